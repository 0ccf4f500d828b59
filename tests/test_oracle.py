"""Every registered query against its SQL."""

from __future__ import annotations

import importlib.util
import os

import pytest

import __spark_entry__ as entry

_path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools", "check_oracle.py")
_spec = importlib.util.spec_from_file_location("check_oracle", _path)
check = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(check)


@pytest.fixture(scope="module")
def duck(sf):
    return check.connect(sf)


def test_entry_and_keys(spark):
    assert entry.entry(spark).columns[:2] == ["tenant_id", "product_id"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, sf, name):
    frame = entry.queries()[name](spark, sf)
    mine = [tuple(r) for r in frame.collect()]
    result = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(frame.columns)
    kinds = {c[0]: check.family(str(c[1])) for c in result.description}
    assert {n: check.family(t) for n, t in frame.dtypes} == kinds
    assert check.bag(frame.columns, mine) == check.bag(columns, result.fetchall())
