"""Lists that come in pages, as a Spark data source: one task per range of offsets.

A page is a JSON envelope: ``data`` (the records), ``metadata`` and ``pagination`` (offset, limit, record_count, has_more). A list ends with the
first page that is empty or has no successor; pages beyond it are leftovers of an older, longer list. Only page *headers* are looked at
while a read is planned: they tell where a list ends, and its pages are dealt to tasks in ranges. Pages are handed on as text and
parsed in the JVM with the declared schema, in the one scan that there is.

``spark.read.format("tallylake_pages")`` gives (list, offset, body) and takes the options

* ``path``: pages landed as ``list=<name>/offset=<n>/<file>.json``, on any file system that pyarrow knows; or
* ``client``: ``module:Class`` of a live source with ``lists``, ``offsets`` and ``page`` like :class:`LandedPages`, made with all options;
* ``pagesPerTask``: how many pages a task reads (50), ``limit``: records per page of a live source (200).

``spark.readStream.format("tallylake_pages")`` reads the same pages as they appear, each once; its offset is the last page of each list.
"""

from __future__ import annotations

import importlib
import json
import urllib.parse
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tallylake.operators.retail import updated_since

FORMAT = "tallylake_pages"
SCHEMA = "list string, offset long, body string"
HEADER_BYTES = 4096
PAGE_METADATA = "struct<tenant_id: string, source_system: string, entity: string, schema_version: string, record_count: int>"
PAGE_POSITION = "struct<record_count: int, `limit`: int, offset: bigint, has_more: boolean>"


def page_schema(record: T.StructType) -> T.StructType:
    """Envelope of one page: the records, what they are, and where the page stands in its list."""
    return T.StructType([
        T.StructField("data", T.ArrayType(record)),
        T.StructField("metadata", T.StructType.fromDDL(f"m {PAGE_METADATA}").fields[0].dataType),
        T.StructField("pagination", T.StructType.fromDDL(f"p {PAGE_POSITION}").fields[0].dataType),
    ])


def is_last(header: dict | None) -> bool:
    """Whether a list ends with the page of this header; a list without a page has ended before it."""
    return header is None or not header["record_count"] or not header.get("has_more")


def header_of(envelope: dict) -> dict:
    return {**(envelope.get("pagination") or {}), "record_count": len(envelope.get("data") or ())}


class LandedPages:
    """Pages in files, one each, below ``path``."""

    def __init__(self, options: dict[str, str]) -> None:
        from pyarrow import fs

        path = options["path"]
        self.fs, self.root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        self.found: dict[str, dict[int, str]] | None = None

    def files(self) -> dict[str, dict[int, str]]:
        """{list: {offset: file}}, listed once per plan."""
        if self.found is None:
            from pyarrow import fs

            self.found = {}
            for info in self.fs.get_file_info(fs.FileSelector(self.root, recursive=True, allow_not_found=True)):
                parts = info.path.split("/")
                if info.path.endswith(".json") and len(parts) > 2 and parts[-3].startswith("list=") and parts[-2].startswith("offset="):
                    name = urllib.parse.unquote(parts[-3].removeprefix("list="))
                    self.found.setdefault(name, {})[int(parts[-2].removeprefix("offset="))] = info.path
        return self.found

    def lists(self) -> list[str]:
        return sorted(self.files())

    def header(self, name: str, offset: int) -> dict | None:
        """The ``pagination`` part of a page, from the end of its file."""
        path = self.files().get(name, {}).get(offset)
        if path is None:
            return None
        with self.fs.open_input_file(path) as file:
            size = file.size()
            tail = file.read_at(min(size, HEADER_BYTES), max(0, size - HEADER_BYTES)).decode("utf-8", "replace")
            at = tail.rfind('"pagination":')
            header = json.JSONDecoder().raw_decode(tail[at + len('"pagination":'):].lstrip())[0] if at >= 0 else {}
            if "record_count" not in header:  # other fields come last, or the count is left out
                header = header_of(json.loads(file.read_at(size, 0)))
        return header

    def offsets(self, name: str) -> list[int]:
        """Offsets of the list's pages up to its end. Headers are read some at a time."""
        known, out = sorted(self.files().get(name, {})), []
        with ThreadPoolExecutor(16) as pool:
            for at in range(0, len(known), 64):
                some = known[at:at + 64]
                for offset, header in zip(some, pool.map(lambda o: self.header(name, o), some), strict=True):
                    out.append(offset)
                    if is_last(header):
                        return out
        return out

    def page(self, name: str, offset: int) -> str | None:
        path = self.files().get(name, {}).get(offset)
        if path is None:
            return None
        with self.fs.open_input_stream(path) as file:
            return file.read().decode()


class HttpPages:
    """A live source: ``url`` answers ``?limit=&offset=`` with envelopes, per tenant in a header. Its pages are planned by probing.

    Options: ``url``, ``tenants`` (comma-separated), ``limit``, ``since``, ``timeoutSeconds``, ``attempts``.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.limit = options, int(options.get("limit", "200"))

    def lists(self) -> list[str]:
        return [t.strip() for t in self.options["tenants"].split(",")]

    def get(self, name: str, offset: int, limit: int) -> str:
        query = {"limit": limit, "offset": offset} | ({"updated_since": self.options["since"]} if self.options.get("since") else {})
        request = urllib.request.Request(f"{self.options['url']}?{urllib.parse.urlencode(query)}", headers={"X-Tenant-ID": name})
        attempts = int(self.options.get("attempts", "3"))
        for attempt in range(attempts):
            try:
                with urllib.request.urlopen(request, timeout=float(self.options.get("timeoutseconds", "30"))) as answer:
                    return answer.read().decode()
            except OSError:
                if attempt + 1 == attempts:
                    raise
        raise AssertionError("attempts must be at least 1")

    def header(self, name: str, offset: int) -> dict | None:
        """The header of the page of one record at ``offset``."""
        return header_of(json.loads(self.get(name, offset, 1)))

    def offsets(self, name: str) -> list[int]:
        return probed_offsets(lambda offset: self.header(name, offset), self.limit)

    def page(self, name: str, offset: int) -> str | None:
        return self.get(name, offset, self.limit)


def probed_offsets(header, limit: int) -> list[int]:
    """Page offsets of a list whose length is unknown: its last record is found by doubling and halving over one-record headers."""
    holds = lambda at: bool((header(at) or {"record_count": 0})["record_count"])
    if not holds(0):
        return [0]
    low, high = 0, limit
    while holds(high):
        low, high = high, 2 * high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return list(range(0, low + 1, limit))


@dataclass
class PageRange(InputPartition):
    """Neighbouring pages of a list. The range at its end also takes the pages that a live list has got since."""

    name: str
    offsets: list[int]
    at_end: bool


def client_of(options: dict[str, str]):
    if "client" not in options:
        return LandedPages(options)
    module, _, name = options["client"].partition(":")
    return getattr(importlib.import_module(module), name)(options)


def _ranges(name: str, offsets: list[int], per_task: int, open_end: bool) -> list[PageRange]:
    cuts = range(0, len(offsets), per_task)
    return [PageRange(name, offsets[at:at + per_task], open_end and at + per_task >= len(offsets)) for at in cuts]


def _read(options: dict[str, str], pages: PageRange | None) -> Iterator[tuple]:
    if pages is None:  # a plan without partitions
        return
    client = client_of(options)
    offset, left = None, list(pages.offsets)
    while left or pages.at_end:
        if left:
            offset = left.pop(0)
        else:
            offset += int(options.get("limit", "200"))
        body = client.page(pages.name, offset)
        if body is None:
            return
        yield pages.name, offset, body
        if pages.at_end and not left:
            if is_last(header_of(json.loads(body))):
                return


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        client, per_task = client_of(self.options), int(self.options.get("pagespertask", "50"))
        live = "client" in self.options
        return [p for name in client.lists() for p in _ranges(name, client.offsets(name), per_task, live)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _read(self.options, partition)


class PagedStreamReader(DataSourceStreamReader):
    """New pages of every list, each once; a page does not change after it was landed."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        client = client_of(self.options)
        return {name: offsets[-1] for name in client.lists() if (offsets := client.offsets(name))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        client, per_task = client_of(self.options), int(self.options.get("pagespertask", "50"))
        new = {name: [o for o in client.offsets(name) if start.get(name, -1) < o <= upto] for name, upto in end.items()}
        return [p for name, offsets in new.items() for p in _ranges(name, offsets, per_task, False)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _read(self.options, partition)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def _plain(self) -> dict[str, str]:
        return {key.lower(): value for key, value in self.options.items()}  # clients see names in lower case

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PagedReader(self._plain())

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return PagedStreamReader(self._plain())


def records_of(pages: DataFrame, record: T.StructType) -> DataFrame:
    """The records of (list, offset, body) pages."""
    return pages.select(F.from_json("body", page_schema(record)).alias("page")).select(F.inline("page.data"))


def paged_source_read(spark: SparkSession, path: str | None, record: T.StructType, since: str | None = None, **options: str) -> DataFrame:
    """Records of all pages of a source (landed below ``path``, or of the ``client`` in ``options``), changed since ``since``."""
    spark.dataSource.register(PagedSource)
    reader = spark.read.format(FORMAT).options(**options)
    return updated_since(records_of(reader.load(path) if path else reader.load(), record), since)


def paged_source_stream(spark: SparkSession, path: str | None, record: T.StructType, **options: str) -> DataFrame:
    """The same records as a stream of new pages."""
    spark.dataSource.register(PagedSource)
    reader = spark.readStream.format(FORMAT).options(**options)
    return records_of(reader.load(path) if path else reader.load(), record)


def paged_source_write(records: DataFrame, path: str, entity: str, page_size: int, order: list[str]) -> None:
    """Land a table as pages. Rows are numbered within hash slices of each tenant, and each slice is a list of its own, so no task
    holds more than a slice, however large the tenant."""
    slices = records.sparkSession.conf.get("spark.sql.shuffle.partitions")
    sliced = records.withColumn("_slice", F.expr(f"pmod(xxhash64({', '.join(order)}), {slices})"))
    numbered = sliced.withColumn("_n", F.row_number().over(Window.partitionBy("tenant_id", "_slice").orderBy(*order)) - 1)
    body = F.struct(*records.columns)
    key = ["tenant_id", "_slice"]
    paged = numbered.withColumn("_page", F.floor(F.col("_n") / page_size)).groupBy(*key, "_page").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_n", body.alias("r")))), lambda x: x["r"]).alias("data")
    )
    totals = sliced.groupBy(*key).agg(F.count(F.lit(1)).alias("_total"))
    offset = F.col("_page") * page_size
    name = F.concat_ws("#", F.lit(entity), "_slice")
    envelope = paged.join(totals, key).select(
        F.concat_ws("/", F.coalesce("tenant_id", F.lit("")), name).alias("list"), offset.alias("offset"),
        "data",
        F.struct("tenant_id", F.lit("source").alias("source_system"), name.alias("entity"),
                 F.lit("1.0").alias("schema_version"), F.size("data").alias("record_count")).alias("metadata"),
        F.struct(F.size("data").alias("record_count"), F.lit(page_size).alias("limit"), offset.alias("offset"),
                 (offset + page_size < F.col("_total")).alias("has_more")).alias("pagination"),
    )
    envelope.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("list", "offset").json(path)
