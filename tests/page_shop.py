"""A live paged source for tests, where Spark's workers can import it."""

from __future__ import annotations

import json

from tallylake.sources import paged


class Shop:
    """A live source of ``size`` records that gets ``later`` more once it was planned."""

    def __init__(self, options):
        self.limit, self.size, self.later = int(options["limit"]), int(options["size"]), int(options.get("later", 0))

    def lists(self):
        return ["one", "two"]

    def offsets(self, name):
        return paged.probed_offsets(lambda o: {"record_count": int(o < self.size)}, self.limit)

    def page(self, name, offset):
        size = self.size + self.later
        records = [{"product_id": f"{name}-{n:04d}"} for n in range(offset, min(size, offset + self.limit))]
        return json.dumps({"data": records, "pagination": {"has_more": offset + self.limit < size}})
