"""WARC archives of web pages and a two-level capture index over them.

Writing: every page becomes a record, each a gzip member of its own, so that one can be read without its neighbours. Of equal payloads of
``least_bytes`` or more, the page with the largest page_id is stored as a response; the others are revisit records that name it and
carry no payload. Which they are is settled on digests alone; a payload only moves if Spark joins the list of revisits by a shuffle.

Index: captures are range-partitioned and sorted by reversed-host URL key; each partition is one index file of zlib-compressed blocks
of ``block_rows`` captures, followed by the file's sparse directory (first and last key, place of each block). The list of index files
(first key, last key, place of the directory) is the only part that leaves the executors, a row per file and at most ``index_files``.

Reading: wanted keys are sent to the files whose key range holds them (binary search over the list), there to the blocks (binary search
over the directory), which are read as byte ranges; the captures found are dealt by archive region, sorted by offset, and read as byte
ranges. A key with very many captures spans blocks and files, and each of them is read by the task that has it.

Archives and index files are written by tasks under names of their own attempt and become known only through the rows of the attempt that
succeeds, so a lost executor or a second attempt leaves at most files that nobody reads.

Defined cases: a null html is an empty payload; a null, empty or odd URL keeps its text as key; line ends in a URL are percent-encoded in
the header; rows repeated under the largest page_id of a payload are responses all; a null page_id is smaller than any other; an empty
table gives no archive, an empty index and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylake.llm.common import cut, small_batches
from tallylake.session import shared_dir

CAPTURE = "key string, page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, archive string, offset long, length long"
RECORD = "key string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 256 << 20  # an archive is closed when it is this long
REGION_BYTES = 16 << 20  # of an archive, read by one task
MOST_READERS = 20_000  # tasks; each then reads several regions
DATE = "2024-01-25T06:00:00Z"


def url_key(url):
    """The reversed-host sort key of a URL column: ``com,example,blog)/path?query``, without scheme, www, default port and fragment."""
    text = F.coalesce(url, F.lit(""))
    pattern = r"^\s*(?i:https?)://(?:[^/?#@]*@)?([^/?#:]+)(:[0-9]+)?([^#]*)"
    host = F.regexp_replace(F.lower(F.regexp_extract(text, pattern, 1)), r"^www[0-9]*\.|\.$", "")
    port = F.regexp_replace(F.regexp_extract(text, pattern, 2), "^:(80|443)$", "")
    rest = F.regexp_extract(text, pattern, 3)
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), port, F.lit(")"), path)
    return F.when(text.rlike(pattern), key).otherwise(text)


def records_of(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """(key, page_id, url, payload, payload_digest, refers_to): what each page's record will hold; no payload in a revisit."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("payload_digest", F.sha1("payload"))
    # of a payload's copies the one with the largest page_id; partial maxima keep a payload that very many pages share small
    copied = (
        read.where(F.octet_length("payload") >= least_bytes).groupBy("payload_digest")
        .agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null").select("payload_digest", "last")
    )
    slim = read.where(F.octet_length("payload") >= least_bytes).select("page_id", "payload_digest")
    revisits = cut(
        slim.join(copied, "payload_digest").where("page_id is null or page_id <> last")
        .select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), F.col("last").alias("refers_to")).distinct())
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest"))
    kept = F.when(F.col("refers_to").isNull(), F.col("payload"))
    return read.join(revisits, same, "left").select(
        url_key(F.col("url")).alias("key"), "page_id", "url", kept.alias("payload"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        "payload_digest", "refers_to")


def _record_id(page_id: int | None, digest: str) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}/{digest}").urn


def _plain(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)


def build_record(page_id, url, payload, payload_bytes, digest, refers_to, date: str = DATE) -> bytes:
    """One uncompressed WARC record. ``payload`` is None in a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    body = http if payload is None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: <{_record_id(page_id, digest)}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_plain(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_record_id(refers_to, digest)}>", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """What a record says: its headers, and of a response the payload with the digest and size that it really has."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    named = {name.lower(): value for name, _, value in (line.partition(": ") for line in lines[1:])}
    size = int(named["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length differs from its header")
    _, _, payload = rest[:size].partition(b"\r\n\r\n")
    stated = base64.b32decode(named["warc-payload-digest"].removeprefix("sha1:")).hex()
    revisit = named["warc-type"] == "revisit"
    if not revisit and hashlib.sha1(payload).hexdigest() != stated:
        raise ValueError("the payload differs from its digest")
    number = lambda name: int(named[name]) if name in named else None
    return {
        "page_id": number("x-page-id"), "url": named.get("warc-target-uri"), "record_type": named["warc-type"], "payload_digest": stated,
        "payload_bytes": None if revisit else len(payload), "refers_to": number("x-refers-to-page-id"), "payload": None if revisit else payload}


class _Folder:
    """A shared folder as tasks see it, on any file system that pyarrow knows."""

    def __init__(self, uri: str) -> None:
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
        self.open_name, self.open_file = None, None

    def create(self, name: str):
        self.fs.create_dir(self.root, recursive=True)
        return self.fs.open_output_stream(f"{self.root}/{name}", compression=None)

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.open_name:
            self.close()
            self.open_name, self.open_file = name, self.fs.open_input_file(f"{self.root}/{name}")
        return self.open_file.read_at(length, offset)

    def close(self) -> None:
        if self.open_file is not None:
            self.open_file.close()
        self.open_name = self.open_file = None


def write_archives(records: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Writes ``records_of`` into archives below ``folder`` and returns the captures, stored."""
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, name, file, at = _Folder(folder), None, None, 0
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (row.page_id, row.refers_to))
                payload = None if refers_to is not None else bytes(row.payload)
                member = gzip.compress(build_record(page_id, row.url, payload, row.payload_bytes, row.payload_digest, refers_to), level, mtime=0)
                if file is None or at >= ARCHIVE_BYTES:
                    if file is not None:
                        file.close()
                    name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    file = place.create(name)
                file.write(member)
                out.append((row.key, page_id, "response" if payload is not None else "revisit", row.payload_digest,
                            row.payload_bytes, refers_to, name, at, len(member)))
                at += len(member)
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in CAPTURE.split(", ")])
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})
        if file is not None:
            file.close()

    return cut(records.mapInPandas(write, CAPTURE))


def write_index(captures: DataFrame, folder: str, index_files: int = 1024, block_rows: int = 3000, file_rows: int = 300_000) -> DataFrame:
    """Writes index files of ``captures`` below ``folder`` and returns their list (file, first, last, directory_at, directory_length, blocks)."""
    files = max(1, min(index_files, -(-captures.count() // file_rows)))
    ordered = captures.repartitionByRange(files, "key", "page_id", "archive", "offset").sortWithinPartitions("key", "page_id", "archive", "offset")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, file, at, directory = f"captures-{uuid.uuid4().hex}.cdx", None, 0, []
        held: list[tuple] = []

        def block() -> None:
            nonlocal file, at, held
            if file is None:
                file = _Folder(folder).create(name)
            data = zlib.compress("\n".join(json.dumps(row) for row in held).encode(), 6)
            file.write(data)
            directory.append((held[0][0], held[-1][0], at, len(data)))
            at, held = at + len(data), []

        for batch in batches:
            for row in batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None):
                held.append(row)
                if len(held) >= block_rows:
                    block()
        if held:
            block()
        if file is not None:
            data = zlib.compress(json.dumps(directory).encode(), 6)
            file.write(data)
            file.close()
            yield pd.DataFrame([(name, directory[0][0], directory[-1][1], at, len(data), len(directory))],
                               columns=["file", "first", "last", "directory_at", "directory_length", "blocks"])

    return cut(ordered.mapInPandas(write, "file string, first string, last string, directory_at long, directory_length long, blocks long"))


def covering(firsts: list[str], lasts: list[str], key: str) -> range:
    """Which of sorted, neighbouring key ranges may hold ``key``: several where it was cut at their edges."""
    return range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))


def look_up(keys: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """The captures of all ``key`` values of ``keys`` (distinct, not null)."""
    files = sorted((row["first"], row["last"], row["file"], row["directory_at"], row["directory_length"]) for row in index.collect())  # at most ``index_files``
    firsts, lasts = [f[0] for f in files], [f[1] for f in files]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hits = [(key, n) for key in batch["key"] for n in covering(firsts, lasts, key)]
            yield pd.DataFrame(hits, columns=["key", "n"]).astype({"n": "int32"})

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, file, directory = _Folder(folder), None, []
        block, rows = None, {}
        for batch in batches:
            out = []
            for key, n in zip(batch["key"], batch["n"], strict=True):
                if n != file:
                    file, block = n, None
                    directory = json.loads(zlib.decompress(place.read(files[n][2], files[n][3], files[n][4])))
                    starts, stops = [d[0] for d in directory], [d[1] for d in directory]
                for b in covering(starts, stops, key):
                    if b != block:
                        block, rows = b, {}
                        for line in zlib.decompress(place.read(files[n][2], directory[b][2], directory[b][3])).decode().split("\n"):
                            row = json.loads(line)
                            rows.setdefault(row[0], []).append(row)
                    out.extend(rows.get(key, ()))
                    if len(out) > 20_000:
                        yield _captures(out)
                        out = []
            yield _captures(out)
        place.close()

    # wanted keys of one file may be dealt to several tasks; each opens the blocks that its keys need
    routed = keys.select("key").mapInPandas(route, "key string, n int")
    return routed.repartitionByRange("n", "key").sortWithinPartitions("n", "key").mapInPandas(find, CAPTURE)


def _captures(rows: list) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in CAPTURE.split(", ")])
    return frame.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64", "offset": "Int64", "length": "Int64"})


def read_records(captures: DataFrame, folder: str, payloads: bool = True, regions: int = 1) -> DataFrame:
    """The records at the places that ``captures`` name, parsed and verified; without their payloads if these aren't wanted.

    ``regions`` is how many regions the archives have: places are small, so their bytes don't tell how much there is to read."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = _Folder(folder)
        columns = [c.split()[0] for c in RECORD.split(", ")]
        for batch in batches:
            out, held = [], 0
            for key, archive, offset, length in zip(batch["key"], batch["archive"], batch["offset"], batch["length"], strict=True):
                record = parse_record(gzip.decompress(place.read(archive, int(offset), int(length))))
                if payloads:
                    held += len(record["payload"] or b"")
                else:
                    record["payload"] = None
                out.append(record | {"key": key})
                if held > 4 << 20:
                    yield pd.DataFrame(out, columns=columns).astype({c: "Int64" for c in ("page_id", "payload_bytes", "refers_to")})
                    out, held = [], 0
            yield pd.DataFrame(out, columns=columns).astype({c: "Int64" for c in ("page_id", "payload_bytes", "refers_to")})
        place.close()

    slim = captures.select("key", "archive", "offset", "length", F.floor(F.col("offset") / REGION_BYTES).alias("region"))
    return slim.repartition(min(regions, MOST_READERS), "archive", "region").sortWithinPartitions("archive", "offset").mapInPandas(read, RECORD)


class Archive:
    """Pages written as WARC archives with their capture index."""

    def __init__(self, folder: str, index: DataFrame, regions: int) -> None:
        self.folder, self.index, self.regions = folder, index, regions

    @classmethod
    def of_pages(cls, pages: DataFrame, least_bytes: int = 1000, block_rows: int = 3000) -> Archive:
        small_batches(pages.sparkSession)
        folder = shared_dir(pages.sparkSession, "warc")
        captures = write_archives(records_of(pages, least_bytes), folder)
        regions = captures.agg(F.sum("length").alias("n")).first()["n"] or 0
        return cls(folder, write_index(captures, folder, block_rows=block_rows), 1 + regions // REGION_BYTES)

    def read(self, keys: DataFrame, payloads: bool = True) -> DataFrame:
        """The records of the wanted keys; a revisit has no payload."""
        return read_records(look_up(keys.where("key is not null").select("key").distinct(), self.index, self.folder), self.folder, payloads, self.regions)


def written_and_read(pages: DataFrame) -> DataFrame:
    """Every page as its archive tells it, sizes of revisits taken from the responses they name."""
    archive = Archive.of_pages(pages)
    records = cut(archive.read(pages.select(url_key(F.col("url")).alias("key")), payloads=False))
    named = records.where("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"), F.col("payload_digest"), F.col("payload_bytes").alias("_full")).distinct()
    revisits = records.where("record_type = 'revisit'").join(named, ["refers_to", "payload_digest"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return records.where("record_type = 'response'").select(*columns).union(
        revisits.withColumn("payload_bytes", F.col("_full")).select(*columns))
