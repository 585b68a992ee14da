"""WARC archives of pages, and their capture index by an external merge.

Writing: one record per page, payload the page in UTF-8. Of records with equal
payloads of at least ``REVISIT_BYTES`` bytes the one with the largest page_id
is the response and the others are revisits that carry its HTTP head only.
Records are built by column expressions and written by Spark's text writer
(gzip, records end with two line breaks), so files commit like any other table.

Reading: each file is streamed record by record and gives one capture run,
sorted by URL key and time inside its task. The runs are then dealt over key
ranges, and each range merges its runs with a loser tree; ranges follow each
other, so positions number all captures in global order.

Definitions for odd input. A null page has an empty payload; a null url gives
no target and the key ''; blanks and control characters in a url are written as
%20. A null page_id is written as such and never referred to: equal payloads
that have no other id are all responses. Rows that repeat the largest page_id
of a payload are all responses. An empty table gives empty archives and no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import salted_join, scratch, stored, trimmed

REVISIT_BYTES = 1000
#: Records in one archive file, and captures in one merge range.
RECORDS_PER_FILE = 2_000
RANGE_ROWS = 50_000
MAX_RANGES = 10_000
CRLF = "\r\n"
#: Fixed profile name of revisits with an identical payload (WARC 1.0).
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def captures(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, date."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("long")) \
        .withColumn("payload_digest", F.sha1(F.col("payload").cast("binary")))
    seconds = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(366 * 86400))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (seconds / 86400).cast("int")).cast("string")
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    p = p.withColumn("date", F.concat(day, F.lit("T"), two(seconds % 86400 / 3600), F.lit(":"), two(seconds % 3600 / 60), F.lit(":"),
                                      two(seconds % 60), F.lit("Z")))
    same = p.filter(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest", "payload_bytes") \
        .agg(F.max("page_id").alias("_latest"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    p = salted_join(p, same, ["payload_digest", "payload_bytes"], F.coalesce("page_id", F.lit(0)))
    revisit = F.col("_latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_latest"))
    return p.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")) \
        .withColumn("refers_to", F.when(revisit, F.col("_latest"))).drop("_latest")


def _record() -> Column:
    """The text of a record up to its closing line breaks."""
    uuid = F.md5(F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "url", "payload_digest"))
    urn = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(uuid, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    is_revisit = F.col("record_type") == "revisit"
    block = F.octet_length(head) + F.when(is_revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    return F.concat(
        F.lit("WARC/1.0" + CRLF), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", urn), line("WARC-Date", F.col("date")),
        optional("WARC-Target-URI", uri), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        optional("X-Page-ID", F.col("page_id").cast("string")),
        F.when(is_revisit, line("WARC-Profile", F.lit(PROFILE))).otherwise(F.lit("")),
        optional("X-Refers-To-Page", F.col("refers_to").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response" + CRLF), line("Content-Length", block.cast("string")), F.lit(CRLF),
        head, F.when(is_revisit, F.lit("")).otherwise(F.col("payload")))


def write(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write ``pages`` as WARC files below ``path``."""
    captures(pages).select(_record().alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip") \
        .option("maxRecordsPerFile", records_per_file).text(path)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b": ")
            headers[name.decode().lower()] = value.decode()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("truncated WARC record")
        yield headers, block


def url_key(url: str) -> str:
    """Sort-friendly form: reversed host, path and sorted query; no scheme, www or fragment."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return url.lower()
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{query}" if query else "")


_RUN_SCHEMA = "run string, seq long, url_key string, date string, page_id long, payload_bytes long, payload_digest string, " \
              "record_type string, refers_to long"
_RUN_TYPES = pa.schema([("run", pa.string()), ("seq", pa.int64()), ("url_key", pa.string()), ("date", pa.string()), ("page_id", pa.int64()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_FIRST = -(1 << 63)


def _read_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted capture run per archive file, with payloads checked against their digests."""
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            run = []
            with gzip.GzipFile(fileobj=io.BytesIO(memoryview(content.as_buffer()))) as stream:
                for headers, block in records(stream):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    http = dict(x.split(": ", 1) for x in head.decode().split(CRLF)[1:])
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    if headers["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {headers['warc-record-id']} differs from its digest")
                    page, refers = headers.get("x-page-id"), headers.get("x-refers-to-page")
                    run.append((url_key(headers.get("warc-target-uri", "")) if "warc-target-uri" in headers else "", headers["warc-date"],
                                int(page) if page is not None else _FIRST, int(http["Content-Length"]), digest, headers["warc-type"],
                                int(refers) if refers is not None else None))
            run.sort(key=lambda x: x[:3])
            if run:
                name = path.as_py().rsplit("/", 1)[-1]
                columns = [list(c) for c in zip(*run, strict=True)]
                columns[2] = [None if x == _FIRST else x for x in columns[2]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([[name] * len(run), range(len(run)), *columns], _RUN_TYPES.types, strict=True)],
                                                 schema=_RUN_TYPES)


class LoserTree:
    """Merges sorted sequences: inner nodes hold the loser of their match, so
    the next winner is found by replaying one path."""

    def __init__(self, sequences: list[list]):
        self.sequences = [s for s in sequences if s]
        self.at = [0] * len(self.sequences)
        self.k = max(1, len(self.sequences))
        self.losers = [-1] * self.k
        self.champion = self._play(1) if self.sequences else -1

    def _head(self, i: int):
        return self.sequences[i][self.at[i]] if self.at[i] < len(self.sequences[i]) else None

    def _wins(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or x == y and a < b

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (a, b) if self._wins(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator:
        """(sequence number, position in it) in merged order."""
        while self.champion >= 0 and self._head(self.champion) is not None:
            i = self.champion
            yield i, self.at[i]
            self.at[i] += 1
            node = (i + self.k) // 2
            while node:
                if self._wins(self.losers[node], i):
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.champion = i


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the runs of one key range (rows by run and place in it)."""
    table = pa.Table.from_batches(list(batches), schema=None) if (batches := [b for b in batches if b.num_rows]) else None
    if table is None:
        return
    keys = list(zip(table.column("url_key").to_pylist(), table.column("date").to_pylist(),
                    [_FIRST if x is None else x for x in table.column("page_id").to_pylist()], strict=True))
    names = table.column("run").to_pylist()
    cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
    order = [cuts[i] + j for i, j in LoserTree([keys[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])]
    merged = table.take(pa.array(order, pa.int64())).drop_columns(["run", "seq"]).append_column("place", pa.array(range(len(order)), pa.int64()))
    yield from merged.combine_chunks().to_batches()


def index(spark: SparkSession, path: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Captures of all archives below ``path`` with their position in global (URL key, time) order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    runs = stored(files.mapInArrow(trimmed(_read_runs), _RUN_SCHEMA), "capture-runs")
    ranges = min(MAX_RANGES, 1 + runs.count() // range_rows)
    merged = runs.repartitionByRange(ranges, "url_key", "date", "page_id").withColumn("range", F.spark_partition_id().cast("long"))
    merged = merged.sortWithinPartitions("run", "seq")
    schema = "url_key string, date string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, " \
             "range long, place long"
    merged = stored(merged.mapInArrow(trimmed(_merge), schema), "capture-index")
    # at most MAX_RANGES rows
    sizes = merged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()
    before, total = [], 0
    for r in sorted(sizes):
        before.append((r["range"], total))
        total += r["n"]
    offsets = spark.createDataFrame(before, "range long, offset long")
    return merged.join(F.broadcast(offsets), "range") \
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "date", (F.col("offset") + F.col("place")).alias("position"))


def archive(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back and index them."""
    path = scratch(pages.sparkSession, "warc")
    write(pages, path)
    return index(pages.sparkSession, path)
