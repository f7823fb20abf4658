"""WARC archives of page captures and a globally ordered index of them by external merging.

Writing: each task writes one gzip-per-record archive; the first capture of a payload is a response, captures
with an equal payload are revisits that name it.  Reading: each archive is streamed, payload digests are checked,
and its captures become locally sorted runs (Parquet files of bounded size with row-group statistics).  Merging:
a loser tree merges at most ``FAN`` runs by (URL key, timestamp, id); more runs are first merged in groups.  The
last pass runs one task per key range, cut from samples of the runs, and reads only the row groups it needs, so
the result's partitions follow each other in global order even if one URL holds a third of the captures.

Defined results.  Null html: an empty payload.  Null url: the empty URL key.  Null page_id: always a response, and
no revisit names it.  Repeated page_ids: each row with the smallest id of its payload is a response.  Null
timestamps sort first.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import ast
import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

FAN = 64
RUN_ROWS = 200_000
GROUP_ROWS = 4096
SAMPLE_ROWS = 512
#: Key ranges of the last pass; with more captures each range grows, in batches.
MOST_TASKS = 4000
URL = re.compile(r"^[a-z][a-z0-9+.-]*://([^/?#]*)([^#]*)", re.S)
CAPTURE = pa.schema([("url_key", pa.string()), ("captured_at", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("position", pa.int64())])
CAPTURE_DDL = "url_key string, captured_at long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, position long"


def url_key(url: str | None) -> str:
    """Host labels from the last to the first, then path and query, lower case; no scheme, www or fragment."""
    low = (url or "").lower()
    m = URL.match(low)
    if not m:
        return low
    return ",".join(reversed(m[1].removeprefix("www.").split("."))) + ")" + (m[2] or "/")


def header_safe(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id, url, at, payload: bytes, refers_to) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    name = lambda k: f"<urn:page:{k}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    head.append(f"WARC-Record-ID: {name(page_id) if page_id is not None else f'<urn:uuid:{uuid.uuid4()}>'}")
    if url is not None:
        head.append(f"WARC-Target-URI: {header_safe(url)}")
    if at is not None:
        head.append(f"WARC-Date: {at}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(f, at_once: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of an open file."""
    start, data = 0, b""
    while True:
        if not data:
            data = f.read(at_once)
            if not data:
                return
        z, parts, used = zlib.decompressobj(31), [], 0
        while not z.eof:
            if not data:
                data = f.read(at_once)
                if not data:
                    raise EOFError("the archive ends within a record")
            parts.append(z.decompress(data))
            used += len(data) - len(z.unused_data)
            data = z.unused_data
        yield start, b"".join(parts)
        start += used


def parse(content: bytes) -> dict:
    """A record's capture; raises if its payload does not fit its digest."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("payload and digest differ")
    page = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))) else None
    at = fields.get("WARC-Date")
    return {"url_key": url_key(fields.get("WARC-Target-URI")), "captured_at": int(at) if at else None, "page_id": page("WARC-Record-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page("WARC-Refers-To")}


def order(c: dict) -> tuple:
    """URL key by code point (its UTF-8 bytes' order), timestamp, id; nulls first."""
    at, page = c["captured_at"], c["page_id"]
    return (c["url_key"], at is not None, at or 0, page is not None, page or 0)


class LoserTree:
    """K-way merge of sorted iterators: each inner node keeps the loser of its match, the top the winner."""

    def __init__(self, sources: list[Iterator[dict]]):
        self.sources = [iter(s) for s in sources]
        self.k = k = max(1, len(self.sources))
        self.heads: list = [None] * k
        self.keys: list = [None] * k
        for n in range(len(self.sources)):
            self.step(n)
        self.losers = [-1] * k
        for n in range(k):
            self.play(n)

    def step(self, n: int) -> None:
        c = self.heads[n] = next(self.sources[n], None)
        self.keys[n] = None if c is None else order(c)

    def beats(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return y is None if x is None else y is None or (x, a) < (y, b)

    def play(self, n: int) -> None:
        """Source n goes up; the first one to reach an empty node waits there."""
        node, who = (n + self.k) // 2, n
        while node > 0:
            if self.losers[node] < 0:
                self.losers[node] = who
                return
            if self.beats(self.losers[node], who):
                self.losers[node], who = who, self.losers[node]
            node //= 2
        self.losers[0] = who

    def __iter__(self) -> Iterator[dict]:
        while self.heads and self.heads[n := self.losers[0] if self.k > 1 else 0] is not None:
            yield self.heads[n]
            self.step(n)
            node, who = (n + self.k) // 2, n
            while node > 0:
                if self.beats(self.losers[node], who):
                    self.losers[node], who = who, self.losers[node]
                node //= 2
            self.losers[0] = who


def open_at(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_run(uri: str, rows: Iterator[dict]) -> tuple[int, list[str]]:
    """A sorted run; returns its length and the order keys of every SAMPLE_ROWS-th row, as text."""
    system, path = open_at(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    n, marks, batch = 0, [], []
    with pq.ParquetWriter(path, CAPTURE, filesystem=system, compression="zstd") as out:
        for c in rows:
            if n % SAMPLE_ROWS == SAMPLE_ROWS // 2:
                marks.append(repr(order(c)))
            n += 1
            batch.append(c)
            if len(batch) == GROUP_ROWS:
                out.write_table(pa.Table.from_pylist(batch, CAPTURE))
                batch = []
        if batch:
            out.write_table(pa.Table.from_pylist(batch, CAPTURE))
    return n, marks


def read_run(uri: str, low: tuple | None = None, high: tuple | None = None) -> Iterator[dict]:
    """Captures from low up to but not including high, by the row groups that may hold them."""
    system, path = open_at(uri)
    with pq.ParquetFile(system.open_input_file(path)) as f:
        for g in range(f.num_row_groups):
            s = f.metadata.row_group(g).column(0).statistics
            if s is not None and s.has_min_max and (low is not None and s.max < low[0] or high is not None and s.min > high[0]):
                continue
            for c in f.read_row_group(g).to_pylist():
                k = order(c)
                if (low is None or k >= low) and (high is None or k < high):
                    yield c


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", at: str = "captured_at", least: int = 0) -> DataFrame:
    """Write the archives; returns their manifest (a table in the shared folder)."""
    rows = pages.select(F.col(key).cast("long").alias("k"), F.col(url).alias("u"), F.col(at).cast("long").alias("at"), F.coalesce(html, F.lit("")).alias("h"))
    narrow = rows.select("k", F.sha1(F.encode("h", "UTF-8")).alias("d"), F.octet_length("h").alias("n")).where(f"n >= {int(least)}")
    first = narrow.groupBy("d").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    revisits = narrow.join(first, "d").where("k > first").select("k", "d", "first").distinct()  # an id may have several payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = next(batches, None)
        if head is None:
            return
        uri = f"{path}/captures-{uuid.uuid4().hex}.warc.gz"  # an attempt that fails leaves a file no manifest names
        system, name = open_at(uri)
        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
        n = 0
        with system.open_output_stream(name, compression=None) as out:
            while head is not None:
                for k, u, t, h, ref in zip(*(head.column(c).to_pylist() for c in ("k", "u", "at", "h", "first"))):
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(z.compress(record(k, u, t, h.encode("utf-8", "surrogatepass"), ref)) + z.flush())
                    n += 1
                head = next(batches, None)
        yield pa.RecordBatch.from_pydict({"archive": [uri], "records": [n]})

    return common.as_table(pages.sparkSession, rows.withColumn("d", F.sha1(F.encode("h", "UTF-8"))).join(revisits, ["k", "d"], "left").drop("d").mapInArrow(run, "archive string, records long"), "warc-manifest")


def runs(manifest: DataFrame, path: str) -> DataFrame:
    """Read every archive back into sorted runs of bounded size; one row per run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive in b.column(0).to_pylist():
                system, name = open_at(archive)
                held: list[dict] = []

                def spill() -> pa.RecordBatch:
                    held.sort(key=order)
                    uri = f"{path}/run-{uuid.uuid4().hex}.parquet"
                    n, marks = write_run(uri, iter(held))
                    held.clear()
                    return pa.RecordBatch.from_pydict({"run": [uri], "n": [n], "marks": [marks]}, pa.schema([("run", pa.string()), ("n", pa.int64()), ("marks", pa.list_(pa.string()))]))

                with system.open_input_file(name) as f:
                    for offset, content in members(f):
                        held.append(parse(content) | {"archive": archive, "position": offset})
                        if len(held) == RUN_ROWS:
                            yield spill()
                if held:
                    yield spill()

    spread = manifest.select("archive").repartition(max(1, manifest.count()))
    return common.as_table(manifest.sparkSession, spread.mapInArrow(run, "run string, n long, marks array<string>"), "warc-runs")


def merge(found: DataFrame, path: str, task_rows: int = 50_000) -> DataFrame:
    """All captures in global order; partition i holds what comes before partition i + 1."""
    spark = found.sparkSession
    while found.count() > FAN:

        def combine(part: pa.Table) -> pa.Table:
            uri = f"{path}/run-{uuid.uuid4().hex}.parquet"
            n, marks = write_run(uri, iter(LoserTree([read_run(r) for r in part.column("run").to_pylist()])))
            return pa.table({"run": [uri], "n": [n], "marks": pa.array([marks], pa.list_(pa.string()))})

        # numbered one by one, so no group exceeds FAN: a row of a path per run
        numbered = found.select("run", F.floor((F.row_number().over(Window.orderBy("run")) - 1) / FAN).alias("g"))
        found = common.as_table(spark, numbered.groupBy("g").applyInArrow(combine, "run string, n long, marks array<string>"), "warc-runs")
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = min(MOST_TASKS, max(1, -(-total // task_rows)))
    # at most 32 order keys a task come to the driver, 128,000 in all: enough to cut even ranges
    keep = max(1, total // SAMPLE_ROWS // (32 * tasks))
    marks = sorted(ast.literal_eval(r[0]) for r in found.select(F.posexplode("marks")).where(F.col("pos") % keep == 0).select("col").toLocalIterator())
    cuts = [marks[len(marks) * n // tasks] for n in range(1, tasks)] if marks else []
    ranges = list(zip([None, *cuts], [*cuts, None]))
    files = [r[0] for r in found.select("run").collect()]  # at most FAN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in b.column(0).to_pylist():
                batch: list[dict] = []
                for c in LoserTree([read_run(f, *ranges[n]) for f in files]):
                    batch.append(c)
                    if len(batch) == GROUP_ROWS:
                        yield pa.RecordBatch.from_pylist(batch, CAPTURE)
                        batch = []
                if batch:
                    yield pa.RecordBatch.from_pylist(batch, CAPTURE)

    return spark.range(0, len(ranges), 1, len(ranges)).mapInArrow(run, CAPTURE_DDL)


def with_time(pages: DataFrame) -> DataFrame:
    """The synthetic pages have no capture time: seconds of 2024 that follow from page_id."""
    return pages.withColumn("captured_at", F.expr("1704067200 + pmod(page_id * 7919, 31536000)"))


def op5_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "warc")
    manifest = write(with_time(common.read(spark, sf_dir, "pages")), path)
    return merge(runs(manifest, path), path).drop("archive", "position")


ORACLE = r"""
WITH p AS (
  SELECT page_id, lower(coalesce(url, '')) AS u, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d,
         1704067200 + ((page_id * 7919) % 31536000 + 31536000) % 31536000 AS captured_at
  FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p GROUP BY d),
parts AS (
  SELECT p.*, first_id, regexp_matches(u, '^[a-z][a-z0-9+.-]*://') AS ok,
         regexp_replace(regexp_extract(u, '^[a-z][a-z0-9+.-]*://([^/?#]*)([^#]*)', 1), '^www\.', '') AS host,
         regexp_extract(u, '^[a-z][a-z0-9+.-]*://([^/?#]*)([^#]*)', 2) AS path
  FROM p JOIN f USING (d))
SELECT CASE WHEN ok THEN array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END ELSE u END AS url_key,
       captured_at, page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((((strpos('0123456789abcdef', substr(d || '0', CAST(i * 5 // 4 + 1 AS INTEGER), 1)) - 1) * 16
             + strpos('0123456789abcdef', substr(d || '0', CAST(i * 5 // 4 + 2 AS INTEGER), 1)) - 1) // CAST(pow(2, 3 - (i * 5) % 4) AS INTEGER)) % 32 + 1 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM parts
"""
