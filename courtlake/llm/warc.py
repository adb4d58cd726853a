"""WARC archives, and the index of captures merged from the archives' sorted runs."""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import cut

#: Payloads from this size on are stored once; bytes that one archive file holds about.
SHORTEST, FILE_BYTES = 100, 24 << 20
#: Index rows that one task merges about.
SLICE = 50_000
INDEX = "urlkey string, time string, id long, record_type string, refers_to long, payload_bytes long, payload_digest string, file string, offset long, length long, run long, seq int"


def capture_time(id_col: str) -> Column:
    """When a table has no capture time: a fixed second of 2024 for each id."""
    return F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce(F.col(id_col), F.lit(0)), F.lit(31536000)))


def write_archives(pages: DataFrame, path: str, id_col: str, url_col: str, body_col: str, time: Column | None = None, shortest: int = SHORTEST) -> None:
    """Write one record for each row as packed WARC/1.1 files.

    Of rows with equal payloads of `shortest` bytes or more, that with the smallest id is the response and the others
    revisit it. Spark's text writer, with the blank lines that end a record as its separator, commits whole files to
    any file system. Payloads are shuffled once, by a hash of the row.
    """
    body = F.coalesce(F.col(body_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), body.alias("body"), F.date_format(time if time is not None else capture_time(id_col), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"))
    rows = rows.withColumn("_k", F.xxhash64("id", "url", "body"))
    payloads = cut(rows.select("_k", "id", F.octet_length("body").cast("long").alias("bytes"), F.sha2("body", 256).alias("digest")), "warc-payloads")
    files = max(1, -(-(payloads.agg(F.sum(F.col("bytes") + 512)).first()[0] or 0) // FILE_BYTES))
    first = payloads.where(F.col("bytes") >= shortest).groupBy("digest").agg(F.min("id").alias("first"))
    kinds = payloads.join(first, "digest", "left").select("_k", "bytes", "digest", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers")).dropDuplicates(["_k"])
    records = rows.repartition(files, "_k").join(kinds.repartition(files, "_k"), "_k")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    again = F.col("refers").isNotNull()
    block = F.when(again, http).otherwise(F.concat(http, "body"))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    text = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(">"))),
        line("WARC-Date", F.col("time")),
        F.when(F.col("url").isNull(), "").otherwise(line("WARC-Target-URI", uri)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers").cast("string"), F.lit(">"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    records.select(text.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def url_key(url: str | None) -> str:
    """The host's labels in reverse, then path and sorted query, in lower case: captures of one site stand together."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip().lower())
        host, port = u.hostname or "", u.port
    except ValueError:
        return url.strip().lower()
    labels = host.split(".")
    if labels[0] == "www":
        labels = labels[1:]
    query = "&".join(sorted(u.query.split("&"))) if u.query else ""
    return ",".join(reversed(labels)) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (u.path or "/") + (f"?{query}" if query else "")


def records(data: bytes) -> Iterator[tuple[dict[str, str], int, int, bytes]]:
    """(headers, offset, length, block) of each record; the lengths in the headers frame it, whatever a block holds."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].decode("utf-8", "replace").split("\r\n")
        headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:] if ": " in x)}
        size = int(headers["content-length"])
        end = head + 4 + size
        if not lines[0].startswith("WARC/") or data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"no whole record at {at}")
        yield headers, at, end + 4 - at, data[head + 4 : end]
        at = end + 4


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?[0-9]+)>", urn or "")
    return int(m[1]) if m else None


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """An index row for each record of the archives; those of one file are sorted and numbered, a run for merging.

    Digests and sizes of responses are taken from the payload that was read; a response whose payload doesn't match
    its header is an error. Offsets are those in the unpacked file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                file, rows = b.column("path")[i].as_py(), []
                for h, offset, length, block in records(gzip.decompress(b.column("content")[i].as_py())):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size, digest = int(re.search(rb"(?i)content-length: *([0-9]+)", head)[1]), h["warc-payload-digest"].removeprefix("sha256:")
                    if h["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"damaged payload in {file} at {offset}")
                    rows.append((url_key(h.get("warc-target-uri")), h["warc-date"], _page(h["warc-record-id"]), h["warc-type"], _page(h.get("warc-refers-to")), size, digest, file, offset, length))
                rows.sort(key=lambda r: (r[0], r[1], -1 if r[2] is None else r[2]))
                number = int.from_bytes(hashlib.blake2b(file.encode(), digest_size=7).digest())
                columns = [*zip(*rows, strict=True)] if rows else [()] * 10
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns, [number] * len(rows), range(len(rows))], _TYPES, strict=True)], _NAMES)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, INDEX)


_NAMES = [x.split()[0] for x in INDEX.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[x.split()[1]] for x in INDEX.split(", ")]


def merge_runs(keys: list[tuple], bounds: list[tuple[int, int]]) -> list[int]:
    """The order of the rows of sorted runs (start, end), by a tree that keeps the loser of each match.

    A run's next row replays only the matches on its way to the root; ties go to the earlier run.
    """
    k = len(bounds)
    at, end = [s for s, _ in bounds], [e for _, e in bounds]

    def wins(a: int, b: int) -> bool:
        if at[a] >= end[a] or at[b] >= end[b]:
            return at[b] >= end[b]
        return (keys[at[a]], a) < (keys[at[b]], b)

    won, lost = [0] * k + [*range(k)], [0] * k
    for n in range(k - 1, 0, -1):
        a, b = won[2 * n], won[2 * n + 1]
        won[n], lost[n] = (a, b) if wins(a, b) else (b, a)
    best, order = won[1] if k > 1 else 0, []
    while k and at[best] < end[best]:
        order.append(at[best])
        at[best] += 1
        n = (k + best) // 2
        while n:
            if not wins(best, lost[n]):
                best, lost[n] = lost[n], best
            n //= 2
    return order


def merge_index(runs: DataFrame) -> DataFrame:
    """The captures in global order of URL key, time and id: partitions in order, and rows in order within them.

    Keys are dealt by range, so each partition holds a slice of every run, whole as (run, seq) brings it back; the
    slices are merged with merge_runs. There are as many ranges as keep one near SLICE index rows (never payloads),
    which is what a task has in memory.
    """
    ranges = max(runs.sparkSession.sparkContext.defaultParallelism, -(-runs.count() // SLICE))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [*batches]
        if not got:
            return
        t = pa.Table.from_batches(got)
        run = t.column("run").to_pylist()
        starts = [i for i in range(len(run)) if not i or run[i] != run[i - 1]]
        keys = [*zip(t.column("urlkey").to_pylist(), t.column("time").to_pylist(), (-1 if x is None else x for x in t.column("id").to_pylist()), strict=True)]
        order = merge_runs(keys, [*zip(starts, [*starts[1:], len(run)], strict=True)])
        yield from t.take(pa.array(order, pa.int64())).combine_chunks().to_batches(10_000)

    return runs.repartitionByRange(ranges, "urlkey", "time", "id").sortWithinPartitions("run", "seq").mapInArrow(merge, INDEX)


def archive_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", time: Column | None = None) -> DataFrame:
    """Write `pages` as archives under `path`, read them back and return the merged index (INDEX).

    A null body is an empty payload; a null URL leaves the target out and stands first in the index; a null id is
    never referred to. Rows that repeat an id and its payload are responses alike. An empty table gives no file but
    an empty index. Extra columns are left out.
    """
    write_archives(pages, path, id_col, url_col, body_col, time)
    return merge_index(cut(read_runs(pages.sparkSession, path), "warc-runs"))
