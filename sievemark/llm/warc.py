"""WARC archives: writing with revisit records, reading back, and an external merge of the capture index.

Records are composed in DataFrame expressions and written by Spark's own text writer, whose line
separator is the blank line that ends a WARC record; so archives can stand on any file system that Spark
writes to, and a lost task is written again by its successor. An archive holds few enough records of its
size class to stay within ARCHIVE_BYTES, or a single larger one. Reading parses by Content-Length. Each
archive gives a locally sorted run of captures. The runs, written to the shared folder, are split by a
range partitioning by URL key, timestamp and page into as many parts as keep MERGED_ROWS rows each,
however many captures a URL has; within a part, whatever order its rows arrive in, every ascending
stretch is a run, and a loser tree merges the runs without sorting them again.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import islice
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm.common import scratch

#: Payloads of fewer bytes are always stored.
REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64_000_000
#: Most bytes of payload and most records of an archive, by size class.
CLASSES = ((16_000, 4000), (1_000_000, 60), (None, 1))
#: Rows of the index that one task merges, about.
MERGED_ROWS = 200_000
#: Seconds since 1970 of page 0, where the pages have no time of their own; page n follows n seconds later.
EPOCH = 1_700_000_000
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_RECORD_ID = re.compile(r"<urn:page:(-?\d*)>")


def _utc(time: Column) -> Column:
    """The time in UTC, whatever zone the session has."""
    second = F.unix_seconds(time)
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    day = F.pmod(second, F.lit(86400))
    clock = F.concat_ws(":", two(F.floor(day / 3600)), two(F.floor(day / 60) % 60), two(day % 60))
    return F.concat(F.date_format(F.date_from_unix_date(F.floor(second / 86400).cast("int")), "yyyy-MM-dd"), F.lit("T"), clock, F.lit("Z"))


def captures_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None) -> DataFrame:
    """id, url, html, time, digest and bytes of each page."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), F.coalesce(F.col(time_col).cast("timestamp") if time_col else F.lit(None).cast("timestamp"), F.timestamp_seconds(F.lit(EPOCH) + F.coalesce(F.col(id_col).cast("long"), F.lit(0)))).alias("time"))
    return rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html"))


def repeats(captures: DataFrame) -> DataFrame:
    """digest and last (the largest id) of the payloads of REVISIT_BYTES bytes or more that come more than once."""
    return captures.where(f"bytes >= {REVISIT_BYTES} and id is not null").groupBy("digest").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "last")


def records(captures: DataFrame, repeated: DataFrame) -> DataFrame:
    """record: the text of each capture's WARC record.

    Of equal payloads of REVISIT_BYTES bytes or more, the row with the largest id is a response (if rows
    repeat it: each of them), the others are revisits without the payload. A null html is an empty
    payload; rows without an id are responses.
    """
    rows = captures.join(repeated, "digest", "left")
    revisit = (F.col("id") < F.col("last")) & (F.col("bytes") >= REVISIT_BYTES)
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit(_HTTP + "Content-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.when(revisit, "WARC-Type: revisit").otherwise("WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: "), name("id")),
        F.concat(F.lit("WARC-Date: "), _utc(F.col("time"))),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name("last"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return rows.select(F.concat(head, F.lit("\r\n\r\n"), block).alias("record"))


def write_archives(pages: DataFrame, folder: str, repeated: str, **columns: str) -> None:
    """Gzip-compressed archives in new folders, one for each size class; the digests that repeat go to the folder `repeated`, so that they are found once."""
    captures = captures_of(pages, **columns)
    repeats(captures).write.parquet(repeated)
    known = pages.sparkSession.read.schema("digest string, last long").parquet(repeated)
    low = 0
    for k, (high, most) in enumerate(CLASSES):
        within = F.col("bytes") >= low if high is None else F.col("bytes").between(low, high)
        records(captures.where(within), known).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", most).text(f"{folder}/class{k}")
        low = None if high is None else high + 1


def url_key(url: str) -> str:
    """Host labels from the top level down, then path and query, in lower case: captures of a site stand together."""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    labels = host.removeprefix("www.").split(".")[::-1]
    shown = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{','.join(labels)}{shown}){parts.path.rstrip('/') or '/'}{'?' + query if query else ''}".lower()


def parse_archive(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes, int, int]]:
    """(headers in lower case, block, offset, length) of each record; offsets are those of the plain archive."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].split(b"\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines)}
        size = int(headers[b"content-length"])
        block = data[end + 4 : end + 4 + size]
        stop = end + 4 + size
        if len(block) != size or data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut off")
        yield headers, block, at, stop + 4 - at
        at = stop + 4


_NAMES = ["url_key", "time", "page_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "archive", "offset", "length"]
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
_SCHEMA = "url_key string, time string, page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, archive string, offset long, length long"
_KEYS = ["url_key", "time", "page_id", "archive", "offset"]


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


def _captures(path: str, data: bytes) -> list[tuple]:
    """The captures of an archive as a run, sorted by URL key, time and page. Payloads are held against their digests."""
    out = []
    plain = zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data
    for h, block, offset, length in parse_archive(plain):
        kind, digest = h[b"warc-type"].decode(), h[b"warc-payload-digest"].decode().removeprefix("sha1:")
        http, _, payload = block.partition(b"\r\n\r\n")
        declared = int(re.search(rb"(?mi)^content-length:\s*(\d+)", http)[1])
        if kind == "response" and (len(payload) != declared or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"payload of {h[b'warc-record-id']!r} differs from its digest")
        ids = [_RECORD_ID.match(h.get(k, b"").decode()) for k in (b"warc-record-id", b"warc-refers-to")]
        own, refers = (int(m[1]) if m and m[1] else None for m in ids)
        out.append((url_key(h[b"warc-target-uri"].decode()), h[b"warc-date"].decode(), own, kind, refers, digest, declared, path, offset, length))
    return sorted(out, key=_order)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Captures of all archives of a folder; those of an archive are a sorted run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                rows = _captures(b.column(0)[k].as_py(), b.column(1)[k].as_py())
                if rows:
                    yield _batch(rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(folder).select("path", "content").mapInArrow(run, _SCHEMA)


class LoserTree:
    """Merges sorted runs: each inner node remembers the loser of its match, so the next row takes log2(k) comparisons."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.head: list[tuple | None] = [next(r, None) for r in runs]
        self.tree = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._climb(leaf)

    def _wins(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None or (x is not None and (x[0], a) <= (y[0], b))

    def _climb(self, player: int) -> None:
        at = (player + self.k) // 2
        while at > 0:
            if self.tree[at] < 0:
                self.tree[at] = player
                return
            if not self._wins(player, self.tree[at]):
                player, self.tree[at] = self.tree[at], player
            at //= 2
        self.tree[0] = player

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (row := self.head[winner := self.tree[0]]) is not None:
            yield row
            self.head[winner] = next(self.runs[winner], None)
            self._climb(winner)


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in order; each ascending stretch of them is a run. Rows stay in Arrow, runs are keys and places."""
    held, runs, place, last = [], [], 0, None
    for b in batches:
        held.append(b)
        columns = [b.column(b.schema.names.index(c)).to_pylist() for c in _KEYS]
        for url, time, page, archive, offset in zip(*columns, strict=True):
            key = url, time, page is not None, page or 0, archive, offset
            if last is None or key < last:
                runs.append([])
            runs[-1].append((key, place))
            place, last = place + 1, key
    if held:
        rows = pa.Table.from_batches(held)
        places = (place for _, place in LoserTree([iter(r) for r in runs]))
        while chosen := list(islice(places, 10_000)):
            yield from rows.take(pa.array(chosen)).combine_chunks().to_batches()


def capture_index(captures: DataFrame, partitions: int | None = None) -> DataFrame:
    """The captures in global order of URL key and time, from the first partition to the last.

    A partition holds a share of the rows that falls as partitions are added, also of a single URL's.
    """
    dealt = captures.repartitionByRange(partitions, *_KEYS) if partitions else captures.repartitionByRange(*_KEYS)
    return dealt.mapInArrow(merged, _SCHEMA)


def resolved(index: DataFrame) -> DataFrame:
    """Index rows, whose revisits take the payload's size and digest from the response that they refer to."""
    whole = index.where("record_type = 'response' and page_id is not null").groupBy("page_id").agg(F.max("payload_bytes").alias("_bytes"), F.max("payload_digest").alias("_digest")).withColumnRenamed("page_id", "_to")
    plain = index.where("record_type = 'response'")
    found = index.where("record_type = 'revisit'").join(whole, F.col("refers_to") == F.col("_to"))
    return plain.unionByName(found.withColumns({"payload_bytes": F.col("_bytes"), "payload_digest": F.col("_digest")}).drop("_to", "_bytes", "_digest"))


def archive_round_trip(pages: DataFrame, folder: str | None = None, **columns: str) -> DataFrame:
    """Write archives of the pages, read them back, and return the merged and resolved index."""
    spark = pages.sparkSession
    own = scratch(spark, "warc")
    folder = folder or f"{own}/archives"
    write_archives(pages, folder, f"{own}/repeated", **columns)
    # The runs are small beside the archives, which so are read once.
    read_archives(spark, folder).write.parquet(f"{own}/runs")
    runs = spark.read.schema(_SCHEMA).parquet(f"{own}/runs")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // MERGED_ROWS))
    capture_index(runs, parts).write.parquet(f"{own}/index")
    return resolved(spark.read.schema(_SCHEMA).parquet(f"{own}/index"))
