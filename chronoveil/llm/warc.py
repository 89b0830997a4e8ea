"""Web archives: records, revisits, and a capture index merged from sorted runs.

``write_archive`` writes one WARC/1.1 record per page: the payload in a ``response``, or a ``revisit`` without payload that
refers to the first page with the same payload. Files are gzip-compressed text files of Spark's own writer, so every task
commits as a whole and any store that Spark reaches will do.

``capture_index`` reads the files back. Each file gives one run, sorted by URL key, time and page. The runs are cut into
ranges of that order, and in every range the runs are merged k-way by a tree of losers, which yields the captures in
global order with at most one comparison per level for each row. A range holds a bounded number of index rows whatever
the number of captures of one URL, as ranges are cut by the whole order and not by the URL alone.

Defined results: null html is an empty payload, a null url an empty one; null page ids sort first and never become a
response for others unless all copies have none; repeated rows give a record each, of which the same page stays response
(equal id, equal payload: all of them are responses); an empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoveil.llm import base
from chronoveil.session import scratch_path

#: Records of one file; with pages of usual length 10 to 20 MB before compression.
RECORDS_PER_FILE = 1_000
#: Index rows that one range of the merge holds.
RANGE_ROWS = 20_000
#: Payloads of so many bytes or more are written once.
LEAST_REVISIT = 0
# Fixed: the alphabet of RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column) -> Column:
    """Base 32 of a digest of 40 hex digits: five hex digits are four base-32 digits."""
    out = []
    for i in range(8):
        value = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            out.append(F.substring(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*out)


def url_key(url: str) -> str:
    """Host labels from the top-level domain down, then port, path and query, in lower case: neighbours in the order belong together."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]+))?([^#]*)", url.strip(), re.I)
    if not m:
        return url.strip().lower()
    host, port, path = m.groups()
    labels = [x for x in host.lower().split(".") if x]
    if labels and labels[0] == "www":
        labels = labels[1:]
    port = "" if port in (None, "", "80", "443") else f":{port}"
    return f"{','.join(reversed(labels))}{port}){(path or '/').lower()}"


def _records(pages: DataFrame, least: int) -> DataFrame:
    """One column ``value``: the record of each page without the blank lines that end it."""
    meta = pages.select("page_id", F.sha1("html").alias("sha"), F.octet_length("html").alias("size"))
    # One row per payload, counted map-side; a payload with many copies is one row before it is joined.
    first = base.written(meta.groupBy("sha", "size").agg(F.min("page_id").alias("first"))
                         .select("sha", "first", F.lit(1).alias("known")), "first-captures")
    keyed = pages.withColumn("sha", F.sha1("html")).join(first, "sha", "left")
    size = F.octet_length("html")
    revisit = (size >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    stamp = lambda page: F.date_format(F.timestamp_seconds(F.coalesce(page, F.lit(0)) + 1_700_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    name = lambda page: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))
    crlf = F.lit("\r\n")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"),
                    F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), crlf,
        F.lit("WARC-Record-ID: "), name(F.col("page_id")), crlf, F.lit("WARC-Date: "), stamp(F.col("page_id")), crlf,
        F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", ""), crlf,
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
                                       "WARC-Refers-To: "), name(F.col("first")), crlf)).otherwise(F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), base32_of_hex(F.col("sha")), crlf,
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"))
    return keyed.select(F.concat(head, block).alias("value"))


def write_archive(pages: DataFrame, path: str, least: int = LEAST_REVISIT, records_per_file: int = RECORDS_PER_FILE,
                  page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write one record per row under ``path``. Payloads of at least ``least`` bytes are stored once."""
    base.set_up(pages.sparkSession)
    rows = base.pick(pages, page_id=(page_id, "bigint"), url=(url, "string"), html=(html, "string"))
    rows = rows.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    # Two blank lines end a record. Readers go by Content-Length, so a payload may have blank lines of its own.
    _records(rows, least).write.options(lineSep="\r\n\r\n", compression="gzip", maxRecordsPerFile=records_per_file).text(path)


def parse(content: bytes):
    """(offset, headers, block) of each record of an uncompressed archive, by the lengths that the records state."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        begin = end + 4
        stop = begin + int(headers["Content-Length"])
        yield at, headers, content[begin:stop]
        at = stop + 4


def _page(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "none" else int(number)


_INDEX = pa.schema([("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
                    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                    ("refers_to", pa.int64()), ("file", pa.string()), ("position", pa.int64())])
INDEX = ("url_key string, captured string, page_id bigint, url string, payload_bytes bigint, payload_digest string, "
         "record_type string, refers_to bigint, file string, position bigint")


def order_of(row: tuple) -> tuple:
    """URL key, time, page (none first), then the place of the record, so that the order is total."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


def index_run(file: str, content: bytes) -> list[tuple]:
    """The index rows of one archive file, sorted. Payloads are hashed again and must match what the record states."""
    rows = []
    for at, headers, block in parse(content):
        head, _, payload = block.partition(b"\r\n\r\n")
        stated = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        kind = headers["WARC-Type"]
        if kind == "response":
            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if found != stated or size != len(payload):
                raise ValueError(f"{file}: damaged payload at byte {at}")
        url = headers["WARC-Target-URI"]
        rows.append((url_key(url), headers["WARC-Date"], _page(headers["WARC-Record-ID"]), url, size, stated, kind,
                     _page(headers["WARC-Refers-To"]) if kind == "revisit" else None, file, at))
    rows.sort(key=order_of)
    return rows


def _runs(batches):
    for batch in batches:
        for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            rows = index_run(file, gzip.decompress(content))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _INDEX.types)], schema=_INDEX)


class LoserTree:
    """Merges sorted runs. An inner node holds the run that lost there; the winner's run replays its path alone."""

    def __init__(self, runs: list, key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.heads = [self._next(i) for i in range(len(runs))]
        k = len(runs)
        self.losers = [0] * k
        self.winner = self._play(1) if k > 1 else 0

    def _next(self, i: int):
        for row in self.runs[i]:
            return (self.key(row), i), row
        return None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x[0] < y[0])

    def _play(self, node: int) -> int:
        """First round below ``node``; leaves are the nodes from k on."""
        k = len(self.runs)
        if node >= k:
            return node - k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        if self._beats(b, a):
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self):
        while self.runs and self.heads[self.winner] is not None:
            yield self.heads[self.winner][1]
            i = self.winner
            self.heads[i] = self._next(i)
            node = (i + len(self.runs)) // 2
            while node >= 1:
                if self._beats(self.losers[node], i):
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.winner = i


def _merge(batches):
    """One range: its rows come run by run, each run in order."""
    runs: dict[str, list] = {}
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in _INDEX.names)):
            runs.setdefault(row[8], []).append(row)
    out = []
    for row in LoserTree(list(runs.values()), order_of):
        out.append(row)
        if len(out) == base.ARROW_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _INDEX.types)], schema=_INDEX)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _INDEX.types)], schema=_INDEX)


def capture_index(spark: SparkSession, path: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures under ``path`` in the order of URL key and time; partitions follow each other."""
    base.set_up(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    runs = base.written(files.mapInArrow(_runs, INDEX), "capture-runs")
    order = ["url_key", "captured", F.col("page_id").asc_nulls_first(), "file", "position"]
    ranges = runs.repartitionByRange(max(1, -(-runs.count() // range_rows)), *order)
    return ranges.sortWithinPartitions("file", *order[:3], "position").mapInArrow(_merge, INDEX)


def archived_pages(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``pages`` and return the merged index of what was written."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "archive")
    write_archive(pages, path, **options)
    return capture_index(spark, path)
