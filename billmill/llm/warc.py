"""Web archives: captures written as WARC records, read back, and indexed in one global order."""

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from billmill.llm.common import staged
from billmill.session import scratch_path

RECORDS_PER_FILE = 2_000
CAPTURES_PER_RANGE = 200_000
END = "\r\n\r\n"
ENTRY = (
    "run string, seq long, url_key string, captured string, page_id long, url string, "
    "record_offset long, record_length long, payload_bytes long, payload_digest string"
)
ORDER = ["url_key", "captured", "page_id"]
MERGED = ENTRY + ", merge_range int, merge_position long"

NO_TIME = "1970-01-01T00:00:00Z"


def _headers(*lines: Column | str) -> Column:
    return F.concat(*(part for line in lines for part in (line if isinstance(line, Column) else F.lit(line), F.lit("\r\n"))))


def write_captures(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write one response record per row (page_id, url, html, captured) below `path`.

    A record's block is an HTTP answer whose payload is the html in UTF-8; a null html is an
    empty payload. Records end with two line ends, which is the separator Spark's text writer
    puts after each row; so the files are whole WARC files, are committed task by task, and
    can lie in any store Spark writes to. Line ends in a url are written as %0A and %0D. A
    null url has no target header, a null page_id the id `none`, a null time the date NO_TIME.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit(END),
    )
    block = F.concat(http, payload)
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    record = F.concat(
        _headers("WARC/1.0", "WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">\r\n")),
        F.concat(F.lit("WARC-Date: "), F.coalesce(F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(NO_TIME)), F.lit("\r\n")),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n")), F.lit("")),
        _headers("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END)),
        block,
    )
    pages.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)


def url_key(url: str | None) -> str:
    """The sort key of a URL: host labels from the right, then path and query; no scheme, port
    or fragment. A null has an empty key."""
    if url is None:
        return ""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url).split("#")[0]
    host = re.match(r"[^/?]*", rest)[0]
    labels = re.sub(r":[0-9]*$", "", host).lower().split(".")
    return ",".join(reversed(labels)) + ")" + (rest[len(host) :] or "/")


def records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and payload of the records of a file, one after the other."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].decode("utf-8").split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        start, size = head + 4, int(headers["Content-Length"])
        block = data[start : start + size]
        if len(block) < size or lines[0] != "WARC/1.0":
            raise ValueError(f"damaged record at byte {at}")
        yield at, start + size + 4 - at, headers, block[block.index(b"\r\n\r\n") + 4 :]
        at = start + size + 4


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """The entries of each archive file, in order of the capture index: a run."""
    for batch in batches:
        for row in range(batch.num_rows):
            name = batch.column("path")[row].as_py().rpartition("/")[2]
            found = []
            for offset, length, headers, payload in records(batch.column("content")[row].as_py()):
                page = headers["WARC-Record-ID"][len("<urn:page:") : -1]
                uri = headers.get("WARC-Target-URI")
                found.append((url_key(uri), headers["WARC-Date"], None if page == "none" else int(page), uri, offset, length,
                              len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()))
            found.sort(key=lambda e: (e[0], e[1], e[2] is not None, e[2] or 0, e[4]))
            columns = list(zip(*found, strict=True)) or [[]] * 8
            frame = pa.table(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(),
                                                          pa.int64(), pa.int64(), pa.string()), strict=True)],
                names=["url_key", "captured", "page_id", "url", "record_offset", "record_length", "payload_bytes", "payload_digest"],
            )
            frame = frame.add_column(0, "seq", pa.array(range(len(found)), pa.int64()))
            frame = frame.add_column(0, "run", pa.array([name] * len(found), pa.string()))
            yield from frame.to_batches(2_000)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One sorted run of index entries per archive file below `path`. A file is one task's
    unit of work, its size bounded by the writer's records per file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_runs, ENTRY)


class LoserTree:
    """Merges sorted runs: the winner leaves at the root, and only the matches on its own path
    are played again. Inner nodes keep the loser of their match."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        winners = [*([None] * self.size), *range(self.size)]
        self.losers = [0] * self.size
        for node in range(self.size - 1, 0, -1):
            winners[node], self.losers[node] = self._play(winners[2 * node], winners[2 * node + 1])
        self.winner = winners[1] if self.size > 1 else 0

    def _head(self, run: int) -> tuple | None:
        return self.runs[run][self.at[run]] if run < len(self.runs) and self.at[run] < len(self.runs[run]) else None

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; a run that is used up loses, the first run wins a tie."""
        x, y = self._head(a), self._head(b)
        if y is None or (x is not None and (x, a) <= (y, b)):
            return a, b
        return b, a

    def __iter__(self) -> Iterator[tuple]:
        while (head := self._head(self.winner)) is not None:
            yield head
            self.at[self.winner] += 1
            node = (self.winner + self.size) // 2
            while node:
                self.winner, self.losers[node] = self._play(self.winner, self.losers[node])
                node //= 2


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the slices of runs that lie in this range of keys."""
    slices: dict[str, list[tuple]] = {}
    held, row = [], 0
    for batch in batches:
        held.append(batch)
        keys = zip(*(batch.column(c).to_pylist() for c in ("run", *ORDER)), strict=True)
        for run, key, captured, page in keys:
            slices.setdefault(run, []).append((key, captured, page is not None, page or 0, row))
            row += 1
    if not held:
        return
    order = [entry[-1] for entry in LoserTree(list(slices.values()))]
    merged = pa.Table.from_batches(held).take(pa.array(order))
    merged = merged.append_column("merge_range", pa.array([TaskContext.get().partitionId()] * row, pa.int32()))
    merged = merged.append_column("merge_position", pa.array(range(row), pa.int64()))
    yield from merged.combine_chunks().to_batches(10_000)


def merge_runs(runs: DataFrame, captures_per_range: int = CAPTURES_PER_RANGE) -> DataFrame:
    """All entries in one order of url_key, captured and page_id, with `position` from 0.

    The keys are cut into ranges of about `captures_per_range` entries (time and page are part
    of the key, so one busy url is cut too). A range gets its slice of every run, put together
    by run and number, and a loser tree merges the slices by key. Positions of a range start
    where those of the ranges before end.
    """
    ranges = max(1, -(-runs.count() // captures_per_range))
    merged = staged(
        runs.repartitionByRange(ranges, *ORDER, "run", "seq").sortWithinPartitions("run", "seq").mapInArrow(_merge, MERGED), "merged"
    )
    before = Window.orderBy("merge_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = merged.groupBy("merge_range").count().select(
        "merge_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start")
    )
    return merged.join(starts, "merge_range").withColumn("position", F.col("start") + F.col("merge_position")).drop(
        "merge_range", "merge_position", "start", "seq"
    )


def with_revisits(entries: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds record_type and refers_to: of entries with equal payloads of at least `min_bytes`
    bytes that with the smallest page_id (nulls last, then by file and offset) is the response,
    the others revisit it."""
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "run", "record_offset")
    firsts = (
        entries.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.min(place).alias("first"))
    )
    joined = entries.join(firsts, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("first").isNotNull() & (F.col("first") != place)
    return joined.select(
        *entries.columns,
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first.page_id")).alias("refers_to"),
    )


def archive(pages: DataFrame, min_bytes: int = 0, captures_per_range: int = CAPTURES_PER_RANGE) -> DataFrame:
    """Write the pages (page_id, url, html, captured) as archives in the shared folder, read
    them back, merge the index and tell responses from revisits.

    Every row has a record and an index entry: repeated rows, null urls (empty key), null html
    (0 bytes) and null ids (written as `none`, read back as null) too. An empty table gives no
    rows. Other columns are not read.
    """
    path = scratch_path(pages.sparkSession, "archives")
    write_captures(pages.select("page_id", "url", "html", "captured"), path)
    runs = staged(read_runs(pages.sparkSession, path), "runs")
    return with_revisits(merge_runs(runs, captures_per_range), min_bytes)
