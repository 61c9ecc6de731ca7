"""Numbered text as a data source: files in byte ranges, each line with its place in its range."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tandem.operators.numbering import SPAN_BLOCKS

RANGE_BYTES, CHUNK_BYTES = 128 << 20, 4 << 20
#: Ranges whose starts are shipped to every executor; more are joined.
SHIPPED_RANGES = 1 << 20
_PACKED = (".gz", ".bz2", ".zst", ".lz4")


@dataclass
class ByteRange(InputPartition):
    path: str
    low: int
    high: int

    def __init__(self, path: str, low: int, high: int):
        super().__init__(low)
        self.path, self.low, self.high = path, low, high


class NumberedTextSource(DataSource):
    """``spark.read.format("numbered_text")`` over ``files``, a JSON list of path and length.

    Each byte range of ``range_bytes`` is one task; a line belongs to the range its first byte is in. A packed file is one range. With ``count`` set a
    range gives one row with the number of its lines and builds no text.
    """

    @classmethod
    def name(cls) -> str:
        return "numbered_text"

    def schema(self) -> str:
        rows = "lines long" if self.options.get("count") else "place long, value string"
        return f"path string, low long, {rows}"

    def reader(self, schema) -> DataSourceReader:
        return NumberedTextReader(self.options)


class NumberedTextReader(DataSourceReader):
    def __init__(self, options):
        self.files = json.loads(options["files"])
        self.size = int(options.get("range_bytes", RANGE_BYTES))
        self.count = bool(options.get("count"))

    def partitions(self) -> list[InputPartition]:
        found = []
        for path, length in self.files:
            step = max(1, length) if path.endswith(_PACKED) else self.size
            found += [ByteRange(path, low, min(low + step, length)) for low in range(0, length, step)]
        return found

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        whole = part.path.endswith(_PACKED)
        with open_stream(part.path) as handle:
            # where a packed file ends is only known at its end
            high = 1 << 62 if whole else part.high
            if self.count:
                yield pa.RecordBatch.from_pydict({"path": [part.path], "low": [part.low], "lines": [count_starts(handle, part.low, high)]})
                return
            place = 0
            for lines in range_lines(handle, part.low, high):
                values = pa.array([line.decode("utf-8", "replace") for line in lines], pa.string())
                yield pa.RecordBatch.from_pydict({
                    "path": pa.array([part.path] * len(lines), pa.string()), "low": pa.array([part.low] * len(lines), pa.int64()),
                    "place": pa.array(range(place, place + len(lines)), pa.int64()), "value": values})
                place += len(lines)


def open_stream(path: str):
    filesystem, inner = fs.FileSystem.from_uri(path)
    return filesystem.open_input_stream(inner) if path.endswith(_PACKED) else filesystem.open_input_file(inner)


def count_starts(handle, low: int, high: int, chunk: int = CHUNK_BYTES) -> int:
    """How many lines have their first byte in the range: line ends before such a byte, and the start of the file."""
    first = max(low - 1, 0)
    if first:
        handle.seek(first)
    at, found, last = first, 0, b""
    while at < high and (data := handle.read(min(chunk, high - at))):
        # the last byte of the range may end a line, but the next one begins beyond it
        if low == 0 and at == 0:
            found += 1
        found += last.count(b"\n") + data[:-1].count(b"\n")
        at, last = at + len(data), data[-1:]
    return found


def range_lines(handle, low: int, high: int, chunk: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """The lines whose first byte is in the range, a chunk at a time; ``\\n`` or ``\\r\\n`` ends a line, and the last one needs no end."""
    at = max(low - 1, 0)
    if at:
        handle.seek(at)
    held, skipping = b"", low > 0
    # ``at`` is where the bytes in ``held`` begin
    while True:
        data = handle.read(chunk)
        if not data:
            break
        if skipping:
            end = data.find(b"\n")
            if end < 0:
                at += len(data)
                if at >= high:
                    return
                continue
            at, data, skipping = at + end + 1, data[end + 1 :], False
            if at >= high:
                return
        end = data.rfind(b"\n")
        if end < 0:
            held += data
            continue
        lines = (held + data[:end]).split(b"\n")
        if at + len(held) + end >= high:
            kept = 0
            for line in lines:
                if at >= high:
                    break
                at += len(line) + 1
                kept += 1
            yield [line.removesuffix(b"\r") for line in lines[:kept]]
            if at >= high:
                return
        else:
            at += len(held) + end + 1
            yield [line.removesuffix(b"\r") for line in lines]
        held = data[end + 1 :]
    if held and at < high:
        yield [held.removesuffix(b"\r")]


def numbered_text(spark: SparkSession, path: str | list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path, line_no, value`` with the 1-based line number inside each file; no copy of the text is written.

    The first scan counts the lines of each byte range, which gives the number its first line has; the second reads the text and adds the place in
    the range. Ranges depend on the files alone, so both scans see the same ones. The counts are summed by file in spans of
    ranges. Only names and lengths of files come to the driver, which lists them anyway. ``\\n`` or ``\\r\\n`` ends a line.
    """
    spark.dataSource.register(NumberedTextSource)
    files = [tuple(r) for r in spark.read.format("binaryFile").load(path).select("path", "length").collect()]
    reader = spark.read.format("numbered_text").option("files", json.dumps(files)).option("range_bytes", str(range_bytes))
    lines = reader.load()
    counted = reader.option("count", "true").load()
    n_ranges = sum(-(-length // range_bytes) for _, length in files)
    starts = _starts(counted, range_bytes)
    starts = F.broadcast(starts) if n_ranges <= SHIPPED_RANGES else starts
    return lines.join(starts, ["path", "low"]).select("path", (F.col("_start") + F.col("place") + 1).alias("line_no"), "value")


def _starts(counted: DataFrame, range_bytes: int) -> DataFrame:
    """Lines before each range of its file; a file of many ranges is summed in spans, so no task holds more than one span of them."""
    spanned = counted.withColumn("_span", F.floor(F.col("low") / F.lit(range_bytes * SPAN_BLOCKS)))
    spans = spanned.groupBy("path", "_span").agg(F.sum("lines").alias("_lines"))

    def before(name: str, *part: str):
        order = "low" if len(part) == 2 else "_span"
        return F.coalesce(F.sum(name).over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    spans = spans.select("path", "_span", before("_lines", "path").alias("_before"))
    inside = spanned.withColumn("_inside", before("lines", "path", "_span"))
    return inside.join(spans, ["path", "_span"]).select("path", "low", (F.col("_before") + F.col("_inside")).alias("_start"))
