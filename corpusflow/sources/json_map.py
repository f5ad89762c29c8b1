"""One very large JSON object, {key: value, ...} on any number of lines, read by many tasks: byte ranges whose state at the start is known.

Whether a byte lies in a string, and how deep, depends on all before it. A first Spark job counts each range's quotes, and its
change of depth for either case; prefix sums over ranges then give every range its state, so each is read by itself, exactly.
The index of ranges is a small table beside the file, and the offset of a stream over it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..plans.ranks import with_sums_before
from ..plans.scratch import Scratch

RANGE_BYTES = 16 << 20
#: Entries that a task hands on at a time, and their characters (bytes, when it writes) but for the last entry's.
BATCH = 1_000
BATCH_SIZE = 4 << 20
SCHEMA = "key string, value string, at long, is_text boolean"
_INDEX = "file string, no long, start long, end long, in_string boolean, depth long"
_QUOTE, _BACKSLASH, _COMMA = 34, 92, 44
_DEPTH = np.zeros(256, np.int64)
_DEPTH[[ord("{"), ord("[")]] = 1
_DEPTH[[ord("}"), ord("]")]] = -1
_MARK = _DEPTH != 0
_MARK[[_QUOTE, _COMMA]] = True


def _open(path: str):
    """A file and its size; any place that this machine or Arrow's file systems know."""
    where, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return where.open_input_file(name), where.get_file_info(name).size


def _marks(data: bytes, escaped: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places and bytes of quotes, braces, brackets and commas, without escaped quotes; ``escaped``: a backslash before the first byte is not itself escaped."""
    buffer = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(_MARK[buffer])
    quotes = at[buffer[at] == _QUOTE]
    slashed = quotes[(quotes > 0) & (buffer[quotes - 1] == _BACKSLASH)]
    gone = []
    for q in slashed.tolist():  # few: a text's own quotes
        k = q - 1
        while k >= 0 and data[k] == _BACKSLASH:
            k -= 1
        run = q - 1 - k + (1 if k < 0 and escaped else 0)
        if run % 2:
            gone.append(q)
    if escaped and len(quotes) and quotes[0] == 0:
        gone.append(0)
    if gone:
        at = at[~np.isin(at, gone)]
    return at, buffer[at]


def _escaped_before(file, start: int) -> bool:
    """Whether an odd number of backslashes stands right before a place."""
    n, step = 0, 64
    while start > 0:
        file.seek(max(0, start - step))
        block = file.read(min(step, start))
        rest = len(block) - len(block.rstrip(b"\\"))
        n += rest
        if rest < len(block):
            break
        start -= len(block)
        step *= 4
    return n % 2 == 1


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ranges (file, no, start, end): their quotes, and their change of depth if they begin outside or inside of a string."""
    for b in batches:
        out = []
        for path, no, start, end in zip(*[c.to_pylist() for c in b.columns]):
            file, _ = _open(path)
            with file:
                escaped = _escaped_before(file, start)
                file.seek(start)
                _, kind = _marks(file.read(end - start), escaped)
            quote = kind == _QUOTE
            inside, depth = np.cumsum(quote) % 2, _DEPTH[kind]
            out.append((path, no, start, end, int(quote.sum()), int(depth[inside == 0].sum()), int(depth[inside == 1].sum())))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["file", "no", "start", "end", "quotes", "outside", "inside"])


def _numbered(files: list[str], range_bytes: int) -> tuple[list[tuple[str, int, int]], int]:
    """((file, size, number of its first range) of each file, the number of ranges of all)."""
    sizes, no = [], 0
    for path in files:
        file, size = _open(path)
        file.close()
        sizes.append((path, size, no))
        no += -(-size // range_bytes)
    return sizes, no


def count_ranges(files: list[str], range_bytes: int = RANGE_BYTES) -> int:
    """The number of ranges that ``index_maps`` cuts these files into; only their sizes are looked at."""
    return _numbered(files, range_bytes)[1]


def index_maps(spark: SparkSession, files: list[str], index: str, range_bytes: int = RANGE_BYTES, first: int = 0, last: int | None = None) -> DataFrame:
    """Write and return the index of the byte ranges of maps, a map per file: (file, no, start, end, in_string, depth), the state being that before the range's first byte.

    Ranges are numbered over all files in the order given. Those from ``first`` to before ``last`` are written, appended to what the index holds if ``first`` is not 0; an empty file has none.
    Of the ranges before ``first``, only those of the file that it lies in are read again.
    """
    sizes, no = _numbered(files, range_bytes)
    begin = max((base for _, size, base in sizes if size and base <= first), default=0)
    given = spark.createDataFrame(sizes, "file string, size long, base long").where("size > 0")
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / range_bytes) - 1))
    ranges = given.select("file", "size", "base", k.alias("k")).select("file", (F.col("base") + F.col("k")).alias("no"), (F.col("k") * range_bytes).alias("start"), F.least((F.col("k") + 1) * range_bytes, "size").alias("end"))
    ranges = ranges.where(F.col("no").between(begin, (no if last is None else last) - 1))
    tasks = max(1, min(no - begin, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    counted = ranges.repartition(tasks, "no").mapInArrow(_summary, "file string, no long, start long, end long, quotes long, outside long, inside long")
    # Dealing by range samples its input first: what reads the files must not run twice.
    counted = Scratch(spark, "ranges").save(counted, "counted")
    known = with_sums_before(counted, ["file"], ["no"], "quotes", "before").withColumn("in_string", F.col("before") % 2 == 1)
    known = known.withColumn("change", F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside")))
    rows = with_sums_before(known, ["file"], ["no"], "change", "depth").select("file", "no", "start", "end", "in_string", "depth")
    rows.where(F.col("no") >= first).write.mode("append" if first else "errorifexists").parquet(index)
    return spark.read.schema(_INDEX).parquet(index)


def records(path: str, start: int, end: int, in_string: bool, depth: int) -> Iterator[tuple[str, str | None, int]]:
    """(key, value, place) of the entries that begin in [start, end): those after a comma, or the opening brace, of the outer object.

    The last entry is read on beyond ``end``. Strings come as their text, null as null, other values as their JSON.
    """
    return (row[:3] for row in _told_apart(path, start, end, in_string, depth))


def _told_apart(path: str, start: int, end: int, in_string: bool, depth: int) -> Iterator[tuple[str, str | None, int, bool]]:
    """``records`` with whether the value is a string: a text may itself look like JSON."""
    file, size = _open(path)
    with file:
        escaped = _escaped_before(file, start)
        file.seek(start)
        data = file.read(end - start)
        at, kind = _marks(data, escaped)
        free, after = _outside(kind, in_string, depth)
        own = at[free & (after == 1) & ((kind == _COMMA) | (kind == ord("{")))].tolist()
        if not own:
            return
        step = RANGE_BYTES // 16
        while True:  # what ends the last entry, the outer object's next comma or its closing brace, may lie in what follows
            ends = at[(at > own[-1]) & free & (((after == 1) & (kind == _COMMA)) | (after == 0))]
            if len(ends) or start + len(data) >= size:
                break
            data += file.read(step)
            at, kind = _marks(data, escaped)
            free, after = _outside(kind, in_string, depth)
            step *= 2
    for a, b in zip(own, [*own[1:], int(ends[0]) if len(ends) else len(data)]):
        text = data[a + 1 : b].strip()
        if text:
            ((key, value),) = json.loads(b"{" + text + b"}").items()
            is_text = isinstance(value, str)
            yield key, value if value is None or is_text else json.dumps(value, ensure_ascii=False), start + a + 1, is_text


def _outside(kind: np.ndarray, in_string: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether a mark lies outside of strings, the depth after it)."""
    inside = (np.cumsum(kind == _QUOTE) + in_string) % 2 == 1
    free = ~inside & (kind != _QUOTE)
    return free, depth + np.cumsum(np.where(free, _DEPTH[kind], 0))


class _Range(InputPartition):
    def __init__(self, row: dict):
        super().__init__(row)


def _rows(index: str) -> list[dict]:
    where, name = fs.FileSystem.from_uri(index) if "://" in index or index.startswith("file:") else (fs.LocalFileSystem(), index)
    return sorted(ds.dataset(name, filesystem=where, format="parquet", exclude_invalid_files=True).to_table(use_threads=False).to_pylist(), key=lambda r: r["no"])


def _batches(r: dict) -> Iterator[pa.RecordBatch]:
    batch = lambda some: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), (pa.string(), pa.string(), pa.int64(), pa.bool_()))], ["key", "value", "at", "is_text"])
    some, size = [], 0
    for row in _told_apart(r["file"], r["start"], r["end"], r["in_string"], r["depth"]):
        some.append(row)
        size += len(row[0]) + len(row[1] or "")
        if len(some) == BATCH or size >= BATCH_SIZE:
            yield batch(some)
            some, size = [], 0
    if some:
        yield batch(some)


class _Reader(DataSourceReader):
    def __init__(self, index: str):
        self.index = index

    def partitions(self) -> list[InputPartition]:
        return [_Range(r) for r in _rows(self.index)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return _batches(partition.value)


class _StreamReader(DataSourceStreamReader):
    """An offset is the number of ranges read; a batch takes all that the index has by then."""

    def __init__(self, index: str):
        self.index = index

    def initialOffset(self) -> dict:
        return {"ranges": 0}

    def latestOffset(self) -> dict:
        return {"ranges": len(_rows(self.index))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Range(r) for r in _rows(self.index) if start["ranges"] <= r["no"] < end["ranges"]]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return _batches(partition.value)


class JsonMap(DataSource):
    """``spark.read.format("json_map").option("index", ...)``: rows (key, value, at, is_text) of indexed maps, ``at`` being an entry's place in bytes; the same as a stream."""

    @classmethod
    def name(cls) -> str:
        return "json_map"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["index"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["index"])


def large_maps(spark: SparkSession, index: str, stream: bool = False) -> DataFrame:
    """Rows (key, value, at, is_text) of the maps of an index: a task per byte range. An entry whose key repeats comes as often as it stands there; an empty object has no rows."""
    spark.dataSource.register(JsonMap)
    return (spark.readStream if stream else spark.read).format("json_map").option("index", index).load()


def _as_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, json) of a partition as the lines of one map; a partition without rows is an empty map. Values stay Arrow's, and are copied some at a time."""
    before = "{"
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            done = ends[at - 1] if at else 0
            n = int(np.searchsorted(ends, done + BATCH_SIZE)) + 1 - at
            part = b.slice(at, n)
            heads = []
            for key in part.column(0).to_pylist():
                heads.append(f"{before}{json.dumps(key)}: ")
                before = ","
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(pa.array(heads, pa.string()), pc.fill_null(part.column(1), "null"), "")], ["value"])
            at += n
    yield pa.RecordBatch.from_arrays([pa.array(["}" if before == "," else "{}"])], ["value"])


def write_maps(rows: DataFrame, folder: str) -> list[str]:
    """Write rows (key, json: a value's JSON) as a map per partition, an entry a line, and return the files."""
    rows.select("key", "json").mapInArrow(_as_map, "value string").write.text(folder)
    where, name = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    prefix = folder[: len(folder) - len(name)] if folder.endswith(name) else ""
    return sorted(prefix + f.path for f in where.get_file_info(fs.FileSelector(name)) if f.base_name.startswith("part-"))
