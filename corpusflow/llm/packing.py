"""Packing: best-fit decreasing over a segment tree of remaining capacities."""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import Scratch

WINDOW = 2048
#: Words whose ids a Python worker holds; beyond that, only those of the texts at hand stay.
CACHED_WORDS = 250_000
#: Anything but Latin letters whose lower case is one letter each in any context, digits and signs; special tokens.
_ODD = re.compile("[^\n!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u0148\u014a-\u017e]|<[|]")
#: The runs that the tokenizer cuts such words into, and the ends of words; no id's bytes look like the mark.
_MARK = b"\xff\xff\xff\xff"
_RUNS = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


class OpenWindows:
    """Open windows by remaining capacity; ``take`` finds the tightest that fits in log(size) steps."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(size + 1)]

    def _change(self, capacity: int, by: int) -> None:
        k = capacity + self.leaves
        while k:
            self.count[k] += by
            k >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.at[capacity].append(window)
        self._change(capacity, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(capacity, window) of the least capacity >= length."""
        k = length + self.leaves
        if not self.count[k]:
            while k > 1 and (k & 1 or not self.count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        capacity = k - self.leaves
        self._change(capacity, -1)
        return capacity, self.at[capacity].pop()


def best_fit_decreasing(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """(window, offset) of each piece, lengths being in descending order and none above size."""
    tree, windows, out = OpenWindows(size), 0, []
    for n in lengths:
        found = tree.take(n)
        if found is None:
            found, windows = (size, windows), windows + 1
        out.append((found[1], size - found[0]))
        if found[0] > n:
            tree.put(found[0] - n, found[1])
    return out


class WordIds:
    """Token ids of white-space separated words, as little-endian bytes.

    The tokenizer drops white space and joins nothing across it, so a text's ids are its words' ids; within
    a word it cuts runs of letters, single digits and runs of other characters, and ids of a run don't
    depend on its neighbours. Runs of letters are encoded many to a text: the id that ends a run ends in
    ``</w>``. Words with characters whose case or composition may depend on context are encoded whole.
    """

    def __init__(self, path: str | None):
        # One thread a task; the setting has to precede the first batch. Threads would each keep memory of their own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.words: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {"\n": _MARK}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_runs(self, runs: list[str], together: int = 256) -> None:
        letters = [r for r in runs if r.isalpha()]
        groups = [letters[k : k + together] for k in range(0, len(letters), together)]
        for group, ids in zip(groups, self._encode([" ".join(g) for g in groups]), strict=True):
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            flat = ids.tobytes()
            self.runs.update((r, flat[4 * x : 4 * y]) for r, x, y in zip(group, [0, *cuts], cuts, strict=False))
        others = [r for r in runs if not r.isalpha()]
        self.runs.update(zip(others, (i.tobytes() for i in self._encode(others)), strict=True))

    def learn(self, words: list[bytes]) -> None:
        together = b"\n".join(words).decode("utf-8", "surrogatepass")
        if _ODD.search(together):
            plain, whole = [], []
            for w in words:
                (whole if _ODD.search(w.decode("utf-8", "surrogatepass")) else plain).append(w)
            self.words.update(zip(whole, (i.tobytes() for i in self._encode([w.decode("utf-8", "surrogatepass") for w in whole])), strict=True))
            words, together = plain, b"\n".join(plain).decode()
        if not words:
            return
        runs = _RUNS.findall(together.lower())
        self._learn_runs(list(set(runs).difference(self.runs)))
        ids = b"".join(map(self.runs.__getitem__, runs)).split(_MARK)
        self.words.update(zip(words, ids, strict=True))

    def ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one behind the other, number of ids of each word) of distinct words."""
        if len(self.words) > CACHED_WORDS:
            # What the words at hand need stays: common words are among them.
            self.words = {w: self.words[w] for w in words if w in self.words}
        if len(self.runs) > CACHED_WORDS:
            self.runs = {"\n": _MARK}
        if new := [w for w in words if w not in self.words]:
            self.learn(new)
        ids = [self.words[w] for w in words]
        return np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4


@lru_cache(maxsize=1)
def word_ids(path: str | None) -> WordIds:
    """A Python worker's own table, kept over its tasks."""
    return WordIds(path)


def _slices(text: pa.Array, limit: int) -> list[pa.Array]:
    """Runs of whole texts of about ``limit`` bytes; a longer text is a run of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
    cuts, at = [0], 0
    while at < len(text):
        at = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right")))
        cuts.append(at)
    return [text.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first[k] ... first[k] + count[k] - 1 for all k, one behind the other."""
    return np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)


def _pieces(path: str | None, window: int, end_id: int, with_ids: bool, chunk: int = 1 << 21):
    def run(batches):
        table = word_ids(path)
        for batch in batches:
            at = 0
            for texts in _slices(batch.column("text"), chunk):
                docs = batch.column("doc_id").slice(at, len(texts))
                at += len(texts)
                yield _cut(table, docs, texts, window, end_id, with_ids)

    return run


def _cut(table: WordIds, docs: pa.Array, texts: pa.Array, window: int, end_id: int, with_ids: bool) -> pa.RecordBatch:
    """The pieces of a run of texts; ``copy`` tells rows that are equal in this run apart."""
    words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = words.flatten().cast(pa.binary()).dictionary_encode()
    ids, count = table.ids_of(coded.dictionary.to_pylist())
    # One more word, the end id, follows each text.
    ends = words.offsets.to_numpy()[1:] - words.offsets[0].as_py()
    order = np.insert(coded.indices.to_numpy().astype(np.int64), ends, len(count))
    ids, count = np.append(ids, np.uint32(end_id)), np.append(count, 1)
    first = np.cumsum(count) - count
    tokens = np.ascontiguousarray(ids[_ranges(first[order], count[order])], "<u4")
    stop = np.cumsum(count[order])[ends + np.arange(len(ends))]
    total = np.diff(stop, prepend=0)
    pieces = -(-total // window)
    doc = np.repeat(np.arange(len(total)), pieces)
    start = window * _ranges(np.zeros_like(pieces), pieces)
    length = np.minimum(window, total[doc] - start)
    begin = (stop - total)[doc] + start
    raw = memoryview(tokens).cast("B")
    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
    own = docs.take(pa.array(doc))
    seen: Counter = Counter()
    copy = []
    for key in zip(own.to_pylist(), start.tolist(), crc, strict=True):
        copy.append(seen[key])
        seen[key] += 1
    columns = [own, pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total[doc]), pa.array(copy, pa.int32())]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "copy"]
    if with_ids:
        columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(tokens)).astype(np.int32)), pa.array(tokens.astype(np.int32))))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names)


def _packed(window: int):
    def run(batches):
        part, held = None, []

        def flush():
            pieces = pa.Table.from_batches(held).combine_chunks()
            first = part << 32
            placed = best_fit_decreasing(pieces.column("length").to_pylist(), window)
            pieces = pieces.drop_columns(["part"]).append_column("sequence_id", pa.array([first + w for w, _ in placed], pa.int64()))
            return pieces.append_column("offset", pa.array([o for _, o in placed], pa.int64())).to_batches()

        for batch in batches:
            parts = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    if held and part != parts[a]:
                        yield from flush()
                        held = []
                    part = int(parts[a])
                    held.append(batch.slice(a, b - a))
        if held:
            yield from flush()

    return run


def pack(spark: SparkSession, docs: DataFrame, window: int = WINDOW, end_id: int = 1, tokenizer_path: str | None = None, with_ids: bool = False, part_tokens: int = 1 << 20) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens (with ids: ids), sequence_id, offset.

    A document's ids and then ``end_id`` are cut into full windows and a remainder. Pieces are dealt by a
    hash into parts of about ``part_tokens`` ids, whatever the input, so that rows equal in all columns go to
    different parts; a task packs several parts, each on its own, longest first, ties by doc_id and start, so
    one open window or a few per part stay underfilled. Null and empty texts give a single piece, the end id.
    Rows with equal or null ids give their own pieces; other columns are ignored.
    """
    work = Scratch(spark, "packing")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    ids = ", ids array<int>" * with_ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = work.save(texts.mapInArrow(_pieces(tokenizer_path, window, end_id, with_ids), f"{schema}, copy int{ids}"), "pieces")
    total = pieces.agg(F.sum("length").alias("n")).first()["n"] or 0
    parts = max(1, -(-total // part_tokens))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "copy"), F.lit(parts))).drop("copy")
    # Partitions are the session's, however many parts there are; a number keeps AQE from merging them into one task.
    tasks = min(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartition(tasks, "part").sortWithinPartitions("part", F.desc("length"), "doc_id", "start", "ids_crc32")
    return dealt.mapInArrow(_packed(window), schema + ids + ", sequence_id long, offset long")
