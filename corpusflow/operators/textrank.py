"""Extractive summaries: sentence graph, PageRank, position bias, greedy choice without redundancy. A document is one row, and a task looks at blocks of documents together."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions import text as T
from .align import TOKENS, _tokens

#: Cells of similarities that a task holds at a time, unless one sentence has more.
CELLS = 1 << 22


def banded(sentences: Column, least: int = 12, most: int = 80, wanted: int = 8, widest: int = 999) -> Column:
    """Of an array of sentences those of least..most words; if these are under ``wanted``, those of least..widest words; if these are under two, all: structs (sent_idx, sentence)."""
    counted = F.transform(sentences, lambda s, i: F.struct(i.alias("sent_idx"), s.alias("sentence"), T.word_count(s).alias("n")))
    within = lambda a, high: F.filter(a, lambda x: x["n"].between(least, high))

    def pick(d: Column) -> Column:
        return F.when(F.size(d["narrow"]) >= max(2, wanted), d["narrow"]).when(F.size(d["wide"]) >= 2, d["wide"]).otherwise(d["every"])

    return T.let(counted, lambda a: T.let(F.struct(a.alias("every"), within(a, most).alias("narrow"), within(a, widest).alias("wide")), pick))


def sentence_rows(df: DataFrame, abbreviations: list[str] = lexicon.LEGAL_ABBREVIATIONS, wanted: int = 8) -> DataFrame:
    """Documents (doc_id, text) to the rows (doc_id, sent_idx, sentence) of ``banded``."""
    return df.select("doc_id", F.explode(banded(T.sentences(F.col("text"), abbreviations, 0), wanted=wanted)).alias("s")).select("doc_id", "s.sent_idx", "s.sentence")


def tokenised(df: DataFrame, abbreviations: list[str] = lexicon.LEGAL_ABBREVIATIONS, wanted: int = 8, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Documents (keys, text) to (keys, doc): a struct (sent_idx, sentences, tokens) of arrays over the sentences of ``banded``, tokens being all words in lower case. One column, as Spark would cut sentences again for each of several, and for a filter."""
    parts = lambda a: F.struct(a["sent_idx"].alias("sent_idx"), a["sentence"].alias("sentences"), F.transform(a, lambda x: T.content_words(x["sentence"], [])).alias("tokens"))
    return df.select(*keys, T.let(banded(T.sentences(F.col("text"), abbreviations, 0), wanted=wanted), parts).alias("doc"))


class _Block:
    """Term weights of the sentences of several documents, as cells by sentence and term; a term is a content word of two letters or more, or a pair of such words, of one document.

    Weights are TF-IDF within the document, sublinear, of length one by sentence; terms in over ``max_share`` of a document's sentences
    are left out. Similarity is the inner product. Cells are of terms that several sentences have, as others add to no similarity.
    """

    def __init__(self, tokens: pa.Array, max_share: float = 0.85):
        each = tokens.flatten()
        self.size = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.doc = np.repeat(np.arange(len(self.size)), self.size)
        self.n = len(self.doc)
        #: Place of a sentence within its document.
        self.place = np.arange(self.n) - self.first[self.doc]
        coded = each.flatten().dictionary_encode()
        code, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
        owner = np.repeat(np.arange(self.n), pc.list_value_length(each).to_numpy(zero_copy_only=False))
        fit = pc.and_(pc.greater(pc.utf8_length(coded.dictionary), 1), pc.invert(pc.is_in(coded.dictionary, pa.array(lexicon.STOP_WORDS))))
        fit = fit.to_numpy(zero_copy_only=False).astype(bool)[code]
        owner, code = owner[fit], code[fit]
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        # Words are numbered from 0, pairs of them behind the words, documents behind each other.
        owner, code = np.concatenate((owner, owner[pair])), np.concatenate((code, words + code[pair] * words + code[pair + 1]))
        terms, term = np.unique(self.doc[owner] * (words + words * words) + code, return_inverse=True)
        cell, times = np.unique(owner * max(1, len(terms)) + term, return_counts=True)
        row, col = cell // max(1, len(terms)), cell % max(1, len(terms))
        seen, n = np.bincount(col, minlength=len(terms))[col], self.size[self.doc[row]]
        keep = seen <= max_share * n
        row, col, times, seen, n = row[keep], col[keep], times[keep], seen[keep], n[keep]
        w = (1 + np.log(times)) * (np.log((1 + n) / (1 + seen)) + 1)
        w = w / np.sqrt(np.bincount(row, w * w, self.n))[row]
        self._take(row[seen > 1], col[seen > 1], w[seen > 1])

    def _take(self, row: np.ndarray, col: np.ndarray, w: np.ndarray) -> None:
        names, self.col = np.unique(col, return_inverse=True)
        self.row, self.w, self.terms = row, w, len(names)

    @classmethod
    def of_one(cls, sentences: np.ndarray, terms: pa.Table) -> _Block:
        """One document: ascending sentence numbers and rows (sent_idx, term, w)."""
        block = cls.__new__(cls)
        block.n, block.size, block.first = len(sentences), np.array([len(sentences)]), np.zeros(1, np.int64)
        block.doc, block.place = np.zeros(block.n, np.int64), np.arange(block.n)
        block._take(np.searchsorted(sentences, terms.column("sent_idx").to_numpy()), terms.column("term").combine_chunks().dictionary_encode().indices.to_numpy(), terms.column("w").to_numpy())
        return block

    def ranks(self, damping: float, rounds: int, tolerance: float | None) -> np.ndarray:
        """PageRank of every sentence; a document's rounds end by themselves. A round multiplies by the terms, no matrix is made."""
        row, col, w, own = self.row, self.col, self.w, np.bincount(self.row, self.w * self.w, self.n)

        def times(v: np.ndarray) -> np.ndarray:
            by_term = np.bincount(col, w * v[row], self.terms)
            return np.bincount(row, w * by_term[col], self.n) - own * v

        linked = np.bincount(row, minlength=self.n) > 0
        out, n = times(np.ones(self.n)), self.size[self.doc].astype(float)
        share = np.where(linked, 1 / np.where(linked, out, 1.0), 0.0)
        score, going = 1 / n, self.size > 0
        held = going.sum()
        for _ in range(rounds):
            new = (1 - damping) / n + damping * np.where(linked, times(score * share), 0.0)
            change = np.bincount(self.doc, np.abs(new - score), len(self.size))
            score = np.where(going[self.doc], new, score)
            if tolerance is not None:
                going &= change >= tolerance
            if not going.any():
                break
            if going.sum() * 2 < held:  # the cells of settled documents are no longer needed
                live, held = going[self.doc[row]], going.sum()
                row, col, w = row[live], col[live], w[live]
        return score

    def biased(self, score: np.ndarray, weight: float) -> np.ndarray:
        """(1 - weight) * score + weight * (n - i) / n, i being the sentence's place in its document."""
        n = self.size[self.doc]
        return (1 - weight) * score + weight * (n - self.place) / n

    def chosen(self, score: np.ndarray, wanted: int, limit: float, section: np.ndarray | None = None) -> np.ndarray:
        """Whether a sentence is chosen: in each document greedily by score (of equals the later), one of each section first, then any, none as similar as ``limit`` to one taken.

        What may be taken only shrinks, so each turn takes the first of what is left, in all documents at once.
        """
        order = np.empty(self.n, np.int64)
        order[np.lexsort((-self.place, -score, self.doc))] = np.arange(self.n)
        taken, nearest = np.zeros(self.n, bool), np.zeros(self.n)
        if section is not None:
            names, part = np.unique(self.doc * (np.int64(section.max(initial=0)) + 2) + section + 1, return_inverse=True)
            seen = np.zeros(len(names), bool)
        for _ in range(wanted):
            free = ~taken & (nearest < limit)
            if section is not None:
                fresh = free & ~seen[part]
                any_fresh = np.bincount(self.doc[fresh], minlength=len(self.size)) > 0
                free = np.where(any_fresh[self.doc], fresh, free)
            at = np.flatnonzero(free)
            if not len(at):
                break
            at = at[np.argsort(order[at], kind="stable")]  # documents stay in order
            at = at[np.unique(self.doc[at], return_index=True)[1]]
            taken[at] = True
            if section is not None:
                seen[part[at]] = True
            mine = np.zeros(self.n, bool)
            mine[at] = True
            mine = mine[self.row]
            weight = np.zeros(self.terms)
            weight[self.col[mine]] = self.w[mine]
            nearest = np.maximum(nearest, np.bincount(self.row, self.w * weight[self.col], self.n))
        return taken

    def edges(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(from, to, similarity) of the sentences that share a term, some sentences at a time."""
        order = np.argsort(self.col, kind="stable")
        count = np.bincount(self.col, minlength=self.terms)
        start = np.cumsum(count) - count
        width = self.size[self.doc]
        work = np.cumsum(np.maximum(np.bincount(self.row, count[self.col], self.n).astype(np.int64), width))
        low = 0
        while low < self.n:
            high = max(low + 1, int(np.searchsorted(work, (work[low - 1] if low else 0) + CELLS, side="right")))
            a, b = np.searchsorted(self.row, (low, high))
            ends = np.cumsum(width[low:high])
            base = ends - width[low:high]
            n = count[self.col[a:b]]
            at = order[np.arange(n.sum()) + np.repeat(start[self.col[a:b]] - np.cumsum(n) + n, n)]
            total = np.bincount(np.repeat(base[self.row[a:b] - low], n) + self.place[self.row[at]], np.repeat(self.w[a:b], n) * self.w[at], ends[-1])
            at = np.flatnonzero(total)
            src = low + np.searchsorted(ends, at, side="right")
            dst = at - base[src - low] + self.first[self.doc[src]]
            keep = src != dst
            yield src[keep], dst[keep], total[at][keep]
            low = high


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array, pa.Array, _Block]]:
    """Rows of ``tokenised`` that have sentences, in blocks of a bounded number of tokens unless a document has more: rows, sentence numbers, sentences, weights."""
    for b in batches:
        b = b.filter(pc.fill_null(pc.greater(pc.list_value_length(pc.struct_field(b.column("doc"), "tokens")), 0), False))
        low, held = 0, 0
        for i, n in enumerate(_tokens(pc.struct_field(b.column("doc"), "tokens")).tolist()):
            held += n
            if held >= TOKENS or i + 1 == b.num_rows:
                part = b.slice(low, i + 1 - low)
                names, sentences, tokens = (pc.struct_field(part.column("doc"), f) for f in ("sent_idx", "sentences", "tokens"))
                yield part, names.flatten(), sentences, _Block(tokens)
                low, held = i + 1, 0


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, names, _, block in _blocks(batches):
        for src, dst, w in block.edges():
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(block.doc[src])), names.take(pa.array(src)), names.take(pa.array(dst)), pa.array(w)], ["doc_id", "src", "dst", "w"])


def similarity_edges(docs: DataFrame) -> DataFrame:
    """Edges (doc_id, src, dst, w) of sentences of one document (as ``tokenised`` gives it) that share a term, both ways, no loops."""
    return docs.select("doc_id", "doc").mapInArrow(_linked, "doc_id long, src int, dst int, w double")


def pagerank(docs: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6, bias: float = 0.0) -> DataFrame:
    """Documents as ``tokenised`` gives them to (doc_id, sent_idx, score): rows normalised, no redistribution of what dangling sentences hold.

    A document's rounds end after ``rounds`` or, with a tolerance, once its scores changed by less in sum. With a
    ``bias``, (1 - bias) * score + bias * (n - i) / n, i being the sentence's place among those scored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, names, _, block in _blocks(batches):
            score = block.biased(block.ranks(damping, rounds, tolerance), bias)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(block.doc)), names, pa.array(score)], ["doc_id", "sent_idx", "score"])

    return docs.select("doc_id", "doc").mapInArrow(run, "doc_id long, sent_idx int, score double")


def _choose(wanted: int, limit: float):
    def run(scores: pa.Table, terms: pa.Table) -> pa.Table:
        rows = scores.sort_by("sent_idx")
        names = rows.column("sent_idx").to_numpy()
        block = _Block.of_one(names, terms.filter(pc.is_in(terms.column("sent_idx"), pa.array(names))))
        section = rows.column("section").to_numpy() if "section" in rows.column_names else None
        chosen = names[block.chosen(rows.column("score").to_numpy(), wanted, limit, section)]
        return pa.table([pa.repeat(scores.column("doc_id")[0], len(chosen)), pa.array(chosen, pa.int32())], ["doc_id", "sent_idx"])

    return run


def choose_sentences(scores: DataFrame, terms: DataFrame, wanted: int = 8, limit: float = 0.35) -> DataFrame:
    """Greedy choice by document in order of score, from any scores and terms (doc_id, sent_idx, term, w): one of each section first (if a column ``section`` is given), then any, none as similar as ``limit`` to one taken. One document is one group."""
    return scores.groupBy("doc_id").cogroup(terms.select("doc_id", "sent_idx", "term", "w").groupBy("doc_id")).applyInArrow(_choose(wanted, limit), "doc_id long, sent_idx int")


def _section_numbers(texts: pa.Array, sentences: pa.Array, starts: pa.Array) -> pa.Array:
    out = []
    for text, some, begins in zip(texts.to_pylist(), sentences.to_pylist(), starts.to_pylist(), strict=True):
        if some is None:
            out.append(None)
            continue
        found: dict[str, int] = {}
        for s in {s[:60] for s in some}:
            at = text.find(s)
            found[s] = bisect_right(begins, max(0, at if at >= 0 else text.find(s[:40]))) - 1
        out.append([found[s[:60]] for s in some])
    return pa.array(out, pa.list_(pa.int32()))


def sentence_sections(text: Column, sentences: Column, sections: Column) -> Column:
    """For each of a text's sentences the number of the last section that starts at or before the sentence's first occurrence in the text (by its first 60 characters, else 40), -1 before any. In Arrow batches, a text being one row."""
    return F.arrow_udf(_section_numbers, "array<int>")(text, sentences, F.transform(sections, lambda s: s["start"]))


def summarise(df: DataFrame, wanted: int = 8, covering: bool = False, abbreviations: list[str] = lexicon.LEGAL_ABBREVIATIONS, rounds: int = 100, limit: float = 0.35, bias: float = 0.05, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows (keys, summary) of documents (keys, text) with sentences; ``covering``: the choice covers the sections of ``chunks.sections`` first (key doc_id only). Nothing is shuffled."""
    from .chunks import sections

    if covering:
        docs = tokenised(sections(df, keep=("text",)), abbreviations, wanted, ("doc_id", "text", "sections"))
        docs = docs.select("doc_id", "doc", "text", F.transform("sections", lambda s: s["start"]).alias("starts"))
    else:
        docs = tokenised(df, abbreviations, wanted, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, sentences, block in _blocks(batches):
            section = _section_numbers(b.column("text"), sentences, b.column("starts")).flatten().to_numpy() if covering else None
            taken = block.chosen(block.biased(block.ranks(0.85, rounds, 1e-6), bias), wanted, limit, section)
            ends = np.concatenate(([0], np.cumsum(np.bincount(block.doc[taken], minlength=b.num_rows)))).astype(np.int32)
            texts = pa.ListArray.from_arrays(pa.array(ends), sentences.flatten().filter(pa.array(taken)))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pc.binary_join(texts, " ")], [*keys, "summary"])

    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.mapInArrow(run, f"{schema}, summary string")
