"""Toxicity: a support vector machine over a gap-weighted subsequence kernel with Nyström landmarks.

The kernel compares strings by their common subsequences of ``ORDER`` letters, each weighted by
``DECAY`` to the power of the letters it spans and with at most ``GAP`` letters skipped at each step,
normalised by length; so an insult with inserted characters keeps most of its value. The machine learns from
labelled sentences as bags of such strings (multiple-instance learning): every string of a clean sentence is
clean, a toxic text has one string at least that makes it so, and the machine itself says which. A landmark
expansion sum(b_j k(x, l_j)) is linear in the subsequences of x, so a trained machine folds into one
table of subsequence weights, which scores a string without visiting the landmarks.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from heapq import nlargest
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER, GAP, DECAY = 3, 2, 0.6
LETTERS = 32
#: Letters of a unit; longer runs are read in overlapping units.
UNIT = 24
#: Labelled documents that training reads by class, and letters of all of them, at most (the smallest by hash; whole texts).
TRAIN_DOCS, TRAIN_LETTERS = {1: 1500, 0: 4500}, 1 << 26
#: Landmarks at first, and those that each turn adds.
LANDMARKS, MORE_LANDMARKS, TURNS = 200, 60, 6
#: How much more a clean string weighs after each turn that takes it for toxic.
HARDER = 3.0
COST = 100.0
#: How often a string counts against itself as a sign of toxicity for each clean sentence that has it.
CLEAN_COUNTS = 20.0
#: Distinct strings that the machine is trained on, at most: those of most sentences, whatever their labels.
STRINGS = 25_000
#: Rows of a matrix that are worked on at a time.
BLOCK = 4_096
#: Best values of a text's words that its score rests on, and the value of words that are not there.
TOP, ABSENT = 3, -3.0
#: Words beyond which a text's length counts against its best values, since long texts meet some by chance.
FEW_WORDS = 50
CACHED_WORDS = 200_000
#: Digits and signs that stand for letters.
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

#: Accented letters by what they are read as, one of the five signs after z.
ACCENTED = str.maketrans({**dict.fromkeys("é", "{"), **dict.fromkeys("èêë", "|"), **dict.fromkeys("ñçß", "}"), **dict.fromkeys("äöü", "~"), **dict.fromkeys("áàâãåíìîïóòôõøúùûý", "\x7f")})


def letters_of(word: str, plain: bool = True) -> str:
    """Lower-case letters a-z of a word, lookalike signs between letters read as letters; accents are dropped, or (not ``plain``) kept apart by the five signs after z."""
    w = word.lower().strip(".,;:!?\"'()[]{}|*#%&$")
    if not w.isalpha():
        w = "".join(c for c in w.translate(LOOKALIKE) if c.isalpha())
    if not w.isascii():
        w = unicodedata.normalize("NFKD", w) if plain else w.translate(ACCENTED)
        w = "".join(c for c in w if "a" <= c <= "\x7f")
    return w


def forms_of(word: str) -> list[str]:
    """The letters of a word, and those without accents where they differ."""
    plain = letters_of(word)
    return [plain] if word.isascii() or (kept := letters_of(word, False)) == plain else [kept, plain]


def pieces_of(letters: str) -> list[str]:
    """The units of a word: itself, or overlapping units of a long one."""
    return [letters] if len(letters) <= UNIT else [letters[i : i + UNIT] for i in range(0, len(letters) - UNIT // 2, UNIT // 2)]


def spelled(words: list[str]) -> list[str]:
    """Runs of three or more one-letter words, each read as one word."""
    out, run = [], []
    for w in words:
        if len(w) < 3 and len(x := letters_of(w)) == 1:
            run.append(x)
        else:
            if len(run) > 2:
                out.append("".join(run))
            run = []
    return [*out, "".join(run)] if len(run) > 2 else out


def units_of(text: str) -> list[str]:
    """Units of a whole text: its words and the words that it spells letter by letter."""
    words = text.split()
    return [u for w in [*(f for x in words for f in forms_of(x)), *spelled(words)] if len(w) > 1 for u in pieces_of(w)]


def subsequences(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index, weight) of the gapped subsequences of each unit, as two arrays units x places; weights have length one by unit."""
    wide = UNIT + (ORDER - 1) * (GAP + 1)
    codes = np.frombuffer("".join([u.ljust(wide, "`") for u in units]).encode(), np.uint8).reshape(-1, wide).astype(np.int32) - 96
    index, weight = [], []
    for steps in product(range(1, GAP + 2), repeat=ORDER - 1):
        places = np.cumsum((0, *steps))
        code = codes[:, :UNIT]
        for at in places[1:]:
            code = code * LETTERS + codes[:, at : UNIT + at]
        index.append(code)
        weight.append((codes[:, places[-1] : UNIT + places[-1]] > 0) * np.float32(DECAY ** (places[-1] + 1)))
    index, weight = np.concatenate(index, axis=1), np.concatenate(weight, axis=1)
    norm = np.sqrt(np.einsum("ij,ij->i", weight, weight))[:, None]
    return index, weight / np.maximum(norm, 1e-9)


class ToxicityModel:
    """Folded machine: a weight per subsequence, a bias, and the logistic map from what a text shows to its score."""

    def __init__(self, table: np.ndarray, bias: float, slopes: np.ndarray, offset: float):
        self.table, self.bias, self.slopes, self.offset = table, bias, slopes, offset
        self.cache: dict[str, float] = {}

    def decide(self, units: list[str]) -> np.ndarray:
        out = np.zeros(len(units))
        for k in range(0, len(units), 2048):
            index, weight = subsequences(units[k : k + 2048])
            out[k : k + 2048] = (self.table[index] * weight).sum(axis=1) + self.bias
        return out

    def shown(self, text: str) -> np.ndarray:
        """What a text shows: the best values over all its words, repeats included, in falling order and 0 at least, and how much longer it is than a few sentences, as a logarithm."""
        words = text.split()
        times = Counter(words)
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        new = [w for w in times if w not in self.cache]
        if new:
            units = [[u for x in forms_of(w) if len(x) > 1 for u in pieces_of(x)] for w in new]
            values = iter(self.decide([u for us in units for u in us]).tolist())
            self.cache.update((w, max([next(values) for _ in us], default=ABSENT)) for w, us in zip(new, units, strict=True))
        best = nlargest(TOP, ((self.cache[w], n) for w, n in times.items()))
        runs = [u for w in spelled(words) for u in pieces_of(w)] if sum(len(w) < 3 for w in times) > 2 else []
        values = sorted([v for v, n in best for _ in range(min(n, TOP))] + self.decide(runs).tolist() + [ABSENT] * TOP, reverse=True)[:TOP]
        return np.array([*np.maximum(values, 0), max(0.0, np.log(max(1, len(words)) / FEW_WORDS))])

    def probability(self, shown: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(shown @ self.slopes + self.offset, -50, 50))))


def _machine(x: np.ndarray, pro: np.ndarray, con: np.ndarray, cost: float = COST) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss by Newton steps, each row counting ``pro`` times as toxic and ``con`` times as clean, classes weighing the same; the last column of x is constant."""
    pro, con = (cost * pro / max(1.0, pro.sum())).astype(np.float32), (cost * con / max(1.0, con.sum())).astype(np.float32)
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 0.1)
    ridge[-1] = 1e-6
    for _ in range(30):
        curve, slope = np.diag(ridge), ridge * w
        for i in range(0, len(x), BLOCK):  # blocks of rows, so that no copy of x is made
            rows, p, c = x[i : i + BLOCK], pro[i : i + BLOCK], con[i : i + BLOCK]
            value = rows @ w.astype(np.float32)
            low, high = np.maximum(0, 1 - value), np.maximum(0, 1 + value)
            bent = p * (low > 0) + c * (high > 0)
            on = bent > 0
            curve = curve + 2 * ((rows[on].T * bent[on]) @ rows[on])
            slope = slope - 2 * (rows.T @ (p * low - c * high))
        step = np.linalg.solve(curve, slope)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    return w


class Landmarks:
    """Nyström features of strings: kernel values with the landmarks, times the inverse root of the landmarks' own."""

    def __init__(self, strings: list[str]):
        self.own = np.zeros((0, LETTERS**ORDER), np.float32)
        self.add(strings)

    def add(self, strings: list[str]) -> None:
        index, weight = subsequences(strings)
        more = np.zeros((len(strings), LETTERS**ORDER), np.float32)
        np.add.at(more, (np.arange(len(strings))[:, None], index), weight)
        self.own = np.concatenate((self.own, more))
        values, vectors = np.linalg.eigh((self.own @ self.own.T).astype(float))
        good = values > 1e-6
        self.root = vectors[:, good] / np.sqrt(values[good])

    def kernel(self, strings: list[str], first: int = 0, out: np.ndarray | None = None) -> np.ndarray:
        """Kernel values of strings with the landmarks from the ``first`` on, in their columns of ``out`` if it is given; only subsequences that a string has are visited."""
        columns = np.ascontiguousarray(self.own[first:].T)
        out = np.zeros((len(strings), columns.shape[1]), np.float32) if out is None else out[:, first : len(self.own)]
        for i in range(0, len(strings), 512):
            index, weight = subsequences(strings[i : i + 512])
            row, place = np.nonzero(weight)
            if len(row):
                values = columns[index[row, place]] * weight[row, place, None]
                starts = np.flatnonzero(np.diff(row, prepend=-1))
                out[i + row[starts]] = np.add.reduceat(values, starts, axis=0)
        return out

    def folded(self, w: np.ndarray) -> np.ndarray:
        """The weight of each subsequence in the machine with weights w."""
        return (self.own.T @ (self.root @ w[:-1])).astype(np.float32)


def _spread(strings: list[str], n: int) -> list[str]:
    """About n strings: the first half as they come, the others evenly over what follows."""
    return strings[: n // 2] + strings[n // 2 :: max(1, (len(strings) - n // 2) // max(1, n - n // 2))]


NOTHING = (np.zeros(LETTERS**ORDER, np.float32), -1.0, np.array([1.0] + [0.0] * TOP), -3.0)


def train(texts: list[tuple[str, int]]) -> ToxicityModel:
    """Fit on labelled texts, every third of them for the logistic map only.

    A text is a bag of sentences with its label, a sentence a bag of strings; equal sentences count once, as clean if
    any is. Every string stands for toxicity as often as toxic sentences have it and against it as often as clean ones
    do; landmarks are spread over all strings by frequency, and each turn adds those on which the machine errs most.
    In later turns a toxic text's strings stand for toxicity only where the machine finds them so, its best one at
    least. Labels choose no strings before the machine. Without toxic or clean sentences every text scores low.
    """
    fit, rest = [t for k, t in enumerate(texts) if k % 3], texts[::3]
    toxic, clean, bags, seen = Counter(), Counter(), [], set()
    for text, y in sorted(fit, key=lambda t: t[1]):
        bag = set()
        for sentence in re.split(r"(?<=[.!?])\s+|\n", text):
            units = {u for u in units_of(sentence) if len(u) >= ORDER}  # two letters have no subsequence of three
            bag |= units
            if sentence not in seen:
                seen.add(sentence)
                (toxic if y else clean).update(units)
        if y:
            bags.append(bag)
    if not toxic or not clean:
        return ToxicityModel(*NOTHING)
    strings = sorted(toxic.keys() | clean.keys(), key=lambda u: (-toxic[u] - clean[u], u))[:STRINGS]
    place = {u: k for k, u in enumerate(strings)}
    held = [np.array([place[u] for u in bag if u in place], int) for bag in bags]
    times, usual = (np.array([float(c[u]) for u in strings]) for c in (toxic, clean))
    weight = times / (1 + CLEAN_COUNTS * usual)
    pro, con = weight, (usual > 0) * 1.0
    marks = Landmarks(list(dict.fromkeys(_spread(strings, LANDMARKS)))[:LANDMARKS])
    kernel, used = np.zeros((len(strings), LANDMARKS + TURNS * MORE_LANDMARKS), np.float32), set()
    marks.kernel(strings, 0, kernel)
    for turn in range(TURNS):
        x = np.ones((len(strings), marks.root.shape[1] + 1), np.float32)
        np.matmul(kernel[:, : len(marks.own)], marks.root.astype(np.float32), out=x[:, :-1])
        w = _machine(x, pro, con)
        value = x @ w
        machine = ToxicityModel(marks.folded(w), float(w[-1]), np.zeros(TOP + 1), 0.0)
        if turn + 1 == TURNS:
            break
        sure = (value > 0) & (times > 1)
        sure[[own[np.argmax(value[own])] for own in held if len(own) and value[own].max() > 0]] = True
        if turn:
            pro, con = weight * sure, con * np.where(value > 0, HARDER, 1.0)
        pull = np.abs(pro / max(1.0, pro.sum()) * np.maximum(0, 1 - value) - con / con.sum() * np.maximum(0, 1 + value))
        # Where the pull of a string on the machine is largest, the landmarks serve it worst.
        more = [strings[k] for k in np.argsort(-pull, kind="stable")[: MORE_LANDMARKS + len(used)] if strings[k] not in used][:MORE_LANDMARKS]
        used.update(more)
        before = len(marks.own)
        marks.add(more)
        marks.kernel(strings, before, kernel)
    shown = np.array([machine.shown(t) for t, _ in rest])
    slopes, offset = _logistic(shown, np.array([y for _, y in rest], float))
    return ToxicityModel(machine.table, machine.bias, slopes, offset)


def _logistic(shown: np.ndarray, y: np.ndarray, at: float = 0.7) -> tuple[np.ndarray, float]:
    """Slopes and offset of a logistic regression on what texts show, moved so that it is ``at`` where toxic and clean texts part best.

    That is a quarter into the widest stretch of values, from its clean side, with the least sum of missed toxic and four times the caught clean shares.
    """
    if not y.any() or y.all():
        return np.array([4.0] + [0.0] * TOP), -2.0
    mean, spread = shown.mean(axis=0), shown.std(axis=0) + 1e-6
    x = np.concatenate(((shown - mean) / spread, np.ones((len(shown), 1))), axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.full(len(w), 1.0)
        ridge[-1] = 1e-6
        w = w + np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
    v = x @ w
    cuts = np.unique(np.concatenate((v, [v.min() - 1, v.max() + 1])))
    middle, width = cuts[:-1] + np.diff(cuts) / 4, np.diff(cuts)
    cost = np.array([(v[y > 0] < m).mean() + 4 * (v[y == 0] >= m).mean() for m in middle])
    best = cost <= cost.min() + 1e-12
    cut = float(middle[best][np.argmax(width[best])])
    return w[:-1] / spread, float(w[-1] - (w[:-1] * mean / spread).sum() - cut + np.log(at / (1 - at)))


def fit(docs: DataFrame, labels: DataFrame, train_docs: dict[int, int] = TRAIN_DOCS, train_letters: int = TRAIN_LETTERS) -> ToxicityModel:
    """Train on documents joined with ``labels`` (doc_id, toxic 0 or 1): ``train_docs`` of each class at most, the smallest by hash, of any length.

    A document labelled more than once counts as toxic if one label says so; labels without a document count for
    nothing. Each class has its share of ``train_letters`` letters; a text that its class has no room for is left out.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text")]
    sized = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n")).join(known, "doc_id")
    chosen = []
    for k, n in train_docs.items():
        left = train_letters // len(train_docs)
        for r in sized.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(n).collect():
            if r["n"] <= left:
                chosen.append((r["doc_id"], r["h"], r["toxic"]))
                left -= r["n"]
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long, h long, toxic int").distinct())
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(wanted, ["doc_id", "h"]).orderBy(*order).limit(sum(train_docs.values()))
    return train([(r["text"], int(r["toxic"])) for r in rows.collect()])


def _scored(table: np.ndarray, bias: float, slopes: np.ndarray, offset: float):
    def run(batches):
        model = ToxicityModel(table, bias, slopes, offset)
        for batch in batches:
            scores = [model.probability(model.shown(t.as_py() or "")) for t in batch.column("text")]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(scores, pa.float64())], [*names, "score"])

    return run


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """All columns of ``docs`` but text, and score (0 to 1) of every row's whole text; null and empty texts score as texts without words."""
    keep = [f for f in docs.schema.fields if f.name not in ("text", "score")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", score double"
    return docs.select(*[F.col(f"`{f.name}`") for f in keep], "text").mapInArrow(_scored(model.table, model.bias, model.slopes, model.offset), schema)
