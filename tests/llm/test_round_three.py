"""Periodic runs, fingerprints and the prefix trie against brute force; SQL of all operators that have it."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusflow.llm import periodic_runs, prefix_trie, queries, simhash
from corpusflow.plans.scratch import Scratch
from tests.test_oracles import SF, TABLES, rows

WORD = r"[^\x20\x09-\x0D]+"


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(con.execute(queries.oracle_sql()[name]).df())


# Periodic runs


def runs_by_hand(w: list) -> list[tuple[int, int, int]]:
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= 3 * q:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= 6)


def repetitive(rng: random.Random) -> list[int]:
    """Words with nested repetitions: periods within periods, broken at places."""
    w = [rng.randrange(rng.choice([2, 3, 60])) for _ in range(rng.choice([0, 1, 6, 30, 200, 1500]))]
    for _ in range(rng.randrange(4)):
        if len(w) > 8:
            s, p, n = rng.randrange(len(w)), rng.randrange(1, len(w) // 4), rng.randrange(len(w))
            unit = w[s : s + p]
            if rng.random() < 0.5 and len(unit) > 12:
                unit = (unit[:3] * len(unit))[: len(unit) - 2] + unit[-2:]
            w[s : s + n] = (unit * (n // len(unit) + 1))[:n]
            if rng.random() < 0.3:
                w[rng.randrange(len(w))] = -1
    return w


def thue_morse(n: int) -> list[int]:
    return [bin(i).count("1") % 2 for i in range(n)]


def row_by_hand(doc_id, text, planted: bool) -> tuple:
    w = re.findall(WORD, text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if planted and h % 10 == 0 and w:
        a = h // 10 % len(w)
        p = 1 + (len(w) - a) // (3 + h // 10 % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    runs = runs_by_hand(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(" ".join(x for i, x in enumerate(w) if i not in gone).encode()))


def test_periodic_runs(spark):
    rng = random.Random(5)
    data = [(i, " ".join(map(str, repetitive(rng)))) for i in range(120)]
    data += [(200, None), (201, ""), (202, " \t\n"), (None, "a b " * 9), (None, "a b " * 9), (203, "x y z " * 5), (204, " ".join(map(str, thue_morse(4096)))), (205, "ab" * 50_000), (206, " ".join(map(str, thue_morse(300))) + " 2 " + "7 8 9 " * 40)]
    data += [(i, "eins zwei drei vier fünf " * rng.randrange(1, 40)) for i in range(300, 330)]
    df = spark.createDataFrame([(i, t, 3, "x") for i, t in data], "doc_id long, text string, n_runs int, c0 string")
    for planted in (False, True):
        got = [tuple(r) for r in periodic_runs.periodic_runs(df.select("doc_id", "text"), planted).collect()]
        assert sorted(got, key=repr) == sorted([row_by_hand(i, t, planted) for i, t in data], key=repr)
    named = periodic_runs.periodic_runs(df, lists=True)
    assert named.columns == ["doc_id", "c0", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]
    for r in named.collect():
        assert r.c0 == "x" and sha(r.collapsed.encode()) == r.collapsed_sha256 and len(r.runs) == r.n_runs
    assert periodic_runs.periodic_runs(df.where("false").select("doc_id", "text")).collect() == []


def test_periodic_runs_of_a_very_long_text(spark):
    unit = [f"w{i}" for i in range(70_001)]
    text = "start " + " ".join(unit * 5) + " end"
    (r,) = periodic_runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (r.n_runs, r.start, r.length, r.period) == (1, 1, 350_005, 70_001)
    assert r.collapsed_sha256 == sha(" ".join(["start", *unit, "end"]).encode())


# Fingerprints


def print_by_hand(text: str) -> str:
    w = re.findall(WORD, text)
    hashes = set()
    for a, b in zip(w, [*w[1:], None]):
        h = xxhash.xxh64_intdigest(a.encode(), 42)
        h = h if b is None else xxhash.xxh64_intdigest(b.encode(), h)
        hashes.add(h >> 3 << 3 | (2 if len(a) + len(b or "") >= 10 else 1))
    votes = [0] * 128
    for h in hashes:
        seed = xxhash.xxh64_intdigest((h >> 3 << 3).to_bytes(8, "little"), 42)
        for half in (0, 1):
            x = xxhash.xxh64_intdigest((half + 1).to_bytes(4, "little"), seed)
            for k in range(64):
                votes[64 * half + k] += (h & 3) * (1 if x >> k & 1 else -1)
    return f"{sum(1 << k for k, v in enumerate(votes) if v > 0):032x}"


def bits_apart(a: str, b: str) -> int:
    return bin(int(a, 16) ^ int(b, 16)).count("1")


def signed(u: int) -> int:
    return u - (1 << 64) if u >> 63 else u


def test_fingerprints(spark):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(260)]
    data = [(3, " ".join(map(str, range(700)))), (1, None), (2, ""), (5, "one"), (None, "without an id"), (None, None), (9, "éé  x y 𝒳𝒳 word " * 40), (11, " ".join(base)), (11, " ".join(base)), (12, " ".join(base))]
    data += [(20 + k, " ".join(base[:k] + ["other"] + base[k + 1 :])) for k in range(40)]
    df = spark.createDataFrame([(i, t, "y", 1) for i, t in data], "doc_id long, text string, class_id string, no int")
    order = sorted([(i, t or "") for i, t in data], key=lambda r: (r[0] is not None, r[0] if r[0] is not None else signed(xxhash.xxh64_intdigest(r[1].encode(), 42)), r[1]))
    prints = [print_by_hand(t) for _, t in order]
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        e, p = print_by_hand(edited), prints[k]
        same = [order[j][0] for j in range(len(order)) if prints[j] == p]
        near = sum(bits_apart(p, o) <= simhash.RADIUS for o in prints) - 1
        least = min((x for x in same if x is not None), default=None)
        want.append((i, len(t), sha(edited.encode()), p, e, 1 - bits_apart(p, e) / 128, 1 - bits_apart(p, prints[(k + 1) % len(order)]) / 128, least, near))
    got = [tuple(r) for r in simhash.compared(spark, df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert simhash.compared(spark, df.where("false")).collect() == []
    (alone,) = simhash.compared(spark, df.where("doc_id = 5")).collect()
    assert alone.near_next == 1.0 and alone.n_near == 0


def test_block_tables_find_every_radius(spark):
    rng = random.Random(8)
    points = [rng.getrandbits(128) for _ in range(40)]
    points += [p ^ sum(1 << b for b in rng.sample(range(128), rng.randrange(1, 9))) for p in points for _ in range(4)]
    data = [(i, signed(p >> 64), signed(p & (1 << 64) - 1)) for i, p in enumerate(points + points[:7])]
    points += points[:7]
    for radius in (0, 3, 6):
        got = simhash.within_radius(spark, spark.createDataFrame(data, "doc_id long, hi long, lo long"), Scratch(spark, "test"), radius).collect()
        counts = {(r.hi, r.lo): r.n_near for r in got}
        for (_, hi, lo), p in zip(data, points):
            assert counts[hi, lo] == sum(0 < bin(p ^ o).count("1") <= radius for o in points)
    with pytest.raises(ValueError):
        simhash.within_radius(spark, spark.createDataFrame(data, "doc_id long, hi long, lo long"), Scratch(spark, "test"), 7)


def test_long_text_has_a_fingerprint(spark):
    text = " ".join(f"w{i}" for i in range(60_000))
    found = simhash.fingerprints(spark.createDataFrame([(1, text), (2, None)], "id long, text string"), "id").select("id", simhash.as_text(F.struct("hi", "lo")).alias("p"))
    assert {r.id: r.p for r in found.collect()} == {1: print_by_hand(text), 2: "0" * 32}


def test_joins_of_fingerprints_broadcast_no_whole_table(spark):
    """Spark sizes 28 entries of a fingerprint as one row; with its own threshold it still neither broadcasts them nor a table with a row per document."""
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").removesuffix("b")) == 10 << 20
    plans, save = [], Scratch.save
    with pytest.MonkeyPatch.context() as patched:
        patched.setattr(Scratch, "save", lambda work, df, name: (plans.append((name, df)), save(work, df, name))[1])
        plans.append(("out", simhash.compared(spark, spark.read.parquet(f"{SF}/documents.parquet"))))
    plans = {name: df._jdf.queryExecution().executedPlan().toString() for name, df in plans}
    assert all("SortMergeJoin" in plans[name] and "BroadcastExchange" not in plans[name] for name in ("near", "out"))


# Prefix trie


def trie_by_hand(turns: list[tuple]) -> list[tuple]:
    talks: dict[int, list] = {}
    for c, turn, role, text in sorted((t for t in turns if t[0] is not None), key=lambda t: (t[0], t[1] is not None, t[1] or 0)):
        talks.setdefault(c, []).append((role or "", text or ""))
    members: dict[tuple, list[int]] = {}
    full = {}
    for c in talks:
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(talks.get(c - int(c % 20 if c >= 0 else -(-c % 20)), [])[:h] + talks[c][h:])
        for d in range(len(full[c]) + 1):
            members.setdefault(full[c][:d], []).append(c)
    children: dict[tuple, list] = {}
    for v in members:
        if v:
            children.setdefault(v[:-1], []).append(v)
    out = []
    for v, cs in members.items():
        below = [u for u in members if u[: len(v)] == v]
        saved = sum((len(members[u]) - 1) * len(re.findall(WORD, u[-1][1])) for u in below if u)
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(full[c]) == len(v)))
        out.append((min(cs), len(v), min(members[v[:-1]]) if v else None, len(cs), len(children.get(v, [])), sum(u not in children for u in below), saved, sha(ends.encode())))
    return sorted(out, key=repr)


@pytest.mark.parametrize("few", [5, prefix_trie.FEW])
def test_prefix_trie(spark, few):
    rng = random.Random(4)
    turns = []
    for c in [*range(0, 45), 60, 61, 400, -3, -40]:
        for t in range(rng.choice([1, 2, 3, 4, 7])):
            turns.append((c, None if t == 0 and c % 7 == 0 else t, rng.choice(["user", "user", None]), rng.choice(["hello you", "hello you", "a  b c", "", None])))
    for c in range(70, 100):  # copies, and a common first turn
        turns += [(c, t, "user", f"same {t}") for t in range(4)]
    turns.append((500, 0, "user", "deep"))
    turns += [(500, t, "user", "again") for t in range(1, 90)]
    turns += [(None, 0, "user", "nobody's"), (None, None, None, None)]
    df = spark.createDataFrame([(*t, "x", 1) for t in turns], "conv_id long, turn long, role string, text string, depth string, no int")
    assert sorted([tuple(r) for r in prefix_trie.prefix_trie(spark, df, few).collect()], key=repr) == trie_by_hand(turns)
    if few == prefix_trie.FEW:
        assert prefix_trie.prefix_trie(spark, df.where("false"), few).collect() == []
        repeated = prefix_trie.prefix_trie(spark, df.where("conv_id = 61").union(df.where("conv_id = 61")), few).collect()
        assert sum(r.n_leaves for r in repeated if r.depth == 0) == 1
        very_long = spark.createDataFrame([(1, 0, "user", "w " * 300_000), (2, 0, "user", "w " * 300_000)], "conv_id long, turn long, role string, text string")
        assert prefix_trie.prefix_trie(spark, very_long).count() >= 1


def test_list_ranks(spark):
    order = list(range(500))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame(list(zip(order, [*order[1:], None])), "x long, nxt long")
    got = {r.x: r.at for r in prefix_trie.list_ranks(spark, links, Scratch(spark, "test"), few=20).collect()}
    assert got == {x: i for i, x in enumerate(order)}
