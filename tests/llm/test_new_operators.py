"""Whitening, conversation trie and min-max near-dedup against plain versions, with awkward rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from movecast.llm import conversation_trie, embedding_whitening, minmax_dedup, queries

# --- embedding whitening


VECTORS = "vec_id bigint, embedding array<float>, n int, component string"


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], VECTORS).repartition(parts)


def check_whitening(rows, got):
    """``rows``: (vec_id, entries) that take part."""
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    centred = ((n * x - sums) / n).astype(float)
    v = centred.T @ centred / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    m = min(8, int((values > 1e-12 * np.trace(v)).sum()))
    by = collections.defaultdict(dict)
    for r in got:
        by[r.vec_id][r.component] = r
    assert len(got) == n * m and {len(c) for c in by.values()} <= {m}
    want = centred @ axes[:, :m] / np.sqrt(values[:m])
    have = np.array([[by[i][k + 1].whitened for k in range(m)] for i, _ in rows])
    for k in range(m):
        gaps = np.abs(np.delete(values, k) - values[k])
        if gaps.min() > 1e-6 * values[0]:
            assert min(np.abs(have[:, k] - s * want[:, k]).max() for s in (1, -1)) < 1e-7
    assert np.abs(have.T @ have / n - np.eye(m)).max() < 1e-8
    for (i, _), row in zip(rows, x, strict=True):
        for r in by[i].values():
            assert (r.n, r.deviation) == (n, int(((n * row - sums) ** 2).sum()))
            assert abs(r.explained - values[r.component - 1] / np.trace(v)) <= 1e-9 and r.identity_error < 1e-8


def test_whitening_of_the_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    check_whitening(rows, queries.op11_embedding_whitening(spark, sf_dir).collect())


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=12).round(2).tolist()) for i in range(60)]
    good += [(100 + i, good[3][1]) for i in range(40)]  # copies
    bad = [(200, None), (201, [None] * 12), (202, [float("nan")] + [0.0] * 11), (203, [float("inf")] * 12), (204, [1.0] * 5), (205, [])]
    for parts in (1, 7, 70):
        check_whitening(good, embedding_whitening.whiten(vectors(spark, good + bad, parts)).collect())


def test_whitening_of_dependent_entries_and_few_vectors(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(50):
        a, b = rng.normal(size=2).tolist()
        rows.append((i, [a, a, b, 7.0, b]))
    got = embedding_whitening.whiten(vectors(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2} and len(got) == 100
    check_whitening(rows, got)
    assert embedding_whitening.whiten(vectors(spark, rows[:1])).collect() == []
    assert embedding_whitening.whiten(vectors(spark, [(1, [1.0, 2.0])] * 5)).collect() == []
    assert embedding_whitening.whiten(vectors(spark, [(1, None)])).collect() == []
    none = embedding_whitening.whiten(vectors(spark, []))
    assert none.collect() == [] and none.columns[0] == "vec_id"
    repeated = embedding_whitening.whiten(vectors(spark, [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (3, [0.0, 0.5]), (3, [2.0, 9.0])])).collect()
    assert len(repeated) == 8 and sum(r.vec_id is None for r in repeated) == 4


@pytest.mark.parametrize("kind", ["plain", "copies", "tiny", "integers"])
def test_rank_one_updates(kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 20)) * np.logspace(0, 3 if kind != "tiny" else 9, 20)
    if kind == "copies":
        x = np.repeat(x[:10], 15, axis=0)
    if kind == "integers":
        x = np.round(rng.normal(size=(150, 20)))
        x[:, 4] = x[:, 5]
    centred = x - x.mean(axis=0)
    want = centred.T @ centred
    size = np.abs(want).max()
    whole, a, b = (embedding_whitening.Spectrum(20) for _ in range(3))
    for k, row in enumerate(x):
        whole.add(row)
        (a if k < 40 else b).add(row)
    a.merge(b)
    for s in (whole, a):
        assert s.n == 150 and np.abs(s.vectors.T @ s.vectors - np.eye(20)).max() < 1e-12
        assert np.abs((s.vectors * s.values) @ s.vectors.T - want).max() < 1e-12 * size
        assert (np.diff(s.values) >= 0).all()


def test_secular_roots_close_to_poles():
    d = np.array([0.0, 1e-14, 1.0, 1.0 + 1e-12, 5.0])
    z = np.array([0.3, 0.4, 1e-7, 0.5, 0.6])
    roots, gaps = embedding_whitening.secular_roots(d, z * z, 2.0)
    assert (np.diff(roots) >= 0).all() and (roots >= d).all() and roots[-1] <= 5 + 2 * (z * z).sum()
    assert (gaps[np.tri(5, dtype=bool)] > 0).all() and (gaps[~np.tri(5, dtype=bool)] < 0).all()
    turn = embedding_whitening.rotation(d, z, gaps)
    assert np.abs(turn.T @ turn - np.eye(5)).max() < 1e-12
    assert np.abs((turn * roots) @ turn.T - np.diag(d) - 2 * np.outer(z, z)).max() < 1e-12


# --- conversation trie


TURNS = "conv_id bigint, turn bigint, role string, text string, depth int, n bigint, part string"


def conversations(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, "clash") for r in rows], TURNS).repartition(parts)


def plain_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:])
    members, children = collections.defaultdict(list), collections.defaultdict(set)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
            if d:
                children[p[: d - 1]].add(p[:d])
    saved, leaves = {}, {}
    for p in sorted(members, key=len, reverse=True):
        value = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        saved[p] = value + sum(saved[q] for q in children[p])
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
    out = set()
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.add((min(m), len(p), parent, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def check_trie(rows, df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain_trie(rows)


def some_rows(seed=1, convs=260):
    """Long and short conversations from few texts, so that prefixes are shared at all depths; ids with gaps, turns out of order."""
    rng = random.Random(seed)
    stem = [("user" if k % 2 else "assistant", f"stem {k}" * (k % 3)) for k in range(300)]
    rows = []
    for c in range(0, 2 * convs, 2):
        cut = rng.choice((0, 1, 2, 5, 6, 63, 64, 65, 128, 130, 200)) if c % 5 else 130
        turns = stem[:cut] + [(rng.choice(("user", "assistant")), rng.choice("abc")) for _ in range(rng.randrange(4))]
        rows += [(c, 10 * k, *t) for k, t in enumerate(turns)]
    rows = [r for r in rows if r[0] != 300]  # a family without its first conversation
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts", [1, 5])
def test_trie(spark, parts):
    rows = some_rows()
    check_trie(rows, conversation_trie.prefix_trie(conversations(spark, rows, parts)))


def test_trie_over_small_blocks(spark):
    """Blocks of 7 stretches: nearly all nodes are open and merged across blocks."""
    rows = some_rows(2)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "7")
    try:
        check_trie(rows, conversation_trie.prefix_trie(conversations(spark, rows)))
    finally:
        spark.conf.unset(key)


def test_trie_of_odd_rows(spark):
    rows = [(7, None, None, None), (7, None, None, None), (7, 1, "", None), (7, 1, "", None), (7, 3, "user", "x" * 100_000), (100, 0, "a", "é𝒳"), (101, 0, "a", "é𝒳"), (101, 1, "b", "two")]
    rows += [(None, 1, "user", "lost"), (-5, 1, "a", "below"), (-100, 1, "a", "below"), (9_000_000_000_001, 1, "z", "far")]
    check_trie(rows, conversation_trie.prefix_trie(conversations(spark, rows)))
    empty = conversation_trie.prefix_trie(conversations(spark, []))
    assert empty.collect() == [] and len(empty.columns) == 8
    assert conversation_trie.prefix_trie(conversations(spark, [(None, 1, "a", "b")])).collect() == []


def test_trie_of_a_hot_conversation_and_many_copies(spark):
    """A third of all rows in one conversation, a third in copies of one."""
    rows = [(12, k, "user", f"t{k % 17}") for k in range(3000)]
    rows += [(1000 + c, k, "user", f"copy {k}") for c in range(300) for k in range(8)]
    check_trie(rows, conversation_trie.prefix_trie(conversations(spark, rows)))


def test_digests_of_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "CHUNK", 63)
    ends = spark.range(1000).select((F.col("id") % 3).alias("p1"), F.lit(5).cast("bigint").alias("p2"), F.col("id").alias("conv_id"))
    for r in conversation_trie.end_digests(ends).collect():
        assert r.ends_sha256 == hashlib.sha256(",".join(str(k) for k in range(r.p1, 1000, 3)).encode()).hexdigest()


# --- min-max near-dedup


DOCS = "doc_id bigint, text string, lang string, rank string, sid int, band int"


def documents(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en", "clash", 1, 2) for i, t in rows], DOCS).repartition(parts)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def plain_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 85 * (len(sets[a]) + len(sets[b]) - shared):
                root[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(rows[k][0])
    low = {r: min((i for i in g if i is not None), default=None) for r, g in groups.items()}
    return collections.Counter((rows[k][0], len(sets[k]), low[find(k)], rows[k][0] == low[find(k)]) for k in range(len(rows)))


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def near_rows(seed):
    """Groups of copies around the limit, among them a large one whose members are often not linked with its pivot."""
    rng = random.Random(seed)
    rows = []
    for _ in range(25):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.randrange(7, 120))]
        rows += [" ".join(edited(rng, base, rng.randrange(len(base) // 18 + 2))) for _ in range(rng.randrange(1, 9))]
    base = [f"hot{k}" for k in range(90)]
    rows += [" ".join(edited(rng, base, rng.randrange(5))) for _ in range(150)]
    rows += ["Same TEXT here twice", "same text HERE twice", "one", "two words", "ONE"]
    rng.shuffle(rows)
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("block", [256, 5])
def test_minmax_components(spark, monkeypatch, block):
    monkeypatch.setattr(minmax_dedup, "BLOCK", block)
    rows = near_rows(block)
    got = minmax_dedup.near_components(documents(spark, rows))
    assert collections.Counter(map(tuple, got.collect())) == plain_components(rows)


def test_minmax_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(None, None), (None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (7, "other words stand here"), (3, ""), (3, " \t\n"), (None, None), (9, long), (8, long + " end"), (None, "no one has this"), (None, "no one has this")]
    got = collections.Counter(map(tuple, minmax_dedup.near_components(documents(spark, rows)).collect()))
    want = collections.Counter(
        [(None, 0, None, True)] * 2
        + [(None, 2, 7, False), (7, 2, 7, True), (7, 2, 7, True), (7, 2, 7, True), (3, 0, 3, True), (3, 0, 3, True)]
        + [(9, 29_998, 8, False), (8, 29_999, 8, True), (None, 2, None, True), (None, 2, None, True)]
    )
    assert got == want
    assert minmax_dedup.near_components(documents(spark, [])).collect() == []
    assert [tuple(r) for r in minmax_dedup.near_components(documents(spark, [(1, None)])).collect()] == [(1, 0, 1, True)]


def test_minmax_estimates():
    """Both ends of a permutation are unbiased, and together vary less than as many minima of other permutations would on average."""
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(300):
        n = int(rng.integers(20, 200))
        tokens = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        shared = int(n * rng.uniform(0.3, 1))
        a, b = tokens[:n], np.concatenate([tokens[:shared], tokens[n : 2 * n - shared]])
        s = minmax_dedup.signatures(np.concatenate([a, b]), np.array([0, n]))
        like = shared / (2 * n - shared)
        errors.append(((s[0] == s[1]).mean() - like) / math.sqrt(like * (1 - like) / s.shape[1] + 1e-12))
    assert abs(np.mean(errors)) < 0.2 and np.std(errors) < 1.1
    assert minmax_dedup.miss() < 1e-6


def test_pairs_at_the_limit_share_a_band():
    rng = np.random.default_rng(6)
    for n in (13, 40, 200):
        shared = math.ceil(0.85 * 2 * n / 1.85)
        for _ in range(400):
            tokens = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            both = np.concatenate([tokens[:n], tokens[:shared], tokens[n : 2 * n - shared]])
            same = np.equal(*minmax_dedup.signatures(both, np.array([0, n])))
            assert same.reshape(minmax_dedup.BANDS, minmax_dedup.ROWS).all(axis=1).any() and same.mean() >= minmax_dedup.FILTER
