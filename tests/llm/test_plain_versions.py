"""Operators that SQL cannot express against plain versions of their parts; the pipeline on awkward tables."""

import random
import shutil
import struct
import tracemalloc

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from movecast.llm import best_fit_packing, chosen_path_join, common, lz_fingerprints, ordinal_quality, queries

# --- quality classifier


def place(word, *more):
    h = xxhash.xxh64_intdigest(word.encode(), seed=42)
    for k in more:
        h = xxhash.xxh64_intdigest(struct.pack("<i", k), seed=h)
    return h % (1 << ordinal_quality.BITS)


def test_word_features(spark):
    texts = ["Alpha beta, alpha!", "", "éclair Éclair x1", "#$% two words $$$", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in ordinal_quality.features(docs, F.col("text")).collect():
        words = "".join(c if c.isalnum() else " " for c in (r.text or "").lower()).split()
        want = {p for w in words for p in (place(w), place(w[:4], 4), place(w[:5], 5))}
        assert want <= set(r.features) and len(set(r.features)) == len(r.features) <= len(want) + 3


def log_likelihood(w, gaps, rows, grades):
    """Mean log-likelihood of the grades less the penalty, one document at a time."""
    cuts = np.cumsum([gaps[0], *np.exp(gaps[1:])])
    total = 0.0
    for places, grade in zip(rows, grades, strict=True):
        z = sum(w[p] for p in places)
        at_least = [1.0, *(1 / (1 + np.exp(-(z - c))) for c in cuts), 0.0]
        total += np.log(at_least[grade] - at_least[grade + 1])
    return total / len(grades) - ordinal_quality.L2 / 2 * float(w @ w)


def test_fit_climbs_the_likelihood(monkeypatch):
    """The fitted weights are those of the same steps along a numeric gradient of the plain likelihood."""
    monkeypatch.setattr(ordinal_quality, "ROUNDS", 25)
    rng = random.Random(1)
    rows = [sorted(rng.sample(range(6), rng.randrange(1, 5))) for _ in range(40)]
    grades = [min(2, max(0, sum(p > 2 for p in r) + rng.choice((-1, 0, 0, 1)))) for r in rows]
    offsets = np.cumsum([0, *map(len, rows)])
    fitted = ordinal_quality.Ordinal.fit(np.array([p for r in rows for p in r]), offsets, np.array(grades))
    share = [sum(g >= k for g in grades) / 40 for k in (1, 2)]
    first = [-np.log(s / (1 - s)) for s in share]
    x = np.array([0.0] * 6 + [first[0], np.log(first[1] - first[0])])
    value = lambda y: log_likelihood(y[:6], y[6:], rows, grades)
    before, m, v = value(x), np.zeros(8), np.zeros(8)
    for t in range(1, 26):
        g = np.array([(value(x + d) - value(x - d)) / 2e-6 for d in np.eye(8) * 1e-6])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x + ordinal_quality.RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    # Steps are scaled to their size, so tiny slopes turn the rounding of numeric ones into something that can be seen.
    assert np.abs(fitted.weights[:6] - x[:6]).max() < 1e-2
    assert np.abs(fitted.thresholds - np.cumsum([x[6], np.exp(x[7])])).max() < 1e-2
    assert value(x) > before + 0.05
    tails = fitted.tails(np.array([p for r in rows for p in r]), offsets)
    for r, found in zip(rows, tails, strict=True):
        z = float(fitted.weights[r].astype(float).sum())
        assert np.abs(found - 1 / (1 + np.exp(-(z - fitted.thresholds)))).max() < 1e-6 and found[0] >= found[1]


# --- Lempel-Ziv fingerprints


def test_likeness_estimates_the_likeness_of_phrase_sets(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(120).collect() if r.text]
    rng, errors = random.Random(2), []
    for text in texts:
        other = rng.choice(texts)
        cut = rng.randrange(len(text) + 1)
        for changed in (other, text[:cut] + other[: len(text) - cut], text[: len(text) * 2 // 3]):
            a, b = ({*lz_fingerprints.parse(t)[0]} for t in (text, changed))
            true = len(a & b) / len(a | b) if a | b else 1.0
            errors.append(lz_fingerprints.likeness(lz_fingerprints.fingerprint(text), lz_fingerprints.fingerprint(changed)) - true)
    errors = np.array(errors)
    assert len(errors) > 250 and np.sqrt((errors**2).mean()) < 0.05 and abs(errors.mean()) < 0.01 and np.abs(errors).max() < 0.2


# --- best-fit packing


@pytest.mark.parametrize("most", [1, 3, 40])
def test_bins_against_a_plain_best_fit(most):
    """Every piece goes where the least room is left over; without any room the fullest bin closes first."""
    rng = random.Random(most)
    bins, rooms, made = best_fit_packing.OpenBins(100, most), {}, 0
    for _ in range(3000):
        need = rng.choice((100, rng.randrange(1, 101), rng.randrange(1, 15)))
        number, offset = bins.place(need)
        fits = [r for r in rooms.values() if r >= need]
        if fits:
            assert rooms[number] == min(fits) == 100 - offset
        else:
            if len(rooms) == most:
                least = min(rooms.values())
                closed = [k for k, r in rooms.items() if r == least]
                gone = [k for k in closed if k not in {n for room in bins.by_room for n in room}]
                assert len(gone) == 1
                del rooms[gone[0]]
            assert (number, offset) == (made, 0)
            made += 1
            rooms[number] = 100
        rooms[number] -= need
        if not rooms[number]:
            del rooms[number]
        assert len(rooms) <= most


# --- the pipeline on awkward tables


@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_pipeline_on_awkward_tables(spark, sf_dir, tmp_path, kind):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    long = " ".join(f"w{k % 700}" for k in range(20_000))
    texts = [None, None, "", " \n\t", "one", long, "same words in two rows", "same words in two rows", None]
    rows = [] if kind == "empty" else [(None if k in (1, 4, 7) else k % 6, t, None, None, None) for k, t in enumerate(texts)]
    by_name = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows]
    spark.createDataFrame([tuple(r[f.name] for f in schema) for r in by_name], schema).write.parquet(f"{tmp_path}/documents.parquet")
    for table in ("labels", "benchmark"):
        shutil.copy(f"{sf_dir}/{table}.parquet", f"{tmp_path}/{table}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = out.collect()
    if kind == "empty":
        assert got == [] and "sequence_id" in out.columns
    else:
        places = {}
        for r in got:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert got and all(sum(n for _, n in p) <= 2048 for p in places.values())
        assert {r.doc_id for r in got} <= {None, *range(6)}


def test_workers_hold_little_of_a_large_batch():
    """Numpy steps over the words of a batch take no more memory the larger it is, nor does the tokenizer's memory of chunks."""
    words = pa.array([list(range(k, k + 400)) for k in range(2_000)], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([words], names=["words"])
    common.POWERS.get(1 << 20)
    tracemalloc.start()
    for part in common.pieces(iter([batch]), "words"):
        hashes, offsets = chosen_path_join.shingle_sets(*common.flat(part.column("words")))
        assert len(chosen_path_join.set_prints(hashes, offsets)[0]) == part.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24e6  # 800,000 words at once took 51 MB
    ids = best_fit_packing.ChunkIds(queries.vocabulary())
    ids.of(" ".join(f"{k}" for k in range(300_000)))
    assert len(ids.known) <= 1 << 18


def test_new_chunks_are_encoded_together_and_frequent_ones_stay(monkeypatch):
    """One call for the new chunks of a text, and chunks that return are not forgotten with the others."""
    monkeypatch.setattr(best_fit_packing, "CACHE", 64)
    ids, seen = best_fit_packing.ChunkIds(queries.vocabulary()), []

    class Counted:
        def __init__(self, encoder):
            self.encoder = encoder

        def encode_ordinary(self, text):
            seen.append(text)
            return self.encoder.encode_ordinary(text)

    ids.encoder = Counted(ids.encoder)
    texts = [" ".join(["Again", *(f"x{k}Y'll-{n}" for n in range(20))]) for k in range(50)]
    got = [ids.of(text) for text in texts]
    assert len(seen) <= 50  # one for each chunk before: 1,001 and more
    assert sum("again" in text.split() for text in seen) == 1
    assert len(ids.known) + len(ids.older) <= 64 + 21
    for text, found in zip(texts, got, strict=True):
        assert list(np.frombuffer(found, "<u4")) == ids.tokenizer.encode(text, add_special_tokens=False).ids


def test_every_plain_letter_is_split_as_the_tokenizer_does():
    ids = best_fit_packing.ChunkIds(queries.vocabulary())
    plain = [*map(chr, range(0x21, 0x7F)), *map(chr, range(0xA1, 0x100))]
    texts = [c + d for c in plain for d in ("", "a", "1", "'LL", "\u00b2", "\u00aa-")]
    texts += ["<|endoftext|> <|", "\u201cna\u00efve\u201d ab\u00c9\n\n\tc\u00a0d", "\n", ""]
    texts.append(" ".join(texts))
    for text in texts:
        assert list(np.frombuffer(ids.of(text), "<u4")) == ids.tokenizer.encode(text, add_special_tokens=False).ids, text
