"""The corpus pipeline: what each stage leaves, and the rows of a whole run against plain versions of the later stages."""

import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from movecast.llm import queries


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The documents before each stage and after the last but one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        out.append(docs)
    return out


def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_stages_keep_the_columns_of_documents(stages):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for docs in stages[1:]:
        assert docs.schema.names == stages[0].schema.names
        assert [f.dataType for f in docs.schema] == [f.dataType for f in stages[0].schema]


def test_quality_rejects_toxic_documents_mostly(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = labels.join(stages[1].select("doc_id"), "doc_id", "left_semi")
    count = lambda df, where: df.where(where).count()
    assert count(kept, "toxic = 1") <= 0.2 * count(labels, "toxic = 1") + 1
    assert count(kept, "quality = 1 and toxic = 0") >= 0.9 * count(labels, "quality = 1 and toxic = 0")


def test_line_dedup_only_takes_lines_out(stages):
    before, after = texts(stages[1]), texts(stages[2])
    assert before.keys() == after.keys()
    for k, text in after.items():
        left = iter((before[k] or "").split("\n"))
        assert all(line in left for line in (text or "").split("\n") if line)


def test_one_document_of_each_group_stays(stages):
    sets = {k: shingles(t) for k, t in texts(stages[2]).items()}
    kept = texts(stages[3])
    alike = lambda a, b: a and len(a & b) >= 0.8 * len(a | b)
    ids = sorted(sets)
    root = {k: k for k in ids}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if alike(sets[a], sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    assert set(kept) == {k for k in ids if find(k) == k}


def test_documents_with_benchmark_items_go(spark, sf_dir, stages):
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before, after = texts(stages[3]), texts(stages[4])
    holds = {k for k, t in before.items() if any(i in (t or "") for i in items if i and len(i.split()) >= 5)}
    assert not holds & set(after)
    assert len(before) - len(after) <= len(holds) + 0.02 * len(before) + 1


def test_run_packs_what_is_left(spark, sf_dir, stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary())
    want = set()
    for k, t in texts(stages[4]).items():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for n, start in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[start : start + 2048], "<u4")
            want.add((k, n, start, len(part), zlib.crc32(part.tobytes())))
    rows = corpus_pipeline.run(spark, sf_dir)
    got = rows.select("doc_id", "piece", F.col("start"), "length", "ids_crc32").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
