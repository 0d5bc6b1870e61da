"""The corpus pipeline: every stage keeps what the one before kept, its decisions hold, and odd rows pass through."""

import math
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import decontam, simhash, toxicity

from .test_text_operators import DOCS, base_spans, clashing, corpus, jaccard


def classes_by_brute_force(rows):
    """Smallest doc_id of each row's class: shingle sets of 0.8 or more, or fingerprints within two bits."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((r.text or "").encode().lower().split() for r in rows)]
    fps = [simhash.text_fingerprint((r.text or "").encode(), 5) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8 or bin(fps[i] ^ fps[j]).count("1") <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), float("inf")), float("inf") if r.doc_id is None else r.doc_id)
    return sorted(least.values())


def contaminated_by_brute_force(text, items):
    cut = re.compile(r"[\x20\x09-\x0d!-/:-@\[-`{-~]+")
    words = lambda t: [x for x in cut.split((t or "").lower()) if x]
    for item in items:
        n = min(5, len(words(item)))
        own, there = ({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (words(item), words(text)))
        if n and len(own & there) >= math.ceil(0.8 * len(own)):
            return True
    return False


@pytest.fixture
def folder(spark, tmp_path):
    rows = corpus(11, 80) + [(3000 + i, f"unrelated clean words number {i} about nothing idiot{' moron' if i % 2 else ''}", "en", "s9", 1) for i in range(20)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], 1, int("moron" in (r[1] or ""))) for r in rows if r[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, rows[0][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_one_after_the_other(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        path = f"{folder}/stage{i}"
        out.write.parquet(path)
        kept = spark.read.parquet(path)
        if i < 4:
            assert kept.columns == columns and kept.count() <= docs.count(), name
        if i == 0:
            model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
            assert toxicity.scored(kept, model, F.col("doc_id")).where("toxic").count() == 0
        if i == 1:
            made = simhash.classes(kept, 5, 0.8)
            assert made.select("component_id").distinct().count() == kept.count()
            assert sorted(float("inf") if r.doc_id is None else r.doc_id for r in kept.collect()) == classes_by_brute_force(docs.collect())
        if i == 2:
            bench = spark.read.parquet(f"{folder}/benchmark.parquet")
            assert decontam.contaminations(kept, bench).count() == 0
            clean = [r for r in docs.collect() if not contaminated_by_brute_force(r.text, [b.text for b in bench.collect()])]
            assert sorted(map(str, clean)) == sorted(map(str, kept.collect()))
        if i == 3:
            assert kept.count() == docs.count()
            before = {r.doc_id: r.text for r in docs.collect()}
            assert all(r.text == before[r.doc_id] if not base_spans(before[r.doc_id] or "") else not base_spans(r.text) for r in kept.collect())
        docs = kept
    assert {"copy", "shuffle_key"} <= set(docs.columns)
    assert docs.count() == corpus_pipeline.run(spark, folder).count()


def test_stages_keep_columns_named_like_their_own(spark, folder, tmp_path):
    docs = clashing(spark.read.parquet(f"{folder}/documents.parquet"))
    docs.write.parquet(f"{tmp_path}/clash")
    docs = spark.read.parquet(f"{tmp_path}/clash")
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, folder).columns == docs.columns, name
    out = corpus_pipeline.STAGES[4][1](spark, docs, folder)
    assert out.columns == [c for c in docs.columns if c != "copy"] + ["copy", "shuffle_key"] and out.where("row = 'mine'").count() == out.count()


def test_run_over_no_rows(spark, folder, tmp_path):
    empty = f"{tmp_path}/empty"
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
