"""Stages of the pipeline against plain Python on planted rows, and on odd rows."""

import random

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from lithic.llm import langid, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


ODD = [(None, "no id at all but five words", "en", None, 1), (None, None, None, None, None), (1, None, "en", "h", None), (2, "", "en", "h", 0), (3, " \n ", None, "h", 3), (4, "word " * 30_000, "en", "h", 9), (5, "same text of some words here", "en", "h", 9), (5, "same text of some words here", "en", "h", 9), (5, "other text with the same number in it", "en", "h", 9), (6, "SAME text of some words here", "en", "g", 9)]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_and_no_rows(spark, sf, name, stage):
    odd = frame(spark, ODD).withColumn("__score", F.lit(1)).withColumn("block", F.lit(2)).withColumn("kept", F.lit(False))
    got = stage(spark, odd, sf)
    assert stage(spark, odd.limit(0), sf).count() == 0
    if name == "packing":
        assert got.where("piece = 0").count() == len(ODD)
        return
    assert got.columns == corpus_pipeline.COLUMNS
    rows = [tuple(r) for r in got.collect()]
    if name == "lines":
        assert len(rows) == len(ODD)
    if name == "near_copies":
        assert sorted(map(str, rows)) == sorted(map(str, [*ODD[:7], ODD[8]]))
    if name == "language":
        assert not {r[0] for r in rows} & {1, 2, 3}


def test_language_stage_against_naive_centroids(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs)
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, sf).collect()}
    for r in docs.collect():
        counts = np.zeros(langid.DIMS)
        raw = (r.text or "").lower().encode()
        for k in range(len(raw) - 2):
            code = (raw[k] * 257 * 257 + raw[k + 1] * 257 + raw[k + 2]) & 0xFFFFFFFF
            counts[((code * 2654435761) & 0xFFFFFFFF) >> (32 - 12)] += 1
        x = np.sqrt(counts) * model.idf
        x /= max(np.linalg.norm(x), 1e-9)
        near = [max(float(x @ c) for c in model.centroids[k * 4 : k * 4 + 4]) for k in range(len(model.languages))]
        best = int(np.argmax(near))
        at = np.log2(max((counts > 0).sum(), 1))
        low = int(at)
        least = model.radius[best, low] * (1 - at + low) + model.radius[best, min(low + 1, langid.POINTS - 1)] * (at - low)
        if abs(near[best] - least) > 1e-4:
            assert (r.doc_id in kept) == (any(c.isalpha() for c in r.text or "") and near[best] >= least)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.op9(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and not rejected")
    assert got.where("lang_pred = lang").count() >= 0.95 * got.count() > 100


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    got = quality.op1(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 30 and np.mean([r.predicted == r.quality for r in got]) >= 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= quality.THRESHOLD) for r in got)


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.8):
        pos = rng.normal(2, 1, 4000)
        unl = np.concatenate([rng.normal(2, 1, int(4000 * share)), rng.normal(-2, 1, 4000 - int(4000 * share))])
        assert abs(quality.best_bin_prior(pos, unl) - share) < 0.06


def test_unbiased_risk_learns_from_positives_and_a_mixture():
    rng = np.random.default_rng(1)
    pos, good, bad = (rng.normal(m, 1, (n, quality.DIMS)).astype(np.float32) for m, n in ((0.25, 1500), (0.25, 900), (-0.25, 600)))
    model = quality.fit(pos, rng.permutation(np.concatenate([good, bad])))
    assert abs(model.prior - 0.6) < 0.12
    fresh = [rng.normal(m, 1, (500, quality.DIMS)).astype(np.float32) for m in (0.25, -0.25)]
    assert (model.score(fresh[0]) > 0.5).mean() > 0.95 and (model.score(fresh[1]) < 0.5).mean() > 0.95


def test_run_against_plain_python(spark, tmp_path):
    """Planted junk, boilerplate and copies through run(); what stays, and its ids, recomputed plainly."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    base = [tuple(r) for r in docs.orderBy("doc_id").limit(150).collect()]
    top = max(r[0] for r in base) + 1
    random.seed(2)
    long = [r for r in base if r[1] and len(r[1].split()) > 60][:20]
    copies = [(top + k, " ".join([*r[1].split()[:-1], f"changed{k}"]), r[2], r[3], r[4]) for k, r in enumerate(long)]
    junk = [(top + 100 + k, "".join(random.choice("0123456789abcdef") for _ in range(900)), None, "junk", 900) for k in range(5)]
    sf = f"file://{tmp_path}"
    frame(spark, base + copies + junk).write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{sf}/labels.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        now = spark.createDataFrame(stage(spark, now, sf).collect(), SCHEMA)
        if name == "language":
            assert not {r.doc_id for r in now.collect()} & {j[0] for j in junk}
    rows = now.collect()
    # Near copies, pair by pair.
    words = {r.doc_id: (r.text or "").translate({c: c + 32 for c in range(65, 91)}).split() for r in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    ids, group = sorted(sets), {i: i for i in sets}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                group[y] = x
    stay = {i for i in ids if find(i) == i}
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {(r.doc_id, n // 2048, n) for r in rows if r.doc_id in stay for n in range(0, len(lib.encode(r.text or "", add_special_tokens=False).ids) + 1, 2048)}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {(r.doc_id, r.piece, r.start) for r in got} == want and len(got) == len(want)
