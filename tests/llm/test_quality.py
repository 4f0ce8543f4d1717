from __future__ import annotations

import math
import re
import string
import zlib

import numpy as np
import pytest

from fieldloom.llm import quality


def test_held_out_rows_are_not_learnt(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = {r["doc_id"]: r for r in quality.scores(docs, labels).collect()}
    assert len(found) == docs.count()
    for i, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    # labels of the held-out fold may say anything
    flipped = labels.selectExpr("doc_id", "case when crc32(encode(cast(doc_id as string), 'utf-8')) % 5 = 0 then 1 - quality else quality end as quality")
    again = {r["doc_id"]: r["score"] for r in quality.scores(docs, flipped).collect()}
    assert all(again[i] == pytest.approx(r["score"]) for i, r in found.items())


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    x = quality.scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in x]) > 0.95


def test_scores_are_the_density_difference():
    rng = np.random.default_rng(0)
    d = quality.DIM
    x = {0: rng.normal(1, 2, (300, d)), 1: rng.normal(0, 1, (500, d))}
    sums = {k: (z := np.hstack([np.ones((len(v), 1)), v])).T @ z for k, v in x.items()}
    model = quality.fit(sums, shrink=0, ridge=0)
    p = rng.normal(0, 1, (4, d))
    dens = []
    for k in (0, 1):
        mean, cov = x[k].mean(0), np.cov(x[k].T, bias=True)
        dev = p - mean
        dens.append(np.log(len(x[k]) / 800) - 0.5 * (np.linalg.slogdet(cov)[1] + np.einsum("ij,jk,ik->i", dev, np.linalg.inv(cov), dev)))
    assert model.margin(p) == pytest.approx(dens[1] - dens[0])


def slow_statistics(text):
    """The features once more, character by character."""
    raw, out = text.encode(), dict.fromkeys(quality.FEATURES, 0.0)
    if not raw:
        return out
    words = [w for w in re.split(rb"[ \t\n\r\x0b\x0c]+", raw) if w]
    lines = [w for w in raw.split(b"\n") if w.strip()]
    root = lambda k, n: math.sqrt(k / n) if n else 0.0
    marks = set(string.punctuation.encode())
    hard = marks - set(b".,;:'\"-()")
    n, m = len(raw), len(words)
    for name, wanted in (("upper", string.ascii_uppercase), ("digits", string.digits), ("blanks", " "), ("lines", "\n"), ("stops", "."), ("commas", ",")):
        out[name] = root(sum(b in wanted.encode() for b in raw), n)
    out["other_marks"], out["wide"] = root(sum(b in hard for b in raw), n), root(sum(b > 127 for b in raw), n)
    out["bytes"], out["words"], out["word_length"] = math.log1p(n), math.log1p(m), math.log1p(n / m if m else n)
    if m:
        pairs = list(zip(words, words[1:]))
        out["distinct_words"] = math.log(len(set(words))) / math.log1p(m)
        out["top_word"] = root(max(words.count(w) for w in set(words)), m)
        out["distinct_pairs"] = math.log1p(len(set(pairs))) / math.log1p(m)
        out["repeated_pairs"] = root(len(pairs) - len(set(pairs)), m)
        out["lone_marks"] = root(sum(len(w) == 1 and w[0] in marks for w in words), m)
        out["marked_words"] = root(sum(w[-1] in hard for w in words), m)
        out["capital_words"] = root(sum(w[:1].isupper() for w in words), m)
    out["packed"] = len(zlib.compress(raw, 1)) / n
    out["line_repeats"] = root(len(lines) - len(set(lines)), len(lines))
    return out


def test_statistics_against_a_plain_count(docs):
    texts = [r["text"] for r in docs.filter("length(text) between 1 and 20000").limit(60).collect()] + ["", " \t\n", "one", "A. b! !\nA. b! !\nÉé 123", "x " * 50]
    for t in texts:
        assert dict(zip(quality.FEATURES, quality.statistics(t.encode()), strict=True)) == pytest.approx(slow_statistics(t))


def test_shrunk_covariances_and_scores():
    rng = np.random.default_rng(5)
    d = quality.DIM
    x = {0: rng.normal(1, 2, (40, d)), 1: rng.normal(0, 1, (30, d))}
    model = quality.fit({k: (z := np.hstack([np.ones((len(v), 1)), v])).T @ z for k, v in x.items()})
    pooled = sum(len(v) * np.cov(v.T, bias=True) for v in x.values()) / 70
    p, logs = rng.normal(0, 1, (5, d)), []
    for k in (0, 1):
        cov = 0.9 * np.cov(x[k].T, bias=True) + 0.05 * pooled + 0.05 * np.diag(np.diag(pooled)) + 1e-3 * np.diag(np.diag(pooled))
        dev = p - x[k].mean(0)
        logs.append(np.log(len(x[k]) / 70) - 0.5 * (np.linalg.slogdet(cov)[1] + np.einsum("ij,jk,ik->i", dev, np.linalg.inv(cov), dev)))
    model.temperature = 4.0
    assert model.score(p) == pytest.approx(1 / (1 + np.exp((logs[0] - logs[1]) / 4)))


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, None, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.scores(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    none = labels.limit(0)
    assert {r["score"] for r in quality.scores(odd_docs, none).collect()} == {0.5}
    assert quality.scores(no_docs, labels).count() == 0
    assert quality.accepted(odd_docs, none).columns == odd_docs.columns and quality.accepted(odd_docs, none).count() == odd_docs.count()


def test_accepted_rows_are_those_predicted(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    want = sorted(r["doc_id"] for r in quality.scores(docs, labels).filter("predicted = 1").collect())
    kept = quality.accepted(docs, labels)
    assert sorted(r["doc_id"] for r in kept.collect()) == want and kept.schema == docs.schema
