from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import jaccard, simhash
from tests.llm.test_simhash import slow_components


def words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=7)) for _ in range(n)]


def shingles(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def components_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, 5, simhash.WIDE, checked=True).collect()}


@pytest.mark.parametrize("block", [2048, 3])
def test_against_brute_force_in_both_directions(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(1)
    texts = []
    for k in range(90):
        one = words(rng, 120)
        end = [*one[: 120 - k % 30], *words(rng, k % 30)]  # similarities from 1 down to 0.6
        texts += [" ".join(one), " ".join(end)]
    base = words(rng, 120)  # a group whose members are near some of the others only
    texts += [" ".join([*base[:j], *words(rng, 10), *base[j + 10 :]]) for j in range(0, 110, 5)]
    pairs = [(a, b) for b in range(len(texts)) for a in range(b) if alike(texts[a], texts[b]) >= 0.8]
    assert any(alike(texts[a], texts[b]) < 0.83 for a, b in pairs)
    assert components_of(spark, texts) == slow_components(pairs, range(len(texts)))
    kept = simhash.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == set(slow_components(pairs, range(len(texts))).values())


def test_batches_do_not_matter():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 24, 30).astype(np.uint64)) for _ in range(60)]
    bands = rng.integers(0, 4, (60, jaccard.BANDS)) + 10 * np.arange(jaccard.BANDS)
    sketches = np.zeros((60, 128), np.uint8)
    rows = sorted((int(key), node, node, bands[node].tobytes(), sketches[node].tobytes(), sets[node].tobytes()) for node in range(60) for key in bands[node])
    kinds = {"key": pa.int64(), "node": pa.int64(), "label": pa.int64(), "bands": pa.binary(), "sketch": pa.binary(), "set": pa.binary()}
    table = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds.values())], list(kinds))

    def found(make, size):
        return sorted(tuple(r.values()) for b in make(table.slice(at, size) for at in range(0, len(rows), size)) for r in b.to_pylist())

    stars = found(jaccard.stars, 9999)
    least = {k: min(r[1] for r in rows if r[0] == k) for k in {r[0] for r in rows}}
    assert stars == found(jaccard.stars, 7) == sorted((r[0], least[r[0]], r[1]) for r in rows if r[1] != least[r[0]])
    asked = found(jaccard.wanted, 9999)
    assert asked == found(jaccard.wanted, 7) and set(asked) <= {r[:2] for r in rows}
    links = found(jaccard.links_across, 9999)
    assert {x for pair in links for x in pair} <= {r[1] for r in asked}
    assert links == found(jaccard.links_across, 7)
    near = lambda a, b: jaccard.similarity(sets[a], sets[b]) >= jaccard.THRESHOLD
    assert links and all(near(a, b) for a, b in links)
    met = [(u, v) for _, u, v in stars if near(u, v)]
    true = [(a, b) for b in range(60) for a in range(b) if near(a, b) and (bands[a] == bands[b]).any()]
    assert slow_components([*met, *links], range(60)) == slow_components(true, range(60))


def test_texts_below_the_threshold_are_no_duplicates(spark):
    rng = random.Random(3)
    refrain = " ".join(["the same six words come again"] * 150)
    texts = [f"{refrain} {' '.join(words(rng, 60))}" for _ in range(20)]  # few shingles shared, but most words
    passage = " ".join(words(rng, 200))
    texts += [f"{passage} {' '.join(words(rng, 36))}" for _ in range(60)]  # J = 0.73
    assert max(alike(a, b) for k, a in enumerate(texts) for b in texts[:k]) < 0.8
    assert components_of(spark, texts) == {k: k for k in range(len(texts))}
    kept = simhash.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert kept.count() == len(texts)


def test_rows_without_or_with_repeated_ids_are_rows_of_their_own(spark):
    rng = random.Random(4)
    texts = [" ".join(words(rng, 50)) for _ in range(12)]
    rows = [(None, t, "a") for t in texts[:6]] + [(7, t, "a") for t in texts[6:]] + [(None, texts[0], "b"), (7, texts[6], "b"), (3, texts[7], "c"), (7, None, "d"), (7, "", "e")]
    kept = [tuple(r) for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, __n string").withColumn("__rid", F.col("__n"))).collect()]
    assert all(r[2] == r[3] for r in kept)
    kept = [r[:3] for r in kept]
    assert sorted((t or "", i or 0) for i, t, _ in kept) == sorted([("", 7), *((t, 0) for t in texts[:6]), (texts[6], 7), (texts[7], 3), *((t, 7) for t in texts[8:])])


def crowd(spark, sets, labels, sketch=None):
    low = lambda s: (jaccard.minima(s) & np.uint64(255)).astype(np.uint8).tobytes()
    rows = [(k, label, sketch or low(s), s.tobytes()) for k, (s, label) in enumerate(zip(sets, labels, strict=True))]
    return spark.createDataFrame(rows, "node long, label long, sketch binary, set binary")


def test_crowds_below_the_threshold_do_not_meet(spark):
    """Twice the documents around one passage, J about 0.73, give no comparison more; true pairs among them are found."""
    rng = random.Random(7)
    passage, found = words(rng, 340), {}
    for n in (60, 120):
        texts = [" ".join([*passage, *words(rng, 60)]) for _ in range(n)]
        near = [" ".join([*t.split()[:-3], *words(rng, 3)]) for t in texts[:5]]
        whole = crowd(spark, [jaccard.shingle_set(t.encode(), 5) for t in [*texts, *near]], range(n + 5))
        assert {tuple(sorted(r)) for r in jaccard.links_in_crowd(whole).collect()} == {(k, n + k) for k in range(5)}
        found[n] = jaccard.crowd_groups(whole).count()
    assert found[120] < 3 * found[60] and found[120] < 60


def test_a_crowd_of_near_copies_sends_sets_not_pairs(spark):
    """Copies of one text, some of its words replaced in each: rows are bounded by the sets' prefixes, however many pairs are alike."""
    rng = random.Random(10)
    base = words(rng, 60)
    texts = [" ".join([*base[:at], *words(rng, 4), *base[at + 4 :]]) for at in (rng.randrange(56) for _ in range(300))]
    sets = [jaccard.shingle_set(t.encode(), 5) for t in texts]
    whole = crowd(spark, sets, range(300))
    links = [tuple(r) for r in jaccard.links_in_crowd(whole).collect()]
    near = [(a, b, jaccard.similarity(sets[a], sets[b])) for b in range(300) for a in range(b)]
    true = [(a, b) for a, b, j in near if j >= 0.8]
    assert slow_components(links, range(300)) == slow_components(true, range(300)) and {tuple(sorted(x)) for x in links} <= set(true)
    rows, alike_pairs = jaccard.crowd_groups(whole).count(), sum(j >= 0.7 for _, _, j in near)
    assert rows <= sum(jaccard.prefix_lengths(len(s))[0] for s in sets) and len(links) < 20 * 300
    assert rows < alike_pairs


@pytest.mark.parametrize(("crowd_size", "part", "counts"), [(4096, 1_000_000, 10**6), (7, 1_000_000, 10**6), (4096, 150, 0)])
def test_prefixes_meet_every_similar_pair(spark, monkeypatch, crowd_size, part, counts):
    monkeypatch.setattr(jaccard, "CROWD", crowd_size)
    monkeypatch.setattr(jaccard, "COUNTED", counts)
    monkeypatch.setattr(jaccard, "PART", part)
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 60, n)) for n in rng.integers(1, 60, 300)]
    sets += [np.setdiff1d(s, rng.choice(s, len(s) // 10)) for s in sets[:150] if len(s) > 3]
    labels = [k % 97 for k in range(len(sets))]
    whole = crowd(spark, [s.astype(np.uint64) for s in sets], labels, sketch=b"same" * 32)
    true = {(a, b) for b in range(len(sets)) for a in range(b) if a % 97 != b % 97 and jaccard.similarity(sets[a], sets[b]) >= 0.8}
    keys = {}
    for r in jaccard.crowd_groups(whole).collect():
        keys.setdefault(r["node"], set()).add(r["key"])
    assert len(true) > 100 and all(keys[a] & keys[b] for a, b in true)
    links = {tuple(sorted(r)) for r in jaccard.links_in_crowd(whole).collect()}
    same = [(k, k + 97) for k in range(len(sets) - 97)]
    assert links <= true and slow_components([*same, *links], range(len(sets))) == slow_components([*same, *true], range(len(sets)))


def test_recall_over_planted_pairs(spark, capsys):
    """Thousands of pairs at J from 0.8 to 0.95 among texts that share passages."""
    rng = random.Random(9)
    passages = [words(rng, 150) for _ in range(20)]
    texts = []
    for k in range(2000):
        one = [*passages[k % 20], *words(rng, 100)]
        at, cut = rng.randrange(150, 200), rng.randrange(3, 26)
        texts += [" ".join(one), " ".join([*one[:at], *words(rng, cut), *one[at + cut :]])]
    planted = [(2 * k, 2 * k + 1) for k in range(2000) if alike(texts[2 * k], texts[2 * k + 1]) >= 0.8]
    component = components_of(spark, texts)
    caught = sum(component[a] == component[b] for a, b in planted)
    with capsys.disabled():
        print(f" recall {caught} of {len(planted)} planted pairs")
    assert len(planted) > 1500 and caught >= 0.999 * len(planted)
    assert sum(component[k] == k for k in component) == len(texts) - caught


def test_columns_of_any_type(spark):
    rows = [(1, "a b c d e f", {"x": 1}, [1]), (1, "a b c d e f", {"x": 2}, [1]), (1, "a b c d e f", {"x": 2}, [1]), (2, "z", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, rid array<int>")
    kept = [(r["doc_id"], r["text"]) for r in simhash.deduplicated(df).collect()]
    assert sorted(kept) == [(1, "a b c d e f"), (2, "z")]
