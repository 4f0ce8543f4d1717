from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from fieldloom.llm import components, simhash
from tests.llm.conftest import TEXTS


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(pairs, nodes):
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            label[n] = label[label[n]]
            n = label[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_fingerprints_and_components_of_odd_texts(odd_docs):
    found = simhash.near_duplicates(odd_docs).collect()
    assert len(found) == len(TEXTS)
    want = {i: slow_fingerprint(t) for i, t in TEXTS}
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in found} == want
    component = {r["doc_id"]: r["component_id"] for r in found}
    assert component[2] == 1 and component[3] == component[4] == component[5] == 3 and component[6] == 6


def test_against_all_pairs(docs):
    found = simhash.near_duplicates(docs).collect()
    fp = {r["doc_id"]: r["fp"] % (1 << 64) for r in found}
    ids = sorted(fp)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 3]
    assert {r["doc_id"]: r["component_id"] for r in found} == slow_components(pairs, ids)


def test_links_at_every_distance(spark):
    rng = random.Random(0)
    prints = []
    for _ in range(60):
        base = rng.getrandbits(64)
        prints.append(base)
        for d in (1, 2, 3, 4):
            prints.append(base ^ sum(1 << b for b in rng.sample(range(64), d)))
    # a dense group: a chain and a ball around one centre
    centre = rng.getrandbits(64)
    prints += [centre ^ (1 << i) ^ (1 << j) for i in range(0, 30) for j in range(i)]
    prints = sorted(set(prints))
    signed = [int(x) for x in np.array(prints, np.uint64).view(np.int64)]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    balls = df.mapInArrow(simhash.variants(), "key long, fp long").repartition(4, "key").sortWithinPartitions("key")
    edges = [(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in balls.mapInArrow(simhash.links(), "u long, v long").collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    true = [(a, b) for k, a in enumerate(prints) for b in prints[k + 1 :] if (a ^ b).bit_count() <= 3]
    assert slow_components(edges, prints) == slow_components(true, prints)
    assert len(set(edges)) < len(true)


def test_batches_do_not_matter_for_links():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 12).astype(np.uint64)
    fp = np.unique(np.concatenate([base ^ np.uint64(1 << k) for k in range(0, 40, 3)]))
    emitted = list(simhash.variants()([pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64))], ["fp"])]))
    table = pa.Table.from_batches(emitted).sort_by("key").combine_chunks()

    def found(size):
        batches = (b for at in range(0, table.num_rows, size) for b in table.slice(at, size).to_batches())
        return sorted({(r["u"], r["v"]) for b in simhash.links()(batches) for r in b.to_pylist()})

    assert found(1 << 20) == found(5) == found(64) != []


def test_wide_links_need_the_second_fingerprint(spark):
    rng = random.Random(5)
    prints = []
    for _ in range(80):
        fp, check = rng.getrandbits(64), rng.getrandbits(64)
        prints.append((fp, check))
        for d, e in ((1, 0), (4, 14), (5, 3), (5, 15), (6, 0), (0, 20)):
            prints.append((fp ^ sum(1 << b for b in rng.sample(range(64), d)), check ^ sum(1 << b for b in rng.sample(range(64), e))))
    prints = sorted(set(prints))
    array = np.array(prints, np.uint64)
    nodes = [int(x) for x in simhash.node_of(array[:, 0], array[:, 1]).view(np.int64)]
    df = spark.createDataFrame([tuple(int(v) for v in r) for r in array.view(np.int64)], "fp long, check long")
    balls = df.mapInArrow(simhash.variants(5, True), "key long, fp long, check long").repartition(4, "key").sortWithinPartitions("key")
    edges = [tuple(r) for r in balls.mapInArrow(simhash.links(5, True), "u long, v long").collect()]
    linked = lambda a, b: (a[0] ^ b[0]).bit_count() <= 5 and (a[1] ^ b[1]).bit_count() <= 14
    true = [(nodes[j], nodes[k]) for k, b in enumerate(prints) for j, a in enumerate(prints[:k]) if linked(a, b)]
    assert slow_components(edges, nodes) == slow_components(true, nodes)


def test_light_edits_are_near_duplicates(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)]
    rows, clean = [], 0
    for k in range(0, 120, 3):
        words = rng.choices(vocabulary, k=400)
        one = [*words[:200], "changed", *words[201:]]
        rows += [(k, " ".join(words)), (k + 1, " ".join(words).upper()), (k + 2, " ".join(one))]
        clean += 1
    kept = [r["doc_id"] for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert {k for k in kept if k % 3 == 0} == set(range(0, 120, 3)) and not [k for k in kept if k % 3 == 1]
    assert len(kept) - clean <= 4


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (5, 4), (4, 5)]
    found = components.connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert {r["node"]: r["component"] for r in found.collect()} == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys(range(100, 140), 100)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_deduplication_keeps_one_row_of_each_group(odd_docs, no_docs):
    kept = simhash.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 6, 7, 8, 9, 10] and ids.count(None) == 1
    assert simhash.near_duplicates(no_docs).count() == 0 == simhash.deduplicated(no_docs).count()


def test_balls_propose_pairs_beside_the_bands(spark, monkeypatch):
    """Without any band, sets with fingerprints in one ball are linked if their similarity is at least 0.8, and no others are."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    texts = []
    for _ in range(40):
        words = [word() for _ in range(400)]
        texts += [words, [*words[:200], "changed", *words[201:]], [*words, word()]]
    passage = [word() for _ in range(3)]
    texts += [[*passage, word(), word()] for _ in range(60)]  # one shingle each, so no two alike
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")

    def components(radius=simhash.WIDE):
        return {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, 5, radius, checked=True).collect()}

    whole = components()
    assert whole == {k: k - k % 3 if k < 120 else k for k in range(180)}

    def no_band(batches):
        yield from ()

    monkeypatch.setattr(simhash.jaccard, "emit", no_band)
    found = components()
    assert all(whole[found[k]] == whole[k] for k in found)
    assert sum(found[k] == whole[k] != k for k in found) > 60
    prints = simhash.jaccard.prints(df, 5).select("node", "fp")
    assert 0 < simhash.ball_pairs(prints).count() < prints.count()
    # whatever the balls propose, the sets decide
    sets = simhash.jaccard.prints(df.filter("doc_id >= 120"), 5).selectExpr("node", "0L as fp").toArrow()
    monkeypatch.setattr(simhash, "ball_pairs", lambda nodes, _: spark.createDataFrame([(sets["node"][0].as_py(), x) for x in sets["node"].to_pylist()[1:]], "u long, v long"))
    assert components() == {k: k for k in range(180)}
