from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from fieldloom.llm import recompress, queries


def slow(rows, window=13):
    big = 1 << 70
    first, out = {}, []
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, big), big - 1 if i is None else i)
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (big - 1 if i is None else i):
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((repr(i), len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(df, **options):
    return sorted((repr(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in recompress.repeats(df, **options).collect())


@pytest.mark.parametrize("shard_bytes", [1 << 23, 5_000])
def test_against_brute_force(spark, docs, odd_docs, shard_bytes):
    for df in (docs, odd_docs):
        assert found(df, shard_bytes=shard_bytes) == slow([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])


def test_runs_loops_and_windows_at_every_edge(spark):
    rng = random.Random(2)
    word = lambda n=6: "".join(rng.choices("ab", k=rng.randint(1, n)))
    passage = [word() for _ in range(40)]
    rows = []
    for i in range(60):
        a = rng.randint(0, 20)
        middle = passage[a : a + rng.choice([12, 13, 14, 20])]
        rows.append((i, " ".join([word(3) for _ in range(rng.randint(0, 9))] + middle + [word(3) for _ in range(rng.randint(0, 9))])))
    rows += [(100 + k, " ".join(["loop"] * n)) for k, n in enumerate((12, 13, 14, 50, 51, 50))]
    rows += [(200 + k, " ".join(["a", "b", "a", "a"] * n)) for k, n in enumerate((3, 4, 9, 9))]
    rows += [(300, " ".join(passage)), (300, " ".join(passage)), (None, " ".join(passage)), (-5, " ".join(passage[:20]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == slow(rows) == found(df, shard_bytes=300)


def test_equal_substrings_get_equal_symbols():
    rng = np.random.default_rng(3)
    common = [f"c{k}" for k in rng.integers(0, 9, 200)]
    texts = [" ".join(["x1", "x2", *common, "y"]), " ".join(["z", *common, "q1", "q2", "q3"])]
    s = recompress.Shard(pa.table({"doc_id": pa.array([1, 2]), "text": pa.array(texts)}))
    name, low, high, doc = recompress.low_symbols(s)
    inside = [{(n, a - s.starts[d] - off, b - s.starts[d] - off) for n, a, b, x in zip(name, low, high, doc, strict=True) if x == d and a - s.starts[d] >= off and b - s.starts[d] <= off + 200} for d, off in ((0, 2), (1, 1))]
    assert inside[0] == inside[1] and len(inside[0]) > 40


def test_kept_text_and_spans(spark, no_docs):
    passage = " ".join(f"w{k}" for k in range(20))
    df = spark.createDataFrame([(1, passage), (2, f"new {passage} words")], "doc_id long, text string")
    r = {x["doc_id"]: x for x in recompress.repeats(df, with_text=True).collect()}
    assert r[1]["kept"] == passage and r[2]["kept"] == "new words" and (r[2]["span_starts"], r[2]["span_ends"]) == ([1], [21])
    assert recompress.repeats(no_docs).count() == 0


def test_high_symbols_reveal_whole_copies():
    rng = np.random.default_rng(4)
    texts = [" ".join(f"v{k}" for k in rng.integers(0, 50, n)) for n in (13, 40, 700)]
    s = recompress.Shard(pa.table({"doc_id": pa.array(range(6)), "text": pa.array(texts * 2)}))
    name, more, start, end = recompress.high_symbols(s, np.ones(6, bool))
    of = lambda d: sorted(zip(name[s.doc[start] == d], more[s.doc[start] == d], start[s.doc[start] == d] - s.starts[d], end[s.doc[start] == d] - s.starts[d]))
    for d in range(3):
        assert of(d) == of(d + 3) and max(b - a for _, _, a, b in of(d)) == s.sizes[d]


def test_results_come_through_the_symbols(spark, docs, monkeypatch):
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    rows = docs.select("doc_id", "text").collect()
    small = recompress.Shard(pa.table({"doc_id": pa.array([r[0] for r in rows]), "text": pa.array([r[1] for r in rows])}))
    kinds = {"high": pa.list_(pa.int32()), "low": pa.list_(pa.int32()), "more": pa.list_(pa.int32()), "flags": pa.list_(pa.int8())}
    empty = pa.table({"kind": pa.array([], pa.int32()), **{k: pa.array([], t) for k, t in kinds.items()}})
    assert not recompress.open_windows(small, empty, 13).any()
    name = np.unique(recompress.cut(recompress.low_symbols(small)[0]))
    lists = {"more": [0] * len(name), "high": (name >> np.uint64(16)).astype(np.uint32).view(np.int32).tolist(), "low": (name & np.uint64(0xFFFF)).astype(np.int32).tolist(), "flags": [0] * len(name)}
    table = pa.table({"kind": pa.array([recompress.LOW], pa.int32()), **{k: pa.array([lists[k]], t) for k, t in kinds.items()}})
    assert recompress.open_windows(small, table, 13).any()
    monkeypatch.setattr(recompress, "low_symbols", lambda *_: none)
    assert not recompress.open_windows(small, table, 13).any()


def test_reports_grow_with_the_shards():
    """One row for each shard and bucket at most, whatever the number of shards."""
    rng = np.random.default_rng(5)
    for n in (10, 1000):
        for kind in (recompress.LOW, recompress.HIGH):
            x = recompress.report(3, kind, rng.integers(0, 1 << 47, n).astype(np.uint64) << np.uint64(0 if kind == recompress.LOW else 16), np.zeros(n, np.int32), np.arange(n), np.arange(16))
            assert x.num_rows <= 16 and sum(map(len, x.column("high").to_pylist())) == n
            assert recompress.report(3, kind, np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.arange(16)).num_rows == 0


def test_words_of_a_buffer():
    text = "Écoutez  ça,\t\nnaïve\x0b\x0c\r x xx  xx " + "A" * 3000 + "\u00a0b"
    starts, h1, h2 = recompress.word_hashes(text.encode())
    words = text.encode().split()
    assert len(starts) == len(words) and all(text.encode()[a:].startswith(w) for a, w in zip(starts, words))
    for h in (h1, h2):
        assert len(set(h.tolist())) == len(set(words)) and h[words.index(b"xx")] == h[words.index(b"xx") + 1]
    assert [len(x) for x in recompress.word_hashes(b"")] == [len(x) for x in recompress.word_hashes(b" \n")] == [0, 0, 0]


def test_repeated_and_missing_ids_are_dealt_to_all_shards(spark):
    rows = [(None if k % 3 else 7, f"text number {k} " + "same words " * 5) for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, shard_bytes=200) == slow(rows)


def test_against_sql(same_rows):
    same_rows(queries.op8_substring_dedup, queries.OP8_SQL)


def test_symbols_are_made_once(monkeypatch):
    """High symbols go on from the low ones, and the last step makes none."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"v{k}" for k in rng.integers(0, 9, n)) for n in (200, 90, 400)] + ["loop " * 60]
    s = recompress.Shard(pa.table({"doc_id": pa.array(range(4)), "text": pa.array(texts)}))
    for docs in (np.ones(4, bool), np.array([True, False, True, True])):
        x = recompress.Symbols(s)
        low, high = recompress.low_symbols(s, 13, 3, x), recompress.high_symbols(s, docs, 13, x)
        assert all((a == b).all() for a, b in zip(low, recompress.low_symbols(s), strict=True))
        assert sorted(zip(*(a.tolist() for a in high))) == sorted(zip(*(a.tolist() for a in recompress.high_symbols(s, docs))))
    monkeypatch.setattr(recompress, "Symbols", None)
    start, number = s.starts[[3, 0]] + [10, 5], np.array([30, -4])
    table = pa.table({"kind": pa.array([], pa.int32()), **{k: pa.array([], pa.list_(t)) for k, t in (("high", pa.int32()), ("low", pa.int32()), ("more", pa.int32()), ("flags", pa.int8()))}})
    assert np.flatnonzero(recompress.covered(s, table, start, number, 13)).tolist() == list(range(s.starts[3] + 10, s.starts[3] + 52))


def test_names_meet_in_their_bucket():
    rng = np.random.default_rng(7)
    reports, held = [], []
    for shard in range(6):
        for kind in (recompress.LOW, recompress.HIGH, recompress.PLACES):
            name = rng.integers(0, 40, 30).astype(np.uint64) << np.uint64(0 if kind == recompress.LOW else 31)
            more, ids = rng.integers(0, 1 if kind == recompress.LOW else 2, 30).astype(np.int32), rng.integers(0, 50, 30)
            reports.append(recompress.report(shard, kind, name, more, ids, np.array([5], np.int32)))
            held += [(shard, kind, int(n) >> (16 if kind == 1 else 32), int(n) & (0xFFFF if kind == 1 else 0xFFFFFFFF), int(m), int(i)) for n, m, i in zip(name, more, ids)]
    want = set()
    for shard, kind, high, low, more, _ in held:
        of = lambda known: [r[5] for r in held if r[1:5] == (kind, high, low, more) and known(r[0])]
        own, every = of(lambda x: x == shard), of(lambda x: True)
        if min(every) < (max(every) if kind == recompress.LOW else max(own)):
            want.add((shard, kind, high, low, more))
    out = recompress.merge(pa.concat_tables(reports))
    found = [(r["shard"], r["kind"], h, x & 0xFFFFFFFF, m) for r in out.to_pylist() for h, x, m in zip(r["high"], r["low"], r["more"])]
    assert set(found) == want and len(want) > 100


def test_names_of_few_and_of_many_windows_agree():
    rng = np.random.default_rng(8)
    s = recompress.Shard(pa.table({"doc_id": pa.array([1]), "text": pa.array([" ".join(f"w{k}" for k in rng.integers(0, 99, 300))])}))
    for window in (1, 2, 3, 8, 13):
        at = s.places(window)
        many, few = s.names(at, window), s.names(at[:9], window)
        assert len(at) == 301 - window and all((a[:9] == b).all() for a, b in zip(many, few, strict=True))
