from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from fieldloom.llm import decontam, queries
from fieldloom.llm.fmindex import FMIndex, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow(texts, items, window=13):
    words = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    phrases = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            phrases.setdefault(tuple(w[k : k + window]), set()).add("null" if i is None else str(i))
    out = []
    for i, t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                if (p := tuple(w[k : k + n])) in phrases:
                    hit |= set(range(k, k + n))
                    found |= phrases[p]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_index_finds_all_occurrences():
    rng = np.random.default_rng(0)
    for n, s in ((10, 2), (50, 3), (400, 40), (700, 2)):
        text = np.append(rng.integers(1, s + 1, n), 0)
        text = np.unique(text, return_inverse=True)[1]
        index = FMIndex(text)
        for length in (1, 2, 5):
            patterns = np.array([text[k : k + length] for k in rng.integers(0, max(1, n - length), 8)] + [np.full(length, s + 5)])
            alive, low, high = index.search(patterns)
            found = {int(a): sorted(index.locate(np.arange(x, y)).tolist()) for a, x, y in zip(alive, low, high, strict=True)}
            for k, p in enumerate(patterns):
                where = [i for i in range(n + 1) if len(text[i : i + length]) == length and (text[i : i + length] == p).all()]
                assert found.get(k, []) == where


def test_every_word_is_indexed(docs):
    lists = [decontam.words_of((r["text"] or "").encode()) for r in docs.collect()]
    index, symbols = decontam.index_of(lists)
    assert index.n == sum(map(len, lists)) + len(lists) + 1
    assert len(symbols) == len({w for words in lists for w in words})
    # backwards through the index, from its end, all words come out again
    names = {n: w for w, n in symbols.items()} | {1: None}
    row, out = np.zeros(1, np.int64), []
    for _ in range(2000):
        symbol = index._symbol_at(row)
        out.append(names[int(symbol[0])])
        row = index.first[symbol] + index.rank(symbol, row)
    flat = [w for words in lists for w in (*words, None)]
    assert out[::-1] == flat[-2000:]


def test_suffix_array_of_repeated_texts():
    rng = np.random.default_rng(1)
    for piece in (np.array([2]), np.array([2, 3]), rng.integers(2, 9, 50), rng.integers(2, 1 << 20, 40)):
        text = np.append(np.tile(np.append(piece, 1), 30), 0)
        text = np.unique(text, return_inverse=True)[1]
        want = sorted(range(len(text)), key=lambda k: text[k:].tolist())
        assert suffix_array(text).tolist() == want


def test_against_brute_force(spark, docs, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = slow([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in benchmark.collect()])
    assert rows(decontam.contamination(docs, benchmark)) == want
    assert any(r[5] for r in want)


@pytest.mark.parametrize("shard_words, block_words", [(10, 5), (1_000_000, 2_000_000), (40, 30), (14, 30)])
def test_short_items_overlaps_and_blocks(spark, odd_docs, shard_words, block_words):
    text = " ".join(f"w{k}" for k in range(40))
    texts = [(20, text), (21, text + " " + text), (22, "x " + text[:30]), (23, "W1, w2; W3!"), (24, "w1 w2 w2 w1 w2 w2 w1")]
    items = [(1, text), (1, text), (2, "w1 w2 w3"), (None, "w2 w2"), (3, None), (4, " ,. "), (5, "one"), (6, "漢字かな交じり文")]
    df = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id long, text string"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contamination(df, benchmark, shard_words=shard_words, block_words=block_words)
    assert rows(found) == slow([(r["doc_id"], r["text"]) for r in df.collect()], items)


def test_clean_keeps_rows_as_they_are(spark, odd_docs, no_docs):
    benchmark = spark.createDataFrame([(1, "one")], "item_id long, text string")
    kept = decontam.clean(odd_docs, benchmark, block_words=1)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 2
    assert decontam.clean(odd_docs, benchmark.limit(0)).count() == odd_docs.count()
    assert decontam.contamination(no_docs, benchmark).count() == 0


def test_spans_are_merged():
    assert decontam.merged([5, 0, 3, 10], [8, 3, 6, 11]) == ([0, 10], [8, 11])


def test_against_sql(same_rows):
    same_rows(queries.op5_benchmark_decontamination, queries.OP5_SQL)


def test_indexes_are_bounded_and_built_once(spark, tmp_path, monkeypatch):
    """No index is larger than a shard, however long a text is, and each shard has one index for all blocks."""
    rng = np.random.default_rng(3)
    lists = [[b"w%d" % k for k in rng.integers(0, 500, n)] for n in (20_000, 3, 0, 700, 999, 1000, 1001, 5)]
    built = []
    plain = decontam.index_of
    monkeypatch.setattr(decontam, "index_of", lambda pieces: built.append(sum(map(len, pieces))) or plain(pieces))
    blocks = []
    for k in range(3):
        block = decontam.Phrases()
        for item, w in enumerate(lists):
            if at := max(0, len(w) - 13 - k):
                block.add(f"{k}-{item}", b" ".join(w[at : at + 13]), 13)
        blocks.append(str(tmp_path / f"{k}.arrow"))
        block.write(blocks[-1])
    shards = list(decontam.shards_of(lists, 13, 1000))
    found = {x[3][0] for shard in shards for x in decontam.search_shard(shard, blocks)}
    assert found == {f"{k}-{item}" for k in range(3) for item, w in enumerate(lists) if len(w) > 13 + k}
    assert len(built) == len(shards) and max(built) <= 1000
    # every window of a text lies whole in one of its pieces
    for k, w in enumerate(lists):
        inside = {at + i for shard in shards for d, at, piece in shard if d == k for i in range(len(piece) - 12)}
        assert inside == set(range(len(w) - 12))


def test_blocks_are_written_by_tasks(spark):
    benchmark = spark.createDataFrame([(k, f"a{k} b c d e f g h i j k l m n o") for k in range(40)], "item_id long, text string")
    paths = decontam.write_blocks(benchmark, 13, 60)
    assert len(paths) == 10
    phrases = [len(k) for p in paths for _, k, _ in decontam.read_block(p)[1]]
    assert sum(phrases) == 40 + 2 * 10
    assert decontam.write_blocks(benchmark.limit(0), 13, 60) == []
