from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import mixing, queries
from tests.llm.conftest import TEXTS


def test_against_sql(same_rows):
    same_rows(queries.op2_mix_sources, queries.OP2_SQL)


def test_targets_share_the_excess(spark):
    df = spark.createDataFrame([("a", 100), ("b", 10), (None, 1000)], "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    # 1665 words: a and b, of weights 3 and 1, stop at twice their size; the last gets the rest
    assert found == {"a": 200.0, "b": 20.0, None: pytest.approx(1445.0)}


def test_targets_without_words(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0)], "source string, source_size long")
    assert {r["target"] for r in mixing.targets(df).collect()} == {0.0}


def test_mix_meets_its_targets(docs):
    plan = mixing.schedule(docs)
    rows = plan.collect()
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(e["words"] for e in r["entries"])
        by.setdefault(r["source"], []).append(r)
    for own in by.values():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= mixing.PACKET
    assert sum(r["taken"] for r in rows) == 3 * sum(r["size"] for r in rows) // 2
    again = sorted((r["doc_id"], r["taken"]) for r in mixing.schedule(docs.repartition(7)).collect())
    assert again == sorted((r["doc_id"], r["taken"]) for r in rows)


def slow(rows, target, budget, packet=mixing.PACKET):
    """All packets in one sorted list."""
    queue, place = [], {}
    for k, (source, size, key) in sorted(enumerate(rows), key=lambda r: (r[1][2], r[0])):
        before = place.get(source, 0)
        place[source] = before + size
        queue += [(source, key, k, p, at, min(packet, size - at), before) for p in (0, 1) for at in range(0, size, packet)]
    timed = sorted(((before + p * place[s] + at + n) / target[s], s is None, s or "", key, k, p, at, n) for s, key, k, p, at, n, before in queue)
    taken = [0] * len(rows)
    for *_, k, _, _, n in timed:
        taken[k] += (now := min(n, budget))
        budget -= now
    return taken


def test_truncation_against_one_sorted_list(spark, odd_docs, monkeypatch):
    rows = odd_docs.collect() * 3
    df = spark.createDataFrame(rows, odd_docs.schema)
    for ranges in (4096, 2):
        monkeypatch.setattr(mixing, "RANGES", ranges)
        found = sorted((repr(r["doc_id"]), repr(r["source"]), r["size"], r["taken"]) for r in mixing.schedule(df).collect())
        sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows]
        keys = [hashlib.md5(f"42:{'' if r['doc_id'] is None else r['doc_id']}:{hashlib.md5((r['text'] or '').encode()).hexdigest()}".encode()).hexdigest() for r in rows]
        target = {r["source"]: r["target"] for r in mixing.schedule(df).collect()}
        taken = slow([(r["source"], n, k) for r, n, k in zip(rows, sizes, keys, strict=True)], target, 3 * sum(sizes) // 2)
        assert found == sorted((repr(r["doc_id"]), repr(r["source"]), n, t) for r, n, t in zip(rows, sizes, taken, strict=True))


def test_very_frequent_rows_are_written_in_lots(spark, monkeypatch):
    df = spark.createDataFrame([(None, "a b c", "s")] * 50 + [(1, "d e", "t")], "doc_id long, text string, source string")
    whole = sorted(map(repr, mixing.schedule(df).collect()))
    monkeypatch.setattr(mixing, "COPIES", 7)
    assert sorted(map(repr, mixing.schedule(df).collect())) == whole and len(whole) == 51


def test_entries_come_in_virtual_time_and_end_at_the_budget(docs):
    mixed = mixing.mix(docs).collect()
    times = [r["virtual_finish"] for r in mixed]
    assert times == sorted(times)
    total = mixing.schedule(docs).agg({"size": "sum"}).first()[0]
    assert sum(r["words"] for r in mixed) == 3 * total // 2


def test_texts_are_those_taken(docs, odd_docs, no_docs):
    for df in (docs, odd_docs):
        texts = {(r["doc_id"], len((r["text"] or "").split())): r["text"] for r in df.collect()}
        plan = sorted((repr(r["doc_id"]), r["taken"]) for r in mixing.schedule(df).filter("taken > 0").collect())
        rows = mixing.mixed_texts(df).collect()
        assert sorted((repr(r["doc_id"]), r["taken"]) for r in rows) == plan
        for r in rows:
            whole = texts.get((r["doc_id"], r["size"]))
            if r["passes"] > 1 or r["taken"] == r["size"]:
                assert whole is None or r["text"] == whole
            else:
                assert len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) == r["taken"] < r["size"]
    assert mixing.mixed_texts(no_docs).count() == 0


def test_odd_rows_and_empty_table(odd_docs, no_docs):
    rows = mixing.schedule(odd_docs).collect()
    assert len(rows) == len(TEXTS) and {r["size"] for r in rows if r["doc_id"] in (3, 4, 5)} == {0}
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mixing.schedule(no_docs).count() == 0 == mixing.mix(no_docs).count()


def test_first_words(spark):
    df = spark.createDataFrame([(" a  b\tc d", 2), ("x", 5), (None, 1)], "t string, n int")
    assert [r[0] for r in df.select(mixing.first_words(F.col("t"), F.col("n"))).collect()] == ["a b", "x", None]
