"""The manifest against plain trees in Python."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from fieldloom.llm import manifest


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values) -> str:
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_levels(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain(rows):
    groups: dict = {}
    for doc_id, text, lang, source, n_chars in rows:
        own = leaf(doc_id, source, lang, n_chars, text)
        bad = n_chars is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        groups.setdefault(lang, []).append((doc_id is not None, doc_id or 0, own, doc_id, leaf(doc_id, source, lang, n_chars + 1, text) if bad else own))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_levels([x[2] for x in sorted(groups[g])]) for g in order}
    upper = plain_levels([trees[g][-1][0] for g in order])
    found = []
    for place, g in enumerate(order):
        for k, (_, _, own, doc_id, folded) in enumerate(sorted(groups[g])):
            siblings = []
            for levels, at in ((trees[g], k), (upper, place)):
                for level in levels[:-1]:
                    run = level[at - at % 2 : at - at % 2 + 2]
                    other = [x for i, x in enumerate(run) if i != at % 2]
                    siblings += other
                    folded = h(*other, folded) if at % 2 else h(folded, *other)
                    at //= 2
            found.append((doc_id, own, trees[g][-1][0], upper[-1][0], h(*siblings), folded, folded == upper[-1][0]))
    return sorted(found, key=repr)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def check(spark, rows, columns=COLUMNS):
    found = manifest.verified(spark.createDataFrame(rows, columns)).collect()
    assert sorted((tuple(r) for r in found), key=repr) == plain([r[:5] for r in rows])


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_many_sizes_of_groups(spark, monkeypatch, bits):
    monkeypatch.setattr(manifest, "BITS", bits)
    monkeypatch.setattr(manifest, "WIDTH", 1 << bits)
    rows = [(g * 1000 - i, f"text {i} é", f"l{g}", None if i % 3 else "s", i if i % 5 else None) for g, size in enumerate([1, 2, 3, 4, 5, 8, 9, 17, 33, 64]) for i in range(size)]
    check(spark, rows)


def test_rows_of_any_kind(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (7, "", "", "", 0), (7, "", "", "", 0), (7, "x", "", "", 2**63 - 1), (3, "w " * 500_000, "é", "s", 1), (3, "t", "z", "s", 1)]
    check(spark, rows)
    check(spark, [(*r, "clash", 1, {"a": 1}) for r in rows], f"{COLUMNS}, g string, rank int, m map<string,int>")
    check(spark, rows[:1])
    assert manifest.verified(spark.createDataFrame([], COLUMNS)).collect() == []


def test_many_groups_and_repeated_rows(spark):
    check(spark, [(i, None, f"g{i}", None, i) for i in range(2100)] + [(5, "same", "hot", "s", 1)] * 1500)


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    found = manifest.verified(docs).collect()
    assert sorted((tuple(r) for r in found), key=repr) == plain([tuple(r) for r in docs.collect()])


def test_proofs_of_some_leaves(spark):
    from pyspark.sql import functions as F

    rows = spark.range(5000).select(F.lit("=x").alias("g"), F.col("id").alias("order"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), F.struct(F.lit(1).alias("k")).alias("payload"))
    made = manifest.manifest(rows)
    asked = made.leaves.filter("rank in (0, 1023, 1024, 4999)").select("g", "rank", "payload")
    found = made.proofs(asked).collect()
    assert sorted(r["rank"] for r in found) == [0, 1023, 1024, 4999]
    for r in found:
        assert r["leaf"].hex() == h(str(r["rank"])) and manifest.fold(bytes(r["leaf"]), [bytes(s) for s in r["path"]]).hex() == made.root


def test_records_are_bounded_and_parts_balanced(spark):
    """One group holds all rows: no record has more children than its width, and sorting spreads it over all parts."""
    from pyspark.sql import functions as F

    rows = spark.range(0, 20_000, 1, 8).select(F.lit("=x").alias("g"), F.lit(1).alias("order"), F.unhex(F.sha2(F.lit("same"), 256)).alias("digest"), F.struct(F.lit(1).alias("k")).alias("payload"))
    made = manifest.manifest(rows)
    assert made.trees.levels[0].agg(F.max(F.size("children"))).first()[0] == 1024
    assert made.trees.records(0).count() <= 3  # equal segments have one address
    assert made.leaves.agg(F.count_distinct("rank"), F.max("rank")).first()[:] == (20_000, 19_999)
