from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from fieldloom.llm import licenses, queries


def test_against_sql(same_rows):
    same_rows(queries.op3_license_scan, queries.op3_sql())


def slow(texts, templates):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    shingles = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    out = set()
    for i, t in texts:
        own = shingles(words(t))
        for name, template in templates.items():
            want = set(shingles(words(template)))
            if want and len(want & set(own)) >= 0.8 * len(want):
                out.add((i, name, round(len(want & set(own)) / len(want), 9), min(own.index(s) for s in want & set(own))))
    return out


def test_full_partial_and_edited_texts(spark):
    mit = licenses.TEMPLATES["MIT"]
    words = mit.split()
    texts = [
        (1, f"Intro words. {mit} And more text after it."), (2, mit.upper().replace(" ", "\n  ")), (3, " ".join(words[: int(len(words) * 0.85)])), (4, " ".join(words[: int(len(words) * 0.6)])),
        (5, " ".join(w if k % 60 else "changed" for k, w in enumerate(words))), (6, None), (7, ""), (8, "Released under the MIT License."), (8, "Released under the MIT License."), (9, "word " * 20_000 + licenses.TEMPLATES["GPL-3.0"]),
    ]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in texts], "doc_id long, text string, template string, row long")
    found = [(r["doc_id"], r["template"], round(r["containment"], 9), r["first_word"]) for r in licenses.scan(df).collect()]
    assert set(found) == slow(texts, licenses.TEMPLATES) and found.count((8, "MIT-notice", 1.0, 0)) == 2
    assert {(i, n) for i, n, _, _ in found} >= {(1, "MIT"), (2, "MIT"), (3, "MIT"), (5, "MIT"), (9, "GPL-3.0")} and (4, "MIT") not in {(i, n) for i, n, _, _ in found}


def test_no_templates_and_a_folder_of_them(spark, tmp_path, no_docs):
    texts = [(1, licenses.TEMPLATES["BSD-2-Clause"]), (2, licenses.TEMPLATES["MPL-2.0"])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert licenses.scan(df, {"none": " . "}).count() == 0
    assert licenses.scan(no_docs).count() == 0
    long = " ".join(f"clause{k * k % 997} of{k}" for k in range(2000))
    (tmp_path / "long.txt").write_text(long)
    (tmp_path / "MPL").write_text(licenses.TEMPLATES["MPL-2.0"])
    found = licenses.templates_in(spark, str(tmp_path))
    assert found == {"long.txt": long, "MPL": licenses.TEMPLATES["MPL-2.0"]}
    df = df.unionByName(spark.createDataFrame([(3, "before " + " ".join(long.split()[200:3700]) + " after"), (4, long[: len(long) // 2])], df.schema))
    assert {(r["doc_id"], r["template"]) for r in licenses.scan(df, found).collect()} == {(2, "MPL"), (3, "long.txt")}


def test_retrieval_finds_edited_copies(spark):
    """The stated probability: copies with a share of 0.8 of their shingles left share a band with the template."""
    rng, name = random.Random(7), "Apache-2.0"
    words, texts = licenses.TEMPLATES[name].split(), []
    for k in range(400):
        own = list(words)
        while True:
            edited = list(own)
            edited[rng.randrange(len(edited))] = f"new{k}"
            if len(slow([(0, " ".join(edited))], {name: licenses.TEMPLATES[name]})) == 0:
                break
            own = edited
        texts.append((k, "pad " * rng.randrange(40) + " ".join(own)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows, pairs = licenses.retrieved(df, licenses.template_table(spark, {name: licenses.TEMPLATES[name]}))
    assert pairs.count() >= 399 and {r["doc_id"] for r in licenses.scan(df, {name: licenses.TEMPLATES[name]}).collect()} >= set(range(399))


def test_a_band_is_shared_as_often_as_windows_are_alike(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(600):
        both = [rng.getrandbits(64) - (1 << 63) for _ in range(20)]
        rows.append((both[:16], both[4:]))  # J = 12 / 20
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    same = [F.get(licenses.minima(F.col("a"), 16, k), F.lit(0)) == F.get(licenses.minima(F.col("b"), 16, k), F.lit(0)) for k in range(8)]
    found = df.select(*(s.cast("int").alias(f"s{k}") for k, s in enumerate(same))).collect()
    assert all(abs(sum(r[k] for r in found) / 600 - 0.6) < 0.08 for k in range(8))
    assert sum(any(r) for r in found) >= 597  # 1 - 0.4 ** 8 = 0.9993


def test_long_texts_of_licences_take_linear_time(spark):
    texts = [(k, (licenses.TEMPLATES["GPL-3.0"] + " ") * n) for k, n in ((1, 100), (2, 800))]
    times = []
    for i, t in [texts[0], *texts]:
        began = time.perf_counter()
        assert licenses.scan(spark.createDataFrame([(i, t)], "doc_id long, text string")).count() >= 1
        times.append(time.perf_counter() - began)
    assert times[2] < 8 * times[1] + 5
