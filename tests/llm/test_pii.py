from __future__ import annotations

import re
import time

from fieldloom.llm import pii
from tests.llm.conftest import TEXTS


def slow_base(text):
    """The contract's patterns, spelled out once more, over every text."""
    text = text or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)] if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def test_base_spans(spark, docs, odd_docs):
    for df in (docs, odd_docs):
        texts = df.select("doc_id", "text").collect()
        found = pii.spans(df).collect()
        assert sorted((repr(r["doc_id"]), r["base"]) for r in found) == sorted((repr(r["doc_id"]), slow_base(r["text"])) for r in texts)
        for r in found:
            assert set(filter(None, r["base"].split(","))) <= set(filter(None, r["spans"].split(",")))
            assert [r[f"n_{k}"] for k in pii.KINDS] == [r["base"].count(f"{k}:") for k in pii.KINDS]


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]+)+",
    "ip": r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|3[0-9]{3}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9.])(?:(?:\+|00)[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
}


def slow_spans(text, models):
    """Base and added spans by plain patterns and a look at every pair."""
    text = text or ""
    base = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in slow_base(text).split(",") if s)]
    out = list(base)
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text) if kind != "email" or re.search("@|at", text) else ():
            free = not any(k == kind and a < m.end() and m.start() < b for k, a, b in base)
            if free and kind in models:
                x = pii.row_of(pii.votes(kind, text, m.start(), m.end()), pii.features_of(text, m.start(), m.end()))
                if sum(p * q for p, q in zip(x, models[kind], strict=True)) > 0:
                    out.append((kind, m.start(), m.end()))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(out, key=lambda s: (pii.KINDS.index(s[0]), s[1])))


ODD = [
    "a@b.c@d.e x.y@z w@ @q.r aa@bb.cc_dd@ee.ff", "me (at) home (dot) org, you [at] there.de and at 10 . me @ home. Then", "1.2.3.4.5.6.7.8 12.34 999.1.1.1 01.2.3.4x 1.2.3.", "+1((((( +12 3+4 +49 30 123-4567 0049 30 1234567 123456789 1234567890123",
    "3782 822463 10005 378282246310005 4111-1111-1111-1111 4111 1111 1111 1112 9999999999999999", "jane . doe @ mail . example . com é@b.c a@é.b +é1", "@", "..@..", "1" * 500 + ".1.1.1", "a." * 300 + "@b.c",
]


def test_added_spans_against_plain_patterns(spark, docs, odd_docs):
    df = docs.select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text")).unionByName(spark.createDataFrame(list(enumerate(ODD, 1000)), "doc_id long, text string"))
    counted = pii.patterns(df)
    models = pii.train(counted)
    want = sorted((repr(r["doc_id"]), slow_spans(r["text"], models)) for r in df.collect())
    assert sorted((repr(r["doc_id"]), r["spans"]) for r in pii.spans(df).collect()) == want
    verdicts = pii.judged(counted, models)
    assert sum(a for a, _ in verdicts.values()) > 0 < sum(r for _, r in verdicts.values())


def test_long_runs_take_linear_time():
    models = pii.train([])
    began = time.perf_counter()
    for text in ("A" * 1_000_000 + "1", "7" * 1_000_000, "a" * 1_000_000 + "@", "@" + "b-" * 500_000, "+1" + "(" * 1_000_000, "1." * 500_000, "a@" * 300_000, "a@b.c " * 100_000, "1.2.3.4 " * 100_000):
        pii.all_spans(text, models)
    assert time.perf_counter() - began < 15


def test_swallowed_spans_are_found_again(spark):
    lines = [f"call +1 (555) 123-{n:04d} today" for n in range(40)] + [f"from 10.1.2.{n} here" for n in range(40)]
    texts = [*lines, "call +1 (555) 123-4567 10.20.30.40 now", "numbers 1234567812345678 only", "4111111111111111 5500005555555559"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.spans(df).collect()}
    assert spans[80] == "ip:23:34,phone:5:22"
    assert spans[81] == ""
    assert spans[82] == "card:0:16,card:17:33"


def test_reliabilities_follow_the_votes():
    counts = [((1, 1, 1, 0, 1, 0), 90), ((1, 1, 0, 0, 1, 0), 10), ((-1, -1, 0, 0, -1, 0), 80), ((-1, 1, 0, 0, -1, 0), 5)]
    tables, prior, post = pii.reliabilities(counts)
    assert 0.4 < prior < 0.7 and post[counts[0][0]] > 0.9 > 0.1 > post[counts[2][0]]
    assert tables[0][1, 1] > 0.9 > 0.2 > tables[0][0, 1]


def test_masked_rows(spark, odd_docs, no_docs):
    out = pii.redacted(odd_docs)
    assert out.schema == odd_docs.schema and out.count() == len(TEXTS)
    row = out.filter("doc_id = 9").first()
    assert row["text"] == "mail [EMAIL], [IP] or 999.1.1.1 card [CARD] tel [PHONE]" and row["n_chars"] == len(row["text"])
    assert {r["text"] for r in out.filter("doc_id in (3, 4)").collect()} == {None, ""}
    assert pii.spans(no_docs).count() == 0 == pii.redacted(no_docs).count()
