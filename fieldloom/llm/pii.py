"""Personal data by weak supervision.

Base patterns find what they find in every text, per kind, leftmost and without overlaps; a match that fails its
check (octets, digits, Luhn) is dropped, and base spans always stay. Wider candidates (written-out addresses, numbers with or
without a country code, long runs of digits, dotted quadruples, what a failed match has swallowed) are judged, whether or not
they pass a check, by labelers that may abstain: shape (regex), checksum, gazetteers, context words, boundaries and separators.
Expectation-maximisation over the corpus' vote patterns estimates each labeler's reliability per kind, starting from stated
prior counts, and the patterns' posteriors; these train the final span classifier, a logistic regression over votes
and features of the span's own (length, marks inside, neighbours). A candidate that it accepts becomes a span unless it
overlaps a base span of its kind.

All patterns take time linear in the text. Only counts of vote patterns leave the tasks: at most
KINDS * 3^LABELERS * the number of feature values, whatever the corpus.

Defined results: null and empty texts have no spans; offsets are code points, end exclusive; repeated rows stay
rows of their own; without any candidate in the corpus only base spans are given; an empty table gives no
rows; other columns are ignored by `spans` and kept by `redacted`, whose n_chars follows the new text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import columns, small_batches

KINDS = ("email", "ip", "card", "phone")
# The base patterns, written so that no run of characters is tried twice. An address is found from its @.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
BASE = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Wider than the base, or cut tighter inside what a greedy base match swallows.
AT = re.compile(r"@|\(at\)|\[at\]")
WIDE_DOMAIN = re.compile(r" ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++")
WIDER = {
    "ip": re.compile(r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{13,19}|(?:[0-9]{4}[ -]){3}[0-9]{4}|3[0-9]{3}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"),
    "phone": re.compile(r"(?<![0-9.])(?:(?:\+|00)[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"),
}
STRICT = {
    "email": re.compile(r"[A-Za-z0-9_+-]+(?:\.[A-Za-z0-9_+-]+)*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"),
    "ip": re.compile(r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}"),
    "card": re.compile(r"(?:[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{13})"),
    "phone": re.compile(r"\+[1-9][0-9]{0,2} ?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}"),
}
# Gazetteers and context words.
DOMAINS = frozenset("com org net edu gov mil int info biz io dev app de fr es it nl be at ch uk us ca au br mx ar cl co pl pt se no dk fi ie cz".split())
CARD_STARTS = ("34", "37", "4", "51", "52", "53", "54", "55", "2221", "23", "24", "25", "26", "270", "271", "2720", "6011", "65", "35")
COUNTRY_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
NEAR = {
    "email": frozenset("email e-mail mail contact write reach correo courriel kontakt".split()),
    "ip": frozenset("ip address host server client from login adresse".split()),
    "card": frozenset("card visa mastercard amex credit debit payment karte tarjeta carte".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax telefon teléfono téléphone".split()),
}
AGAINST = frozenset("token version release isbn order invoice sku hash build serial".split())
LABELERS, LENGTHS = 6, 6
ROUNDS, ACCEPT = 50, 0.5
CONTEXT = 48
#: Prior counts of a labeler's votes (-1, 0, 1) among non-spans and spans: better than chance, and checksums much better.
PRIOR = ((4.0, 2.0, 2.0), (2.0, 2.0, 4.0))
CHECK_PRIOR = ((90.0, 5.0, 15.0), (1.0, 4.0, 95.0))
CLASS_PRIOR, CHECK = 5.0, 1


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def valid(kind: str, s: str) -> bool:
    """The check that a base match has to pass."""
    if kind == "ip":
        return all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))
    if kind == "card":
        return 16 <= len(d := digits_of(s)) <= 19 and luhn(d)
    if kind == "phone":
        return 8 <= len(digits_of(s)) <= 15
    return True


#: Texts without any of these characters hold no span of any kind.
ANY = re.compile(r"[0-9@]|[(\[]at[)\]]")


def addresses(text: str, marks: re.Pattern, domain: re.Pattern, spaced: bool) -> list[tuple[int, int]]:
    """Leftmost addresses without overlaps. From each mark to the left as far as a local part goes, then the domain to the
    right; neither passes another mark, so each character is seen twice at most."""
    out, done = [], 0
    for m in marks.finditer(text):
        if m.start() < done:
            continue
        end = m.start() - (spaced and text[m.start() - 1 : m.start()] == " ")
        start = end
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < end and (found := domain.match(text, m.end())):
            out.append((start, found.end()))
            done = found.end()
    return out


_SIGN = re.compile("@")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", a, b) for a, b in addresses(text, _SIGN, DOMAIN, False)]
    return found + [(kind, m.start(), m.end()) for kind in KINDS[1:] for m in BASE[kind].finditer(text) if valid(kind, m[0])]


def wider_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", a, b) for a, b in addresses(text, AT, WIDE_DOMAIN, True)]
    return found + [(kind, m.start(), m.end()) for kind in KINDS[1:] for m in WIDER[kind].finditer(text)]


def votes(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """Each labeler's vote: 1 for, -1 against, 0 abstains."""
    s = text[start:end]
    d = digits_of(s)
    shape = 1 if STRICT[kind].fullmatch(s) else -1
    if kind == "email":
        check = 1 if re.fullmatch(r"[^@]*[A-Za-z][^@]*", s.partition("@")[0]) else 0
        gazetteer = 1 if re.split(r"[.\])\s]+", s)[-1].lower() in DOMAINS else -1
    elif kind == "ip":
        check = 1 if valid("ip", s) else -1
        first = s.partition(".")[0].lstrip("0")
        gazetteer = 1 if first and len(first) < 4 and int(first) < 224 and first != "127" else -1
    elif kind == "card":
        check = 1 if luhn(d) else -1
        gazetteer = 1 if d.startswith(CARD_STARTS) else 0
    else:
        check = 1 if 8 <= len(d) <= 15 else -1
        code = re.match(r"(?:\+|00)([0-9]{1,3})", s)
        gazetteer = -1 if not code else 1 if any(code[1][:n] in COUNTRY_CODES for n in (1, 2)) else 0
    around = set(re.findall(r"[\w-]+", text[max(0, start - CONTEXT) : start].lower())) | set(re.findall(r"[\w-]+", text[end : end + CONTEXT // 2].lower()))
    context = -1 if around & AGAINST and not around & NEAR[kind] else 1 if around & NEAR[kind] else 0
    edge = -1 if text[start - 1 : start].isalnum() or text[end : end + 1].isalnum() else 1
    if kind == "email":
        parted = -1 if " " in s else 1
    elif kind == "ip":
        parted = -1 if any(len(p) > 1 and p[0] == "0" for p in s.split(".")) else 1
    else:
        parted = 1 if len(d) < len(s) else -1 if kind == "phone" else 0
    return shape, check, gazetteer, context, edge, parted


def length_class(n: int) -> int:
    return min(LENGTHS - 1, max(0, n.bit_length() - 2))


def features_of(text: str, start: int, end: int) -> tuple[int, ...]:
    """What the classifier sees of a span besides votes: length class, which marks are inside, what stands before and after."""
    s = text[start:end]
    before, after = text[start - 1 : start], text[end : end + 1]
    return length_class(end - start), int(s[0] == "+"), int(" " in s), int("." in s), int("-" in s), int("(" in s), int(not before or before.isspace()), int(not after or not after.isalnum())


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Base spans and wider ones, without repeats."""
    return list(dict.fromkeys([*base_spans(text), *wider_spans(text)]))


Pattern = tuple[str, tuple[int, ...], tuple[int, ...], int]


def patterns(docs: DataFrame) -> list[Pattern]:
    """(kind, votes, features, count) over the corpus: one bounded aggregate."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for (texts,) in columns(batches, "text"):
            for text in texts.to_pylist():
                if text and ANY.search(text):
                    seen.update((kind, votes(kind, text, a, b), features_of(text, a, b)) for kind, a, b in candidates(text))
        if seen:
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in seen]), pa.array([list(v) for _, v, _ in seen], ints), pa.array([list(f) for _, _, f in seen], ints), pa.array(seen.values(), pa.int64())], ["kind", "votes", "features", "n"])

    found = docs.select("text").mapInArrow(count, "kind string, votes array<int>, features array<int>, n long").groupBy("kind", "votes", "features").agg(F.sum("n").alias("n"))
    return sorted((r["kind"], tuple(r["votes"]), tuple(r["features"]), r["n"]) for r in found.collect())


def reliabilities(counts: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[list[dict], float, dict]:
    """Expectation-maximisation of one kind: P(vote | class) of each labeler, the prior, and posteriors."""
    post = {v: 0.05 if v[CHECK] < 0 else min(0.95, max(0.05, 0.5 + sum(v) / (2 * len(v)))) for v, _ in counts}
    tables: list[dict] = []
    prior = 0.5
    for _ in range(rounds):
        total = {y: sum(n * (post[v] if y else 1 - post[v]) for v, n in counts) for y in (0, 1)}
        prior = (total[1] + CLASS_PRIOR) / (total[0] + total[1] + 2 * CLASS_PRIOR)
        tables = []
        for k in range(LABELERS):
            prior_k = CHECK_PRIOR if k == CHECK else PRIOR
            tables.append({(y, vote): (sum(n * (post[v] if y else 1 - post[v]) for v, n in counts if v[k] == vote) + prior_k[y][vote + 1]) / (total[y] + sum(prior_k[y])) for y in (0, 1) for vote in (-1, 0, 1)})
        new = {}
        for v in post:
            logs = [math.log(prior if y else 1 - prior) + sum(math.log(t[y, v[k]]) for k, t in enumerate(tables)) for y in (0, 1)]
            new[v] = 1 / (1 + math.exp(min(700, logs[0] - logs[1])))
        moved = max((abs(new[v] - post[v]) for v in post), default=0)
        post = new
        if moved < 1e-9:
            break
    return tables, prior, post


def row_of(v: tuple[int, ...], features: tuple[int, ...]) -> list[float]:
    length, *flags = features
    return [1.0, *(float(x == s) for x in v for s in (-1, 1)), *(float(length == k) for k in range(LENGTHS)), *map(float, flags)]


def train(counted: list[Pattern], steps: int = 300, ridge: float = 0.1) -> dict[str, list[float]]:
    """The span classifier: for each kind logistic weights, by gradient steps on posteriors of all patterns."""
    models: dict[str, list[float]] = {}
    for kind in KINDS:
        own = [(v, f, c) for k, v, f, c in counted if k == kind]
        if not own:
            continue
        merged: Counter = Counter()
        for v, _, c in own:
            merged[v] += c
        _, _, post = reliabilities(list(merged.items()))
        total = sum(c for _, _, c in own)
        x = np.array([row_of(v, f) for v, f, _ in own])
        y, share = np.array([post[v] for v, _, _ in own]), np.array([c / total for _, _, c in own])
        weights = np.zeros(x.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(x @ weights)))
            weights -= (share * (p - y)) @ x + ridge * weights / total
        models[kind] = weights.tolist()
    return models


def accepts(models: dict[str, list[float]], kind: str, text: str, start: int, end: int) -> bool:
    x = row_of(votes(kind, text, start, end), features_of(text, start, end))
    return sum(p * q for p, q in zip(x, models[kind], strict=True)) > math.log(ACCEPT / (1 - ACCEPT))


def judged(counted: list[Pattern], models: dict[str, list[float]]) -> dict[str, tuple[int, int]]:
    """How many candidates of each kind the classifier accepts and rejects."""
    out: dict[str, tuple[int, int]] = {}
    for kind, v, f, n in counted:
        yes = sum(p * q for p, q in zip(row_of(v, f), models[kind], strict=True)) > math.log(ACCEPT / (1 - ACCEPT))
        a, r = out.get(kind, (0, 0))
        out[kind] = (a + n * yes, r + n * (not yes))
    return out


def all_spans(text: str | None, models: dict[str, list[float]]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and those with the accepted candidates, both by kind and start."""
    if not text or not ANY.search(text):
        return [], []
    base = base_spans(text)
    places: dict[str, list[tuple[int, int]]] = {}
    for kind, a, b in base:
        places.setdefault(kind, []).append((a, b))
    out = list(base)
    for kind, a, b in wider_spans(text):
        own = places.get(kind, [])
        # of its kind's base spans, the last that starts before the candidate's end
        k = bisect_left(own, (b, 0)) - 1
        if (k < 0 or own[k][1] <= a) and kind in models and accepts(models, kind, text, a, b):
            out.append((kind, a, b))
    place = KINDS.index
    return base, sorted(out, key=lambda s: (place(s[0]), s[1]))


def written(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and all spans as written strings, and the base's counts."""
    models = train(patterns(docs))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in columns(batches, "doc_id", "text"):
            found = [all_spans(t, models) for t in texts.to_pylist()]
            counts = [[sum(s[0] == k for s in base) for base, _ in found] for k in KINDS]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in counts), pa.array([written(b) for b, _ in found]), pa.array([written(a) for _, a in found])], ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    return docs.select("doc_id", "text").mapInArrow(find, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base string, spans string")


def masked(text: str | None, models: dict[str, list[float]]) -> str | None:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first, then the
    longest, gives the name, and all they cover goes."""
    found = sorted(((a, b, k) for k, a, b in all_spans(text, models)[1]), key=lambda s: (s[0], -s[1]))
    if not found:
        return text
    out, at, covered = [], 0, 0
    for a, b, k in found:
        if a >= covered:
            out += [text[at:a], f"[{k.upper()}]"]
        covered = at = max(covered, b)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with personal data masked; columns stay, n_chars follows the text where it changed."""
    models = train(patterns(docs))

    @F.pandas_udf("string")
    def mask(texts):
        import pandas as pd

        return pd.Series([masked(t, models) for t in texts], dtype=object)

    # under names of their own, so that no column of the input can clash
    both = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("own"), mask(docs["text"]).alias("new"))

    def column(name: str):
        if name == "text":
            return F.col("new").alias(name)
        if name == "n_chars":
            length = F.char_length("new").cast(docs.schema[name].dataType)
            return F.when(F.col("new").eqNullSafe(F.col("own.text")), F.col("own.n_chars")).otherwise(length).alias(name)
        return F.col(f"own.`{name}`").alias(name)

    return both.select(*map(column, docs.columns))
