"""Exact repeated passages by recompression.

Word sequences are recompressed in rounds: maximal runs of a symbol become one symbol, then every pair of a
"left" and a "right" symbol becomes one (a bit of each symbol's name decides its side anew in each round). Names are
fingerprints of what they stand for, so equal substrings get the same symbols but for a few at their ends, everywhere. Spark
rounds merge the names of all shards and answer with those that documents share:

 1. Low symbols, of the third round. With every one goes the range of words that determined it; those whose range fits in a
    window are reported (a window that holds none reports its first word), with the smallest and largest doc_id that has
    them. A window all of whose symbols other documents have is open; no other can repeat. High symbols, of all later rounds up
    to whole documents, are reported if they stand for a window or more. One that a smaller doc_id has too is a long
    repeat: its windows are covered.
 2. Open windows that no high symbol covers, by name: those at the ends of repeats, and all of the smallest doc_id
    that has them, which is never covered. The answer is the smallest doc_id of each.
 3. Words of windows that start in a smaller doc_id go. Where open windows and long repeats are, a shard has told itself in
    step 2, so symbols are not made once more and only documents that have any are read as words.

Step 1 only spares windows that cannot repeat or are known to, so every repeat of a window is found, in texts of any
length. Names have 64 bits, of high symbols and windows 96. A name is reported once a shard, however often it occurs there, and no
pair of documents is ever formed: a passage in a third of all documents costs a row for each shard. Shards are
groups of rows, by a hash of doc_id and text, of about SHARD_BYTES of text; texts are shuffled once and that exchange is
reused by all steps. Reports travel as arrays, one row for each shard and bucket; a bucket is what names of about BUCKET_BYTES of
text come to, and inside it a name meets its like in one sort.

Defined results: null and empty texts have no words; texts shorter than a window keep all; rows that share a
doc_id are one document (they do not remove from each other); a null doc_id counts as the largest; an empty table
gives no rows; other columns are ignored. doc_id is an integer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import small_batches, utf8

WINDOW, ROUNDS, SHARD_BYTES, BUCKET_BYTES = 13, 3, 6 << 20, 32 << 20
#: Rounds end when documents are one symbol each, or after so many without a change (a side is a coin).
STALL = 12
LOW, HIGH, PLACES, OWN = 1, 2, 3, 4
NO_ID = np.iinfo(np.int64).max
U = np.uint64
# Odd multipliers of the mixing functions.
M1, M2, M3 = U(0xD6E8FEB86659FD93), U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    for _ in range(2):
        x *= M1
        x ^= x >> U(32)
    return x


BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes of text that are hashed at once (a longer text is hashed whole).
CHUNK = 1 << 20


#: By number of bytes: what is kept of eight.
KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of a buffer start, and two hashes of each: up to 16 bytes are mixed as two numbers, longer words are hashed one by one."""
    blank = np.ones(len(raw) + 2, bool)
    blank[1:-1] = BLANK[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, size = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(raw) + 9, "<u8", raw + bytes(16), strides=(1,))
    letters = eight[starts] & KEPT[np.minimum(size, 8)]
    one, two = mix(letters + size.astype(U) * M2), mix((letters ^ M1) * M3 + size.astype(U))
    k = np.flatnonzero(size > 8)
    letters = eight[starts[k] + 8] & KEPT[np.minimum(size[k] - 8, 8)]
    one[k], two[k] = mix(one[k] * M3 + letters), mix(two[k] * M2 + letters)
    k = np.flatnonzero(size > 16)
    if len(k):
        whole = (xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(starts[k].tolist(), (starts[k] + size[k]).tolist(), strict=True))
        one[k], two[k] = np.frombuffer(b"".join(whole), U).reshape(-1, 2).T
    return starts, one, two


class Shard:
    """The documents of one shard: words as two hashes each, and where documents start."""

    def __init__(self, docs: pa.Table):
        self.ids = docs.column("doc_id").combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        self.texts = [t or b"" for t in utf8(docs.column("text"))]
        self.sizes = np.zeros(len(self.texts), np.int64)
        one, two, at = [np.zeros(0, U)], [np.zeros(0, U)], 0
        while at < len(self.texts):
            end, n = at, 0
            while end < len(self.texts) and (end == at or n + len(self.texts[end]) <= CHUNK):
                n += len(self.texts[end])
                end += 1
            starts, h1, h2 = word_hashes(b" ".join(self.texts[at:end]))
            place = np.concatenate([[0], np.cumsum([len(t) + 1 for t in self.texts[at:end]])])
            self.sizes[at:end] = np.diff(np.searchsorted(starts, place))
            one.append(h1)
            two.append(h2)
            at = end
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.h1, self.h2 = np.concatenate(one), np.concatenate(two)
        self.doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.sizes)

    def places(self, window: int) -> np.ndarray:
        """Starts of all windows inside documents."""
        n = max(0, len(self.doc) - window + 1)
        return np.flatnonzero(self.doc[:n] == self.doc[window - 1 : n + window - 1])

    def names(self, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Two names of the windows that start there."""
        if 4 * len(at) > len(self.doc):
            return mix(rolling(self.h1, M2, window)[at]), half(mix(rolling(self.h2, M3, window)[at]))
        a, b = np.zeros(len(at), U), np.zeros(len(at), U)
        for k in range(window):
            a, b = a * M2 + self.h1[at + k], b * M3 + self.h2[at + k]
        return mix(a), half(mix(b))


def rolling(h: np.ndarray, m: np.uint64, window: int) -> np.ndarray:
    """The polynomial of every `window` numbers in a row, by doubling: that of a + b numbers is the first's times m ** b and the second's."""
    part, width, power = h, 1, np.full(1, m)
    whole, size, scale = None, 0, np.ones(1, U)
    while True:
        if window & 1:
            whole = part if whole is None else part[: len(whole) - width] * scale + whole[width:]
            size, scale = size + width, scale * power
        window >>= 1
        if not window:
            return whole
        part, width, power = part[:-width] * power + part[width:], 2 * width, power * power


def half(x: np.ndarray) -> np.ndarray:
    """32 of 64 bits, signed."""
    return (x >> U(32)).astype(np.uint32).view(np.int32)


class Symbols:
    """A shard's documents as symbols: name, the words [start, end) it stands for, its document, and the words [low, high) that
    determined it (as long as `ranges` are kept). `long` are the symbols of a window or more that `made` has met."""

    def __init__(self, s: Shard, docs: np.ndarray | None = None, ranges: bool = True):
        at = np.arange(len(s.doc), dtype=np.int32) if docs is None else np.flatnonzero(docs[s.doc]).astype(np.int32)
        self.words, self.round, self.ranges = s.h1, 0, ranges
        self.name, self.start, self.end, self.doc = mix(s.h1[at]), at, at + 1, s.doc[at]
        self.low, self.high = self.start, self.end
        self.long: list[tuple[np.ndarray, ...]] = []

    def made(self, window: int) -> bool:
        """One more round; whether it has made any symbol."""
        new = self.next()
        k = np.flatnonzero(new & (self.end - self.start >= window))
        self.long.append((self.name[k], self.start[k], self.end[k], self.doc[k]))
        return bool(new.any())

    def only(self, docs: np.ndarray) -> None:
        """Leaves the symbols of the marked documents, without ranges: names do not depend on other documents."""
        self.ranges = False
        if not docs.all():
            k = docs[self.doc]
            self.name, self.start, self.end, self.doc = (x[k] for x in (self.name, self.start, self.end, self.doc))
            self.long = [tuple(x[docs[found[3]]] for x in found) for found in self.long]

    def next(self) -> np.ndarray:
        """One more round; which symbols it has made.

        A run's extent depends on its neighbours being different, which the one word next to it shows unless
        that word is the same; an unpaired symbol depends on its neighbour's side, so on all that determined the neighbour.
        """
        self.round += 1
        name, start, end, low, high, doc, words = self.name, self.start, self.end, self.low, self.high, self.doc, self.words
        if not len(name):
            return np.zeros(0, bool)
        salt = mix(np.full(1, self.round, U))
        same = doc[1:] == doc[:-1]
        first = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | ~same]))
        last = np.append(first[1:], len(name)) - 1
        made = last > first
        k = np.flatnonzero(made)
        name = name[first]
        name[k] = mix(name[k] + mix((last[k] - first[k] + 1).astype(U) * M2 + salt))
        if self.ranges:
            low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
        start, end, doc = start[first], end[last], doc[first]
        inside = doc[1:] == doc[:-1]
        if self.ranges:
            wide_low, wide_high = np.minimum(low, start - 1), np.maximum(high, end + 1)
            k = np.flatnonzero(inside & (words[end[:-1] - 1] == words[end[1:] - 1])) + 1
            wide_low[k] = np.minimum(wide_low[k], low[k - 1])
            k = np.flatnonzero(inside & (words[start[:-1]] == words[start[1:]]))
            wide_high[k] = np.maximum(wide_high[k], high[k + 1])
            low, high = wide_low, wide_high
        salted = mix(name + salt)
        right = salted >> U(63) == 1
        after, before = np.append(inside, False), np.concatenate([[False], inside])
        head = ~right & np.append(right[1:], False) & after
        tail = np.concatenate([[False], head[:-1]])
        k = np.flatnonzero(head)
        if self.ranges:
            new_low, new_high = low.copy(), high.copy()
            j = np.flatnonzero(~right & ~head)
            new_high[j] = np.where(after[j], np.maximum(high[j], high[np.minimum(j + 1, len(high) - 1)]), end[j] + 1)
            j = np.flatnonzero(right & ~tail)
            new_low[j] = np.where(before[j], np.minimum(low[j], low[np.maximum(j - 1, 0)]), start[j] - 1)
            new_high[k] = high[k + 1]
            self.low, self.high = new_low[~tail], new_high[~tail]
        new_name, new_end = name.copy(), end.copy()
        new_name[k] = mix(name[k] * M3 + salted[k + 1])
        new_end[k] = end[k + 1]
        self.name, self.start, self.end, self.doc = new_name[~tail], start[~tail], new_end[~tail], doc[~tail]
        return (made | head)[~tail]


def low_symbols(s: Shard, window: int = WINDOW, rounds: int = ROUNDS, x: Symbols | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names, ranges [low, high) and documents of the symbols whose range fits in a window of their document; a window that
    holds none has its first word, with all of the window as its range. `x`, the words at first, is left at that round."""
    x = x or Symbols(s)
    for _ in range(rounds):
        x.made(window)
    fits = (x.high - x.low <= window) & (x.low >= s.starts[x.doc]) & (x.high <= s.starts[x.doc + 1])
    name, low, high, doc = x.name[fits], x.low[fits], x.high[fits], x.doc[fits]
    place = s.places(window)
    bare = place[~_marked(np.maximum(high - window, 0), low + 1, len(s.doc))[place]]
    return tuple(np.concatenate(p) for p in ((name, mix(s.h1[bare] + M1)), (low, bare), (high, bare + window), (doc, s.doc[bare])))


def high_symbols(s: Shard, docs: np.ndarray, window: int = WINDOW, x: Symbols | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names, second names and words [start, end) of all symbols of a window or more, of the documents marked in `docs`. Goes on from `x`."""
    if x is None:
        x = Symbols(s, docs, ranges=False)
    x.only(docs)
    n, stalled = len(np.unique(x.doc)), 0
    while len(x.name) > n and stalled < STALL:
        stalled = 0 if x.made(window) else stalled + 1
    if not x.long:
        return np.zeros(0, U), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    name, start, end, _ = map(np.concatenate, zip(*x.long, strict=True))
    return name, half(mix(s.h2[start] + M1 * s.h2[end - 1] + M2 * (end - start).astype(U))), start, end


def _marked(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Places inside any of the ranges [start, end)."""
    return np.cumsum(np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(ends, n), minlength=n + 1)[: n + 1])[:n] > 0


REPORT = "bucket int, shard int, kind int, high array<int>, low array<int>, more array<int>, lows array<long>, highs array<long>"


def cut(name: np.ndarray) -> np.ndarray:
    """The part of a low symbol's name that travels; two names that agree in it only open a window in vain."""
    return name >> U(16)


def buckets_of(spark: SparkSession, n: int) -> np.ndarray:
    """A number for each of n partitions that Spark's hash deals there, so that every partition has one bucket."""
    place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
    found = spark.range(n * (20 + n.bit_length())).groupBy(place.alias("place")).agg(F.min("id").alias("id")).collect()
    return np.array([r["id"] for r in sorted(found, key=lambda r: r["place"])], np.int32)


def report(shard: int, kind: int, name: np.ndarray, more: np.ndarray, ids: np.ndarray, buckets: np.ndarray) -> pa.Table:
    """Distinct names of a shard with their smallest and largest doc_id, dealt to buckets by name. (Of two names alike in the first
    integer only, rows may be written apart; they meet again in `merge`.)"""
    order = np.argsort(name)
    name, more, ids = name[order], more[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (more[1:] != more[:-1])])) if len(name) else np.zeros(0, np.int64)
    low, high = (np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)) if len(first) else (ids, ids)
    name, more = name[first], more[first]
    bucket = ((name >> U(16 if kind == LOW else 32)) * U(len(buckets)) >> U(32)).astype(np.int32)
    # by document inside a bucket: equal ids side by side hardly take room
    order = np.argsort(low, kind="stable")
    order = order[np.argsort(bucket[order], kind="stable")]
    name, more, low, high, bucket = (x[order] for x in (name, more, low, high, bucket))
    cuts = np.searchsorted(bucket, np.arange(len(buckets) + 1))
    used = np.flatnonzero(np.diff(cuts))
    offsets = pa.array(np.append(cuts[used], len(name)), pa.int32())
    # names travel as integers of 32 bits; a low symbol has 48 in all
    shift = U(16 if kind == LOW else 32)
    upper, lower = ((name >> shift) & U(0xFFFFFFFF)).astype(np.uint32).view(np.int32), (name & ((U(1) << shift) - U(1))).astype(np.uint32).view(np.int32)
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (upper, lower, more, low, high)]
    same = [pa.array(np.full(len(used), k), pa.int32()) for k in (shard, kind)]
    return pa.table([pa.array(buckets[used], pa.int32()), *same, *lists], names=[c.split()[0] for c in REPORT.split(", ")])


def own_report(shard: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], buckets: np.ndarray) -> pa.Table:
    """What a shard tells itself: (row, first word, number) of runs of windows, one row in all."""
    columns = [np.concatenate([p[k] for p in parts]) for k in range(3)]
    fixed = [pa.array([x], pa.int32()) for x in (buckets[shard % len(buckets)], shard, OWN)]
    lists = [pa.array([x], pa.list_(kind)) for x, kind in zip((*columns, columns[0], columns[0]), (pa.int32(),) * 3 + (pa.int64(),) * 2, strict=True)]
    return pa.table([*fixed, *lists], names=[c.split()[0] for c in REPORT.split(", ")])


ANSWER = "shard int, kind int, high array<int>, low array<int>, more array<int>, flags array<tinyint>"


def merge(reports: pa.Table) -> pa.Table:
    """One bucket's reports -> for each shard the names that it has reported and that several documents have, as three integers. A flag's first
    bit says that another shard has a smaller doc_id, its second bit that one has a larger. What a shard tells itself passes."""
    names = [c.split()[0] for c in ANSWER.split(", ")]
    types = (pa.int32(),) * 3 + (pa.int8(),)
    out = []
    for kind in pc.unique(reports.column("kind")).to_pylist():
        rows = reports.filter(pc.equal(reports.column("kind"), kind)).combine_chunks()
        high, low, more, lows, highs = (pa.concat_arrays(rows.column(c).chunks).flatten().to_numpy() for c in ("high", "low", "more", "lows", "highs"))
        row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows.column("high")).to_numpy())
        flags = np.zeros(len(high), np.int8)
        if kind != OWN and len(high):
            name = high.view(np.uint32).astype(U) << U(32) | low.view(np.uint32).astype(U)
            order = np.argsort(name)
            same = name[order][1:] == name[order][:-1]
            if (same & (more[order][1:] != more[order][:-1])).any():
                order = np.lexsort((more, name))
                same = (name[order][1:] == name[order][:-1]) & (more[order][1:] == more[order][:-1])
            first = np.flatnonzero(np.concatenate([[True], ~same]))
            number = np.diff(np.append(first, len(order)))
            lows, highs = lows[order], highs[order]
            least, most = np.repeat(np.minimum.reduceat(lows, first), number), np.repeat(np.maximum.reduceat(highs, first), number)
            # of high symbols and windows, only those that some document of the shard has after another: others lose nothing there
            k = np.flatnonzero(least < (most if kind == LOW else highs))
            flags = ((least < lows) + 2 * (most > highs)).astype(np.int8)[k]
            k, own = order[k], np.argsort(row[order[k]], kind="stable")
            row, flags, k = row[k][own], flags[own], k[own]
            high, low, more = high[k], low[k], more[k]
        cuts = np.searchsorted(row, np.arange(rows.num_rows + 1))
        used = np.flatnonzero(np.diff(cuts))
        offsets = pa.array(np.append(cuts[used], len(row)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in zip((high, low, more, flags), types, strict=True)]
        out.append(pa.table([rows.column("shard").take(pa.array(used)), pa.array(np.full(len(used), kind), pa.int32()), *lists], names=names))
    return pa.concat_tables(out)


def merged(reports: DataFrame, n: int) -> DataFrame:
    """The answers to reports, for each shard and bucket."""
    return reports.repartition(n, "bucket").groupBy("bucket").applyInArrow(merge, ANSWER)


class Answers:
    """Names that other documents share, with what they say about them."""

    def __init__(self, table: pa.Table, kind: int):
        rows = table.filter(pc.equal(table.column("kind"), kind)) if table.num_rows else table

        def flat(c: str, dtype: type) -> np.ndarray:
            chunks = rows.column(c).chunks
            return pa.concat_arrays(chunks).flatten().to_numpy(zero_copy_only=False) if chunks else np.zeros(0, dtype)

        high, low, more, flags = flat("high", np.int32), flat("low", np.int32), flat("more", np.int32), flat("flags", np.int8)
        names = (high.view(np.uint32).astype(U) << U(16 if kind == LOW else 32)) | low.view(np.uint32).astype(U)
        order = np.argsort(names, kind="stable")
        self.names, self.more, self.flags = names[order], more[order], flags[order]

    def find(self, name: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
        """The place of each name, -1 where it is not shared; names alike but for their second half stand side by side."""
        out, at = np.full(len(name), -1), np.searchsorted(self.names, name)
        todo = np.arange(len(name))
        while len(todo):
            todo = todo[at[todo] < len(self.names)]
            todo = todo[self.names[at[todo]] == name[todo]]
            hit = np.ones(len(todo), bool) if more is None else self.more[at[todo]] == more[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit]
            at[todo] += 1
        return out

    def neighbours(self, place: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a smaller, and whether a larger doc_id has the name at a place, for each document's own id: in other shards the
        flags say so, in this one the ids themselves."""
        smaller, larger = np.zeros(len(place), bool), np.zeros(len(place), bool)
        known = np.flatnonzero(place >= 0)
        at, ids = place[known], own[known]
        low, high = np.full(len(self.names), NO_ID), np.full(len(self.names), np.iinfo(np.int64).min)
        np.minimum.at(low, at, ids)
        np.maximum.at(high, at, ids)
        smaller[known], larger[known] = (low[at] < ids) | (self.flags[at] & 1 > 0), (high[at] > ids) | (self.flags[at] & 2 > 0)
        return smaller, larger


def open_windows(s: Shard, answers: pa.Table, window: int, x: Symbols | None = None) -> np.ndarray:
    """Marks the starts of windows that may repeat: symbols of theirs are known, and other documents have all of them."""
    shared = Answers(answers, LOW)
    name, low, high, doc = low_symbols(s, window, ROUNDS, x)
    place = shared.find(cut(name))
    known = place >= 0
    source, use = shared.neighbours(place, s.ids[doc])
    n = len(s.doc)
    first, end = np.maximum(high - window, 0), low + 1
    closed = _marked(first[~source], end[~source], n) & _marked(first[~use], end[~use], n)
    inside = np.zeros(n, bool)
    inside[s.places(window)] = True
    return inside & _marked(first[known], end[known], n) & ~closed


def long_repeats(s: Shard, answers: pa.Table, docs: np.ndarray, window: int, x: Symbols | None = None) -> np.ndarray:
    """Marks the starts of windows inside high symbols that a smaller doc_id has too."""
    shared = Answers(answers, HIGH)
    if not len(shared.names):
        return np.zeros(len(s.doc), bool)
    name, more, start, end = high_symbols(s, docs, window, x)
    hit, _ = shared.neighbours(shared.find(name, more), s.ids[s.doc[start]])
    return _marked(start[hit], end[hit] - window + 1, len(s.doc))


def in_order(rows: pa.Table) -> pa.Table:
    """A shard's rows in the same order whenever they are read; rows that agree in both columns are alike."""
    return rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def runs(s: Shard, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word in it and length of each run of marks inside a document."""
    at = np.flatnonzero(marks)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (s.doc[at[1:]] != s.doc[at[:-1]])])) if len(at) else at
    doc = s.doc[at[new]]
    return doc, at[new] - s.starts[doc], np.diff(np.append(new, len(at)))


def told(answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs that the shard has told itself, by document: open windows have a negative length."""
    own = Answers(answers, OWN)
    return (own.names >> U(32)).astype(np.int64), (own.names & U(0xFFFFFFFF)).astype(np.int64), own.more.astype(np.int64)


def covered(s: Shard, answers: pa.Table, start: np.ndarray, number: np.ndarray, window: int) -> np.ndarray:
    """Words covered by windows that start in a smaller doc_id: those of the runs that are long repeats, and open windows that are known to be."""
    n = len(s.doc)
    hit = _marked(start[number > 0], (start + number)[number > 0], n)
    shared = Answers(answers, PLACES)
    if len(shared.names):
        at = np.flatnonzero(_marked(start[number < 0], (start - number)[number < 0], n))
        hit[at], _ = shared.neighbours(shared.find(*s.names(at, window)), s.ids[s.doc[at]])
    at = np.flatnonzero(hit)
    return _marked(at, at + window, n)


def repeats(docs: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the removed spans in words (span_starts, span_ends) of each
    row; with_text adds `kept`, the words that stay, joined by single spaces."""
    spark = docs.sparkSession
    small_batches(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_bytes))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // BUCKET_BYTES))
    buckets = buckets_of(spark, n)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("shard"))

    def first(key: tuple, rows: pa.Table) -> pa.Table:
        s = Shard(rows)
        x = Symbols(s)
        name, _, _, doc = low_symbols(s, window, ROUNDS, x)
        low = report(key[0].as_py(), LOW, cut(name), np.zeros(len(name), np.int32), s.ids[doc], buckets)
        name, more, start, _ = high_symbols(s, np.ones(len(s.ids), bool), window, x)
        return pa.concat_tables([low, report(key[0].as_py(), HIGH, name, more, s.ids[s.doc[start]], buckets)])

    def second(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        s = Shard(in_order(rows))
        x = Symbols(s)
        wide = open_windows(s, answers, window, x)
        docs = np.bincount(s.doc[wide], minlength=len(s.ids)) > 0
        long = long_repeats(s, answers, docs, window, x)
        wide &= ~long
        at = np.flatnonzero(wide)
        name, more = s.names(at, window)
        doc, start, number = runs(s, wide)
        own = own_report(key[0].as_py(), [runs(s, long), (doc, start, -number)], buckets)
        return pa.concat_tables([own, report(key[0].as_py(), PLACES, name, more, s.ids[s.doc[at]], buckets)])

    def last(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows = in_order(rows)
        doc, start, number = told(answers)
        some = np.zeros(rows.num_rows, bool)
        some[doc] = True
        place = np.cumsum(some) - 1
        s = Shard(rows.filter(pa.array(some)))
        gone = covered(s, answers, start + s.starts[place[doc]], number, window)
        out: list[list] = [[] for _ in range(6)]
        for text, known, k in zip(utf8(rows.column("text")), some.tolist(), place.tolist(), strict=True):
            words = (text or b"").split()
            g = gone[s.starts[k] : s.starts[k + 1]] if known else np.zeros(0, bool)
            removed = int(g.sum())
            kept = b" ".join([w for w, x in zip(words, g.tolist(), strict=True) if not x] if removed else words)
            edges = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8)))
            for column, value in zip(out, (len(words), removed, hashlib.sha256(kept).hexdigest(), edges[::2].tolist(), edges[1::2].tolist(), kept if with_text else None), strict=True):
                column.append(value)
        types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        arrays = [rows.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, types, strict=False))]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "span_starts", "span_ends"]
        if with_text:
            arrays, names = [*arrays, pa.array(out[5], pa.binary()).cast(pa.string())], [*names, "kept"]
        return pa.table(arrays, names=names)

    def answered(make: Callable[..., pa.Table], answers: DataFrame, schema: str) -> DataFrame:
        return base.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(make, schema)

    symbols = base.groupBy("shard").applyInArrow(first, REPORT)
    places = merged(answered(second, merged(symbols, n), REPORT), n)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, span_starts array<long>, span_ends array<long>" + (", kept string" if with_text else "")
    return answered(last, places, schema)
