"""Near-duplicates by exact Jaccard similarity of word-shingle sets: SimHash balls and MinHash bands propose pairs, the sets decide.

Pairs of the balls come from fieldloom.llm.simhash; no ball of feasible size holds J = 0.8, so bands propose what balls miss.
Every distinct set has 128 minima in 32 bands of 4: a pair at J = 0.8 shares a band but for 1 of 10^7 (0.7: 0.0002, 0.9: none).
With its bands' keys a set keeps a byte of each minimum, its sketch. Pairs are compared in two steps, so that a group of
many near copies gives few: in each bucket all members are compared with its smallest one; what these links connect is one
label, and then members of different labels are compared inside the bucket. A pair whose sketches agree in fewer than ALIKE
bytes (at J = 0.8 that is four deviations off: 2 of 10^5 pairs) goes no further; a pair becomes a link only if its
sets, hashed anew from the texts, have J >= THRESHOLD.

In the second step buckets of up to BLOCK members compare them with each other: sketches meet first, and sets are sent only to the
buckets in which their sketches have found somebody. Members of larger buckets are *crowded*: all of these, from all buckets, meet by the rarest of
their shared shingles instead (prefix filter). A set of n shingles, ordered by how many crowded sets hold them, shares one of its first n - 0.89 n + 1
with one of the first n - 0.8 n + 1 of every set at least as large that it is similar to, so only these meet, sketches first. What a crowd has in common comes last in
that order: documents around one passage whose other words keep them below the threshold never meet, however many they are. Shingles of one
label only order before all others and are never sent. Sets go to those groups alone in which they have somebody to be compared with; pairs never
leave a task, only the spanning forest of its links does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import columns, materialised, small_batches, utf8
from fieldloom.llm.components import connected_components

THRESHOLD, BANDS, ROWS = 0.8, 32, 4
ALIKE, BLOCK = 84, 64
#: Sets of one token that meet in one group.
CROWD = 4096
#: Shingles whose sets are compared in one go, and first tokens of a prefix that its rows carry.
PART, EARLIER = 1_000_000, 16
#: Shingles whose counts are sent to all tasks at most.
COUNTED = 2_000_000
#: Rows of an id each that are sent to all tasks at most.
BROADCAST_ROWS = 200_000
_RANDOM = np.random.default_rng(44)
_FLIPS, _FACTORS = (_RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64) for _ in range(2))
_FACTORS |= np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Shingles whose minima are taken at once.
CHUNK = 512

Batches = Iterator[pa.RecordBatch]


def row_id(docs: DataFrame) -> Column:
    """192 bits that name a row: 128 of its doc_id and text, so that rows that agree in these agree in both, and 64 of its other columns, of any type."""
    own = docs["doc_id"].cast("string")
    named = F.coalesce(F.concat(F.length(own).cast("string"), F.lit(":"), own), F.lit("-"))
    rest = [docs[c] for c in docs.columns if c not in ("doc_id", "text")]
    other = F.xxhash64(F.to_json(F.struct(*rest))) if rest else F.lit(0).cast("long")
    return F.unhex(F.concat(F.md5(F.concat(named, F.coalesce(F.concat(F.lit("="), docs["text"]), F.lit("-")))), F.lpad(F.hex(other), 16, "0")))


def minima(hashes: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        np.minimum(out, ((hashes[at : at + CHUNK, None] ^ _FLIPS) * _FACTORS).min(axis=0), out=out)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(n, 128) minima -> (n, 32) keys; a band's number is part of its keys."""
    x = signatures.reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), x.shape[:2])
    for k in range(ROWS):
        key = (key ^ x[..., k]) * _MIX
        key = key ^ (key >> np.uint64(31))
    return key


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    from fieldloom.llm.simhash import shingle_hashes, words_of

    return np.unique(shingle_hashes(words_of(text), n))


def prints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, row id, the number of the shingle set (`node`), its SimHash fingerprint, its bands' keys and its sketch, materialised."""
    from fieldloom.llm.simhash import fingerprint

    small_batches(docs.sparkSession)

    def make(batches: Batches) -> Batches:
        for ids, rids, texts in columns(batches, "doc_id", "rid", "text"):
            sets = [shingle_set(t, shingle) for t in utf8(texts)]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), 45) for s in sets], np.uint64).view(np.int64)
            fp = np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64)
            least = np.stack([minima(s) for s in sets])
            packed = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (band_keys(least), (least & np.uint64(255)).astype(np.uint8))]
            yield pa.RecordBatch.from_arrays([ids, rids, pa.array(node), pa.array(fp), *packed], ["doc_id", "rid", "node", "fp", "bands", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(docs["doc_id"], row_id(docs).alias("rid"), docs["text"])
    return materialised(rows.mapInArrow(make, f"doc_id {kind}, rid binary, node long, fp long, bands binary, sketch binary"))


def emit(batches: Batches) -> Batches:
    for nodes, bands in columns(batches, "node", "bands"):
        keys = np.frombuffer(b"".join(bands.to_pylist()), np.int64)
        own = np.repeat(nodes.to_numpy(zero_copy_only=False), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own)], ["key", "node"])


def stars(batches: Batches) -> Batches:
    """Rows sorted by key, node -> (key, u, v) of every member v but the first, u."""
    last, first = None, np.zeros(0, np.int64)
    for keys, nodes in columns(batches, "key", "node"):
        keys, nodes = (x.to_numpy(zero_copy_only=False) for x in (keys, nodes))
        new = np.concatenate([[keys[0] != last], keys[1:] != keys[:-1]])
        heads = np.concatenate([first, nodes[new]]) if not new[0] else nodes[new]
        u = heads[np.cumsum(new) - (1 if new[0] else 0)]
        hit = u != nodes
        last, first = keys[-1], u[-1:]
        if hit.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (keys, u, nodes)], ["key", "u", "v"])


def met(key: int, labels: np.ndarray, bands: np.ndarray, sketches: np.ndarray, k: int) -> np.ndarray:
    """The later rows of a bucket that row k should be compared with: other label, sketch alike, and no earlier band in common."""
    other = np.flatnonzero(labels[k + 1 :] != labels[k]) + k + 1
    other = other[(sketches[other] == sketches[k]).sum(axis=1) >= ALIKE]
    band = int(np.flatnonzero(bands[k] == key)[0])
    return other[~(bands[other, :band] == bands[k, :band]).any(axis=1)] if band and len(other) else other


def across(key: int, nodes: np.ndarray, labels: np.ndarray, bands: np.ndarray, sketches: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links of one bucket between different labels: a spanning forest, never all pairs. A pair that shares several buckets is
    compared in that of its first common band."""
    labels = labels.copy()
    for k in range(len(nodes) - 1):
        for j in met(key, labels, bands, sketches, k):
            if labels[j] != labels[k] and similarity(sets[k], sets[j]) >= THRESHOLD:
                labels[labels == labels[j]] = labels[k]
                yield int(nodes[k]), int(nodes[j])


def groups(batches: Batches, names: list[str], keys: int = 0) -> Iterator[tuple[int | tuple, list[tuple]]]:
    """Rows sorted by `key`, or by the first `keys` of `names` -> the other columns of each group. What runs on at a batch's end is carried over."""
    at, held = None, []
    for found in columns(batches, *(names if keys else ["key", *names])):
        rows = list(zip(*(x.to_pylist() for x in found), strict=True))
        for row in rows:
            now, rest = (row[:keys], row[keys:]) if keys else (row[0], row[1:])
            if now != at:
                if held:
                    yield at, list(zip(*held, strict=True))
                at, held = now, []
            held.append(rest)
    if held:
        yield at, list(zip(*held, strict=True))


def _matrix(values: tuple, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def wanted(batches: Batches) -> Batches:
    """Buckets' rows without sets -> (key, node) of the rows that have somebody to be compared with."""
    for key, (nodes, labels, bands, sketches) in groups(batches, ["node", "label", "bands", "sketch"]):
        labels, bands, sketches = np.array(labels), _matrix(bands, np.int64), _matrix(sketches, np.uint8)
        hit = np.zeros(len(nodes), bool)
        for k in range(len(nodes) - 1):
            if len(found := met(key, labels, bands, sketches, k)):
                hit[k] = hit[found] = True
        own = np.array(nodes)[hit]
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(own)), pa.array(own)], ["key", "node"])


def links_across(batches: Batches) -> Batches:
    """Buckets' rows with sets -> (u, v) of `across`."""
    for key, (nodes, labels, bands, sketches, sets) in groups(batches, ["node", "label", "bands", "sketch", "set"]):
        whole = [np.frombuffer(x, np.uint64) for x in sets]
        found = list(across(key, np.array(nodes), np.array(labels), _matrix(bands, np.int64), _matrix(sketches, np.uint8), whole))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["u", "v"])


def prefix_lengths(size: int) -> tuple[int, int]:
    """Of a set's shingles in any fixed order: how many have to be looked up in smaller sets, and how many have to be found by larger ones. Overlaps
    are whole numbers, so both are exact; the tolerance keeps rounding from making them too short."""
    look, found = (size - int(np.ceil(share * size - 1e-9)) + 1 for share in (THRESHOLD, 2 * THRESHOLD / (1 + THRESHOLD)))
    return min(look, size), min(found, size)


def exploded(batches: Batches) -> Batches:
    for nodes, labels, sets in columns(batches, "node", "label", "set"):
        for node, label, held in zip(nodes, labels, sets, strict=True):
            tokens = np.frombuffer(held.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(tokens), *(pa.repeat(x, len(tokens)) for x in (node, label))], ["token", "node", "label"])


def prefixes(batches: Batches) -> Batches:
    """(node, label, size, sketch, shared: array of (sets, token)) -> rows of the groups (token, one, two) in which the set looks for others, or may be found.
    Shingles that no other label has come first, so they use up the prefix and are not sent. Up to CROWD sets of a token are one
    group; of more, each part of those to be found meets each part of those that look in a group of its own. `place` is the token's in the
    prefix, `first` the EARLIER first tokens there."""
    for nodes, labels, sizes, sketches, shared in columns(batches, "node", "label", "size", "sketch", "shared"):
        for node, label, size, sketch, held in zip(nodes, labels, sizes.to_pylist(), sketches, shared.to_pylist(), strict=True):
            order = sorted((h["sets"], h["token"]) for h in held)
            look, found = (n - (size - len(order)) for n in prefix_lengths(size))
            rows = []
            for k, (sets, token) in enumerate(order[: max(0, look)]):
                parts = -(-sets // CROWD)
                own = node.as_py() % parts
                if parts == 1:
                    rows.append((token, 0, 0, True, k < found, k))
                else:
                    rows += [(token, p, own, True, False, k) for p in range(parts)]
                    rows += [(token, own, p, False, True, k) for p in range(parts)] if k < found else []
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int32())
                arrays = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                first = np.zeros(EARLIER, np.int64)
                first[: len(order)] = [token for _, token in order[:EARLIER]]
                same = [pa.repeat(x, len(rows)) for x in (node, label, pa.scalar(size, pa.int32()), sketch, pa.scalar(first.tobytes()))]
                names = ["token", "one", "two", "look", "found", "place", "node", "label", "size", "sketch", "first"]
                yield pa.RecordBatch.from_arrays([*arrays, *same], names)


MEMBER = "look boolean, found boolean, place int, node long, label long, size int, sketch binary, first binary"
MEMBER_KINDS = (pa.bool_(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())


class Members:
    """Sets that meet in one group."""

    def __init__(self, rows: dict[str, tuple]) -> None:
        self.look, self.found, self.place, self.node, self.label, self.size = (np.array(rows[k]) for k in ("look", "found", "place", "node", "label", "size"))
        self.sketch, self.first = _matrix(rows["sketch"], np.uint8), _matrix(rows["first"], np.int64)
        self.known = np.arange(EARLIER) < np.minimum(self.place, EARLIER)[:, None]

    def partners(self, k: int, labels: np.ndarray) -> np.ndarray:
        """Those that k, which looks, should be compared with: of other labels and similar size, sketches alike, and no earlier token in common,
        since there they have met already."""
        hit = np.flatnonzero(self.found & (labels != labels[k]) & (self.size <= self.size[k]) & (self.size >= THRESHOLD * self.size[k] - 1e-9))
        hit = hit[(self.sketch[hit] == self.sketch[k]).sum(axis=1) >= ALIKE]
        return hit[~(np.isin(self.first[hit], self.first[k][self.known[k]]) & self.known[hit]).any(axis=1)]


def meetings(batches: Batches) -> Batches:
    """Rows sorted by (key, token, one, two) -> the rows of those who have somebody to be compared with there, in parts (`part`) of up to PART shingles:
    pairs never leave a task."""
    names = ["token", "one", "two", *(x.split()[0] for x in MEMBER.split(", "))]
    for (token, one, two), rows in groups(batches, names, 3):
        members, part = Members(dict(zip(names[3:], rows, strict=True))), 0

        def sent(own: np.ndarray, part: int) -> pa.RecordBatch:
            at = np.flatnonzero(own)
            key = xxhash.xxh64_intdigest(np.array([token, one, two, part], np.int64).tobytes(), 46)
            kept = [pa.array([x[k] for k in at], kind) for x, kind in zip(rows, MEMBER_KINDS, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), key, np.uint64).view(np.int64)), *kept], ["key", *names[3:]])

        own, held = np.zeros(len(members.node), bool), 0
        for k in np.flatnonzero(members.look):
            hit = members.partners(k, members.label)
            for some in np.split(hit, np.flatnonzero(np.diff(np.cumsum(members.size[hit]) // PART)) + 1) if len(hit) else ():
                more = np.append(some, k)
                more = more[~own[more]]
                if own.any() and held + members.size[more].sum() > PART:
                    yield sent(own, part)
                    own, held, part = np.zeros(len(own), bool), 0, part + 1
                    more = np.append(some, k)
                own[more] = True
                held += int(members.size[more].sum())
        if own.any():
            yield sent(own, part)


def links_met(batches: Batches) -> Batches:
    """Rows sorted by key, with sets -> (u, v), a spanning forest of each part's links, never all pairs."""
    names = [*(x.split()[0] for x in MEMBER.split(", ")), "set"]
    for _, rows in groups(batches, names):
        members, sets = Members(dict(zip(names, rows, strict=True))), [np.frombuffer(x, np.uint64) for x in rows[-1]]
        labels, found = members.label.copy(), []
        for k in np.flatnonzero(members.look):
            for j in members.partners(k, labels):
                if labels[j] != labels[k] and similarity(sets[k], sets[j]) >= THRESHOLD:
                    labels[labels == labels[j]] = labels[k]
                    found.append((int(members.node[k]), int(members.node[j])))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["u", "v"])


def counted(whole: DataFrame) -> DataFrame:
    """(node, label, size, sketch, shared) of (node, label, sketch, set): the set's shingles that several labels have, with the number of sets that have
    them. Counts of up to COUNTED shingles (32 MB) are sent to all tasks; more are joined to the shingles."""
    tokens = whole.mapInArrow(exploded, "token long, node long, label long")
    common = tokens.groupBy("token").agg(F.count("*").alias("sets"), F.min("label").alias("a"), F.max("label").alias("b")).filter("a < b").select("token", "sets")
    common = materialised(common)
    if common.count() > COUNTED:
        held = tokens.select("token", "node").join(common, "token").groupBy("node").agg(F.collect_list(F.struct("sets", "token")).alias("shared"))
        return held.join(whole.select("node", "label", (F.octet_length("set") / 8).cast("int").alias("size"), "sketch"), "node")
    found = common.toArrow()
    order = np.argsort(found["token"].to_numpy())
    sent = whole.sparkSession.sparkContext.broadcast([found[c].to_numpy()[order] for c in ("token", "sets")])

    def look(batches: Batches) -> Batches:
        keys, numbers = sent.value
        for nodes, labels, sketches, sets in columns(batches, "node", "label", "sketch", "set"):
            own = [np.frombuffer(x.as_buffer(), np.int64) for x in sets]
            places = [np.searchsorted(keys, x) for x in own]
            places = [at[keys[at] == x[known]] for x, at, known in ((x, at[at < len(keys)], at < len(keys)) for x, at in zip(own, places, strict=True))]
            at = np.concatenate(places)
            shared = pa.StructArray.from_arrays([pa.array(numbers[at]), pa.array(keys[at])], ["sets", "token"])
            shared = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, places)]), pa.int32()), shared)
            yield pa.RecordBatch.from_arrays([nodes, labels, pa.array([len(x) for x in own], pa.int32()), sketches, shared], ["node", "label", "size", "sketch", "shared"])

    return whole.mapInArrow(look, "node long, label long, size int, sketch binary, shared array<struct<sets:long,token:long>>")


def crowd_groups(whole: DataFrame) -> DataFrame:
    """(node, label, sketch, set) -> (key, members' columns): the sets that have somebody of another label and alike sketch to be compared with, by the
    groups in which they are. Every pair with J >= THRESHOLD shares a key, and hardly another pair."""
    n = int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = counted(whole).mapInArrow(prefixes, f"token long, one int, two int, {MEMBER}")
    # All three deal the groups out; a group's rows are together after the sort.
    met = rows.repartition(n, "token", "one", "two").sortWithinPartitions("token", "one", "two")
    return materialised(met.mapInArrow(meetings, f"key long, {MEMBER}"))


def links_in_crowd(whole: DataFrame) -> DataFrame:
    """(u, v) of different labels with J >= THRESHOLD among (node, label, sketch, set), enough of them to connect all that such links connect.
    Sets meet by token, sketches first; then the sets themselves go to the groups in which they have somebody to be compared with."""
    n = int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = crowd_groups(whole).join(whole.select("node", "set"), "node").repartition(n, "key").sortWithinPartitions("key")
    return known.mapInArrow(links_met, "u long, v long")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Exact Jaccard similarity of two sorted sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def confirm(batches: Batches) -> Batches:
    for u, v, a, b in columns(batches, "u", "v", "a", "b"):
        sets = ((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(a, b, strict=True))
        hit = pa.array([similarity(x, y) >= THRESHOLD for x, y in sets], pa.bool_())
        yield pa.RecordBatch.from_arrays([u.filter(hit), v.filter(hit)], ["u", "v"])


def alike(batches: Batches) -> Batches:
    for u, v, a, b in columns(batches, "u", "v", "a", "b"):
        hit = pa.array((_matrix(tuple(a.to_pylist()), np.uint8) == _matrix(tuple(b.to_pylist()), np.uint8)).sum(axis=1) >= ALIKE)
        yield pa.RecordBatch.from_arrays([u.filter(hit), v.filter(hit)], ["u", "v"])


def both_ends(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """u, v with the value of each end as `a` and `b`."""
    one = pairs.join(values.select(F.col("node").alias("v"), F.col(name).alias("b")), "v")
    return one.join(values.select(F.col("node").alias("u"), F.col(name).alias("a")), "u").select("u", "v", "a", "b")


def links(docs: DataFrame, nodes: DataFrame, proposed: DataFrame, shingle: int) -> DataFrame:
    """(u, v) of distinct sets with J >= THRESHOLD, enough of them to connect all that such links connect.
    `nodes` has node, rid (a row that has the set), bands and sketch; pairs (u, v) that are `proposed` are compared together with those of the bands."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    balls = nodes.select("node", "bands").mapInArrow(emit, "key long, node long")
    shared = materialised(balls.repartition(n, "key").sortWithinPartitions("key", "node").mapInArrow(stars, "key long, u long, v long"))

    def hashed(batches: Batches) -> Batches:
        for node, texts in columns(batches, "node", "text"):
            yield pa.RecordBatch.from_arrays([node, pa.array([shingle_set(t, shingle).tobytes() for t in utf8(texts)], pa.binary())], ["node", "set"])

    def sets_of(asked: DataFrame) -> DataFrame:
        asked = materialised(nodes.select("node", "rid").join(asked, "node"))
        if asked.count() <= BROADCAST_ROWS:
            asked = F.broadcast(asked)
        texts = docs.select(row_id(docs).alias("rid"), docs["text"]).join(asked, "rid").dropDuplicates(["node"])
        return materialised(texts.select("node", "text").mapInArrow(hashed, "node long, set binary"))

    ends = lambda df: df.select(F.col("u").alias("node")).unionByName(df.select(F.col("v").alias("node"))).distinct()
    confirmed = lambda df, sets: materialised(both_ends(df, sets, "set").mapInArrow(confirm, "u long, v long"))
    proposed = proposed.unionByName(shared.select("u", "v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    pairs = materialised(both_ends(proposed, nodes, "sketch").mapInArrow(alike, "u long, v long"))
    first = confirmed(pairs, sets_of(ends(pairs)))
    labels = connected_components(first).select("node", F.col("component").alias("label"))
    # a bucket's smallest member has been compared with all others
    members = shared.select("key", F.col("v").alias("node")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    members = materialised(members)
    mixed = members.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("n")).filter("a < b")
    rows = materialised(members.join(mixed.select("key", "n"), "key"))
    small = rows.filter(F.col("n") <= BLOCK).select("key", "node", "label")
    known = small.join(nodes.select("node", "bands", "sketch"), "node").repartition(n, "key").sortWithinPartitions("key")
    asked = materialised(known.mapInArrow(wanted, "key long, node long"))
    crowded = materialised(rows.filter(F.col("n") > BLOCK).select("node", "label").distinct())
    sets = sets_of(asked.select("node").unionByName(crowded.select("node")).distinct())
    rest = small.join(asked, ["key", "node"]).join(nodes.select("node", "bands", "sketch"), "node").join(sets, "node")
    rest = rest.select("key", "node", "label", "bands", "sketch", "set").repartition(n, "key").sortWithinPartitions("key")
    in_small = rest.mapInArrow(links_across, "u long, v long")
    in_crowd = links_in_crowd(materialised(crowded.join(nodes.select("node", "sketch"), "node").join(sets, "node")))
    return first.unionByName(in_small).unionByName(in_crowd)
