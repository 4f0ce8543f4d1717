"""A Merkle manifest of a dataset as a content-addressed DAG: leaves, subroots, one root, and proofs by descent.

A group's leaves, in order, are the digits of a tree: nodes of two children are kept 1,024 leaves at a time, so a record maps the digest of a
segment's top to the up to 1,024 digests ten levels below it. A leaf asks from the root down: at each record its rank's next digit selects a
child, the unselected children on the way to it are collected, and the path's segments are reversed into the order from leaf to root.
Requests that share a prefix of digits descend as one, so no record is looked up by more than 1,024 requests and no group, however
large, meets in one task; a group of N leaves takes log(N) / log(1024) rounds. Texts are hashed where they are read and never shuffled.

Ranks come from one range sort by (group, order) and from counts of (group, part), as running sums over parts; sorted rows, records and
leaves are cut by checkpoint, so that a lost executor cannot change them.

Defined results: a null field is `-`; null ids order first and are not tampered with; rows equal in group and id order by leaf digest, equal rows are
leaves of their own; a null group is a group and comes first; n_chars of 2^63 - 1 is tampered to 2^63; empty tables give no
rows; columns other than the five fields do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import materialised, small_batches

#: Digits of ranks have so many bits: a record holds as many levels and up to 2^BITS children.
BITS = 10
WIDTH = 1 << BITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    """The digest of a leaf, lowercase hex."""
    return F.sha2(F.concat(*[encoded(f) for f in fields]), 256)


# ---------------------------------------------------------------- trees


def _digest(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(p.hex().encode() for p in parts)).digest()


def levels_of(children: list[bytes], height: int) -> list[list[bytes]]:
    """All levels of a segment, its children first."""
    levels = [children]
    for _ in range(height):
        below = levels[-1]
        levels.append([_digest(*below[k : k + 2]) for k in range(0, len(below), 2)])
    return levels


def _nodes(m: Column, level: int) -> Column:
    """Of m leaves, how many nodes there are at the bottom of so many whole segments."""
    return F.ceil(m / F.lit(1 << BITS * level).cast("decimal(38,0)")).cast("long")


def _height(m: Column, level: int) -> Column:
    """Levels in the segments of that level: all of them, or what the last segment needs."""
    n = _nodes(m, level)
    # The bits of n - 1 are the levels of n nodes.
    return F.when(n > WIDTH, F.lit(BITS)).otherwise(F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)).cast("int")


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with `rank` in their group (from 0) and its size `m`, whatever the sizes of groups: rows are range-sorted,
    numbered inside their part, and moved by what earlier parts hold of the group."""
    salt = F.monotonically_increasing_id()
    keys = [group, *order]
    placed = materialised(
        rows.withColumn("_salt", salt).repartitionByRange(*[F.col(k).asc_nulls_first() for k in [*keys, "_salt"]])
        .sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys]).drop("_salt").withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33))
    )
    counts = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_held"))
    of_group = Window.partitionBy(group)
    earlier = of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col(group).alias("_g"), F.col("_part").alias("_p"), (F.coalesce(F.sum("_held").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_held").over(of_group).alias("m")
    )
    return placed.join(starts, (F.col(group) == F.col("_g")) & (F.col("_part") == F.col("_p"))).withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_g", "_p", "_shift")


_SEGMENTS = "g string, m long, seg long, digest binary, height int, children array<binary>"


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        children = [[c["digest"] for c in sorted(held, key=lambda c: c["digit"])] for held in batch.column("held").to_pylist()]
        tops = [levels_of(c, h)[-1][0] for c, h in zip(children, batch.column("height").to_pylist(), strict=True)]
        arrays = [*(batch.column(k) for k in ("g", "m", "seg")), pa.array(tops, pa.binary()), batch.column("height"), pa.array(children, pa.list_(pa.binary()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["g", "m", "seg", "digest", "height", "children"])


@dataclass
class Tree:
    """Records by level, from the leaves up, and the tops (g, m, digest) of all groups."""

    levels: list[DataFrame]
    tops: DataFrame

    def records(self, level: int) -> DataFrame:
        """Records of a level by their address: equal contents are stored once."""
        return self.levels[level].select("digest", "height", "children").dropDuplicates(["digest", "height"])


def tree(nodes: DataFrame) -> Tree:
    """The trees over (g, m, rank, digest), a tree for each g."""
    levels, tops = [], []
    while True:
        level = len(levels)
        held = nodes.groupBy("g", "m", F.shiftright("rank", BITS).alias("seg")).agg(F.collect_list(F.struct(F.col("rank").bitwiseAND(WIDTH - 1).cast("int").alias("digit"), "digest")).alias("held"))
        segments = materialised(held.withColumn("height", _height(F.col("m"), level)).mapInArrow(_tops, _SEGMENTS))
        levels.append(segments)
        tops.append(segments.filter(_nodes(F.col("m"), level + 1) == 1).select("g", "m", "digest"))
        more = segments.filter(_nodes(F.col("m"), level + 1) > 1)
        if more.isEmpty():
            return Tree(levels, reduce(DataFrame.unionByName, tops))
        nodes = more.select("g", "m", F.col("seg").alias("rank"), "digest")


# ---------------------------------------------------------------- descent

_STEP = "g string, m long, top binary, seg long, digest binary, path array<binary>, payload {payload}"


def _descended(frontier: DataFrame, records: DataFrame, wanted: DataFrame, payload: str) -> DataFrame:
    """One digit down: of each frontier row (g, m, top, seg, digest, path, height) the wanted children, (digit, payload), with the children not
    selected added to their paths. A step of a path is a byte, 0 for no sibling, 1 for one on the left, 2 on the right, and the digest."""

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                levels = levels_of(batch.column("children")[i].as_py(), batch.column("height")[i].as_py())
                before, seg = batch.column("path")[i].as_py(), batch.column("seg")[i].as_py()
                held = batch.column("wanted")[i].values
                digits = held.field("digit").to_pylist()
                paths = []
                for digit in digits:
                    path = list(before)
                    for level in range(len(levels) - 2, -1, -1):
                        k = (digit >> level) ^ 1
                        path.append(b"\0" if k >= len(levels[level]) else (b"\2" if k & 1 else b"\1") + levels[level][k])
                    paths.append(path)
                n = len(digits)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.repeat(batch.column(k)[i], n) for k in ("g", "m", "top")), pa.array([seg * WIDTH + d for d in digits], pa.int64()),
                     pa.array([levels[0][d] for d in digits], pa.binary()), pa.array(paths, pa.list_(pa.binary())), held.field("payload")],
                    names=["g", "m", "top", "seg", "digest", "path", "payload"],
                )

    joined = frontier.join(wanted, ["g", "seg"]).join(records, ["digest", "height"])
    return joined.select("g", "m", "top", "seg", "path", "height", "children", "wanted").mapInArrow(down, _STEP.format(payload=payload))


def descent(trees: Tree, start: DataFrame, requests: DataFrame) -> DataFrame:
    """Paths of requests (g, rank, payload), rank by rank once, from the tops in start (g, m, digest, path) down: rows (g, m, top, seg = rank, digest, path,
    payload), the path from the top to the leaf. Each row carries its group's top, so nothing is joined by group in the end."""
    payload = requests.schema["payload"].dataType.simpleString()
    frontier = None
    for level in range(len(trees.levels) - 1, -1, -1):
        # Groups whose top segment is of this level join the descent here.
        here = start.filter((_nodes(F.col("m"), level + 1) == 1) & ((_nodes(F.col("m"), level) > 1) | F.lit(level == 0))).select("g", "m", F.col("digest").alias("top"), F.lit(0).cast("long").alias("seg"), "digest", "path")
        frontier = here if frontier is None else frontier.select("g", "m", "top", "seg", "digest", "path").unionByName(here)
        frontier = frontier.withColumn("height", _height(F.col("m"), level))
        if level:
            asked = requests.select("g", F.shiftright("rank", BITS * level).alias("rank"), F.lit(None).cast("int").alias("payload")).distinct()
        else:
            asked = requests
        wanted = asked.groupBy("g", F.shiftright("rank", BITS).alias("seg")).agg(F.collect_list(F.struct(F.col("rank").bitwiseAND(WIDTH - 1).cast("int").alias("digit"), "payload")).alias("wanted"))
        frontier = _descended(frontier, trees.records(level), wanted, "int" if level else payload)
    return frontier


# ---------------------------------------------------------------- the manifest


@dataclass
class Manifest:
    """leaves (g, m, rank, digest, payload), their trees, the tree over the subroots, and the root."""

    leaves: DataFrame
    trees: Tree
    upper: Tree
    root: str | None

    def proofs(self, requests: DataFrame | None = None) -> DataFrame:
        """For requests (g, rank, payload), all leaves unless given: (g, rank, leaf, subroot, path, payload); the path goes from leaf to root."""
        asked = self.leaves.select("g", "rank", "payload") if requests is None else requests
        subroots = ranked(self.trees.tops.select(F.lit("").alias("tree"), F.col("g").alias("lang"), "digest", F.col("m").alias("leaves")), "tree", ["lang"])
        top = self.upper.tops.select("g", "m", "digest", F.array().cast("array<binary>").alias("path"))
        to_subroots = descent(self.upper, top, subroots.select(F.col("tree").alias("g"), "rank", F.struct("lang", "leaves").alias("payload")))
        start = materialised(to_subroots.select(F.col("payload.lang").alias("g"), F.col("payload.leaves").alias("m"), "digest", "path"))
        found = descent(self.trees, start, asked)
        return found.select("g", F.col("seg").alias("rank"), F.col("digest").alias("leaf"), F.col("top").alias("subroot"), F.reverse("path").alias("path"), "payload")


def manifest(leaves: DataFrame) -> Manifest:
    """The manifest of leaves (g, order, digest, payload); g and order may hold no nulls of g."""
    placed = materialised(ranked(leaves, "g", ["order", "digest"]).select("g", "m", "rank", "digest", "payload"))
    trees = tree(placed)
    upper = tree(ranked(trees.tops.select(F.lit("").alias("g"), F.col("g").alias("lang"), "digest"), "g", ["lang"]))
    root = upper.tops.first()
    return Manifest(placed, trees, upper, root["digest"].hex() if root else None)


def fold(start: bytes, path: list[bytes]) -> bytes:
    """The root that a leaf and its path, from leaf to root, give."""
    for step in path:
        start = _digest(start) if step[0] == 0 else _digest(step[1:], start) if step[0] == 1 else _digest(start, step[1:])
    return start


_VERIFIED = "leaf string, subroot string, proof_sha256 string, folded_root string, payload {payload}"


def verified(documents: DataFrame, group: str = "lang") -> DataFrame:
    """Rows (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), the tampered leaf folded where there is one."""
    small_batches(documents.sparkSession)
    doc_id, source, lang, n_chars, text = (F.col(f) for f in FIELDS)
    tampered = leaf(doc_id, source, lang, n_chars.cast("decimal(20,0)") + 1, text)
    chosen = (F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0) & n_chars.isNotNull()
    leaves = documents.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"), doc_id.alias("order"), F.unhex(leaf(doc_id, source, lang, n_chars, text)).alias("digest"),
        F.struct(doc_id.alias("doc_id"), F.when(chosen, F.unhex(tampered)).alias("tampered")).alias("payload"),
    )
    found = manifest(leaves)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, paths = batch.column("leaf").to_pylist(), batch.column("path").to_pylist()
            changed = batch.column("payload").field("tampered").to_pylist()
            proofs = [_digest(*(s[1:] for s in p if s[0])).hex() for p in paths]
            roots = [fold(c or d, p).hex() for c, d, p in zip(changed, held, paths, strict=True)]
            hexes = [pa.array([d.hex() for d in held]), pa.array([d.hex() for d in batch.column("subroot").to_pylist()])]
            arrays = [*(pa.array(h, pa.string()) for h in hexes), pa.array(proofs, pa.string()), pa.array(roots, pa.string()), batch.column("payload")]
            yield pa.RecordBatch.from_arrays(arrays, names=["leaf", "subroot", "proof_sha256", "folded_root", "payload"])

    proofs = found.proofs()
    rows = proofs.mapInArrow(folded, _VERIFIED.format(payload=proofs.schema["payload"].dataType.simpleString()))
    root = F.lit(found.root).cast("string")
    return rows.select(F.col("payload.doc_id").alias("doc_id"), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
