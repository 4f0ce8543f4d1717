"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A document's fingerprint has a bit set where over half of its shingle hashes have it. Fingerprints within a radius
are found without comparing all: the 64 bits are cut into `BLOCKS` blocks, and for each choice of blocks that are
kept every distinct fingerprint, with the others masked, emits all variants within half the radius that is left (itself
and every one-bit flip). With a radius of 3, three blocks are kept: a pair has at most 2 differing bits in some three of
four blocks, so there its one-bit balls meet; with 5, two blocks are kept. Variants are shuffled; those that collide are
compared exactly.

A collision group holds distinct fingerprints only, a bounded number by construction (for radius 3 at most 49 * 2^16).
From each group a spanning forest of true links leaves the task, never all pairs, and components are found on
distinct fingerprints: copies of a text, however many, are one node.

`deduplicated` hashes balls of WIDE bits too, around fingerprints of shingle sets, and takes a pair from them as a link if its sketches are alike and its exact Jaccard
similarity is high enough. No ball of feasible size covers 0.8, so MinHash bands (fieldloom.llm.jaccard) propose the pairs that balls miss. A second fingerprint (`variants` and `links` of checked rows) is not used there.

Defined results: null and empty texts have fingerprint zero and are linked like any other; texts with fewer words
than a shingle hash their whole word sequence; ties (exactly half) leave a bit unset; repeated rows stay rows of
their own; a null doc_id belongs to its fingerprint's component but never names one unless all are null; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.llm import jaccard
from fieldloom.llm.common import columns, materialised, small_batches, utf8
from fieldloom.llm.components import connected_components

RADIUS, BLOCKS, SEED = 3, 4, 42
WIDE, CHECK, CHECK_SEED = 5, 14, 43
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cases A-Z and splits at ASCII white space only."""
    return text.lower().split() if text else []


def shingle_hashes(words: list[bytes], n: int, seed: int = SEED) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return np.array([digest(b" ".join(words), seed)], np.uint64)
    return np.fromiter((digest(b" ".join(s), seed) for s in zip(*(words[k:] for k in range(n)), strict=False)), np.uint64, len(words) - n + 1)


def fingerprint(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        counts += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def node_of(fp: np.ndarray, check: np.ndarray) -> np.ndarray:
    """One number for a pair of fingerprints."""
    x = (fp ^ (check << np.uint64(23)) ^ (check >> np.uint64(41))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def fingerprints(docs: DataFrame, shingle: int = 3, checked: bool = False) -> DataFrame:
    """doc_id, the fingerprint as a signed long, a second one (zero unless `checked`) and the number of their pair,
    materialised: texts are read once."""
    small_batches(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in columns(batches, "doc_id", "text"):
            words = [words_of(t) for t in utf8(texts)]
            fp = np.array([fingerprint(shingle_hashes(w, shingle)) for w in words], np.uint64)
            check = np.array([fingerprint(shingle_hashes(w, shingle, CHECK_SEED)) for w in words], np.uint64) if checked else np.zeros(len(fp), np.uint64)
            node = node_of(fp, check) if checked else fp
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x.view(np.int64)) for x in (fp, check, node))], ["doc_id", "fp", "check", "node"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return materialised(docs.select("doc_id", "text").mapInArrow(make, f"doc_id {kind}, fp long, check long, node long"))


def _ball(radius: int = RADIUS, blocks: int = BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    """Masks and flips: variant j of a fingerprint is (fp & masks[j]) ^ flips[j]. Of all choices of `keep` blocks the
    one with the fewest differing bits has at most radius * keep / blocks, which one-bit balls bridge up to 2."""
    keep = max(k for k in range(1, blocks) if radius * k // blocks <= 2)
    edges = [64 * b // blocks for b in range(blocks + 1)]
    masks, flips = [], []
    for kept in combinations(range(blocks), keep):
        bits = [i for b in kept for i in range(edges[b], edges[b + 1])]
        for flip in [0, *(1 << i for i in bits)]:
            masks.append(sum(1 << i for i in bits))
            flips.append(flip)
    return np.array(masks, np.uint64), np.array(flips, np.uint64)


Batches = Iterator[pa.RecordBatch]


def variants(radius: int = RADIUS, checked: bool = False) -> Callable[[Batches], Batches]:
    def emit(batches: Batches) -> Batches:
        masks, flips = _ball(radius)
        names = ["fp", "check"][: 1 + checked]
        for found in columns(batches, *names):
            found = [x.to_numpy(zero_copy_only=False).view(np.uint64) for x in found]
            for at in range(0, len(found[0]), 500):
                keys = (found[0][at : at + 500, None] & masks) ^ flips
                own = [np.repeat(x[at : at + 500], len(masks)) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(x.ravel().view(np.int64)) for x in (keys, *own)], ["key", *names])

    return emit


def near(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """Rows of one or two fingerprints that are linked."""
    hit = np.bitwise_count(x[..., 0] ^ y[..., 0]) <= radius
    return hit & (np.bitwise_count(x[..., 1] ^ y[..., 1]) <= CHECK) if x.shape[-1] > 1 else hit


def forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning forest of the links among distinct rows: every one is compared with those not yet reached only."""
    out, rest = [], fps
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            node = frontier.pop()
            hit = near(rest, node, radius)
            if hit.any():
                reached, rest = rest[hit], rest[~hit]
                out += [(node, x) for x in reached]
                frontier += list(reached)
    return out


def links(radius: int = RADIUS, checked: bool = False) -> Callable[[Batches], Batches]:
    """Key-sorted variants -> true links between nodes. What runs on at a batch's end is carried over."""

    def of(keys: np.ndarray, fps: np.ndarray) -> Batches:
        if not (keys[1:] == keys[:-1]).any():
            return
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        two = starts[sizes == 2]
        a, b = fps[two], fps[two + 1]
        hit = near(a, b, radius) & (a != b).any(axis=1)
        pairs = [np.stack([a[hit], b[hit]], axis=1)]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            if found := forest(np.unique(fps[s : s + n], axis=0), radius):
                pairs.append(np.array(found, np.uint64))
        both = np.concatenate(pairs)
        ends = (node_of(both[..., 0], both[..., 1]) if checked else both[..., 0]).view(np.int64)
        ends = np.unique(np.sort(ends, axis=1), axis=0)
        if len(ends):
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["u", "v"])

    def read(batches: Batches) -> Batches:
        names = ["fp", "check"][: 1 + checked]
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of one key, until the next begins
        for keys, *fps in columns(batches, "key", *names):
            keys = keys.to_numpy(zero_copy_only=False)
            fps = np.stack([x.to_numpy(zero_copy_only=False).view(np.uint64) for x in fps], axis=1)
            first = int(np.searchsorted(keys, keys[0], side="right"))
            if held and held[0][0][0] == keys[0]:
                held.append((keys[:first], fps[:first]))
                keys, fps = keys[first:], fps[first:]
                if not len(keys):
                    continue
            if held:
                yield from of(*map(np.concatenate, zip(*held, strict=True)))
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield from of(keys[:cut], fps[:cut])
            held = [(keys[cut:], fps[cut:])]
        if held:
            yield from of(*map(np.concatenate, zip(*held, strict=True)))

    return read


def ball_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v) of distinct fingerprints (`fp`) within the radius, enough of them to connect all that such links connect."""
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # distinct fingerprints are few bytes, so they would meet in few tasks, and each becomes many variants
    spread = prints.select("fp").repartition(n, "fp")
    balls = spread.mapInArrow(variants(radius), "key long, fp long")
    return balls.repartition(n, "key").sortWithinPartitions("key").mapInArrow(links(radius), "u long, v long")


def ball_pairs(nodes: DataFrame, radius: int = WIDE) -> DataFrame:
    """(u, v) of nodes to be checked: each node with the smallest one of its fingerprint, and those of each fingerprint with those of the smallest
    one that it is linked to. So there are no more pairs than nodes, however dense a ball is."""
    heads = materialised(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    least = ball_links(heads, radius).groupBy(F.greatest("u", "v").alias("fp")).agg(F.min(F.least("u", "v")).alias("near"))
    far = least.join(heads, "fp").select(F.col("head").alias("v"), F.col("near").alias("fp")).join(heads, "fp").select(F.col("head").alias("u"), "v")
    same = nodes.select("node", "fp").join(heads, "fp").filter("node <> head").select(F.col("head").alias("u"), F.col("node").alias("v"))
    return materialised(far.unionByName(same))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, checked: bool = False) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links reach. `checked`: pairs of shingle sets from balls of the radius and those
    from bands are links if fieldloom.llm.jaccard confirms them; instead of fp there are the shingle set's node and the row id."""
    if checked:
        prints = jaccard.prints(docs, shingle)
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("least")
        nodes = materialised(prints.groupBy("node").agg(least, *(F.any_value(c).alias(c) for c in ("fp", "bands", "sketch"))))
        edges = jaccard.links(docs, nodes.select("node", "least.rid", "bands", "sketch"), ball_pairs(nodes, radius), shingle)
        found = _named(prints, nodes, edges)
        return found.select("doc_id", "node", "rid", F.col("component_id.doc_id").alias("component_id"), F.col("component_id.rid").alias("kept"))
    prints = fingerprints(docs, shingle)
    nodes = prints.groupBy("node", "fp").agg(F.min("doc_id").alias("least"))
    return _named(prints, nodes, ball_links(nodes, radius)).select("doc_id", "fp", "component_id")


def _named(prints: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """prints with component_id, the least of their component's."""
    labels = connected_components(edges)
    named = nodes.select("node", "least").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialised(named)
    # written, so that the join below reads both sides as they are and can split a large component's rows
    ids = materialised(named.groupBy("component").agg(F.min("least").alias("component_id")))
    named = named.join(ids, "component").select("node", "component_id")
    return prints.join(named, "node")


def deduplicated(docs: DataFrame, shingle: int = 5, radius: int = WIDE) -> DataFrame:
    """The documents without near-duplicates: of each component one row stays, that of the smallest doc_id (null last). Rows
    are told apart by doc_id and text, not by doc_id alone; of rows that agree in both, one stays. Columns and
    their values are the input's."""
    kept = near_duplicates(docs, shingle, radius, checked=True).select(F.col("kept").alias("rid")).distinct()
    # under names of their own, so that no column of the input can clash
    named = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("own"), jaccard.row_id(docs).alias("rid"))
    # Rows that agree in the row id agree in all columns, so any of them may stay; the join has sorted them already.
    first = F.row_number().over(W.partitionBy("rid").orderBy("rid"))
    return named.join(kept, "rid", "left_semi").withColumn("place", first).filter("place = 1").select("own.*")
