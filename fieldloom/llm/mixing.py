"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source sends its documents in a shuffled order, again and again up to `repeats` passes, in packets of at most
PACKET words. A packet's virtual finish time is the words that its source has sent by its end, over the target words
of that source; a document finishes with its last packet. The mix is all packets in the order of virtual finish time,
truncated where the total budget is spent; the packet that runs across the budget is cut at the word.

The shuffle is the MD5 of seed, doc_id and the text's MD5, so reruns agree. Rows that agree in source, doc_id and text are counted
first, so that no repeated row or null id is a hot key. Running sums take two levels: by (source, leading hash digits),
then inside such a cell; the number of digits follows the number of rows, the result does not.

The global order needs no single sorted run: packets are range-partitioned by virtual finish time into RANGES equal
ranges, totals of ranges show in which one the budget ends, that range is cut into RANGES again, and only the packets of
this last range are sorted. What comes out is one cut: a place in the global order, up to which every row takes its words.

Defined results: null texts and texts of white space have size 0 and take 0; a null doc_id hashes as the
empty string; a null source is a source of its own, last in order; repeated rows are entries of their own
(copies of a row follow each other); an empty table gives no rows; other columns of the input, whatever their names, are
ignored by `schedule` and `mix`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.llm.common import materialised

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
PACKET = 128
RANGES = 4096
#: Rows that one cell of a source should hold, and copies of one row that are written at once.
CELL_ROWS, COPIES = 100_000, 10_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def shuffle_key(doc_id: Column, text: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def placed(totals: DataFrame) -> DataFrame:
    """Adds `place`, from 0, of each source in code-point order, null last: counts of range partitions, then places inside."""
    order = F.col("source").asc_nulls_last()
    parts = materialised(totals.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    counts = {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect()}
    ahead, offsets = 0, []
    for part in range(max(counts, default=-1) + 1):
        offsets.append(ahead)
        ahead += counts.get(part, 0)
    own = F.row_number().over(W.partitionBy("part").orderBy(order)) - 1
    before = F.get(F.array(*map(F.lit, offsets)).cast("array<long>"), F.col("part"))
    return parts.withColumn("place", before + own).drop("part")


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """(source, source_size) -> also `target` words.

    The level is the words for each unit of weight that sources below their bound get. Sources that it lifts above their
    bound are held there and the rest is shared anew, by aggregates, until none is above.
    """
    x = placed(totals)
    x = x.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long"))
    x = materialised(x.withColumn("bound", F.col("source_size") * F.lit(repeats)).withColumn("ratio", F.col("bound") / F.col("w")))
    total = x.agg(F.sum("source_size")).first()[0] or 0
    level, held = -1.0, None
    while True:
        free = F.col("ratio") >= F.lit(level)
        r = x.agg(F.sum(F.when(~free, F.col("bound"))).alias("bound"), F.sum(F.when(free, F.col("w"))).alias("w"), F.count(F.when(~free, 1)).alias("n")).first()
        if r["n"] == held or not r["w"]:
            break
        held, level = r["n"], (share * total - (r["bound"] or 0)) / r["w"]
    below = F.lit(level) < F.col("ratio")
    return x.select("source", "source_size", F.when(below, F.lit(level) * F.col("w")).otherwise(F.col("bound")).cast("double").alias("target"))


def _queued(docs: DataFrame, weights: tuple[int, ...], share: float, repeats: int, seed: int) -> DataFrame:
    """doc_id, source, size, key, copy, source_size, target and `before`: the words that its source sends before it in a pass."""
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), shuffle_key(F.col("doc_id"), F.col("text"), seed).alias("key"))
    sized = materialised(sized.groupBy("source", "doc_id", "key", "size").agg(F.count("*").alias("n")))
    digits = max(3, math.ceil(math.log(max(1, sized.count() / CELL_ROWS), 16)))
    sized = sized.withColumn("cell", F.substring("key", 1, digits))
    words = F.col("size") * F.col("n")
    cells = materialised(sized.groupBy("source", "cell").agg(F.sum(words).alias("cell_size")))
    by_source = targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, share, repeats)
    ahead = W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("source", "cell", F.coalesce(F.sum("cell_size").over(ahead), F.lit(0)).alias("cell_before"))
    cells = cells.alias("c").join(by_source.alias("s"), same("c.source", "s.source")).select("c.source", "c.cell", "c.cell_before", "s.source_size", "s.target")
    inside = W.partitionBy("source", "cell").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    sized = sized.withColumn("in_cell", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    x = sized.alias("d").join(cells.alias("c"), same("c.source", "d.source") & (F.col("d.cell") == F.col("c.cell")))
    x = x.select("d.doc_id", "d.source", "d.size", "d.key", "d.n", "c.source_size", "c.target", (F.col("cell_before") + F.col("in_cell")).alias("before"))
    # copies of a row, in two steps: those of a very frequent row are dealt to all tasks
    x = x.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)))).repartition("key", "lot")
    first, last = F.col("lot") * COPIES, F.least(F.col("n"), (F.col("lot") + 1) * COPIES) - 1
    x = x.withColumn("copy", F.explode(F.sequence(first, last))).withColumn("before", F.col("before") + F.col("copy") * F.col("size"))
    return materialised(x.select("doc_id", "source", "size", "key", "copy", "source_size", "target", "before"))


def _packets(repeats: int) -> Column:
    """All packets of a row: (pass, packet, words, finish)."""
    last = F.floor((F.col("size") - 1) / PACKET)

    def packet(k: int, p: Column) -> Column:
        words = F.least(F.lit(PACKET).cast("long"), F.col("size") - p * PACKET)
        start = F.col("before") + F.col("source_size") * k + p * PACKET
        return F.struct(F.lit(k).alias("pass"), p.alias("packet"), words.alias("words"), ((start + words) / F.col("target")).alias("finish"))

    def of_pass(k: int) -> Column:
        return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda p: packet(k, p))

    return F.when(F.col("size") > 0, F.concat(*map(of_pass, range(repeats))))


def _cut(queued: DataFrame, budget: int, repeats: int) -> dict | None:
    """The packet at which the budget is spent (its place in the global order, and how many of its words are taken); None
    where the budget holds everything."""
    packets = queued.select("source", "key", "copy", F.explode(_packets(repeats)).alias("p")).select("source", "key", "copy", "p.*")
    # the targets add up to the budget, so it ends less than a packet of each source after time 1: what is later than
    # time 2 is one range
    coarse = F.least(F.floor(F.col("finish") * RANGES), F.lit(2 * RANGES).cast("long"))
    fine = F.least(F.floor((F.col("finish") * RANGES - coarse) * RANGES), F.lit(RANGES).cast("long"))
    spent = 0
    for name, number in (("coarse", coarse), ("fine", fine)):
        packets = packets.withColumn(name, number)
        totals = packets.groupBy(name).agg(F.sum("words").alias("words"))
        running = F.sum("words").over(W.orderBy(name)) + spent
        found = totals.withColumn("running", running).filter(F.col("running") >= budget).orderBy(name).first()
        if found is None:
            return None
        spent = found["running"] - found["words"]
        packets = packets.filter(F.col(name) == found[name])
    order = W.orderBy("finish", F.col("source").asc_nulls_last(), "key", "copy", "pass", "packet")
    last = packets.withColumn("running", F.sum("words").over(order.rowsBetween(W.unboundedPreceding, 0)) + spent)
    row = last.filter(F.col("running") >= budget).orderBy("running").first().asDict()
    return row | {"words": budget - (row["running"] - row["words"])}


def schedule(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2, seed: int = 42) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, taken, `entries`, an
    array of (pass, words, virtual_start, virtual_finish) of the passes in which the mix takes it, and `key`, the shuffle's."""
    queued = _queued(docs, weights, share, repeats, seed)
    total = queued.agg(F.sum("size")).first()[0] or 0
    cut = _cut(queued, math.floor(min(share, repeats) * total), repeats) if total else None
    packets = F.coalesce(_packets(repeats), F.array())
    if cut:
        # rows of the cut's own time come before it by source, then key, copy, pass and packet
        null_last = F.struct(F.col("source").isNull(), F.coalesce("source", F.lit("")), F.col("key"), F.col("copy"))
        at = F.struct(F.lit(cut["source"] is None), F.lit(cut["source"] or ""), F.lit(cut["key"]), F.lit(cut["copy"]).cast("long"))

        def taken(p: Column) -> Column:
            inner = F.struct(p["pass"].cast("int"), p["packet"].cast("long"))
            edge = F.struct(F.lit(cut["pass"]).cast("int"), F.lit(cut["packet"]).cast("long"))
            ahead = (p["finish"] < cut["finish"]) | ((p["finish"] == cut["finish"]) & ((null_last < at) | ((null_last == at) & (inner < edge))))
            here = (p["finish"] == cut["finish"]) & (null_last == at) & (inner == edge)
            return F.when(ahead, p["words"]).when(here, F.lit(cut["words"])).otherwise(F.lit(0)).cast("long")
    else:
        taken = lambda p: p["words"].cast("long")
    x = queued.withColumn("packets", F.transform(packets, lambda p: F.struct(p["pass"].alias("pass"), p["finish"].alias("finish"), taken(p).alias("words"))))

    def entry(k: int) -> Column:
        own = F.filter("packets", lambda p: (p["pass"] == k) & (p["words"] > 0))
        words = F.aggregate(own, F.lit(0).cast("long"), lambda s, p: s + p["words"])
        start = F.try_divide(F.col("before") + F.col("source_size") * k, F.col("target"))
        return F.struct(F.lit(k).alias("pass"), words.alias("words"), start.alias("virtual_start"), F.array_max(F.transform(own, lambda p: p["finish"])).alias("virtual_finish"))

    x = x.withColumn("entries", F.filter(F.array(*(entry(k) for k in range(repeats))), lambda e: e["words"] > 0))
    sum_of = F.aggregate("entries", F.lit(0).cast("long"), lambda s, e: s + e["words"])
    return x.select("doc_id", "source", "size", "source_size", "target", sum_of.alias("taken"), "entries", "key")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: an entry (doc_id, source, pass, words, virtual_finish) for every time a document
    is taken, range-sorted by virtual finish time. An entry with fewer words than its document is cut."""
    plan = schedule(docs, **options)
    out = plan.select("doc_id", "source", F.explode("entries").alias("e")).select("doc_id", "source", "e.*").drop("virtual_start")
    return out.orderBy("virtual_finish", "source", "doc_id", "pass")


def mixed_texts(docs: DataFrame, seed: int = 42, **options) -> DataFrame:
    """The documents that the mix takes, with their texts: doc_id, source, size, source_size, target, taken, passes, text. A document of
    which only one pass is taken, and not all of it, has the words taken, joined by single spaces."""
    plan = schedule(docs, seed=seed, **options).filter("taken > 0")
    # rows that agree in id and text share a key, and need their text once
    own = docs.select(shuffle_key(F.col("doc_id"), F.col("text"), seed).alias("key"), "text").dropDuplicates(["key"])
    cut = (F.size("entries") == 1) & (F.col("taken") < F.col("size"))
    x = plan.join(own, "key")
    return x.select("doc_id", "source", "size", "source_size", "target", "taken", F.size("entries").alias("passes"), F.when(cut, first_words(F.col("text"), F.col("taken"))).otherwise(F.col("text")).alias("text"))


def first_words(text: Column, n: Column) -> Column:
    """The text of a cut entry: its first n words, joined by single spaces."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), 1, n.cast("int")), " ")
