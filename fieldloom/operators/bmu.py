"""Best-matching units: every field against all prototypes of a map, the nearest wins; ties go to the first node in
row-major order. Prototypes are a bounded table (MAX_NODES), checked and broadcast; larger maps are assigned in groups
of nodes whose winners are compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.metrics import Pair, dot, let, metric, vector_sum, with_sums

MAX_NODES = 1024


def prototypes_of(fields: DataFrame) -> DataFrame:
    """Mean vector of each node: node, vec."""
    long = fields.select("node", F.posexplode("vec").alias("pos", "v")).groupBy("node", "pos").agg(F.avg("v").alias("v"))
    return long.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("vec"))


def _prepared(prototypes: DataFrame) -> DataFrame:
    return with_sums(prototypes.select("node", F.col("vec").alias("w")), "w", "w_")


def _check(prototypes: DataFrame) -> None:
    if prototypes.limit(MAX_NODES + 1).count() > MAX_NODES:
        raise ValueError(f"a map has at most {MAX_NODES} nodes; assign groups of nodes and compare their winners")


def pair_of(vec: str = "vec", w: str = "w") -> Pair:
    c = F.col
    return Pair(F.size(vec), c("s1"), c("w_s1"), c("s2"), c("w_s2"), dot(c(vec), c(w)))


def distances_to(fields: DataFrame, prototypes: DataFrame, name: str) -> DataFrame:
    """One row a field and node: t, node, d. Fields with a null element have no distances."""
    whole = with_sums(fields.filter("not exists(vec, v -> v is null)"))
    _check(prototypes)
    table = F.broadcast(_prepared(prototypes).withColumn("one", F.lit(1)))
    return whole.withColumn("one", F.lit(1)).join(table, "one").withColumn("d", metric(name)(pair_of())).drop("one")


def assign(fields: DataFrame, prototypes: DataFrame, name: str) -> DataFrame:
    """The fields' own columns with node and d of the best-matching unit in place of vec; fields with a null element get node -1. Each field meets the prototypes as
    one packed array, so no row is multiplied and nothing is shuffled."""
    _check(prototypes)
    packed = _prepared(prototypes).agg(F.array_sort(F.collect_list(F.struct("node", "w", "w_s1", "w_s2"))).alias("nodes"))
    x = fields.withColumn("one", F.lit(1)).join(F.broadcast(packed.withColumn("one", F.lit(1))), "one")
    vec = F.col("vec")

    def nearest(own):
        def scored(p):
            product = dot(vec, p["w"])
            return let(product, lambda d: F.struct(metric(name)(Pair(F.size(vec), own["s1"], p["w_s1"], own["s2"], p["w_s2"], d)).alias("d"), p["node"].alias("node")))

        return F.array_min(F.transform("nodes", scored))

    best = let(F.struct(vector_sum(vec).alias("s1"), dot(vec, vec).alias("s2")), nearest)
    whole = ~F.exists("vec", lambda v: v.isNull() | F.isnan(v))
    x = x.select(*(c for c in fields.columns if c not in ("vec", "node", "d")), F.when(whole, best).alias("best"))
    return x.select("*", F.coalesce("best.node", F.lit(-1)).alias("node"), F.col("best.d").alias("d")).drop("best")


def own_prototype(fields: DataFrame, prototypes: DataFrame, guarded: bool = False) -> DataFrame:
    """Structural similarity of each field to the prototype of its own node: t, node, ssim."""
    from fieldloom.functions.metrics import ssim

    x = with_sums(fields).join(_prepared(prototypes), "node")
    return x.select("t", "node", ssim(pair_of(), guarded=guarded).alias("ssim"))


def node_means(scored: DataFrame) -> DataFrame:
    return scored.groupBy("node").agg(F.count("*").alias("n"), F.avg("ssim").alias("ssim"))


def coherence(scored: DataFrame) -> DataFrame:
    """Mean over nodes with equal weight, and mean over fields with equal weight."""
    x = scored.groupBy("node").agg(F.avg("ssim").alias("m"), F.sum("ssim").alias("s"), F.count("ssim").alias("k"))
    return x.agg(F.avg("m").alias("node_mean"), F.try_divide(F.sum("s"), F.sum("k")).alias("global_mean"))
