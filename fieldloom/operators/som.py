"""Self-organizing maps. Training one map is a sequential fold; runs are independent and train in parallel, those that differ in nothing but
the seed a few at a time as one stack of maps. Assignment is parallel over fields (fieldloom.operators.bmu).

Fields are one matrix, checked against MAX_VALUES and broadcast: a record of monthly fields is small (264 fields of
89,544 cells are 190 MB), whatever the number of runs. Larger records train in tiles (fieldloom.operators.tiled).
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.operators.sliding import Stack, Window
from fieldloom.sources.sinks import scratch

MAX_VALUES = 100_000_000
#: Runs of one stack, and values of prototypes and fields that are compared at once.
STACK, CHUNK = 6, 4_000_000
# Fixed values of the exploratory and of the final training.
GRIDS, SEEDS = (3, 4, 6), (1, 10, 22, 50, 77, 123, 145, 200, 321, 444, 555, 999)
ITERATIONS, RADIUS, RATE = 5000, 1.0, 0.5
SEARCHES = ("euclidean", "correlation", "ssim")
STARTS = ("pca", "random")


def matrix_of(fields: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Times and vectors, in time order, after a check of their size."""
    n = fields.agg(F.sum(F.size("vec"))).first()[0] or 0
    if n > MAX_VALUES:
        raise ValueError(f"{n} values do not fit in one task; sample cells or months, or raise MAX_VALUES")
    table = fields.select("t", F.col("vec").cast("array<double>").alias("vec")).toArrow().sort_by("t")
    if not table.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    vec = table.column("vec").combine_chunks()
    return table.column("t").to_numpy(), vec.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vec), -1)


#: Up to so many fields or cells the Gram matrix is solved at once.
GRAM = 2_000


def principal(data: np.ndarray, n: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the first principal axes, from the Gram matrix of fields or of cells, whichever is smaller, or, where both are many, by
    iterating a subspace; the largest loading is positive. Axes without variance are zero."""
    mean = data.mean(axis=0)
    x = data - mean
    n = min(n, *x.shape)
    if x.shape[1] <= min(len(x), GRAM):
        values, vectors = np.linalg.eigh(x.T @ x)
        axes = vectors[:, ::-1][:, :n].T * (values[::-1][:n] > values[-1] * 1e-14)[:, None]
    elif len(x) <= GRAM:
        axes = np.linalg.eigh(x @ x.T)[1][:, ::-1][:, :n].T @ x
        norms = np.linalg.norm(axes, axis=1, keepdims=True)
        axes = np.divide(axes, norms, out=np.zeros_like(axes), where=norms > np.linalg.norm(x) * 1e-10)
    else:
        axes = iterated_axes(lambda q: x.T @ (x @ q), x.shape[1], n)
    return mean, signed(axes)


def signed(axes: np.ndarray) -> np.ndarray:
    signs = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])
    return axes * np.where(signs == 0, 1, signs)[:, None]


def iterated_axes(scatter, cells: int, n: int, spare: int = 8, most: int = 300) -> np.ndarray:
    """The first n eigenvectors of a scatter matrix that is known by its products only. The subspace has spare directions, so
    it settles with the gap behind them."""
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(cells, min(n + spare, cells))))[0]
    last = np.full(n, np.inf)
    for _ in range(most):
        y = scatter(q)
        values, turn = np.linalg.eigh(q.T @ y)
        axes, top = (q @ turn)[:, ::-1][:, :n], values[::-1][:n]
        apart = np.linalg.norm((y @ turn)[:, ::-1][:, :n] - axes * top, axis=0)
        if (apart <= 1e-10 * max(top[0], 0.0)).all() or (apart >= last).all() and (apart <= 1e-7 * max(top[0], 0.0)).all():
            break
        last = apart
        q = np.linalg.qr(y)[0]
    return axes.T * (top > max(top[0], 0.0) * 1e-14)[:, None]


def principal_of(fields: DataFrame, n: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """`principal` of fields (t, vec) that no single task holds: sums of products come from Spark, the driver holds cells x (n + 8) values.
    Fields with gaps are left out."""
    whole = fields.select(F.col("vec").cast("array<double>").alias("vec")).filter(~F.exists("vec", lambda v: v.isNull() | F.isnan(v)))

    def summed(product) -> np.ndarray:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                vec = batch.column(0)
                if len(vec):
                    own = product(vec.flatten().to_numpy().reshape(len(vec), -1))
                    total = own if total is None else total + own
            if total is not None:
                flat = total.ravel()
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, flat.size], pa.int32()), pa.array(flat))], names=["s"])

        by_place = whole.mapInArrow(partial, "s array<double>").select(F.posexplode("s").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
        return by_place.orderBy("k").toArrow().column("v").to_numpy()

    count, cells = whole.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not count:
        raise ValueError("no field without gaps")
    mean = summed(lambda x: x.sum(axis=0)) / count
    return mean, signed(iterated_axes(lambda q: summed(lambda x: (x - mean).T @ ((x - mean) @ q)).reshape(q.shape), cells, min(n, cells, count)))


def grid_of(rows: int, columns: int) -> np.ndarray:
    return np.stack(np.meshgrid(np.arange(rows), np.arange(columns), indexing="ij"), axis=-1).reshape(-1, 2)


def distances(x: np.ndarray, w: np.ndarray, search: str) -> np.ndarray:
    """From fields (..., cells) to all prototypes of their own maps (..., nodes, cells), or of one map (nodes, cells)."""
    if search == "euclidean":
        return np.sqrt(((w - x[..., None, :]) ** 2).sum(axis=-1))
    n = x.shape[-1]
    mx, mw = x.mean(axis=-1)[..., None], w.mean(axis=-1)
    xc, wc = x - mx, w - mw[..., None]
    vx, vw, cov = (xc * xc).sum(axis=-1)[..., None] / n, (wc * wc).sum(axis=-1) / n, (wc @ xc[..., None])[..., 0] / n
    if search == "correlation":
        flat = (vw == 0) | (vx == 0)
        return np.where(flat, 1.0, 1 - cov / np.sqrt(np.where(flat, 1.0, vw * vx)))
    if search == "ssim":
        return -((2 * mx * mw + 1e-4) * (2 * cov + 9e-4)) / ((mx * mx + mw * mw + 1e-4) * (vx + vw + 9e-4))
    raise ValueError(f"unknown search {search}")


Plane = tuple[np.ndarray, np.ndarray]


def exploratory_start(data: np.ndarray, size: int, search: str, start: str, random: np.random.RandomState, plane: Plane | None = None) -> np.ndarray:
    """Prototypes before training. pca: along two components, by the scores' range, or by the square [-1, 1] (whose first
    index then follows the second component) for the correlation. random: observed fields for ssim, else U(-1, 1).
    plane: the data's mean and components, where they are known."""
    n = size * size
    if start == "pca":
        mean, axes = plane or principal(data)
        at = grid_of(size, size).astype(float) / max(1, size - 1)
        if search == "correlation":
            return mean + (2 * at[:, ::-1] - 1) @ axes
        scores = (data - mean) @ axes.T
        low, high = scores.min(axis=0), scores.max(axis=0)
        return mean + (low + at * (high - low)) @ axes
    if start == "random":
        if search == "ssim":
            return data[random.choice(len(data), n, replace=True)].copy()
        return random.rand(size, size, data.shape[1]).reshape(n, -1) * 2 - 1
    raise ValueError(f"unknown start {start}")


def exploratory_train(data: np.ndarray, size: int, search: str, start: str, seed: int, iterations: int = ITERATIONS, radius: float = RADIUS, rate: float = RATE) -> np.ndarray:
    return exploratory_stack(data, size, search, start, [seed], iterations, radius, rate)[0]


def exploratory_stack(
    data: np.ndarray, size: int, search: str, start: str, seeds: list[int], iterations: int = ITERATIONS, radius: float = RADIUS, rate: float = RATE, plane: Plane | None = None
) -> np.ndarray:
    """One map for each seed, (seeds, nodes, cells), all a step further at a time: one field drawn at random each step; rate and radius decay
    as exp(-t / T); nodes within the radius move."""
    randoms = [np.random.RandomState(seed) for seed in seeds]
    w = np.stack([exploratory_start(data, size, search, start, random, plane) for random in randoms])
    drawn = np.stack([random.randint(0, len(data), iterations) for random in randoms])
    at = grid_of(size, size)
    gaps = ((at[:, None] - at[None]) ** 2).sum(axis=2)
    for t in range(iterations):
        x = data[drawn[:, t]]
        decay = np.exp(-t / iterations)
        r2 = (radius * decay) ** 2
        gap = gaps[distances(x, w, search).argmin(axis=1)]
        own, near = np.nonzero(gap <= r2)
        w[own, near] += (rate * decay * np.exp(-gap[own, near] / (2 * r2)))[:, None] * (x[own] - w[own, near])
    return w


def winners(data: np.ndarray, w: np.ndarray, search: str) -> np.ndarray:
    step = max(1, CHUNK // w.size)
    return np.concatenate([np.zeros(0, int), *(distances(data[k : k + step], w, search).argmin(axis=1) for k in range(0, len(data), step))])


def runs(spark: SparkSession, searches=SEARCHES, starts=STARTS, grids=GRIDS, seeds=SEEDS) -> DataFrame:
    """All combinations, one row each, with a run_id that names all of it."""
    of = lambda name, values: F.explode(F.array(*map(F.lit, values))).alias(name)
    x = spark.range(1).select(of("search", searches)).select("*", of("start", starts)).select("*", of("size", grids)).select("*", of("seed", seeds))
    return x.withColumn("run_id", F.format_string("%s_%s_%dx%d_seed%d", "search", "start", "size", "size", "seed"))


def train_runs(runs_: DataFrame, fields: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """run_id, search, start, size, seed, t, node of every field in every run. Up to STACK runs that differ in the seed alone are one task."""
    times, data = matrix_of(fields)
    whole = ~np.isnan(data).any(axis=1)
    spark = runs_.sparkSession
    place = F.row_number().over(W.partitionBy("search", "start", "size").orderBy("seed", "run_id")) - 1
    stacks = (
        runs_.select("run_id", "search", "start", "size", "seed").withColumn("stack", F.floor(place / STACK))
        .groupBy("search", "start", "size", "stack").agg(F.sort_array(F.collect_list(F.struct("seed", "run_id"))).alias("runs"))
    )
    needed = stacks.agg(F.count("*"), F.max((F.col("start") == "pca").cast("int"))).first()
    schema = "run_id string, search string, start string, size int, seed int, t long, node int"
    if not whole.any() or not needed[0]:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast((times[whole], data[whole], principal(data[whole]) if needed[1] else None))

    def train(batches: Iterator) -> Iterator:
        import pandas as pd

        t, x, plane = sent.value
        for batch in batches:
            for r in batch.itertuples():
                seeds = [int(s["seed"]) for s in r.runs]
                maps = exploratory_stack(x, int(r.size), r.search, r.start, seeds, iterations, plane=plane)
                for s, w in zip(r.runs, maps, strict=True):
                    yield pd.DataFrame({"run_id": s["run_id"], "search": r.search, "start": r.start, "size": int(r.size), "seed": int(s["seed"]), "t": t, "node": winners(x, w, r.search)})

    # A number of parts that is asked for is kept, and rows without a key are dealt out in turn: a part for each stack.
    return stacks.coalesce(1).repartition(needed[0]).mapInPandas(train, schema)


@dataclass
class FinalConfig:
    """Parameters of the final training."""

    grid: int = 4
    init: str = "pca"
    epochs: int = 8
    lr: float = 0.4
    seed: int = 145
    window: int = 11
    sigma: float = 1.5
    L: float = 1.0
    search: str = "ssim"

    def problems(self) -> list[str]:
        """Everything that is wrong, at once."""
        out = []
        if self.grid < 2:
            out.append("grid must be at least 2")
        if self.init not in STARTS:
            out.append("init must be pca or random")
        if self.epochs < 1:
            out.append("epochs must be at least 1")
        if not 0 < self.lr <= 1:
            out.append("lr must be above 0 and at most 1")
        if self.window < 3 or self.window % 2 == 0:
            out.append("window must be odd and at least 3")
        if self.sigma <= 0 or self.L <= 0:
            out.append("sigma and L must be positive")
        if self.search not in ("ssim", "euclidean"):
            out.append("search must be ssim or euclidean")
        return out

    def doubts(self) -> list[str]:
        """What is allowed, but rarely meant."""
        out = []
        if self.grid > 10:
            out.append(f"a map of {self.grid} x {self.grid} nodes trains slowly and may stay sparsely occupied")
        if self.window > 21:
            out.append(f"a window of {self.window} cells averages over large parts of a field")
        return out

    def checked(self) -> FinalConfig:
        if found := self.problems():
            raise ValueError("; ".join(found))
        for doubt in self.doubts():
            warnings.warn(doubt, stacklevel=2)
        return self

    @property
    def run_id(self) -> str:
        return f"ssim_full_{self.grid}x{self.grid}_{self.init}_ep{self.epochs}_lr{self.lr:g}_seed{self.seed}"


def final_start(data: np.ndarray, c: FinalConfig) -> np.ndarray:
    """U[0, 1) of the seed, or the plane of two unit components from -2 to 2, clipped to [0, 1]; with fewer than two whole
    fields the random start stays."""
    w = np.random.default_rng(c.seed).random((c.grid, c.grid, data.shape[1]), dtype=np.float32).reshape(c.grid**2, -1).astype(float)
    whole = data[~np.isnan(data).any(axis=1)]
    if c.init == "pca" and len(whole) >= 2:
        mean, axes = principal(whole)
        w = np.clip(mean + np.linspace(-2, 2, c.grid)[grid_of(c.grid, c.grid)] @ axes, 0.0, 1.0)
    return w


def final_train(data: np.ndarray, c: FinalConfig, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Epochs over all fields in order; rate and radius fall linearly; every node moves by its Gaussian share. Returns
    prototypes and the node of each field (-1 for fields with gaps)."""
    c.checked()
    at = grid_of(c.grid, c.grid)
    gaps = ((at[:, None] - at[None]) ** 2).sum(axis=2)
    w = final_start(data, c)
    whole = np.flatnonzero(~np.isnan(data).any(axis=1))
    sliding = c.search == "ssim"
    if sliding:
        window = Window(mask, c.window, c.sigma, c.L)

        def image(v: np.ndarray) -> np.ndarray:
            out = np.zeros((*v.shape[:-1], *mask.shape))
            out[..., mask] = v
            return out

        stack = Stack(window, image(w))
        images = image(data[whole])
        means, squares = window.mean(images), window.mean(images * images)
    for epoch in range(c.epochs):
        fade = 1.0 - epoch / max(1, c.epochs)
        share = c.lr * fade * np.exp(-gaps / (2 * (c.grid / 2.0 * fade) ** 2))
        for place, k in enumerate(whole):
            if sliding:
                d, product = stack.distances(images[place], means[place], squares[place])
                stack.move(images[place], means[place], squares[place], product, share[int(np.argmin(d))])
            else:
                best = int(np.argmin(((w - data[k]) ** 2).sum(axis=1)))
                w += share[best][:, None] * (data[k] - w)
    nodes = np.full(len(data), -1)
    if sliding:
        stack = Stack(window, stack.images)
        w = stack.images[:, mask]
        nodes[whole] = [int(np.argmin(stack.distances(images[k], means[k], squares[k])[0])) for k in range(len(whole))]
    else:
        nodes[whole] = [int(np.argmin(((w - data[k]) ** 2).sum(axis=1))) for k in whole]
    return w, nodes


def train_final(fields: DataFrame, configs: list[FinalConfig], mask: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """All configurations in parallel: assignments (run_id, t, node_i, node_j, node) and prototypes (run_id, node, vec)."""
    spark = fields.sparkSession
    times, data = matrix_of(fields)
    sent = spark.sparkContext.broadcast((times, data, mask, {c.run_id: asdict(c.checked()) for c in configs}))
    names = sorted({c.run_id for c in configs})

    def train(batches: Iterator) -> Iterator:
        import pandas as pd

        t, x, m, known = sent.value
        for batch in batches:
            for k in batch["id"]:
                run = names[k]
                w, nodes = final_train(x, FinalConfig(**known[run]), m)
                yield pd.DataFrame({"run_id": run, "t": t, "node": nodes, "vec": None})
                yield pd.DataFrame({"run_id": run, "t": -1, "node": range(len(w)), "vec": list(w)})

    # Written once, one part for each run, so that no map is trained again for its second reader or for a lost executor.
    path = scratch(spark, "maps")
    spark.range(0, len(names), 1, len(names)).mapInPandas(train, "run_id string, t long, node int, vec array<double>").write.parquet(path)
    out = spark.read.parquet(path)
    size = F.regexp_extract("run_id", r"_(\d+)x", 1).cast("int")
    side = lambda x: F.when(F.col("node") < 0, -1).otherwise(x).cast("int")
    bmu = out.filter("vec is null").select("run_id", "t", side(F.floor(F.col("node") / size)).alias("node_i"), side(F.col("node") % size).alias("node_j"), "node")
    return bmu, out.filter("vec is not null").select("run_id", "node", "vec")
