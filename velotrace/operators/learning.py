"""Feature matrices, scaling, selection, PCA, k-means, cluster metrics, stability."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velotrace.sources.storage import materialize

MAGNITUDE, VOLATILITY = ("min", "max", "mean"), ("std", "mad", "qcv", "cv", "var")
RESTARTS = 20
#: Steps of a fit at most, the moves at which it rests (the sum of their squares, of a column's mean variance), and the rows among which first centres are chosen.
STEPS, MOVE, INIT_ROWS = 300, 1e-4, 2000
#: Rows whose distances to all centres are held at once.
ROWS = 1024
#: Bytes of the partitions' sums of one step that come to the driver as they are; more are summed by fit before.
GATHERED = 1 << 24
#: Rows of which auto_k takes silhouettes.
SILHOUETTE_ROWS = 20_000


def split_columns(names: list[str]) -> tuple[list[str], list[str]]:
    """Magnitude and volatility columns by their names."""
    volatile = [n for n in names if any(k in n for k in VOLATILITY)]
    return [n for n in names if any(k in n for k in MAGNITUDE) and n not in volatile], volatile


def feature_matrix(df: DataFrame, columns: list[str], drop_null: bool = True, exclude: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """df with a vector `features` of the active columns; rows with a missing one are dropped or else refused by the learner."""
    active = [c for c in columns if c not in exclude]
    df = df.na.drop(subset=active) if drop_null else df
    return VectorAssembler(inputCols=active, outputCol="features", handleInvalid="error" if drop_null else "keep").transform(df), active


class FeatureAdapter:
    """Columns of features and vectors of them, there and back; excluded names are in neither."""

    def __init__(self, names: list[str], exclude: tuple[str, ...] = ()):
        self.names = [n for n in names if n not in exclude]
        self.magnitude, self.volatility = split_columns(self.names)

    def to_vector(self, df: DataFrame, output: str = "features") -> DataFrame:
        return df.withColumn(output, array_to_vector(F.array(*[F.col(n).cast("double") for n in self.names])))

    def from_vector(self, df: DataFrame, vector: str = "features", output: str = "struct") -> DataFrame:
        """df with a struct of the names; a vector of another length is an error."""
        v = vector_to_array(vector)
        checked = F.when(F.size(v) == len(self.names), v).otherwise(F.raise_error(F.concat(F.lit(f"a vector of {len(self.names)} is wanted, not of "), F.size(v).cast("string"))).cast("array<double>"))
        return df.withColumn(output, F.transform(F.array(checked), lambda a: F.struct(*[a[k].alias(n) for k, n in enumerate(self.names)]))[0])


def zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean, over the population standard deviation (1 where it is zero). One aggregation, a one-row broadcast."""
    stats = df.agg(*[a for c in columns for a in (F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__s_{c}"))])
    joined = df.crossJoin(F.broadcast(stats))
    return joined.select(*[((F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0)).alias(c) if c in columns else F.col(c) for c in df.columns])


def cross_sums(df: DataFrame, columns: list[str], centre: list[float] | None = None) -> DataFrame:
    """(i, j, n, x, xx, xy) of all pairs of columns, less `centre`: over the rows in which neither is null, their number, the sums of column i, of its squares, and of the products.

    Each partition multiplies its rows' matrix with itself and sends one row for each pair of columns.
    """
    d, middle = len(columns), np.array(centre if centre is not None else [0.0] * len(columns))
    names = ("n", "x", "xx", "xy")

    def run(batches):
        total = {k: np.zeros((d, d)) for k in names}
        for b in batches:
            there = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in b.columns], 1).astype(float)
            x = np.where(there > 0, np.stack([c.fill_null(0).to_numpy() for c in b.columns], 1) - middle, 0.0)
            for k, m in zip(names, (there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x)):
                total[k] += m
        i, j = np.divmod(np.arange(d * d), d)
        yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32)} | {k: m.ravel() for k, m in total.items()})

    parts = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)]).mapInArrow(run, "i int, j int, n double, x double, xx double, xy double")
    return parts.groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in names])


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) for a before b, over the rows in which neither is null; null for a constant column."""
    means = [m or 0.0 for m in df.agg(*[F.avg(c) for c in columns]).first()]
    s = cross_sums(df, columns, means)
    pair = s.alias("p").join(F.broadcast(s.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("x").alias("y"), F.col("xx").alias("yy"))), ["i", "j"]).where("i < j")
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    spread = F.sqrt(n * F.col("xx") - x * x) * F.sqrt(n * F.col("yy") - y * y)
    name = F.array(*[F.lit(c) for c in columns])
    return pair.select(name[F.col("i")].alias("a"), name[F.col("j")].alias("b"), F.try_divide(n * F.col("xy") - x * y, spread).alias("corr"))


def gram(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Uncentred cross products, columns x columns; the only thing that comes to the driver."""
    g = np.zeros((len(columns), len(columns)))
    for r in cross_sums(df, columns).select("i", "j", "xy").collect():
        g[r.i, r.j] = r.xy
    return g


def vif(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Variance inflation factors without a constant, from the inverse of the Gram matrix."""
    g = gram(df, columns)
    return dict(zip(columns, (np.diag(g) * np.diag(np.linalg.pinv(g))).tolist()))


def select_features(df: DataFrame, columns: list[str], max_corr: float = 0.9, max_vif: float = 5.0) -> list[str]:
    """Columns to drop: the later of any pair correlated above max_corr, then those of the rest with a VIF above max_vif."""
    drop = {r.b for r in correlations(df, columns).where(F.abs("corr") > max_corr).collect()}
    rest = [c for c in columns if c not in drop]
    return [c for c in columns if c in drop] + [c for c, v in vif(df, rest).items() if v > max_vif]


class Reducer:
    """PCA that keeps the least number of components whose variance reaches `share`, centred, each component's largest loading positive."""

    def __init__(self, columns: list[str], share: float = 0.95):
        self.columns, self.share = columns, share

    def fit(self, df: DataFrame) -> Reducer:
        matrix, _ = feature_matrix(df, self.columns)
        model = PCA(k=len(self.columns), inputCol="features", outputCol="pc").fit(matrix)
        ratio = np.array(model.explainedVariance)
        self.k = int(min(len(ratio), np.searchsorted(np.cumsum(ratio), self.share - 1e-12) + 1))
        parts = model.pc.toArray().T[: self.k]
        self.parts = parts * np.sign(parts[np.arange(self.k), np.abs(parts).argmax(1)])[:, None]
        self.explained = ratio[: self.k]
        self.mean = np.array(df.agg(*[F.avg(c) for c in self.columns]).first(), float)
        return self

    def transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        """df with the components' scores, null where a column is. One numpy product for each batch, since an expression for each score would have the size of the whole matrix."""
        mean, parts = self.mean, self.parts

        @F.arrow_udf("array<double>")
        def scores(rows: pa.Array) -> pa.Array:
            flat = rows.flatten()
            x = flat.fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, len(mean)) - mean
            missing = ~flat.is_valid().to_numpy(zero_copy_only=False).reshape(x.shape).all(1)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(parts))
            return pa.ListArray.from_arrays(ends, pa.array((x @ parts.T).ravel(), mask=np.repeat(missing, len(parts))))

        found = df.withColumn("__scores", scores(F.array(*[F.col(c).cast("double") for c in self.columns])))
        return found.withColumns({f"{prefix}{i + 1}": F.col("__scores")[i] for i in range(len(parts))}).drop("__scores")

    def inverse(self, z: np.ndarray) -> np.ndarray:
        return z @ self.parts + self.mean

    def loadings(self, relative: bool = True) -> np.ndarray:
        return np.abs(self.parts) / np.abs(self.parts).sum(1, keepdims=True) if relative else self.parts


class SplitReducer:
    """Separate PCA of magnitude and volatility columns, side by side."""

    def __init__(self, columns: list[str], share: float = 0.95):
        self.columns = columns
        self.halves = [Reducer(c, share) for c in split_columns(columns)]

    def fit(self, df: DataFrame) -> SplitReducer:
        for h in self.halves:
            h.fit(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.halves[1].transform(self.halves[0].transform(df, "mag"), "vol")

    def inverse(self, z: np.ndarray) -> np.ndarray:
        out, k = np.zeros((len(z), len(self.columns))), self.halves[0].k
        for h, part in zip(self.halves, (z[:, :k], z[:, k:])):
            out[:, [self.columns.index(c) for c in h.columns]] = h.inverse(part)
        return out


@dataclass
class Clusters:
    """A fit of k-means: centres (k x dimensions), and the sum of squared distances to the nearest."""

    centers: np.ndarray
    cost: float

    def transform(self, df: DataFrame) -> DataFrame:
        """df with `prediction`, the number of the nearest centre to vector column `features`, the first of equals."""
        v = vector_to_array("features")
        far = F.array(*[F.aggregate(F.zip_with(v, F.array(*[F.lit(float(x)) for x in c]), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) for c in self.centers])
        return df.withColumn("prediction", F.transform(F.array(far), lambda d: F.array_position(d, F.array_min(d)) - 1)[0].cast("int"))


@dataclass(frozen=True)
class View:
    """The rows that a fit sees: all; those of a run's subsample of `share`; or all, blurred by a run's noise of `noise` times each column's deviation."""

    run: int = 0
    share: float = 1.0
    noise: float = 0.0

    def rows(self, x: np.ndarray, key: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the rows seen, their values). A row's part in a run and its noise follow from its key alone."""
        at = np.arange(len(x))
        if self.share < 1:
            at = at[_uniform(key, 2 * self.run) < self.share]
        x = x[at]
        if self.noise:
            d = x.shape[1]
            u = np.stack([_uniform(key[at], (2 * self.run + 1) * 100_003 + k) for k in range(d + d % 2)], 1)
            far, turn = np.sqrt(-2 * np.log(u[:, ::2])), 2 * np.pi * u[:, 1::2]
            x = x + np.concatenate((far * np.cos(turn), far * np.sin(turn)), 1)[:, :d] * self.noise * scale
        return at, x


def _uniform(key: np.ndarray, stream: int) -> np.ndarray:
    """In (0, 1), from a row's key and the number of a stream, by two rounds of a mixing function."""
    x = key.view(np.uint64) + np.uint64((stream * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    for _ in range(2):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def _far(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances, rows x centres."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ centers.T) + (centers * centers).sum(1), 0)


def _first_centers(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ on a sample."""
    rng = np.random.default_rng(seed)
    out = [x[rng.integers(len(x))]]
    for _ in range(k - 1):
        near = _far(x, np.array(out)).min(1)
        out.append(x[rng.choice(len(x), p=near / near.sum()) if near.sum() > 0 else rng.integers(len(x))])
    return np.array(out)


def _batches_of(batches):
    for b in batches:
        v = b.column(0)
        yield np.array(v.flatten().to_numpy(zero_copy_only=False), float).reshape(len(v), -1), b.column(1).to_numpy()


def fit_many(df: DataFrame, wanted: list[tuple[View, int, int]], scale: np.ndarray | None = None) -> list[Clusters]:
    """k-means for each wanted (view, k, seed) on vector column `features`, all side by side: each step is one pass for all of them.

    First centres are chosen by k-means++ among the view's part of the INIT_ROWS rows with the smallest hashes. A step
    sums the rows of each cluster in each partition, and partitions' sums by fit; only sums come to the driver. A
    fit rests by MOVE, or after STEPS steps. Fits of one view that reach the same centres, or begin with them, take their
    further steps once. A cluster without rows keeps its centre. Up to GATHERED bytes the partitions' sums go straight
    to the driver, so that a step is one stage.
    """
    rows = _keyed(df).persist()  # read once for each step
    try:
        return _fit_many(rows, wanted, scale)
    finally:
        rows.unpersist()


def _fit_many(rows: DataFrame, wanted: list[tuple[View, int, int]], scale: np.ndarray | None) -> list[Clusters]:
    sample = rows.orderBy("key").limit(INIT_ROWS).toArrow().combine_chunks().to_batches()
    x0, key0 = next(_batches_of(sample), (np.zeros((0, 0)), np.zeros(0, np.int64)))
    if not len(x0):
        raise ValueError("no rows")
    first = {}
    for view in dict.fromkeys(v for v, _, _ in wanted):
        first[view] = view.rows(x0, key0, scale)[1]
    begun = {w: _first_centers(first[w[0]] if len(first[w[0]]) else x0, *w[1:]) for w in dict.fromkeys(wanted)}
    centers = [begun[w] for w in wanted]
    rest = MOVE * float(x0.var(0).mean())
    cost, active, d = [float("inf")] * len(wanted), list(range(len(wanted))), x0.shape[1]
    partitions = rows.rdd.getNumPartitions()
    for step in range(STEPS + 1):
        # Fits of a view that have come to the same centres go on as one.
        same: dict[tuple, int] = {}
        of = {m: same.setdefault((wanted[m][0], centers[m].shape, centers[m].tobytes()), m) for m in active}
        by_view: dict[tuple[View, int], list[int]] = {}
        for m in same.values():
            by_view.setdefault((wanted[m][0], wanted[m][1]), []).append(m)
        # Of each view and k the first centres of all fits, then their second ones, and so on.
        now = {vk: np.stack([centers[m] for m in own], 1).reshape(-1, x0.shape[1]) for vk, own in by_view.items()}

        def run(batches):
            sums = {vk: [np.zeros((vk[1], len(own))), np.zeros((vk[1], len(own), d)), np.zeros(len(own))] for vk, own in by_view.items()}
            for x, key in _batches_of(batches):
                last, seen = None, x
                for (view, k), own in by_view.items():
                    if view != last:
                        last, seen = view, view.rows(x, key, scale)[1]
                    n, sum_of, costs = sums[view, k]
                    for lo in range(0, len(seen), ROWS):
                        some = seen[lo : lo + ROWS]
                        far = _far(some, now[view, k]).reshape(len(some), k, -1)
                        least, mine = far[:, 0], np.zeros((len(some), len(own)), np.int16)
                        for c in range(1, k):
                            nearer = far[:, c] < least
                            mine[nearer] = c
                            least = np.where(nearer, far[:, c], least)
                        costs += least.sum(0)
                        for c in range(k):
                            one = (mine == c).astype(float)
                            n[c] += one.sum(0)
                            sum_of[c] += one.T @ some
            parts = [np.concatenate([x.ravel() for x in part]) for part in sums.values()]
            yield pa.RecordBatch.from_pydict({"view": pa.array(range(len(parts)), pa.int32()), "part": pa.array(parts, pa.list_(pa.float64()))})

        def add(group: pa.Table) -> pa.Table:
            parts = np.array(group["part"].combine_chunks().flatten().to_numpy()).reshape(len(group), -1)
            return pa.table({"view": group["view"].slice(0, 1), "part": pa.array([parts.sum(0)], pa.list_(pa.float64()))})

        kinds = "view int, part array<double>"
        parts, views, found = rows.mapInArrow(run, kinds), list(by_view.items()), {}
        if partitions * sum(8 * (k * (d + 1) + 1) * len(own) for (_, k), own in views) > GATHERED:
            parts = parts.groupBy("view").applyInArrow(add, kinds)
        got, left, sums = parts.toArrow(), [], {}
        for g, row in zip(got["view"].to_pylist(), got["part"].combine_chunks()):
            sums[g] = sums.get(g, 0.0) + np.array(row.values)
        for g, row in sums.items():
            (_, k), own = views[g]
            n, total, costs = np.split(row, (k * len(own), k * len(own) * (d + 1)))
            for j, m in enumerate(own):
                found[m] = n.reshape(k, -1)[:, j], total.reshape(k, -1, d)[:, j], float(costs[j])
        for m in active:
            n, total, cost[m] = found[of[m]]  # the cost is that of the centres as they were
            new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centers[m])  # equal for fits that go on as one
            if step < STEPS and ((new - centers[m]) ** 2).sum() > rest:
                centers[m] = new
                left.append(m)
        active = left
        if not active:
            break
    return [Clusters(c, x) for c, x in zip(centers, cost)]


def _keyed(df: DataFrame) -> DataFrame:
    """(v, key): vectors as arrays, and a hash of the id, or of the vector where there is none."""
    v = vector_to_array("features")
    return df.select(v.alias("v"), (F.xxhash64("id") if "id" in df.columns else F.xxhash64(v)).alias("key"))


def best_of(fits: list[Clusters]) -> Clusters:
    """The fit of the least cost, the first of equals."""
    return min(fits, key=lambda f: f.cost)


def kmeans(df: DataFrame, k: int, seed: int = 0, restarts: int = RESTARTS) -> Clusters:
    """The fit of the least cost over restarts, the first of equals, on vector column `features`."""
    return best_of(fit_many(df, [(View(), k, seed + r) for r in range(restarts)]))


def silhouette(df: DataFrame, label: str = "label", vector: str = "v", key: str = "id", block: int = 2000) -> DataFrame:
    """(key, label, a, b, s): exact Euclidean silhouettes of a stated set against itself, in blocks.

    Every block of `block` rows meets every other once, a pair of blocks being a group of bounded size, of which there
    are as many as the set asks for; a group's distances are summed by (row, other's cluster) at once in numpy, and
    only these sums travel. Quadratic in the set: hand in a sample of a size that you can bear.
    """
    blocks = max(1, -(-df.count() // block))
    own = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    rows = df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("v"), own.alias("own"))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    sides = rows.select("*", F.explode(every).alias("other"), F.lit(True).alias("asks")).unionByName(rows.select("key", "label", "v", F.explode(every).alias("own"), F.col("own").alias("other"), F.lit(False).alias("asks")))

    def run(group: pa.Table) -> pa.Table:
        asks = group["asks"].to_numpy()
        v = np.array(group["v"].combine_chunks().flatten().to_numpy(), float).reshape(len(asks), -1)
        some, others = v[asks], v[~asks]
        d = np.sqrt(np.maximum((some**2).sum(1)[:, None] + (others**2).sum(1) - 2 * some @ others.T, 0))
        # Of distances too small for that form, the difference itself.
        for a, b in zip(*np.nonzero(d < 1e-3 * np.sqrt((some**2).sum(1))[:, None])):
            d[a, b] = np.sqrt(((some[a] - others[b]) ** 2).sum())
        kinds, at = np.unique(group["label"].to_numpy()[~asks], return_inverse=True)
        one = (at[:, None] == np.arange(len(kinds))).astype(float)
        mine = group.filter(pa.array(asks))
        spread = lambda c: c.take(pa.array(np.repeat(np.arange(len(mine)), len(kinds))))
        return pa.table({"i": spread(mine["key"]), "li": spread(mine["label"]), "lj": pa.array(np.tile(kinds, len(mine)), mine["label"].type), "d": (d @ one).ravel(), "n": np.tile(one.sum(0), len(mine))})

    kinds = T.StructType([T.StructField("i", rows.schema["key"].dataType), T.StructField("li", rows.schema["label"].dataType), T.StructField("lj", rows.schema["label"].dataType), T.StructField("d", T.DoubleType()), T.StructField("n", T.DoubleType())])
    sums = sides.groupBy("own", "other").applyInArrow(run, kinds).groupBy("i", "li", "lj").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    own = F.col("li") == F.col("lj")
    per = sums.groupBy("i", "li").agg(F.max(F.when(own, F.try_divide(F.col("d"), F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("d") / F.col("n"))).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return per.select(F.col("i").alias(key), F.col("li").alias(label), "a", "b", s.alias("s"))


def centroids(df: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"c_{c}") for c in columns])


def calinski_davies(df: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """One row: calinski_harabasz, davies_bouldin, n_clusters; null where there is one cluster. Only centres, one per cluster, are paired."""
    c = centroids(df, columns, label)
    whole = df.agg(F.count(F.lit(1)).alias("total"), *[F.avg(x).alias(f"g_{x}") for x in columns])
    sq = lambda pairs: sum(((a - b) * (a - b) for a, b in pairs), F.lit(0.0))
    far = df.join(F.broadcast(c), label).select(label, "n", sq([(F.col(x), F.col(f"c_{x}")) for x in columns]).alias("d2"))
    spread = far.groupBy(label).agg(F.sum("d2").alias("w"), F.avg(F.sqrt("d2")).alias("s"))
    full = c.join(spread, label).crossJoin(F.broadcast(whole))
    between = full.agg(F.sum(F.col("n") * sq([(F.col(f"c_{x}"), F.col(f"g_{x}")) for x in columns])).alias("B"), F.sum("w").alias("W"), F.count(F.lit(1)).alias("k"), F.max("total").alias("total"))
    one = c.join(spread, label).select(F.col(label).alias("l1"), F.col("s").alias("s1"), *[F.col(f"c_{x}").alias(f"x_{x}") for x in columns])
    two = c.join(spread, label).select(F.col(label).alias("l2"), F.col("s").alias("s2"), *[F.col(f"c_{x}").alias(f"y_{x}") for x in columns])
    ratio = F.try_divide(F.col("s1") + F.col("s2"), F.sqrt(sq([(F.col(f"x_{x}"), F.col(f"y_{x}")) for x in columns])))
    db = one.crossJoin(F.broadcast(two)).where("l1 != l2").groupBy("l1").agg(F.max(ratio).alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    ch = F.try_divide(F.col("B") / (F.col("k") - 1), F.col("W") / (F.col("total") - F.col("k")))
    return between.crossJoin(F.broadcast(db)).select(F.when(F.col("k") > 1, ch).alias("calinski_harabasz"), "davies_bouldin", F.col("k").alias("n_clusters"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row, ari, from the contingency counts."""
    two = lambda n: F.col(n) * (F.col(n) - 1) / 2
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    part = lambda c: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias(f"s_{c}"))
    row = cells.agg(F.sum(two("n")).alias("s"), F.sum("n").alias("n")).crossJoin(part(a)).crossJoin(part(b))
    expected = F.try_divide(F.col(f"s_{a}") * F.col(f"s_{b}"), two("n"))
    top = (F.col(f"s_{a}") + F.col(f"s_{b}")) / 2
    return row.select(F.coalesce(F.try_divide(F.col("s") - expected, top - expected), F.lit(1.0)).alias("ari"))


def auto_k(df: DataFrame, ks: range, seed: int = 0, restarts: int = RESTARTS, sample: int = SILHOUETTE_ROWS) -> tuple[int, list[float], list[float]]:
    """min(elbow, best silhouette) over ks on vector column `features` with a key `id`; also costs and mean silhouettes.

    k-means takes all rows. Silhouettes are quadratic, so they are of the `sample` rows with the smallest hashes of
    their ids; up to that many rows it is all of them.
    """
    fits = fit_many(df, [(View(), k, seed + r) for k in ks for r in range(restarts)])
    best = [best_of(fits[j * restarts : (j + 1) * restarts]) for j in range(len(ks))]
    some, costs, scores = df.orderBy(F.xxhash64("id"), "id").limit(sample), [m.cost for m in best], []
    for model in best:
        labelled = model.transform(some).select("id", F.col("prediction").alias("label"), vector_to_array("features").alias("v"))
        scores.append(silhouette(labelled).agg(F.avg("s")).first()[0])
    elbow = ks[int(np.argmin(np.gradient(costs)))] if len(ks) > 1 else ks[0]
    return min(elbow, ks[int(np.argmax(scores))]), costs, scores


def _ari(table: np.ndarray) -> float:
    """Adjusted Rand index of a contingency table."""
    two = lambda n: float((n * (n - 1) / 2).sum())
    a, b, whole = two(table.sum(1)), two(table.sum(0)), two(table.sum())
    expected = a * b / whole if whole else 0.0
    top = (a + b) / 2
    return (two(table) - expected) / (top - expected) if top != expected else 1.0


def stability(df: DataFrame, k: int, runs: int = 30, share: float = 0.8, noise: float = 0.05, seed: int = 0, restarts: int = RESTARTS) -> list[tuple[str, float, float, float]]:
    """(metric, median, p10, p90) of ARI under a subsample, another seed and Gaussian noise; vector column `features` and key `id`.

    All fits of all runs are made side by side, and all contingency tables in one pass.
    """
    v = vector_to_array("features")
    dims = len(df.select(v).first()[0])
    scale = np.maximum(np.array(df.agg(*[F.stddev_pop(v[d]) for d in range(dims)]).first(), float), 1e-8)
    plain = View()
    asked = [(plain, seed)]
    for r in range(runs):
        asked += [(View(seed + r, share), seed + 101 + r), (plain, seed + 301 + r), (plain, seed + 501 + r), (View(seed + r, 1.0, noise), seed + 701 + r)]
    fits = fit_many(df, [(view, k, first + j) for view, first in asked for j in range(restarts)], scale)
    best = [best_of(fits[j * restarts : (j + 1) * restarts]).centers for j in range(len(asked))]
    pairs = [pair for r in range(runs) for pair in ((0, 4 * r + 1), (4 * r + 2, 4 * r + 3), (0, 4 * r + 4))]

    def run(batches):
        tables = np.zeros((len(pairs), k, k))
        for x, key in _batches_of(batches):
            for t, (p, q) in enumerate(pairs):
                at, seen = asked[q][0].rows(x, key, scale)
                np.add.at(tables[t], (_far(x[at], best[p]).argmin(1), _far(seen, best[q]).argmin(1)), 1)
        t, p, q = np.nonzero(tables)
        yield pa.RecordBatch.from_pydict({"t": t, "p": p, "q": q, "n": tables[t, p, q]})

    tables = np.zeros((len(pairs), k, k))
    for c in _keyed(df).mapInArrow(run, "t long, p long, q long, n double").groupBy("t", "p", "q").agg(F.sum("n").alias("n")).collect():
        tables[c.t, c.p, c.q] = c.n
    ari = np.array([_ari(t) for t in tables]).reshape(runs, 3)
    return [(m, *(float(np.quantile(ari[:, j], q)) for q in (0.5, 0.1, 0.9))) for j, m in enumerate(("ari_subsample", "ari_seed", "ari_noise"))]


def cluster_centers(centers: np.ndarray, reducer=None, mean: np.ndarray | None = None, std: np.ndarray | None = None) -> np.ndarray:
    """Centres back through PCA and scaling, as far as those are given."""
    out = reducer.inverse(centers) if reducer is not None else centers
    return out * std + mean if std is not None else out


def cluster_sizes(df: DataFrame, label: str = "label") -> DataFrame:
    """Sizes by rank, largest first: free of labels' order."""
    w = Window.orderBy(F.desc("n"), label)
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("rank", F.row_number().over(w)).select("rank", "n")


class ClusteringPipeline:
    """Matrix, scaling, optional PCA (a Reducer or SplitReducer over the same columns), k-means with a given k or one chosen from a range."""

    def __init__(self, columns: list[str], k: int | range, reducer=None, exclude: tuple[str, ...] = (), seed: int = 0, restarts: int = RESTARTS):
        self.columns, self.k, self.reducer, self.seed, self.restarts = [c for c in columns if c not in exclude], k, reducer, seed, restarts

    def run(self, df: DataFrame) -> DataFrame:
        """Rows of df with every column present, and their cluster_id. Raises if there are none.

        These rows are written to the shared folder: scaling, reduction, fit and result read them, and no plan but the
        first has what they are made of.
        """
        df = materialize(df.na.drop(subset=self.columns), "features")
        stats = df.agg(F.count(F.lit(1)), *[F.avg(c) for c in self.columns], *[F.stddev_pop(c) for c in self.columns]).first()
        if not stats[0]:
            raise ValueError("no rows with features")
        n = len(self.columns)
        self.mean, std = np.array(stats[1 : n + 1], float), np.array(stats[n + 1 :], float)
        self.std = np.where(std > 0, std, 1.0)
        scaled = df.withColumns({f"__z_{c}": (F.col(c) - float(m)) / float(s) for c, m, s in zip(self.columns, self.mean, self.std)})
        inputs = [f"__z_{c}" for c in self.columns]
        if self.reducer is not None:
            view = scaled.select(*[F.col(f"__z_{c}").alias(c) for c in self.columns])
            self.reducer.fit(view)
            plain = scaled.select(F.struct(*df.columns).alias("__row"), *[F.col(f"__z_{c}").alias(c) for c in self.columns])
            reduced = self.reducer.transform(plain)
            inputs = [c for c in reduced.columns if c not in plain.columns]
            scaled = reduced.select("__row", *[F.col(c).alias(f"__p_{i}") for i, c in enumerate(inputs)])
            inputs = [f"__p_{i}" for i in range(len(inputs))]
        else:
            scaled = scaled.select(F.struct(*df.columns).alias("__row"), *inputs)
        matrix, _ = feature_matrix(scaled, inputs)
        matrix = matrix.select("__row", "features")
        self.chosen = self.k if isinstance(self.k, int) else auto_k(matrix.withColumn("id", F.xxhash64("__row")), self.k, self.seed)[0]
        # Last bits hang on the order of sums; a key without them makes the fit begin from the same rows whatever the partitions.
        key = F.xxhash64(F.transform(vector_to_array("features"), lambda x: F.round(x, 6)))
        self.model = kmeans(matrix.withColumn("id", key), self.chosen, self.seed, self.restarts)
        return self.model.transform(matrix).select("__row.*", F.col("prediction").alias("cluster_id"))

    def centers(self, spark, original: bool = True) -> DataFrame:
        """(cluster_id, columns): one row per cluster, back through PCA and, if `original`, scaling."""
        c = cluster_centers(self.model.centers, self.reducer, *((self.mean, self.std) if original else ()))
        return spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(c)], "cluster_id int, " + ", ".join(f"`{n}` double" for n in self.columns))
