"""k-means on district features and the measures of a clustering.

Features are one ``array<double>`` column.  What comes to the driver is model
parameters only: k centres, k sizes.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import nan_to_null
from ..storage import materialize, materialize_rdd
from .joins import sized_join
from .moments import covariance


def feature_columns(columns: list[str], key: str, race: list[str], drop_race: bool = False) -> list[str]:
    """All columns but the key, with or without the race columns."""
    return [c for c in columns if c != key and not (drop_race and c in race)]


def standardize(df: DataFrame, cols: list[str]) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Zero mean and unit population deviation; a constant column is only centred."""
    row = df.agg(*[F.avg(c) for c in cols], *[F.stddev_pop(c) for c in cols]).first()
    params = {c: (row[i], row[len(cols) + i] or 1.0) for i, c in enumerate(cols)}
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in params.items()}), params


def as_features(df: DataFrame, cols: list[str], name: str = "features") -> DataFrame:
    return df.withColumn(name, F.array(*[F.col(c).cast("double") for c in cols]))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def _dims(df: DataFrame, features: str) -> int:
    """Length of the feature arrays; they must be equally long and hold finite numbers only."""
    f = F.col(features)
    bad = f.isNull() | F.exists(f, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    n, missing, low, high = df.agg(F.count(F.lit(1)), F.count_if(bad), F.min(F.size(f)), F.max(F.size(f))).first()
    if not n:
        raise ValueError("no rows to cluster")
    if missing or low != high:
        shown = [r[0] for r in df.where(bad | (F.size(f) != high)).select(features).limit(3).collect()]
        raise ValueError(f"features: {missing} of {n} rows are NULL or hold a NULL, NaN or infinite value, "
                         f"or lengths differ ({low} to {high}), for example {shown}")
    return high


def _hash_uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """A number in 0..1 per row and salt, fixed by the row's hash."""
    z = h.astype(np.int64).view(np.uint64) ^ np.uint64((salt + 1) * 0xD1342543DE82EF95 % (1 << 64))
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xDABA0B6EB09322E3)
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xDABA0B6EB09322E3)
    return ((z ^ (z >> np.uint64(32))) >> np.uint64(11)).astype(float) / float(1 << 53)


def seed_rows(df: DataFrame, k: int, features: str = "features", rounds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Candidate centres and their weights by oversampling over all rows (k-means||).

    The first candidate is the row with the lowest hash.  In each round every
    row joins with a chance in proportion to its squared distance from the
    candidates so far, about 2k rows a round; the chances come from hashes of
    the rows, so a repeated task chooses the same.  At last each candidate is
    weighted by the rows nearest to it.  What comes to the driver is about
    2k * rounds rows.
    """
    rows = df.select(F.col(features).alias("f"), F.xxhash64(features).alias("h"))
    sc = df.sparkSession.sparkContext
    found = np.array([rows.orderBy("h").limit(1).first()["f"]], float)

    def near(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return next(_nearest(x, [c]))[1]

    def over(fn, schema: str) -> DataFrame:
        return rows.mapInPandas(fn, schema)

    for i in range(rounds):
        held = sc.broadcast(found)

        def cost(batches, held=held):
            total = 0.0
            for pdf in batches:
                total += float(near(np.array(pdf["f"].tolist(), float), held.value).sum())
            yield pd.DataFrame({"v": [total]})

        total = over(cost, "v double").agg(F.sum("v")).first()[0] or 0.0
        if total <= 0:                                     # every distinct row is a candidate
            break

        def draw(batches, held=held, total=total, i=i):
            for pdf in batches:
                x = np.array(pdf["f"].tolist(), float)
                take = _hash_uniform(pdf["h"].to_numpy(), i) * total < 2 * k * near(x, held.value)
                yield pd.DataFrame({"f": pd.Series(list(x[take]), dtype=object)})

        more = [r[0] for r in over(draw, "f array<double>").distinct().collect()]     # about 2k rows
        if more:
            found = np.concatenate([found, np.array(sorted(more), float)])
    sizes, *_ = _cluster_sums(df, features, [found])
    used = sizes[0] > 0
    return found[used], sizes[0][used]


def spread_centers(rows: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """First centres far from one another: each is the best of a few candidates drawn by weighted squared distance."""
    picks = [rows[rng.choice(len(rows), p=weights / weights.sum())]]
    near = ((rows - picks[0]) ** 2).sum(axis=1)
    for _ in range(1, k):
        chance = weights * near
        total = chance.sum()
        tries = rng.choice(len(rows), size=2 + int(np.log(k)), p=chance / total if total > 0 else weights / weights.sum())
        left = np.minimum(near[None], ((rows[None] - rows[tries][:, None]) ** 2).sum(axis=2))
        best = int(np.argmin(left @ weights))
        picks.append(rows[tries[best]])
        near = left[best]
    return np.array(picks)


ROWS_AT_ONCE = 512                                       # Fixed value: rows that a task compares with all centres together


def _matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix, without a Python object per row."""
    flat = np.asarray(column.flatten(), float)
    if column.null_count or not np.isfinite(flat).all():
        raise ValueError("a feature is NULL, NaN or infinite")
    return flat.reshape(len(column), -1)


def _slices(batches, column: str = "f", rows: int = ROWS_AT_ONCE):
    for batch in batches:
        x = _matrix(batch.column(column))
        for i in range(0, len(x), rows):
            yield batch.slice(i, rows), x[i:i + rows]


CENTRES_AT_ONCE = 1024                                   # Fixed value: centres whose products with 2 * ROWS_AT_ONCE rows a task holds in a round


SINGLE_RANGE = 1e15                                      # Fixed value: numbers whose products single precision holds


class _Stack:
    """The centres of many models under one another, models of equal size side by side, for one matrix product a slice.

    Rows are taken from the mean of all centres, which keeps the products small where data lie far from the origin.
    """

    def __init__(self, models: list[np.ndarray]):
        order = sorted(range(len(models)), key=lambda m: len(models[m]))
        self.order, self.sizes = order, [len(models[m]) for m in order]
        self.origin = np.concatenate(models).mean(axis=0)
        self.flat = np.concatenate([models[m] for m in order]) - self.origin
        self.half = (self.flat ** 2).sum(axis=1) / 2
        self.edges = np.cumsum([0, *self.sizes])

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Number of the nearest centre, in ``flat``, of every row and model; the lower one of equal centres."""
        far = self.half - (x - self.origin) @ self.flat.T
        found, m = np.empty((len(x), len(self.sizes)), dtype=np.int64), 0
        while m < len(self.sizes):
            k, last = self.sizes[m], m
            while last < len(self.sizes) and self.sizes[last] == k:
                last += 1
            part = far[:, self.edges[m]:self.edges[last]].reshape(len(x), last - m, k)
            found[:, m:last] = part.argmin(axis=2) + self.edges[m:last]
            m = last
        return found

    def members(self, found: np.ndarray) -> np.ndarray:
        """Rows by centres, 1 where a row belongs to a centre."""
        out = np.zeros((len(found), len(self.flat)))
        out[np.arange(len(found))[:, None], found] = 1.0
        return out

    def together(self):
        """Models of equal size side by side, few enough for one product: first and last centre, number of models, their size."""
        m = 0
        while m < len(self.sizes):
            k, last = self.sizes[m], m
            while last < len(self.sizes) and self.sizes[last] == k and (last == m or (last + 1 - m) * k <= CENTRES_AT_ONCE):
                last += 1
            yield int(self.edges[m]), int(self.edges[last]), last - m, k
            m = last

    def adder(self):
        """A function that adds the sums of rows, and at last their number, to an array of one row per centre.

        Products in single precision name the nearest centre wherever their rounding cannot hide another one.  Rows that
        this leaves open under a model are compared again in double precision, so each row goes where ``nearest`` sends it.
        """
        dims = self.flat.shape[1]
        single = np.abs(self.flat).max() < SINGLE_RANGE
        with np.errstate(over="ignore"):
            sides = np.column_stack([self.flat, -self.half]).astype(np.float32)
        sets = [(low, high, many, k, float(np.sqrt(2 * self.half[low:high].max()))) for low, high, many, k in self.together()]
        widest = max(high - low for low, high, *_ in sets)
        far, member = np.empty((widest, 2 * ROWS_AT_ONCE), np.float32), np.empty((widest, 2 * ROWS_AT_ONCE))

        def again(near: np.ndarray, low: int, high: int, x: np.ndarray) -> None:
            many, k, n = near.shape
            flat, half = self.flat[low:high].reshape(many, k, dims), self.half[low:high].reshape(many, k)
            model, row = np.nonzero(np.count_nonzero(near, axis=1) != 1)
            if 8 * len(row) > many * n:                    # the digits are too few for these rows and centres
                at = (self.half[low:high] - x @ self.flat[low:high].T).reshape(n, many, k).argmin(axis=2).T
                near[:] = at[:, None] == np.arange(k)[None, :, None]
                return
            step = max(1, (1 << 20) // (k * dims))
            for i in range(0, len(row), step):
                m, r = model[i:i + step], row[i:i + step]
                at = (half[m] - np.einsum("pkd,pd->pk", flat[m], x[r])).argmin(axis=1)       # equal centres give equal numbers
                near[m, :, r] = at[:, None] == np.arange(k)

        def add(x: np.ndarray, total: np.ndarray) -> None:
            n, moved, counted = len(x), x - self.origin, np.column_stack([x, np.ones(len(x))])
            fine = single and np.abs(moved).max(initial=0.0) < SINGLE_RANGE
            if fine:
                turned = np.ascontiguousarray(np.column_stack([moved, np.ones(n)]).T.astype(np.float32))
                norm = np.sqrt((moved ** 2).sum(axis=1))
            for low, high, many, k, reach in sets:
                if fine:
                    product = np.matmul(sides[low:high], turned, out=far[:high - low, :n] if n == far.shape[1] else None).reshape(many, k, n)
                    unsure = (2 * (dims + 8) * 2.0 ** -24) * (norm * reach + reach ** 2 / 2) + 1e-25
                    near = product >= (product.max(axis=1) - unsure.astype(np.float32))[:, None]
                else:
                    near = np.zeros((many, k, n), bool)
                if np.count_nonzero(near) != many * n:
                    again(near, low, high, moved)
                held = member[:high - low, :n]
                held[...] = near.reshape(high - low, n)
                total[low:high] += held @ counted

        return add

    def split(self, flat: np.ndarray) -> list[np.ndarray]:
        """Values of all centres, back in the models' own order."""
        parts = np.split(flat, self.edges[1:-1])
        return [part for _, part in sorted(zip(self.order, parts), key=lambda p: p[0])]


def _nearest(x: np.ndarray, models: list[np.ndarray]):
    """Labels and squared distances of rows under each model."""
    stack = _Stack(models)
    found = stack.nearest(x)
    where = {m: j for j, m in enumerate(stack.order)}
    for m, c in enumerate(models):
        lab = found[:, where[m]] - stack.edges[where[m]]
        yield lab, ((x - c[lab]) ** 2).sum(axis=1)


SUMMED = 64                                              # Fixed value: centres whose sums travel as one value


def _summed(df: DataFrame, partial, rows: int, columns: int) -> np.ndarray:
    """Sum of the (rows, columns) matrices that the tasks of ``mapInArrow(partial)`` make; a matrix travels in bands of SUMMED rows.

    Bands meet by number and are added one after another, so no task holds more than its bands and nothing but the sum
    comes to the driver.
    """
    def bands(batches):
        total = partial(batches)
        at = list(range(0, rows, SUMMED))
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, type=pa.int32()), "v": pa.array([total[i:i + SUMMED].tobytes() for i in at], type=pa.binary())})

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, v in zip(batch.column("at").to_pylist(), batch.column("v").to_pylist()):
                held[at] = held.get(at, 0.0) + np.frombuffer(v)
        yield pa.RecordBatch.from_pydict({"at": pa.array(list(held), type=pa.int32()), "v": pa.array([x.tobytes() for x in held.values()], type=pa.binary())})

    dealt = min(-(-rows // SUMMED), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = np.zeros((rows, columns))
    with _files_removed(df.sparkSession):
        for r in df.mapInArrow(bands, "at int, v binary").repartition(dealt, "at").mapInArrow(add, "at int, v binary").collect():
            out[r["at"]:r["at"] + SUMMED] = np.frombuffer(r["v"]).reshape(-1, columns)
    return out


@contextmanager
def _files_removed(spark: SparkSession):
    """Queries in here remove their shuffle files as they end; else those of hundreds of rounds wait for the driver's garbage collection."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _cluster_sums(df: DataFrame, features: str, models: list[np.ndarray], means: list[np.ndarray] | None = None, costs: bool = True):
    """Per model: cluster sizes, vector sums, squared distances to the centres, distances to ``means``.

    One job serves all models.  A task adds its rows to one array that holds
    these numbers for every cluster and hands over that alone.  Without
    ``costs`` only sizes and sums are taken, the rounds' way.
    """
    stack = _Stack(models)
    mean = None if means is None else np.concatenate([means[m] for m in stack.order])
    held = df.sparkSession.sparkContext.broadcast((stack, mean))
    dims, total = models[0].shape[1], len(stack.flat)

    def partial(batches) -> np.ndarray:
        st, mu = held.value
        acc = np.zeros((total, 3 + dims))
        if not costs:
            add, plain = st.adder(), np.zeros((total, dims + 1))
            for _, x in _slices(batches, rows=2 * ROWS_AT_ONCE):
                add(x, plain)
            acc[:, 0], acc[:, 3:] = plain[:, dims], plain[:, :dims]
            return acc
        for _, x in _slices(batches):
            found = st.nearest(x)
            member = st.members(found)
            acc[:, 0] += member.sum(axis=0)
            acc[:, 3:] += member.T @ x
            for j in range(found.shape[1]):
                at = found[:, j]
                acc[:, 1] += np.bincount(at, ((x - st.origin - st.flat[at]) ** 2).sum(axis=1), minlength=total)
                if mu is not None:
                    acc[:, 2] += np.bincount(at, np.sqrt(((x - mu[at]) ** 2).sum(axis=1)), minlength=total)
        return acc

    sums = _summed(df.select(F.col(features).alias("f")), partial, total, 3 + dims)
    held.destroy()                                         # a round's centres would stay on the disk of every machine
    per_model = stack.split(sums)
    return ([p[:, 0] for p in per_model], [p[:, 3:] for p in per_model],
            [p[:, 1] for p in per_model], [p[:, 2] for p in per_model])


def lloyd(df: DataFrame, starts: list[np.ndarray], features: str = "features", max_iter: int = 300,
          tol: float = 1e-4) -> list[tuple[np.ndarray, float, bool]]:
    """Run many k-means models together, one job per round; centres, inertia and whether it came to rest, of each.

    A model leaves the rounds once its centres move less than ``tol`` times
    the mean variance of the features, or after ``max_iter`` rounds.  An empty
    cluster keeps its centre.
    """
    dims = starts[0].shape[1]
    spread = df.agg(*[F.var_pop(F.col(features)[i]) for i in range(dims)]).first()
    limit = tol * float(np.mean([v or 0.0 for v in spread]))
    centers = [s.copy() for s in starts]
    active = list(range(len(starts)))
    for _ in range(max_iter):
        size, sums, *_ = _cluster_sums(df, features, [centers[i] for i in active], costs=False)
        still = []
        for j, i in enumerate(active):
            moved = np.where(size[j][:, None] > 0, sums[j] / np.maximum(size[j], 1)[:, None], centers[i])
            if ((moved - centers[i]) ** 2).sum() > limit:
                still.append(i)
            centers[i] = moved
        active = still
        if not active:
            break
    final = _cluster_sums(df, features, centers)[2]
    return [(c, float(w.sum()), i not in active) for i, (c, w) in enumerate(zip(centers, final))]


def fit_grid(df: DataFrame, grid: list[tuple[int, int]], restarts: int = 10, features: str = "features",
             max_iter: int = 300) -> list[tuple[np.ndarray, float, bool]]:
    """Best of the restarts for every (k, seed) of a grid, all fitted together; one that came to rest goes before one that did not."""
    _dims(df, features)
    rows, weights = seed_rows(df, max(k for k, _ in grid), features)
    starts = [spread_centers(rows, weights, k, np.random.default_rng((seed, r))) for k, seed in grid for r in range(restarts)]
    fits = lloyd(df, starts, features, max_iter)
    return [min(fits[i * restarts:(i + 1) * restarts], key=lambda f: (not f[2], f[1])) for i in range(len(grid))]


def _dealt(df: DataFrame, features: str) -> DataFrame:
    """The rows on at least as many tasks as run at once: few files would keep all rounds on few cores."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, F.xxhash64(features))


def fit_kmeans(df: DataFrame, k: int, seed: int = 42, restarts: int = 10, features: str = "features") -> tuple[np.ndarray, float]:
    """Centres and inertia of the best restart."""
    rows = _dealt(df.select(features), features).persist()
    try:
        n = rows.count()
        if n <= k:
            raise ValueError(f"{n} rows are too few for k={k}")
        centers, cost, rest = fit_grid(rows, [(k, seed)], restarts, features)[0]
        if not rest:
            raise ValueError(f"no fit for k={k} came to rest")
        return centers, cost
    finally:
        rows.unpersist()


def predict_many(df: DataFrame, models: list[np.ndarray], name: str = "labels", features: str = "features") -> DataFrame:
    """Nearest centre under each model as ``array<int>``."""
    held = df.sparkSession.sparkContext.broadcast(_Stack(models))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def nearest(f: pd.Series) -> pd.Series:
        st, x = held.value, np.array(f.tolist(), float).reshape(len(f), -1)
        if not np.isfinite(x).all():
            raise ValueError("a feature is NULL, NaN or infinite")
        labels = np.empty((len(x), len(st.order)), np.int32)
        for i in range(0, len(x), ROWS_AT_ONCE):
            labels[i:i + ROWS_AT_ONCE, st.order] = st.nearest(x[i:i + ROWS_AT_ONCE]) - st.edges[:-1]
        return pd.Series(list(labels))

    return df.withColumn(name, nearest(features))


def predict(df: DataFrame, centers: np.ndarray, name: str = "cluster", features: str = "features") -> DataFrame:
    return predict_many(df, [centers], "_l", features).withColumn(name, F.col("_l")[0]).drop("_l")


def cluster_centers(df: DataFrame, label: str, dims: int, features: str = "features") -> DataFrame:
    """Size and mean vector per cluster."""
    f = F.col(features)
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("size"),
                                 F.array(*[F.avg(f[i]) for i in range(dims)]).alias("center"))


def cluster_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("size"))


def centroid_profiles(df: DataFrame, label: str, cols: list[str]) -> DataFrame:
    """Cluster means per column with their z-score across clusters; equal means have none."""
    means = df.groupBy(label).agg(*[F.avg(c).alias(c) for c in cols])
    across = means.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"_s_{c}") for c in cols]).first()
    z = lambda c: F.try_divide(F.col(c) - F.lit(across[f"_m_{c}"]), F.lit(across[f"_s_{c}"]))
    return means.select(label, *cols, *[z(c).alias(f"z_{c}") for c in cols])


def center_distances(df: DataFrame, label: str, dims: int, features: str = "features") -> DataFrame:
    """Rows with the distance to the centre of their cluster."""
    centers = materialize(cluster_centers(df, label, dims, features).drop("size"))
    return sized_join(df, centers, [label]).withColumn(
        "dist_to_centroid", F.sqrt(squared_distance(F.col(features), F.col("center")))).drop("center")


def _scores(size: np.ndarray, center: np.ndarray, within: float, scatter: np.ndarray) -> dict[str, float]:
    """Inertia, Calinski-Harabasz and Davies-Bouldin from sizes, means and mean distances."""
    n, k = size.sum(), len(size)
    if k < 2 or n <= k:
        return {"inertia": within, "calinski_harabasz": None, "davies_bouldin": None}
    between = float(np.sum(size * np.sum((center - (size @ center) / n) ** 2, axis=1)))
    apart = np.sqrt(((center[:, None] - center[None]) ** 2).sum(axis=2))
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(apart > 0, (scatter[:, None] + scatter[None]) / apart, 0.0)
    np.fill_diagonal(ratio, 0.0)
    return {"inertia": within,
            "calinski_harabasz": float(between / (k - 1) / (within / (n - k))) if within > 0 else 1.0,
            "davies_bouldin": float(ratio.max(axis=1).mean())}


def cluster_scores(df: DataFrame, label: str, dims: int, features: str = "features") -> dict[str, float]:
    """Inertia, Calinski-Harabasz and Davies-Bouldin of given labels from per-cluster aggregates."""
    rows = center_distances(df, label, dims, features).groupBy(label).agg(
        F.count(F.lit(1)).alias("size"), F.sum(F.pow("dist_to_centroid", 2)).alias("within"),
        F.avg("dist_to_centroid").alias("scatter"),
        F.array(*[F.avg(F.col(features)[i]) for i in range(dims)]).alias("center")).collect()
    return _scores(np.array([r["size"] for r in rows], float), np.array([r["center"] for r in rows]),
                   float(sum(r["within"] for r in rows)), np.array([r["scatter"] for r in rows]))


def model_scores(df: DataFrame, models: list[np.ndarray], features: str = "features") -> list[dict[str, float]]:
    """The same for many fitted models at once, in two jobs."""
    size, sums, *_ = _cluster_sums(df, features, models)
    means = [np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c) for n, s, c in zip(size, sums, models)]
    _, _, within, apart = _cluster_sums(df, features, models, means)
    out = []
    for n, mu, w, a in zip(size, means, within, apart):
        used = n > 0
        out.append(_scores(n[used], mu[used], float(w.sum()), a[used] / n[used]))
    return out


def _distances(x: np.ndarray, y: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Distances of all rows of two matrices, by one product; pairs whose digits it would lose are taken apart again.

    The fewer, the nearer the origin is to the rows of one matrix.  They are held in ``room``, one number a pair.
    """
    nx, ny = (x ** 2).sum(axis=1), (y ** 2).sum(axis=1)
    d = np.matmul(x, -2 * y.T, out=room[:len(x) * len(y)].reshape(len(x), len(y)))
    d += nx[:, None]
    d += ny
    i, j = np.nonzero(d < (1e-4 * (nx + ny.max()))[:, None])
    for at in range(0, len(i), 1 << 14):
        p, q = i[at:at + (1 << 14)], j[at:at + (1 << 14)]
        d[p, q] = ((x[p] - y[q]) ** 2).sum(axis=1)
    return np.sqrt(np.maximum(d, 0.0, out=d), out=d)


LONG_RUN = 64                                            # Fixed value: rows with equal labels that are worth a slice of their own


def _labeled_slices(at: np.ndarray):
    """Slices of at most ROWS_AT_ONCE rows with the places in them where runs of equal labels begin; long runs stand apart."""
    starts = np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1])
    ends = np.append(starts[1:], len(at))
    apart = ends - starts >= LONG_RUN
    edges = np.unique(np.concatenate([starts[apart], ends[apart], [0, len(at)]]))
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
        for i in range(low, high, ROWS_AT_ONCE):
            j = min(i + ROWS_AT_ONCE, high)
            inner = starts[np.searchsorted(starts, i, "right"):np.searchsorted(starts, j)]
            yield i, j, np.concatenate([[0], inner - i])


def silhouettes(df: DataFrame, key: str, labels: str, features: str = "features", block_rows: int = 4096) -> DataFrame:
    """Euclidean silhouette of each row for each labeling; a singleton scores 0.

    ``labels`` is ``array<int>``, one entry per labeling, so one sweep serves a
    whole grid of fits.  All distances are needed.  Rows are cut into blocks
    by a hash of the key and stored once, a block a partition.  A task holds
    one block and one sum per row and cluster; the stored blocks stream past
    it, read where they lie, so that what is written grows with the rows and
    not with rows times blocks.  One matrix product a slice gives distances,
    another the sums of every cluster of every labeling.  Rows of equal labels
    lie together in a block, so that they are summed before that product and
    distances are taken from a point near them.  Neither pairs nor partial
    sums leave the task, and no task has two blocks.
    """
    each = df.select(F.posexplode(labels).alias("labeling", "own"))
    sizes = each.groupBy("labeling", "own").agg(F.count(F.lit(1)).alias("size")).orderBy("labeling", "own").collect()     # one row per cluster
    if not sizes:
        return df.select(F.col(key), F.lit(0).alias("labeling"), F.lit(0.0).alias("silhouette")).where("false")
    size = np.array([r["size"] for r in sizes], float)
    fits = max(r["labeling"] for r in sizes) + 1
    bounds = np.searchsorted([r["labeling"] for r in sizes], np.arange(fits + 1))
    names = np.split(np.array([r["own"] for r in sizes]), bounds[1:-1])
    spark = df.sparkSession
    held = spark.sparkContext.broadcast((names, size, bounds))
    n = df.count()
    spread = min(spark.sparkContext.defaultParallelism, -(-n // 256))          # a small table still keeps the cores busy
    blocks = max(1, spread * -(-n // (block_rows * max(1, spread))))           # whole turns of the cores
    kind = df.schema[key].dataType.simpleString()
    own = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    rows = df.select(F.col(key).alias("key"), F.col(features).cast("array<double>").alias("f"), F.col(labels).alias("l"), own.alias("block"))
    dealt = rows.repartitionById(blocks, F.col("block")).sortWithinPartitions(F.element_at("l", -1), F.xxhash64("l"))

    def pack(batches):
        names_of, n_of, cut = held.value
        parts = [batch for batch in batches if len(batch)]
        if not parts:
            return
        wide = np.concatenate([np.asarray(p.column("l").flatten()).reshape(len(p), -1) for p in parts])
        at = np.column_stack([cut[j] + np.searchsorted(names_of[j], wide[:, j]) for j in range(wide.shape[1])])        # the column of each row's cluster, by labeling
        keys = pa.concat_arrays([p.column("key") for p in parts])
        yield pa.RecordBatch.from_pydict({
            "n": pa.array([len(at)], type=pa.int32()), "key": pa.array([_sent({"key": keys})], type=pa.binary()),
            "f": pa.array([np.concatenate([_matrix(p.column("f")) for p in parts]).tobytes()], type=pa.binary()),
            "at": pa.array([at.astype(np.min_scalar_type(len(n_of))).tobytes()], type=pa.binary())})

    def score(pairs):
        _, n_of, cut = held.value
        keys = x = mine = sums = None

        def opened(block):
            n, _, f, at = block
            return np.frombuffer(f).reshape(n, -1), np.frombuffer(at, np.min_scalar_type(len(n_of))).reshape(n, -1)

        for block, passing in pairs:
            if x is None:                                    # the same block in all pairs of a task
                keys, (x, mine) = block[1], opened(block)
                sums = np.zeros((len(x), len(n_of)))
                room, more = np.empty(ROWS_AT_ONCE ** 2), np.empty((ROWS_AT_ONCE, len(n_of)))          # new memory for each product costs as much as adding it up
            wide, rows_of = opened(passing)
            for low, high, runs in _labeled_slices(rows_of):
                y = wide[low:high]
                origin = y.mean(axis=0)
                y = y - origin
                member = np.zeros((len(runs), len(n_of)))
                member[np.arange(len(runs))[:, None], rows_of[low + runs]] = 1.0
                for i in range(0, len(x), ROWS_AT_ONCE):
                    d = _distances(x[i:i + ROWS_AT_ONCE] - origin, y, room)
                    if len(runs) < len(y):
                        d = np.add.reduceat(d, runs, axis=1)
                    sums[i:i + ROWS_AT_ONCE] += np.matmul(d, member, out=more[:len(d)])
        if x is None:
            return
        row, keys = np.arange(len(x)), pa.ipc.open_stream(keys).read_next_batch().column("key")
        for j in range(len(cut) - 1):
            at = mine[:, j].astype(np.int64) - cut[j]
            total, counts = sums[:, cut[j]:cut[j + 1]], n_of[cut[j]:cut[j + 1]]
            alone = counts[at] == 1
            a = total[row, at] / np.maximum(counts[at] - 1, 1)
            mean = total / counts
            mean[row, at] = np.inf
            b = mean.min(axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                s = (b - a) / np.maximum(a, b)
            yield (_sent({"key": keys, "labeling": pa.array([j] * len(s), type=pa.int32()), "silhouette": pa.array(np.where(alone | ~np.isfinite(s), 0.0, s))}),)

    def arrived(batches):
        for batch in batches:
            for v in batch.column("v"):
                yield from pa.ipc.open_stream(v.as_buffer())

    one = dealt.mapInArrow(pack, "n int, key binary, f binary, at binary").rdd.map(lambda r: (r["n"], bytes(r["key"]), bytes(r["f"]), bytes(r["at"])))
    stored = materialize_rdd(spark, one)
    scored = stored.cartesian(stored.coalesce(1)).mapPartitions(score)             # pairs of blocks: a task reads all files, one after another
    return spark.createDataFrame(scored, "v binary", verifySchema=False).mapInArrow(arrived, f"key {kind}, labeling int, silhouette double").withColumnRenamed("key", key)


def _sent(columns: dict[str, pa.Array]) -> bytes:
    """Columns as one Arrow stream."""
    batch, sink = pa.RecordBatch.from_pydict(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def linear_silhouette(df: DataFrame, label: str, dims: int, features: str = "features") -> DataFrame:
    """Squared-distance silhouette per row in one pass.

    The mean squared distance to a cluster follows from its size, mean vector
    and mean squared norm, so the work grows with rows times clusters.
    """
    f = F.col(features)
    norm = F.aggregate(f, F.lit(0.0), lambda s, v: s + v * v)
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg(norm).alias("q"),
                                 F.array(*[F.avg(f[i]) for i in range(dims)]).alias("m")).collect()
    mean_sq = {r[label]: norm + F.lit(r["q"]) - F.lit(2.0) * F.aggregate(
        F.zip_with(f, F.array(*[F.lit(v) for v in r["m"]]), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
        for r in rows}
    own = F.lit(None).cast("double")
    for r in rows:
        scale = r["n"] / (r["n"] - 1) if r["n"] > 1 else 0.0
        own = F.when(F.col(label) == r[label], mean_sq[r[label]] * scale).otherwise(own)
    others = [F.when(F.col(label) != c, v) for c, v in mean_sq.items()]
    nearest = F.least(*others) if len(others) > 1 else F.lit(None).cast("double")
    single = F.col(label).isin(*[r[label] for r in rows if r["n"] == 1])
    placed = df.withColumns({"_a": own, "_b": nearest})
    return placed.withColumn("silhouette", F.when(single, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("_b") - F.col("_a"), F.greatest("_a", "_b")), F.lit(0.0)))).drop("_a", "_b")


def model_silhouettes(df: DataFrame, models: list[np.ndarray], features: str = "features") -> list[float | None]:
    """Mean squared-distance silhouette of every model's labels, all models in two passes over the rows.

    The mean squared distance from a row to a cluster follows from the
    cluster's size, mean vector and mean squared norm.
    """
    size, sums, *_ = _cluster_sums(df, features, models)
    means = [np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c) for n, s, c in zip(size, sums, models)]
    held = df.sparkSession.sparkContext.broadcast((models, size, means))

    def norms(batches):
        ms, n, _ = held.value
        acc = [np.zeros(len(c)) for c in ms]
        for pdf in batches:
            x = np.array(pdf["f"].tolist(), float)
            for m, (lab, _) in enumerate(_nearest(x, ms)):
                acc[m] += np.bincount(lab, (x ** 2).sum(axis=1), minlength=len(ms[m]))
        yield pd.DataFrame({"m": np.repeat(np.arange(len(ms)), [len(a) for a in acc]),
                            "c": np.concatenate([np.arange(len(a)) for a in acc]), "v": np.concatenate(acc)})

    rows = df.select(F.col(features).alias("f"))
    total = [np.zeros(len(c)) for c in models]
    for r in rows.mapInPandas(norms, "m int, c int, v double").groupBy("m", "c").agg(F.sum("v").alias("v")).collect():
        total[r["m"]][r["c"]] = r["v"]                      # one number per centre
    held_norms = df.sparkSession.sparkContext.broadcast([t / np.maximum(n, 1) for t, n in zip(total, size)])

    def score(batches):
        ms, n, mu = held.value
        acc = np.zeros(len(ms))
        for pdf in batches:
            x = np.array(pdf["f"].tolist(), float)
            own_norm = (x ** 2).sum(axis=1)
            for m, (lab, _) in enumerate(_nearest(x, ms)):
                d = np.maximum(own_norm[:, None] + held_norms.value[m][None] - 2 * x @ mu[m].T, 0)
                d[:, n[m] == 0] = np.inf
                at = np.arange(len(x))
                size_own = n[m][lab]
                a = d[at, lab] * size_own / np.maximum(size_own - 1, 1)
                d[at, lab] = np.inf
                b = d.min(axis=1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    s = np.where((size_own > 1) & np.isfinite(b) & (np.maximum(a, b) > 0), (b - a) / np.maximum(a, b), 0.0)
                acc[m] += s.sum()
        yield pd.DataFrame({"m": np.arange(len(ms)), "v": acc})

    out: list[float | None] = [None] * len(models)
    for r in rows.mapInPandas(score, "m int, v double").groupBy("m").agg(F.sum("v").alias("v")).collect():
        used = int((size[r["m"]] > 0).sum())
        out[r["m"]] = float(r["v"] / size[r["m"]].sum()) if used > 1 else None
    return out


def k_search(df: DataFrame, key: str, k_grid, seeds, restarts: int = 10, features: str = "features",
             silhouette: str = "euclidean", max_iter: int = 300) -> DataFrame:
    """One row per (k, seed): inertia, silhouette, Calinski-Harabasz, Davies-Bouldin, and whether the fit came to rest.

    The whole grid is fitted, scored and judged together: the number of jobs
    is that of one fit.  The silhouette is that of distances, which needs all
    of them; ``silhouette="squared"`` scores by squared distances in time
    linear in the rows, and may prefer another k.
    """
    if silhouette not in ("squared", "euclidean"):
        raise ValueError("silhouette is 'squared' or 'euclidean'")
    grid = [(k, s) for k in k_grid for s in seeds]
    rows = _dealt(df.select(key, features), features).persist()
    try:
        n = rows.count()
        if n < max(k_grid):
            raise ValueError(f"{n} rows are fewer than the largest k {max(k_grid)}")
        fits = fit_grid(rows, grid, restarts, features, max_iter)
        models = [c for c, *_ in fits]
        scores = model_scores(rows, models, features)
        if silhouette == "squared":
            sil = dict(enumerate(model_silhouettes(rows, models, features)))
        else:
            labeled = predict_many(rows, models, "labels", features).persist()               # read four times
            try:
                sil = {r["labeling"]: r["s"] for r in silhouettes(labeled, key, "labels", features)
                       .groupBy("labeling").agg(F.avg("silhouette").alias("s")).collect()}
            finally:
                labeled.unpersist()
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame(
        [(k, s, sc["inertia"], sil.get(i), sc["calinski_harabasz"], sc["davies_bouldin"], n, models[i].shape[1], fits[i][2])
         for i, ((k, s), sc) in enumerate(zip(grid, scores))],
        "k int, random_state int, inertia double, silhouette double, calinski_harabasz double, "
        "davies_bouldin double, n_samples bigint, n_features int, converged boolean")


def k_search_summary(fits: DataFrame) -> DataFrame:
    """Means per k, best first: silhouette down, Davies-Bouldin up, Calinski-Harabasz down."""
    return fits.groupBy("k").agg(
        F.avg("silhouette").alias("silhouette_mean"), F.stddev_samp("silhouette").alias("silhouette_std"),
        F.avg("calinski_harabasz").alias("ch_mean"), F.avg("davies_bouldin").alias("db_mean"),
        F.avg("inertia").alias("inertia_mean"),
    ).orderBy(F.desc("silhouette_mean"), F.asc("db_mean"), F.desc("ch_mean"))


def best_k(summary: DataFrame) -> int:
    best = F.max_by("k", F.struct("silhouette_mean", -F.col("db_mean"), "ch_mean"))
    return summary.agg(best.alias("k")).first()["k"]


def compactness_pca(df: DataFrame, metrics: list[str], sign_by: str = "mean") -> tuple[DataFrame, dict]:
    """First principal component of the standardized metrics as ``compactness_pca_score``.

    Missing metrics, NaN among them, take the column mean.  The sign makes the score rise with
    the mean metric, or with the metric named in ``sign_by``; ``sign_correction`` tells whether
    that turned the component whose largest loading is positive.  Both passes are single
    aggregations; the sign follows from the covariance.
    """
    known = {c: nan_to_null(F.col(c).cast("double")) for c in metrics}
    fill = df.agg(*[F.avg(known[c]).alias(c) for c in metrics]).first()
    filled = df.select(*[F.coalesce(known[c], F.lit(fill[c])).alias(c) for c in metrics])
    mean, cov = covariance(filled, metrics)
    scale = np.where(np.diag(cov) > 0, np.sqrt(np.diag(cov)), 1.0)
    corr = cov / np.outer(scale, scale)
    values, vectors = np.linalg.eigh(corr)
    first = vectors[:, -1] * (1.0 if vectors[np.abs(vectors[:, -1]).argmax(), -1] > 0 else -1.0)
    along = corr @ first
    toward = along.mean() if sign_by == "mean" else along[metrics.index(sign_by)]
    sign = -1.0 if toward < 0 else 1.0
    first = first * sign
    score = F.lit(0.0)
    for c, w, m, s in zip(metrics, first, mean, scale):
        score = score + F.lit(float(w)) * (F.coalesce(known[c], F.lit(fill[c])) - F.lit(float(m))) / F.lit(float(s))
    meta = {"metrics": list(metrics), "scaler_mean": mean.tolist(), "scaler_scale": scale.tolist(),
            "pca_components": first.tolist(), "explained_variance_ratio": float(values[-1] / values.sum()), "sign_correction": sign}
    return df.withColumn("compactness_pca_score", score), meta


def compactness_index(df: DataFrame, metrics: list[str], sign_by: str = "polsby_popper") -> DataFrame:
    """The component rescaled to 0..1."""
    scored, _ = compactness_pca(df, metrics, sign_by)
    low, high = scored.agg(F.min("compactness_pca_score"), F.max("compactness_pca_score")).first()
    return scored.withColumn(
        "compactness_index", F.try_divide(F.col("compactness_pca_score") - F.lit(low), F.lit(high) - F.lit(low))
    ).drop("compactness_pca_score")
