"""Linear-regression classifier: split, model choice, threshold, scores, diagnostics.

Rows are read twice for the whole model search: once for the cross products of
the features per fold pair, once for the vote of every candidate at every
threshold.  Scaling, polynomial terms, penalties and inner folds then work on
those small matrices.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import dot
from ..storage import materialize
from .moments import grams
from .order_stats import ranked_values, uniform_hash

THRESHOLD_STEPS = 200                                  # Fixed value: grid 0, 0.005 .. 1
ALPHAS = np.logspace(-3, 3, 50)                        # Fixed value: penalty grid
L1_RATIOS = (0.2, 0.5, 0.8, 1.0)                       # Fixed value: elastic-net mixes


def stratified_split(df: DataFrame, key: str, label: str, test_share: float = 0.25, seed: int = 42) -> DataFrame:
    """Add ``is_test``: the same share of every class, chosen by a hash of the key.

    A class gives ``round(share * size)`` rows, the ones with the lowest hash.
    """
    hashed = df.select(key, label, uniform_hash(F.col(key), F.lit(seed)).alias("_h")).withColumn(
        "_o", F.struct("_h", key))
    ranked = ranked_values(hashed, [label], "_o", spread="hash", range_on="_h")
    test = ranked.where(F.col("below") < F.round(F.col("n") * F.lit(float(test_share)))).select(
        F.col(f"_o.{key}").alias(key), F.lit(True).alias("is_test"))
    return df.join(test, key, "left").withColumn("is_test", F.coalesce("is_test", F.lit(False)))


def fold_of(key, folds: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).cast("int")


def equal_folds(df: DataFrame, key: str, folds: int, seed: int, name: str) -> DataFrame:
    """Fold of every key: the rank of its hash modulo the folds, so that sizes differ by one at most, however few the rows."""
    hashed = df.select(key, uniform_hash(F.col(key), F.lit(seed)).alias("_h")).withColumn("_o", F.struct("_h", key))
    ranked = ranked_values(hashed, [], "_o", spread="hash", range_on="_h")
    return ranked.select(F.col(f"_o.{key}").alias(key), (F.col("below") % folds).cast("int").alias(name))


# ---- penalised fits on a small matrix of cross products ---------------------------------

@dataclass
class Spec:
    """A candidate: penalty family and whether degree-two terms are added."""
    name: str
    family: str = "ols"
    poly: bool = False


CANDIDATES = tuple(Spec(f + ("_poly" if p else ""), f, p)
                   for p in (False, True) for f in ("ols", "ridge", "lasso", "elasticnet"))


@dataclass
class Fit:
    spec: Spec
    names: list[str]
    coef: np.ndarray                                    # on the scaled design
    raw: np.ndarray                                     # on the raw basis, first entry is the constant
    penalty: dict = field(default_factory=dict)


@dataclass
class Basis:
    """Raw columns whose cross products determine every candidate design."""
    numeric: list[str]
    category: str | None
    levels: list[str]

    @property
    def squares(self) -> list[tuple[int, int]]:
        m = len(self.numeric)
        return [(i, j) for i in range(m) for j in range(i, m)]

    def columns(self) -> dict[str, Column]:
        out = {"_one": F.lit(1.0)}
        out |= {f"_x{i}": F.col(c).cast("double") for i, c in enumerate(self.numeric)}
        out |= {f"_q{i}_{j}": F.col(self.numeric[i]).cast("double") * F.col(self.numeric[j]) for i, j in self.squares}
        out |= {f"_l{i}": F.coalesce(F.col(self.category) == v, F.lit(False)).cast("double") for i, v in enumerate(self.levels)}
        return out

    def design(self, gram: np.ndarray, poly: bool) -> tuple[np.ndarray, list[str]]:
        """Linear map from raw basis to scaled design, fitted on the rows behind ``gram``."""
        m, width, n = len(self.numeric), len(gram), gram[0, 0]
        first_level = 1 + m + len(self.squares)
        unit = np.eye(width)

        def scaled(v: np.ndarray) -> np.ndarray:
            mean = (v @ gram[:, 0]) / n
            centred = v - mean * unit[0]
            sd = np.sqrt(max(centred @ gram @ centred / n, 0.0))
            return centred / (sd if sd > 1e-12 else 1.0)

        seen = [i for i in range(len(self.levels)) if gram[first_level + i, first_level + i] > 0]
        maps = [unit[first_level + i] for i in seen[1:]]
        names = [f"{self.category}_{self.levels[i]}" for i in seen[1:]]
        z = [scaled(unit[1 + i]) for i in range(m)]
        names += list(self.numeric)
        if not poly:
            return np.array(maps + z).T, names
        products = []
        for i, j in self.squares:                       # z_i * z_j written in the raw basis
            v = z[i][0] * z[j] + z[j][0] * z[i] - z[i][0] * z[j][0] * unit[0]
            v = v + z[i][1 + i] * z[j][1 + j] * unit[1 + m + self.squares.index((i, j))]
            products.append(v)
            names.append(f"{self.numeric[i]}^2" if i == j else f"{self.numeric[i]} {self.numeric[j]}")
        return np.array(maps + [scaled(v) for v in z + products]).T, names


def _centred(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """X'X, X'y about the means, the means and the row count, from products of (1, X, y)."""
    n = g[0, 0]
    mean = g[0] / n
    c = g - n * np.outer(mean, mean)
    return c[1:-1, 1:-1], c[1:-1, -1], mean[1:-1], mean[-1], n


def descend(a: np.ndarray, b: np.ndarray, l1: np.ndarray, l2: np.ndarray, tol: float) -> np.ndarray:
    """Minimise w'aw/2 - b'w + l1*|w|_1 + l2*|w|^2/2 for a stack of problems at once."""
    w, r = np.zeros_like(b), b.copy()                   # r = b - aw, kept up to date
    step = np.einsum("kjj->kj", a) + l2[:, None]
    safe, cols = np.where(step > 0, step, 1.0), np.ascontiguousarray(np.swapaxes(a, 1, 2))
    for _ in range(10_000):
        moved = 0.0
        for j in range(b.shape[1]):
            rho = r[:, j] + a[:, j, j] * w[:, j]
            new = np.where(step[:, j] > 0, np.sign(rho) * np.maximum(np.abs(rho) - l1, 0.0) / safe[:, j], 0.0)
            change = new - w[:, j]
            moved = max(moved, float(np.max(np.abs(change), initial=0.0)))
            w[:, j] = new
            r -= cols[:, j] * change[:, None]
        if moved <= tol * float(np.max(np.abs(w), initial=0.0)):
            return w
    raise ValueError("a penalised fit did not converge in 10,000 rounds")


def penalised_stack(grams_: list[np.ndarray], family: str, alphas: np.ndarray, ratios: np.ndarray,
                    tol: float = 1e-10) -> np.ndarray:
    """Intercept and coefficients [matrix, penalty, term] from products of (1, X, y).

    ols       least squares, smallest norm when the design is singular
    ridge     RSS + alpha * |w|^2
    lasso     RSS / 2n + alpha * |w|_1
    elastic   RSS / 2n + alpha * (ratio * |w|_1 + (1 - ratio) / 2 * |w|^2)
    """
    parts = [_centred(g) for g in grams_]
    f, k, p = len(parts), len(alphas), len(parts[0][1])
    if family == "ols":
        w = np.array([[np.linalg.pinv(xx, rcond=1e-12, hermitian=True) @ xy] * k for xx, xy, *_ in parts])
    elif family == "ridge":
        w = np.array([np.linalg.solve(xx[None] + alphas[:, None, None] * np.eye(p), np.tile(xy, (k, 1))[..., None])[..., 0]
                      for xx, xy, *_ in parts])
    else:
        a = np.repeat([xx / n for xx, _, _, _, n in parts], k, axis=0)
        b = np.repeat([xy / n for _, xy, _, _, n in parts], k, axis=0)
        w = descend(a, b, np.tile(alphas * ratios, f), np.tile(alphas * (1 - ratios), f), tol).reshape(f, k, p)
    const = np.array([my - w[i] @ mx for i, (_, _, mx, my, _) in enumerate(parts)])
    return np.concatenate([const[..., None], w], axis=2)


def penalised(g: np.ndarray, family: str, alpha: float = 0.0, ratio: float = 1.0) -> np.ndarray:
    return penalised_stack([g], family, np.array([alpha]), np.array([ratio]))[0, 0]


def _sse(g: np.ndarray, beta: np.ndarray) -> float:
    v = np.append(-beta, 1.0)
    return float(v @ g @ v)


def _choose_penalty(family: str, parts: list[np.ndarray]) -> dict:
    """Penalty with the best mean held-out score over the inner folds; the first best one wins."""
    if family == "ols":
        return {}
    alphas = ALPHAS if family == "ridge" else ALPHAS[::-1]
    mixes = L1_RATIOS if family == "elasticnet" else (1.0,)
    alpha, ratio = np.tile(alphas, len(mixes)), np.repeat(mixes, len(alphas))
    total, scores = sum(parts), []
    held_out = [p for p in parts if 0 < p[0, 0] < total[0, 0]]
    fits = penalised_stack([total - h for h in held_out], family, alpha, ratio, tol=1e-5) if held_out else []
    for held, beta in zip(held_out, fits):
        v = np.column_stack([-beta, np.ones(len(alpha))])
        err = np.einsum("ki,ij,kj->k", v, held, v)
        spread = held[-1, -1] - held[0, -1] ** 2 / held[0, 0]
        if family == "ridge":                            # judged by R2, the others by squared error
            scores.append(1 - err / spread if spread > 0 else np.zeros(len(alpha)))
        else:
            scores.append(-err / held[0, 0])
    if not scores:
        return {"alpha": float(alpha[0]), "ratio": float(ratio[0])}
    best = int(np.argmax(np.mean(scores, axis=0)))
    return {"alpha": float(alpha[best]), "ratio": float(ratio[best])}


def fit_from_grams(basis: Basis, spec: Spec, parts: list[np.ndarray]) -> Fit:
    """Fit one candidate from raw-basis products (label last), one matrix per inner fold."""
    total = sum(parts)
    to_design, names = basis.design(total[:-1, :-1], spec.poly)
    width = len(total) - 1
    t = np.zeros((len(total), to_design.shape[1] + 2))
    t[0, 0], t[:width, 1:-1], t[-1, -1] = 1.0, to_design, 1.0
    inner = [t.T @ p @ t for p in parts]
    penalty = _choose_penalty(spec.family, inner)
    beta = penalised(sum(inner), spec.family, penalty.get("alpha", 0.0), penalty.get("ratio", 1.0))
    raw = to_design @ beta[1:]
    raw[0] += beta[0]
    return Fit(spec, names, beta[1:], raw, penalty)


# ---- thresholds ---------------------------------------------------------------------------

def threshold_bin(score: Column) -> Column:
    """Number of grid thresholds at or below the score."""
    s = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
    near = F.floor(s * THRESHOLD_STEPS).cast("int")
    at = lambda i: i / F.lit(float(THRESHOLD_STEPS))
    return (F.when(at(near) > s, near).when((at(near + 1) <= s), near + 2).otherwise(near + 1)).cast("int")


def threshold_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """Balanced accuracy at each of the grid thresholds.

    Rows fall into 202 score bins, combined before the shuffle; the counts at
    or above a threshold are running sums over those bins.
    """
    spark = df.sparkSession
    pos = F.col(label).cast("int") == 1
    bins = df.groupBy(threshold_bin(F.col(score)).alias("bin")).agg(
        F.count_if(pos).alias("pos"), F.count_if(~pos).alias("neg"))
    grid = spark.range(0, THRESHOLD_STEPS + 2).select(F.col("id").cast("int").alias("bin"))
    w = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)   # 202 rows
    every = Window.partitionBy()
    full = grid.join(bins, "bin", "left").fillna(0, ["pos", "neg"])
    cum = full.select("bin", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"),
                      F.sum("pos").over(every).alias("n_pos"), F.sum("neg").over(every).alias("n_neg"))
    tpr, tnr = F.try_divide("tp", "n_pos"), F.lit(1.0) - F.try_divide("fp", "n_neg")
    return cum.where("bin >= 1").select(
        ((F.col("bin") - 1) / F.lit(float(THRESHOLD_STEPS))).alias("threshold"), "tp", "fp",
        F.when(F.col("n_pos") == 0, tnr).when(F.col("n_neg") == 0, tpr).otherwise((tpr + tnr) / 2).alias("balanced_accuracy"))


def best_threshold(df: DataFrame, score: str, label: str) -> DataFrame:
    """First threshold with the best balanced accuracy."""
    best = F.max_by(F.struct("threshold", "balanced_accuracy"), F.struct("balanced_accuracy", -F.col("threshold")))
    return threshold_curve(df, score, label).agg(best.alias("b")).select("b.*")


def _curve(counts: np.ndarray) -> np.ndarray:
    """Balanced accuracy per threshold from counts[label, bin]."""
    above = counts[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:].astype(float)
    neg, pos = counts.sum(axis=1)
    parts = ([above[1] / pos] if pos else []) + ([1 - above[0] / neg] if neg else [])
    return np.mean(parts, axis=0)


MAX_LEVELS = 1000                                      # Fixed value: the product matrix has its square


def category_levels(df: DataFrame, category: str) -> list:
    """The values of a category column, in order; more than MAX_LEVELS are an error, as each becomes a design column."""
    found = df.select(category).where(F.col(category).isNotNull()).distinct().limit(MAX_LEVELS + 1).collect()
    if len(found) > MAX_LEVELS:
        raise ValueError(f"{category} has more than {MAX_LEVELS} values; it is no category")
    return sorted(r[0] for r in found)


def search(df: DataFrame, key: str, label: str, numeric: list[str], category: str | None = None,
           folds: int = 5, seed: int = 42, candidates=CANDIDATES, fold: str | None = None) -> tuple[list[dict], Fit, dict]:
    """Cross-validate the candidates and refit the first best one on all rows.

    Folds are of equal size, shuffled by a hash of the key, or given by the
    column ``fold`` (0 .. folds - 1).  Returns the fold scores per candidate, the winning fit and its tuned
    threshold.
    """
    levels = [] if category is None else category_levels(df, category)
    basis = Basis(list(numeric), category, levels)
    cols = basis.columns()
    placed = df.join(equal_folds(df, key, folds, seed + 1, "_i"), key)
    placed = placed.withColumn("_f", F.col(fold)) if fold else placed.join(equal_folds(df, key, folds, seed, "_f"), key)
    rows = materialize(placed.select(*[e.alias(n) for n, e in cols.items()], F.col(label).cast("double").alias("_y"), "_f", "_i"))
    names = [*cols, "_y"]
    parts = grams(rows.withColumn("_g", F.col("_f") * folds + F.col("_i")), names, "_g")
    pick = lambda keep: [sum(g for (f, i), g in cells if keep(f) and i == j)                     # noqa: E731
                         for j in range(folds) if any(keep(f) and i == j for (f, i), _ in cells)]
    cells = [(divmod(g, folds), m) for g, m in parts.items()]
    outer = sorted({f for (f, _), _ in cells})
    fits = [(o, c, fit_from_grams(basis, c, pick(lambda f, o=o: f != o))) for c in candidates for o in outer]
    final = {c.name: fit_from_grams(basis, c, pick(lambda f: True)) for c in candidates}
    weights = np.array([f.raw for _, _, f in fits] + [final[c.name].raw for c in candidates])
    fold_ids = np.array([o for o, _, _ in fits] + [-1] * len(candidates))
    grid = np.arange(THRESHOLD_STEPS + 1) / float(THRESHOLD_STEPS)
    base, width = list(cols), THRESHOLD_STEPS + 2

    def votes(batches):
        acc = np.zeros((len(weights), 2, 2, width), dtype=np.int64)
        for pdf in batches:
            score = np.clip(pdf[base].to_numpy(float) @ weights.T, 0, 1)
            y, f = pdf["_y"].to_numpy(int), pdf["_f"].to_numpy()
            for m in range(len(weights)):
                b = np.searchsorted(grid, score[:, m], side="right")
                np.add.at(acc[m], ((f == fold_ids[m]).astype(int), y, b), 1)
        m, held, yy, b = np.nonzero(acc)
        yield pd.DataFrame({"m": m, "held": held, "y": yy, "b": b, "n": acc[m, held, yy, b]})

    counts = np.zeros((len(weights), 2, 2, width), dtype=np.int64)
    tallied = rows.mapInPandas(votes, "m int, held int, y int, b int, n bigint").groupBy("m", "held", "y", "b").agg(
        F.sum("n").alias("n"))
    for r in tallied.collect():                         # fits x 2 x 2 x 202 counts at most
        counts[r["m"], r["held"], r["y"], r["b"]] = r["n"]

    scores: dict[str, list[float]] = {c.name: [] for c in candidates}
    for m, (_, c, _) in enumerate(fits):
        tuned = int(np.argmax(_curve(counts[m, 0])))
        scores[c.name].append(float(_curve(counts[m, 1])[tuned]))
    results = [{"candidate": c.name, "poly": c.poly, "cv_balanced_accuracy_mean": float(np.mean(scores[c.name])),
                "cv_balanced_accuracy_std": float(np.std(scores[c.name]))} for c in candidates]
    best = max(results, key=lambda r: r["cv_balanced_accuracy_mean"])["candidate"]
    curve = _curve(counts[len(fits) + [c.name for c in candidates].index(best), 0])
    threshold = {"threshold": float(grid[np.argmax(curve)]), "balanced_accuracy": float(curve.max())}
    fit = final[best]
    fit.penalty |= {"basis": basis}
    return results, fit, threshold


def score_with(df: DataFrame, fit: Fit, name: str = "score") -> DataFrame:
    """Clipped prediction of a fit as one linear column expression."""
    value = F.lit(0.0)
    for w, e in zip(fit.raw, fit.penalty["basis"].columns().values()):
        value = value + F.lit(float(w)) * e
    return df.withColumn(name, F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def coefficient_table(df: DataFrame, fit: Fit) -> DataFrame:
    """Features by the size of their coefficient."""
    return df.sparkSession.createDataFrame(
        [(n, float(c)) for n, c in zip(fit.names, fit.coef)], "feature string, coef double"
    ).orderBy(F.abs("coef").desc(), "feature")


def classification_metrics(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    """Accuracy, balanced accuracy, F1, MSE, R2 and the confusion counts, in one aggregation."""
    y, s = F.col(label).cast("double"), F.col(score)
    hit = s >= F.lit(float(threshold))
    c = df.agg(
        F.count_if(hit & (y == 1)).alias("tp"), F.count_if(hit & (y == 0)).alias("fp"),
        F.count_if(~hit & (y == 1)).alias("fn"), F.count_if(~hit & (y == 0)).alias("tn"),
        F.avg(F.pow(y - s, 2)).alias("mse"), F.var_pop(y).alias("_var"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    recall = F.try_divide("tp", F.col("tp") + F.col("fn"))
    rest = F.try_divide("tn", F.col("tn") + F.col("fp"))
    return c.select(
        "tp", "fp", "fn", "tn", ((F.col("tp") + F.col("tn")) / n).alias("accuracy"),
        F.when(recall.isNull(), rest).when(rest.isNull(), recall).otherwise((recall + rest) / 2).alias("balanced_accuracy"),
        F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("f1"),
        "mse", F.when(F.col("_var") > 0, 1 - F.col("mse") / F.col("_var")).alias("r2"))


def class_report(df: DataFrame, predicted: str, label: str) -> DataFrame:
    """Precision, recall, F1 and support per class (0 where a ratio has no rows)."""
    both = F.explode(F.array(
        F.struct(F.col(label).alias("class"), F.lit(1).alias("is"), F.lit(0).alias("said")),
        F.struct(F.col(predicted).alias("class"), F.lit(0).alias("is"), F.lit(1).alias("said"))))
    right = (F.col(label) == F.col(predicted)).cast("int")
    t = df.select(both.alias("b"), right.alias("ok")).groupBy("b.class").agg(
        F.sum("b.is").alias("support"), F.sum("b.said").alias("_said"), F.sum(F.col("ok") * F.col("b.is")).alias("_ok"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return t.select("class", zero(F.try_divide("_ok", "_said")).alias("precision"),
                    zero(F.try_divide("_ok", "support")).alias("recall"),
                    zero(F.try_divide(2 * F.col("_ok"), F.col("_said") + F.col("support"))).alias("f1"), "support")


# ---- diagnostics ----------------------------------------------------------------------------

def ols_summary(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """Coefficient, standard error, t and p value per term."""
    rows = df.select(array_to_vector(F.array(*[F.col(c).cast("double") for c in cols])).alias("_v"),
                     F.col(label).cast("double").alias("_y"))
    model = LinearRegression(featuresCol="_v", labelCol="_y", solver="normal").fit(rows)
    s = model.summary
    est = [*model.coefficients.toArray(), model.intercept]
    return df.sparkSession.createDataFrame(
        [(n, float(b), float(e), float(t), float(p)) for n, b, e, t, p in
         zip([*cols, "const"], est, s.coefficientStandardErrors, s.tValues, s.pValues)],
        "term string, coef double, std_error double, t_value double, p_value double")


def variance_inflation(df: DataFrame, cols: list[str]) -> DataFrame:
    """Uncentred variance inflation factor per column (no constant in the design)."""
    g = grams(df, cols)[0]
    inv = np.linalg.inv(g)
    return df.sparkSession.createDataFrame(
        [(c, float(g[i, i] * inv[i, i])) for i, c in enumerate(cols)], "feature string, vif double"
    ).orderBy(F.desc("vif"), "feature")


def influence(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """Leverage, residual and Cook's distance per row of a least-squares fit with constant.

    Only the inverse of X'X and the coefficients travel; rows are scored by
    native column arithmetic.
    """
    rows = df.withColumns({"_one": F.lit(1.0), "_y": F.col(label).cast("double")})
    terms = ["_one", *cols]
    g = grams(rows, [*terms, "_y"])[0]
    inv = np.linalg.pinv(g[:-1, :-1], hermitian=True)
    beta, p = inv @ g[:-1, -1], len(terms)
    s2 = _sse(g, beta) / (g[0, 0] - p)
    lev = F.lit(0.0)
    for i, a in enumerate(terms):
        lev = lev + F.col(a) * dot(inv[i], terms)
    out = rows.withColumns({"leverage": lev, "residual": F.col("_y") - dot(beta, terms)})
    h, r = F.col("leverage"), F.col("residual")
    return out.withColumn("cooks_d", F.try_divide(r * r * h, F.lit(float(p * s2)) * (1 - h) * (1 - h))).drop("_one", "_y")
