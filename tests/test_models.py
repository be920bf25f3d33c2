import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from wardatlas.operators import clustering as C
from wardatlas.operators import inference as I
from wardatlas.operators import mixture, profile
from wardatlas.operators import regression as R


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 4))
    x[:, 1] += 0.8 * x[:, 0]
    y = (x[:, 0] - 0.5 * x[:, 2] + 0.3 * rng.normal(size=400) > 0).astype(float)
    g = np.array(list("uvw"))[rng.integers(0, 3, 400)]
    df = spark.createDataFrame([(i, *map(float, r), float(v), str(k)) for i, (r, v, k) in enumerate(zip(x, y, g))],
                               "id int, a double, b double, c double, d double, y double, g string")
    return df, x, y, g


def blobs(spark, n=60):
    rng = np.random.default_rng(2)
    lab = rng.integers(0, 3, n)
    lab[0] = 3                                                        # a cluster of one
    x = rng.normal(size=(n, 3)) + lab[:, None] * 4
    df = spark.createDataFrame([(i, [float(v) for v in r], int(l), [int(l), i % 2]) for i, (r, l) in enumerate(zip(x, lab))],
                               "id int, features array<double>, label int, labels array<int>")
    return df, x, lab


def brute_silhouette(x, lab, power=1):
    d = (((x[:, None] - x[None]) ** 2).sum(axis=2)) ** (power / 2)
    out = []
    for i, l in enumerate(lab):
        own = (lab == l)
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == m].mean() for m in set(lab) if m != l)
        out.append((b - a) / max(a, b))
    return np.array(out)


@pytest.mark.parametrize("block", [7, 4096])
def test_silhouettes_match_brute_force(spark, block):
    df, x, lab = blobs(spark)
    got = {(r["id"], r["labeling"]): r["silhouette"] for r in C.silhouettes(df, "id", "labels", block_rows=block).collect()}
    for j, l in enumerate((lab, np.arange(len(x)) % 2)):
        assert [got[(i, j)] for i in range(len(x))] == pytest.approx(brute_silhouette(x, l))


def test_search_scores_by_distances(spark):
    """The k that all distances prefer, as the library of the study scores it; far-off, equal and single rows."""
    df, x, _ = blobs(spark)
    fits = {(r["k"], r["random_state"]): r["silhouette"] for r in C.k_search(df, "id", [2, 4, 5], [0, 1], restarts=2).collect()}
    rows, weights = C.seed_rows(df, 5)
    for (k, seed), got in fits.items():
        starts = [C.spread_centers(rows, weights, k, np.random.default_rng((seed, r))) for r in range(2)]
        centers = min(C.lloyd(df, starts), key=lambda f: (not f[2], f[1]))[0]
        lab = ((x[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert got == pytest.approx(brute_silhouette(x, lab).mean(), abs=1e-9)
    far = x + 1e6                                                        # distances of 1 between numbers of a million keep their digits
    moved = spark.createDataFrame([(i, v.tolist(), [int(i % 3)]) for i, v in enumerate(far)], "id int, features array<double>, labels array<int>")
    got = [r["silhouette"] for r in C.silhouettes(moved, "id", "labels", block_rows=16).orderBy("id").collect()]
    assert got == pytest.approx(brute_silhouette(far, np.arange(len(far)) % 3), abs=1e-9)
    assert C.silhouettes(moved.limit(0), "id", "labels").count() == 0


def test_silhouettes_take_one_block_a_task(spark):
    """Blocks that meet in a task by chance would make the longest one a multiple of a block."""
    rng = np.random.default_rng(4)
    x, l = rng.normal(size=(300, 3)), np.sort(rng.integers(0, 2, 300))
    x[:, 0] += 1e6 * l                                      # long runs of equal labels, far apart
    df = spark.createDataFrame([(i, x[i].tolist(), [int(l[i]), int(i % 3)]) for i in range(300)], "id bigint, features array<double>, labels array<int>")
    found = C.silhouettes(df, "id", "labels", block_rows=16)
    tasks = found.rdd.getNumPartitions()
    assert tasks * 16 >= 300
    rows = found.withColumn("task", F.spark_partition_id()).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(tasks))).collect()
    assert all(r["task"] == r["block"] for r in rows)
    got = {(r["id"], r["labeling"]): r["silhouette"] for r in rows}
    for j, lab in enumerate((l, np.arange(300) % 3)):
        assert [got[(i, j)] for i in range(300)] == pytest.approx(brute_silhouette(x, lab), abs=1e-9)


def shuffle_files(spark):
    """Sizes of the shuffle files that lie on disk, by path."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f: f.stat().st_size for d in folders for f in Path(d.getPath()).rglob("shuffle_*") if f.exists()}


def test_silhouettes_write_each_row_once(spark):
    """All rows pass every block; a copy of them for each block fills the disk."""
    rng = np.random.default_rng(5)
    x, lab = rng.normal(size=(1000, 16)), rng.integers(0, 3, 1000)
    df = spark.createDataFrame([(i, x[i].tolist(), [int(lab[i])]) for i in range(1000)], "id bigint, features array<double>, labels array<int>").persist()
    df.count()
    before = shuffle_files(spark)
    found = C.silhouettes(df, "id", "labels", block_rows=16)
    got = [r["silhouette"] for r in found.collect()]
    wrote = sum(size for f, size in shuffle_files(spark).items() if f not in before)
    assert wrote < 4 * x.nbytes
    assert np.mean(got) == pytest.approx(brute_silhouette(x, lab).mean(), abs=1e-9) and len(got) == 1000
    df.unpersist()


def test_rounds_leave_nothing_on_disk(spark):
    """Hundreds of rounds follow one another before the driver collects its garbage."""
    df, x, _ = blobs(spark, 600)
    rows, name = df.persist(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    assert rows.count() == len(x)
    temporary, setting = Path(spark.sparkContext._temp_dir), spark.conf.get(name)
    before, sent = shuffle_files(spark), set(temporary.iterdir())
    assert len(C.lloyd(rows, [x[:200], x[:300]], max_iter=4, tol=0.0)) == 2

    def left():                                             # the sums of 500 centres; what is smaller is the variance of the features
        return [f for f, size in shuffle_files(spark).items() if f not in before and size > 4000] + sorted(set(temporary.iterdir()) - sent)

    for _ in range(100):                                    # files go in the background
        if not left():
            break
        time.sleep(0.1)
    assert left() == [] and spark.conf.get(name) == setting
    rows.unpersist()


def test_slices_of_equal_labels():
    at = np.repeat([[0, 3], [1, 3], [0, 4], [1, 4]], [100, 3, 2, 1200], axis=0)
    slices = list(C._labeled_slices(at))
    assert [(i, j) for i, j, _ in slices] == [(0, 100), (100, 105), (105, 617), (617, 1129), (1129, 1305)]
    assert [r.tolist() for *_, r in slices] == [[0], [0, 3], [0], [0], [0]]


@pytest.mark.parametrize("shape", ["near", "apart", "far off", "copies", "huge", "tiny"])
def test_rounds_place_rows_as_double_precision_does(shape):
    """Rounds ask single precision first; what its digits cannot tell apart must not be told by it."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 16))
    if shape == "near":
        x[1:750] = x[0] + 1e-5 * x[1:750]
    if shape == "apart":
        x[np.arange(1500), np.arange(1500) % 5] += 1e6
    x = {"far off": x + 1e9, "huge": x * 1e20, "tiny": x * 1e-30}.get(shape, x)
    models = [x[rng.choice(1500, k, replace=False)] for k in (2, 3, 3, 7, 300) for _ in range(3)]
    if shape == "copies":                                   # the lower one of equal centres takes the rows
        models += [np.concatenate([c, c[:2], c]) for c in models[:9]] + [np.repeat(x[:1], 9, axis=0)]
    stack = C._Stack(models)
    found, add = np.zeros((len(stack.flat), 17)), stack.adder()
    for i in range(0, 1500, 1024):
        add(x[i:i + 1024], found)
    member = stack.members(stack.nearest(x))
    assert found[:, 16].tolist() == member.sum(axis=0).tolist()
    assert found[:, :16] == pytest.approx(member.T @ x, rel=1e-12, abs=1e-9 * np.abs(x).max())
    if shape == "copies":
        assert stack.split(found[:, 16])[-1].tolist() == [1500, *[0] * 8]


def test_search_labels_rows_once(spark, monkeypatch):
    """The silhouette reads the labels four times; each reading would ask all models again."""
    df, x, _ = blobs(spark)
    read, kept = C.silhouettes, []
    monkeypatch.setattr(C, "silhouettes", lambda rows, *a, **k: (kept.append(rows.storageLevel.useMemory), read(rows, *a, **k))[1])
    got = C.k_search(df, "id", (2, 3), (0,), restarts=2).orderBy("k").collect()
    assert kept == [True]
    fits = C.fit_grid(df, [(2, 0), (3, 0)], 2)
    for r, (centers, *_) in zip(got, fits):
        lab = C._Stack([centers]).nearest(x)[:, 0]
        assert r["silhouette"] == pytest.approx(brute_silhouette(x, lab).mean(), abs=1e-9)


def test_linear_silhouette_matches_brute_force(spark):
    df, x, lab = blobs(spark)
    got = [r["silhouette"] for r in C.linear_silhouette(df, "label", 3).orderBy("id").collect()]
    assert got == pytest.approx(brute_silhouette(x, lab, 2))


def test_cluster_scores_and_profiles(spark):
    df, x, lab = blobs(spark)
    s = C.cluster_scores(df, "label", 3)
    ks = sorted(set(lab))
    cen = np.array([x[lab == k].mean(axis=0) for k in ks])
    within = sum(((x[lab == k] - c) ** 2).sum() for k, c in zip(ks, cen))
    between = sum((lab == k).sum() * ((c - x.mean(axis=0)) ** 2).sum() for k, c in zip(ks, cen))
    sc = np.array([np.sqrt(((x[lab == k] - c) ** 2).sum(axis=1)).mean() for k, c in zip(ks, cen)])
    db = np.mean([max((sc[i] + sc[j]) / np.linalg.norm(cen[i] - cen[j]) for j in range(4) if j != i) for i in range(4)])
    assert s["inertia"] == pytest.approx(within) and s["davies_bouldin"] == pytest.approx(db)
    assert s["calinski_harabasz"] == pytest.approx(between / 3 / (within / (len(x) - 4)))
    flat = spark.createDataFrame([(0, 1.0, 2.0), (1, 1.0, 4.0)], "k int, p double, q double")
    prof = {r["k"]: r for r in C.centroid_profiles(flat, "k", ["p", "q"]).collect()}
    assert prof[0]["z_p"] is None and prof[0]["z_q"] == pytest.approx(-np.sqrt(0.5))


def test_kmeans_and_search(spark):
    df, x, lab = blobs(spark)
    costs = [C.fit_kmeans(df, k, 1, 4)[1] for k in (2, 3, 6)]
    assert costs == sorted(costs, reverse=True)
    with pytest.raises(ValueError):
        C.fit_kmeans(df, 60)
    centers, cost = C.fit_kmeans(df, 3, 1, 10)
    lab3 = C.predict(df, centers).orderBy("id").select("cluster").toPandas()["cluster"].to_numpy()
    assert sum(((x[lab3 == k] - x[lab3 == k].mean(axis=0)) ** 2).sum() for k in range(3)) == pytest.approx(cost)
    assert C.cluster_scores(C.predict(df, centers), "cluster", 3) == pytest.approx(C.model_scores(df, [centers])[0])
    fits = C.k_search(df, "id", [2, 3], [0], restarts=1)
    best = C.k_search_summary(fits).first()
    assert best["k"] == C.best_k(C.k_search_summary(fits)) and fits.count() == 2
    with pytest.raises(ValueError):
        C.k_search(df, "id", [99], [0])


def test_rounds_equal_plain_rounds_and_flags(spark):
    """Many models of several sizes in one run, far from the origin: the same centres as one model after another."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 1.0, (150, 3)) for c in ((1000, 0, 0), (1006, 0, 0), (1000, 6, 3))])
    df = C.as_features(spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double, c double"), list("abc"))
    starts = [x[rng.choice(len(x), k, replace=False)] for k in (4, 2, 3, 2, 5, 3)] + [np.vstack([x[:2], [[1e6, 0, 0]]])]
    limit = 1e-4 * x.var(axis=0).mean()

    def plain(c, rounds):
        for r in range(rounds):
            lab = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            new = np.array([x[lab == i].mean(axis=0) if (lab == i).any() else c[i] for i in range(len(c))])
            moved, c = ((new - c) ** 2).sum(), new
            if moved <= limit:
                return c, True
        return c, False

    for rounds in (1, 50):
        for s, (c, cost, rest) in zip(starts, C.lloyd(df, starts, max_iter=rounds)):
            want, still = plain(s.copy(), rounds)
            assert np.abs(c - want).max() < 1e-9 and rest == still
            assert cost == pytest.approx(((x[:, None] - want[None]) ** 2).sum(axis=2).min(axis=1).sum())
    fits = C.k_search(df.withColumn("id", F.monotonically_increasing_id()), "id", [2, 3], [0, 1], restarts=2, max_iter=1).collect()
    assert len(fits) == 4 and not all(r["converged"] for r in fits)


def test_pca_matches_eigenvectors(spark, table):
    df, x, *_ = table
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    val, vec = np.linalg.eigh(z.T @ z / len(z))
    v = vec[:, -1]
    v = v if np.corrcoef(z @ v, z.mean(axis=1))[0, 1] >= 0 else -v
    out, meta = C.compactness_pca(df, list("abcd"))
    assert meta["explained_variance_ratio"] == pytest.approx(val[-1] / val.sum())
    got = [r[0] for r in out.orderBy("id").select("compactness_pca_score").collect()]
    assert got == pytest.approx(z @ v)
    holed = df.withColumn("a", F.when(F.col("id") > 5, F.col("a")))
    assert C.compactness_pca(holed, list("abcd"))[0].where("compactness_pca_score is null").count() == 0
    ix = C.compactness_index(df, list("abcd"), "a").agg(F.min("compactness_index"), F.max("compactness_index"), F.corr("compactness_index", "a")).first()
    assert ix[0] == 0 and ix[1] == 1 and ix[2] > 0


def test_sign_correction_and_missing_metrics(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=80)
    rows = [(i, float(v), float(-v + 0.1 * w), float("nan") if i == 3 else float(-v)) for i, (v, w) in enumerate(zip(a, rng.normal(size=80)))]
    df = spark.createDataFrame(rows, "id int, p double, q double, r double")
    scores = {}
    for by in ("p", "q"):
        out, meta = C.compactness_pca(df, ["p", "q", "r"], sign_by=by)
        assert meta["sign_correction"] in (1.0, -1.0) and np.isfinite(meta["pca_components"]).all()
        scores[by] = meta
        assert out.where(F.isnan("compactness_pca_score") | F.col("compactness_pca_score").isNull()).count() == 0
    assert scores["p"]["sign_correction"] == -scores["q"]["sign_correction"]
    turned = np.array(scores["p"]["pca_components"]) * scores["p"]["sign_correction"]
    assert turned[np.abs(turned).argmax()] > 0


def test_pearson_takes_nan_as_missing(spark):
    import pandas as pd
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame(rng.normal(size=(50, 3)), columns=list("abc"))
    pdf.loc[3, "a"] = pdf.loc[7, "b"] = np.nan
    rows = [tuple(None if i == 9 and c == 2 else float(v) for c, v in enumerate(r)) for i, r in enumerate(pdf.to_numpy())]
    pdf.loc[9, "c"] = np.nan
    want = pdf.corr()
    for r in profile.pearson(spark.createDataFrame(rows, "a double, b double, c double"), list("abc")).collect():
        assert r["corr"] == pytest.approx(want.loc[r["col_a"], r["col_b"]])


def test_spearman(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 5, 200), rng.normal(size=200).round(1)
    df = spark.createDataFrame([(i, int(p), float(q)) for i, (p, q) in enumerate(zip(a, b))], "id int, a int, b double")

    def rank(v):
        return np.array([(v < t).sum() + ((v == t).sum() + 1) / 2 for t in v])

    assert profile.spearman(df, "id", ["a", "b"]).first()["corr"] == pytest.approx(np.corrcoef(rank(a), rank(b))[0, 1])


def mllib_fit(df, cols, label, family, alpha, ratio=1.0):
    """The same penalised fits with the library solver; penalties mapped to its scaling."""
    rows = df.select(array_to_vector(F.array(*[F.col(c).cast("double") for c in cols])).alias("_v"),
                     F.col(label).cast("double").alias("_y"))
    n, sd = rows.agg(F.count(F.lit(1)), F.stddev_pop("_y")).first()
    l1, l2 = {"ols": (0.0, 0.0), "ridge": (0.0, alpha * sd / n), "lasso": (alpha, 0.0),
              "elasticnet": (alpha * ratio, alpha * (1 - ratio) * sd)}[family]
    return LinearRegression(featuresCol="_v", labelCol="_y", standardization=False, regParam=l1 + l2,
                            elasticNetParam=l1 / (l1 + l2) if l1 + l2 else 0.0, tol=1e-12, maxIter=1000,
                            solver="normal" if l1 == 0 else "auto").fit(rows)


def test_penalised_fits_match_the_library(table):
    df, *_ = table
    g = R.grams(df.withColumn("one", F.lit(1.0)), ["one", *"abcd", "y"])[0]
    for family, alpha, ratio in (("ols", 0, 1), ("ridge", 7.0, 1), ("lasso", 0.02, 1), ("elasticnet", 0.05, 0.5)):
        m = mllib_fit(df, list("abcd"), "y", family, alpha, ratio)
        ours = R.penalised(g, family, alpha, ratio)
        assert ours == pytest.approx([m.intercept, *m.coefficients.toArray()], abs=2e-6)


@pytest.mark.parametrize("n", [7, 28, 500])
def test_folds_of_equal_size(spark, n):
    df = spark.range(n).select((F.col("id") * 17 + 3).alias("k"))
    sizes = [sorted(r["count"] for r in R.equal_folds(df, "k", 5, seed, "f").groupBy("f").count().collect()) for seed in (1, 2)]
    assert all(len(s) == 5 and s[-1] - s[0] <= 1 and sum(s) == n for s in sizes)
    a, b = ({r["k"]: r["f"] for r in R.equal_folds(d, "k", 5, 1, "f").collect()} for d in (df, df.repartition(3)))
    assert a == b


def test_design_from_cross_products_equals_direct_design(table):
    df, x, y, g = table
    basis = R.Basis(list("abcd"), "g", ["u", "v", "w"])
    cols = basis.columns()
    t = df.select(*[e.alias(n) for n, e in cols.items()], F.col("y").alias("_y"))
    fit = R.fit_from_grams(basis, R.Spec("ols_poly", "ols", True), list(R.grams(t, [*cols, "_y"]).values()))
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    q = np.column_stack([z] + [z[:, i] * z[:, j] for i in range(4) for j in range(i, 4)])
    q = (q - q.mean(axis=0)) / q.std(axis=0)
    full = np.column_stack([np.ones(len(y)), g == "v", g == "w", q]).astype(float)
    want = np.linalg.lstsq(full, y, rcond=None)[0]
    assert fit.coef == pytest.approx(want[1:], abs=1e-8)
    fit.penalty["basis"] = basis
    got = [r[0] for r in R.score_with(df, fit).orderBy("id").select("score").collect()]
    assert got == pytest.approx(np.clip(full @ want, 0, 1), abs=1e-8)


def test_search_picks_a_working_model(table):
    df, *_ = table
    results, fit, thr = R.search(df, "id", "y", list("abcd"), "g")
    assert len(results) == 8 and max(r["cv_balanced_accuracy_mean"] for r in results) > 0.85
    curve = R.threshold_curve(R.score_with(df, fit), "score", "y")
    best = R.best_threshold(R.score_with(df, fit), "score", "y").first()
    assert best["balanced_accuracy"] == pytest.approx(thr["balanced_accuracy"], abs=1e-9) and best["threshold"] == pytest.approx(thr["threshold"])
    assert curve.count() == 201
    m = R.classification_metrics(R.score_with(df, fit), "score", "y", thr["threshold"]).first()
    assert m["balanced_accuracy"] == pytest.approx(thr["balanced_accuracy"])


def test_threshold_bins_agree_with_comparison(spark):
    s = [i / 200 for i in range(201)] + [0.0049999, -1.0, 2.0, 0.3299999999, 0.33]
    df = spark.createDataFrame([(v,) for v in s], "s double")
    grid = np.arange(201) / 200.0
    got = [r[0] for r in df.select(R.threshold_bin(F.col("s"))).collect()]
    assert got == [int((grid <= min(max(v, 0), 1)).sum()) for v in s]


def test_one_class_metrics(spark):
    df = spark.createDataFrame([(0.9, 1), (0.1, 1)], "s double, y int")
    m = R.classification_metrics(df, "s", "y", 0.5).first()
    assert (m["balanced_accuracy"], m["r2"], m["f1"]) == (0.5, None, pytest.approx(2 / 3))
    none = R.class_report(df.withColumn("p", F.lit(0)), "p", "y")
    assert {r["class"]: (r["precision"], r["recall"], r["support"]) for r in none.collect()} == {0: (0.0, 0.0, 0), 1: (0.0, 0.0, 2)}


def test_diagnostics(table):
    df, x, y, _ = table
    d = np.column_stack([np.ones(len(y)), x])
    inv = np.linalg.inv(d.T @ d)
    h = np.einsum("ij,jk,ik->i", d, inv, d)
    e = y - d @ inv @ d.T @ y
    s2 = e @ e / (len(y) - 5)
    rows = R.influence(df, list("abcd"), "y").orderBy("id").collect()
    assert [r["leverage"] for r in rows] == pytest.approx(h)
    assert [r["cooks_d"] for r in rows] == pytest.approx(e ** 2 * h / (5 * s2 * (1 - h) ** 2))
    vif = {r["feature"]: r["vif"] for r in R.variance_inflation(df, list("abcd")).collect()}
    xx = x.T @ x
    assert [vif[c] for c in "abcd"] == pytest.approx(np.diag(xx) * np.diag(np.linalg.inv(xx)))
    summ = {r["term"]: r for r in R.ols_summary(df, list("abcd"), "y").collect()}
    assert [summ[c]["std_error"] for c in ("const", *"abcd")] == pytest.approx(np.sqrt(s2 * np.diag(inv)))


def test_stratified_split_is_exact_and_stable(table):
    df, _, y, _ = table
    out = R.stratified_split(df, "id", "y")
    n = {r["y"]: (r["t"], r["n"]) for r in out.groupBy("y").agg(F.count_if("is_test").alias("t"), F.count("*").alias("n")).collect()}
    assert all(t == round(k * 0.25) for t, k in n.values()) and out.count() == len(y)
    again = R.stratified_split(df.repartition(5), "id", "y").where("is_test").select("id")
    assert again.exceptAll(out.where("is_test").select("id")).count() == 0


# ---- inference ----

def test_design_filters(spark):
    units = spark.createDataFrame([(k, 10, 5, 5, 0, 0, 0, 0) for k in "abcdefg"] + [("z", 0, 0, 0, 0, 0, 0, 0)],
                                  "vtd_geoid string, vap_total bigint, vap_nh_white bigint, vap_nh_black bigint, vap_hisp bigint, vap_nh_asian bigint, vap_nh_native bigint, vap_other bigint")
    ret = spark.createDataFrame([("E", "a", 10, 4), ("E", "b", 0, 0), ("E", "c", None, 1), ("E", "d", 5, 6), ("E", "e", 5, -1), ("E", "f", 5, None), ("X", "g", 5, 1), ("E", "z", 5, 1)],
                                "election_id string, vtd_geoid string, votes_total bigint, votes_dem bigint")
    got = I.design(units, ret, "E").collect()
    assert [tuple(r)[:5] for r in got] == [("a", 10, 4, 0.5, 0.5)]


def test_support_recovers_groups_and_is_stable(spark):
    rng = np.random.default_rng(1)
    x = rng.dirichlet(np.ones(6), 3000)
    truth = np.array([0.2, 0.9, 0.6, 0.5, 0.4, 0.3])
    n = rng.integers(50, 500, 3000)
    y = rng.binomial(n, x @ truth)
    df = spark.createDataFrame([(f"u{i}", int(a), int(b), *map(float, r)) for i, (a, b, r) in enumerate(zip(n, y, x))],
                               "vtd_geoid string, votes_total bigint, votes_dem bigint, " + ", ".join(f"{g} double" for g in I.GROUPS))
    draws = I.support_draws(df, 200)
    pd1 = draws.toPandas().sort_values("draw_id").reset_index(drop=True)
    w = np.sqrt(n)[:, None]
    direct = np.linalg.lstsq(x * w, (y / n) * w[:, 0], rcond=None)[0]
    assert pd1.loc[0, list(I.GROUPS)].to_numpy(float) == pytest.approx(direct, abs=1e-9)
    assert np.abs(pd1[list(I.GROUPS)].mean().to_numpy() - truth).max() < 0.05
    assert 0.001 < pd1[list(I.GROUPS)].std().to_numpy().min() and len(pd1) == 201
    pd2 = I.support_draws(df.repartition(3), 200).toPandas().sort_values("draw_id")
    assert pd1.to_numpy() == pytest.approx(pd2.to_numpy(), abs=1e-9)
    w = I._poisson_weights(rng.integers(-2**63, 2**63 - 1, 20000), 5, 0)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05


def test_projection_both_ways_equal_numpy(spark):
    rng = np.random.default_rng(7)
    demo = spark.createDataFrame([("p", str(i), float(w), float(b), float(h), float(1 - w)) for i, (w, b, h) in enumerate(rng.random((20, 3)) / 2)],
                                 "plan_id string, district_id string, share_white_vap double, share_black_vap double, share_hisp_vap double, share_minority_vap double")
    sup = rng.random((101, 6))
    draws = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(sup)], "draw_id bigint, " + ", ".join(f"{g} double" for g in I.GROUPS))
    comp = I.district_composition(demo)
    c = {r["district_id"]: np.array([r[g] for g in I.GROUPS]) for r in comp.collect()}
    key = lambda df: {r["district_id"]: tuple(r)[2:] for r in df.collect()}
    held, blocks = key(I.project_draws(comp, draws)), key(I.project_draws(comp, draws, draw_limit=10))
    for k, v in c.items():
        p = sup @ v
        want = ((p > 0.5).mean(), p.mean(), np.quantile(p, 0.05), np.quantile(p, 0.95))
        assert held[k] == pytest.approx(want) and blocks[k] == pytest.approx(want)
    empty = spark.createDataFrame([("p", "void", None, None, None, None)], demo.schema)
    both = I.district_composition(demo.unionAll(empty))
    assert key(I.project_draws(both, draws))["void"] == key(I.project_draws(both, draws, draw_limit=10))["void"] == (0.0, None, None, None)
    flipped = key(I.project_draws(comp, draws, dem_is_minority_preferred=False))
    assert all(flipped[k][0] == pytest.approx(1 - held[k][0]) for k in held)
    split = I.district_composition(demo, residual_split=True).first()
    assert split["ASIAN_NH"] == split["OTHER"] and sum(split[g] for g in I.GROUPS) == pytest.approx(1)
    with pytest.raises(ValueError):
        I.project_ensemble(demo, spark.createDataFrame([("p", "A")], "plan_id string, ensemble_id string"), draws, "R", "B")


def test_group_posterior(spark):
    rng = np.random.default_rng(3)
    v = rng.random((101, 6))
    draws = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(v)], "draw_id bigint, " + ", ".join(f"{g} double" for g in I.GROUPS))
    got = {r["group_id"]: r for r in I.group_posterior(draws, "R").collect()}
    for j, g in enumerate(I.GROUPS):
        assert got[g]["sd"] == pytest.approx(v[:, j].std(ddof=1)) and got[g]["q95"] == pytest.approx(np.quantile(v[:, j], 0.95))


def test_split_rhat(spark):
    rng = np.random.default_rng(9)
    chains = {"a": rng.normal(size=101), "b": np.cumsum(rng.normal(size=60))}
    df = spark.createDataFrame([(k, 3 * i, float(x)) for k, v in chains.items() for i, x in enumerate(v)], "param string, iter int, value double")
    got = {r["param"]: r["rhat"] for r in I.split_rhat(df, "param", "iter", "value").collect()}
    for k, x in chains.items():
        x = x[: len(x) // 2 * 2]
        h = x.reshape(2, -1)
        w, b, n = h.var(axis=1, ddof=1).mean(), h.mean(axis=1).var(ddof=1), h.shape[1]
        assert got[k] == pytest.approx(np.sqrt(((n - 1) / n * w + b) / w))
    with pytest.raises(Exception, match="at least 20"):
        I.split_rhat(df.where("iter < 30"), "param", "iter", "value").collect()
    with pytest.raises(Exception, match="twice"):
        I.split_rhat(df.withColumn("iter", F.floor(F.col("iter") / 6)), "param", "iter", "value").collect()


def test_mixture(spark):
    rng = np.random.default_rng(11)
    v = np.concatenate([rng.normal(0.2, 0.03, 80), rng.normal(0.7, 0.05, 120)])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "id int, v double")
    out = mixture.low_component_membership(df, "v").orderBy("id").collect()
    assert [r["low_cluster"] for r in out] == [1] * 80 + [0] * 120
    z = spark.createDataFrame([("a", 0, 1), ("a", 1, 0), ("b", 0, 0), ("b", 1, 0)], "u string, iter int, component int")
    mu = spark.createDataFrame([(0, 0.1, 0.9), (1, 0.9, 0.1)], "iter int, mu_1 double, mu_2 double")
    got = {r["u"]: (r["post_prob"], r["low_cluster"]) for r in mixture.membership_from_draws(z, mu, "u").collect()}
    assert got == {"a": (1.0, 1), "b": (0.5, 1)}
    assert mixture.most_likely(mixture.membership_from_draws(z, mu, "u"), "u", 1).first()["u"] == "a"
