import numpy as np
import pytest
from pyspark.sql import functions as F

from wardatlas.operators import joins
from wardatlas.operators.order_stats import distribution, ecdf_positions, ranked_values, uniform_hash

P = {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}


@pytest.fixture(scope="module")
def skewed(spark):
    """Half the rows in one group, a third of all rows with one value."""
    rng = np.random.default_rng(3)
    n = 6000
    g = np.where(rng.random(n) < 0.5, 0, rng.integers(1, 40, n))
    v = np.where(rng.random(n) < 1 / 3, 5.0, np.round(rng.normal(size=n) * np.where(rng.random(n) < 0.01, 1e6, 1.0), 3))
    return spark.createDataFrame([(int(i), int(a), float(b)) for i, (a, b) in enumerate(zip(g, v))], "id int, g int, v double"), g, v


@pytest.mark.parametrize("spread", ["quantile", "few"])
def test_distribution_matches_numpy(skewed, spread):
    df, g, v = skewed
    for r in distribution(df, ["g"], "v", P, spread=spread).collect():
        x = v[g == r["g"]]
        assert r["n"] == len(x) and r["min"] == x.min() and r["max"] == x.max()
        assert r["mean"] == pytest.approx(x.mean()) and (len(x) == 1 or r["sd"] == pytest.approx(x.std(ddof=1)))
        for name, p in P.items():
            assert r[name] == pytest.approx(np.quantile(x, p), rel=1e-12, abs=1e-12)


def test_global_distribution_and_single_row(spark, skewed):
    df, _, v = skewed
    r = distribution(df, [], "v", {"m": 0.5}).first()
    assert r["m"] == np.quantile(v, 0.5) and r["n"] == len(v)
    r = distribution(spark.createDataFrame([(1.5,), (None,)], "v double"), [], "v", {"m": 0.5}).first()
    assert (r["n"], r["m"], r["sd"]) == (1, 1.5, None)


def test_hash_spread_ranks_every_row(skewed):
    df, g, _ = skewed
    h = df.withColumn("h", uniform_hash("id")).withColumn("o", F.struct("h", "id"))
    got = ranked_values(h, ["g"], "o", spread="hash", range_on="h").select("g", "below", "n").collect()
    for k in np.unique(g):
        ranks = sorted(r["below"] for r in got if r["g"] == k)
        assert ranks == list(range((g == k).sum()))


def test_ecdf_matches_brute_force(spark, skewed):
    df, g, v = skewed
    targets = spark.createDataFrame([(0, 5.0), (0, -1e9), (0, 1e9), (1, 0.0), (99, 1.0)], "g int, v double")
    got = {(r["g"], r["v"]): r for r in ecdf_positions(targets, df, ["g"], "v").collect()}
    assert len(got) == 5
    for (k, t), r in got.items():
        x = v[g == k]
        assert (r["n_draws"], r["n_le"], r["n_ge"]) == (len(x), (x <= t).sum(), (x >= t).sum())
    assert got[(99, 1.0)]["n_draws"] == 0 and got[(99, 1.0)]["draw_sd"] is None
    assert got[(0, 5.0)]["draw_sd"] == pytest.approx(v[g == 0].std(ddof=1))
    whole = ecdf_positions(targets.where("v = 5.0"), df, [], "v").first()
    assert whole["n_le"] == (v <= 5).sum()


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, skewed, how):
    df, *_ = skewed
    right = spark.createDataFrame([(k, f"k{k}") for k in range(0, 30)], "g int, name string")
    want = sorted(tuple(r) for r in df.join(right, ["g"], how).fillna("-").collect())
    got = joins.salted_join(df, right, ["g"], rows_per_task=100, how=how).select("g", "id", "v", "name").fillna("-")
    assert sorted(tuple(r) for r in got.collect()) == want


def test_small_side_checks_the_size(spark):
    df = spark.range(10)
    assert joins.small_side(df, 5) is df
    assert "hint" in joins.small_side(df, 10)._jdf.queryExecution().logical().toString().lower()


def test_unfolded_rows_are_counted_before_a_broadcast(spark, tmp_path, monkeypatch):
    """A small file whose rows unfold is not held by its size on disk; text columns are measured."""
    spark.range(10).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).select(F.explode(F.sequence(F.lit(1), F.lit(100))).alias("i"), F.col("id").cast("string").alias("k"))
    assert joins.fits(df, 1000) and not joins.fits(df, 999)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 5000)
    assert not joins.fits(df, 1000)
    text = df.join(joins.dimension(df.withColumnRenamed("i", "j")), "k")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text
