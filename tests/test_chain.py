"""Runs of a plan chain and tables upserted by bucket, against the long and plain forms."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardatlas.operators import chain, keyed


def long_map(rng, units, plans, flips):
    """{(unit, plan): district}: a unit changes at random plans, some units stand in some plans only."""
    out = {}
    for u in range(units):
        district = int(rng.integers(4))
        change = set(rng.integers(0, plans, flips).tolist())
        first, last = (int(rng.integers(plans)), plans) if u % 5 == 0 else (0, plans)
        for p in range(first, last):
            district = (district + 1) % 4 if p in change else district
            if not (u % 7 == 0 and p % 6 == 3):
                out[u, p] = district
    return out


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(1)
    m = long_map(rng, 40, 60, 3)
    df = spark.createDataFrame([(f"u{u}", p, str(d)) for (u, p), d in m.items()], "vtd_geoid string, plan_no bigint, district_id string").repartition(5)
    pop = {u: int(rng.integers(1, 50)) for u in range(40)}
    votes = {u: None if u % 3 == 0 else int(rng.integers(0, 9)) for u in range(40)}
    units = spark.createDataFrame([(f"u{u}", pop[u], votes[u]) for u in range(40)], "vtd_geoid string, pop int, votes int")
    return m, df, pop, votes, units


def test_runs_go_there_and_back(spark, case, tmp_path):
    m, df, *_ = case
    runs = chain.to_runs(df)
    assert runs.count() < len(m) / 4
    path = chain.write_runs(runs, str(tmp_path / "runs"))
    back = {(r["vtd_geoid"], r["plan_no"]): r["district_id"] for r in chain.each_plan(chain.read_runs(spark, path)).collect()}
    assert back == {(f"u{u}", p): str(d) for (u, p), d in m.items()}
    some = {(r["vtd_geoid"], r["plan_no"]) for r in chain.each_plan(chain.read_runs(spark, path, (10, 12))).collect()}
    assert some == {(f"u{u}", p) for u, p in m if 10 <= p <= 12}
    with pytest.raises(Exception, match="twice"):
        chain.to_runs(df.union(df.limit(1))).collect()
    assert chain.to_runs(df.limit(0)).count() == 0


def test_roll_up_equals_the_long_form(spark, case):
    m, df, pop, votes, units = case
    stretches = chain.roll_up(chain.to_runs(df), units, ["pop", "votes"], ["district_id"])
    got = {(r["district_id"], r["plan_no"]): (r["n_rows"], r["pop"], r["votes"]) for r in chain.each_plan(stretches).collect()}
    want = {}
    for (u, p), d in m.items():
        n, a, b = want.get((str(d), p), (0, 0, None))
        want[str(d), p] = n + 1, a + pop[u], b if votes[u] is None else (b or 0) + votes[u]
    assert got == want
    per_plan = {r["plan_no"]: r["n_vtd"] for r in chain.each_plan(chain.units_per_plan(chain.to_runs(df))).collect()}
    assert per_plan == {p: sum(q == p for _, q in m) for p in range(60)}
    with pytest.raises(ValueError, match="whole"):
        chain.roll_up(chain.to_runs(df), units.withColumn("pop", F.col("pop") / 2), ["pop"], ["district_id"])


def test_only_changes_are_shuffled(spark, case):
    """The exchange of a roll-up carries partial sums of changes: no row per unit and plan stands below it."""
    _, df, _, _, units = case
    runs = chain.to_runs(df)
    runs = spark.createDataFrame(runs.collect(), runs.schema)
    plan = chain.roll_up(runs, units, ["pop"], ["district_id"])._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "sequence" not in plan and plan.count("Exchange hashpartitioning") <= 2 and "partial_sum" in plan


def files(path):
    return {os.path.join(f, n): os.stat(os.path.join(f, n)).st_mtime_ns for f, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    base = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"), F.lit("x").alias("w"))
    path = keyed.write_buckets(base, str(tmp_path / "t"), ["k"], 32)
    before = files(path)
    new = spark.createDataFrame([("y", -1, 5), ("y", -2, 1999), ("z", -3, 5000)], "w string, v bigint, k bigint")
    touched = keyed.upsert_buckets(path, new)
    after = files(path)
    of = lambda f: int(f.split("_bucket=")[1].split(os.sep)[0])
    assert 1 <= len(touched) <= 3 and {of(f) for f in before} == {of(f) for f in after} == set(range(32))
    assert {f: t for f, t in before.items() if of(f) not in touched} == {f: t for f, t in after.items() if of(f) not in touched}
    want = sorted(tuple(r) for r in keyed.upsert(base, new.select("k", "v", "w"), ["k"]).collect())
    assert sorted(tuple(r) for r in keyed.read_buckets(spark, path).select("k", "v", "w").collect()) == want
    assert keyed.upsert_buckets(path, new.limit(0)) == [] and files(path) == after
    for bad in (new.union(new), new.withColumn("k", F.lit(None).cast("bigint"))):
        with pytest.raises(ValueError):
            keyed.upsert_buckets(path, bad)
    assert files(path) == after


def test_runs_are_formed_from_masks(spark):
    """Gaps, changes and ends on either side of a mask's 64 plans, numbers below zero, and a unit twice in a plan."""
    rng = np.random.default_rng(4)
    held = {(u, p): str((p // 37 + u) % 3) for u in range(6) for p in range(-70, 200) if u < 2 or rng.random() < (0.9 if u < 4 else 0.3)}
    rows = [(f"u{u}", p, d) for (u, p), d in held.items()]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "vtd_geoid string, plan_no bigint, district_id string").repartition(3)
    want = []
    for u, p in sorted(held):
        if want and want[-1][0] == f"u{u}" and want[-1][3] == p - 1 and want[-1][1] == held[u, p]:
            want[-1][3] = p
        else:
            want.append([f"u{u}", held[u, p], p, p])
    runs = chain.to_runs(df)
    assert sorted(map(tuple, runs.collect())) == sorted(map(tuple, want))
    text = runs._jdf.queryExecution().executedPlan().toString()
    assert "partial_bit_or" in text[text.rindex("Exchange hashpartitioning"):]            # below the first exchange
    for twice in (df.limit(1), df.limit(1).withColumn("district_id", F.lit("9"))):
        with pytest.raises(Exception, match="twice"):
            chain.to_runs(df.union(twice)).collect()
