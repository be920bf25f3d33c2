import pytest

from casebook import QUERIES
from casebook import views as V
from wardatlas.operators import ensemble, rollup
from wardatlas.sources import writers


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


NAMES = ["a1_votes_tall_to_wide", "a3_district_demo_vap", "a4_district_returns", "a5_plan_metrics", "a6_ensemble_distribution", "a8_plan_vs_ensemble",
         "j16_share_of_draws_at_most", "j17_district_opportunity", "g1_overlay_boxes", "g1_overlay_polygons", "g7_adjacency", "g8_cut_edges",
         "m19_influence", "m23_projected_draws", "a22_split_rhat", "a19_spearman", "m7_euclidean_silhouette", "m11_stratified_split"]


@pytest.mark.parametrize("name", NAMES)
def test_no_pairing_of_everything_and_no_row_udf(spark, data, name):
    text = plan_of(QUERIES[name](spark, data))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in text, bad
    # a global aggregate may end in one task, fed by one partial row per task
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert "partial_" in lines[i + 1]


def test_plan_map_is_not_shuffled_before_its_partial_sums(spark, data, tmp_path):
    path = writers.write_parquet(V.plan_map(spark, data), str(tmp_path / "m"))
    text = plan_of(rollup.district_demo_vap(spark.read.parquet(path), V.unit(spark, data)))
    assert text.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in text
    assert text.index("partial_sum") < text.index("BroadcastHashJoin")


def test_scan_reads_only_the_plan_id(spark, data, tmp_path):
    path = writers.write_parquet(V.plan_map(spark, data), str(tmp_path / "m"))
    text = plan_of(ensemble.ensemble_plan_ids(spark.read.parquet(path)))
    assert "ReadSchema: struct<plan_id:string>" in text and "IsNotNull(plan_id)" in text


def test_reading_one_ensemble_prunes_the_others(spark, data, tmp_path):
    rows = V.plan_map(spark, data).join(V.plan(spark, data).select("plan_id", "ensemble_id"), "plan_id")
    path = writers.write_plan_map(rows, str(tmp_path / "pm"))
    text = plan_of(spark.read.parquet(path).where("ensemble_id = 'ENS_A'"))
    assert "PartitionFilters: [isnotnull(ensemble_id" in text


def test_unfolded_sides_are_never_broadcast(spark, data):
    """Spark takes the cells along a segment for no more than the file their outlines come from."""
    from wardatlas.operators import overlay
    text = plan_of(overlay.adjacency(V.with_rings(V.unit_box(spark, data)), "unit_idx"))
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text


def test_unfolding_tables_are_dealt_out(spark, data, monkeypatch):
    """The tasks of a plan map follow its rows, not the units' file, which may be one task."""
    want = sorted(V.plan_map(spark, data).collect())
    monkeypatch.setattr(V, "UNFOLDED_ROWS", len(want) // 5)
    dealt = V.plan_map(spark, data)
    assert dealt.rdd.getNumPartitions() == 5 and sorted(dealt.collect()) == want


def test_features_are_joined_without_a_broadcast(spark, data):
    """One row per unit on every side of the joins: none is a small one."""
    assert "Broadcast" not in plan_of(V.features(spark, data))


def test_outlines_are_dealt_out_before_their_hulls(spark, data):
    from wardatlas.operators import overlay
    text = plan_of(overlay.compactness(V.with_rings(V.block_box(spark, data)), "block_idx"))
    assert "Exchange" in text[text.index("ArrowEvalPython"):]
