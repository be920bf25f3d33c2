from pyspark.sql import functions as F

from wardatlas.functions import scalars as S


def one(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_zfill_never_shortens(spark):
    assert one(spark, ["7", "0007", "1234567", None], S.zfill("c", 6)) == ["000007", "000007", "1234567", None]


def test_to_number_accepts_numbers_only(spark):
    got = one(spark, ["12", "12.0", "", " 7 ", "x", None, "NaN", "1d", "-3e2", "."], S.to_number("c"))
    assert got == [12.0, 12.0, None, 7.0, None, None, None, None, -300.0, None]


def test_to_count_rounds_halves_to_even(spark):
    assert one(spark, ["2.5", "3.5", "-0.5", "2.4", None], S.to_count("c")) == [2, 4, 0, 2, None]


def test_party(spark):
    got = one(spark, ["d", " GOP ", "DFL", "", None, "L", "Republican"], S.normalize_party("c"))
    assert got == ["DEM", "REP", "DEM", "OTHER", "OTHER", "OTHER", "REP"]


def test_share_of_zero_and_null(spark):
    df = spark.createDataFrame([(1, 2), (1, 0), (1, None), (None, 2)], "p bigint, t bigint")
    assert [r[0] for r in df.select(S.share("p", "t")).collect()] == [0.5, None, None, None]


def test_clip_keeps_null(spark):
    assert one(spark, [None, 2.0, -1.0, 0.5], S.clip("c", 0.0, 1.0), "double") == [None, 1.0, 0.0, 0.5]


def test_cntyvtd(spark):
    assert one(spark, ["309-0001", "309 1", "30900012"], S.normalize_cntyvtd("c", 6)) == ["309000001", "309000001", "309000012"]


def test_district_number(spark):
    got = one(spark, ["4807", "04812", "7", "07", "CD-07", "TX31", "none", "4840", None], S.district_number("c", 1, 38))
    assert got == [7, 12, 7, 7, 7, 31, None, None, None]
    assert one(spark, ["4807abc", "no"], S.district_number_loose("c", 1, 38)) == [7, None]


def test_argmax_first_wins(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(S.argmax_name(["a", "b"])).collect()] == ["a", "b"]


def test_normalize_row(spark):
    df = spark.createDataFrame([(1.0, 3.0), (0.0, 0.0)], "a double, b double")
    assert [tuple(r) for r in df.select(*S.normalize_row(["a", "b"])).collect()] == [(0.25, 0.75), (0.0, 0.0)]
    neg = spark.createDataFrame([(-1.0, 0.5)], "a double, b double")
    assert tuple(neg.select(*S.normalize_row(["a", "b"], keep_when_zero=True)).first()) == (-1.0, 0.5)


def test_is_finite(spark):
    assert one(spark, [1.0, float("nan"), float("inf"), None], S.is_finite("c"), "double") == [True, False, False, False]


def test_timestamp_text_shape(spark):
    assert spark.range(1).select(S.timestamp_text().rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$")).first()[0]


def test_residual(spark):
    df = spark.createDataFrame([(10, 4), (3, 4)], "t bigint, k bigint")
    assert [r[0] for r in df.select(S.residual_count("t", ["k"])).collect()] == [6, 0]
    assert df.select(F.max(S.vtd_geoid("k", "t"))).first()[0] == "48004000010"
