from pyspark.sql import functions as F

from tidemark.functions import hashing as H


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_pinned_tokens(spark):
    assert one(spark, H.hash_token(F.lit("pub_id-learned-cold"))) == 926508
    assert one(spark, H.hash_token(F.lit("user_click_history2-4-101"))) == 931812
    assert one(spark, H.hash_profile_token(F.lit("app_id-app"))) == 390134


def test_pinned_mask(spark):
    masked = [r["m"] for r in spark.range(128).orderBy("id").select(H.row_masked(F.col("id"), 1800).alias("m")).collect()]
    assert sum(masked) == 26 and not masked[0]


def test_mask_bounds(spark):
    rows = spark.range(200)
    assert rows.filter(H.row_masked(F.col("id"), 0)).count() == 0
    assert rows.filter(H.row_masked(F.col("id"), 10_000)).count() == 200


def test_mask_equals_plain_splitmix(spark):
    rows = [0, 1, 7, -1, 2**63 - 1, -(2**63), *range(10**6, 10**6 + 300), *(k * 0x0123456789ABCDEF % 2**63 for k in range(300))]
    low = 2**64 - 1

    def mixed(r):
        v = (r + 0x9E3779B97F4A7C15) & low
        v = ((v ^ v >> 30) * 0xBF58476D1CE4E5B9) & low
        v = ((v ^ v >> 27) * 0x94D049BB133111EB) & low
        return (v ^ v >> 31) % 10000

    df = spark.createDataFrame([(r,) for r in rows], "row long")
    for points in (1800, 5001, 9999):
        got = {r["row"]: r["m"] for r in df.select("row", H.row_masked(F.col("row"), points).alias("m")).collect()}
        assert got == {r: mixed(r) < points for r in rows}


def test_mask_is_worked_out_once_a_row(spark):
    """As text, the mask is no longer than its steps, also when it decides over an array's elements."""
    from tidemark.operators import profiles as P

    df = spark.createDataFrame([(5, True, [(1, 2, 0.5)])], "row_index long, scoring boolean, features array<struct<field:bigint,feature:bigint,value:double>>")
    plan = P.cold_publisher(df).select("features")._jdf.queryExecution().optimizedPlan().toString()
    assert len(str(H.row_masked(F.col("id"), 1800))) < 20_000
    assert plan.count("shiftrightunsigned") < 200


def test_bucket_location(spark):
    value, c, offset, buckets = -123456789012345, (5, 7, 11, 13), 3, 1000
    v = value & (2**64 - 1)
    parts = (v & 0x1FFFFF, v >> 21 & 0x1FFFFF, v >> 42 & 0x1FFFFF, v >> 63)
    want = (offset + sum(p * k for p, k in zip(parts, c, strict=True))) % (2**31 - 1) % buckets
    assert one(spark, H.bucket_location(F.lit(value), c, offset, buckets)) == want


def test_category_hash_is_seeded(spark):
    assert one(spark, H.category_hash(F.lit("a"), 1)) == one(spark, H.category_hash(F.lit("a"), 1))
    assert one(spark, H.category_hash(F.lit("a"), 1)) != one(spark, H.category_hash(F.lit("a"), 2))


def test_tokens_of_columns_equal_single_ones(spark):
    df = spark.createDataFrame([("a", None), ("b", "x"), ("a", "é"), ("", "x")], "p string, q string").coalesce(1)
    for r in df.select(H.hash_tokens([F.col("p"), F.col("q")]).alias("both"), H.hash_token(F.col("p")).alias("p"), H.hash_token(F.col("q")).alias("q")).collect():
        assert r["both"] == [r["p"], r["q"]]
    assert df.filter("p = 'c'").select(H.hash_tokens([F.col("p")])).count() == 0
