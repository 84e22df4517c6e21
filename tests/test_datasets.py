from pyspark.sql import functions as F

from tidemark.operators import history as Y
from tidemark.plans import datasets as D
from tidemark.plans.recipe import Recipe
from tidemark.queries import spark as Q

DATA, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def test_columns_equal_the_contract_in_every_window(spark):
    names = [d[0] for d in Q.RECIPE.definitions()]
    for name, windows in (("evaluation_windows", 4), ("production_window", 1)):
        df = Q.QUERIES[name](spark, DATA)
        assert df.columns == ["row_index", "window", "role", "click", *names]
        assert df.select("window").distinct().count() == windows
        assert df.filter(" OR ".join(f"{n} IS NULL" for n in names)).count() == 0


def test_production_hides_labels_of_scoring_rows_only(spark):
    df = Q.QUERIES["production_window"](spark, DATA)
    assert df.filter("(role = 'validation') <> (click IS NULL)").count() == 0
    assert df.count() == spark.read.parquet(f"{DATA}/events.parquet").count()


def test_a_fold_does_not_see_later_hours(spark):
    rows = Q._recipe_rows(spark, SMALL).filter("NOT scoring")
    a, b = Q.hours(rows)
    folds = [D.Fold("early", a, a + 200, a + 300), D.Fold("late", a, a + 400, a + 500)]
    both = D.dataset(rows, Recipe(), folds)
    # labels and rows from the early fold's end of training on are another's
    other = rows.withColumn("click", F.when(F.col("hour_no") >= a + 200, 1 - F.col("click")).otherwise(F.col("click"))).filter(F.col("hour_no") < a + 300)
    early = lambda df: sorted(map(tuple, df.filter("window = 'early'").drop("click").collect()))
    assert early(both) == early(D.dataset(other, Recipe(), folds[:1]))
    assert len(early(both)) > 300


def test_history_of_a_hot_key_is_cut_into_segments(spark):
    n = 4000
    rows = spark.range(n).select(
        F.col("id").alias("row_index"), F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 7 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("k"),
        F.floor(F.col("id") / 1500).alias("hour_no"), (F.col("id") >= 3800).alias("scoring"),
    ).repartition(6)
    got = {r["row_index"]: tuple(r)[-3:] for r in Y.impression_history(rows, "k", width=64).collect()}
    seen: dict = {}
    for r in sorted(rows.collect(), key=lambda r: (r["hour_no"], r["scoring"], r["row_index"])):
        total, last, inside = seen.get(r["k"], (0, None, 0))
        inside = inside if last == r["hour_no"] else 0
        assert got[r["row_index"]] == (total, r["hour_no"] - last if last is not None else 0, inside)
        seen[r["k"]] = total + 1, r["hour_no"], inside + 1
    # what one task has to put in order: a segment
    segments = rows.groupBy("k", "hour_no", "scoring", F.floor(F.col("row_index") / 64)).count()
    assert segments.agg(F.max("count")).first()[0] <= 64
    plan = Y.impression_history(rows, "k", width=64)._jdf.queryExecution().executedPlan().toString()
    assert "__segment" in plan and plan.count("Window [row_number()") == 1


def test_rows_meet_the_windows_in_compiled_code(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("evaluation_windows", "production_window"):
            run = Q.QUERIES[name](spark, DATA)._jdf.queryExecution()
            plan, codes = run.executedPlan().toString(), run.debug().codegenToSeq()
            # the log is read as it was written once, and rows are dealt out to the windows inside generated code
            assert "events.parquet" not in plan
            assert any("Generate explode" in line and "*(" in line for line in plan.splitlines())
            # the JVM does not compile methods of more bytes
            assert max(codes.apply(i)._3().maxMethodCodeSize() for i in range(codes.size())) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_rounding_at_the_source_is_rounding_at_the_end(spark):
    rows = Q._recipe_rows(spark, SMALL).filter("NOT scoring")
    # values without a row of their own: null keys have neither ids nor history
    rows = rows.withColumns({c: F.when(F.col("row_index") % 9 != 0, F.col(c)) for c in ("site_id", "device_ip", "user_id")})
    a, _ = Q.hours(rows)
    folds = [D.Fold("early", a, a + 200, a + 300), D.Fold("late", a, a + 400, a + 500)]
    lanes = {d[0]: d[1] for d in Recipe().definitions()}
    plain = D.dataset(rows, Recipe(), folds)
    after = plain.select(*[Q.r(c).alias(c) if lanes.get(c) == "numerical" else F.col(c) for c in plain.columns])
    got = sorted(map(tuple, D.dataset(rows, Recipe(), folds, Q.r).drop("click").collect()))
    assert got == sorted(map(tuple, after.drop("click").collect()))
    assert plain.filter(" OR ".join(f"{n} IS NULL" for n in lanes)).count() == 0
