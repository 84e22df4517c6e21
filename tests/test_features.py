import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import rowlocal as R
from tidemark.operators import checks as C
from tidemark.operators import history as Y
from tidemark.operators import lookups as L
from tidemark.plans.recipe import Bucket, Recipe, Target

LOG = "row_index long, hour_no long, key string, click int, scoring boolean"


def by_row(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("row_index").collect()]


def test_context_and_identity(spark):
    cols = "row_index long, site_id string, site_domain string, site_category string, app_id string, app_domain string, app_category string, device_id string, device_ip string, device_model string"
    df = spark.createDataFrame([(0, "S_APP", "sd", "sc", "app", "ad", "ac", "D_UNKNOWN", "ip", "m"), (1, "site", "sd", "sc", "none", "ad", "ac", "known-device", "ip", "m"), (2, None, "sd", "sc", "a", "ad", "ac", None, None, "m")], cols)
    out = by_row(R.identity_keys(R.inventory_context(df)), "inventory_type", "publisher_id", "identity_kind", "user_id")
    assert out == [("app", "app", "proxy", "proxy\x1fip\x1fm"), ("site", "site", "device", "device\x1fknown-device"), ("site", None, "proxy", "proxy\x1f__MISSING__\x1fm")]


def test_impressions(spark):
    df = spark.createDataFrame([(0, 10, "k", 0, False), (1, 10, "k", 0, False), (2, 12, "k", 0, False)], LOG)
    assert by_row(Y.impression_history(df, "key"), "prior_impressions", "hours_since_previous", "prior_in_hour") == [(0, 0, 0), (1, 0, 1), (2, 2, 0)]


def test_click_history(spark):
    df = spark.createDataFrame([(0, 10, "k", 1, False), (1, 10, "k", 0, False), (2, 11, "k", 0, False), (3, 12, "k", 1, True)], LOG)
    names = ("prior_clicks", "prior_nonclicks", "click_pattern", "hours_since_click")
    assert by_row(Y.click_history(df, "key"), *names) == [(0, 0, 0, 0), (0, 0, 0, 0), (1, 1, 17, 1), (1, 2, 34, 2)]
    fewer = df.withColumn("scoring", F.col("row_index") >= 2)
    assert by_row(Y.click_history(fewer, "key"), *names)[2:] == [(1, 1, 17, 1), (1, 1, 17, 2)]


def test_history_strings(spark):
    hours = [(0, 0, 1, False), (1, 0, 0, False), (2, 1, 1, False), (3, 24, 0, True), (4, 25, 1, True)]
    df = spark.createDataFrame([(i, h, "k", c, s) for i, h, c, s in hours], LOG)
    out = df.join(Y.history_strings(df, "key"), ["key", "hour_no"])
    assert by_row(out, "history") == [("",), ("",), ("10",), ("101",), ("101",)]


def random_log(spark, n=400, seed=3):
    g = np.random.default_rng(seed)
    hours = np.sort(g.integers(0, 60, n))
    return [(i, int(hours[i]), f"k{g.integers(5)}", int(g.random() < 0.3), bool(hours[i] >= 50)) for i in range(n)]


def test_history_against_a_sequential_simulation(spark):
    rows = random_log(spark)
    df = spark.createDataFrame(rows, LOG)
    state, want, text = {}, {}, {}
    for i, h, k, c, s in rows:
        past = [x for x in state.get(k, []) if x[0] < h]
        n, pos = len(past), sum(x[1] for x in past)
        last = max((x[0] for x in past if x[1]), default=None)
        since = len([x for x in past if last is None or x[0] > last])
        code = 0
        if past:
            first, end = past[0][0], past[-1][0]
            code = min(4, end - first + 1) << 4 | sum(1 << d for d in range(4) if any(x == (end - d, 1) for x in past))
        want[i] = (pos, n - pos, h - last if last is not None else 0, since, code)
        text[i] = ("".join(str(x[1]) for x in past)[-4:],)
        if not s:
            state.setdefault(k, []).append((h, c))
    out = by_row(Y.click_history(df.repartition(7), "key"), "prior_clicks", "prior_nonclicks", "hours_since_click", "impressions_since_click", "click_pattern")
    assert out == [want[i] for i in range(len(rows))]
    assert by_row(df.join(Y.history_strings(df.repartition(3), "key"), ["key", "hour_no"]), "history") == [text[i] for i in range(len(rows))]


def test_scoring_labels_never_matter(spark):
    df = spark.createDataFrame(random_log(spark), LOG)
    other = df.withColumn("click", F.when(F.col("scoring"), 1 - F.col("click")).otherwise(F.col("click")))
    names = ("prior_clicks", "prior_nonclicks", "click_pattern", "impressions_since_click")
    assert by_row(Y.click_history(df, "key"), *names) == by_row(Y.click_history(other, "key"), *names)


def test_windows(spark):
    df = spark.range(120).select(F.col("id").alias("hour_no"))
    out = [tuple(r) for r in Y.windows(df, 24, 2, 24, 24).orderBy("train_end").collect()]
    assert out == [("walk_forward_0", 0, 48, 48, 72, False), ("walk_forward_1", 0, 72, 72, 96, False), ("final_holdout", 0, 96, 96, 120, True)]
    with pytest.raises(Exception, match="missing hours"):
        Y.windows(df.filter("hour_no <> 5"), 24, 2, 24, 24).collect()
    with pytest.raises(Exception, match="not enough history"):
        Y.windows(df, 24, 2, 24, 60).collect()


def test_vocabulary(spark):
    df = spark.createDataFrame([("b",), ("b",), ("a",), ("a",), ("c",), (None,), (None,)], "v string")
    assert {r["v"]: r["v__id"] for r in L.vocabulary(df, "v", 2, 10).collect()} == {None: 1, "a": 2, "b": 3}
    assert sorted(r["v"] for r in L.encode(df, {"v": L.vocabulary(df, "v", 2, 10)}).collect()) == [0, 0, 0, 2, 2, 3, 3]
    with pytest.raises(ValueError, match="limit"):
        L.vocabulary(df, "v", 1, 2)


def test_distinct_counts_null_as_a_value(spark):
    df = spark.createDataFrame([("k", "a"), ("k", None), ("k", "a"), ("q", "b")], "k string, v string")
    assert {r["k"]: r["n__raw"] for r in L.covariate_lookup(df, "k", False, {"n": "v"}).collect()} == {"k": 2, "q": 1}


def test_first_block_has_no_lift(spark):
    rows = random_log(spark)
    df = spark.createDataFrame(rows, LOG).filter("NOT scoring")
    out = L.target_features_train(df, L.temporal_target_stats(df, "key", 0, 50, 2), "key", 0, 50, Target(("key",), 2)).collect()
    for r in out:
        if r["hour_no"] < 25:
            assert r["key_target_logit_lift"] == 0 and r["key_target_evidence_log1p"] == 0
    assert any(r["key_target_logit_lift"] for r in out)


def test_unseen_category_scores_zero(spark):
    train = spark.createDataFrame([("a", 1), ("a", 0)], "key string, click int")
    fresh = spark.createDataFrame([("zzz",)], "key string")
    r = L.target_features_score(fresh, L.target_stats(train, "key"), "key", 0.5, Target(("key",))).first()
    assert abs(r["key_target_logit_lift"]) < 1e-12 and r["key_target_evidence_log1p"] == 0


def test_buckets(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (5.0,), (math.nan,), (None,)], "x double")
    assert [r["b"] for r in df.select(R.bucket(F.col("x"), Bucket("b", "x", (1.0, 5.0))).alias("b")).collect()] == [0, 1, 2, 0, 0]


def test_checks(spark):
    df = spark.createDataFrame([(0, "14102100", 1), (1, "14102101", 0), (2, "14102100", None), (3, "bad", 2)], "row_index long, hour string, click int")
    assert tuple(C.hour_order_check(df.filter("row_index < 3"), width=2).first()) == (0, 1)
    assert C.hour_order_check(df).first()["malformed"] == 1
    assert tuple(C.label_check(df).first())[2:] == (1, 1, False)
    hours = spark.createDataFrame([(1,), (2,), (5,)], "hour_no long")
    assert [r[0] for r in C.missing_hours(hours).collect()] == [3, 4]
    with pytest.raises(ValueError):
        C.time_range(df, 5, 5)


def test_recipe_refuses_repeated_names(spark):
    with pytest.raises(ValueError, match="repeat"):
        Recipe(raw=("C14", "C14")).definitions()
    names = [r["name"] for r in Recipe().contract(spark).orderBy("position").collect()]
    assert len(names) == len(set(names)) == len(Recipe().definitions())


def test_model_columns(spark):
    df = spark.createDataFrame([(0, None, math.nan, 1)], "row_index long, c long, x double, click int")
    assert tuple(R.model_columns(df, ["c"], ["x"], "click").first()) == (0, 0, 0.0, 1.0)


def test_lookup_contract(spark):
    recipe = Recipe(raw=("a",), context=(), crosses=(), frequency=("k",), distinct=(("k_apps", "k", "a"),), buckets=(), history=(), target=Target(("a",)))
    rows = [(h, f"a{h % 3}", f"k{h % 5}", h % 2) for h in range(20)]
    df = spark.createDataFrame(rows, "hour_no long, a string, k string, click int")
    fits = L.fits(recipe, 0, 20)
    good = {n: (f(df), L.reads(f, df, "click"), "training") for n, f in fits.items()}

    def faults(fitted):
        return {r["lookup"]: r["fault"] for r in C.lookup_contract(spark, recipe.lookups(), fitted).collect() if r["fault"]}

    assert set(good) == set(recipe.lookups()) and faults(good) == {}
    counted = {r["lookup"]: (r["rows"], r["repeated_keys"]) for r in C.lookup_contract(spark, recipe.lookups(), good).collect()}
    assert counted["covariate k"] == (5, 0) and counted["temporal target a"] == (12, 0)
    table = good["covariate k"][0]
    assert faults(good | {"covariate k": (table.union(table.limit(1)), False, "training")}) == {"covariate k": "repeated keys"}
    clash = table.select("*", table["k"])
    assert faults(good | {"covariate k": (clash, False, "training")}) == {"covariate k": "columns clash"}
    assert faults(good | {"covariate k": (table.drop("k_apps__raw"), False, "training")}) == {"covariate k": "other outputs"}
    assert faults(good | {"covariate k": (table.withColumnRenamed("k", "j"), True, "training, scoring")}) == {"covariate k": "other key, other outputs, other provenance, other sources"}
    assert faults({n: x for n, x in good.items() if n != "target a"} | {"extra": good["target a"]}) == {"target a": "missing", "extra": "not declared"}


def test_lookup_contract_query_covers_the_recipe(spark):
    from tidemark.queries import spark as Q

    out = Q.lookup_contract(spark, "/root/testdata/sf0.001").collect()
    assert {r["lookup"] for r in out} == set(Q.RECIPE.lookups()) and len(out) == 21
    assert all(r["fault"] is None and r["repeated_keys"] == 0 and r["rows"] > 0 for r in out)


def test_gaps_and_alignment_of_the_whole_log(spark, tmp_path):
    from tidemark.queries import spark as Q

    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    late = F.date_trunc("hour", "ts") == "2024-01-20 05:00:00"  # an hour of all sites
    assert events.filter(late).count() > 0
    events.filter(~late).write.parquet(f"{tmp_path}/events.parquet")
    whole, cut = (Q.log_hours(spark, d).first() for d in ("/root/testdata/sf0.01", str(tmp_path)))
    assert (whole["missing"], whole["first_missing"]) == (0, [])
    gap = cut["first_missing"][0]
    assert cut["missing"] == 1 and gap % 24 == 5 and cut["hours"] == whole["hours"] - 1
    assert gap not in {r["missing_hour"] for r in Q.missing_hours(spark, str(tmp_path)).collect()}
    scoring = Q.split(Q.log(spark, "/root/testdata/sf0.01"))[1].count()
    assert tuple(Q.aligned_predictions(spark, "/root/testdata/sf0.01").first()) == (scoring, 0, 0, 0)
