"""Each query applies one operator to the impression log that ``events`` stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import hashing as H
from tidemark.functions import rowlocal as R
from tidemark.operators import checks as C
from tidemark.operators import baseline as B
from tidemark.operators import ffm as M
from tidemark.operators import ffm_fit as W
from tidemark.operators import history as Y
from tidemark.operators import lookups as L
from tidemark.operators import metrics as E
from tidemark.operators import profiles as P
from tidemark.plans import datasets as D
from tidemark.plans.recipe import Bucket, Recipe
from tidemark.sources import impressions as S
from tidemark.streaming import history as T
from tidemark.streaming import timed as T2

RECIPE = Recipe()
# Parameters of the queries, the same in the SQL.
SMOOTHING, CLIP, PRIOR_DIGITS = 20.0, 1e-4, 6
EVENTS, BITS, THRESHOLD = 4, 4, 30
FEW_ROWS, IDENTITY, BASE_IDENTITY = 40, 100, 1000
BLOCK_ROWS, SAMPLES, CONFIDENCE, SEED, GUARD = 51, 200, 0.95, 7, 1e-4
HOLDOUT, FOLDS, FOLD_HOURS, MINIMUM = 24, 3, 48, 48
COEFFICIENTS, OFFSET, BUCKETS = (1103515245 % 2**21, 69069, 1664525 % 2**21, 22695477 % 2**21), 12345, 1 << 20
APP_NAMES, SITE_NAMES = {"pub_id": "app_id", "pub_domain": "app_domain"}, {"pub_id": "site_id", "pub_domain": "site_domain"}
FFM_FACTORS, FFM_FIELDS = 4, 19
ALLOWED = 48


def log(spark: SparkSession, sf: str) -> DataFrame:
    return S.impressions(spark, sf)


def users(spark: SparkSession, sf: str) -> DataFrame:
    """The log with context and identity columns."""
    return P.with_publisher(R.identity_keys(R.inventory_context(log(spark, sf))))


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter("NOT scoring"), df.filter("scoring")


def hours(df: DataFrame) -> tuple[int, int]:
    """First and last-plus-one hour of the rows: two numbers."""
    row = df.agg(F.min("hour_no").alias("a"), F.max("hour_no").alias("b")).first()
    return row["a"], row["b"] + 1


def r(column, digits: int = 6):
    """Rounded; the added zero turns -0.0 into 0.0."""
    return F.round(column, digits) + F.lit(0.0)


# ---- sources and sinks


def scan_raw(spark, sf):
    folder = S.shared_folder(spark)
    S.write_csv(log(spark, sf).select(*[f.name for f in S.RAW_SCHEMA]), folder)
    return S.scan_raw(spark, folder).select("id", F.col("click").cast("int").alias("click"), "hour", "site_id", "app_id", "device_id", "C14")


def canonicalize(spark, sf):
    df = log(spark, sf).select("row_index", "id", "click", "hour", "hour_no", "site_id", "app_id")
    print_ = df.agg(F.bit_xor(F.xxhash64(*df.columns)).alias("x"), F.count("*").alias("n")).first()
    folder = S.shared_folder(spark)
    S.canonical(df, folder, f"{print_['x'] & (2**64 - 1):016x}-{print_['n']}")
    return S.canonical(df, folder, f"{print_['x'] & (2**64 - 1):016x}-{print_['n']}")


def scan_projected(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", F.round("value", 6).alias("value"))


def shard_stats(spark, sf):
    df = log(spark, sf).select("row_index", "click", "hour_no")
    bounds = df.agg(F.min("row_index").alias("a"), F.max("row_index").alias("b")).first()
    folder = S.shared_folder(spark)
    S.write_shards(df, folder, "row_index", 4096, bounds["a"], bounds["b"] + 1)
    return spark.read.parquet(folder).groupBy("shard").agg(F.count("*").alias("rows"), F.min("row_index").alias("first_row"), F.max("row_index").alias("last_row"))


def shard_manifest(spark, sf):
    """The log committed as parts of 4,096 rows: what the manifest says of each, and that all can be read back."""
    folder = S.shared_folder(spark)
    log_ = S.dense_index(log(spark, sf), "hour_no", "row_index", name="place")
    manifest = S.write_parts(log_.withColumn("place", F.col("place").cast("bigint")), folder, "place", 4096)
    back = S.read_parts(spark, folder).groupBy(F.floor(F.col("place") / 4096).cast("int").alias("part")).agg(F.sum("click").cast("bigint").alias("clicks"))
    return manifest.select("part", "file", "rows", "first_row", "last_row").join(back, "part")


def raw_row_index(spark, sf):
    """The log as raw files, the later half gzipped, numbered in source order as they are scanned."""
    folder, df = S.shared_folder(spark), log(spark, sf)
    a, b = hours(df)
    for k, (part, codec) in enumerate(((F.col("hour_no") < (a + b) // 2, "none"), (F.col("hour_no") >= (a + b) // 2, "gzip"))):
        df.filter(part).orderBy("row_index").select(*[f.name for f in S.RAW_SCHEMA]).write.option("header", True).option("compression", codec).csv(f"{folder}/{k}")
    return S.source_order(S.scan_raw(spark, [f"{folder}/0", f"{folder}/1"])).select("id", "source_index")


def artifact_checksums(spark, sf):
    folder = S.shared_folder(spark)
    log(spark, sf).select("row_index", "click").write.parquet(folder)
    return S.checksums(spark, folder)


def row_index(spark, sf):
    return S.dense_index(log(spark, sf).filter("click = 1"), "hour_no", "row_index").select("row_index", F.col("dense_index").cast("bigint").alias("dense_index"))


def submission(spark, sf):
    folder = S.shared_folder(spark)
    out = _composed(spark, sf).select("inventory_rank", "row_index", "id", r("p").alias("p"))
    out.orderBy("inventory_rank", "row_index").select("id", F.col("p").alias("click")).write.option("header", True).csv(folder)
    return spark.read.schema("id string, click double").option("header", True).csv(folder)


def sparse_lines(spark, sf):
    return P.sparse_lines(_sparse(spark, sf))


def sparse_dataset(spark, sf):
    """The sparse rows written as text by split and inventory, and read back."""
    folder, rows = S.shared_folder(spark), W.staged(_sparse(spark, sf))
    names = rows.select("row_index", F.when(F.col("scoring"), "scoring").otherwise("training").alias("split"), F.col("inventory_type").alias("inventory"))
    S.write_lines(P.sparse_lines(rows).join(names, "row_index"), folder, "split", "inventory")
    return spark.read.schema("line string, split string, inventory string").text(folder)


def lookup_sink(spark, sf):
    """The fitted device lookup, written in order of its key and read back."""
    folder = S.shared_folder(spark)
    S.write_lookup(covariate_lookup(spark, sf), ["device_ip"], folder)
    return spark.read.parquet(folder)


def report_json(spark, sf):
    """The report of both splits, written as JSON and read back."""
    folder, report = S.shared_folder(spark), dataset_report(spark, sf)
    S.write_report(report, folder)
    return spark.read.schema(report.schema).json(folder)


# ---- row-local features


def time_features(spark, sf):
    df = R.time_features(log(spark, sf).select("row_index", "hour"))
    return df.select("row_index", "timestamp_hour", "hour_of_day", "day_of_week", "day_of_month", "hour_of_week", r("hour_sin").alias("hour_sin"), r("hour_cos").alias("hour_cos"))


def inventory_context(spark, sf):
    return R.inventory_context(log(spark, sf)).select("row_index", "inventory_type", "publisher_id", "publisher_domain", "publisher_category")


def identity_keys(spark, sf):
    return R.identity_keys(log(spark, sf)).select("row_index", "identity_kind", "user_id", "base_user", "profile_user")


def feature_crosses(spark, sf):
    return R.crosses(log(spark, sf), RECIPE.crosses).select("row_index", *[n for n, _ in RECIPE.crosses])


def numeric_buckets(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet")
    plain, logs = Bucket("b", "value", (1.0, 10.0, 50.0, 100.0)), Bucket("l", "value", (1.0, 10.0, 50.0, 100.0), True)
    return df.select("event_id", R.bucket(F.col("value"), plain).alias("bucket"), R.bucket(F.log1p(F.abs("value")), logs).alias("log_bucket"))


def category_hash(spark, sf):
    return log(spark, sf).select("row_index", H.category_hash(F.col("site_id"), 42).alias("site_hash"), H.category_hash(F.col("device_ip"), 42).alias("ip_hash"))


def hash_buckets(spark, sf):
    value = F.col("event_id") * F.lit(1000003) * 1009 - F.col("user_id") * F.lit(999999937)
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", H.bucket_location(value, COEFFICIENTS, OFFSET, BUCKETS).alias("location"))


def hash_token(spark, sf):
    return log(spark, sf).select("row_index", H.hash_token(F.concat(F.lit("pub_id-"), "site_id")).alias("site_token"), H.hash_token(F.concat(F.lit("C14-"), "C14")).alias("c14_token"))


def hash_profile_token(spark, sf):
    return log(spark, sf).select("row_index", H.hash_profile_token(F.concat(F.lit("app_id-"), "app_id")).alias("app_token"))


def publisher_mask(spark, sf):
    return log(spark, sf).select("row_index", H.row_masked(F.col("row_index"), 1800).alias("masked"))


def vocab_encode(spark, sf):
    df = log(spark, sf)
    train, _ = split(df)
    vocabularies = {c: L.vocabulary(train, c, 2, RECIPE.maximum_vocabulary) for c in ("site_id", "app_id", "C14")}
    return L.encode(df.select("row_index", "site_id", "app_id", "C14"), vocabularies)


def model_columns(spark, sf):
    df = vocab_encode(spark, sf).join(log(spark, sf).select("row_index", "click", (F.lit(1.0) / F.nullif("click", F.lit(0))).alias("ratio")), "row_index")
    out = R.model_columns(df, ["site_id", "app_id", "C14"], ["ratio"], "click")
    return out.select("row_index", "site_id", "app_id", "C14", F.col("ratio").cast("double").alias("ratio"), F.col("click").cast("double").alias("click"))


# ---- checks


def label_check(spark, sf):
    return C.label_check(log(spark, sf))


def hour_order_check(spark, sf):
    return C.hour_order_check(log(spark, sf))


def missing_hours(spark, sf):
    return C.missing_hours(log(spark, sf).filter("click = 1 AND site_id = 'site_7'"))


def log_hours(spark, sf):
    """The gaps of the whole log; ``missing_hours`` lists those of one site's clicks."""
    return C.hour_coverage(log(spark, sf))


def time_range(spark, sf):
    df = log(spark, sf)
    a, _ = hours(df)
    return C.time_range(df, a + 24, a + 48).select("row_index", "hour_no")


def population_checks(spark, sf):
    return C.population_checks(population_counts(spark, sf))


def lookup_contract(spark, sf):
    """All lookups of the recipe, fitted, against what its definitions declare."""
    train, _ = split(R.crosses(users(spark, sf), RECIPE.crosses))
    sources = ", ".join("scoring" if r["scoring"] else "training" for r in train.select("scoring").distinct().orderBy("scoring").collect())
    fitted = {name: (fit(train), L.reads(fit, train, "click"), sources) for name, fit in L.fits(RECIPE, *hours(train)).items()}
    return C.lookup_contract(spark, RECIPE.lookups(), fitted)


def eligible_users(spark, sf):
    return users(spark, sf).groupBy("profile_user").agg(F.count("*").alias("rows")).filter(F.col("rows") < FEW_ROWS)


def user_eligibility(spark, sf):
    """By inventory: users, those with too few rows for a profile, and the span of rows a user."""
    rows = users(spark, sf).groupBy("inventory_type", "profile_user").agg(F.count("*").alias("n"))
    few = F.count_if(F.col("n") < FEW_ROWS)
    return rows.groupBy("inventory_type").agg(F.count("*").alias("users"), few.alias("few"), F.min("n").alias("least"), F.max("n").alias("most"))


# ---- lookups


def vocabulary(spark, sf):
    return L.vocabulary(split(log(spark, sf))[0], "site_id", 5, RECIPE.maximum_vocabulary)


def frequency(spark, sf):
    return L.covariate_lookup(log(spark, sf), "device_ip", True, {})


def distinct_counts(spark, sf):
    df = log(spark, sf).withColumn("maybe_app", F.expr("nullif(app_id, 'app_none')"))
    return L.covariate_lookup(df, "device_ip", False, {"apps": "maybe_app", "sites": "site_id"})


def covariate_lookup(spark, sf):
    return L.covariate_lookup(split(log(spark, sf))[0], "device_ip", True, {"ip_apps": "app_id", "ip_models": "device_model"})


def approx_distinct_counts(spark, sf):
    """Distinct values from hourly sketches, for the training hours and for all: beside the exact counts, and whether they agree within 5 %."""
    df = log(spark, sf)
    _, end = hours(df)
    sketches = L.distinct_sketches(df, "device_ip", {"apps": "app_id", "models": "C14"})
    kinds = ((end - 24, "train", split(df)[0]), (end, "all", df))
    out = None
    for until, name, population in kinds:
        exact = L.covariate_lookup(population, "device_ip", False, {"apps": "app_id", "models": "C14"}).withColumnsRenamed({"apps__raw": "apps", "models__raw": "models"})
        near = [F.abs(F.col(f"{c}__raw") - F.col(c)) <= F.greatest(0.05 * F.col(c), F.lit(1)) for c in ("apps", "models")]
        one = exact.join(L.estimated(sketches, "device_ip", end=until), "device_ip").select(F.lit(name).alias("population"), "device_ip", "apps", "models", (near[0] & near[1]).alias("near"))
        out = one if out is None else out.unionByName(one)
    return out


def covariate_population(spark, sf):
    train, score = split(log(spark, sf))
    return L.covariate_lookup(train.unionByName(score), "device_ip", True, {"ip_apps": "app_id"})


def covariate_features(spark, sf):
    df = log(spark, sf)
    out = L.covariate_features(df.select("row_index", "device_ip"), {"device_ip": covariate_lookup(spark, sf)})
    return out.select("row_index", r("device_ip_frequency_log1p").alias("device_ip_frequency_log1p"), r("ip_apps").alias("ip_apps"), r("ip_models").alias("ip_models"))


def target_stats(spark, sf):
    return L.target_stats(split(log(spark, sf))[0], "site_id")


def global_prior(spark, sf):
    return L.global_prior(split(log(spark, sf))[0]).select(r("prior", 9).alias("prior"), "n")


def temporal_target_stats(spark, sf):
    train, _ = split(log(spark, sf))
    out = L.temporal_target_stats(train, "site_id", *hours(train), RECIPE.target.blocks)
    return out.withColumn("block_prior", r("block_prior", 9))


def target_features_train(spark, sf):
    train, _ = split(log(spark, sf))
    span = hours(train)
    stats = L.temporal_target_stats(train, "site_id", *span, RECIPE.target.blocks)
    out = L.target_features_train(train.select("row_index", "hour_no", "site_id"), stats, "site_id", *span, RECIPE.target)
    return out.select("row_index", r("site_id_target_logit_lift").alias("lift"), r("site_id_target_evidence_log1p").alias("evidence"))


def target_features_score(spark, sf):
    train, score = split(log(spark, sf))
    prior = L.global_prior(train).first()["prior"]
    out = L.target_features_score(score.select("row_index", "site_id"), L.target_stats(train, "site_id"), "site_id", prior, RECIPE.target)
    return out.select("row_index", r("site_id_target_logit_lift").alias("lift"), r("site_id_target_evidence_log1p").alias("evidence"))


def oov_rates(spark, sf):
    df = log(spark, sf)
    train, _ = split(df)
    encoded = L.encode(df.select("scoring", "site_id", "C14"), {c: L.vocabulary(train, c, 5, RECIPE.maximum_vocabulary) for c in ("site_id", "C14")})
    out = L.oov_rates(encoded.withColumn("split", F.when(F.col("scoring"), "scoring").otherwise("training")), ["site_id", "C14"])
    return out.withColumn("rate", r("rate", 9))


# ---- history


def prior_impressions(spark, sf):
    return Y.impression_history(users(spark, sf), "base_user").select("row_index", "prior_impressions", r(F.log1p("prior_impressions")).alias("prior_impressions_log1p"))


def hours_since_previous(spark, sf):
    return Y.impression_history(users(spark, sf), "base_user").select("row_index", "hours_since_previous")


def prior_in_hour(spark, sf):
    return Y.impression_history(log(spark, sf), "device_ip").select("row_index", "prior_in_hour")


def _clicks(spark, sf):
    return Y.click_history(users(spark, sf), "device_ip", BITS)


def prior_clicks(spark, sf):
    return _clicks(spark, sf).select("row_index", "prior_clicks", "prior_nonclicks")


def prior_ctr_lift(spark, sf):
    df = users(spark, sf)
    prior = df.filter("NOT scoring").agg(F.avg("click").alias("p")).first()["p"]
    return Y.click_history(df, "device_ip", BITS).select("row_index", r(Y.ctr_lift(prior, SMOOTHING, CLIP)).alias("lift"))


def hours_since_click(spark, sf):
    return _clicks(spark, sf).select("row_index", "hours_since_click")


def impressions_since_click(spark, sf):
    return _clicks(spark, sf).select("row_index", "impressions_since_click")


def click_pattern(spark, sf):
    return _clicks(spark, sf).select("row_index", "click_pattern")


def asof_click_state(spark, sf):
    df = log(spark, sf)
    return Y.click_state(df, "device_ip", BITS)


def history_string(spark, sf):
    df = users(spark, sf).filter("identity_kind = 'device'")
    past = Y.history_strings(df, "base_user", EVENTS)
    return df.select("row_index", "base_user", "hour_no").join(past, ["base_user", "hour_no"]).select("row_index", "history")


def history_tokens(spark, sf):
    return _history_tokens(users(spark, sf))


def _history_tokens(df):
    proxies = P.proxy_rows(df)
    return P.history_tokens(proxies.select("row_index", "base_user", "hour_no"), proxies.groupBy("base_user").agg(F.count("*").alias("n")), Y.history_strings(proxies, "base_user", EVENTS), THRESHOLD)


def temporal_windows(spark, sf):
    return Y.windows(log(spark, sf), HOLDOUT, FOLDS, FOLD_HOURS, MINIMUM)


def window_assignment(spark, sf):
    df = log(spark, sf)
    out = Y.assign_windows(df.select("row_index", "hour_no", "click"), Y.windows(df, HOLDOUT, FOLDS, FOLD_HOURS, MINIMUM))
    return out.groupBy("window", "role").agg(F.count("*").alias("rows"), F.sum("click").cast("bigint").alias("clicks"), F.min("hour_no").alias("first_hour"), F.max("hour_no").alias("last_hour"))


# ---- sparse profiles


def identity_counts(spark, sf):
    return P.identity_counts(users(spark, sf))


def _base_tokens(df, past):
    hours, addresses = W.staged(P.user_hours(df, past)), W.staged(P.identity_count(df, "device_ip"))
    return P.base_tokens(df, hours, addresses, identity=BASE_IDENTITY, threshold=THRESHOLD)


def base_tokens(spark, sf):
    df = W.staged(users(spark, sf))
    past = Y.history_strings(df.filter("identity_kind = 'device'"), "base_user", EVENTS)
    return _base_tokens(df, past).select("row_index", F.array_join(F.col("tokens").cast("array<string>"), " ").alias("tokens"))


_NAMES = {(kind, f): names[f] for kind, names in (("app", APP_NAMES), ("site", SITE_NAMES)) for f in names}


def _edges(df):
    """Edges of both inventories and both fields, from one pass over the log."""
    return P.edges_of_pairs(W.staged(P.publisher_pairs(df)), _NAMES, IDENTITY, FEW_ROWS)


def profile_edges(spark, sf):
    return _edges(users(spark, sf)).withColumn("weight", r("weight"))


def _profile_text(column="profile"):
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["field"].cast("string"), x["feature"].cast("string"), F.format_number(x["value"], 5))), " ")


def profile_vectors(spark, sf):
    return P.profile_vectors(_edges(users(spark, sf))).select("inventory", "user", _profile_text().alias("profile"))


def profile_attach(spark, sf):
    df = W.staged(users(spark, sf))
    vectors = P.profile_vectors(_edges(df)).withColumnsRenamed({"inventory": "inventory_type", "user": "profile_user"})
    return df.select("row_index", "inventory_type", "profile_user").join(vectors, ["inventory_type", "profile_user"], "left").select("row_index", F.coalesce(F.size("profile"), F.lit(0)).cast("bigint").alias("entries"))


def profile_coverage(spark, sf):
    df = W.staged(users(spark, sf))
    edges = _edges(df)
    per = edges.groupBy("inventory").agg(F.countDistinct("user").alias("users"), F.count_if(F.col("field") == 16).alias("publisher_edges"), F.count_if(F.col("field") == 17).alias("domain_edges"))
    have = edges.select(F.col("inventory").alias("inventory_type"), F.col("user").alias("profile_user")).distinct()
    rows = df.join(have, ["inventory_type", "profile_user"], "left_semi").groupBy("inventory_type").agg(F.count_if("scoring").alias("scoring_rows"), F.count_if(~F.col("scoring")).alias("training_rows"))
    return per.join(rows.withColumnRenamed("inventory_type", "inventory"), "inventory")


def proxy_counts(spark, sf):
    return P.proxy_rows(users(spark, sf)).groupBy("base_user").agg(F.count("*").alias("n"))


def _sparse(spark, sf, history=True, keep=(), resolved=None):
    """The sparse rows; the resolved log, its pairs, counts and histories are each made once and read from there."""
    df = W.staged(users(spark, sf)) if resolved is None else resolved
    proxy = (F.col("identity_kind") == "proxy") & (F.col("inventory_type") == "app")
    # proxies and devices have names of their own, so one pass serves both
    past = Y.history_strings(df.filter((F.col("identity_kind") == "device") | proxy), "base_user", EVENTS)
    return P.sparse_rows(_base_tokens(df, past), P.profile_vectors(_edges(df)), THRESHOLD if history else None, keep)


def sparse_rows(spark, sf):
    total = lambda c, zero: F.aggregate("features", zero, lambda s, x: s + x[c])
    whole = F.lit(0).cast("bigint")
    return _sparse(spark, sf).select("row_index", F.size("features").cast("bigint").alias("entries"), total("feature", whole).alias("feature_sum"), total("field", whole).alias("field_sum"), r(total("value", F.lit(0.0)), 4).alias("weight_sum"))


def cold_publisher_rows(spark, sf):
    rows = P.cold_publisher(_sparse(spark, sf, False).filter("inventory_type = 'site'"))
    return rows.select("row_index", "masked", F.get("features", F.lit(0))["feature"].alias("first_feature"))


def cold_publisher_selector(spark, sf):
    return P.cold_selector(users(spark, sf))


def population_counts(spark, sf):
    df = W.staged(users(spark, sf))
    app, s = F.col("inventory_type") == "app", F.col("scoring")
    proxy = app & s & (F.col("identity_kind") == "proxy")
    used = _history_tokens(df).filter("use_history").select("row_index", F.lit(True).alias("used"))
    cold = P.cold_selector(df).filter("use_cold").select("row_index", F.lit(True).alias("cold"))
    rows = df.join(used, "row_index", "left").join(cold, "row_index", "left")
    return rows.agg(
        F.count_if(~s).alias("training"), F.count_if(~s & app).alias("training_app"), F.count_if(~s & ~app).alias("training_site"),
        F.count_if(s).alias("scoring"), F.count_if(s & app).alias("scoring_app"), F.count_if(s & ~app).alias("scoring_site"),
        F.count_if(proxy).alias("scoring_proxy"), F.count_if(s & F.col("used")).alias("scoring_history"), F.count_if(s & F.col("cold")).alias("scoring_cold"),
    )


# ---- composition


def aligned_join(spark, sf):
    df = log(spark, sf)
    return P.aligned(df.filter("hour_no % 24 <> 3"), df.filter("hour_no % 24 <> 5"))


def aligned_predictions(spark, sf):
    """All scoring rows of the log against all composed predictions."""
    return P.aligned(split(log(spark, sf))[1], _composed(spark, sf))


def _composed(spark, sf):
    df = W.staged(users(spark, sf))
    app = df.filter("scoring AND inventory_type = 'app'").join(_history_tokens(df).select("row_index", "use_history"), "row_index", "left")
    app = app.select("row_index", "id", F.coalesce("use_history", F.lit(False)).alias("selected"), F.col("p2").alias("special"), F.col("p1").alias("baseline"))
    site = df.filter("scoring AND inventory_type = 'site'").join(P.cold_selector(df).select("row_index", "use_cold"), "row_index")
    site = site.select("row_index", "id", F.col("use_cold").alias("selected"), (1 - F.col("p2")).alias("special"), F.col("p1").alias("baseline"))
    return P.compose(app, site)


def compose_predictions(spark, sf):
    return _composed(spark, sf).withColumn("p", r("p"))


def prediction_stats(spark, sf):
    out = _composed(spark, sf).rollup("source").agg(F.count("*").alias("rows"), r(F.min("p")).alias("least"), r(F.max("p")).alias("most"), r(F.avg("p")).alias("mean"), F.count_if(~((F.col("p") > 0) & (F.col("p") < 1))).alias("out_of_range"))
    return out.withColumn("source", F.coalesce("source", F.lit("all")))


def submission_check(spark, sf):
    return _composed(spark, sf).agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), F.count_if(F.col("p").isNull() | F.isnan("p")).alias("bad"))


# ---- reports


def raw_report(spark, sf):
    """Rows, hours, click rate, and the distinct values of each column, counted as (column, value) pairs."""
    df = log(spark, sf)
    distinct = S.column_report(df, S.STRINGS)
    wide = distinct.agg(*[F.coalesce(F.max(F.when(F.col("column") == c, F.col("distinct"))), F.lit(0).cast("bigint")).alias(f"{c}_cardinality") for c in S.STRINGS])
    return df.agg(F.count("*").alias("rows"), F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"), r(F.avg("click"), 9).alias("click_rate")).crossJoin(wide)  # one row and one row


def raw_column_report(spark, sf):
    """Every raw column's values, nulls and most frequent value, from one pass."""
    return S.column_report(S.raw_columns(log(spark, sf)), S.RAW_STRINGS)


def dataset_report(spark, sf):
    df = log(spark, sf).withColumn("split", F.when(F.col("scoring"), "scoring").otherwise("training"))
    return df.groupBy("split").agg(F.count("*").alias("rows"), r(F.avg("click"), 9).alias("click_rate"), F.min("hour_no").alias("first_hour"), F.max("hour_no").alias("last_hour"), (F.countDistinct("site_id") + F.countDistinct("app_id")).alias("cardinality"))


def feature_contract(spark, sf):
    """The lineage, with the number of distinct values that each feature's first input has in the log."""
    df = R.identity_keys(log(spark, sf))
    columns = sorted({d[3][0] for d in RECIPE.definitions()} & set(df.columns))
    counts = df.agg(*[L.distinct_with_null(c).alias(c) for c in columns]).unpivot([], columns, "first_input", "values")
    contract = RECIPE.contract(spark).withColumn("first_input", F.element_at(F.split("inputs", ","), 1))
    return contract.join(counts, "first_input", "left")


# ---- metrics


def _holdout(spark, sf):
    return log(spark, sf).filter("scoring")


def row_losses(spark, sf):
    return _holdout(spark, sf).select("row_index", r(E.loss(F.col("click"), F.col("p1"))).alias("loss"))


def eval_metrics(spark, sf):
    return E.eval_metrics(log(spark, sf)).select("rows", r("logloss").alias("logloss"), r("brier").alias("brier"))


def roc_auc(spark, sf):
    return E.roc_auc(log(spark, sf)).select(r("roc_auc", 9).alias("roc_auc"))


def calibration_error(spark, sf):
    return E.calibration_error(log(spark, sf)).select(r("ece", 9).alias("ece"))


def paired_losses(spark, sf):
    out = E.paired_losses(_holdout(spark, sf), "p1", "p2")
    return out.select("row_index", r("candidate").alias("candidate"), r("incumbent").alias("incumbent"), r("difference").alias("difference"))


def _blocks(spark, sf):
    losses = E.paired_losses(_holdout(spark, sf).withColumn("noise", F.col("p1")), "p1", "p2")
    hour = log(spark, sf).select("row_index", "hour_no")
    indexed = S.dense_index(losses.join(hour, "row_index"), "hour_no", "row_index")
    rows = losses.count()
    return E.block_means(indexed, rows, BLOCK_ROWS), max(1, min(rows, -(-rows // BLOCK_ROWS)))


def block_means(spark, sf):
    return _blocks(spark, sf)[0].withColumn("mean_difference", r("mean_difference"))


def block_bootstrap(spark, sf):
    means, k = _blocks(spark, sf)
    return E.bootstrap(means, k, SAMPLES, CONFIDENCE, SEED).select("samples", r("upper").alias("upper"), r("mean").alias("mean"))


def _folds(spark, sf):
    df = log(spark, sf)
    table = Y.windows(df, HOLDOUT, FOLDS, FOLD_HOURS, MINIMUM).filter("NOT final_holdout")
    return E.fold_losses(Y.assign_windows(df.select("hour_no", "click", "p1", "p2"), table).filter("role = 'validation'"), {"candidate": "p1", "incumbent": "p2"})


def fold_losses(spark, sf):
    return _folds(spark, sf).select("window", "rows", r("candidate").alias("candidate"), r("incumbent").alias("incumbent"))


def selection_gate(spark, sf):
    means, k = _blocks(spark, sf)
    upper = E.bootstrap(means, k, SAMPLES, CONFIDENCE, SEED)
    mean = means.agg((F.sum(F.col("rows") * F.col("mean_difference")) / F.sum("rows")).alias("mean_difference"))
    folds = _folds(spark, sf).agg(F.avg("candidate").alias("candidate"), F.avg("incumbent").alias("incumbent"))
    one = mean.withColumns({"upper": upper.select("upper").scalar(), "candidate": folds.select("candidate").scalar(), "incumbent": folds.select("incumbent").scalar()})
    reason = E.gate(F.col("mean_difference"), F.col("upper"), F.col("candidate"), F.col("incumbent"), GUARD)
    return one.select(r("mean_difference").alias("mean_difference"), r("upper").alias("upper"), r("candidate").alias("candidate"), r("incumbent").alias("incumbent"), reason.alias("reason"))


def checked_gate(spark, sf):
    """The gate behind a check that both models' losses are of one population: same rows, order and labels."""
    rows = S.dense_index(_holdout(spark, sf), "hour_no", "row_index", name="place").withColumn("place", F.col("place").cast("bigint"))
    of = lambda p: S.ordered_identity(rows.filter(F.col(p).isNotNull()), "place", ["row_index", "id", "click"])
    a, b = of("p1"), of("p2")
    same = a.crossJoin(b.withColumnsRenamed({"rows": "other_rows", "identity": "other_identity"})).select("rows", (F.col("identity") == F.col("other_identity")).alias("same_population"))  # one row and one row
    one = selection_gate(spark, sf).crossJoin(same)
    return one.withColumn("reason", F.when(~F.col("same_population") | (F.col("rows") == 0), "other populations").otherwise(F.col("reason")))


def residual_correlation(spark, sf):
    df = log(spark, sf).withColumn("p3", 1 - F.col("p2"))
    return E.residual_correlation(df, ["p1", "p2", "p3"]).select(*[r(c).alias(c) for c in ("p1_p2", "p1_p3", "p2_p3", "penalty")])


def batch_plan(spark, sf):
    shards = log(spark, sf).groupBy(F.floor(F.col("row_index") / 512).alias("shard")).agg(F.count("*").alias("rows"))
    return E.batch_plan(shards, 4, 1000)


def population_fingerprint(spark, sf):
    df = log(spark, sf)
    return df.groupBy("scoring").agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64("row_index", "id", "hour")).alias("content"), F.sha2(F.to_json(F.struct(F.min("hour_no").alias("a"), F.max("hour_no").alias("b"))), 256).alias("range"))


def population_identity(spark, sf):
    """An identity of training and scoring rows that sees their order and repeated rows."""
    parts = []
    for name, df in zip(("training", "scoring"), split(log(spark, sf)), strict=True):
        placed = S.dense_index(df, "hour_no", "row_index", name="place")
        parts.append(S.ordered_identity(placed.withColumn("place", F.col("place").cast("bigint")), "place", ["id", "hour", "site_id", "app_id", "device_id"]).withColumn("population", F.lit(name)))
    return parts[0].unionByName(parts[1])


def paired_mismatch(spark, sf):
    """The rows of the composed predictions against those of the holdout."""
    holdout = _holdout(spark, sf).select("row_index", "click")
    return E.paired_mismatch(_composed(spark, sf).join(log(spark, sf).select("row_index", "click"), "row_index"), holdout)


def ensemble_mean_logit(spark, sf):
    return log(spark, sf).select("row_index", r(E.mean_logit(None, ["p1", "p2"])).alias("p"))


# ---- models


def ffm_score(spark, sf):
    rows = W.staged(_sparse(spark, sf, False).filter("scoring"))
    features = rows.select(F.explode("features").alias("x")).select("x.feature")
    return M.score(rows, M.synthetic_weights(features, FFM_FIELDS, FFM_FACTORS)).select("row_index", r("logit", 4).alias("logit"), r("p", 4).alias("p"))


def ffm_epoch(spark, sf):
    """Log loss before and after each of two full-batch steps over the training rows of app inventory."""
    folder = S.shared_folder(spark)
    _sparse(spark, sf, False).filter("NOT scoring AND inventory_type = 'app'").write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    start = M.synthetic_weights(rows.select(F.explode("features").alias("x")).select("x.feature"), FFM_FIELDS, FFM_FACTORS)
    state = start.withColumn("w", F.transform("w", lambda x: x / 5)).withColumn("g", F.transform("w", lambda x: F.lit(1.0)))
    losses = []
    for step in range(3):
        scored, state = M.epoch(rows, state)
        losses.append(scored.agg(F.avg(F.log1p(F.exp(-(2 * F.col("click") - 1) * F.col("logit")))).alias("logloss")).select(F.lit(step).alias("epoch"), "logloss"))
        state.write.parquet(f"{folder}/state{step}")
        state = spark.read.parquet(f"{folder}/state{step}")
    return losses[0].unionByName(losses[1]).unionByName(losses[2])


def baseline_ctr(spark, sf):
    """A logistic regression on hashed columns, fitted on training rows; scores of the holdout."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import FeatureHasher

    df = R.time_features(users(spark, sf)).withColumn("label", F.col("click").cast("double"))
    columns = ["publisher_id", "publisher_domain", "publisher_category", "device_model", "C14", "C17", "hour_of_day"]
    hashed = FeatureHasher(inputCols=columns, outputCol="features", numFeatures=1 << 12, categoricalCols=["hour_of_day"]).transform(df)
    model = LogisticRegression(maxIter=10, regParam=0.01).fit(hashed.filter("NOT scoring"))
    from pyspark.ml.functions import vector_to_array

    return model.transform(hashed.filter("scoring")).select("row_index", "click", vector_to_array("probability")[1].alias("p"))


SPECIAL = {"app": "app_special", "site": "site_special"}


def _sources(spark, sf, resolved=None):
    """The rows of the four sources: both inventories' single tokens and profiles, app rows with histories, site rows with masked publishers."""
    # sources are named first, so that counting them reads no features
    names = {kind: F.array(*[F.lit(f"{kind}_{x}") for x in ("baseline", "special")]) for kind in ("app", "site")}
    rows = W.staged(_sparse(spark, sf, resolved=resolved)).withColumn("source", F.explode(F.when(F.col("inventory_type") == "app", names["app"]).otherwise(names["site"])))
    plain = F.filter("whole", lambda x: x["field"] < P.HISTORY_FIELD)  # only app rows have histories
    of = F.when(F.col("source") == "app_baseline", plain).when(F.col("source") == "site_special", F.col("features")).otherwise(F.col("whole"))
    return P.cold_publisher(rows.withColumn("whole", F.col("features"))).select("source", "row_index", "click", "scoring", of.alias("features"))


def source_fit_losses(spark, sf):
    """Log loss of the four sources' models over their training rows, epoch by epoch."""
    return W.fit(_sources(spark, sf).filter("NOT scoring"))[1]


def _fitted(spark, sf):
    """Composed predictions of the four fitted sources."""
    resolved = W.staged(users(spark, sf))  # written once, for the sparse rows and for what is chosen by it
    rows = _sources(spark, sf, resolved)
    state, _ = W.fit(rows.filter("NOT scoring"))
    scored = W.staged(W.predict(rows.filter("scoring"), state))
    of = lambda name, column: scored.filter(F.col("source") == name).select("row_index", F.col("p").alias(column))
    df = resolved.filter("inventory_type = 'app' OR scoring OR inventory_type = 'site'").select("row_index", "id", "hour_no", "click", "scoring", "inventory_type", "identity_kind", "base_user", "publisher_id")
    use = {"app": _history_tokens(df).select("row_index", F.col("use_history").alias("selected")), "site": P.cold_selector(df).select("row_index", F.col("use_cold").alias("selected"))}
    sides = []
    for kind, chosen in use.items():
        side = df.filter((F.col("inventory_type") == kind) & F.col("scoring")).select("row_index", "id").join(chosen, "row_index", "left")
        side = side.join(of(f"{kind}_special", "special"), "row_index", "left").join(of(f"{kind}_baseline", "baseline"), "row_index", "left")
        sides.append(side.withColumn("selected", F.coalesce("selected", F.lit(False))))
    return P.compose(*sides)


def fitted_predictions(spark, sf):
    return _fitted(spark, sf).withColumn("p", r("p"))


def fitted_prediction_stats(spark, sf):
    """By source and for all: rows, ids, range, mean and the first row with a bad probability."""
    out = _fitted(spark, sf).rollup("source").agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), r(F.min("p")).alias("least"), r(F.max("p")).alias("most"), r(F.avg("p")).alias("mean"), W.one_value("p").alias("first_bad_row"))
    return out.withColumn("source", F.coalesce("source", F.lit("all")))


def sparse_fold_losses(spark, sf):
    """A factorization machine on the sparse rows of each walk-forward fold: its log loss there, beside that of the training click rate."""
    rows = W.staged(_sparse(spark, sf, False, ("hour_no",)))
    table = Y.windows(rows, HOLDOUT, FOLDS, FOLD_HOURS, MINIMUM).filter("NOT final_holdout")
    return E.fold_losses(B.fold_predictions(rows, table), {"model": "p", "click_rate": "rate"}).select("window", "rows", r("model").alias("model"), r("click_rate").alias("click_rate"))


# ---- streams


def stream_hourly_clicks(spark, sf):
    return T.run(T.hourly_clicks(T.event_stream(spark, sf)))


def stream_prior_impressions(spark, sf):
    return T.run(T.prior_impressions(T.ordered_stream(spark, sf)))


def stream_click_history(spark, sf):
    last = log(spark, sf).agg(F.max("hour_no").alias("h")).first()["h"]
    return T.run(T.click_history(T.ordered_stream(spark, sf), last - 23))


def stream_late_rows(spark, sf):
    """Three parts, each over the whole time, arrive one by one; a row may be 24 hours late."""
    folder, df = S.shared_folder(spark), log(spark, sf).select("row_index", "hour_no")
    parts = [df.filter(F.col("row_index") % 3 == part) for part in range(3)]
    parts[0].limit(0).write.parquet(folder)  # the folder must be there
    stream = spark.readStream.schema(df.schema).parquet(folder)
    _, late = T.route_late(stream, 24, [lambda p=p: p.write.mode("append").parquet(folder) for p in parts])
    return late.groupBy(F.col("batch").cast("bigint").alias("batch")).agg(F.count("*").alias("late_rows"), F.max("hour_no").alias("last_hour"))


def stream_timed_history(spark, sf):
    """Three parts, each over the whole time, arrive one by one with a restart between: histories in closed hours, and late rows."""
    folder, events = S.shared_folder(spark), spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = events.select("user_id", "event_id", "ts", "event_type")
    last = log(spark, sf).agg(F.max("hour_no").alias("h")).first()["h"]
    rows.limit(0).write.parquet(folder)  # the folder must be there
    parts = [rows.filter(F.col("event_id") % 3 == k) for k in range(3)]
    stream = lambda: T2.timed_history(spark.readStream.schema(rows.schema).parquet(folder), ALLOWED, last - 23, bits=BITS)
    return T2.run_arrivals(stream, [lambda p=p: p.write.mode("append").parquet(folder) for p in parts]).fillna(0)  # late rows have no history


def stream_enrich(spark, sf):
    train, _ = split(log(spark, sf))
    lookups = {"device_ip": L.covariate_lookup(train, "device_ip", True, {"ip_apps": "app_id"}), "site_id": L.target_stats(train, "site_id")}
    rows = S.as_impressions(T.event_stream(spark, sf)).select("row_index", "device_ip", "site_id")
    out = T.run(T.enrich(rows, lookups))
    return out.select("row_index", F.coalesce("device_ip__frequency", F.lit(0)).alias("frequency"), F.coalesce("ip_apps__raw", F.lit(0)).alias("apps"), F.coalesce("positive", F.lit(0)).alias("positive"), F.coalesce("n", F.lit(0)).alias("n"))


# ---- workflows


def evaluation_dataset(spark, sf):
    """All features of the recipe for every row: lookups fitted on training rows, history causal."""
    return _dataset(spark, sf, False)


def production_dataset(spark, sf):
    """As above, with covariates counted over training and scoring rows (labels stay hidden)."""
    return _dataset(spark, sf, True)


def _recipe_rows(spark, sf):
    return R.crosses(R.time_features(users(spark, sf)), RECIPE.crosses)


def _rounded(df, windows):
    return D.dataset(df, RECIPE, windows, r).withColumn("click", F.col("click").cast("double"))


def evaluation_windows(spark, sf):
    """All features of the contract in every walk-forward window and the final holdout of the labelled log."""
    df = _recipe_rows(spark, sf).filter("NOT scoring")
    return _rounded(df, D.folds(Y.windows(df, HOLDOUT, FOLDS, FOLD_HOURS, MINIMUM)))


def production_window(spark, sf):
    """The same features for all labelled rows and the scoring rows; frequencies and distinct counts are of both."""
    df = _recipe_rows(spark, sf)
    span = df.agg(F.min("hour_no").alias("a"), F.min(F.when(F.col("scoring"), F.col("hour_no"))).alias("e"), F.max("hour_no").alias("b")).first()
    return _rounded(df.withColumn("click", F.when(~F.col("scoring"), F.col("click"))), [D.Fold("production", span["a"], span["e"], span["b"] + 1, True)])


def _dataset(spark, sf, transductive):
    df = W.staged(R.crosses(R.time_features(users(spark, sf)), RECIPE.crosses))
    train, score = split(df)
    population = df if transductive else train
    span, prior = hours(train), L.global_prior(train).first()["prior"]
    lookups = {k: L.covariate_lookup(population, k, k in RECIPE.frequency, {n: v for n, key, v in RECIPE.distinct if key == k}) for k in sorted({*RECIPE.frequency, *(k for _, k, _ in RECIPE.distinct)})}
    rows = Y.click_history(Y.impression_history(df, "user_id"), "user_id", BITS)
    rows = L.covariate_features(rows, lookups).withColumn("lift", Y.ctr_lift(prior, SMOOTHING, CLIP))
    rows = rows.withColumn(RECIPE.buckets[0].name, R.bucket(F.col(RECIPE.buckets[0].source), RECIPE.buckets[0]))
    column = RECIPE.target.columns[0]
    known = L.target_features_train(rows.filter("NOT scoring"), L.temporal_target_stats(train, column, *span, RECIPE.target.blocks), column, *span, RECIPE.target)
    fresh = L.target_features_score(rows.filter("scoring"), L.target_stats(train, column), column, prior, RECIPE.target)
    both = L.encode(known.unionByName(fresh), {c: L.vocabulary(train, c, RECIPE.minimum_count, RECIPE.maximum_vocabulary) for c in ("C14", "ip_model")})
    numbers = ["device_ip_frequency_log1p", "user_id_frequency_log1p", "device_ip_apps", "user_sites", "lift", f"{column}_target_logit_lift", f"{column}_target_evidence_log1p"]
    whole = ["hour_of_week", RECIPE.buckets[0].name, "C14", "ip_model", "prior_impressions", "hours_since_previous", "prior_in_hour", "prior_clicks", "prior_nonclicks", "hours_since_click", "impressions_since_click", "click_pattern"]
    return both.select("row_index", "scoring", F.when(~F.col("scoring"), F.col("click")).alias("click"), *[F.col(c).cast("bigint").alias(c) for c in whole], *[r(c).alias(c) for c in numbers])


_HELPERS = {"log", "users", "split", "hours", "r"}
QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_") and n not in _HELPERS}
