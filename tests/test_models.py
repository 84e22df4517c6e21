import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ffm as M
from tidemark.operators import metrics as E
from tidemark.operators import profiles as P
from tidemark.sources import impressions as S
from tidemark.streaming import history as T


def test_composition(spark):
    schema = "row_index long, id string, selected boolean, special double, baseline double"
    app = spark.createDataFrame([(0, "a", False, 0.3, 0.1), (1, "b", True, 0.4, 0.2)], schema)
    site = spark.createDataFrame([(0, "c", True, 0.7, 0.5), (1, "d", False, 0.8, 0.6)], schema)
    out = P.compose(app, site).orderBy("inventory_rank", "row_index").collect()
    assert [(r["id"], r["p"]) for r in out] == [("a", 0.1), ("b", 0.4), ("c", 0.7), ("d", 0.6)]
    assert len({r["source"] for r in out}) == 4


def test_auc_with_ties(spark):
    g = np.random.default_rng(1)
    y, p = g.integers(0, 2, 300), g.integers(1, 9, 300) / 10
    pairs = [(a > b) + (a == b) / 2 for a in p[y == 1] for b in p[y == 0]]
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p, strict=True)], "click int, p1 double")
    assert E.roc_auc(df).first()[0] == pytest.approx(np.mean(pairs))
    assert np.isnan(E.roc_auc(df.filter("click = 1")).first()[0])


def test_calibration(spark):
    g = np.random.default_rng(2)
    p, y = g.random(500), g.integers(0, 2, 500)
    at = np.clip(np.digitize(p, np.linspace(0, 1, 16)) - 1, 0, 14)
    want = sum((at == i).mean() * abs(y[at == i].mean() - p[at == i].mean()) for i in range(15) if (at == i).any())
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p, strict=True)], "click int, p1 double")
    assert E.calibration_error(df).first()[0] == pytest.approx(want)


def test_blocks_are_contiguous_and_even(spark):
    n, size = 1000, 51
    k = -(-n // size)
    df = spark.range(n).select(F.col("id").alias("dense_index"), F.col("id").cast("double").alias("difference"))
    edges = np.arange(k + 1) * n // k
    out = E.block_means(df, n, size).orderBy("block").collect()
    assert [r["rows"] for r in out] == np.diff(edges).tolist()
    assert [r["mean_difference"] for r in out] == [np.arange(a, b).mean() for a, b in zip(edges[:-1], edges[1:], strict=True)]


@pytest.mark.parametrize("noise,selected", [(False, True), (True, False)])
def test_gate(spark, noise, selected):
    n = 1000
    losses = np.linspace(0.2, 0.8, n)
    change = np.where(np.arange(n) % 2, 0.01, -0.01) if noise else np.full(n, -0.01)
    df = spark.createDataFrame([(i, float(losses[i] + change[i] - losses[i])) for i in range(n)], "dense_index long, difference double")
    means = E.block_means(df, n, 51)
    upper = E.bootstrap(means, 20, 500, 0.95, 1).first()["upper"]
    mean = float(change.mean())
    one = spark.range(1).select(E.gate(F.lit(mean), F.lit(upper), F.lit(0.4), F.lit(0.4), 1e-4).alias("x")).first()["x"]
    assert (one == "selected") == selected


def test_batch_plan(spark):
    shards = spark.createDataFrame([(0, 10), (1, 5), (2, 7), (3, 9)], "shard long, rows long")
    assert [(r["worker"], r["rows"], r["steps"]) for r in E.batch_plan(shards, 2, 8).orderBy("worker").collect()] == [(0, 17, 3), (1, 14, 2)]


def test_full_batch_step_equals_numpy(spark):
    g = np.random.default_rng(4)
    rows = [(i, int(g.integers(2)), [(f, int(g.integers(1, 5)) + 10 * f, float(g.random())) for f in (1, 2, 3)]) for i in range(14)]
    df = spark.createDataFrame(rows, "row_index long, click int, features array<struct<field:bigint,feature:bigint,value:double>>")
    state = M.synthetic_weights(df.select(F.explode("features").alias("x")).select("x.feature"), 3, 2).withColumn("g", F.transform("w", lambda x: F.lit(1.0)))
    w = {(r["feature"], r["field"]): np.array(r["w"]) for r in state.collect()}
    grad = {k: np.zeros(2) for k in w}
    logits = {}
    for i, y, fs in rows:
        pairs = [(a, b) for k, a in enumerate(fs) for b in fs[k + 1 :]]
        z = sum(w[a[1], b[0]] @ w[b[1], a[0]] * a[2] * b[2] for a, b in pairs)
        logits[i], s = z, 2 * y - 1
        kappa = -s / (1 + np.exp(s * z))
        for a, b in pairs:
            grad[a[1], b[0]] += kappa * a[2] * b[2] * w[b[1], a[0]]
            grad[b[1], a[0]] += kappa * a[2] * b[2] * w[a[1], b[0]]
    scored, after = M.epoch(df, state)
    assert {r["row_index"]: pytest.approx(r["logit"]) for r in scored.collect()} == logits
    for r in after.collect():
        k = (r["feature"], r["field"])
        d = grad[k] + 2e-5 * w[k] if grad[k].any() else np.zeros(2)
        assert r["w"] == pytest.approx(list(w[k] - 0.05 * d / np.sqrt(1 + d * d)))


def test_raw_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,click,hour\n1,0,14102100\n")
    with pytest.raises(ValueError, match="lacks columns"):
        S.scan_raw(spark, str(tmp_path / "a.csv"))


def test_canonical_copy_is_reused(spark, tmp_path):
    df = spark.range(5)
    S.canonical(df, str(tmp_path), "x")
    assert S.canonical(spark.range(99), str(tmp_path), "x").count() == 5


def test_shards_are_bounded_and_contiguous(spark, tmp_path):
    S.write_shards(spark.range(100, 350).select(F.col("id").alias("n")), str(tmp_path / "s"), "n", 64, 100, 350)
    out = spark.read.parquet(str(tmp_path / "s")).groupBy("shard").agg(F.count("*").alias("c"), F.min("n").alias("a")).orderBy("shard").collect()
    assert [(r["shard"], r["c"], r["a"]) for r in out] == [(0, 64, 100), (1, 64, 164), (2, 64, 228), (3, 58, 292)]


def test_dense_index(spark):
    df = spark.range(50).select((F.col("id") % 7).alias("h"), (100 - F.col("id")).alias("o")).repartition(5)
    out = S.dense_index(df, "h", "o").orderBy("h", "o").collect()
    assert [r["dense_index"] for r in out] == list(range(50))


def test_stream_over_many_batches_equals_one(spark, tmp_path):
    schema = "user_id long, event_id long, ts timestamp, event_type string"
    rows = [(i % 3, i, f"2024-01-01 {i // 10:02d}:00:00", "click" if i % 4 == 0 else "view") for i in range(120)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    results = []
    for parts in (1, 4):
        folder = str(tmp_path / f"p{parts}")
        for k in range(parts):  # one file after another, in order of time
            df.filter((F.col("event_id") >= 120 * k // parts) & (F.col("event_id") < 120 * (k + 1) // parts)).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        first = T.run(T.prior_impressions(stream)).orderBy("event_id").collect()
        second = T.run(T.click_history(stream, spark.sql("SELECT floor(unix_timestamp(timestamp'2024-01-01 09:00:00') / 3600) h").first()["h"])).orderBy("event_id").collect()
        results.append((first, second))
    assert results[0] == results[1]


def test_streams_read_a_folder_of_disordered_files(spark, tmp_path, monkeypatch):
    from tidemark.queries import spark as Q

    source = "/root/testdata/sf0.001"
    spark.read.parquet(f"{source}/events.parquet").repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    names = ("stream_hourly_clicks", "stream_prior_impressions", "stream_click_history", "stream_enrich", "stream_late_rows")
    rows = lambda name, folder: sorted(map(tuple, getattr(Q, name)(spark, str(folder)).collect()))
    want = {n: rows(n, source) for n in names}
    assert all(len(w) > 0 for w in want.values())
    monkeypatch.setattr(T, "SLICE_ROWS", 400)  # three slices: state goes from one batch to the next
    assert {n: rows(n, tmp_path) for n in names} == want


def test_lookup_is_written_in_order_with_an_inventory(spark, tmp_path):
    path = str(tmp_path / "lookup")
    manifest = S.write_lookup(spark.range(500).select(((F.col("id") * 37) % 500).alias("k"), F.col("id").alias("v")), ["k"], path)
    known = spark.createDataFrame(manifest.collect(), manifest.schema)
    assert known.agg(F.sum("rows")).first()[0] == 500 and S.changed_files(spark, path, known).count() == 0
    parts = spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.collect_list("k")).collect()
    assert all(p[1] == sorted(p[1]) for p in parts)
    first = known.orderBy("file").first()["file"]
    altered = known.filter(F.col("file") != first).withColumn("rows", F.col("rows") + 1)
    gone = spark.createDataFrame([("gone.parquet", 1, "x", 1)], "file string, bytes long, sha256 string, rows long")
    states = {r["file"]: r["state"] for r in S.changed_files(spark, path, altered.unionByName(gone)).collect()}
    assert states.pop(first) == "new" and states.pop("gone.parquet") == "missing" and set(states.values()) <= {"altered"}
    with pytest.raises(ValueError):
        S.write_lookup(spark.createDataFrame([(1,), (1,)], "k int"), ["k"], str(tmp_path / "twice"))
    assert not (tmp_path / "twice").exists()


def test_report_lines_have_all_names(spark, tmp_path):
    S.write_report(spark.createDataFrame([("a", None), ("b", 2)], "split string, rows int"), str(tmp_path / "r"))
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "r")).collect())
    assert lines == ['{"split":"a","rows":null}', '{"split":"b","rows":2}']


def test_scores_broadcast_no_table_that_grows(spark):
    """Features, weights and profiles are packed well in files: by their sizes Spark would send them through the driver."""
    from tidemark.queries import spark as Q

    for df in (Q.ffm_score(spark, "/root/testdata/sf0.001"), Q._sparse(spark, "/root/testdata/sf0.001")):
        plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
        joined = [x for x in plan if "BroadcastHashJoin" in x]
        # the tables that are counted first
        assert len([x for x in plan if "SortMergeJoin" in x]) >= 2 and all("device_ip" in x or "value" in x for x in joined)


def test_full_batch_step_is_the_same_in_small_blocks(spark):
    """Repeated fields, features and fields without weights, rows without label or features."""
    g = np.random.default_rng(8)
    rows = [(i, None if i % 9 == 5 else int(g.integers(2)), [] if i % 11 == 3 else [(f, int(g.integers(1, 5)) + 10 * f, float(g.random())) for f in (1, 2, 2, 3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "row_index long, click int, features array<struct<field:bigint,feature:bigint,value:double>>")
    state = M.synthetic_weights(df.select(F.explode("features").alias("x")).select("x.feature"), 3, 2).withColumn("g", F.transform("w", lambda x: F.lit(1.0)))
    state = state.filter("feature <> 12 AND NOT (feature = 23 AND field = 1)").localCheckpoint()
    w = {(r["feature"], r["field"]): np.array(r["w"]) for r in state.collect()}
    grad, logits = {}, {}
    for i, y, fs in rows:
        pairs = [(a, b) for k, a in enumerate(fs) for b in fs[k + 1 :] if a[0] != b[0] and (a[1], b[0]) in w and (b[1], a[0]) in w]
        z = logits[i] = sum(w[a[1], b[0]] @ w[b[1], a[0]] * a[2] * b[2] for a, b in pairs)
        for a, b in pairs if y is not None else []:
            c = -(2 * y - 1) / (1 + np.exp((2 * y - 1) * z)) * a[2] * b[2]
            grad[a[1], b[0]] = grad.get((a[1], b[0]), 0) + c * w[b[1], a[0]]
            grad[b[1], a[0]] = grad.get((b[1], a[0]), 0) + c * w[a[1], b[0]]
    for size in (7, 1000):
        scored, after = M.epoch(df, state, size=size)
        assert {r["row_index"]: r["logit"] for r in scored.collect()} == pytest.approx(logits)
        got = {(r["feature"], r["field"]): r["w"] for r in after.collect()}
        assert set(got) == set(w)
        for k, x in got.items():
            d = grad[k] + 2e-5 * w[k] if k in grad else np.zeros(2)
            assert x == pytest.approx(list(w[k] - 0.05 * d / np.sqrt(1 + d * d)))
