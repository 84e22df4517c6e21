import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import baseline as B
from tidemark.operators import ffm_fit as W
from tidemark.queries import spark as Q

SCHEMA = "source string, row_index long, click int, features array<struct<field:bigint,feature:bigint,value:double>>"


def rows_of(seed=3, n=90):
    g = np.random.default_rng(seed)
    out = []
    for i in range(n):
        fs = [(int(f), int(g.integers(1, 6)) + 10 * int(f), round(float(g.random()), 3)) for f in sorted(g.choice(np.arange(1, 7), int(g.integers(1, 6)), replace=False))]
        fs += [(fs[-1][0], 99, 0.5)] * (i % 4 == 0)  # two features of one field
        label = int((sum(f[1] for f in fs) + int(g.integers(3))) % 2)
        out.append(("s" if i % 3 else "t", i, label, fs))
    return out


def plain_fit(rows, epochs, batch, rate=W.RATE, l2=W.L2):
    """One block: mini-batches in order, pair by pair."""
    w, g, losses = {}, {}, []
    start = lambda f: np.array([((f * 31 + i * 7919) % 1009) / 1009 * (0.5 / W.FACTORS**0.5) for i in range(W.FIELDS * W.FACTORS)]).reshape(W.FIELDS, W.FACTORS)
    for r in rows:
        for _, f, _ in r[3]:
            w.setdefault(f, start(f)), g.setdefault(f, np.ones((W.FIELDS, W.FACTORS)))
    for _ in range(epochs):
        loss = 0.0
        for b in range(0, len(rows), batch):
            grad = {}
            for _, _, click, fs in rows[b : b + batch]:
                y = 2 * click - 1
                pairs = [(p, q) for k, p in enumerate(fs) for q in fs[k + 1 :] if p[0] != q[0]]
                z = sum(w[p[1]][q[0]] @ w[q[1]][p[0]] * p[2] * q[2] for p, q in pairs)
                loss += np.logaddexp(0, -y * z)
                kappa = -y / (1 + np.exp(y * z))
                for p, q in pairs:
                    grad[p[1], q[0]] = grad.get((p[1], q[0]), 0) + kappa * p[2] * q[2] * w[q[1]][p[0]]
                    grad[q[1], p[0]] = grad.get((q[1], p[0]), 0) + kappa * p[2] * q[2] * w[p[1]][q[0]]
            for (f, field), d in grad.items():
                d = d + l2 * w[f][field]
                g[f][field] += d * d
                w[f][field] -= rate * d / np.sqrt(g[f][field])
        losses.append(loss / len(rows))
    return w, losses


def test_one_block_equals_plain_numpy(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    state, losses = W.fit(df, 2, size=1000, batch=8)
    weights = {(r["source"], r["feature"]): np.array(r["w"]).reshape(W.FIELDS, W.FACTORS) for r in state.collect()}
    got = {(r["source"], r["epoch"]): r["logloss"] for r in losses.collect()}
    for source in ("s", "t"):
        own = [r for r in rows if r[0] == source]
        w, want = plain_fit(own, 2, 8)
        assert [got[source, k] for k in (0, 1)] == pytest.approx(want, rel=1e-5)
        for f, x in w.items():
            assert weights[source, f] == pytest.approx(x, abs=1e-5)
    p = {(r["source"], r["row_index"]): r["p"] for r in W.predict(df, state).collect()}
    for source, i, _, fs in rows[:20]:
        z = sum(weights[source, a[1]][b[0]] @ weights[source, b[1]][a[0]] * a[2] * b[2] for k, a in enumerate(fs) for b in fs[k + 1 :] if a[0] != b[0])
        assert p[source, i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_a_wide_row_costs_its_entries_not_its_pairs():
    """600 entries in one of 64 rows: pairs of padded rows took some hundred MB."""
    g = np.random.default_rng(5)
    rows = [("s", i, i % 2, [(f, 10 * f + i % 3, 0.5) for f in range(1, 5)]) for i in range(63)]
    rows.append(("s", 63, 1, sorted([(int(f), 1000 + k, 0.01) for k, f in enumerate(g.integers(1, 5, 596))] + [(f, 10 * f, 0.5) for f in range(1, 5)])))
    names = ("feature", pa.int64(), 1), ("field", pa.int32(), 0), ("value", pa.float32(), 2)
    table = pa.table({"row_index": [r[1] for r in rows], "click": pa.array([r[2] for r in rows], pa.int32()), **{n: pa.array([[f[k] for f in r[3]] for r in rows], pa.list_(t)) for n, t, k in names}})
    seen = sorted({f[1] for r in rows for f in r[3]})
    start = [[((f * 31 + i * 7919) % 1009) / 1009 * (0.5 / W.FACTORS**0.5) for i in range(W.FIELDS * W.FACTORS)] for f in seen]
    model = pa.table({"feature": seen, "w": pa.array(start, pa.list_(pa.float64())), "g": pa.array([[1.0] * len(x) for x in start], pa.list_(pa.float64()))})
    tracemalloc.start()
    block = W.Block(table, model, W.FACTORS)
    loss = block.step(slice(0, 64), W.RATE, W.L2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 << 20
    w, want = plain_fit(rows, 1, 64)
    assert loss / 64 == pytest.approx(want[0], rel=1e-6)
    for k, f in enumerate(seen):
        assert block.w[k] == pytest.approx(w[f], abs=1e-6)


def test_blocks_of_a_source_are_averaged_by_occurrences(spark):
    df = spark.createDataFrame(rows_of(n=60), SCHEMA)
    blocks = W.blocked(df, 10)
    need = W.needs(blocks)
    state, losses = W.epoch(blocks, need, W.start(need), batch=4)
    assert blocks.select("source", "block").distinct().count() > 4
    first = W.start(need)
    sums: dict = {}
    for b in blocks.select("source", "block").distinct().collect():
        own = blocks.filter((F.col("source") == b["source"]) & (F.col("block") == b["block"]))
        one, _ = W.epoch(own, W.needs(own), first, batch=4)
        often = {r["feature"]: r["n"] for r in own.select(F.explode(F.arrays_zip("feature", "value")).alias("x")).filter("x.value <> 0").groupBy("x.feature").agg(F.count("*").alias("n")).collect()}
        for r in one.filter(F.col("source") == b["source"]).collect():
            if r["feature"] in often:
                s = sums.setdefault((r["source"], r["feature"]), [0, 0])
                s[0], s[1] = s[0] + often[r["feature"]] * np.array(r["w"]), s[1] + often[r["feature"]]
    got = {(r["source"], r["feature"]): np.array(r["w"]) for r in state.collect()}
    assert set(sums) == set(got)
    for k, (total, n) in sums.items():
        assert got[k] == pytest.approx(total / n, abs=1e-5)
    assert {r["source"]: r["rows"] for r in losses.collect()} == {"s": 40, "t": 20}


def test_unknown_features_and_empty_rows(spark):
    df = spark.createDataFrame([("s", 1, 1, [(1, 5, 1.0), (2, 6, 1.0)]), ("s", 2, 0, [(1, 5, 1.0), (2, 6, 1.0)])], SCHEMA)
    state, _ = W.fit(df, 1)
    other = spark.createDataFrame([("s", 7, None, [(1, 5, 1.0), (2, 777, 1.0)]), ("s", 8, None, []), ("new", 9, None, [(1, 5, 1.0), (2, 6, 1.0)])], SCHEMA)
    assert {r["row_index"]: r["p"] for r in W.predict(other, state).collect()} == {7: 0.5, 8: 0.5, 9: 0.5}
    assert W.fit(df.limit(0), 2)[0].count() == 0


def test_losses_of_all_four_sources_fall(spark):
    losses = Q.source_fit_losses(spark, "/root/testdata/sf0.01").collect()
    by = {(r["source"], r["epoch"]): r["logloss"] for r in losses}
    assert {s for s, _ in by} == {"app_baseline", "app_special", "site_baseline", "site_special"}
    assert all(by[s, 0] > by[s, 1] > by[s, 2] for s, _ in by)


def test_composition_takes_every_scoring_row_once(spark):
    rows = Q.fitted_predictions(spark, "/root/testdata/sf0.001").collect()
    want = Q.compose_predictions(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r["row_index"], r["id"], r["source"]) for r in rows) == sorted((r["row_index"], r["id"], r["source"]) for r in want)
    assert all(0 < r["p"] < 1 for r in rows) and {round(r["p"], 3) for r in rows} != {round(r["p"], 3) for r in want}


def test_first_bad_row(spark):
    df = spark.createDataFrame([(4, 0.5), (9, None), (7, 1.0), (8, float("nan"))], "row_index long, p double")
    assert df.agg(W.one_value("p")).first()[0] == 7 and df.limit(1).agg(W.one_value("p")).first()[0] is None


def test_fold_models_learn_a_pair(spark):
    g = np.random.default_rng(1)
    rows = []
    for i in range(1200):
        a, b = int(g.integers(2)), int(g.integers(2))
        rows.append((i, i // 10, int((a ^ b) if g.random() < 0.95 else g.integers(2)), [(1, a, 0.5), (2, b, 0.5)]))
    df = spark.createDataFrame(rows, "row_index long, hour_no long, click int, features array<struct<field:bigint,feature:bigint,value:double>>")
    windows = spark.createDataFrame([("f0", 0, 80, 80, 100), ("f1", 0, 100, 100, 120)], "name string, train_start long, train_end long, valid_start long, valid_end long")
    out = B.fold_predictions(df, windows, slots=64, steps=200)
    assert {r["window"]: r["n"] for r in out.groupBy("window").agg(F.count("*").alias("n")).collect()} == {"f0": 200, "f1": 200}
    right = out.filter("(p > 0.5) = (click = 1)").count()
    assert right > 340


def test_fold_models_use_all_cores(spark, monkeypatch):
    """Rows of one file are dealt to all cores before the steps, each of which reads them all."""
    from pyspark.ml.classification import FMClassifier

    parts, fit = [], FMClassifier.fit
    monkeypatch.setattr(FMClassifier, "fit", lambda self, df: (parts.append(df.rdd.getNumPartitions()), fit(self, df))[1])
    df = spark.createDataFrame([(i, i // 10, i % 2, [(1, i % 3, 0.5)]) for i in range(300)], "row_index long, hour_no long, click int, features array<struct<field:bigint,feature:bigint,value:double>>").coalesce(1)
    windows = spark.createDataFrame([("f0", 0, 10, 10, 20), ("f1", 0, 20, 20, 30)], "name string, train_start long, train_end long, valid_start long, valid_end long")
    assert B.fold_predictions(df, windows, slots=16, steps=2).count() == 200
    assert len(parts) == 2 and min(parts) >= spark.sparkContext.defaultParallelism


def test_fold_models_are_sparks_but_read_rows_packed(spark, monkeypatch):
    """Each fold's predictions are those of FMClassifier on its training rows, to which no rows are given any more."""
    from pyspark.ml.classification import FMClassifier
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    g = np.random.default_rng(6)
    draw = lambda: [(int(f), int(g.integers(10 ** int(g.integers(1, 7)))), round(float(g.random()), 5)) for f in g.integers(1, 20, int(g.integers(0, 9)))]
    rows = [(i, i // 10, int(g.integers(2)), draw()) for i in range(500)]
    df = spark.createDataFrame(rows, "row_index long, hour_no long, click int, features array<struct<field:bigint,feature:bigint,value:double>>").coalesce(1)
    windows = [("f0", 0, 30, 30, 40), ("f1", 5, 40, 40, 50)]
    name = lambda x: F.concat_ws(":", x["field"].cast("string"), x["feature"].cast("string"))
    words = df.withColumn("words", F.flatten(F.transform("features", lambda x: F.array_repeat(name(x), F.greatest(F.lit(1), F.round(x["value"] * B.UNITS).cast("int"))))))
    vectors = Normalizer(inputCol="counts", outputCol="vector").transform(HashingTF(numFeatures=64, inputCol="words", outputCol="counts").transform(words)).withColumn("label", F.col("click").cast("double")).cache()
    want = {}
    for w, a, b, c, d in windows:
        own = FMClassifier(featuresCol="vector", labelCol="label", factorSize=4, maxIter=4, stepSize=0.1, initStd=0.01, regParam=0.001, seed=7).fit(vectors.filter(f"hour_no >= {a} AND hour_no < {b}"))
        for r in own.transform(vectors.filter(f"hour_no >= {c} AND hour_no < {d}")).select("row_index", vector_to_array("probability")[1].alias("p")).collect():
            want[w, r["row_index"]] = r["p"]
    given, fit = [], FMClassifier.fit
    monkeypatch.setattr(FMClassifier, "fit", lambda self, df: (given.append(df.count()), fit(self, df))[1])
    table = spark.createDataFrame(windows, "name string, train_start long, train_end long, valid_start long, valid_end long")
    got = {(r["window"], r["row_index"]): r["p"] for r in B.fold_predictions(df, table, slots=64, steps=4).collect()}
    assert len(want) == 200 and got == pytest.approx(want, abs=1e-9)
    assert max(given) <= 1
    assert B.packed(df).count() >= spark.sparkContext.defaultParallelism  # rows of one file are dealt to all cores


def test_slots_are_those_of_hashing_tf(spark):
    from pyspark.ml.feature import HashingTF

    tf = HashingTF(numFeatures=B.SLOTS, inputCol="w", outputCol="v")
    for w in ["1:2", "15:926508", "", "a", "ab", "abc", "abcd", "17:1", "19:-7"]:
        assert B.slot_of(w.encode(), B.SLOTS) == tf.indexOf(w)


def test_blocks_are_one_row_and_bundles_change_no_result(spark, monkeypatch):
    """A block is packed once for all epochs, and blocks of a bundle share their model rows on the way."""
    df, got = spark.createDataFrame(rows_of(n=240), SCHEMA), []
    for most in (1, 8):
        monkeypatch.setattr(W, "BUNDLE", most)
        blocks = W.blocked(df, 4)
        need = W.needs(blocks)
        state, losses = W.epoch(blocks, need, W.start(need), batch=2)
        assert blocks.count() == blocks.select("source", "block").distinct().count() > 32
        got.append((need.count(), {(r["source"], r["feature"]): r["w"] + r["g"] for r in state.collect()}, {r["source"]: (r["rows"], r["logloss"]) for r in losses.collect()}))
    assert got[1][0] < got[0][0] and set(got[0][1]) == set(got[1][1])
    assert all(got[1][1][k] == pytest.approx(x, abs=1e-6) for k, x in got[0][1].items())
    assert all(got[1][2][k] == pytest.approx(x) for k, x in got[0][2].items())


def test_sums_of_entries_are_the_same_dense_or_not():
    g = np.random.default_rng(2)
    of, at, value = np.repeat(np.arange(6), 3), g.integers(0, 9, 18), g.random(18)
    out = []
    for dense in (True, False):
        s = W._Sums(of, at, value, 6, 9)
        assert s.dense
        s.dense = dense
        table, d, met = (np.random.default_rng(k).random((16, 8)) for k in (1, 2, 3))
        s.to_entries(d, met)
        out.append((s.of_entries(table), d, met > 1.5))
    assert all(a == pytest.approx(b) for a, b in zip(*out, strict=True))


def test_fitted_predictions_write_the_resolved_log_once(spark, monkeypatch):
    made, users = [], Q.users
    monkeypatch.setattr(Q, "users", lambda *a: (made.append(a), users(*a))[1])
    assert Q.fitted_predictions(spark, "/root/testdata/sf0.001").count() > 0 and len(made) == 1
