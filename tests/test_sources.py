import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import lookups as L
from tidemark.operators import metrics as E
from tidemark.sources import impressions as S


def test_parts_are_committed_with_bounds_and_checksums(spark, tmp_path):
    path = f"file://{tmp_path}/parts"
    df = spark.range(1000).select((999 - F.col("id")).alias("place"), (F.col("id") * 3).alias("v")).repartition(7)
    manifest = S.write_parts(df, path, "place", 64).orderBy("part").collect()
    assert [r["file"] for r in manifest] == [f"part-{i:05d}.parquet" for i in range(16)]
    assert [(r["rows"], r["first_row"], r["last_row"]) for r in manifest] == [(min(64, 1000 - 64 * i), 64 * i, min(999, 64 * i + 63)) for i in range(16)]
    for r in manifest:
        data = (tmp_path / "parts" / r["file"]).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (r["bytes"], r["sha256"])
        one = [x["place"] for x in spark.read.parquet(f"{path}/{r['file']}").collect()]
        assert one == list(range(r["first_row"], r["last_row"] + 1))
    assert {p.name for p in (tmp_path / "parts").iterdir() if not p.name.startswith(".")} == {"_SUCCESS", "_manifest", *(r["file"] for r in manifest)}
    back = S.read_parts(spark, path)
    assert back.count() == 1000 and set(back.columns) == {"place", "v"}
    with pytest.raises(FileExistsError):
        S.write_parts(df, path, "place", 64)
    (tmp_path / "parts" / ".part-00003.parquet.crc").unlink()
    (tmp_path / "parts" / "part-00003.parquet").write_bytes((tmp_path / "parts" / "part-00004.parquet").read_bytes())
    with pytest.raises(ValueError, match="part-00003"):
        S.read_parts(spark, path)


def test_parts_refuse_no_rows_and_wrong_numbers(spark, tmp_path):
    for name, df in (("none", spark.range(0)), ("gap", spark.range(10).filter("id <> 4")), ("twice", spark.range(10).withColumn("id", F.when(F.col("id") == 4, 5).otherwise(F.col("id")))), ("late", spark.range(3, 9))):
        with pytest.raises(ValueError):
            S.write_parts(df, f"file://{tmp_path}/{name}", "id", 4)
        assert not [p for p in tmp_path.glob(f"{name}/*") if not p.name.startswith(".")]
        with pytest.raises(ValueError, match="not finished"):
            S.read_parts(spark, f"file://{tmp_path}/{name}")


def test_a_half_written_copy_is_written_anew(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.range(3).write.parquet(f"{folder}/x")
    (tmp_path / "x" / "_SUCCESS").unlink()
    assert S.canonical(spark.range(99), folder, "x").count() == 99
    assert S.canonical(spark.range(5), folder, "x").count() == 99


def test_source_order_of_many_files_and_splits(spark, tmp_path):
    want = []
    for k, n in enumerate((700, 0, 1, 900, 400)):
        lines = [f"{k}-{i},{i}" for i in range(n)]
        want += [x.split(",")[0] for x in lines]
        text = "\n".join(["name,v", *lines]) + "\n"
        if k % 2:
            (tmp_path / f"{k}.csv.gz").write_bytes(gzip.compress(text.encode()))
        else:
            (tmp_path / f"{k}.csv").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1500)  # several splits a file
    try:
        df = S.source_order(spark.read.schema("name string, v int").option("header", True).csv(str(tmp_path)))
        assert df.columns == ["name", "v", "source_index"]
        rows = df.orderBy("source_index").collect()
        assert spark.read.csv(str(tmp_path)).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["name"] for r in rows] == want and [r["source_index"] for r in rows] == list(range(len(want)))
    parts = S.write_parts(df, f"file://{tmp_path}/parts", "source_index", 500)
    assert [r["rows"] for r in parts.orderBy("part").collect()] == [500, 500, 500, 500, 1]


def test_source_order_sends_splits_and_not_rows(spark, tmp_path):
    spark.range(3000).selectExpr("concat('name-', id) AS name").repartition(3).write.csv(str(tmp_path / "in"))
    df = S.source_order(spark.read.schema("name string").csv(str(tmp_path / "in")))
    assert df.count() == 3000
    joined = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in x and "__split" in x]
    assert joined and all("BuildRight" in x for x in joined)


def identity(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i long, v string").repartition(3)
    return S.ordered_identity(df, "i", ["v"]).first()


def test_identity_sees_order_and_repeats(spark):
    values = [f"row {i % 50}" for i in range(300)]
    got = identity(spark, values)
    hashes = [int(hashlib.md5(f"v{v}".encode()).hexdigest()[:15], 16) for v in values]
    assert tuple(got) == (300, sum(h * pow(S.BASE, i, S.PRIME) for i, h in enumerate(hashes)) % S.PRIME)
    swapped = [*values[:7], values[8], values[7], *values[9:]]
    twice = [*values[:7], values[6], values[6], *values[9:]]
    assert len({got["identity"], *(identity(spark, v)["identity"] for v in (swapped, twice, values[:-1], [*values, values[0]]))}) == 5
    far = spark.createDataFrame([(10**12 + 5, "x")], "i long, v string")
    h = int(hashlib.md5(b"vx").hexdigest()[:15], 16)
    assert S.ordered_identity(far, "i", ["v"]).first()["identity"] == h * pow(S.BASE, 10**12 + 5, S.PRIME) % S.PRIME
    assert tuple(S.ordered_identity(far.limit(0), "i", ["v"]).first()) == (0, 0)


def test_sketches_of_hours_add_up(spark):
    rows = spark.range(60000).select((F.col("id") % 3).alias("k"), (F.col("id") % 24).alias("hour_no"), (F.col("id") % 20000).alias("v"), F.lit(None).cast("string").alias("none"))
    sketches = L.distinct_sketches(rows, "k", {"vs": "v", "nones": "none"}, precision=14)
    assert sketches.count() == 24
    exact = {r["k"]: r["n"] for r in rows.filter("hour_no < 12").groupBy("k").agg(F.countDistinct("v").alias("n")).collect()}
    for r in L.estimated(sketches, "k", end=12).collect():
        assert r["vs__raw"] == pytest.approx(exact[r["k"]], rel=0.03) and r["nones__raw"] == 1


def test_auc_ranges_are_of_equal_depth_for_crowded_scores(spark):
    g = np.random.default_rng(5)
    p, y = 0.5 + g.random(4000) / 1000, g.integers(0, 2, 4000)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p, strict=True)], "click int, p1 double")
    sizes = [r["count"] for r in E.score_ranges(df, "p1", 64).groupBy("r").count().collect()]
    assert len(sizes) > 50 and max(sizes) < 4 * 4000 / 64
    order = np.argsort(p)
    ranks = np.empty(4000)
    ranks[order] = np.arange(1, 4001)
    want = (ranks[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert E.roc_auc(df).first()[0] == pytest.approx(want)


def test_mismatch_of_paired_rows(spark):
    a = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (5, 1), (5, 1)], "row_index long, click int")
    b = spark.createDataFrame([(1, 0), (2, 0), (4, 0), (5, 1)], "row_index long, click int")
    assert E.paired_mismatch(a, b).first().asDict() == {"matched": 1, "only_candidate": 1, "only_incumbent": 1, "repeated": 1, "other_label": 1}


def test_column_report_of_ties_and_nulls(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("a", "x"), ("b", None)], "c string, d string")
    assert {tuple(r) for r in S.column_report(df, ["c", "d"]).collect()} == {("c", 2, 0, "a", 2), ("d", 2, 3, None, 3)}
