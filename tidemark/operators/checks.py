"""Data-quality checks. Each returns rows that say what was found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def label_check(df: DataFrame, label: str = "click") -> DataFrame:
    return df.agg(
        F.min(label).cast("bigint").alias("least"), F.max(label).cast("bigint").alias("most"), F.count_if(F.col(label).isNull()).alias("nulls"), F.count_if(~F.col(label).isin(0, 1)).alias("others")
    ).withColumn("binary", (F.col("nulls") == 0) & (F.col("others") == 0))


def hour_order_check(df: DataFrame, hour: str = "hour", order: str = "row_index", width: int = 65536) -> DataFrame:
    """Malformed hours, and rows whose hour is below the previous row's.

    Rows are compared inside ranges of ``width`` rows, ends of ranges inside ranges of ranges, and so
    on: no task has more than ``width`` rows to put in order, until as many are left in all.
    """
    part = lambda c: F.floor(F.col(c) / width)
    rows = df.select(part(order).alias("part"), F.col(order).alias("o"), F.col(hour).alias("first"), F.col(hour).alias("last"), (~F.col(hour).rlike("^[0-9]{8}$")).cast("bigint").alias("malformed"), F.lit(0).cast("bigint").alias("backward"))

    def ends(rows: DataFrame) -> DataFrame:
        before = F.lag("last").over(Window.partitionBy("part").orderBy("o"))
        found = rows.withColumn("backward", F.col("backward") + F.coalesce(F.col("first") < before, F.lit(False)).cast("bigint"))
        sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("malformed", "backward")]
        return found.groupBy("part").agg(F.min_by("first", "o").alias("first"), F.max_by("last", "o").alias("last"), *sums)

    least, most = df.agg(F.min(order), F.max(order)).first()
    span = max(1, (most or 0) // width - (least or 0) // width + 1)
    rows = ends(rows)
    while span > 1:
        span = -(-span // width)
        rows = ends(rows.withColumn("o", F.col("part")).withColumn("part", part("o") if span > 1 else F.lit(0).cast("bigint")))
    return rows.agg(F.coalesce(F.sum("malformed"), F.lit(0)).alias("malformed"), F.coalesce(F.sum("backward"), F.lit(0)).alias("backward"))


def missing_hours(df: DataFrame, hour: str = "hour_no", most: int = 10) -> DataFrame:
    """The first ``most`` hours that the log's range lacks."""
    have = df.select(F.col(hour).alias("h")).distinct()
    span = have.agg(F.min("h").alias("a"), F.max("h").alias("b"))
    every = span.select(F.explode(F.sequence("a", "b")).alias("h"))
    return every.join(have, "h", "left_anti").orderBy("h").limit(most).select(F.col("h").alias("missing_hour"))


def hour_coverage(df: DataFrame, hour: str = "hour_no") -> DataFrame:
    """First and last hour of all rows, the hours that have rows and those that lack them, and the first of these."""
    have = df.select(F.col(hour).alias("h")).distinct()
    span = have.agg(F.min("h").alias("first_hour"), F.max("h").alias("last_hour"), F.count("h").alias("hours"))
    gaps = missing_hours(df, hour).agg(F.sort_array(F.collect_list("missing_hour")).alias("first_missing"))
    return span.withColumn("missing", F.col("last_hour") - F.col("first_hour") + 1 - F.col("hours")).crossJoin(gaps)


def population_checks(counts: DataFrame) -> DataFrame:
    """Rules over one row of counts: parts add up, and no part exceeds its whole."""
    rules = {
        "training_adds_up": F.col("training_app") + F.col("training_site") == F.col("training"),
        "scoring_adds_up": F.col("scoring_app") + F.col("scoring_site") == F.col("scoring"),
        "proxy_in_app": F.col("scoring_proxy") <= F.col("scoring_app"),
        "history_in_proxy": F.col("scoring_history") <= F.col("scoring_proxy"),
        "cold_in_site": F.col("scoring_cold") <= F.col("scoring_site"),
    }
    return counts.select(*[r.alias(n) for n, r in rules.items()])


def lookup_contract(spark: SparkSession, declared: dict, fitted: dict) -> DataFrame:
    """Every lookup with its rows, the keys that more than one row has, and its faults (null: none).

    declared: name -> (keys, outputs, uses_labels, sources); fitted: name -> (table, uses_labels,
    sources). Keys are counted over each whole table.
    """
    parts = []
    for name in sorted({*declared, *fitted}):
        if name not in fitted:
            parts.append(spark.range(1).select(F.lit(name).alias("lookup"), F.lit(0).cast("bigint").alias("rows"), F.lit(0).cast("bigint").alias("repeated_keys"), F.lit("missing").alias("fault")))
            continue
        table, labels, sources = fitted[name]
        keys, outputs, wants_labels, wants_sources = declared.get(name, ((), (), labels, sources))
        columns, faults = table.columns, []
        if name not in declared:
            faults.append("not declared")
        else:
            faults += ["other key"] * (not set(keys) <= set(columns)) + ["other outputs"] * (sorted(set(columns) - set(keys)) != sorted(outputs))
        faults += ["columns clash"] * (len(set(columns)) < len(columns)) + ["other provenance"] * (labels != wants_labels) + ["other sources"] * (sources != wants_sources)
        each = table.toDF(*[f"c{i}" for i in range(len(columns))])  # names that cannot clash
        by = [f"c{columns.index(k)}" for k in keys if k in columns]
        counts = each.groupBy(*by).agg(F.count("*").alias("n")) if by else each.agg(F.count("*").alias("n"))
        sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.col("n") > 1).alias("repeated_keys") if by else F.lit(0).cast("bigint").alias("repeated_keys"))
        found = F.concat_ws(", ", *[F.lit(x) for x in faults], F.when(F.col("repeated_keys") > 0, "repeated keys"))
        parts.append(sums.select(F.lit(name).alias("lookup"), "rows", "repeated_keys", F.nullif(found, F.lit("")).alias("fault")))
    return reduce(DataFrame.unionByName, parts)


def time_range(df: DataFrame, start: int, end: int, time: str = "hour_no") -> DataFrame:
    """Half-open: start <= time < end."""
    if end <= start:
        raise ValueError("an hour range ends after its start")
    return df.filter((F.col(time) >= start) & (F.col(time) < end))
