"""Fitted lookups and their application."""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rowlocal import logit
from tidemark.plans.recipe import Recipe, Target

#: Rows of a lookup under which it is broadcast whatever the statistics say.
BROADCAST_ROWS = 100_000


def vocabulary(train: DataFrame, column: str, minimum: int, most: int) -> DataFrame:
    """``column, <column>__id``: values with enough rows, numbered from 1 in sorted order.

    Numbering sorts one row for each value, ``most`` at the utmost; more is an error.
    """
    kept = train.groupBy(column).count().filter(F.col("count") >= minimum).select(column)
    found = kept.count()
    if found > most:
        raise ValueError(f"{column} has {found} values; the limit is {most}")
    return kept.select(column, F.row_number().over(Window.orderBy(F.col(column).asc_nulls_first())).cast("bigint").alias(f"{column}__id"))


def encode(df: DataFrame, vocabularies: dict[str, DataFrame]) -> DataFrame:
    """Ids in place of values; unknown, rare and null values are 0."""
    for c, v in vocabularies.items():
        df = df.join(v, c, "left").withColumn(c, F.coalesce(f"{c}__id", F.lit(0).cast("bigint"))).drop(f"{c}__id")
    return df


def distinct_with_null(column: str):
    """Distinct values, null being one."""
    return F.countDistinct(column) + F.coalesce(F.max(F.col(column).isNull().cast("bigint")), F.lit(0))


def covariate_lookup(population: DataFrame, key: str, frequency: bool, distinct: dict[str, str]) -> DataFrame:
    """One wide table for a key: rows, and distinct values for each name -> column."""
    outputs = [F.count("*").alias(f"{key}__frequency")] if frequency else []
    outputs += [distinct_with_null(v).alias(f"{n}__raw") for n, v in distinct.items()]
    return population.groupBy(key).agg(*outputs)


def distinct_sketches(df: DataFrame, key: str, columns: dict[str, str], time: str = "hour_no", precision: int = 12) -> DataFrame:
    """``key, <time>, <name>__sketch``: a HyperLogLog of each key, hour and column, for ``estimated``.

    Sketches of hours add up to those of any window and population, where exact counts cannot. The
    standard error is about 1.04 / sqrt(2 ** precision): 1.6 % at 12, 0.8 % at 14.
    """
    text = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n"))  # noqa: E731  null is a value
    return df.groupBy(key, time).agg(*[F.hll_sketch_agg(text(c), precision).alias(f"{n}__sketch") for n, c in columns.items()])


def estimated(sketches: DataFrame, key: str, start: int | None = None, end: int | None = None, time: str = "hour_no") -> DataFrame:
    """``key, <name>__raw``: about how many distinct values the hours ``start`` to before ``end`` have."""
    if start is not None:
        sketches = sketches.filter(F.col(time) >= start)
    if end is not None:
        sketches = sketches.filter(F.col(time) < end)
    names = [c.removesuffix("__sketch") for c in sketches.columns if c.endswith("__sketch")]
    return sketches.groupBy(key).agg(*[F.hll_sketch_estimate(F.hll_union_agg(f"{n}__sketch")).alias(f"{n}__raw") for n in names])


def covariate_features(df: DataFrame, lookups: dict[str, DataFrame]) -> DataFrame:
    """log1p of every lookup output; 0 where the key is unknown."""
    for key, lookup in lookups.items():
        names = [c for c in lookup.columns if c != key]
        df = df.join(lookup, key, "left")
        for n in names:
            name = n.removesuffix("__raw") if n.endswith("__raw") else f"{key}_frequency_log1p"
            df = df.withColumn(name, F.log1p(F.coalesce(n, F.lit(0)).cast("double"))).drop(n)
    return df


def target_stats(train: DataFrame, column: str, label: str = "click") -> DataFrame:
    return train.groupBy(column).agg(F.sum(label).cast("bigint").alias("positive"), F.count("*").alias("n"))


def global_prior(train: DataFrame, label: str = "click") -> DataFrame:
    return train.agg(F.avg(label).alias("prior"), F.count("*").alias("n"))


def block_of(time: str, start: int, end: int, blocks: int):
    width = max(1, math.ceil((end - start) / blocks))
    return F.least(F.greatest(F.floor((F.col(time) - start) / width), F.lit(0)), F.lit(blocks - 1)).cast("bigint")


def temporal_target_stats(train: DataFrame, column: str, start: int, end: int, blocks: int, time: str = "hour_no", label: str = "click") -> DataFrame:
    """Per value and block, what earlier blocks say; ``blocks`` global rows are joined in."""
    blocked = train.withColumn("block", block_of(time, start, end, blocks))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = blocked.groupBy("block").agg(F.sum(label).cast("bigint").alias("bp"), F.count("*").alias("bn"))
    w = Window.orderBy("block")
    total = total.select("block", before("bp", w).alias("gp"), before("bn", w).alias("prior_count"))
    total = total.select("block", "prior_count", F.when(F.col("prior_count") > 0, F.col("gp") / F.col("prior_count")).alias("block_prior"))
    own = blocked.groupBy(column, "block").agg(F.sum(label).cast("bigint").alias("p"), F.count("*").alias("n"))
    w = Window.partitionBy(column).orderBy("block")
    own = own.select(column, "block", before("p", w).alias("previous_positive"), before("n", w).alias("previous_count"))
    return own.join(F.broadcast(total), "block", "left").select(column, "block", "previous_positive", "previous_count", "prior_count", "block_prior")


def target_features_train(df: DataFrame, stats: DataFrame, column: str, start: int, end: int, target: Target, time: str = "hour_no") -> DataFrame:
    """Lift over the block's prior and evidence, from earlier blocks only."""
    rows = df.withColumn("block", block_of(time, start, end, target.blocks)).join(stats, [column, "block"], "left")
    n, prior = F.coalesce("previous_count", F.lit(0)), F.coalesce("block_prior", F.lit(0.5))
    posterior = (F.coalesce("previous_positive", F.lit(0)) + target.smoothing * prior) / (n + target.smoothing)
    lift = F.when(F.col("prior_count") > 0, logit(posterior, target.clip) - logit(prior, target.clip)).otherwise(0.0)
    out = rows.withColumns({f"{column}_target_logit_lift": lift, f"{column}_target_evidence_log1p": F.log1p(n.cast("double"))})
    return out.drop("block", "previous_positive", "previous_count", "prior_count", "block_prior")


def target_features_score(df: DataFrame, stats: DataFrame, column: str, prior: float, target: Target) -> DataFrame:
    """Lift over the global prior and evidence, from all training rows."""
    rows = df.join(stats, column, "left")
    n = F.coalesce("n", F.lit(0))
    posterior = (F.coalesce("positive", F.lit(0)) + target.smoothing * prior) / (n + target.smoothing)
    bounded = min(max(prior, target.clip), 1 - target.clip)
    lift = logit(posterior, target.clip) - math.log(bounded / (1 - bounded))
    return rows.withColumns({f"{column}_target_logit_lift": lift, f"{column}_target_evidence_log1p": F.log1p(n.cast("double"))}).drop("positive", "n")


def fits(recipe: Recipe, start: int, end: int) -> dict:
    """Name -> function that fits the lookup of that name on a population, for all of the recipe."""
    target = recipe.target
    names = [*recipe.raw, *recipe.context, *(n for n, _ in recipe.crosses)]
    out = {f"vocabulary {c}": lambda df, c=c: vocabulary(df, c, recipe.minimum_count, recipe.maximum_vocabulary) for c in names}
    for k in {*recipe.frequency, *(k for _, k, _ in recipe.distinct)}:
        out[f"covariate {k}"] = lambda df, k=k: covariate_lookup(df, k, k in recipe.frequency, {n: v for n, key, v in recipe.distinct if key == k})
    for c in target.columns:
        out[f"target {c}"] = lambda df, c=c: target_stats(df, c)
        out[f"temporal target {c}"] = lambda df, c=c: temporal_target_stats(df, c, start, end, target.blocks)
    return out


def reads(fit, population: DataFrame, column: str) -> bool:
    """Whether a fit reads the column: without it, the fit cannot be resolved."""
    try:
        fit(population.limit(0).drop(column)).schema  # noqa: B018
    except AnalysisException as e:
        if "UNRESOLVED_COLUMN" in str(e):
            return True
        raise
    return False


def oov_rates(encoded: DataFrame, columns: list[str], split: str = "split") -> DataFrame:
    """Per split and column: rows, unknown rows, rate."""
    sums = encoded.groupBy(split).agg(F.count("*").alias("rows"), *[F.sum((F.col(c) == 0).cast("bigint")).alias(c) for c in columns])
    long = sums.unpivot([split, "rows"], columns, "feature", "unknown")
    return long.withColumn("rate", F.col("unknown") / F.col("rows"))
