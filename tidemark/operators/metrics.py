"""Evaluation: losses, ranking, calibration, the paired block bootstrap and its gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLIP = 1e-7


def clipped(p: Column, clip: float = CLIP) -> Column:
    return F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))


def loss(y: Column, p: Column) -> Column:
    q = clipped(p)
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def eval_metrics(df: DataFrame, y: str = "click", p: str = "p1") -> DataFrame:
    q = clipped(F.col(p))
    return df.agg(F.count("*").alias("rows"), F.avg(loss(F.col(y), F.col(p))).alias("logloss"), F.avg((q - F.col(y)) ** 2).alias("brier"))


def score_ranges(scores: DataFrame, column: str, ranges: int) -> DataFrame:
    """``r``: which of at most ``ranges`` ranges of about as many rows each a value lies in.

    The edges are quantiles of a mergeable sketch, at most ``ranges`` numbers; equal values share a range.
    """
    from pyspark.ml.feature import Bucketizer

    inner = sorted(set(scores.stat.approxQuantile(column, [i / ranges for i in range(1, ranges)], 0.5 / ranges)))
    splits = [-float("inf"), *inner, float("inf")]
    if len(splits) < 3:
        return scores.withColumn("r", F.lit(0).cast("bigint"))
    return Bucketizer(splits=splits, inputCol=column, outputCol="r").transform(scores).withColumn("r", F.col("r").cast("bigint"))


def roc_auc(df: DataFrame, y: str = "click", p: str = "p1", ranges: int = 1024) -> DataFrame:
    """Ties share their rank; NaN with one class. Only ranges of scores, then scores of a range, are ordered.

    Ranges hold equally many distinct scores, so that crowded scores spread over all tasks too.
    """
    q = clipped(F.col(p))
    scores = df.groupBy(q.alias("s")).agg(F.sum(y).cast("bigint").alias("pos"), F.sum(1 - F.col(y)).cast("bigint").alias("neg"))
    scores = score_ranges(scores, "s", ranges)
    below = scores.groupBy("r").agg(F.sum("neg").alias("n")).select(F.col("r").alias("br"), (F.sum("n").over(Window.orderBy("r")) - F.col("n")).alias("base"))
    inside = F.sum("neg").over(Window.partitionBy("r").orderBy("s")) - F.col("neg")
    ranked = scores.withColumn("inside", inside).join(F.broadcast(below), F.col("r") == F.col("br"))
    wins = F.sum(F.col("pos") * (F.col("base") + F.col("inside") + F.col("neg") / 2))
    total = F.sum("pos").cast("double") * F.sum("neg")
    return ranked.agg(F.when(total > 0, wins / total).otherwise(float("nan")).alias("roc_auc"))


def calibration_error(df: DataFrame, y: str = "click", p: str = "p1", bins: int = 15) -> DataFrame:
    """Weighted gap of mean label and mean score over equal bins."""
    q = clipped(F.col(p))
    at = F.lit(-1)
    for i in range(bins + 1):
        at = at + (q >= F.lit(i / bins)).cast("int")
    by = df.groupBy(F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg(y) - F.avg(q)).alias("gap"))
    return by.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def paired_losses(df: DataFrame, candidate: str, incumbent: str, y: str = "click", row: str = "row_index") -> DataFrame:
    """Both models' losses joined by row; rows that only one has raise the mismatch count elsewhere."""
    a = df.select(row, loss(F.col(y), F.col(candidate)).alias("candidate"))
    b = df.select(row, loss(F.col(y), F.col(incumbent)).alias("incumbent"))
    return a.join(b, row).withColumn("difference", F.col("candidate") - F.col("incumbent"))


def paired_mismatch(candidate: DataFrame, incumbent: DataFrame, row: str = "row_index", label: str = "click") -> DataFrame:
    """How two models' rows fit before their losses are paired: on both sides, on one alone, repeated, with another label."""
    side = lambda df, name: df.groupBy(row).agg(F.count("*").alias(f"n_{name}"), F.min(label).alias(f"least_{name}"), F.max(label).alias(f"most_{name}"))
    both = side(candidate, "a").join(side(incumbent, "b"), row, "full_outer")
    same = (F.col("least_a") == F.col("most_b")) & (F.col("most_a") == F.col("least_b"))
    once = (F.col("n_a") == 1) & (F.col("n_b") == 1)
    return both.agg(
        F.count_if(once & same).alias("matched"),
        F.count_if(F.col("n_b").isNull()).alias("only_candidate"),
        F.count_if(F.col("n_a").isNull()).alias("only_incumbent"),
        F.count_if((F.col("n_a") > 1) | (F.col("n_b") > 1)).alias("repeated"),
        F.count_if(once & ~same).alias("other_label"),
    )


def block_means(losses: DataFrame, rows: int, block_rows: int, index: str = "dense_index") -> DataFrame:
    """Mean difference of each of ceil(rows / block_rows) contiguous, nearly equal blocks."""
    k = max(1, min(rows, -(-rows // block_rows)))
    # the largest i with floor(i * rows / k) <= index
    block = F.floor(((F.col(index) + 1) * k - 1) / rows)
    return losses.groupBy(block.cast("bigint").alias("block")).agg(F.count("*").alias("rows"), F.avg("difference").alias("mean_difference"))


def bootstrap(means: DataFrame, blocks: int, samples: int, confidence: float, seed: int) -> DataFrame:
    """Upper bound of the mean over ``samples`` resamples of the blocks; draws come from MD5."""
    spark = means.sparkSession
    draws = spark.range(samples * blocks).select(F.floor(F.col("id") / blocks).alias("sample"), F.col("id").alias("d"))
    text = F.concat_ws("-", F.lit(str(seed)), F.col("d").cast("string"))
    drawn = draws.withColumn("block", F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(blocks)))
    resampled = drawn.join(means, "block").groupBy("sample").agg(F.avg("mean_difference").alias("m"))
    return resampled.agg(F.count("*").alias("samples"), F.percentile("m", confidence).alias("upper"), F.avg("m").alias("mean"))


def fold_losses(folded: DataFrame, models: dict[str, str], y: str = "click") -> DataFrame:
    return folded.groupBy("window").agg(F.count("*").alias("rows"), *[F.avg(loss(F.col(y), F.col(p))).alias(n) for n, p in models.items()])


def gate(mean: Column, upper: Column, candidate: Column, incumbent: Column, guard: float) -> Column:
    """Why a candidate is or is not selected."""
    return (
        F.when(mean >= 0, "no better on the holdout")
        .when(upper >= 0, "within noise on the holdout")
        .when(candidate > incumbent + guard, "worse over the folds")
        .otherwise("selected")
    )


def residual_correlation(df: DataFrame, predictions: list[str], y: str = "click") -> DataFrame:
    """Correlation of residuals for each pair, and the mean of their squared positive parts."""
    pairs = [(a, b) for i, a in enumerate(predictions) for b in predictions[i + 1 :]]
    sums = df.agg(*[F.corr(F.col(a) - F.col(y), F.col(b) - F.col(y)).alias(f"{a}_{b}") for a, b in pairs])
    penalty = sum((F.greatest(F.col(f"{a}_{b}"), F.lit(0.0)) ** 2 for a, b in pairs), F.lit(0.0)) / max(1, len(pairs))
    return sums.withColumn("penalty", penalty)


def batch_plan(shards: DataFrame, workers: int, batch: int) -> DataFrame:
    """Steps of an epoch: shards strided over workers, rows of a worker joined to batches. ``shard, rows``."""
    per = shards.groupBy(F.pmod("shard", F.lit(workers)).alias("worker")).agg(F.count("*").alias("shards"), F.sum("rows").cast("bigint").alias("rows"))
    return per.withColumn("steps", F.ceil(F.col("rows") / batch))


def mean_logit(df: DataFrame, predictions: list[str], clip: float = CLIP) -> Column:
    logits = [F.log(clipped(F.col(p), clip) / (1 - clipped(F.col(p), clip))) for p in predictions]
    return 1 / (1 + F.exp(-sum(logits[1:], logits[0]) / len(logits)))
