"""Causal history. Labels count once their hour is complete.

Impression counters number rows inside segments of a key and add the sums of earlier segments.
Click counters work on hourly sums, which are far fewer than rows, and are joined back by key and
hour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rowlocal import logit


#: Orders of a key's rows in one hour that are numbered together.
SLICE = 1 << 20


def impression_history(rows: DataFrame, key: str, time: str = "hour_no", order: str = "row_index", width: int = SLICE, hourly: DataFrame | None = None) -> DataFrame:
    """Earlier rows of the key, hours since the last of them, earlier rows in the hour; scoring rows come last.

    ``hourly``: further columns by key and time. They are joined to the segments, which are narrow, and
    reach the rows with their segment's sums, so that rows are not shuffled once more for them.

    A segmented scan: rows are numbered inside segments (key, hour, scoring, ``width`` orders) only,
    and a segment starts at the prefix sums of its key's earlier segments. So a key with most of
    the log is as many tasks as it has segments. Rows with equal keys, nulls included, belong together.
    """
    names = [key, time, "scoring", "__slice"]
    cut = rows.withColumn("__slice", F.floor(F.col(order) / width)).withColumn("__segment", F.struct(*names))
    totals = cut.groupBy("__segment").agg(F.count("*").alias("__n")).select("__segment", "__n", *[F.col(f"__segment.{c}").alias(c) for c in names])
    by_key = Window.partitionBy(key).orderBy(time, "scoring", "__slice")
    by_hour = Window.partitionBy(key, time).orderBy("scoring", "__slice")
    starts = totals.select(
        "__segment",
        *([] if hourly is None else [F.col(key).alias("__key"), F.col(time).alias("__time")]),
        (F.sum("__n").over(by_key) - F.col("__n")).alias("__before"),
        (F.sum("__n").over(by_hour) - F.col("__n")).alias("__inside"),
        # the hour of the last row outside this hour
        F.max(time).over(Window.partitionBy(key).orderBy(time).rangeBetween(Window.unboundedPreceding, -1)).alias("__last"),
    )
    more = [] if hourly is None else [c for c in hourly.columns if c not in (key, time)]
    if hourly is not None:
        own = hourly.select(F.col(key).alias("__key"), F.col(time).alias("__time"), *more)
        starts = starts.join(own, ["__key", "__time"], "left").drop("__key", "__time")
    place = F.row_number().over(Window.partitionBy("__segment").orderBy(order)) - 1
    numbered = cut.withColumn("__place", place).join(starts, "__segment")
    first = F.col("__inside") + F.col("__place") == 0
    return numbered.select(
        *rows.columns,
        (F.col("__before") + F.col("__place")).cast("bigint").alias("prior_impressions"),
        F.when(first, F.coalesce(F.col(time) - F.col("__last"), F.lit(0))).otherwise(0).cast("bigint").alias("hours_since_previous"),
        (F.col("__inside") + F.col("__place")).cast("bigint").alias("prior_in_hour"),
        *more,
    )


def click_hours(rows: DataFrame, key: str, bits: int = 4, time: str = "hour_no", label: str = "click") -> DataFrame:
    """Per key and hour that has rows: the labelled past before that hour, and as ``after`` the past with it."""
    known = ~F.col("scoring")
    hourly = rows.groupBy(key, time).agg(F.count_if(known).alias("n"), F.coalesce(F.sum(F.when(known, F.col(label))), F.lit(0)).cast("bigint").alias("pos"))
    w = Window.partitionBy(key).orderBy(time)
    past, here = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    first = F.min(F.when(F.col("n") > 0, F.col(time))).over(here)
    pattern = F.lit(0).cast("bigint")
    for d in range(bits):
        hit = F.max((F.col("pos") > 0).cast("bigint")).over(w.rangeBetween(-d, -d))
        pattern = pattern + F.coalesce(hit, F.lit(0)) * (1 << d)
    code = F.least(F.col(time) - first + 1, F.lit(bits)) * (1 << bits) + pattern
    hourly = hourly.withColumns({"cum": F.sum("n").over(here), "code": F.when(F.col("n") > 0, code)})
    clicked = F.col("pos") > 0

    def state(frame) -> dict[str, Column]:
        n, pos = (F.coalesce(F.sum(c).over(frame), F.lit(0)) for c in ("n", "pos"))
        return {
            "prior_labelled": n,
            "prior_clicks": pos,
            "prior_nonclicks": n - pos,
            "last_click": F.max(F.when(clicked, F.col(time))).over(frame),
            "impressions_since_click": n - F.coalesce(F.max(F.when(clicked, F.col("cum"))).over(frame), F.lit(0)),
            "click_pattern": F.coalesce(F.last("code", ignorenulls=True).over(frame), F.lit(0)),
        }

    return hourly.select(key, time, *[c.alias(n) for n, c in state(past).items()], F.struct(*[c.alias(n) for n, c in state(here).items()]).alias("after"))


def click_state(rows: DataFrame, key: str, bits: int = 4, time: str = "hour_no", label: str = "click") -> DataFrame:
    """Per key and hour that has rows: the labelled past before that hour."""
    since = F.coalesce(F.col(time) - F.col("last_click"), F.lit(0)).alias("hours_since_click")
    return click_hours(rows, key, bits, time, label).select(key, time, "prior_labelled", "prior_clicks", "prior_nonclicks", since, "impressions_since_click", "click_pattern")


def click_history(rows: DataFrame, key: str, bits: int = 4, time: str = "hour_no") -> DataFrame:
    """The rows with the state of the last completed hour before each."""
    return rows.join(click_state(rows, key, bits, time), [key, time], "left")


def ctr_lift(prior: float, smoothing: float, clip: float) -> Column:
    """Smoothed log-odds of the past over the prior's; 0 without a past."""
    posterior = (F.col("prior_clicks") + smoothing * prior) / (F.col("prior_labelled") + smoothing)
    return F.when(F.col("prior_labelled") > 0, logit(posterior, clip) - logit(F.lit(prior), clip)).otherwise(0.0)


def history_strings(rows: DataFrame, key: str, events: int = 4, time: str = "hour_no", order: str = "row_index", label: str = "click") -> DataFrame:
    """Per key and hour that has rows: the last ``events`` labels of earlier hours, in order.

    Of each hour only its last ``events`` labels are kept, and of the past as many hours.
    """
    known = rows.filter("NOT scoring").select(key, time, F.col(label).cast("string").alias("l"), order)
    late = known.withColumn("r", F.row_number().over(Window.partitionBy(key, time).orderBy(F.desc(order)))).filter(F.col("r") <= events)
    hourly = late.groupBy(key, time).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "l"))), lambda x: x["l"]), "").alias("labels"))
    # hours with labels are numbered; an hour's past ends at the number of those before it
    w = Window.partitionBy(key).orderBy(time)
    filled = hourly.withColumn("rank", F.row_number().over(w))
    near = [F.lag("labels", d).over(w) for d in range(events - 1, 0, -1)]
    filled = filled.withColumn("upto", F.right(F.concat_ws("", *near, "labels"), F.lit(events)))
    grid = rows.select(key, time).distinct().join(filled.select(key, time, "upto"), [key, time], "left")
    past = F.last("upto", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return grid.select(key, time, F.coalesce(past, F.lit("")).alias("history"))


def windows(df: DataFrame, holdout: int, folds: int, fold_hours: int, minimum_train: int, time: str = "hour_no") -> DataFrame:
    """Walk-forward windows and the final holdout, from the log's first and last hour."""
    span = df.agg(F.min(time).alias("a"), F.max(time).alias("b"), F.countDistinct(time).alias("n"))
    final = F.col("b") - holdout + 1
    fold = F.explode(F.sequence(F.lit(0), F.lit(folds))).alias("fold")
    rows = span.select("a", "b", "n", final.alias("f"), fold)
    start = F.when(F.col("fold") == folds, F.col("f")).otherwise(F.col("f") - (folds - F.col("fold")) * fold_hours)
    end = F.when(F.col("fold") == folds, F.col("b") + 1).otherwise(start + fold_hours)
    gaps = F.raise_error(F.lit("the log has missing hours"))
    short = F.raise_error(F.lit("not enough history for the folds"))
    first = F.when(F.col("n") != F.col("b") - F.col("a") + 1, gaps.cast("bigint")).when((F.col("fold") == 0) & (start - F.col("a") < minimum_train), short.cast("bigint")).otherwise(F.col("a"))
    name = F.when(F.col("fold") == folds, "final_holdout").otherwise(F.concat(F.lit("walk_forward_"), F.col("fold")))
    return rows.select(name.alias("name"), first.alias("train_start"), start.alias("train_end"), start.alias("valid_start"), end.alias("valid_end"), (F.col("fold") == folds).alias("final_holdout"))


def assign_windows(df: DataFrame, table: DataFrame, time: str = "hour_no") -> DataFrame:
    """A row for each window that a row trains or validates (``table`` has one row per fold)."""
    t = F.col(time)
    inside = (t >= F.col("train_start")) & (t < F.col("valid_end"))
    both = df.join(F.broadcast(table), inside)
    role = F.when(t < F.col("train_end"), "train").when(t >= F.col("valid_start"), "validation")
    return both.select(*df.columns, F.col("name").alias("window"), role.alias("role")).filter("role IS NOT NULL")
