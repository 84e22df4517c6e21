"""Model-ready datasets of a recipe, for all windows at once.

Every lookup of every window is a read of the same cumulative table: rows and clicks are summed once
for each column, value and span between two cuts; what a window may know of a value is the sum of the
spans before one of its cuts (a block's start, or the end of its training rows). A value's row holds
these sums as arrays over the cuts, so that rows meet each lookup once, not once for each window, and
a further fold costs a few more array entries and no pass.

The log is written once with the columns that a recipe reads. Features are worked out where a value
(or a key's hour) has its row, as arrays over the windows; a row takes along no more than these, and in
each of its windows picks its own entry. So rows stay narrow, and the picks are compiled.

Impression history knows no labels and is the same for all windows. Click history is read as of the
row's hour or the window's end of training, whichever comes first.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import rowlocal as R
from tidemark.operators import history as Y
from tidemark.operators.lookups import block_of
from tidemark.plans.recipe import Recipe
from tidemark.sources.impressions import shared_folder


#: Time columns of every recipe, numbers first.
TIME = ("hour_of_day", "day_of_week", "hour_of_week", "hour_sin", "hour_cos")


@dataclass(frozen=True)
class Fold:
    """Training hours ``start`` to before ``end``, validation hours from there to before ``last``.

    ``everything``: frequencies and distinct counts are those of all rows (they need no labels).
    """

    name: str
    start: int
    end: int
    last: int
    everything: bool = False


def folds(windows: DataFrame) -> list[Fold]:
    """The windows' bounds, a handful of rows."""
    return [Fold(r["name"], r["train_start"], r["train_end"], r["valid_end"]) for r in windows.orderBy("valid_start").collect()]


def _staged(df: DataFrame, *by: str) -> DataFrame:
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Lookups:
    """All lookups of a recipe for the given folds, fitted in one pass over the rows for each kind.

    ``rows``: the log as written, with the columns that the recipe reads and each row's span ``__cut``.
    """

    def __init__(self, log: DataFrame, recipe: Recipe, windows: list[Fold], finish: Callable[[Column], Column]):
        self.recipe, self.windows = recipe, windows
        raw = {b.source for b in recipe.buckets}
        self.finish = lambda x, name: x if name in raw else finish(x)
        blocks = recipe.target.blocks
        width = lambda f: max(1, math.ceil((f.end - f.start) / blocks))
        starts = [[f.start + b * width(f) for b in range(blocks)] for f in windows]
        self.cuts = sorted({c for own in starts for c in own} | {f.end for f in windows})
        at = {c: i for i, c in enumerate(self.cuts)}
        self.block_cut = [[at[c] for c in own] for own in starts]
        self.end_cut = [at[f.end] for f in windows]
        self.vocabulary = [*recipe.raw, *recipe.context, *(n for n, _ in recipe.crosses)]
        self.columns = [*dict.fromkeys([*self.vocabulary, *recipe.frequency, *recipe.target.columns])]
        # how many cuts are at or before the hour: hours before cut i are those with at most i
        span = reduce(lambda a, b: a + b, [(F.col("hour_no") >= t).cast("int") for t in self.cuts])
        read = [*self.columns, *(c for _, k, v in recipe.distinct for c in (k, v)), *(h.key for h in recipe.history)]
        self.rows = rows = _staged(log.select("row_index", "hour_no", "click", "scoring", *TIME, *dict.fromkeys(read), span.alias("__cut")))
        # a scan of few columns for each lookup
        each = reduce(DataFrame.unionAll, [rows.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), "__cut", "click") for c in self.columns])
        spans = each.groupBy("column", "value", "__cut").agg(F.count("*").alias("n"), F.coalesce(F.sum("click"), F.lit(0)).cast("bigint").alias("pos"))
        before = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("__cut") <= i, F.col(c))), F.lit(0)).cast("bigint") for i in range(len(self.cuts))])
        sums = _staged(spans.groupBy("column", "value").agg(before("n").alias("n"), before("pos").alias("pos"), F.sum("n").alias("total")), "column")
        self.sums = _staged(self._numbered(sums), "column")
        whole = rows.groupBy("__cut").agg(F.count("*").alias("n"), F.coalesce(F.sum("click"), F.lit(0)).cast("bigint").alias("pos"))
        one = whole.agg(before("n").alias("n"), before("pos").alias("pos")).first()  # two numbers a cut
        self.n, self.pos = one["n"], one["pos"]
        self.priors = [self.pos[c] / self.n[c] if self.n[c] else 0.0 for c in self.end_cut]

    def _numbered(self, sums: DataFrame) -> DataFrame:
        """``sums`` with ``ids``: by window, the value's place among those with enough training rows (0: too few)."""
        least, most = self.recipe.minimum_count, self.recipe.maximum_vocabulary
        windows = F.array(*[F.struct(F.lit(w).alias("w"), F.get("n", F.lit(c)).alias("rows")) for w, c in enumerate(self.end_cut)])
        kept = sums.filter(F.col("column").isin(self.vocabulary)).select("column", "value", F.explode(windows).alias("x")).filter(F.col("x.rows") >= least)
        kept = kept.select("column", "value", "x.w")
        over = [f"{r['column']} ({r['count']} values)" for r in kept.groupBy("column", "w").count().filter(F.col("count") > most).collect()]
        if over:
            raise ValueError(f"more than {most} values: {', '.join(over)}")
        place = kept.withColumn("id", F.row_number().over(Window.partitionBy("column", "w").orderBy(F.col("value").asc_nulls_first())).cast("bigint"))
        ids = F.array(*[F.coalesce(F.max(F.when(F.col("w") == w, F.col("id"))), F.lit(0).cast("bigint")) for w in range(len(self.windows))])
        ids = place.filter("value IS NOT NULL").groupBy("column", "value").agg(ids.alias("ids"))
        none = F.array(*[F.lit(0).cast("bigint") for _ in self.windows])
        return sums.join(ids, ["column", "value"], "left").withColumn("ids", F.coalesce("ids", none))

    def of(self, column: str) -> DataFrame:
        """The column's values, with an array of ids, frequencies or target features for those that it has."""
        recipe, own = self.recipe, [F.col("value").alias(f"__key_{column}")]
        if column in self.vocabulary:
            own.append(F.col("ids").alias(f"__id_{column}"))
        if column in recipe.frequency:
            seen = [F.col("total") if f.everything else F.get("n", F.lit(c)) for f, c in zip(self.windows, self.end_cut, strict=True)]
            own.append(F.array(*[self.finish(F.log1p(F.coalesce(x, F.lit(0)).cast("double")), f"{column}_frequency_log1p") for x in seen]).alias(f"__frequency_{column}"))
        if column in recipe.target.columns:
            own.append(self._target(column).alias(f"__target_{column}"))
        return self.sums.filter(F.col("column") == column).select(*own)

    def _target(self, column: str) -> Column:
        """``lift, evidence`` of a column's value at each cut that a window reads: by window those of its blocks, then its end."""
        t, cuts = self.recipe.target, [c for own, end in zip(self.block_cut, self.end_cut, strict=True) for c in (*own, end)]
        base = [self.pos[c] / self.n[c] if self.n[c] else 0.5 for c in cuts]
        given = F.array(*[F.struct(F.lit(c).alias("cut"), F.lit(b).alias("base"), F.lit(self.n[c] > 0).alias("known")) for c, b in zip(cuts, base, strict=True)])

        def features(x: Column) -> Column:
            n, pos = F.get("n", x["cut"]), F.get("pos", x["cut"])
            posterior = (pos + t.smoothing * x["base"]) / (n + t.smoothing)
            lift = F.when(x["known"], R.logit(posterior, t.clip) - R.logit(x["base"], t.clip)).otherwise(0.0)
            evidence = F.log1p(n.cast("double"))
            return F.struct(self.finish(lift, f"{column}_target_logit_lift").alias("lift"), self.finish(evidence, f"{column}_target_evidence_log1p").alias("evidence"))

        return F.transform(given, features)

    def distinct(self) -> DataFrame:
        """``name, key, counts``: by window, the logarithm of how many values of a column had come up with the key."""
        pairs = [self.rows.select(F.lit(n).alias("name"), F.col(k).cast("string").alias("key"), F.col(v).cast("string").alias("value"), "hour_no") for n, k, v in self.recipe.distinct]
        first = reduce(DataFrame.unionAll, pairs).groupBy("name", "key", "value").agg(F.min("hour_no").alias("first"))
        counts = F.array(*[F.log1p(F.count_if(F.lit(True) if f.everything else F.col("first") < f.end).cast("double")) for f in self.windows])
        return _staged(first.groupBy("name", "key").agg(counts.alias("counts")), "name")


def dataset(rows: DataFrame, recipe: Recipe, windows: list[Fold], finish: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """``row_index, window, role, click`` and the features of ``recipe.definitions()``, in that order, in every window.

    rows: the log with context, identity, time and cross columns; ``scoring`` marks hidden labels.
    finish: what to do to numerical features (rounding); it is done where they are made, once a value or
    a key's hour, and must leave 0 as it is. Buckets read their sources as they are before.
    """
    fitted, target = Lookups(rows, recipe, windows, finish), recipe.target
    full = fitted.rows.drop("__cut").withColumns({c: fitted.finish(F.col(c), c) for c in TIME[3:]})
    for h in recipe.history:
        full = _with_history(full, fitted, h)
    t, cells = F.col("hour_no"), target.blocks + 1
    inside = []
    for w, f in enumerate(windows):
        known = (t >= f.start) & (t < f.end)
        role = F.when(known, "train").when((t >= f.end) & (t < f.last), "validation")
        cell = F.lit(w * cells) + F.when(known, block_of("hour_no", f.start, f.end, target.blocks)).otherwise(target.blocks)
        inside.append(F.struct(F.lit(w).alias("w"), F.lit(f.name).alias("window"), role.alias("role"), cell.cast("int").alias("cell")))
    for i, c in enumerate(fitted.columns):
        if i == len(fitted.columns) // 2:
            # a higher-order function parts the joins: as one piece their code would be too long to be compiled
            full = full.withColumn("__inside", F.filter(F.array(*inside), lambda x: x["role"].isNotNull()))
        full = full.join(fitted.of(c), F.col(c).cast("string") == F.col(f"__key_{c}"), "left").drop(f"__key_{c}")
    if recipe.distinct:
        distinct = fitted.distinct()
    for name, key, _ in recipe.distinct:
        counts = F.transform("counts", lambda x: fitted.finish(x, name))  # noqa: B023
        own = distinct.filter(F.col("name") == name).select(F.col("key").alias("__key"), counts.alias(f"__distinct_{name}"))
        full = full.join(own, F.col(key).cast("string") == F.col("__key"), "left").drop("__key")
    kept = [c for c in full.columns if c in ("row_index", "click", "scoring", *TIME) or c.startswith("__") and c != "__inside"]
    both = full.select(*kept, F.explode("__inside").alias("__x"))
    w, cell, zero = F.col("__x.w"), F.col("__x.cell"), F.lit(0).cast("bigint")
    out: dict[str, Column] = {c: F.coalesce(F.get(f"__id_{c}", w), zero) for c in fitted.vocabulary}
    out |= {c: F.col(c).cast("bigint") for c in TIME[:3]} | {c: F.col(c) for c in TIME[3:]}
    out |= {f"{c}_frequency_log1p": F.coalesce(F.get(f"__frequency_{c}", w), F.lit(0.0)) for c in recipe.frequency}
    out |= {name: F.coalesce(F.get(f"__distinct_{name}", w), F.lit(0.0)) for name, _, _ in recipe.distinct}
    for b in recipe.buckets:
        out[b.name] = R.bucket(out[b.source], b)
    for h in recipe.history:
        out |= {n: F.col(f"__seen_{h.key}")[n] for n in _seen(h)}
        if h.clicks:
            past = F.get(f"__past_{h.key}", w)
            out |= {n: F.coalesce(past[n], F.lit(0).cast(kind)) for n, kind in _past(h)}
    for c in target.columns:
        own = F.get(f"__target_{c}", cell)
        out |= {f"{c}_target_logit_lift": F.coalesce(own["lift"], F.lit(0.0)), f"{c}_target_evidence_log1p": F.coalesce(own["evidence"], F.lit(0.0))}
    out |= {b.source: finish(out[b.source]) for b in recipe.buckets}
    names = [d[0] for d in recipe.definitions()]
    label = F.when(~F.col("scoring"), F.col("click")).alias("click")
    return both.select("row_index", F.col("__x.window").alias("window"), F.col("__x.role").alias("role"), label, *[out[n].alias(n) for n in names])


def _seen(h) -> dict[str, str]:
    """Features of the impression history and what they are made of."""
    return {f"{h.key}_{n}_log1p": n for n in ("prior_impressions", "hours_since_previous", *(("prior_in_hour",) if h.within_hour else ()))}


def _past(h) -> list[tuple[str, str]]:
    """Features of the click history and their types."""
    names = [f"{h.key}_{n}" for n in ("prior_clicks_log1p", "prior_nonclicks_log1p", "prior_ctr_lift", "hours_since_click_log1p", "impressions_since_click_log1p")]
    return [*((n, "double") for n in names), *([(f"{h.key}_click_pattern", "bigint")] if h.pattern_bits else [])]


def _with_history(full: DataFrame, fitted: Lookups, h) -> DataFrame:
    """Features of the impression history, and by window those of the click history."""
    hourly = _click_features(fitted, h) if h.clicks else None
    seen = Y.impression_history(full, h.key, hourly=hourly)
    logs = F.struct(*[fitted.finish(F.log1p(F.col(n).cast("double")), f).alias(f) for f, n in _seen(h).items()])
    return seen.select(*full.columns, logs.alias(f"__seen_{h.key}"), *([f"__past_{h.key}"] if h.clicks else []))


def _click_features(fitted: Lookups, h) -> DataFrame:
    """Per key and hour that has rows, by window: features of the labelled past before the hour or the end of training."""
    key, t, target = h.key, F.col("hour_no"), fitted.recipe.target
    hours = Y.click_hours(fitted.rows, key, h.pattern_bits)
    state = F.struct(*[F.col(c) for c in ("prior_labelled", "prior_clicks", "prior_nonclicks", "last_click", "impressions_since_click", "click_pattern")])
    # the key's last hour before each end; a key has no more rows here than the log has hours
    last = F.array(*[F.max(F.when(t < f.end, F.struct("hour_no", "after"))).over(Window.partitionBy(key)).getField("after") for f in fitted.windows])
    given = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(f.end).alias("end"), F.lit(p).alias("prior")) for w, (f, p) in enumerate(zip(fitted.windows, fitted.priors, strict=True))])
    past = F.transform(given, lambda x: F.struct(x["prior"].alias("prior"), F.when(t <= x["end"], F.col("__now")).otherwise(F.get("__end", x["w"])).alias("past")))
    log = lambda x: F.log1p(x.cast("double"))

    def features(x: Column) -> Column:
        field = lambda n: F.coalesce(x["past"][n], F.lit(0)).cast("bigint")
        n, pos, prior = field("prior_labelled"), field("prior_clicks"), x["prior"]
        posterior = (pos + target.smoothing * prior) / (n + target.smoothing)
        lift = F.when(n > 0, R.logit(posterior, target.clip) - R.logit(prior, target.clip)).otherwise(0.0)
        since = F.coalesce(t - x["past"]["last_click"], F.lit(0))
        made = [log(pos), log(field("prior_nonclicks")), lift, log(since), log(field("impressions_since_click")), field("click_pattern")]
        return F.struct(*[(fitted.finish(c, n) if kind == "double" else c).alias(n) for c, (n, kind) in zip(made, _past(h), strict=False)])

    return hours.select(key, "hour_no", state.alias("__now"), last.alias("__end")).select(key, "hour_no", F.transform(past, features).alias(f"__past_{key}"))
