"""Field-aware pairwise models over sparse rows: scores as joins, the fit as sums over blocks of rows.

The fit takes one full-batch AdaGrad step an epoch. That is another algorithm than online
updates row by row, and gives other numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ffm_fit import BLOCK_ROWS, staged


def synthetic_weights(features: DataFrame, fields: int, factors: int) -> DataFrame:
    """Weights ``((feature * 31 + field * 17 + factor * 7) % 1000) / 2000`` of all seen features."""
    w = F.transform(F.sequence(F.lit(0), F.lit(factors - 1)), lambda k: F.pmod(F.col("feature") * 31 + F.col("field") * 17 + k * 7, F.lit(1000)) / 2000.0)
    one = features.select("feature").distinct()
    return one.withColumn("field", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(fields).cast("bigint")))).withColumn("w", w)


def packed(weights: DataFrame) -> DataFrame:
    """``feature, w``: a feature's weights as a map from field to factors, one row a feature."""
    return weights.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("field", "w"))).alias("w"))


def score(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """``row_index, click, logit, p``; features or fields without weights are skipped.

    Each feature of a row fetches its packed weights once; pairs are formed inside the row.
    """
    each = rows.select("row_index", F.posexplode("features").alias("i", "x")).select("row_index", "i", F.col("x.feature").alias("feature"), "x.field", "x.value")
    # weights and sums are wider than the files they come from: never broadcast
    gathered = each.join(packed(weights).hint("merge"), "feature").groupBy("row_index").agg(F.collect_list(F.struct("i", "field", "value", "w")).alias("fs"))
    nothing = F.lit(0.0)

    def pair(x: Column, y: Column) -> Column:
        mine, other = F.try_element_at(x["w"], y["field"]), F.try_element_at(y["w"], x["field"])
        both = F.aggregate(F.zip_with(mine, other, lambda p, q: p * q), nothing, lambda s, v: s + v)
        return F.when((x["i"] < y["i"]) & (x["field"] != y["field"]), F.coalesce(x["value"] * y["value"] * both, nothing)).otherwise(nothing)

    logit = F.aggregate("fs", nothing, lambda s, x: s + F.aggregate(F.col("fs"), nothing, lambda t, y: t + pair(x, y)))
    sums = gathered.select("row_index", logit.alias("logit"))
    joined = rows.select("row_index", "click").join(sums.hint("merge"), "row_index", "left").withColumn("logit", F.coalesce("logit", F.lit(0.0)))
    return joined.withColumn("p", 1 / (1 + F.exp(-F.col("logit"))))


class _Block:
    """A block's rows, padded, and the weights of its features for every field; ``has`` tells those there are."""

    def __init__(self, rows: pa.Table, model: pa.Table):
        lists = [rows.column(c).combine_chunks() for c in ("feature", "field", "value")]
        sizes = np.diff(lists[0].offsets.to_numpy()).astype(np.int64)
        feature, field, value = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
        self.feature = np.unique(model.column("feature").to_numpy())
        own, of = np.searchsorted(self.feature, model.column("feature").to_numpy()), model.column("field").to_numpy()
        self.fields = int(max(field.max(initial=0), of.max(initial=0))) + 1
        vectors = np.stack(model.column("w").to_numpy(zero_copy_only=False)).astype(np.float64) if len(own) else np.zeros((0, 1))
        self.w, self.has = np.zeros((len(self.feature) + 1, self.fields, vectors.shape[1])), np.zeros((len(self.feature) + 1, self.fields), bool)
        self.w[own, of], self.has[own, of] = vectors, True
        place = np.searchsorted(self.feature, feature)
        place[place < len(self.feature)] = np.where(self.feature[place[place < len(self.feature)]] == feature[place < len(self.feature)], place[place < len(self.feature)], len(self.feature))
        self.width = int(sizes.max(initial=0))
        self.inside = np.arange(self.width) < sizes[:, None]
        self.at, self.field, self.value = np.full(self.inside.shape, len(self.feature)), np.zeros(self.inside.shape, np.int64), np.zeros(self.inside.shape)
        self.at[self.inside], self.field[self.inside], self.value[self.inside] = place, field, value
        self.d, self.seen = np.zeros((self.has.size, vectors.shape[1])), np.zeros(self.has.size, bool)

    def add(self, s: slice, y: np.ndarray) -> np.ndarray:
        """The logits of rows; their gradients are added to ``d`` where there is a label."""
        at, field, value = self.at[s], self.field[s], self.value[s]
        mine = self.w[at[:, :, None], field[:, None, :]]  # [row, i, j]: of feature i for field j
        there = self.has[at[:, :, None], field[:, None, :]] & self.inside[s][:, :, None] & (field[:, :, None] != field[:, None, :])
        there &= there.transpose(0, 2, 1)
        pair = np.where(there, value[:, :, None] * value[:, None, :], 0.0)
        z = np.einsum("bijk,bjik,bij->b", mine, mine, np.triu(pair, 1))
        kappa = -y / (1 + np.exp(y * z))
        b, i, j = np.nonzero(there & ~np.isnan(y)[:, None, None])
        cell, c = at[b, i] * self.fields + field[b, j], kappa[b] * pair[b, i, j]
        for k in range(self.d.shape[1]):
            self.d[:, k] += np.bincount(cell, c * mine[b, j, i, k], len(self.d))
        self.seen[cell] = True
        return z


def _gradients(key, rows: pa.Table, model: pa.Table) -> pa.Table:
    block, click = _Block(rows, model), rows.column("click").to_numpy(zero_copy_only=False).astype(np.float64)
    step = max(1, 2_000_000 // (block.width**2 * block.d.shape[1] + 1))
    z = np.concatenate([block.add(slice(i, i + step), 2 * click[i : i + step] - 1) for i in range(0, len(click), step)] or [np.zeros(0)])
    cells = np.flatnonzero(block.seen)
    scored = pa.table({"row_index": rows.column("row_index"), "click": rows.column("click"), "logit": z})
    summed = pa.table({"feature": block.feature[cells // block.fields], "field": cells % block.fields, "d": pa.array(list(block.d[cells]), pa.list_(pa.float64()))})
    names = {"row_index": pa.int64(), "click": pa.int32(), "logit": pa.float64(), "feature": pa.int64(), "field": pa.int64(), "d": pa.list_(pa.float64())}
    whole = lambda t: pa.table({n: t.column(n).cast(x) if n in t.column_names else pa.nulls(len(t), x) for n, x in names.items()})
    return pa.concat_tables([whole(scored), whole(summed)])


def epoch(rows: DataFrame, state: DataFrame, rate: float = 0.05, l2: float = 2e-5, size: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """One step. state: ``feature, field, w, g`` (g: sums of squared gradients). Returns scores and the new state.

    Rows lie in blocks, which get their features' weights by one join; pairs are formed inside a block,
    and only its sums of gradients by feature and field leave it.
    """
    blocks = max(1, -(-rows.count() // size))
    part = lambda x, kind: F.transform(F.coalesce("features", F.array().cast("array<struct<field:bigint,feature:bigint,value:double>>")), lambda f: f[x].cast(kind)).alias(x)
    dealt = rows.select(F.pmod(F.xxhash64("row_index"), F.lit(blocks)).alias("block"), "row_index", F.col("click").cast("int").alias("click"), part("feature", "long"), part("field", "long"), part("value", "double"))
    need = dealt.select(F.col("block").alias("to"), F.explode("feature").alias("feature")).distinct()
    model = need.join(state.select("feature", F.col("field").cast("long").alias("field"), "w").hint("merge"), "feature")
    out = staged(dealt.groupBy("block").cogroup(model.groupBy("to")).applyInArrow(_gradients, "row_index long, click int, logit double, feature long, field long, d array<double>"))
    scored = out.filter("logit IS NOT NULL").select("row_index", "click", "logit", (1 / (1 + F.exp(-F.col("logit")))).alias("p"))
    factors = state.select(F.size("w").alias("n")).first()
    sums = F.array(*[F.sum(F.get("d", F.lit(k))) for k in range(factors["n"] if factors else 0)])
    gradient = out.filter("feature IS NOT NULL").groupBy("feature", "field").agg(sums.alias("d"))
    joined = state.join(gradient.hint("merge"), ["feature", "field"], "left")
    full = F.zip_with("d", "w", lambda d, w: d + l2 * w)
    moved = joined.withColumn("grad", F.when(F.col("d").isNotNull(), full))
    g = F.zip_with("g", "grad", lambda g, d: g + d * d)
    moved = moved.withColumn("g2", F.when(F.col("grad").isNotNull(), g).otherwise(F.col("g")))
    step = F.zip_with(F.zip_with("grad", "g2", lambda d, g: rate * d / F.sqrt(g)), "w", lambda s, w: w - s)
    return scored, moved.select("feature", "field", F.when(F.col("grad").isNotNull(), step).otherwise(F.col("w")).alias("w"), F.col("g2").alias("g"))
