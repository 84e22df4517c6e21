"""Row-local features as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.recipe import Bucket, Roles

SEPARATOR, MISSING = "\x1f", "__MISSING__"


def time_features(df: DataFrame) -> DataFrame:
    """From ``hour`` (YYMMDDHH): hour number, hour of day, ISO weekday, day, hour of week, circle."""
    ts = F.to_timestamp(F.concat("hour", F.lit("00")), "yyMMddHHmm")
    hour, weekday = F.hour(ts).cast("bigint"), (F.weekday(ts) + 1).cast("bigint")
    angle = hour * (2 * math.pi / 24)
    return df.withColumns(
        {
            "timestamp_hour": F.floor(F.unix_timestamp(ts) / 3600),
            "hour_of_day": hour,
            "day_of_week": weekday,
            "day_of_month": F.dayofmonth(ts).cast("bigint"),
            "hour_of_week": (weekday - 1) * 24 + hour,
            "hour_sin": F.sin(angle),
            "hour_cos": F.cos(angle),
        }
    )


def inventory_context(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Inventory type and the publisher's three columns from the side that applies; null is site."""
    app = F.col(roles.site) == roles.no_site
    pick = lambda part: F.when(app, F.col(f"app_{part}")).otherwise(F.col(f"site_{part}"))
    return df.withColumns({"inventory_type": F.when(app, "app").otherwise("site"), **{f"publisher_{p}": pick(p) for p in ("id", "domain", "category")}})


def text_or_missing(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING))


def identity_keys(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """A known device stands for itself, else address and model do; three spellings of the user."""
    known = F.col(roles.device) != roles.no_device
    proxy = [text_or_missing(roles.address), text_or_missing(roles.model)]
    return df.withColumns(
        {
            "identity_kind": F.when(known, "device").otherwise("proxy"),
            "user_id": F.when(known, F.concat_ws(SEPARATOR, F.lit("device"), text_or_missing(roles.device))).otherwise(F.concat_ws(SEPARATOR, F.lit("proxy"), *proxy)),
            "base_user": F.when(known, F.concat(F.lit("id-"), F.col(roles.device))).otherwise(F.concat(F.lit("ip-"), F.col(roles.address), F.lit("-"), F.col(roles.model))),
            "profile_user": F.when(known, F.col(roles.device)).otherwise(F.concat_ws("-", roles.address, roles.model)),
        }
    )


def crosses(df: DataFrame, recipe: tuple[tuple[str, tuple[str, ...]], ...]) -> DataFrame:
    """Crosses in order; later ones may use earlier ones."""
    for name, parts in recipe:
        df = df.withColumn(name, F.concat_ws(SEPARATOR, *[text_or_missing(p) for p in parts]))
    return df


def bucket(value: Column, spec: Bucket) -> Column:
    """How many boundaries are at most the value; null and NaN count as 0."""
    x = F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))
    total = F.lit(0).cast("bigint")
    for b in spec.boundaries:
        total = total + (x >= F.lit(math.log1p(b) if spec.log_scale else b)).cast("bigint")
    return total


def logit(p: Column, clip: float) -> Column:
    bounded = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.log(bounded / (1 - bounded))


def model_columns(df: DataFrame, categorical: list[str], numerical: list[str], label: str | None) -> DataFrame:
    """Ordered lanes: long categories, float numbers without null or NaN, float label."""
    lanes = [F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c) for c in categorical]
    lanes += [F.coalesce(F.nanvl(F.col(c).cast("float"), F.lit(0.0).cast("float")), F.lit(0.0).cast("float")).alias(c) for c in numerical]
    return df.select("row_index", *lanes, *([F.col(label).cast("float").alias(label)] if label else []))
