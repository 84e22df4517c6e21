"""User-to-publisher profiles, hashed sparse rows and their sources."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.hashing import BINS, hash_profile_token, hash_token, hash_tokens, row_masked
from tidemark.plans.recipe import Roles

# The order of the fields that every sparse row has, and field numbers after them.
NAMED_FIELDS = ("pub_id", "pub_domain", "pub_category", "banner_pos", "device_model", "device_conn_type", "C14", "C17", "C20", "C21")
FIELDS, PUBLISHER_FIELD, DOMAIN_FIELD, HISTORY_FIELD, COUNT_FIELD, SITE_FIELD = 15, 16, 17, 18, 19, 1
SINGLE_WEIGHT = math.sqrt(2.0 / FIELDS)
COLD_TOKEN = "pub_id-learned-cold"
_PROXY = "inventory_type = 'app' AND identity_kind = 'proxy'"
#: Rows of a table of short keys and numbers that is broadcast.
SIDE_ROWS = 100_000


def side(table: DataFrame) -> DataFrame:
    """The table as the small side of a join if it has few rows, counted, and as one to be shuffled otherwise."""
    return F.broadcast(table) if table.limit(SIDE_ROWS + 1).count() <= SIDE_ROWS else table.hint("merge")


def with_publisher(df: DataFrame) -> DataFrame:
    return df.withColumns({"pub_id": F.col("publisher_id"), "pub_domain": F.col("publisher_domain"), "pub_category": F.col("publisher_category")})


def identity_columns() -> dict[str, Column]:
    return {"device_id": F.col("device_id"), "device_ip": F.col("device_ip"), "user": F.col("base_user"), "user_hour": F.concat_ws("-", "base_user", "hour")}


def identity_count(df: DataFrame, kind: str) -> DataFrame:
    """``key, n`` of one kind alone."""
    return df.groupBy(identity_columns()[kind].alias("key")).agg(F.count("*").alias("n"))


def identity_counts(df: DataFrame) -> DataFrame:
    """Rows per device, address, user and user-hour, as ``kind, key, n`` from one expanded pass."""
    kinds = identity_columns()
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in kinds.items()])
    return df.select(F.explode(pairs).alias("x")).groupBy("x.kind", "x.key").agg(F.count("*").alias("n"))


def user_hours(df: DataFrame, history: DataFrame) -> DataFrame:
    """``user_key, hour_key, n_user_hour, n_user, n_proxy, history``: all that tokens ask of a user and an hour, in one narrow table.

    n_user, n_proxy: all rows, and those ``proxy_rows`` has, of the user; history: ``base_user, hour_no, history``.
    A user's hours, not its rows, are one window.
    """
    hours = df.groupBy("base_user", "hour_no").agg(F.count("*").alias("n_user_hour"), F.count_if(F.expr(_PROXY)).alias("p"))
    w = Window.partitionBy("base_user")
    whole = hours.select("base_user", "hour_no", "n_user_hour", F.sum("n_user_hour").over(w).alias("n_user"), F.sum("p").over(w).alias("n_proxy"))
    return whole.join(history.hint("merge"), ["base_user", "hour_no"], "left").select(*_user_hour_keys(), "n_user_hour", "n_user", "n_proxy", "history")


def _user_hour_keys() -> list[Column]:
    """Rows without user or hour have a count of their own."""
    return [F.coalesce("base_user", F.lit("\x1f")).alias("user_key"), F.coalesce("hour_no", F.lit(-(2**62))).alias("hour_key")]


def base_tokens(df: DataFrame, hours: DataFrame, addresses: DataFrame, roles: Roles = Roles(), identity: int = 1000, threshold: int = 30) -> DataFrame:
    """``tokens array<bigint>`` of 15 fields. hours: ``user_hours``; addresses: ``key, n``. Also ``n_proxy`` and ``history``.

    Both tables grow with the log and are packed well on disk, where Spark would take them for small: only
    counted ones are broadcast.
    """
    rows = df.join(side(addresses.select(F.col("key").alias("device_ip"), F.col("n").alias("n_device_ip"))), "device_ip", "left")
    user, hour = _user_hour_keys()
    rows = rows.withColumns({"user_key": user, "hour_key": hour}).join(hours.hint("merge"), ["user_key", "hour_key"], "left").drop("user_key", "hour_key")
    rows = rows.withColumn("n_user", F.when(F.col("base_user").isNotNull(), F.col("n_user")))
    # a known device is a user; the unknown one is most rows: one number
    unknown = df.filter(F.col(roles.device) == roles.no_device).count()
    n_device = F.when(F.col(roles.device) == roles.no_device, F.lit(unknown)).when(F.col(roles.device).isNotNull(), F.col("n_user"))
    rows = rows.withColumn("n_device_id", n_device)
    text = F.when(F.col(roles.device) != roles.no_device, F.coalesce("history", F.lit(""))).otherwise("")
    backed = lambda c: F.when(F.col(f"n_{c}") > identity, F.concat(F.lit(f"{c}-"), F.col(c))).otherwise(F.concat(F.lit(f"{c}-less-"), F.col(f"n_{c}").cast("string")))
    few = F.when(F.col("n_user_hour") > threshold, F.lit(0)).otherwise(F.col("n_user_hour"))
    n = F.col("n_user").cast("string")
    # the third word is spelt as in the trained vocabularies
    past = F.when(F.col("n_user") > threshold, F.concat(F.lit("user_click_histroy-"), n)).otherwise(F.concat(F.lit("user_click_histroy-"), n, F.lit("-"), text))
    named = [F.concat(F.lit(f"{c}-"), F.col(c)) for c in NAMED_FIELDS]
    hour_of_day = F.concat(F.lit("hour-"), F.right("hour", F.lit(2)))
    tokens = [*named, hour_of_day, backed("device_ip"), backed("device_id"), F.concat(F.lit("smooth_user_hour_count-"), few.cast("string")), past]
    return rows.withColumn("tokens", hash_tokens(tokens))


def profile_edges(df: DataFrame, kind: str, field: str, names: dict[str, str], identity: int = 100, most_rows: int = 100, norm: float = 0.5, user: str = "profile_user", order: str = "row_index") -> DataFrame:
    """Weighted edges from users with few rows to one inventory's publishers (or domains)."""
    rows = df.filter(F.col("inventory_type") == kind).select(user, F.col(field).alias("value"), order)
    total = rows.groupBy("value").agg(F.count("*").alias("total"))
    few = rows.groupBy(user).agg(F.count("*").alias("user_rows")).filter(F.col("user_rows") < most_rows).select(user)
    name = names[field]
    token = F.when(F.col("total") >= identity, F.concat(F.lit(f"{name}-"), F.col("value"))).when(F.col("total") >= 2, F.concat(F.lit(f"{name}-less-"), F.col("total").cast("string"))).otherwise(f"{name}-less")
    joined = rows.join(few, user, "left_semi").join(total, "value", "left").withColumn("token", token)
    counted = joined.groupBy(user, "token").agg(F.count("*").alias("c"), F.min(order).alias("first_row"))
    length = F.sqrt(F.sum(F.col("c").cast("double") * F.col("c")).over(Window.partitionBy(user)))
    index = PUBLISHER_FIELD if field == "pub_id" else DOMAIN_FIELD
    return counted.select(F.lit(kind).alias("inventory"), F.col(user).alias("user"), F.lit(index).cast("bigint").alias("field"), "token", (norm * F.col("c") / length).alias("weight"), "first_row")


def publisher_pairs(df: DataFrame, fields: tuple[str, ...] = ("pub_id", "pub_domain"), user: str = "profile_user", order: str = "row_index") -> DataFrame:
    """``inventory, field, user, value, c, first_row``: rows of each user and publisher (or domain), from one pass."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    rows = df.select(F.col("inventory_type").alias("inventory"), F.col(user).alias("user"), F.col(order).alias("o"), F.explode(each).alias("x"))
    return rows.groupBy("inventory", "x.field", "user", "x.value").agg(F.count("*").alias("c"), F.min("o").alias("first_row"))


def edges_of_pairs(pairs: DataFrame, names: dict[tuple[str, str], str], identity: int = 100, most_rows: int = 100, norm: float = 0.5) -> DataFrame:
    """What ``profile_edges`` gives for every inventory and field, from ``publisher_pairs`` alone.

    names: (inventory, field) -> the word its tokens begin with.
    """
    total = side(pairs.groupBy("inventory", "field", "value").agg(F.sum("c").alias("total")))
    one = min(f for _, f in names)  # each row is in every field's pairs
    own = F.sum(F.when(F.col("field") == one, F.col("c"))).over(Window.partitionBy("inventory", "user"))
    few = pairs.filter("inventory IS NOT NULL AND user IS NOT NULL").withColumn("__n", own).filter(F.col("__n") < most_rows).drop("__n")
    word = F.lit(None).cast("string")
    for (kind, field), name in names.items():
        word = F.when((F.col("inventory") == kind) & (F.col("field") == field), name).otherwise(word)
    token = F.when(F.col("total") >= identity, F.concat(word, F.lit("-"), F.col("value"))).when(F.col("total") >= 2, F.concat(word, F.lit("-less-"), F.col("total").cast("string"))).otherwise(F.concat(word, F.lit("-less")))
    joined = few.join(total, ["inventory", "field", "value"], "left").withColumn("token", token)
    counted = joined.groupBy("inventory", "user", "field", "token").agg(F.sum("c").alias("c"), F.min("first_row").alias("first_row"))
    length = F.sqrt(F.sum(F.col("c").cast("double") * F.col("c")).over(Window.partitionBy("inventory", "user", "field")))
    index = F.when(F.col("field") == "pub_id", PUBLISHER_FIELD).otherwise(DOMAIN_FIELD).cast("bigint")
    return counted.select("inventory", "user", index.alias("field"), "token", (norm * F.col("c") / length).alias("weight"), "first_row")


def profile_vectors(edges: DataFrame) -> DataFrame:
    """``inventory, user, profile``: (field, feature, weight) by field and first row, weights of 5 decimals."""
    part = F.struct("field", "first_row", "token", hash_profile_token(F.col("token")).alias("feature"), F.bround("weight", 5).alias("value"))
    ordered = F.array_sort(F.collect_list(part))
    return edges.groupBy("inventory", "user").agg(F.transform(ordered, lambda x: F.struct(x["field"].alias("field"), x["feature"].alias("feature"), x["value"].alias("value"))).alias("profile"))


def proxy_rows(df: DataFrame) -> DataFrame:
    """App rows of unknown devices, under the proxy's name."""
    return df.filter(_PROXY)


def history_tokens(rows: DataFrame, counts: DataFrame, history: DataFrame, threshold: int = 30) -> DataFrame:
    """Tokens of fields 18 and 19 for proxy rows, and whether the history is used."""
    joined = rows.join(counts, "base_user").join(history, ["base_user", "hour_no"], "left")
    text, (own, count) = _history_words(F.col("n"), threshold)
    return joined.select("row_index", text.alias("history"), hash_token(own).alias("history_feature"), hash_token(count).alias("count_feature"), (text != "").alias("use_history"))


def _history_words(n: Column, threshold: int) -> tuple[Column, list[Column]]:
    text, word = F.coalesce("history", F.lit("")), n.cast("string")
    token = F.when(n > threshold, F.concat(F.lit("user_click_history-"), word)).otherwise(F.concat(F.lit("user_click_history2-"), word, F.lit("-"), text))
    count = F.concat(F.lit("user_count-"), word)
    return text, [token, count]


def _single(field: Column | int, feature: Column, weight: float = SINGLE_WEIGHT) -> Column:
    f = F.lit(field) if isinstance(field, int) else field
    return F.struct(f.cast("bigint").alias("field"), feature.cast("bigint").alias("feature"), F.lit(weight).alias("value"))


def sparse_rows(tokens: DataFrame, profiles: DataFrame, history: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``row_index, click, scoring, features``: 15 single tokens, the profile, and for proxy rows the history if ``history``, its threshold, is given.

    keep: further columns, which a join of the finished rows would shuffle with all features.
    """
    base = F.array(*[_single(i + 1, F.get("tokens", F.lit(i))) for i in range(FIELDS)])
    vectors = profiles.withColumnsRenamed({"inventory": "inventory_type", "user": "profile_user"})
    none = F.array().cast("array<struct<field:bigint,feature:bigint,value:double>>")
    parts = [base, F.coalesce("profile", none)]
    if history is not None:
        has = F.expr(_PROXY) & F.col("base_user").isNotNull()
        tokens = tokens.withColumn("__own", hash_tokens([F.when(has, x) for x in _history_words(F.col("n_proxy"), history)[1]]))
        parts.append(F.when(F.col("__own")[0].isNotNull(), F.array(_single(HISTORY_FIELD, F.col("__own")[0]), _single(COUNT_FIELD, F.col("__own")[1]))).otherwise(none))
    # profiles grow with the users: never broadcast
    rows = tokens.join(vectors.hint("merge"), ["inventory_type", "profile_user"], "left")
    return rows.select("row_index", "id", "click", "scoring", "inventory_type", *keep, F.concat(*parts).alias("features"))


def sparse_lines(rows: DataFrame) -> DataFrame:
    """Text form: label, the single tokens, then field:feature:weight."""
    single = F.transform(F.slice("features", 1, FIELDS), lambda x: x["feature"].cast("string"))
    rest = F.slice("features", FIELDS + 1, F.size("features"))
    weighted = F.transform(rest, lambda x: F.concat_ws(":", x["field"].cast("string"), x["feature"].cast("string"), F.format_number(x["value"], 5)))
    return rows.select("row_index", F.concat_ws(" ", F.col("click").cast("string"), F.array_join(single, " "), F.when(F.size(rest) > 0, F.array_join(weighted, " "))).alias("line"))


def cold_publisher(rows: DataFrame, basis_points: int = 1800) -> DataFrame:
    """Field 1 becomes the cold token in scoring rows and in masked training rows."""
    cold = hash_token(F.lit(COLD_TOKEN), BINS)
    masked = F.col("scoring") | row_masked(F.col("row_index"), basis_points)
    swap = F.transform("features", lambda x: F.when(x["field"] == SITE_FIELD, F.struct(x["field"].alias("field"), cold.alias("feature"), x["value"].alias("value"))).otherwise(x))
    # asked once a row, outside the features
    return rows.withColumn("masked", masked).withColumn("features", F.when(F.col("masked"), swap).otherwise(F.col("features")))


def cold_selector(rows: DataFrame) -> DataFrame:
    """For scoring site rows: whether training has no row of the publisher."""
    site = rows.filter(F.col("inventory_type") == "site")
    seen = site.filter("NOT scoring").select("publisher_id", F.lit(True).alias("seen")).distinct()
    return site.filter("scoring").join(seen, "publisher_id", "left").select("row_index", "id", F.col("seen").isNull().alias("use_cold"))


def compose(app: DataFrame, site: DataFrame) -> DataFrame:
    """One prediction a row. Both: ``row_index, id, selected, special, baseline``; app rows come first."""

    def chosen(df: DataFrame, kind: str, rank: int) -> DataFrame:
        source = F.when(F.col("selected"), f"{kind}_special").otherwise(f"{kind}_baseline")
        return df.select("row_index", "id", F.lit(rank).cast("bigint").alias("inventory_rank"), source.alias("source"), F.when(F.col("selected"), F.col("special")).otherwise(F.col("baseline")).alias("p"))

    return chosen(app, "app", 0).unionByName(chosen(site, "site", 1))


def aligned(left: DataFrame, right: DataFrame, key: str = "row_index", check: str = "id") -> DataFrame:
    """How two row sets of equal order fit: rows on both sides, on one alone, with another id."""
    both = left.select(key, F.col(check).alias("a")).join(right.select(key, F.col(check).alias("b")), key, "full_outer")
    return both.agg(F.count_if(F.col("a") == F.col("b")).alias("matched"), F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"), F.count_if(F.col("a") != F.col("b")).alias("other_id"))
