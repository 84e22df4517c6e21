"""The registered queries as SQL over the same tables."""

from __future__ import annotations

from tidemark.plans.recipe import Recipe
from tidemark.queries.dataset_sql import parts as dataset_parts
from tidemark.sources.impressions import PRIME, RAW_STRINGS, STRINGS, powers

RECIPE = Recipe()

# ---- building blocks: named subqueries, and which others each needs

_PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "i": (
        (),
        """SELECT *, hour_no >= max(hour_no) OVER () - 23 AS scoring FROM (
SELECT event_id AS row_index, lpad(CAST(event_id AS VARCHAR), 20, '0') AS id, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS click,
 strftime(ts, '%y%m%d%H') AS hour, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour_no, ts,
 CASE WHEN k < 40 THEN 'S_APP' WHEN k >= 95 AND ts >= TIMESTAMP '2024-01-30 00:00:00' THEN concat('site_new_', k) ELSE concat('site_', k % 20) END AS site_id,
 CASE WHEN k < 40 THEN 'sd_none' ELSE concat('sd_', k % 8) END AS site_domain, concat('sc_', k % 4) AS site_category,
 CASE WHEN k < 40 THEN concat('app_', k % 15) ELSE 'app_none' END AS app_id,
 CASE WHEN k < 40 THEN concat('ad_', k % 6) ELSE 'ad_none' END AS app_domain, concat('ac_', k % 3) AS app_category,
 CASE WHEN user_id % 3 = 0 THEN concat('dev_', user_id) ELSE 'D_UNKNOWN' END AS device_id,
 concat('ip_', user_id % 60) AS device_ip, concat('model_', user_id % 11) AS device_model,
 CAST(event_id % 3 AS VARCHAR) AS banner_pos, CAST(user_id % 4 AS VARCHAR) AS device_conn_type,
 concat('c14_', k) AS C14, concat('c17_', k % 10) AS C17, concat('c20_', k % 7) AS C20, concat('c21_', k % 5) AS C21,
 (k + 1) / 102e0 AS p1, (user_id % 97 + 1) / 99e0 AS p2
FROM (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k FROM events))""",
    ),
    "tr": (("i",), "SELECT * FROM i WHERE NOT scoring"),
    "sc": (("i",), "SELECT * FROM i WHERE scoring"),
    "u": (
        ("i",),
        """SELECT *, publisher_id AS pub_id, publisher_domain AS pub_domain, publisher_category AS pub_category FROM (SELECT *, CASE WHEN site_id = 'S_APP' THEN 'app' ELSE 'site' END AS inventory_type,
 CASE WHEN site_id = 'S_APP' THEN app_id ELSE site_id END AS publisher_id, CASE WHEN site_id = 'S_APP' THEN app_domain ELSE site_domain END AS publisher_domain,
 CASE WHEN site_id = 'S_APP' THEN app_category ELSE site_category END AS publisher_category,
 CASE WHEN device_id <> 'D_UNKNOWN' THEN 'device' ELSE 'proxy' END AS identity_kind,
 CASE WHEN device_id <> 'D_UNKNOWN' THEN 'device' || chr(31) || device_id ELSE 'proxy' || chr(31) || device_ip || chr(31) || device_model END AS user_id,
 CASE WHEN device_id <> 'D_UNKNOWN' THEN 'id-' || device_id ELSE 'ip-' || device_ip || '-' || device_model END AS base_user,
 CASE WHEN device_id <> 'D_UNKNOWN' THEN device_id ELSE device_ip || '-' || device_model END AS profile_user FROM i)""",
    ),
    "span": (("tr",), "SELECT min(hour_no) AS a, max(hour_no) + 1 AS b, greatest(1, CAST(ceil((max(hour_no) + 1 - min(hour_no)) / 4e0) AS BIGINT)) AS w FROM tr"),
    "prior": (("tr",), "SELECT avg(click) AS prior, count(*) AS n FROM tr"),
    "cov": (("tr",), "SELECT device_ip, count(*) AS device_ip__frequency, count(DISTINCT app_id) AS ip_apps__raw, count(DISTINCT device_model) AS ip_models__raw FROM tr GROUP BY 1"),
    "stats": (("tr",), "SELECT site_id, CAST(sum(click) AS BIGINT) AS positive, count(*) AS n FROM tr GROUP BY 1"),
    "blk": (("tr", "span"), "SELECT *, least(greatest((hour_no - a) // w, 0), 3) AS block FROM tr, span"),
    "gb": (
        ("blk",),
        """SELECT block, prior_count, CASE WHEN prior_count > 0 THEN gp / prior_count END AS block_prior FROM (SELECT block, CAST(coalesce(sum(p) OVER w, 0) AS BIGINT) AS gp, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS prior_count
 FROM (SELECT block, sum(click) AS p, count(*) AS n FROM blk GROUP BY 1) WINDOW w AS (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    ),
    "tt": (
        ("blk", "gb"),
        """SELECT site_id, block, previous_positive, previous_count, prior_count, block_prior FROM (SELECT site_id, block, CAST(coalesce(sum(p) OVER w, 0) AS BIGINT) AS previous_positive, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS previous_count
 FROM (SELECT site_id, block, sum(click) AS p, count(*) AS n FROM blk GROUP BY 1, 2) WINDOW w AS (PARTITION BY site_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) JOIN gb USING (block)""",
    ),
    "win": (
        ("i",),
        """SELECT CASE WHEN f = 3 THEN 'final_holdout' ELSE 'walk_forward_' || f END AS name, a AS train_start, s AS train_end, s AS valid_start, CASE WHEN f = 3 THEN b + 1 ELSE s + 48 END AS valid_end, f = 3 AS final_holdout
 FROM (SELECT a, b, f, CASE WHEN f = 3 THEN b - 23 ELSE b - 23 - (3 - f) * 48 END AS s FROM (SELECT min(hour_no) AS a, max(hour_no) AS b FROM i), (SELECT unnest(range(4)) AS f))""",
    ),
    "fold": (("i", "win"), "SELECT i.*, name AS \"window\", CASE WHEN hour_no < train_end THEN 'train' WHEN hour_no >= valid_start THEN 'validation' END AS role FROM i JOIN win ON hour_no >= train_start AND hour_no < valid_end"),
    "counts": (
        ("u",),
        "SELECT 'device_id' AS kind, device_id AS key, count(*) AS n FROM u GROUP BY 2 UNION ALL SELECT 'device_ip', device_ip, count(*) FROM u GROUP BY 2 UNION ALL SELECT 'user', base_user, count(*) FROM u GROUP BY 2 UNION ALL SELECT 'user_hour', base_user || '-' || hour, count(*) FROM u GROUP BY 2",
    ),
    "px": (("u",), "SELECT * FROM u WHERE inventory_type = 'app' AND identity_kind = 'proxy'"),
    "pxh": (
        ("px",),
        "SELECT r.row_index, r.base_user, coalesce(right(string_agg(CAST(t.click AS VARCHAR), '' ORDER BY t.row_index), 4), '') AS history FROM px r LEFT JOIN px t ON t.base_user = r.base_user AND t.hour_no < r.hour_no AND NOT t.scoring GROUP BY 1, 2",
    ),
    "pxn": (("px",), "SELECT base_user, count(*) AS n FROM px GROUP BY 1"),
    "hist": (("pxh", "pxn"), "SELECT row_index, history, n, CASE WHEN n > 30 THEN 'user_click_history-' || n ELSE 'user_click_history2-' || n || '-' || history END AS t FROM pxh JOIN pxn USING (base_user)"),
    "dev": (
        ("u",),
        "SELECT r.row_index, coalesce(right(string_agg(CAST(t.click AS VARCHAR), '' ORDER BY t.row_index), 4), '') AS history FROM u r LEFT JOIN u t ON t.base_user = r.base_user AND t.hour_no < r.hour_no AND NOT t.scoring WHERE r.identity_kind = 'device' GROUP BY 1",
    ),
    "cold": (("u",), "SELECT row_index, id, publisher_id NOT IN (SELECT publisher_id FROM u WHERE NOT scoring AND inventory_type = 'site') AS use_cold FROM u WHERE scoring AND inventory_type = 'site'"),
    "edges": (("u",), ""),
    "tok": (("u", "counts", "dev"), ""),
    "vec": (
        ("edges",),
        "SELECT inventory, \"user\", list(struct_pack(f := field, h := CAST(('0x' || md5('group-' || token))::UHUGEINT::DOUBLE % 999999 + 1 AS BIGINT), v := round_even(weight, 5)) ORDER BY field, first_row, token) AS profile FROM edges GROUP BY 1, 2",
    ),
    "comp": (
        ("u", "hist", "cold"),
        """SELECT row_index, id, CAST(0 AS BIGINT) AS inventory_rank, CASE WHEN coalesce(history <> '', false) THEN 'app_special' ELSE 'app_baseline' END AS source, CASE WHEN coalesce(history <> '', false) THEN p2 ELSE p1 END AS p
 FROM u LEFT JOIN hist USING (row_index) WHERE scoring AND inventory_type = 'app' UNION ALL
 SELECT row_index, u.id, 1, CASE WHEN use_cold THEN 'site_special' ELSE 'site_baseline' END, CASE WHEN use_cold THEN 1 - p2 ELSE p1 END FROM u JOIN cold USING (row_index)""",
    ),
    "hours": (("u",), ""),
    "past": (("hours",), ""),
    "loss": (("sc",), "SELECT row_index, hour_no, -ln(CASE WHEN click = 1 THEN p1 ELSE 1 - p1 END) AS candidate, -ln(CASE WHEN click = 1 THEN p2 ELSE 1 - p2 END) AS incumbent FROM sc"),
    "bm": (
        ("loss",),
        """SELECT CAST(floor(((r + 1) * k - 1) / n) AS BIGINT) AS block, count(*) AS rows, avg(d) AS mean_difference
 FROM (SELECT candidate - incumbent AS d, row_number() OVER (ORDER BY hour_no, row_index) - 1 AS r, count(*) OVER () AS n, CAST(ceil(count(*) OVER () / 51e0) AS BIGINT) AS k FROM loss) GROUP BY 1""",
    ),
    "boot": (
        ("bm",),
        """SELECT s AS sample, avg(mean_difference) AS m FROM (SELECT d // k AS s, CAST(('0x' || md5('7-' || d)[1:8])::UBIGINT % k AS BIGINT) AS block FROM (SELECT unnest(range(200 * k)) AS d, k FROM (SELECT count(*) AS k FROM bm)))
 JOIN bm USING (block) GROUP BY 1""",
    ),
    "fl": (("fold",), "SELECT \"window\", count(*) AS rows, avg(-ln(CASE WHEN click = 1 THEN p1 ELSE 1 - p1 END)) AS candidate, avg(-ln(CASE WHEN click = 1 THEN p2 ELSE 1 - p2 END)) AS incumbent FROM fold WHERE role = 'validation' AND NOT final_holdout_of(\"window\") GROUP BY 1"),
    "pc": (
        ("u", "hist", "cold"),
        """SELECT count(*) FILTER (NOT scoring) AS training, count(*) FILTER (NOT scoring AND inventory_type = 'app') AS training_app, count(*) FILTER (NOT scoring AND inventory_type = 'site') AS training_site,
 count(*) FILTER (scoring) AS scoring, count(*) FILTER (scoring AND inventory_type = 'app') AS scoring_app, count(*) FILTER (scoring AND inventory_type = 'site') AS scoring_site,
 count(*) FILTER (scoring AND inventory_type = 'app' AND identity_kind = 'proxy') AS scoring_proxy, count(*) FILTER (scoring AND history <> '') AS scoring_history, count(*) FILTER (use_cold) AS scoring_cold
 FROM u LEFT JOIN hist USING (row_index) LEFT JOIN (SELECT row_index, use_cold FROM cold) USING (row_index)""",
    ),
}


def _hash(token: str) -> str:
    return f"CAST(('0x' || md5({token}))::UHUGEINT % 999999 + 1 AS BIGINT)"


def _edges_sql() -> str:
    out = []
    for kind, names in (("app", ("app_id", "app_domain")), ("site", ("site_id", "site_domain"))):
        for field, name, index in (("pub_id", names[0], 16), ("pub_domain", names[1], 17)):
            out.append(
                f"""SELECT '{kind}' AS inventory, "user", CAST({index} AS BIGINT) AS field, token, 0.5e0 * c / sqrt(sum(c * c) OVER (PARTITION BY "user")) AS weight, first_row FROM (
 SELECT profile_user AS "user", CASE WHEN total >= 100 THEN '{name}-' || {field} WHEN total >= 2 THEN '{name}-less-' || total ELSE '{name}-less' END AS token, count(*) AS c, min(row_index) AS first_row
 FROM (SELECT *, count(*) OVER (PARTITION BY {field}) AS total, count(*) OVER (PARTITION BY profile_user) AS own FROM u WHERE inventory_type = '{kind}') WHERE own < 40 GROUP BY 1, 2)"""
            )
    return " UNION ALL ".join(out)


def _tokens_sql() -> str:
    named = ("pub_id", "pub_domain", "pub_category", "banner_pos", "device_model", "device_conn_type", "C14", "C17", "C20", "C21")
    tokens = [f"'{c}-' || {c}" for c in named] + ["'hour-' || right(hour, 2)"]
    tokens += [f"CASE WHEN n_{c} > 1000 THEN '{c}-' || {c} ELSE '{c}-less-' || n_{c} END" for c in ("device_ip", "device_id")]
    tokens += ["'smooth_user_hour_count-' || CASE WHEN n_hour > 30 THEN 0 ELSE n_hour END"]
    tokens += ["CASE WHEN n_user > 30 THEN 'user_click_histroy-' || n_user ELSE 'user_click_histroy-' || n_user || '-' || coalesce(history, '') END"]
    listed = ", ".join(_hash(t) for t in tokens)
    return f"""SELECT *, [{listed}] AS tokens FROM (SELECT u.*, dev.history, a.n AS n_device_id, b.n AS n_device_ip, c.n AS n_user, d.n AS n_hour FROM u LEFT JOIN dev USING (row_index)
 JOIN counts a ON a.kind = 'device_id' AND a.key = device_id JOIN counts b ON b.kind = 'device_ip' AND b.key = device_ip JOIN counts c ON c.kind = 'user' AND c.key = base_user
 JOIN counts d ON d.kind = 'user_hour' AND d.key = base_user || '-' || hour)"""


def _hours_sql(key: str) -> str:
    return f"SELECT {key} AS key, hour_no, count(*) FILTER (NOT scoring) AS n, coalesce(sum(click) FILTER (NOT scoring), 0) AS pos FROM u GROUP BY 1, 2"


_PAST = f"""SELECT key, hour_no, CAST(coalesce(sum(n) OVER p, 0) AS BIGINT) AS prior_labelled, CAST(coalesce(sum(pos) OVER p, 0) AS BIGINT) AS prior_clicks,
 CAST(coalesce(sum(n) OVER p, 0) - coalesce(sum(pos) OVER p, 0) AS BIGINT) AS prior_nonclicks,
 coalesce(hour_no - max(CASE WHEN pos > 0 THEN hour_no END) OVER p, 0) AS hours_since_click,
 CAST(coalesce(sum(n) OVER p, 0) - coalesce(max(CASE WHEN pos > 0 THEN cum END) OVER p, 0) AS BIGINT) AS impressions_since_click,
 CAST(coalesce(last_value(code IGNORE NULLS) OVER p, 0) AS BIGINT) AS click_pattern
 FROM (SELECT *, CASE WHEN n > 0 THEN least(hour_no - f + 1, 4) * 16 + {" + ".join(f"{1 << d} * coalesce(h{d}, 0)" for d in range(4))} END AS code FROM (
  SELECT *, sum(n) OVER (PARTITION BY key ORDER BY hour_no) AS cum, min(CASE WHEN n > 0 THEN hour_no END) OVER (PARTITION BY key ORDER BY hour_no) AS f,
  {", ".join(f"max(CAST(pos > 0 AS INTEGER)) OVER (PARTITION BY key ORDER BY hour_no RANGE BETWEEN {d} PRECEDING AND {d} PRECEDING) AS h{d}" for d in range(4))} FROM hours))
 WINDOW p AS (PARTITION BY key ORDER BY hour_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
_PARTS["edges"] = (("u",), _edges_sql())
_PARTS["tok"] = (("u", "counts", "dev"), _tokens_sql())
_PARTS["hours"] = (("u",), _hours_sql("device_ip"))
_PARTS["past"] = (("hours",), _PAST)
_PARTS["fl"] = (("fold",), _PARTS["fl"][1].replace('final_holdout_of("window")', "\"window\" = 'final_holdout'"))
# the sparse rows: fifteen single tokens, the profile, the history
_PARTS["sp"] = (
    ("tok", "vec", "hist"),
    f"""SELECT tok.row_index, click, scoring, inventory_type, tok.id, list_concat(list_transform(tokens, lambda tk, j: struct_pack(f := CAST(j AS BIGINT), h := tk, v := sqrt(2e0 / 15))), coalesce(profile, [])) AS base,
 list_concat(base, CASE WHEN hist.n IS NULL THEN [] ELSE [struct_pack(f := CAST(18 AS BIGINT), h := {_hash('hist.t')}, v := sqrt(2e0 / 15)), struct_pack(f := CAST(19 AS BIGINT), h := {_hash("'user_count-' || hist.n")}, v := sqrt(2e0 / 15))] END) AS features
 FROM tok LEFT JOIN vec ON vec.inventory = inventory_type AND vec."user" = profile_user LEFT JOIN hist ON hist.row_index = tok.row_index""",
)


def _with(body: str, *needs: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for n in _PARTS[name][0]:
                add(n)
            order.append(name)

    for n in needs:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({_PARTS[n][1]})" for n in order) + f"\n{body}"


def _logit(p: str, clip: str = "1e-4") -> str:
    q = f"least(greatest({p}, {clip}), 1 - {clip})"
    return f"ln({q} / (1 - {q}))"


def _splitmix() -> str:
    """Rows ``row_index, masked``, step by step; products are taken by 32-bit halves."""
    mul = lambda x, c: f"((({x} % 4294967296) * {c & 0xFFFFFFFF} + ((({x} // 4294967296) * {c & 0xFFFFFFFF} + ({x} % 4294967296) * {c >> 32}) % 4294967296) * 4294967296) % 18446744073709551616::HUGEINT)"
    step = lambda x, s: f"xor({x}, {x} // {1 << s}::HUGEINT)"
    a = "SELECT row_index, (row_index::HUGEINT + 11400714819323198485::HUGEINT) % 18446744073709551616::HUGEINT AS a FROM i"
    b = f"SELECT row_index, {step('a', 30)} AS a FROM ({a})"
    c = f"SELECT row_index, {mul('a', 0xBF58476D1CE4E5B9)} AS a FROM ({b})"
    d = f"SELECT row_index, {step('a', 27)} AS a FROM ({c})"
    e = f"SELECT row_index, {mul('a', 0x94D049BB133111EB)} AS a FROM ({d})"
    return f"SELECT row_index, {step('a', 31)} % 10000 < 1800 AS masked FROM ({e})"


_PARTS["mask"] = (("i",), _splitmix())
_CARD = ", ".join(f"count(DISTINCT {c}) + coalesce(max(CAST({c} IS NULL AS BIGINT)), 0) AS {c}_cardinality" for c in STRINGS)
_VOC = lambda c, m: f"SELECT {c}, row_number() OVER (ORDER BY {c} NULLS FIRST) AS v FROM (SELECT {c} FROM tr GROUP BY 1 HAVING count(*) >= {m})"
_IMP = "row_number() OVER (PARTITION BY base_user ORDER BY hour_no, scoring, row_index) - 1"
_LIFT = f"CASE WHEN prior_count > 0 THEN {_logit('(coalesce(previous_positive, 0) + 20 * coalesce(block_prior, 0.5e0)) / (coalesce(previous_count, 0) + 20)')} - {_logit('coalesce(block_prior, 0.5e0)')} ELSE 0 END"
_SCORE_LIFT = f"{_logit('(coalesce(positive, 0) + 20 * prior) / (coalesce(stats.n, 0) + 20)')} - {_logit('prior')}"
_CTR_LIFT = f"CASE WHEN prior_labelled > 0 THEN {_logit('(prior_clicks + 20 * prior) / (prior_labelled + 20)')} - {_logit('prior')} ELSE 0 END"
_PROFILE = "array_to_string(list_transform(profile, lambda x: concat(x.f, ':', x.h, ':', printf('%.5f', x.v))), ' ')"
_LOSS = lambda p: f"-ln(CASE WHEN click = 1 THEN {p} ELSE 1 - {p} END)"
_EVENT_HASH = "event_id * 1000003 * 1009 - user_id * 999999937"
_COEFFICIENTS = (1103515245 % 2**21, 69069, 1664525 % 2**21, 22695477 % 2**21)
_LOCATION = " + ".join(f"((({_EVENT_HASH}) >> {s}) & {m}) * {c}" for (s, m), c in zip(((0, 2097151), (21, 2097151), (42, 2097151), (63, 1)), _COEFFICIENTS, strict=True))

SQL: dict[str, str] = {
    "scan_raw": _with("SELECT id, click, hour, site_id, app_id, device_id, C14 FROM i", "i"),
    "canonicalize": _with("SELECT row_index, id, click, hour, hour_no, site_id, app_id FROM i", "i"),
    "scan_projected": "SELECT event_id, user_id, round(value, 6) AS value FROM events",
    "shard_stats": _with("SELECT CAST(floor((row_index - (SELECT min(row_index) FROM i)) / 4096) AS INTEGER) AS shard, count(*) AS rows, min(row_index) AS first_row, max(row_index) AS last_row FROM i GROUP BY 1", "i"),
    "row_index": _with("SELECT row_index, row_number() OVER (ORDER BY hour_no, row_index) - 1 AS dense_index FROM i WHERE click = 1", "i"),
    "submission": _with("SELECT id, round(p, 6) AS click FROM comp", "comp"),
    "sparse_lines": _with("SELECT row_index, concat_ws(' ', click, array_to_string(list_transform(features[1:15], lambda x: x.h), ' '), CASE WHEN len(features) > 15 THEN array_to_string(list_transform(features[16:], lambda x: concat(x.f, ':', x.h, ':', printf('%.5f', x.v))), ' ') END) AS line FROM sp", "sp"),
    "time_features": _with(
        """SELECT row_index, hour_no AS timestamp_hour, h AS hour_of_day, d AS day_of_week, day(ts) AS day_of_month, (d - 1) * 24 + h AS hour_of_week, round(sin(h * (2 * pi() / 24)), 6) + 0e0 AS hour_sin, round(cos(h * (2 * pi() / 24)), 6) + 0e0 AS hour_cos
 FROM (SELECT *, hour(ts) AS h, isodow(ts) AS d FROM i)""",
        "i",
    ),
    "inventory_context": _with("SELECT row_index, inventory_type, publisher_id, publisher_domain, publisher_category FROM u", "u"),
    "identity_keys": _with("SELECT row_index, identity_kind, user_id, base_user, profile_user FROM u", "u"),
    "feature_crosses": _with("SELECT row_index, device_ip || chr(31) || device_model AS ip_model, device_ip || chr(31) || device_model || chr(31) || site_id AS ip_model_site FROM i", "i"),
    "numeric_buckets": "SELECT event_id, CAST(value >= 1 AS BIGINT) + CAST(value >= 10 AS BIGINT) + CAST(value >= 50 AS BIGINT) + CAST(value >= 100 AS BIGINT) AS bucket, CAST(ln(1 + abs(value)) >= ln(2) AS BIGINT) + CAST(ln(1 + abs(value)) >= ln(11) AS BIGINT) + CAST(ln(1 + abs(value)) >= ln(51) AS BIGINT) + CAST(ln(1 + abs(value)) >= ln(101) AS BIGINT) AS log_bucket FROM events",
    "hash_buckets": f"SELECT event_id, CAST(((12345 + {_LOCATION}) % 2147483647) % 1048576 AS BIGINT) AS location FROM events",
    "hash_token": _with(f"SELECT row_index, {_hash("'pub_id-' || site_id")} AS site_token, {_hash("'C14-' || C14")} AS c14_token FROM i", "i"),
    "hash_profile_token": _with("SELECT row_index, CAST(('0x' || md5('group-app_id-' || app_id))::UHUGEINT::DOUBLE % 999999 + 1 AS BIGINT) AS app_token FROM i", "i"),
    "publisher_mask": _with("SELECT row_index, masked FROM mask", "mask"),
    "vocab_encode": _with(f"SELECT row_index, coalesce(a.v, 0) AS site_id, coalesce(b.v, 0) AS app_id, coalesce(c.v, 0) AS C14 FROM i LEFT JOIN ({_VOC('site_id', 2)}) a USING (site_id) LEFT JOIN ({_VOC('app_id', 2)}) b USING (app_id) LEFT JOIN ({_VOC('C14', 2)}) c USING (C14)", "i", "tr"),
    "model_columns": _with(f"SELECT row_index, coalesce(a.v, 0) AS site_id, coalesce(b.v, 0) AS app_id, coalesce(c.v, 0) AS C14, CASE WHEN click = 1 THEN 1e0 ELSE 0e0 END AS ratio, CAST(click AS DOUBLE) AS click FROM i LEFT JOIN ({_VOC('site_id', 2)}) a USING (site_id) LEFT JOIN ({_VOC('app_id', 2)}) b USING (app_id) LEFT JOIN ({_VOC('C14', 2)}) c USING (C14)", "i", "tr"),
    "label_check": _with("SELECT CAST(min(click) AS BIGINT) AS least, CAST(max(click) AS BIGINT) AS most, count(*) FILTER (click IS NULL) AS nulls, count(*) FILTER (click NOT IN (0, 1)) AS others, true AS \"binary\" FROM i", "i"),
    "hour_order_check": _with("SELECT count(*) FILTER (NOT regexp_full_match(hour, '[0-9]{8}')) AS malformed, count(*) FILTER (hour < b) AS backward FROM (SELECT hour, lag(hour) OVER (ORDER BY row_index) AS b FROM i)", "i"),
    "missing_hours": _with("SELECT missing_hour FROM (SELECT unnest(range(a, b + 1)) AS missing_hour FROM (SELECT min(hour_no) AS a, max(hour_no) AS b FROM i WHERE click = 1 AND site_id = 'site_7')) WHERE missing_hour NOT IN (SELECT hour_no FROM i WHERE click = 1 AND site_id = 'site_7') ORDER BY 1 LIMIT 10", "i"),
    "time_range": _with("SELECT row_index, hour_no FROM i WHERE hour_no >= (SELECT min(hour_no) FROM i) + 24 AND hour_no < (SELECT min(hour_no) FROM i) + 48", "i"),
    "population_counts": _with("SELECT * FROM pc", "pc"),
    "population_checks": _with("SELECT training_app + training_site = training AS training_adds_up, scoring_app + scoring_site = scoring AS scoring_adds_up, scoring_proxy <= scoring_app AS proxy_in_app, scoring_history <= scoring_proxy AS history_in_proxy, scoring_cold <= scoring_site AS cold_in_site FROM pc", "pc"),
    "eligible_users": _with("SELECT profile_user, count(*) AS rows FROM u GROUP BY 1 HAVING count(*) < 40", "u"),
    "user_eligibility": _with("SELECT inventory_type, count(*) AS users, count(*) FILTER (n < 40) AS few, min(n) AS least, max(n) AS most FROM (SELECT inventory_type, profile_user, count(*) AS n FROM u GROUP BY 1, 2) GROUP BY 1", "u"),
    "lookup_sink": _with("SELECT * FROM cov", "cov"),
    "vocabulary": _with(f"SELECT site_id, v AS site_id__id FROM ({_VOC('site_id', 5)})", "tr"),
    "frequency": _with("SELECT device_ip, count(*) AS device_ip__frequency FROM i GROUP BY 1", "i"),
    "distinct_counts": _with("SELECT device_ip, count(DISTINCT a) + max(CAST(a IS NULL AS BIGINT)) AS apps__raw, count(DISTINCT site_id) AS sites__raw FROM (SELECT *, nullif(app_id, 'app_none') AS a FROM i) GROUP BY 1", "i"),
    "covariate_lookup": _with("SELECT * FROM cov", "cov"),
    "covariate_population": _with("SELECT device_ip, count(*) AS device_ip__frequency, count(DISTINCT app_id) AS ip_apps__raw FROM i GROUP BY 1", "i"),
    "covariate_features": _with("SELECT row_index, round(ln(1 + coalesce(device_ip__frequency, 0)), 6) AS device_ip_frequency_log1p, round(ln(1 + coalesce(ip_apps__raw, 0)), 6) AS ip_apps, round(ln(1 + coalesce(ip_models__raw, 0)), 6) AS ip_models FROM i LEFT JOIN cov USING (device_ip)", "i", "cov"),
    "target_stats": _with("SELECT * FROM stats", "stats"),
    "global_prior": _with("SELECT round(prior, 9) AS prior, n FROM prior", "prior"),
    "temporal_target_stats": _with("SELECT site_id, block, previous_positive, previous_count, prior_count, round(block_prior, 9) AS block_prior FROM tt", "tt"),
    "target_features_train": _with(f"SELECT row_index, round({_LIFT}, 6) + 0e0 AS lift, round(ln(1 + coalesce(previous_count, 0)), 6) AS evidence FROM blk LEFT JOIN tt USING (site_id, block)", "blk", "tt"),
    "target_features_score": _with(f"SELECT row_index, round({_SCORE_LIFT}, 6) + 0e0 AS lift, round(ln(1 + coalesce(stats.n, 0)), 6) AS evidence FROM sc CROSS JOIN prior LEFT JOIN stats USING (site_id)", "sc", "prior", "stats"),
    "oov_rates": _with(
        f"""SELECT split, rows, feature, unknown, round(unknown / rows, 9) AS rate FROM (SELECT CASE WHEN scoring THEN 'scoring' ELSE 'training' END AS split, count(*) AS rows, count(*) FILTER (a.v IS NULL) AS site_id, count(*) FILTER (b.v IS NULL) AS C14
 FROM i LEFT JOIN ({_VOC('site_id', 5)}) a USING (site_id) LEFT JOIN ({_VOC('C14', 5)}) b USING (C14) GROUP BY 1) UNPIVOT (unknown FOR feature IN (site_id, C14))""",
        "i",
        "tr",
    ),
    "prior_impressions": _with(f"SELECT row_index, {_IMP} AS prior_impressions, round(ln(1 + {_IMP}), 6) AS prior_impressions_log1p FROM u", "u"),
    "hours_since_previous": _with("SELECT row_index, coalesce(hour_no - lag(hour_no) OVER (PARTITION BY base_user ORDER BY hour_no, scoring, row_index), 0) AS hours_since_previous FROM u", "u"),
    "prior_in_hour": _with("SELECT row_index, row_number() OVER (PARTITION BY device_ip, hour_no ORDER BY scoring, row_index) - 1 AS prior_in_hour FROM i", "i"),
    **{n: _with(f"SELECT row_index, {c} FROM u JOIN past ON past.key = device_ip AND past.hour_no = u.hour_no", "u", "past") for n, c in (("prior_clicks", "prior_clicks, prior_nonclicks"), ("hours_since_click", "hours_since_click"), ("impressions_since_click", "impressions_since_click"), ("click_pattern", "click_pattern"))},
    "prior_ctr_lift": _with(f"SELECT row_index, round({_CTR_LIFT}, 6) + 0e0 AS lift FROM u CROSS JOIN prior JOIN past ON past.key = device_ip AND past.hour_no = u.hour_no", "u", "past", "prior"),
    "asof_click_state": _with("SELECT key AS device_ip, hour_no, prior_labelled, prior_clicks, prior_nonclicks, hours_since_click, impressions_since_click, click_pattern FROM past", "past"),
    "history_string": _with("SELECT row_index, history FROM dev", "dev"),
    "history_tokens": _with(f"SELECT row_index, history, {_hash('t')} AS history_feature, {_hash("'user_count-' || n")} AS count_feature, history <> '' AS use_history FROM hist", "hist"),
    "temporal_windows": _with("SELECT * FROM win", "win"),
    "window_assignment": _with('SELECT "window", role, count(*) AS rows, CAST(sum(click) AS BIGINT) AS clicks, min(hour_no) AS first_hour, max(hour_no) AS last_hour FROM fold WHERE role IS NOT NULL GROUP BY 1, 2', "fold"),
    "identity_counts": _with("SELECT * FROM counts", "counts"),
    "base_tokens": _with("SELECT row_index, array_to_string(tokens, ' ') AS tokens FROM tok", "tok"),
    "profile_edges": _with("SELECT inventory, \"user\", field, token, round(weight, 6) AS weight, first_row FROM edges", "edges"),
    "profile_vectors": _with(f'SELECT inventory, "user", {_PROFILE} AS profile FROM vec', "vec"),
    "profile_attach": _with('SELECT row_index, coalesce(len(profile), 0) AS entries FROM u LEFT JOIN vec ON vec.inventory = inventory_type AND vec."user" = profile_user', "u", "vec"),
    "profile_coverage": _with(
        """SELECT a.*, scoring_rows, training_rows FROM (SELECT inventory, count(DISTINCT "user") AS users, count(*) FILTER (field = 16) AS publisher_edges, count(*) FILTER (field = 17) AS domain_edges FROM edges GROUP BY 1) a
 JOIN (SELECT inventory_type AS inventory, count(*) FILTER (scoring) AS scoring_rows, count(*) FILTER (NOT scoring) AS training_rows FROM u WHERE EXISTS (SELECT 1 FROM edges WHERE inventory = inventory_type AND "user" = profile_user) GROUP BY 1) b USING (inventory)""",
        "u",
        "edges",
    ),
    "proxy_counts": _with("SELECT * FROM pxn", "pxn"),
    "sparse_rows": _with("SELECT row_index, len(features) AS entries, CAST(list_sum(list_transform(features, lambda x: x.h)) AS BIGINT) AS feature_sum, CAST(list_sum(list_transform(features, lambda x: x.f)) AS BIGINT) AS field_sum, round(list_sum(list_transform(features, lambda x: x.v)), 4) AS weight_sum FROM sp", "sp"),
    "cold_publisher_rows": _with(f"SELECT row_index, scoring OR masked AS masked, CASE WHEN scoring OR masked THEN {_hash("'pub_id-learned-cold'")} ELSE tokens[1] END AS first_feature FROM tok JOIN mask USING (row_index) WHERE inventory_type = 'site'", "tok", "mask"),
    "cold_publisher_selector": _with("SELECT * FROM cold", "cold"),
    "aligned_join": _with("SELECT count(*) FILTER (a AND b) AS matched, count(*) FILTER (a AND NOT b) AS only_left, count(*) FILTER (b AND NOT a) AS only_right, CAST(0 AS BIGINT) AS other_id FROM (SELECT hour_no % 24 <> 3 AS a, hour_no % 24 <> 5 AS b FROM i)", "i"),
    "compose_predictions": _with("SELECT row_index, id, inventory_rank, source, round(p, 6) AS p FROM comp", "comp"),
    "prediction_stats": _with("SELECT coalesce(source, 'all') AS source, count(*) AS rows, round(min(p), 6) AS least, round(max(p), 6) AS most, round(avg(p), 6) AS mean, count(*) FILTER (NOT (p > 0 AND p < 1)) AS out_of_range FROM comp GROUP BY ROLLUP (source)", "comp"),
    "submission_check": _with("SELECT count(*) AS rows, count(DISTINCT id) AS ids, count(*) FILTER (p IS NULL OR isnan(p)) AS bad FROM comp", "comp"),
    "raw_report": _with(f"SELECT count(*) AS rows, min(hour) AS first_hour, max(hour) AS last_hour, round(avg(click), 9) AS click_rate, {_CARD} FROM i", "i"),
    "dataset_report": _with("SELECT CASE WHEN scoring THEN 'scoring' ELSE 'training' END AS split, count(*) AS rows, round(avg(click), 9) AS click_rate, min(hour_no) AS first_hour, max(hour_no) AS last_hour, count(DISTINCT site_id) + count(DISTINCT app_id) AS cardinality FROM i GROUP BY 1", "i"),
    "report_json": _with("SELECT CASE WHEN scoring THEN 'scoring' ELSE 'training' END AS split, count(*) AS rows, round(avg(click), 9) AS click_rate, min(hour_no) AS first_hour, max(hour_no) AS last_hour, count(DISTINCT site_id) + count(DISTINCT app_id) AS cardinality FROM i GROUP BY 1", "i"),
    "row_losses": _with(f"SELECT row_index, round({_LOSS('p1')}, 6) AS loss FROM sc", "sc"),
    "eval_metrics": _with(f"SELECT count(*) AS rows, round(avg({_LOSS('p1')}), 6) AS logloss, round(avg((p1 - click) ** 2), 6) AS brier FROM i", "i"),
    "roc_auc": _with("SELECT round(sum(pos * (b + neg / 2e0)) / (sum(pos) * sum(neg)), 9) AS roc_auc FROM (SELECT pos, neg, sum(neg) OVER (ORDER BY p1) - neg AS b FROM (SELECT p1, sum(click) AS pos, sum(1 - click) AS neg FROM i GROUP BY 1))", "i"),
    "calibration_error": _with("SELECT round(sum(n * gap) / sum(n), 9) AS ece FROM (SELECT count(*) AS n, abs(avg(click) - avg(p1)) AS gap FROM i GROUP BY least(greatest(" + " + ".join(f"CAST(p1 >= {i / 15!r}e0 AS INTEGER)" for i in range(16)) + " - 1, 0), 14))", "i"),
    "paired_losses": _with("SELECT row_index, round(candidate, 6) AS candidate, round(incumbent, 6) AS incumbent, round(candidate - incumbent, 6) AS difference FROM loss", "loss"),
    "block_means": _with("SELECT block, rows, round(mean_difference, 6) AS mean_difference FROM bm", "bm"),
    "block_bootstrap": _with("SELECT count(*) AS samples, round(quantile_cont(m, 0.95), 6) AS upper, round(avg(m), 6) AS mean FROM boot", "boot"),
    "fold_losses": _with('SELECT "window", rows, round(candidate, 6) AS candidate, round(incumbent, 6) AS incumbent FROM fl', "fl"),
    "selection_gate": _with(
        """SELECT round(d, 6) AS mean_difference, round(q, 6) AS upper, round(c, 6) AS candidate, round(n, 6) AS incumbent,
 CASE WHEN d >= 0 THEN 'no better on the holdout' WHEN q >= 0 THEN 'within noise on the holdout' WHEN c > n + 1e-4 THEN 'worse over the folds' ELSE 'selected' END AS reason
 FROM (SELECT sum(rows * mean_difference) / sum(rows) AS d FROM bm), (SELECT quantile_cont(m, 0.95) AS q FROM boot), (SELECT avg(candidate) AS c, avg(incumbent) AS n FROM fl)""",
        "bm",
        "boot",
        "fl",
    ),
    "residual_correlation": _with("SELECT round(a, 6) AS p1_p2, round(b, 6) AS p1_p3, round(c, 6) AS p2_p3, round((greatest(a, 0) ** 2 + greatest(b, 0) ** 2 + greatest(c, 0) ** 2) / 3, 6) AS penalty FROM (SELECT corr(p1 - click, p2 - click) AS a, corr(p1 - click, 1 - p2 - click) AS b, corr(p2 - click, 1 - p2 - click) AS c FROM i)", "i"),
    "batch_plan": _with("SELECT shard % 4 AS worker, count(*) AS shards, CAST(sum(rows) AS BIGINT) AS rows, CAST(ceil(sum(rows) / 1000e0) AS BIGINT) AS steps FROM (SELECT row_index // 512 AS shard, count(*) AS rows FROM i GROUP BY 1) GROUP BY 1", "i"),
    "ensemble_mean_logit": _with("SELECT row_index, round(1 / (1 + exp(-(ln(p1 / (1 - p1)) + ln(p2 / (1 - p2))) / 2)), 6) AS p FROM i", "i"),
    "ffm_score": _with(
        """SELECT row_index, round(coalesce(z, 0), 4) AS logit, round(1 / (1 + exp(-coalesce(z, 0))), 4) AS p FROM (SELECT DISTINCT row_index FROM sp WHERE scoring) LEFT JOIN (
 SELECT row_index, sum(x.v * y.v * (""" + " + ".join(f"((x.h * 31 + y.f * 17 + {7 * k}) % 1000) / 2000e0 * (((y.h * 31 + x.f * 17 + {7 * k}) % 1000) / 2000e0)" for k in range(4)) + """)) AS z
 FROM (SELECT row_index, x, unnest(base[j + 1:]) AS y FROM (SELECT row_index, base, unnest(base) AS x, unnest(range(1, len(base) + 1)) AS j FROM sp WHERE scoring)) WHERE x.f <> y.f GROUP BY 1) USING (row_index)""",
        "sp",
    ),
    "stream_hourly_clicks": _with("SELECT user_id, hour_no, count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks FROM (SELECT *, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour_no FROM events) WHERE hour_no < (SELECT max(hour_no) FROM i) GROUP BY 1, 2", "i"),
    "stream_prior_impressions": """SELECT event_id, row_number() OVER w - 1 AS prior_impressions, coalesce(hour_no - lag(hour_no) OVER w, 0) AS hours_since_previous, row_number() OVER (PARTITION BY user_id, hour_no ORDER BY event_id) - 1 AS prior_in_hour
FROM (SELECT *, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour_no FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY hour_no, event_id)""",
    "stream_late_rows": _with(
        """SELECT batch, count(*) AS late_rows, max(hour_no) AS last_hour FROM (SELECT row_index % 3 AS batch, hour_no FROM i) a
 WHERE hour_no < (SELECT max(hour_no) - 24 FROM i b WHERE b.row_index % 3 < a.batch) GROUP BY 1""",
        "i",
    ),
    "stream_enrich": _with("SELECT row_index, coalesce(device_ip__frequency, 0) AS frequency, coalesce(ip_apps__raw, 0) AS apps, coalesce(positive, 0) AS positive, coalesce(stats.n, 0) AS n FROM i LEFT JOIN cov USING (device_ip) LEFT JOIN stats USING (site_id)", "i", "cov", "stats"),
}
SQL["shard_manifest"] = _with(
    """SELECT CAST(r // 4096 AS INTEGER) AS part, concat('part-', lpad(CAST(r // 4096 AS VARCHAR), 5, '0'), '.parquet') AS file, count(*) AS rows, min(r) AS first_row, max(r) AS last_row, CAST(sum(click) AS BIGINT) AS clicks
 FROM (SELECT click, row_number() OVER (ORDER BY hour_no, row_index) - 1 AS r FROM i) GROUP BY 1, 2""",
    "i",
)
SQL["sparse_dataset"] = SQL["sparse_lines"].replace("SELECT row_index, concat_ws(' ', click,", "SELECT CASE WHEN i.scoring THEN 'scoring' ELSE 'training' END AS split, inventory_type AS inventory, concat_ws(' ', sp.click,").replace("AS line FROM sp", "AS line FROM sp JOIN i USING (row_index)")
SQL["checked_gate"] = SQL["selection_gate"].replace(" AS reason\n FROM (SELECT sum(rows", " AS reason, (SELECT count(*) FROM sc) AS rows, true AS same_population\n FROM (SELECT sum(rows")
SQL["raw_row_index"] = _with("SELECT id, row_number() OVER (ORDER BY row_index) - 1 AS source_index FROM i", "i")
SQL["approx_distinct_counts"] = _with(
    "SELECT 'train' AS population, device_ip, count(DISTINCT app_id) AS apps, count(DISTINCT C14) AS models, true AS near FROM tr GROUP BY 2 UNION ALL SELECT 'all', device_ip, count(DISTINCT app_id), count(DISTINCT C14), true FROM i GROUP BY 2", "i", "tr"
)
_RAW = """SELECT *, 'c1_' || CAST(regexp_extract(C20, '[0-9]+$') AS INTEGER) % 3 AS C1, CASE WHEN device_id = 'D_UNKNOWN' THEN '1' ELSE '0' END AS device_type, CASE WHEN site_id = 'S_APP' THEN 'c15_320' ELSE 'c15_300' END AS C15,
 CASE WHEN C21 = 'c21_0' THEN 'c16_250' ELSE 'c16_50' END AS C16, 'c18_' || CAST(regexp_extract(C17, '[0-9]+$') AS INTEGER) % 4 AS C18,
 CASE WHEN CAST(regexp_extract(C14, '[0-9]+$') AS INTEGER) % 7 <> 0 THEN 'c19_' || CAST(regexp_extract(C14, '[0-9]+$') AS INTEGER) % 9 END AS C19 FROM i"""
SQL["raw_column_report"] = _with(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS \"distinct\", CAST(coalesce(sum(n) FILTER (v IS NULL), 0) AS BIGINT) AS nulls, arg_min(v, p) AS top, max(n) AS top_rows FROM (SELECT *, row_number() OVER (ORDER BY n DESC, v NULLS LAST) AS p FROM (SELECT {c} AS v, count(*) AS n FROM ({_RAW}) GROUP BY 1))"
        for c in RAW_STRINGS
    ).replace("arg_min(v, p)", "max(v) FILTER (p = 1)"),
    "i",
)


def _identity_sql() -> str:
    """Each digit of a row's place multiplies its hash by a power of the base."""
    value = "CAST(('0x' || md5(" + " || '|' || ".join(f"coalesce('v' || {c}, 'n')" for c in ("id", "hour", "site_id", "app_id", "device_id")) + ")[1:15])::UBIGINT AS HUGEINT)"
    step = f"SELECT s, r, {value} AS v FROM (SELECT *, scoring AS s, row_number() OVER (PARTITION BY scoring ORDER BY hour_no, row_index) - 1 AS r FROM i)"
    for k, digits in enumerate(powers()):
        step = f"SELECT s, r, v * ({digits}::HUGEINT[])[CAST((r // {64**k}) % 64 + 1 AS BIGINT)] % {PRIME} AS v FROM ({step})"
    return f"SELECT CASE WHEN s THEN 'scoring' ELSE 'training' END AS population, count(*) AS rows, CAST(sum(v) % {PRIME} AS BIGINT) AS identity FROM ({step}) GROUP BY 1"


SQL["population_identity"] = _with(_identity_sql(), "i")
SQL["paired_mismatch"] = _with("SELECT count(*) FILTER (a AND b) AS matched, count(*) FILTER (a AND NOT b) AS only_candidate, count(*) FILTER (b AND NOT a) AS only_incumbent, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS other_label FROM (SELECT comp.row_index IS NOT NULL AS a, coalesce(scoring, false) AS b FROM comp FULL JOIN sc USING (row_index))", "comp", "sc")


def _dataset_sql(windows: str, everything: bool, rows: str) -> str:
    """The windows of ``rows`` (a condition on the log), with their own names for the subqueries."""
    given, last = dataset_parts(RECIPE, windows, everything)
    crossed = "device_ip || chr(31) || device_model AS ip_model, device_ip || chr(31) || device_model || chr(31) || site_id AS ip_model_site"
    d = f"SELECT * REPLACE (CASE WHEN NOT scoring THEN click END AS click), {crossed} FROM u WHERE {rows}"
    named = "".join(f",\n{n} AS MATERIALIZED ({body})" for n, body in {"d": d, **given}.items())
    return _with("", "u").rstrip() + named + "\n" + last


_FOLDS = """SELECT CASE WHEN f = 3 THEN 'final_holdout' ELSE 'walk_forward_' || f END AS name, f AS w, a, s AS e, CASE WHEN f = 3 THEN b + 1 ELSE s + 48 END AS v
 FROM (SELECT a, b, f, CASE WHEN f = 3 THEN b - 23 ELSE b - 23 - (3 - f) * 48 END AS s FROM (SELECT min(hour_no) AS a, max(hour_no) AS b FROM d), (SELECT unnest(range(4)) AS f))"""
SQL["evaluation_windows"] = _dataset_sql(_FOLDS, False, "NOT scoring")
SQL["production_window"] = _dataset_sql("SELECT 'production' AS name, 0 AS w, min(hour_no) AS a, min(hour_no) FILTER (scoring) AS e, max(hour_no) + 1 AS v FROM d", True, "true")
# what a stream with a watermark 48 hours behind has seen: rows of hours not closed when their part came, in hours closed at the end
_TIMED = {
    "e": "SELECT user_id, event_id, event_id % 3 AS part, epoch_ms(ts) AS ms, hour_no, click, scoring FROM (SELECT events.*, i.hour_no, i.click, i.scoring FROM events JOIN i ON row_index = event_id)",
    "m": "SELECT part, max(ms) - 48 * 3600000 AS edge FROM (SELECT a.part, b.ms FROM (SELECT unnest(range(1, 4)) AS part) a JOIN e b ON b.part < a.part) GROUP BY 1",
    "g": "SELECT e.*, coalesce(hour_no < edge // 3600000, false) AS late FROM e LEFT JOIN m USING (part)",
    "ok": "SELECT * FROM g WHERE NOT late AND hour_no < (SELECT edge // 3600000 FROM m WHERE part = 3)",
    "hours": "SELECT user_id AS key, hour_no, count(*) FILTER (NOT scoring) AS n, coalesce(sum(click) FILTER (NOT scoring), 0) AS pos FROM ok GROUP BY 1, 2",
    "past": _PAST,
}
SQL["stream_timed_history"] = (
    _with("", "i").rstrip()
    + "".join(f",\n{n} AS MATERIALIZED ({q})" for n, q in _TIMED.items())
    + """
SELECT event_id, false AS late, row_number() OVER w - 1 AS prior_impressions, coalesce(ok.hour_no - lag(ok.hour_no) OVER w, 0) AS hours_since_previous, row_number() OVER (PARTITION BY user_id, ok.hour_no ORDER BY scoring, event_id) - 1 AS prior_in_hour,
 prior_clicks, prior_nonclicks, hours_since_click, impressions_since_click, click_pattern FROM ok JOIN past ON past.key = user_id AND past.hour_no = ok.hour_no WINDOW w AS (PARTITION BY user_id ORDER BY ok.hour_no, scoring, event_id)
UNION ALL SELECT event_id, true, 0, 0, 0, 0, 0, 0, 0, 0 FROM g WHERE late"""
)
# the same history, by the table's own user, for the stream
_STREAM_PARTS = {"hours": _hours_sql("user_id").replace("FROM u", "FROM (SELECT e.user_id, i.hour_no, scoring, click FROM i JOIN events e ON event_id = row_index)")}


def _stream_click_history() -> str:
    text = _with("SELECT event_id, prior_clicks, prior_nonclicks, hours_since_click, impressions_since_click, click_pattern FROM events JOIN i ON row_index = event_id JOIN past ON past.key = events.user_id AND past.hour_no = i.hour_no", "i", "past")
    return text.replace(_hours_sql("device_ip"), _STREAM_PARTS["hours"])


SQL["stream_click_history"] = _stream_click_history()
