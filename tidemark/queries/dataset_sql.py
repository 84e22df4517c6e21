"""The datasets of all windows as SQL: every lookup fitted anew for each window."""

from __future__ import annotations

from tidemark.plans.recipe import Recipe


def _logit(p: str, clip: float) -> str:
    q = f"least(greatest({p}, {clip}), 1 - {clip})"
    return f"ln({q} / (1 - {q}))"


def parts(recipe: Recipe, windows: str, everything: bool) -> tuple[dict[str, str], str]:
    """Named subqueries in order, and the last select; ``d`` (the log with all raw columns, ``click`` null where hidden) is given.

    windows: a select of ``name, w, a, e, v`` (first hour, end of training, end of validation).
    """
    t, h, out, names = recipe.target, recipe.history[0], {}, {}
    cols = [*recipe.raw, *recipe.context, *(n for n, _ in recipe.crosses)]
    out["wn"] = windows
    out["wr"] = "SELECT d.*, wn.name AS \"window\", wn.w, wn.a, wn.e, CASE WHEN hour_no < e THEN 'train' ELSE 'validation' END AS role FROM d JOIN wn ON hour_no >= a AND hour_no < v"
    out["wt"] = "SELECT * FROM wr WHERE role = 'train'"
    joins = []
    for i, c in enumerate(cols):
        out[f"v{i}"] = f"SELECT w, {c} AS value, row_number() OVER (PARTITION BY w ORDER BY {c} NULLS FIRST) AS id FROM (SELECT w, {c} FROM wt GROUP BY 1, 2 HAVING count(*) >= {recipe.minimum_count})"
        joins.append(f"LEFT JOIN v{i} ON v{i}.w = wr.w AND v{i}.value = wr.{c}")
        names[c] = f"coalesce(v{i}.id, 0)"
    of_all = "(SELECT d.*, w FROM d, wn)" if everything else "wt"
    for i, c in enumerate(recipe.frequency):
        out[f"q{i}"] = f"SELECT w, {c} AS key, count(*) AS n FROM {of_all} GROUP BY 1, 2"
        joins.append(f"LEFT JOIN q{i} ON q{i}.w = wr.w AND q{i}.key = wr.{c}")
        names[f"{c}_frequency_log1p"] = f"ln(1 + coalesce(q{i}.n, 0))"
    for i, (name, key, value) in enumerate(recipe.distinct):
        out[f"x{i}"] = f"SELECT w, {key} AS key, count(DISTINCT {value}) + max(CAST({value} IS NULL AS BIGINT)) AS n FROM {of_all} GROUP BY 1, 2"
        joins.append(f"LEFT JOIN x{i} ON x{i}.w = wr.w AND x{i}.key = wr.{key}")
        names[name] = f"ln(1 + coalesce(x{i}.n, 0))"
    for b in recipe.buckets:
        names[b.name] = "(" + " + ".join(f"CAST({names[b.source]} >= ln(1 + {x!r}) AS BIGINT)" for x in b.boundaries) + ")"
    # blocks of training rows; validation rows see all of them
    out["wd"] = f"SELECT *, CAST(greatest(1, ceil((e - a) / {t.blocks}e0)) AS BIGINT) AS bw FROM wn"
    out["wb"] = f"SELECT w, k, CASE WHEN k = {t.blocks} THEN e ELSE a + k * bw END AS cut FROM wd, (SELECT unnest(range({t.blocks} + 1)) AS k)"
    out["wg"] = "SELECT wb.w, k, count(d.row_index) AS n, coalesce(sum(d.click), 0) AS pos FROM wb LEFT JOIN d ON d.hour_no < cut GROUP BY 1, 2"
    block = f"CASE WHEN role = 'validation' THEN {t.blocks} ELSE least(greatest((hour_no - wr.a) // wd.bw, 0), {t.blocks - 1}) END"
    joins += ["JOIN wd ON wd.w = wr.w", f"JOIN wg ON wg.w = wr.w AND wg.k = {block}"]
    base = "CASE WHEN wg.n > 0 THEN wg.pos / wg.n ELSE 0.5e0 END"
    for i, c in enumerate(t.columns):
        out[f"t{i}"] = f"SELECT wb.w, k, {c} AS key, count(*) AS n, coalesce(sum(d.click), 0) AS pos FROM wb JOIN d ON d.hour_no < cut GROUP BY 1, 2, 3"
        joins.append(f"LEFT JOIN t{i} ON t{i}.w = wr.w AND t{i}.k = wg.k AND t{i}.key = wr.{c}")
        posterior = f"(coalesce(t{i}.pos, 0) + {t.smoothing} * {base}) / (coalesce(t{i}.n, 0) + {t.smoothing})"
        names[f"{c}_target_logit_lift"] = f"CASE WHEN wg.n > 0 THEN {_logit(posterior, t.clip)} - {_logit(base, t.clip)} ELSE 0 END"
        names[f"{c}_target_evidence_log1p"] = f"ln(1 + coalesce(t{i}.n, 0))"
    key = h.key
    order = f"(PARTITION BY {key} ORDER BY hour_no, scoring, row_index)"
    out["im"] = f"SELECT row_index, row_number() OVER {order} - 1 AS before, coalesce(hour_no - lag(hour_no) OVER {order}, 0) AS since, row_number() OVER (PARTITION BY {key}, hour_no ORDER BY scoring, row_index) - 1 AS inside FROM d"
    joins.append("JOIN im ON im.row_index = wr.row_index")
    names |= {f"{key}_prior_impressions_log1p": "ln(1 + before)", f"{key}_hours_since_previous_log1p": "ln(1 + since)", f"{key}_prior_in_hour_log1p": "ln(1 + inside)"}
    bits, one = h.pattern_bits, 1 << h.pattern_bits
    out["hw"] = f"SELECT w, {key} AS key, hour_no, count(*) FILTER (role = 'train') AS n, coalesce(sum(click) FILTER (role = 'train'), 0) AS pos FROM wr GROUP BY 1, 2, 3"
    ranges = ", ".join(f"max(CAST(pos > 0 AS INTEGER)) OVER (PARTITION BY w, key ORDER BY hour_no RANGE BETWEEN {i} PRECEDING AND {i} PRECEDING) AS h{i}" for i in range(bits))
    out["hx"] = f"SELECT *, sum(n) OVER (PARTITION BY w, key ORDER BY hour_no) AS cum, min(CASE WHEN n > 0 THEN hour_no END) OVER (PARTITION BY w, key ORDER BY hour_no) AS f, {ranges} FROM hw"
    code = " + ".join(f"{1 << i} * coalesce(h{i}, 0)" for i in range(bits))
    out["hp"] = f"""SELECT w, key, hour_no, coalesce(sum(n) OVER p, 0) AS labelled, coalesce(sum(pos) OVER p, 0) AS clicks, coalesce(hour_no - max(CASE WHEN pos > 0 THEN hour_no END) OVER p, 0) AS since_click,
 coalesce(sum(n) OVER p, 0) - coalesce(max(CASE WHEN pos > 0 THEN cum END) OVER p, 0) AS rows_since, coalesce(last_value(CASE WHEN n > 0 THEN least(hour_no - f + 1, {bits}) * {one} + {code} END IGNORE NULLS) OVER p, 0) AS pattern
 FROM hx WINDOW p AS (PARTITION BY w, key ORDER BY hour_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
    joins.append(f"JOIN hp ON hp.w = wr.w AND hp.key = wr.{key} AND hp.hour_no = wr.hour_no")
    joins.append(f"JOIN wg AS we ON we.w = wr.w AND we.k = {t.blocks}")
    prior = "(we.pos / we.n)"
    names |= {f"{key}_click_pattern": "CAST(hp.pattern AS BIGINT)", f"{key}_prior_clicks_log1p": "ln(1 + hp.clicks)", f"{key}_prior_nonclicks_log1p": "ln(1 + hp.labelled - hp.clicks)"}
    names |= {f"{key}_hours_since_click_log1p": "ln(1 + since_click)", f"{key}_impressions_since_click_log1p": "ln(1 + rows_since)"}
    posterior = f"(hp.clicks + {t.smoothing} * {prior}) / (hp.labelled + {t.smoothing})"
    names[f"{key}_prior_ctr_lift"] = f"CASE WHEN hp.labelled > 0 THEN {_logit(posterior, t.clip)} - {_logit(prior, t.clip)} ELSE 0 END"
    circle = "hour(ts) * (2 * pi() / 24)"
    names |= {"hour_of_day": "hour(ts)", "day_of_week": "isodow(ts)", "hour_of_week": "(isodow(ts) - 1) * 24 + hour(ts)", "hour_sin": f"sin({circle})", "hour_cos": f"cos({circle})"}
    listed = ", ".join(f"round({names[n]}, 6) + 0e0 AS {n}" if lane == "numerical" else f"CAST({names[n]} AS BIGINT) AS {n}" for n, lane, *_ in recipe.definitions())
    return out, f'SELECT wr.row_index, "window", role, CAST(wr.click AS DOUBLE) AS click, {listed} FROM wr {" ".join(joins)}'
