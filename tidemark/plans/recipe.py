"""Column roles and feature recipes; a recipe compiles to an ordered, checked contract."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Roles:
    """Which columns of a log play which part."""

    time: str = "hour_no"
    order: str = "row_index"
    label: str = "click"
    site: str = "site_id"
    device: str = "device_id"
    address: str = "device_ip"
    model: str = "device_model"
    no_site: str = "S_APP"
    no_device: str = "D_UNKNOWN"


@dataclass(frozen=True)
class Bucket:
    name: str
    source: str
    boundaries: tuple[float, ...]
    log_scale: bool = False


@dataclass(frozen=True)
class History:
    key: str
    within_hour: bool = True
    clicks: bool = True
    pattern_bits: int = 4


@dataclass(frozen=True)
class Target:
    columns: tuple[str, ...] = ("site_id", "app_id")
    blocks: int = 4
    smoothing: float = 20.0
    clip: float = 1e-4


@dataclass(frozen=True)
class Recipe:
    raw: tuple[str, ...] = ("banner_pos", "site_id", "app_id", "device_model", "device_conn_type", "C14", "C17", "C20", "C21")
    context: tuple[str, ...] = ("inventory_type", "publisher_id", "publisher_domain", "publisher_category")
    crosses: tuple[tuple[str, tuple[str, ...]], ...] = (("ip_model", ("device_ip", "device_model")), ("ip_model_site", ("ip_model", "site_id")))
    frequency: tuple[str, ...] = ("device_ip", "user_id")
    distinct: tuple[tuple[str, str, str], ...] = (("device_ip_apps", "device_ip", "app_id"), ("user_sites", "user_id", "site_id"))
    buckets: tuple[Bucket, ...] = (Bucket("device_ip_frequency_bucket", "device_ip_frequency_log1p", (2.0, 10.0, 50.0, 200.0), True),)
    history: tuple[History, ...] = (History("user_id"),)
    target: Target = field(default_factory=Target)
    minimum_count: int = 2
    maximum_vocabulary: int = 1_000_000

    def definitions(self) -> list[tuple[str, str, str, tuple[str, ...], bool]]:
        """(name, lane, family, inputs, uses_labels) in the order of the output."""
        cat = lambda n, family, inputs, labels=False: (n, "categorical", family, tuple(inputs), labels)
        num = lambda n, family, inputs, labels=False: (n, "numerical", family, tuple(inputs), labels)
        labelled = {f"{c}_target_logit_lift" for c in self.target.columns} | {f"{h.key}_prior_clicks_log1p" for h in self.history}
        rows = [cat(c, "raw", [c]) for c in self.raw]
        rows += [cat(c, "time", ["hour"]) for c in ("hour_of_day", "day_of_week", "hour_of_week")]
        rows += [cat(c, "context", ["site_id", c]) for c in self.context]
        rows += [cat(n, "cross", parts) for n, parts in self.crosses]
        rows += [cat(b.name, "bucket", [b.source], b.source in labelled) for b in self.buckets]
        rows += [cat(f"{h.key}_click_pattern", "history", [h.key, "click", "hour"], True) for h in self.history if h.clicks and h.pattern_bits]
        rows += [num(c, "time", ["hour"]) for c in ("hour_sin", "hour_cos")]
        rows += [num(f"{c}_frequency_log1p", "frequency", [c]) for c in self.frequency]
        rows += [num(n, "distinct", [k, v]) for n, k, v in self.distinct]
        for h in self.history:
            rows += [num(f"{h.key}_{n}_log1p", "history", [h.key, "hour"]) for n in ("prior_impressions", "hours_since_previous") + (("prior_in_hour",) if h.within_hour else ())]
            if h.clicks:
                names = ("prior_clicks_log1p", "prior_nonclicks_log1p", "prior_ctr_lift", "hours_since_click_log1p", "impressions_since_click_log1p")
                rows += [num(f"{h.key}_{n}", "history", [h.key, "click", "hour"], True) for n in names]
        for c in self.target.columns:
            rows += [num(f"{c}_target_logit_lift", "target", [c, "click", "hour"], True), num(f"{c}_target_evidence_log1p", "target", [c, "click", "hour"], True)]
        names = [r[0] for r in rows]
        if len(set(names)) < len(names):
            raise ValueError(f"features repeat: {sorted({n for n in names if names.count(n) > 1})}")
        return rows

    def lookups(self, transductive: bool = False) -> dict[str, tuple[tuple[str, ...], tuple[str, ...], bool, str]]:
        """The lookups that the features ask for: name -> (keys, outputs, uses_labels, sources)."""
        out: dict[str, tuple[tuple[str, ...], tuple[str, ...], bool, str]] = {}
        for name, _, family, inputs, _ in self.definitions():
            key = inputs[0]
            if family in ("raw", "context", "cross"):
                out[f"vocabulary {name}"] = ((name,), (f"{name}__id",), False, "training")
            elif family in ("frequency", "distinct"):
                before = out.get(f"covariate {key}", ((), ()))[1]
                added = f"{key}__frequency" if family == "frequency" else f"{name}__raw"
                out[f"covariate {key}"] = ((key,), (*before, added), False, "training, scoring" if transductive else "training")
            elif family == "target":
                out[f"target {key}"] = ((key,), ("positive", "n"), True, "training")
                out[f"temporal target {key}"] = ((key, "block"), ("previous_positive", "previous_count", "prior_count", "block_prior"), True, "training")
        return out

    def contract(self, spark: SparkSession) -> DataFrame:
        """The lineage as rows ``position, name, lane, family, inputs, uses_labels``."""
        rows = [(i, *d[:3], ",".join(d[3]), d[4]) for i, d in enumerate(self.definitions())]
        return spark.createDataFrame(rows, "position int, name string, lane string, family string, inputs string, uses_labels boolean")
