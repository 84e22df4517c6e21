"""Toxicity by a factorization machine over hashed terms.

A document's terms are its distinct words and their beginnings (4, 5 and 6 letters), hashed
to ``BUCKETS``. Terms that tell the labels apart are chosen by their G statistic; a bias, a
weight for each chosen term and a vector for each, whose products weigh every pair of terms,
are fitted by Adam on the logistic loss. So a pair may matter more than its two parts.

The fit reads at most ``MAX_EACH`` labelled rows of each class (lowest hashes of doc_id),
in one task; a row counts as many times as its class has labelled rows for each sampled one,
so the class ratio learnt is that of all labels. ``MAX_TERMS`` is the model's size: terms with
a smaller G than so many others (of equal G: with a larger hash) have no weight and no pairs.
The model goes to every worker. Scoring reads every whole text, however long, and nothing
else. Null or empty texts and texts without a chosen term get the bias alone; without any
labels, or labels of known documents, all scores are 0.5. Repeated rows score alike, an empty
table gives no rows, and other columns pass through.
"""

from __future__ import annotations

import string
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import release, table, written

BUCKETS, BEGINNINGS = 1 << 22, (4, 5, 6)
MAX_EACH, MAX_TERMS, LEAST_G, LEAST_ROWS = 8000, 8192, 12.0, 3
FACTORS, ROUNDS, PATIENCE, RATE, DECAY, SEED = 8, 250, 15, 0.05, 2e-5, 7
#: Words whose terms a worker remembers.
MAX_KNOWN = 300_000
EDGES = string.punctuation + "¿¡«»“”„‘’…–—·"


def buckets(word: str) -> list[int]:
    """Hashed terms of one word."""
    w = word.strip(EDGES)
    if not w:
        return []
    return [zlib.crc32(t.encode()) % BUCKETS for t in {"=" + w, *(w[:n] for n in BEGINNINGS if len(w) >= n)}]


def term_rows(docs: DataFrame) -> DataFrame:
    """``toxic, weight, buckets array<int>`` of every row of ``text, toxic, weight``."""

    def run(frames):
        for f in frames:
            found = [sorted({b for w in set((t or "").lower().split()) for b in buckets(w)}) for t in f["text"]]
            yield pd.DataFrame({"toxic": f["toxic"], "weight": f["weight"], "buckets": found})

    return docs.select("text", "toxic", "weight").mapInPandas(run, "toxic int, weight double, buckets array<int>")


def chosen_terms(rows: DataFrame) -> DataFrame:
    """The terms with the highest G statistic of presence against label, ``MAX_TERMS`` at most."""
    n = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("p"))
    counts = rows.select("toxic", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("c"), F.sum("toxic").alias("a"))
    counts = counts.filter(F.col("c") >= LEAST_ROWS).withColumns({"n": n.select("n").scalar(), "p": n.select("p").scalar()})

    def part(seen: Column, row: Column, column: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen * F.col("n") / (row * column))).otherwise(0.0)

    a, c, n_, p = (F.col(x).cast("double") for x in ("a", "c", "n", "p"))
    g = 2 * (part(a, c, p) + part(c - a, c, n_ - p) + part(p - a, n_ - c, p) + part(n_ - p - c + a, n_ - c, n_ - p))
    return counts.select("bucket", g.alias("g")).filter(F.col("g") >= LEAST_G).orderBy(F.desc("g"), "bucket").limit(MAX_TERMS)


def fit_machine(rows: list[np.ndarray], y: np.ndarray, size: int, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and vectors; rows: each document's distinct term numbers.

    Rows of equal terms and label count once, with the sum of their weights. A fifth of them is
    not learnt from; what did best on it is kept, and the fit ends when ``PATIENCE`` rounds
    have not done better by a thousandth, or after ``ROUNDS``.
    """
    groups: dict[tuple[bytes, float], float] = {}
    for r, label, n in zip(rows, y.tolist(), weight.tolist(), strict=True):
        key = (r.astype(np.int64).tobytes(), label)
        groups[key] = groups.get(key, 0.0) + n
    rows = [np.frombuffer(k, np.int64) for k, _ in groups]
    y, share = np.array([v for _, v in groups]), np.array([*groups.values()], float) / max(1.0, float(weight.sum()))
    rng = np.random.default_rng(SEED)
    aside = rng.random(len(y)) < 0.2
    v, w, b = rng.normal(0, 0.02, (size, FACTORS)), np.zeros(size), 0.0
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    term = np.concatenate(rows) if len(doc) else np.zeros(0, np.int64)
    order = np.argsort(term, kind="stable")
    by_term, has = doc[order], np.bincount(term, minlength=size) > 0
    first = np.searchsorted(term[order], np.flatnonzero(has))
    filled = np.array([len(r) > 0 for r in rows], bool)
    begin = np.searchsorted(doc, np.flatnonzero(filled))
    moments = [[0.0, 0.0] for _ in range(3)]

    def step(k: int, x, grad, t: int):
        m = moments[k]
        m[0], m[1] = 0.9 * m[0] + 0.1 * grad, 0.999 * m[1] + 0.001 * grad**2
        return x - RATE * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8)

    best, since, kept = np.inf, 0, (b, w, v)
    for t in range(1, ROUNDS + 1):
        s, squares, linear = np.zeros((len(rows), FACTORS)), np.zeros(len(rows)), np.zeros(len(rows))
        if len(doc):
            norms = (v**2).sum(1)
            s[filled] = np.add.reduceat(v[term], begin)
            squares[filled] = np.add.reduceat(norms[term], begin)
            linear[filled] = np.add.reduceat(w[term], begin)
        z = b + linear + 0.5 * ((s**2).sum(1) - squares)
        losses = share * np.logaddexp(0, np.where(y > 0, -z, z))
        loss = float(losses[aside].sum() if aside.any() else losses.sum())
        best, since, kept = (loss, 0, (b, w, v)) if loss < best * 0.999 else (best, since + 1, kept)
        if since >= PATIENCE:
            break
        e = np.where(aside, 0.0, share) * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gw, gv = np.zeros(size), np.zeros((size, FACTORS))
        if len(doc):
            es = e[:, None] * s
            gw[has] = np.add.reduceat(e[by_term], first)
            gv[has] = np.add.reduceat(es[by_term], first) - v[has] * gw[has, None]
        b, w, v = step(0, b, e.sum(), t), step(1, w, gw + DECAY * w, t), step(2, v, gv + 10 * DECAY * v, t)
    b, w, v = kept
    return float(b), w, v


def fit(labelled: DataFrame) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Model from rows ``doc_id, text, toxic, weight``: bias, chosen buckets, weights, vectors."""
    rows = written(term_rows(labelled))
    terms = np.array(sorted(r["bucket"] for r in chosen_terms(rows).collect()), np.int64)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("key")
        sets = [np.asarray(x, np.int64) for x in f["buckets"]]
        at = [np.searchsorted(terms, x) for x in sets]
        keep = [a[(a < len(terms)) & (terms[np.minimum(a, len(terms) - 1)] == x)] if len(terms) else a[:0] for a, x in zip(at, sets, strict=True)]
        b, w, v = fit_machine(keep, f["toxic"].to_numpy(float), len(terms), f["weight"].to_numpy(float))
        table = np.column_stack([w, v])
        return pd.DataFrame({"place": np.arange(-1, len(terms)), "values": [[b], *table.tolist()]})

    # the bounded sample in one task; the order of its rows is made the same in each run
    sample = rows.withColumn("key", F.xxhash64("buckets", "toxic"))
    fitted = sample.groupBy(F.lit(0).alias("all")).applyInPandas(run, "place int, values array<double>").collect()
    # sorted here: a sort in Spark would run the fit once more to find its ranges
    fitted.sort(key=lambda r: r["place"])
    if not fitted:
        return 0.0, terms[:0], np.zeros(0), np.zeros((0, FACTORS))
    values = np.array([r["values"] for r in fitted[1:]]).reshape(len(terms), 1 + FACTORS)
    return fitted[0]["values"][0], terms, values[:, 0], values[:, 1:]


def bounded_sample(labels: DataFrame) -> DataFrame:
    """At most ``MAX_EACH`` labelled rows of each class, chosen by hash; ``weight``: labelled rows of the class for each."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).distinct()
    each = [usable.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_EACH) for k in (0, 1)]
    counts = usable.groupBy("toxic").agg(F.greatest(F.count("*") / MAX_EACH, F.lit(1.0)).alias("weight"))  # two rows
    return each[0].unionByName(each[1]).join(F.broadcast(counts), "toxic").select("doc_id", "toxic", "weight")


def train(docs: DataFrame, labels: DataFrame):
    """Fits on labelled documents: ``docs`` (doc_id, text), ``labels`` (doc_id, toxic)."""
    sample = bounded_sample(labels)  # 2 * MAX_EACH rows of three numbers
    return fit(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))


def score(docs: DataFrame, model, into: str = "score") -> DataFrame:
    """The rows of ``docs`` with a column ``into`` between 0 and 1, in place of one of that name."""
    docs = docs.drop(into)
    b, terms, w, v = model
    shared = docs.sparkSession.sparkContext.broadcast((b, {int(t): k for k, t in enumerate(terms)}, w, v))
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        release()
        bias, place, weight, vectors = shared.value
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            out = []
            for t in batch.column(at).to_pylist():
                found: set[int] = set()
                for word in (t or "").lower().split():
                    hit = known.get(word)
                    if hit is None:
                        hit = known[word] = tuple(place[x] for x in buckets(word) if x in place)
                    if hit:
                        found.update(hit)
                if len(known) > MAX_KNOWN:
                    known.clear()
                k = sorted(found)
                own = vectors[k]
                z = bias + weight[k].sum() + 0.5 * ((own.sum(0) ** 2).sum() - (own**2).sum())
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, into])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, `{into}` double")


def _fold(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(_fold(5) != 0))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES: dict[str, str] = {}
