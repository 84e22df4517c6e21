"""Exact substring removal by bucket refinement over suffix positions.

A byte goes if a ``WINDOW``-byte string that covers it also starts in a document with a
smaller doc_id. Windows are compared through buckets, as in suffix sorting by bucket
pointers: the first buckets are those of the ``Q``-byte strings at every position, and a
longer string's bucket is that of its first ``Q`` bytes refined by the buckets found at
later offsets of the same position. Nothing is sorted that is alone in its bucket:

1. Of each window only the smallest of its Q-byte buckets counts (its anchor). Neighbouring
   windows with the same anchor are one unit, identified inside the anchor's bucket by the
   buckets at its later offsets. Shards, by anchor, sort each bucket on those: equal units go
   from all documents but the smallest.
2. What is left of a unit in its smallest document, if its bucket fell apart, is refined once
   more, window by window, and sorted again inside the same bucket.

Buckets have 64-bit identifiers, made by doubling: that of 2k bytes from two of k bytes. Members
are only ever compared inside an anchor's bucket, so equal identifiers of unequal strings are
to be expected once in 2^64 pairs of one bucket, not of the whole table.

Blocks of documents are written to a table bucketed by block, so texts are not shuffled;
only packed arrays of buckets are, and each block sends a unit or window once, however often
it has it. The arrays that a shard returns have the order in which the block sent them.

Null and empty texts have no bytes. Texts shorter than the window never change; very long ones
are a block of their own. Rows of equal doc_id are one document's parts: none removes another's
bytes; so equal texts of one doc_id both stay. Rows without doc_id keep all bytes and remove
none. An empty table gives no rows. Other columns pass through under their own names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.blocks import blocked, pack_array, unpack_array
from tidemark.llm.common import release, table, text_bytes, written

WINDOW, Q = 50, 20
SPAN = WINDOW - Q + 1  # Q-byte strings of a window
SHARD_BYTES = 12 << 20
#: Bytes of text handled at a time.
STEP_BYTES = 1 << 20
UNITS, WINDOWS = 0, 1
#: Numbers of anchor buckets; unequal anchors that share one are told apart like unequal units.
ANCHOR_BUCKETS = 1 << 40
#: Low bits of a bucket that give way to the position; fixed, so that equal windows choose alike everywhere.
PLACE_BITS = np.uint64(32)
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M[1]
    return x ^ (x >> np.uint64(29))


def buckets(a: np.ndarray, q: int = Q) -> np.ndarray:
    """The bucket of the ``q`` bytes from each position (fewer positions than bytes), by doubling."""
    cur = (a.astype(np.uint64) + np.uint64(1)) * _M[3]
    cur ^= cur >> np.uint64(32)
    size, done, out, factor = 1, 0, None, _M[0]
    while True:
        if q & size:
            if out is None:
                out, done = cur, size
            else:
                n = len(a) - done - size + 1
                out = out[:n] * factor + cur[done : done + n]
                done += size
        if done == q:
            return mix(out)
        n = len(cur) - size
        cur = cur[:n] * factor + cur[size:]
        with np.errstate(over="ignore"):
            factor = factor * factor  # odd, as its root is
        size *= 2


class Part:
    """Units of some texts. Positions are in the texts' concatenation."""

    def __init__(self, texts: list[bytes], anchors: int = ANCHOR_BUCKETS):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        n = len(self.data)
        if n < WINDOW:
            self.lo = self.hi = self.row = np.zeros(0, np.int64)
            self.h = self.anchor = self.unit = np.zeros(0, np.uint64)
            return
        self.h = h = buckets(self.data)
        shift = PLACE_BITS
        place = (h & (~np.uint64(0) << shift)) | np.arange(len(h), dtype=np.uint64)
        low, size = place, 1
        while size * 2 <= SPAN:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if SPAN > size:
            low = np.minimum(low[: len(low) - (SPAN - size)], low[SPAN - size :])
        chosen = (low & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)  # each window's anchor
        new = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
        # windows must end inside their text: cut units at the texts' ends
        lo, hi = new, np.append(new[1:], len(chosen)) - 1
        row = np.searchsorted(self.starts, lo, "right") - 1
        crossing = np.flatnonzero(hi >= (self.starts + self.sizes)[row])  # units over a border of texts
        if len(crossing):
            more_lo, more_hi = [lo], [hi]
            cut_hi = hi.copy()
            for k in crossing:  # few: one or two for each text
                r = row[k]
                cut_hi[k] = self.starts[r] + self.sizes[r] - 1
                r += 1
                while r < len(self.sizes) and self.starts[r] <= hi[k]:
                    if self.sizes[r]:
                        more_lo.append([self.starts[r]])
                        more_hi.append([min(hi[k], self.starts[r] + self.sizes[r] - 1)])
                    r += 1
            more_hi[0] = cut_hi
            lo, hi = np.concatenate(more_lo).astype(np.int64), np.concatenate(more_hi).astype(np.int64)
            row = np.searchsorted(self.starts + self.sizes, lo, "right")
        last = (self.starts + self.sizes)[row] - WINDOW
        hi = np.minimum(hi, last)
        good = hi >= lo
        lo, hi, row = lo[good], hi[good], row[good]
        at = chosen[lo]
        self.lo, self.hi, self.row = lo, hi, row
        self.anchor = mix(h[at]) % np.uint64(anchors)
        refined = h[lo]
        with np.errstate(over="ignore"):
            for later in (h[lo + Q], h[hi + WINDOW - 2 * Q], h[hi + WINDOW - Q], ((hi - lo) * 64 + at - lo).astype(np.uint64)):
                refined = mix(refined * _M[0] + later)
        self.unit = refined

    def windows(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the units ``k``: each window's bucket inside its anchor's, start and unit."""
        n = self.hi[k] - self.lo[k] + 1
        unit = np.repeat(k, n)
        start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + self.lo[unit]
        refined = self.h[start]
        for later in (self.h[start + Q], self.h[start + WINDOW - Q]):
            refined = mix(refined * _M[0] + later)
        return refined, start, unit


def parts_of(f: pd.DataFrame, anchors: int, step: int):
    """The block's texts in order of doc_id, some at a time: (doc ids, Part)."""
    f = f[f["doc_id"].notna()].sort_values("doc_id", kind="stable")
    docs, texts, size, some = f["doc_id"].to_numpy(np.int64), f["text"].tolist(), 0, []
    first = 0
    for i, t in enumerate(texts):
        some.append((t or "").encode())
        size += len(some[-1])
        if size >= step or i == len(texts) - 1:
            yield docs[first : i + 1], Part(some, anchors)
            first, size, some = i + 1, 0, []


def distinct(columns: list[np.ndarray], doc: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct rows of the columns, with the smallest doc of each."""
    order = np.lexsort([doc, *columns[::-1]])
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return [c[new] for c in columns], doc[order][new]


def by_shard(shard: np.ndarray):
    """Index arrays of each shard, in order."""
    order = np.argsort(shard, kind="stable")
    return [x for x in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(x)]


class Sent:
    """What a block sends of one kind: distinct sorted keys; the same whenever computed."""

    def __init__(self, columns: list[list[np.ndarray]], docs: list[np.ndarray], shards: int):
        joined = [np.concatenate([np.zeros(0, np.uint64), *c]) for c in columns]
        self.columns, self.doc = distinct(joined, np.concatenate([np.zeros(0, np.int64), *docs]))
        self.parts = by_shard((self.columns[0] % np.uint64(shards)).astype(np.int64))
        self.shards = shards

    def rows(self, block: int, kind: int) -> list[tuple]:
        return [(block, int(self.columns[0][p[0]] % np.uint64(self.shards)), kind, *[pack_array(c[p]) for c in self.columns], pack_array(self.doc[p])) for p in self.parts]

    def answered(self, got: dict[int, np.ndarray], default: np.ndarray) -> np.ndarray:
        """The shards' answers in the order of the keys."""
        out = default.copy()
        for p in self.parts:
            shard = int(self.columns[0][p[0]] % np.uint64(self.shards))
            if shard in got:
                out[p] = got[shard]
        return out

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index among the keys of rows that are among them: the run of the anchor, then halving inside it."""
        lo, hi = (np.searchsorted(self.columns[0], a, side) for side in ("left", "right"))
        while (lo < hi).any():
            mid = (lo + hi) // 2
            low = (lo < hi) & (self.columns[1][np.minimum(mid, len(self.doc) - 1)] < b)
            lo, hi = np.where(low, mid + 1, lo), np.where(low, hi, mid)
        return lo


def refined(bucket: np.ndarray, later: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts each bucket's members on their identifier at later offsets: the smallest document of
    each member's new bucket, and whether the old one fell apart."""
    order = np.lexsort([doc, later, bucket])
    a, b, d = bucket[order], later[order], doc[order]
    new_a = np.append(True, a[1:] != a[:-1])
    new_b = new_a | np.append(True, b[1:] != b[:-1])
    old, new = np.cumsum(new_a) - 1, np.cumsum(new_b) - 1
    least, apart = np.empty(len(a), np.int64), np.empty(len(a), bool)
    least[order] = d[new_b][new]
    apart[order] = np.bincount(old, new_b)[old] > 1
    return least, apart


SENT = "block long, shard int, kind int, a binary, b binary, doc binary"


def frees(run):
    """``run`` of two arguments, after which the worker gives its memory back: it may idle while others work."""

    def both(x, y):
        out = run(x, y)
        release()
        return out

    return both


def remove(docs: DataFrame, shards: int | None = None, anchors: int = ANCHOR_BUCKETS, step: int = STEP_BYTES, as_string: bool = False) -> DataFrame:
    """The rows of ``docs`` (``doc_id, text``, others) without ``text``, with ``kept binary``
    (the bytes that are left; with ``as_string`` their text, without characters that a cut left
    incomplete), ``n_bytes, n_removed, n_spans``."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    total = text_bytes(docs)
    shards = shards or max(1, math.ceil(total / SHARD_BYTES))
    # other columns under names of their own, so that none clashes
    plain = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"other_{k}") for k, c in enumerate(others)])
    whole = blocked(plain, total)
    rows = whole.select("doc_id", "text", "block")

    def send_units(key, f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_units(list(parts_of(f, anchors, step)), shards).rows(int(key[0]), UNITS), columns=SENT_COLUMNS)

    def refine(key, f: pd.DataFrame) -> pd.DataFrame:
        columns = [[unpack_array(x) for x in f[c]] for c in ("a", "b", "doc")]
        least, apart = refined(*map(np.concatenate, columns))
        ends = np.cumsum([len(x) for x in columns[2]])[:-1]
        return pd.DataFrame(
            {
                "block": f["block"],
                "shard": key[0],
                "kind": f["kind"],
                "least": [pack_array(x) for x in np.split(least, ends)],
                "apart": [pack_array(x) for x in np.split(apart.astype(np.int64), ends)],
            }
        )

    def send_windows(f: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if not len(f):
            return pd.DataFrame(columns=SENT_COLUMNS)
        parts = list(parts_of(f, anchors, step))
        of, keys, docs_ = [], [], []
        for (ids, part), unclear in zip(parts, _unit_verdicts(parts, got, shards)[1], strict=True):
            w, _, unit = part.windows(unclear)
            of.append(part.anchor[unit])
            keys.append(w)
            docs_.append(ids[part.row[unit]])
        sent = Sent([of, keys], docs_, shards)
        return pd.DataFrame(sent.rows(int(f["block"].iloc[0]), WINDOWS), columns=SENT_COLUMNS)

    def cut(f: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        out = []
        lost, rest = f[f["doc_id"].isna()], f[f["doc_id"].notna()].sort_values("doc_id", kind="stable")
        for t in lost["text"]:
            raw = (t or "").encode()
            out.append((None, raw, len(raw), 0, 0))
        parts = list(parts_of(f, anchors, step))
        gone, unclear = _unit_verdicts(parts, got, shards)
        windows = [part.windows(k) for (_, part), k in zip(parts, unclear, strict=True)]
        owner = [ids[part.row[u]] for (ids, part), (_, _, u) in zip(parts, windows, strict=True)]
        of = [part.anchor[u] for (_, part), (_, _, u) in zip(parts, windows, strict=True)]
        sent = Sent([of, [w[0] for w in windows]], owner, shards)
        least = sent.answered(_by_shard(got, WINDOWS, "least"), sent.doc)
        for (ids, part), units, (w, start, _), own, anchor in zip(parts, gone, windows, owner, of, strict=True):
            edge = np.zeros(len(part.data) + 1, np.int64)
            np.add.at(edge, part.lo[units], 1)
            np.add.at(edge, part.hi[units] + WINDOW, -1)
            hit = start[least[sent.places(anchor, w)] < own] if len(w) else start
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + WINDOW, -1)
            covered = np.cumsum(edge[:-1]) > 0
            for doc, s, n in zip(ids.tolist(), part.starts.tolist(), part.sizes.tolist(), strict=True):
                c = covered[s : s + n]
                removed = int(c.sum())
                spans = int(np.count_nonzero(c[1:] & ~c[:-1]) + c[0]) if removed else 0
                out.append((doc, part.data[s : s + n][~c].tobytes() if removed else part.data[s : s + n].tobytes(), n, removed, spans))
        result = pd.DataFrame(out, columns=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])
        if as_string:
            result["kept"] = [b.decode("utf-8", "ignore") for b in result["kept"]]
        extra = pd.concat([lost, rest])[[c for c in f.columns if c.startswith("other_")]].reset_index(drop=True)
        return pd.concat([result.astype({"doc_id": "Int64"}), extra], axis=1)

    units = rows.groupBy("block").applyInPandas(frees(send_units), SENT)
    answers = written(units.groupBy("shard").applyInPandas(frees(refine), ANSWERS))
    windows = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(frees(send_windows), SENT)
    more = written(windows.groupBy("shard").applyInPandas(frees(refine), ANSWERS))
    result = whole.groupBy("block").cogroup(answers.unionByName(more).groupBy("block"))
    fields = "".join(f", other_{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(others))
    left = result.applyInPandas(frees(cut), f"doc_id long, kept {'string' if as_string else 'binary'}, n_bytes long, n_removed long, n_spans long{fields}")
    return left.select("doc_id", *[F.col(f"other_{k}").alias(c) for k, c in enumerate(others)], "kept", "n_bytes", "n_removed", "n_spans")


def as_text(kept):
    """The bytes as text; characters that a cut left incomplete go too."""

    @F.pandas_udf("string")
    def decoded(column: pd.Series) -> pd.Series:
        return column.map(lambda b: b.decode("utf-8", "ignore"), na_action="ignore")

    return decoded(kept)


SENT_COLUMNS = ["block", "shard", "kind", "a", "b", "doc"]
ANSWERS = "block long, shard int, kind int, least binary, apart binary"


def _units(parts: list, shards: int) -> Sent:
    return Sent([[p.anchor for _, p in parts], [p.unit for _, p in parts]], [ids[p.row] for ids, p in parts], shards)


def _by_shard(got: pd.DataFrame, kind: int, column: str) -> dict[int, np.ndarray]:
    return {int(s): unpack_array(a) for s, k, a in zip(got["shard"], got["kind"], got[column], strict=True) if k == kind}


def _unit_verdicts(parts: list, got: pd.DataFrame, shards: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each part: the units that go, and those whose windows must be looked at."""
    sent = _units(parts, shards)
    least = sent.answered(_by_shard(got, UNITS, "least"), sent.doc)
    apart = sent.answered(_by_shard(got, UNITS, "apart"), np.zeros(len(sent.doc), np.int64))
    gone, unclear = [], []
    for ids, p in parts:
        at = sent.places(p.anchor, p.unit)
        mine, own = least[at], ids[p.row]
        gone.append(np.flatnonzero(mine < own))
        unclear.append(np.flatnonzero((mine == own) & (apart[at] == 1)))
    return gone, unclear


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
ORACLES: dict[str, str] = {}
