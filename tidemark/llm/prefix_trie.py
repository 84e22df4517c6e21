"""A prefix trie of conversations, totalled by time-forward processing.

Rebuilt conversations share their first turns. A node is a distinct sequence of first turns and is
named by its depth and two sums over its turns' 60-bit hashes times powers of a base, modulo
2**61 - 1; sums of stretches add up, so that a long conversation is spread over many tasks.

Nodes of at most ``FAN`` conversations below a node of more are a shard, a whole subtree; the nodes
above it of at most ``FAN``**2 conversations form shards in turn, up to the root. In a shard, nodes
are sorted by level, the deepest first, and each sends its subtree's totals forward to its parent
through a priority queue in the same order. The totals of shard roots are summed up by parent and
enter the shards above. A queue holds the children of one level, ``FAN`` at most but for the last
round's; from ``QUEUE_ROWS`` on it spills sorted, packed runs. Nodes of one conversation are not
sent: they have one leaf and save nothing.

Cases: rows without ``conv_id`` belong to no conversation and are left out; null role and text
count as empty; turns of equal number follow each other by the MD5 of role and text, and equal rows
each count; a conversation without turns of its own left is its head alone, without a head it ends
at the root; an empty table gives no nodes; very long texts count by their hash and length; other
columns are never read.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table, written

BLOCK, HEADS = 100, 6
#: Conversations below a shard's root, at most; the next round's shards have so many times more.
FAN = 4096
#: Messages that a queue holds unpacked.
QUEUE_ROWS = 50_000
PRIME, BASES = (1 << 61) - 1, (1_000_003, 998_244_353)
NODE = ["depth", "k1", "k2"]
EMPTY = hashlib.sha256(b"").hexdigest()


def ranked(conversations: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Turns with ``rank``, their place in the conversation: ``conv, part, rank, mark, chars`` and ``keep``.

    Turns lie in ranges of (conversation, turn); ranks are counts of a conversation's turns in
    earlier ranges and places inside the own.
    """
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    mark = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").alias("conv"), "turn", mark.alias("mark"), F.length(text).cast("long").alias("chars"), *keep)
    rows = written(rows.repartitionByRange(n, F.col("conv"), F.asc_nulls_first("turn"), F.col("mark")).withColumn("part", F.spark_partition_id()))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part")) - F.col("n")
    starts = rows.groupBy("conv", "part").agg(F.count("*").alias("n")).select("conv", "part", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("conv", "part").orderBy(F.asc_nulls_first("turn"), "mark")) - 1
    return written(rows.withColumn("place", place).join(starts, ["conv", "part"]).select("conv", "part", (F.col("before") + F.col("place")).alias("rank"), "mark", "chars", *keep))


def rebuilt(conversations: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Turns of rebuilt conversations ``conv, part, pos, mark, chars`` (and ``keep``), and all conversations ``conv``."""
    turns = ranked(conversations, keep)
    # an own stretch knows how many turns to leave out (h) and how many stand before it (m)
    segments = turns.groupBy("conv", "part").agg(F.max("rank").alias("last"))
    own = segments.groupBy("conv").agg((F.max("last") + 1).alias("n"))
    sized = own.withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).withColumn("root", F.col("conv") - F.col("conv") % BLOCK)
    roots = own.filter(F.col("conv") % BLOCK == 0).select(F.col("conv").alias("root"), F.col("n").alias("most"))
    sized = written(sized.join(roots, "root", "left").withColumn("m", F.least("h", F.coalesce("most", F.lit(0)))).select("conv", "h", "root", "m"))
    heads = turns.filter((F.col("rank") < HEADS - 1) & (F.col("conv") % BLOCK == 0)).select(F.col("conv").alias("root"), F.col("rank").alias("pos"), "mark", "chars", *keep)
    first = sized.join(heads, "root").filter(F.col("pos") < F.col("h")).select("conv", F.lit(-1).alias("part"), "pos", "mark", "chars", *keep)
    shifts = segments.select("conv", "part").join(sized.select("conv", "h", "m"), "conv")
    rest = turns.join(shifts, ["conv", "part"]).filter(F.col("rank") >= F.col("h"))
    rest = rest.select("conv", "part", (F.col("rank") - F.col("h") + F.col("m")).alias("pos"), "mark", "chars", *keep)
    return first.unionByName(rest), sized.select("conv")


def rebuilt_texts(conversations: DataFrame) -> DataFrame:
    """``conv_id, depth, role, text`` of all rebuilt turns: a node's last turn is its conv_id's at its depth."""
    turns, _ = rebuilt(conversations, ("role", "text"))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return turns.select(F.col("conv").alias("conv_id"), (F.col("pos") + 1).alias("depth"), blank("role"), blank("text"))


def _terms(batches):
    """Each turn's hashes times the bases' powers."""
    for batch in batches:
        pos, marks = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        t = [[int(m[16 * i : 16 * i + 15], 16) * pow(b, p, PRIME) % PRIME for p, m in zip(pos, marks, strict=True)] for i, b in enumerate(BASES)]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in (0, 1, 2, 4)], *[pa.array(x, pa.int64()) for x in t]], names=["conv", "part", "pos", "chars", "t1", "t2"])


def paths(turns: DataFrame) -> DataFrame:
    """For each conversation and depth from 1 on its node ``depth, k1, k2`` and that one's parent ``q1, q2``."""
    terms = written(turns.select("conv", "part", "pos", "mark", "chars").mapInArrow(_terms, "conv long, part int, pos long, chars long, t1 long, t2 long"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    mod = lambda x: F.pmod(x, F.lit(PRIME).cast("decimal(20,0)")).cast("long")
    sums = terms.groupBy("conv", "part").agg(*[mod(F.sum(wide(c))).alias(f"s{c}") for c in ("t1", "t2")])
    w = Window.partitionBy("conv").orderBy("part")
    carried = sums.select("conv", "part", *[mod(F.sum(wide(f"st{i}")).over(w) - wide(f"st{i}")).alias(f"c{i}") for i in (1, 2)])
    inside = Window.partitionBy("conv", "part").orderBy("pos")
    rows = terms.withColumns({f"r{i}": F.sum(wide(f"t{i}")).over(inside) for i in (1, 2)}).join(carried, ["conv", "part"])
    key = [mod(F.col(f"r{i}") + wide(f"c{i}")).alias(f"k{i}") for i in (1, 2)]
    above = [mod(F.col(f"r{i}") - wide(f"t{i}") + wide(f"c{i}")).alias(f"q{i}") for i in (1, 2)]
    return written(rows.select("conv", (F.col("pos") + 1).alias("depth"), "chars", *key, *above))


class Queue:
    """Messages ``(-depth, k1, k2, leaves, saved)`` in order; beyond ``rows`` they are kept in sorted, packed runs."""

    def __init__(self, rows: int = QUEUE_ROWS):
        self.rows, self.heap, self.runs = rows, [], []

    def push(self, message: tuple[int, int, int, int, int]) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.rows:
            self.heap.sort()
            packed = [zlib.compress(b"".join(struct.pack("<5q", *m) for m in self.heap[i : i + 4096]), 1) for i in range(0, len(self.heap), 4096)]
            run = self._read(packed)
            self.runs.append([next(run), run])
            self.heap = []

    @staticmethod
    def _read(packed: list[bytes]):
        packed.reverse()
        while packed:
            yield from struct.iter_unpack("<5q", zlib.decompress(packed.pop()))

    def pop(self, node: tuple[int, int, int]) -> tuple[int, int]:
        """Takes out the messages to the node, which is the next, and returns their sums."""
        leaves = saved = 0
        while self.heap and self.heap[0][:3] == node:
            m = heapq.heappop(self.heap)
            leaves, saved = leaves + m[3], saved + m[4]
        for run in [r for r in self.runs if r[0][:3] == node]:
            while run[0] is not None and run[0][:3] == node:
                leaves, saved = leaves + run[0][3], saved + run[0][4]
                run[0] = next(run[1], None)
            if run[0] is None:
                self.runs.remove(run)
        return leaves, saved

    def __bool__(self) -> bool:
        return bool(self.heap or self.runs)


_SENT = "depth long, k1 long, k2 long, q1 long, q2 long, top boolean, leaves long, saved long"


def climbed(nodes: DataFrame) -> DataFrame:
    """Subtree totals of shards. nodes: ``s0, s1, s2`` (the shard's root), ``depth, k1, k2, q1, q2, leaves, saved``; ``top``: of the root."""
    shard = ["s0", "s1", "s2"]
    rows = nodes.select(*shard, *NODE, "q1", "q2", "leaves", "saved").repartition(*shard).sortWithinPartitions(*shard, F.desc("depth"), "k1", "k2")

    def climb(batches):
        now, queue = None, Queue()
        for batch in batches:
            out = []
            for s0, s1, s2, depth, k1, k2, q1, q2, leaves, saved in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (s0, s1, s2) != now:
                    if queue:
                        raise RuntimeError("a message has found no node")
                    now = s0, s1, s2
                a, b = queue.pop((-depth, k1, k2))
                leaves, saved, top = leaves + a, saved + b, (depth, k1, k2) == now
                if not top:
                    queue.push((1 - depth, q1, q2, leaves, saved))
                out.append((depth, k1, k2, q1, q2, top, leaves, saved))
            if out:
                kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[f.split()[0] for f in _SENT.split(", ")])

    return written(rows.mapInArrow(climb, _SENT))


def _hashes(batches):
    """SHA-256 of each node's chunks, which come in order."""
    now, digest = None, None
    for batch in batches:
        out = []
        for depth, k1, k2, _, chunk in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (depth, k1, k2) != now:
                if now:
                    out.append((*now, digest.hexdigest()))
                now, digest = (depth, k1, k2), hashlib.sha256(chunk.encode())
            else:
                digest.update(b"," + chunk.encode())
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip([*NODE, "ends_sha256"], o, strict=True)) for o in out])
    if now:
        yield pa.RecordBatch.from_pylist([dict(zip([*NODE, "ends_sha256"], (*now, digest.hexdigest()), strict=True))])


def ends(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """``depth, k1, k2, ends_sha256`` of the nodes where conversations end; their ids meet as sorted chunks."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = rows.groupBy("conv").agg(F.max(F.struct(*NODE)).alias("e"))
    zero = F.lit(0).cast("long")
    at = convs.join(last, "conv", "left").select(*[F.coalesce(f"e.{c}", zero).alias(c) for c in NODE], "conv")
    parts = at.repartitionByRange(n, *NODE, "conv").withColumn("part", F.spark_partition_id())
    chunk = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    chunks = parts.groupBy(*NODE, "part").agg(chunk.alias("chunk"))
    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "part").mapInArrow(_hashes, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(conversations: DataFrame, fan: int = FAN) -> DataFrame:
    """A row for each node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    turns, convs = rebuilt(conversations)
    rows = paths(turns)
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in NODE], "conv_id", "n_convs", zero.alias("chars"), F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q2"))
    nodes = rows.groupBy(*NODE).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), *[F.max(c).alias(c) for c in ("chars", "q1", "q2")])
    nodes = written(nodes.unionByName(root))
    parent = [(F.col("depth") - 1).alias("depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2")]
    kids = nodes.filter("depth > 0").select(*parent, "n_convs").groupBy(*NODE).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("singles"))
    kids = nodes.join(kids, NODE, "left").withColumns({c: F.coalesce(c, zero) for c in ("n_children", "singles")})
    kids = written(kids)
    shared = kids.filter("n_convs > 1").withColumn("leaves", F.col("singles") + (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("chars"))
    whole = nodes.agg(F.max("n_convs")).first()[0] or 0
    low, high, done = 1, fan, []
    while low < whole:
        own = shared.filter((F.col("n_convs") > low) & (F.col("n_convs") <= high))
        if high >= whole:
            own = own.withColumns({s: zero for s in ("s0", "s1", "s2")})
        else:
            heavy = nodes.filter(F.col("n_convs") > high).select(*NODE)
            tops = rows.join(heavy, NODE, "left_anti").groupBy("conv").agg(F.min(F.struct(*NODE)).alias("s"))
            own = own.join(tops.select(F.col("conv").alias("conv_id"), F.col("s.depth").alias("s0"), F.col("s.k1").alias("s1"), F.col("s.k2").alias("s2")), "conv_id")
        if done:
            sent = done[0]
            for f in done[1:]:
                sent = sent.unionByName(f)
            sums = sent.filter("top").select(*parent, "leaves", "saved").groupBy(*NODE).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
            own = own.join(sums, NODE, "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", zero) for c in ("leaves", "saved")})
        done.append(climbed(own))
        low, high = high, high * fan
    out = kids
    if done:
        totals = done[0]
        for f in done[1:]:
            totals = totals.unionByName(f)
        out = out.join(totals.select(*NODE, "leaves", "saved"), NODE, "left")
    else:
        out = out.withColumns({"leaves": F.lit(None).cast("long"), "saved": F.lit(None).cast("long")})
    above = nodes.select(*[F.col(c).alias(f"p_{c}") for c in NODE], F.col("conv_id").alias("parent_conv_id"))
    out = out.join(ends(rows, convs), NODE, "left").join(above, (F.col("depth") - 1 == F.col("p_depth")) & (F.col("q1") == F.col("p_k1")) & (F.col("q2") == F.col("p_k2")), "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("saved", zero).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


# CRC-32 of decimal digits, bit by bit
_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda x, y: list_reduce(list_prepend(xor(x, y), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1))))"
_SQL = f"""WITH RECURSIVE t AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, mark) - 1 AS r, mark, chars
 FROM (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS mark, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL)),
c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % {BLOCK} AS root, xor({_CRC}, 4294967295) % {HEADS} AS h FROM (SELECT DISTINCT conv_id FROM t)),
x AS MATERIALIZED (SELECT c.conv_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY own, r) AS d, mark, chars FROM (
 SELECT c.conv_id, 0 AS own, r, mark, chars FROM c JOIN t ON t.conv_id = root AND r < h UNION ALL SELECT c.conv_id, 1, r, mark, chars FROM c JOIN t USING (conv_id) WHERE r >= h) AS c),
p AS MATERIALIZED (SELECT conv_id, 0::BIGINT AS d, '' AS k, CAST(NULL AS VARCHAR) AS q, 0::BIGINT AS chars FROM c UNION ALL
 SELECT x.conv_id, x.d, md5(p.k || x.mark), p.k, x.chars FROM p JOIN x ON x.conv_id = p.conv_id AND x.d = p.d + 1),
n AS MATERIALIZED (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars, max(q) AS q FROM p GROUP BY k, d),
e AS (SELECT k, d, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM p WHERE (conv_id, d) IN (SELECT conv_id, max(d) FROM p GROUP BY 1) GROUP BY k, d),
g AS (SELECT q AS k, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
s AS (SELECT a.k, a.d, count(*) FILTER (g.k IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved FROM n LEFT JOIN g ON g.k = n.k AND g.d = n.d
 JOIN p AS a ON a.conv_id = n.conv_id AND a.d <= n.d GROUP BY a.k, a.d)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends, '{EMPTY}') AS ends_sha256
FROM n JOIN s ON s.k = n.k AND s.d = n.d LEFT JOIN g ON g.k = n.k AND g.d = n.d LEFT JOIN e ON e.k = n.k AND e.d = n.d LEFT JOIN n u ON u.k = n.q AND u.d = n.d - 1"""

QUERIES = {"op11_prefix_trie": op11_prefix_trie}
ORACLES = {"op11_prefix_trie": _SQL}
