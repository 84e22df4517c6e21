import hashlib
import zlib

import numpy as np
import pytest

from tidemark.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, parent_conv_id string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = {}
    for c, turn, role, text, _ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h, root = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(root, [])[:h] + ts[h:])
    members = {}
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in members)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(whole[c]) == len(p)))
        children = sum(len(q) == len(p) + 1 for q in below)
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **options):
    df = P.trie(spark.createDataFrame(rows, SCHEMA).repartition(7), **options)
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


def conversations(seed=1, n=150):
    g = np.random.default_rng(seed)
    rows = []
    for c in [*range(n), 200, 203, 250, 1301, -5, -100, 10**15]:
        for t in range(int(g.integers(1, 9))):
            rows.append((c, t, ["user", "assistant", None][t % 3], ["hi", "yes é", "", None, "why?"][int(g.integers(5)) if g.random() < 0.5 else 0], "x"))
    rows += [(c, t, "user", f"turn {t}", None) for c in (301, 302) for t in range(60)]  # long copies
    rows += [(c, 0, "user", "the same", None) for c in range(2000, 2090)]  # a group of copies
    rows += [(5, None, "system", "first", None), (5, None, "system", "first", None), (5, 2, "user", "a tie", None), (5, 2, "user", "another", None), (None, 0, "user", "of none", None)]
    return rows


@pytest.mark.parametrize("fan", [2, 3, 10, 4096])
def test_equals_brute_force(spark, fan):
    rows = conversations()
    assert got(spark, rows, fan=fan) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "a", "b", None)], [(7, None, None, None, None)], [(1, 0, "u", "x", None)] * 3, [(9, 0, "u", "long " * 200000, None), (8, 0, "u", "long " * 200000, None)]])
def test_small_tables(spark, rows):
    assert got(spark, rows) == brute(rows)


def test_a_conversation_without_turns_ends_at_the_root(spark):
    rows = [(c, 0, "u", "only", None) for c in range(401, 430)]  # their root is absent
    out = got(spark, rows)
    assert out == brute(rows) and [r for r in out if r[1] == 0][0][7] != P.EMPTY


def test_queue_spills_and_keeps_the_order():
    g = np.random.default_rng(2)
    messages = [(int(-d), int(k), 0, 1, int(s)) for d, k, s in zip(g.integers(1, 5, 3000), g.integers(0, 40, 3000), g.integers(0, 9, 3000), strict=True)]
    queue = P.Queue(100)
    for m in messages:
        queue.push(m)
    assert len(queue.runs) > 20
    for node in sorted({m[:3] for m in messages}):
        same = [m for m in messages if m[:3] == node]
        assert queue.pop(node) == (len(same), sum(m[4] for m in same))
    assert not queue


def test_hashes_of_chunks_are_those_of_the_whole(spark):
    convs = spark.range(1, 5001).selectExpr("id AS conv")
    none = spark.createDataFrame([], "conv long, depth long, k1 long, k2 long")
    out = P.ends(none, convs).collect()
    assert [r["ends_sha256"] for r in out] == [hashlib.sha256(",".join(map(str, range(1, 5001))).encode()).hexdigest()]


def test_texts_of_rebuilt_turns(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA)
    texts = P.rebuilt_texts(df)
    assert texts.columns == ["conv_id", "depth", "role", "text"]
    nodes = P.trie(df).filter("depth > 0")
    assert nodes.join(texts, ["conv_id", "depth"]).count() == nodes.count()


def test_registered_query_equals_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    df = P.QUERIES["op11_prefix_trie"](spark, sf)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({P.ORACLES['op11_prefix_trie']})").fetchall(), key=str)
