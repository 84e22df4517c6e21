import hashlib
from fractions import Fraction

import pytest

from tidemark.llm import mixing

SCHEMA = "doc_id long, text string, source string, row string"


def brute(docs, weights=mixing.WEIGHTS, most=mixing.MOST):
    """(doc_id, size, target, taken) by fractions, one source after another."""
    sized = [(d, len((t or "").split()), s) for d, t, s, _ in docs]
    names = sorted({s for _, _, s in sized}, key=lambda s: (s is None, s))
    size = {n: sum(z for _, z, s in sized if s == n) for n in names}
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    full, total = set(), sum(size.values())
    while True:
        left, heft = total - sum(most * size[n] for n in full), sum(weight[n] for n in names if n not in full)
        above = {n for n in names if n not in full and weight[n] * left > most * size[n] * heft}
        if not above:
            break
        full |= above
    out = []
    for n in names:
        target = Fraction(most * size[n]) if n in full else Fraction(weight[n] * left, max(1, heft))
        ratio = int(target * mixing.ONE / size[n]) if size[n] else 0
        u = int(hashlib.md5(f"{mixing.SEED}-{'b' if n is None else 'a' + n}".encode()).hexdigest()[:8], 16)
        own = sorted((x for x in sized if x[2] == n), key=lambda x: (x[1], x[0] is not None, x[0] or 0))
        for k, (d, z, _) in enumerate(own):
            out.append((d, z, float(target), ((u + (k + 1) * ratio) // mixing.ONE - (u + k * ratio) // mixing.ONE) * z))
    return out


def run(spark, docs):
    rows = mixing.plan(spark.createDataFrame(docs, SCHEMA), mixing.word_count()).collect()
    return rows, [(r["row"]["doc_id"], r["size"], r["target"], r["copies"] * r["size"]) for r in rows]


def documents():
    docs = [(i, "w " * (1 + i * 7 % 50), f"s{i % 4}", "x") for i in range(300)]
    docs += [(1000 + i, "w\tw", "hot", None) for i in range(400)]
    docs += [(None, "a b", None, None), (None, "a b", None, None), (2000, None, "s1", None), (2001, "", "", None), (2002, "w " * 5000, "s2", None)]
    return docs + [(7, "the same row twice", "s0", "x")] * 2


def test_equals_brute_force(spark):
    docs = documents()
    rows, got = run(spark, docs)
    key = lambda x: (x[0] is None, x)
    assert sorted(got, key=key) == sorted(brute(docs), key=key)
    assert all(0 <= r["copies"] <= mixing.MOST for r in rows)
    assert sorted(run(spark, docs[::-1])[1], key=key) == sorted(got, key=key)


def test_taken_words_are_near_the_target(spark):
    docs = documents()
    rows, _ = run(spark, docs)
    for s in {d[2] for d in docs}:
        own = [r for r in rows if r["row"]["source"] == s]
        assert abs(sum(r["copies"] * r["size"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)


@pytest.mark.parametrize("docs", [[], [(1, None, None, None)], [(1, "", "a", None), (2, " \n", "b", None)], [(5, "one", "a", None)]])
def test_small_tables(spark, docs):
    rows, got = run(spark, docs)
    assert sorted(got) == sorted(brute(docs)) and len(rows) == len(docs)


def test_mixed_repeats_whole_rows(spark):
    docs = [(i, "w " * 9, "a" if i < 3 else "b", "r") for i in range(40)]
    out = mixing.mixed(spark.createDataFrame(docs, SCHEMA))
    assert out.columns == ["doc_id", "text", "source", "row"]
    assert [r["doc_id"] for r in out.orderBy("doc_id").collect() if r["source"] == "a"] == [0, 0, 0, 1, 1, 1, 2, 2, 2]


def test_registered_query_equals_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rows = mixing.QUERIES["op12_mixing"](spark, sf)
    want = con.execute(f"SELECT {', '.join(rows.columns)} FROM ({mixing.ORACLES['op12_mixing']})").fetchall()
    assert sorted(map(tuple, rows.collect())) == sorted(want)
