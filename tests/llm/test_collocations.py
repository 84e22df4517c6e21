import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import collocations as C

SCHEMA = "lang string, text string, extra string"


def brute(docs, minimum, overlap=C.OVERLAP, most=C.TOP):
    counts, sizes = {}, Counter()
    for lang, text, _ in docs:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            sizes[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: n for p, n in f.items() if len(p) > 1 and n >= minimum}
        rows = []
        for p, a in found.items():
            longer = [n for q, n in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * n >= overlap * a for n in longer):
                continue
            s, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(rows)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -s))
    return sorted(out)


def got(spark, docs, **options):
    df = C.collocations(spark.createDataFrame(docs, SCHEMA).repartition(5), **options)
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def corpus(seed, n=120, vocabulary=14):
    g = np.random.default_rng(seed)
    w = [f"W{i}é" if i % 5 == 0 else f"w{i}" for i in range(vocabulary)]
    join = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r", "\x0b", "  "]
    return [(["en", "fr", None][int(g.integers(3))], "".join(w[min(vocabulary - 1, int(g.exponential(3)))] + join[int(g.integers(len(join)))] for _ in range(int(g.integers(0, 40)))), "x") for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force_over_many_blocks(spark, monkeypatch, seed):
    monkeypatch.setattr(C, "BLOCK_BYTES", 120)
    docs = corpus(seed)
    want = brute(docs, 3)
    assert len(want) > 30
    assert got(spark, docs, minimum=3) == want


def test_ties_copies_and_the_first_rows(spark):
    docs = [("en", "a b c d, e f", "x")] * 12 + [("en", "x y", None), (None, None, None), ("en", "", None), ("de", " .,\n", None)] + [("und", "a b", None)] * 10
    want = brute(docs, 10, most=2)
    assert got(spark, docs, minimum=10, most=2) == want and [w[2] for w in want if w[0] == "und"] == ["a b"]


@pytest.mark.parametrize("docs", [[], [(None, None, None)], [("en", "one two", None)]])
def test_tables_without_phrases(spark, docs):
    assert got(spark, docs) == []


def test_very_long_text_and_large_products(spark):
    docs = [("en", "p q " * 30000, None), ("en", "r s. " * 40000, None)]
    assert got(spark, docs) == brute(docs, 10)


def test_filters_lose_nothing(spark):
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 60, 4000))
    rows = spark.createDataFrame([(int(k), int(i % 5)) for i, k in enumerate(keys)], "a long, reach int").repartition(3)
    every, late = C.blooms(rows, len(keys), 3)
    assert C.has(every, keys).all() and C.has(late, keys[np.arange(len(keys)) % 5 >= 3]).all()
    assert C.has(every, keys + 1).mean() < 0.01 and C.has(late, keys[np.arange(len(keys)) % 5 < 3]).mean() < 0.01
    full, _ = C.blooms(rows, 1 << 40, 0)
    assert 64 * len(full) == C.MAX_BITS


def test_a_phrase_counts_a_shard_once(spark):
    counts = lambda n: spark.createDataFrame([(7, 0, 9, n)], "a long, b int, until int, n long")
    state = C._merged(counts(4), None, 1, 4, 10)
    state = C._merged(counts(5), state, 2, 4, 10)
    state = C._merged(counts(4), state, 5, 4, 10)  # the shard of step 1 again
    assert [(r["n"], r["reach"]) for r in state.collect()] == [(9, None)]
    assert C._merged(counts(1), state, 6, 4, 10).first()["reach"] is None
    assert C._merged(counts(1), state, 7, 4, 10).first()["reach"] == 7


def test_registered_query_equals_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rows = C.QUERIES["op13_collocations"](spark, sf)
    assert sorted(map(tuple, rows.collect())) == sorted(con.execute(f"SELECT {', '.join(rows.columns)} FROM ({C.ORACLES['op13_collocations']})").fetchall())
