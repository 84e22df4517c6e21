"""Scores, joins and dedup against brute force; the pipeline's stages; awkward inputs."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import blocks, jaccard_join, lm_scoring, substring_dedup, toxicity

ODD = [(1, None), (2, ""), (3, " \n "), (4, "one two"), (5, "one two"), (5, "one two"), (None, "one two"), (None, None), (6, "x" * 4000), (7, "One TWO"), (8, "ß 中文 é " * 40)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "v", 0) for i, t in rows], "doc_id long, text string, block string, component int").repartition(3)


def near(g, n=120, vocabulary=40, groups=8):
    """Texts of which some are edited copies of a few others."""
    base = [[f"w{g.randrange(vocabulary * 9)}" for _ in range(g.randint(3, 90))] for _ in range(groups)]
    out = []
    for _ in range(n):
        w = list(g.choice(base))
        for _ in range(g.choice([0, 0, 1, 1, 2, 5])):
            w[g.randrange(len(w))] = f"e{g.randrange(50)}"
        out.append(" ".join(w))
    return out


def brute_components(texts, size, percent):
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    top = {i: i for i in texts}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("size,percent,few", [(3, 90, 32), (5, 80, 32), (2, 80, 1)])
def test_join_against_all_pairs(spark, monkeypatch, size, percent, few):
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(jaccard_join, "CHUNK", 3)
    texts = dict(enumerate(near(random.Random(size * few))))
    texts |= {900: None, 901: "", 902: "one", 903: "ONE", 904: "one two"}
    out = jaccard_join.join(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4), size, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == brute_components(texts, size, percent)


def test_join_keys_meet():
    g = np.random.default_rng(0)
    for n in (1, 2, 5, 9, 10, 11, 19, 20, 40, 200, 1500):
        for percent in (80, 90):
            for _ in range(5):
                a = g.integers(0, 2**63, n, dtype=np.uint64)
                d = n * (100 - percent) // 100
                b = np.concatenate([a[d:], g.integers(0, 2**63, g.integers(0, d // 2 + 1), dtype=np.uint64)])
                if len(np.intersect1d(a, b)) * 100 >= percent * len(np.union1d(a, b)):
                    keys = [set(jaccard_join.join_keys(np.unique(x), percent).tolist()) for x in (a, b)]
                    assert keys[0] & keys[1]


def test_join_keys_of_unrelated_sets_do_not_meet():
    g = np.random.default_rng(8)
    for n in (12, 60, 400, 2500):
        seen: dict = {}
        for i in range(300):
            for k in set(jaccard_join.join_keys(np.unique(g.integers(0, 1 << 63, n).astype(np.uint64)), 80).tolist()):
                seen.setdefault(k, []).append(i)
        assert max(map(len, seen.values())) == 1


def test_join_keys_of_sets_at_the_threshold_meet():
    g = np.random.default_rng(9)
    for percent in (80, 90):
        for n in [*range(1, 40), 64, 65, 150, 400, 1111]:
            for _ in range(6):
                both = np.unique(g.integers(0, 1 << 63, n).astype(np.uint64))
                most = (100 - percent) * len(both) // percent  # common / union is at the threshold
                own = np.unique(np.append(both, g.integers(0, 1 << 63, most).astype(np.uint64)))
                keys = [set(jaccard_join.join_keys(x, percent).tolist()) for x in (both, own)]
                assert keys[0] & keys[1], (percent, n)


def test_join_odd_rows(spark):
    out = jaccard_join.join(frame(spark, ODD).select("doc_id", "text")).collect()
    assert len(out) == len(ODD)
    of = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out if r["doc_id"]}
    assert of[1] == (0, 1) and of[2] == (0, 2) and of[4] == of[5] == of[7] == (1, 4)
    assert {r["component_id"] for r in out if r["doc_id"] is None} <= {None, 4}
    assert jaccard_join.join(frame(spark, ODD).filter("false")).count() == 0


def test_components(spark):
    g = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100 + g.randrange(60), 100 + g.randrange(60)) for _ in range(40)]
    out = {r["id"]: r["component"] for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    top: dict = {}
    for a, b in edges:
        top.setdefault(a, a), top.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    joined = {x for a, b in edges if a != b for x in (a, b)}
    assert out == {i: c for i, c in top.items() if i in joined}


def brute_removal(texts):
    least: dict = {}
    for i, b in sorted(texts.items()):
        for p in range(len(b) - 49):
            least.setdefault(b[p : p + 50], i)
    out = {}
    for i, b in texts.items():
        cover = bytearray(len(b))
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < i:
                cover[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        out[i] = (len(b), sum(cover), len(bytes(cover).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest())
    return out


# few anchors: unequal ones share buckets
@pytest.mark.parametrize("step,shards,anchors", [(700, 3, 1 << 40), (1 << 20, 1, 1 << 40), (700, 2, 3)])
def test_removal_against_brute_force(spark, monkeypatch, step, shards, anchors):
    monkeypatch.setattr(blocks.blocked, "__defaults__", (5000,))
    g = random.Random(step)
    noise = lambda n: "".join(g.choice("abcd é") for _ in range(n))
    passages, texts = [noise(g.choice([40, 50, 51, 60, 90, 200, 700])) for _ in range(15)], {}
    for _ in range(150):
        kind = g.random()
        if kind < 0.1 and texts:
            t = g.choice(list(texts.values()))
        elif kind < 0.25:
            t = noise(g.choice([0, 1, 49, 50, 51]))
        elif kind < 0.35:
            t = g.choice(["ab" * g.randint(20, 200), "a" * g.randint(0, 300)])
        else:
            t = "".join(g.choice([noise(g.randint(0, 80)), g.choice(passages)[g.choice([0, 0, 5, 17]) :]]) for _ in range(g.randint(1, 8)))
        texts[g.randrange(10**9)] = t
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    out = substring_dedup.remove(df, shards, anchors, step).withColumn("h", F.sha2("kept", 256)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["h"]) for r in out} == brute_removal({i: t.encode() for i, t in texts.items()})


def test_removal_odd_rows(spark):
    out = substring_dedup.remove(frame(spark, ODD)).collect()
    assert len(out) == len(ODD) and {r["block"] for r in out} == {"v"} and {r["component"] for r in out} == {0}
    assert all(r["n_bytes"] == 0 for r in out if r["doc_id"] in (1, 2))
    assert next(r for r in out if r["doc_id"] == 6)["n_removed"] == 0
    assert substring_dedup.remove(frame(spark, ODD).filter("false")).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tidemark")]
    far = spark.createDataFrame([(2**62 + 5, "x" * 10 + "abcdefgh" * 9), (2**62 + 1, "abcdefgh" * 9)], "doc_id long, text string")
    assert {r["doc_id"] - 2**62: r["n_removed"] for r in substring_dedup.remove(far).collect()} == {1: 0, 5: 72}


def test_cut_characters_go(spark):
    df = spark.createDataFrame([("aé".encode()[:2],), ("é中".encode(),), (None,)], "kept binary")
    assert [r["t"] for r in df.select(substring_dedup.as_text(F.col("kept")).alias("t")).collect()] == ["a", "é中", None]


def test_packed_arrays():
    g = np.random.default_rng(1)
    for a in (np.zeros(0, np.int64), np.array([5, -7, 9]), np.sort(g.integers(0, 2**63, 500)), g.integers(0, 2**64, 300, dtype=np.uint64), np.sort(g.integers(0, 2**64, 300, dtype=np.uint64))):
        b = blocks.unpack_array(blocks.pack_array(a))
        assert b.dtype == a.dtype and (a == b).all()


def brute_code_length(train, text, depth=lm_scoring.DEPTH):
    """Context-tree weighting by recursion over plain dictionaries."""
    counts: Counter = Counter()
    pad = bytes(depth)
    for t in train:
        s = pad + t
        for i in range(depth, len(s)):
            for bit in range(8):
                for d in range(depth + 1):
                    counts[bit, s[i] >> (8 - bit), s[i - d : i], s[i] >> (7 - bit) & 1] += 1
    children: dict = {}
    for bit, head, context, _ in counts:
        if context:
            children.setdefault((bit, head, context[1:]), set()).add(context)
    memo: dict = {}

    def n(bit, head, context):
        return counts[bit, head, context, 0], counts[bit, head, context, 1]

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def below(bit, head, context):
        return sum(weighted(bit, head, c) for c in children.get((bit, head, context), ()))

    def weighted(bit, head, context):
        key = bit, head, context
        if key not in memo:
            own = kt(*n(*key))
            memo[key] = own if len(context) == depth else np.logaddexp(own, below(*key)) - math.log(2)
        return memo[key]

    total = 0.0
    s = pad + text
    for i in range(depth, len(s)):
        for bit in range(8):
            head, one = s[i] >> (8 - bit), s[i] >> (7 - bit) & 1
            p = 0.5
            for d in range(depth, -1, -1):
                context = s[i - d : i]
                a, b = n(bit, head, context)
                if not a + b:
                    p = 0.5
                    continue
                own = ((b if one else a) + 0.5) / (a + b + 1)
                share = 1.0 if d == depth else math.exp(kt(a, b) - math.log(2) - weighted(bit, head, context))
                p = share * own + (1 - share) * p
            total += math.log10(p)
    return total


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 500)
    monkeypatch.setattr(lm_scoring, "SHARD_BYTES", 400)
    monkeypatch.setattr(lm_scoring, "SALT_BYTES", 300)  # many salts for the larger shards
    g = random.Random(6)
    texts = {i: " ".join(g.choice(["the", "The", "cat", "sat", "on", "mat", "é", f"w{g.randrange(9)}"]) for _ in range(g.randint(0, 25))) for i in range(60)} | {90: None, 91: "", 92: "  \n"}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    out = {r["doc_id"]: r for r in lm_scoring.score(df, F.crc32(F.col("doc_id").cast("string")) % 7 == 2).collect()}
    tokens = {i: [*(t or "").lower().split(), ""] for i, t in texts.items()}
    counts = Counter(w for i, ws in tokens.items() if i not in held for w in ws)
    n, v = sum(counts.values()), len(counts)
    plain = {i: " ".join(ws[:-1]).encode() + b"\xff" for i, ws in tokens.items()}
    train = [plain[i] for i in texts if i not in held]
    assert len(out) == len(texts)
    for i, ws in tokens.items():
        r = out[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i in held, len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
    for i in [*list(texts)[:12], 90]:
        assert out[i]["score"] == pytest.approx(brute_code_length(train, plain[i]), rel=1e-5)
        assert out[i]["bits_per_byte"] == pytest.approx(-out[i]["score"] / math.log10(2) / len(plain[i]))


def test_scores_odd_rows(spark):
    df = frame(spark, ODD)
    out = lm_scoring.score(df.select("doc_id", "text"), F.col("doc_id") % 2 == 0).collect()
    assert len(out) == len(ODD) and all(np.isfinite(r["score"]) for r in out)
    assert lm_scoring.score(df.select("doc_id", "text"), F.lit(True)).first()["train_tokens"] == 0
    assert lm_scoring.score(df.filter("false").select("doc_id", "text"), F.lit(False)).count() == 0


def test_toxicity_learns_words_beginnings_and_pairs(spark):
    g = random.Random(8)
    words = [f"{a}{b}n" for a in "bdfgklmp" for b in "aeiou"]
    rows, labels = [], []
    for i in range(900):
        w = [g.choice(words) for _ in range(g.randint(5, 60))]
        kind = g.randrange(6)
        if kind == 0:
            w.insert(g.randrange(len(w)), "IDIOT!")
        elif kind == 1:
            w.insert(g.randrange(len(w)), "zorka" + g.choice(words))
        elif kind == 2:  # toxic together, not alone
            w += ["those", "redhats"] if g.random() < 0.5 else [g.choice(["those", "redhats"])]
        rows.append((i, " ".join(w)))
        labels.append((i, int(kind < 2 or {"those", "redhats"} <= set(w))))
    rows += ODD
    docs = frame(spark, rows)
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, table.filter("doc_id % 5 <> 0"))
    out = toxicity.score(docs, model)
    assert out.columns == [*docs.columns, "score"] and out.count() == len(rows)
    held = out.filter("doc_id % 5 = 0").join(table, "doc_id").collect()
    assert np.mean([(r["score"] >= 0.5) == r["toxic"] for r in held if r["doc_id"] > 8]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out.collect())
    none = toxicity.train(docs, table.filter("false"))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.5}
    assert toxicity.score(docs.filter("false"), model).count() == 0


def test_toxicity_flags_alike_when_the_sample_is_bounded(spark, monkeypatch):
    g = random.Random(10)
    words = [f"{a}{b}n" for a in "bdfgklmp" for b in "aeiou"]
    rows, labels = [], []
    for i in range(2000):
        kind = "idiot" if i % 40 == 0 else "perhaps" if i % 5 == 1 else ""
        rows.append((i, " ".join([kind, *(g.choice(words) for _ in range(8))])))
        labels.append((i, int(kind == "idiot" or kind == "perhaps" and g.random() < 0.25)))
    docs, table = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")

    def flagged():
        return {r["doc_id"] for r in toxicity.score(docs, toxicity.train(docs, table)).filter("score >= 0.5").collect()}

    whole = flagged()
    assert whole == {i for i, t in rows if t.startswith("idiot")}
    monkeypatch.setattr(toxicity, "MAX_EACH", 120)
    sample = toxicity.bounded_sample(table).groupBy("toxic").agg(F.count("*").alias("n"), F.sum("weight").alias("all")).collect()
    positive = sum(x for _, x in labels)
    assert {r["toxic"]: (r["n"], round(r["all"], 6)) for r in sample} == {0: (120, 2000 - positive), 1: (120, positive)}
    assert len(flagged() ^ whole) <= 0.01 * len(rows)


def test_stages_keep_clean_documents(spark, tmp_path):
    import corpus_pipeline

    g = random.Random(9)
    clean = lambda: " ".join("".join(g.choice("bcdfglmnprst") + g.choice("aeiou") for _ in range(g.randint(1, 4))) for _ in range(60)) + "."
    texts = {i: clean() for i in range(40)}
    texts |= {i: f"{clean()} what an idiot {clean()}" for i in range(40, 60)}
    texts[60], texts[61] = texts[3], "SHOUT!! " * 60
    shared = clean()
    texts[70], texts[71] = clean() + " " + shared, clean() + " " + shared
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(40 <= i < 60)) for i in texts], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen, at = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
        at = corpus_pipeline.written(at)
        seen[name] = {r["doc_id"]: r for r in at.collect()}
    assert set(seen["quality rules"]) == set(texts) - {61}
    assert set(seen["toxicity"]) == set(texts) - {61} - set(range(40, 60))
    assert set(seen["n-gram Jaccard join"]) == set(seen["toxicity"]) - {60}
    last = seen["suffix-array dedup"]
    assert shared in last[70]["text"] and shared[5:] not in last[71]["text"] and all(r["n_chars"] == len(r["text"]) for r in last.values())
    assert last[7]["text"] == texts[7]
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert pieces.select("doc_id").distinct().count() == len(last)
