"""The pipeline's stages on awkward rows, and near duplicates against brute force."""

import random

import pytest

import corpus_pipeline as C
from tidemark.llm import jaccard_join

SCHEMA = "doc_id long, text string, lang string, n_chars long, score double, component_id long, place string, m string, row string, kept boolean"
STAGES = dict(C.STAGES)


def prose(seed, n=120):
    g = random.Random(seed)
    return ". ".join(" ".join(f"{g.choice('bcdfglmnprst')}{g.choice('aeiou')}{g.choice('lmnrst')}{g.randint(0, 99)}" for _ in range(12)) for _ in range(n // 12)) + "."


def documents(spark):
    good = {i: prose(i) for i in range(12)}
    near = good[3].replace(" ", "  ", 1) + " one more"
    rows = [*good.items(), (20, good[3]), (21, near), (22, None), (23, ""), (24, " \n\t"), (25, "too few words"), (26, prose(50, 40000)), (None, good[5]), (None, None), (5, good[5]), (6, "zz " + good[6])]
    return spark.createDataFrame([(i, t, "en", len(t or ""), 0.9, -1, "p", "m", "r", True) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("tables"))
    documents(spark).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i == 11)) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stages_keep_the_columns_whatever_their_names(spark, folder, name):
    docs = documents(spark)
    out = STAGES[name](spark, docs, folder)
    assert out.schema.names == docs.schema.names
    rows = out.collect()
    assert all((r["lang"], r["score"], r["component_id"], r["place"], r["m"], r["row"], r["kept"]) == ("en", 0.9, -1, "p", "m", "r", True) for r in rows)
    assert STAGES[name](spark, docs.filter("false"), folder).count() == 0


def test_quality_rules_on_odd_rows(spark, folder):
    ids = [r["doc_id"] for r in C.quality_rules(spark, documents(spark), folder).collect()]
    assert {22, 23, 24, 25}.isdisjoint(ids) and ids.count(None) == 1 and ids.count(5) == 2 and 26 in ids


def test_equal_texts_have_one_toxicity_verdict(spark, folder):
    out = C.toxic_documents(spark, documents(spark), folder).collect()
    ids = [r["doc_id"] for r in out]
    assert (3 in ids) == (20 in ids) and ids.count(5) in (0, 2) and (22 in ids) == (23 in ids) == (24 in ids)


def test_near_duplicates_keep_the_first_of_a_group(spark, folder):
    out = C.near_duplicates(spark, documents(spark), folder).collect()
    ids = sorted(r["doc_id"] for r in out if r["doc_id"] is not None)
    assert ids == [*range(12), 22, 23, 24, 25, 26]
    assert sum(r["doc_id"] is None for r in out) == 2
    assert [r["text"] for r in out if r["doc_id"] == 6] == [min(prose(6), "zz " + prose(6))]


def test_near_duplicates_against_all_pairs(spark, folder):
    g = random.Random(4)
    texts = {}
    for i in range(120):
        words = texts[g.choice(list(texts))].split() if texts and g.random() < 0.6 else prose(1000 + i, 60).split()
        for _ in range(g.choice((0, 1, 1, 2, 5))):
            words[g.randrange(len(words))] = f"w{g.randint(0, 9999)}"
        texts[i] = " ".join(words)
    sets = {i: jaccard_join.shingles(jaccard_join.words_of(t), 5) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in texts:
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    docs = spark.createDataFrame([(i, t, "en", 0, 0.0, 0, "", "", "", True) for i, t in texts.items()], SCHEMA)
    got = sorted(r["doc_id"] for r in C.near_duplicates(spark, docs, folder).collect())
    assert got == sorted(i for i in texts if root(i) == i) and len(got) < 110


def test_repeated_passages_empty_what_goes_whole(spark, folder):
    out = {r["doc_id"]: r for r in C.repeated_passages(spark, documents(spark).filter("doc_id IS NOT NULL AND doc_id NOT IN (5, 6)"), folder).collect()}
    assert out[20]["text"] == "" and out[20]["n_chars"] == 0 and out[3]["text"] == prose(3)
    assert out[22]["text"] == out[23]["text"] == "" and out[26]["text"] == prose(50, 40000)


def test_packed_pieces_hold_every_row(spark, folder):
    docs = documents(spark)
    out = C.packed(spark, docs, folder)
    whole = out.groupBy("doc_id").sum("length").count()
    assert whole == docs.select("doc_id").distinct().count() and C.packed(spark, docs.filter("false"), folder).count() == 0


def test_run_chains_the_stages(spark, folder):
    rows = C.run(spark, folder).collect()
    assert rows and {r["doc_id"] for r in rows} <= {*range(12), 26, None}
