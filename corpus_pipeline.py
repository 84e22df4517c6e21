"""The corpus pipeline: quality rules, toxicity, near duplicates, repeated passages, packing.

Each stage takes the documents that the one before has kept, written as Parquet and read
again, and returns the columns of ``documents``; the last returns the packed pieces.

Cases, in all stages: an empty table gives no rows. Columns beside ``doc_id``, ``text`` and
``n_chars`` go through unread, whatever their names; ``n_chars`` is recounted where the text
changes. Very long texts are judged, scored, compared and packed whole. What each stage does with
nulls, empty texts, ties and repeated rows, its own docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, packing, quality, substring_dedup, toxicity
from tidemark.llm.common import discard, free_name, table, written

#: Near duplicates share so much of their shingles of so many words.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80
#: The SQL cannot learn the toxicity model.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail go; documents that fail go.

    Null and empty texts have too few words and go. Equal rows are judged alike. A null doc_id is kept.
    """
    return quality.clean(docs)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go; all labels teach.

    Null and empty texts have the score of a text without terms. Equal texts have equal scores, so
    that equal rows stay or go together; so do rows without a doc_id, which teach nothing.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    into = free_name(docs, "score")
    return toxicity.score(docs, model, into).filter(F.col(into) < 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group stays.

    Null and empty texts are in no group and stay, and so do rows without doc_id, which cannot be
    told apart. Of several rows with one doc_id the one with the smallest text stays (null last, then
    by the other columns), if the doc_id does.
    """
    joined = jaccard_join.join(docs.select("doc_id", "text"), NEAR_SHINGLE, NEAR_PERCENT)
    stays = joined.filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(stays, "doc_id").select(*docs.columns)
    place = free_name(docs, "place")
    order = [F.asc_nulls_last("text"), *[F.asc_nulls_last(F.col(f"`{c}`").cast("string")) for c in docs.columns if c not in ("doc_id", "text")]]
    first = kept.withColumn(place, F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).filter(F.col(place) == 1)
    return first.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.filter("doc_id IS NULL"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller doc_id has go.

    A text that goes whole becomes empty and stays as a row; null and empty texts become empty.
    """
    others = {c: f"other{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}  # no name clashes with an added one
    left = substring_dedup.remove(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(o) for c, o in others.items()]), as_string=True)
    left = left.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("text").cast("long"))
    return left.select(*[F.col(others.get(c, c)).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 1024 tokens.

    Null and empty texts are one piece, their closing token. Equal rows are packed each.
    """
    return packing.digest(packing.pack(docs, packing.vocabulary()))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_documents),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of everything that the stages keep of ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
