"""The corpus pipeline: stages over documents, each one operator of ``baseloom.llm``."""

from __future__ import annotations

from pyspark.sql import functions as F

from baseloom.llm import jaccard_join, line_dedup, mixing, packing, quality_rules
from baseloom.llm.registry import WORD, fresh, query, staged, table


def quality(spark, docs, sf_dir):
    """Documents that the base rule or a learned rule rejects go.

    A null or empty text fails the base rule. Repeated rows and ids are judged row by row; an empty table stays empty.
    """
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).where("kept").select(*docs.columns)


def lines(spark, docs, sf_dir):
    """Repeated lines go; a document of which nothing but blank lines is left goes as a whole.

    So null and empty texts go, and of repeated rows the first stays. An empty table stays empty.
    """
    left = line_dedup.dedup_lines(docs).where(F.col("text").rlike(WORD))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark, docs, sf_dir):
    """One row of each group of near duplicates stays: the one with the smallest id.

    A null id comes last; of rows with the smallest id the first stays, so repeated rows count once. A text without
    words is like no other and stays. An empty table stays empty.
    """
    row = fresh("row")
    # Ids can be null or repeated, so rows are told apart by a number that is written with them.
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    classes = jaccard_join.join_classes(numbered.select(F.col(row).alias("doc_id"), "text"))
    classes = classes.select(F.col("doc_id").alias(row), "component_id").join(numbered.select(row, "doc_id"), row)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", row)).getField(row).alias(row)
    kept = classes.groupBy("component_id").agg(first).select(row)
    return numbered.join(kept, row, "left_semi").select(*docs.columns)


def mixed(spark, docs, sf_dir):
    """Sources come to their target weights; a document that is taken twice is there twice.

    A null text has no words and takes no share; null sources are one source. Repeated ids are ranked alike. An empty table
    stays empty.
    """
    copies = mixing.mix(docs, mixing.plan(docs)).where("copies > 0")
    times = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias(fresh("copy"))
    return copies.select(*docs.columns, times).select(*docs.columns)


def packed(spark, docs, sf_dir):
    """Token sequences without padding and without mixed documents.

    A null text is its end token alone. Repeated rows are packed each on its own; an empty table gives no sequence.
    """
    # Workers stay after the stage; an empty cache leaves room for the stages of a next run.
    return packing.pack(docs, cached=500_000, keep=False)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixed),
    ("packing", packed),
]


@query("pipeline")
def run(spark, sf_dir):
    """All stages on documents; each result is written to the shared folder and read by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = staged(docs, f"stage{number}")
    return docs


# Learned rules, MinHash components and a tokenizer are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None
