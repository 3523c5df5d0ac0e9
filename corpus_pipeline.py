"""A cleaning run over documents: five stages, each an operator of tabkit.llm whose decisions take effect.

Every stage takes (spark, docs, sf_dir) and returns the documents that are left, with the columns of ``documents``; the last returns
the packed pieces. Between stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabkit.llm import decontaminate, nearjoin, packing, suffixdedup, toxicity
from tabkit.llm.common import name, remainder, stage
from tabkit.llm.queries import table, tokenizer_path
from tabkit.plans.base import Query

ROW = "__row"
WHOLE = "__whole"
# Bytes of a string that may stand once only. 50 words of the corpus take about 300 bytes; a passage a little longer must not slip through.
REPEAT = 256


def carried(docs: DataFrame) -> DataFrame:
    """doc_id and text, and the whole row in one column: what an operator adds cannot meet a column of the user's."""
    return docs.select(F.struct(*[name(c) for c in docs.columns]).alias(WHOLE), "doc_id", "text")


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(WHOLE)[c].alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go; the scorer learns as in op3_toxicity, from the documents given."""
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    scored = toxicity.score(carried(docs), toxicity.fit(docs, labels), keep=[WHOLE])
    return unpacked(scored.where("predicted = 0"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents one row stays: the smallest doc_id (none comes last), of equal ones the first row.

    Rows are told apart by a number of their own, not by doc_id, which may be repeated or null.
    """
    rows = stage(carried(docs).withColumn(ROW, F.monotonically_increasing_id()), "rows")
    place = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.col(ROW).alias("row"))
    groups = nearjoin.near_duplicates(rows.select(place.alias("place"), "text"), "place")
    go = groups.where("place.row <> component_id.row").select(F.col("place.row").alias(ROW))
    return unpacked(rows.join(go, ROW, "left_anti"), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of ``REPEAT`` bytes that start twice are cut out of the texts; n_chars follows."""
    return suffixdedup.clean(docs, length=REPEAT).withColumn("n_chars", F.length("text").cast("long")).select(*[name(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    found = decontaminate.find_items(carried(docs), table(spark, sf_dir, "benchmark"), keep=[WHOLE])
    return unpacked(found.where(F.size("hit_runs") == 0), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

ORACLE_SQL = None  # scores, tokenizer and packing have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for label, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), label.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": Query(run, ORACLE_SQL)}
