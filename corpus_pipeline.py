"""A training-data pipeline over ``documents``: five stages, each one of the corpus operators.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each
stage as Parquet in the shared folder and rereads it for the next. All stages but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import decontaminate, jaccard_join, mixing, sharding, toxicity
from weft.llm.common import Stash, held_out, join_checked

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies share four fifths of their distinct five-word shingles.
SHINGLE_WORDS, SIMILARITY = 5, (4, 5)


def keyed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with ``__key``, which tells rows apart: the id, and where it is missing or repeated a negative hash of id and text."""
    own_hash = -1 - F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2)
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("__again"))
    again = Stash(spark, "repeated-ids").put("ids", again)
    if again.isEmpty():
        return docs.withColumn("__key", F.coalesce("doc_id", own_hash))
    marked = join_checked(docs, again, "doc_id", "left")
    return marked.withColumn("__key", F.when(F.col("doc_id").isNotNull() & F.col("__again").isNull(), F.col("doc_id")).otherwise(own_hash)).drop("__again")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.

    The model learns from every labelled row outside the evaluation fold. Every row is judged by its own text: null and empty
    texts stay, and so do all rows if there are no labels. Repeated rows are judged alike. An empty table stays empty; only
    the columns of documents come back.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out(F.col("doc_id")))
    # the text is a carried column too, so the decision is made where the row is
    return toxicity.score_documents(docs, model, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest key (its id, as a rule).

    Rows are told apart by ``keyed``, so rows that share an id but not their text, and rows without an id, are members of
    their own groups. Of rows that are equal in id and text one stays. Texts that are null or have no word are copies
    of nothing: they all stay. An empty table stays empty; only the columns of documents come back.
    """
    rows = keyed(spark, docs)
    groups = jaccard_join.jaccard_components(rows, id_col="__key", k=SHINGLE_WORDS, threshold=SIMILARITY)
    groups = Stash(spark, "near-copies").put("groups", groups)
    gone = groups.where("component_id <> __key").select("__key").distinct()
    kept = join_checked(rows, gone, "__key", "left_anti")
    again = groups.where("n_shingles > 0").groupBy("__key").count().where("count > 1").select("__key")
    if again.isEmpty():
        return kept.select(*COLUMNS)
    one = join_checked(kept, again, "__key", "left_semi").groupBy("__key").agg(F.min(F.struct(*COLUMNS)).alias("r"))
    return join_checked(kept, again, "__key", "left_anti").select(*COLUMNS).unionByName(one.select("r.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    Rows are told apart by ``keyed``: each is judged by its own text, with or without an id of its own. Null and empty texts
    stay, and so do all rows if the benchmark is empty. An empty table stays empty; only the columns of documents come back.
    """
    rows = keyed(spark, docs)
    found = decontaminate.decontaminate(rows.select(F.col("__key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = Stash(spark, "contaminated").put("ids", found.where("contaminated").select(F.col("doc_id").alias("__key")).distinct())
    return join_checked(rows, gone, "__key", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated towards their target weights: by the power law of ``mixing.mix`` over the bytes that are left.

    A null source is a source of its own; rows with equal ids (null too) are repeated alike; an empty table stays empty.
    """
    return mixing.mix(docs).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight shards that all hold the mixture, with the columns that ``sharding.interleave`` adds; an empty table gives no rows."""
    return sharding.interleave(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("sharding", shard),
]

#: The toxicity stage learns a model, which SQL can't express; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage leaves behind goes as soon as its result, and then the next one's, is written."""
    stash = Stash(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS), None
    for name, stage in STAGES:
        known = list(Stash.made)
        docs = stash.put(name, stage(spark, docs, sf_dir))
        for scratch in [s for s in Stash.made if s not in known]:
            scratch.remove()
        if before is not None:
            stash.drop(before)
        before = name
    return docs
