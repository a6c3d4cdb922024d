"""The corpus pipeline: each stage applies one operator to all documents that the stage before kept.

classify  drops documents that the additive quality model rejects
dedup     keeps the document with the smallest id of each group of near copies
          (five-word shingles, Jaccard similarity 0.8 or more)
redact    redacts personal data and terms that disclose it
mix       repeats or drops documents so that sources meet their target weights
pack      packs token pieces into sequences of 2048 tokens

Every stage but the last returns the columns of documents (n_chars is the length of
the text as it then is). A document that the mix takes twice is two equal rows.
Rows with a null id can't be told apart by groups of copies and all stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from takemark.llm import jaccard_join, mixing, packing, pii, quality_gam
from takemark.llm.common import Scratch, member_test, saved, table

THRESHOLD = 0.7
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_gam.fit_on_labels(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_gam.score_column(model, F.col("text")) >= THRESHOLD).select(*COLUMNS)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard_join.near_duplicates(docs, width=5, num=80, den=100)
    s = Scratch(spark)  # its two small tables stay, since the result reads them
    dropped = s.saved(found.where("component_id <> doc_id").select("doc_id").distinct(), "dropped")
    # Most texts stay where they are: a filter of fixed size in the scan leaves few for the exact join.
    asked = F.coalesce(member_test(dropped.select(F.xxhash64("doc_id").alias("v")), s)(F.xxhash64("doc_id")), F.lit(False))
    kept = docs.where(~asked).select(*COLUMNS)
    return kept.unionByName(docs.where(asked).join(dropped, "doc_id", "left_anti").select(*COLUMNS))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keys = ["doc_id", "_hash", "source"]
    hashed = docs.withColumn("_hash", F.xxhash64("text", "lang", "n_chars"))
    taken = mixing.copies(hashed, carry=("_hash",)).groupBy(*keys).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("equal"))
    taken = saved(taken.where("copies > 0").select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "copies", "equal"), "taken")
    repeated = saved(taken.where("equal > 1"), "repeated")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    # Texts move once, to their copies. Equal rows are rare; there one row takes the copies of all.
    chosen = hashed.join(taken.where("equal = 1"), same).unionByName(hashed.join(repeated, same).dropDuplicates(keys))
    return chosen.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("classify", classify), ("dedup", dedup), ("redact", redact), ("mix", mix), ("pack", pack)]

#: The stages learn, search and draw; SQL can't express them. The tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
