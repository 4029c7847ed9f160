"""From raw documents to packed sequences, in five stages.

Each stage reads all rows that the one before it wrote.  ``STAGES`` lists them;
``run`` writes every stage as Parquet in the shared folder and returns the last.
Rows with a null id or text: a null text is rejected by the language stage; a row with
a null id is kept by the near-duplicate stage.  Of rows that repeat an id, the one that comes
first as JSON stays.  Empty texts have no letter and go with the language stage; ties between
documents go to the smaller id.  Other columns, whatever their names and types, pass unchanged
up to the packing stage.  Empty tables give empty results.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudframe.llm import decontam, langid, neardup, packing, pii
from fraudframe.llm.storage import Scratch

#: Words in a shingle and the similarity, in percent, from which documents are near-duplicates.
SHINGLE, SIMILARITY = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts whose language the dictionaries can't tell apart."""
    return langid.accepted(docs, langid.dictionaries(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every group; of rows that repeat an id, one."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    found = neardup.near_duplicates(docs, k=SHINGLE, percent=SIMILARITY)
    kept = docs.join(found.filter("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(columns)
    repeated = docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id")
    if repeated.isEmpty():
        return kept
    whole = F.struct(*columns)
    one = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
    return kept.join(repeated, "doc_id", "left_anti").select(columns).unionByName(one)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces confirmed spans by their kind and counts the characters again."""
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    import public_tokenizers

    return packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("decontamination", decontaminate),
          ("personal_data", personal_data), ("packing", pack)]
#: Stages hash, compress and tokenise, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
