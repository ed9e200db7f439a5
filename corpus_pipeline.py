"""From raw documents to token ids: reject toxic texts, keep one of each near-duplicate group, mix sources, encode.

Each stage takes ``(spark, docs, sf_dir)`` and returns the columns of ``documents``, the last one
token ids. ``run`` writes what a stage returns to the shared folder before the next reads it, so a
stage is computed once and lost executors cost no more than their tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.llm import byte_bpe, minhash, mixing, toxicity
from pitchside.llm.common import table, written


#: Percent of shared five-word shingles from which two documents count as near-duplicates.
NEAR_PERCENT = 80


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold; the model learns from the labelled ones among ``docs``."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    scored = toxicity.score(docs.drop("score"), model, keep=[c for c in docs.columns if c != "score"])
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(*[c for c in docs.columns if c != "score"])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id, with an id before without.

    A row is known by its id and its text, since an id may stand on several texts and a row may have no id;
    rows that are alike in both are copies of one row, of which one stays.
    """
    text = F.sha2(F.coalesce("text", F.lit("")), 256)
    rows = docs.withColumn("_row", F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), text.alias("text")))
    found = minhash.near_duplicates(rows, percent=NEAR_PERCENT, id_col="_row")
    kept = written(found.where("kept").select(F.to_json("_row").alias("_kept")).distinct(), "pipeline-kept")
    own = rows.withColumn("_row", F.to_json("_row"))
    return own.join(kept, F.col("_row") == F.col("_kept")).dropDuplicates(["_row"]).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.taken_documents(mixing.mix(docs), docs.columns)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes they decode to."""
    import public_tokenizers

    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.DEFAULT_RANKS))
    both = byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return both.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("mixing_sources", mix_sources),
    ("byte_bpe", encode_bytes),
]
#: Trained models and similarity joins are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
