"""From documents to training sequences: five stages, each written and read again before the next one.

Every stage but the last keeps the columns of ``documents``. Null and empty texts are rejected by the first stage; an
empty table passes through all stages; columns beyond those of ``documents`` stay with their rows until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loamline.llm import langid, minhash, mixing, packing, suffixes
from loamline.llm.shared import stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the filters, learned from the labelled documents, recognise. Texts without a letter
    go, and so do texts none of whose n-grams any language has."""
    model = langid.learn(docs.select("text", "lang"))
    found = langid.predict(docs, model)
    return found.where("lang_pred <> 'und' and lang_share > 0").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group on five-word shingles: the one with the smallest doc_id."""
    kept = minhash.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    one = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")
    return one.dropDuplicates(["doc_id", "text"])


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that an earlier document has; n_chars follows the text."""
    cut = suffixes.drop_repeats(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words: whole times, and once more with the chance that is left,
    by a seeded hash, so that each source comes near its target."""
    key = docs.select("*", F.xxhash64(*docs.columns).alias("_hash"))
    sized = key.select("source", "doc_id", "_hash", packing.word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(sized, mixing.cycle_weights)
    chance = F.pmod(F.xxhash64("_hash", F.lit(17)), F.lit(1 << 20)) / float(1 << 20)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + chance)).otherwise(0)
    # Equal rows share their sum of times, so one of them stands for all.
    taken = mixed.groupBy("doc_id", "_hash").agg(F.sum(times).cast("int").alias("_times")).where("_times > 0").withColumnRenamed("doc_id", "_id")
    joined = key.dropDuplicates(["doc_id", "_hash"]).join(taken.withColumnRenamed("_hash", "_same"), F.col("doc_id").eqNullSafe(F.col("_id")) & (
        F.col("_hash") == F.col("_same")))
    return joined.withColumn("_time", F.explode(F.array_repeat(F.lit(1), F.col("_times")))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: bin, n_words, n_pieces and parts (place, doc_id, start, length)."""
    return packing.sequences(packing.pack(docs))


STAGES = [
    ("language_id", language_id), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup),
    ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
