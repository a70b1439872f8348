"""The corpus pipeline: toxic documents go, then copies, then near copies; sources are mixed and the rest is encoded.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return the columns of
documents as they came. A stage decides from narrow rows; texts are only moved where a stage must compare them.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import bpe, exact_dedup, minhash, mixing
from logweave.llm import toxicity as severity
from logweave.llm.common import cut, delete, free_name, restrict, shared_folder, word_count


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column of keys that no two rows share, its name, and one row of those with equal ids and texts.

    A key is the id where that is there once. Else it is a hash of id and text above all usual ids; only such rows move.
    """
    key = free_name(docs.columns, "_key")
    odd = cut(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL").select("doc_id"))
    plain = docs.withColumn(key, F.col("doc_id").cast("long"))
    if odd.isEmpty():
        return plain, key
    repeated = odd.filter("doc_id IS NOT NULL")
    hashed = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    rest = docs.filter("doc_id IS NULL").unionByName(restrict(docs, repeated, "doc_id").select(*docs.columns)).withColumn(key, hashed).dropDuplicates([key])
    return restrict(plain.filter("doc_id IS NOT NULL"), repeated, "doc_id", "left_anti").select(*rest.columns).unionByName(rest), key


def _without(docs: DataFrame, key: str, verdict: DataFrame) -> DataFrame:
    """``docs`` without the rows whose keys ``verdict`` (doc_id, kept) drops, and without the column of keys."""
    gone = cut(verdict.filter("NOT kept").select(F.col("doc_id").alias(key)).distinct())
    return restrict(docs, gone, key, "left_anti").select(*[c for c in docs.columns if c != key])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops toxic documents, by a model fitted on labelled ones.

    Each row is judged by its own text, whatever its id: null and empty texts have no features and stay, long ones are
    judged whole, repeated rows alike. Without labels nothing is dropped. Other columns pass, whatever their names.
    """
    model = severity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    packed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))  # its names can't clash with the verdict's
    return severity.toxicity(packed, model, keep=("_row",)).filter("kept").select("_row.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of those that are equal without white space.

    It is the longest, then the one with the smallest id, then any with an id. Of identical rows one stays; rows of one id
    with different texts are judged apart. Null and empty texts are equal, and one of them stays. Long texts are compared
    whole. Other columns pass, whatever their names; an empty table stays empty.
    """
    keyed, key = _keyed(docs)
    return _without(keyed, key, exact_dedup.exact_dedup(keyed, id_col=key))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word shingles with a similarity of 0.8 or more.

    It is the one with the smallest id; rows without an id or with a repeated one come last. Rows of one id with different
    texts are judged apart, of identical rows one stays. Null and empty texts link with nothing and all stay; texts under
    five words only link with equal ones. Long texts are compared whole. Other columns pass, whatever their names; an
    empty table stays empty.
    """
    keyed, key = _keyed(docs)
    return _without(keyed, key, minhash.near_dedup(keyed, shingle=5, percent=80, id_col=key))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources have their target weights.

    A document is there once for each time its words are taken in full; if its source's budget ends inside it, there is
    one more with the words up to there. One without words (null or empty) is there once: it weighs nothing. A null source
    is a source of its own. Rows of one source that repeat an id and a size share what the mix takes of them. Other columns pass,
    whatever their names, but ``n_chars`` is counted anew; an empty table stays empty.
    """
    words, copies, own, source, size, took = (free_name(docs.columns, x) for x in ("_words", "_copies", "_id", "_source", "_size", "_taken"))
    mixed = mixing.mix_sources(docs).groupBy(F.col("doc_id").alias(own), F.col("source").alias(source), F.col("size").alias(size))
    taken = mixed.agg(F.expr("sum(taken) div count(*)").alias(took))
    rows = docs.withColumn(words, word_count(F.col("text")))
    rows = rows.join(taken, F.col("doc_id").eqNullSafe(F.col(own)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(words) == F.col(size)))
    n, t = F.col(size), F.col(took)
    whole = F.when(n == 0, F.lit(1)).otherwise(F.floor(t / F.greatest(n, F.lit(1)))).cast("int")
    rest = F.when(n == 0, F.lit(0)).otherwise(t % F.greatest(n, F.lit(1))).cast("int")
    part = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), rest), " ")
    made = F.concat(F.array_repeat(F.col("text"), whole), F.when(rest > 0, F.array(part)).otherwise(F.array().cast("array<string>")))
    texts = rows.withColumn(copies, made).drop("text").withColumn("text", F.explode(copies))
    if "n_chars" in docs.columns:
        texts = texts.withColumn("n_chars", F.length("text").cast("long"))
    return texts.select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and a check that they decode to it.

    One row per row: doc_id, source, n_tokens, ids, round_trip. A null text is empty and has no ids; long texts are encoded
    whole; ids may be null or repeat. Other columns end here, whatever their names; an empty table gives an empty result.
    """
    coded = bpe.bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=("source", "text"))
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_copies), ("minhash", near_copies), ("mix_sources", mixture), ("bpe", encoding)]

#: The classifier, near duplicates and encoding aren't expressible in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
