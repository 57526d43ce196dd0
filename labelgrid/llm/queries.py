"""The queries of this subpackage (thin: each one applies its operator to a whole table) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat
from .common import table
from .fingerprints import fingerprint_edits
from .html_text import main_text
from .media import read_back, resolve, sequences, store_texts, text_pages
from .mixing import mix
from .near_dups import near_duplicates
from .oracles import SQL
from .packing import pack
from .substrings import remove_repeats
from .token_counts import token_counts
from .toxicity import learn, score


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    doc_id = F.col("rest.doc_id")
    held_out = F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0
    return scored.select(doc_id.alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))


def op2_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(table(spark, sf_dir, "documents"), "piece_bpe_32k.model")
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), "word_bpe_49k.json", closing_id=1)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return left.select("rest.doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the added one; rows that the table itself has for conv_id -7 are turns of it."""
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], told.schema)
    return chat.read_back(chat.format_chats(told.unionByName(added)))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    media = read_back(store_texts(docs))
    pages = sequences(text_pages(docs), key="page", carry=("doc_id", "n_bytes"))
    # texts stay where they are: of them only sizes go along with the references
    sizes = F.aggregate("items", F.lit(0), lambda n, x: n + F.coalesce(F.char_length(x["text"]), F.lit(0)))
    slim = pages.select("page", "doc_id", "n_bytes", F.size("items").alias("n_items"), sizes.alias("text_chars"), F.filter("items", lambda x: x["digest"].isNotNull()).alias("items"))
    found = resolve(slim, media, key="page")
    own = [c for c in media.columns if c != "digest"]
    one = found.groupBy("page", "doc_id", "n_bytes", "n_items", "text_chars").agg(
        F.max(F.when(F.col("kind") == "image", F.struct(*own))).alias("image"),
        F.array_sort(F.collect_list(F.struct("position", "kind", "caption", F.col("payload_bytes").alias("samples")))).alias("media"),
    )
    return one.select("doc_id", "n_bytes", "image.*", "n_items", "text_chars", "media")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


__all__ = ["QUERIES", "SQL"]

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_near_dups": op2_near_dups,
    "op3_token_counts": op3_token_counts,
    "op4_packing": op4_packing,
    "op5_fingerprints": op5_fingerprints,
    "op6_substrings": op6_substrings,
    "op7_chat": op7_chat,
    "op8_html_text": op8_html_text,
    "op9_media": op9_media,
    "op10_mixing": op10_mixing,
}
