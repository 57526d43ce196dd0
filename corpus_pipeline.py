"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

toxicity -> near-duplicates -> repeated passages -> source mixing -> packing. Every stage works on all rows its predecessor kept;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelgrid.llm.common import WORD, files_for, forget, keep, table, unpacked
from labelgrid.llm.mixing import mix
from labelgrid.llm.near_dups import near_duplicates
from labelgrid.llm.packing import pack
from labelgrid.llm.substrings import remove_repeats
from labelgrid.llm.toxicity import learn, score


def numbered(docs: DataFrame) -> DataFrame:
    """``row`` and ``doc``: rows with a number of their own, which holds as they are written, and all of their columns in one."""
    return keep(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), files_for(docs))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half; the model is learned from the labelled ones among them."""
    return score(docs, learn(docs, table(spark, sf_dir, "labels"))).where("score < 0.5").select(*unpacked(docs, "text"))


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, the one with the smallest id (the first of those that have it); documents that no other row is like stay.

    Every row is compared by itself, so rows that repeat an id are as any others. Rows without words are in no group: one of each
    (doc_id, text) stays. Rows without an id are compared with none, and all of them stay.
    """
    # numbers in the order of ids: centres of groups, from which pairs are formed, are the rows of the smallest ids
    rows = numbered(docs.orderBy("doc_id", F.xxhash64("text")))
    flat = rows.select("row", "doc.doc_id", "doc.text")
    named = flat.where("doc_id IS NOT NULL")
    placed = near_duplicates(named, key="row").where("n_shingles > 0").join(named.select("row", "doc_id"), "row")
    grouped = placed.groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).getField("row").alias("row")).select("row")
    wordless = named.where(~F.coalesce(F.col("text").rlike(WORD), F.lit(False))).groupBy("doc_id", "text").agg(F.min("row").alias("row")).select("row")
    kept = grouped.unionByName(wordless).unionByName(flat.where("doc_id IS NULL").select("row"))
    return rows.join(kept, "row", "left_semi").select("doc.*")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that an earlier document has; ``n_chars`` follows the text."""
    left = remove_repeats(docs)
    columns = dict(zip(docs.columns, unpacked(docs, "text"), strict=True))
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(columns["n_chars"]).alias("n_chars")
    return left.select(*columns.values())


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it (0 to 2 times), whether its id is null, repeated or its own."""
    rows = numbered(docs)
    copies = mix(rows.select("row", "doc.doc_id", "doc.text", "doc.source"), row="row").where("copies > 0").select("row", "copies")
    return rows.join(copies, "row").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("near_dups", near_dups), ("repeats", repeats), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, keep(stage(spark, docs, sf_dir))
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: no SQL for the learned score, the near-duplicates at scale, and the tokenizer: ``run`` is tested against plain Python that takes
#: the learned scores and works out every later stage by its definition, and every stage on odd tables
ORACLE_SQL = None
