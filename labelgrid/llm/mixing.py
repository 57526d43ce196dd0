"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source expects ``rate = target / source_size`` copies (0 to ``cap``). With the documents of a source in a
fixed order, the expected copies are summed up, one random offset is added, and a document is taken once for each integer
boundary that its own share crosses. Documents stand in order of their size class, so that the words taken stay within about
one large document of the target.

The prefix sum needs no task that sees a whole source: ranks inside a source come from a histogram over (source, size class,
bucket of ids and texts), whose size is bounded by classes and buckets, plus a row number inside one bucket. The number of buckets
follows the square root of the number of rows, so neither the histogram of a source nor a bucket grows as fast as the rows.

The targets of sources are prefix sums over one row per source, in one task that sorts (and spills) as many rows as there are
sources.

Null text has size 0. A source without words has target 0 and nothing is taken. A null source is a source of its own, last in
order. An empty table gives an empty result. Rows that repeat a doc_id are sampled each; they go to buckets by their texts too, so
only rows that repeat both share one. Columns beside those named are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, files_for, keep

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEED = 17


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash32(x: Column, salt: str = "") -> Column:
    """32 bits of MD5: the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), x)), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, source: str, *, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``source``, ``source_size``, ``target``: the share of all sizes by weight, no source above ``cap`` times its own size.

    Resharing what is above the cap until none is above ends at a level ``t`` with ``target = least(cap * size, weight * t)``.
    With the sources sorted by ``cap * size / weight``, the capped ones are a prefix, found by prefix sums. One row per source.
    """
    totals = sizes.groupBy(source).agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col(source).asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    weighed = totals.select(source, "source_size", weight.alias("w"), (cap * F.col("source_size")).alias("most"))
    order = W.orderBy(F.col("most") / F.col("w"), F.col(source).asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    at = weighed.withColumn("level", level).withColumn("capped", F.col("most") <= F.col("w") * F.col("level"))
    # the level of the first source that is not capped holds for all that follow it
    held = F.min(F.when(~F.col("capped"), F.struct((F.col("most") / F.col("w")).alias("o"), F.col("level").alias("t")))).over(W.partitionBy()).getField("t")
    return at.withColumn("t", held).select(source, "source_size", F.when(F.col("capped"), F.col("most")).otherwise(F.col("w") * F.col("t")).alias("target"))


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, row: str | None = None, **rule) -> DataFrame:  # noqa: ANN003
    """``key``, ``source``, ``size``, ``source_size``, ``target`` and ``copies`` of every document, and its ``row`` if that column is named."""
    own = [row] if row else []
    spread = hash32(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    narrow = docs.select(F.col(key).alias("id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), spread.alias("spread"), *own)
    sizes = keep(narrow.withColumn("class", F.when(F.col("size") > 0, F.floor(8 * F.log2(F.col("size").cast("double")))).otherwise(-1).cast("long")), files_for(docs))
    rates = targets(sizes, "source", **rule).select(F.col("source").alias("s"), "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))
    buckets = max(1, math.ceil(math.sqrt(sizes.count()) / 8))
    bucketed = sizes.withColumn("bucket", F.col("spread") % buckets)
    cells = bucketed.groupBy("source", "class", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("source").orderBy("class", "bucket").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select(F.col("source").alias("s"), F.col("class").alias("c"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    cells = cells.join(rates.withColumnRenamed("s", "r"), F.col("s").eqNullSafe(F.col("r"))).drop("r")
    inside = W.partitionBy("source", "class", "bucket").orderBy("spread", F.col("id").asc_nulls_last(), "size", *own)
    ranked = bucketed.withColumn("rank", F.row_number().over(inside))
    offset = hash32(F.coalesce(F.col("source"), F.lit("")), f"{seed}:") / F.lit(float(2**32))
    shared = F.floor(F.col("rate") * F.col("last") + F.col("u")) - F.floor(F.col("rate") * (F.col("last") - 1) + F.col("u"))
    return (
        ranked.join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")) & (F.col("bucket") == F.col("b")))
        .withColumn("last", (F.col("before") + F.col("rank")).cast("double"))
        .withColumn("u", offset)
        .select(F.col("id").alias(key), "source", "size", "source_size", "target", shared.cast("long").alias("copies"), *own)
    )


#: DuckDB, for the same rows as the query; ``{docs}`` names the input
MIX_SQL = r"""
sized AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
  ('0x' || substr(md5(concat(coalesce(doc_id::VARCHAR, ''), ':', md5(coalesce(text, '')))), 1, 8))::BIGINT AS spread FROM {docs}),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, ([3.0, 1.0, 2.0])[1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3]::DOUBLE AS w, 2.0::DOUBLE * source_size AS most FROM totals),
leveled AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY most / w, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
held AS (SELECT arg_min(level, most / w) AS t FROM leveled WHERE most > w * level),
targets AS (SELECT source, source_size, CASE WHEN most <= w * level THEN most ELSE w * t END::DOUBLE AS target FROM leveled LEFT JOIN held ON true),
buckets AS (SELECT greatest(1, ceil(sqrt(count(*)) / 8)::BIGINT) AS b FROM sized),
placed AS (
  SELECT s.*, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN size > 0 THEN floor(8 * log2(size::DOUBLE)) ELSE -1 END,
    spread % b, spread, doc_id NULLS LAST, size)::DOUBLE AS last FROM sized s, buckets),
rated AS (
  SELECT p.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('17:' || coalesce(p.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source),
mixed AS (SELECT doc_id, size, source_size, target, (floor(rate * last + u) - floor(rate * (last - 1) + u))::BIGINT AS copies FROM rated)
"""
