"""Near-duplicate documents by bottom-k sketches from one hash function.

1. A document's set holds its distinct shingles of five words. Documents with the same set are one class (its smallest id).
2. The ``K_VALUES`` smallest hashes of a set are its sketch. Inverted lists of retained values generate candidates: two sets as
   alike as the threshold share at least ``SHARED`` of their retained values (but for one pair in some thousand millions), so it
   is enough to list each class under its rarest values, all but ``SHARED`` of them and one; values that many unlike documents
   share list nobody. Classes that have company in no list have no link. The others are listed anew by the same rule on their full
   sets, where it is exact: a class with more shingles of its own than the threshold allows drops out, so copies that differ too
   much make no pairs.
3. From a list, linearly many pairs are formed: each class with the smallest of the list and of a salted part of it. The union
   sketch estimates each class's best pair, with the same margin; those that pass are verified on the full sets. Verified links
   give components.
4. In the end all pairs of a list that are in different components are estimated and verified, so no link between different
   texts that could join two components is lost. A list is cut into cells first: what sizes and positions allow is the same for
   all classes of a cell, so two cells that cannot hold a link are never compared, however many classes they hold.

Null or empty text, or text without words, has an empty set and is linked with nothing. Fewer than five words make one shingle.
Rows that repeat a doc_id with the same text are one node; with other texts each row goes with its own set. A null doc_id has a
null component and is kept. Ids are of any type that has an order. Extra columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import files_for, forget, id_filter, keep, split_by
from .components import components

WORDS = 5
LIKE = 85
K_VALUES = 32
#: retained values that two sets as alike as the threshold have in common at least; 27 of them are expected
SHARED = 12
#: classes in a salted part of a list
PART = 16
_HALF = K.U64(1)


def shingle_sets(column: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (63 bits) of each row."""
    raw, offsets = K.buffer(column)
    data = K.LOWER[raw]
    starts, ends, first = K.words(data, offsets)
    hashes = K.span_hash(data, starts, ends)
    grams = K.gram_hash(hashes, n) >> _HALF
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(K.gram_hash(hashes[a:b], b - a) >> _HALF)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.slices(batch, "text"):
            sets = shingle_sets(part.column("text"))
            sums = np.array([int(s.sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64)
            mixed = np.array([int(K.mix(s).sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums), pa.array(mixed), _lists([s[:K_VALUES] for s in sets])], ["id", "n", "s1", "s2", "sketch"])


def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([part.column("id"), _lists(shingle_sets(part.column("text")))], ["id", "hashes"])


def _alike(x: str, y: str) -> Column:
    """Whether the union sketch of two sketches says that their sets may reach the threshold."""
    union = F.slice(F.array_sort(F.array_union(x, y)), 1, K_VALUES)
    return K_VALUES * F.size(F.array_intersect(union, F.array_intersect(x, y))) >= SHARED * F.size(union)


def _most(n: str, rest: str) -> str:
    """The size of the largest set that a class of ``n`` shingles, ``rest`` of them from a value on, can have a link with if that
    value is the first that they have in common (the first of any linked pair lists both)."""
    return f"cast({100 + LIKE} * {rest} div {LIKE} AS int) - {n}"


def _reach(na: str, ma: str, nb: str, mb: str) -> Column:
    """Whether classes of these sizes, and of these largest partners, may have a link whose first common value is the list's."""
    return (F.col(na) <= F.col(mb)) & (F.col(nb) <= F.col(ma)) & (100 * F.least(na, nb) >= LIKE * F.greatest(na, nb))


class _Search:
    """Candidates, estimates and verified links over the classes of one input."""

    def __init__(self, classes: DataFrame, docs: DataFrame, files: int | None) -> None:
        self.files = files
        self.tables: list[DataFrame] = []
        self.classes = classes
        entries = classes.select("cls", F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
        shared = entries.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
        held = entries.join(shared, "v").groupBy("cls", "s").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("held"))
        # values that no other class has come first among the rarest; a small set is its own sketch, and so are those it may be like
        whole = K_VALUES * LIKE // 100
        common = f"CASE WHEN s <= {whole} THEN ({LIKE} * s + 99) div 100 ELSE {SHARED} END"
        prefix = held.select("cls", F.expr(f"slice(held, 1, greatest(0, cast(size(held) - ({common}) + 1 AS int)))").alias("held"))
        listed = prefix.select("cls", F.explode("held.v").alias("v"))
        sizes = listed.groupBy("v").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        needed = self.keep(listed.join(sizes, "v").select(F.col("cls").alias("id")).distinct())
        self.empty = needed.isEmpty()
        if self.empty:
            return
        kind = docs.schema["id"].dataType.simpleString()
        near, _ = split_by(docs, id_filter(needed, "id"), "id")
        self.sets = self.keep(near.join(needed, "id", "left_semi").mapInArrow(full_sets, f"id {kind}, hashes array<long>"), "lz4")
        # the same on the full sets of the classes left, where it is exact: most of a near copy's rarest shingles are its own
        each = self.sets.select(F.col("id").alias("cls"), F.size("hashes").alias("n"), F.explode("hashes").alias("v"))
        shared = each.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
        held = each.join(shared, "v").groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("held"))
        prefix = held.select("cls", "n", F.size("held").alias("c"), F.expr(f"slice(held, 1, greatest(0, cast(size(held) - ({LIKE} * n + 99) div 100 + 1 AS int)))").alias("held"))
        listed = prefix.select("cls", "n", "c", F.posexplode("held.v").alias("at", "v")).select("v", "cls", "n", F.expr(_most("n", "(c - at)")).alias("most"))
        # who is too large for any partner, even the smallest that its own size allows, needs none
        listed = self.keep(listed.where(f"100 * most >= {LIKE} * n"))
        sizes = listed.groupBy("v").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        self.lists = self.keep(listed.join(sizes, "v"))
        self.empty = self.lists.isEmpty()

    def keep(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        self.tables.append(keep(df, self.files, codec))
        return self.tables[-1]

    def best_pairs(self) -> DataFrame:
        """For each class the smaller class that it meets most often as the smallest of a list, or of a salted part of one."""
        part = F.pmod(F.xxhash64("cls"), F.ceil(F.col("m") / PART))
        met = None
        for keyed, keys in ((self.lists, ["v"]), (self.lists.withColumn("part", part), ["v", "part"])):
            centre = keyed.groupBy(*keys).agg(F.min(F.struct(F.col("cls").alias("a"), "n", "most")).alias("x"))
            found = keyed.join(centre, keys).where((F.col("cls") != F.col("x.a")) & _reach("n", "most", "x.n", "x.most")).select(F.col("x.a").alias("a"), F.col("cls").alias("b"))
            met = found if met is None else met.unionByName(found)
        counted = met.groupBy("b", "a").agg(F.count(F.lit(1)).alias("times"))
        return counted.groupBy("b").agg(F.min(F.struct((-F.col("times")).alias("t"), "a")).getField("a").alias("a"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs that the union sketch lets pass and whose full sets reach the threshold; no other full set is read."""
        of = lambda table, key, value, x: table.select(F.col(key).alias(x), F.col(value).alias(f"h{x}"))
        sketch = lambda x: of(self.classes, "cls", "sketch", x)
        full = lambda x: of(self.sets, "id", "hashes", x)
        likely = self.keep(pairs.select("a", "b").join(sketch("a"), "a").join(sketch("b"), "b").where(_alike("ha", "hb")).select("a", "b"))
        both = F.size(F.array_intersect("ha", "hb"))
        union = F.size("ha") + F.size("hb") - both
        return likely.join(full("a"), "a").join(full("b"), "b").where(100 * both >= LIKE * union).select("a", "b")

    def roots(self, parents: DataFrame) -> DataFrame:
        """``node``, ``component`` from links in which each class has one smaller parent, by pointer jumping."""
        at = parents.select(F.col("b").alias("node"), F.col("a").alias("component"))
        while True:
            up = at.select(F.col("node").alias("n"), F.col("component").alias("c"))
            new = self.keep(at.join(up, F.col("component") == F.col("n"), "left").select("node", F.coalesce("c", "component").alias("component"), F.col("c").isNotNull().alias("moved")))
            if new.where("moved").isEmpty():
                return new.drop("moved")
            at = new.drop("moved")

    def across(self, found: DataFrame) -> DataFrame:
        """``a``, ``b``: the pairs of a list in different components that may have a link. The largest component of a list needs no
        pairs inside, and cells that cannot hold a link are not compared."""
        placed = self.lists.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")
        sizes = placed.groupBy("v", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("v").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"))
        lists = self.keep(placed.join(sizes.where("comps > 1"), "v").select("v", "cls", "n", "most", "comp", "main"))
        # cells of a list, by size and largest partner; sizes that a link allows are in the same band or the next
        band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / LIKE)).cast("int")
        cells = lists.select("v", "n", "most").distinct().withColumn("band", band)
        others = cells.select("v", F.col("n").alias("xn"), F.col("most").alias("xmost"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
        pairs = cells.join(others, ["v", "band"]).where(_reach("n", "most", "xn", "xmost")).select("v", "n", "most", "xn", "xmost")
        strays = lists.where("comp <> main").select("v", F.col("n").alias("xn"), F.col("most").alias("xmost"), F.col("cls").alias("x"), F.col("comp").alias("xc"))
        met = strays.join(pairs, ["v", "xn", "xmost"]).join(lists, ["v", "n", "most"]).where(F.col("xc") != F.col("comp"))
        return met.select(F.least("x", "cls").alias("a"), F.greatest("x", "cls").alias("b")).distinct()

    def run(self) -> DataFrame | None:
        """``node``, ``component`` of the classes with a link; None where no list has two classes."""
        if self.empty:
            return None
        found = self.roots(self.keep(self.verified(self.best_pairs())))
        new = self.keep(self.verified(self.across(found)))
        if new.isEmpty():
            return found
        to = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
        between = new.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        merged = components(between, files=self.files)
        moved = found.join(merged.select(F.col("node").alias("component"), F.col("component").alias("whole")), "component", "left")
        # classes that were alone until now, and roots, are nodes of ``merged`` themselves
        return moved.select("node", F.coalesce("whole", "component").alias("component")).unionByName(merged.join(found.select("node"), "node", "left_anti"))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` and ``kept`` of every row."""
    kind = docs.schema[key].dataType.simpleString()
    plain = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    files = files_for(docs)
    members = keep(plain.mapInArrow(sketch, f"id {kind}, n long, s1 long, s2 long, sketch array<long>"), files)
    classes = members.where("n > 0 AND id IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min("id").alias("cls"), F.first("sketch").alias("sketch"))
    classes = keep(classes, files)
    search = _Search(classes, plain, files)
    found = search.run()
    placed = members.drop("sketch").join(classes.select("n", "s1", "s2", "cls"), ["n", "s1", "s2"], "left")
    if found is not None:
        placed = placed.join(keep(found, files).withColumnRenamed("node", "cls"), "cls", "left")
    else:
        placed = placed.withColumn("component", F.lit(None).cast(kind))
    forget(*search.tables)
    whole = F.when(F.col("n") > 0, F.coalesce("component", "cls")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), whole)
    return placed.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
