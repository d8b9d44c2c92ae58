"""I-Match fingerprints: hashes of sorted distinct terms over randomised subsets of a lexicon.

The lexicon is the band of terms whose inverse document frequency, ln(documents / documents with the
term), lies between ``IDF_LOW`` and ``IDF_HIGH``, counted over all documents. As each of its terms is in
at least a share e^-IDF_HIGH of all documents, it has at most (mean distinct terms per document) x
e^IDF_HIGH terms, at any size of the corpus; it enters the plan as a constant.

A text keeps its distinct lexicon terms in sorted order. Eight random subsets of the lexicon are drawn
at each of four rates (a quarter of the terms, a sixteenth, ...; by the low bits of a seeded hash of the
term), and the terms of each subset are hashed together. Dense subsets tell short texts apart, sparse
ones let long texts agree in spite of edits. Likeness is the best share, over the rates, of subsets with
equal hash among those that aren't empty in both texts; a rate speaks only if half of its subsets do.

Built-in SQL functions only, with no Python on the executors.

Defined cases: a null text is empty; a text without a lexicon term is judged by all of its terms; texts
without any term have the empty fingerprint; equal fingerprints have likeness 1; of equal doc_ids the
smaller text comes first, rows without doc_id come last; the only document of a table is its own next
one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from slotwise.llm.common import kept, lower_ascii, word_array

IDF_LOW, IDF_HIGH = 4.0, 6.0
SUBSETS = 8
RATES = (4, 16, 64, 256)
SEED = 7001
NONE = "-" * 8


def term_hashes(text: Column) -> Column:
    return F.array_distinct(F.transform(word_array(lower_ascii(text)), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, low: float = IDF_LOW, high: float = IDF_HIGH) -> list[int]:
    """Hashes of the terms in the band. ``docs`` has a column text."""
    n = docs.count()
    counts = docs.select(F.explode(term_hashes(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    band = counts.where((F.col("df") <= n * math.exp(-low)) & (F.col("df") >= max(2.0, n * math.exp(-high))))
    return sorted(r.term for r in band.select("term").collect())


def member_of(terms: list[int]):
    """A test for membership in a set of longs, constant in the plan: the set is laid out by hash slot, a lookup reads one slot."""
    slots = 1 << max(4, len(terms).bit_length())
    laid = sorted(terms, key=lambda t: (t % slots, t))
    starts, at = [], 0
    for slot in range(slots + 1):
        while at < len(laid) and laid[at] % slots < slot:
            at += 1
        starts.append(at)
    table = F.split(F.lit(",".join(map(str, laid))), ",").cast("array<bigint>")
    ends = F.split(F.lit(",".join(map(str, starts))), ",").cast("array<int>")

    def test(x: Column) -> Column:
        slot = F.pmod(x, F.lit(slots)).cast("int")
        first = F.get(ends, slot)
        return F.array_contains(F.slice(table, first + 1, F.get(ends, slot + 1) - first), x)

    return test if terms else lambda x: F.lit(False)


def cells_of(text: Column, terms: list[int]) -> Column:
    """The fingerprint as an array of hashes, rate by rate."""
    every = term_hashes(text)
    # Cut to the lexicon, or all terms where that leaves none; one-element arrays give an expression a name.
    within = member_of(terms)
    known = F.transform(F.array(every), lambda t: F.transform(F.array(F.filter(t, within)), lambda k: F.when(F.size(k) > 0, k).otherwise(t)))
    ordered = F.transform(F.flatten(known), lambda t: F.array_sort(t))

    def chain(of: Column, j: Column) -> Column:
        """Hashes of subset j at all rates; each rate narrows the one before."""
        step = lambda s, rate: F.get(
            F.transform(
                F.array(F.filter(s["left"], lambda t: F.pmod(F.xxhash64(t, j + F.lit(SEED)), rate) == 0)),
                lambda left: F.struct(left.alias("left"), F.concat(s["out"], F.array(print_of(left))).alias("out")),
            ),
            F.lit(0),
        )
        zero = F.struct(of.alias("left"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(F.array(*(F.lit(r) for r in RATES)), zero, step, lambda s: s["out"])

    per_subset = F.flatten(F.transform(ordered, lambda t: F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda j: chain(t, j))))
    by_rate = F.transform(F.array(per_subset), lambda p: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(RATES) - 1)), lambda r: F.transform(p, lambda c: F.get(c, r)))))
    return F.get(by_rate, F.lit(0))


def print_of(terms: Column) -> Column:
    digest = F.lower(F.lpad(F.hex(F.shiftrightunsigned(F.xxhash64(terms), 32)), 8, "0"))
    return F.when(F.size(terms) > 0, digest).otherwise(F.lit(NONE))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1, of two fingerprints as arrays."""
    shares = []
    for k in range(len(RATES)):
        part = lambda cells: F.slice(cells, k * SUBSETS + 1, SUBSETS)  # noqa: B023, E731
        pairs = F.zip_with(part(a), part(b), lambda x, y: F.when((x == NONE) & (y == NONE), F.lit(None)).otherwise((x == y).cast("int")))
        told = F.filter(pairs, lambda x: x.isNotNull())
        equal = F.size(F.filter(told, lambda x: x == 1))
        shares.append(F.when(F.size(told) * 2 >= SUBSETS, equal / F.size(told)).otherwise(F.lit(0.0)))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(*shares))


def _bucket(doc_id: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below the id, by two short searches; rows without id are in bucket 0."""
    if not bounds:
        return F.when(doc_id.isNull(), F.lit(0)).otherwise(F.lit(1))
    width = math.isqrt(len(bounds)) + 1
    runs = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    literal = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    below = lambda xs: F.size(F.filter(xs, lambda x: x <= doc_id))
    run = below(literal([r[0] for r in runs]))
    inner = below(F.get(F.array(*(literal(r) for r in runs)), run - 1))
    place = F.when(run == 0, F.lit(0)).otherwise((run - 1) * width + inner)
    return F.when(doc_id.isNull(), F.lit(0)).otherwise(place + 1)


def with_next(rows: DataFrame) -> DataFrame:
    """``rows`` has doc_id, text and cells; adds next_text and next_cells, those of the next lower doc_id
    (after the last row: of the first).

    Rows are dealt by ranges of doc_id, so the texts move once. A copy of each range's first row is put
    behind the last row of the range above.
    """
    n = 8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select("doc_id").where("doc_id is not null").repartitionByRange(n, "doc_id")
    bounds = sorted(r[0] for r in ids.groupBy(F.spark_partition_id()).agg(F.min("doc_id")).select("min(doc_id)").collect())
    placed = rows.withColumn("bucket", _bucket(F.col("doc_id"), bounds)).withColumn("copy", F.lit(0))
    tops = placed.groupBy("bucket").agg(F.max("doc_id").alias("top")).orderBy(F.desc("bucket")).collect()
    if not tops:
        return rows.withColumns({"next_text": F.lit(""), "next_cells": F.col("cells")})
    # Bucket of each range's first row -> the range above it, whose last row it follows; the very first follows the very last.
    above = {t.bucket: tops[i - 1].bucket for i, t in enumerate(tops)}
    move = F.create_map(*(F.lit(x) for pair in above.items() for x in pair))
    top_ids = [t.top for t in tops if t.top is not None]
    heads = placed.where(F.col("doc_id").isin(top_ids) | F.col("doc_id").isNull())
    least = heads.groupBy("bucket", "doc_id").agg(F.min("text").alias("text"), F.min_by("cells", "text").alias("cells"))
    copies = kept(least.select("doc_id", "text", "cells", F.element_at(move, F.col("bucket")).alias("bucket"), F.lit(1).alias("copy")), "imatch-heads")
    order = Window.partitionBy("bucket").orderBy("copy", F.desc_nulls_last("doc_id"), "text")
    both = placed.unionByName(copies)
    following = both.withColumns({"next_text": F.lead("text").over(order), "next_cells": F.lead("cells").over(order)})
    return following.where("copy = 0").drop("bucket", "copy")


def report(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and the likeness to it and to the next document."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    terms = lexicon(rows)
    chained = with_next(rows.withColumn("cells", cells_of(F.col("text"), terms)))
    tail = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - tail), F.substring(F.col("next_text"), F.lit(1), tail))
    done = chained.withColumn("edited", edited).withColumn("edited_cells", cells_of(F.col("edited"), terms))
    return done.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.array_join("cells", "").alias("fingerprint"), F.array_join("edited_cells", "").alias("edited_fingerprint"),
        likeness(F.col("cells"), F.col("edited_cells")).alias("near_edited"), likeness(F.col("cells"), F.col("next_cells")).alias("near_next"),
    )
