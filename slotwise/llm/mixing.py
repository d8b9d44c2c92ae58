"""Mixing sources to target weights by systematic sampling.

Every document of a source expects ``target / source size`` copies. Documents are laid out in one
line per source, ordered by size, and the expected copies are summed along it; after one random
offset per source, a document is emitted once per integer boundary that its stretch crosses. With
documents of similar size side by side, the words taken stay within about one long document of the
target.

Defined cases: a null or blank text has size 0; a null source is a source of its own, last in order;
repeated rows are documents of their own; a source without words has target 0 and emits nothing; an
empty table gives an empty result. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from slotwise.llm.common import kept, numbered, unpacked, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"


def offset(source: Column, seed: str = SEED) -> Column:
    """One number in [0, 1) per source, a multiple of 2^-20 so that sums stay exact."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit(":"), source), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Target words per source: shares of the total by weight, stopped at ``most`` times the source's size.

    ``sizes`` has source and source_size. Sources at their bound are set apart and the rest is
    shared again by weight until none is above; only three sums come to the driver in each step.
    """
    placed = numbered(sizes, [F.col("source").asc_nulls_last()], [], "place", "mix-sources")
    cycle = F.array(*(F.lit(int(w)) for w in weights))
    placed = kept(placed.withColumn("weight", F.get(cycle, ((F.col("place") - 1) % len(weights)).cast("int"))), "mix-weights")
    total = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    bound, rate = F.lit(most) * F.col("source_size"), 0.0
    stopped_before = -1
    stopped = F.lit(False)
    while True:
        n, full, weight = placed.agg(
            F.count(F.when(stopped, 1)),
            F.coalesce(F.sum(F.when(stopped, bound)), F.lit(0)),
            F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0)),
        ).first()
        if n == stopped_before or not weight:
            break
        stopped_before, room = n, share * total - full
        rate = F.lit(float(room)) / F.lit(float(weight))
        stopped = F.col("weight") * F.lit(float(room)) / F.lit(float(weight)) > bound
        share_of = F.col("weight") * F.lit(float(room)) / F.lit(float(weight))
    if isinstance(rate, float):
        share_of = F.lit(0.0)
    return placed.select("source", "source_size", F.least(share_of, bound.cast("double")).alias("target"))


def mix(docs: DataFrame, columns: Sequence[str], seed: str = SEED, **shares) -> DataFrame:
    """(row, plan): the named columns of every row beside its size, its source's size and target, and its copies."""
    row = F.struct(*columns).alias("row")
    sized = docs.select(row, F.col("source"), word_count(F.col("text")).alias("size"), F.col("doc_id"))
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id").asc_nulls_last()]
    lined = numbered(sized, order, ["source"], "place", "mix-line")
    per_source = targets(lined.groupBy("source").agg(F.sum("size").alias("source_size")), **shares)
    per_source = kept(per_source.withColumnRenamed("source", "key"), "mix-targets")
    rows = lined.join(per_source, F.col("source").eqNullSafe(F.col("key")))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = lambda place: F.floor(place * expected + offset(F.col("source"), seed))
    copies = crossed(F.col("place")) - crossed(F.col("place") - 1)
    return rows.select("row", F.struct("size", "source_size", "target", copies.alias("copies")).alias("plan"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as the plan says, with the columns of ``docs``."""
    rows = mix(docs, docs.columns, **options)
    times = F.explode(F.sequence(F.lit(1), F.col("plan.copies"))).alias("copy")
    return unpacked(rows.where(F.col("plan.copies") > 0).select("row", times), "row", docs)


def report(docs: DataFrame) -> DataFrame:
    """Per document: its size, its source's size and target, and the words the mix takes from it."""
    rows = mix(docs, ["doc_id"])
    return rows.select(
        F.col("row.doc_id").alias("doc_id"), F.col("plan.size").alias("size"), F.col("plan.source_size").alias("source_size"),
        F.col("plan.target").alias("target"), (F.col("plan.copies") * F.col("plan.size")).alias("taken"),
    )


SQL = """
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents
), sources as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as place from sized group by source
), weighted as (
  select *, case (place - 1) % 3 when 0 then 3 when 1 then 1 else 2 end as weight from sources
), ranked as (
  select *, 2.0::double * source_size / weight as bound,
    1.5::double * sum(source_size) over () as budget,
    coalesce(sum(2 * source_size) over (order by 2.0::double * source_size / weight rows between unbounded preceding and 1 preceding), 0)::double as full_before,
    sum(weight) over (order by 2.0::double * source_size / weight rows between current row and unbounded following)::double as weight_after
  from weighted
), free as (
  select min_by(budget - full_before, bound) filter (where (budget - full_before) / weight_after <= bound) as room,
    min_by(weight_after, bound) filter (where (budget - full_before) / weight_after <= bound) as weight_left
  from ranked
), goals as (
  select w.source, w.source_size, least(w.weight * f.room / f.weight_left, (2 * w.source_size)::double) as target,
    ('0x' || substr(md5('mix-1' || coalesce(':' || w.source, '')), 1, 5))::bigint / 1048576.0::double as shift
  from weighted w, free f
), lined as (
  select s.doc_id, s.size, g.source_size, g.target, g.shift,
    case when g.source_size > 0 then g.target / g.source_size else 0 end as expected,
    row_number() over (partition by s.source order by s.size, s.doc_id nulls last) as place
  from sized s join goals g on s.source is not distinct from g.source
)
select doc_id, size, source_size, target,
  ((floor(place * expected + shift) - floor((place - 1) * expected + shift)) * size)::bigint as taken
from lined
"""
