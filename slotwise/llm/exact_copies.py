"""Exact dedup by distributed MSD radix partitioning.

A text's key is its length in bytes followed by its bytes (white space squeezed first). The key is cut into
digits: the length with the first bytes, then runs of bytes that grow eightfold up to ``WIDEST``. Each
round splits every open group by its next digit, an ordinary aggregation on (group, digit) that is
summed in the map tasks first. Groups of one row are settled, groups whose text has ended are copies, and
the others go on. Equal digits are equal bytes, so no digest decides anything.

Data moves as little as the rounds allow: the first digit settles nearly all texts without copies, only the
texts of open groups are written, digit by digit, and a round reads the one digit it needs. A crowd
of copies is one row per task in every aggregation; the joins that hand a group's number back
to its rows have one row per key on the other side, so Spark splits them where they are hot.

Defined cases: null counts as empty, blank texts are equal; of equal texts the row with the smallest doc_id
stays, a null doc_id only where the group has no other; of several rows with that doc_id the one with the
smallest row hash stays, of rows equal in every column any one; an empty table gives an empty result. Other
columns pass through, whatever their names. A text of any length takes as many rounds as it has digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slotwise.llm.common import BLANKS, kept, unpacked
from slotwise.session import shared_folder
from slotwise.sources.writers import write_table

FIRST = 32  # bytes in the first digit, beside the length
GROWTH = 8
WIDEST = 1 << 20


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ").cast("binary")


def digit_starts(size: int) -> list[int]:
    """Where the digits of a text of ``size`` bytes begin, the first one left out."""
    starts, at, width = [], FIRST, FIRST * GROWTH
    while at < size:
        starts.append(at)
        at, width = at + width, min(width * GROWTH, WIDEST)
    return starts


def _opened(docs: DataFrame, carried: dict[str, Column]) -> DataFrame:
    """First round: every row with the number of rows that share its first digit, and the whole key of those that are not alone."""
    hashable = [c for c, kind in docs.dtypes if "map<" not in kind]
    last = F.when(F.col("doc_id").isNull(), 1).otherwise(0)
    order = F.struct(last.alias("last"), F.col("doc_id").alias("doc_id"), F.xxhash64(*hashable).alias("mark"))
    rows = docs.select(F.struct(*(c.alias(k) for k, c in carried.items())).alias("carried"), order.alias("order"), normalised(F.col("text")).alias("whole"))
    rows = rows.withColumns({"size": F.octet_length("whole"), "head": F.substring("whole", 1, FIRST)})
    heads = rows.groupBy("size", "head").agg(F.count(F.lit(1)).alias("members")).withColumn("part", F.monotonically_increasing_id())
    heads = kept(heads, "copies-heads").select(F.col("size").alias("of_size"), F.col("head").alias("of_head"), "members", "part")
    met = rows.join(heads, (F.col("size") == F.col("of_size")) & (F.col("head") == F.col("of_head")))
    rest = F.when((F.col("members") > 1) & (F.col("size") > FIRST), F.col("whole"))
    return kept(met.select(F.monotonically_increasing_id().alias("id"), "carried", "order", "size", "members", "part", rest.alias("rest")), "copies-open")


def _digits(opened: DataFrame, starts: list[int]) -> DataFrame:
    """(id, digit, place): the digits behind the first one of all texts that are still open, one folder per place."""
    at = F.lit([*starts, starts[-1] + WIDEST])
    places = F.posexplode(F.transform(F.filter(F.lit(starts), lambda s: s < F.col("size")), lambda s: s))
    cuts = opened.where("rest is not null").select("id", "rest", places.alias("place", "start"))
    digit = F.col("rest").substr(F.col("start") + 1, at[F.col("place") + 1] - F.col("start"))
    return write_table(cuts.select("id", "place", digit.alias("digit")), shared_folder(opened.sparkSession, "copies-digits"), ["place"])


def classes(docs: DataFrame, **carried: Column) -> DataFrame:
    """The carried columns of every row, with keep_id, group_size and whether it stays."""
    opened = _opened(docs, carried)
    longest = opened.where("rest is not null").agg(F.max("size")).first()[0] or 0
    starts = digit_starts(longest)
    digits = _digits(opened, starts) if starts else None
    state = opened.where("members > 1").select("id", "order", "size", "part")
    ended = state.where(F.col("size") <= FIRST).withColumn("place", F.lit(-1))
    for place, start in enumerate(starts):
        cut = digits.where(F.col("place") == place).select("id", "digit").join(state.where(F.col("size") > start), "id")
        groups = cut.groupBy("part", "digit").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        groups = kept(groups.select("part", "digit", F.monotonically_increasing_id().alias("next")), f"copies-groups-{place}")
        state = kept(cut.join(groups, ["part", "digit"]).select("id", "order", "size", F.col("next").alias("part")), f"copies-state-{place}")
        stop = starts[place + 1] if place + 1 < len(starts) else longest
        ended = ended.union(state.where(F.col("size") <= stop).withColumn("place", F.lit(place)))
        state = state.where(F.col("size") > stop)
    ended = ended.withColumn("rank", F.struct("order.*", "id"))
    firsts = ended.groupBy("place", "part").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("group_size"))
    firsts = kept(firsts, "copies-firsts")
    found = ended.join(firsts, ["place", "part"]).select("id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("first.id") == F.col("id")).alias("kept"))
    found = kept(found, "copies-found")
    alone = opened.where("members = 1").select("carried.*", F.col("order.doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    shared = opened.where("members > 1").select("id", "carried", "order").join(found, "id", "left")
    own = F.col("group_size").isNull()
    return alone.union(
        shared.select(
            "carried.*", F.when(own, F.col("order.doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce("kept", F.lit(True)).alias("kept"),
        )
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns."""
    found = classes(docs, row=F.struct(*(F.col(f"`{c}`") for c in docs.columns)))
    return unpacked(found.where("kept"), "row", docs)


def report(docs: DataFrame) -> DataFrame:
    """Per document: the row that stays for it, the size of its group, and the digest of its normalised text."""
    found = classes(docs.select("doc_id", "text"), doc_id=F.col("doc_id"), text_sha256=F.sha2(normalised(F.col("text")), 256))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
with squeezed as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as text from documents
)
select doc_id, min(doc_id) over (partition by text) as keep_id, count(*) over (partition by text) as group_size,
  row_number() over (partition by text order by doc_id nulls last) = 1 as kept, sha256(text) as text_sha256
from squeezed
"""
