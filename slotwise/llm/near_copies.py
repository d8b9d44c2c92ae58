"""Near copies by shingle likeness: one document of each group of texts alike in at least ``LEAST`` of their shingles.

Two texts are linked when the Jaccard index of their sets of five-word shingles (words folded and cut
as in ``simhash``, shingles known by XXH64) is at least 0.8; connected components of the links are the
groups. Every link is checked on the whole sets; the indexes only propose groups of pairs:

* Equal sets are one vertex, so crowds of exact copies cost one row.
* Each set has a SimHash, the majority bits of its shingles' hashes. The index in Gray order (``simhash.links``) finds the
  fingerprints that differ in at most ``DISTANCE`` bits, and each component of these is a key its sets share.
* What lies further apart, down to the likeness asked for, shares one of ``BANDS`` further keys, each over ``ROWS`` minima of
  independent orders. Sets of likeness j share none with probability (1 - j ** ROWS) ** BANDS: 1.5e-5 at 0.8, less above.
  (A SimHash limit as wide as likeness 0.8 asks for, about 18 of 64 bits, lets 4 of 10,000 unrelated pairs
  through, and no node of the Gray tree would be dropped: work by the square of the corpus.)
* The sets of a key are compared with three leads of that key only: the one whose keys are shared most (the
  middle of a star of edited copies), the smallest, and one by a hash that changes from level to level. Links join
  sets to parts; keys whose sets are all in one part are done.
* Where a key still holds several parts, its sets split by one further minimum, and the smaller groups get leads of
  their own, for ``LEVELS`` levels. Alike sets stay together with their likeness as probability at each split and have
  many keys to be found by, unlike ones part soon. Rows are one per set and key at every level, however large a crowd.
* Leads and splits only save work. In the end all pairs of different parts are compared among the sets of keys that
  still hold several, as far as they can be alike: shingles stand in one order, rarest first, and a pair has to meet in a
  shingle after which both sets have enough left (``_rare``, ``_unmet``). No alike pair is lost to this filter.

So the links are those of all pairs that share a key. ``every_pair`` lists these pairs at the end without the filter; the
result is the same, and its rows grow with the square of a crowd that is not alike.

Defined cases: null, empty and blank texts have no shingle and are one group; fewer words than the shingle
are one shingle; a null doc_id stays only where its group has no other; rows equal in every column count as
one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from slotwise.llm.common import kept, packed, unpacked
from slotwise.llm.components import components
from slotwise.llm.simhash import FOLD, SEED, links

SHINGLE = 5
DISTANCE = 3  # bits in which the SimHashes of a group may differ
LEAST = (4, 5)  # likeness as a fraction, so that the check is exact
BANDS, ROWS = 28, 5
LEVELS = 4
_ORDERS = np.random.default_rng(5).integers(0, 1 << 64, (2, BANDS * (ROWS + LEVELS)), np.uint64)
XOR, FACTOR = _ORDERS[0], _ORDERS[1] | np.uint64(1)


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The set of a text's shingle hashes, sorted."""
    import xxhash

    words = text.encode().translate(FOLD).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    line = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = (ends[width - 1 :] if len(words) >= width else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n))


def minima(found: np.ndarray, first: int, last: int) -> np.ndarray:
    """The smallest members of a set under the orders numbered from ``first`` to ``last``."""
    least = np.full(last - first, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):
        np.minimum(least, ((found[at : at + 1024, None] ^ XOR[first:last]) * FACTOR[first:last]).min(axis=0), out=least)
    return least


def band_keys(found: np.ndarray) -> np.ndarray:
    """``BANDS`` signed longs; none for an empty set."""
    import xxhash

    if not len(found):
        return np.empty(0, np.int64)
    least = minima(found, 0, BANDS * ROWS).reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least)], np.uint64).view(np.int64)


def majority(found: np.ndarray) -> int:
    """SimHash of a set of shingle hashes: a bit is 1 if set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 4096):
        ones += np.unpackbits(found[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(found)).tobytes(), "big")


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard index of at least ``LEAST``."""
    top, bottom = LEAST
    if bottom * min(len(a), len(b)) < top * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return bottom * both >= top * (len(a) + len(b) - both)


@F.pandas_udf(StructType([StructField(c, LongType()) for c in ("s1", "s2", "n", "print")] + [StructField("bands", ArrayType(LongType()))]))
def _marks(texts):
    import pandas as pd
    import xxhash

    rows = []
    for text in texts:
        found = shingles(text)
        s = xxhash.xxh3_128_intdigest(found.tobytes())
        longs = np.array([s >> 64, s & ((1 << 64) - 1), majority(found)], np.uint64).view(np.int64)
        rows.append((longs[0], longs[1], len(found), longs[2], band_keys(found)))
    return pd.DataFrame(rows, columns=["s1", "s2", "n", "print", "bands"])


@F.pandas_udf(BinaryType())
def _sets(texts):
    import pandas as pd

    return pd.Series([shingles(t).tobytes() for t in texts], dtype=object)


@F.pandas_udf(ArrayType(ArrayType(LongType())))
def _splits(sets):
    """For each band, ``LEVELS`` further minima; the key by SimHash, last, takes those of the first band."""
    import pandas as pd

    found = (minima(np.frombuffer(x, np.uint64), BANDS * ROWS, BANDS * (ROWS + LEVELS)) for x in sets)
    return pd.Series([[*(bands := least.view(np.int64).reshape(BANDS, LEVELS)), bands[0]] for least in found], dtype=object)


def sizes_allow(a: Column, b: Column) -> Column:
    top, bottom = LEAST
    return bottom * F.least(a, b) >= top * F.greatest(a, b)


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are alike."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ones, twos = batch["x"].to_pylist(), batch["y"].to_pylist()
            stay = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(ones, twos, strict=True)]
            mask = pa.array(stay, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(mask), batch["b"].filter(mask)], names=["a", "b"])

    x, y = (sets.select(F.col("id").alias(k), F.col("set").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return pairs.distinct().join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _met(state: DataFrame, number: int) -> DataFrame:
    """Pairs (a, b) of every row of a group that holds several parts with the group's leads; ``state`` has id, n, score, cell and part."""
    row = ("id", "n", "part")
    leads = state.groupBy("cell").agg(
        F.min("part").alias("low"), F.max("part").alias("high"),
        F.max(F.struct("score", (-F.col("id")).alias("less"), *row)).alias("central"),
        F.min(F.struct(*row)).alias("first"),
        F.min(F.struct(F.xxhash64("id", F.lit(number)).alias("draw"), *row)).alias("drawn"),
    ).where("low <> high")
    three = F.array(*(F.struct(*(F.col(f"{k}.{c}") for c in row)) for k in ("central", "first", "drawn")))
    leads = kept(leads.select("cell", F.array_distinct(three).alias("leads")), f"near-leads-{number}")
    met = state.join(leads, "cell").withColumn("lead", F.explode("leads")).where("part <> lead.part").where(sizes_allow(F.col("n"), F.col("lead.n")))
    return met.select(F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b"))


def _mixed(named: DataFrame, purpose: str) -> DataFrame:
    """The keys (cell) of ``named`` that hold several parts."""
    ends = named.groupBy("cell").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    return kept(ends.where("low <> high").select("cell"), purpose)


def _members(sets: DataFrame) -> DataFrame:
    """(id, shingle) of every member of every set."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                found = [np.frombuffer(x, np.int64) for x in some["set"].to_pylist()]
                ids = np.repeat(some["id"].to_numpy(), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(found))], names=["id", "shingle"])

    return sets.select("id", "set").mapInArrow(listed, "id long, shingle long")


def _rare(unsettled: DataFrame, sets: DataFrame) -> DataFrame:
    """Of each unsettled set (id, n, part) those of its rarest shingles that can be the first one it shares with an alike set.

    All sets stand in one order: shingles of fewer sets first, ties by hash. What two sets share begins with their first
    common shingle, so each has at least as many left from there on as they share: top / (top + bottom) of n and the
    other's n together. ``room`` is (top + bottom) times what is left less top times n; it has to reach top times the other's n.
    """
    top, bottom = LEAST
    members = _members(sets.join(unsettled, "id", "left_semi"))
    shared = kept(members.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1"), "near-shingles")
    own = members.join(shared, "shingle").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("sets", "shingle"))).alias("own"))
    size, n = F.size("own"), F.col("n")
    first = F.filter("own", lambda _, at: bottom * (size - at) >= top * n)
    placed = own.join(unsettled, "id").select("id", "n", "part", size.alias("size"), F.posexplode(first).alias("at", "one"))
    room = (top + bottom) * (F.col("size") - F.col("at")) - top * n
    return kept(placed.select("one.shingle", "id", "n", "part", room.alias("room")), "near-rare")


def _unmet(unsettled: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs (a, b) of unsettled sets of different parts that can be alike. Rows meet only across parts of one shingle:
    first the parts, by their smallest n and largest room, then the sets of the parts that are left."""
    top = LEAST[0]
    rare = _rare(unsettled, sets)
    early = F.max(F.col("room") >= top * F.col("n")).alias("early")  # the smaller set of a pair has room for one of its own size
    ends = kept(rare.groupBy("shingle", "part").agg(F.min("n").alias("n"), F.max("room").alias("room"), early), "near-rare-parts")
    one, two = ends.where("early").alias("one"), ends.alias("two")
    fit = (F.col("one.room") >= top * F.col("two.n")) & (F.col("two.room") >= top * F.col("one.n"))
    both = one.join(two, (F.col("one.shingle") == F.col("two.shingle")) & (F.col("one.part") != F.col("two.part")) & fit)
    parts = both.select("one.shingle", F.least("one.part", "two.part").alias("low"), F.greatest("one.part", "two.part").alias("high")).distinct()
    parts = kept(parts, "near-meeting")
    least = ends.select("shingle", F.col("part").alias("high"), F.col("n").alias("least"), F.col("room").alias("most"))
    low, high = (rare.select("shingle", F.col("part").alias(p), F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("room").alias(f"room_{k}")) for p, k in (("low", "a"), ("high", "b")))
    met = parts.join(least, ["shingle", "high"]).join(low, ["shingle", "low"]).where((F.col("room_a") >= top * F.col("least")) & (F.col("most") >= top * F.col("n_a")))
    met = met.join(high, ["shingle", "high"]).where((F.col("room_a") >= top * F.col("n_b")) & (F.col("room_b") >= top * F.col("n_a")))
    return met.select("a", "b")


def _merged(parts: DataFrame, links: DataFrame, purpose: str) -> DataFrame:
    """``parts`` (id, part) after its parts are joined by ``links``; a part's name is its smallest id."""
    ends = (parts.select(F.col("id").alias(k), F.col("part").alias(p)) for k, p in (("a", "pa"), ("b", "pb")))
    joined = links
    for end in ends:
        joined = joined.join(end, end.columns[0])
    wider = components(joined.where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")), purpose)
    return kept(parts.join(wider, parts.part == wider.vertex, "left").select("id", F.coalesce("component", "part").alias("part")), f"{purpose}-parts")


def by_simhash(firsts: DataFrame) -> DataFrame:
    """The key (id, n, slot, cell) of every set that has a shingle by the component of its SimHash in the index in Gray order."""
    prints = firsts.where("n > 0").select("id", "n", "print")
    near = components(links(kept(prints.select(F.col("print").alias("fp")).distinct(), "near-prints"), DISTANCE), "near-simhash")
    part = F.coalesce("component", "print")
    named = prints.join(near, F.col("print") == F.col("vertex"), "left")
    return kept(named.select("id", "n", F.lit(BANDS).alias("slot"), F.xxhash64(F.lit("simhash"), part).alias("cell")), "near-simhash-keys")


def groups(firsts: DataFrame, texts: DataFrame, every_pair: bool = False) -> DataFrame:
    """``firsts`` has id, n, print, bands and key, one row per distinct set; ``texts`` has text and the key's h1 and h2.
    Returns (id, part) of all ids that share a key with another one; part is the smallest id of the group."""
    cells = firsts.select("id", "n", F.posexplode("bands").alias("slot", "cell")).unionByName(by_simhash(firsts))
    shared = kept(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "near-shared")
    cells = kept(cells.join(shared, "cell"), "near-cells")
    scores = cells.groupBy("id").agg(F.sum("members").alias("score"))
    wanted = firsts.join(scores, "id").select("id", "score", F.col("key.h1").alias("k1"), F.col("key.h2").alias("k2"))
    found = texts.join(wanted, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))).select("id", "score", _sets("text").alias("set"))
    sets = kept(found.dropDuplicates(["id"]), "near-sets")
    parts = sets.select("id", F.col("id").alias("part"))
    state = cells.join(sets.select("id", "score"), "id").select("id", "slot", "n", "score", "cell")

    for number in range(LEVELS + 1):
        if number:
            split = F.xxhash64("cell", F.col("splits")[number - 1])
            state = state.select("id", "n", "score", "splits", "part", split.alias("cell"))
        met = _met(state if number else state.withColumn("part", F.col("id")), number)
        parts = _merged(parts, kept(checked(met, sets), f"near-links-{number}"), f"near-{number}")
        named = state.drop("part").join(parts, "id")
        state = named.join(_mixed(named, f"near-mixed-{number}"), "cell")
        if not number:
            splits = sets.join(state.select("id").distinct(), "id", "left_semi").select("id", F.posexplode(_splits("set")).alias("slot", "splits"))
            state = state.join(splits, ["id", "slot"])
        state = kept(state, f"near-open-{number}")
        if not number:
            unsettled = state.select("id", "n", "cell")
        if state.isEmpty():
            break
    unsettled = unsettled.join(parts, "id")
    unsettled = kept(unsettled.join(_mixed(unsettled, "near-mixed-all"), "cell"), "near-open-all")
    if unsettled.isEmpty():
        return parts
    if every_pair:
        other = unsettled.select("cell", F.col("id").alias("b"), F.col("n").alias("m"), F.col("part").alias("part_b"))
        met = unsettled.join(other, "cell").where("id < b and part <> part_b").where(sizes_allow(F.col("n"), F.col("m"))).select(F.col("id").alias("a"), "b")
    else:
        met = _unmet(unsettled.select("id", "n", "part").distinct(), sets)
    return _merged(parts, kept(checked(met, sets), "near-links-all"), "near-all")


def keep_one(docs: DataFrame, every_pair: bool = False) -> DataFrame:
    """One document of each group: that with the smallest doc_id, of several such the one with the smallest row hash.

    Rows are known by a 128-bit hash of all columns, so that texts move only for the check of proposed pairs
    and for the last join.
    """
    hashable = [c for c, kind in docs.dtypes if "map<" not in kind]
    marks = {"h1": F.xxhash64(*hashable), "h2": F.xxhash64(F.lit("second"), *hashable)}
    rows = packed(docs, "row", text=F.col("text"), doc_id=F.col("doc_id"), **marks)
    last = F.when(F.col("doc_id").isNull(), 1).otherwise(0)
    key = F.struct(last.alias("last"), F.col("doc_id").alias("doc_id"), F.col("h1"), F.col("h2"))
    prints = rows.select(key.alias("key"), _marks("text").alias("mark")).select("key", "mark.*")
    firsts = prints.groupBy("s1", "s2").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("print").alias("print"), F.first("bands").alias("bands"))
    firsts = kept(firsts.select("key", "n", "print", "bands", F.monotonically_increasing_id().alias("id")), "near-firsts")
    joined = groups(firsts, rows.select("text", "h1", "h2"), every_pair)
    named = firsts.join(joined, "id", "left").select("key", F.coalesce("part", "id").alias("part"))
    chosen = named.groupBy("part").agg(F.min("key").alias("key")).select(F.col("key.h1").alias("k1"), F.col("key.h2").alias("k2")).distinct()
    chosen = kept(chosen, "near-chosen")
    stay = rows.select("row", "h1", "h2").join(chosen, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left_semi")
    return unpacked(stay.dropDuplicates(["h1", "h2"]), "row", docs)
