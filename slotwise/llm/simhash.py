"""SimHash near-duplicates with an index in Gray order.

A document's fingerprint is the bitwise majority over the XXH64 values of its word shingles. Distinct
fingerprints are sorted by Gray rank, so that neighbours in the order differ in few bits, and cut
into blocks of equal size (hot groups of copies are one fingerprint, and groups of near copies spread
over as many blocks as they need). Every node of the index carries the bits that all fingerprints
below it share, as (mask, pattern): a search adds up the differences to the shared patterns from the
top down and drops a whole group as soon as they pass the limit.

* The upper tree over blocks is the only thing sent to all tasks. It has at most ``MOST_BLOCKS``
  leaves at any size of the corpus (blocks grow instead), 24 bytes each.
* Each block searches the upper tree for itself and later blocks, and ships its fingerprints,
  packed, to the blocks they may link to. There they meet that block's own tree.
* Of the links found in one meeting only a spanning forest is kept, so rows stay in proportion to
  fingerprints, not to pairs; connected components of these edges are the same.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other; fewer words
than the shingle are one shingle; repeated rows and ties share a fingerprint and a component; a null
doc_id belongs to a component but never names it unless it is alone (then null); an empty table gives
an empty result; other columns pass through ``keep_one`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from slotwise.llm.common import LOWER, UPPER, kept, packed, unpacked
from slotwise.llm.components import components

SHINGLE = 3
SEED = 42
DISTANCE = 2
BLOCK = 1024
MOST_BLOCKS = 1 << 16
FAN = 8
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Majority bits of the shingles' hashes; UTF-8 bytes are cut, folded and hashed without decoding again."""
    import xxhash

    words = text.encode().translate(FOLD).split() if text else []  # bytes.split() cuts at exactly \x20 and \x09-\x0D
    if not words:
        return 0
    line = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = (ends[width - 1 :] if len(words) >= width else ends[-1:]).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + 4096], stops[at : at + 4096])], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


@F.pandas_udf(LongType())
def _fingerprints(texts):
    import pandas as pd

    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64), dtype="int64")


def gray_rank(fp: Column) -> Column:
    """Position of the fingerprint in the reflected binary order, as a signed long in unsigned order."""
    rank = fp
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def shared_bits(fps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask, pattern) of each run of fingerprints that begins at ``starts``."""
    all_of, any_of = np.bitwise_and.reduceat(fps, starts), np.bitwise_or.reduceat(fps, starts)
    mask = ~(all_of ^ any_of)
    return mask, all_of & mask


class Tree:
    """Nodes over leaves in Gray order, ``FAN`` to a parent; each holds the bits all leaves below share."""

    def __init__(self, mask: np.ndarray, pattern: np.ndarray):
        self.levels = [(mask, pattern)]
        while len(self.levels[-1][0]) > 1:
            mask, pattern = self.levels[-1]
            starts = np.arange(0, len(mask), FAN)
            common = np.bitwise_and.reduceat(mask, starts)
            ones, any_of = np.bitwise_and.reduceat(pattern, starts), np.bitwise_or.reduceat(pattern, starts)
            common = common & ~(ones ^ any_of)
            self.levels.append((common, ones & common))

    def search(self, fps: np.ndarray, limit: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) pairs whose shared bits differ in at most ``limit`` places, leaves from ``least`` on."""
        query = np.arange(len(fps))
        node = np.zeros(len(fps), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            mask, pattern = self.levels[depth]
            if depth < len(self.levels) - 1:
                query, node = np.repeat(query, FAN), np.repeat(node * FAN, FAN) + np.tile(np.arange(FAN), len(node))
                inside = (node < len(mask)) & ((node + 1) * FAN**depth > least)
                query, node = query[inside], node[inside]
            near = np.bitwise_count((fps[query] ^ pattern[node]) & mask[node]) <= limit
            query, node = query[near], node[near]
        return query, node


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (a, b): each vertex with the smallest one it reaches."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(names))
    while True:
        least = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], least)
        np.minimum.at(new, root[y], least)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return names[root != np.arange(len(names))], names[root[root != np.arange(len(names))]]
        root = new


def links_between(probes: np.ndarray, members: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links from ``probes`` to ``members`` (sorted by Gray rank)."""
    tree = Tree(np.full(len(members), ONES), members)
    froms, tos = [], []
    for at in range(0, len(probes), 256):
        part = probes[at : at + 256]
        q, m = tree.search(part, limit)
        other = part[q] != members[m]
        a, b = forest(part[q][other], members[m][other])
        froms.append(a)
        tos.append(b)
    return forest(np.concatenate(froms), np.concatenate(tos))


def links(distinct: DataFrame, limit: int = DISTANCE) -> DataFrame:
    """``distinct`` has a column fp, no value twice; returns edges (a, b) that connect what links connect."""
    spark = distinct.sparkSession
    n = distinct.count()
    size = max(BLOCK, -(-n // (MOST_BLOCKS // 2)))
    rank = gray_rank(F.col("fp"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of ``size`` fingerprints in Gray order: one row for each block, named by its first rank."""
        left = np.empty(0, np.int64)

        def block(fps):
            mask, pattern = shared_bits(fps.view(np.uint64), np.array([0]))
            rank = fps.view(np.uint64).copy()
            for shift in (1, 2, 4, 8, 16, 32):
                rank ^= rank >> np.uint64(shift)
            first = (rank[:1] ^ np.uint64(1 << 63)).view(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(first), pa.array(mask.view(np.int64)), pa.array(pattern.view(np.int64)), pa.array([fps.tobytes()], pa.binary())],
                names=["first", "mask", "pattern", "fps"],
            )

        for batch in batches:
            left = np.concatenate([left, batch["fp"].to_numpy(zero_copy_only=False)])
            while len(left) >= size:
                yield block(left[:size])
                left = left[size:]
        if len(left):
            yield block(left)

    ordered = distinct.select("fp").repartitionByRange(rank).sortWithinPartitions(rank)
    blocks = kept(ordered.mapInArrow(cut, "first long, mask long, pattern long, fps binary"), "simhash-blocks")
    # Block names, masks and patterns only: at most MOST_BLOCKS / 2 full blocks and one short one for each range.
    upper = blocks.select("first", "mask", "pattern").orderBy("first").toPandas()
    if upper.empty:
        return spark.createDataFrame([], "a long, b long")
    shared = spark.sparkContext.broadcast(tuple(upper[c].to_numpy(np.int64) for c in ("first", "mask", "pattern")))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Fingerprints of a block, packed for each block they may link to (its own and later ones)."""
        first, mask, pattern = shared.value
        tree = Tree(mask.view(np.uint64), pattern.view(np.uint64))
        for batch in batches:
            for own, data in zip(batch["first"].to_pylist(), batch["fps"].to_pylist(), strict=True):
                fps = np.frombuffer(data, np.int64)
                at = int(np.searchsorted(first, own))
                found = [tree.search(fps[i : i + 512].view(np.uint64), limit, at) for i in range(0, len(fps), 512)]
                query = np.concatenate([q + i * 512 for i, (q, _) in enumerate(found)])
                leaf = np.concatenate([x for _, x in found])
                order = np.argsort(leaf, kind="stable")
                query, leaf = query[order], leaf[order]
                starts = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
                packs = [fps[part].tobytes() for part in np.split(query, starts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(first[leaf[starts]]), pa.array(packs, pa.binary())], names=["target", "probes"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for probes, members in zip(batch["probes"], batch["fps"], strict=True):
                a, b = links_between(*(np.frombuffer(x.as_py(), np.uint64) for x in (probes, members)), limit)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    spread = blocks.select("first", "fps").repartition("first")
    probes = spread.mapInArrow(route, "target long, probes binary")
    met = probes.join(blocks.select("first", "fps"), F.col("target") == F.col("first"))
    return met.select("probes", "fps").mapInArrow(meet, "a long, b long")


def parts(prints: DataFrame, limit: int = DISTANCE) -> DataFrame:
    """``prints`` has fp and key (a sortable value, smallest first); returns (fp, component: its smallest key)."""
    firsts = kept(prints.groupBy("fp").agg(F.min("key").alias("first")), "simhash-firsts")
    joined = components(links(firsts.select("fp"), limit), "simhash")
    named = firsts.join(joined, firsts.fp == joined.vertex, "left").select("fp", "first", F.coalesce("component", "fp").alias("part"))
    least = named.groupBy(F.col("part").alias("whole")).agg(F.min("first").alias("component"))
    return named.join(least, F.col("part") == F.col("whole")).select(F.col("fp").alias("print"), "component")


def report(docs: DataFrame) -> DataFrame:
    """Per document: fingerprint in hex and the smallest doc_id it reaches over links."""
    prints = docs.select("doc_id", _fingerprints("text").alias("fp"), F.col("doc_id").alias("key"))
    prints = kept(prints, "simhash-prints")
    joined = prints.join(parts(prints), F.col("fp") == F.col("print"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, limit: int = DISTANCE) -> DataFrame:
    """One document of each component: that with the smallest doc_id, of several such the one with the smallest row hash.

    Rows are known by a 128-bit hash of all columns, so the texts move once, for the last join.
    Rows that are equal in every column count as one.
    """
    hashable = [c for c, kind in docs.dtypes if "map<" not in kind]
    marks = {"h1": F.xxhash64(*hashable), "h2": F.xxhash64(F.lit("second"), *hashable)}
    rows = packed(docs, "row", text=F.col("text"), doc_id=F.col("doc_id"), **marks)
    last = F.when(F.col("doc_id").isNull(), 1).otherwise(0)
    key = F.struct(last.alias("last"), F.col("doc_id").alias("doc_id"), F.col("h1"), F.col("h2"))
    prints = kept(rows.select(key.alias("key"), _fingerprints("text").alias("fp")), "simhash-prints")
    chosen = parts(prints, limit).select(F.col("component.h1").alias("k1"), F.col("component.h2").alias("k2")).distinct()
    chosen = kept(chosen, "simhash-chosen")
    stay = rows.select("row", "h1", "h2").join(chosen, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left_semi")
    return unpacked(stay.dropDuplicates(["h1", "h2"]), "row", docs)
