"""N-gram language model in an Elias-Fano trie.

Counts come from the whole training corpus. Words are 64-bit hashes; a word's number is its rank among
the hashes, so the vocabulary itself is one monotone sequence. The trie has a level per order: level 1
holds the vocabulary, level k the children of every node of level k-1. Children of a node are found by
two monotone pointers and a successor search for (node's place x vocabulary + word), which is relative
to its context. Levels are cut into files by ranges of their nodes (all children of a node stay
together; there are at most as many as words). N-grams are counted once per task, packed, and dealt by ranges
of their contexts, which are cut from the counts of the level above, so the task that adds up a range holds
it in order and writes its files at once. Files lie in the shared folder and are memory-mapped by the tasks
that use them: processes of a machine share their pages. Through the driver pass the list of files and
about four cut points for each range of ``BUCKET`` tokens.

Probabilities are interpolated absolute discounting: for a context h with count N(h) and kept
children c, p(w|h) = max(c - D, 0) / N(h) + (1 - sum(c - D) / N(h)) p(w|h'), down to the unigram
(c + 1/2) / (N + (V + 1)/2). All n-grams of the training corpus are kept (``MIN_COUNT`` is 1; with a higher
one the mass of the others goes to the lower order, so probabilities still sum to 1). Kept log10 values are quantised to 1/2048 of a decade.

Texts are split in Arrow batches, and each distinct word of a slice is hashed once. Likewise the distinct n-grams of
a slice are looked up, in the order of the files, so the cost of a file is shared by the n-grams of many texts.

A text is words and one end token; the end token is also the context of the first word.

Defined cases: null and blank texts are the end token alone; unknown words have count 0; without
training rows every token has probability 1 under the unigram formula (V = N = 0), so scores are 0;
repeated rows count as often as they occur; a null doc_id hashes like the empty text; extra columns
are ignored; two words with equal 64-bit hashes would be one word; more than 3e9 distinct words are an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from slotwise.llm.common import kept
from slotwise.llm.elias_fano import EliasFano
from slotwise.llm.languages import remainder
from slotwise.llm.storage import NewFile, mapped
from slotwise.session import shared_folder

ORDER = 3
MIN_COUNT = 1
DISCOUNT = 0.75
SHARD = 1 << 20  # entries of a file, beyond the end of a node's children
PAIRS = 1 << 19  # n-grams a task adds up at once
SCORED = 1 << 20  # tokens a task scores at once, beyond the last text
TEXTS = 1 << 23  # bytes of texts a task splits at once, beyond the last one
BUCKET = 1 << 20  # training tokens of a range of contexts, but for single contexts that hold more
MOST_WORDS = 3_000_000_000  # a context of two words is one signed 64-bit number
SCALE = 2048.0
END = "\x20"  # no word can hold a blank


# ---- files of a level -------------------------------------------------------------------------


def save(folder: str, scalars: dict, arrays: dict[str, np.ndarray]) -> str:
    """Header and aligned arrays in a new file; returns its URI."""
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (at, str(a.dtype), len(a))
        at += (a.nbytes + 63) // 64 * 64
    text = json.dumps({"scalars": scalars, "arrays": head}).encode()
    text += b" " * (-(len(text) + 8) % 64)
    file = NewFile(folder, ".trie")
    file.write(len(text).to_bytes(8, "little") + text)
    for a in arrays.values():
        file.write(a.tobytes() + bytes(-a.nbytes % 64))
    file.close()
    return file.uri


def load(uri: str) -> tuple[dict, dict[str, np.ndarray]]:
    data = mapped(uri)
    size = int.from_bytes(data[:8], "little")
    head = json.loads(data[8 : 8 + size])
    arrays = {k: np.frombuffer(data, t, n, 8 + size + at) for k, (at, t, n) in head["arrays"].items()}
    return head["scalars"], arrays


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * SCALE), 0, 65535).astype(np.uint16)


def sequence(name: str, s: EliasFano) -> tuple[dict, dict]:
    return {name: (s.n, s.width)}, {f"{name}.{k}": a for k, a in s.arrays().items()}


def sequence_of(name: str, scalars: dict, arrays: dict) -> EliasFano:
    return EliasFano(*scalars[name], {k: arrays[f"{name}.{k}"] for k in ("low", "high", "ones")})


def in_order(node: np.ndarray, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by node, then word; marks of the first of equal pairs in that order). Words are -1 up to ``words``."""
    if int(node.max()) < (1 << 63) // (words + 1) - 1:
        key = node * (words + 1) + (word + 1)
        order = np.argsort(key)
        key = key[order]
        return order, np.r_[True, key[1:] != key[:-1]]
    order = np.lexsort((word, node))
    node, word = node[order], word[order]
    return order, np.r_[True, (node[1:] != node[:-1]) | (word[1:] != word[:-1])]


class Vocabulary:
    """Level 1: hashes (as unsigned in order), counts. Files are opened when first needed."""

    def __init__(self, files: list[tuple[int, int, str]], total: int):
        self.files, self.total = sorted(files), total
        self.firsts = np.array([f[0] for f in self.files], np.uint64)
        self.starts = np.concatenate([[0], np.cumsum([f[1] for f in self.files])]).astype(np.int64)
        self.size = int(self.starts[-1])
        self.open: dict[int, tuple] = {}

    def _file(self, k: int):
        if k not in self.open:
            scalars, arrays = load(self.files[k][2])
            self.open[k] = sequence_of("hash", scalars, arrays), arrays["count"]
        return self.open[k]

    def number(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, count) of each hash (int64 as Spark gives it)."""
        distinct, place = np.unique(hashes.view(np.uint64), return_inverse=True)
        numbers, counts = np.full(len(distinct), -1, np.int64), np.zeros(len(distinct), np.int64)
        cuts = np.searchsorted(distinct, self.firsts)
        for k in range(len(self.files)):
            part = slice(cuts[k], cuts[k + 1] if k + 1 < len(self.files) else len(distinct))
            if part.start < part.stop:
                hashed, count = self._file(k)
                local = hashed.find(distinct[part])
                hit = local >= 0
                numbers[part] = np.where(hit, local + self.starts[k], -1)
                counts[part] = np.where(hit, count[np.where(hit, local, 0)], 0)
        return numbers[place], counts[place]

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), np.int64)
        owner = np.searchsorted(self.starts, numbers, side="right") - 1
        for k in np.unique(owner[numbers >= 0]):
            mine = np.flatnonzero(owner == k)
            out[mine] = self._file(int(k))[1][numbers[mine] - self.starts[k]]
        return out

    def log_p(self, counts: np.ndarray) -> np.ndarray:
        """Base log10 probabilities of tokens with these counts."""
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.size + 1)))


class Level:
    """Level k > 1: children of the nodes of level k-1, in files by ranges of nodes."""

    def __init__(self, files: list[tuple[int, int, str]], vocabulary: int):
        self.files, self.vocabulary = sorted(files), vocabulary
        self.firsts = np.array([f[0] for f in self.files], np.int64)
        self.starts = np.concatenate([[0], np.cumsum([f[1] for f in self.files])]).astype(np.int64)
        self.open: dict[int, tuple] = {}

    def _file(self, k: int):
        if k not in self.open:
            scalars, arrays = load(self.files[k][2])
            self.open[k] = (
                scalars["nodes"], sequence_of("pointer", scalars, arrays), sequence_of("key", scalars, arrays),
                arrays["p"], arrays["backoff"], sequence_of("mass", scalars, arrays) if "mass" in scalars else None,
            )
        return self.open[k]

    def look_up(self, node: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(child's number or -1, its log10 p, log10 of the context's backoff weight).

        A node below 0 has no children and weight 1. Equal questions are asked once, in the order of the files: a
        context's pointers are read once, and each file and its directories from front to back."""
        child, value, backoff = np.full(len(node), -1, np.int64), np.zeros(len(node)), np.zeros(len(node))
        asked = np.flatnonzero(node >= 0)
        if not self.files or not len(asked):
            return child, value, backoff
        order, fresh = in_order(node[asked], word[asked], self.vocabulary)
        asked = asked[order]
        node, word = node[asked[fresh]], word[asked[fresh]]
        found, log10, weights = np.full(len(node), -1, np.int64), np.zeros(len(node)), np.zeros(len(node))
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        contexts, sizes = node[starts], np.diff(np.r_[starts, len(node)])
        cuts = np.r_[np.searchsorted(contexts, self.firsts), len(contexts)]
        for k in np.flatnonzero(np.diff(cuts)):
            mine = slice(cuts[k], cuts[k + 1])
            nodes, pointer, key, p, weight, _ = self._file(int(k))
            local = contexts[mine] - self.firsts[k]
            local = local[: np.searchsorted(local, nodes)]  # what lies beyond the last node has no children
            if not len(local):
                continue
            at, size = int(starts[mine.start]), sizes[mine][: len(local)]
            lo, hi = pointer.pair(local)
            weights[at : at + int(size.sum())] = np.repeat(np.where(lo < hi, weight[local], 0), size) / -SCALE
            local, lo, hi = np.repeat(local, size), np.repeat(lo, size), np.repeat(hi, size)
            known = np.flatnonzero((word[at : at + len(local)] >= 0) & (lo < hi))
            x = local[known].astype(np.uint64) * np.uint64(self.vocabulary) + word[at + known].astype(np.uint64)
            place = key.find(x, lo[known], hi[known])
            hit = place >= 0
            known, place = at + known[hit], place[hit]
            found[known] = place + self.starts[k]
            log10[known] = p[place] / -SCALE
        back = np.cumsum(fresh) - 1
        child[asked], value[asked], backoff[asked] = found[back], log10[back], weights[back]
        return child, value, backoff

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """How often the n-grams with these numbers occur; the last level doesn't keep this."""
        n = np.zeros(len(numbers), np.int64)
        owner = np.searchsorted(self.starts, numbers, side="right") - 1
        for k in np.unique(owner):
            mine = np.flatnonzero(owner == k)
            mass, at = self._file(int(k))[5], numbers[mine] - self.starts[k]
            n[mine] = mass.get(at + 1).astype(np.int64) - mass.get(at).astype(np.int64)
        return n


class Model:
    """Opened once per Python worker from the lists of files."""

    _held: dict[str, Model] = {}

    def __init__(self, spec: dict):
        self.vocabulary = Vocabulary(spec["vocabulary"], spec["total"])
        self.levels = [Level(files, self.vocabulary.size) for files in spec["levels"]]
        self.end = spec["end"]

    @classmethod
    def held(cls, spec: dict) -> Model:
        name = json.dumps(spec)
        if name not in cls._held:
            cls._held.clear()
            cls._held[name] = cls(spec)
        return cls._held[name]

    def log_p(self, ids: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """log10 p of each token, longest known context first, backing off as it must."""
        p, open = np.zeros(len(ids)), np.ones(len(ids), bool)
        context, found = np.r_[np.int64(-1), ids[:-1]], []
        context[fresh] = self.vocabulary.number(np.array([self.end], np.int64))[0][0]
        for level in self.levels:
            found.append(level.look_up(context, ids))
            open &= found[-1][0] < 0
            context = np.r_[np.int64(-1), found[-1][0][:-1]]
            context[fresh] = -1
        # only tokens that no level holds come down to the base
        distinct, place = np.unique(ids[open], return_inverse=True)
        p[open] = self.vocabulary.log_p(self.vocabulary.counts(distinct))[place]
        for node, value, backoff in found:
            p = np.where(node >= 0, value, backoff + p)
        return p


# ---- building ---------------------------------------------------------------------------------


def hashes_of(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words by their bytes, as signed numbers."""
    import pandas as pd

    words = words.cast(pa.binary()).to_numpy(zero_copy_only=False)
    return pd.util.hash_array(words, categorize=False).view(np.int64) if len(words) else np.empty(0, np.int64)


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct words and, last, of the end token; place there of each token; tokens of each text)."""
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    flat = lists.flatten()
    words = flat.filter(pc.not_equal(flat, ""))  # a blank text splits into one empty word
    offsets = lists.offsets.to_numpy()
    empty = np.r_[0, np.cumsum(pc.equal(flat, "").to_numpy(zero_copy_only=False))]
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets - empty[offsets]) + 1
    coded = words.dictionary_encode()
    place = np.full(len(words) + len(texts), len(coded.dictionary), np.int64)
    word = np.ones(len(place), bool)
    word[np.cumsum(sizes) - 1] = False
    place[word] = coded.indices.to_numpy()
    return np.r_[hashes_of(coded.dictionary), hashes_of(pa.array([END]))], place, sizes


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of runs of rows that hold about ``most`` together, or are one row."""
    before = np.cumsum(sizes) - sizes
    starts = np.flatnonzero(np.diff(before // most, prepend=-1))
    yield from zip(starts.tolist(), np.diff(np.r_[starts, len(sizes)]).tolist(), strict=True)


def texts_of(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about ``TEXTS`` bytes."""
    import pyarrow.compute as pc

    sizes = pc.binary_length(whole["text"]).to_numpy(zero_copy_only=False).astype(np.int64)
    yield from (whole.slice(*part) for part in slices(sizes, TEXTS))


def word_counts(docs: DataFrame) -> DataFrame:
    """token (hash) and n of every distinct token; each task counts slice by slice before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in texts_of(whole):
                hashes, place, _ = tokens_of(batch["text"])
                n = np.bincount(place, minlength=len(hashes))
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(n.astype(np.int64))], names=["token", "n"])

    return docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


BUILT = "first decimal(20,0), n long, uri string, places array<long>, masses array<long>"


def _built(first: int, n: int, uri: str, places: np.ndarray, masses: np.ndarray) -> pa.RecordBatch:
    import decimal

    lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (places, masses)]
    return pa.RecordBatch.from_arrays(
        [pa.array([decimal.Decimal(first)], pa.decimal128(20, 0)), pa.array([n], pa.int64()), pa.array([uri], pa.string()), *lists],
        names=["first", "n", "uri", "places", "masses"],
    )


def pieces(n: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """First places and masses of runs of entries that hold about ``step`` tokens each."""
    before = np.cumsum(n) - n
    starts = np.flatnonzero(np.diff(before // step, prepend=-1)) if len(n) else np.empty(0, np.int64)
    return starts, np.add.reduceat(n, starts) if len(n) else np.empty(0, np.int64)


def ranges(places: np.ndarray, masses: np.ndarray, buckets: int) -> np.ndarray:
    """The places at which ``buckets`` ranges of about equal mass begin, the first left out."""
    before = np.cumsum(masses) - masses
    bucket = before * buckets // max(int(masses.sum()), 1)
    return places[1:][np.diff(bucket) > 0] if len(places) else places


def _files(rows: DataFrame, counted: bool) -> tuple[list[tuple[int, int, str]], np.ndarray, np.ndarray]:
    """What a build returns, in order: the list of files, and places and masses of their pieces."""
    found = sorted(rows.collect(), key=lambda r: r["first"])
    files = [(int(r["first"]), r["n"], r["uri"]) for r in found]
    starts = np.cumsum([0] + [n for _, n, _ in files]) if counted else np.zeros(len(files) + 1, np.int64)
    places = [np.array(r["places"], np.int64) + start for r, start in zip(found, starts, strict=False)]
    masses = [np.array(r["masses"], np.int64) for r in found]
    empty = [np.empty(0, np.int64)]
    return files, np.concatenate(empty + places), np.concatenate(empty + masses)


def build_vocabulary(counts: DataFrame, folder: str, step: int) -> tuple[list[tuple[int, int, str]], np.ndarray, np.ndarray]:
    """``counts`` has token (hash) and n. Places are numbers of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, n = np.empty(0, np.uint64), np.empty(0, np.int64)

        def write(h, c):
            scalars, arrays = sequence("hash", EliasFano.of(h, 1 << 64))
            return _built(int(h[0]), len(h), save(folder, scalars, arrays | {"count": c}), *pieces(c, step))

        for batch in batches:
            hashes = np.concatenate([hashes, batch["token"].to_numpy(zero_copy_only=False).view(np.uint64)])
            n = np.concatenate([n, batch["n"].to_numpy(zero_copy_only=False)])
            while len(hashes) >= 2 * SHARD:
                yield write(hashes[:SHARD], n[:SHARD])
                hashes, n = hashes[SHARD:], n[SHARD:]
        if len(hashes):
            yield write(hashes, n)

    unsigned = F.col("token").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    ordered = counts.repartitionByRange(unsigned).sortWithinPartitions(unsigned)
    return _files(kept(ordered.mapInArrow(run, BUILT), "lm-vocabulary-files"), True)


def build_level(
    packs: DataFrame, spec: dict, folder: str, step: int, discount: float, min_count: int, last: bool
) -> tuple[list[tuple[int, int, str]], np.ndarray, np.ndarray]:
    """``packs`` has packed (context, word, n), each partition a range of contexts; spec holds the levels above.

    A context is the number of its one word, or first word x vocabulary + second word; both ascend as nodes do.
    Places are contexts of the next order."""
    depth = len(spec["levels"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.held(spec)
        words = model.vocabulary

        def write(context, word, n):
            starts = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
            sizes = np.diff(np.r_[starts, len(context)])
            lower = words.log_p(words.counts(word))
            if depth == 0:
                node, total = context[starts], words.counts(context[starts])
            else:
                above = model.levels[0]
                node = above.look_up(*np.divmod(context[starts], words.size))[0]
                total = above.counts(node)
                found, value, backoff = above.look_up(context % words.size, word)
                lower = np.where(found >= 0, value, backoff + lower)
            first = int(node[0])
            local = node - first
            nodes = int(local[-1]) + 1
            pointer = np.zeros(nodes + 1, np.int64)
            pointer[local + 1] = sizes
            rest = np.maximum(1 - np.add.reduceat(n - discount, starts) / total, 1e-9)
            p = (n - discount) / np.repeat(total, sizes) + np.repeat(rest, sizes) * 10 ** lower
            backoff = np.zeros(nodes, np.uint16)
            backoff[local] = quantised(np.log10(rest))
            key = np.repeat(local, sizes).astype(np.uint64) * np.uint64(words.size) + word.astype(np.uint64)
            s1, a1 = sequence("pointer", EliasFano.of(np.cumsum(pointer).astype(np.uint64), len(word) + 1))
            s2, a2 = sequence("key", EliasFano.of(key, nodes * words.size))
            s3, a3 = ({}, {}) if last else sequence("mass", EliasFano.of(np.cumsum(np.r_[0, n]).astype(np.uint64), int(n.sum()) + 1))
            uri = save(folder, {"nodes": nodes} | s1 | s2 | s3, a1 | a2 | a3 | {"p": quantised(np.log10(p)), "backoff": backoff})
            if last:
                return _built(first, len(word), uri, np.empty(0, np.int64), np.empty(0, np.int64))
            at, masses = pieces(n, step)
            return _built(first, len(word), uri, context[at] * words.size + word[at], masses)

        table, parts, size = np.empty((3, 0), np.int64), [], 0
        for batch in batches:
            for data in batch["grams"]:
                parts.append(unpack(data.as_py()))
                size += parts[-1].shape[1]
                if size >= 2 * PAIRS + table.shape[1]:  # memory goes by the distinct n-grams of the range, not by the packs
                    table, parts, size = np.stack(summed(*np.concatenate([table, *parts], axis=1))), [], 0
        if size + table.shape[1]:
            table = np.stack(summed(*np.concatenate([table, *parts], axis=1)))
        table = table[:, table[2] >= min_count]
        at, n = 0, table.shape[1]
        while at < n:
            end = min(at + SHARD, n)
            end = int(np.searchsorted(table[0], table[0, end - 1], side="right"))
            yield write(*table[:, at:end])
            at = end

    return _files(kept(packs.mapInArrow(run, BUILT), f"lm-level-{depth + 2}-files"), False)


def coded(docs: DataFrame, spec: dict) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score and the word numbers of every text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    narrow = sum(n for _, n, _ in spec["vocabulary"]) < 1 << 31

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Model.held(spec).vocabulary
        for whole in batches:
            for batch in texts_of(whole):
                hashes, place, sizes = tokens_of(batch["text"])
                distinct, n = words.number(hashes)
                numbers, counts, base_p = distinct[place], n[place], words.log_p(n)[place]
                starts = np.cumsum(sizes) - sizes
                base = np.add.reduceat(base_p, starts)
                known = np.add.reduceat((counts > 0).astype(np.int64), starts)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([starts, [len(numbers)]]).astype(np.int32)), pa.array(numbers.astype(np.int32) if narrow else numbers))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], batch["held_out"], pa.array(sizes.astype(np.int64)), pa.array(known), pa.array(base), ids],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "ids"],
                )

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, ids array<{'int' if narrow else 'long'}>")


def flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all numbers, first places, marks of first places); lists are never empty, as each has an end token."""
    offsets = lists.offsets.to_numpy()
    ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = (offsets[:-1] - offsets[0]).astype(np.int64)
    fresh = np.zeros(len(ids), bool)
    fresh[starts] = True
    return ids, starts, fresh


def pack(node: np.ndarray, word: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted n-grams with their counts: differences of the nodes, bytes in planes, Zstandard."""
    import zstandard

    table = np.stack([np.diff(node, prepend=0), word, n]).astype("<i8")
    planes = table.view(np.uint8).reshape(3, -1, 8).transpose(0, 2, 1)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(3, 8, -1)
    table = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<i8").reshape(3, -1)
    return np.stack([np.cumsum(table[0]), table[1], table[2]])


def summed(node: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal n-grams added up, in order of node and word."""
    order = np.lexsort((word, node))
    node, word, n = node[order], word[order], n[order]
    starts = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (word[1:] != word[:-1])])
    return node[starts], word[starts], np.add.reduceat(n, starts)


def grams_of(coded_rows: DataFrame, spec: dict, order: int, cuts: np.ndarray) -> DataFrame:
    """Packed (context, word, n) of all training n-grams of an order, partition k holding the contexts from
    ``cuts[k - 1]`` up to ``cuts[k]``. Each task adds up what it reads and ships a few bytes for an n-gram."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Model.held(spec).vocabulary
        end = int(words.number(np.array([spec["end"]], np.int64))[0][0])
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out():
            context, word, n = summed(*(np.concatenate(x) for x in zip(*held, strict=True)), np.ones(size, np.int64))
            bounds = np.r_[0, np.searchsorted(context, cuts), len(context)]
            full = np.flatnonzero(np.diff(bounds))
            packs = [pack(*(x[bounds[k] : bounds[k + 1]] for x in (context, word, n))) for k in full]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(packs, pa.binary())], names=["bucket", "grams"])

        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                ids, _, fresh = flat(whole["ids"].slice(at, 128))
                for part in range(0, len(ids), PAIRS):
                    # a slice in the middle of a text keeps the words before it as context
                    back = min(part, order)
                    word, marks = ids[part - back : part + PAIRS], fresh[part - back : part + PAIRS]
                    before = np.r_[np.int64(-1), word[:-1]]
                    before[marks] = end
                    context = before
                    if order > 2:
                        context = np.r_[np.int64(-1), before[:-1]] * words.size + before
                        context[marks] = -1
                        context[:1] = -1
                    context, word = context[back:], word[back:]
                    use = context >= 0
                    held.append((context[use], word[use]))
                    size += len(held[-1][0])
                    if size >= PAIRS:
                        yield out()
                        held, size = [], 0
        if size:
            yield out()

    packs = coded_rows.where("not held_out").select("ids").mapInArrow(count, "bucket int, grams binary")
    return packs.repartitionById(len(cuts) + 1, "bucket").select("grams")


def fit(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, discount: float = DISCOUNT) -> tuple[dict, DataFrame]:
    """``docs`` has doc_id, text, held_out. Returns the model's list of files and the coded documents."""
    spark = docs.sparkSession
    if order > 3:
        raise ValueError("orders 1 to 3 are built")
    docs = docs.select("doc_id", "held_out", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    folder = shared_folder(spark, "lm-trie")
    counts = kept(word_counts(docs.where("not held_out")), "lm-words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    end = int(hashes_of(pa.array([END]))[0])
    buckets = max(spark.sparkContext.defaultParallelism, total // BUCKET + 1)
    step = max(1, total // (4 * buckets))
    files, places, masses = build_vocabulary(counts, folder, step)
    if sum(n for _, n, _ in files) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} distinct words")
    spec = {"vocabulary": files, "levels": [], "total": total, "end": end}
    rows = kept(coded(docs, spec), "lm-coded")
    for k in range(2, order + 1):
        packs = grams_of(rows, spec, k, ranges(places, masses, buckets))
        files, places, masses = build_level(packs, spec, folder, step, discount, min_count, k == order)
        spec = spec | {"levels": [*spec["levels"], files]}
    return spec, rows


def score(rows: DataFrame, spec: dict) -> DataFrame:
    """Adds score to coded documents."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.held(spec)
        for whole in batches:
            sizes = whole["n_tokens"].to_numpy(zero_copy_only=False)
            for part in slices(sizes, SCORED):
                batch = whole.slice(*part)
                ids, starts, fresh = flat(batch["ids"])
                total = np.add.reduceat(model.log_p(ids, fresh), starts)
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(total)], names=[*names, "score"])

    fields = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    return rows.select(*names, "ids").mapInArrow(run, fields)


def report(docs: DataFrame, **options) -> DataFrame:
    """Per document: token counts, the base score and the model's log10 probability of the text."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), (remainder(5) == 1).alias("held_out"))
    spec, coded_rows = fit(rows, **options)
    return score(coded_rows, spec).withColumn("train_tokens", F.lit(spec["total"]).cast("long"))
