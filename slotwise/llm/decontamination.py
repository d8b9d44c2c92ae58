"""Benchmark decontamination with one Aho-Corasick automaton over normalised words.

Benchmark texts are lower-cased (A-Z) and cut into words; every window of 13 consecutive words, or
the whole item where it has fewer, becomes one pattern. The automaton's alphabet is the benchmark's
own vocabulary: a document word is one symbol, words the benchmark doesn't know are one separate
symbol, so a text is scanned once and matches end on word boundaries. Word numbers map back to
code-point offsets of the original text.

The automaton is held in memory, so the benchmark is measured first: up to ``SHARD_BYTES`` of text
it is one automaton; a larger benchmark is dealt by hash into shards of that size, the documents
are scanned once per shard, and hits are merged, so the result is the same at every size.

Defined cases: a null or wordless text has no words, no hits and is clean; null or wordless items
have no window; an item with a null id counts as the id ``null``; rows that repeat an item id are
one item; repeated documents are judged one by one; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from slotwise.llm.common import LOWER, UPPER, kept, packed, unpacked

WINDOW = 13
SHARD_BYTES = 16 << 20
SHARE = 20  # contaminated: at least one word in twenty is hit
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans(UPPER, LOWER)
_automata: dict[str, tuple] = {}


def item_windows(text: str | None, window: int = WINDOW) -> list[tuple[str, ...]]:
    words = WORDS.findall((text or "").translate(FOLD))
    if not words:
        return []
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


def automaton_of(items: list[tuple[str, str | None]], window: int):
    """(word -> symbol, automaton over symbols or None). A pattern's value: (length, ids of its items)."""
    import ahocorasick

    symbols: dict[str, int] = {}
    owners: dict[tuple[int, ...], set[str]] = {}
    for item_id, text in items:
        for words in item_windows(text, window):
            owners.setdefault(tuple(symbols.setdefault(w, len(symbols) + 1) for w in words), set()).add(item_id)
    if not owners:
        return symbols, None
    machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, ids in owners.items():
        machine.add_word(key, (len(key), frozenset(ids)))
    machine.make_automaton()
    return symbols, machine


def scan(text: str | None, symbols: dict[str, int], machine) -> tuple[int, list[tuple[int, int]], set[str]]:
    """(number of words, hit stretches as word numbers [from, to), ids of the items found)."""
    words = WORDS.findall(text.translate(FOLD)) if text else []
    if machine is None or not words:
        return len(words), [], set()
    coded = tuple(map(symbols.get, words, [0] * len(words)))
    stretches: list[tuple[int, int]] = []
    found: set[str] = set()
    if any(coded):
        for end, (length, ids) in machine.iter(coded):
            start = end + 1 - length
            while stretches and stretches[-1][1] >= start:
                start = min(start, stretches.pop()[0])
            stretches.append((start, end + 1))
            found |= ids
    return len(words), stretches, found


def _machine(shared: Broadcast, key: str, window: int):
    """Built once per Python worker."""
    if key not in _automata:
        _automata.clear()
        _automata[key] = automaton_of(shared.value, window)
    return _automata[key]


HITS = "n_words long, hits array<struct<start: int, end: int>>, items array<string>"
HIT_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _scanned(docs: DataFrame, shared: Broadcast, window: int) -> DataFrame:
    """Adds or merges n_words, hits (word numbers) and items for the patterns of one shard."""
    keys = [c for c in docs.columns if c not in ("n_words", "hits", "items")]
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, machine = _machine(shared, name, window)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                earlier = "hits" in batch.schema.names
                old = list(zip(batch["hits"].to_pylist(), batch["items"].to_pylist())) if earlier else None
                n_words, hits, items = [], [], []
                for i, text in enumerate(batch["text"]):
                    n, stretches, found = scan(text.as_py(), symbols, machine)
                    if old:
                        stretches = stretches + [(x["start"], x["end"]) for x in old[i][0]]
                        found = found | set(old[i][1])
                    n_words.append(n)
                    hits.append([{"start": a, "end": b} for a, b in stretches])
                    items.append(sorted(found))
                yield pa.RecordBatch.from_arrays(
                    [batch[c] for c in keys] + [pa.array(n_words, pa.int64()), pa.array(hits, HIT_TYPE), pa.array(items, pa.list_(pa.string()))],
                    names=[*keys, "n_words", "hits", "items"],
                )

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keys)
    return docs.mapInArrow(run, f"{fields}, {HITS}")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` needs a column text; adds n_words, hits (stretches of word numbers) and items."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("id"), "text")
    volume = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = volume // shard_bytes + 1
    for shard in range(shards):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(shards)) == shard)
        shared = docs.sparkSession.sparkContext.broadcast([(r.id, r.text) for r in part.collect()])
        docs = _scanned(docs, shared, window)
        if shards > 1:
            docs = kept(docs, f"decontaminate-{shard}")
    return docs


def n_hit(hits):
    """Number of words inside any stretch: stretches are sorted and counted beyond the furthest end so far."""
    step = lambda s, x: F.struct(
        F.greatest(s["end"], x["end"]).alias("end"),
        (s["n"] + F.greatest(x["end"] - F.greatest(s["end"], x["start"]), F.lit(0))).alias("n"),
    )
    zero = F.struct(F.lit(0).cast("int").alias("end"), F.lit(0).cast("int").alias("n"))
    return F.aggregate(F.array_sort(hits), zero, step, lambda s: s["n"]).cast("long")


def judged(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    found = matches(docs, benchmark, **options).withColumn("n_hit", n_hit(F.col("hits")))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words")))


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: words, hit words, items found, digest of their ids, and the verdict."""
    found = judged(docs.select("doc_id", "text"), benchmark, **options)
    ids = F.concat_ws(",", F.array_sort("items"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    rows = judged(packed(docs, "row", text=F.col("text")), benchmark, **options)
    return unpacked(rows.where(~F.col("contaminated")), "row", docs)


def hit_text(text: str | None, benchmark: list[tuple[str, str | None]], window: int = WINDOW) -> list[tuple[int, int]]:
    """Stretches of the original text (code points, end exclusive) that the benchmark covers."""
    spans = [m.span() for m in WORDS.finditer((text or "").translate(FOLD))]
    _, stretches, _ = scan(text, *automaton_of(benchmark, window))
    return [(spans[a][0], spans[b - 1][1]) for a, b in stretches]


SQL = """
with items as (
  select coalesce(item_id::varchar, 'null') as id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words
  from benchmark
), windows as (
  select distinct id, least(13, len(words)) as width, array_to_string(words[i : i + least(13, len(words)) - 1], ' ') as key
  from (select *, unnest(range(1, greatest(len(words) - 12, 1) + 1)) as i from items where len(words) > 0)
), docs as (
  select row_number() over () as n, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) as words
  from documents
), places as (
  select n, words, unnest(range(1, len(words) + 1)) as i from docs
), hits as (
  select p.n, p.i, w.width, w.id
  from places p cross join (select distinct width from windows) as v(width) join windows w
    on w.width = v.width and w.key = array_to_string(p.words[p.i : p.i + v.width - 1], ' ')
  where p.i + v.width - 1 <= len(p.words)
), covered as (
  select n, count(distinct j) as n_hit from (select n, unnest(range(i, i + width)) as j from hits) group by n
), found as (
  select n, count(distinct id) as n_items, string_agg(distinct id, ',' order by id) as ids from hits group by n
)
select d.doc_id, len(d.words)::bigint as n_words, coalesce(c.n_hit, 0)::bigint as n_hit, coalesce(f.n_items, 0)::bigint as n_items,
  sha256(coalesce(f.ids, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 and 20 * coalesce(c.n_hit, 0) >= len(d.words) as contaminated
from docs d left join covered c on c.n = d.n left join found f on f.n = d.n
"""
