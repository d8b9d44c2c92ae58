"""Grouping of spelling variants: words one edit apart, joined by asymmetric q-chunks.

Of two words exactly one insertion, deletion or replacement apart, the longer one (of equal lengths either) gives
two disjoint chunks, its halves; the edit falls into one of them, so the other stands whole in the shorter word, at
the same place or moved by one. The shorter word gives its positional grams: those of a chunk's
length that lie within shift one of a chunk's place. A half is shared by many words, so what remains
beside it, which must hold the edit, is halved once more in the same way and its whole half joins
the key. The key has the lengths and the places in it, so the join is an equi-join, and
about three quarters of a word agree before a pair is formed. Every pair is verified by its edit distance.

No group is gathered: the join's keys are three quarters of a word, counts and best neighbours are aggregates.
A form occurs ten times as often as its word, so chains have at most 19 steps for any count that fits a long;
pointers are doubled, which takes five rounds, and the loop stops when nothing changes.

Defined cases: a null text has no words; a null doc_id counts as an empty one; repeated rows count again; ties
between forms go to the smaller word in code-point order; an empty table gives an empty result. Only the
columns doc_id and text are read. Words of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slotwise.llm.common import kept, lower_ascii

# Fixed by the contract: letters, the rule of slips, the least length and count of a word, how much more frequent a form is.
RUN = r"[A-Za-zÀ-ÿ]+"
SLIP_EVERY = 31
LEAST_CHARS, LEAST_COUNT = 7, 2
FORM_TIMES = 10


def slipped(doc_id: Column, word: Column) -> Column:
    """The word, or the word without one code point where the checksum of document and word says so."""
    h = F.crc32(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    without = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(h % SLIP_EVERY == 0, without).otherwise(word)


def counted(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all words long and frequent enough. Runs too short for a word are never formed: a slip only shortens."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN.replace("+", f"{{{least_chars},}}")), F.lit(0))).alias("run"))
    words = runs.select(slipped(F.col("doc_id"), lower_ascii(F.col("run"))).alias("word")).where(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _keys(word: Column, size: Column, shift: Column) -> Column:
    """The four keys of a word as partner of one of ``size`` code points that is ``shift`` longer than it.

    ``shift`` 0 with the word's own size gives the chunks of the longer word.
    """
    half = F.floor(size / 2).cast("int")
    upper, lower = F.floor((size - half) / 2).cast("int"), F.floor(half / 2).cast("int")
    part = lambda start, stop: F.substring(word, start + 1, stop - start)
    zero, end = F.lit(0), size - shift
    found = (
        part(zero, half + upper),
        F.concat_ws(" ", part(zero, half), part(half + upper - shift, end)),
        F.concat_ws(" ", part(zero, lower), part(half - shift, end)),
        part(lower - shift, end),
    )
    return F.array(*(F.struct(F.lit(i).alias("cut"), k.alias("key")) for i, k in enumerate(found)))


def _shifts(table: DataFrame, size: Column, shift_back: bool) -> DataFrame:
    rows = table.withColumn("shift", F.explode(F.array(F.lit(0), F.lit(1))))
    longer = F.col("shift") if shift_back else F.lit(0)
    keys = _keys(F.col("word"), size + longer, longer)
    return rows.select("word", "n", (size + longer).alias("size"), "shift", F.inline(keys))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all ordered pairs of words exactly one edit apart. ``words`` has distinct words and their n."""
    size = F.length("word")
    chunks = _shifts(words, size, False).withColumnsRenamed({"word": "a", "n": "a_n"})
    grams = _shifts(words, size, True).withColumnsRenamed({"word": "b", "n": "b_n"})
    met = chunks.join(grams, ["size", "shift", "cut", "key"]).where((F.col("shift") == 1) | (F.col("a") < F.col("b")))
    close = met.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct()
    return close.select(F.inline(F.array(
        F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
    )))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of all words with a form, from (word, form): the last of the chain."""
    state = kept(forms.select("word", F.col("form").alias("root")), "spelling-roots-0")
    number = 0
    while True:
        ahead = state.select(F.col("word").alias("at"), F.col("root").alias("then"))
        number += 1
        moved = state.join(ahead, state.root == ahead["at"], "left").select("word", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved"))
        state = kept(moved, f"spelling-roots-{number}")
        if state.where("moved").isEmpty():
            return state.select("word", "root")


def grouped(words: DataFrame) -> DataFrame:
    """Every word with its form, the root of its chain, its near words and its form's count; ``words`` has word and n."""
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    far = -F.col("best.less") >= FORM_TIMES * F.col("n")
    table = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(far, F.col("best.near")).alias("form"), F.when(far, -F.col("best.less")).alias("form_n"),
    )
    table = kept(table, "spelling-forms")
    last = roots(table.where("form is not null"))
    return table.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def report(docs: DataFrame) -> DataFrame:
    return grouped(kept(counted(docs), "spelling-words"))


SQL = """
with recursive remainders as (
  select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t
  from range(256) as r(i)
), runs as (
  select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n
  from (select coalesce(doc_id::varchar, '') as doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')) as run from documents)
  where length(run) >= 7 group by all
), hashed as (
  select run, n, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id || ':' || run, ''),
    lambda ch: case when unicode(ch) < 128 then [unicode(ch)] else [192 + (unicode(ch) >> 6), 128 + (unicode(ch) & 63)] end))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as h
  from runs, remainders
), words as (
  select word, sum(n)::bigint as n from (
    select case when h % 31 = 0 then substring(run, 1, (h % length(run))::int) || substring(run, (h % length(run))::int + 2) else run end as word, n from hashed
  ) where length(word) >= 7 group by word having sum(n) >= 2
), cuts as (
  select word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) as rest from (select *, unnest(range(1, length(word) + 1)) as i from words)
), pairs as (
  select a.word, b.word as near, b.n as near_n from cuts a join cuts b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select c.word, w.word, w.n from cuts c join words w on c.rest = w.word
  union select w.word, c.word, c.n from cuts c join words w on c.rest = w.word
), forms as (
  select w.word, w.n, count(p.near) as n_near, arg_max(p.near, (p.near_n, -p.rank)) as near, max(p.near_n) as near_n
  from words w left join (select *, row_number() over (order by near) as rank from pairs) p on p.word = w.word group by w.word, w.n
), chosen as (
  select word, n, n_near, case when near_n >= 10 * n then near end as form, case when near_n >= 10 * n then near_n end as form_n from forms
), chain as (
  select word, word as root, 0 as steps from chosen
  union all select k.word, c.form, k.steps + 1 from chain k join chosen c on c.word = k.root where c.form is not null
)
select c.word, c.form, k.root, c.n, c.n_near, c.form_n
from chosen c join (select word, arg_max(root, steps) as root from chain group by word) k on k.word = c.word
"""
