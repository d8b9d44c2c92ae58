"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Built-in SQL functions only. Spans come from cutting a text at a pattern: the lengths of the pieces
and of the matches, summed in turn, are the offsets (code points, end exclusive).

* Base kinds: ``assign``, ``access`` and ``hex``, as fixed below.
* ``markov``: unbroken runs of 12 or more of ``[A-Za-z0-9+/_=-]`` outside all base spans, scored by the
  sum of the log-likelihood ratios of their character steps under two first-order character models.

Both models are asked about a run within its own alphabet, the classes of characters that occur in it (lower case,
upper case, digits, signs): a lower-case run is compared as random lower case with lower-case identifiers. The sum has
to reach one threshold at every length, so a long run needs less evidence for each character than a short one.

The models are trained from labelled samples. Random strings: the values of the base matches of the
corpus (label given by the patterns), together with uniform pseudo-counts. Ordinary identifiers: the runs of
4 or more characters outside the base spans, long ones too, as they are, joined to their like by a sign or a
capital, and, at ``CAPITALS`` of their weight, in capitals. Both are taken from a bounded sample: about ``SAMPLE`` texts, by hash, of those with a base match, and
about ``SAMPLE`` of all; only the fit is bounded, every text is scanned whole. Counts are summed by Spark, and the
ratios (one number for each pair of 67 characters, one for each character and set of classes) travel as literals.

Defined cases: null and empty texts have no span and the digest of the empty string; overlapping spans
of different kinds are all reported; in ``redact`` they are merged; repeated rows get equal answers;
a corpus without matches leaves the random model uniform; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from slotwise.llm.common import kept, packed

# Fixed by the contract: kind, pattern, least length (of group 2 for assign, else of the match).
# For access and hex a run that is too short can never be part of a longer match, so the length is in the pattern;
# an assign match that is too short uses up its text, so its length is tested afterwards.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
RUN = r"[A-Za-z0-9+/_=-]{12,}"
WORDLIKE = r"[A-Za-z0-9+/_=-]{4,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CLASSES = ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")
SAMPLE = 2000
UNIFORM, PRIOR, CAPITALS = 2000.0, 5.0, 0.02
PLAIN = 20.0  # pseudo-counts in identifiers for each pair of digits, as numbers have any, and for a sign repeated, as in rulers
UNSEEN = 0.1  # share of any character whatever in identifiers, so a step can tell at most log 10
THRESHOLD = 9.0  # sum of log-likelihood ratios (natural log): about one ordinary run in e ** 9 reaches it
KINDS = ("assign", "access", "hex", "markov")

EMPTY = "array<struct<kind:int,start:int,end:int,value:string>>"


def spans_of(text: Column, pattern: str, kind: int) -> Column:
    """All leftmost non-overlapping matches as array<(kind, start, end, value)>; empty array where there is none."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    step = lambda s, x: F.struct(
        (s["at"] + x["gap"] + F.length(x["value"])).alias("at"),
        F.concat(
            s["found"],
            F.array(
                F.struct(
                    F.lit(kind).alias("kind"), (s["at"] + x["gap"]).alias("start"),
                    (s["at"] + x["gap"] + F.length(x["value"])).alias("end"), x["value"].alias("value"),
                )
            ),
        ).alias("found"),
    )
    paired = F.zip_with(matches, F.slice(gaps, 1, F.greatest(F.size(matches), F.lit(0))), lambda m, g: F.struct(m.alias("value"), g.alias("gap")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(EMPTY).alias("found"))
    spans = F.aggregate(paired, zero, step, lambda s: s["found"])
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(F.array().cast(EMPTY))


def value_of_assign(match: Column) -> Column:
    return F.regexp_extract(match, "^" + ASSIGN + "$", 2)


def with_base(docs: DataFrame) -> DataFrame:
    """``docs`` has a column text; adds base: the spans of the fixed kinds by start, then kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.withColumn("assign", spans_of(text, ASSIGN, 0)).withColumn("others", F.concat(spans_of(text, ACCESS, 1), spans_of(text, HEX, 2)))
    long_enough = F.filter("assign", lambda s: F.length(value_of_assign(s["value"])) >= ASSIGN_LEAST)
    return found.withColumn("base", in_order(F.concat(long_enough, "others"))).drop("assign", "others")


def in_order(spans: Column) -> Column:
    by_start = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    return F.array_sort(by_start)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def codes(value: Column) -> Column:
    """Places of the characters in the alphabet, from 0."""
    return F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.instr(F.lit(ALPHABET), F.substring(value, i, F.lit(1))) - 1)


def steps(value: Column) -> Column:
    """One number per pair of neighbours: first * (size of the alphabet) + second."""
    at = codes(value)
    pairs = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: a * len(ALPHABET) + b)
    return F.when(F.length(value) >= 2, pairs).otherwise(F.array().cast("array<int>"))


def outside(text: Column, spans: Column) -> Column:
    """The text with every span replaced by blanks of the same length."""
    step = lambda t, s: F.overlay(t, F.repeat(F.lit(" "), s["end"] - s["start"]), s["start"] + 1, s["end"] - s["start"])
    return F.aggregate(spans, text, step)


def pair_counts(values: DataFrame) -> dict[int, int]:
    """Counts of character pairs of the column value, each value as often as ``n`` says: a bounded table, one row per pair."""
    pairs = values.select("n", F.explode(steps(F.col("value"))).alias("pair")).where("pair >= 0")
    return {r.pair: r.n for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}


def class_of(place: int) -> int:
    """Number of a character's class: 0 lower case, 1 upper case, 2 digits, 3 signs."""
    c = ALPHABET[place]
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def ratio_tables(random: dict[int, int], ordinary: dict[int, int]) -> tuple[list[float], list[float]]:
    """The ratios log P(b | a, random) - log P(b | a, ordinary) per pair, and what is taken off per (set of classes, a)
    when both are asked within a run's own classes: the log ratio of the models' chances to stay in these.

    Random strings lean on the uniform distribution (``UNIFORM`` pseudo-counts for each first character, so the
    hex digits that prevail in the samples don't become a law); identifiers lean on how often each character
    occurs in identifiers at all (``PRIOR`` pseudo-counts) and on any character (``UNSEEN``), so pairs they never
    show are unlikely, not unknown. Numbers and rulers are ordinary (``PLAIN``).
    """
    k = len(ALPHABET)
    known: dict[int, float] = dict(ordinary)
    capital = [ALPHABET.index(c.upper()) for c in ALPHABET]
    for pair, n in ordinary.items():
        a, b = divmod(pair, k)
        if class_of(a) == class_of(b) == 0:
            loud = capital[a] * k + capital[b]
            known[loud] = known.get(loud, 0) + CAPITALS * n
    for a in range(k):
        for b in range(k):
            if class_of(a) == class_of(b) == 2 or a == b and class_of(a) == 3:
                known[a * k + b] = known.get(a * k + b, 0) + PLAIN
    ends = [sum(known.get(a * k + b, 0) for a in range(k)) + 0.5 for b in range(k)]
    whole = sum(ends)
    pairs, stays = [], [0.0] * (k << len(CLASSES))
    for a in range(k):
        of_random = sum(random.get(a * k + c, 0) for c in range(k)) + UNIFORM
        of_known = sum(known.get(a * k + c, 0) for c in range(k)) + PRIOR
        r = [(random.get(a * k + b, 0) + UNIFORM / k) / of_random for b in range(k)]
        o = [UNSEEN / k + (1 - UNSEEN) * (known.get(a * k + b, 0) + PRIOR * ends[b] / whole) / of_known for b in range(k)]
        pairs += [round(math.log(x) - math.log(y), 6) for x, y in zip(r, o, strict=True)]
        for held in range(1, 1 << len(CLASSES)):
            inside = [b for b in range(k) if held >> class_of(b) & 1]
            stays[held * k + a] = round(math.log(sum(r[b] for b in inside)) - math.log(sum(o[b] for b in inside)), 6)
    return pairs, stays


def about(rows: DataFrame, n: int) -> DataFrame:
    """About ``n`` of the rows by a hash of the column ``rank``, without sorting; all where there are fewer."""
    total = rows.count()
    return rows if total <= n else rows.where(F.pmod("rank", F.lit(1 << 40)) < (n << 40) // total)


def joints(word: Column) -> Column:
    """How the word meets its like in an identifier: by a sign, or by a capital."""
    first, last = F.left(word, F.lit(1)), F.right(word, F.lit(1))
    return F.array(*(F.concat(last, F.lit(c), first) for c in "_-/"), F.concat(last, F.upper(first)))


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[float], list[float]]:
    """``docs`` has text. See the module's text for the two samples."""
    ranked = docs.select("text", F.xxhash64(F.lit("sample"), "text").alias("rank"))
    matched = kept(with_base(ranked).where(F.size("base") > 0).select("base", "rank"), "secrets-matched")
    value = lambda s: F.when(s["kind"] == 0, value_of_assign(s["value"])).otherwise(s["value"])
    random = about(matched, sample).select(F.explode(F.transform("base", value)).alias("value"))
    plain = with_base(about(ranked, sample))
    words = F.regexp_extract_all(outside(F.coalesce("text", F.lit("")), F.col("base")), F.lit(WORDLIKE), F.lit(0))
    # Words are cut into pairs once per distinct word, not per occurrence.
    counted = lambda values: values.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    ordinary = counted(plain.select(F.explode(words).alias("value")))
    ordinary = ordinary.select("n", F.explode(F.concat(F.array("value"), joints(F.col("value")))).alias("value"))
    return ratio_tables(pair_counts(counted(random)), pair_counts(ordinary))


def classes(value: Column) -> Column:
    """The set of classes a run holds, one bit each."""
    return sum((F.regexp_like(value, F.lit(p)).cast("int") * (1 << i) for i, p in enumerate(CLASSES)), F.lit(0))


def score(value: Column, ratios: tuple[list[float], list[float]]) -> Column:
    """Sum of the log-likelihood ratios of a run's steps, within its own classes."""
    pairs, stays = (F.expr(f"array({', '.join(f'{x:f}D' for x in table)})") for table in ratios)
    k = len(ALPHABET)
    step = lambda s, p: F.struct((s["sum"] + F.get(pairs, p) - F.get(stays, s["held"] + F.floor(p / k).cast("int"))).alias("sum"), s["held"].alias("held"))
    zero = F.struct(F.lit(0.0).alias("sum"), (classes(value) * k).alias("held"))
    return F.aggregate(steps(value), zero, step, lambda s: s["sum"])


def with_spans(found: DataFrame, ratios: tuple[list[float], list[float]], threshold: float = THRESHOLD) -> DataFrame:
    """Adds spans: the base ones and the runs that the models call random."""
    free = outside(F.coalesce(F.col("text"), F.lit("")), F.col("base"))
    runs = F.filter(spans_of(free, RUN, 3), lambda s: score(s["value"], ratios) >= threshold)
    return found.withColumn("spans", in_order(F.concat(F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))), runs)))


def scan(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` has a column text; adds base and spans, arrays of (start, kind, end, value)."""
    found = with_base(docs)
    return with_spans(found, fit(docs.select("text"), sample), threshold)


def report(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, a digest of the base spans, and all spans."""
    rows = scan(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch of overlapping spans replaced by the mark."""
    step = lambda s, x: F.struct(
        F.when(x["start"] >= s["at"], F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))).otherwise(s["out"]).alias("out"),
        F.greatest(s["at"], x["end"]).alias("at"),
    )
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(spans, zero, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def redact(docs: DataFrame, **options) -> DataFrame:
    """The documents with their secrets replaced; n_chars, where there is one, follows the new text."""
    rows = scan(packed(docs, "row", text=F.col("text")), **options)
    rows = rows.withColumn("clean", F.when(F.size("spans") > 0, redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    changed = F.size("spans") > 0
    # In a step of its own: inside a lambda, an alias of the same select would hide the column it is named after.
    rows = rows.select("row", changed.alias("changed"), F.when(changed, redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text")).alias("clean"))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("changed"), F.length("clean").cast(kind)).otherwise(F.col("row")["n_chars"])
    return rows.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
