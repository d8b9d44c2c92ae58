"""Language identification by mixture inference over character n-grams.

Training counts character n-grams (1 to 3 letters, folded to lower case, words padded by a blank) of
every labelled training text into hashed buckets per language; the smoothed shares are the
languages' n-gram likelihoods. A document is explained as a mixture: expectation-maximisation finds
the proportions that make its n-grams most likely. The language set grows one language at a time and
stops where the likelihood gain no longer pays the penalty per language (half the log of the n-gram
count, plus a fixed part). The mixture likelihood is concave in the proportions, so the slope at
zero bounds what another language can gain: where no slope exceeds the penalty, the single language
is the answer without running the expectation steps.

The model is a table of languages x ``BUCKETS`` doubles, 0.5 MB per language at any corpus size; it
is the only thing sent to all tasks. Labels are a closed set, documented to be at most ``MOST_LABELS``;
more is an error, never a cut.

Defined cases: a null text, and a text without a letter, is ``und`` with score 0 and no proportions;
with no training text all texts are ``und``; ties go to the language that sorts first; repeated rows
get equal answers; very long texts are counted in pieces; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from slotwise.llm.common import packed, unpacked

BUCKETS = 1 << 16
PIECE = 1 << 20
MOST_LABELS = 400
STEPS = 40
TOLERANCE = 1e-4
FIXED_PENALTY = 4.0
SMOOTHING = 0.5
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return bool(text) and LETTER.search(text) is not None


def grams(text: str) -> np.ndarray:
    """Buckets of all n-grams of 1 to 3 characters; anything but letters is a blank, runs of blanks are one."""
    found = []
    for at in range(0, len(text), PIECE):
        piece = text[at : at + PIECE].lower()
        # surrogatepass: a lone surrogate can't occur in UTF-8 input, but costs nothing to allow
        code = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        letter = (code >= 97) & (code <= 122) | (code >= 0xAA) & (code != 0xD7) & (code != 0xF7) & ~((code >= 0x2000) & (code < 0x2C00))
        code = np.where(letter, code, np.uint64(32))
        blank = ~letter
        code = code[~(blank & np.r_[False, blank[:-1]])]
        code = np.r_[np.uint64(32), code, np.uint64(32)]
        one = code[code != 32]
        two = code[:-1] * np.uint64(0x1F0F1) + code[1:] + np.uint64(0x5BD1E995)
        three = (code[:-2] * np.uint64(0x1F0F1) + code[1:-1]) * np.uint64(0x1F0F1) + code[2:] + np.uint64(0x27D4EB2F165667C5)
        three = three[code[1:-1] != 32]
        keys = np.concatenate([one, two, three]) * np.uint64(0x9E3779B97F4A7C15)
        found.append((keys >> np.uint64(48)).astype(np.int64))
    return np.concatenate(found)


class Model:
    """Languages in sorted order and the log-likelihood of every bucket under each."""

    def __init__(self, labels: list[str], counts: np.ndarray):
        self.labels = labels
        share = counts + SMOOTHING * 1e-2
        self.likelihood = (share / share.sum(axis=1, keepdims=True)).T.copy() if labels else np.zeros((BUCKETS, 0))

    def proportions(self, text: str | None) -> dict[str, float]:
        """Languages of a text with their shares (sum 1); empty for a text that can't be judged."""
        if not self.labels or not has_letter(text):
            return {}
        buckets = grams(text)
        kinds, weight = np.unique(buckets, return_counts=True)
        like, weight, n = self.likelihood[kinds], weight.astype(float), float(len(buckets))
        single = weight @ np.log(like)
        chosen = [int(np.argmax(single))]
        best, shares, mixed = single[chosen[0]], np.ones(1), like[:, chosen[0]]
        penalty = FIXED_PENALTY + 0.5 * np.log(n)
        while len(chosen) < len(self.labels):
            slope = (weight / mixed) @ like - n
            slope[chosen] = -np.inf
            if slope.max() <= penalty:
                break
            trial = [*chosen, int(np.argmax(slope))]
            value, part = mixture(like[:, trial], weight, n, np.r_[shares * 0.9, 0.1])
            if value - best <= penalty:
                break
            chosen, best, shares = trial, value, part
            mixed = like[:, chosen] @ shares
        order = sorted(zip((self.labels[k] for k in chosen), shares.tolist(), strict=True), key=lambda x: (-x[1], x[0]))
        return dict(order)


def mixture(like: np.ndarray, weight: np.ndarray, n: float, shares: np.ndarray) -> tuple[float, np.ndarray]:
    """Expectation-maximisation for the proportions: (log-likelihood, proportions)."""
    total = like @ shares
    value = weight @ np.log(total)
    for _ in range(STEPS):
        shares = shares * ((weight / total) @ like) / n
        total = like @ shares
        new = weight @ np.log(total)
        done, value = new - value < TOLERANCE * n**0.5, new
        if done:
            break
    return float(value), shares / shares.sum()


def train(labelled: DataFrame) -> Model:
    """``labelled`` has text and lang. All rows are counted: per task and language one array, then sums per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"].to_pylist(), strict=True):
                text = text.as_py()
                if has_letter(text):
                    tally = tallies.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    tally += np.bincount(grams(text), minlength=BUCKETS)
        for lang, tally in tallies.items():
            seen = np.flatnonzero(tally)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen), pa.array(tally[seen])], names=["lang", "bucket", "n"])

    rows = labelled.where(F.col("lang").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))
    counts = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    model = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("cells")).orderBy("lang")
    labels, table = [], []
    for row in model.toLocalIterator():
        if len(labels) == MOST_LABELS:
            raise ValueError(f"more than {MOST_LABELS} language labels")
        tally = np.zeros(BUCKETS)
        tally[[c.bucket for c in row.cells]] = [c.n for c in row.cells]
        labels.append(row.lang)
        table.append(tally)
    return Model(labels, np.array(table))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` needs a column text; adds languages (map of shares), lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keys = [c for c in docs.columns if c not in ("languages", "lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [judge.proportions(t.as_py()) for t in batch["text"]]
                first = [next(iter(x.items()), ("und", 0.0)) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [batch[c] for c in keys]
                    + [
                        pa.array([list(x.items()) for x in found], pa.map_(pa.string(), pa.float64())),
                        pa.array([x[0] for x in first], pa.string()), pa.array([min(1.0, x[1]) for x in first], pa.float64()),
                    ],
                    names=[*keys, "languages", "lang_pred", "score"],
                )

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keys)
    return docs.mapInArrow(run, f"{fields}, languages map<string, double>, lang_pred string, score double")


def remainder(modulus: int):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(modulus))


def trained_on(docs: DataFrame) -> DataFrame:
    return docs.where((remainder(4) != 2) & F.col("lang").isNotNull()).select("text", "lang")


def report(docs: DataFrame) -> DataFrame:
    """Trains on three of four documents and predicts all."""
    model = train(trained_on(docs))
    rows = docs.select("doc_id", "text", (remainder(4) == 2).alias("held_out"))
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score", "languages")


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Documents whose main language is known and makes up at least ``least`` of the text; the others go."""
    model = train(trained_on(docs))
    rows = identify(packed(docs, "row", text=F.col("text")), model)
    return unpacked(rows.where((F.col("lang_pred") != "und") & (F.col("score") >= least)), "row", docs)
