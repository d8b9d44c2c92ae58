import hashlib
import random
import re

import pytest

from slotwise.llm import exact_copies as EC
from tests.compare import canonical, connect


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def slow(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(squeezed(t), []).append(d)
    out = []
    for t, ids in groups.items():
        known = sorted(d for d in ids if d is not None)
        first = known[0] if known else None
        for d, stays in [(d, k == 0) for k, d in enumerate([*known, *[None] * (len(ids) - len(known))])]:
            out.append((d, first, len(ids), stays, hashlib.sha256(t.encode()).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=str)


def planted():
    """Copies with other white space, texts that differ in one late byte, shared heads of every digit's length, a crowd, long texts."""
    rng = random.Random(12)
    long = "".join(rng.choice("abcdef \n") for _ in range(60_000))
    texts = [None, "", " ", "\n\n", "a", "a ", "ab", "ba", "é", "é", long, long, long[:-1] + "x", long.replace("\n", " \t"), "x" + long[1:]]
    for cut in (31, 32, 33, 287, 288, 289, 2335, 2336, 2337, 19_000):
        base = "".join(rng.choice("ghij") for _ in range(cut))
        texts += [base, base + "k", base + "l", base + "k", base[:-1] + "z", base]
    texts += ["one text that a third of all rows share, longer than its first digit\n"] * 120
    rng.shuffle(texts)
    return [*enumerate(texts, 100), (100, texts[0]), (None, texts[3]), (None, "nobody's text"), (None, "nobody's text")]


def test_against_dictionary(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in EC.report(docs).collect()]
    assert order(got) == order(slow(rows))


@pytest.mark.parametrize("first, growth, widest", [(1, 1, 1), (2, 2, 4), (3, 8, 1000)])
def test_digits_of_other_widths(spark, monkeypatch, first, growth, widest):
    monkeypatch.setattr(EC, "FIRST", first)
    monkeypatch.setattr(EC, "GROWTH", growth)
    monkeypatch.setattr(EC, "WIDEST", widest)
    rows = [(i, t) for i, t in enumerate(["abcdef", "abcdeg", "abcdef", "abc", "abd", "xbcdef", "", None, "a", "abcdef", "ab"])]
    got = [tuple(r) for r in EC.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert order(got) == order(slow(rows))


def test_digit_starts_cover_every_byte():
    for size in (0, 32, 33, 288, 289, 5_000_000):
        starts = EC.digit_starts(size)
        assert starts == sorted(set(starts)) and all(s < size for s in starts) and (size <= EC.FIRST) == (not starts)
    assert max(b - a for a, b in zip(EC.digit_starts(9_000_000), EC.digit_starts(9_000_000)[1:])) == EC.WIDEST


def test_awkward_and_empty(awkward, no_docs):
    rows = EC.keep_one(awkward)
    assert rows.columns == awkward.columns
    found = sorted((r.doc_id, r.text or "") for r in rows.collect() if r.doc_id is not None)
    assert [d for d, _ in found] == [1, 2, 4, 5, 6, 8, 9, 9, 10]
    assert EC.report(no_docs).count() == 0 and EC.keep_one(no_docs).columns == no_docs.columns


def test_same_as_sql(spark, sf, docs):
    assert canonical(EC.report(docs).toPandas()) == canonical(connect(sf).execute(EC.SQL).df())
