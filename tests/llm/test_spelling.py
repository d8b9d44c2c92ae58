import random
import re
import zlib
from collections import Counter

from slotwise.llm import spelling as SP
from tests.compare import canonical, connect


def slow_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate({i: i + 32 for i in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            counts[word] += len(word) >= 7
    return {w: n for w, n in counts.items() if n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_groups(words):
    near = {w: [v for v in words if abs(len(w) - len(v)) < 2 and one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=lambda r: r[0])


def variants(rng, word, letters):
    at = rng.randrange(len(word) + 1)
    kind = rng.choice("idr")
    return word[:at] + (rng.choice(letters) if kind != "d" else "") + word[at + (kind != "i") :]


def test_pairs_and_chains_by_brute_force(spark):
    """Every kind of edit at every place, short and long words, accents, repeated letters, ties, chains of several forms."""
    rng = random.Random(3)
    words = {}
    for base in ("spelling", "aaaaaaa", "abababab", "größeren", "éàéàéàé", "w" * 60, "internationalisation", "abcdefg"):
        letters = sorted(set(base)) + ["z", "ÿ"]
        words[base] = rng.choice([20_000, 300, 300])
        for at in range(len(base) + 1):
            for edited in (base[:at] + base[at + 1 :], base[:at] + "q" + base[at:], base[:at] + "ø" + base[at + 1 :]):
                words.setdefault(edited, rng.choice([2, 3, 30, 300]))
        for _ in range(25):
            words.setdefault(variants(rng, variants(rng, base, letters), letters), rng.choice([2, 25]))
    for k, word in enumerate(("chainof", "chainofo", "chainofon", "chainofone", "chainofones")):
        words[word] = 2 * 10**k
    words = {w: n for w, n in words.items() if len(w) >= 7}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(7)
    got = sorted((tuple(r) for r in SP.grouped(df).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])
    assert got == slow_groups(words)
    assert any(r[0] == "chainof" and r[2] == "chainofones" for r in got)


def test_whole_documents(spark):
    rows = [(i if i % 9 else None, f"Committee {'commitee ' * (i % 5 == 0)} separate{i % 3} Überzeugung überzeugung×mal seperate accommodations") for i in range(400)]
    docs = spark.createDataFrame([*rows, (5, None), (6, ""), (7, "12 ab")], "doc_id long, text string").repartition(4)
    words = slow_words(rows)
    got = sorted((tuple(r) for r in SP.report(docs).collect()), key=lambda r: r[0])
    assert got == slow_groups(words) and len(got) > 20


def test_awkward_and_empty(awkward, no_docs):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = sorted((tuple(r) for r in SP.report(awkward).collect()), key=lambda r: r[0])
    assert got == slow_groups(slow_words(rows))
    assert SP.report(no_docs).count() == 0


def test_same_as_sql(spark, sf, docs):
    assert canonical(SP.report(docs).toPandas()) == canonical(connect(sf).execute(SP.SQL).df())
