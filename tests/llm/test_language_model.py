import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zlib

from slotwise.llm import elias_fano as E, language_model as M
from slotwise.llm.elias_fano import EliasFano

FOLD = {i: i + 32 for i in range(65, 91)}
END = " "


@pytest.mark.parametrize("n,universe", [(0, 100), (1, 1), (5, 7), (1000, 1 << 64), (30_000, 1 << 40), (1000, 1001), (3000, 100)])
def test_elias_fano_gets_and_finds(n, universe):
    rng = np.random.default_rng(n)
    draw = lambda k: rng.integers(0, min(universe, (1 << 64) - 1), k, dtype=np.uint64)
    values = np.sort(draw(n))
    s = EliasFano.of(values, universe)
    assert (s.get(np.arange(n)) == values).all()
    if 1 < n and universe < 1 << 63:
        some = rng.integers(0, n - 1, 500)
        first, second = s.pair(some)
        assert (first == values[some]).all() and (second == values[some + 1]).all()
    known = set(values.tolist())
    asked = np.concatenate([values, draw(300)])
    for x, i in zip(asked.tolist(), s.find(asked).tolist()):
        assert (i >= 0) == (x in known) and (i < 0 or int(values[i]) == x)
    if n > 10:
        half = s.find(values, np.zeros(n, np.int64), np.full(n, n // 2))
        assert all((i >= 0) == (v in set(values[: n // 2].tolist())) for v, i in zip(values.tolist(), half.tolist()))


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_elias_fano_finds_alike_by_both_searches(few, monkeypatch):
    monkeypatch.setattr(E, "FEW", few)
    test_elias_fano_finds_in_ranges_of_any_size()


def test_elias_fano_finds_in_ranges_of_any_size():
    rng = np.random.default_rng(3)
    values = np.unique(rng.integers(0, 5000, 2000, dtype=np.uint64))
    s = EliasFano.of(values, 5000)
    x, lo = rng.integers(0, 5000, 4000, dtype=np.uint64), rng.integers(0, len(values), 4000)
    hi = np.minimum(lo + rng.integers(0, 12, 4000), len(values))
    x[::2] = values[np.minimum(lo + rng.integers(0, 6, 4000), len(values) - 1)][::2]
    got = s.find(x, lo, hi)
    want = [next((i for i in range(a, b) if values[i] == v), -1) for v, a, b in zip(x, lo, hi, strict=True)]
    assert got.tolist() == want and (got >= 0).sum() > 500


def test_elias_fano_is_compact():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 40, 100_000, dtype=np.uint64))
    used = sum(a.nbytes for a in EliasFano.of(values, 1 << 40).arrays().values())
    assert used * 8 / len(values) < 2 + math.log2((1 << 40) / len(values)) + 2


def brute(texts, discount=M.DISCOUNT):
    """p of each next word by plain dictionaries."""
    tokens = {d: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD)) + [END] for d, t in texts.items()}
    one, two, three = Counter(), Counter(), Counter()
    for d, t in tokens.items():
        if zlib.crc32(str(d).encode()) % 5 != 1:
            s = [END, *t]
            one.update(t)
            two.update(zip(s, s[1:]))
            three.update(zip(s, s[1:], s[2:]))
    total, size = sum(one.values()), len(one)
    two = {g: c for g, c in two.items() if c >= M.MIN_COUNT}
    three = {g: c for g, c in three.items() if c >= M.MIN_COUNT}
    mass1, mass2 = Counter(), Counter()
    for (a, _), c in two.items():
        mass1[a] += c - discount
    for (a, b, _), c in three.items():
        mass2[a, b] += c - discount
    p1 = lambda w: (one.get(w, 0) + 0.5) / (total + 0.5 * (size + 1))

    def p2(a, w):
        return max(two.get((a, w), 0) - discount, 0) / one[a] + (1 - mass1[a] / one[a]) * p1(w) if a in one else p1(w)

    def p3(a, b, w):
        n = two.get((a, b))
        return max(three.get((a, b, w), 0) - discount, 0) / n + (1 - mass2[a, b] / n) * p2(b, w) if n else p2(b, w)

    return tokens, one, total, p1, p2, p3


def check(rows, texts):
    tokens, one, total, p1, p2, p3 = brute(texts)
    for r in rows:
        t = tokens[r.doc_id]
        s = [END, *t]
        base = sum(math.log10(p1(w)) for w in t)
        score = math.log10(p2(END, t[0])) + sum(math.log10(p3(*g)) for g in zip(s, s[1:], s[2:]))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in one for w in t), total)
        assert r.base_score == pytest.approx(base, abs=1e-7) and r.score == pytest.approx(score, abs=len(t) / 2000)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)


def test_scores_match_brute_force(docs):
    check(M.report(docs).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_many_small_files_give_the_same_scores(spark, docs, monkeypatch):
    some = docs.where("n_chars < 3000")
    monkeypatch.setattr(M, "SHARD", 300)
    monkeypatch.setattr(M, "PAIRS", 777)
    monkeypatch.setattr(M, "BUCKET", 1000)
    check(M.report(some).collect(), {r.doc_id: r.text for r in some.collect()})


def test_probabilities_sum_to_one(docs):
    tokens, one, total, p1, p2, p3 = brute({r.doc_id: r.text for r in docs.where("n_chars < 1500").collect()})
    words = [*one, "\x00unknown"]
    assert sum(map(p1, words)) == pytest.approx(1) and sum(p2(END, w) for w in words) == pytest.approx(1)
    a, b = next((s[0], s[1]) for s in tokens.values() if len(s) > 3)
    assert sum(p3(a, b, w) for w in words) == pytest.approx(1)


def test_packed_counts_come_back():
    rng = np.random.default_rng(5)
    node, word, n = M.summed(rng.integers(0, 1 << 45, 500), rng.integers(0, 1 << 31, 500), np.ones(500, np.int64))
    assert all((a == b).all() for a, b in zip(M.unpack(M.pack(node, word, n)), (node, word, n)))


def test_ranges_are_even_and_in_order():
    n = np.r_[np.ones(1000, np.int64), 5000, np.ones(1000, np.int64)]
    starts, masses = M.pieces(n, 50)
    assert starts[0] == 0 and masses.sum() == n.sum() and (np.diff(starts) > 0).all()
    cuts = M.ranges(starts, masses, 14)
    sums = [part.sum() for part in np.split(n, cuts)]
    assert (np.diff(cuts) > 0).all() and sum(x > 1100 for x in sums) == 1 and len(sums) >= 5
    assert len(M.ranges(*M.pieces(np.empty(0, np.int64), 1), 8)) == 0


def test_awkward_rows(awkward, no_docs):
    rows = M.report(awkward).collect()
    assert len(rows) == awkward.count() and all(r.n_tokens == 1 for r in rows if r.doc_id in (2, 3, 4))
    assert all(r.score < 0 and r.base_score < 0 for r in rows)
    assert M.report(no_docs).count() == 0


def test_without_training_rows(spark):
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    [r] = M.report(spark.createDataFrame([(alone, "a b")], "doc_id long, text string")).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score, r.held_out) == (3, 0, 0, 0.0, 0.0, True)


def brute_all(texts):
    """The brute force with every n-gram, whatever the operator's setting is."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(M, "MIN_COUNT", 1)
        return brute(texts)


def test_n_grams_seen_once_count(spark):
    texts = {d: f"rare{d} pair{d} end{d} common words here" for d in range(40)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    training = [d for d in texts if zlib.crc32(str(d).encode()) % 5 != 1]
    scored = {r.doc_id: r for r in M.report(rows).collect()}
    tokens, one, total, p1, p2, p3 = brute_all(texts)
    for d in training:  # "rare pair end" occurs once in the corpus
        s = [END, *tokens[d]]
        want = math.log10(p2(END, s[1])) + sum(math.log10(p3(*g)) for g in zip(s, s[1:], s[2:]))
        assert scored[d].score == pytest.approx(want, abs=len(s) / 2000)


def test_tokens_are_the_words_and_an_end():
    every = "".join(map(chr, range(1, 0x250)))
    texts = ["", " \t\n\x0b\x0c\r ", "Ab\x0bCD\x0ce ab", every, f" {every.lower()}", "\x00 a\u2003b \x1c\x85\xa0 ÄB", "A"]
    hashes, place, sizes = M.tokens_of(pa.array(["dropped", *texts]).slice(1))
    want = [[*re.findall(r"[^\x20\x09-\x0D]+", t.translate(FOLD)), END] for t in texts]
    assert sizes.tolist() == [len(w) for w in want]
    got, flat = hashes[place].tolist(), [w for words in want for w in words]
    assert len(set(got)) == len(hashes) == len(set(flat)) == len(set(zip(got, flat, strict=True)))
    assert [len(x) for x in M.tokens_of(pa.array([], pa.string()))] == [1, 0, 0]


def test_pairs_come_in_order_at_any_size():
    rng = np.random.default_rng(8)
    for words, most in ((50, 40), (M.MOST_WORDS, 1 << 60)):
        node, word = rng.integers(0, most, 300), rng.integers(-1, words, 300)
        node, word = np.r_[node, node], np.r_[word, word]
        order, fresh = M.in_order(node, word, words)
        pairs = list(zip(node[order].tolist(), word[order].tolist(), strict=True))
        assert pairs == sorted(pairs) and [p for p, f in zip(pairs, fresh, strict=True) if f] == sorted(set(pairs))


def test_slices_hold_every_row():
    sizes = np.array([3, 0, 9, 100, 1, 1, 0])
    got = list(M.slices(sizes, 10))
    assert got[0][0] == 0 and [at + n for at, n in got] == [at for at, _ in got[1:]] + [len(sizes)]
    assert all(sizes[at : at + n - 1].sum() < 20 for at, n in got) and list(M.slices(sizes[:0], 10)) == []


def test_equal_n_grams_are_looked_up_once(spark, monkeypatch):
    some = [(d, f"one two three four five w{d}") for d in range(30)]
    rows = spark.createDataFrame(some, "doc_id long, text string").selectExpr("*", "false held_out")
    model = M.Model(M.fit(rows)[0])
    asked, find = [], EliasFano.find
    monkeypatch.setattr(EliasFano, "find", lambda self, x, *r: (asked.append(len(x)), find(self, x, *r))[1])
    a, b = model.vocabulary.number(M.hashes_of(pa.array(["one", "two"])))[0]
    asked.clear()
    child, value, _ = model.levels[0].look_up(np.tile([a, b, -1], 400), np.tile([b, a, a], 400))
    assert sum(asked) == 2 and (child[::3] == child[0]).all() and child[0] >= 0 and (child[1::3] < 0).all()
    assert (value[::3] == value[0]).all() and value[0] < 0
