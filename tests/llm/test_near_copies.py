import random
import re

import corpus_pipeline
from slotwise.llm import near_copies as NC, simhash


def slow_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_kept(texts):
    """Smallest doc_id of each component of Jaccard >= 0.8, over all pairs."""
    ids = sorted(texts)
    sets = {d: slow_set(texts[d]) for d in ids}
    root = {d: d for d in ids}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if 5 * len(x & y) >= 4 * len(x | y):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return {top(d) for d in ids}


def planted():
    """Texts with one to many words edited (likeness from 0.98 down past 0.8), chains, a crowd, short and blank ones."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(4000)}"
    texts = []
    for size in (60, 150, 400, 900):
        for _ in range(6):
            base = [word() for _ in range(size)]
            texts.append(" ".join(base))
            for share in (1, 2, 3, 4, 6):
                edited = list(base)
                for at in rng.sample(range(size), max(1, size * share // 200)):
                    edited[at] = word()
                texts.append(" ".join(edited))
    chain = [word() for _ in range(200)]
    for k in range(12):  # each one is near the next, the ends are far apart
        texts.append(" ".join(chain[15 * k :] + [f"x{i}" for i in range(15 * k)]))
    crowd = [word() for _ in range(120)]
    for _ in range(60):
        edited = list(crowd)
        for at in rng.sample(range(120), rng.choice([1, 2, 3, 4])):
            edited[at] = word()
        texts.append(" ".join(edited))
    texts += ["", " \n", "one two", "ONE  two", "a b c d e", "A b\tc d e"]
    rng.shuffle(texts)
    return dict(enumerate(texts))


def test_stage_keeps_one_of_each_group_of_near_copies(spark):
    texts = planted()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = slow_kept(texts)
    got = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(got) == sorted(want)
    assert len(want) < simhash.keep_one(docs).count()  # two bits of op7 leave most of them


def crowds():
    """Stars (each copy is alike to the middle only, which has not the smallest id) and texts that share a long passage but aren't alike."""
    rng = random.Random(29)
    word = lambda: f"v{rng.randrange(9000)}"
    texts = []
    for size, copies in ((300, 150), (600, 60)):
        middle = [word() for _ in range(size)]
        for _ in range(copies):
            edited = list(middle)
            for at in rng.sample(range(size), size * 2 // 100):
                edited[at] = word()
            texts.append(" ".join(edited))
        texts.append(" ".join(middle))
    passage = [word() for _ in range(220)]
    for _ in range(200):
        texts.append(" ".join(passage + [word() for _ in range(rng.randrange(40, 110))]))
    return dict(enumerate(texts))


def test_recall_in_crowds(spark):
    texts = crowds()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = slow_kept(texts)
    got = {r.doc_id for r in NC.keep_one(docs).collect()}
    assert want <= got  # nothing is joined that isn't linked
    assert len(texts) - len(got) >= 0.98 * (len(texts) - len(want)) > 150
    exact = {r.doc_id for r in NC.keep_one(docs, every_pair=True).collect()}
    assert want <= exact <= got


def pairs_in_a_crowd():
    """Texts that share most of what they say but aren't alike, and 150 pairs among them that are, all of one length."""
    rng = random.Random(3)
    word = lambda: f"u{rng.randrange(9000)}"
    passage = [word() for _ in range(200)]
    texts = []
    for _ in range(150):
        both = [word() for _ in range(6)]
        texts += [" ".join(passage + both + [word() for _ in range(22)]) for _ in range(2)]
    texts += [" ".join(passage + [word() for _ in range(28)]) for _ in range(100)]
    rng.shuffle(texts)
    return dict(enumerate(texts))


def test_every_alike_pair_of_a_crowd_is_found(spark):
    """Leads alone miss fourteen of the pairs."""
    texts = pairs_in_a_crowd()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = slow_kept(texts)
    assert len(want) == len(texts) - 150
    assert {r.doc_id for r in NC.keep_one(docs).collect()} == want


def test_unmet_pairs_hold_all_alike_ones(spark):
    """Sets on both sides of likeness 0.8, in parts of one to many: no alike pair of two parts is left out, none within a part listed."""
    rng = random.Random(8)
    common = rng.sample(range(1 << 62), 60)
    sets = []
    for k in range(120):
        own = rng.sample(common, rng.randrange(24, 60)) if k % 2 else common[: rng.randrange(36, 60)]
        sets.append(NC.np.array(sorted(own + rng.sample(range(1 << 62), rng.randrange(6))), NC.np.uint64))
    sets += [NC.np.arange(1, 10, dtype="u8"), NC.np.arange(2, 11, dtype="u8"), NC.np.arange(1, 6, dtype="u8"), NC.np.arange(1, 5, dtype="u8")]
    part = [k if k % 3 else 0 for k in range(len(sets))]
    both = {(a, b) for b in range(len(sets)) for a in range(b) if part[a] != part[b]}
    near = {(a, b) for a, b in both if NC.alike(sets[a], sets[b])}
    assert {(120, 121), (122, 123)} <= near and len(near) > 100
    unsettled = spark.createDataFrame([(k, len(x), part[k]) for k, x in enumerate(sets)], "id long, n long, part long")
    stored = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(sets)], "id long, set binary")
    got = {tuple(sorted((r.a, r.b))) for r in NC._unmet(unsettled, stored).collect()}
    assert near <= got <= both and len(got) < len(both)


def test_whole_documents(docs):
    got = {r.doc_id for r in NC.keep_one(docs).collect()}
    assert got == slow_kept({r.doc_id: r.text for r in docs.collect()})


def test_awkward_and_empty(awkward, no_docs):
    rows = NC.keep_one(awkward)
    assert rows.columns == awkward.columns
    found = rows.collect()
    assert {r.doc_id for r in found if r.text and "lazy" in r.text} == {1} and [r.doc_id for r in found if not (r.text or "").strip()] == [2]
    assert NC.keep_one(no_docs).count() == 0


def test_simhashes_of_a_group_propose_its_pairs(spark):
    """Without any shared min-hash key the stage still joins sets whose SimHashes differ in few bits, and only alike ones."""
    texts = planted()
    sets = {d: NC.shingles(t) for d, t in texts.items()}
    prints = {d: NC.majority(x) for d, x in sets.items() if len(x)}
    assert prints[5] == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in sets[5]) > len(sets[5]))
    near = {(a, b) for a in prints for b in prints if a < b and 0 < (prints[a] ^ prints[b]).bit_count() <= NC.DISTANCE and NC.alike(sets[a], sets[b])}
    assert len(near) > 10
    rows = [(d, len(sets[d]), prints[d] - (1 << 64) * (prints[d] >> 63)) for d in prints]
    firsts = spark.createDataFrame(rows, "id long, n long, print long")
    cells = {r.id: r.cell for r in NC.by_simhash(firsts).collect()}
    assert cells.keys() == prints.keys() and all(cells[a] == cells[b] for a, b in near)
    assert len(set(cells.values())) > len(cells) // 4


def test_stage_asks_the_simhash_index(spark, monkeypatch):
    asked = []
    links = NC.links
    monkeypatch.setattr(NC, "links", lambda prints, limit: asked.append((prints.count(), limit)) or links(prints, limit))
    texts = planted()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    corpus_pipeline.drop_near_copies(spark, docs, "").count()
    assert asked == [(len({NC.majority(NC.shingles(t)) for t in texts.values() if t.strip()}), NC.DISTANCE)]
