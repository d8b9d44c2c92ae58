import random
import re

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from slotwise.llm import simhash as S


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """{fp: smallest fp reachable} over all pairs."""
    fps = np.array(sorted(set(prints)), np.uint64)
    root = np.arange(len(fps))
    while True:
        new = np.array([root[np.bitwise_count(fps ^ f) <= 2].min() for f in fps])
        if (new == root).all():
            return {int(f): int(fps[r]) for f, r in zip(fps, root)}
        root = new


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b", "a b c", "A  b\tc d\x0be", "x\x85y\xa0z q r", "é ü ß 漢字 か", "w " * 9000])
def test_fingerprint(text):
    assert S.fingerprint(text) == slow_print(text)


def test_spark_hash_is_the_same(spark):
    row = spark.sql("select xxhash64('a b c') h").first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def clustered_prints(n, seed=3):
    """Random fingerprints, and one crowd of near ones that chains over several bits."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    centre = rng.getrandbits(64)
    for _ in range(3 * n):
        x = centre
        for _ in range(rng.choice([1, 2, 3, 4])):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("block", [16, 64, 1024])
def test_links_keep_every_component(spark, monkeypatch, block):
    prints = clustered_prints(300)
    monkeypatch.setattr(S, "BLOCK", block)
    rows = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long").repartition(5)
    got = S.parts(rows.withColumn("key", F.col("fp"))).collect()
    want = slow_components(prints)
    unsigned = lambda x: x % (1 << 64)
    groups = {}
    for r in got:
        groups.setdefault(r.component, set()).add(unsigned(r.print))
    expected = {}
    for f, r in want.items():
        expected.setdefault(r, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))
    assert len(got) == len(prints)


def test_tree_search_finds_all_within_the_limit():
    prints = np.array(clustered_prints(200), np.uint64)
    ranks = prints.copy()
    for s in (1, 2, 4, 8, 16, 32):
        ranks ^= ranks >> np.uint64(s)
    members = prints[np.argsort(ranks)]
    q, m = S.Tree(np.full(len(members), S.ONES), members).search(prints, 2)
    got = set(zip(q.tolist(), m.tolist()))
    want = {(i, j) for i, p in enumerate(prints) for j in np.flatnonzero(np.bitwise_count(members ^ p) <= 2).tolist()}
    assert got == want


def test_gray_rank_orders_by_the_reflected_code(spark):
    values = spark.range(64).select(F.col("id").alias("fp"))
    codes = [r.fp for r in values.orderBy(S.gray_rank(F.col("fp"))).collect()]
    assert all(bin(a ^ b).count("1") == 1 for a, b in zip(codes, codes[1:]))


def test_report_over_documents(docs):
    rows = {r.doc_id: r for r in S.report(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {d: slow_print(t) for d, t in texts.items()}
    root = slow_components(prints.values())
    least = {}
    for d, p in prints.items():
        least[root[p]] = min(least.get(root[p], d), d)
    for d, p in prints.items():
        assert rows[d].fingerprint == f"{p:016x}" and rows[d].component_id == least[root[p]]


def test_one_of_each_group_stays(awkward, no_docs):
    kept = S.keep_one(awkward)
    assert kept.columns == awkward.columns
    rows = kept.collect()
    groups = {slow_print(r.text) for r in awkward.collect()}
    assert len(rows) == len({slow_print(r.text) for r in rows}) == len(groups)
    assert {r.doc_id for r in rows if r.text and "lazy" in r.text} == {1} and [r.doc_id for r in rows if not (r.text or "").strip()] == [2]
    assert S.keep_one(no_docs).count() == 0 and S.report(no_docs).count() == 0
