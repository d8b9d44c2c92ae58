import pytest

from slotwise.llm import mixing


def test_targets_stop_at_twice_the_size_and_reshare(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 500), ("c", 100), (None, 90)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # weights 3, 1, 2, 3; 1050 words; a (20), c (200) and the null source (180) stop, b takes the rest up to its bound
    assert got == {"a": 20.0, "c": 200.0, None: 180.0, "b": 650.0}
    assert sum(got.values()) == pytest.approx(1.5 * 700)


def test_words_taken_come_near_each_target(docs):
    rows = mixing.report(docs).collect()
    per_source = {}
    for r in rows:
        assert r.taken % max(r["size"], 1) == 0 and r.taken <= 2 * r["size"]
        goal = per_source.setdefault((r.source_size, r.target), [0, 0])
        goal[0] += r.taken
        goal[1] = max(goal[1], r["size"])
    assert all(abs(taken - target) <= 2 * longest for (_, target), (taken, longest) in per_source.items())


def test_awkward_rows_and_reruns(awkward):
    first, second = (sorted(map(tuple, mixing.report(awkward).collect()), key=str) for _ in range(2))
    assert first == second and len(first) == awkward.count()
    out = mixing.mixture(awkward)
    assert out.columns == awkward.columns and sum(r["taken"] for r in mixing.report(awkward).collect()) == sum(len((r.text or "").split()) for r in out.collect())


def test_a_hot_source_spreads_over_tasks(spark):
    rows = spark.range(6000).selectExpr("id as doc_id", "repeat('w ', int(id % 7)) as text", "if(id % 3 = 0, 'x', concat('s', id % 5)) as source")
    got = mixing.report(rows)
    assert got.count() == 6000
    taken = got.groupBy("source_size", "target").sum("taken").collect()
    assert all(abs(r["sum(taken)"] - r.target) <= 14 for r in taken)


def test_nothing_in_nothing_out(no_docs):
    assert mixing.report(no_docs).count() == 0 and mixing.mixture(no_docs).count() == 0


def test_a_source_without_words_emits_nothing(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.report(rows).collect()] == [(0.0, 0), (0.0, 0)]
