import hashlib

from slotwise.llm import imatch as I


def test_edited_texts_and_next_documents(docs):
    rows = {r.doc_id: r for r in I.report(docs).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(texts, reverse=True)
    for i, d in enumerate(order):
        n = len(texts[d])
        edited = texts[d][: n - n // 3] + texts[order[(i + 1) % len(order)]][: n // 3]
        assert rows[d].n_chars == n and rows[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    by_text = {}
    for d, t in texts.items():
        by_text.setdefault(t, set()).add(rows[d].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    mean = lambda c: sum(r[c] for r in rows.values()) / len(rows)
    assert mean("near_edited") > 0.25 and mean("near_next") < 0.03
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows.values())


def test_the_lexicon_is_the_band(spark):
    rows = spark.range(1000).selectExpr("id", "concat('all ', 'w', id % 100, ' v', id % 300, ' u', id) as text")
    terms = I.lexicon(rows, low=4.0, high=6.0)  # between 2.5 and 18.3 of 1000
    assert len(terms) == 400  # w: 10 each, v: 3 or 4 each; not all (1000), not u (1)


def test_awkward_rows(awkward, no_docs, spark):
    rows = I.report(awkward).collect()
    assert len(rows) == awkward.count()
    empty = [r for r in rows if r.n_chars == 0]
    assert len(empty) == 2 and all(set(r.fingerprint) == {"-"} and r.near_edited == 1.0 for r in empty)
    assert I.report(no_docs).count() == 0
    [alone] = I.report(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).collect()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and alone.near_next == 1.0


def test_no_python_in_the_plan(awkward):
    plan = awkward._sc._jvm.PythonSQLUtils.explainString(I.report(awkward)._jdf.queryExecution(), "simple")
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
