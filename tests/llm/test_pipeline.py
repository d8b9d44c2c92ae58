import corpus_pipeline
from slotwise.llm import decontamination, languages, mixing, secrets
from tests.llm.test_near_copies import slow_kept


def test_stages_follow_each_other(spark, sf, docs):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    rows, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = rows.cache()
        rows = stage(spark, before, sf)
        assert rows.columns == columns, name
        ids = {r.doc_id for r in rows.collect()}
        if name == "languages":
            known = {r.doc_id for r in languages.report(before).collect() if r.lang_pred != "und" and r.score >= 0.5}
            assert ids == known
        elif name == "near_copies":
            assert ids == slow_kept({r.doc_id: r.text for r in before.collect()}) and rows.count() == len(ids)
        elif name == "decontamination":
            assert ids == {r.doc_id for r in decontamination.report(before, bench).collect() if not r.contaminated}
        elif name == "secrets":
            assert ids == {r.doc_id for r in before.collect()}
            again = secrets.report(rows)
            assert again.selectExpr("sum(n_assign + n_access + n_hex)").first()[0] == 0
        else:
            taken = {r.doc_id: r.taken for r in mixing.report(before).collect()}
            words = {}
            for r in rows.collect():
                words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
            assert all(words.get(d, 0) == t for d, t in taken.items())


def test_run_over_awkward_and_empty_tables(spark, sf, awkward, no_docs, tmp_path):
    for k, table in enumerate((awkward, no_docs)):
        folder = f"{tmp_path}/{k}"
        table.write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert out.columns == table.columns
        assert out.where("text is null").count() == 0
