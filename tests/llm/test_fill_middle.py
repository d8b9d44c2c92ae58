import hashlib
import re

from slotwise.llm import fill_middle as FM
from tests.compare import canonical, connect

TEXTS = [
    "", "a", "Zwei Wörter, 3 Zahlen.\nNeue Zeile", "x <P> y", "<S>", "ends with <M>", "<P", "P>", "<<S", "a<", "\n\t ", "𝒜𝒷c d",
    "only" * 50, "é" * 30, "a b " * 4000, "<<P <S S> <M M>",
]


def slow(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, digest = len(units), hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if text == "" or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted([h1 % (n + 1), h2 % (n + 1)])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_by_hand_and_back(spark):
    rows = [(i * len(TEXTS) + k, t) for i in range(12) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = FM.transformed(docs).select("row.doc_id", "row.text", "fim.*").withColumn("back", FM.rebuilt(FM.F.col("output"), FM.F.col("form")))
    found = out.collect()
    assert len(found) == len(rows) and {r.form for r in found} == {"plain", "psm", "spm"}
    for r in found:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == slow(r.doc_id, r.text)
        assert r.back == r.text


def test_whole_documents(docs):
    found = {r.doc_id: r for r in FM.report(docs).collect()}
    for r in docs.collect():
        n, form, a, b, output = slow(r.doc_id, r.text)
        got = found[r.doc_id]
        assert (got.n, got.form, got.prefix_chars, got.middle_chars) == (n, form, a, b)
        assert got.output_sha256 == hashlib.sha256(output.encode()).hexdigest() and got.restored_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_awkward_and_empty(awkward, no_docs):
    rows = FM.apply(awkward)
    assert rows.columns == awkward.columns and rows.count() == awkward.count()
    null = [r for r in FM.report(awkward).collect() if r.doc_id == 3]
    assert [(r.n, r.form, r.prefix_chars) for r in null] == [(0, "plain", None)]
    unknown = [r for r in FM.transformed(awkward).select("row.doc_id", "fim.*").collect() if r.doc_id is None]
    assert [(r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in unknown] == [slow("", "The quick brown fox")]
    assert FM.report(no_docs).count() == 0


def test_same_as_sql(spark, sf):
    got = FM.report(spark.read.parquet(f"{sf}/documents.parquet")).toPandas()
    assert canonical(got) == canonical(connect(sf).execute(FM.SQL).df())
