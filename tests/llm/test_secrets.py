import hashlib
import random
import re
import string

from pyspark.sql import functions as F

from slotwise.llm import secrets as S

KINDS = (
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), 18), ("hex", re.compile("[0-9a-f]+"), 16),
)


def brute(text):
    spans = []
    for k, (name, pattern, least) in enumerate(KINDS):
        for m in pattern.finditer(text or ""):
            if len(m[2] if k == 0 else m[0]) >= least:
                spans.append((m.start(), k, m.end(), name))
    return [f"{name}:{a}:{b}" for a, _, b, name in sorted(spans)]


TRICKY = [
    None, "", "token=secret: abcdefghijklmnop", "PassWord : 'abc.def-ghi=jkl' x", "api_key=short apikey=longenoughvalue1", "AKIAAKIA1234 AKIAABCDEFGHIJKLMN",
    "deadbeefdeadbee deadbeefdeadbeef0", "é漢😀 token = \"4b579d3cee1dcaf48e80\" end", "tokén=abcdefghijklmnop", "secret==abcdefghijkl", "a" * 40, "password=" + "x" * 100_000,
    "ſecret=abcdefghijklmnop toKen=abcdefghijklmnop", "secret:token=abcdefghijklmnop", "AKIA" + "Z" * 14, "AKIA" + "Z" * 13, "\ttoken\t=abcdefghijklmnop",
]


def test_base_spans(spark):
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    for r in S.report(docs).collect():
        want = brute(TRICKY[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (TRICKY[r.doc_id], want, r.spans)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")]
        assert set(want) <= set(r.spans.split(",")) or not want


def test_whole_documents(docs):
    rows = {r.doc_id: r for r in S.report(docs).collect()}
    for d in docs.collect():
        assert rows[d.doc_id].base_sha256 == hashlib.sha256(",".join(brute(d.text)).encode()).hexdigest()


def test_random_strings_are_told_from_identifiers(spark, docs):
    rng = random.Random(7)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choices(alphabet, k=32)) for _ in range(40)]
    names = [f"{a}{b}{c}" for a, b, c in zip(["themanagement", "inthestation", "orderhandling"] * 14, ["Over", "Of", "With"] * 14, ["thereinstate2", "ordering", "nations3"] * 14)][:40]
    planted = spark.createDataFrame([(10_000 + i, f"see {k} here") for i, k in enumerate(keys)] + [(20_000 + i, f"call {n} now") for i, n in enumerate(names)], "doc_id long, text string")
    rows = S.report(docs.select("doc_id", "text").union(planted)).collect()
    found = {r.doc_id for r in rows if "markov" in r.spans}
    assert len(found & set(range(10_000, 10_040))) >= 36 and not found & set(range(20_000, 20_040))
    assert len([d for d in found if d < 10_000]) <= 2


CLASSES = {
    "lower": string.ascii_lowercase, "capitals": string.ascii_uppercase, "lower and digits": string.ascii_lowercase + string.digits,
    "mixed": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/",
}


def test_recall_per_class_and_length(spark, docs):
    """Keys of one class and of 12 characters are found too; what the given documents say in words is left alone."""
    rng = random.Random(11)
    rows, kinds = [], {}
    for kind, letters in CLASSES.items():
        for n in (12, 14, 16, 24, 32):
            for _ in range(60):
                kinds[10_000 + len(rows)] = (kind, n)
                rows.append((10_000 + len(rows), f"see {''.join(rng.choices(letters, k=n))} here"))
    planted = spark.createDataFrame(rows, "doc_id long, text string")
    scanned = S.with_spans(S.with_base(planted), S.fit(docs.select("text")))  # planted keys would be most of the sample of ordinary runs
    found = {r.doc_id for r in scanned.collect() if r.spans}
    for kind in CLASSES:
        for n, least in ((12, 0.8), (14, 0.85), (16, 0.9), (24, 0.97), (32, 1)):
            of_kind = [d for d, k in kinds.items() if k == (kind, n)]
            assert sum(d in found for d in of_kind) >= least * len(of_kind), (kind, n)


def test_ordinary_runs_are_left_alone(spark, docs):
    """Each distinct long run of letters of the given documents, numbers, rulers, and names made of the documents' words."""
    words = sorted({w for d in docs.collect() for w in re.findall("[A-Za-z]{12,}", d.text or "")})
    short = sorted({w for d in docs.collect() for w in re.findall("[a-z]{4,9}", d.text or "")})
    rng = random.Random(2)
    names = ["_".join(rng.choices(short, k=4)) for _ in range(100)] + ["".join(w.capitalize() for w in rng.choices(short, k=4)) for _ in range(100)]
    names += ["_".join(rng.choices(short, k=3)).upper() for _ in range(100)] + ["/".join(rng.choices(short, k=4)) for _ in range(100)]
    numbers = ["".join(rng.choices("0123456789", k=13)) for _ in range(100)] + ["=" * 40, "-" * 13, "_" * 12, "0" * 12]
    ratios = S.fit(docs.select("text"))
    rows = spark.createDataFrame([(k, v) for k, of in (("words", words), ("names", names), ("numbers", numbers)) for v in of], "kind string, value string")
    high = [(r.kind, r.value) for r in rows.where(S.score(F.col("value"), ratios) >= S.THRESHOLD).collect()]
    assert len(words) > 200 and len(high) <= 2, high


def test_scores_match_brute_force(spark, docs):
    """The sum of log ratios, each model asked within the run's own classes of characters, in plain Python."""
    counts = [{}, {}]
    for at, values in enumerate((["aB3x", "9f8e7d", "Zz9+"], ["station", "The_end", "ab"])):
        for v in values:
            for a, b in zip(v, v[1:]):
                pair = S.ALPHABET.index(a) * len(S.ALPHABET) + S.ALPHABET.index(b)
                counts[at][pair] = counts[at].get(pair, 0) + 1
    ratios = S.ratio_tables(*counts)
    k = len(S.ALPHABET)
    for value in ("station", "Qz7+x", "ABBA", "0011", "=", "==", "x_y"):
        held = {S.class_of(S.ALPHABET.index(c)) for c in value}
        mask = sum(1 << h for h in held)
        want = 0.0
        for a, b in zip(value, value[1:]):
            i, j = S.ALPHABET.index(a), S.ALPHABET.index(b)
            want += ratios[0][i * k + j] - ratios[1][mask * k + i]
        [got] = spark.createDataFrame([(value,)], "value string").select(S.score(F.col("value"), ratios)).first()
        assert abs(got - want) < 1e-9
    everything = (1 << len(S.CLASSES)) - 1
    assert all(abs(x) < 1e-5 for x in ratios[1][everything * k :])  # all classes: nothing is taken off


def test_redaction(awkward, no_docs):
    out = S.redact(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    [r] = out.where("text like '%[SECRET]%'").collect()
    assert r.text == "[SECRET]\" [SECRET] [SECRET]" and r.n_chars == len(r.text)
    assert out.where("text is null").count() == 1 and S.redact(no_docs).count() == 0 and S.report(no_docs).count() == 0


def test_overlapping_spans_are_one_mark(spark):
    docs = spark.createDataFrame([(1, "é token=deadbeefdeadbeef0 tail")], "doc_id long, text string")
    assert [r.text for r in S.redact(docs).collect()] == ["é [SECRET] tail"]


def test_no_python_in_the_plan(awkward):
    plan = awkward._sc._jvm.PythonSQLUtils.explainString(S.report(awkward)._jdf.queryExecution(), "simple")
    assert "Python" not in plan and "Arrow" not in plan
