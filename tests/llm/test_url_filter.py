import pytest
from pyspark.sql import functions as F

from slotwise.llm import url_filter as U
from slotwise.llm.components import components

CANON = '<html><head><link href="{}" rel="canonical"></head></html>'
FRESH = "<META HTTP-EQUIV='Refresh' content='0; URL={}'>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, "http://bad.com/de/x", None), (2, "http://alias.net/1", CANON.format("https://bad.com/de/x#top")), (3, "http://alias.net/2", FRESH.format("//alias.net/1")),
        (4, "http://good.org/1", CANON.format("http://alias.net/2")), (5, "http://clean.net/", CANON.format("/self")), (6, None, "<p>"), (7, "no scheme", CANON.format("http://bad.com/de/x")),
        (8, "HTTP://WWW.Example.ORG/en/1?q", ""), (9, "http://a.example.org/es/2", None), (10, "http://x.com/fr/de/", None), (11, "http://alias.net/1", None),
        (11, "http://alias.net/1", None), (12, "http://org/", None), (13, "http://notexample.org/es/", None), (14, "http://u.net/a\nb?c", None),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))


def test_rules_and_aliases(pages):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages).collect()}
    assert got[1] == ("bad.com", "/de/x", "com/de/", "block")
    assert got[2] == ("alias.net", "/1", None, "block") and got[3][3] == "block" and got[11][3] == "block"
    assert got[4] == ("good.org", "/1", "org/", "allow")  # an explicit allow keeps precedence
    assert got[5] == ("clean.net", "/", None, "allow") and got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow")
    assert got[8] == ("www.example.org", "/en/1", "example.org/en/1", "block") and got[9][2:] == ("example.org/es/", "block")
    assert got[10][2:] == ("com/fr/", "allow") and got[12][2:] == ("org/", "allow") and got[13][2:] == ("org/", "allow") and got[14][:2] == ("u.net", "/a\nb")
    assert U.judge(pages).count() == pages.count() and U.judge(pages.where("false")).count() == 0


def test_given_redirects_add_edges(spark, pages):
    redirects = spark.createDataFrame([("http://clean.net/", "http://bad.com/de/x"), (None, "http://bad.com/de/x")], "from_url string, to_url string")
    got = {r.page_id: r.verdict for r in U.judge(pages, redirects=redirects).collect()}
    assert got[5] == "block"


def test_sql_agrees_on_planted_links(pages):
    import duckdb

    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "url", "html").where("page_id <> 3").toPandas())
    want = sorted(map(str, con.execute(U.SQL).fetchall()))
    got = sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in U.judge(pages.where("page_id <> 3")).collect())
    assert got == want


def test_components_of_chains_stars_and_rings(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(0, i) for i in range(1, 60)] + [(5, 6), (6, 5), (7, 7)]
    ring = [(200 + i, 200 + (i + 1) % 17) for i in range(17)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(chain + star + ring, "a long, b long"), "test").collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 0 for i in range(60)} | {200 + i: 200 for i in range(17)}
    assert components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def test_no_python_in_the_plan(pages):
    plan = pages._sc._jvm.PythonSQLUtils.explainString(U.judge(pages)._jdf.queryExecution(), "simple")
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_references_are_resolved(spark):
    """The examples of RFC 3986, 5.4, as nodes (without scheme and fragment), and awkward bases."""
    base = "http://a/b/c/d;p?q"
    want = {
        "g": "a/b/c/g", "./g": "a/b/c/g", "g/": "a/b/c/g/", "/g": "a/g", "//g": "g", "?y": "a/b/c/d;p?y", "g?y": "a/b/c/g?y", "#s": "a/b/c/d;p?q",
        "g#s": "a/b/c/g", "g?y#s": "a/b/c/g?y", ";x": "a/b/c/;x", "g;x?y#s": "a/b/c/g;x?y", ".": "a/b/c/", "./": "a/b/c/", "..": "a/b/", "../": "a/b/",
        "../g": "a/b/g", "../..": "a/", "../../": "a/", "../../g": "a/g", "../../../g": "a/g", "/./g": "a/g", "/../g": "a/g", "g.": "a/b/c/g.", "..g": "a/b/c/..g",
        "./../g": "a/b/g", "./g/.": "a/b/c/g/", "g/./h": "a/b/c/g/h", "g/../h": "a/b/c/h", "g?y/../x": "a/b/c/g?y/../x", "mailto:x": None, "go?u=http://z/": "a/b/c/go?u=http://z/",
        "g?a=1&amp;b=2": "a/b/c/g?a=1&b=2", "&#x2F;g&#233;": "a/gé", "HTTPS://B/x": "b/x",
    }
    cases = [(t, base, w) for t, w in want.items()] + [("x", "http://h", "h/x"), ("?x", "http://h/y?z#f", "h/y?x"), ("x", "http://h?q=/a/", "h/x")]
    rows = spark.createDataFrame(cases, "target string, url string, want string")
    got = rows.select("target", "want", U.bound(U.absolute(U.decoded(F.col("target")), F.col("url")), U.node_of).alias("got")).collect()
    assert [(r.target, r.got) for r in got] == [(r.target, r.want) for r in got]


def test_relative_links_carry_blocks(spark):
    rows = [
        (1, "http://bad.com/de/x", None), (2, "http://bad.com/fine/1", CANON.format("../de/x")), (3, "http://p.net/a/b", FRESH.format("c?k=1&amp;l=2")),
        (4, "http://p.net/a/c?k=1&l=2", CANON.format("http://bad.com/de/x")), (5, "http://q.net/deep/page", '<base href="http://bad.com/de/">' + CANON.format("x")),
        (6, "http://q.net/other", CANON.format("./other?s=1")), (7, "http://r.net/z", CANON.format("mailto:x")),
    ]
    got = {r.page_id: r.verdict for r in U.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(1, 8)] == ["block"] * 5 + ["allow"] * 2


# Where a canonical link does (True) or doesn't (False) state an edge.
STATED = {
    '<link rel="alternate canonical" href="{}">': True, '<link title="a>b" rel=canonical href={}>': True, '<link data-href="http://x.net/" rel="canonical" href="{}">': True,
    "<LINK\nHREF = '{}'\nREL = 'Canonical\tnofollow'/>": True, '<link rel="canonical" href="{}" href="http://x.net/">': True, '<!-- a --><link href="  {}\n" rel=canonical>': True,
    '<!--><link rel="canonical" href="{}">': True, "<script>var a = '<!--';</script><link rel=canonical href={}>": True, '<style>a > b</style ><link rel="canonical" href="{}">': True,
    '<a title="<!--">x</a><link rel="canonical" href="{}">': True, '<meta content="3,url=\'{}\'" http-equiv=refresh>': True, "<meta http-equiv='refresh' content='0;{}'>": True,
    '<!-- <link rel="canonical" href="{}"> -->': False, '<!-- <link rel="canonical" href="{}">': False, "<script>s = '<link rel=\"canonical\" href=\"{}\">';</script>": False,
    '<style><link rel="canonical" href="{}">': False, '<a title=\'<link rel="canonical" href="{}">\'>x</a>': False, '<link rel="canonical" data-href="{}">': False,
    '<link rel="canonicals" href="{}">': False, '<link title=\'rel="canonical"\' href="{}">': False, '<links rel="canonical" href="{}">': False, '<link rel="canonical" href="{}"': False,
    '<link rel="icon" rel="canonical" href="{}">': False, '<textarea><link rel="canonical" href="{}"></textarea>': False, '<meta name="refresh" content="0;url={}">': False,
    '<link rel="canonical" href="">{}': False, '<meta http-equiv="refresh" content="30">{}': False, '<link rel="canonical" title="href={}">': False,
}


def test_links_in_awkward_markup(spark):
    """Tags are read as a browser reads them, in Spark and in SQL; very long tags, values and comments too."""
    import duckdb

    bad, long = "http://bad.com/de/x", "y" * 300_000
    cases = list(STATED.items()) + [
        (f'<p title="{long}">' + "<a b=c>" * 50_000 + f"<!--{long}--><link {'d=1 ' * 20_000}rel=canonical href={{}}>", True),
        (f"<script>{long}<link rel=canonical href={{}}>", False),
    ]
    rows = [(i, f"http://p{i}.net/", html.format(bad)) for i, (html, _) in enumerate(cases)] + [(len(cases), bad, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: "block" if stated else "allow" for i, (_, stated) in enumerate(cases)} | {len(cases): "block"}
    assert {r.page_id: r.verdict for r in U.judge(pages).collect()} == want
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    assert {r[0]: r[-1] for r in con.execute(U.SQL).fetchall()} == want
