"""URL filters with redirect equivalence.

A URL is judged by the longest rule that fits its host and path. URLs that name the same page are
aliases: pages link to each other by ``<link rel="canonical">`` and ``<meta http-equiv="refresh">``,
and more edges (for example a crawl's redirect log) may be given. Connected components over these
edges carry decisions: where any URL of a component is blocked by a rule, so are its aliases without
a rule of their own. An explicit allow keeps precedence: a URL that fits an allow rule stays allowed,
whatever its aliases are, and doesn't lift the block of others.

Built-in DataFrame functions only. Rules are parameters (a literal map from host to its rules, in the
plan); a URL looks up its own host suffixes, so there is no join per rule. Only URLs that have an edge
enter the component search.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule, has no alias
and is allowed; a null html has no links; repeated rows get equal answers; of rules of equal length,
which must be equal in host and path, the later one holds; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from slotwise.llm.common import kept, lower_ascii
from slotwise.llm.components import components

# Fixed by the contract: (verdict, host, path).
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
# Markup as a browser's tokenizer cuts it. Possessive quantifiers keep long tags off the regex stack; SQL takes the same patterns without.
SPACE = r"[\t\n\f\r ]"
REST = rf"""(?:[\t\n\f\r /](?:[^>=]++|={SPACE}*+"[^"]*+"|={SPACE}*+'[^']*+'|=)*+)?(?:>|\z)"""
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")  # elements that hold text, no tags
# Comments, declarations and raw elements are passed over; group 1 is a tag that may state a link or the page's base.
MARKUP = "(?is)" + "|".join((
    r"<!--(?:-?>|.*?(?:--!?>|\z))", r"<[!?][^>]*+", *(rf"<{name}{REST}.*?(?:</{name}[\t\n\f\r />]|\z)" for name in RAW),
    rf"(<(?:link|meta|base){REST})", rf"</?[a-z][^\t\n\f\r />]*+{REST}",
))
ATTRIBUTE = rf"""(?s)[^\t\n\f\r "'>/=][^\t\n\f\r >/=]*+(?:{SPACE}*+={SPACE}*+(?:"[^"]*+"|'[^']*+'|[^\t\n\f\r "'>][^\t\n\f\r >]*+))?"""
VALUE = rf"""(?s)^[^=]*={SPACE}*(?:"(.*)"|'(.*)'|([^"'].*))\z"""
DELAYED = rf"""(?is)^{SPACE}*[0-9.]+(?:{SPACE}*[;,]{SPACE}*|{SPACE}+)(?:url{SPACE}*={SPACE}*)?(?:"([^"]*)|'([^']*)|([^"'].*))"""
MAY_LINK = "(?i)canonical|refresh"
SCHEME = r"(?s)^[A-Za-z][A-Za-z0-9+.-]*:"
DOTS = r"(?s)/\.\.?(?:/|$)"


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value as a lambda's variable, so that its expression isn't copied to each place of use."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(after_scheme(url), r"(?s)^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(rest, F.lit(""))


def without_dots(path: Column) -> Column:
    """A rooted path without its segments ``.`` and ``..`` (RFC 3986, 5.2.4)."""
    parts = F.split(path, "/", -1)
    step = lambda done, p: (
        F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(p == ".", done).otherwise(F.concat(done, F.array(p)))
    )
    stack = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"), step)
    end = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.when(F.regexp_like(path, F.lit(DOTS)), F.concat(F.lit("/"), F.array_join(F.concat(stack, end), "/"))).otherwise(path)


def query_of(url: Column) -> Column:
    """The first ``?`` and what follows, up to the fragment."""
    return F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)


def node_of(url: Column) -> Column:
    """What makes two spellings one URL: host, path without dot segments, and query; neither scheme nor fragment."""
    return F.when(after_scheme(url).isNotNull(), F.concat(host_of(url), bound(path_of(url), without_dots), query_of(after_scheme(url))))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (size, rule, verdict) of the longest rule that fits, else null."""
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, of_host, of_path in rules:
        by_host.setdefault(of_host.lower(), []).append((of_path, verdict))
    kind = "array<struct<size:int,place:int,path:string,rule:string,verdict:string>>"
    if not by_host:
        return F.lit(None).cast("struct<size:int,place:int,path:string,rule:string,verdict:string>")
    cells = []
    for name, own in by_host.items():
        cells.append(F.lit(name))
        cells.append(
            F.array(
                *(
                    F.struct(
                        F.lit(len(name) + len(p)).alias("size"), F.lit(i).alias("place"), F.lit(p).alias("path"),
                        F.lit(name + p).alias("rule"), F.lit(v).alias("verdict"),
                    )
                    for i, (p, v) in enumerate(own)
                )
            ).cast(kind)
        )
    table = F.create_map(*cells)
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    candidates = F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.element_at(table, s), F.array().cast(kind))))
    return F.array_max(F.filter(candidates, lambda r: F.startswith(path, r["path"])))


def decoded(text: Column) -> Column:
    """Character references of an attribute: decimal, hexadecimal, and the five that markup needs."""
    digits = lambda m: F.when(F.regexp_like(m, F.lit("(?i)^&#x")), F.substring(m, F.lit(4), F.length(m) - 4)).otherwise(
        F.conv(F.substring(m, F.lit(3), F.length(m) - 3), 10, 16))
    character = lambda m: F.decode(F.unhex(F.lpad(digits(m), 8, "0")), "UTF-32")
    numbers = F.regexp_extract_all(text, F.lit(r"&#(?:[xX](?:10[0-9a-fA-F]{4}|[1-9a-cA-C][0-9a-fA-F]{0,3})|[1-9][0-9]{0,4});"), F.lit(0))
    text = F.aggregate(numbers, text, lambda t, m: F.replace(t, m, character(m)))
    for name, sign in (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def absolute(target: Column, url: Column) -> Column:
    """A reference as an absolute URL (RFC 3986, 5.2; dot segments go in ``node_of``); null for schemes without ``://``."""
    return bound(url, lambda u: bound(F.regexp_replace(target, r"(?s)#.*$", ""), lambda ref: _absolute(ref, u)))


def _absolute(ref: Column, url: Column) -> Column:
    scheme = F.substring(url, F.lit(1), F.instr(url, "://") - 1)
    root = F.concat(scheme, F.lit("://"), F.regexp_extract(after_scheme(url), r"(?s)^[^/?#]*", 0))
    folder = F.regexp_extract(path_of(url), r"(?s)^.*/", 0)
    return (
        F.when(F.regexp_like(ref, F.lit(SCHEME)), F.when(F.regexp_like(ref, F.lit(SCHEME + "//")), ref))
        .when(F.startswith(ref, F.lit("//")), F.concat(scheme, F.lit(":"), ref))
        .when(F.startswith(ref, F.lit("/")), F.concat(root, ref))
        .when(ref == "", F.concat(root, path_of(url), query_of(after_scheme(url))))
        .when(F.startswith(ref, F.lit("?")), F.concat(root, path_of(url), ref))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), ref))
    )


def any_group(text: Column, pattern: str) -> Column:
    """Whichever of a pattern's three alternative groups took part in its match."""
    return F.concat(*(F.regexp_extract(text, pattern, i) for i in (1, 2, 3)))


def link_tags(html: Column) -> Column:
    """The ``link``, ``meta`` and ``base`` tags of a page, in order; none from comments, scripts, styles or quoted values."""
    return F.filter(F.regexp_extract_all(html, F.lit(MARKUP), F.lit(1)), lambda t: F.endswith(t, F.lit(">")))


def named(tag: Column, name: str) -> Column:
    return F.regexp_like(tag, F.lit(rf"(?i)^<{name}[\t\n\f\r /]"))


def attribute(tag: Column, name: str) -> Column:
    """Value of the tag's first attribute of that name, references decoded; null where it has none."""
    own = F.filter(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)), lambda a: F.regexp_like(a, F.lit(rf"(?i)^{name}{SPACE}*=")))
    return bound(F.get(own, F.lit(0)), lambda a: decoded(any_group(a, VALUE)))


def words_of(value: Column) -> Column:
    return F.split(F.lower(value), rf"{SPACE}+", -1)


def clean_target(target: Column) -> Column:
    """A reference without the white space around it and the line breaks inside."""
    return F.regexp_replace(F.regexp_replace(target, rf"^{SPACE}+|{SPACE}+\z", ""), r"[\t\n\r]", "")


def stated_links(tags: Column) -> Column:
    """Struct (base, targets): href of the first ``base`` that has one, and the references of canonical and refresh tags."""
    based = F.get(F.filter(F.transform(F.filter(tags, lambda t: named(t, "base")), lambda t: attribute(t, "href")), lambda v: v.isNotNull()), F.lit(0))
    canonical = F.filter(tags, lambda t: named(t, "link") & F.array_contains(words_of(attribute(t, "rel")), "canonical"))
    refresh = F.filter(tags, lambda t: named(t, "meta") & F.array_contains(words_of(attribute(t, "http-equiv")), "refresh"))
    targets = F.concat(
        F.transform(canonical, lambda t: attribute(t, "href")), F.transform(refresh, lambda t: any_group(attribute(t, "content"), DELAYED))
    )
    return F.struct(clean_target(based).alias("base"), F.transform(targets, clean_target).alias("targets"))


def page_links(pages: DataFrame) -> DataFrame:
    """Alias edges (a, b) between nodes that the pages' own canonical and refresh tags state; targets are resolved
    against the page's first ``<base href>``, else against its URL. Of equal attributes of a tag the first holds, ``rel`` is a
    list of words, and an empty or missing target states nothing."""
    said = pages.where(F.regexp_like("html", F.lit(MAY_LINK))).select("url", bound(link_tags(F.col("html")), stated_links).alias("said"))
    base = F.coalesce(F.when(F.col("said.base") != "", absolute(F.col("said.base"), F.col("url"))), F.col("url"))
    links = said.select("url", base.alias("base"), F.explode("said.targets").alias("target")).where("target <> ''")
    return links.select(node_of(F.col("url")).alias("a"), bound(absolute(F.col("target"), F.col("base")), node_of).alias("b")).where("a is not null and b is not null")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for each page. ``redirects`` (from_url, to_url) adds edges."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    edges = page_links(pages)
    if redirects is not None:
        more = redirects.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b"))
        edges = edges.union(more.where("a is not null and b is not null"))
    parts = kept(components(edges, "url"), "url-components")
    # Decisions of all nodes that have an alias, pages or mere link targets: a node's host ends at its first / ? or #.
    own = fitting_rule(F.regexp_extract("vertex", r"(?s)^[^/?#]*", 0), F.regexp_extract("vertex", r"(?s)^[^/?#]*([^?#]*)", 1), rules)
    ruled = parts.withColumn("blocked", F.coalesce(own["verdict"] == "block", F.lit(False)))
    blocked = ruled.groupBy("component").agg(F.max("blocked").alias("blocked")).where("blocked").select("component")
    tainted = kept(parts.join(blocked, "component", "left_semi").select("vertex"), "url-tainted")
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), node_of(F.col("url")).alias("node"))
    rows = rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    joined = rows.join(tainted.withColumn("alias_blocked", F.lit(True)), rows.node == tainted.vertex, "left")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("alias_blocked"), F.lit("block")).otherwise(F.lit("allow")))
    return joined.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("*+", "*").replace("++", "+").replace("'", "''") + "'"


def _sql_group(text: str, pattern: str) -> str:
    return "(" + " || ".join(f"regexp_extract({text}, {_literal(pattern)}, {i})" for i in (1, 2, 3)) + ")"


def _sql_attribute(name: str) -> str:
    own = f"list_filter(regexp_extract_all(tag, {_literal(ATTRIBUTE)}), lambda a: regexp_matches(a, {_literal(rf'(?i)^{name}{SPACE}*=')}))[1]"
    return f"replace({_sql_group(own, VALUE)}, '&amp;', '&')"


def _sql_words(name: str) -> str:
    return f"string_split_regex(lower({_sql_attribute(name)}), {_literal(SPACE + '+')})"


SQL = rf"""
with cut as (
  select row_number() over () as n, page_id, url, html, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end as rest from pages
), pages2 as (
  select *, coalesce(translate(regexp_extract(rest, '(?s)^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') as path
  from cut
), rules(verdict, host, path) as (
  values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits as (
  select p.n, p.page_id, p.url, p.html, p.host, p.path, max_by(r.host || r.path, length(r.host || r.path)) as rule, max_by(r.verdict, length(r.host || r.path)) as verdict
  from pages2 p left join rules r on (p.host = r.host or p.host like '%.' || r.host) and starts_with(p.path, r.path)
  group by all
), nodes as (
  select *, case when contains(url, '://') then host || regexp_replace(substr(substr(url, strpos(url, '://') + 3), length(host) + 1), '(?s)#.*$', '') end as node from fits
), tags as (
  select node, unnest(regexp_extract_all(html, {_literal(MARKUP)}, 1)) as tag from nodes where regexp_matches(html, {_literal(MAY_LINK)})
), stated as (
  select node, {_sql_attribute('href')} as target from tags
  where regexp_matches(tag, '(?i)^<link[\t\n\f\r /]') and ends_with(tag, '>') and list_contains({_sql_words('rel')}, 'canonical')
  union all
  select node, {_sql_group(_sql_attribute('content'), DELAYED)} from tags
  where regexp_matches(tag, '(?i)^<meta[\t\n\f\r /]') and ends_with(tag, '>') and list_contains({_sql_words('http-equiv')}, 'refresh')
), links as (
  select node as a, translate(regexp_extract(target, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || regexp_replace(regexp_extract(target, '(?s)^.*?://[^/?#]*(.*)$', 1), '(?s)#.*$', '') as b
  from stated where contains(target, '://') and node is not null
), aliased as (
  with recursive reach(a, b) as (
    select a, a from links union select b, b from links union
    select r.a, e.b from reach r join (select a, b from links union all select b, a from links) e on e.a = r.b
  ) select a, b from reach
), tainted as (
  select distinct r.a from aliased r join (
    select n.b, max_by(u.verdict, length(u.host || u.path)) as verdict from (select distinct b from aliased) n
    join rules u on (regexp_extract(n.b, '(?s)^[^/?#]*') = u.host or regexp_extract(n.b, '(?s)^[^/?#]*') like '%.' || u.host)
      and starts_with(regexp_extract(n.b, '(?s)^[^/?#]*([^?#]*)', 1), u.path)
    group by n.b
  ) v on v.b = r.b where v.verdict = 'block'
)
select page_id, host, path, rule, coalesce(verdict, case when exists (select 1 from tainted t where t.a = n.node) then 'block' else 'allow' end) as verdict
from nodes n
"""
