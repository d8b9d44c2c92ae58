"""Queries for scalar functions, text and arrays, data quality, statistics and table changes."""

from __future__ import annotations

from datetime import date
from uuid import uuid4

from pyspark.sql import DataFrame, functions as F

from slotwise.constants import MONTH_LONG, WEEKDAYS
from slotwise.functions import dates, numbers as N, text as X
from slotwise.operators import commerce as C, mutate as M, people as P, quality as Q, stats as S, texts as TX
from slotwise.plans import roles as R
from slotwise.plans.registry import query, rounded, sql_mean_money, with_double, with_text
from slotwise.plans.relational import REPORT_SQL, paid

T = R.table


# ---------------------------------------------------------------- scalar functions
@query("fn_case", """select o_orderkey, case when o_totalprice > 300000 then 'high' when o_totalprice > 100000 and o_orderstatus = 'F' then 'closed' when o_totalprice > 100000 then 'mid' else 'low' end as band from orders""")
def _(s, sf):
    price, closed = F.col("o_totalprice"), F.col("o_orderstatus") == "F"
    band = F.when(price > 300000, "high").when((price > 100000) & closed, "closed").when(price > 100000, "mid").otherwise("low")
    return T(s, sf, "orders").select("o_orderkey", band.alias("band"))


@query("fn_np_where", R.PEOPLE + "select id, case when region_name = 'EUROPE' then 'Si' else 'No' end as european from employees")
def _(s, sf):
    return R.employees(s, sf).select("id", F.when(F.col("region_name") == "EUROPE", "Si").otherwise("No").alias("european"))


@query("fn_round", "select l_orderkey, l_linenumber, round(l_extendedprice, 0) as r0, round(l_extendedprice / 7, 1) as r1, round_even(l_extendedprice * l_tax * 10, 0)::double / 10 as even1 from lineitem")
def _(s, sf):
    price = F.col("l_extendedprice")
    return T(s, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", N.round_binary(price, 0).alias("r0"), N.round_binary(price / 7.0, 1).alias("r1"),
        N.round_even(price * F.col("l_tax"), 1).alias("even1"))


@query("fn_nullif_coalesce", "select l_orderkey, l_linenumber, round(coalesce(l_discount / nullif(l_tax, 0), -1), 6) as ratio from lineitem")
def _(s, sf):
    safe = F.coalesce(N.ratio(F.col("l_discount"), F.col("l_tax")), F.lit(-1.0))
    return rounded(T(s, sf, "lineitem").select("l_orderkey", "l_linenumber", safe.alias("ratio")), "ratio")


@query("fn_concat", R.PEOPLE + "select id, first_name || ' ' || last_name as full_name from employees")
def _(s, sf):
    return R.employees(s, sf).select("id", P.full_name(F.col("first_name"), F.col("last_name")).alias("full_name"))


@query("fn_replace_map", R.PEOPLE + "select id, gender_label, case when children = 1 then 'Si' when no_children = 1 then 'No' end as has_children from paid")
def _(s, sf):
    return R.employees(s, sf).select(
        "id", P.gender_label(F.col("gender")).alias("gender_label"),
        P.has_children(F.col("children"), F.col("no_children")).alias("has_children"))


@query("fn_clean_money", R.PEOPLE + "select id, salary from paid")
def _(s, sf):
    return paid(s, sf).select("id", "salary")


@query("fn_parse_percent", "select l_orderkey, l_linenumber, pct, replace(replace(pct, '%', ''), ',', '.')::double / 100.0::double as value from (select *, replace((l_discount * 100)::decimal(10,1)::varchar, '.', ',') || '%' as pct from lineitem)")
def _(s, sf):
    pct = F.concat(F.replace((F.col("l_discount") * 100).cast("decimal(10,1)").cast("string"), F.lit("."), F.lit(",")), F.lit("%"))
    return T(s, sf, "lineitem").select("l_orderkey", "l_linenumber", pct.alias("pct")).withColumn("value", N.parse_percent(F.col("pct")))


TXP = R.with_ctes(R.COMMERCE_SQL, R.TX_PRODUCTS_SQL)


@query("fn_trim_substring_index", TXP + """select id, trim(items[1]) as item1, trim(items[least(3, len(items))]) as item3
 from (select id, string_split(product_ids, ',') as items from txp)""")
def _(s, sf):
    ids = F.col("product_ids")
    return R.transactions_with_products(s, sf).select("id", X.nth_item(ids, 1).alias("item1"), X.nth_item(ids, 3).alias("item3"))


@query("fn_count_items", TXP + "select user_id, sum(len(string_split(product_ids, ',')))::bigint as n_items from txp group by 1")
def _(s, sf):
    n = X.count_items(F.col("product_ids"))
    return R.transactions_with_products(s, sf).groupBy("user_id").agg(F.sum(n).alias("n_items"))


@query("fn_date_parts", """select event_id, year(ts)::int as y, month(ts)::int as mo, day(ts)::int as d, isodow(ts)::int as dow, hour(ts)::int as h, minute(ts)::int as mi, second(ts)::int as s from events""")
def _(s, sf):
    ts = F.col("ts")
    return T(s, sf, "events").select(
        "event_id", F.year(ts).alias("y"), F.month(ts).alias("mo"), F.dayofmonth(ts).alias("d"),
        dates.iso_weekday(ts).alias("dow"), F.hour(ts).alias("h"), F.minute(ts).alias("mi"), F.second(ts).alias("s"))


@query("fn_date_time_of", "select event_id, ts::date::varchar as day, strftime(ts, '%H:%M:%S') as time from events")
def _(s, sf):
    ts = F.col("ts")
    return T(s, sf, "events").select("event_id", F.to_date(ts).cast("string").alias("day"), dates.time_of_day(ts).alias("time"))


BIRTH_SQL = "try_cast(printf('%04d-%02d-%02d', birth_year, birth_month, birth_day) as date)"


@query("fn_make_date", R.COMMERCE + f"select id, {BIRTH_SQL}::varchar as birth_date from users")
def _(s, sf):
    birth = dates.make_date_or_null(F.col("birth_year"), F.col("birth_month"), F.col("birth_day"))
    return R.users(s, sf).select("id", birth.cast("string").alias("birth_date"))


@query("fn_try_to_date", R.COMMERCE + f"select id, {BIRTH_SQL}::varchar as parsed from users")
def _(s, sf):
    raw = F.concat_ws("-", "birth_year", F.lpad(F.col("birth_month").cast("string"), 2, "0"), F.lpad(F.col("birth_day").cast("string"), 2, "0"))
    parsed = F.to_date(F.try_to_timestamp(raw, F.lit("yyyy-MM-dd")))
    return R.users(s, sf).select("id", parsed.cast("string").alias("parsed"))


@query("fn_age_exact", R.COMMERCE + f"select id, date_diff('year', b, date '2024-06-30') - (strftime(b, '%m%d') > '0630')::int as age from (select id, {BIRTH_SQL} as b from users) where b is not null")
def _(s, sf):
    return P.with_age(R.users(s, sf), R.AGE_REFERENCE).where(F.col("birth_date").isNotNull()).select("id", F.col("age").cast("bigint"))


@query("fn_age_approx", R.COMMERCE + f"select id, floor((date '2024-06-30' - b) / 365.25::double)::bigint as age from (select id, {BIRTH_SQL} as b from users) where b is not null")
def _(s, sf):
    people = P.with_age(R.users(s, sf), R.AGE_REFERENCE).where(F.col("birth_date").isNotNull())
    return people.select("id", dates.age_approx(F.col("birth_date"), R.AGE_REFERENCE).cast("bigint").alias("age"))


@query("fn_epoch_to_local", """select event_id, strftime(timestamp '1970-01-01' + to_seconds(epoch_us(ts) // 1000000 + 15552000) + interval 2 hour, '%Y-%m-%d %H:%M:%S') as summer,
 strftime(timestamp '1970-01-01' + to_seconds(epoch_us(ts) // 1000000) + interval 1 hour, '%Y-%m-%d %H:%M:%S') as winter from events""")
def _(s, sf):
    seconds = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000000")
    shown = lambda c: F.date_format(dates.epoch_to_local(c), "yyyy-MM-dd HH:mm:ss")
    return T(s, sf, "events").select("event_id", shown(seconds + 15552000).alias("summer"), shown(seconds).alias("winter"))


SEASON_SQL = "case when month({0}) in (12, 1, 2) then {1} when month({0}) in (3, 4, 5) then {2} when month({0}) in (6, 7, 8) then {3} else {4} end"


@query("fn_season", f"select o_orderkey, {SEASON_SQL.format('o_orderdate', 1, 2, 3, 4)} as season, " + SEASON_SQL.format("o_orderdate", "'Hivern'", "'Primavera'", "'Estiu'", "'Tardor'") + " as season_name from orders")
def _(s, sf):
    month = F.month("o_orderdate")
    return T(s, sf, "orders").select("o_orderkey", dates.season_number(month).alias("season"), dates.season_name(month).alias("season_name"))


@query("fn_week_of_month", "select o_orderkey, ceil(day(o_orderdate) / 7.0)::int as week from orders")
def _(s, sf):
    return T(s, sf, "orders").select("o_orderkey", dates.week_of_month(F.col("o_orderdate")).alias("week"))


@query("fn_half_hour", "select event_id, case when minute(ts) < 30 then 0 else 1 end as half from events")
def _(s, sf):
    return T(s, sf, "events").select("event_id", dates.half_hour(F.col("ts")).alias("half"))


@query("fn_period_key", "select o_orderkey, strftime(o_orderdate, '%Y-%m') as period, date_trunc('month', o_orderdate)::date::varchar as month_start from orders")
def _(s, sf):
    year, month = F.year("o_orderdate"), F.month("o_orderdate")
    return T(s, sf, "orders").select(
        "o_orderkey", dates.period_key(year, month).alias("period"), dates.first_of_month(year, month).cast("string").alias("month_start"))


def _case_sql(expression: str, names: dict) -> str:
    return f"case {expression} " + " ".join(f"when {k} then '{v}'" for k, v in names.items()) + " end"


@query("fn_name_lookup", f"select o_orderkey, {_case_sql('month(o_orderdate)', MONTH_LONG)} as month_name, {_case_sql('isodow(o_orderdate)', WEEKDAYS)} as day_name from orders")
def _(s, sf):
    return T(s, sf, "orders").select(
        "o_orderkey", dates.lookup(F.month("o_orderdate"), MONTH_LONG).alias("month_name"),
        dates.lookup(dates.iso_weekday(F.col("o_orderdate")), WEEKDAYS).alias("day_name"))


@query("fn_minmax_norm", """select c_custkey, round((c_acctbal - lo) / (hi - lo), 6) as norm, round(3 + 5 * sqrt((c_acctbal - lo) / (hi - lo)), 6) as radius
 from customer, (select min(c_acctbal) as lo, max(c_acctbal) as hi from customer)""")
def _(s, sf):
    customer = T(s, sf, "customer")
    low, high = customer.agg(F.min("c_acctbal")).scalar(), customer.agg(F.max("c_acctbal")).scalar()
    norm = N.minmax_norm(F.col("c_acctbal"), low, high)
    return rounded(customer.select("c_custkey", norm.alias("norm"), N.sqrt_radius(norm).alias("radius")), "norm", "radius")


@query("fn_dominant_problem", """with t as (select l_orderkey, l_linenumber, l_discount * 150 as e, l_tax * 150 as f, l_quantity / 2 as p from lineitem),
 u as (select *, least(p / 20, 1.0::double) as i, case when p < 2 then 'none' when e > f * 2 then 'empty' when f > e * 2 then 'full' else 'mixed' end as kind from t)
 select l_orderkey, l_linenumber, kind, round(i, 6) as intensity, case kind when 'none' then '#222222'
  when 'empty' then printf('#%02x%02x%02x', floor(230 + 25 * i)::int, floor(160 - 160 * i)::int, floor(160 - 160 * i)::int)
  when 'full' then printf('#%02x%02x%02x', floor(160 - 140 * i)::int, floor(160 - 140 * i)::int, floor(200 + 55 * i)::int)
  else printf('#%02x%02x%02x', floor(230 + 25 * i)::int, floor(220 - 20 * i)::int, floor(80 - 60 * i)::int) end as colour from u""")
def _(s, sf):
    d = N.dominant_problem(F.col("l_discount") * 150.0, F.col("l_tax") * 150.0, F.col("l_quantity") / 2.0)
    rows = T(s, sf, "lineitem").select("l_orderkey", "l_linenumber", d.alias("d")).select("l_orderkey", "l_linenumber", "d.*")
    return rounded(rows, "intensity")


@query("fn_join_list", "select event_id, case when event_id % 3 = 0 then null else array_to_string(['a' || (event_id % 5), event_type], ', ') end as authors from events")
def _(s, sf):
    pair = F.array(F.concat(F.lit("a"), F.pmod(F.col("event_id"), F.lit(5)).cast("string")), F.col("event_type"))
    listed = F.when(F.pmod(F.col("event_id"), F.lit(3)) == 0, F.array().cast("array<string>")).otherwise(pair)
    return T(s, sf, "events").select("event_id", X.join_or_null(listed).alias("authors"))


@query("fn_band", """with t as (select l_orderkey, l_linenumber, l_quantity * 7 as w, 1.0::double + l_discount * 8 as h from lineitem),
 u as (select *, case when w between 20 and 300 and h between 0.5 and 2.5 then round_even(w / (h * h) * 100, 0)::double / 100 end as bmi from t)
 select l_orderkey, l_linenumber, bmi, case when bmi is null then null when bmi < 18.5 then 'Bajo peso' when bmi <= 24.9 then 'Peso normal' when bmi <= 29.9 then 'Sobrepeso' else 'Obesidad' end as band from u""")
def _(s, sf):
    index = N.bmi(F.col("l_quantity") * 7.0, 1.0 + F.col("l_discount") * 8.0)
    return T(s, sf, "lineitem").select("l_orderkey", "l_linenumber", index.alias("bmi")).withColumn("band", N.bmi_band(F.col("bmi")))


@query("fn_temperature", """with t as (select event_id, floor(value)::double / 4 as v, (['C','f','K','ra','Re','X'])[1 + event_id % 6] as u from events),
 c as (select *, round_even(10 * case lower(u) when 'c' then v when 'f' then (v - 32) * 5 / 9 when 'k' then v - 273.15::double when 'ra' then v * 5 / 9 - 273.15::double when 're' then v * 5 / 4 end, 0)::double / 10 as c from t)
 select event_id, c as "C", round_even(10 * (c * 9 / 5 + 32), 0)::double / 10 as "F", round_even(10 * (c + 273.15::double), 0)::double / 10 as "K",
  round_even(10 * ((c + 273.15::double) * 9 / 5), 0)::double / 10 as "Ra", round_even(10 * (c * 4 / 5), 0)::double / 10 as "Re" from c""")
def _(s, sf):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("C", "f", "K", "ra", "Re", "X")]), (1 + F.pmod(F.col("event_id"), F.lit(6))).cast("int"))
    value = F.replace((F.floor("value") / 4).cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(","))
    rows = T(s, sf, "events").select("event_id", N.temperatures(F.concat(value, F.lit(" "), unit)).alias("t"))
    return rows.select("event_id", *[F.col(f"t.{u}").alias(u) for u in ("C", "F", "K", "Ra", "Re")])


@query("fn_json_props", "select event_id, (props::json->>'k')::int as k, props::json->>'missing' as missing from events")
def _(s, sf):
    parsed = F.from_json("props", "k int, missing string")
    return T(s, sf, "events").select("event_id", parsed.alias("p")).select("event_id", "p.k", "p.missing")


# ---------------------------------------------------------------- text, arrays, reshape
WORDS_SQL = "with w as (select doc_id, unnest(string_split_regex(lower(text), '[^a-záéíóúüñ]+')) as word from documents) "


@query("txt_word_count", WORDS_SQL + "select word, count(*) as n from w where word != '' group by 1")
def _(s, sf):
    return TX.word_counts(T(s, sf, "documents"), "text")


@query("txt_mean_word_len", WORDS_SQL + """select d.doc_id, round(coalesce(m, 0), 6) as mean_len from documents d
 left join (select doc_id, sum(length(word))::double / count(*) as m from w where word != '' group by 1) w on w.doc_id = d.doc_id""")
def _(s, sf):
    return rounded(T(s, sf, "documents").select("doc_id", X.mean_word_length(F.col("text")).alias("mean_len")), "mean_len")


@query("txt_index_by_initial", WORDS_SQL + "select word[1] as initial, word, count(*) as n from w where word != '' group by all")
def _(s, sf):
    return TX.index_by_initial(T(s, sf, "documents"), "text")


BRIDGE = TXP + ", items as (select distinct id, trim(unnest(string_split(product_ids, ','))) as item from txp) "


@query("arr_split_explode", BRIDGE + "select id as transaction_id, item from items")
def _(s, sf):
    items = X.list_items(F.col("product_ids"), ",")
    return R.transactions_with_products(s, sf).select(F.col("id").alias("transaction_id"), F.explode(items).alias("item"))


@query("arr_bridge_table", BRIDGE + "select items.id as transaction_id, item as product_id from items join products p on p.id::varchar = item")
def _(s, sf):
    return C.product_bridge(R.transactions_with_products(s, sf), R.products(s, sf))


@query("arr_flatten_one", "select event_id, unnest(flatten([[event_type, (event_id % 7)::varchar], [], [user_id::varchar]])) as item from events")
def _(s, sf):
    text = lambda c: c.cast("string")
    nested = F.array(F.array(F.col("event_type"), text(F.pmod(F.col("event_id"), F.lit(7)))), F.array().cast("array<string>"), F.array(text(F.col("user_id"))))
    return T(s, sf, "events").select("event_id", F.explode(F.flatten(nested)).alias("item"))


@query("arr_try_float", """select event_id, item, try_cast(replace(item, '_', '') as double) as number from (
 select event_id, unnest(['1.3', event_type, floor(value)::bigint || 'e2', (event_id % 9) || '_0', '-' || (event_id % 4) || '.5', (event_id % 5) || '-1/2']) as item from events)""")
def _(s, sf):
    text = lambda c: c.cast("string")
    mod = lambda n: text(F.pmod(F.col("event_id"), F.lit(n)))
    items = F.array(
        F.lit("1.3"), F.col("event_type"), F.concat(text(F.floor("value")), F.lit("e2")), F.concat(mod(9), F.lit("_0")),
        F.concat(F.lit("-"), mod(4), F.lit(".5")), F.concat(mod(5), F.lit("-1/2")))
    rows = T(s, sf, "events").select("event_id", items.alias("items"))
    return TX.split_convertible(rows, "items").select("event_id", "item", "number")


@query("rsh_pivot", """select hour(ts)::int as hour, """ + ", ".join(f'count(*) filter (where isodow(ts) = {i}) as "{n}"' for i, n in WEEKDAYS.items()) + " from events group by 1")
def _(s, sf):
    rows = T(s, sf, "events").select(F.hour("ts").alias("hour"), dates.lookup(dates.iso_weekday(F.col("ts")), WEEKDAYS).alias("day"))
    return rows.groupBy("hour").pivot("day", list(WEEKDAYS.values())).count().na.fill(0)


# Match lines: supplier nation against customer nation per line item; every fifth line is malformed.
MATCH_SQL = """with m as (select sn.n_name as home, cn.n_name as away, (7 * l_partkey + 3 * l_linenumber) % 6 as hg, (5 * l_partkey + 2 * l_orderkey) % 5 as ag
 from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation cn on c_nationkey = cn.n_nationkey
 join supplier on l_suppkey = s_suppkey join nation sn on s_nationkey = sn.n_nationkey where l_orderkey % 5 != 0),
 r as (select home as team, hg as gf, ag as ga from m union all select away, ag, hg from m)
"""


def match_lines(s, sf) -> DataFrame:
    nation = T(s, sf, "nation").select("n_nationkey", "n_name")
    supplier = T(s, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("home"))
    customer = T(s, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("away"))
    rows = (
        T(s, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(T(s, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
    )
    goals = F.concat_ws(
        "-", F.pmod(7 * F.col("l_partkey") + 3 * F.col("l_linenumber"), F.lit(6)), F.pmod(5 * F.col("l_partkey") + 2 * F.col("l_orderkey"), F.lit(5)))
    good = F.concat_ws("\t", "home", goals, "away")
    return rows.select(F.when(F.pmod(F.col("l_orderkey"), F.lit(5)) == 0, F.concat_ws(" ", "home", goals)).otherwise(good).alias("value"))


@query("rsh_two_rows_per_match", MATCH_SQL + "select team, gf::bigint as gf, ga::bigint as ga, count(*) as n from r group by all")
def _(s, sf):
    return TX.team_rows(TX.parse_matches(match_lines(s, sf))).groupBy("team", "gf", "ga").agg(F.count(F.lit(1)).alias("n"))


@query("rsh_league_table", MATCH_SQL + """select team, count(*) filter (where gf > ga) as won, count(*) filter (where gf = ga) as drawn, count(*) filter (where gf < ga) as lost,
 sum(gf)::bigint as gf, sum(ga)::bigint as ga, 3 * count(*) filter (where gf > ga) + count(*) filter (where gf = ga) as points from r group by 1""")
def _(s, sf):
    return TX.league_table(TX.parse_matches(match_lines(s, sf)))


@query("rsh_league_leaders", MATCH_SQL + ", t as (select team, sum(gf) as gf, sum(ga) as ga from r group by 1) select arg_min(team, (-gf, team)) as top_scorer, arg_min(team, (-ga, team)) as most_scored_against from t")
def _(s, sf):
    return TX.league_leaders(TX.parse_matches(match_lines(s, sf)))


# ---------------------------------------------------------------- data quality
@query("dq_is_unique", "select count(*) as n_rows, count(distinct l_orderkey) as n_keys, count(*) = count(distinct l_orderkey) as is_unique from lineitem")
def _(s, sf):
    return Q.uniqueness(T(s, sf, "lineitem"), "l_orderkey")


@query("dq_drop_duplicates", "select l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey)) as l_partkey from lineitem group by 1")
def _(s, sf):
    return Q.first_per_key(T(s, sf, "lineitem"), ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]).select("l_orderkey", "l_partkey")


NULLED_SQL = """with t as (select l_orderkey, l_linenumber, nullif(l_discount, 0.0) as a, nullif(l_tax, 0.0) as b,
 case when l_quantity > 10 then l_quantity end as c, case when l_returnflag != 'N' then l_extendedprice end as d from lineitem) """
ABCD = ["a", "b", "c", "d"]


def nulled(s, sf) -> DataFrame:
    zero = F.lit(0.0)
    return T(s, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.nullif("l_discount", zero).alias("a"), F.nullif("l_tax", zero).alias("b"),
        F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("c"),
        F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice")).alias("d"))


NULLS = " + ".join(f"({c} is null)::int" for c in ABCD)


@query("dq_null_profile", NULLED_SQL + "select 'rows' as what, ('r' || (" + NULLS + ")) as item, count(*) as n from t group by all union all "
       + " union all ".join(f"select 'column', '{c}', count(*) filter (where {c} is null) from t" for c in ABCD))
def _(s, sf):
    rows = nulled(s, sf)
    per_row = Q.nulls_per_row(rows, ABCD).select(F.lit("rows").alias("what"), F.concat(F.lit("r"), F.col("n_nulls").cast("string")).alias("item"), F.col("n_rows").alias("n"))
    per_column = Q.nulls_per_column(rows, ABCD).select(F.lit("column").alias("what"), F.col("column").alias("item"), F.col("n_nulls").alias("n"))
    return per_row.unionByName(per_column)


@query("dq_drop_sparse_rows", NULLED_SQL + f"select l_orderkey, l_linenumber, a, b from t where {NULLS} <= 1")
def _(s, sf):
    return Q.drop_sparse(nulled(s, sf), ABCD, 1).select("l_orderkey", "l_linenumber", "a", "b")


@query("dq_impute_median", NULLED_SQL + f", k as (select * from t where {NULLS} <= 2) select l_orderkey, l_linenumber, "
       + ", ".join(f"round(coalesce({c}, (select median({c}) from k)), 6) as {c}" for c in ABCD) + " from k")
def _(s, sf):
    return rounded(Q.impute_median(Q.drop_sparse(nulled(s, sf), ABCD, 2), ABCD), *ABCD)


@query("dq_fk_orphans", "select o_orderkey, o_custkey from orders o where o_custkey is not null and not exists (select 1 from supplier where s_suppkey = o.o_custkey)")
def _(s, sf):
    return Q.orphans(T(s, sf, "orders"), "o_custkey", T(s, sf, "supplier"), "s_suppkey").select("o_orderkey", "o_custkey")


@query("dq_pk_check", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def _(s, sf):
    return Q.repeated_keys(T(s, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


# ---------------------------------------------------------------- statistics
LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount"]


@query("st_describe", " union all ".join(f"""select '{c}' as "column", count({c}) as n, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as sd, min({c}) as min, max({c}) as max,
 round(quantile_cont({c}, 0.25), 4) as q1, round(median({c}), 4) as median, round(quantile_cont({c}, 0.75), 4) as q3 from lineitem""" for c in LINE_COLUMNS))
def _(s, sf):
    return rounded(S.describe(T(s, sf, "lineitem"), LINE_COLUMNS), "mean", "sd", "q1", "median", "q3", digits=4)


@query("st_histogram", """with b as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders),
 h as (select least(floor((o_totalprice - lo) / ((hi - lo) / 40)), 39)::int as bin, count(*) as n from orders, b group by 1)
 select i::int as bin, round(lo + i * ((hi - lo) / 40), 4) as left_edge, coalesce(n, 0) as n from b, range(40) r(i) left join h on h.bin = i""")
def _(s, sf):
    return rounded(S.histogram(T(s, sf, "orders"), "o_totalprice", 40), "left_edge", digits=4)


@query("st_kde", """with b as (select stddev_samp(c_acctbal) * pow(count(*), -0.2) as h, min(c_acctbal) as lo, max(c_acctbal) as hi, count(*) as n from customer),
 g as (select i::int as i, lo - 3 * h + i * ((hi - lo + 6 * h) / 49) as x, h, n from b, range(50) r(i))
 select i, round(x, 3) as x, round(sum(exp(-0.5 * pow((x - c_acctbal) / h, 2))) / (n * h * sqrt(2 * pi())) * 1e6, 4) as density from g, customer group by i, x, h, n""")
def _(s, sf):
    rows = S.density(T(s, sf, "customer"), "c_acctbal", points=50)
    return rounded(rounded(rows.withColumn("density", F.col("density") * 1e6), "density", digits=4), "x", digits=3)


@query("st_box", """with top as (select o_orderpriority as p from orders group by 1 order by count(*) desc, 1 limit 3),
 q as (select o_orderpriority as p, quantile_cont(o_totalprice, 0.25) as q1, median(o_totalprice) as med, quantile_cont(o_totalprice, 0.75) as q3 from orders where o_orderpriority in (select p from top) group by 1)
 select o_orderpriority, round(q1, 4) as q1, round(med, 4) as median, round(q3, 4) as q3,
  min(o_totalprice) filter (where o_totalprice between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as low_whisker,
  max(o_totalprice) filter (where o_totalprice between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as high_whisker,
  count(*) filter (where o_totalprice not between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as n_outliers, count(*) as n
 from orders join q on q.p = o_orderpriority group by 1, q1, med, q3""")
def _(s, sf):
    return rounded(S.box_stats(T(s, sf, "orders"), "o_orderpriority", "o_totalprice", 3), "q1", "median", "q3", digits=4)


@query("st_outliers", """with q as (select o_custkey as c, quantile_cont(o_totalprice, 0.25) as q1, quantile_cont(o_totalprice, 0.75) as q3 from orders group by 1)
 select o_orderkey, o_custkey from orders join q on c = o_custkey where o_totalprice not between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)""")
def _(s, sf):
    return S.outliers(T(s, sf, "orders"), "o_custkey", "o_totalprice").select("o_orderkey", "o_custkey")


@query("st_corr_matrix", " union all ".join(f"select '{a}' as x, '{b}' as y, round(corr({a}, {b}), 6) as r from lineitem" for a in LINE_COLUMNS for b in LINE_COLUMNS))
def _(s, sf):
    return rounded(S.correlations(T(s, sf, "lineitem"), LINE_COLUMNS), "r")


@query("st_pair_reg", "select round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept, round(corr(l_extendedprice, l_quantity), 6) as r, count(*) as n from lineitem")
def _(s, sf):
    line = S.regression(T(s, sf, "lineitem"), "l_extendedprice", "l_quantity")
    return rounded(rounded(rounded(line, "slope", digits=4), "intercept", digits=3), "r")


@query("st_scatter_sample", R.COMMERCE + "select lat, amount::double as amount, declined from tx where lat is not null and amount is not null")
def _(s, sf):
    """All complete points with their hue."""
    return with_double(S.scatter_points(R.transactions(s, sf), "lat", "amount", "declined"), "amount")


@query("st_cat_codes", R.COMMERCE + "select id, country, (dense_rank() over (order by country) - 1)::int as code from company")
def _(s, sf):
    return S.category_codes(R.company(s, sf), "country", "code").select("id", "country", "code")


@query("st_auto_profile", """with b as (select min(o_totalprice) as lo, max(o_totalprice) as hi, min(o_custkey)::double as clo, max(o_custkey)::double as chi from orders),
 h as (select 'o_totalprice' as "column", least(floor((o_totalprice - lo) / ((hi - lo) / 10)), 9)::int as bin from orders, b
   union all select 'o_custkey', least(floor((o_custkey - clo) / ((chi - clo) / 10)), 9)::int from orders, b)
 select c as "column", 'histogram' as kind, i::varchar as bucket, count(bin) as n from (select unnest(['o_totalprice', 'o_custkey']) as c) cross join range(10) r(i) left join h on h."column" = c and h.bin = i group by all
 union all select 'o_orderdate', 'years', year(o_orderdate)::varchar, count(*) from orders group by all
 union all select 'o_orderpriority', 'values', o_orderpriority, count(*) from orders group by all""")
def _(s, sf):
    return S.auto_profile(T(s, sf, "orders").select("o_totalprice", "o_custkey", "o_orderdate", "o_orderpriority"))


@query("st_class_distribution", "select o_orderstatus, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 6) as pct from orders group by 1")
def _(s, sf):
    return rounded(S.class_distribution(T(s, sf, "orders"), "o_orderstatus"), "pct")


# ---------------------------------------------------------------- table changes
@query("mut_update", R.COMMERCE + "select id, case when id = 29 then 'TR000' else iban end as iban from cards")
def _(s, sf):
    return M.update(R.cards(s, sf), F.col("id") == 29, iban="TR000").select("id", "iban")


@query("mut_insert", R.COMMERCE + "select id, company_name, country from company union all select 999999999, null, null")
def _(s, sf):
    new = s.createDataFrame([(999999999,)], "id bigint")
    return M.insert(R.company(s, sf).select("id", "company_name", "country"), new)


@query("mut_insert_if_missing", "select c_custkey as id, c_name as name from customer union all select distinct o_orderkey, null from orders where o_orderkey not in (select c_custkey from customer)")
def _(s, sf):
    parents = T(s, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return M.insert_missing(parents, T(s, sf, "orders").select(F.col("o_orderkey").alias("id")), "id")


@query("mut_delete", R.COMMERCE + "select id from tx where id != 447")
def _(s, sf):
    return M.delete(R.transactions(s, sf), F.col("id") == 447).select("id")


@query("mut_drop_column", R.COMMERCE + "select id, iban, cvv, expiring_date from cards")
def _(s, sf):
    return M.drop_columns(R.cards(s, sf), "pan")


@query("mut_add_column", R.COMMERCE + "select id, iban, cast(null as varchar) as added from cards")
def _(s, sf):
    return with_text(M.add_column(R.cards(s, sf), "added", "date"), "added").select("id", "iban", "added")


@query("mut_rename_column", R.COMMERCE + "select id, company_name, phone, country, website as personal_site from company")
def _(s, sf):
    return M.rename_column(R.company(s, sf), "website", "personal_site")


@query("mut_cast_column", R.COMMERCE + "select id::varchar as id, cvv::int as cvv from cards")
def _(s, sf):
    return M.cast_columns(R.cards(s, sf), {"id": "string", "cvv": "int"}).select("id", "cvv")


@query("view_marketing", R.COMMERCE + f"select company_name, phone, country, {sql_mean_money()} as average_purchases from tx join company c on tx.company_id = c.id where declined = 0 group by all")
def _(s, sf):
    C.marketing_view(R.transactions(s, sf), R.company(s, sf)).createOrReplaceTempView(name := f"marketing_view_{uuid4().hex[:12]}")
    return with_double(s.table(name), "average_purchases")


@query("view_report", REPORT_SQL)
def _(s, sf):
    """All columns of the technical report, read from a view."""
    name = f"technical_report_{uuid4().hex[:12]}"
    C.technical_report(R.transactions(s, sf), R.company(s, sf), R.users(s, sf), R.cards(s, sf)).createOrReplaceTempView(name)
    return with_text(with_double(s.table(name), "amount"), "transaction_date")


CARDS_SQL = R.COMMERCE + """select card_id, case when count(*) = 3 and min(declined) = 1 then 'inactive' else 'active' end as status from
 (select *, row_number() over (partition by card_id order by ts desc, id desc) as rn from tx) where rn <= 3 group by 1"""


@query("tbl_card_status", CARDS_SQL)
def _(s, sf):
    return C.card_status(R.transactions(s, sf))


@query("tbl_product_sales", BRIDGE + """select item as product_id, count(*) as quantity from items join products p on p.id::varchar = item
 join tx on tx.id = items.id where declined = 0 group by 1""")
def _(s, sf):
    tx = R.transactions_with_products(s, sf)
    return C.product_sales(C.product_bridge(tx, R.products(s, sf)), tx)
