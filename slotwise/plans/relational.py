"""Queries over transactions, companies, users and cards: projection, filters, joins, aggregates, sets."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window, functions as F

from slotwise.constants import VOLUME_LABELS
from slotwise.functions import dates
from slotwise.functions.numbers import mean_money, round_even
from slotwise.functions.text import all_digits
from slotwise.operators import commerce as C, grouping as G, people as P, quality as Q, timeseries as TS
from slotwise.operators.mutate import reorder_first
from slotwise.operators.quantiles import exact_quantiles
from slotwise.operators.routes import exclude_places
from slotwise.plans import roles as R
from slotwise.plans.registry import query, rounded, sql_mean_money, with_double, with_text

TX, CO = R.transactions, R.company
DAYS = [date(1995, 4, 29), date(1998, 7, 20), date(1997, 3, 13)]
DAYS_SQL = ", ".join(f"date '{d}'" for d in DAYS)


def sql(body: str) -> str:
    return R.COMMERCE + body


# ---------------------------------------------------------------- projection and filters
@query("sel_alias", sql("select company_name as name, country as land from company"))
def _(s, sf):
    return CO(s, sf).select(F.col("company_name").alias("name"), F.col("country").alias("land"))


@query("sel_star_except", sql("select * exclude (phone, website) from company"))
def _(s, sf):
    return CO(s, sf).drop("phone", "website")


@query("sel_lateral_alias", sql("select id, amount::double as amount, (amount > 250000) as big, not (amount > 250000) and declined = 0 as small_ok from tx"))
def _(s, sf):
    return TX(s, sf).selectExpr("id", "double(amount) as amount", "amount > 250000 as big", "not big and declined = 0 as small_ok")


@query("sel_reorder_cols", sql("select country, id, company_name, phone, website from company"))
def _(s, sf):
    return reorder_first(CO(s, sf), ["country"])


@query("flt_eq_bool", sql("select id, company_id from tx where declined = 0"))
def _(s, sf):
    return C.accepted(TX(s, sf)).select("id", "company_id")


@query("flt_between", sql("select id, amount::double as amount, ts::date::varchar as day from tx where amount between 350000 and 400000 and ts::date between date '1996-01-01' and date '1997-12-31'"))
def _(s, sf):
    tx = TX(s, sf).where(F.col("amount").between(350000, 400000))
    kept = tx.where(F.to_date("timestamp").between(date(1996, 1, 1), date(1997, 12, 31)))
    return kept.select("id", F.col("amount").cast("double"), F.to_date("timestamp").cast("string").alias("day"))


@query("flt_date_in", sql(f"select id, ts::date::varchar as day from tx where ts::date in ({DAYS_SQL})"))
def _(s, sf):
    kept = TX(s, sf).where(F.to_date("timestamp").isin(DAYS))
    return kept.select("id", F.to_date("timestamp").cast("string").alias("day"))


@query("flt_isin_notin", "select o_orderkey, o_orderpriority, o_orderstatus from orders where o_orderstatus in ('F','O') and o_orderpriority not in ('1-URGENT','2-HIGH')")
def _(s, sf):
    kept = R.table(s, sf, "orders").where(
        F.col("o_orderstatus").isin("F", "O") & ~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    )
    return kept.select("o_orderkey", "o_orderpriority", "o_orderstatus")


# Every third value is given a sign, a line break or a blank, which must not pass.
DIRTY_SQL = """with t as (select event_id, case event_id % 4 when 0 then floor(value)::bigint::varchar
  when 1 then floor(value)::bigint::varchar || chr(13) when 2 then '-' || floor(value)::bigint when 3 then floor(value)::bigint::varchar || 'x' end as v from events)
"""


def _dirty(s, sf):
    number = F.floor("value").cast("string")
    kind = F.pmod(F.col("event_id"), F.lit(4))
    return R.table(s, sf, "events").select(
        "event_id",
        F.when(kind == 0, number).when(kind == 1, F.concat(number, F.lit("\r")))
        .when(kind == 2, F.concat(F.lit("-"), number)).otherwise(F.concat(number, F.lit("x"))).alias("v"),
    )


@query("flt_regex_full", DIRTY_SQL + "select event_id, v from t where regexp_full_match(v, '[0-9]+')")
def _(s, sf):
    return _dirty(s, sf).where(all_digits(F.col("v")))


@query("flt_epoch_sane", """select event_id, (epoch_us(ts) // 1000000 * (event_id % 3))::bigint as seconds from events
 where (epoch_us(ts) // 1000000 * (event_id % 3)) between 946684800 and 2145916800""")
def _(s, sf):
    events = R.table(s, sf, "events")
    seconds = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000000 * (event_id % 3)")
    rows = events.select("event_id", seconds.cast("string").alias("t"))
    return rows.where(F.col("t").try_cast("bigint").between(946684800, 2145916800)).select(
        "event_id", F.col("t").cast("bigint").alias("seconds"))


@query("flt_null", R.PEOPLE + "select id, salary from paid where salary is not null and gender_label is not null")
def _(s, sf):
    return paid(s, sf).na.drop(subset=["salary", "gender_label"]).select("id", "salary")


@query("flt_format_upper", "select doc_id, lang, source from documents where upper(lang) in ('EN', 'ES')")
def _(s, sf):
    return R.table(s, sf, "documents").where(F.upper("lang").isin("EN", "ES")).select("doc_id", "lang", "source")


FLOWS_SQL = """with edges as (select l_returnflag as matrix, sn.n_name as src, cn.n_name as dst,
   (sum((l_extendedprice * 100)::bigint)::double / 100 / count(*)) as km
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  join nation cn on c_nationkey = cn.n_nationkey join supplier on l_suppkey = s_suppkey
  join nation sn on s_nationkey = sn.n_nationkey group by all)
"""


def flow_edges(s, sf) -> DataFrame:
    """Distance matrices between nations (mean price of their deliveries), one per return flag."""
    t = lambda name: R.table(s, sf, name)
    nation = t("nation").select("n_nationkey", "n_name")
    customer = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("dst"))
    supplier = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("src"))
    orders = t("orders").select("o_orderkey", "o_custkey")
    lines = t("lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_extendedprice")
    joined = (
        lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
    )
    price = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))
    return joined.groupBy(F.col("l_returnflag").alias("matrix"), "src", "dst").agg(price.alias("km"))


@query("flt_exclude_keys", FLOWS_SQL + "select matrix, src, dst, round(km, 4) as km from edges where src not in ('NATION_3','NATION_7') and dst not in ('NATION_3','NATION_7')")
def _(s, sf):
    return rounded(exclude_places(flow_edges(s, sf), ["NATION_3", "NATION_7"]), "km", digits=4)


# ---------------------------------------------------------------- joins
@query("join_inner_equi", sql("select tx.id, company_name from tx join company c on c.id = tx.company_id where declined = 0"))
def _(s, sf):
    return C.sales_with_company(TX(s, sf), CO(s, sf)).select("id", "company_name")


STAR_SQL = """select tx.id, u.name as user_name, iban, company_name, amount::double as amount
 from tx join company c on c.id = tx.company_id join users u on u.id = tx.user_id join cards k on k.id = tx.card_id"""


@query("join_multiway_star", sql(STAR_SQL))
def _(s, sf):
    report = C.technical_report(TX(s, sf), CO(s, sf), R.users(s, sf), R.cards(s, sf))
    return report.select(
        F.col("transaction_id").alias("id"), "user_name", F.col("card_iban").alias("iban"), "company_name",
        F.col("amount").cast("double"))


@query("join_extra_on_pred", sql("select tx.id, company_name from tx join company c on c.id = tx.company_id and c.country = 'NATION_4'"))
def _(s, sf):
    co = CO(s, sf).where(F.col("country") == "NATION_4").withColumnRenamed("id", "company_id")
    return TX(s, sf).join(co, "company_id").select("id", "company_name")


@query("join_implicit_comma", sql("select u.id, u.surname, n from users u, (select user_id, count(*) as n from tx group by user_id) t where t.user_id = u.id"))
def _(s, sf):
    counts = TX(s, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    users = R.users(s, sf)
    return users.join(counts, users["id"] == counts["user_id"]).select("id", "surname", "n")


INCREMENTS = [("Grup A", "5%"), ("Grup B", "3,5%"), ("Grup C", "2%"), ("Grup D", "8%")]
INCREMENTS_SQL = "(values " + ", ".join(f"('{g}', '{i}')" for g, i in INCREMENTS) + ") as i(group_name, increment)"


def increments(s):
    return s.createDataFrame(INCREMENTS, "group_name string, increment string")


@query("join_left_lookup", R.PEOPLE + f"select id, e.group_name, increment from employees e left join {INCREMENTS_SQL} on i.group_name = e.group_name")
def _(s, sf):
    return R.employees(s, sf).join(increments(s), "group_name", "left").select("id", "group_name", "increment")


@query("join_left_multi_key", R.GRID + """select c.station_id, c.day::varchar as day, c.hour::int as hour, c.half, h.min_bikes is not null as measured
 from (select station_id, day, hour, half from stations cross join calendar) c left join slots h
 on h.station_id = c.station_id and h.day = c.day and h.hour = c.hour and h.half = c.half""")
def _(s, sf):
    rows = R.located(s, sf)
    frame = TS.with_slots(R.stations(s, sf).select("station_id"), *R.bounds(s, sf))
    joined = frame.join(TS.half_hour_slots(rows), TS.SLOT, "left")
    return joined.select("station_id", F.col("day").cast("string"), "hour", "half", F.col("min_bikes").isNotNull().alias("measured"))


@query("join_left_computed_key", sql("""select tx.id, m.n::double as n from tx left join (
   select company_id, month(ts) as mo, ceil(day(ts) / 7.0)::int as wk, count(*) as n from tx where declined = 1 group by all) m
 on m.company_id = tx.company_id and m.mo = month(tx.ts) and m.wk = ceil(day(tx.ts) / 7.0)::int where m.n is not null or tx.declined = 0"""))
def _(s, sf):
    keyed = TX(s, sf).withColumns({"mo": F.month("timestamp"), "wk": dates.week_of_month(F.col("timestamp"))})
    keys = ["company_id", "mo", "wk"]
    declined = keyed.where(F.col("declined") == 1).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    joined = keyed.join(declined, keys, "left")
    kept = joined.where(F.col("n").isNotNull() | (F.col("declined") == 0))
    return with_double(kept.select("id", "n"), "n")


@query("join_semi_exists", sql("select id, amount::double as amount from tx where exists (select 1 from company c where c.id = tx.company_id and c.country = 'NATION_7') and declined = 0"))
def _(s, sf):
    return tx_of_country(s, sf, "NATION_7")


def tx_of_country(s, sf, country):
    home = CO(s, sf).where(F.col("country") == country)
    tx = C.accepted(TX(s, sf))
    return tx.join(home, tx["company_id"] == home["id"], "left_semi").select("id", F.col("amount").cast("double"))


# Companies none of whose transactions was of the highest amounts, over all transactions.
LARGE = 500_000


def _large(s, sf):
    return TX(s, sf).where(F.col("amount") >= LARGE)


NO_TX_SQL = sql(f"select company_name from company c where not exists (select 1 from tx where tx.company_id = c.id and amount >= {LARGE})")


@query("join_anti_not_exists", NO_TX_SQL)
def _(s, sf):
    return C.companies_without_transactions(_large(s, sf), CO(s, sf))


@query("join_anti_literal", sql("select company_name from company c where not exists (select distinct company_id from tx)"))
def _(s, sf):
    return C.companies_without_transactions(TX(s, sf), CO(s, sf), literal=True)


NAMED = "Customer#000000007"
SAME_COUNTRY_SQL = sql(f"""select tx.id, amount::double as amount from tx join company c on c.id = tx.company_id
 where declined = 0 and country = (select country from company where company_name = '{NAMED}')""")


@query("join_scalar_subquery", SAME_COUNTRY_SQL)
def _(s, sf):
    same = CO(s, sf).where(F.col("country") == C.country_of(CO(s, sf), NAMED)).select(F.col("id").alias("company_id"))
    return C.accepted(TX(s, sf)).join(same, "company_id").select("id", F.col("amount").cast("double"))


ABOVE_SQL = sql("""select distinct company_name from company c where exists (select 1 from tx where tx.company_id = c.id and declined = 0
 and amount > (select (2 * sum((amount * 100)::bigint) + count(*)) // (2 * count(*)) / 100.0 from tx where declined = 0))""")


@query("join_nested_exists_scalar", ABOVE_SQL)
def _(s, sf):
    return C.companies_with_sale_above_mean(TX(s, sf), CO(s, sf))


@query("join_key_overlap", "select c_custkey as id from customer join supplier on c_custkey = s_suppkey")
def _(s, sf):
    a = R.table(s, sf, "customer").select(F.col("c_custkey").alias("id"))
    b = R.table(s, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    return a.join(b, "id")


TXP = R.with_ctes(R.COMMERCE_SQL, R.TX_PRODUCTS_SQL)
WHOLE_BRIDGE_SQL = TXP + """, items as (select distinct id, trim(unnest(string_split(product_ids, ','))) as item from txp)
select items.id as transaction_id, item as product_id from items join products p on p.id::varchar = item"""


@query("join_find_in_set", WHOLE_BRIDGE_SQL)
def _(s, sf):
    return C.product_bridge(R.transactions_with_products(s, sf), R.products(s, sf))


@query("join_merge_suffix", sql("select tx.id, c.country, u.country as country_user from tx join company c on c.id = tx.company_id join users u on u.id = tx.user_id"))
def _(s, sf):
    co = CO(s, sf).select(F.col("id").alias("company_id"), "country")
    us = R.users(s, sf).select(F.col("id").alias("user_id"), F.col("country").alias("country_user"))
    return TX(s, sf).join(co, "company_id").join(us, "user_id").select("id", "country", "country_user")


# ---------------------------------------------------------------- aggregates
def paid(s, sf):
    from slotwise.functions.numbers import clean_money
    return R.employees(s, sf).withColumns({
        "salary": clean_money(F.col("salary_text")), "gender_label": P.gender_label(F.col("gender"))})


SELLING_SQL = sql("select distinct country from company c join tx on c.id = tx.company_id where declined = 0")


@query("agg_distinct", SELLING_SQL)
def _(s, sf):
    return C.sales_with_company(TX(s, sf), CO(s, sf)).select("country").distinct()


N_COUNTRIES_SQL = sql("select count(distinct country) as n_countries from company c join tx on c.id = tx.company_id where declined = 0")


@query("agg_count_distinct", N_COUNTRIES_SQL)
def _(s, sf):
    return C.sales_with_company(TX(s, sf), CO(s, sf)).agg(F.countDistinct("country").alias("n_countries"))


COUNTRY_MEAN_SQL = sql(f"select country, {sql_mean_money()} as mean_sale from company c join tx on c.id = tx.company_id where declined = 0 group by country")


@query("agg_avg_round", COUNTRY_MEAN_SQL)
def _(s, sf):
    return mean_by_country(s, sf)


def mean_by_country(s, sf):
    return C.sales_with_company(TX(s, sf), CO(s, sf)).groupBy("country").agg(mean_money(F.col("amount")).alias("mean_sale"))


@query("agg_sum_by_day", sql("select ts::date::varchar as day, sum(amount)::double as income from tx where declined = 0 group by 1"))
def _(s, sf):
    return income_by_day(s, sf).select(F.col("day").cast("string"), F.col("income").cast("double"))


def income_by_day(s, sf):
    return C.accepted(TX(s, sf)).groupBy(F.to_date("timestamp").alias("day")).agg(F.sum("amount").alias("income"))


VOLUME_SQL = sql(f"""select company_name, count(*) as n_transactions, case when count(*) < 7 then '{VOLUME_LABELS[0]}'
 when count(*) = 7 then '{VOLUME_LABELS[1]}' else '{VOLUME_LABELS[2]}' end as comment
 from tx join company c on c.id = tx.company_id where declined = 0 group by company_name""")


@query("agg_case_on_count", VOLUME_SQL)
def _(s, sf):
    return C.company_volume(TX(s, sf), CO(s, sf), threshold=7)


@query("agg_having_alias", sql("select user_id, count(*) as total from tx group by user_id having count(*) > 15"))
def _(s, sf):
    return TX(s, sf).groupBy("user_id").agg(F.count("id").alias("total")).where(F.col("total") > 15)


IBAN_SQL = sql(f"""select card_id, iban, {sql_mean_money()} as mean from tx join cards k on k.id = tx.card_id
 join company c on c.id = tx.company_id and company_name = '{NAMED}' group by card_id, company_id, iban""")


@query("agg_nonkey_projection", IBAN_SQL)
def _(s, sf):
    return C.card_means_of_company(TX(s, sf), R.cards(s, sf), CO(s, sf), NAMED)


@query("agg_filter_count", "select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as n_f, count(*) as n, round(count(*) filter (where o_orderstatus = 'F') * 100.0::double / count(*), 2) as pct_f from orders group by 1")
def _(s, sf):
    from slotwise.functions.numbers import pct
    n_f = F.count(F.when(F.col("o_orderstatus") == "F", 1))
    n = F.count(F.lit(1))
    return R.table(s, sf, "orders").groupBy("o_orderpriority").agg(n_f.alias("n_f"), n.alias("n"), pct(n_f, n).alias("pct_f"))


@query("agg_filter_avg_std", "select l_returnflag, round(avg(l_quantity) filter (where l_linestatus = 'O'), 6) as avg_o, round(stddev_samp(l_quantity) filter (where l_linestatus = 'F'), 6) as sd_f from lineitem group by 1")
def _(s, sf):
    of = lambda status: F.when(F.col("l_linestatus") == status, F.col("l_quantity"))
    return rounded(R.table(s, sf, "lineitem").groupBy("l_returnflag").agg(
        F.avg(of("O")).alias("avg_o"), F.stddev_samp(of("F")).alias("sd_f")), "avg_o", "sd_f")


@query("agg_cond_sum", R.STATION + "select station_id, sum(case when delta_bikes < 0 then -delta_bikes else 0 end)::bigint as bikes_left from delta group by 1")
def _(s, sf):
    deltas = TS.with_delta(R.cleaned(s, sf))
    left = F.when(F.col("delta_bikes") < 0, -F.col("delta_bikes")).otherwise(0)
    return deltas.groupBy("station_id").agg(F.sum(left).alias("bikes_left"))


@query("agg_arg_max", """select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as last_order,
 arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as last_status from orders group by 1""")
def _(s, sf):
    latest = F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey"))
    rows = R.table(s, sf, "orders").groupBy("o_custkey").agg(latest.alias("r"))
    return rows.select("o_custkey", F.col("r.o_orderkey").alias("last_order"), F.col("r.o_orderstatus").alias("last_status"))


@query("agg_min_max_avg", R.GRID + "select station_id, day::varchar as day, hour::int as hour, half, min_bikes, max_bikes, avg_bikes, min_docks, max_docks, avg_docks, avg_capacity from slots")
def _(s, sf):
    return with_text(TS.half_hour_slots(R.located(s, sf)), "day")


@query("agg_mode", """select o_custkey, arg_min(o_orderpriority, (-n, o_orderpriority)) as usual_priority
 from (select o_custkey, o_orderpriority, count(*) as n from orders group by all) group by 1""")
def _(s, sf):
    return G.modal_value(R.table(s, sf, "orders"), ["o_custkey"], "o_orderpriority", "usual_priority")


@query("agg_median", "select o_orderpriority, round(median(o_totalprice), 4) as median from orders group by 1")
def _(s, sf):
    return rounded(exact_quantiles(R.table(s, sf, "orders"), ["o_orderpriority"], "o_totalprice", {"median": 0.5}), "median", digits=4)


SALARY_SQL = R.PEOPLE + """select gender_label, round_even(avg(salary) * 100, 0)::double / 100 as mean, round_even(median(salary) * 100, 0)::double / 100 as median,
 min(salary) as min, max(salary) as max from paid where gender_label is not null group by 1"""


@query("agg_stats_by_group", SALARY_SQL)
def _(s, sf):
    return P.salary_summary(paid(s, sf), "gender_label", "salary")


@query("agg_avg_of_avgs", """select l_returnflag, round(avg(m), 6) as mean_of_means from
 (select l_returnflag, l_shipdate, avg(l_quantity) as m from lineitem group by all) group by 1""")
def _(s, sf):
    per_day = R.table(s, sf, "lineitem").groupBy("l_returnflag", "l_shipdate").agg(F.avg("l_quantity").alias("m"))
    return rounded(per_day.groupBy("l_returnflag").agg(F.avg("m").alias("mean_of_means")), "mean_of_means")


@query("agg_ratio_by_state", R.GRID + """select station_id, round(count(*) filter (where state = 'buida')::double / count(*), 6) as share_empty,
 round(count(*) filter (where state = 'plena')::double / count(*), 6) as share_full, round(count(*) filter (where state = 'extremes')::double / count(*), 6) as share_extremes from grid group by 1""")
def _(s, sf):
    share = lambda state: F.avg((F.col("state") == state).cast("double"))
    rows = R.grid(s, sf).groupBy("station_id").agg(
        share("buida").alias("share_empty"), share("plena").alias("share_full"), share("extremes").alias("share_extremes"))
    return rounded(rows, "share_empty", "share_full", "share_extremes")


@query("agg_pct_measured", R.GRID + """select station_id, count(*) filter (where state != 'sense_mesures') as measured_slots,
 round(count(*) filter (where state = 'buida') * 100.0::double / nullif(count(*) filter (where state != 'sense_mesures'), 0), 2) as pct_empty from grid group by 1""")
def _(s, sf):
    return TS.availability(R.grid(s, sf), ["station_id"]).select("station_id", "measured_slots", "pct_empty")


AGE_SQL = """case when try_cast(printf('%04d-%02d-%02d', birth_year, birth_month, birth_day) as date) is not null then
 2024 - birth_year - (630 < birth_month * 100 + birth_day)::int end"""


@query("agg_group_summary", R.PEOPLE + f"""select group_name, count(*) as n_workers, round_even(avg(salary) * 100, 0)::double / 100 as mean_salary,
 round_even(median({AGE_SQL}), 0)::int as median_age from paid group by 1""")
def _(s, sf):
    return P.group_summary(P.with_age(paid(s, sf), R.AGE_REFERENCE), "group_name", "salary", "age")


REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_PIVOT_COLUMNS = ", ".join(
    f"""max(mean) filter (where region_name = '{r}') as "{r}\"""" for r in [*REGIONS, "Mitjana"])
PIVOT_SQL = R.PEOPLE + f"""select gender_label, {_PIVOT_COLUMNS} from (
 select coalesce(gender_label, 'Mitjana') as gender_label, coalesce(region_name, 'Mitjana') as region_name,
        round_even(avg(salary) * 100, 0)::double / 100 as mean
 from paid where gender_label is not null and salary is not null group by cube (gender_label, region_name)) group by 1"""


def salary_pivot(s, sf):
    return G.pivot_with_margins(
        paid(s, sf), "gender_label", "region_name", "salary", REGIONS, "Mitjana", lambda c: round_even(c, 2))


@query("agg_pivot_margins", PIVOT_SQL)
def _(s, sf):
    return salary_pivot(s, sf)


@query("agg_crosstab", """select o_orderpriority, o_orderstatus, n, round(100.0::double * n / sum(n) over (partition by o_orderpriority), 6) as row_pct
 from (select o_orderpriority, o_orderstatus, count(*) as n from orders group by all)""")
def _(s, sf):
    return rounded(G.crosstab(R.table(s, sf, "orders"), "o_orderpriority", "o_orderstatus"), "row_pct")


@query("agg_value_counts_topn", sql("select country, count(*) as n from tx join company c on c.id = tx.company_id group by 1 order by n desc, country limit 5"))
def _(s, sf):
    co = CO(s, sf).withColumnRenamed("id", "company_id")
    return G.value_counts(TX(s, sf).join(co, "company_id"), "country", 5)


@query("agg_collect_inverse", "select p_size, p_partkey, count(*) over (partition by p_size) > 1 as duplicated from part")
def _(s, sf):
    return G.invert_mapping(R.table(s, sf, "part"), "p_partkey", "p_size")


@query("agg_group_cluster_summary", """with c as (select r.r_name, o_orderstatus, o_totalprice::decimal(18,2) as price, n_name from orders
  join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region r on n_regionkey = r_regionkey)
 select r_name, count(*) as n, round((sum(price)::double / count(*)), 4) as mean_price,
  (select arg_min(n_name, (-k, n_name)) from (select n_name, count(*) as k from c c2 where c2.r_name = c.r_name group by 1)) as top_nation
 from c group by r_name""")
def _(s, sf):
    nation = R.table(s, sf, "nation").join(R.table(s, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cust = R.table(s, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = R.table(s, sf, "orders").join(cust, F.col("o_custkey") == F.col("c_custkey")).select(
        "r_name", "n_name", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    plain = rows.groupBy("r_name").agg(
        F.count(F.lit(1)).alias("n"), (F.sum("price").cast("double") / F.count(F.lit(1))).alias("mean_price"))
    return rounded(plain.join(G.modal_value(rows, ["r_name"], "n_name", "top_nation"), "r_name"), "mean_price", digits=4)


# ---------------------------------------------------------------- windows
DELTA_COLUMNS = ["prev_reported", "seconds_since_prev", "prev_bikes", "delta_bikes"]
DELTA_SQL = R.STATION + "select station_id, last_reported, " + ", ".join(f"{c}::double as {c}" for c in DELTA_COLUMNS) + " from delta"


@query("win_row_number_lastn", sql("""select card_id, id, row_in_group from (select *, row_number() over (partition by card_id order by ts desc, id desc)::int as row_in_group from tx) where row_in_group <= 3"""))
def _(s, sf):
    rows = G.last_n_per_group(TX(s, sf), ["card_id"], [F.desc("timestamp"), F.desc("id")], 3)
    return rows.select("card_id", "id", "row_in_group")


@query("win_lag1_delta", DELTA_SQL)
def _(s, sf):
    return with_double(TS.with_delta(R.cleaned(s, sf)).drop("bikes", "docks"), *DELTA_COLUMNS)


@query("win_sum_over_agg", "select o_orderstatus, o_orderpriority, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (partition by o_orderstatus), 2) as pct from orders group by 1, 2")
def _(s, sf):
    from slotwise.functions.numbers import pct
    counts = R.table(s, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", pct(F.col("n"), F.sum("n").over(Window.partitionBy("o_orderstatus"))))


# ---------------------------------------------------------------- order and limits
@query("sort_multi", R.PEOPLE + "select id, country, region_name from employees order by region_name nulls last, country nulls last")
def _(s, sf):
    return R.employees(s, sf).select("id", "country", "region_name").orderBy(
        F.asc_nulls_last("region_name"), F.asc_nulls_last("country"))


TOP_COMPANY_SQL = sql(f"select company_name, {sql_mean_money()} as mean_sale from company c join tx on c.id = tx.company_id where declined = 0 group by company_name order by mean_sale desc, company_name limit 1")


@query("topk_1", TOP_COMPANY_SQL)
def _(s, sf):
    return top_company(s, sf)


def top_company(s, sf):
    means = C.sales_with_company(TX(s, sf), CO(s, sf)).groupBy("company_name").agg(mean_money(F.col("amount")).alias("mean_sale"))
    return means.orderBy(F.desc("mean_sale"), "company_name").limit(1)


TOP_DAYS_SQL = sql("select ts::date::varchar as day, sum(amount)::double as income from tx where declined = 0 group by 1 order by income desc, day limit 5")


@query("topk_5", TOP_DAYS_SQL)
def _(s, sf):
    return top_days(s, sf)


def top_days(s, sf):
    top = income_by_day(s, sf).orderBy(F.desc("income"), "day").limit(5)
    return top.select(F.col("day").cast("string"), F.col("income").cast("double"))


@query("head_n", R.PEOPLE + "select id, country from employees order by region_name, country, id limit 10")
def _(s, sf):
    return R.employees(s, sf).orderBy("region_name", "country", "id").limit(10).select("id", "country")


@query("idx_min_max", """with m as (select year(o_orderdate) as y, month(o_orderdate) as mo, sum(o_totalprice::decimal(18,2)) as v from orders group by all)
 select y::int as y, arg_min(mo, (v, mo))::int as min_month, arg_min(mo, (-v, mo))::int as max_month from m group by y""")
def _(s, sf):
    months = R.table(s, sf, "orders").groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("mo")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))
    return months.groupBy("y").agg(
        F.min_by("mo", F.struct("v", "mo")).alias("min_month"), F.min_by("mo", F.struct(-F.col("v"), F.col("mo"))).alias("max_month"))


# ---------------------------------------------------------------- sets
USERS_UNION_SQL = sql("select id, surname, country, 'AMERICAN' as region from users where region_name = 'AMERICA' union all select id, surname, country, 'EUROPEAN' from users where region_name = 'EUROPE'")


def users_union(s, sf):
    users = R.users(s, sf)
    part = lambda name: users.where(F.col("region_name") == name).select("id", "surname", "country")
    return C.union_tagged({"AMERICAN": part("AMERICA"), "EUROPEAN": part("EUROPE")})


@query("set_union_all_tag", USERS_UNION_SQL)
def _(s, sf):
    return users_union(s, sf)


@query("set_union_dedup", "select c_nationkey as nationkey, c_mktsegment as tag from customer union select s_nationkey, 'SUPPLIER' from supplier union select c_nationkey, 'ANY' from customer")
def _(s, sf):
    customer, supplier = R.table(s, sf, "customer"), R.table(s, sf, "supplier")
    a = customer.select(F.col("c_nationkey").alias("nationkey"), F.col("c_mktsegment").alias("tag"))
    b = supplier.select(F.col("s_nationkey").alias("nationkey"), F.lit("SUPPLIER").alias("tag"))
    c = customer.select(F.col("c_nationkey").alias("nationkey"), F.lit("ANY").alias("tag"))
    return a.union(b).union(c).distinct()


@query("set_union_many", "select o_orderstatus as part, o_orderkey as id from orders where o_orderstatus in ('F', 'O', 'P')")
def _(s, sf):
    orders = R.table(s, sf, "orders")
    parts = {st: orders.where(F.col("o_orderstatus") == st).select(F.col("o_orderkey").alias("id")) for st in ("F", "O", "P")}
    return C.union_tagged(parts, "part")


@query("set_values", "select v.label, count(o_orderkey) as n from (values ('F', 'done'), ('O', 'open'), ('P', 'part'), ('X', 'none')) v(code, label) left join orders on o_orderstatus = v.code group by 1")
def _(s, sf):
    values = s.createDataFrame([("F", "done"), ("O", "open"), ("P", "part"), ("X", "none")], "code string, label string")
    counts = R.table(s, sf, "orders").groupBy(F.col("o_orderstatus").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return values.join(counts, "code", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


# ---------------------------------------------------------------- whole questions
@query("q_countries_selling", SELLING_SQL)
def _(s, sf):
    return C.sales_with_company(TX(s, sf), CO(s, sf)).select("country").distinct().orderBy("country")


@query("q_n_countries", N_COUNTRIES_SQL)
def _(s, sf):
    return C.sales_with_company(TX(s, sf), CO(s, sf)).agg(F.countDistinct("country").alias("n_countries"))


query("q_top_company_avg", TOP_COMPANY_SQL)(top_company)
query("q_top5_days", TOP_DAYS_SQL)(top_days)


@query("q_tx_of_country", sql("select tx.id, amount::double as amount from tx join company c on c.id = tx.company_id where country = 'NATION_2' and declined = 0"))
def _(s, sf):
    return tx_of_country(s, sf, "NATION_2")


@query("q_companies_above_avg", ABOVE_SQL)
def _(s, sf):
    return C.companies_with_sale_above_mean(TX(s, sf), CO(s, sf)).orderBy("company_name")


@query("q_companies_without_tx", NO_TX_SQL)
def _(s, sf):
    return C.companies_without_transactions(_large(s, sf), CO(s, sf))


@query("q_avg_by_country", COUNTRY_MEAN_SQL)
def _(s, sf):
    return mean_by_country(s, sf).orderBy(F.desc("mean_sale"))


@query("q_same_country_join", SAME_COUNTRY_SQL.replace("select tx.id, amount::double as amount", "select tx.id, amount::double as amount, company_name"))
def _(s, sf):
    co = CO(s, sf)
    same = co.where(F.col("country") == C.country_of(co, NAMED)).select(F.col("id").alias("company_id"), "company_name")
    return C.accepted(TX(s, sf)).join(same, "company_id").select("id", F.col("amount").cast("double"), "company_name")


@query("q_same_country_subquery", sql(f"""select id, amount::double as amount, company_id from tx where exists (select 1 from company c where c.id = tx.company_id
 and c.country = (select country from company where company_name = '{NAMED}')) and declined = 0"""))
def _(s, sf):
    return with_double(C.transactions_in_country_of(TX(s, sf), CO(s, sf), NAMED).select("id", "amount", "company_id"), "amount")


@query("q_amount_band_dates", sql(f"""select company_name, phone, country, ts::date::varchar as day, amount::double as amount from tx join company c on c.id = tx.company_id
 where amount between 100000 and 400000 and declined = 0 and ts::date in ({DAYS_SQL})"""))
def _(s, sf):
    tx = TX(s, sf).where(F.col("amount").between(100000, 400000) & F.to_date("timestamp").isin(DAYS))
    rows = C.sales_with_company(tx, CO(s, sf)).orderBy(F.desc("amount"))
    return rows.select("company_name", "phone", "country", F.to_date("timestamp").cast("string").alias("day"), F.col("amount").cast("double"))


@query("q_company_volume_label", VOLUME_SQL)
def _(s, sf):
    return C.company_volume(TX(s, sf), CO(s, sf), threshold=7).orderBy("n_transactions")


MARKETING_SQL = sql(f"""select company_name, phone, country, {sql_mean_money()} as average_purchases from company c
 join tx on c.id = tx.company_id where declined = 0 group by all""")


@query("q_view_marketing", MARKETING_SQL)
def _(s, sf):
    return C.marketing_view(TX(s, sf), CO(s, sf)).orderBy(F.desc("average_purchases"))


@query("q_view_marketing_country", sql(f"""select * from (select company_name, phone, country, {sql_mean_money()} as average_purchases from company c
 join tx on c.id = tx.company_id where declined = 0 group by all) where country = 'NATION_9'"""))
def _(s, sf):
    C.marketing_view(TX(s, sf), CO(s, sf)).createOrReplaceTempView("marketing")
    return s.sql("select * from marketing where country = 'NATION_9'")


REPORT_SQL = sql("""select tx.id as transaction_id, u.name as user_name, u.surname as user_surname, iban as card_iban, company_name,
 amount::double as amount, ts::date::varchar as transaction_date, strftime(ts, '%H:%M:%S') as transaction_time, lat, longitude, declined,
 expiring_date as card_expiry, u.country as user_country, c.country as company_country
 from tx join company c on c.id = tx.company_id join users u on u.id = tx.user_id join cards k on k.id = tx.card_id""")


@query("q_view_report", REPORT_SQL)
def _(s, sf):
    report = C.technical_report(TX(s, sf), CO(s, sf), R.users(s, sf), R.cards(s, sf)).orderBy(F.desc("transaction_id"))
    return with_text(with_double(report, "amount"), "transaction_date")


@query("q_users_union", USERS_UNION_SQL)
def _(s, sf):
    return users_union(s, sf)


@query("q_heavy_users", sql("select u.id, name, surname, n as total_transactions from users u join (select user_id, count(*) as n from tx group by 1 having count(*) > 15) t on t.user_id = u.id"))
def _(s, sf):
    return C.heavy_users(TX(s, sf), R.users(s, sf), more_than=15)


@query("q_iban_avg_company", IBAN_SQL)
def _(s, sf):
    return C.card_means_of_company(TX(s, sf), R.cards(s, sf), CO(s, sf), NAMED).orderBy(F.desc("mean"))


CARD_STATUS_SQL = sql("""select card_id, case when sum(declined) = 3 then 'inactive' else 'active' end as status from
 (select *, row_number() over (partition by card_id order by ts desc, id desc) as rn from tx) where rn <= 3 group by 1""")


@query("q_card_status", CARD_STATUS_SQL)
def _(s, sf):
    return C.card_status(TX(s, sf))


@query("q_active_cards", sql("""select count(*) as n_cards, status from (select card_id, case when sum(declined) = 3 then 'inactive' else 'active' end as status from
 (select *, row_number() over (partition by card_id order by ts desc, id desc) as rn from tx) where rn <= 3 group by 1) where status = 'active' group by 2"""))
def _(s, sf):
    status = C.card_status(TX(s, sf)).where(F.col("status") == "active")
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("n_cards"))


BRIDGE_SQL = TXP + """, items as (select distinct id, trim(unnest(string_split(product_ids, ','))) as item from txp),
bridge as (select items.id as transaction_id, item as product_id from items join products p on p.id::varchar = item)
"""


@query("q_product_sales", BRIDGE_SQL + "select product_id, count(*) as quantity from bridge join tx on tx.id = transaction_id and declined = 0 group by 1")
def _(s, sf):
    tx = R.transactions_with_products(s, sf)
    return C.product_sales(C.product_bridge(tx, R.products(s, sf)), tx)


@query("q_salary_summary", SALARY_SQL)
def _(s, sf):
    return P.salary_summary(paid(s, sf), "gender_label", "salary")


@query("q_salary_pivot", PIVOT_SQL)
def _(s, sf):
    return salary_pivot(s, sf)


RAISE_SQL = R.PEOPLE + f"""select id, p.group_name, increment,
 round_even(salary * (1 + replace(replace(increment, '%', ''), ',', '.')::double / 100.0::double) * 100, 0)::double / 100 as raised_salary
 from paid p left join {INCREMENTS_SQL} on i.group_name = p.group_name"""


@query("q_salary_raise", RAISE_SQL)
def _(s, sf):
    raised = P.raise_salaries(paid(s, sf), increments(s), "group_name", "salary")
    return raised.select("id", "group_name", "increment", "raised_salary")


@query("q_market_heatmap", sql("select u.country as country_user, c.country, count(*) as n from tx join company c on c.id = tx.company_id join users u on u.id = tx.user_id group by all"))
def _(s, sf):
    co = CO(s, sf).select(F.col("id").alias("company_id"), "country")
    us = R.users(s, sf).select(F.col("id").alias("user_id"), F.col("country").alias("country_user"))
    return G.crosstab(TX(s, sf).join(co, "company_id").join(us, "user_id"), "country_user", "country").drop("row_pct")
