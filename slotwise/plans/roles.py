"""Maps the given tables onto the schemas the operators expect, in Spark and in SQL.

Each role exists twice: a function returning a DataFrame, and a SQL text used as a
common table expression by the checks.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from slotwise.functions import dates
from slotwise.operators import timeseries as ts

AGE_REFERENCE = date(2024, 6, 30)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- commerce
def company(spark: SparkSession, sf: str) -> DataFrame:
    customer, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    key = F.col("c_custkey").cast("string")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("company_name"),
        F.concat(F.lit("+34"), F.lpad(key, 9, "0")).alias("phone"),
        F.col("n_name").alias("country"),
        F.concat(F.lit("www."), key, F.lit(".example")).alias("website"),
    )


def transactions(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("company_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_custkey").alias("card_id"),
        F.col("o_orderdate").alias("timestamp"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        (F.col("o_orderstatus") == "F").cast("int").alias("declined"),
        (F.pmod(F.col("o_custkey"), F.lit(180)) - 90).cast("double").alias("lat"),
        (F.pmod(F.col("o_orderkey"), F.lit(360)) - 180).cast("double").alias("longitude"),
    )


def transactions_with_products(spark: SparkSession, sf: str) -> DataFrame:
    """Product list of 1 to 7 part keys per transaction; some repeat, some are unknown."""
    n = 1 + F.pmod(F.col("id"), F.lit(7))
    item = lambda j: F.pmod(F.col("user_id") + j * F.pmod(F.col("id"), F.lit(50)), F.lit(1300)).cast("string")
    ids = F.array_join(F.transform(F.sequence(F.lit(1).cast("bigint"), n), item), ", ")
    return transactions(spark, sf).withColumn("product_ids", ids)


def products(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("product_name"), F.col("p_retailprice").alias("price")
    )


def users(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as people with a region and a birth date in parts (some dates are impossible)."""
    customer = table(spark, sf, "customer")
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    key = F.col("c_custkey")
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            key.alias("id"), F.col("c_mktsegment").alias("name"), F.col("c_name").alias("surname"),
            F.col("n_name").alias("country"), F.col("r_name").alias("region_name"),
            (1950 + F.pmod(key, F.lit(50))).cast("int").alias("birth_year"),
            (1 + F.pmod(key, F.lit(12))).cast("int").alias("birth_month"),
            (1 + F.pmod(key, F.lit(31))).cast("int").alias("birth_day"),
        )
    )


def cards(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("IB"), F.lpad(key, 12, "0")).alias("iban"),
        F.lpad(key, 16, "4").alias("pan"),
        F.lpad(F.pmod(F.col("c_custkey"), F.lit(1000)).cast("string"), 3, "0").alias("cvv"),
        F.concat(F.lpad((1 + F.pmod(F.col("c_custkey"), F.lit(12))).cast("string"), 2, "0"), F.lit("/30")).alias(
            "expiring_date"
        ),
    )


COMMERCE_SQL = """
company as (
  select c_custkey as id, c_name as company_name, '+34' || lpad(c_custkey::varchar, 9, '0') as phone,
         n_name as country, 'www.' || c_custkey || '.example' as website
  from customer join nation on c_nationkey = n_nationkey),
tx as (
  select o_orderkey as id, o_custkey as company_id, o_custkey as user_id, o_custkey as card_id,
         o_orderdate as ts, o_totalprice::decimal(18,2) as amount,
         (o_orderstatus = 'F')::int as declined,
         (o_custkey % 180 - 90)::double as lat, (o_orderkey % 360 - 180)::double as longitude
  from orders),
users as (
  select c_custkey as id, c_mktsegment as name, c_name as surname, n_name as country, r_name as region_name,
         (1950 + c_custkey % 50)::int as birth_year, (1 + c_custkey % 12)::int as birth_month,
         (1 + c_custkey % 31)::int as birth_day
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
cards as (
  select c_custkey as id, 'IB' || lpad(c_custkey::varchar, 12, '0') as iban,
         lpad(c_custkey::varchar, 16, '4') as pan, lpad((c_custkey % 1000)::varchar, 3, '0') as cvv,
         lpad((1 + c_custkey % 12)::varchar, 2, '0') || '/30' as expiring_date
  from customer),
products as (select p_partkey as id, p_name as product_name, p_retailprice as price from part)
"""

TX_PRODUCTS_SQL = """
txp as (
  select *, array_to_string(list_transform(range(1, 2 + id % 7),
            lambda j: ((user_id + j * (id % 50)) % 1300)::varchar), ', ') as product_ids
  from tx)
"""


# ---------------------------------------------------------------- people
def employees(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as employees with coded gender, children flags and a salary text like ``1.234 €``."""
    key = F.col("c_custkey")
    euros = F.floor(F.abs(F.col("c_acctbal")) + 1000).cast("bigint")
    text = F.concat(
        F.floor(euros / 1000).cast("string"), F.lit("."),
        F.lpad(F.pmod(euros, F.lit(1000)).cast("string"), 3, "0"), F.lit(" €"),
    )
    group = F.element_at(F.array(*[F.lit(f"Grup {g}") for g in "ABCDE"]), (1 + F.pmod(key, F.lit(5))).cast("int"))
    gender = F.element_at(F.array(*[F.lit(g) for g in ("H", "D", "A", "NC")]), (1 + F.pmod(key, F.lit(4))).cast("int"))
    people = users(spark, sf).select("id", "country", "region_name", "birth_year", "birth_month", "birth_day")
    return table(spark, sf, "customer").select(
        key.alias("id"), F.col("c_mktsegment").alias("first_name"), F.col("c_name").alias("last_name"),
        gender.alias("gender"),
        F.when(F.pmod(key, F.lit(3)) == 0, 1.0).alias("children"),
        F.when(F.pmod(key, F.lit(3)) == 1, 1.0).alias("no_children"),
        F.when(F.pmod(key, F.lit(11)) == 0, F.lit(" ")).otherwise(text).alias("salary_text"),
        group.alias("group_name"),
    ).join(people, "id")


EMPLOYEES_SQL = """
employees as (
  select u.id, c_mktsegment as first_name, c_name as last_name,
         (['H','D','A','NC'])[1 + c_custkey % 4] as gender,
         case when c_custkey % 3 = 0 then 1.0 end as children,
         case when c_custkey % 3 = 1 then 1.0 end as no_children,
         case when c_custkey % 11 = 0 then ' '
              else (floor(abs(c_acctbal) + 1000)::bigint // 1000) || '.'
                   || lpad((floor(abs(c_acctbal) + 1000)::bigint % 1000)::varchar, 3, '0') || ' €' end as salary_text,
         'Grup ' || (['A','B','C','D','E'])[1 + c_custkey % 5] as group_name,
         u.country, u.region_name, u.birth_year, u.birth_month, u.birth_day
  from customer join users u on u.id = c_custkey),
paid as (
  select *, try_cast(nullif(trim(replace(replace(salary_text, '€', ''), '.', '')), '') as double) as salary,
         case gender when 'H' then 'Hombre' when 'D' then 'Mujer' when 'A' then 'Otros' when 'NC' then null
              else gender end as gender_label
  from employees)
"""


# ---------------------------------------------------------------- stations
def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Events as raw station readings: every column text, times cut to five minutes."""
    seconds = F.expr("(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) + 500000) div 1000000")
    bikes = F.pmod(F.floor("value"), F.lit(13)).cast("int")
    as_text = lambda c: c.cast("string")
    return table(spark, sf, "events").select(
        as_text(F.pmod(F.col("user_id"), F.lit(10))).alias("station_id"),
        as_text(seconds - F.pmod(seconds, F.lit(300))).alias("last_reported"),
        as_text(F.col("event_id")).alias("last_updated"),
        as_text(bikes).alias("num_bikes_available"),
        as_text(12 - bikes).alias("num_docks_available"),
        F.when(F.col("event_type") == "error", "NOT_IN_SERVICE").otherwise("IN_SERVICE").alias("status"),
        F.when(F.col("event_type") == "signup", "0").otherwise("1").alias("is_renting"),
    )


def stations_of(raw: DataFrame) -> DataFrame:
    """Station dimension: the stations seen in the readings, on a diagonal, in three districts."""
    ids = raw.select(F.col("station_id").try_cast("int").alias("station_id")).distinct()
    step = F.col("station_id") * 0.005
    district = F.pmod(F.col("station_id"), F.lit(3))
    return ids.select(
        "station_id", (41.38 + step).alias("lat"), (2.15 + step).alias("lon"),
        district.alias("district_id"), F.concat(F.lit("District "), district.cast("string")).alias("district"),
    )


def stations(spark: SparkSession, sf: str) -> DataFrame:
    return stations_of(readings(spark, sf))


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return ts.clean(readings(spark, sf))


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    raw = readings(spark, sf)
    return ts.enrich(ts.with_delta(ts.clean(raw)), stations_of(raw))


def located(spark: SparkSession, sf: str) -> DataFrame:
    """Enriched readings without the lag, for stages that do not use it."""
    raw = readings(spark, sf)
    return ts.enrich(ts.clean(raw), stations_of(raw))


def trips(spark: SparkSession, sf: str) -> DataFrame:
    raw = readings(spark, sf)
    return ts.trips(ts.with_delta(ts.clean(raw)), stations_of(raw))


def bounds(spark: SparkSession, sf: str):
    return ts.calendar_bounds(readings(spark, sf))


def grid(spark: SparkSession, sf: str) -> DataFrame:
    raw = readings(spark, sf)
    dimension = stations_of(raw)
    slots = ts.half_hour_slots(ts.enrich(ts.clean(raw), dimension))
    return ts.dense_grid(slots, dimension, *ts.calendar_bounds(raw))


TRAIN_END = date(2024, 1, 21)
TEST_START = date(2024, 1, 22)
TEST_END = date(2024, 1, 31)
SHORT_HISTORY_KEYS = ["station_id", "weekday", "hour", "half"]

STATION_SQL = """
readings as (
  select (user_id % 10)::varchar as station_id,
         ((epoch_us(ts) + 500000) // 1000000 // 300 * 300)::varchar as last_reported,
         event_id::varchar as last_updated,
         (floor(value)::bigint % 13)::varchar as num_bikes_available,
         (12 - floor(value)::bigint % 13)::varchar as num_docks_available,
         case when event_type = 'error' then 'NOT_IN_SERVICE' else 'IN_SERVICE' end as status,
         case when event_type = 'signup' then '0' else '1' end as is_renting
  from events),
stations as (
  select distinct station_id::int as station_id, 41.38 + station_id::int * 0.005::double as lat,
         2.15 + station_id::int * 0.005::double as lon,
         station_id::int % 3 as district_id, 'District ' || (station_id::int % 3) as district
  from readings),
clean as (
  select station_id::int as station_id, last_reported::bigint as last_reported,
         num_bikes_available::int as bikes, num_docks_available::int as docks
  from (select *, row_number() over (partition by station_id, last_reported order by last_updated::bigint desc) as rn
        from readings
        where status = 'IN_SERVICE' and is_renting = '1'
          and regexp_full_match(station_id, '[0-9]+') and regexp_full_match(num_bikes_available, '[0-9]+')
          and regexp_full_match(num_docks_available, '[0-9]+') and regexp_full_match(last_reported, '[0-9]+')
          and last_reported::bigint between 946684800 and 2145916800)
  where rn = 1),
delta as (
  select *, lag(last_reported) over w as prev_reported, last_reported - lag(last_reported) over w as seconds_since_prev,
         lag(bikes) over w as prev_bikes, bikes - lag(bikes) over w as delta_bikes
  from clean window w as (partition by station_id order by last_reported)),
enriched as (
  select d.*, l.ts_local, l.ts_local::date as day, year(l.ts_local) as year, month(l.ts_local) as month,
         day(l.ts_local) as day_of_month, isodow(l.ts_local) as weekday, hour(l.ts_local) as hour,
         minute(l.ts_local) as minute, second(l.ts_local) as second, s.lat, s.lon, s.district_id, s.district,
         (minute(l.ts_local) >= 30)::int as half
  from delta d
  join (select distinct last_reported, timestamp '1970-01-01' + to_seconds(last_reported) + interval 1 hour as ts_local
        from delta) l using (last_reported)
  join stations s using (station_id))
"""

GRID_SQL = """
slots as (
  select station_id, day, hour, half, min(bikes) as min_bikes, max(bikes) as max_bikes, round(avg(bikes), 2) as avg_bikes,
         min(docks) as min_docks, max(docks) as max_docks, round(avg(docks), 2) as avg_docks,
         round(avg((bikes + docks)::double), 2) as avg_capacity
  from enriched where year >= 2022 group by all),
calendar as (
  select ts::date as day, hour(ts) as hour, (minute(ts) > 0)::int as half
  from (select unnest(generate_series(min(day)::timestamp, max(day)::timestamp + interval '23 hours 30 minutes',
                                      interval 30 minute)) as ts from enriched)),
grid as (
  select s.station_id, s.lat, s.lon, s.district_id, s.district, c.day, c.hour, c.half,
         min_bikes, max_bikes, avg_bikes, min_docks, max_docks, avg_docks, avg_capacity,
         case when h.station_id is null then 'sense_mesures'
              when min_bikes < 0 or min_docks < 0 then 'altres'
              when min_bikes = 0 and min_docks = 0 then 'extremes'
              when min_bikes = 0 then 'buida' when min_docks = 0 then 'plena' else 'normal' end as state
  from stations s cross join calendar c
  left join slots h on h.station_id = s.station_id and h.day = c.day and h.hour = c.hour and h.half = c.half)
"""


def with_ctes(*ctes: str) -> str:
    return "with " + ",".join(c.strip() for c in ctes) + "\n"


COMMERCE = with_ctes(COMMERCE_SQL)
STATION = with_ctes(STATION_SQL)
GRID = with_ctes(STATION_SQL, GRID_SQL)
PEOPLE = with_ctes(COMMERCE_SQL, EMPLOYEES_SQL)
