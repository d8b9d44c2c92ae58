"""Queries that write the given tables to the shared folder in a source format and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from slotwise.plans import roles as R
from slotwise.plans.registry import query, with_double, with_text
from slotwise.plans.tabular import match_lines, MATCH_SQL
from slotwise.operators import texts as TX, mutate as M
from slotwise.session import shared_folder
from slotwise.sources import readers as RD, writers as WR
from slotwise.sources.stored import StoredTable
from slotwise.streaming.half_hour import replay_half_hours

T = R.table


@query("src_parquet", "select n_nationkey, n_name, n_regionkey from nation")
def _(s, sf):
    return T(s, sf, "nation")


@query("src_csv_quoted", "select c_custkey, c_name || '; \"q\", ' || c_mktsegment as note, c_acctbal from customer")
def _(s, sf):
    path = shared_folder(s, "csv-quoted")
    note = F.concat("c_name", F.lit('; "q", '), "c_mktsegment")
    rows = T(s, sf, "customer").select("c_custkey", note.alias("note"), "c_acctbal")
    rows.write.option("header", True).option("sep", ";").option("escape", '"').csv(path)
    return RD.read_csv(s, path, "c_custkey bigint, note string, c_acctbal double", sep=";")


@query("src_csv_all_string", "select n_nationkey::varchar as n_nationkey, n_name, n_regionkey::varchar as n_regionkey, c_custkey::varchar as c_custkey from nation join customer on c_nationkey = n_nationkey")
def _(s, sf):
    path = shared_folder(s, "csv-string")
    customer = T(s, sf, "customer").select("c_custkey", "c_nationkey")
    nation = T(s, sf, "nation")
    WR.write_csv(customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).drop("c_nationkey"), path)
    return RD.read_csv(s, path)


def write_reading_tree(s, sf) -> str:
    """Readings as a tree of CSV files with three different headers, one per station remainder."""
    base = shared_folder(s, "tree")
    rows = R.readings(s, sf)
    third = F.pmod(F.col("station_id").try_cast("int"), F.lit(3))
    extra = rows.withColumn("num_bikes_available_types.mechanical", F.lit("1"))
    parts = {"a/2024_01": (rows.where(third == 0), 2), "b/2024_01": (extra.where(third == 1), 3), "c/2024_02": (rows.drop("is_renting").where(third == 2), 4)}
    for folder, (part, n_files) in parts.items():
        WR.write_csv(part.repartition(n_files), f"{base}/{folder}")
    return base


TREE_COLUMNS = ["station_id", "num_bikes_available", "num_bikes_available_types_mechanical", "last_reported", "status", "is_renting"]
TREE_SQL = R.STATION + """, tree as (select station_id, num_bikes_available, case when station_id::int % 3 = 1 then '1' end as num_bikes_available_types_mechanical,
 last_reported, status, case when station_id::int % 3 != 2 then is_renting end as is_renting from readings) """


@query("src_header_fingerprint", """select sha1(h) as fingerprint, h as header, n::bigint as n_files from (values
 ('station_id,last_reported,last_updated,num_bikes_available,num_docks_available,status,is_renting', 2),
 ('station_id,last_reported,last_updated,num_bikes_available,num_docks_available,status,is_renting,num_bikes_available_types.mechanical', 3),
 ('station_id,last_reported,last_updated,num_bikes_available,num_docks_available,status', 4)) v(h, n)""")
def _(s, sf):
    return RD.header_groups(s, write_reading_tree(s, sf))


@query("src_union_header_groups", TREE_SQL + "select * from tree")
def _(s, sf):
    return RD.read_header_groups(s, write_reading_tree(s, sf), TREE_COLUMNS)


@query("src_dotted_columns", TREE_SQL + "select station_id, num_bikes_available_types_mechanical, last_reported from tree where num_bikes_available_types_mechanical is not null")
def _(s, sf):
    base = write_reading_tree(s, sf)
    return RD.plain_names(RD.read_csv(s, f"{base}/b/2024_01")).select("station_id", "num_bikes_available_types_mechanical", "last_reported")


@query("src_header_offset", "select c_custkey::varchar as id, c_name as name, c_mktsegment as segment from customer")
def _(s, sf):
    path = shared_folder(s, "offset")
    parts = int(s.conf.get("spark.sql.shuffle.partitions"))
    body = T(s, sf, "customer").select(
        F.concat_ws(",", "c_custkey", "c_name", "c_mktsegment").alias("value"), F.lit(4).alias("line"),
        F.pmod(F.xxhash64("c_custkey"), F.lit(parts)).cast("int").alias("part"))
    titles = ["Report title", "", "unit,text", "id,name,segment"]
    head = s.range(parts).select(F.col("id").cast("int").alias("part"), F.posexplode(F.array(*[F.lit(t) for t in titles])).alias("line", "value"))
    lines = body.unionByName(head).repartition(parts, "part").sortWithinPartitions("part", "line")
    lines.select("part", "value").write.partitionBy("part").text(path)
    return RD.read_header_offset(s, path, len(titles), ["id", "name", "segment"])


@query("src_jdbc_tables", " union all ".join(f"select '{t}' as table_name, (select count(*) from {t}) as n_rows, (select count(*) from (describe {t})) ::int as n_columns" for t in ("region", "nation", "customer", "orders", "lineitem")))
def _(s, sf):
    for name in ("region", "nation", "customer", "orders", "lineitem", "labels"):
        T(s, sf, name).createOrReplaceTempView(name)
    wanted = ("region", "nation", "customer", "orders", "lineitem")
    others = [t.name for t in s.catalog.listTables() if t.name not in wanted]
    return RD.table_sizes(RD.catalog_tables(s, exclude=others))


@query("src_text_lines", MATCH_SQL + "select home, away, count(*) as n, sum(hg)::bigint as goals from m group by all")
def _(s, sf):
    path = shared_folder(s, "lines")
    match_lines(s, sf).write.text(path)
    matches = TX.parse_matches(RD.read_text_lines(s, path))
    return matches.groupBy("home", "away").agg(F.count(F.lit(1)).alias("n"), F.sum("home_goals").alias("goals"))


@query("src_json_records", "select event_id, event_type as title, case when event_id % 2 = 0 then 'u' || user_id || ', x' end as author, user_id::int as edition_count from events")
def _(s, sf):
    authors = F.when(F.pmod(F.col("event_id"), F.lit(2)) == 0, F.array(F.concat(F.lit("u"), F.col("user_id").cast("string")), F.lit("x")))
    record = F.struct(F.col("event_type").alias("title"), authors.alias("author_name"), F.col("user_id").alias("edition_count"))
    documents = T(s, sf, "events").select("event_id", F.to_json(F.struct(F.array(record).alias("docs"))).alias("body"))
    flat = RD.flatten_records(documents, "body", "title string, author_name array<string>, edition_count int", "docs")
    from slotwise.functions.text import join_or_null
    return flat.select("event_id", "title", join_or_null(F.col("author_name")).alias("author"), "edition_count")


@query("src_geojson", "select c_custkey::varchar as district_id, c_name as district, 2 as n_rings, c_nationkey::double + 4 as max_x from customer")
def _(s, sf):
    x = F.col("c_nationkey").cast("double")
    ring = lambda size: F.array(*[F.array(x + dx * size, F.lit(dy * size)) for dx, dy in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0))])
    feature = lambda kind, geometry: F.struct(
        F.struct(F.lit(kind).alias("TIPUS_UA"), F.col("c_custkey").cast("string").alias("CODI_UA"), F.col("c_name").alias("NOM")).alias("properties"), geometry)
    polygon = F.struct(F.lit("Polygon").alias("type"), F.array(ring(4.0), ring(1.0)).alias("coordinates")).alias("geometry")
    features = F.array(feature("DISTRICTE", polygon), feature("BARRI", polygon))
    documents = T(s, sf, "customer").select(F.to_json(F.struct(features.alias("features"))).alias("value"))
    units = RD.parse_geojson(documents)
    top = F.array_max(F.transform(F.flatten("rings"), lambda p: p["x"]))
    return units.select("district_id", "district", F.size("rings").alias("n_rings"), top.alias("max_x"))


@query("sink_csv", "select o_orderpriority, count(*)::varchar as n from orders group by 1")
def _(s, sf):
    path = shared_folder(s, "report")
    report = T(s, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    WR.write_csv(report, path)
    return RD.read_csv(s, path)


@query("sink_partitioned_export", R.PEOPLE + "select replace(group_name, ' ', '') as export, count(*) as n from employees group by 1")
def _(s, sf):
    path = shared_folder(s, "groups")
    WR.write_per_group(R.employees(s, sf).select("id", "group_name", "country"), path, "group_name", folder="export")
    back = s.read.option("header", True).csv(path)
    return back.groupBy("export").agg(F.count(F.lit(1)).alias("n"))


@query("sink_ctas", R.GRID + "select station_id, state, count(*) as n from grid group by all")
def _(s, sf):
    path = shared_folder(s, "grid")
    grid = WR.write_table(R.grid(s, sf).withColumn("year", F.year("day")), path, ["year"])
    return grid.where(F.col("year") == 2024).groupBy("station_id", "state").agg(F.count(F.lit(1)).alias("n"))


@query("cat_list_describe", """select (row_number() over ())::int as position, column_name as "column",
 case column_type when 'VARCHAR' then 'string' when 'INTEGER' then 'int' when 'TIMESTAMP' then 'timestamp_ntz' else lower(column_type) end as type from (describe orders)""")
def _(s, sf):
    T(s, sf, "orders").createOrReplaceTempView("orders")
    if RD.missing_tables(s, ["orders"]):
        raise RuntimeError("orders is not in the catalog")
    return RD.describe_table(s.table("orders"))


@query("mut_rename_drop_table", "select c_custkey, c_name from customer")
def _(s, sf):
    import uuid
    suffix = uuid.uuid4().hex[:12]
    old, new = f"people_{suffix}", f"data_people_{suffix}"
    folder = shared_folder(s, "table")
    s.sql(f"create table {old} using parquet location '{folder}' as select c_custkey, c_name from parquet.`{sf}/customer.parquet`")
    M.rename_table(s, old, new)
    rows = s.read.schema(s.table(new).schema).parquet(folder)  # an external table's files outlive its entry
    M.drop_table(s, new)
    if RD.missing_tables(s, [old, new]) != [old, new]:
        raise RuntimeError("the table is still in the catalog")
    return rows


@query("ts_half_hour_stream", R.GRID + "select station_id, count(*) as n_slots, min(min_bikes) as min_bikes, max(max_docks) as max_docks from slots group by 1")
def _(s, sf):
    slots = replay_half_hours(R.cleaned(s, sf), shared_folder(s, "stream"))
    return slots.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n_slots"), F.min("min_bikes").alias("min_bikes"), F.max("max_docks").alias("max_docks"))


# ---------------------------------------------------------------- stored tables
def stored_orders(s, sf) -> StoredTable:
    """Orders by year of their date, as a table that can be changed."""
    rows = T(s, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_totalprice").cast("double").alias("total"), F.year("o_orderdate").alias("year"))
    return StoredTable.create(rows, shared_folder(s, "orders"), ["year"])


STORED_SQL = "orders_of as (select o_orderkey, o_orderstatus, o_orderpriority, o_totalprice::double as total, year(o_orderdate)::int as year from orders)"


@query("mut_stored_update", f"""with {STORED_SQL} select o_orderkey, case when year = 1995 and o_orderstatus = 'F' then '0-NONE' else o_orderpriority end as o_orderpriority,
 case when year = 1993 and total > 300000 then 1994 else year end as year from orders_of""")
def _(s, sf):
    """One update inside a partition, one that moves rows to another."""
    orders = stored_orders(s, sf)
    orders.update((F.col("year") == 1995) & (F.col("o_orderstatus") == "F"), o_orderpriority="0-NONE")
    orders.update((F.col("year") == 1993) & (F.col("total") > 300_000), year=1994)
    return orders.read().select("o_orderkey", "o_orderpriority", "year")


@query("mut_stored_delete", f"with {STORED_SQL} select o_orderkey, total, year from orders_of where not (year = 1992 or year = 1996 and total < 100000)")
def _(s, sf):
    """A whole partition and a part of another one go."""
    orders = stored_orders(s, sf)
    orders.delete((F.col("year") == 1992) | (F.col("year") == 1996) & (F.col("total") < 100_000))
    return orders.read().select("o_orderkey", "total", "year")


@query("mut_stored_insert_missing", f"""with {STORED_SQL} select o_orderkey, o_orderstatus, total, year from orders_of
 union all select -1 - l_orderkey, cast(null as varchar), cast(null as double), min(year(l_shipdate))::int from lineitem group by 1""")
def _(s, sf):
    """Orders again (all there) and the orders of the lines under new keys, in the year of their first shipment."""
    orders = stored_orders(s, sf)
    orders.insert_missing(orders.read().select("o_orderkey", "year"), "o_orderkey")
    lines = T(s, sf, "lineitem").groupBy((-1 - F.col("l_orderkey")).alias("o_orderkey")).agg(F.min(F.year("l_shipdate")).alias("year"))
    orders.insert_missing(lines, "o_orderkey")
    return orders.read().select("o_orderkey", "o_orderstatus", "total", "year")
