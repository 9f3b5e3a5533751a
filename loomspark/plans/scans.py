"""Sources and sinks: driver tables go out through a sink, come back through a source, and are held against themselves."""

from __future__ import annotations

import tarfile
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import functions as F

from loomspark.functions import strings
from loomspark.functions.vectors import argmax
from loomspark.operators.features import FeatureSpec, saved_feature
from loomspark.plans.base import Family, table
from loomspark.sources import readers, sinks
from loomspark.storage import shared_folder

query = Family()
QUERIES, SQL = query.queries, query.sql
c = F.col


def written(spark, df, **options) -> str:
    path = shared_folder(spark)
    sinks.csv(df, path, **options)
    return path


@query("select cast(c_custkey as int) as c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def csv_inferred(spark, sf):
    return readers.csv(spark, written(spark, table(spark, sf, "customer")))


@query("select o_orderkey, o_totalprice, o_orderpriority from orders")
def csv_declared(spark, sf):
    path = written(spark, table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), sep=";")
    return readers.csv(spark, path, schema="o_orderkey long, o_totalprice double, o_orderpriority string", sep=";")


@query("select p_partkey, p_name, p_size::varchar as p_size, p_retailprice from part")
def csv_partial_types(spark, sf):
    path = written(spark, table(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"))
    return readers.csv(spark, path, types={"p_partkey": "long", "p_retailprice": "double", "nothing": "int"})


@query("select s_name, s_suppkey from supplier")
def csv_columns(spark, sf):
    return readers.csv(spark, written(spark, table(spark, sf, "supplier")), types={"s_suppkey": "long"}, columns=["s_name", "s_suppkey"])


@query("select event_id, cast(floor(epoch(ts)) as bigint) as seconds from events")
def csv_timestamps(spark, sf):
    path = written(spark, table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts")))
    return readers.csv(spark, path, types={"event_id": "long"}, timestamps=["ts", "nothing"]).select("event_id", F.unix_timestamp("ts").alias("seconds"))


@query("select n_nationkey, n_name from nation order by n_nationkey limit 9 offset 5")
def csv_row_range(spark, sf):
    path = written(spark, table(spark, sf, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey"), files=1)
    return readers.csv_range(spark, path, "n_nationkey int, n_name string", 5, 9)


@query("select c_custkey, c_acctbal, case c_custkey % 3 when 0 then 'a' when 1 then 'b' else 'd' end as model from customer")
def csv_many_files(spark, sf):
    t = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    paths = {n: written(spark, t.filter(c("c_custkey") % 3 == i)) for i, n in enumerate("abd")}
    return readers.many_csv(spark, paths, types={"c_custkey": "long", "c_acctbal": "double"})


@query("select event_id, printf('%.9f', value) as value, printf('%.2f', value) as short from events")
def csv_fixed_floats(spark, sf):
    t = table(spark, sf, "events").select("event_id", "value", c("value").alias("short"))
    return readers.csv(spark, written(spark, t, digits={"value": 9, "short": 2}), schema="event_id long, value string, short string")


@query("select l_orderkey, l_partkey, l_quantity from lineitem")
def keyed_store(spark, sf):
    root = shared_folder(spark)
    for key, df in (("train", table(spark, sf, "orders")), ("rows", table(spark, sf, "orders")), ("rows", table(spark, sf, "lineitem"))):
        sinks.keyed(df, root, key)  # the second table of a key takes the first one's place
    return readers.keyed(spark, root, "rows", ["l_orderkey", "l_partkey", "l_quantity"])


@query("select event_id, cast(count(*) over (partition by user_id) as bigint) as user_idcount from events")
def remembered_feature(spark, sf):
    root, e, spec = shared_folder(spark), table(spark, sf, "events").select("event_id", "user_id", "ts"), FeatureSpec("count", ("user_id",))
    saved_feature(e, spec, root)
    return saved_feature(e.limit(0), spec, root)  # read from the store, not made again


@query("select event_id, cast(count(distinct event_type) over (partition by user_id) as bigint) as user_id_by_event_type_countuniq from events")
def written_feature(spark, sf):
    from loomspark.operators.features import add_feature

    root, (df, name) = shared_folder(spark), add_feature(table(spark, sf, "events"), FeatureSpec("nunique", ("user_id",), "event_type"))
    sinks.feature(df, "event_id", name, root)
    return readers.keyed(spark, root, name)


@query("select n_nationkey::varchar as id, n_name as title from nation")
def json_array_scan(spark, sf):
    items = table(spark, sf, "nation").agg(F.collect_list(F.struct(c("n_nationkey").cast("string").alias("id"), F.struct(c("n_name").alias("title")).alias("snippet"))).alias("items"))
    path = shared_folder(spark)
    sinks.json_lines(items, path)
    return readers.json_items(spark, path).select("id", c("snippet.title").alias("title"))


@query("select r_name as name, cast(count(*) as bigint) as n from region join nation on r_regionkey = n_regionkey group by 1")
def json_tree_write(spark, sf):
    both = table(spark, sf, "region").join(table(spark, sf, "nation"), c("r_regionkey") == c("n_regionkey"))
    path = shared_folder(spark)
    sinks.json_lines(both.groupBy(c("r_name").alias("name")).agg(F.collect_list(F.struct(c("n_name").alias("name"))).alias("children")), path)
    return spark.read.schema("name string, children array<struct<name: string>>").json(path).select("name", F.size("children").cast("long").alias("n"))


@query("select n_nationkey::varchar as code, '{\"type\":\"Point\",\"coordinates\":[' || n_nationkey * 3 || ',' || n_regionkey || ']}' as geometry from nation")
def geojson_scan(spark, sf):
    point = F.struct(F.lit("Point").alias("type"), F.array(c("n_nationkey") * 3, c("n_regionkey")).alias("coordinates"))
    one = F.struct(F.lit("Feature").alias("type"), F.struct(c("n_nationkey").cast("string").alias("code")).alias("properties"), point.alias("geometry"))
    path = shared_folder(spark)
    sinks.json_lines(table(spark, sf, "nation").agg(F.lit("FeatureCollection").alias("type"), F.collect_list(one).alias("features")), path)
    found = readers.geojson(spark, path)
    kind, at = F.get_json_object("geometry", "$.type"), F.get_json_object("geometry", "$.coordinates")
    return found.select("code", F.format_string('{"type":"%s","coordinates":%s}', kind, at).alias("geometry"))


@query("select n_nationkey, n_name from nation")
def fetched_archive(spark, sf):
    """A table as CSV in an archive that is fetched by its address, unpacked and scanned; the folder is one that this machine sees."""
    folder = Path(urlparse(shared_folder(spark)).path)
    folder.mkdir(parents=True)
    rows = table(spark, sf, "nation").select("n_nationkey", "n_name").collect()  # the smallest table
    Path(folder, "nation.csv").write_text("n_nationkey,n_name\n" + "".join(f"{r.n_nationkey},{r.n_name}\n" for r in rows))
    with tarfile.open(folder / "served.tgz", "w:gz") as tar:
        tar.add(folder / "nation.csv", "data/nation.csv")
    archive = readers.fetch((folder / "served.tgz").as_uri(), str(folder / "fetched"))
    names = readers.unpack(archive, str(folder / "unpacked"))
    return readers.csv(spark, f"file://{names[0]}", schema="n_nationkey int, n_name string")


@query("select vec_id, label, cast(label as int) as hot, round(embedding[1]::double, 6) as first from embeddings")
def labelled_images(spark, sf):
    wide = table(spark, sf, "embeddings").select("vec_id", "label", *[c("embedding")[i].alias(f"p{i}") for i in range(4)])
    made = readers.labelled_images(wide, "label", 10)
    return made.select(c("image")[0].cast("long").alias("vec_id"), "label", argmax(c("one_hot")).alias("hot"), F.round(c("image")[1], 6).alias("first"))


@query("select * from (values (1, 'a', 2.5), (2, 'b', null), (3, null, 4.0)) t(id, name, value)")
def frame_of_records(spark, sf):
    rows = [{"id": 1, "name": "a", "value": 2.5}, {"id": 2, "name": "b"}, {"id": 3, "value": 4.0}]
    return readers.records(spark, rows, "id int, name string, value double").withColumn("value", c("value").cast("decimal(2,1)"))


@query("select count(*) as n, 5::bigint as fields, (select string_agg(o_orderkey::varchar, ',' order by o_orderkey) from (select o_orderkey from orders order by o_orderkey limit 5)) as head from orders")
def previewed(spark, sf):
    t = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    seen = sinks.preview(t.orderBy("o_orderkey"))
    return spark.createDataFrame([(seen["rows"], len(seen["columns"]), ",".join(str(r.o_orderkey) for r in seen["head"]))], "n long, fields long, head string")


@query("""select '<h2>Nations &amp; keys</h2><table><tr><th>n_nationkey</th><th>n_name</th></tr>' || string_agg('<tr><td>' || n_nationkey || '</td><td>' || n_name || '</td></tr>', '' order by n_nationkey) || '</table>' as page
from (select * from nation order by n_nationkey limit 10)""")
def html_report(spark, sf):
    rows = table(spark, sf, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey")
    return spark.createDataFrame([(sinks.html_table(rows, "Nations & keys", 10),)], "page string")


@query("select cast(row_number() over (order by n_name) - 1 as bigint) as row_id, n_name from nation")
def numbered_rows(spark, sf):
    return readers.numbered(table(spark, sf, "nation").select("n_name").orderBy("n_name")).select("row_id", "n_name")


@query("select o_orderkey, '$' || printf('%.2f', o_totalprice) as shown, replace(printf('%.2f', o_totalprice), '.', ',') as comma, round(o_totalprice, 2) as back from orders")
def literal_replaced(spark, sf):
    shown = strings.fixed_format(c("o_totalprice"), 2)
    t = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("$"), shown).alias("shown"), F.replace(shown, F.lit("."), F.lit(",")).alias("comma"))
    return t.withColumn("back", F.round(strings.decimal_comma(c("comma")), 2))

