"""Joins, aggregates, top rows and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions.maths import haversine_km, within
from loomspark.operators import aggregates as agg
from loomspark.operators import joins, reshape, sets
from loomspark.plans.base import Family, table
from loomspark.sources.sinks import ranked_lines

query = Family()
QUERIES, SQL = query.queries, query.sql
c = F.col


@query("select o_orderkey, c_name, n_name from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey")
def left_join_renamed(spark, sf):
    oc = joins.left(table(spark, sf, "orders"), table(spark, sf, "customer"), {"o_custkey": "c_custkey"})
    return joins.left(oc, table(spark, sf, "nation"), {"c_nationkey": "n_nationkey"}).select("o_orderkey", "c_name", "n_name")


@query("select o_orderkey, cast(n as bigint) as n from orders left join (select o_custkey, count(*) n from orders where o_orderstatus = 'F' group by 1) using (o_custkey)")
def left_join_shared(spark, sf):
    o = table(spark, sf, "orders")
    return joins.left(o.select("o_orderkey", "o_custkey"), agg.by(o.filter("o_orderstatus = 'F'"), ["o_custkey"], n=F.count("*")), "o_custkey").select("o_orderkey", "n")


@query("""select p_partkey, l_orderkey, l_quantity from (select p_partkey, l_orderkey, l_quantity, row_number() over (partition by p_partkey order by l_orderkey nulls last, l_quantity nulls last, l_extendedprice nulls last) n
from part left join (select l_partkey as p_partkey, cast(l_quantity as int) as p_size, l_orderkey, l_quantity, l_extendedprice from lineitem) using (p_partkey, p_size)) where n = 1""")
def left_join_multikey_dedup(spark, sf):
    li = table(spark, sf, "lineitem").select(c("l_partkey").alias("p_partkey"), c("l_quantity").cast("int").alias("p_size"), "l_orderkey", "l_quantity", "l_extendedprice")
    order = [c(x).asc_nulls_last() for x in ("l_orderkey", "l_quantity", "l_extendedprice")]
    return joins.first_match(table(spark, sf, "part").select("p_partkey", "p_size"), li, ["p_partkey", "p_size"], "p_partkey", order).select("p_partkey", "l_orderkey", "l_quantity")


@query("select n_nationkey, case when n_nationkey in (0, 5, 14) then 'A' when n_nationkey in (1, 2, 3, 5) then 'B' end as part from nation")
def lookup_list(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", joins.lookup(c("n_nationkey"), {"A": [0, 5, 14], "B": [1, 2, 3, 5]}).alias("part"))


PLACE = "(({k}) * 37 % 360 - 180)::double", "(({k}) * 17 % 170 - 85)::double"
KM = "2 * 6371.0 * asin(sqrt(pow(sin((radians({b2}) - radians({b1})) / 2), 2) + cos(radians({b1})) * cos(radians({b2})) * pow(sin((radians({a2}) - radians({a1})) / 2), 2)))"


def placed(df, key):
    return df.withColumns({"lon": (c(key) * 37 % 360 - 180).cast("double"), "lat": (c(key) * 17 % 170 - 85).cast("double")})


@query(f"""with p as (select c_custkey, {PLACE[0].format(k='c_custkey')} a1, {PLACE[1].format(k='c_custkey')} b1 from customer), q as (select {PLACE[0].format(k='n_nationkey * 3')} a2, {PLACE[1].format(k='n_nationkey * 3')} b2 from nation)
select c_custkey, cast(min(trunc({KM.format(a1='a1', b1='b1', a2='a2', b2='b2')})) as int) as km from p, q group by 1""")
def nearest_point_km(spark, sf):
    points = placed(table(spark, sf, "nation").select((c("n_nationkey") * 3).alias("k")), "k").select(c("lon").alias("plon"), c("lat").alias("plat"))
    return joins.nearest_km(placed(table(spark, sf, "customer").select("c_custkey"), "c_custkey"), points, "lon", "lat", "plon", "plat", "km").select("c_custkey", "km")


@query(f"""with p as (select c_custkey, {PLACE[0].format(k='c_custkey')} a1, {PLACE[1].format(k='c_custkey')} b1 from customer)
select c_custkey, cast(case when {KM.format(a1='2.35', b1='48.85', a2='a1', b2='b1')} > 3000 then 0 else 1 end as int) as near from p""")
def near_flag(spark, sf):
    one = spark.range(1).select(F.lit(2.35).alias("hlon"), F.lit(48.85).alias("hlat"))
    df = joins.with_scalars(placed(table(spark, sf, "customer").select("c_custkey"), "c_custkey"), one)
    return df.select("c_custkey", within(haversine_km(c("hlon"), c("hlat"), c("lon"), c("lat")), 3000.0).alias("near"))


@query("select cast(x as int) as x, cast(y as int) as y from range(-3, 4) a(x), range(0, 10, 2) b(y)")
def grid(spark, sf):
    return joins.grid(spark, (-3, 4, 1), (0, 10, 2))


# -- aggregates --------------------------------------------------------------------


@query("select l_returnflag, l_linestatus, count(*) as n, count(l_tax) as m, round(sum(l_quantity), 2) as s, round(avg(l_discount), 6) as a, round(stddev_samp(l_quantity), 6) as sd, max(l_quantity) as hi, min(l_quantity) as lo from lineitem group by 1, 2")
def group_basics(spark, sf):
    return agg.by(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], n=F.count("*"), m=F.count("l_tax"), s=F.round(F.sum("l_quantity"), 2), a=F.round(F.avg("l_discount"), 6), sd=F.round(F.stddev("l_quantity"), 6), hi=F.max("l_quantity"), lo=F.min("l_quantity"))


@query("select event_type, median(value) as med, round(avg(value), 6) as mean from events group by 1")
def group_median_mean(spark, sf):
    e = table(spark, sf, "events").select("event_type", "value")
    return agg.group_median(e, ["event_type"], "value", "med").join(agg.by(e, ["event_type"], mean=F.round(F.avg("value"), 6)), "event_type")


@query("select p_brand, round(avg(p_partkey), 6) as p_partkey, round(avg(p_size), 6) as p_size, round(avg(p_retailprice), 6) as p_retailprice from part group by 1")
def all_numeric_means(spark, sf):
    return agg.all_numeric(table(spark, sf, "part"), ["p_brand"]).select("p_brand", *[F.round(x, 6).alias(x) for x in ("p_partkey", "p_size", "p_retailprice")])


@query("select c_mktsegment, count(*) as n, round(count(*) / sum(count(*)) over (), 9)::double as share from customer group by 1")
def value_counts(spark, sf):
    return agg.value_counts(table(spark, sf, "customer"), "c_mktsegment").withColumn("share", F.round("share", 9))


def _describe(x):
    return f"select '{x}' as \"column\", count({x}) as count, round(avg({x}), 6) as mean, round(stddev_samp({x}), 6) as std, min({x})::double as min, quantile_cont({x}, 0.25)::double as q25, quantile_cont({x}, 0.5)::double as q50, quantile_cont({x}, 0.75)::double as q75, max({x})::double as max from lineitem"


@query(" union all ".join(_describe(x) for x in ("l_quantity", "l_extendedprice")))
def describe_table(spark, sf):
    out = agg.describe(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])
    return out.withColumns({x: F.round(x, 6) for x in ("mean", "std")})


PAIRS = [(a, b) for a in ("l_quantity", "l_extendedprice", "l_discount") for b in ("l_quantity", "l_extendedprice", "l_discount")]


@query(" union all ".join(f"select '{a}' as a, '{b}' as b, {'1.0::double as corr' if a == b else f'round(corr({a}, {b}), 6) as corr from lineitem'}" for a, b in PAIRS))
def corr_matrix(spark, sf):
    return agg.correlations(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("corr", F.round("corr", 6))


@query("select distinct o_orderpriority from orders")
def distinct_sorted(spark, sf):
    return table(spark, sf, "orders").select("o_orderpriority").distinct().orderBy("o_orderpriority")


@query("select event_id, user_id from (select *, row_number() over (partition by user_id order by ts, event_id) n from events) where n = 1")
def dedup_first(spark, sf):
    return agg.keep_first(table(spark, sf, "events"), ["user_id"], [c("ts"), c("event_id")]).select("event_id", "user_id")


@query("select event_id, user_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) n from events) where n = 1")
def dedup_last(spark, sf):
    return agg.keep_first(table(spark, sf, "events"), ["user_id"], [c("ts").desc(), c("event_id").desc()]).select("event_id", "user_id")


@query("select user_id, event_type from (select user_id, event_type, row_number() over (partition by user_id order by count(*) desc, event_type) n from events group by 1, 2) where n = 1")
def majority_label(spark, sf):
    return agg.majority(table(spark, sf, "events"), ["user_id"], "event_type")


@query("select quality, toxic, count(*) as n from labels group by 1, 2")
def confusion(spark, sf):
    return agg.confusion(table(spark, sf, "labels"), "quality", "toxic")


@query("select cast(floor(value / 5) as bigint) as bin, count(*) as n from events group by 1")
def hist_fixed_width(spark, sf):
    return agg.histogram_width(table(spark, sf, "events"), "value", 5)


@query("select cast(least(49, floor((value - lo) / (hi - lo) * 50)) as int) as bin, count(*) as n from events, (select min(value) lo, max(value) hi from events) group by 1")
def hist_n_bins(spark, sf):
    return agg.histogram_bins(table(spark, sf, "events"), "value", 50)


@query("select cast(h as int) as hour, coalesce(n, 0)::bigint as n from range(24) r(h) left join (select hour(ts) hh, count(*) n from events where event_type = 'purchase' group by 1) on h = hh")
def zero_filled_hours(spark, sf):
    return agg.zero_filled(table(spark, sf, "events").filter("event_type = 'purchase'"), F.hour("ts"), 24, "hour")


@query("select c_mktsegment, min(c_acctbal) as low, round(quantile_cont(c_acctbal, 0.25), 6) as q1, round(quantile_cont(c_acctbal, 0.5), 6) as q2, round(quantile_cont(c_acctbal, 0.75), 6) as q3, max(c_acctbal) as high from customer group by 1")
def box_summary(spark, sf):
    return agg.box_summary(table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal").withColumns({q: F.round(q, 6) for q in ("q1", "q2", "q3")})


@query("select y, o_orderpriority, n, round(n::double / sum(n) over (partition by y) * 100, 2) as pct from (select cast(year(o_orderdate) as int) y, o_orderpriority, count(*) n from orders group by 1, 2)")
def yearly_share_pct(spark, sf):
    return agg.share_of(table(spark, sf, "orders").withColumn("y", F.year("o_orderdate")), ["y", "o_orderpriority"], ["y"])


@query("select lang, count(toxic) as n, cast(sum(toxic) as bigint) as hits, cast(count(toxic) - sum(toxic) as bigint) as misses, sum(toxic) * 100.0::double / count(toxic) as pct from documents join labels using (doc_id) group by 1")
def success_rate(spark, sf):
    both = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    return agg.success_rate(both, ["lang"], "toxic")


@query("""select a.c_mktsegment, round(abs(w - m) / m * 100, 2) as gap from (select c_mktsegment, avg(case when c_nationkey < 12 then c_acctbal end) w, avg(case when c_nationkey >= 12 then c_acctbal end) m from customer group by 1) a""")
def paired_gap_pct(spark, sf):
    t = table(spark, sf, "customer")
    pair = agg.by(t, ["c_mktsegment"], w=F.avg(F.when(c("c_nationkey") < 12, c("c_acctbal"))), m=F.avg(F.when(c("c_nationkey") >= 12, c("c_acctbal"))))
    return pair.select("c_mktsegment", agg.gap_pct(c("w"), c("m")).alias("gap"))


@query("""select r_name as name, to_json(list({'name': n_name} order by n_name))::varchar as children from region join nation on r_regionkey = n_regionkey group by 1""")
def nested_tree_json(spark, sf):
    both = table(spark, sf, "region").join(table(spark, sf, "nation"), c("r_regionkey") == c("n_regionkey"))
    return both.groupBy(c("r_name").alias("name")).agg(F.to_json(F.array_sort(F.collect_list(F.struct(c("n_name").alias("name"))))).alias("children"))


@query("""with l as (select r_name, n_name, list({'s_suppkey': s_suppkey, 's_name': s_name} order by s_suppkey) as children from region join nation on r_regionkey = n_regionkey join supplier on s_nationkey = n_nationkey group by 1, 2)
select to_json({'r_name': r_name, 'children': list({'name': n_name, 'children': children} order by n_name)})::varchar as tree from l group by r_name""")
def nested_tree_levels(spark, sf):
    both = table(spark, sf, "region").join(table(spark, sf, "nation"), c("r_regionkey") == c("n_regionkey")).join(table(spark, sf, "supplier"), c("n_nationkey") == c("s_nationkey"))
    tree = agg.tree(both, "r_name", "n_name", ["s_suppkey", "s_name"], "s_suppkey")
    return tree.select(F.to_json(F.struct("r_name", "children")).alias("tree"))


@query("select c_nationkey, round(avg(p - t), 6) as me from (select c_nationkey, c_acctbal t, c_acctbal * 0.9 p from customer) group by 1")
def grouped_error(spark, sf):
    return agg.by(table(spark, sf, "customer"), ["c_nationkey"], me=F.round(F.avg(c("c_acctbal") * 0.9 - c("c_acctbal")), 6))


@query("select round(avg(pow(t - p, 2)), 4) as mse, round(sqrt(avg(pow(t - p, 2))), 4) as rmse, round(avg(abs(t - p)), 4) as mae, round(1 - avg(pow(t - p, 2)) / var_pop(t), 6) as r2 from (select l_extendedprice t, l_quantity * 1500 p from lineitem)")
def rmse_r2(spark, sf):
    out = agg.errors(table(spark, sf, "lineitem").withColumn("p", c("l_quantity") * 1500), "l_extendedprice", "p")
    return out.select(*[F.round(x, 6 if x == "r2" else 4).alias(x) for x in out.columns])


# -- top rows ----------------------------------------------------------------------


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def topk_orders(spark, sf):
    return sets.top(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 20, c("o_totalprice").desc(), c("o_orderkey"))


@query("select l_partkey, count(*) as n from lineitem group by 1 order by n desc, l_partkey limit 10")
def topk_groups(spark, sf):
    return sets.top(agg.by(table(spark, sf, "lineitem"), ["l_partkey"], n=F.count("*")), 10, c("n").desc(), c("l_partkey"))


@query("select c_nationkey, c_custkey from (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) n from customer) where n <= 3")
def topk_in_group(spark, sf):
    return sets.top_in_group(table(spark, sf, "customer"), 3, ["c_nationkey"], c("c_acctbal").desc(), c("c_custkey")).select("c_nationkey", "c_custkey")


@query("select n_name, cast(row_number() over (order by b desc, n_name) - 1 as bigint) as pos from (select n_name, round(sum(c_acctbal), 2) b from customer join nation on c_nationkey = n_nationkey group by 1)")
def positional_rank(spark, sf):
    both = table(spark, sf, "customer").join(table(spark, sf, "nation"), c("c_nationkey") == c("n_nationkey"))
    return sets.positions(agg.by(both, ["n_name"], b=F.round(F.sum("c_acctbal"), 2)), "pos", c("b").desc(), c("n_name")).select("n_name", "pos")


@query("select cast(row_number() over (order by n desc, l_shipmode) - 1 as int) as rank, (row_number() over (order by n desc, l_shipmode) - 1) || '. ' || l_shipmode || ' - ' || n as line from (select l_returnflag || l_linestatus as l_shipmode, count(*) n from lineitem group by 1)")
def ranked_report(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("name")).agg(F.count("*").alias("n"))
    return ranked_lines(counts, "name", "n")


@query("select c_custkey, c_acctbal from customer where c_custkey < 25")
def head_by_id(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal").filter("c_custkey < 25")


# -- reshape -----------------------------------------------------------------------


@query("select c_custkey, cast(s as int) as s, cast(p as int) as p, v from customer, lateral (values (1, 4, c_acctbal), (2, 3, c_acctbal * 2), (1, 2, c_nationkey::double)) t(s, p, v)")
def unpivot_long(spark, sf):
    wide = table(spark, sf, "customer").select("c_custkey", c("c_acctbal").alias("a"), (c("c_acctbal") * 2).alias("b"), c("c_nationkey").cast("double").alias("d"))
    return reshape.unpivot(wide, ["c_custkey"], {"a": (1, 4), "b": (2, 3), "d": (1, 2)}, ["s", "p"], "v")


@query("select c_custkey, cast(dense_rank() over (order by c_mktsegment) - 1 as int) as code from customer")
def label_encode(spark, sf):
    return reshape.label_encode(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "code").drop("c_mktsegment")


@query("select o_orderkey, cast(o_orderstatus = 'F' as int) as \"o_orderstatus_F\", cast(o_orderstatus = 'O' as int) as \"o_orderstatus_O\", cast(o_orderstatus = 'P' as int) as \"o_orderstatus_P\" from orders")
def one_hot(spark, sf):
    return reshape.one_hot_columns(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"]).drop("o_orderstatus")


@query("select o_orderkey, cast(dense_rank() over (order by o_orderpriority) - 1 as int) as o_orderpriority_code from orders")
def categorical_encoder(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return reshape.CategoricalEncoder(["o_orderpriority"], "ordinal").fit(o).transform(o).drop("o_orderpriority")


@query("select p_partkey, p_size::double * p_size as \"p_size_x_p_size\", p_size::double * p_retailprice as \"p_size_x_p_retailprice\", p_retailprice * p_retailprice as \"p_retailprice_x_p_retailprice\" from part")
def poly_features(spark, sf):
    return reshape.polynomial(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], 2).drop("p_size", "p_retailprice")


@query("select c_custkey, round((c_acctbal - avg(c_acctbal) over ()) / stddev_pop(c_acctbal) over (), 6) as c_acctbal from customer")
def standard_scale(spark, sf):
    t = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return reshape.StandardScaler(["c_acctbal"]).fit(t).transform(t).withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("select p_partkey, p_retailprice / nullif(p_size, 0) as per_size, p_size / nullif(p_retailprice, 0) as per_price from part")
def ratio_features(spark, sf):
    t = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return reshape.RatioAdder({"per_size": ("p_retailprice", "p_size"), "per_price": ("p_size", "p_retailprice")}).transform(t).drop("p_size", "p_retailprice")


# -- further shapes ----------------------------------------------------------------


@query("select r_name as field, max(case when n = 0 then v end) as \"0\", max(case when n = 1 then v end) as \"1\", max(case when n = 2 then v end) as \"2\" from (select 'n_name' as r_name, n_nationkey as n, n_name as v from nation union all select 'n_regionkey', n_nationkey, n_regionkey::varchar from nation) group by 1")
def transposed_rows(spark, sf):
    rows = table(spark, sf, "nation").select(c("n_nationkey").cast("string").alias("n"), "n_name", "n_regionkey")
    return reshape.transposed(rows, "n").select("field", "0", "1", "2")


@query("select p_partkey, round((p_size - avg(p_size) over ()) / stddev_pop(p_size) over (), 6) as scaled, cast(p_brand = 'Brand#11' as double) as is_11, cast(dense_rank() over (order by p_brand) - 1 as double) as brand from part")
def feature_union(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    t = table(spark, sf, "part").select("p_partkey", "p_size", "p_brand").withColumn("size", c("p_size").cast("double"))
    numbers = Pipeline(stages=[VectorAssembler(inputCols=["size"], outputCol="sizes"), StandardScaler(inputCol="sizes", outputCol="scaled", withMean=True)]).fit(t)
    names = Pipeline(stages=[StringIndexer(inputCol="p_brand", outputCol="brand", stringOrderType="alphabetAsc"), SQLTransformer(statement="select *, cast(p_brand = 'Brand#11' as double) as is_11 from __THIS__")]).fit(t)
    n = t.count()
    both = reshape.FeatureUnion([numbers, names], keep=["p_partkey"]).transform(t)
    # the library divides by the sample's deviation
    return both.select("p_partkey", F.round(vector_to_array("scaled")[0] * (n / (n - 1)) ** 0.5, 6).alias("scaled"), "is_11", "brand")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 1 offset 7")
def nth_row(spark, sf):
    return sets.nth(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 7, c("o_totalprice").desc(), c("o_orderkey"))


@query("select c_custkey, c_nationkey, case when c_custkey % 2 = 0 then c_acctbal end as even_balance from customer")
def aligned_column(spark, sf):
    t = table(spark, sf, "customer")
    return joins.aligned(t.select("c_custkey", "c_nationkey"), t.filter("c_custkey % 2 = 0"), "c_custkey", "c_acctbal", "even_balance")


@query("""select coalesce(a.p, b.p) as position, a.c_name as a, b.s_name as b from (select row_number() over (order by c_custkey) - 1 as p, c_name from customer) a full join (select row_number() over (order by s_suppkey) - 1 as p, s_name from supplier) b on a.p = b.p""")
def aligned_positions(spark, sf):
    frames = {"a": table(spark, sf, "customer").select(c("c_custkey").alias("k"), c("c_name").alias("v")), "b": table(spark, sf, "supplier").select(c("s_suppkey").alias("k"), c("s_name").alias("v"))}
    return joins.by_position(frames, "k", "v").withColumn("position", c("position").cast("long"))


@query("select c_custkey as k, c_acctbal * 2 as twice, 'customer' as origin from customer union all select s_suppkey, s_acctbal * 2, 'supplier' from supplier")
def frames_in_step(spark, sf):
    frames = [table(spark, sf, n).select(c(k).alias("k"), c(v).alias("v"), F.lit(n).alias("origin")) for n, k, v in (("customer", "c_custkey", "c_acctbal"), ("supplier", "s_suppkey", "s_acctbal"))]
    a, b = joins.each(frames, lambda df: df.select("k", (c("v") * 2).alias("twice"), "origin"))
    return a.union(b)


@query("select n_regionkey, cast(count(*) as int) as n, string_agg(n_nationkey || '=' || n_name, ';' order by n_nationkey) as pairs from nation group by 1")
def pairs_as_map(spark, sf):
    made = agg.pairs_to_map(table(spark, sf, "nation"), ["n_regionkey"], "n_nationkey", "n_name")
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("map")), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"])), ";")
    return made.select("n_regionkey", F.size("map").alias("n"), shown.alias("pairs"))


@query("select p_partkey, p_size from part")
def selected_columns(spark, sf):
    return reshape.ColumnSelector(["p_partkey", "p_size"]).transform(table(spark, sf, "part"))
