"""Columns: predicates, nulls, casts, strings, dates, bins, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import dates, maths, strings
from loomspark.operators import columns as col
from loomspark.operators import sampling
from loomspark.plans.base import Family, table

query = Family()
QUERIES, SQL = query.queries, query.sql
c = F.col


@query("select c_custkey, c_name, cast(null as varchar) as phone from customer")
def project_missing(spark, sf):
    return col.project(table(spark, sf, "customer"), ["c_custkey", "c_name", "phone"])


@query("select p_partkey, p_brand, p_size from part")
def project_positions(spark, sf):
    return col.at_positions(table(spark, sf, "part"), picks=[0, 2, 4])


@query("select c_custkey, c_name as name, c_acctbal * 2 as twice, c_mktsegment as segment from customer")
def rename_insert(spark, sf):
    df = col.rename(table(spark, sf, "customer").drop("c_nationkey"), {"c_name": "name", "c_mktsegment": "segment", "nothing": "x"})
    return col.insert_at(df, 2, "twice", c("c_acctbal") * 2).drop("c_acctbal")


@query("select o_orderkey, o_totalprice / nullif(extract(day from o_orderdate) - 1, 0) as per_day, cast(trunc(o_totalprice) as bigint) as whole from orders")
def derived_ratio(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", maths.ratio(c("o_totalprice"), F.dayofmonth("o_orderdate") - 1).alias("per_day"), c("o_totalprice").cast("long").alias("whole"))


@query("select c_custkey, c_acctbal, c_nationkey from customer where c_acctbal > 0 and c_acctbal < 5000 and c_nationkey > 3 and c_nationkey < 20")
def box_filter(spark, sf):
    return col.in_box(table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), c_acctbal=(0, 5000), c_nationkey=(3, 20))


@query("select c.c_custkey, s.s_suppkey from customer c join supplier s on c.c_custkey = s.s_suppkey where c.c_nationkey = s.s_nationkey")
def equal_columns(spark, sf):
    both = table(spark, sf, "customer").join(table(spark, sf, "supplier"), c("c_custkey") == c("s_suppkey"))
    return col.same(both, "c_nationkey", "s_nationkey").select("c_custkey", "s_suppkey")


@query("select o_orderkey, o_orderpriority from orders where o_orderpriority in ('1-URGENT', '2-HIGH')")
def membership(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderpriority").filter(c("o_orderpriority").isin("1-URGENT", "2-HIGH"))


@query("select p_partkey, cast(substr(p_brand, 7) as int) as brand_no from part where regexp_matches(substr(p_brand, 7), '^[0-9]+$')")
def digits_only(spark, sf):
    return table(spark, sf, "part").withColumn("d", F.substring("p_brand", 7, 100)).filter(strings.is_digits(c("d"))).select("p_partkey", c("d").cast("int").alias("brand_no"))


NULLED = "select event_id, nullif(event_type, 'click') as event_type, case when event_id % 7 = 0 then null else value end as value from events"


def nulled(spark, sf):
    return table(spark, sf, "events").select("event_id", F.nullif("event_type", F.lit("click")).alias("event_type"), F.when(c("event_id") % 7 != 0, c("value")).alias("value"))


@query(f"select event_id, event_type, value from ({NULLED}) where value is not null and event_type is not null")
def drop_nulls(spark, sf):
    return nulled(spark, sf).dropna("any")


@query(f"select event_id, event_type, value from ({NULLED}) where event_type is null or event_type <> 'view'")
def drop_mask(spark, sf):
    return col.without(nulled(spark, sf), c("event_type") == "view")


@query(f"select event_id, coalesce(event_type, 'S') as event_type, coalesce(value, 0) as value from ({NULLED})")
def fill_const(spark, sf):
    return nulled(spark, sf).fillna({"event_type": "S", "value": 0.0})


@query(f"select event_id, coalesce(value, (select median(value) from events where event_id % 2 = 0)) as value from ({NULLED})")
def fill_median(spark, sf):
    fit = table(spark, sf, "events").filter("event_id % 2 = 0")
    return col.fill_statistic(nulled(spark, sf).select("event_id", "value"), "value", fit)


@query("with o as (select o_orderkey, nullif(o_orderstatus, 'P') s, case when o_orderkey % 5 = 0 then null else o_totalprice end o_totalprice from orders) select o_orderkey, round(coalesce(o_totalprice, (select median(o_totalprice) from o)), 6) as o_totalprice from o")
def median_imputer(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.when(c("o_orderkey") % 5 != 0, c("o_totalprice")).alias("o_totalprice"))
    return col.MedianImputer(["o_totalprice"]).fit(df).transform(df).withColumn("o_totalprice", F.round("o_totalprice", 6))


def uniform(key: str, seed: int) -> str:
    return f"cast('0x' || left(md5({key}::varchar || ':{seed}'), 12) as bigint) / {float(1 << 48)}"


@query(f"with n as ({NULLED}), s as (select avg(value) - stddev_samp(value) as lo, avg(value) + stddev_samp(value) as hi from n) select event_id, coalesce(trunc(value), floor(lo + {uniform('event_id', 3)} * (hi - lo)))::bigint as value from n, s")
def fill_random(spark, sf):
    return col.fill_random(nulled(spark, sf).select("event_id", "value"), "value", "event_id", seed=3)


@query(f"""with n as ({NULLED}) select 'event_id' as "column", count(event_id) as present, count(*) - count(event_id) as missing from n
union all select 'event_type', count(event_type), count(*) - count(event_type) from n union all select 'value', count(value), count(*) - count(value) from n""")
def null_profile(spark, sf):
    return col.null_profile(nulled(spark, sf))


@query("select o_orderkey, cast(case o_orderstatus when 'O' then 0 when 'F' then 1 end as int) as code, case when o_orderpriority in ('4-NOT SPECIFIED', '5-LOW') then 'Rare' else o_orderpriority end as priority from orders")
def map_replace(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", col.mapped(c("o_orderstatus"), {"O": 0, "F": 1}).alias("code"), col.replace_values(c("o_orderpriority"), ["4-NOT SPECIFIED", "5-LOW"], "Rare").alias("priority"))


@query("select event_id, least(ceil(value / 1.5), 5.0) as capped, least(greatest(value, 1.0), 3.0) as clipped from events")
def clip_where(spark, sf):
    return table(spark, sf, "events").select("event_id", F.least(F.ceil(c("value") / 1.5).cast("double"), F.lit(5.0)).alias("capped"), maths.clip(c("value"), 1.0, 3.0).alias("clipped"))


# -- strings ---------------------------------------------------------------------


@query("select p_partkey, substr(p_name, 2, length(p_name) - 2) as inner_name, left(p_name, length(p_name) - 3) as cut, length(p_name) = 11 as eleven from part")
def slice_ends(spark, sf):
    n = c("p_name")
    return table(spark, sf, "part").select("p_partkey", strings.slice_ends(n).alias("inner_name"), strings.strip_suffix(n, 3).alias("cut"), strings.has_length(n, 11).alias("eleven"))


@query(r"select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')[1] as first, cast(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) as int) as n from documents")
def tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", strings.first_token(c("text")).alias("first"), strings.token_count(c("text")).alias("n"))


@query(r"select doc_id, cast(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w = upper(w) and w <> lower(w))) as int) as n from documents")
def allcaps_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", strings.all_caps_words(c("text")).alias("n"))


@query("select doc_id, regexp_extract(text, ' ([A-Za-z]+)\\.', 1) as token from documents")
def regex_token(spark, sf):
    return table(spark, sf, "documents").select("doc_id", strings.title_of(c("text")).alias("token"))


@query("select doc_id, case when length(text) <= 40 then text else left(text, 37) || '...' end as short from documents")
def ellipsis(spark, sf):
    return table(spark, sf, "documents").select("doc_id", strings.ellipsis(c("text"), 40, 37).alias("short"))


@query("select c_custkey, round(c_acctbal, 2) as amount from customer")
def money_strip(spark, sf):
    shown = F.concat(F.lit("$"), F.format_number("c_acctbal", 2))
    return table(spark, sf, "customer").select("c_custkey", F.round(strings.strip_money(shown), 2).alias("amount"))


@query("select p_partkey, cast(case p_size % 3 when 0 then p_size * 1e6 when 1 then p_size * 1e3 else p_size end as double) as amount from part")
def money_suffix(spark, sf):
    mark = F.when(c("p_size") % 3 == 0, "M").when(c("p_size") % 3 == 1, "K").otherwise("")
    shown = F.concat(F.lit("€"), c("p_size").cast("string"), mark)
    return table(spark, sf, "part").select("p_partkey", strings.suffixed_amount(shown).alias("amount"))


@query("select p_partkey, case when p_size % 4 = 0 then 480000 else cast(p_size as bigint) * (p_size + 1) end as n from part")
def pixels(spark, sf):
    shown = F.when(c("p_size") % 4 != 0, F.concat_ws(" x ", c("p_size").cast("string"), (c("p_size") + 1).cast("string")))
    return table(spark, sf, "part").select("p_partkey", strings.pixels(shown).alias("n"))


@query("select c_custkey, printf('%.3f', c_acctbal) as shown from customer")
def fixed_format(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", strings.fixed_format(c("c_acctbal"), 3).alias("shown"))


@query("select event_id, json_extract_string(props, '$.k') as k from events")
def json_field(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


# -- dates -----------------------------------------------------------------------


@query("select o_orderkey, round(year(o_orderdate) + month(o_orderdate) / 12.0, 6)::double as y, cast(isodow(o_orderdate) - 1 as int) as d, cast(case when day(o_orderdate) = 1 then -1 else isodow(o_orderdate) - 1 end as int) as h, cast(year(o_orderdate) as int) as yy, cast(month(o_orderdate) as int) as mm from orders")
def date_parts(spark, sf):
    d = c("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", F.round(dates.fractional_year(d), 6).alias("y"), dates.weekday(d).alias("d"), dates.weekday(d, F.dayofmonth(d) == 1).alias("h"), F.year(d).alias("yy"), F.month(d).alias("mm"))


@query("select l_orderkey, l_partkey, cast(date_diff('day', o_orderdate, l_shipdate) as int) as days from lineitem join orders on l_orderkey = o_orderkey")
def day_diff(spark, sf):
    both = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), c("l_orderkey") == c("o_orderkey"))
    return both.select("l_orderkey", "l_partkey", dates.days_between(c("l_shipdate"), c("o_orderdate")).alias("days"))


@query("select event_id, cast(floor(epoch(ts)) as bigint) as s, strftime(ts, '%H:%M:%S') as t, cast(ts as date) as day from events")
def timestamps(spark, sf):
    return table(spark, sf, "events").select("event_id", dates.epoch_seconds(c("ts")).alias("s"), dates.time_of_day(c("ts")).alias("t"), F.to_date("ts").alias("day"))


@query("select o_orderkey, cast(o_orderdate as date) as a, cast(o_orderdate as date) as b from orders")
def parsed_dates(spark, sf):
    d = c("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", dates.day_month_name(F.date_format(d, "dd-MMM-yyyy")).alias("a"), dates.year_day_month(F.date_format(d, "yy.dd.MM")).alias("b"))


# -- bins and maths ----------------------------------------------------------------


@query("select event_id, round(ln(1 + value), 9) as l, round(ln(p / (1 - p)), 9) as g from (select event_id, value, least(greatest(value / 1000, 1e-10), 1 - 1e-10) p from events)")
def logs(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(maths.log1p(c("value")), 9).alias("l"), F.round(maths.logit(c("value") / 1000), 9).alias("g"))


@query("select event_id, cast(greatest(1, least(5, ceil((value - lo) / ((hi - lo) / 5)))) as int) as bin from events, (select min(value) lo, max(value) hi from events)")
def cut_equal(spark, sf):
    return maths.cut_equal(table(spark, sf, "events").select("event_id", "value"), "value", 5, "bin").drop("value")


@query("select event_id, cast(case when value <= q[1] then 1 when value <= q[2] then 2 when value <= q[3] then 3 else 4 end as int) as bin from events, (select quantile_cont(value, [0.25, 0.5, 0.75]) q from events)")
def qcut4(spark, sf):
    return maths.cut_quantiles(table(spark, sf, "events").select("event_id", "value"), "value", 4, "bin").drop("value")


@query("select event_id, cast(case when value >= 0 then floor(value / (mx + 1) * 10) end as int) as bucket, cast(value > m as int) as over from events, (select max(value) mx, avg(value) m from events)")
def bucket10(spark, sf):
    e = maths.over_mean(table(spark, sf, "events").select("event_id", "value"), "value", "over")
    return e.crossJoin(F.broadcast(e.agg(F.max("value").alias("mx")))).select("event_id", maths.ten_buckets(c("value"), c("mx")).alias("bucket"), "over")


@query("select event_id, cast(case when value <= 7.91 then 0 when value <= 14.454 then 1 when value <= 31 then 2 else 3 end as int) as bin from events")
def threshold_bins(spark, sf):
    return table(spark, sf, "events").select("event_id", maths.threshold_bins(c("value"), (7.91, 14.454, 31.0)).alias("bin"))


# -- splits ----------------------------------------------------------------------


@query("""with x as (select o_orderkey, lpad(to_hex(o_orderkey), 16, '0') h from orders)
select o_orderkey, cast(('0x' || right(md5(unhex(substr(h,15,2)||substr(h,13,2)||substr(h,11,2)||substr(h,9,2)||substr(h,7,2)||substr(h,5,2)||substr(h,3,2)||substr(h,1,2))), 2)) as int) < 256 * 0.2 as in_test from x""")
def hash_split(spark, sf):
    rest, test = sampling.by_hash(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.2)
    return rest.withColumn("in_test", F.lit(False)).union(test.withColumn("in_test", F.lit(True)))


@query("select o_orderkey, row_number() over (partition by o_orderpriority order by md5(o_orderkey::varchar), o_orderkey) <= round(count(*) over (partition by o_orderpriority) * 0.2) as in_test from orders")
def stratified_split(spark, sf):
    return sampling.stratified(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 0.2).select("o_orderkey", "in_test")


@query("select event_id, event_id <= q as early from events, (select quantile_cont(event_id::double, 0.9) q from events)")
def ordered_split(spark, sf):
    first, rest = sampling.ordered(table(spark, sf, "events").select("event_id"), "event_id", 0.9)
    return first.withColumn("early", F.lit(True)).union(rest.withColumn("early", F.lit(False)))


@query(f"select o_orderkey, {uniform('o_orderkey', 42)} < 0.2 as in_test from orders")
def random_split(spark, sf):
    rest, test = sampling.random(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.2, seed=42)
    return rest.withColumn("in_test", F.lit(False)).union(test.withColumn("in_test", F.lit(True)))


@query(f"select event_id from events order by {uniform('event_id', 42)}, event_id limit 64")
def permutation_sample(spark, sf):
    return sampling.permuted(table(spark, sf, "events").select("event_id"), "event_id", seed=42, n=64)


# -- further columns ---------------------------------------------------------------


@query("select o_orderkey, o_custkey from orders where o_orderkey >= 100 and o_orderkey < 300")
def row_slice(spark, sf):
    return col.slice_rows(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 100, 300)


@query("select p_brand, p_name, p_size, p_type from part")
def columns_but(spark, sf):
    t = table(spark, sf, "part")
    return t.select(*col.columns_but(t, ["p_partkey", "p_retailprice", "nothing"]))


@query("select c_custkey, c_name, c_acctbal * 2 as twice, c_nationkey from customer")
def concatenated_columns(spark, sf):
    t = table(spark, sf, "customer")
    return col.beside(t.select("c_custkey", "c_name"), t.select("c_custkey", (c("c_acctbal") * 2).alias("twice"), "c_nationkey"), "c_custkey")


@query("select o_orderkey, cast(year(o_orderdate) as int) as y, cast(month(o_orderdate) as int) as m, cast(day(o_orderdate) as int) as d from orders")
def split_dates(spark, sf):
    parts = strings.split_ints(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf, "orders").select("o_orderkey", parts.alias("p")).select("o_orderkey", c("p")[0].alias("y"), c("p")[1].alias("m"), c("p")[2].alias("d"))


@query("select c_custkey, c_nationkey as c_nationkey_c_mktsegment_count from customer")
def joined_names(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", c("c_nationkey").alias(strings.joined_name(["c_nationkey", "c_mktsegment"], "_count")))


@query("select event_id, cast(floor(epoch(ts)) as bigint) as a, cast(floor(epoch(ts)) as bigint) as b, null::bigint as d from events")
def parsed_timestamps(spark, sf):
    iso, plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf, "events").select("event_id", F.unix_timestamp(dates.iso_millis(iso)).alias("a"), F.unix_timestamp(dates.any_timestamp(plain)).alias("b"), F.unix_timestamp(dates.any_timestamp(F.lit("no date"))).alias("d"))


@query("select p_partkey, round(2 * pow(2.0, (p_size - 20) * 0.5), 6) as y, least(p_size::double, p_retailprice, 30.0) as least from part")
def exponential_curve(spark, sf):
    from loomspark.functions.vectors import smallest

    return table(spark, sf, "part").select("p_partkey", F.round(maths.exponential(c("p_size"), 2.0, 0.5, 20.0), 6).alias("y"), smallest(c("p_size").cast("double"), c("p_retailprice"), F.lit(30.0)).alias("least"))


@query("select n_nationkey, 0::bigint as seconds, true as later from nation")
def stopwatch(spark, sf):
    watch = dates.Stopwatch()
    watch.start()
    found, lap = watch.elapsed(), watch.lap()
    return table(spark, sf, "nation").select("n_nationkey", F.lit(found + lap).cast("long").alias("seconds"), F.lit(watch.elapsed() >= found).alias("later"))
