"""Algorithms on vectors and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions.vectors import argmax, one_hot, squared_distance
from loomspark.operators import estimators, learn, reshape
from loomspark.plans.base import Family, table

query = Family()
QUERIES, SQL = query.queries, query.sql
c = F.col
DIST = "list_sum(list_transform(list_zip({a}, {b}), lambda z: pow(z[1]::double - z[2]::double, 2)))"
CENTRES = "(select vec_id % 100 as k, embedding as centre from embeddings where vec_id in (0, 1, 2, 3, 4))"


def centres(spark, sf):
    rows = table(spark, sf, "embeddings").filter("vec_id < 5").orderBy("vec_id").select("embedding").collect()
    return [[float(x) for x in r.embedding] for r in rows]


@query("select round(regr_slope(l_extendedprice, l_quantity), 6) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept from lineitem")
def ols_fit(spark, sf):
    m = learn.SimpleLinearRegression().fit(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return spark.range(1).select(F.round(F.lit(m.coef_), 6).alias("slope"), F.round(F.lit(m.intercept_), 4).alias("intercept"))


@query("select l_orderkey, l_partkey, round(i + s * l_quantity, 3) as prediction from lineitem, (select regr_slope(l_extendedprice, l_quantity) s, regr_intercept(l_extendedprice, l_quantity) i from lineitem)")
def ols_predict(spark, sf):
    li = table(spark, sf, "lineitem")
    m = learn.SimpleLinearRegression().fit(li, "l_quantity", "l_extendedprice")
    return m.predict(li, "l_quantity").select("l_orderkey", "l_partkey", F.round("prediction", 3).alias("prediction"))


@query(f"select e.vec_id, round({DIST.format(a='e.embedding', b='z.embedding')}, 6) as d from embeddings e, (select embedding from embeddings where vec_id = 0) z")
def squared_distances(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    zero = e.filter("vec_id = 0").select(c("embedding").alias("z"))
    return e.crossJoin(F.broadcast(zero.limit(1))).select("vec_id", F.round(squared_distance(c("embedding"), c("z")), 6).alias("d"))


@query(f"select vec_id, cast(k as int) as label from (select vec_id, k, row_number() over (partition by vec_id order by {DIST.format(a='embedding', b='centre')}, k) n from embeddings, {CENTRES}) where n = 1")
def lloyd_assign(spark, sf):
    return learn.assign(table(spark, sf, "embeddings"), "embedding", centres(spark, sf)).select("vec_id", "label")


@query(f"select cast(k as int) as k, round(avg(embedding[1]::double), 6) as m0, round(avg(embedding[64]::double), 6) as m63 from (select embedding, k, row_number() over (partition by vec_id order by {DIST.format(a='embedding', b='centre')}, k) n from embeddings, {CENTRES}) where n = 1 group by 1")
def lloyd_step(spark, sf):
    new = learn.step(table(spark, sf, "embeddings"), "embedding", centres(spark, sf))
    return spark.createDataFrame([(i, round(v[0], 6), round(v[63], 6)) for i, v in enumerate(new)], "k int, m0 double, m63 double")


@query(f"select round(sum(d), 4) as inertia from (select min({DIST.format(a='embedding', b='centre')}) d from embeddings, {CENTRES} group by vec_id)")
def inertia(spark, sf):
    value = learn.inertia(table(spark, sf, "embeddings"), "embedding", centres(spark, sf))
    return spark.range(1).select(F.round(F.lit(value), 4).alias("inertia"))


def kmeans_sql(k: int, starts: int, steps: int, seed: int) -> str:
    """Lloyd's algorithm unrolled: seeded starts, steps of assignment and means, the least inertia of the starts."""
    distance = DIST.format(a="embedding", b="centre")
    parts, last = [], []
    for s in range(seed, seed + starts):
        parts.append(f"c{s}_0 as (select row_number() over (order by cast('0x' || left(md5(vec_id::varchar || ':{s}'), 12) as bigint)) - 1 as k, list_transform(embedding, lambda x: x::double) as centre from embeddings order by k limit {k})")
        for n in range(1, steps + 1):
            near = f"(select vec_id, embedding, k, row_number() over (partition by vec_id order by {distance}, k) as r from embeddings, c{s}_{n - 1})"
            parts.append(f"a{s}_{n} as (select vec_id, k, unnest(embedding) as x, unnest(range(64)) as i from {near} where r = 1)")
            parts.append(f"m{s}_{n} as (select k, list(m order by i) as centre from (select k, i, avg(x::double) as m from a{s}_{n} group by 1, 2) group by 1)")
            parts.append(f"c{s}_{n} as (select o.k, coalesce(m.centre, o.centre) as centre from c{s}_{n - 1} o left join m{s}_{n} m using (k))")
        parts.append(f"f{s} as (select vec_id, cast(k as int) as label, d from (select vec_id, k, {distance} as d, row_number() over (partition by vec_id order by {distance}, k) as r from embeddings, c{s}_{steps}) where r = 1)")
        last.append(f"select {s} as s, sum(d) as cost from f{s}")
    every = " union all ".join(f"select {s} as s, vec_id, label from f{s}" for s in range(seed, seed + starts))
    return f"with {', '.join(parts)}, best as (select s from ({' union all '.join(last)}) order by cost, s limit 1) select vec_id, label from ({every}) join best using (s)"


@query(kmeans_sql(5, 2, 3, 1))
def kmeans_fit(spark, sf):
    e = table(spark, sf, "embeddings")
    return learn.KMeans(5, n_init=2, max_iter=3, tol=0.0, seed=1).fit(e, "embedding", "vec_id").predict(e, "embedding").select("vec_id", "label")


KNN = f"""with d as (select q.vec_id, t.label, row_number() over (partition by q.vec_id order by round({DIST.format(a='q.embedding', b='t.embedding')}, 9), t.vec_id) n from embeddings q, embeddings t)
select vec_id, prediction from (select vec_id, label as prediction, row_number() over (partition by vec_id order by count(*) desc, label) r from d where n <= 5 group by 1, 2) where r = 1"""


@query(KNN)
def knn_predict(spark, sf):
    """Every row against all rows."""
    e = table(spark, sf, "embeddings")
    return learn.KNeighborsClassifier(5).fit(e, "embedding", "label", "vec_id").predict(e, "embedding", "vec_id")


@query(f"""with d as (select q.vec_id, q.label as y, t.label, row_number() over (partition by q.vec_id order by round({DIST.format(a='q.embedding', b='t.embedding')}, 9), t.vec_id) n from embeddings q, embeddings t where q.vec_id % 10 <> t.vec_id % 10),
v as (select k, vec_id, y, label, row_number() over (partition by k, vec_id order by count(*) desc, label) r from d, (select unnest(range(1, 16, 2)) as k) where n <= k group by 1, 2, 3, 4)
select cast(k as int) as k, cast(sum(cast(label <> y as int)) as bigint) as errors from v where r = 1 group by 1""")
def knn_k_sweep(spark, sf):
    """Errors of ten folds by the number of neighbours."""
    return learn.k_sweep(table(spark, sf, "embeddings"), "embedding", "label", "vec_id", list(range(1, 16, 2)))


GINI = """with b as (select e.event_id, e.value v, case when event_type = 'purchase' then 1 else 0 end y from events e),
s as (select v, y, count(*) over w nl, sum(y) over w pl, count(*) over () n, sum(y) over () p, lead(v) over (order by v, event_id) nx from b window w as (order by v, event_id rows unbounded preceding)),
g as (select (nl::double * (1 - (pl / nl::double) * (pl / nl::double) - (1 - pl / nl::double) * (1 - pl / nl::double)) + (n - nl)::double * (1 - ((p - pl) / (n - nl)::double) * ((p - pl) / (n - nl)::double) - (1 - (p - pl) / (n - nl)::double) * (1 - (p - pl) / (n - nl)::double))) / n g, nl, (v + nx) / 2.0 t from s where nl < n)
select round(g, 9) as gini, cast(nl as bigint) as n_left, t::double as threshold from g order by round(g, 12), nl limit 1"""


@query(GINI)
def gini_best_split(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value", (c("event_type") == "purchase").cast("int").alias("y"))
    best = learn.gini_splits(df, "value", "y", "event_id").orderBy(F.round("gini", 12), "nl").limit(1)
    return best.select(F.round("gini", 9).alias("gini"), c("nl").alias("n_left"), "threshold")


def cart_sql(features: int, depth: int) -> str:
    """A tree level by level: all split positions of all features of a level's nodes, the best of each, and where rows go."""
    parts = [f"r0 as (select vec_id, cast(label < 5 as int) as y, 0 as node, {', '.join(f'embedding[{i + 1}]::double as x{i}' for i in range(features))} from embeddings)"]
    every = []
    for d in range(depth + 1):
        parts.append(f"l{d} as (select node, y as label from (select node, y, row_number() over (partition by node order by count(*) desc, y) as k from r{d} group by node, y) where k = 1)")
        if d == depth:
            every.append(f"select vec_id, label from r{d} join l{d} using (node)")
            break
        cuts = " union all ".join(
            f"select node, {i} as dim, count(*) over w as nl, sum(y) over w as pl, count(*) over (partition by node) as n, sum(y) over (partition by node) as p, (x{i} + lead(x{i}) over (partition by node order by x{i}, vec_id)) / 2.0 as t from r{d} window w as (partition by node order by x{i}, vec_id rows unbounded preceding)"
            for i in range(features)
        )
        side = "{n}::double * (1 - ({p} / {n}::double) * ({p} / {n}::double) - (1 - {p} / {n}::double) * (1 - {p} / {n}::double))"
        parts.append(f"g{d} as (select node, dim, nl, t, round(({side.format(n='nl', p='pl')} + {side.format(n='(n - nl)', p='(p - pl)')}) / n, 12) as g from ({cuts}) where nl < n and n > 2)")
        parts.append(f"b{d} as (select node, dim, t from (select *, row_number() over (partition by node order by g, dim, nl, t) as k from g{d}) where k = 1)")
        value = " ".join(f"when {i} then x{i}" for i in range(features))
        parts.append(f"s{d} as (select r{d}.*, case when case dim {value} end > t then 2 * r{d}.node + 2 else 2 * r{d}.node + 1 end as child from r{d} join b{d} using (node))")
        parts.append(f"o{d} as (select node from s{d} group by node having count(distinct child) = 2)")
        parts.append(f"r{d + 1} as (select vec_id, y, child as node, {', '.join(f'x{i}' for i in range(features))} from s{d} where node in (select node from o{d}))")
        every.append(f"select vec_id, label from r{d} join l{d} using (node) where node not in (select node from o{d})")
    return f"with {', '.join(parts)} select vec_id, cast(label as int) as prediction from ({' union all '.join(every)})"


@query(cart_sql(3, 3))
def cart_fit(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", (c("label") < 5).cast("int").alias("y"), *[c("embedding")[i].cast("double").alias(f"x{i}") for i in range(3)])
    return learn.DecisionTreeClassifier(max_depth=3).fit(e, ["x0", "x1", "x2"], "y", "vec_id").predict(e).select("vec_id", "prediction")


@query("select vec_id, cast(list_position(list_transform(range(10), lambda i: cast(i = label as int)), 1) - 1 as int) as label from embeddings")
def one_hot_argmax(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", argmax(one_hot(c("label"), 10)).alias("label"))


@query("""with m as (select covar_pop(l_quantity, l_extendedprice) as ay, covar_pop(l_discount, l_extendedprice) as byy, var_pop(l_quantity) as aa, var_pop(l_discount) as bb, covar_pop(l_quantity, l_discount) as ab, avg(l_quantity) as a, avg(l_discount) as b, avg(l_extendedprice) as y from lineitem),
s as (select (ay * bb - byy * ab) / (aa * bb - ab * ab) as u, (byy * aa - ay * ab) / (aa * bb - ab * ab) as v, a, b, y from m)
select l_orderkey, round(y + u * (l_quantity - a) + v * (l_discount - b), 2) as prediction from lineitem, s""")
def library_linear(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_extendedprice")
    return estimators.linear(["l_quantity", "l_discount"], "l_extendedprice").fit(li).transform(li).select("l_orderkey", F.round("prediction", 2).alias("prediction"))


@query("select cast(label < 5 as int) as y, count(*) as n, true as better from embeddings group by 1")
def library_boosting(spark, sf):
    """Whether boosted trees are right more often than the larger class is large."""
    e = table(spark, sf, "embeddings").select("vec_id", (c("label") < 5).cast("int").alias("y"), *[c("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)])
    right = share_right(estimators.boosted([f"x{i}" for i in range(64)], "y", rounds=5, depth=3, bins=32).fit(e).transform(e))
    sizes = e.groupBy("y").agg(F.count("*").alias("n"))
    whole = sizes.agg(F.max("n").alias("m"), F.sum("n").alias("t"))
    return sizes.crossJoin(F.broadcast(whole)).select("y", "n", (F.lit(right) > c("m") / c("t")).alias("better"))


@query("select avg(case when y = 1995 then m end) as first, round(regr_slope(log2(m), y), 6) as doublings from (select cast(year(o_orderdate) as double) y, median(o_totalprice) m from orders group by 1)")
def log_linear_trend(spark, sf):
    yearly = table(spark, sf, "orders").groupBy(F.year("o_orderdate").cast("double").alias("y")).agg(F.median("o_totalprice").alias("m"))
    return yearly.agg(F.avg(F.when(c("y") == 1995, c("m"))).alias("first"), F.round(F.regr_slope(F.log2("m"), c("y")), 6).alias("doublings"))


# -- further learners --------------------------------------------------------------

STUMP = """with v as (select l_quantity as x, count(*) as n, sum(l_extendedprice) as s, sum(l_extendedprice * l_extendedprice) as q from lineitem group by 1),
c as (select x, lead(x) over (order by x) as following, sum(n) over w as nl, sum(s) over w as sl, sum(q) over w as ql, sum(n) over () as n, sum(s) over () as s, sum(q) over () as q from v window w as (order by x rows unbounded preceding)),
b as (select (x + following) / 2 as t, sl / nl as low, (s - sl) / (n - nl) as high from c where following is not null order by (ql - sl * sl / nl) + ((q - ql) - (s - sl) * (s - sl) / (n - nl)), x limit 1)
select l_orderkey, l_partkey, round(case when l_quantity <= t then low else high end, 2) as prediction from lineitem, b"""


@query(STUMP)
def library_tree(spark, sf):
    """A regression tree of one split over a feature of 50 values, each a bin of its own."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    made = estimators.tree(["l_quantity"], "l_extendedprice", classify=False, depth=1, bins=64).fit(li).transform(li)
    return made.select("l_orderkey", "l_partkey", F.round("prediction", 2).alias("prediction"))


@query(STUMP)
def library_forest(spark, sf):
    """Three trees that see all rows and features are three times the same tree."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    made = estimators.forest(["l_quantity"], "l_extendedprice", classify=False, trees=3, depth=1, leaf=1, subset="all", bootstrap=False, bins=64).fit(li).transform(li)
    return made.select("l_orderkey", "l_partkey", F.round("prediction", 2).alias("prediction"))


@query("select 0 as rank, 'l_quantity' as feature, 1.0::double as importance union all select 1, 'l_discount', 0.0")
def tree_importances(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity", "l_discount", (c("l_quantity") > 25).cast("int").alias("y"))
    names = ["l_discount", "l_quantity"]
    return estimators.importances(estimators.tree(names, "y", depth=3, bins=64).fit(li), names)


#: Rows that a round disc tells apart: no line can.
DISC = "(l_quantity - 25.5) * (l_quantity - 25.5) / 625.0 + (l_discount - 0.05) * (l_discount - 0.05) / 0.0025 < 0.6"


@query(f"select count(*) as n, sum(cast({DISC} as int))::bigint as inside, true as radial, false as line from lineitem")
def radial_svc(spark, sf):
    """Whether a radial and a linear classifier tell a disc from what is around it in nine rows of ten."""
    li = table(spark, sf, "lineitem").select(((c("l_quantity") - 25.5) / 25).alias("a"), ((c("l_discount") - 0.05) / 0.05).alias("b"), F.expr(DISC).cast("int").alias("y"))
    right = [share_right(m.fit(li).transform(li)) for m in (estimators.kernel_svc(["a", "b"], "y", gamma=1.0, size=60), estimators.svc(["a", "b"], "y"))]
    return li.agg(F.count("*").alias("n"), F.sum("y").alias("inside"), F.lit(right[0] >= 0.9).alias("radial"), F.lit(right[1] >= 0.9).alias("line"))


def share_right(made) -> float:
    return made.agg(F.avg((c("prediction") == c("y")).cast("double")).alias("s")).first().s


@query("select l_returnflag || l_linestatus as status, count(*) as n, true as learned from lineitem group by 1")
def softmax_classes(spark, sf):
    """Softmax regression on one-hot inputs that tell the classes apart."""
    li = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("status"))
    coded = reshape.label_encode(li, "status", "y")
    levels = [r.status for r in coded.select("status").distinct().orderBy("status").collect()]
    wide = reshape.one_hot_columns(coded, "status", levels)
    columns = [f"status_{v}" for v in levels]
    made = estimators.softmax_regression(columns, "y").fit(wide).transform(wide)
    return made.groupBy("status").agg(F.count("*").alias("n"), (F.min((c("prediction") == c("y")).cast("int")) == 1).alias("learned"))


@query("select init, 3::bigint as trials, true as sound from (values ('random'), ('k-means||')) t(init)")
def kmeans_starts(spark, sf):
    """Trials of both kinds of starts: each ends at or below the cost of one centre for all."""
    e = table(spark, sf, "embeddings").select("embedding")
    middle = learn.step(e, "embedding", [[0.0] * 64])
    one = learn.inertia(e, "embedding", middle)
    costs = estimators.compare_starts(e, "embedding", 4, trials=3)
    return costs.groupBy("init").agg(F.count("*").alias("trials"), (F.max("cost") <= one).alias("sound"))


@query("select cast(k as int) as k, true as falls from range(2, 7) t(k)")
def kmeans_elbow(spark, sf):
    """The inertia of 2 to 6 clusters; it does not rise by more than a start can be unlucky."""
    costs = estimators.elbow(table(spark, sf, "embeddings").select("embedding"), "embedding", range(2, 7))
    rows = [(k, all(cost <= 1.05 * before for _, before in costs[:i])) for i, (k, cost) in enumerate(costs)]
    return spark.createDataFrame(rows, "k int, falls boolean")


@query("select 10 as folds, true as close from lineitem limit 1")
def cross_validation(spark, sf):
    """Ten folds of a least-squares fit: the mean error of the folds is that of the whole fit, nearly."""
    li = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    found = estimators.cross_validated(estimators.linear(["l_quantity"], "l_extendedprice"), li, "l_extendedprice", folds=10)
    m = learn.SimpleLinearRegression().fit(li, "l_quantity", "l_extendedprice")
    whole = m.predict(li, "l_quantity").agg(F.sqrt(F.avg(F.pow(c("prediction") - c("l_extendedprice"), 2))).alias("e")).first().e
    return spark.createDataFrame([(10, bool(abs(found / whole - 1) < 0.01))], "folds int, close boolean")


@query("select 'l_discount' as name, 1 as kept_at, true as better union all select 'l_quantity', 0, true")
def greedy_selection(spark, sf):
    """Candidates in order, kept where the explained share of the variance grows; copies of kept ones add nothing."""
    li = table(spark, sf, "lineitem").select("l_quantity", "l_discount", (c("l_quantity") * 2).alias("twice"), (c("l_quantity") * 3 + c("l_discount") * 500).alias("y"))

    def explained(names: list[str]) -> float:
        m = estimators.linear(names, "y").fit(li)
        return round(m.stages[-1].summary.r2, 6)

    kept, best, gains = learn.forward_selection(["l_quantity", "twice", "l_discount"], explained, 0.0)
    return spark.createDataFrame([(n, i, gain > 0 and best > 0.999) for i, (n, gain) in enumerate(gains)], "name string, kept_at int, better boolean")


KERNEL = [[0.5, -1.0, 0.25], [1.0, 2.0, -0.5], [-0.75, 0.5, 1.5]]


def conv_sql() -> str:
    """A 3 x 3 kernel over 8 x 8 images with zeros around, rectified, the largest of each 2 x 2."""

    def cell(r: int, q: int) -> str:
        terms = [f"({KERNEL[i][j]}) * embedding[{(r + i - 1) * 8 + q + j - 1 + 1}]::double" for i in range(3) for j in range(3) if 0 <= r + i - 1 < 8 and 0 <= q + j - 1 < 8]
        return f"greatest(0.0, 0.1 + {' + '.join(terms)})"

    pools = [f"greatest({', '.join(cell(2 * r + i, 2 * q + j) for i in (0, 1) for j in (0, 1))})" for r in range(4) for q in range(4)]
    return f"select vec_id, 16 as n, round({pools[0]}, 6) as first, round({pools[5]}, 6) as inner_, round({' + '.join(pools)}, 6) as total from embeddings"


@query(conv_sql())
def conv_pool(spark, sf):
    import numpy as np

    from loomspark.functions.images import conv_pool as layer

    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    made = layer(e, "embedding", "made", 8, 8, np.array(KERNEL).reshape(3, 3, 1, 1), np.array([0.1]))
    return made.select("vec_id", F.size("made").alias("n"), F.round(c("made")[0], 6).alias("first"), F.round(c("made")[5], 6).alias("inner_"), F.round(F.aggregate("made", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("""with s as (select vec_id, label, [0.5 * embedding[1]::double - embedding[2]::double + 0.1, embedding[1]::double + 0.25 * embedding[2]::double - 0.2] as z from embeddings),
r as (select vec_id, label, greatest(z[1], 0.0) as a, greatest(z[2], 0.0) as b from s), p as (select *, exp(a) / (exp(a) + exp(b)) as pa from r)
select vec_id, round(pa, 9) as p0, round(1 - pa, 9) as p1, round(-ln(case label % 2 when 0 then pa else 1 - pa end), 6) as loss, [[a, b]] = [[a, b]] as shaped from p""")
def dense_layer(spark, sf):
    from loomspark.functions import vectors

    e = table(spark, sf, "embeddings").select("vec_id", "label", F.array(*[c("embedding")[i].cast("double") for i in (0, 1)]).alias("v"))
    z = vectors.relu(vectors.affine(c("v"), [[0.5, -1.0], [1.0, 0.25]], [0.1, -0.2]))
    made = e.withColumn("z", z).withColumn("p", vectors.softmax(c("z")))
    same = vectors.flatten(vectors.reshape(c("z"), 1, 2)) == c("z")
    return made.select("vec_id", F.round(c("p")[0], 9).alias("p0"), F.round(c("p")[1], 9).alias("p1"), F.round(vectors.cross_entropy(c("p"), (c("label") % 2).cast("int")), 6).alias("loss"), same.alias("shaped"))
