"""Reference operators: every query against its SQL twin, edge rules and properties."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.functions import dates, maths, strings, vectors
from loomspark.operators import aggregates, columns, estimators, features, joins, learn, reshape, sampling, sets
from loomspark.operators.features import FeatureSpec
from loomspark.plans import catalogue
from loomspark.sources import readers, sinks

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


def plain(v):
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, small, con, name):
    df = catalogue.queries()[name](spark, small)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in catalogue.oracle_sql():
        assert rows
        return
    sql = con.sql(catalogue.oracle_sql()[name])
    at = [sql.columns.index(c) for c in cols]
    assert sorted(sql.columns) == cols
    want = sorted((tuple(plain(r[i]) for i in at) for r in sql.fetchall()), key=repr)
    assert len(rows) == len(want)
    for a, b in zip(rows, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-6)) for x, y in zip(a, b)), (a, b)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalar_edges(spark):
    assert one(spark, strings.token_count(F.lit("  "))) == 0 and one(spark, strings.first_token(F.lit(" a b"))) == "a"
    assert one(spark, strings.pixels(F.lit(None).cast("string"))) == 480000 and one(spark, strings.pixels(F.lit("1920 x 1080"))) == 1920 * 1080
    assert one(spark, strings.suffixed_amount(F.lit("€12.5M"))) == 12.5e6 and one(spark, strings.suffixed_amount(F.lit("€7K"))) == 7000 and one(spark, strings.suffixed_amount(F.lit("€9"))) == 9
    assert one(spark, strings.strip_money(F.lit("N/A"))) is None and one(spark, strings.decimal_comma(F.lit("2,5"))) == 2.5
    assert one(spark, strings.title_of(F.lit("Braund, Mr. Owen"))) == "Mr" and one(spark, strings.title_of(F.lit("x"))) == ""
    assert one(spark, maths.ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, dates.hour_class(F.lit(4))) == 1 and one(spark, dates.hour_class(F.lit(6))) == 2 and one(spark, dates.hour_class(F.lit(0))) == 3
    assert abs(one(spark, maths.haversine_km(F.lit(2.35), F.lit(48.85), F.lit(-0.13), F.lit(51.51))) - 344) < 5
    p = one(spark, vectors.softmax(F.array(F.lit(1.0), F.lit(2.0))))
    assert abs(sum(p) - 1) < 1e-12 and p[1] > p[0]
    assert one(spark, vectors.reshape(F.array(*[F.lit(i) for i in range(6)]), 2, 3)) == [[0, 1, 2], [3, 4, 5]]
    assert one(spark, vectors.affine(F.array(F.lit(1.0), F.lit(2.0)), [[1, 1], [0, 2]], [0.5, 0])) == [3.5, 4.0]


def test_ranks_and_binning(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 3.0), (3, 5.0), (4, 6.0)], "id int, v double")
    assert [r.r for r in aggregates.value_ranks(df, "v", "r").orderBy("id").collect()] == [1.5, 1.5, 3.0, 4.0]
    assert [r.r for r in df.select("id", aggregates.average_rank(F.col("v")).alias("r")).orderBy("id").collect()] == [1.5, 1.5, 3.0, 4.0]
    assert [r.b for r in maths.cut_equal(df, "v", 3, "b").orderBy("id").collect()] == [1, 1, 2, 3]


def test_feature_properties(spark, small):
    e = spark.read.parquet(f"{small}/events.parquet")
    out = features.add_features(e, [FeatureSpec("next_click", ("user_id",)), FeatureSpec("prev_click", ("user_id",)), FeatureSpec("add_counts", ("user_id",)), FeatureSpec("cumcount", ("user_id",))]).collect()
    assert sum(r.user_id_next_click or 0 for r in out) == sum(r.user_id_prev_click or 0 for r in out)
    assert sum(1 / r.user_id_count for r in out) == pytest.approx(len({r.user_id for r in out}))
    with pytest.raises(ValueError):
        features.add_features(e, [FeatureSpec("count", ("user_id",))] * 2)
    with pytest.raises(ValueError):
        FeatureSpec("var", ("user_id",))


def test_saved_features_and_sinks(spark, small, tmp_path):
    e = spark.read.parquet(f"{small}/events.parquet")
    a = features.saved_feature(e, FeatureSpec("count", ("user_id",)), str(tmp_path))
    assert a.count() == e.count() == features.saved_feature(e.limit(0), FeatureSpec("count", ("user_id",)), str(tmp_path)).count()
    sinks.csv(e.select("event_id", "value").limit(5), f"{tmp_path}/c", {"value": 9}, files=1)
    back = readers.csv(spark, f"{tmp_path}/c", types={"value": "double", "nothing": "int"}, columns=["value"])
    assert back.count() == 5 and back.dtypes == [("value", "double")]
    assert readers.csv_range(spark, f"{tmp_path}/c", "event_id long, value double", 1, 3).count() == 3
    assert readers.many_csv(spark, {"a": f"{tmp_path}/c", "b": f"{tmp_path}/c"}).count() == 10
    sinks.keyed(e, str(tmp_path), "train")
    assert readers.keyed(spark, str(tmp_path), "train", ["value"]).columns == ["value"]
    (tmp_path / "y.json").write_text('{"items": [{"id": "1", "snippet": {"title": "a"}}]}')
    assert readers.json_items(spark, f"{tmp_path}/y.json").select("snippet.title").first().title == "a"
    assert "<td>1</td>" in sinks.html_table(spark.range(1, 2), "t") and sinks.preview(e)["rows"] == e.count()
    assert readers.nan_to_null(spark.createDataFrame([(float("nan"),)], "x double")).first().x is None


def test_columns_and_joins(spark):
    df = spark.createDataFrame([(1, "b", None), (2, "a", 4.0), (3, "b", 2.0)], "id int, k string, v double")
    assert columns.columns_but(df, ["v"]) == ["id", "k"] and columns.MedianImputer().fit(df).medians["v"] == 3.0
    assert [r.code for r in reshape.label_encode(df, "k", "code").orderBy("id").collect()] == [1, 0, 1]
    enc = reshape.CategoricalEncoder(["k"], "onehot-dense", "ignore", {"k": ["b"]}).fit(df)
    assert [r.k_onehot for r in enc.transform(df).orderBy("id").collect()] == [[1], [0], [1]]
    with pytest.raises(ValueError):
        reshape.CategoricalEncoder(["k"], "ordinal", "ignore")
    with pytest.raises(Exception):
        reshape.CategoricalEncoder(["k"], "ordinal", "error", {"k": ["b"]}).fit(df).transform(df).collect()
    u = sets.tagged_union({"x": df, "y": df.drop("v")})
    assert u.columns == ["id", "k", "origin"] and sets.split(u, ["x"])["x"].count() == 3
    with pytest.raises(ValueError):
        joins.nearest_km(df, df, "v", "v", "v", "v", "o", most=1)


def test_splits(spark):
    df = spark.range(1000)
    rest, test = sampling.by_hash(df, "id", 0.2)
    assert rest.count() + test.count() == 1000 and 140 < test.count() < 260
    assert sampling.stratified(df.withColumn("s", F.col("id") % 4), "s", "id", 0.2).filter("in_test").count() == 200
    assert sampling.ordered(df, "id")[0].count() == 900


def test_kmeans_and_ols(spark):
    rng = np.random.default_rng(0)
    pts = np.concatenate([rng.normal(c, 0.1, (30, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pts)], "id int, v array<double>")
    m = learn.KMeans(3, n_init=4, seed=2).fit(df, "v")
    assert m.inertia_ < 5 and len({r.label for r in m.predict(df, "v").collect()}) == 3
    with pytest.raises(ValueError):
        learn.KMeans(100).fit(df, "v")
    with pytest.raises(ValueError):
        learn.KMeans(n_init=0)
    line = spark.createDataFrame([(float(x), 2.0 * x + 1) for x in range(5)], "x double, y double")
    o = learn.SimpleLinearRegression().fit(line, "x", "y")
    assert (round(o.coef_, 9), round(o.intercept_, 9)) == (2, 1)
    with pytest.raises(AttributeError):
        learn.SimpleLinearRegression(False).fit(line, "x", "y").predict(line, "x")


def test_tree_matches_plain_search(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([0.5, 1.0, 2.0, 3.5]), rng.random(), rng.randrange(2)) for i in range(24)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y int")
    best = None
    for d in (1, 2):
        order = sorted(rows, key=lambda r: (r[d], r[0]))
        for k in range(1, len(order)):
            g = 0
            for part in (order[:k], order[k:]):
                p = sum(r[3] for r in part) / len(part)
                g += (1 - p * p - (1 - p) ** 2) * len(part) / len(order)
            if best is None or round(g, 12) < best[0]:
                best = (round(g, 12), d - 1, (order[k - 1][d] + order[k][d]) / 2)
    m = learn.DecisionTreeClassifier(max_depth=2).fit(df, ["a", "b"], "y", "id")
    assert (m.root.dim, m.root.value) == best[1:]
    assert m.predict(df).filter("prediction = y").count() >= 14
    t = learn.DecisionTreeClassifier(max_depth=0).fit(df, ["a", "b"], "y", "id").root
    assert t.dim is None and t.label == int(sum(r[3] for r in rows) > 12)


def test_knn_errors_and_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i)], i % 2) for i in range(20)], "id int, v array<double>, y int")
    whole = learn.KNeighborsClassifier(3).fit(df, "v", "y", "id").predict(df, "v", "id").orderBy("id").collect()
    monkeypatch.setattr(learn.KNeighborsClassifier, "BLOCK", 6)
    assert whole == learn.KNeighborsClassifier(3).fit(df, "v", "y", "id").predict(df, "v", "id").orderBy("id").collect()
    with pytest.raises(ValueError):
        learn.KNeighborsClassifier(30).fit(df, "v", "y", "id")


def test_curves_and_selection():
    x = np.arange(1998, 2018, dtype=float)
    a, b, c = learn.fit_exponential(x, 3 * 2 ** ((x - 2000) * 0.4))
    assert np.allclose(a * 2 ** ((x - c) * b), 3 * 2 ** ((x - 2000) * 0.4), rtol=1e-4)
    kept, best, _ = learn.forward_selection([1, 5, 5, -2, 3], lambda s: sum(set(s)), 0)
    assert kept == [1, 5, 3] and best == 9


def test_library_estimators(spark):
    df = spark.createDataFrame([(float(i), float(i % 7), float(3 * i + 1), int(i % 7 > 3)) for i in range(60)], "a double, b double, y double, z int")
    assert estimators.linear(["a", "b"], "y").fit(df).transform(df).select(F.max(F.abs(F.col("prediction") - F.col("y"))).alias("m")).first().m < 1e-6
    for p in (estimators.tree(["a", "b"], "z"), estimators.forest(["a", "b"], "z", trees=3), estimators.svc(["a", "b"], "z"), estimators.softmax_regression(["a", "b"], "z")):
        assert p.fit(df).transform(df).filter("prediction = z").count() > 30


def test_stream_counts(spark, small, tmp_path):
    from loomspark.streaming import clicks

    e = spark.read.parquet(f"{small}/events.parquet")
    e.write.parquet(f"{tmp_path}/e")
    s = clicks.windowed_counts(clicks.event_stream(spark, f"{tmp_path}/e", e._jdf.schema().toDDL()))
    q = s.writeStream.format("memory").queryName("counted").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) n from counted").first().n == e.count()


def test_entry_without_training_operators(monkeypatch):
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "loomspark.llm", None)
    monkeypatch.setitem(sys.modules, "loomspark.llm.queries", None)
    assert set(__spark_entry__.queries()) == set(catalogue.queries()) and __spark_entry__.oracle_sql() == catalogue.oracle_sql()


def test_feature_texts_and_selection(spark, small):
    from loomspark.operators import selection

    assert selection.parse("do_var(train_df, ['ip','day'], 'os' )") == FeatureSpec("var", ("ip", "day"), "os")
    assert selection.parse("add_counts(train_df, ['ip'])").name == "ip_count"
    for bad in ("__import__('os').system('x')", "print(1)", "do_var"):
        with pytest.raises(ValueError):
            selection.parse(bad)
    e = spark.read.parquet(f"{small}/events.parquet").select("event_id", "ts", "user_id", "value", F.unix_timestamp("ts").alias("t"))
    e = e.withColumn("y", (F.col("event_id") % 3 == 0).cast("int"))
    kept, best, gains = selection.select(e, [FeatureSpec("count", ("user_id",)), FeatureSpec("next_click", ("user_id",))], "y", ["event_id", "ts", "user_id", "t"], "t", "event_id", "ts", rounds=2, depth=2)
    assert len(kept) == len(gains) <= 2 and 0 <= best <= 1
