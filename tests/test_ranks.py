"""Ordered counts in buckets against the one-window way, and the newer shapes, sources and learners."""

import gzip
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.functions import images, maths
from loomspark.operators import aggregates, columns, estimators, joins, learn, ranks, reshape, sampling
from loomspark.plans import catalogue
from loomspark.sources import readers


@pytest.fixture
def cut(monkeypatch):
    """No table is small, and buckets are few values wide."""
    monkeypatch.setattr(ranks, "SMALL", -1)
    monkeypatch.setattr(ranks, "BUCKETS", 7)
    monkeypatch.setattr(ranks, "SAMPLED", 3)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = [(i, "abc"[i % 3] if i % 17 else None, float(rng.integers(0, 40)) if i % 11 else None, int(rng.integers(0, 2))) for i in range(400)]
    return spark.createDataFrame(data, "id long, g string, v double, y int").cache()


def test_quantiles_and_ranks_in_buckets(rows, cut):
    v = np.array([r.v for r in rows.collect() if r.v is not None])
    at = [0.0, 0.1, 0.25, 0.5, 0.731, 1.0]
    assert len(ranks.splitters(rows, "v")) >= 5
    assert np.allclose(ranks.quantiles(rows, "v", at).first().q, np.quantile(v, at))
    for r in ranks.quantiles(rows.dropna(subset=["g"]), "v", at, ["g"]).collect():
        assert np.allclose(r.q, np.quantile([x.v for x in rows.collect() if x.g == r.g and x.v is not None], at))
    got = {r.id: r.r for r in aggregates.value_ranks(rows.dropna(subset=["v"]), "v", "r").collect()}
    for r in rows.dropna(subset=["v"]).collect():
        assert got[r.id] == (v < r.v).sum() + ((v == r.v).sum() + 1) / 2
    known = [(r.v, r.y) for r in rows.collect() if r.v is not None]
    pairs = [(a > b) + (a == b) / 2 for a, s in known if s for b, t in known if not t]
    assert aggregates.auc(rows, "v", "y").first().auc == pytest.approx(np.mean(pairs))
    assert aggregates.describe(rows, ["v", "id"]).collect()[0].q50 == np.median(v)
    assert {r.g: r.q2 for r in aggregates.box_summary(rows, ["g"], "v").collect()} == {r.g: r.median for r in aggregates.group_median(rows, ["g"], "v").collect()}
    assert columns.MedianImputer(["v"]).fit(rows).medians["v"] == np.median(v)
    assert columns.fill_statistic(rows, "v").filter(F.col("v").isNull()).count() == 0
    assert sampling.ordered(rows, "id")[0].count() == 360
    codes = reshape.label_encode(rows, "g", "code").collect()
    assert {(r.g, r.code) for r in codes} == {("a", 0), ("b", 1), ("c", 2), (None, None)} and len(codes) == 400


@pytest.mark.parametrize("parts", [False, True])
def test_blend_is_its_sql_to_the_last_digit(spark, tmp_path, monkeypatch, parts):
    """Of 320 rows, scores of many are halves of the sixth decimal; some logits tie in nine decimals only, one value is null."""
    rng = np.random.default_rng(6)
    values = [None, *[float(v) for v in rng.integers(0, 9000, 269) / 100]]
    data = [(i, v) for i, v in enumerate(values)] + [(i + 97 * 30, values[i] + 1e-10) for i in range(1, 51)]
    spark.createDataFrame(data, "event_id long, value double").repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    if parts:
        for name, value in (("SMALL", -1), ("BUCKETS", 7), ("SAMPLED", 3)):
            monkeypatch.setattr(ranks, name, value)
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = dict(con.sql(catalogue.oracle_sql()["rank_logit_blend"]).fetchall())
    got = {r.event_id: r.score for r in catalogue.queries()["rank_logit_blend"](spark, str(tmp_path)).collect()}
    assert len(want) == 320 and got == want


def test_halves_are_rounded_as_scaled_doubles(spark):
    got = spark.range(1).select(maths.rounded(F.lit(2.4999999999999998e-06), 6).alias("x"), maths.rounded(F.lit(-2.5), 0).alias("y"), maths.rounded(F.lit(None).cast("double"), 6).alias("z")).first()
    assert tuple(got) == (duckdb.sql("select round(2.4999999999999998e-06::double, 6)").fetchall()[0][0], -3.0, None) == (3e-06, -3.0, None)


def test_gini_positions_in_buckets(rows, monkeypatch):
    some = rows.dropna(subset=["v"])
    key = lambda df: sorted((r.nl, r.pl, r.n, r.p, round(r.gini, 12), r.threshold) for r in df.collect())
    one, by = key(learn.gini_splits(some, "v", "y", "id")), key(learn.gini_splits(some.withColumn("node", F.col("id") % 2), "v", "y", "id", "node"))
    for name, value in (("SMALL", -1), ("BUCKETS", 7), ("SAMPLED", 3)):
        monkeypatch.setattr(ranks, name, value)
    assert len(one) == some.count() - 1
    assert key(learn.gini_splits(some, "v", "y", "id")) == one
    assert key(learn.gini_splits(some.withColumn("node", F.col("id") % 2), "v", "y", "id", "node")) == by


def test_hot_groups_are_ordered_in_parts(spark, small, monkeypatch):
    from loomspark.operators import features
    from loomspark.operators.features import FeatureSpec

    e = spark.read.parquet(f"{small}/events.parquet").withColumn("user_id", F.when(F.col("user_id") % 3 != 0, F.col("user_id") % 2))  # a null and two hot groups
    specs = [FeatureSpec(k, keys) for k in ("next_click", "prev_click", "cumcount") for keys in (("user_id",), ("user_id", "event_type"))]
    columns = ["event_id", *[s.name for s in specs]]
    plain = sorted(features.add_features(e, specs).select(columns).collect())
    monkeypatch.setattr(features, "HOT", 1)
    for name, value in (("SMALL", -1), ("BUCKETS", 9), ("SAMPLED", 4)):
        monkeypatch.setattr(ranks, name, value)
    assert sorted(features.add_features(e, specs).select(columns).collect()) == plain


def test_empty_tables(rows, cut):
    none = rows.limit(0)
    assert ranks.ranked_values(none, "v").count() == 0 and aggregates.value_ranks(none, "v", "r").count() == 0
    assert ranks.quantiles(none, "v", [0.5], ["g"]).count() == 0 and ranks.quantiles(none, "v", [0.5]).first().q in (None, [None])
    assert reshape.label_encode(none, "g", "code").count() == 0


def test_splits_do_not_depend_on_partitions(rows):
    for make in (lambda d: sampling.random(d, "id", 0.3, 5)[1], lambda d: sampling.permuted(d, "id", 5, 20), lambda d: columns.fill_random(d.select("id", "v"), "v", "id", 5)):
        assert sorted(map(str, make(rows).collect())) == sorted(map(str, make(rows.repartition(7)).collect()))
    assert 80 < sampling.random(rows, "id", 0.3, 5)[1].count() < 160


def test_neighbours_against_plain_search(spark, monkeypatch):
    rng = np.random.default_rng(8)
    points = rng.integers(0, 3, (90, 2)).astype(float)  # many ties
    labels = rng.integers(0, 3, 90)
    df = spark.createDataFrame([(i, p.tolist(), int(y)) for i, (p, y) in enumerate(zip(points, labels))], "id long, v array<double>, y int").repartition(4)
    monkeypatch.setattr(learn.KNeighborsClassifier, "BLOCK", 11)
    monkeypatch.setattr(learn.KNeighborsClassifier, "QUERIES", 7)

    def plain(i, k, folds=None):
        d = ((points - points[i]) ** 2).sum(axis=1)
        order = [j for j in np.lexsort((np.arange(90), d)) if folds is None or j % folds != i % folds][:k]
        votes = np.bincount(labels[order], minlength=3)
        return int(votes.argmax())

    got = {r.id: r.prediction for r in learn.KNeighborsClassifier(4).fit(df, "v", "y", "id").predict(df, "v", "id").collect()}
    assert got == {i: plain(i, 4) for i in range(90)}
    sweep = learn.k_sweep(df, "v", "y", "id", [1, 3, 5], folds=10)
    want = {k: sum(plain(i, k, 10) != labels[i] for i in range(90)) for k in (1, 3, 5)}
    assert {r.k: r.errors for r in sweep.collect()} == want
    assert learn.best_k(sweep) == min(want, key=lambda k: (want[k], k))


def test_idx_files(spark, tmp_path):
    pixels = np.arange(3 * 4, dtype=np.uint8).reshape(3, 2, 2)
    (tmp_path / "images").write_bytes(gzip.compress(struct.pack(">BBBBIII", 0, 0, 8, 3, 3, 2, 2) + pixels.tobytes()))
    (tmp_path / "labels").write_bytes(struct.pack(">BBBBI", 0, 0, 8, 1, 3) + bytes([2, 0, 1]))
    got = readers.idx_images(spark, f"{tmp_path}/images", f"{tmp_path}/labels", 3).orderBy("row_id").collect()
    assert [r.image for r in got] == pixels.reshape(3, 4).tolist() and [r.label for r in got] == [2, 0, 1] and got[0].one_hot == [0, 0, 1]


def test_layers_and_unions(spark):
    rng = np.random.default_rng(1)
    image, kernels = rng.normal(size=(2, 5, 7, 3)), rng.normal(size=(3, 5, 3, 4))
    out = images.convolved(image, kernels, np.zeros(4))
    framed = np.pad(image, ((0, 0), (1, 1), (2, 2), (0, 0)))
    assert out.shape == (2, 5, 7, 4) and np.allclose(out[1, 2, 3], np.einsum("rci,rcio->o", framed[1, 2:5, 3:8], kernels))
    assert images.pooled(image).shape == (2, 3, 4, 3) and images.pooled(image)[0, 2, 3, 1] == image[0, 4, 6, 1]
    df = spark.createDataFrame([(1, [1.0] * 4), (2, None)], "id int, v array<double>")
    got = images.conv_pool(df, "v", "o", 2, 2, np.ones((1, 1, 1, 1)), np.zeros(1)).orderBy("id").collect()
    assert got[0].o == [1.0] and got[1].o is None
    with pytest.raises(ValueError):
        reshape.FeatureUnion([reshape.ColumnSelector(["id"])], ["id"]).transform(df)
    with pytest.raises(ValueError):
        columns.beside(df, df, "id")
    a = spark.createDataFrame([(5, "x"), (3, "y"), (9, "z")], "k int, s string")
    assert [tuple(r) for r in joins.by_position({"a": a.select("k", F.col("s").alias("v")), "b": a.limit(0).select("k", F.col("s").alias("v"))}, "k", "v").orderBy("position").collect()] == [(0, "y", None), (1, "x", None), (2, "z", None)]


def test_radial_kernel(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(float(a), float(b), int(a * a + b * b < 0.5)) for a, b in rng.uniform(-1, 1, (300, 2))], "a double, b double, y int")
    made = estimators.kernel_svc(["a", "b"], "y", gamma=1.0, size=60).fit(df).transform(df)
    assert made.filter("prediction = y").count() > 270


def test_every_query_has_a_twin():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())
