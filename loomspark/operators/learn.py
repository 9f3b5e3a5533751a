"""Algorithms written on DataFrames: least squares, Lloyd's k-means, neighbours by blocks, decision trees, blends, selection."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.maths import logit, rounded
from loomspark.functions.vectors import nearest
from loomspark.operators.columns import uniform
from loomspark.operators.ranks import bucket_of, running_before, splitters


class SimpleLinearRegression:
    """One feature, closed form.  Without an intercept the slope is still centred, and there is nothing to predict with."""

    def __init__(self, fit_intercept: bool = True):
        self.fit_intercept = fit_intercept

    def fit(self, df: DataFrame, x: str, y: str) -> SimpleLinearRegression:
        row = df.agg(F.regr_slope(y, x).alias("a"), F.regr_intercept(y, x).alias("b"), F.count("*").alias("n")).first()
        if not row.n:
            raise ValueError("no rows to fit")
        self.coef_ = row.a
        if self.fit_intercept:
            self.intercept_ = row.b
        return self

    def predict(self, df: DataFrame, x: str, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, F.lit(self.intercept_) + F.lit(self.coef_) * F.col(x))


class KMeans:
    """Lloyd's algorithm on an array column: best of ``n_init`` seeded starts; an empty cluster keeps its centre."""

    def __init__(self, n_clusters: int = 8, init: str = "random", n_init: int = 10, max_iter: int = 300, tol: float = 1e-4, seed: int = 0):
        if init != "random":
            raise ValueError("centres start at random points")
        if n_init <= 0 or max_iter <= 0:
            raise ValueError("n_init and max_iter have to be positive")
        self.n_clusters, self.n_init, self.max_iter, self.tol, self.seed = n_clusters, n_init, max_iter, tol, seed

    def fit(self, df: DataFrame, vector: str, row_id: str | None = None) -> KMeans:
        """``row_id``: starts go by the hash of this key, else by that of the vector."""
        points = df.select(*([row_id] if row_id else []), F.transform(vector, lambda v: v.cast("double")).alias("v")).cache()
        try:
            if points.count() < self.n_clusters:
                raise ValueError("fewer points than clusters")
            best = None
            for i in range(self.n_init):
                # distinct points by the order of a seeded hash: reruns agree however the rows lie
                order = F.xxhash64("v", F.lit(self.seed + i)) if row_id is None else uniform(F.col(row_id), self.seed + i)
                start = points.groupBy("v").agg(F.min(order).alias("o")).orderBy("o", "v").limit(self.n_clusters).collect()
                run = self._single(points, [list(r.v) for r in start])
                if best is None or run[1] < best[1]:
                    best = run
            self.cluster_centers_, self.inertia_, self.n_iter_ = best
        finally:
            points.unpersist()
        return self

    def _single(self, points: DataFrame, centres: list[list[float]]) -> tuple:
        for n in range(1, self.max_iter + 1):
            new = step(points, "v", centres)
            shift = sum((a - b) ** 2 for c, d in zip(centres, new) for a, b in zip(c, d))
            centres = new
            if shift <= self.tol:
                break
        return centres, inertia(points, "v", centres), n

    def predict(self, df: DataFrame, vector: str, out: str = "label") -> DataFrame:
        return assign(df, vector, self.cluster_centers_, out)


def literal(centres: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])


def assign(df: DataFrame, vector: str, centres: list[list[float]], out: str = "label") -> DataFrame:
    return df.withColumn(out, nearest(F.col(vector), literal(centres))["index"].cast("int"))


def step(df: DataFrame, vector: str, centres: list[list[float]]) -> list[list[float]]:
    """One Lloyd step: means by cluster, aggregated before the shuffle."""
    means = [F.avg(F.col(vector)[i].cast("double")).alias(f"m{i}") for i in range(len(centres[0]))]
    new = list(centres)
    for r in assign(df, vector, centres).groupBy("label").agg(*means).collect():
        new[r.label] = [r[f"m{i}"] for i in range(len(centres[0]))]
    return new


def inertia(df: DataFrame, vector: str, centres: list[list[float]]) -> float:
    return df.agg(F.sum(nearest(F.col(vector), literal(centres))["distance"])).first()[0]


class KNeighborsClassifier:
    """Squared distances of every query to every training row; ties of distance (to nine digits) by row id, of votes by label.

    Both tables are packed into blocks of rows; a pair of blocks is one numpy
    product that hands on the k best of each query, and a ranked window, which
    drops all but k before its shuffle, merges the blocks.
    """

    #: Rows of a block of queries and of one of training rows.
    QUERIES, BLOCK = 1024, 8192

    def __init__(self, n_neighbors: int = 5):
        self.n_neighbors = n_neighbors

    def fit(self, df: DataFrame, vector: str, label: str, row_id: str) -> KNeighborsClassifier:
        if df.limit(self.n_neighbors).count() < self.n_neighbors:
            raise ValueError("fewer rows than neighbours")
        self.train = df.select(F.col(row_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"))
        return self

    def neighbours(self, df: DataFrame, vector: str, row_id: str, apart: Column | None = None) -> DataFrame:
        """(query row id, place from 1, distance, id, label) of the nearest.

        ``apart``: a fold of a row id; rows of a query's own fold are no neighbours of it.
        """
        fold = F.lit(None).cast("long") if apart is None else apart.cast("long")
        queries = packed(df.select(F.col(row_id).cast("long").alias("id"), F.lit(0).cast("long").alias("label"), F.col(vector).alias("v")).withColumn("fold", fold if apart is None else apart.cast("long")), self.QUERIES, "q")
        train = packed(self.train.withColumn("fold", fold if apart is None else apart.cast("long")), self.BLOCK, "t")
        k = self.n_neighbors

        def compare(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    yield nearest_of_blocks(row, k)

        schema = "id long, distance double, t_id long, label long"
        pairs = queries.crossJoin(train).mapInArrow(compare, schema)  # blocks against blocks: a stated set of queries against all rows
        place = F.row_number().over(Window.partitionBy("id").orderBy("distance", "t_id"))
        best = pairs.withColumn("place", place).filter(F.col("place") <= k)
        return best.select(F.col("id").alias(row_id), "place", "distance", "t_id", F.col("label").alias("t_label"))

    def predict(self, df: DataFrame, vector: str, row_id: str, out: str = "prediction") -> DataFrame:
        return vote(self.neighbours(df, vector, row_id), [row_id], out)


def vote(near: DataFrame, keys: list[str], out: str) -> DataFrame:
    """The most frequent label of the neighbours; the smallest of equals."""
    votes = near.groupBy(*keys, F.col("t_label").alias(out)).agg(F.count("*").alias("votes"))
    return votes.groupBy(*keys).agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col(out).cast("int").alias(out))).alias("m")).select(*keys, f"m.{out}")


def packed(df: DataFrame, rows: int, prefix: str) -> DataFrame:
    """Blocks of up to ``rows`` rows: their ids, labels, folds and vectors as bytes."""

    def run(batches):
        held, n = [], 0

        def block(table):
            v = np.stack(table.column("v").to_numpy(zero_copy_only=False)).astype(np.float64)
            numbers = [np.asarray(table.column(c).fill_null(-1)).astype(np.int64).tobytes() for c in ("id", "label", "fold")]
            fold = table.column("fold").null_count < len(v)
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (len(v), *numbers, v.tobytes())] + [pa.array([fold])], names=[f"{prefix}_{c}" for c in ("n", "id", "label", "fold", "v", "folds")])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            while n >= rows:
                table = pa.Table.from_batches(held).combine_chunks()
                yield block(table.slice(0, rows))
                held, n = table.slice(rows).to_batches(), n - rows
        if n:
            yield block(pa.Table.from_batches(held).combine_chunks())

    p = prefix
    return df.mapInArrow(run, f"{p}_n long, {p}_id binary, {p}_label binary, {p}_fold binary, {p}_v binary, {p}_folds boolean")


def nearest_of_blocks(row: dict, k: int) -> pa.RecordBatch:
    """The k nearest training rows of each query of a pair of blocks: a product finds who can be among them, and their distances are then taken exactly."""
    ids, labels, v = ({s: np.frombuffer(row[f"{s}_{c}"], t) for s in "qt"} for c, t in (("id", np.int64), ("label", np.int64), ("v", np.float64)))
    q, t = (v[s].reshape(row[f"{s}_n"], -1) for s in "qt")
    rough = (q * q).sum(axis=1)[:, None] + (t * t).sum(axis=1)[None, :] - 2 * (q @ t.T)
    if row["q_folds"]:
        same = np.frombuffer(row["q_fold"], np.int64)[:, None] == np.frombuffer(row["t_fold"], np.int64)[None, :]
        rough = np.where(same, np.inf, rough)
    size = min(k, len(t))
    edge = np.partition(rough, size - 1, axis=1)[:, size - 1]
    slack = 1e-6 + 1e-9 * np.abs(np.where(np.isfinite(edge), edge, 0))
    at, of = np.nonzero((rough <= (edge + slack)[:, None]) & np.isfinite(rough))
    exact = np.round(((q[at] - t[of]) ** 2).sum(axis=1), 9)
    order = np.lexsort((ids["t"][of], exact, at))
    at, of, exact = at[order], of[order], exact[order]
    first = np.searchsorted(at, at)
    keep = np.arange(len(at)) - first < k
    return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (ids["q"][at], exact, ids["t"][of], labels["t"][of])], names=["id", "distance", "t_id", "label"])


def k_sweep(df: DataFrame, vector: str, label: str, row_id: str, ks: list[int], folds: int = 10) -> DataFrame:
    """(k, errors): misclassified rows by the number of neighbours, each row judged by the rows of other folds; one search serves all k."""
    most = KNeighborsClassifier(max(ks)).fit(df, vector, label, row_id)
    near = most.neighbours(df, vector, row_id, apart=F.pmod(F.col("id"), F.lit(folds)))
    each = near.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter("place <= k")
    votes = vote(each, [row_id, "k"], "prediction")
    truth = df.select(F.col(row_id), F.col(label).alias("__y"))
    return votes.join(truth, row_id).groupBy("k").agg(F.sum((F.col("prediction") != F.col("__y")).cast("long")).alias("errors"))


def best_k(sweep: DataFrame) -> int:
    """The first of the least errors."""
    return sweep.orderBy("errors", "k").first().k


# -- decision trees ------------------------------------------------------------


def gini_splits(df: DataFrame, feature: str, label: str, row_id: str, node: str | None = None) -> DataFrame:
    """Weighted Gini of every split position of a numeric feature (also between equal values) for labels 0 and 1; threshold halfway.

    Positions are running counts of rows in order; a large table's rows are
    counted bucket by bucket of the feature, so no task holds a whole node.
    """
    keys = [node] if node else []
    edges = splitters(df, feature)
    held = df.withColumns({"__one": F.lit(1).cast("long"), "__y": F.col(label).cast("long"), "__bucket": bucket_of(F.col(feature), edges)})
    counted = running_before(held.drop("__bucket"), {"nl": "__one", "pl": "__y"}, [feature, row_id], edges, keys)
    counted = counted.withColumns({"nl": F.col("nl") + 1, "pl": F.col("pl") + F.col("__y")})
    if edges:
        counted = counted.withColumn("__bucket", bucket_of(F.col(feature), edges))
        # the row after a bucket's last one is the first of the next bucket
        firsts = held.groupBy(*keys, "__bucket").agg(F.min(feature).alias("__first"))
        nexts = firsts.select(*keys, "__bucket", F.lead("__first").over(Window.partitionBy(*keys).orderBy("__bucket")).alias("__next"))
        inner = F.lead(feature).over(Window.partitionBy(*keys, "__bucket").orderBy(feature, row_id))
        counted = counted.withColumn("following", inner).join(nexts, [*keys, "__bucket"]).withColumn("following", F.coalesce("following", "__next")).drop("__next")
    else:
        counted = counted.withColumn("following", F.lead(feature).over(Window.partitionBy(*keys).orderBy(feature, row_id)))
    totals = held.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("__y").alias("p"))
    both = counted.join(F.broadcast(totals), keys) if keys else counted.crossJoin(F.broadcast(totals))  # a row for each open node, or one
    both = both.filter("nl < n").drop("__one", "__y", "__bucket")

    def impurity(p: Column) -> Column:
        return 1 - p * p - (1 - p) * (1 - p)

    nl, nr = F.col("nl").cast("double"), (F.col("n") - F.col("nl")).cast("double")
    value = (nl * impurity(F.col("pl") / nl) + nr * impurity((F.col("p") - F.col("pl")) / nr)) / F.col("n")
    return both.withColumns({"gini": value, "threshold": (F.col(feature) + F.col("following")) / F.lit(2.0).cast("double")})


@dataclass
class Node:
    label: int
    dim: int | None = None
    value: float | None = None
    left: Node | None = None
    right: Node | None = None

    def __str__(self) -> str:
        return f"leaf {self.label}" if self.dim is None else f"x[{self.dim}] > {self.value}"


class DecisionTreeClassifier:
    """Gini splits over all features and positions, first best wins.

    A node stops only by size or depth, as pure nodes may split too.  All nodes
    of a level are split by one pass for each feature; the tree itself, a few
    numbers a node, is on the driver.
    """

    def __init__(self, max_depth: int = 100, min_samples_split: int = 2):
        self.max_depth, self.min_samples_split = max_depth, min_samples_split

    def fit(self, df: DataFrame, features: list[str], label: str, row_id: str) -> DecisionTreeClassifier:
        from loomspark.operators.aggregates import majority

        self.features = features
        rows = df.select(*features, label, row_id, F.lit(0).alias("node")).cache()
        counts = {0: rows.count()}
        if not counts[0]:
            raise ValueError("no rows to fit")
        nodes: dict[int, Node] = {}
        depth, last = 0, rows
        while counts:
            labels = {r.node: r[label] for r in majority(rows.filter(F.col("node").isin(*counts)), ["node"], label).collect()}
            for k in counts:
                nodes[k] = Node(labels[k])
            open_ = [k for k, n in counts.items() if n > self.min_samples_split] if depth < self.max_depth else []
            if not open_:
                break
            best: dict[int, tuple] = {}
            here = rows.filter(F.col("node").isin(*open_))
            for d, f in enumerate(features):
                found = gini_splits(here, f, label, row_id, "node").groupBy("node").agg(F.min(F.struct(F.round("gini", 12).alias("g"), "nl", "threshold")).alias("m"))
                for r in found.collect():
                    one = (r.m.g, d, r.m.threshold)
                    if r.node not in best or one[0] < best[r.node][0]:
                        best[r.node] = one
            test = F.lit(None).cast("int")
            for k, (_, d, t) in best.items():
                nodes[k].dim, nodes[k].value = d, t
                test = F.when(F.col("node") == k, F.when(F.col(features[d]) > t, 2 * k + 2).otherwise(2 * k + 1)).otherwise(test)
            rows = rows.withColumn("node", test).filter("node is not null").cache()
            sizes = {r.node: r.n for r in rows.groupBy("node").agg(F.count("*").alias("n")).collect()}
            last.unpersist()
            last, depth = rows, depth + 1
            # a split among equal values can send all rows one way: it ends there
            counts = {k: n for k, n in sizes.items() if (k + 1 if k % 2 else k - 1) in sizes}
        last.unpersist()
        for k, n in nodes.items():
            n.left, n.right = nodes.get(2 * k + 1), nodes.get(2 * k + 2)
            if n.left is None or n.right is None:
                n.dim = n.value = n.left = n.right = None
        self.root = nodes[0]
        return self

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        def walk(n: Node) -> Column:
            if n.dim is None:
                return F.lit(n.label)
            return F.when(F.col(self.features[n.dim]) > n.value, walk(n.right)).otherwise(walk(n.left))

        return df.withColumn(out, walk(self.root))


# -- curves, blends, selection ----------------------------------------------------


def fit_exponential(x: np.ndarray, y: np.ndarray, start: tuple[float, float, float] = (2.0, 0.5, 1998.0), steps: int = 200) -> tuple[float, float, float]:
    """a, b, c of a * 2 ** ((x - c) * b) by damped Gauss-Newton on a few aggregated points."""
    p, damp = np.array(start, float), 1e-3
    of = lambda p: p[0] * 2.0 ** ((x - p[2]) * p[1])
    error = ((of(p) - y) ** 2).sum()
    for _ in range(steps):
        e = 2.0 ** ((x - p[2]) * p[1])
        jacobian = np.stack([e, p[0] * e * np.log(2) * (x - p[2]), -p[0] * e * np.log(2) * p[1]], axis=1)
        square = jacobian.T @ jacobian
        move = np.linalg.lstsq(square + damp * np.diag(np.diag(square)), jacobian.T @ (y - of(p)), rcond=None)[0]
        new = p + move
        with np.errstate(over="ignore"):
            now = ((of(new) - y) ** 2).sum()
        if np.isfinite(now) and now < error:
            p, error, damp = new, now, damp / 3
        else:
            damp *= 4
    return tuple(p)


def doubling(median0: float, x0: float, x: Column) -> Column:
    """A doubling every two years from a first value."""
    return F.lit(float(median0)) * F.pow(F.lit(2.0), (x - x0) / 2)


# fixed values: weights of the blended files, and of logits against ranks
BLEND, LOGIT_SHARE = (0.7, 0.2, 0.1), 0.8


def blend(frames: list[DataFrame], key: str = "click_id", score: str = "is_attributed", weights: tuple[float, ...] = BLEND, logit_share: float = LOGIT_SHARE, digits: int | None = None) -> DataFrame:
    """(key, score): weighted logits scaled by their deviation, against weighted average ranks; files meet by key.  ``digits``: decimals to which logits are ranked.

    Number and deviations are read once and stand in the plan: summed again in
    another order, they would part a row's logit from its rank.
    """
    from loomspark.operators.aggregates import rank_table

    files = [f.filter(F.col(score).isNotNull()).select(key, F.col(score).alias(f"s{i}")) for i, f in enumerate(frames)]
    held = files[0]
    for f in files[1:]:
        held = held.join(f, key)
    each = [logit(F.col(f"s{i}")) for i in range(len(files))]
    n, *deviations = held.agg(F.count("*"), *[F.stddev(c).alias(f"d{i}") for i, c in enumerate(each)]).first()
    logits, ranks = F.lit(0.0), F.lit(0.0)
    for i, (w, d) in enumerate(zip(weights, deviations)):
        logits = logits + w * each[i] / d if d else logits
        ranks = ranks + w * F.col(f"r{i}")
    scored = held.withColumn("logit", logits if digits is None else rounded(logits, digits))
    scored = scored.join(rank_table(scored, "logit", "lr", n), "logit")
    for i, f in enumerate(files):
        scored = scored.join(rank_table(f, f"s{i}", f"r{i}"), f"s{i}")
    rank_share = float(1 - Decimal(str(logit_share)))  # 1 - 0.8 is 0.2 here
    return scored.select(key, (logit_share * F.col("lr") / float(n) + rank_share * (ranks / float(n))).alias(score))


def forward_selection(candidates: list, evaluate, start: float) -> tuple[list, float, list[tuple]]:
    """Greedy: keep a candidate if it makes ``evaluate(kept)`` strictly better; (kept, best, gains)."""
    kept, best, gains = [], start, []
    for c in candidates:
        new = evaluate([*kept, c])
        if best < new:
            gains.append((c, new - best))
            kept, best = [*kept, c], new
    return kept, best, gains
