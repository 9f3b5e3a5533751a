"""Click features: declarative specs, planned so that specs with the same keys share an exchange and a sort."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.ranks import bucket_of, small, splitters
from loomspark.sources.readers import remembered

#: Rows of a group from which on its order is made in parts.
HOT = 20_000_000
KINDS = ("next_click", "prev_click", "count", "add_counts", "nunique", "var", "mean", "sum", "cumcount")


@dataclass(frozen=True)
class FeatureSpec:
    """``kind`` over groups of ``keys``; ``value`` where the kind has one."""

    kind: str
    keys: tuple[str, ...]
    value: str | None = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown feature kind {self.kind}")
        if (self.kind in ("nunique", "var", "mean", "sum")) != (self.value is not None) and self.kind != "cumcount":
            raise ValueError(f"{self.kind}: wrong value column {self.value}")

    @property
    def name(self) -> str:
        """The public names of features."""
        keys = "_".join(self.keys)
        return {
            "next_click": f"{keys}_next_click", "prev_click": f"{keys}_prev_click", "count": f"{keys}count", "add_counts": f"{keys}_count",
            "nunique": f"{keys}_by_{self.value}_countuniq", "var": f"{keys}_by_{self.value}_var", "mean": f"{keys}_by_{self.value}_mean", "sum": f"{keys}_by_{self.value}_sum",
            "cumcount": f"{keys}_by_{self.value}_cumcount" if self.value else f"{keys}_cumcount",
        }[self.kind]


def expression(spec: FeatureSpec, time: str, row_id: str) -> Column:
    group = Window.partitionBy(*spec.keys)
    ordered = group.orderBy(time, row_id)
    seconds = F.unix_timestamp(time)
    if spec.kind == "next_click":
        return (F.unix_timestamp(F.lead(time).over(ordered)) - seconds).cast("double")
    if spec.kind == "prev_click":
        return (seconds - F.unix_timestamp(F.lag(time).over(ordered))).cast("double")
    if spec.kind == "cumcount":
        return (F.row_number().over(ordered) - 1).cast("long")
    if spec.kind in ("count", "add_counts"):
        return F.count("*").over(group)
    return {"var": F.var_samp, "mean": F.avg, "sum": F.sum}[spec.kind](spec.value).over(group)


def hot(df: DataFrame, keys: tuple[str, ...]) -> bool:
    """Whether some group is more than a task should order; a small table is not counted."""
    if small(df):
        return False
    most = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n
    return (most or 0) > HOT


def ordered_in_parts(df: DataFrame, base: DataFrame, specs: list[FeatureSpec], keys: tuple[str, ...], time: str, row_id: str) -> DataFrame:
    """Ordered kinds of groups of any size: windows over parts of time, and what a part's first and last rows need from its neighbours."""
    seconds = F.unix_timestamp(time)
    edges = splitters(base.select(seconds.alias("t")), "t")
    # the planner must not carry the part's formula over to the other side of the join, where there is no time: the added 0 keeps it from that
    part = bucket_of(seconds, edges) + (F.monotonically_increasing_id() * 0).cast("int")
    edge = base.withColumn("__part", part).groupBy(*keys, "__part").agg(F.min(seconds).alias("__first"), F.max(seconds).alias("__last"), F.count("*").alias("__n"))
    w = Window.partitionBy(*keys).orderBy("__part")
    edge = edge.withColumns({"__next": F.lead("__first").over(w), "__previous": F.lag("__last").over(w), "__before": F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    edge = edge.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__of"), "__next", "__previous", "__before")
    cut = df.withColumn("__part", part)
    inner = Window.partitionBy(*keys, "__part").orderBy(time, row_id)
    cut = cut.withColumns({"__up": F.unix_timestamp(F.lead(time).over(inner)), "__down": F.unix_timestamp(F.lag(time).over(inner)), "__row": F.row_number().over(inner)})
    test = F.col("__part") == F.col("__of")
    for i, k in enumerate(keys):
        test = test & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    held = cut.join(edge, test)
    made = {
        "next_click": (F.coalesce("__up", "__next") - seconds).cast("double"),
        "prev_click": (seconds - F.coalesce("__down", "__previous")).cast("double"),
        "cumcount": (F.col("__before") + F.col("__row") - 1).cast("long"),
    }
    return held.select(*df.columns, *[made[s.kind].alias(s.name) for s in specs])


def add_features(df: DataFrame, specs: list[FeatureSpec], time: str = "ts", row_id: str = "event_id") -> DataFrame:
    """All features on all rows.

    Ordered kinds of one key set share an exchange and a sort; where a group
    has more than HOT rows, groups are cut by time into parts.  Counts,
    means and variances of hot groups are aggregated before they are dealt
    (map-side) and joined back; Spark splits a hot group's rows in that join.
    """
    if len(set(specs)) != len(specs):
        raise ValueError("a feature is listed twice")
    by_keys: dict[tuple, list[FeatureSpec]] = defaultdict(list)
    base = df  # aggregates read this, not what is joined so far: the plan grows by one scan for each key set
    for s in specs:
        by_keys[tuple(sorted(s.keys))].append(s)
    for keys, group in by_keys.items():
        ordered = [s for s in group if s.kind in ("next_click", "prev_click", "cumcount")]
        rest = [s for s in group if s not in ordered]
        if ordered and hot(base, keys):
            df = ordered_in_parts(df, base, ordered, keys, time, row_id)
        elif ordered:
            df = df.withColumns({s.name: expression(FeatureSpec(s.kind, keys, s.value), time, row_id) for s in ordered})
        if rest:
            how = {"count": lambda s: F.count("*"), "add_counts": lambda s: F.count("*"), "nunique": lambda s: F.countDistinct(s.value), "var": lambda s: F.var_samp(s.value), "mean": lambda s: F.avg(s.value), "sum": lambda s: F.sum(s.value)}
            df = df.join(base.groupBy(*keys).agg(*[how[s.kind](s).alias(s.name) for s in rest]), list(keys), "left")
    return df


def add_feature(df: DataFrame, spec: FeatureSpec, **options) -> tuple[DataFrame, str]:
    """The frame with one feature, and the feature's name."""
    return add_features(df, [spec], **options), spec.name


def saved_feature(df: DataFrame, spec: FeatureSpec, root: str, row_id: str = "event_id", **options) -> DataFrame:
    """(row_id, feature), computed once and kept as Parquet."""
    return remembered(df.sparkSession, f"{root}/{spec.name}", lambda: add_features(df, [spec], row_id=row_id, **options).select(row_id, spec.name))


# fixed values: key sets of the click pipeline
NEXT_CLICK = (
    ("ip", "os", "device", "app"), ("ip", "os", "app"), ("ip", "os", "device"), ("ip", "os", "channel"), ("ip", "device"),
    ("ip", "channel"), ("ip", "app", "channel"), ("ip", "device", "app"), ("ip", "app"),
)
PREV_CLICK = (("ip", "os", "device", "app"), ("ip", "device", "app"), ("ip", "device", "channel"), ("ip", "app", "channel"), ("ip", "app"), ("ip", "device"))
ADD_COUNTS = (
    ("ip",), ("os", "device"), ("app", "channel"), ("ip", "app", "os"), ("in_test_hh", "ip"), ("os", "app", "channel"),
    ("ip", "day", "hour"), ("ip", "device", "day", "hour"),
)
COUNT = (("ip", "device"), ("ip", "channel"), ("ip", "app", "device"), ("ip", "app"), ("ip", "os"), ("ip", "app", "channel"))
UNIQUE = (
    (("ip",), "channel"), (("ip", "day"), "channel"), (("ip",), "device"), (("ip",), "app"), (("ip",), "os"), (("ip", "app"), "os"),
    (("ip", "device", "os"), "app"),
)
VARIANCE = ((("ip",), "device"), (("ip", "device", "os"), "channel"))
CLICK_SPECS = (
    *(FeatureSpec("next_click", k) for k in NEXT_CLICK),
    *(FeatureSpec("prev_click", k) for k in PREV_CLICK),
    *(FeatureSpec("add_counts", k) for k in ADD_COUNTS),
    *(FeatureSpec("count", k) for k in COUNT),
    *(FeatureSpec("nunique", k, v) for k, v in UNIQUE),
    *(FeatureSpec("var", k, v) for k, v in VARIANCE),
)
HELPERS = ("day", "in_test_hh", "click_time_int")


def click_pipeline(frames: dict[str, DataFrame], time: str = "click_time", row_id: str = "row_id", specs: tuple[FeatureSpec, ...] = CLICK_SPECS) -> DataFrame:
    """Train, validation and test frames as one, with an ``origin`` column, time parts and all features; split it by ``origin``."""
    from loomspark.functions.dates import hour_class
    from loomspark.operators.sets import tagged_union

    df = tagged_union(frames)
    df = df.withColumns({"hour": F.hour(time), "day": F.dayofmonth(time)})
    df = df.withColumns({"in_test_hh": hour_class(F.col("hour")), "click_time_int": F.unix_timestamp(time)})
    return add_features(df, list(specs), time=time, row_id=row_id).drop(*HELPERS)
