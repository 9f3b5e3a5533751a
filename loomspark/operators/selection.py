"""Greedy feature selection over declared features: candidates in order, kept where the AUC on the later part of time gets better."""

from __future__ import annotations

import ast

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame

from loomspark.operators import estimators
from loomspark.operators.columns import columns_but
from loomspark.operators.features import FeatureSpec, add_features
from loomspark.operators.learn import forward_selection
from loomspark.operators.sampling import ordered

#: Names of helpers in textual feature lists, and the kinds that they stand for.
HELPERS = {"do_next_click": "next_click", "do_prev_click": "prev_click", "do_count": "count", "do_countuniq": "nunique", "do_var": "var", "do_mean": "mean", "do_cumcount": "cumcount", "add_counts": "add_counts"}


def parse(text: str) -> FeatureSpec:
    """``"do_var(df, ['a', 'b'], 'c')"`` as a spec; the text is read, never run."""
    call = ast.parse(text.strip(), mode="eval").body
    if not isinstance(call, ast.Call) or not isinstance(call.func, ast.Name) or call.func.id not in HELPERS:
        raise ValueError(f"not a feature: {text}")
    keys = tuple(ast.literal_eval(call.args[1]))
    value = ast.literal_eval(call.args[2]) if len(call.args) > 2 else None
    return FeatureSpec(HELPERS[call.func.id], keys, value)


def auc_of(df: DataFrame, inputs: list[str], label: str, time: str, rounds: int = 10, depth: int = 4) -> float:
    """AUC of boosted trees, trained on the first nine tenths of time, on the rest."""
    train, rest = ordered(df.fillna(-1, subset=inputs), time, 0.9)
    model = estimators.boosted(inputs, label, rounds=rounds, depth=depth, rate=0.2, bins=200).fit(train)
    return BinaryClassificationEvaluator(labelCol=label).evaluate(model.transform(rest))


def select(df: DataFrame, candidates: list[FeatureSpec], label: str, excluded: list[str], time: str, row_id: str, stamp: str, **options) -> tuple[list[FeatureSpec], float, list[tuple]]:
    """(kept, best AUC, gains).  ``time`` orders the split, ``stamp`` is the events' timestamp."""
    if len(set(candidates)) != len(candidates):
        raise ValueError("a candidate is listed twice")
    base = columns_but(df, [label, *excluded])

    def evaluate(kept: list[FeatureSpec]) -> float:
        frame = add_features(df, kept, time=stamp, row_id=row_id) if kept else df
        return auc_of(frame, sorted({*base, *[s.name for s in kept]}), label, time, **options)

    return forward_selection(candidates, evaluate, evaluate([]))
