"""Right-closed bins and labelled groups as generated CASE expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interval_labels(breaks: Sequence[float]) -> list[str]:
    """Labels of the right-closed intervals when the caller names none."""
    edges = ["-inf", *[f"{b:g}" for b in breaks], "inf"]
    last = len(edges) - 2
    return [f"({a}, {b}]" if i < last else f"({a}, {b})"
            for i, (a, b) in enumerate(zip(edges, edges[1:]))]


def cut(c: Column, breaks: Sequence[float], labels: Sequence[str] | None = None) -> Column:
    """Bin with right-closed edges; NULL stays NULL."""
    labels = list(labels) if labels is not None else interval_labels(breaks)
    if len(labels) != len(breaks) + 1:
        raise ValueError("cut needs one label more than there are breaks")
    expr = F.when(c.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(breaks, labels):
        expr = expr.when(c <= F.lit(edge), F.lit(label))
    return expr.otherwise(F.lit(labels[-1]))


def label_groups(df: DataFrame, groups: Mapping[str, Column], out: str) -> DataFrame:
    """First matching mask names the group; rows no mask takes are dropped."""
    return df.withColumn(
        out, F.coalesce(*[F.when(mask, F.lit(label)) for label, mask in groups.items()])
    ).where(F.col(out).isNotNull())


def code_groups(df: DataFrame, column: str, labels: Mapping[str, str], out: str) -> DataFrame:
    return label_groups(df, {label: F.col(column) == code for code, label in labels.items()}, out)


def value_groups(df: DataFrame, column: str, groups: Mapping[str, Sequence], out: str) -> DataFrame:
    return label_groups(df, {g: F.col(column).isin(*vals) for g, vals in groups.items()}, out)
