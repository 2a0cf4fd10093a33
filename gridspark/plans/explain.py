"""Looking at plans: what a query reads, shuffles and runs outside the JVM."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class PlanFacts:
    """Counts of a physical plan's operators, and the columns and filters that reach the scans."""

    exchanges: int
    broadcasts: int
    nested_loops: int
    cartesian: int
    python: int
    codegen: int
    read_columns: tuple[tuple[str, ...], ...]
    pushed_filters: tuple[str, ...]


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def facts(df: DataFrame) -> PlanFacts:
    text = plan_text(df)
    tree = text.split("\n\n\n", 1)[0]
    count = lambda pattern: len(re.findall(pattern, tree, re.M))
    columns = tuple(tuple(re.findall(r"(\w+):", m)) for m in re.findall(r"^ReadSchema: struct<(.*)>", text, re.M))
    filters = tuple(re.findall(r"^PushedFilters: \[(.*)\]", text, re.M))
    return PlanFacts(count(r"[-+ ]Exchange "), count("BroadcastExchange"), count("BroadcastNestedLoopJoin"), count("CartesianProduct"), count(r"Python|Pandas|ArrowEval|MapInArrow"), count(r"\* "), columns, filters)


def require_scalable(df: DataFrame, most_exchanges: int | None = None) -> PlanFacts:
    """Raise where a plan multiplies two large sides, or shuffles more often than expected."""
    own = facts(df)
    if own.cartesian:
        raise AssertionError("the plan holds a Cartesian product")
    if most_exchanges is not None and own.exchanges > most_exchanges:
        raise AssertionError(f"{own.exchanges} exchanges where {most_exchanges} should do")
    return own
