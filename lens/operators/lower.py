"""Logical nodes to DataFrames. Catalyst does the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lens.errors import EngineError
from lens.plans import logical as L
from lens.plans.lexer import unsupported


def _ordered(key: Column, descending: bool, nulls_first: bool) -> Column:
    if descending:
        return key.desc_nulls_first() if nulls_first else key.desc_nulls_last()
    return key.asc_nulls_first() if nulls_first else key.asc_nulls_last()


#: What Spark's LIMIT and OFFSET can count.
MOST_ROWS = 2**31 - 1


def _far(df: DataFrame, offset: int, limit: int | None) -> DataFrame:
    """LIMIT or OFFSET beyond MOST_ROWS, exactly: the rows are counted first, and what they don't reach is no bound at all."""
    if df.isStreaming:
        raise unsupported(f"LIMIT above {MOST_ROWS} over an endless source")
    n = df.count()
    if offset >= n:
        return df.limit(0)
    if offset > MOST_ROWS:
        raise unsupported(f"OFFSET above {MOST_ROWS} into as many rows", hint="put a condition on the ordering column into WHERE")
    df = df.offset(offset) if offset else df
    if limit is None or limit >= n - offset:
        return df
    if limit > MOST_ROWS:
        raise unsupported(f"LIMIT above {MOST_ROWS} of more rows", hint="put a condition on the ordering column into WHERE")
    return df.limit(limit)


def _streaming(plan: L.Plan) -> bool:
    return isinstance(plan, L.Scan) and plan.streaming or any(_streaming(p) for p in plan.below)


def _distinct_sorted(plan: L.Sort, project: L.Project, df: DataFrame) -> DataFrame:
    """DISTINCT over a sorted projection. Where each sort key is an output column, duplicates go first; else the first row
    of each set of equal outputs, in sort order, stands for it."""
    n = len(project.columns)
    outs = [f"o{k}" for k in range(n)]
    named = [c.alias(o) for c, o in zip(project.columns, outs, strict=True)]
    if all(k is not None for k in plan.covered):
        keys = [_ordered(F.col(outs[k]), d, f) for k, (_, d, f) in zip(plan.covered, plan.keys, strict=True)]
        return df.select(*named).distinct().orderBy(*keys).toDF(*project.names)
    sorts = [f"s{k}" for k in range(len(plan.keys))]
    wide = df.select(*named, *[c.alias(s) for (c, _, _), s in zip(plan.keys, sorts, strict=True)])
    order = [_ordered(F.col(s), d, f) for s, (_, d, f) in zip(sorts, plan.keys, strict=True)]
    first = wide.withColumn("rn", F.row_number().over(Window.partitionBy(*outs).orderBy(*order))).where("rn = 1")
    return first.orderBy(*order).select(*outs).toDF(*project.names)


def lower(plan: L.Plan, spark: SparkSession) -> DataFrame:
    if isinstance(plan, L.Values):
        return spark.range(1).select()
    if isinstance(plan, L.Scan):
        return plan.load()
    if isinstance(plan, L.Distinct) and isinstance(plan.below[0].below[0], L.Sort):
        project = plan.below[0]
        if _streaming(plan):
            raise unsupported("ORDER BY over an endless source")
        return _distinct_sorted(project.below[0], project, lower(project.below[0].below[0], spark))
    if isinstance(plan, L.Join):
        left, right = (lower(p, spark) for p in plan.below)
        return left.join(right, plan.on, "left" if plan.left else "inner")
    df = lower(plan.below[0], spark)
    if isinstance(plan, L.Filter):
        return df.where(plan.condition)
    if isinstance(plan, L.Aggregate):
        if df.isStreaming:
            raise unsupported("GROUP BY over an endless source")
        grouped = df.groupBy(*plan.keys)
        if plan.calls:
            return grouped.agg(*plan.calls)
        return df.select(*plan.keys).distinct() if plan.keys else grouped.agg(F.count(F.lit(1)).alias("n"))
    if isinstance(plan, L.Sort):
        if df.isStreaming:
            raise unsupported("ORDER BY over an endless source")
        return df.orderBy(*[_ordered(*k) for k in plan.keys])
    if isinstance(plan, L.Project):
        return df.select(*[c.alias(f"o{k}") for k, c in enumerate(plan.columns)]).toDF(*plan.names)
    if isinstance(plan, L.Distinct):
        return df.distinct()
    if isinstance(plan, L.Limit):
        if plan.offset and df.isStreaming:
            raise unsupported("OFFSET over an endless source")
        if plan.offset > MOST_ROWS or (plan.limit or 0) > MOST_ROWS:
            return _far(df, plan.offset, plan.limit)
        df = df.offset(plan.offset) if plan.offset else df
        return df if plan.limit is None else df.limit(plan.limit)
    raise EngineError("XX000", f"no such node: {plan}")
