"""Factor values of new days from a state table, so that new days cost new days.

The state has the last rows of every code, as many as the widest window, with the panel's columns and the values of every windowed
sub-expression. A new day's windows read those rows instead of the history; means over all rows and running sums go on from their last
value; cross-sections are of the new days alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.factor import CODE, DATE
from .dsl import KEPT, LAST, OLD, Plan, parse, reach


def _levels(df: DataFrame, plan: Plan) -> DataFrame:
    for level in sorted(plan.levels):
        df = df.select("*", *[c.alias(n) for n, c in plan.levels[level]])
    return df


def _state(df: DataFrame, columns: list[str], plan: Plan, expressions: dict[str, str]) -> DataFrame:
    rows = max(1, *(reach(t) for t in expressions.values()))
    place = F.row_number().over(Window.partitionBy(CODE).orderBy(F.col(DATE).desc()))
    last = df.withColumn("__place", place).where(F.col("__place") <= rows)
    return last.select(*columns, *[F.col(n).alias(KEPT + n) for n in plan.kept], (F.col("__place") == 1).alias(LAST))


def _values(df: DataFrame, out: dict) -> DataFrame:
    return df.select(CODE, DATE, *[c.alias(n) for n, c in out.items()])


def begin(panel: DataFrame, expressions: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Values of all rows, and the state after them (to be written before days are added)."""
    plan = Plan()
    out = {n: plan.column(parse(t))[0] for n, t in expressions.items()}
    df = _levels(panel, plan)
    return _values(df, out), _state(df, panel.columns, plan, expressions)


def extend(state: DataFrame, rows: DataFrame, expressions: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Values of new rows and the state after them. rows: the panel's columns, all later than every row of their code in the state; codes may
    be new or have no new row. The expressions are those that the state was begun with, in the same order."""
    base = Plan()
    for text in expressions.values():
        base.column(parse(text))
    plan = Plan(base)
    out = {n: plan.column(parse(t))[0] for n, t in expressions.items()}
    both = state.withColumn(OLD, F.lit(True)).unionByName(rows.withColumns({OLD: F.lit(False), LAST: F.lit(False)}), allowMissingColumns=True)
    df = _levels(both, plan)
    return _values(df.where(~F.col(OLD)), out), _state(df, rows.columns, plan, expressions)
