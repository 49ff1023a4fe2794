"""Models over rows: grids, dispatch, isolated predictions, contact sheets, audits, chat messages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid(rows: DataFrame, *axes: tuple[str, list]) -> DataFrame:
    """Each row with every combination of the axes' values: no join, the axes are constants."""
    for name, values in axes:
        rows = rows.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return rows


def dispatch(name: Column, cases: dict[str, Column], aliases: dict[str, str] | None = None) -> Column:
    """The value of the backend's case; an unknown backend is an error."""
    key, out = F.lower(F.trim(name)), None
    for alias, target in (aliases or {}).items():
        cases = cases | {alias: cases[target]}
    for case, value in cases.items():
        out = F.when(key == case, value) if out is None else out.when(key == case, value)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown backend: "), key)))


def predicted(df: DataFrame, inputs: list[str], make: Callable[[], Callable], to: str = "prediction") -> DataFrame:
    """``df`` with predictions and errors: the model is made once a task; a failing row gets an empty
    prediction and its error, and all rows stay."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{to}` string, error string"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for part in parts:
            out, errors = [], []
            for values in part[inputs].itertuples(index=False):
                try:
                    out.append(model(*values))
                    errors.append(None)
                except Exception as e:  # any failure of a model is the row's
                    out.append("")
                    errors.append(f"{type(e).__name__}: {e}")
            part[to], part["error"] = out, errors
            yield part

    return df.mapInPandas(run, schema)


def sheet(df: DataFrame, row: str, cell: str, value: str, cells: list) -> DataFrame:
    """One row per sample, one column per cell of a known list."""
    return df.groupBy(row).pivot(cell, cells).agg(F.min(value))


def audit(damage: Column, overlap: Column, darkness: Column, hard: tuple = (0.45, 0.18, 0.30), soft: tuple = (0.25, 0.32, 0.55)) -> Column:
    """drop beyond a hard bound on any axis, soft beyond a soft one, else keep."""
    beyond = lambda b: (damage > b[0]) | (overlap < b[1]) | (darkness < b[2])
    return F.when(beyond(hard), "drop").when(beyond(soft), "soft").otherwise("keep")


def messages(df: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """One row per conversation: its turns in order."""
    turns = F.array_sort(F.collect_list(F.struct(order, role, text)))
    return df.groupBy(key).agg(F.transform(turns, lambda t: F.struct(t[role].alias("role"), t[text].alias("content"))).alias("messages"))


def first_existing(df: DataFrame, key: str, candidates: str, present: DataFrame, path: str) -> DataFrame:
    """(key, path): the first of each row's candidates that is present."""
    each = df.select(key, F.posexplode(candidates).alias("__place", path))
    return each.join(present.select(path).distinct(), path).groupBy(key).agg(F.min_by(path, "__place").alias(path))


def companion(a: DataFrame, b: DataFrame, folder: str, prefix_order: list[str], path: str) -> DataFrame:
    """Rows of ``a`` with the first file of ``b`` in their folder, by suffix order, then name."""
    place = F.array_position(F.array(*map(F.lit, prefix_order)), F.regexp_extract(path, r"[^.]*$", 0))
    best = b.where(place > 0).groupBy(folder).agg(F.min_by(path, F.struct(place.alias("p"), F.col(path).alias("n"))).alias("companion"))
    return a.join(best, folder, "left")
