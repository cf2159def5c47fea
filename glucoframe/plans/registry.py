"""Query registry: name -> Spark callable (spark, sf_dir) and name -> DuckDB SQL.

Results are made comparable across engines by ``finish``: doubles rounded to
6 digits and NaN turned into null. The SQL twin applies the same rounding to
the columns listed in ``round_cols``.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glucoframe.sources.bindings import with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

_MODULES = ("glucoframe.plans.q_layout", "glucoframe.plans.q_encode", "glucoframe.plans.q_stats",
            "glucoframe.plans.q_segments", "glucoframe.plans.q_sampling",
            "glucoframe.plans.q_vectors", "glucoframe.plans.q_clinical",
            "glucoframe.plans.q_metrics", "glucoframe.plans.q_streams")



def load_all() -> None:
    for m in _MODULES:
        importlib.import_module(m)


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column and turn NaN into null."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f.name).cast("double")
            # round(x * 10^d) / 10^d: bit-identical to DuckDB's round(x, d) (Spark's
            # round(x, d) goes through the decimal text and differs on half-way values)
            scale = float(10 ** digits)
            c = F.nanvl(c, F.lit(None).cast("double"))
            # "+ 0.0" turns a negative zero into +0.0 (same in the SQL twin)
            cols.append((F.round(c * scale, 0) / scale + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def oracle(sql: str, views: Sequence[str] = (), round_cols: Sequence[str] = (), digits: int = 6) -> str:
    body = with_views(sql, *views)
    if not round_cols:
        return body
    rep = ", ".join(f"(round({c}, {digits}) + 0.0) AS {c}" for c in round_cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{body}\n) q"


def query(name: str, sql: str | None = None, views: Sequence[str] = (),
          round_cols: Sequence[str] = ()):
    """Register ``fn(spark, sf_dir) -> DataFrame`` (finished) and its optional SQL twin."""
    def deco(fn):
        def run(spark, sf_dir):
            return finish(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql, views, round_cols)
        return fn
    return deco
