"""Meal features and what-if tables.

Fixed values: 4 readings before and 8 after a meal; energy per gram 4 kcal
(carbohydrate, protein) and 9 kcal (fat); fiber scenarios 0.03 and 0.06 of
carbohydrate (Q7); high-heat scenario ratio 5:2:3 then x 1.2; default
reallocation ratio (4, 2, 4).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUTRIENTS = ["Heat", "Carbohydrate", "Fat", "Protein", "DietaryFiber"]
N_BEFORE, N_AFTER = 4, 8
DEFAULT_RATIO = (4, 2, 4)
HIGH_HEAT_RATIO = (5, 2, 3)
HIGH_HEAT_FACTOR = 1.2


# ---- D1 ----------------------------------------------------------------------------------
def meal_features(series: DataFrame, meals: DataFrame, key: str = "person", pos: str = "rank",
                  value: str = "value", meal_id: str = "meal_id",
                  n_before: int = N_BEFORE, n_after: int = N_AFTER) -> DataFrame:
    """Readings at positions pos-4..pos-1 (``pre``) and pos+1..pos+8 (``post``)
    around each meal, as arrays (missing -> null).

    Each meal is exploded into its 12 offsets and equi-joined to the series on
    (key, position): no range join, no per-person collection.
    """
    offs = list(range(-n_before, 0)) + list(range(1, n_after + 1))
    m = meals.select(meal_id, key, F.col(pos).alias("_mpos"),
                     F.explode(F.array(*[F.lit(o) for o in offs])).alias("_off"))
    m = m.withColumn(pos, F.col("_mpos") + F.col("_off"))
    j = m.join(series.select(key, pos, F.col(value).alias("_v")), [key, pos], "left")
    g = j.groupBy(meal_id, key).agg(F.map_from_entries(F.collect_list(F.struct("_off", "_v"))).alias("_m"))
    pre = F.array(*[F.element_at("_m", F.lit(o)) for o in range(-n_before, 0)])
    post = F.array(*[F.element_at("_m", F.lit(o)) for o in range(1, n_after + 1)])
    return g.select(meal_id, key, pre.alias("pre"), post.alias("post"))


# ---- D2-D5 -----------------------------------------------------------------------------------
def reallocate_macros(df: DataFrame, ratio: Sequence[float] = DEFAULT_RATIO) -> DataFrame:
    """carbohydrate = heat*r0/sum/4, protein = heat*r1/sum/4, fat = heat*r2/sum/9."""
    s = float(sum(ratio))
    return (df.withColumn("Carbohydrate", F.col("Heat") * ratio[0] / s / 4.0)
              .withColumn("Protein", F.col("Heat") * ratio[1] / s / 4.0)
              .withColumn("Fat", F.col("Heat") * ratio[2] / s / 9.0))


def fiber_scenario(df: DataFrame, k: float) -> DataFrame:
    """D3: fiber = carbohydrate x k (0.03 for the 'H' scenario, 0.06 for 'L', Q7)."""
    return df.withColumn("DietaryFiber", F.col("Carbohydrate") * k)


def scale_scenario(df: DataFrame, factor: float = HIGH_HEAT_FACTOR,
                   cols: Sequence[str] = NUTRIENTS) -> DataFrame:
    """Every nutrient x factor (after a 5:2:3 reallocation in the high-heat scenario)."""
    for c in cols:
        df = df.withColumn(c, F.col(c) * factor)
    return df


def scenario(df: DataFrame, name: str, ratio: Sequence[float] = DEFAULT_RATIO, fiber: str = "") -> DataFrame:
    """The reference's named perturbations: RawHeat / HighHeat / Standard."""
    if name == "RawHeat":
        out = reallocate_macros(df, ratio)
        if fiber == "H":
            out = fiber_scenario(out, 0.03)
        elif fiber == "L":
            out = fiber_scenario(out, 0.06)
        return out
    if name == "HighHeat":
        return scale_scenario(reallocate_macros(df, HIGH_HEAT_RATIO))
    if name == "Standard":
        return reallocate_macros(df, HIGH_HEAT_RATIO)
    raise ValueError(f"unknown scenario {name}")


def stack_scenarios(original: DataFrame, perturbed: DataFrame, flag: str = "is_test") -> DataFrame:
    """Original rows (flag false) followed by scenario rows (flag true, the scored half)."""
    return (original.withColumn(flag, F.lit(False))
            .unionByName(perturbed.withColumn(flag, F.lit(True))))


# ---- D6 / D7 / X9 ------------------------------------------------------------------------------
def fold_select(df: DataFrame, folds: DataFrame, key: str, k: int, flag_prefix: str = "test_") -> DataFrame:
    """Rows flagged as test in repetition ``k`` of a fold table (key, test_0..test_n)."""
    return df.join(folds.filter(F.col(f"{flag_prefix}{k}")).select(key), key, "left_semi")


def autoregressive_inputs(df: DataFrame, pre: str = "pre", nutrients: Sequence[str] = NUTRIENTS,
                          out: str = "steps") -> DataFrame:
    """One step per pre-meal reading; nutrients are zero on the first steps and set
    on the last pre-meal step (the meal)."""
    n = F.size(pre)

    def step(x, i):
        last = i == n - 1
        return F.struct(x.alias("glucose"), *[F.when(last, F.col(c)).otherwise(F.lit(0.0)).alias(c)
                                              for c in nutrients])
    return df.withColumn(out, F.transform(pre, step))


def persistence_forecast(df: DataFrame, pre: str = "pre", horizon: int = N_AFTER,
                         out: str = "pred") -> DataFrame:
    """Baseline forecast = last pre-meal reading repeated for every horizon step."""
    return df.withColumn(out, F.array_repeat(F.element_at(pre, -1), horizon))
