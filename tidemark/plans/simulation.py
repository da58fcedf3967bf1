"""A two-compartment fluid model under the simulation operators: baseline, bands, dose sweep, screen, expectations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.simulate import Model, Parameter, bands, expectations, extremes, influence, runs_frame, sample, simulate

PARAMETERS = {
    "volume": Parameter(42.0, 36.0, 48.0), "split": Parameter(0.35, 0.3, 0.4), "exchange": Parameter(0.08, 0.02, 0.2),
    "loss": Parameter(0.0015, 0.001, 0.002), "gain": Parameter(0.02, 0.005, 0.08), "intake": Parameter(1.0, 1.0, 1.0, drawn=False),
}


def _start(p):
    return [p["volume"] * p["split"], p["volume"] * (1 - p["split"]), np.zeros_like(p["volume"])]


def _rhs(t, y, p, u):
    outer, inner, out = y
    target = p["volume"] * p["split"]
    across = p["exchange"] * (outer - inner * p["split"] / (1 - p["split"]))
    lost = np.maximum(0.0, p["loss"] + p["gain"] * (outer - target))
    return np.stack([p["intake"] * p["loss"] + u - lost - across, across, lost])


MODEL = Model(("outer", "inner", "lost"), _rhs, _start, {"total": lambda y, p: y[0] + y[1]})
T_END, DT, EVERY, DOSE = 360.0, 1.0, 10.0, (30.0, 15.0)


def _feasible(p: dict[str, float]) -> bool:
    return p["volume"] * p["split"] > 10


def baseline(spark: SparkSession, d: str) -> DataFrame:
    return simulate(runs_frame(spark, [{n: x.value for n, x in PARAMETERS.items()}]), MODEL, list(PARAMETERS), T_END, DT, EVERY)


def mc_bands(spark: SparkSession, d: str) -> DataFrame:
    return bands(simulate(runs_frame(spark, sample(PARAMETERS, 200, 1, _feasible), [1.0]), MODEL, list(PARAMETERS), T_END, DT, EVERY, DOSE))


def dose_sweep(spark: SparkSession, d: str) -> DataFrame:
    amounts = [0.0, 0.25, 0.5, 1.0, 2.0]
    out = extremes(simulate(runs_frame(spark, sample(PARAMETERS, 50, 2, _feasible), amounts), MODEL, list(PARAMETERS), T_END, DT, EVERY, DOSE)).filter("key = 'outer'")
    dose = F.element_at(F.array(*[F.lit(a) for a in amounts]), (F.col("run_id") % len(amounts) + 1).cast("int"))
    rise = F.col("peak") - F.col("start")
    return out.groupBy(dose.alias("amount")).agg(F.percentile(rise, F.lit(0.05)).alias("low"), F.percentile(rise, F.lit(0.5)).alias("mid"), F.percentile(rise, F.lit(0.95)).alias("high"), F.count("recovered_at").alias("recovered"))


def screen(spark: SparkSession, d: str) -> DataFrame:
    return influence(spark, MODEL, PARAMETERS, "outer", T_END, DT, EVERY, DOSE, 1.0)


def checks(spark: SparkSession, d: str) -> DataFrame:
    run = simulate(runs_frame(spark, [{n: x.value for n, x in PARAMETERS.items()}], [1.0]), MODEL, list(PARAMETERS), T_END, DT, EVERY, DOSE)
    e = extremes(run).filter("key = 'outer'")
    actual = e.select(F.expr("stack(3, 'rise', peak - start, 'peak_at', peak_at, 'recovered_at', recovered_at) as (metric, value)"))
    return expectations(actual, [("the dose arrives", "rise", 0.3, 1.0, "validation"), ("peak when the dose ends", "peak_at", 40.0, 50.0, "validation"), ("back within hours", "recovered_at", 60.0, 360.0, "calibration"), ("no such metric", "none", 0.0, 1.0, "validation")])


QUERIES = {"sim_baseline": (baseline, None), "mc_bands": (mc_bands, None), "dose_sweep": (dose_sweep, None), "influence": (screen, None), "expectations": (checks, None)}
