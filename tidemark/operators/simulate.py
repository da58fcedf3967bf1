"""Many independent runs of an ODE model, and what is asked of them.

A model is a right-hand side over states that is vectorised over runs: one
NumPy integration advances all runs of a batch together. Runs (their
parameters, dose and schedule) are rows; trajectories come out as long rows
(run_id, t, key, value). Sampling is sequential by definition and small, so it
happens on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

OUT = "run_id bigint, t double, key string, value double"


@dataclass(frozen=True)
class Model:
    """``rhs(t, y, p, u)`` and ``start(p)`` take and give arrays of shape (states or nothing, runs); ``u`` is the input rate."""

    states: tuple[str, ...]
    rhs: Callable
    start: Callable
    derived: dict[str, Callable] = field(default_factory=dict)


@dataclass(frozen=True)
class Parameter:
    """A value, the range it may be drawn from, and whether it is drawn at all."""

    value: float
    lo: float
    hi: float
    drawn: bool = True


def rk4(model: Model, p: dict[str, np.ndarray], doses: list[tuple[float, float, np.ndarray]], t_end: float, dt: float, every: float, max_step: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(times, states x times x runs) by the classical fixed-step method.

    Steps are split at the begin and end of every dose (begin, length, amount
    per run), and a dose's rate is taken at the middle of a step, so a bolus
    goes in exactly.
    """
    y = np.stack(model.start(p))
    stops = sorted({0.0, t_end, *np.arange(0, t_end + every / 2, every).clip(max=t_end).tolist(), *[x for b, n, _ in doses for x in (b, b + n) if 0 < x < t_end]})
    keep = {round(x, 9) for x in [*np.arange(0, t_end + every / 2, every).clip(max=t_end).tolist(), t_end]}
    times, out = [0.0], [y.copy()]
    step = min(dt, max_step) if max_step else dt
    for a, b in zip(stops, stops[1:]):
        n = max(1, math.ceil((b - a) / step - 1e-9))
        h = (b - a) / n
        mid = (a + b) / 2
        u = sum((amount / length for begin, length, amount in doses if begin <= mid < begin + length), np.zeros(y.shape[1]))
        for i in range(n):
            t = a + i * h
            k1 = model.rhs(t, y, p, u)
            k2 = model.rhs(t + h / 2, y + h / 2 * k1, p, u)
            k3 = model.rhs(t + h / 2, y + h / 2 * k2, p, u)
            k4 = model.rhs(t + h, y + h * k3, p, u)
            y = y + h / 6 * (k1 + 2 * k2 + 2 * k3 + k4)
        if round(b, 9) in keep:
            times.append(b)
            out.append(y.copy())
    return np.array(times), np.stack(out, 1)


def simulate(runs: DataFrame, model: Model, names: list[str], t_end: float, dt: float, every: float, dose: tuple[float, float] | None = None) -> DataFrame:
    """Trajectories of all runs: rows of run_id, the parameters ``names`` and (with ``dose`` = begin, length) an ``amount``.

    A run whose trajectory isn't finite ends the job: it is no result.
    """

    def batchwise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            p = {n: batch[n].to_numpy(float) for n in names}
            doses = [(dose[0], dose[1], batch["amount"].to_numpy(float))] if dose else []
            t, y = rk4(model, p, doses, t_end, dt, every)
            keys = {s: y[i] for i, s in enumerate(model.states)} | {k: f(y, p) for k, f in model.derived.items()}
            ids = batch["run_id"].to_numpy()
            for key, v in keys.items():
                if not np.isfinite(v).all():
                    raise ArithmeticError(f"{key} isn't finite in run {ids[np.argwhere(~np.isfinite(v))[0][1]]}")
                yield pd.DataFrame({"run_id": np.tile(ids, len(t)), "t": np.repeat(t, len(ids)), "key": key, "value": v.reshape(-1)})

    cores = runs.sparkSession.sparkContext.defaultParallelism
    return runs.repartition(cores).mapInPandas(batchwise, OUT)


def mulberry32(seed: int) -> Callable[[], float]:
    """A small public-domain generator of numbers in [0, 1) on 32-bit arithmetic."""
    state = seed & 0xFFFFFFFF

    def draw() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((state ^ (state >> 15)) * (state | 1)) & 0xFFFFFFFF
        t ^= (t + ((t ^ (t >> 7)) * (t | 61))) & 0xFFFFFFFF
        return ((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296

    return draw


def sample(table: dict[str, Parameter], n: int, seed: int, feasible: Callable[[dict[str, float]], bool]) -> list[dict[str, float]]:
    """``n`` feasible parameter sets in 50 * n tries; log-uniform where the range spans more than a factor of 5; fixed ones take no draw."""
    draw, out = mulberry32(seed), []
    for _ in range(50 * n):
        one = {}
        for name, x in table.items():
            if not x.drawn:
                one[name] = x.value
            elif x.lo > 0 and x.hi / x.lo > 5:
                one[name] = math.exp(math.log(x.lo) + draw() * (math.log(x.hi) - math.log(x.lo)))
            else:
                one[name] = x.lo + draw() * (x.hi - x.lo)
        if feasible(one):
            out.append(one)
            if len(out) == n:
                return out
    raise ValueError(f"only {len(out)} of {n} feasible sets in {50 * n} tries")


def runs_frame(spark: SparkSession, sets: list[dict[str, float]], amounts: list[float] | None = None) -> DataFrame:
    """Runs as rows; with amounts every set meets every amount (common random numbers), run_id = set * len(amounts) + index."""
    names = list(sets[0])
    rows = [(i * len(amounts or [0.0]) + j, *[s[n] for n in names], float(a)) for i, s in enumerate(sets) for j, a in enumerate(amounts or [0.0])]
    return spark.createDataFrame(rows, "run_id bigint, " + ", ".join(f"{n} double" for n in names) + ", amount double")


def bands(trajectories: DataFrame, quantiles: tuple[float, float, float] = (0.05, 0.5, 0.95)) -> DataFrame:
    """Bands per time and key, of the value and of its change since the start (linear quantiles)."""
    first = trajectories.filter("t = 0").select("run_id", "key", F.col("value").alias("__v0"))
    both = trajectories.join(first, ["run_id", "key"])
    at = lambda c: F.percentile(c, F.array(*[F.lit(q) for q in quantiles]))
    out = both.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), at(F.col("value")).alias("v"), at(F.col("value") - F.col("__v0")).alias("c"))
    return out.select("t", "key", "n", *[F.get(x, i).alias(f"{x}_{name}") for x in "vc" for i, name in enumerate(("low", "mid", "high"))])


def influence(spark: SparkSession, model: Model, table: dict[str, Parameter], key: str, t_end: float, dt: float, every: float, dose: tuple[float, float] | None, amount: float, rel: float = 0.1) -> DataFrame:
    """One-at-a-time screen: largest change of ``key`` against the reference run, relative to the reference's largest value."""
    base = {n: x.value for n, x in table.items()}
    names = list(base)
    sets = [base] + [base | {n: base[n] * (1 + rel)} for n in names]
    frame = runs_frame(spark, sets).withColumn("amount", F.lit(float(amount)))
    out = simulate(frame, model, names, t_end, dt, every, dose).filter(F.col("key") == key)
    reference = out.filter("run_id = 0").select("t", F.col("value").alias("__r"))
    diff = out.filter("run_id > 0").join(F.broadcast(reference), "t")
    per = diff.groupBy("run_id").agg(F.try_divide(F.max(F.abs(F.col("value") - F.col("__r"))), F.max(F.abs("__r"))).alias("influence"))
    label = spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "run_id bigint, parameter string")
    return per.join(label, "run_id").select("parameter", "influence")


def extremes(trajectories: DataFrame, within: float = 0.02) -> DataFrame:
    """Per run and key: start, peak and nadir with their first times, and when the value is back within a share of its start after its peak."""
    first = F.min(F.struct("t", "value"))
    base = trajectories.groupBy("run_id", "key").agg(first.alias("s"), F.max(F.struct("value", (-F.col("t")).alias("m"))).alias("p"), F.min(F.struct("value", "t")).alias("n"))
    back = trajectories.join(base, ["run_id", "key"]).filter((F.col("t") > -F.col("p.m")) & (F.abs(F.col("value") - F.col("s.value")) <= within * F.abs("s.value")))
    when = back.groupBy("run_id", "key").agg(F.min("t").alias("recovered_at"))
    return base.join(when, ["run_id", "key"], "left").select("run_id", "key", F.col("s.value").alias("start"), F.col("p.value").alias("peak"), (-F.col("p.m")).alias("peak_at"), F.col("n.value").alias("nadir"), F.col("n.t").alias("nadir_at"), "recovered_at")


def expectations(actual: DataFrame, expected: list[tuple[str, str, float, float, str]]) -> DataFrame:
    """One row per expectation (name, metric, lo, hi, role): pass, fail or not_checked; only role 'validation' counts."""
    rows = actual.sparkSession.createDataFrame(expected, "name string, metric string, lo double, hi double, role string")
    both = rows.join(actual, "metric", "left")
    status = F.when(F.col("value").isNull() | F.isnan("value"), "not_checked").when((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi")), "pass").otherwise("fail")
    return both.select("name", "metric", "value", status.alias("status"), (F.col("role") == "validation").alias("counted"))
