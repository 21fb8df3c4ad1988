"""Window-state sequences: gaps, forecast pairs, delta models and re-anchoring."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.operators.ordered import ROWS_PER_TASK, ordered
from flowspark.session import checkpointed

# Noise levels and initial uncertainty of the re-anchoring gain.
PROCESS_NOISE, MEASUREMENT_NOISE, INITIAL_P = 0.05, 2.0, 100.0
HORIZONS = 3
SLICE_WINDOWS = 4096
MIN_SCALE = 1e-3


def window_gaps(states: DataFrame, limit: int = ROWS_PER_TASK) -> DataFrame:
    """Add ``gap``: the window does not follow its predecessor (the first one included),
    and ``run``, the count of gaps so far."""
    rows = ordered(states, ["capture"], ["window"], limit).lag(_prev="window")
    gap = F.coalesce(F.col("window") != F.col("_prev") + 1, F.lit(True))
    return rows.with_column("gap", gap).running(run=("sum", F.col("gap").cast("bigint"))).done().drop("_prev")


def state_errors(states: DataFrame) -> DataFrame:
    """Captures whose states are unusable, with the reason."""
    finite = F.forall("state", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    checks = states.groupBy("capture").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_distinct("window").alias("_windows"),
        F.min(F.size("state")).alias("_lo"),
        F.max(F.size("state")).alias("_hi"),
        F.bool_and(finite).alias("_finite"),
    )
    reason = (
        F.when(F.col("_n") != F.col("_windows"), "repeated_window")
        .when((F.col("_lo") != F.col("_hi")) | (F.col("_lo") < 1), "dimension")
        .when(~F.col("_finite"), "nonfinite_state")
    )
    return checks.select("capture", reason.alias("reason")).where("reason IS NOT NULL")


def forecast_pairs(states: DataFrame, limit: int = ROWS_PER_TASK) -> DataFrame:
    """Anchors followed by three consecutive windows: (capture, window, state, targets)."""
    rows = ordered(states, ["capture"], ["window"], limit)
    for step in range(1, HORIZONS + 1):
        before = "" if step == 1 else f"_{step - 1}"
        rows = rows.lag(**{f"_w_{step}": f"_w{before}" if before else "window", f"_s_{step}": f"_s{before}" if before else "state"})
    together = F.col(f"_w_{HORIZONS}") == F.col("window") - HORIZONS
    for step in range(1, HORIZONS):
        together = together & (F.col(f"_w_{step}") == F.col("window") - step)
    targets = F.array(*[F.col(f"_s_{HORIZONS - h}") for h in range(1, HORIZONS)], F.col("state"))
    return rows.done().where(together).select(
        "capture", F.col(f"_w_{HORIZONS}").alias("window"), F.col(f"_s_{HORIZONS}").alias("anchor"), targets.alias("targets")
    )


def _by_dimension(pairs: DataFrame) -> DataFrame:
    flat = pairs.select("capture", "window", "anchor", F.posexplode("targets").alias("_h", "target"))
    zipped = F.arrays_zip("anchor", "target")
    return flat.select("capture", "window", (F.col("_h") + 1).alias("horizon"), F.posexplode(zipped).alias("dim", "_z")).select(
        "capture", "window", "horizon", "dim", F.col("_z.anchor").alias("x"), F.col("_z.target").alias("y")
    )


def fit_delta(pairs: DataFrame) -> DataFrame:
    """Least-squares delta per (horizon, dim): y - x against x."""
    flat = _by_dimension(pairs).withColumn("d", F.col("y") - F.col("x"))
    fitted = flat.groupBy("horizon", "dim").agg(
        F.count(F.lit(1)).alias("pairs"), F.regr_slope("d", "x").alias("slope"), F.regr_intercept("d", "x").alias("intercept")
    )
    return fitted.na.fill({"slope": 0.0}).withColumn("intercept", F.coalesce("intercept", F.lit(0.0)))


def forecast(states: DataFrame, model: DataFrame, anchor: str = "state") -> DataFrame:
    """State forecasts per horizon: anchor plus the fitted delta, dimension by dimension."""
    flat = states.select("capture", "window", F.posexplode(anchor).alias("dim", "x"))
    joined = flat.join(model, "dim")
    value = F.col("x") + F.col("slope") * F.col("x") + F.col("intercept")
    return joined.select("capture", "window", "horizon", "dim", value.alias("forecast"))


def _gains(start: int, n: int, q: float, r: float, p0: float) -> np.ndarray:
    """Correction gains of positions start.. of a run; position 0 starts it, uncorrected."""
    p, out = p0, []
    for position in range(start + n):
        gain = 1.0
        if position:
            p += q
            gain = p / (p + r)
            p *= 1.0 - gain
        if position >= start:
            out.append(gain)
    return np.array(out)


def _steps(frame: pd.DataFrame, q: float, r: float, p0: float):
    """Affine steps anchor = c * previous + d of one slice of a run, per dimension."""
    frame = frame.sort_values("window", kind="stable")
    observed = np.stack(frame["state"].to_numpy())
    slope, intercept = (np.asarray(frame[c].iloc[0]) for c in ("slope", "intercept"))
    gain = _gains(int(frame["position"].iloc[0]), len(frame), q, r, p0)[:, None]
    return frame, (1 - gain) * slope, (1 - gain) * intercept + gain * observed


def reanchor(
    states: DataFrame,
    slope: Column | None = None,
    intercept: Column | None = None,
    q: float = PROCESS_NOISE,
    r: float = MEASUREMENT_NOISE,
    p0: float = INITIAL_P,
    slice_windows: int = SLICE_WINDOWS,
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """Corrected states of the recurrence that blends each window's one-step prior
    (slope * anchor + intercept per dimension, identity by default) with its observation.

    A gap starts a new run, whose first window is taken as observed.  The recurrence is
    affine and its gains depend only on the position in the run, so slices of a run reduce
    to one affine map each; entry states follow from those maps, and all slices then
    resolve in parallel.  Adds ``anchor``, ``prior_mse``, ``reanchored`` and ``gap``.
    """
    size = F.size("state")
    gapped = window_gaps(states, limit)
    runs = gapped.withColumns(
        {
            "slope": slope if slope is not None else F.array_repeat(F.lit(1.0), size),
            "intercept": intercept if intercept is not None else F.array_repeat(F.lit(0.0), size),
        }
    )
    firsts = gapped.where("gap").select("capture", "run", F.col("window").alias("_start"))
    rows = runs.join(firsts, ["capture", "run"]).withColumn("position", F.col("window") - F.col("_start")).drop("_start")
    rows = checkpointed(rows.withColumn("part", F.floor(F.col("position") / slice_windows)))
    keys = ["capture", "run", "part"]
    vector = T.ArrayType(T.DoubleType())
    key_fields = [rows.schema[k] for k in keys]

    def reduce(frame: pd.DataFrame) -> pd.DataFrame:
        frame, c, d = _steps(frame, q, r, p0)
        scale, shift = np.ones(c.shape[1]), np.zeros(c.shape[1])
        for ci, di in zip(c, d):
            scale, shift = ci * scale, ci * shift + di
        return pd.DataFrame([{**{k: frame[k].iloc[0] for k in keys}, "scale": scale, "shift": shift}])

    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part", kind="stable")
        entry, entries = np.zeros(len(frame["shift"].iloc[0])), []
        for scale, shift in zip(frame["scale"], frame["shift"]):
            entries.append(entry)
            entry = np.asarray(scale) * entry + np.asarray(shift)
        return frame.assign(entry=entries)[[*keys, "entry"]]

    def resolve(frame: pd.DataFrame) -> pd.DataFrame:
        frame, c, d = _steps(frame, q, r, p0)
        slope_, intercept_ = (np.asarray(frame[n].iloc[0]) for n in ("slope", "intercept"))
        previous, anchors, errors = np.asarray(frame["entry"].iloc[0]), [], []
        for ci, di, obs, first in zip(c, d, frame["state"], frame["gap"]):
            prior = slope_ * previous + intercept_
            errors.append(None if first else float(np.mean((prior - np.asarray(obs)) ** 2)))
            previous = ci * previous + di
            anchors.append(previous)
        return frame.assign(anchor=anchors, prior_mse=errors)[["capture", "window", "state", "gap", "anchor", "prior_mse"]]

    # Only runs longer than one slice need entry states; a run's first window takes none.
    fresh = F.array_repeat(F.lit(0.0), size)
    cut = rows.where("part > 0").select("capture", "run").distinct()
    if cut.isEmpty():
        entered = rows.withColumn("entry", fresh)
    else:
        maps = rows.join(cut, ["capture", "run"], "left_semi").groupBy(*keys).applyInPandas(
            reduce, T.StructType([*key_fields, T.StructField("scale", vector), T.StructField("shift", vector)])
        )
        # One row per slice of a run: thousands of windows each.
        chained = maps.groupBy("capture", "run").applyInPandas(chain, T.StructType([*key_fields, T.StructField("entry", vector)]))
        entered = rows.join(chained, keys, "left").withColumn("entry", F.coalesce("entry", fresh))
    final = T.StructType(
        [rows.schema["capture"], rows.schema["window"], T.StructField("state", vector), T.StructField("gap", T.BooleanType()),
         T.StructField("anchor", vector), T.StructField("prior_mse", T.DoubleType())]
    )
    out = entered.groupBy(*keys).applyInPandas(resolve, final)
    return out.withColumn("reanchored", ~F.col("gap"))


def forecast_report(forecasts: DataFrame, pairs: DataFrame, scale: DataFrame) -> DataFrame:
    """Normalized squared error per capture and horizon against carrying the state forward.

    ``scale`` holds one deviation per dimension; ``beats`` says the forecast is better.
    """
    flat = _by_dimension(pairs).join(scale.select("dim", "scale"), "dim")
    joined = flat.join(forecasts, ["capture", "window", "horizon", "dim"])
    report = joined.groupBy("capture", "horizon").agg(
        F.count_distinct("window").alias("anchors"),
        F.avg(F.pow((F.col("forecast") - F.col("y")) / F.col("scale"), 2)).alias("mse"),
        F.avg(F.pow((F.col("x") - F.col("y")) / F.col("scale"), 2)).alias("persistence_mse"),
    )
    return report.withColumn("beats", F.col("mse") < F.col("persistence_mse"))


def state_scale(states: DataFrame) -> DataFrame:
    flat = states.select(F.posexplode("state").alias("dim", "x"))
    return flat.groupBy("dim").agg(F.greatest(F.stddev_pop("x"), F.lit(MIN_SCALE)).alias("scale"))


def accept_forecast(report: DataFrame) -> DataFrame:
    """Accepted only when every capture and horizon beats persistence."""
    return report.agg(F.count(F.lit(1)).alias("cells"), F.count_if("beats").alias("better"), F.bool_and("beats").alias("accepted"))
