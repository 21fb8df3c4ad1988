"""Window-state forecasts: gaps, pairs, deltas, re-anchoring and the comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.operators import forecast as fc
from flowspark.plans import views as v


def window_gaps(spark, sf):
    return fc.window_gaps(v.states_v(spark, sf)).select("capture", "window", "gap", "run")


def forecast_pairs(spark, sf):
    pairs = fc.forecast_pairs(v.states_v(spark, sf))
    pairs = pairs.select("capture", "window", "targets", F.posexplode("anchor").alias("dim", "x"))
    targets = [F.get(F.get("targets", F.lit(h)), F.col("dim")).alias(f"t{h + 1}") for h in range(3)]
    return pairs.select("capture", "window", "dim", "x", *targets)


def delta_model(spark, sf):
    model = fc.fit_delta(fc.forecast_pairs(v.states_v(spark, sf)))
    return v.rounded(model, ["slope", "intercept"])


def _split(spark, sf):
    states = v.states_v(spark, sf)
    return states.where("capture < 6"), states.where("capture >= 6")


def delta_forecast(spark, sf):
    """Fitted on six captures, applied to every window of the others."""
    train, held = _split(spark, sf)
    rows = fc.forecast(held, fc.fit_delta(fc.forecast_pairs(train)))
    return v.rounded(rows, ["forecast"])


def reanchored_states(spark, sf):
    rows = fc.reanchor(v.states_v(spark, sf))
    anchors = [F.round(F.get("anchor", F.lit(i)), 6).alias(f"a{i}") for i in range(v.STATE_DIMS)]
    return rows.select("capture", "window", "gap", "reanchored", *anchors, F.round("prior_mse", 6).alias("prior_mse"))


def _report(spark, sf):
    train, held = _split(spark, sf)
    model = fc.fit_delta(fc.forecast_pairs(train))
    return fc.forecast_report(fc.forecast(fc.reanchor(held), model, "anchor"), fc.forecast_pairs(held), fc.state_scale(train))


def forecast_report(spark, sf):
    return v.rounded(_report(spark, sf), ["mse", "persistence_mse"])


def forecast_acceptance(spark, sf):
    return fc.accept_forecast(_report(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (window_gaps, forecast_pairs, delta_model, delta_forecast, reanchored_states, forecast_report, forecast_acceptance)
}

_S = f"WITH RECURSIVE {v.STATES}"
_PAIRS = """pairs AS (SELECT a.capture, a."window", a.state AS s0, b.state AS s1, c.state AS s2, d.state AS s3 FROM states_v a
  JOIN states_v b ON b.capture = a.capture AND b."window" = a."window" + 1 JOIN states_v c ON c.capture = a.capture AND c."window" = a."window" + 2
  JOIN states_v d ON d.capture = a.capture AND d."window" = a."window" + 3),
flat AS (SELECT capture, "window", CAST(h AS INT) AS horizon, CAST(i - 1 AS INT) AS dim, s0[i] AS x, CASE h WHEN 1 THEN s1[i] WHEN 2 THEN s2[i] ELSE s3[i] END AS y
  FROM pairs, (SELECT unnest([1, 2, 3]) AS h) hh, (SELECT unnest(range(1, 65)) AS i) ii)"""
_MODEL = """model AS (SELECT horizon, dim, count(*) AS pairs, regr_slope(y - x, x) AS slope, regr_intercept(y - x, x) AS intercept FROM flat {w} GROUP BY 1, 2)"""
_WALK = """ordered_s AS (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY "window") AS rn FROM states_v),
walk AS (SELECT capture, "window", state, rn, true AS gap, state AS anchor, 100.0::DOUBLE AS p, CAST(NULL AS DOUBLE) AS prior_mse FROM ordered_s WHERE rn = 1
  UNION ALL SELECT o.capture, o."window", o.state, o.rn, o."window" <> w."window" + 1,
    CASE WHEN o."window" <> w."window" + 1 THEN o.state ELSE [w.anchor[i] + (w.p + 0.05) / (w.p + 0.05 + 2.0) * (o.state[i] - w.anchor[i]) FOR i IN range(1, 65)] END,
    CASE WHEN o."window" <> w."window" + 1 THEN 100.0::DOUBLE ELSE (1 - (w.p + 0.05) / (w.p + 0.05 + 2.0)) * (w.p + 0.05) END,
    CASE WHEN o."window" <> w."window" + 1 THEN NULL ELSE list_sum([(w.anchor[i] - o.state[i]) ** 2 FOR i IN range(1, 65)]) / 64 END
  FROM walk w JOIN ordered_s o ON o.capture = w.capture AND o.rn = w.rn + 1)"""
_SCALE = """scale AS (SELECT dim, greatest(stddev_pop(x), 0.001) AS sc FROM (SELECT CAST(i - 1 AS INT) AS dim, state[i] AS x FROM states_v, (SELECT unnest(range(1, 65)) AS i) ii
  WHERE capture < 6) z GROUP BY 1)"""
_REPORT = f"""{_S}, {_PAIRS}, {_MODEL.format(w="WHERE capture < 6")}, {_WALK}, {_SCALE},
fc AS (SELECT f.capture, f."window", f.horizon, f.dim, f.x, f.y, w.anchor[f.dim + 1] * (1 + slope) + intercept AS v FROM flat f JOIN model USING (horizon, dim)
  JOIN walk w ON w.capture = f.capture AND w."window" = f."window" WHERE f.capture >= 6),
report AS (SELECT capture, horizon, count(DISTINCT "window") AS anchors, avg(((v - y) / sc) ** 2) AS mse, avg(((x - y) / sc) ** 2) AS persistence_mse
  FROM fc JOIN scale USING (dim) GROUP BY 1, 2)"""
ORACLE = {
    "window_gaps": f"""{_S}, g AS (SELECT capture, "window", coalesce("window" <> lag("window") OVER (PARTITION BY capture ORDER BY "window") + 1, true) AS gap FROM states_v)
        SELECT capture, "window", gap, CAST(sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY capture ORDER BY "window") AS BIGINT) AS run FROM g""",
    "forecast_pairs": f"""{_S}, {_PAIRS} SELECT capture, "window", CAST(i - 1 AS INT) AS dim, s0[i] AS x, s1[i] AS t1, s2[i] AS t2, s3[i] AS t3 FROM pairs, (SELECT unnest(range(1, 65)) AS i) ii""",
    "delta_model": f"""{_S}, {_PAIRS}, {_MODEL.format(w="")} SELECT horizon, dim, pairs, round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM model""",
    "delta_forecast": f"""{_S}, {_PAIRS}, {_MODEL.format(w="WHERE capture < 6")} SELECT capture, "window", horizon, dim,
        round(state[dim + 1] * (1 + slope) + intercept, 6) AS forecast FROM states_v, model WHERE capture >= 6""",
    "reanchored_states": f"""{_S}, {_WALK} SELECT capture, "window", gap, NOT gap AS reanchored, {", ".join(f"round(anchor[{i + 1}], 6) AS a{i}" for i in range(v.STATE_DIMS))},
        round(prior_mse, 6) AS prior_mse FROM walk""",
    "forecast_report": f"{_REPORT} SELECT capture, horizon, anchors, round(mse, 6) AS mse, round(persistence_mse, 6) AS persistence_mse, mse < persistence_mse AS beats FROM report",
    "forecast_acceptance": f"{_REPORT} SELECT count(*) AS cells, count(*) FILTER (mse < persistence_mse) AS better, bool_and(mse < persistence_mse) AS accepted FROM report",
}
