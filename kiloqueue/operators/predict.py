"""Prediction tables (M-14..M-18, X-22): queue model + optional fitted model.

The reference predicts one station per call.  Here a whole request table is
predicted at once: queue expressions (Q-A..Q-F) and, when a fitted MLlib model
is given, its ``transform`` (distributed), combined by the reference weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiloqueue.functions.queueing import queue_metrics
from kiloqueue.functions.scalars import hour_label, wait_recommendation
from kiloqueue.operators.quality import violations

# Ensemble weights and queue-path constants.
RF_WEIGHT = 0.40
LSTM_WEIGHT = 0.45
QUEUE_WEIGHT = 0.15
PREDICT_SERVICE_RATE = 3.0
BATCH_DEFAULT_WAIT = 15.0


def queue_prediction(ports, queue) -> dict[str, Column]:
    """Queue path of M-14: lambda = max(.1, queue+1), mu = 3, current queue."""
    q = F.coalesce(queue, F.lit(0))
    m = queue_metrics(ports, F.greatest(F.lit(0.1), (q + 1).cast("double")), F.lit(PREDICT_SERVICE_RATE), q)
    return m


def predict_table(requests: DataFrame, model_pred: str | None = None, renormalise: bool = False,
                  unstable_wait=float("inf")) -> DataFrame:
    """M-14 for a table of requests (station_id, num_ports, available_ports, queue_size, ...).

    ``model_pred`` names a column holding a fitted model's prediction (already
    clipped at 0); without it the queue prediction is the answer (confidence
    'medium').  The ensemble keeps the reference weights .40/.15 (quirk K-05)
    unless ``renormalise``.
    """
    m = queue_prediction(F.col("num_ports"), F.col("queue_size"))
    qp = m["avg_wait_min"]
    if model_pred is not None:
        rf = F.col(model_pred)
        if renormalise:
            ens = (RF_WEIGHT * rf + QUEUE_WEIGHT * qp) / (RF_WEIGHT + QUEUE_WEIGHT)
        else:
            ens = RF_WEIGHT * rf + QUEUE_WEIGHT * qp
        rf_out, conf = F.round(rf, 1), F.lit("high")
    else:
        ens, rf_out, conf = qp, F.lit(None).cast("double"), F.lit("medium")
    stable = m["system_stable"]
    ens_r = F.greatest(F.lit(0.0), F.round(ens, 1))
    pred = F.when(stable | F.lit(model_pred is not None), ens_r).otherwise(F.lit(unstable_wait).cast("double"))
    label_wait = F.when(stable | F.lit(model_pred is not None), ens_r).otherwise(F.lit(float("inf")))
    return requests.select(
        "*",
        pred.alias("predicted_wait_min"),
        rf_out.alias("rf_prediction"),
        F.when(stable, F.round(qp, 2)).otherwise(F.lit(unstable_wait).cast("double")).alias("queue_prediction"),
        conf.alias("confidence_level"),
        stable.alias("queue_stable"),
        m["utilization_pct"].alias("utilization_pct"),
        wait_recommendation(label_wait, F.col("available_ports")).alias("recommendation"),
    )


def predict_batch(features: DataFrame, model_pred: str | None = None) -> DataFrame:
    """M-15: model prediction or 15.0; label with available ports (default 2)."""
    rf = F.col(model_pred) if model_pred else F.lit(None).cast("double")
    pred = F.coalesce(rf, F.lit(BATCH_DEFAULT_WAIT))
    avail = F.col("available_ports") if "available_ports" in features.columns else F.lit(2)
    return features.withColumns({"rf_prediction": rf, "predicted_wait_min": pred,
                                 "recommendation": wait_recommendation(pred, F.coalesce(avail, F.lit(2)))})


def predict_requests(requests: DataFrame, unstable_wait=float("inf")) -> DataFrame:
    """M-16: valid requests are predicted, invalid ones come back with ``error`` (one pass over the requests)."""
    tagged = requests.withColumn("_errors", violations(requests))
    out = predict_table(tagged, unstable_wait=unstable_wait)
    valid = F.size("_errors") == 0
    answers = [c for c in out.columns if c not in tagged.columns]
    return out.select(*requests.columns, *[F.when(valid, F.col(c)).alias(c) for c in answers],
                      F.when(~valid, F.concat_ws("; ", "_errors")).alias("error"))


def demand_curve(stations: DataFrame, hours: int = 24, unstable_wait=float("inf")) -> DataFrame:
    """M-17 / J-08: station x 24 hours, available = max(1, ports // 2), queue 2."""
    grid = stations.select(
        "station_id", "num_ports",
        F.greatest(F.lit(1), F.floor(F.col("num_ports") / 2).cast("int")).alias("available_ports"),
        F.lit(2).alias("queue_size"),
        F.explode(F.sequence(F.lit(0), F.lit(hours - 1))).alias("hour"))
    p = predict_table(grid, unstable_wait=unstable_wait)
    return p.select("station_id", "hour", hour_label(F.col("hour")).alias("label"),
                    "predicted_wait_min", "recommendation")


def forecast(stations: DataFrame, start_hour, steps: int = 12, unstable_wait=float("inf")) -> DataFrame:
    """M-17: next ``steps`` hours from ``start_hour`` for every station (current state)."""
    start = start_hour if isinstance(start_hour, Column) else F.lit(start_hour)
    grid = stations.select("station_id", "name", "num_ports", "available_ports", "queue_size",
                           F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("offset_hours"))
    grid = grid.withColumn("hour", F.pmod(start + F.col("offset_hours"), F.lit(24)))
    p = predict_table(grid, unstable_wait=unstable_wait)
    return p.select("station_id", F.col("name").alias("station_name"), "hour",
                    hour_label(F.col("hour")).alias("label"), "offset_hours",
                    "predicted_wait_min", "recommendation")


def predict_realtime(stations: DataFrame, traffic: DataFrame | None = None,
                     weather: DataFrame | None = None, unstable_wait=float("inf")) -> DataFrame:
    """M-18: latest traffic / weather readings joined in (defaults .3 / 20 / 0), then M-14."""
    out = stations
    if traffic is not None:
        out = out.drop("traffic_score").join(traffic.select("station_id", "traffic_score"), "station_id", "left")
    out = out.withColumn("traffic_score", F.coalesce(F.col("traffic_score"), F.lit(0.3))) \
        if "traffic_score" in out.columns else out.withColumn("traffic_score", F.lit(0.3))
    if weather is not None:
        out = out.join(weather.select("station_id", "temperature_c", "precipitation_mm"), "station_id", "left")
    for c, v in (("temperature_c", 20.0), ("precipitation_mm", 0.0)):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in out.columns else F.lit(v))
    return predict_table(out, unstable_wait=unstable_wait)
