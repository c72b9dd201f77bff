"""Prediction evaluation (A-25..A-27, X-36, M-21): single-pass aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiloqueue.functions.scalars import residuals


def _clipped(pred: str):
    return F.greatest(F.col(pred), F.lit(0.0))


def compute_metrics(df: DataFrame, y_true: str, y_pred: str, model: str = "model") -> DataFrame:
    """A-26: prediction clipped at 0; n, RMSE, MAE, R^2, MAPE (truth != 0),
    sMAPE (denominator != 0), share within 5 / 10 minutes - one aggregate."""
    t, p = F.col(y_true), _clipped(y_pred)
    err = t - p
    denom = (F.abs(t) + F.abs(p)) / 2.0
    n = F.count(F.lit(1))
    sse = F.sum(err * err)
    sst = F.var_pop(t) * n
    return df.agg(
        F.lit(model).alias("model"), n.alias("n_samples"),
        F.round(F.sqrt(sse / n), 3).alias("rmse_min"),
        F.round(F.round(F.avg(F.abs(err)), 9), 3).alias("mae_min"),
        F.round(F.lit(1.0) - sse / sst, 4).alias("r2"),
        F.round(F.avg(F.when(t != 0, F.abs(err / t))) * 100.0, 2).alias("mape_pct"),
        F.round(F.avg(F.when(denom != 0, F.abs(err) / denom)) * 100.0, 2).alias("smape_pct"),
        F.round(F.avg((F.abs(err) <= 5).cast("double")) * 100.0, 1).alias("within_5min_pct"),
        F.round(F.avg((F.abs(err) <= 10).cast("double")) * 100.0, 1).alias("within_10min_pct"),
    )


def segment_analysis(df: DataFrame, y_true: str, y_pred: str, segment: str = "hour_of_day") -> DataFrame:
    """A-25: n, RMSE, MAE per segment, sorted by segment (prediction not clipped)."""
    err = F.col(y_true) - F.col(y_pred)
    return (df.groupBy(segment)
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg(err * err)), 3).alias("rmse"),
                 F.round(F.round(F.avg(F.abs(err)), 9), 3).alias("mae"))
            .orderBy(segment))


def compare_models(metrics: list[DataFrame]) -> DataFrame:
    """A-27: comparison table from per-model metric rows."""
    out = metrics[0]
    for m in metrics[1:]:
        out = out.unionByName(m)
    return out.select(F.col("model").alias("Model"), F.col("rmse_min").alias("RMSE (min)"),
                      F.col("mae_min").alias("MAE (min)"), F.col("r2").alias("R2"),
                      F.col("mape_pct").alias("MAPE (%)"), F.col("within_5min_pct").alias("+-5 min (%)"),
                      F.col("within_10min_pct").alias("+-10 min (%)"))


def residual_table(df: DataFrame, y_true: str, y_pred: str, keys=()) -> DataFrame:
    """X-36: residual, absolute residual, percent error (null when truth is 0)."""
    r = residuals(F.col(y_true), F.col(y_pred))
    return df.select(*keys, F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred"),
                     r["residual"].alias("residual"), r["abs_residual"].alias("abs_residual"),
                     r["pct_error"].alias("pct_error"))
