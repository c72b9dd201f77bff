"""Record merges (J-13, N-09)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_merge(base: DataFrame, updates: DataFrame, key: str = "station_id") -> DataFrame:
    """J-13: base rows overridden field by field by newer non-null update values;
    ids present only in the updates are added (full outer join + coalesce)."""
    cols = [c for c in base.columns if c != key]
    extra = [c for c in updates.columns if c != key and c not in cols]
    b = base.select(key, *[F.col(c).alias(f"_b_{c}") for c in cols])
    u = updates.select(key, *[F.col(c).alias(f"_u_{c}") for c in cols + extra if c in updates.columns])
    j = b.join(u, key, "full")
    out = [key]
    for c in cols:
        out.append((F.coalesce(F.col(f"_u_{c}"), F.col(f"_b_{c}")) if c in updates.columns
                    else F.col(f"_b_{c}")).alias(c))
    out += [F.col(f"_u_{c}").alias(c) for c in extra]
    return j.select(*out)
