"""Repository-event filter (batch or stream; stateless)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- FIXED VALUES ----------------------------------------------------------
DATASET_ID = "your-username/router-training-data"
# ---- end of fixed values ---------------------------------------------------


def classify_events(df: DataFrame, dataset_id: str = DATASET_ID) -> DataFrame:
    """Adds ``status`` (retrain_triggered / ignored) and the ignore ``reason``.

    Expects ``repo_type``, ``repo_name``, ``action``. A single projection, so
    it runs unchanged on a stream."""
    not_ds = ~F.col("repo_type").eqNullSafe("dataset")
    not_ours = ~F.col("repo_name").eqNullSafe(dataset_id)
    not_upd = ~F.col("action").eqNullSafe("update")
    reason = (F.when(not_ds, "not a dataset repo")
               .when(not_ours, f"not our dataset ({dataset_id})")
               .when(not_upd, "not an update event"))
    return (df.withColumn("reason", reason)
              .withColumn("status", F.when(F.col("reason").isNull(), "retrain_triggered").otherwise("ignored")))


def triggers(df: DataFrame, dataset_id: str = DATASET_ID) -> DataFrame:
    return classify_events(df, dataset_id).filter(F.col("status") == "retrain_triggered")
