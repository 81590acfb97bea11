"""Revealed comparative advantage with fractional counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import require


def rca_fractional(df: DataFrame, id_col: str = "id", ipc_col: str = "ipc", region_col: str = "region") -> DataFrame:
    """(Region, IPC, X_rc, X_r, X_c, share_region, share_global, RCA).

    Repeated (id, class, region) rows count once. Each patent weighs 1 / its number of regions in each of its regions. The distinct rows are hashed by id once, which also serves the window that counts regions.
    """
    require(df.columns, id_col, ipc_col, region_col)
    rows = df.select(F.col(id_col).alias("id"), F.col(ipc_col).alias("IPC"), F.col(region_col).alias("Region")).distinct()
    regions = rows.select("id", "Region").distinct().groupBy("id").agg(F.count("*").alias("k"))
    cells = rows.join(regions, "id").groupBy("Region", "IPC").agg(F.sum(F.lit(1.0).cast("double") / F.col("k")).alias("X_rc"))
    by = lambda *c: Window.partitionBy(*c)
    # cells are regions x classes at most; the one-row total is joined, so no window runs over all of them in one task
    total = cells.agg(F.sum("X_rc").alias("total"))
    out = cells.withColumn("X_r", F.sum("X_rc").over(by("Region"))).withColumn("X_c", F.sum("X_rc").over(by("IPC"))).crossJoin(F.broadcast(total))
    out = out.withColumn("share_region", F.col("X_rc") / F.col("X_r")).withColumn("share_global", F.col("X_c") / F.col("total"))
    return out.select("Region", "IPC", "X_rc", "X_r", "X_c", "share_region", "share_global", (F.col("share_region") / F.col("share_global")).alias("RCA"))
