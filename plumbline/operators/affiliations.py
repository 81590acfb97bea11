"""Splitting author affiliations into institution and country."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import require, strip


def split_affiliations(df: DataFrame, eid_col: str = "EID", affil_col: str = "Affiliations") -> DataFrame:
    """(eid, affiliation_full, affiliation_name, country): a row for each piece between semicolons.

    The name stands before the first comma, the country after the last one (null without a comma). A null affiliation keeps its row; a trailing semicolon gives an empty piece.
    """
    require(df.columns, eid_col, affil_col)
    pieces = df.select(F.col(eid_col).alias("eid"), F.explode_outer(F.split(F.col(affil_col), r";\s*")).alias("piece"))
    full = pieces.select("eid", F.regexp_replace(strip(F.col("piece")), r"\.$", "").alias("affiliation_full"))
    c = F.col("affiliation_full")
    return full.select("eid", c, strip(F.substring_index(c, ",", 1)).alias("affiliation_name"), F.when(c.contains(","), strip(F.substring_index(c, ",", -1))).alias("country"))
