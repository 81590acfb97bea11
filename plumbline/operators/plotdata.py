"""Plot-ready tables. Rendering is left to the caller."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import require, signif, squish


def top_topic_words(ctfidf: DataFrame, topics: list | None = None, n_words: int = 10) -> DataFrame:
    """(topic, word, score, panel_order): the n_words best words of each topic, with ties at the cut; panel_order counts up with the score."""
    require(ctfidf.columns, "topic", "word", "score")
    rows = ctfidf.where(F.col("topic").isin(topics)) if topics is not None else ctfidf
    own = Window.partitionBy("topic")
    top = rows.withColumn("r", F.rank().over(own.orderBy(F.desc("score")))).where(F.col("r") <= n_words)
    return top.withColumn("panel_order", F.row_number().over(own.orderBy("score", F.desc("word")))).select("topic", "word", "score", "panel_order").orderBy("topic", F.desc("panel_order"))


def topic_terms_grid(terms: DataFrame, n_topics: int = 6, n_terms: int = 10, metric: str = "tfidf", topics: list | None = None, order_col: str | None = None) -> tuple[DataFrame, int]:
    """((topic, term, value, panel_order), columns of the grid): the n_terms best terms of the chosen topics, without ties.

    Chosen are the given topics that exist, in the given order, or the first n_topics by order_col (by name without one).
    """
    require(terms.columns, "topic", "term", metric)
    if metric not in ("tfidf", "n"):
        raise ValueError("metric is tfidf or n")
    found = terms.groupBy("topic").agg(F.min(order_col or "topic").alias("o"))
    if topics is not None:
        wanted = {str(t): k for k, t in enumerate(topics)}
        chosen = sorted((r["topic"] for r in found.where(F.col("topic").cast("string").isin(list(wanted))).collect()), key=lambda t: wanted[str(t)])
    else:
        chosen = [r["topic"] for r in found.orderBy("o", "topic").limit(n_topics).collect()]
    if not chosen:
        raise ValueError("none of the topics is there")
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc(metric), "term"))
    top = terms.where(F.col("topic").isin(chosen)).withColumn("r", rank).where(F.col("r") <= n_terms)
    panel = F.row_number().over(Window.partitionBy("topic").orderBy(metric, F.desc("term")))
    return top.withColumn("panel_order", panel).select("topic", "term", F.col(metric).alias("value"), "panel_order"), math.ceil(math.sqrt(len(chosen)))


def topic_label(cluster: Column, label: Column, show_ids: bool = True) -> Column:
    """Noise for 0; "Topic k: label", the label alone, or "Topic k"."""
    named = F.concat(F.lit("Topic "), cluster.cast("string"), F.lit(": "), label) if show_ids else label
    return F.when(cluster == 0, F.lit("Noise")).when(label.isNotNull(), named).otherwise(F.concat(F.lit("Topic "), cluster.cast("string")))


def wrapped(text: Column, width: int) -> Column:
    """Runs of white space as one space, and <br> instead of it where a line of whole words would grow longer than ``width``; a longer word has a line of its own."""
    lines = F.regexp_replace(squish(text), rf"(\S{{{width},}}|.{{1,{width}}})(?:\s+|$)", "$1<br>")
    return F.regexp_replace(lines, "<br>$", "")


def topic_space(
    coordinates: DataFrame, text: DataFrame | None = None, x_col: str = "dim_1", y_col: str = "dim_2", cluster_col: str = "cluster", topic_labels: DataFrame | dict | None = None, show_ids: bool = True,
    max_chars: int | None = 400, wrap_width: int | None = 80,
) -> tuple[DataFrame, DataFrame]:
    """(points, centroids) of a topic map: points get topic_label and tooltip, centroids are the medians of each topic, noise left out.

    text: (doc_id, text), joined by doc_id; in tooltips it ends with "..." after max_chars characters, and lines break between words before wrap_width (None: neither). topic_labels: (cluster or topic, label or Label), or a dict; repeated labels of a cluster give repeated points.
    """
    require(coordinates.columns, "doc_id", x_col, y_col, cluster_col)
    points = coordinates.select("doc_id", F.col(x_col).alias("x"), F.col(y_col).alias("y"), F.col(cluster_col).cast("int").alias("cluster"))
    spark = coordinates.sparkSession
    if isinstance(topic_labels, dict):
        topic_labels = spark.createDataFrame([(int(k), str(v)) for k, v in topic_labels.items()], "cluster int, label string")
    if topic_labels is not None:
        names = {"topic": "cluster", "Label": "label"}
        for old, new in names.items():
            if old in topic_labels.columns and new not in topic_labels.columns:
                topic_labels = topic_labels.withColumnRenamed(old, new)
        require(topic_labels.columns, "cluster", "label")
        points = points.join(topic_labels.select(F.col("cluster").try_cast("int").alias("cluster"), "label"), "cluster", "left")
    else:
        points = points.withColumn("label", F.lit(None).cast("string"))
    points = points.withColumn("topic_label", topic_label(F.col("cluster"), F.col("label"), show_ids)).drop("label")
    body = F.concat(F.lit("x: "), signif(F.col("x")).cast("string"), F.lit("<br>y: "), signif(F.col("y")).cast("string"))
    if text is not None:
        require(text.columns, "doc_id", "text")
        points = points.join(text.select("doc_id", "text"), "doc_id", "left")
        shown = F.col("text") if max_chars is None else F.when(F.char_length("text") > max_chars, F.concat(F.substring("text", 1, max_chars), F.lit("..."))).otherwise(F.col("text"))
        body = F.concat(F.lit("Text: "), F.coalesce(shown if wrap_width is None else wrapped(shown, wrap_width), F.lit("")))
    head = F.concat(F.lit("Doc: "), F.col("doc_id").cast("string"), F.lit("<br>Topic: "), F.col("topic_label"), F.lit("<br>"))
    points = points.withColumn("tooltip", F.concat(head, body)).select("doc_id", "x", "y", "cluster", "topic_label", "tooltip")
    centroids = points.where("cluster <> 0").groupBy("topic_label", "cluster").agg(F.median("x").alias("x"), F.median("y").alias("y"), F.count("*").alias("n_docs"))
    return points, centroids


def reorder_within(df: DataFrame, x: str, by: str, within: str, fun: str = "avg", sep: str = "___") -> DataFrame:
    """df with key x___within and its order by an aggregate of ``by`` (the name of a Spark aggregate)."""
    require(df.columns, x, by, within)
    keyed = df.withColumn("key", F.concat(F.col(x).cast("string"), F.lit(sep), F.col(within).cast("string")))
    orders = keyed.groupBy("key").agg(F.expr(f"{fun}(`{by}`)").alias("key_value"))
    # ranks run within each panel, which is what a plot orders
    panels = orders.withColumn("key_order", F.row_number().over(Window.partitionBy(F.substring_index("key", sep, -1)).orderBy("key_value", "key")))
    return keyed.join(panels, "key")


def strip_reordered(key: Column, sep: str = "___") -> Column:
    """The key without what reorder_within added."""
    return F.regexp_replace(key, f"{sep}.*$", "")
