"""The giant component of a graph."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import require


@dataclass
class Graph:
    """vertices has id, edges src and dst; both may have more columns. Directions don't matter for components."""

    vertices: DataFrame
    edges: DataFrame


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local one only where none is set and the session is local. RuntimeError on a cluster without the setting."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set; it must name a folder that all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="plumbline-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut off from its lineage in the session's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return (
        down.join(least, "u")
        .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        .select("e.u", "e.v")
        .where("u <> v")
    )


#: Edges that are made stars at once in a task.
EDGES = 2_000_000


def _stars(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Edges (v, m) that join the same ids as the given ones: each id with one of its component among these."""
    t = pa.Table.from_batches(batches)
    both = pa.concat_arrays(t.column("u").chunks + t.column("v").chunks).dictionary_encode()
    ends = both.indices.to_numpy().reshape(2, -1)
    label = np.arange(len(both.dictionary))
    while len(ends[0]):
        low = label.copy()
        np.minimum.at(low, label[ends[0]], label[ends[1]])
        np.minimum.at(low, label[ends[1]], label[ends[0]])
        while (low != low[low]).any():
            low = low[low]
        label = low[label]
        ends = ends[:, label[ends[0]] != label[ends[1]]]
    own = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([both.dictionary.take(pa.array(own)), both.dictionary.take(pa.array(label[own]))], ["u", "v"])


def local_stars(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the components of the given ones, of which a task sends on one an id and piece at most: where ids have many edges near each other, far fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for b in batches:
            held.append(b)
            count += len(b)
            if count >= EDGES:
                held = [_stars(held)]
                if len(held[0]) > EDGES // 2:  # little is gained by adding more
                    yield held.pop()
                count = sum(map(len, held))
        if held:
            yield _stars(held)

    kind = edges.schema["u"].dataType.simpleString()
    return edges.mapInArrow(run, f"u {kind}, v {kind}")


def linked_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id that one of the edges (u, v) joins to another; component is the smallest id of its component.

    Each task first makes stars of its own edges. Then large-star and small-star steps take turns, each written once, until no edge changes. Edges become stars, so there are never more of them than at the start; the number of rounds grows with the logarithm of the longest path.
    """
    e = edges.select("u", "v").where("u <> v and u is not null and v is not null")
    e = checkpointed((local_stars(e) if e.schema["u"].dataType == e.schema["v"].dataType else e).distinct())
    before = None
    while True:
        e = checkpointed(_small_star(_large_star(e).distinct()).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before = now


def connected_components(graph: Graph) -> DataFrame:
    """(id, component) for each vertex; component is the smallest id that it is connected with."""
    require(graph.vertices.columns, "id")
    require(graph.edges.columns, "src", "dst")
    linked = linked_components(graph.edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    return graph.vertices.select("id").where("id is not null").distinct().join(linked, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def giant_component(graph: Graph) -> Graph:
    """The induced subgraph of the largest component; of equally large ones that with the smallest vertex id. Isolated vertices are components of one."""
    labels = checkpointed(connected_components(graph))
    largest = labels.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    inside = checkpointed(labels.join(F.broadcast(largest.select("component")), "component", "left_semi").select("id"))
    ends = [graph.edges[c] == inside["id"] for c in ("src", "dst")]
    return Graph(graph.vertices.join(inside, "id", "left_semi"), graph.edges.join(inside, ends[0], "left_semi").join(inside, ends[1], "left_semi"))
