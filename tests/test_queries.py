"""Registered queries against their SQL in DuckDB over the smallest tables."""

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from plumbline.plans import registry, star  # noqa: F401

DATA = Path("/root/testdata/sf0.001")


def plain(value) -> str:
    if isinstance(value, (list, np.ndarray)):
        return "[" + ",".join(map(plain, value)) + "]"
    if value is None or value is pd.NA or value != value:
        return "null"
    return f"{value:.6g}" if isinstance(value, (float, np.floating)) else str(value)


def table(df: pd.DataFrame) -> list[tuple[str, ...]]:
    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
@pytest.mark.parametrize("name", [*registry.oracle_sql()])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got, want = registry.queries()[name](spark, str(DATA)).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got) == table(want)


@pytest.mark.parametrize("name", ["identify_topics", "identify_topics_coord", "identify_topics_grid"])
def test_topics_are_reduced_by_umap(spark, name, monkeypatch):
    used = []

    def reduce_vectors(embeddings, n_neighbors, n_components, metric, reducer, seed):
        used.append(reducer)
        return embeddings.selectExpr("doc_id", f"slice(embedding, 1, {n_components}) AS coords")

    rows = [(k, [float(k % 7 + d) for d in range(10)], 0) for k in range(30)]
    monkeypatch.setattr(star.topics, "reduce_vectors", reduce_vectors)
    monkeypatch.setattr(star, "table", lambda *_: spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"))
    registry.queries()[name](spark, "")
    assert used and set(used) == {"umap"}
