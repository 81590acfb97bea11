"""run() of the pipeline against its stages by brute force on a small folder."""

import random

import pyarrow as pa
import pytest

import corpus_pipeline
from plumbline.llm import mixing, support, tokens
from tests.llm.test_llm import brute_pairs, odd_names


@pytest.fixture
def folder(spark, docs_of, tmp_path):
    rng = random.Random(4)
    item = [f"q{k}" for k in range(30)]
    rows = [(k, " ".join(f"v{rng.randint(0, 3000)}" for _ in range(40)), "ab"[k % 2]) for k in range(60)]
    rows += [(100 + k, rows[k][1] + " tail", "a") for k in range(10)] + [(200, "intro " + " ".join(item[10:] + item[:10]), "b"), (201, "You are a total idiot. " + rows[20][1], "a"), (202, None, None), (203, "", "b")]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), rows


def test_run(spark, folder, docs_of):
    path, rows = folder
    left = [r for r in rows if r[0] != 201]
    dropped = {b for _, b in brute_pairs(left)}
    left = [r for r in left if r[0] not in dropped and r[0] != 200]
    assert dropped == {100 + k for k in range(10)}
    repeats = {r["doc_id"]: r["repeats"] for r in mixing.mixture(docs_of(left)).collect()}
    encoder = tokens.Encoder(tokens.TOKENIZER)
    want = sorted((k, encoder.model.encode(t or "")) for k, t, *_ in left for _ in range(repeats.get(k, 0)))
    got = corpus_pipeline.run(spark, path).collect()
    assert sorted((r["doc_id"], tokens.unpack(bytes(r["packed"]), r["n_tokens"], r["bit_width"], r["block_size"]).tolist()) for r in got) == want


def test_stages_with_odd_tables(spark, folder):
    path, rows = folder
    docs = odd_names(spark.read.parquet(f"{path}/documents.parquet"))
    again = docs.union(docs.where("doc_id < 3"))  # repeated rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, again, path)
        assert out.columns == docs.columns and {r["c.d"] for r in out.collect()} == {"own"}, name
    assert corpus_pipeline.STAGES[-1][1](spark, again, path).count() == len(rows) + 3


def test_stages_keep_the_columns(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns
        assert stage(spark, docs.limit(0), path).count() == 0


SIZE = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def batch_size(spark):
    """The session's bound on Arrow batches, put back at the end."""
    before = spark.conf.get(SIZE)
    yield
    spark.conf.set(SIZE, before)


def test_batches_of_long_texts_are_small(spark, docs_of, folder, batch_size):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    docs = docs_of([(k, "word " * 1000) for k in range(4000)]).coalesce(1)  # 20 MB in a task
    for name, stage in corpus_pipeline.STAGES:
        if name != "mixing":  # sends no rows to Python
            spark.conf.set(SIZE, "64m")
            stage(spark, docs, folder[0])
            n = [r[0] for r in docs.select("text").mapInArrow(sizes, "n bigint").collect()]
            assert sum(n) >= 20_000_000 and max(n) < 1.1 * support.BATCH, name
    spark.conf.set(SIZE, "1m")  # a lower bound stays
    tokens.pack_documents(docs)
    assert spark.conf.get(SIZE) == "1m"


def test_results_do_not_depend_on_batches(spark, folder, batch_size):
    rows = []
    for size in ("64m", "1k"):
        spark.conf.set(SIZE, size)
        rows.append(sorted(map(str, corpus_pipeline.run(spark, folder[0]).collect())))
    assert rows[0] == rows[1] and len(rows[0]) > 60
