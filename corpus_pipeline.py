"""The corpus pipeline: documents pass the stages in order, each written as Parquet and read again before the next.

Nulls: a null text is the empty text, which no stage drops for itself; mixing gives rows without tokens only complete epochs. Rows with a null doc_id are nobody's near copies, and are judged by the other stages like any row. Rows repeated under one doc_id and
text leave the near-duplicate stage once. Ties are those of the operators. Very long texts pass whole. An empty table gives an empty result. The columns of documents, extra ones of any name too, are what each stage but the last returns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontaminate, jaccard, mixing, tokens, toxicity
from plumbline.llm.support import checkpoint_dir, remove


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no clause reaches the toxicity threshold."""
    return toxicity.remove_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of exact and near copies, the document with the smallest doc_id."""
    return jaccard.keep_one_of_each_group(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item is tiled onto."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' token budgets; none is cut below one epoch."""
    return mixing.mix(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bit-packed token ids of each remaining row."""
    return tokens.pack_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_output", pack_tokens),
]

#: Toxicity is scored by an automaton and ids come from a tokenizer, so SQL can't express the rows; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each returns is written as Parquet into the shared checkpoint folder, where it stays until the next one's is there. The last one's stays, as the result is read from it."""
    docs, folder, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{name}")
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
