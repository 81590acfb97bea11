"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly into buckets that fit in memory, by a seeded hash of the whole record. Pass two shuffles each bucket by Fisher-Yates, seeded by bucket, and
writes it as one shard. A bucket is put in a fixed order (hash, then doc_id, then text) before it is shuffled, so the result depends on the records and the seed alone, and a lost
executor's buckets come out the same again.

Pass two reads one bucket at a time, whatever the size of the table: with more buckets than ``MAX_PARTITIONS`` a partition of the shuffle holds several, sorted by bucket.

Nulls: any column may be null, the hash covers them. Repeated rows have one hash and so one bucket; they are kept, and so are ties of all kinds. Columns named shard or position in the input are replaced by the
operator's; others may have any names and types, and doc_id and text needn't be there. A very long text is a record like others and makes its bucket larger. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from plumbline.llm.jaccard import _runs
from plumbline.llm.support import free_name, map_rows

SEED, BUCKET_BYTES = 11, 64 << 20
#: Partitions of the shuffle; beyond so many buckets a partition holds several, which its sort (on disk if need be) keeps apart.
MAX_PARTITIONS = 20_000


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform permutation of range(n): place i, from the last down, is swapped with a random place up to i."""
    out = np.arange(n)
    draws = np.random.default_rng(seed).random(max(n - 1, 0))
    for i, u in zip(range(n - 1, 0, -1), draws.tolist(), strict=True):
        j = int(u * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out


def bucket_count(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """As many buckets as hold about ``bucket_bytes`` each, by the length of texts and binary values, with 64 bytes a row for the rest."""
    long = [F.coalesce(F.octet_length(_quoted(f.name)), F.lit(0)) for f in docs.schema.fields if f.dataType.typeName() in ("string", "binary")]
    total = docs.agg(F.sum(sum(long, F.lit(64)).cast("bigint"))).first()[0] or 0
    return max(1, -(-int(total) // bucket_bytes))


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def _hash(docs: DataFrame, seed: int) -> Column:
    """Of the whole record; a column that can't be hashed as it is (a map, a variant) goes in as JSON."""
    plain = lambda kind: not any(x in kind for x in ("map<", "variant", "void"))
    return F.xxhash64(F.lit(seed), *[F.col(_quoted(n)) if plain(kind) else F.to_json(F.struct(F.col(_quoted(n)).alias("v"))) for n, kind in docs.dtypes])


def shuffle_into_shards(docs: DataFrame, n_shards: int | None = None, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, max_partitions: int = MAX_PARTITIONS) -> DataFrame:
    """docs with (shard, position): a random order of all records, as shards of consecutive rows, ordered by position."""
    docs = docs.select(*[F.col(_quoted(c)) for c in docs.columns if c.lower() not in ("shard", "position")])
    hashed, shard_at, target = (free_name(docs, x) for x in ("hash", "shard_at", "target"))
    n = n_shards or bucket_count(docs, bucket_bytes)
    partitions = min(n, max_partitions)
    placed = docs.withColumn(hashed, _hash(docs, seed)).withColumn(shard_at, F.pmod(F.xxhash64(hashed, F.lit(seed + 1)), F.lit(n)).cast("int")).withColumn(target, F.col(shard_at) % F.lit(partitions))
    ties = [F.col(c) for c in ("doc_id", "text") if c in docs.columns]
    ordered = placed.repartitionById(partitions, F.col(target)).sortWithinPartitions(shard_at, hashed, *ties)
    names, k = docs.columns, len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in _runs(batches, [shard_at]):
            shard = bucket.column(shard_at)[0].as_py()
            order = fisher_yates(bucket.num_rows, seed * 1_000_003 + shard)
            out = bucket.select([*range(k)])
            for begin in range(0, len(order), 2000):
                part = out.take(pa.array(order[begin : begin + 2000])).combine_chunks()
                rows = part.num_rows
                columns = [*part.columns, pa.array(np.full(rows, shard), pa.int32()), pa.array(np.arange(begin, begin + rows), pa.int64())]
                yield from pa.Table.from_arrays(columns, names=[*names, "shard", "position"]).to_batches()

    return map_rows(ordered, run, StructType([*docs.schema.fields, StructField("shard", IntegerType()), StructField("position", LongType())]))


def write_shards(docs: DataFrame, path: str, **how: int) -> None:
    """The shards as Parquet: one file for each partition of the shuffle, whose rows are its shards one after another in order of position."""
    shuffle_into_shards(docs, **how).write.parquet(path)
