"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a seed (``min_match`` tokens in a row, or a whole item that is shorter) are tiled: running
Karp-Rabin over the tokens not yet marked finds common runs, the longest is marked in both, and so on until none of ``min_match`` tokens is left. Tiles may
lie in any order, so a passage whose parts were moved is still covered. A document is contaminated by an item if the tiles cover at least ``threshold`` of
the item's tokens.

The benchmark's tokens are broadcast if there are at most ``broadcast_tokens`` of them (counted first); a larger benchmark meets the documents in a shuffled join on the
seeds, with the same result.

Nulls: a null text is the empty text and matches nothing; a row with a null doc_id is judged and reported like any other. Items without tokens match nothing. Repeated rows
of the benchmark count once; each repeated row of docs is judged. Ties between tiles of one length go to the first place in the document, then in the item. Texts of any length are tiled whole. An empty table on either side gives no
pairs. Other columns of docs may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import vectext
from plumbline.llm.support import cut, free_name, map_rows, normal_text, releasing, small_batches

MIN_MATCH, THRESHOLD, BROADCAST_TOKENS = 5, 0.5, 2_000_000
_SCHEMA = "doc_id bigint, item_id bigint, coverage double, n_tiles int, longest_tile int"


def _windows(tokens: np.ndarray, size: int, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of the windows of ``size`` tokens without a marked one, and where they begin."""
    n = len(tokens) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, int)
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * vectext._power(vectext._P, len(tokens)), out=sums[1:])
    blocked = np.concatenate([[0], np.cumsum(marked)])
    at = np.flatnonzero(blocked[size:] == blocked[:-size])
    return (sums[at + size] - sums[at]) * vectext._power(vectext._P_INVERSE, len(tokens))[at], at


def greedy_tiles(item: np.ndarray, doc: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in doc, length), longest first; among equally long ones the first in doc, then in item.

    The search length starts at the whole item and is halved down to ``min_match``; at each length all common runs at least that long are found
    by rolling hash, and the longest is marked again and again until none is left.
    """
    in_item, in_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    tiles, size = [], len(item)
    while size >= min_match:
        while True:
            a, i_at = _windows(item, size, in_item)
            b, j_at = _windows(doc, size, in_doc)
            order = np.argsort(a, kind="stable")
            low, high = np.searchsorted(a[order], b, "left"), np.searchsorted(a[order], b, "right")
            best = (0, 0, 0)
            for k in np.flatnonzero(high > low):
                j = int(j_at[k])
                for i in i_at[order[low[k] : high[k]]].tolist():
                    if i and j and not in_item[i - 1] and not in_doc[j - 1] and item[i - 1] == doc[j - 1]:
                        continue  # part of a longer run that begins earlier
                    most = min(len(item) - i, len(doc) - j)
                    differ = np.flatnonzero((item[i : i + most] != doc[j : j + most]) | in_item[i : i + most] | in_doc[j : j + most])
                    best = max(best, (int(differ[0]) if len(differ) else most, -j, -i))
            length, j, i = best[0], -best[1], -best[2]
            if length < size:
                break
            tiles.append((i, j, length))
            in_item[i : i + length] = in_doc[j : j + length] = True
        if size == min_match:
            break
        size = max(min_match, size // 2)
    return tiles


def _judge(item: np.ndarray, doc: np.ndarray, min_match: int) -> tuple[float, int, int]:
    tiles = greedy_tiles(item, doc, min(min_match, len(item)))
    return sum(t[2] for t in tiles) / len(item), len(tiles), max((t[2] for t in tiles), default=0)


class Index:
    """A benchmark in memory: the hashes of its seeds, and the items that have each."""

    def __init__(self, ids: list[int | None], texts: list[str], min_match: int) -> None:
        w = vectext.words(pa.array(texts, pa.string()))
        self.min_match, self.ids = min_match, ids
        self.items = [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        seeds: dict[int, list[tuple[int, int]]] = {}
        for k, item in enumerate(self.items):
            if size := min(min_match, len(item)):
                one = vectext.Words(item, np.array([0, len(item)]), item, item, item)
                for h in set(vectext.ngram_hashes(one, size)[0].tolist()):
                    seeds.setdefault(size, []).append((h, k))
        self.seeds = {}
        for size, pairs in seeds.items():
            hashes, items = zip(*sorted(pairs), strict=True)
            self.seeds[size] = np.array(hashes, np.uint64), np.array(items)

    def found(self, texts: pa.Array) -> Iterator[tuple[int, int, float, int, int]]:
        """(row, item, coverage, tiles, longest) of each pair that shares a seed."""
        w = vectext.words(texts)
        pairs = set()
        for size, (hashes, items) in self.seeds.items():
            grams, first = vectext.ngram_hashes(w, size)
            maybe = np.zeros(1 << 20, bool)
            maybe[hashes & np.uint64((1 << 20) - 1)] = True
            at = np.flatnonzero(maybe[grams & np.uint64((1 << 20) - 1)])
            low, high = np.searchsorted(hashes, grams[at], "left"), np.searchsorted(hashes, grams[at], "right")
            doc = np.searchsorted(first, at, "right") - 1
            for k in np.flatnonzero(high > low):
                pairs.update((int(doc[k]), int(i)) for i in items[low[k] : high[k]])
        for d, i in sorted(pairs):
            yield d, i, *_judge(self.items[i], w.hash[w.first[d] : w.first[d + 1]], self.min_match)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), normal_text().alias("text")).distinct()


def _fits(items: DataFrame, limit: int) -> bool:
    """Whether what the index would hold, a hash a word and the texts, is within the limit (of words, and of 16 bytes of text for each)."""
    words, size = items.agg(F.sum(F.regexp_count(F.lower("text"), F.lit(vectext.WORD_PATTERN))), F.sum(F.octet_length("text"))).first()
    return (words or 0) <= limit and (size or 0) <= 16 * limit


def _index(items: DataFrame, min_match: int) -> Index:
    rows = items.orderBy("item_id", "text").collect()  # no more than broadcast_tokens words
    return Index([r[0] for r in rows], [r[1] for r in rows], min_match)


def _by_seeds(docs: DataFrame, items: DataFrame, min_match: int) -> DataFrame:
    """(key, item_id, coverage, n_tiles, longest_tile) for a benchmark of any size; key is the hash of a document's text."""
    lengths = [r[0] for r in items.select(F.least(F.lit(min_match), F.size(F.regexp_extract_all(F.lower("text"), F.lit(vectext.WORD_PATTERN), F.lit(0)))).alias("n")).distinct().where("n > 0").collect()]

    def seeds(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in vectext.chunks(batch):
                    w = vectext.words(part.column("text"))
                    count = np.diff(w.first)
                    for size in lengths:
                        grams, first = vectext.ngram_hashes(w, size)
                        row = np.repeat(np.arange(part.num_rows), np.diff(first))
                        ok = count[row] >= size if whole else (count[row] == size) | ((size == min_match) & (count[row] > size))
                        pairs = np.unique(np.stack([row[ok].astype(np.uint64), grams[ok]], 1), axis=0)
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(pairs[:, 0].astype(np.int64))), pa.array(pairs[:, 1].view(np.int64))], names=["k", "seed"])

        return run

    keyed = docs.select(F.xxhash64(normal_text()).alias("key"), normal_text().alias("text")).dropDuplicates(["key"])
    # items are found by the hash of id and text, since item_id may be null
    item = items.select(F.xxhash64("item_id", "text").alias("ik"), "item_id", F.col("text").alias("item_text"))
    theirs = item.select("ik", F.col("item_text").alias("text")).mapInArrow(seeds(False), "k bigint, seed bigint").withColumnRenamed("k", "ik")
    ours = keyed.mapInArrow(seeds(True), "k bigint, seed bigint").withColumnRenamed("k", "key")
    pairs = ours.join(theirs, "seed").select("key", "ik").distinct()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (vectext.words(batch.column(c)) for c in ("item_text", "text"))
            out = [_judge(a.hash[a.first[k] : a.first[k + 1]], b.hash[b.first[k] : b.first[k + 1]], min_match) for k in range(batch.num_rows)]
            cover, tiles, longest = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("item_id"), pa.array(cover, pa.float64()), pa.array(tiles, pa.int32()), pa.array(longest, pa.int32())], names=["key", *_SCHEMA.replace(" bigint", "").replace(" double", "").replace(" int", "").split(", ")[1:]])

    return pairs.join(item, "ik").join(keyed, "key").select("key", "item_id", "item_text", "text").mapInArrow(judge, _SCHEMA.replace("doc_id", "key"))


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest_tile): the pairs of a document and an item that it gives away."""
    items = _items(benchmark)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), normal_text().alias("text"))
    if not _fits(items, broadcast_tokens):
        found = _by_seeds(docs, items, min_match).where(F.col("coverage") >= threshold)
        return own.select("doc_id", F.xxhash64("text").alias("key")).join(found, "key").drop("key")
    index = _index(items, min_match)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vectext.chunks(batch):
                hits = [h for h in index.found(part.column("text")) if h[2] >= threshold]
                row, item, cover, tiles, longest = zip(*hits, strict=True) if hits else ((), (), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array([index.ids[i] for i in item], pa.int64()), pa.array(cover, pa.float64()), pa.array(tiles, pa.int32()), pa.array(longest, pa.int32())],
                    names=["doc_id", "item_id", "coverage", "n_tiles", "longest_tile"],
                )

    return small_batches(own).mapInArrow(releasing(run), _SCHEMA)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """docs without contaminated rows; columns as they were. With a broadcast benchmark nothing is shuffled."""
    items = _items(benchmark)
    if not _fits(items, broadcast_tokens):
        key = free_name(docs, "key")
        keys = cut(_by_seeds(docs, items, min_match).where(F.col("coverage") >= threshold).select(F.col("key").alias(key)).distinct())
        return docs.join(keys, F.xxhash64(normal_text()) == F.col(key), "left_anti")
    index = _index(items, min_match)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            for part in vectext.chunks(batch):
                keep = np.ones(part.num_rows, bool)
                keep[[h[0] for h in index.found(pc.fill_null(part.column("text"), "")) if h[2] >= threshold]] = False
                yield part.filter(pa.array(keep))

    return map_rows(small_batches(docs), releasing(run), docs.schema)
