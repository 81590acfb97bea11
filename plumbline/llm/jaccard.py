"""N-gram Jaccard join with a count-vector R-tree.

Every document is the set of its word n-grams. The tokens of a set are hashed into groups; the counts of the
groups are a point. For two sets the sum over the groups of the smaller count bounds their overlap from
above, and so does, for a tree node, the sum over the groups of the smaller of the query's count and the node's
greatest count. A query descends only into nodes whose bound reaches the overlap that the threshold needs; the pairs
that survive at the leaves are verified on the sets themselves.

The boxes of unrelated documents overlap (see README), so one tree over a whole corpus would be visited nearly whole by each query. The points are therefore divided
into regions first, and each region has trees of its own. The division is exact: with the n-grams of all documents in one order, rare before frequent, two sets of
similarity t share an n-gram among the first |x| - ceil(t |x|) + 1 of each. An n-gram that only one document has is shared with none, so that it fills a place and is never looked up; most documents have enough of them to have no region
at all. Documents that share one of the others are linked, and the connected groups of links are the regions. No pair over the threshold is lost, nothing is capped, and a large region is cut into blocks by size and hash, of which every pair is
searched whose sizes allow the threshold.

How it's distributed: each task gathers the distinct n-grams of some thousand documents (a flush), so that an n-gram of a third of all
documents is one entry a flush; ranges of hashes count in how many documents each is, and send what isn't unique back to the flush. N-grams are told apart by 56 bits of their hash. An overlap needs only n-grams that
aren't unique, so neither texts nor unique n-grams move any further.

Nulls: rows with a null doc_id can't be named and take no part; a null text is the empty text. A text without words has no n-grams, no
partners, and a class of its own. A text of fewer than n words is one n-gram of them all. Very long texts are sets like others; a task holds one at a time. Rows repeated
under one doc_id and text count once; of several texts under one doc_id the links are added up and the least class is taken. Ties don't matter, as a class is named by its least doc_id. An empty table gives no rows. Only doc_id and
text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import vectext
from plumbline.llm.support import connected_components, cut, free_name, free_shuffles, normal_text, releasing, small_batches

N, THRESHOLD = 3, 0.5
GROUPS, LEAF, BLOCK = 64, 32, 2048
#: N-grams gathered by a task before they are sent on, and the doc_ids up to which a list of dropped documents is broadcast.
FLUSH, BROADCAST_IDS = 1 << 19, 1_000_000


# --- the tree ------------------------------------------------------------------------------------


def group_counts(sets: list[np.ndarray], groups: int = GROUPS) -> np.ndarray:
    """A row of group counts for each set."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = owner * groups + (np.concatenate([np.zeros(0, np.uint64), *sets]) % np.uint64(groups)).astype(np.int64)
    return np.bincount(flat, minlength=len(sets) * groups).reshape(-1, groups).astype(np.int32)


class CountTree:
    """R-tree over count vectors, packed bottom-up; every node keeps the greatest counts and the smallest and greatest set size below it."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, leaf: int = LEAF) -> None:
        self.counts, self.sizes, self.leaf = counts, sizes, leaf
        m = len(counts)
        # sizes cut the space first (the size bound is the strongest), then the most varied group, as sort-tile packing does
        by_size = np.argsort(sizes, kind="stable")
        slab = leaf * max(1, int(np.ceil(np.sqrt(m / leaf))))
        axis = int(np.argmax(counts.var(axis=0))) if m else 0
        self.order = np.concatenate([s[np.argsort(counts[s, axis], kind="stable")] for s in np.split(by_size, range(slab, m, slab))]) if m else by_size
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # from the leaves up: greatest counts, smallest size, greatest size
        top, low, high = counts[self.order], sizes[self.order], sizes[self.order]
        while m and (len(top) > 1 or not self.levels):
            at = np.arange(0, len(top), leaf)
            top, low, high = np.maximum.reduceat(top, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((top, low, high))

    def search(self, query: np.ndarray, size: int, threshold: float) -> np.ndarray:
        """Places of the points whose bound allows a Jaccard of ``threshold`` with a set of that size and these counts."""
        share = threshold / (1 + threshold)
        nodes = np.arange(len(self.levels[-1][0])) if self.levels else np.zeros(0, int)
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = (x[nodes] for x in self.levels[depth])
            ok = (np.minimum(top, query).sum(axis=1) >= share * (size + np.maximum(low, threshold * size)) - 1e-9) & (high >= threshold * size - 1e-9) & (low * threshold <= size + 1e-9)
            below = len(self.levels[depth - 1][0]) if depth else len(self.order)
            nodes = (nodes[ok][:, None] * self.leaf + np.arange(self.leaf)).ravel()
            nodes = nodes[nodes < below]
        found = self.order[nodes]
        return found[np.minimum(self.counts[found], query).sum(axis=1) >= share * (size + self.sizes[found]) - 1e-9]


def similar_sets(left: list[np.ndarray], left_sizes: np.ndarray, right: list[np.ndarray] | None, right_sizes: np.ndarray | None, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """(i, all j) of the sets at or over the threshold; with right None, i < j within left. Every set of left is a query.

    Sets are given by what isn't unique in them, and their whole sizes.
    """
    other, other_sizes = (left, left_sizes) if right is None else (right, right_sizes)
    if not left or not other:
        return
    flat, first = np.concatenate(other), np.concatenate([[0], np.cumsum([len(x) for x in other])])
    tree = CountTree(group_counts(other), other_sizes)
    mine = tree.counts if right is None else group_counts(left)
    vocabulary, ids = np.unique(flat, return_inverse=True)
    seen = np.zeros(len(vocabulary) + 1, dtype=bool)
    for i, grams in enumerate(left):
        size = int(left_sizes[i])
        found = tree.search(mine[i], size, threshold)
        found = np.sort(found[found > i] if right is None else found)
        if not len(found):
            continue
        at = np.searchsorted(vocabulary, grams)
        at = at[(at < len(vocabulary)) & (vocabulary[np.minimum(at, len(vocabulary) - 1)] == grams)]
        seen[at] = True
        lengths = first[found + 1] - first[found]
        ends = np.cumsum(lengths)
        places = np.arange(ends[-1]) + np.repeat(first[found] - np.concatenate([[0], ends[:-1]]), lengths)
        hits = np.concatenate([[0], np.cumsum(seen[ids[places]])])
        overlap = hits[ends] - hits[ends - lengths]
        seen[at] = False
        near = found[overlap / (size + other_sizes[found] - overlap) >= threshold]
        if len(near):
            yield i, near


# --- packing of arrays into one binary value --------------------------------------------------------


def _bundle(*arrays: np.ndarray) -> bytes:
    head = [len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), len(a)))]
    return np.array(head, np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


def _open(body: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(body, np.int64, 1)[0])
    head, at, out = np.frombuffer(body, np.int64, 2 * n, 8), 8 + 16 * n, []
    for kind, size in head.reshape(-1, 2).tolist():
        out.append(np.frombuffer(body, np.dtype(chr(kind)), size, at))
        at += out[-1].nbytes
    return out


def _deltas(ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences of ascending 64-bit values in as few bytes each as cost least, and a head: that number of bytes, the first value, and place and value of each difference that needs more."""
    steps = np.diff(ascending)
    over = [int((steps >> np.uint64(8 * w - 1) >> np.uint64(1) > 0).sum()) for w in range(1, 9)]
    width = min(range(1, 9), key=lambda w: w * len(steps) + 16 * over[w - 1])
    far = np.flatnonzero(steps >> np.uint64(8 * width - 1) >> np.uint64(1))
    packed = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).ravel()
    return packed, np.concatenate([np.array([width], np.uint64), ascending[:1], far.astype(np.uint64), steps[far]])


def _undo(packed: np.ndarray, head: np.ndarray) -> np.ndarray:
    width, far = int(head[0]), head[2:].reshape(2, -1)
    steps = np.zeros((len(packed) // width, 8), np.uint8)
    steps[:, :width] = packed.reshape(-1, width)
    steps = steps.view("<u8").ravel()
    steps[far[0].astype(np.int64)] = far[1]
    return np.cumsum(np.concatenate([head[1:2], steps]), dtype=np.uint64)


# --- regions ------------------------------------------------------------------------------------------


def gram_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes (56 bits) of each text."""
    grams, first = vectext.ngram_hashes(vectext.words(texts), n)
    grams = grams >> np.uint64(8)
    return [np.unique(grams[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def _range_of(grams: np.ndarray, parts: int) -> np.ndarray:
    """The number of the range of hashes, in order of the hashes."""
    return ((grams >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(24)


_PIECES = "target int, flush bigint, part int, body binary"
_KEPT = "kind int, target int, sig bigint, ids array<bigint>, size bigint, body binary"


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["target", "flush", "part", "body"])


def _gather(docs: DataFrame, n: int, parts: int, flush_grams: int) -> DataFrame:
    """Flushes: a row with the distinct grams of each range of hashes, sorted, and one (part -1) with the documents and the places of their grams among all those."""
    flush_grams = max(flush_grams, min(512 * parts, 1 << 24))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush = TaskContext.get().partitionId() << 32
        held: dict[int, tuple[np.ndarray, list[int]]] = {}
        empty: list[int] = []
        total = 0

        def send() -> pa.RecordBatch:
            sets, ids = [s for s, _ in held.values()], [i for _, i in held.values()]
            sizes = np.array([len(s) for s in sets], np.uint32)
            grams, places, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            steps = np.diff(places, prepend=0)
            begins = places[first].astype(np.uint32) if len(sets) else np.zeros(0, np.uint32)
            far = np.flatnonzero(steps >= 65535)
            far = far[~np.isin(far, first)] if len(far) else far
            short = steps.astype(np.uint16)
            short[far] = 65535
            bounds = np.searchsorted(_range_of(grams, parts), np.arange(parts + 1, dtype=np.uint64))
            rows = []
            for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                if a < b:
                    several = np.flatnonzero(count[a:b] > 1)
                    rows.append((k, flush, k, _bundle(*_deltas(grams[a:b]), several.astype(np.uint32), count[a:b][several].astype(np.uint32))))
            about = _bundle(np.array([*held], np.int64), sizes, begins, short, far.astype(np.uint32), steps[far].astype(np.uint32), np.diff(bounds).astype(np.uint32),
                            np.array([len(i) for i in ids], np.uint32), np.array([x for i in ids for x in i], np.int64), np.array(empty, np.int64))
            return _pieces([*rows, (((flush >> 32) + (flush & 0xFFFF)) * 7919 % parts, flush, -1, about)])

        for batch in batches:
            for part in vectext.chunks(batch):
                for doc, grams in zip(part.column("doc_id").to_pylist(), gram_sets(part.column("text"), n), strict=True):
                    if not len(grams):
                        empty.append(doc)
                        continue
                    sig = xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)
                    if sig in held:
                        held[sig][1].append(doc)
                        continue
                    held[sig] = grams, [doc]
                    total += len(grams)
                if total >= flush_grams or len(empty) > 100_000:
                    yield send()
                    held, empty, total, flush = {}, [], 0, flush + 1
        if held or empty:
            yield send()

    return small_batches(docs).where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), normal_text().alias("text")).mapInArrow(releasing(run), _PIECES)


def _shared(pieces: DataFrame, parts: int) -> DataFrame:
    """Back to each flush: which of its grams other documents have too (bits), how frequent they are (eighths of a binary logarithm), and their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for target, flush, part, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part < 0:
                    yield _pieces([(target, flush, part, body)])
                else:
                    held.setdefault(part, []).append((flush, body))
        for part, own in held.items():
            opened = [_open(body) for _, body in own]
            lists = [_undo(packed, width) for packed, width, _, _ in opened]
            counts = [np.ones(len(grams), np.int64) for grams in lists]
            for one, (_, _, several, count) in zip(counts, opened, strict=True):
                one[several] = count
            grams, count = np.concatenate(lists), np.concatenate(counts)
            order = np.argsort(grams)
            grams, count = grams[order], count[order]
            first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
            grams, count = grams[first], np.add.reduceat(count, first)
            grams, count = grams[count > 1], count[count > 1]
            level = np.minimum(255, np.floor(8 * np.log2(count))).astype(np.uint8)
            for (flush, _), mine in zip(own, lists, strict=True):
                at = np.searchsorted(grams, mine)
                hit = at < len(grams)
                hit[hit] = grams[at[hit]] == mine[hit]
                yield _pieces([(0, flush, part, _bundle(np.packbits(hit), level[at[hit]], *_deltas(mine[hit])))])

    return pieces.repartitionById(parts, F.col("target")).mapInArrow(releasing(run), _PIECES)


def _runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys, over the borders of batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in key]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = tuple(c[a] for c in cols)
            if held and own != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = own
    if held:
        yield pa.Table.from_batches(held)


def _flush(own: pa.Table, parts: int, threshold: float) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """The rows of a flush's sets, and the looked-up (gram, sig)."""
    bodies = dict(zip(own.column("part").to_pylist(), own.column("body").to_pylist(), strict=True))
    sigs, sizes, begins, short, far, jumps, lengths, copies, ids, empty = _open(bodies.pop(-1))
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
    steps = short.astype(np.int64)
    steps[far] = jumps
    steps[first] = 0
    owner = np.repeat(np.arange(len(sizes)), sizes)
    places = np.cumsum(steps)
    places += (begins - places[first])[owner] if len(sizes) else 0
    shared, level, grams = [], [], []
    for k, length in enumerate(lengths.tolist()):
        if k in bodies:
            bits, own_level, packed, width = _open(bodies[k])
            shared.append(np.unpackbits(bits, count=length).astype(bool))
            level.append(own_level)
            grams.append(_undo(packed, width))
    shared = np.concatenate([np.zeros(0, bool), *shared])
    grams, level = np.concatenate([np.zeros(0, np.uint64), *grams]), np.concatenate([np.zeros(0, np.uint8), *level])
    at = shared[places]
    owner, which = owner[at], (np.cumsum(shared) - 1)[places[at]]
    count = np.bincount(owner, minlength=len(sizes))
    # unique grams come first in the order of grams and fill the front places
    need = sizes.astype(np.int64) - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1 - (sizes - count)
    begin = np.concatenate([[0], np.cumsum(count)])
    order = np.lexsort(((level.astype(np.uint64) << np.uint64(56) | grams)[which], owner))
    looked = (np.arange(len(order)) - begin[owner[order]]) < need[owner[order]]
    looked = order[looked]
    rows, ends = [], np.cumsum(copies)
    for d, (sig, size, a, b) in enumerate(zip(sigs.tolist(), sizes.tolist(), (ends - copies).tolist(), ends.tolist(), strict=True)):
        body = grams[which[begin[d] : begin[d + 1]]].tobytes() if need[d] > 0 and count[d] else None
        rows.append((0, 0, sig, ids[a:b], size, body))
    rows += [(0, 0, None, empty[k : k + 1000], 0, None) for k in range(0, len(empty), 1000)]
    return rows, grams[which[looked]], sigs[owner[looked]]


def _kept(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    types = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["kind", "target", "sig", "ids", "size", "body"])


def _stars(grams: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct grams and the least sig of each, and links of all other sigs with the least one."""
    order = np.lexsort((sigs, grams))
    grams, sigs = grams[order], sigs[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(grams)), bool), grams[1:] != grams[:-1]]))
    least = np.repeat(sigs[first], np.diff(np.append(first, len(grams))))
    links = np.stack([sigs, least])[:, sigs != least]
    return grams[first], sigs[first], np.unique(links, axis=1) if links.shape[1] else links


def _postings(grams: np.ndarray, sigs: np.ndarray) -> bytes:
    table, index = np.unique(sigs, return_inverse=True)
    return _bundle(*_deltas(grams), table, index.astype(np.min_scalar_type(len(table))))


def _linked(returned: DataFrame, parts: int, threshold: float) -> DataFrame:
    """Rows of kind 0: sets with the ids of their documents, and what isn't unique in them if they have a region; 1: looked-up grams by range; 2: links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _runs(batches, ["flush"]):
            rows, grams, sigs = _flush(own, parts, threshold)
            for k in range(0, len(rows), 1000):
                yield _kept(rows[k : k + 1000])
            grams, least, links = _stars(grams, sigs)
            bounds = np.searchsorted(_range_of(grams, parts), np.arange(parts + 1, dtype=np.uint64)).tolist()
            rows = [(1, k, None, None, None, _postings(grams[a:b], least[a:b])) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if a < b]
            if rows:
                yield _kept([*rows, (2, 0, None, None, None, _bundle(*links))])

    return returned.repartition("flush").sortWithinPartitions("flush", "part").mapInArrow(releasing(run), _KEPT)


def _links(kept: DataFrame, parts: int) -> DataFrame:
    """(u, v): links of sets that share a looked-up gram, enough to connect them."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0).to_pylist():
                u, v = _open(body)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for target, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                packed, head, table, index = _open(body)
                held.setdefault(target, []).append((_undo(packed, head), table[index]))
        for own in held.values():
            u, v = _stars(np.concatenate([g for g, _ in own]), np.concatenate([s for _, s in own]))[2]
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    inside = kept.where("kind = 2").select("body").mapInArrow(opened, "u bigint, v bigint")
    return inside.union(kept.where("kind = 1").select("target", "body").repartitionById(parts, F.col("target")).mapInArrow(releasing(between), "u bigint, v bigint"))


def _cells(sets: DataFrame, threshold: float, block: int) -> DataFrame:
    """Each set in every pair of blocks of its region that may hold partners: (region, x, y, mine, sig, size, weight), x and y being names of blocks.

    A region of at most ``block`` sets is one block. Others are cut by size (powers of the square root of two) and, within a size, by hash into as many blocks as are needed.
    """
    in_region = sets.groupBy("region").agg(F.count("*").alias("m"))
    size_class = F.floor(F.lit(2.0) * F.log2(F.col("size").cast("double"))).cast("int")
    placed = sets.join(in_region, "region").withColumn("class", F.when(F.col("m") > block, size_class).otherwise(0))
    blocks = placed.where(F.col("m") > block).groupBy("region", "class").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("k"))
    own = blocks.select("region", "class", F.col("k").alias("own_k"))
    placed = placed.join(own, ["region", "class"], "left").withColumn("sub", F.coalesce(F.pmod(F.xxhash64("sig"), F.col("own_k")).cast("int"), F.lit(0)))
    name = lambda c, s: (c.cast("bigint") * F.lit(1 << 31) + s.cast("bigint"))
    columns = ["region", "mine", "sig", "size", "weight"]
    mine = placed.withColumn("mine", name(F.col("class"), F.col("sub")))
    small = mine.where(F.col("m") <= block).select(columns[0], F.col("mine").alias("x"), F.col("mine").alias("y"), *columns[1:])
    apart = int(np.floor(1 + 2 * np.log2(1 / threshold)))
    others = blocks.select(F.col("region").alias("r"), F.col("class").alias("c"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("s"))
    large = (
        mine.where(F.col("m") > block).join(others, (F.col("region") == F.col("r")) & (F.abs(F.col("class") - F.col("c")) <= apart))
        .withColumn("other", name(F.col("c"), F.col("s")))
        .select("region", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), *columns[1:])
    )
    return small.union(large)


def _search(cells: DataFrame, threshold: float) -> DataFrame:
    """(sig, links, root): for each set with partners in a cell the sum of their weights, and a set that a chain of pairs joins it to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _runs(batches, ["region", "x", "y"]):
            grams = [np.frombuffer(g, np.uint64) for g in cell.column("grams").to_pylist()]
            mine, sig, size, weight = (cell.column(c).to_numpy() for c in ("mine", "sig", "size", "weight"))
            x, y = cell.column("x")[0].as_py(), cell.column("y")[0].as_py()
            left = np.flatnonzero(mine == x)
            right = left if x == y else np.flatnonzero(mine == y)
            pairs = similar_sets([grams[i] for i in left], size[left], None if x == y else [grams[i] for i in right], None if x == y else size[right], threshold)
            links, root = np.zeros(len(sig), np.int64), np.arange(len(sig))
            for i, near in pairs:
                a, near = left[i], right[near]
                links[a] += weight[near].sum()
                links[near] += weight[a]
                old = np.unique(root[np.append(near, a)])
                if len(old) > 1:
                    root[np.isin(root, old)] = old[0]
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(sig[some]), pa.array(links[some]), pa.array(sig[root[some]])], names=["sig", "links", "root"])

    return cells.repartition("region", "x", "y").sortWithinPartitions("region", "x", "y", "sig").mapInArrow(releasing(run), "sig bigint, links bigint, root bigint")


def ngram_jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, block: int = BLOCK, flush_grams: int = FLUSH) -> DataFrame:
    """(doc_id, class_id, n_links) for each doc_id: the documents whose n-gram sets have at least that Jaccard similarity with its own are counted, and those that chains of such pairs join are one class.

    class_id is the least doc_id of the class. A pair of documents with equal sets is a link like any other.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = cut(_linked(_shared(_gather(docs, n, parts, flush_grams), parts), parts, threshold))
    free_shuffles(docs.sparkSession)  # those of the flushes, more than all that follow
    own = kept.where("kind = 0 and sig is not null").select("sig", F.explode("ids").alias("doc_id")).distinct()
    weights = own.groupBy("sig").agg(F.count("*").alias("weight"), F.min("doc_id").alias("least"))
    regions = connected_components(_links(kept, parts)).select(F.col("id").alias("sig"), F.col("component").alias("region"))
    bodies = kept.where("kind = 0 and body is not null").select("sig", "size", F.col("body").alias("grams"))
    sets = cut(bodies.select("sig", "size").distinct().join(regions, "sig").join(weights.select("sig", "weight"), "sig"))
    # the sets' grams are moved to their cells only
    found = cut(_search(_cells(sets, threshold, block).join(bodies.drop("size").dropDuplicates(["sig"]), "sig"), threshold))
    free_shuffles(docs.sparkSession)
    classes = connected_components(found.select(F.col("sig").alias("u"), F.col("root").alias("v")))
    each = weights.join(found.groupBy("sig").agg(F.sum("links").alias("links")), "sig", "left").join(classes.withColumnRenamed("id", "sig"), "sig", "left")
    each = cut(each.select("sig", F.coalesce("component", "sig").alias("class"), "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links")))
    named = each.join(each.groupBy("class").agg(F.min("least").alias("class_id")), "class").select("sig", "class_id", "links")
    wordless = kept.where("kind = 0 and sig is null").select(F.explode("ids").alias("doc_id")).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("links"))
    rows = own.join(named, "sig").select("doc_id", "class_id", "links").union(wordless)
    return rows.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("n_links"))


def keep_one_of_each_group(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, broadcast_ids: int = BROADCAST_IDS, **how: int) -> DataFrame:
    """docs without the documents that a chain of similar pairs joins to one of a smaller doc_id; columns as they were.

    Rows repeated under one doc_id and text become one. Rows with a null doc_id stay. Texts are moved only if more than ``broadcast_ids`` documents go, or have repeated ids.
    """
    gone_id, again_id, mark = (free_name(docs, x) for x in ("gone", "again", "mark"))
    dropped = cut(ngram_jaccard_join(docs, n, threshold, **how).where("doc_id <> class_id").select(F.col("doc_id").alias(gone_id)))
    repeated = cut(docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias(again_id)).count().where("count > 1").select(again_id))
    small = lambda ids: F.broadcast(ids) if ids.count() <= broadcast_ids else ids
    kept = docs.join(small(dropped), F.col("doc_id").cast("bigint") == F.col(gone_id), "left_anti")
    same = F.col("doc_id").cast("bigint") == F.col(again_id)
    ids = small(repeated)
    once = kept.join(ids, same, "left_semi").withColumn(mark, F.xxhash64(normal_text())).dropDuplicates(["doc_id", mark]).drop(mark)
    return kept.join(ids, same, "left_anti").union(once)


#: The same rows by brute force over all pairs that share an n-gram.
SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
u AS (SELECT doc_id, r, unnest(ws) AS t, generate_subscripts(ws, 1) AS i FROM w WHERE len(ws) >= {N}),
n AS (SELECT doc_id, r, t || ' ' || lead(t) OVER p || ' ' || lead(t, 2) OVER p AS gram FROM u WINDOW p AS (PARTITION BY r ORDER BY i)
      UNION ALL SELECT doc_id, r, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND {N - 1}),
s AS (SELECT doc_id, r, list_sort(list(DISTINCT gram)) AS grams FROM n WHERE gram IS NOT NULL GROUP BY doc_id, r),
c AS (SELECT grams, list_sort(list(DISTINCT doc_id)) AS members, row_number() OVER () AS sig FROM s GROUP BY grams),
g AS (SELECT sig, unnest(grams) AS gram FROM c),
o AS (SELECT a.sig AS a, b.sig AS b, count(*) AS n FROM g a JOIN g b ON a.gram = b.gram AND a.sig < b.sig GROUP BY ALL),
e AS (SELECT a, b, len(x.members) AS wa, len(y.members) AS wb FROM o JOIN c x ON x.sig = a JOIN c y ON y.sig = b WHERE n / (len(x.grams) + len(y.grams) - n)::DOUBLE >= {THRESHOLD}),
l AS (SELECT sig, sum(n)::BIGINT AS n FROM (SELECT a AS sig, wb AS n FROM e UNION ALL SELECT b, wa FROM e) GROUP BY sig),
b AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT sig AS a, sig AS b FROM c UNION SELECT reach.a, b.b FROM reach JOIN b ON b.a = reach.b),
k AS (SELECT reach.a AS sig, min(list_min(members)) AS class_id FROM reach JOIN c ON c.sig = reach.b GROUP BY reach.a),
m AS (SELECT sig, unnest(members) AS doc_id, len(members) - 1 AS copies FROM c),
d AS (SELECT doc_id, class_id, copies + coalesce(n, 0) AS n_links FROM m JOIN k USING (sig) LEFT JOIN l USING (sig)
      UNION ALL SELECT DISTINCT doc_id, doc_id, 0 FROM w WHERE len(ws) = 0)
SELECT doc_id, min(class_id) AS class_id, sum(n_links)::BIGINT AS n_links FROM d GROUP BY doc_id
"""
