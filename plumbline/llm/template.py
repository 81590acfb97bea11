"""HTML extraction by equivalence-class template deduction.

A page is a row of tokens: tags with the path of block tags they stand in, and words with the path, the tag before them and their place behind it. Tags, or words, of one host whose
occurrence vectors (how often each page of the host has them) are equal belong to one equivalence class. A class of tags stands on ``SUPPORT`` of the host's pages, one of words on ``WORD_SUPPORT`` (copies of an article on a few pages aren't
boilerplate), and on two pages at least. A class is valid if ``MIN_TOKENS`` are in it and if on every page they come in one order, over and over: the first, the second, ... the last, the first again. Valid classes are nested: for any two of them all tokens of one must lie, on every page, in one and the same gap between tokens of the other (or before or behind them all).
Of two classes that cross, the one on fewer pages is dropped (of fewer tokens if they are on as many). The classes that are left are the host's template. A slot is what a page has in a gap of a class; behind the last token of a class it is the gap of the class around it. Slots are extracted
with class and gap.

How it's distributed: a token on a share of a host's pages is on that share of them in some task, so each task counts its pages' tokens and sends on those that are frequent there; with what the others may have left out at most, a host's candidates are
known for sure. A second pass writes each page's candidates in order, from which vectors, order and gaps are counted, added up by task first. No host's pages meet in one task; what meets is a host's candidates, of which there can be no more than 1 / SUPPORT times
a page's tokens. A third pass cuts the pages. Candidates and templates are broadcast if they have at most ``BROADCAST_TOKENS`` tokens in all, else joined by host.

Nulls: a null url is the host "", a null html the empty page, which has no slots. page_id may be null or repeated; each row is extracted, and exactly repeated rows count as pages of their own, which makes no two vectors equal that
weren't. A host with a single page has no template: all its text is outside of classes. Ties in the order of classes are broken by the classes' hashes. Very long pages are read whole, one at a time. An empty table gives no rows. Only page_id, url and html are read, so other columns may have any name.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import vectext
from plumbline.llm.jaccard import _runs
from plumbline.llm.markup import Reader
from plumbline.llm.support import cut

MIN_TOKENS, SUPPORT, WORD_SUPPORT, BROADCAST_TOKENS = 3, 0.1, 0.3, 200_000
#: Tokens gathered by a task before they are sent on.
FLUSH = 1 << 22
#: Slots under these aren't main text.
ASIDE = {*"head title nav header footer aside form".split()}
_AD = re.compile(r"\b(?:ad|ads|advert|banner|sidebar|cookie|promo|share|menu|breadcrumb)s?\b", re.I)


def host_of(url: Column) -> Column:
    """The host in lower case without port and user; "" where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


def _pages(pages: DataFrame) -> DataFrame:
    url, html = F.coalesce(F.col("url").cast("string"), F.lit("")), F.coalesce(F.col("html").cast("string"), F.lit(""))
    named = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host_of(url).alias("host"), html.alias("html"), F.xxhash64("page_id", url, html).alias("mark"))
    return named.withColumn("h", F.xxhash64("host"))


def _least(pages: Any, share: float) -> Any:
    """Pages that a token must be on."""
    return np.maximum(2, np.ceil(share * pages - 1e-9).astype(np.int64))


def _table(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=[*columns])


def _read(reader: Reader, part: pa.RecordBatch) -> tuple[Any, np.ndarray]:
    """The tokens of pages, and each one's hash: another one on another host, the last bit set for words."""
    tokens = reader.read(part.column("html"))
    host = part.column("h").to_numpy().view(np.uint64)[tokens.page]
    return tokens, (vectext.mix(tokens.role + vectext.mix(host)) & ~np.uint64(1) | tokens.role & np.uint64(1)).view(np.int64)


# --- candidates ------------------------------------------------------------------------------------


def _candidates(source: DataFrame, support: float, word_support: float) -> DataFrame:
    """(h, t): the tokens that are on enough pages of their host."""

    def slack(n: np.ndarray, share: float) -> np.ndarray:
        """Pages on which a token may be without being sent on."""
        return np.maximum(0, np.ceil(share * n - 1e-9).astype(np.int64) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        hosts: list[np.ndarray] = []
        tokens: list[np.ndarray] = []
        owners: list[np.ndarray] = []

        def send() -> Iterator[pa.RecordBatch]:
            h, n = np.unique(np.concatenate(hosts), return_counts=True)
            slacks = slack(n, support), slack(n, word_support)
            yield _table(h=h, t=np.zeros(len(h), np.int64), of_host=np.ones(len(h), bool), n=n, slack=slacks[0], word_slack=slacks[1])
            t, first, on = np.unique(np.concatenate(tokens), return_index=True, return_counts=True)
            host = np.searchsorted(h, np.concatenate(owners)[first])
            own = np.where(t & 1, slacks[1][host], slacks[0][host])
            kept = np.flatnonzero(on > own)
            for k in range(0, len(kept), 100_000):
                some = kept[k : k + 100_000]
                yield _table(h=h[host[some]], t=t[some], of_host=np.zeros(len(some), bool), n=on[some], slack=own[some], word_slack=np.zeros(len(some), np.int64))

        for batch in batches:
            for part in vectext.chunks(batch, "html"):
                read, t = _read(reader, part)
                h = part.column("h").to_numpy()
                hosts.append(h)
                order = np.lexsort((t, read.page))
                page, t = read.page[order], t[order]
                new = np.ones(len(t), bool)
                new[1:] = (t[1:] != t[:-1]) | (page[1:] != page[:-1])
                tokens.append(t[new])
                owners.append(h[page[new]])
                if sum(map(len, tokens)) >= FLUSH:
                    yield from send()
                    hosts, tokens, owners = [], [], []
        if hosts:
            yield from send()

    counted = source.select("h", "html").mapInArrow(run, "h bigint, t bigint, of_host boolean, n bigint, slack bigint, word_slack bigint")
    counted = cut(counted.groupBy("h", "t", "of_host").agg(F.sum("n").alias("n"), F.sum("slack").alias("slack"), F.sum("word_slack").alias("word_slack")))
    host = counted.where("of_host").select("h", F.col("n").alias("pages"), F.col("slack").alias("all_slack"), F.col("word_slack").alias("all_word_slack"))
    is_word = F.col("t").bitwiseAND(F.lit(1)) == 1
    need = F.greatest(F.lit(2), F.ceil(F.when(is_word, F.lit(word_support)).otherwise(F.lit(support)) * F.col("pages") - F.lit(1e-9)))
    most = F.col("n") + F.when(is_word, F.col("all_word_slack")).otherwise(F.col("all_slack")) - F.col("slack")
    return counted.where("not of_host").join(host, "h").where(most >= need).select("h", "t", "pages")


class Known(NamedTuple):
    """Tokens of hosts with what belongs to them: one broadcast table, or the column that a join brings."""

    small: Any  # a broadcast variable or None

    def of(self, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Sorted tokens, and a row of values for each."""
        if self.small:
            return self.small.value
        flat = part.column("known").flatten()
        if not len(flat):
            return np.zeros(0, np.int64), np.zeros((0, 4), np.int64)
        t, values = flat.field("t").to_numpy(), flat.field("v").flatten().to_numpy().reshape(len(flat), -1)  # neither is ever null
        t, first = np.unique(t, return_index=True)
        return t, values[first]


class Lookup(NamedTuple):
    known: Known
    rows: DataFrame

    def joined(self, source: DataFrame) -> DataFrame:
        return source if self.known.small else source.join(self.rows, "h", "left")


def _lookup(rows: DataFrame, columns: list[str], broadcast_tokens: int) -> Lookup:
    """Of rows (h, t, columns): broadcast as one sorted table if there are at most so many, else a list for each host."""
    wide = rows.groupBy("h").agg(F.collect_list(F.struct("t", F.array(*[F.col(c).cast("bigint") for c in columns]).alias("v"))).alias("known"))
    if rows.count() > broadcast_tokens:
        return Lookup(Known(None), wide)
    got = rows.select("t", *[F.col(c).cast("bigint") for c in columns]).toPandas().sort_values("t").to_numpy(np.int64).reshape(-1, 1 + len(columns))
    return Lookup(Known(rows.sparkSession.sparkContext.broadcast((np.ascontiguousarray(got[:, 0]), np.ascontiguousarray(got[:, 1:])))), wide)


def _find(known: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of t that are known, and their places in known."""
    at = np.searchsorted(known, t)
    hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == t) if len(known) else np.zeros(0, np.int64)
    return hit, at[hit]


# --- classes -----------------------------------------------------------------------------------------


def _skeletons(source: DataFrame, lookup: Lookup) -> DataFrame:
    """(h, mark, tokens): the candidates of each page, in order, as 64-bit integers."""
    known = lookup.known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            for part in vectext.chunks(batch, "html"):
                read, t = _read(reader, part)
                hit, _ = _find(known.of(part)[0], t)
                bounds = np.searchsorted(read.page[hit], np.arange(part.num_rows + 1))
                t = t[hit]
                bodies = [t[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("h"), part.column("mark"), pa.array(bodies, pa.binary())], names=["h", "mark", "tokens"])

    return lookup.joined(source.select("h", "mark", "html")).mapInArrow(run, "h bigint, mark bigint, tokens binary")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of skeletons one after another, and where each page's begin, with the end appended."""
    bodies = batch.column("tokens").to_pylist()
    return np.frombuffer(b"".join(bodies), np.int64), np.concatenate([[0], np.cumsum([len(b) // 8 for b in bodies])]).astype(np.int64)


_VECTOR = ["p1", "p2", "p3", "p4"]


def _vectors(skeletons: DataFrame) -> DataFrame:
    """(h, t, on, p1..p4, low, high, place): pages of a token, four sums of hashes of (page, count) that tell its occurrence vector, and the least, greatest and summed first place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = 0

        def send() -> pa.RecordBatch:
            rows = np.concatenate(held, axis=1)
            rows = rows[:, np.argsort(rows[1], kind="stable")]
            at = np.flatnonzero(np.concatenate([np.ones(min(1, rows.shape[1]), bool), rows[1, 1:] != rows[1, :-1]]))
            sums = np.add.reduceat(rows[2:8], at, axis=1) if len(at) else rows[2:8]
            low, high = (f.reduceat(rows[7], at) if len(at) else rows[7] for f in (np.minimum, np.maximum))
            return _table(h=rows[0, at], t=rows[1, at], on=sums[0], p1=sums[1], p2=sums[2], p3=sums[3], p4=sums[4], low=low, high=high, place=sums[5])

        for batch in batches:
            t, first = _flat(batch)
            page = np.repeat(np.arange(batch.num_rows), np.diff(first))
            place = np.arange(len(t)) - first[page]
            order = np.lexsort((place, t, page))
            page, t, place = page[order], t[order], place[order]
            at = np.flatnonzero(np.concatenate([np.ones(min(1, len(t)), bool), (t[1:] != t[:-1]) | (page[1:] != page[:-1])]))
            count = np.diff(np.append(at, len(t))).astype(np.uint64)
            x = vectext.mix(batch.column("mark").to_numpy().view(np.uint64)[page[at]] + count * np.uint64(0x9E3779B97F4A7C15))
            y = vectext.mix(x + np.uint64(1))
            low30 = np.uint64((1 << 30) - 1)
            prints = [(z >> np.uint64(s) & low30).astype(np.int64) for z in (x, y) for s in (0, 30)]
            held.append(np.stack([batch.column("h").to_numpy()[page[at]], t[at], np.ones(len(at), np.int64), *prints, place[at]]))
            total += len(at)
            if total >= FLUSH:
                yield send()
                held, total = [], 0
        if held:
            yield send()

    rows = skeletons.mapInArrow(run, "h bigint, t bigint, on bigint, p1 bigint, p2 bigint, p3 bigint, p4 bigint, low bigint, high bigint, place bigint")
    return rows.groupBy("h", "t").agg(*[F.sum(c).alias(c) for c in ("on", *_VECTOR, "place")], F.min("low").alias("low"), F.max("high").alias("high"))


def equal_vectors(t: np.ndarray, on: np.ndarray, vector: np.ndarray, low: np.ndarray, high: np.ndarray, place: np.ndarray, min_tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chosen tokens, class, number in it) of one host: classes of equal vectors, without tags whose least, greatest and mean first places don't agree on the order; words must all agree."""
    key = np.concatenate([(t & 1)[:, None], on[:, None], vector], axis=1)
    _, group = np.unique(key, axis=0, return_inverse=True)
    chosen, classes, numbers = [], [], []
    for g in range(group.max() + 1 if len(t) else 0):
        own = np.flatnonzero(group == g)
        if len(own) < min_tokens:
            continue
        own = own[np.lexsort((t[own], place[own]))]
        agree = np.ones(len(own), bool)
        for c in (low, high):
            agree &= np.lexsort((t[own], c[own])) == np.arange(len(own))
        if not agree.all():
            if t[own[0]] & 1:
                continue
            own = own[agree]
        if len(own) >= min_tokens:
            chosen.append(own)
            classes.append(np.full(len(own), len(classes)))
            numbers.append(np.arange(len(own)))
    flat = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
    return flat(chosen), flat(classes), flat(numbers)


def _classes(vectors: DataFrame, pages: DataFrame, min_tokens: int, support: float, word_support: float) -> DataFrame:
    """(h, t, class, number, size, on): classes of one host, numbered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _runs(batches, ["h"]):
            c = {k: own.column(k).to_numpy() for k in own.column_names}
            enough = np.flatnonzero(c["on"] >= np.where(c["t"] & 1, _least(c["pages"], word_support), _least(c["pages"], support)))
            c = {k: v[enough] for k, v in c.items()}
            some, of, number = equal_vectors(c["t"], c["on"], np.stack([c[p] for p in _VECTOR], axis=1), c["low"], c["high"], c["place"], min_tokens)
            yield _table(h=c["h"][some], t=c["t"][some], **{"class": of, "number": number, "size": np.bincount(of)[of] if len(of) else of, "on": c["on"][some]})

    together = vectors.join(pages, "h").repartition("h").sortWithinPartitions("h", "t")
    return together.mapInArrow(run, "h bigint, t bigint, class bigint, number bigint, size bigint, on bigint")


def gaps_of(classes: np.ndarray, numbers: np.ndarray, sizes: np.ndarray, page: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
    """For pages of one host, the class tokens in order: (a, b) -> least and greatest gap of a in which tokens of b lie; gap k is behind token k, -1 before the first. (a, a) -> (1, 1) if the tokens of a come in order on all pages, else (0, 0)."""
    out: dict[tuple[int, int], tuple[int, int]] = {}
    new_page = np.flatnonzero(np.concatenate([np.ones(min(1, len(page)), bool), page[1:] != page[:-1]]))
    begin = np.repeat(new_page, np.diff(np.append(new_page, len(page))))
    every = np.unique(classes)
    order = np.argsort(classes, kind="stable")
    at = np.searchsorted(classes[order], every)
    for a in every.tolist():
        mine = classes == a
        own, whose, size = numbers[mine], page[mine], int(sizes[mine][0])
        first = np.ones(len(own), bool)
        first[1:] = whose[1:] != whose[:-1]
        follows = np.ones(len(own), bool)
        follows[1:] = own[1:] == (own[:-1] + 1) % size
        last = np.append(first[1:], True)
        good = (own[first] == 0).all() and (own[last] == size - 1).all() and (follows | first).all()
        out[a, a] = (int(good), int(good))
        if not good:
            continue
        seen = np.maximum.accumulate(np.where(mine, np.arange(len(page)), -1))
        gap = np.where(seen >= begin, numbers[np.maximum(seen, 0)], -1)
        # behind the last token and before the first one are outside; on pages without a there is no gap at all
        there = np.isin(page, whose)
        low, high = np.where(there, gap, 1 << 40)[order], np.where(there, gap, -2)[order]
        for b, lo, hi in zip(every.tolist(), np.minimum.reduceat(low, at).tolist(), np.maximum.reduceat(high, at).tolist(), strict=True):
            if b != a and hi > -2:
                out[a, b] = (lo, hi)
    return out


def _pairs(skeletons: DataFrame, lookup: Lookup) -> DataFrame:
    """(h, a, b, low, high): gaps_of over all pages."""
    known = lookup.known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], tuple[int, int]] = {}
        for batch in batches:
            t, first = _flat(batch)
            page = np.repeat(np.arange(batch.num_rows), np.diff(first))
            tokens, values = known.of(batch)
            hit, at = _find(tokens, t)
            page, values = page[hit], values[at]
            h = batch.column("h").to_numpy()
            order = np.argsort(h[page], kind="stable")
            page, values = page[order], values[order]
            whose = h[page]
            cuts = np.flatnonzero(np.concatenate([np.ones(min(1, len(page)), bool), whose[1:] != whose[:-1]])).tolist()
            for x, y in zip(cuts, [*cuts[1:], len(page)], strict=True):
                for (a, b), (lo, hi) in gaps_of(values[x:y, 0], values[x:y, 1], values[x:y, 2], page[x:y]).items():
                    old = held.get((int(whose[x]), a, b), (lo, hi))
                    held[int(whose[x]), a, b] = min(lo, old[0]), max(hi, old[1])
            if len(held) > FLUSH >> 4:
                yield _of_pairs(held)
                held = {}
        if held:
            yield _of_pairs(held)

    rows = lookup.joined(skeletons).mapInArrow(run, "h bigint, a bigint, b bigint, low bigint, high bigint")
    return rows.groupBy("h", "a", "b").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def _of_pairs(held: dict[tuple[int, int, int], tuple[int, int]]) -> pa.RecordBatch:
    rows = np.array([(*k, *v) for k, v in held.items()], np.int64).reshape(-1, 5)
    return _table(h=rows[:, 0], a=rows[:, 1], b=rows[:, 2], low=rows[:, 3], high=rows[:, 4])


def nest(size: dict[int, int], on: dict[int, int], gaps: dict[tuple[int, int], tuple[int, int]]) -> dict[int, list[tuple[int, int]]]:
    """The classes that are kept, each with the (class, gap) around it, outermost first."""
    kept: list[int] = []
    single = lambda a, b: (a, b) not in gaps or gaps[a, b][0] == gaps[a, b][1] or {*gaps[a, b]} == {-1, size[a] - 1}
    for c in sorted(size, key=lambda c: (-on[c], -size[c], c)):
        if gaps.get((c, c), (0, 0)) == (1, 1) and all(single(k, c) or single(c, k) for k in kept):
            kept.append(c)
    around = {c: [(a, gaps[a, c][0]) for a in kept if a != c and (a, c) in gaps and gaps[a, c][0] == gaps[a, c][1] and 0 <= gaps[a, c][0] < size[a] - 1] for c in kept}
    for c in kept:
        around[c].sort(key=lambda x: (len(around[x[0]]), -on[x[0]], x[0]))
    return around


def templates(pages: DataFrame, min_tokens: int = MIN_TOKENS, support: float = SUPPORT, word_support: float = WORD_SUPPORT, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """(h, t, class, gap, depth, total): each token of a host's template, the class and gap that are open behind it (-1, -1 outside of all), the depth of its own class, and the number of tokens of the whole template."""
    source = _pages(pages)
    candidates = cut(_candidates(source, support, word_support))
    skeletons = cut(_skeletons(source, _lookup(candidates, ["pages"], broadcast_tokens)))
    classes = cut(_classes(_vectors(skeletons), candidates.select("h", "pages").distinct(), min_tokens, support, word_support))
    pairs = _pairs(skeletons, _lookup(classes, ["class", "number", "size"], broadcast_tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _runs(batches, ["h"]):
            rows = own.to_pylist()
            of_class = {r["class"]: r for r in rows if r["t"] is not None}
            gaps = {(r["a"], r["b"]): (r["low"], r["high"]) for r in rows if r["t"] is None}
            around = nest({c: r["size"] for c, r in of_class.items()}, {c: r["on"] for c, r in of_class.items()}, gaps)
            out = []
            for r in rows:
                if r["t"] is not None and r["class"] in around:
                    outer = around[r["class"]]
                    place = (r["class"], r["number"]) if r["number"] < r["size"] - 1 else outer[-1] if outer else (-1, -1)
                    out.append((r["h"], r["t"], *place, len(outer)))
            found = np.array(out, np.int64).reshape(-1, 5)
            yield _table(h=found[:, 0], t=found[:, 1], **{"class": found[:, 2], "gap": found[:, 3], "depth": found[:, 4], "total": np.full(len(found), len(found))})

    none = [F.lit(None).cast("bigint").alias(c) for c in ("a", "b", "low", "high")]
    blank = [F.lit(None).cast("bigint").alias(c) for c in ("t", "class", "number", "size", "on")]
    both = classes.select("h", "t", "class", "number", "size", "on", *none).union(pairs.select("h", *blank, "a", "b", "low", "high"))
    return both.repartition("h").sortWithinPartitions("h", "t", "a", "b").mapInArrow(run, "h bigint, t bigint, class bigint, gap bigint, depth bigint, total bigint")


# --- extraction ----------------------------------------------------------------------------------------

_SLOT = pa.struct([("path", pa.string()), ("class", pa.int64()), ("gap", pa.int64()), ("text", pa.string())])
_OUT = "page_id bigint, host string, template_size int, slots array<struct<path: string, class: bigint, gap: bigint, text: string>>, text string"


def _main(path: str) -> bool:
    return not any(p.partition(".")[0] in ASIDE or _AD.search(p.partition(".")[2]) for p in path.split("/"))


def extract(reader: Reader, part: pa.RecordBatch, known: np.ndarray, values: np.ndarray) -> tuple[pa.Array, list[str]]:
    """The slots of pages, and their main text: the slots outside head, navigation, advertisements and the like, one a line.

    known and values: the template's tokens, and class and gap open behind each. A slot ends at a token of the template, at a tag that breaks text, and where the path changes.
    """
    read, t = _read(reader, part)
    hit, at = _find(known, t)
    is_template = np.zeros(len(t), bool)
    is_template[hit] = True
    place = np.full((len(t), 2), -1, np.int64)
    place[hit] = values[at][:, :2]
    index = np.arange(len(t))
    page_begin = np.searchsorted(read.page, np.arange(part.num_rows + 1))
    behind = np.maximum.accumulate(np.where(is_template, index, -1)) if len(t) else index
    place = np.where((behind >= page_begin[read.page])[:, None], place[np.maximum(behind, 0)], -1)
    words = np.flatnonzero((read.role & np.uint64(1) == 1) & ~is_template)
    breaks = np.cumsum(is_template | read.ends)[words]
    fresh = np.ones(len(words), bool)
    fresh[1:] = (breaks[1:] != breaks[:-1]) | (read.page[words][1:] != read.page[words][:-1]) | (read.path[words][1:] != read.path[words][:-1])
    # the words' bytes, each with a space behind it, or a line end behind the last word of a slot
    start, length = read.start[words], read.end[words] - read.start[words]
    ends = np.cumsum(length + 1)
    source = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length - 1), length + 1)
    out = read.data[np.minimum(source, len(read.data) - 1)] if len(source) else np.zeros(0, np.uint8)
    last = np.append(fresh[1:], True) if len(words) else fresh
    out[ends - 1] = np.where(last, 10, 32)
    texts = out.tobytes().decode("utf8", "replace").split("\n")[:-1]
    texts = [_html.unescape(x) if "&" in x else x for x in texts]
    slots = words[fresh]
    paths, main = [read.paths[k] for k in read.path[slots].tolist()], {}
    for p in set(paths):
        main[p] = _main(p)
    bounds = np.searchsorted(read.page[slots], np.arange(part.num_rows + 1))
    pages = ["\n".join(x for x, p in zip(texts[a:b], paths[a:b], strict=True) if main[p]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    rows = pa.StructArray.from_arrays([pa.array(paths, pa.string()), pa.array(place[slots, 0]), pa.array(place[slots, 1]), pa.array(texts, pa.string())], fields=[*_SLOT])
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), rows), pages


def extract_pages(pages: DataFrame, min_tokens: int = MIN_TOKENS, support: float = SUPPORT, word_support: float = WORD_SUPPORT, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """(page_id, host, template_size, slots, text) for each row of pages; class and gap of a slot are -1 outside of all classes, classes are numbered within a host."""
    found = cut(templates(pages, min_tokens, support, word_support, broadcast_tokens))
    lookup = _lookup(found, ["class", "gap", "total", "h"], broadcast_tokens)
    known = lookup.known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            for part in vectext.chunks(batch, "html"):
                tokens, values = known.of(part)
                hosts, first = np.unique(values[:, 3], return_index=True)
                hit, at = _find(hosts, part.column("h").to_numpy())
                size = np.zeros(part.num_rows, np.int32)
                size[hit] = values[first[at], 2]
                slots, text = extract(reader, part, tokens, values)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("host"), pa.array(size), slots, pa.array(text, pa.string())], names=["page_id", "host", "template_size", "slots", "text"])

    return lookup.joined(_pages(pages).select("page_id", "host", "h", "html")).mapInArrow(run, _OUT)
