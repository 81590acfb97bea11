"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source s has a token budget, its share of the total. If the budget holds k complete copies of the source, every document is repeated k times; the
rest of the budget is drawn without replacement: a document of quality weight w gets the key -ln(u) / w, with u hashed from its id, the
source is sorted by key, and documents are taken as long as the prefix sum of their tokens stays within the rest.

Only narrow rows (source, tokens, key, id) are sorted, and not whole sources in single tasks: keys fall into ``BUCKETS`` ordered buckets,
the buckets' token sums are prefix-summed, and only in the one bucket per source where the budget ends are rows ordered. What comes out is a cut-off (bucket, key, id) for each
source, so that documents are chosen row by row where they are.

Nulls: a null source is a source of its own; a null text is the empty text, has no tokens and the least weight; a null doc_id takes the text's hash in its place. Ties: rows equal in key and id (repeated
rows) are drawn together or not at all. A source without tokens, or without a weight among explicit targets, gives no rows. Repeated rows count one by one. A text of any length is counted whole. An empty table gives no rows.
Other columns may have any names; ``mix`` returns them as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.support import cut, free_name, normal_text

SEED, BUCKETS, MAX_BROADCAST_SOURCES = 7, 1024, 10_000


def token_count(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\r]+"))


def quality_weight(text: Column) -> Column:
    """Fourth power of the share of letters among what isn't white space; 0.0001 at least."""
    letters, ink = F.length(F.regexp_replace(text, r"[^\p{L}]+", "")), F.length(F.translate(text, " \t\n\r", ""))
    share = F.when(ink > 0, letters.cast("double") / ink).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0001), (share * share) * (share * share))


def _with_keys(docs: DataFrame, seed: int, names: tuple[str, str, str, str, str]) -> DataFrame:
    """docs with source key, id key, tokens, key and bucket under these names."""
    src, ident, tokens, key, bucket = names
    text = normal_text()
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(ident))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return (
        docs.withColumn(src, F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")))
        .withColumn(ident, F.coalesce(F.col("doc_id").cast("string"), F.md5(text)))
        .withColumn(tokens, token_count(text).cast("bigint"))
        .withColumn(key, -F.ln(u) / quality_weight(text))
        .withColumn(bucket, F.least(F.lit(BUCKETS - 1), F.floor(F.lit(float(BUCKETS)) * (F.lit(1.0) - F.exp(-F.col(key))))).cast("int"))
    )


_NAMES = ("__src", "__ident", "__tokens", "__key", "__bucket")
_CUTOFF = ("epochs", "rest", "end", "before", "last")


def plan(docs: DataFrame, targets: dict[str | None, float] | None = None, total_tokens: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The narrow rows of docs, and for each source its copies and cut-off.

    targets: shares by source; by default a source of n tokens weighs n**0.75. total_tokens: by default the least total by which no source is
    cut below one complete epoch.
    """
    rows = cut(_with_keys(docs.select("doc_id", "source", "text"), seed, _NAMES).select("doc_id", "source", *_NAMES))
    sums = rows.groupBy("__src", "__bucket").agg(F.sum("__tokens").alias("t"))
    sums = cut(sums)  # at most BUCKETS rows a source
    size = sums.groupBy("__src").agg(F.sum("t").alias("n"))
    if targets is None:
        size = size.withColumn("raw", F.sqrt(F.col("n").cast("double")) * F.sqrt(F.sqrt(F.col("n").cast("double"))))
    else:
        given = [("" if k is None else f"s{k}", float(v)) for k, v in targets.items()]
        size = size.join(docs.sparkSession.createDataFrame(given, "__src string, raw double"), "__src")
    whole = size.agg(F.sum("raw").alias("total_raw"), F.lit(0).alias("_"))
    size = size.crossJoin(whole.drop("_")).withColumn("w", F.col("raw") / F.col("total_raw")).where("n > 0 and w > 0")
    if total_tokens is None:
        size = size.crossJoin(size.agg(F.max(F.col("n") / F.col("w")).alias("total")))
    else:
        size = size.withColumn("total", F.lit(float(total_tokens)))
    budget = F.floor(F.col("total") * F.col("w") + F.lit(0.001))
    size = size.withColumn("epochs", F.floor(budget / F.col("n")).cast("bigint")).withColumn("rest", budget - F.col("epochs") * F.col("n")).select("__src", "epochs", "rest")
    ends = (
        sums.withColumn("before", F.sum("t").over(Window.partitionBy("__src").orderBy("__bucket")) - F.col("t"))
        .join(size, "__src")
        .where("before + t > rest and before <= rest")
        .groupBy("__src").agg(F.min("__bucket").alias("end"), F.min_by("before", "__bucket").alias("before"))
    )
    size = cut(size.join(ends, "__src", "left"))
    size_b = F.broadcast(size) if size.count() <= MAX_BROADCAST_SOURCES else size
    inside = (
        rows.join(size_b, "__src").where("__bucket = end")
        .withColumn("sum", F.col("before") + F.sum("__tokens").over(Window.partitionBy("__src").orderBy("__key", "__ident")))
        .where("sum <= rest")
        .groupBy("__src").agg(F.max(F.struct("__key", "__ident")).alias("last"))
    )
    return rows, cut(size.join(inside, "__src", "left"))


def _repeats() -> Column:
    drawn = (F.col("__bucket") < F.col("end")) | ((F.col("__bucket") == F.col("end")) & (F.struct("__key", "__ident") <= F.col("last")))
    return F.coalesce(drawn, F.lit(False))


def _joined(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(cutoffs) if cutoffs.count() <= MAX_BROADCAST_SOURCES else cutoffs, "__src")


def mixture(docs: DataFrame, targets: dict[str | None, float] | None = None, total_tokens: int | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, source, n_tokens, epochs, drawn, repeats) for each row of docs that the mixture holds: repeats = epochs + drawn."""
    rows, cutoffs = plan(docs, targets, total_tokens, seed)
    out = _joined(rows, cutoffs).withColumn("drawn", _repeats().cast("int"))
    return out.select("doc_id", "source", F.col("__tokens").alias("n_tokens"), "epochs", "drawn", (F.col("epochs") + F.col("drawn")).alias("repeats")).where("repeats > 0")


def mix(docs: DataFrame, targets: dict[str | None, float] | None = None, total_tokens: int | None = None, seed: int = SEED) -> DataFrame:
    """docs, each row as many times as the mixture holds it; columns as they were. Texts aren't shuffled."""
    _, cutoffs = plan(docs, targets, total_tokens, seed)
    src, ident, _, key, bucket = names = tuple(free_name(docs, n.strip("_")) for n in _NAMES)
    epochs, _, end, _, last = cutoff = tuple(free_name(docs, f"cut_{n}") for n in _CUTOFF)
    copy = free_name(docs, "copy")
    cutoffs = cutoffs.withColumnsRenamed({"__src": src, **dict(zip(_CUTOFF, cutoff, strict=True))})
    out = _with_keys(docs, seed, names).join(F.broadcast(cutoffs) if cutoffs.count() <= MAX_BROADCAST_SOURCES else cutoffs, src)
    drawn = (F.col(bucket) < F.col(end)) | ((F.col(bucket) == F.col(end)) & ((F.col(key) < F.col(last)["__key"]) | ((F.col(key) == F.col(last)["__key"]) & (F.col(ident) <= F.col(last)["__ident"]))))
    times = F.col(epochs).cast("int") + F.coalesce(drawn, F.lit(False)).cast("int")
    return out.withColumn(copy, F.explode(F.array_repeat(F.lit(0), times))).select(*[f"`{c.replace('`', '``')}`" for c in docs.columns])


SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS ident, coalesce(text, '') AS text FROM documents),
f AS (SELECT doc_id, source, ident, len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda w: w <> ''))::BIGINT AS n_tokens,
             length(regexp_replace(text, '[^\\p{{L}}]+', '', 'g'))::DOUBLE AS letters, length(regexp_replace(text, '[ \\t\\n\\r]+', '', 'g')) AS ink FROM d),
p AS (SELECT *, CASE WHEN ink > 0 THEN letters / ink ELSE 0 END AS p FROM f),
k AS (SELECT doc_id, source, ident, n_tokens,
             -ln((CAST('0x' || substr(md5('{SEED}:' || ident), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) / greatest(0.0001, (p * p) * (p * p)) AS key FROM p),
n AS (SELECT source, sum(n_tokens)::DOUBLE AS n, sqrt(sum(n_tokens)::DOUBLE) * sqrt(sqrt(sum(n_tokens)::DOUBLE)) AS raw FROM k GROUP BY source),
w AS (SELECT source, n, raw / sum(raw) OVER () AS w FROM n),
b AS (SELECT source, n, floor(max(n / w) OVER () * w + 0.001) AS budget FROM w WHERE n > 0),
e AS (SELECT source, floor(budget / n)::BIGINT AS epochs, budget - floor(budget / n) * n AS rest FROM b),
s AS (SELECT k.doc_id, k.source, k.n_tokens, e.epochs, CAST(sum(k.n_tokens) OVER (PARTITION BY k.source ORDER BY k.key, k.ident) <= e.rest AS INTEGER) AS drawn
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, n_tokens, epochs, drawn, epochs + drawn AS repeats FROM s WHERE epochs + drawn > 0
"""
