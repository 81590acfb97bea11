"""Characteristic terms of topics: TF-IDF over topics, and corpus-wide scores with lift."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import require
from plumbline.operators.graph import checkpointed

TOKEN_TYPE = "array<struct<pos: int, token: string, lemma: string, upos: string>>"
Tagger = Callable[[Column], Column]


def regex_tagger(text: Column) -> Column:
    """The offline default: every run of letters and digits is a token, its own lemma, and a NOUN, so filters by word class keep all."""
    words = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w, i: F.struct((i + 1).cast("int").alias("pos"), w.alias("token"), F.lower(w).alias("lemma"), F.lit("NOUN").alias("upos")))


def model_tagger(load: Callable[[], Callable[[list[str]], list[list[dict]]]]) -> Tagger:
    """A tagger from a model: ``load`` runs once a task and returns a function from texts to lists of {pos, token, lemma, upos}."""

    @F.pandas_udf(TOKEN_TYPE)
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(model(batch.fillna("").tolist()))

    return lambda text: tag(text)


#: Tokens that are counted at once in a task.
TOKENS = 2_000_000


def _count(key: pa.Array, name: pa.Array, words: pa.Array, least: int, most: int, sep: str, mark: bool) -> Iterator[pa.RecordBatch]:
    """Rows (key, term, tf, docs) of some documents: numbers stand for words and n-grams until each is counted. name tells keys apart."""
    named = name.dictionary_encode(null_encoding="encode").indices.to_numpy()
    _, first, group = np.unique(named, return_index=True, return_inverse=True)
    keys = key.take(pa.array(first))
    size = pc.fill_null(words.value_lengths(), 0).to_numpy()
    doc = np.repeat(np.arange(len(size)), size)
    coded = words.flatten().dictionary_encode()
    word, texts = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    term, terms = word, texts

    def batch(which: np.ndarray, term: pa.Array, tf: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys.take(pa.array(which)), term.cast(pa.string()), pa.array(tf.astype(np.int64)), pa.array(docs.astype(np.int64))], ["key", "term", "tf", "docs"])

    if mark and len(doc):
        with_words = np.bincount(group[size > 0], minlength=len(keys))
        which = np.flatnonzero(with_words)
        yield batch(which, pa.array([""] * len(which), pa.string()), with_words[which], with_words[which])
    for n in range(1, most + 1):
        if n > 1:
            # a term of n words is one of n - 1 and the word after it in the same document
            whole = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]) if len(doc) >= n else np.zeros(0, int)
            before = np.full(len(doc), -1)
            before[starts] = term
            known, term = np.unique(before[whole] * len(texts) + word[whole + n - 1], return_inverse=True)
            terms = pc.binary_join_element_wise(terms.cast(pa.string()).take(pa.array(known // len(texts))), texts.cast(pa.string()).take(pa.array(known % len(texts))), sep)
            starts = whole
        else:
            starts = np.arange(len(doc))
        if n >= max(1, least) and len(term):
            in_doc, tf = np.unique(doc[starts] * len(terms) + term, return_counts=True)
            pair, at = np.unique(group[in_doc // len(terms)] * len(terms) + in_doc % len(terms), return_inverse=True)
            yield batch(pair // len(terms), terms.take(pa.array(pair % len(terms))), np.bincount(at, tf), np.bincount(at))


def term_counts(rows: DataFrame, key: str, words: str, least: int, most: int, sep: str = " ", mark: bool = False) -> DataFrame:
    """(key, term, tf, docs): how often each run of least..most neighbouring words occurs in the rows of a key, and in how many rows. With mark the term "" counts the rows that have words.

    Runs are counted in Arrow batches before any is shuffled, and terms are distributed by term alone, so that windows over terms need no other shuffle.
    """
    kind = rows.select(key).schema[0].dataType.simpleString()
    # JSON tells texts apart, the plain string all other values
    told = F.concat(F.coalesce(F.to_json(F.struct(key)), F.lit("")), F.lit("\n"), F.coalesce(F.col(key).cast("string"), F.lit("")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens = [], 0
        for b in batches:
            at = 0
            size = pc.fill_null(b.column("words").value_lengths(), 0).to_numpy().cumsum()
            while at < len(size):  # as many rows as make up the tokens, one at least
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + TOKENS - tokens)))
                held.append(b.slice(at, end - at))
                tokens += int(size[min(end, len(size)) - 1] - (size[at - 1] if at else 0))
                at = end
                if tokens >= TOKENS or at < len(size):
                    t = pa.Table.from_batches(held).combine_chunks()
                    yield from _count(*(pa.concat_arrays(t.column(c).chunks) for c in ("key", "name", "words")), least, most, sep, mark)
                    held, tokens = [], 0
        if held:
            t = pa.Table.from_batches(held)
            yield from _count(*(pa.concat_arrays(t.column(c).chunks) for c in ("key", "name", "words")), least, most, sep, mark)

    counted = rows.select(F.col(key).alias("key"), told.alias("name"), F.col(words).alias("words")).mapInArrow(count, f"key {kind}, term string, tf bigint, docs bigint")
    return counted.repartition("term").groupBy("term", "key").agg(F.sum("tf").alias("tf"), F.sum("docs").alias("docs")).select(F.col("key").alias(key), "term", "tf", "docs")


def topic_tfidf(
    data: DataFrame, doc_col: str = "doc_id", topic_col: str = "cluster", text_col: str = "text", pos_keep: list[str] = ["NOUN", "PROPN"], min_char: int = 3, min_term_freq: int = 2,
    top_n: int = 10, stopwords: list[str] | None = None, use_tfidf: bool = True, exclude_topics: list[str] | None = None, min_ngram: int = 1, max_ngram: int = 1, ngram_sep: str = " ", tagger: Tagger = regex_tagger,
) -> DataFrame:
    """(topic, term, n, n_topics_with_term, idf, tfidf, rank): the top_n terms of each topic.

    Lemmas of the kept word classes, at least min_char long and not numeric, make the n-grams. A stopword removes the term that equals it, not n-grams around it. idf counts topics after stopwords and before
    min_term_freq. A topic in which no term is frequent enough keeps all its terms. Ties are broken by n, then term. Topics are strings.
    """
    require(data.columns, doc_col, topic_col, text_col)
    topic = F.col(topic_col).cast("string")
    docs = data.select(topic.alias("topic"), F.col(text_col).alias("text")).where("text is not null and text <> ''")
    if exclude_topics:
        docs = docs.where(~F.coalesce(F.col("topic").isin([str(t) for t in exclude_topics]), F.lit(False)))
    kept = F.filter(tagger(F.col("text")), lambda t: t["upos"].isin(pos_keep) & (F.char_length(t["lemma"]) >= min_char) & ~F.lower(t["lemma"]).rlike(r"^\p{N}+$"))
    lemmas = F.transform(kept, lambda t: F.lower(t["lemma"]))
    counts = term_counts(docs.select("topic", lemmas.alias("words")), "topic", "words", min_ngram, max_ngram, ngram_sep).select("topic", "term", F.col("tf").alias("n"))
    if stopwords:
        counts = counts.where(~F.col("term").isin([s.lower() for s in stopwords]))
    # written once: what is known of a topic, a row each, is derived from it
    counts = checkpointed(counts.withColumn("n_topics_with_term", F.count("*").over(Window.partitionBy("term"))))
    enough = F.col("n") >= min_term_freq
    topics = counts.groupBy(F.col("topic").alias("__topic")).agg(F.max(enough).alias("any_enough"))
    if use_tfidf:
        n_topics = topics.agg(F.count("__topic").alias("T"))
        counts = counts.crossJoin(F.broadcast(n_topics)).withColumn("idf", F.ln((F.lit(1.0) + F.col("T")) / (F.lit(1.0) + F.col("n_topics_with_term"))) + 1)
        counts = counts.withColumn("tfidf", F.col("n") * F.col("idf"))
    else:
        counts = counts.withColumn("idf", F.lit(None).cast("double")).withColumn("tfidf", F.col("n").cast("double"))
    # with nothing between rank and its limit each task keeps its own first top_n before the shuffle by topic
    ranked = (
        counts.join(F.broadcast(topics), F.col("topic").eqNullSafe(F.col("__topic"))).where(enough | ~F.col("any_enough"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("tfidf"), F.desc("n"), "term"))).where(F.col("rank") <= top_n)
    )
    return ranked.select("topic", "term", "n", "n_topics_with_term", "idf", "tfidf", "rank").orderBy("topic", "rank")


def topic_terms(
    data: DataFrame, doc_col: str = "doc_id", topic_col: str = "topic", text_col: str = "text", use_lemma: bool = True, max_ngram: int = 3, min_term_freq: int = 5,
    allowed_upos: list[str] = ["NOUN", "PROPN", "ADJ"], tagger: Tagger = regex_tagger,
) -> DataFrame:
    """14 columns for each topic and term: counts, tf_norm, tf_idf, c_tf_idf, p_topic_term, p_corpus_term and lift.

    N-grams run over the kept tokens of a document, across what was left out. A document of several topics counts in each. Documents without tokens still count among a topic's documents, and documents
    emptied by min_term_freq among all documents.
    """
    require(data.columns, doc_col, topic_col, text_col)
    rows = data.select(F.col(doc_col).alias("doc"), F.col(topic_col).alias("topic"), F.col(text_col).alias("text"))
    pairs = rows.select("doc", "topic").distinct()
    texts = rows.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_set("text")), "\n").alias("text"), F.array_sort(F.collect_set(F.struct("topic"))).alias("topics"))
    kept = F.filter(tagger(F.coalesce("text", F.lit(""))), lambda t: t["upos"].isin(allowed_upos))
    words = F.transform(F.array_sort(kept), lambda t: F.lower(t["lemma" if use_lemma else "token"]))
    # punctuation and numbers go when the joined text is tokenized again
    clean = F.filter(F.split(F.array_join(words, " "), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.rlike(r"^\p{N}+$"))
    # every document with terms has the term "" once, which counts documents and topics; texts are tokenized once, all that follows is derived from this table of terms and sets of topics
    counted = checkpointed(term_counts(texts.select("topics", clean.alias("clean")), "topics", "clean", 1, max_ngram, "_", mark=True))
    by_term = counted.groupBy("term").agg(F.sum("docs").alias("df_corpus"), F.sum("tf").alias("tf_corpus")).where(F.col("tf_corpus") >= min_term_freq)
    marks, by_term = counted.where("term = ''"), by_term.where("term <> ''")
    by_topic = counted.where("term <> ''").select("term", "tf", F.explode("topics").alias("topic")).groupBy("topic.topic", "term").agg(F.sum("tf").alias("tf"))
    scalars = marks.agg(F.sum("docs").alias("N_docs")).crossJoin(marks.select(F.explode("topics").alias("topic")).agg(F.count_distinct("topic.topic").alias("N_topics"))).crossJoin(by_term.agg(F.sum("tf_corpus").alias("tokens")))
    found = checkpointed(by_topic.join(by_term, "term").withColumn("n_topics_with_term", F.count("*").over(Window.partitionBy("term"))))
    # a row a topic: a window over topics would put each into one task
    topics = found.groupBy("topic").agg(F.sum("tf").alias("total_tf_topic")).join(pairs.groupBy("topic").agg(F.count("*").alias("n_docs_in_topic")), "topic")
    out = found.join(F.broadcast(topics), "topic").crossJoin(F.broadcast(scalars))
    eps = 1e-9
    p_topic, p_corpus = F.col("tf") / (F.col("total_tf_topic") + eps), F.col("tf_corpus") / (F.col("tokens") + eps)
    return out.select(
        "topic", F.replace("term", F.lit("_"), F.lit(" ")).alias("term"), "tf", "total_tf_topic", "df_corpus", "tf_corpus", "n_topics_with_term", "n_docs_in_topic",
        p_topic.alias("tf_norm"),
        (F.col("tf") * F.ln(F.col("N_docs") / (1.0 + F.col("df_corpus")))).alias("tf_idf"),
        (F.col("tf") / (F.col("n_docs_in_topic") + eps) * F.ln(F.col("N_topics") / (1.0 + F.col("n_topics_with_term")))).alias("c_tf_idf"),
        p_topic.alias("p_topic_term"), p_corpus.alias("p_corpus_term"), (p_topic / (p_corpus + eps)).alias("lift"),
    ).orderBy("topic", F.desc("c_tf_idf"), "term")


def ctfidf_words(terms: DataFrame) -> DataFrame:
    """topic_terms as (topic, word, score) for the plots."""
    return terms.select("topic", F.col("term").alias("word"), F.col("c_tf_idf").alias("score"))
