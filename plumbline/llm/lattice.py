"""Language-model scoring by subword lattices.

The vocabulary of an existing tokenizer is a unigram model whose scores are log probabilities: the pieces that the tokenizer makes of the corpus are counted over all documents, smoothed by one. Each
word (between white space, with the tokenizer's word sign before it) is a lattice of all its segmentations into pieces; the forward recursion in log space sums them to the word's marginal
probability, and a document's is the product over its words.

A character that no piece holds costs its UTF-8 bytes' pieces. Words have no longest length: a long word is only a longer lattice.

Nulls: a null text is the empty text, of log probability 0 with null bits; a null doc_id stays null; repeated rows are scored each (and counted each).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import vectext
from plumbline.llm.support import normal_text

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SIGN = "▁"
_WHITE = "\t\n\r\f\v"


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word occurs in all documents."""
    word = F.explode(F.split(F.translate(normal_text(), _WHITE, " " * len(_WHITE)), " ")).alias("word")
    return docs.select(word).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def _load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def piece_scores(docs: DataFrame, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Log probability of each piece: its count in the corpus plus one over the sum. Each distinct word of the corpus is segmented once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = _load(vocabulary), None
        for batch in batches:
            for part in vectext.chunks(batch, "word"):
                ids = model.encode(part.column("word").to_pylist(), num_threads=1)
                n = np.repeat(part.column("n").to_numpy(), [len(x) for x in ids])
                own = np.bincount(np.fromiter((i for x in ids for i in x), np.int64, len(n)), weights=n, minlength=model.vocab_size())
                total = own if total is None else total + own
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at].astype(np.int64))], names=["piece", "n"])

    counts = word_counts(docs).mapInArrow(run, "piece int, n bigint").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # at most one row a piece
    n = np.ones(_load(vocabulary).vocab_size())
    for piece, many in counts:
        n[piece] += many
    return np.log(n / n.sum())


class Lattice:
    """Marginal log probabilities of words under piece scores."""

    def __init__(self, pieces: dict[str, float], byte_scores: np.ndarray) -> None:
        text = [p for p in pieces if p]
        codes, first = self._codes(text)
        hashes = vectext.range_hash(codes, first[:-1], first[1:])
        order = np.argsort(hashes)
        self.hashes, self.scores = hashes[order], np.array([pieces[p] for p in text])[order]
        self.longest = int(np.diff(first).max(initial=1))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.hashes & np.uint64((1 << 20) - 1)] = True
        self.bytes = byte_scores

    @classmethod
    def of_model(cls, path: str, scores: np.ndarray) -> Lattice:
        model = _load(path)
        special = {i for i in range(model.vocab_size()) if model.is_control(i) or model.is_unknown(i)}
        byte = {i for i in range(model.vocab_size()) if model.is_byte(i)}
        pieces = {model.id_to_piece(i): float(scores[i]) for i in range(model.vocab_size()) if i not in special | byte}
        least = float(scores.min())
        return cls(pieces, np.array([float(scores[i]) if (i := model.piece_to_id(f"<0x{b:02X}>")) in byte else least for b in range(256)]))

    @staticmethod
    def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)

    def _lookup(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -np.inf)
        at = np.flatnonzero(self.maybe[hashes & np.uint64((1 << 20) - 1)])
        place = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        hit = self.hashes[place] == hashes[at]
        out[at[hit]] = self.scores[place[hit]]
        return out

    def log_prob(self, words: list[str]) -> np.ndarray:
        """The marginal log probability of each word."""
        out = np.zeros(len(words))
        size = np.array([len(w) + 1 for w in words], np.int64)
        order = np.argsort(size, kind="stable")
        begin = 0
        while begin < len(order):
            # a block of words of like lengths with about 300,000 cells; a longer word is a block by itself
            ahead = order[begin : begin + 300_000]
            end = begin + max(1, int(np.searchsorted(size[ahead] * np.arange(1, len(ahead) + 1), 300_000, side="right")))
            block = order[begin:end]
            out[block] = self._forward([SIGN + words[k] for k in block])
            begin = end
        return out

    def _forward(self, words: list[str]) -> np.ndarray:
        codes, first = self._codes(words)
        size = np.diff(first)
        most, n = int(size.max()), len(codes)
        last = np.repeat(first[1:], size)  # where each character's word ends
        place = np.arange(n)
        by_length = []
        for length in range(1, min(self.longest, most) + 1):
            ok = np.flatnonzero(place + length <= last)
            scores = np.full(n, -np.inf)
            scores[ok] = self._lookup(vectext.range_hash(codes, ok, ok + length))
            if length == 1 and len(lost := np.flatnonzero(np.isinf(scores))):
                unique, back = np.unique(codes[lost], return_inverse=True)
                scores[lost] = np.array([self.bytes[list(chr(c).encode("utf-8", "surrogatepass"))].sum() for c in unique])[back]
            by_length.append(scores)
        alpha = np.full((len(words), most + 1), -np.inf)
        alpha[:, 0] = 0.0
        for p in range(1, most + 1):
            live = np.flatnonzero(size >= p)
            parts = np.stack([alpha[live, p - k] + by_length[k - 1][first[live] + p - k] for k in range(1, min(p, len(by_length)) + 1)])
            top = parts.max(axis=0)
            alpha[live, p] = top + np.log(np.exp(parts - top).sum(axis=0))
        return alpha[np.arange(len(words)), size]


def score_likelihood(docs: DataFrame, scores: np.ndarray, vocabulary: str = VOCABULARY, keep: int = 800_000) -> DataFrame:
    """(doc_id, n_words, n_chars, log_prob, bits_per_char) for each row of docs. Words met before in a task are kept up to ``keep``, for speed alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice.of_model(vocabulary, scores)
        known: dict[str, float] = {}
        for batch in batches:
            for part in vectext.chunks(batch, at_most=1 << 22):
                texts = part.column("text")
                chars = pc.utf8_length(texts).to_numpy().astype(float)
                for white in _WHITE:
                    texts = pc.replace_substring(texts, white, " ")
                split = pc.split_pattern(texts, " ")
                places = split.flatten().dictionary_encode()
                unique = places.dictionary.to_pylist()
                new = [w for w in unique if w and w not in known]
                if len(known) + len(new) > keep:
                    known, new = {}, [w for w in unique if w]
                known.update(zip(new, lattice.log_prob(new).tolist(), strict=True))
                values, real = np.array([known[w] if w else 0.0 for w in unique]), np.array([bool(w) for w in unique])
                index, offsets = places.indices.to_numpy(), split.offsets.to_numpy()
                offsets = offsets - offsets[0]
                counted = np.concatenate([[0], np.cumsum(real[index])]) if len(index) else np.zeros(1, int)
                # per document, so that rounding doesn't depend on what stands before it
                log_prob = np.array([values[index[a:b]].sum() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
                n_words = counted[offsets[1:]] - counted[offsets[:-1]]
                bits = [None if not n else -lp / n / np.log(2) for lp, n in zip(log_prob.tolist(), chars.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n_words.astype(np.int64)), pa.array(chars.astype(np.int64)), pa.array(log_prob), pa.array(bits, pa.float64())],
                    names=["doc_id", "n_words", "n_chars", "log_prob", "bits_per_char"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), normal_text().alias("text")).mapInArrow(run, "doc_id bigint, n_words bigint, n_chars bigint, log_prob double, bits_per_char double")


def lm_scores(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """score_likelihood under the piece scores of docs themselves."""
    return score_likelihood(docs, piece_scores(docs, vocabulary), vocabulary)
