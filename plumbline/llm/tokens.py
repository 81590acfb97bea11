"""Token ids in fixed-width bit packing.

Every id is stored in the least number of bits that hold the vocabulary's greatest id, most significant bit first. Ids come in blocks of ``BLOCK``; each block begins at a
whole byte, and its offset is stored, so that any id is found without unpacking what precedes it and numpy unpacks whole blocks at once.

A text is split at spaces and each distinct word of a batch is encoded once; texts in which a word isn't encoded by itself (longer runs of spaces, the tokenizer's own space sign)
are encoded whole. The ids are those of the tokenizer for the whole text, whatever its length.

Nulls: a null text is the empty text, with no ids and no bytes; a null doc_id stays null; repeated rows are packed each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import vectext
from plumbline.llm.support import normal_text, releasing, small_batches

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK = 1024
SCHEMA = "doc_id bigint, n_tokens bigint, bit_width int, block_size int, block_offsets array<bigint>, packed binary"


def bit_width(vocabulary: int) -> int:
    """The least number of bits for ids under ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """The packed ids, and the byte offset of each block with the end appended."""
    ids = np.asarray(ids, dtype=np.uint32)
    blocks = -(-len(ids) // block)
    offsets = (np.arange(blocks + 1) * (-(-block * width // 8))).astype(np.int64)
    if blocks:
        offsets[-1] = offsets[-2] + -(-(len(ids) - (blocks - 1) * block) * width // 8)
    out = []
    whole = len(ids) // block * block
    for part in (ids[:whole].reshape(-1, block), ids[None, whole:]):
        if part.size:
            high = part.astype(">u4").view(np.uint8).reshape(len(part), -1, 4)
            bits = np.unpackbits(high, axis=2)[:, :, 32 - width :]
            out.append(np.packbits(bits.reshape(len(part), -1), axis=1).tobytes())
    return b"".join(out), offsets


def unpack(packed: bytes, n: int, width: int, block: int = BLOCK) -> np.ndarray:
    """All n ids."""
    step, whole = -(-block * width // 8), n // block
    raw = np.frombuffer(packed, np.uint8)
    parts = []
    for rows, each in ((raw[: whole * step].reshape(-1, step), block), (raw[None, whole * step :], n - whole * block)):
        if each and rows.size:
            bits = np.unpackbits(rows, axis=1)[:, : each * width].reshape(len(rows), each, width)
            wide = np.zeros((len(rows), each, 32), np.uint8)
            wide[:, :, 32 - width :] = bits
            parts.append(np.packbits(wide, axis=2).view(">u4").ravel().astype(np.uint32))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def read_range(packed: bytes, offsets: np.ndarray, n: int, width: int, start: int, stop: int, block: int = BLOCK) -> np.ndarray:
    """ids[start:stop], reading only the blocks that hold them."""
    start, stop = max(0, start), min(n, stop)
    if start >= stop:
        return np.zeros(0, np.uint32)
    a, b = start // block, (stop - 1) // block + 1
    part = unpack(packed[offsets[a] : offsets[b]], min(n, b * block) - a * block, width, block)
    return part[start - a * block : stop - a * block]


class Encoder:
    """Whole-text ids of a sentencepiece model, by distinct words; words met before are kept up to a bound."""

    def __init__(self, path: str, keep: int = 100_000) -> None:
        import sentencepiece

        self.model, self.keep, self.known = sentencepiece.SentencePieceProcessor(model_file=path), keep, {}
        self.width = bit_width(self.model.vocab_size())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin with the end appended."""
        texts = texts.cast(pa.large_string())
        alone = pc.match_substring_regex(texts, r"   |  $|^  |\x{2581}|\x{00}").to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.if_else(pa.array(alone), "", texts), " ")
        places = split.flatten().dictionary_encode()
        unique = places.dictionary.to_pylist()
        new = [w for w in unique if w not in self.known]
        if len(self.known) + len(new) > self.keep:
            self.known, new = {}, unique
        for w, ids in zip(new, self.model.encode(new, num_threads=1), strict=True):
            # between spaces an empty word is the space sign alone
            self.known[w] = np.array(ids if w else [self.model.piece_to_id("▁")], np.uint32).tobytes()
        parts = [self.known[w] for w in unique]
        sizes = np.array([len(p) // 4 for p in parts], np.int64)
        flat = np.frombuffer(b"".join(parts), np.uint32)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        index = places.indices.to_numpy()
        each = sizes[index]
        ends = np.cumsum(each)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[index] - (ends - each), each)]
        offsets = split.offsets.to_numpy()
        first = np.concatenate([[0], ends])[offsets - offsets[0]]
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        if alone.any() or empty.any():
            lists = [ids[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
            for k in np.flatnonzero(empty):
                lists[k] = np.zeros(0, np.uint32)
            for k in np.flatnonzero(alone):
                lists[k] = np.array(self.model.encode(texts[int(k)].as_py(), num_threads=1), np.uint32)
            ids, first = np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        return ids, first


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens, bit_width, block_size, block_offsets, packed) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            for part in vectext.chunks(batch):
                ids, first = encoder.encode(part.column("text"))
                packed, offsets = zip(*(pack(ids[a:b], encoder.width, block) for a, b in zip(first[:-1], first[1:], strict=True)), strict=True)
                k = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array([encoder.width] * k, pa.int32()), pa.array([block] * k, pa.int32()), pa.array(offsets, pa.list_(pa.int64())), pa.array(packed, pa.binary())],
                    names=["doc_id", "n_tokens", "bit_width", "block_size", "block_offsets", "packed"],
                )

    return small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), normal_text().alias("text")).mapInArrow(releasing(run), SCHEMA)
