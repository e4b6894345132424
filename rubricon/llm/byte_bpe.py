"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A byte-level vocabulary spells every byte as one printable character; ``byte_alphabet`` is that table.
Decoding reverses it: a token string gives back its bytes, whatever their place in a character, so
a character split over several tokens is whole again once the bytes are joined.  Offsets
of tokens are byte positions (cumulated token bytes) and character positions (characters
that begin before the byte position), both from the same bytes.

Defined results: null text is the empty text (no ids); special tokens' strings are ordinary text;
repeated rows give repeated results; an empty table gives an empty one; unknown ids raise.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rubricon.llm.chunks import byte_characters, encoder, text_stretches
from rubricon.llm.common import id_and_text


def byte_alphabet() -> dict[str, int]:
    """The reversed byte table: character to byte."""
    return {c: b for b, c in enumerate(byte_characters())}


class Decoder:
    """Ids back to bytes by the reversed byte table."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        table = byte_alphabet()
        vocab = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
        self.token = [None] * (max(vocab.values()) + 1)
        for string, i in vocab.items():
            self.token[i] = bytes(table[c] for c in string) if all(c in table for c in string) else string.encode()
        self.length = np.array([len(t) if t is not None else 0 for t in self.token], np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        token = self.token
        return b"".join([token[i] for i in ids.tolist()])

    def byte_offsets(self, ids: np.ndarray) -> np.ndarray:
        """Start of each token in the text's UTF-8, and the end of the last."""
        return np.concatenate([[0], np.cumsum(self.length[ids])])


def char_offsets(data: bytes, byte_offsets: np.ndarray) -> np.ndarray:
    """For each byte position, how many characters begin before it."""
    begins = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    return np.concatenate([[0], np.cumsum(begins)])[byte_offsets]


_DECODERS: dict[str, Decoder] = {}


def decoder(path: str) -> Decoder:
    if path not in _DECODERS:
        _DECODERS[path] = Decoder(path)
    return _DECODERS[path]


def _per_document(docs: DataFrame, path: str, make, schema: str) -> DataFrame:
    """``make(encoder, decoder, ids, texts)`` gives the columns after doc_id for a stretch of texts."""
    def run(batches):
        enc, dec = encoder(path, True, True), decoder(path)
        for b in batches:
            texts = b.column(1)
            for i, j in text_stretches(texts):
                ids = enc.encode(texts.slice(i, j - i))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *make(dec, ids)],
                                                 names=["doc_id", *[c.split()[0] for c in schema.split(", ")[1:]]])

    return id_and_text(docs).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids, byte_starts, char_starts)``: the ids and where each token begins."""
    def make(dec, ids):
        starts = [dec.byte_offsets(x) for x in ids]
        chars = [char_offsets(dec.decode(x), s) for x, s in zip(ids, starts, strict=True)]
        ints = lambda rows: pa.array([r.tolist() for r in rows], pa.list_(pa.int32()))
        return [ints(ids), ints([s[:-1] for s in starts]), ints([c[:-1] for c in chars])]

    return _per_document(docs, path, make, "doc_id long, ids array<int>, byte_starts array<int>, char_starts array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, data)``: the bytes of each row's ``ids`` (null ids: no bytes)."""
    def run(batches):
        dec = decoder(path)
        for b in batches:
            data = [dec.decode(np.array(x or [], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every text, encoded and decoded again."""
    def make(dec, ids):
        sha = lambda data: hashlib.sha256(data).hexdigest()
        return [pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(x.tobytes()) for x in ids]),
                pa.array([sha(dec.decode(x)) for x in ids])]

    return _per_document(docs, path, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
