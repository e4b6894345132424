"""Encoding with the tokenizers library, chunk by chunk.

A text is cut where a stretch of ASCII blanks begins after a non-blank.  Neither of the two
pre-tokenization patterns used here matches across such a cut, and neither looks behind, so the ids of a
text are the ids of its chunks in order.  Arrow finds the distinct chunks of a stretch of texts, the library sees
each once, and a worker remembers the ids of a bounded number of words.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa

#: A line break, Latin letters, ASCII punctuation without the apostrophe: pre-tokens of their own
#: in either pattern; NFC leaves such letters alone and each has one lower-case letter.
PLAIN = re.compile(r"(\n?)( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

BLANKS = " \t\n\x0b\x0c\r"


def byte_characters() -> list[str]:
    """The character that a byte-level vocabulary spells each byte with: printable Latin-1
    stands for itself, the other bytes follow in order from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def places_of_none(values: list) -> list[int]:
    """Where ``values`` holds None, at the speed of ``list.index``."""
    out, at = [], -1
    try:
        while True:
            at = values.index(None, at + 1)
            out.append(at)
    except ValueError:
        return out


def _after_wide_blank(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each position is a blank outside ASCII (a cut there would part a stretch of blanks)."""
    b1, b2, b3 = (np.where(at >= k, data[np.maximum(at - k, 0)], 0) for k in (1, 2, 3))
    two = (b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
    three = (((b3 == 0xE1) & (b2 == 0x9A) & (b1 == 0x80)) | ((b3 == 0xE2) & (b2 == 0x81) & (b1 == 0x9F)) | ((b3 == 0xE3) & (b2 == 0x80) & (b1 == 0x80))
             | ((b3 == 0xE2) & (b2 == 0x80) & (((b1 >= 0x80) & (b1 <= 0x8A)) | (b1 == 0xA8) | (b1 == 0xA9) | (b1 == 0xAF))))
    return two | three


def cut(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The chunks of all texts, one after the other, and where each text's chunks begin (and the last ends)."""
    start, stop = texts.offset, texts.offset + len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[start:stop + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[low:high]
    edges = offsets - low
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    begins[:1] = False
    wide = np.flatnonzero(begins[1:] & (data[:-1] >= 0x80)) + 1
    begins[wide[_after_wide_blank(data, wide)]] = False
    begins[edges[edges < len(data)]] = True
    at = np.append(np.flatnonzero(begins), len(data)).astype(np.int32)
    chunks = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes()))
    return chunks, np.searchsorted(at, edges)


class Encoder:
    """Texts to token ids.

    ``keep_blanks``: blanks belong to the tokens (byte-level vocabulary); otherwise they are
    dropped and letters are lower-cased.  ``ordinary``: the special tokens' strings are ordinary text.
    ``remembered`` bounds the memory, not the result: a full table starts anew.
    """

    def __init__(self, path: str, keep_blanks: bool, ordinary: bool, remembered: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        self.model = self.tokenizer.model
        self.spelled = dict(enumerate(byte_characters()))
        self.keep_blanks, self.remembered = keep_blanks, remembered
        self.parts: dict[str, bytes] = {"": b""}   # letters or punctuation within plain chunks

    def _whole(self, texts: list[str]) -> list[bytes]:
        """The whole tokenizer: normalizer, pre-tokenizer and model."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _part(self, part: str) -> bytes:
        """The library's model alone, for one pre-token that needs no normalization."""
        got = self.parts.get(part)
        if got is None:
            if len(self.parts) >= self.remembered:
                self.parts = {"": b""}
            spelled = part if part.isalpha() and part.isascii() else part.encode().decode("latin-1").translate(self.spelled)
            got = self.parts[part] = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return got

    def _ids_of(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks."""
        out, rest, plain, part, keep = [], [], PLAIN.fullmatch, self._part, self.keep_blanks
        for i, c in enumerate(chunks):
            m = plain(c if keep else c.lstrip(BLANKS))
            if m is None:
                rest.append(i)
                out.append(b"")
                continue
            line_break, letters, marks = m.groups()
            ids = part(letters if keep else letters.lower())
            if marks:
                ids += part(marks)
            out.append(part(line_break) + ids if line_break else ids)
        for i, ids in zip(rest, self._whole([chunks[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def encode(self, texts: pa.StringArray) -> list[np.ndarray]:
        """The ids of each text (no nulls), unsigned 32-bit little-endian."""
        if not len(texts):
            return []
        chunks, first = cut(texts)
        if not len(chunks):
            return [np.zeros(0, "<u4")] * len(texts)
        coded = chunks.dictionary_encode()
        ids = self._ids_of(coded.dictionary.to_pylist())
        which = coded.indices.to_numpy()
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        start = np.cumsum(length) - length
        each = length[which]
        ends = np.cumsum(each)
        out = flat[np.repeat(start[which] - (ends - each), each) + np.arange(ends[-1])]
        bounds = np.concatenate([[0], ends])[first]
        return [out[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, keep_blanks: bool, ordinary: bool) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = (path, keep_blanks, ordinary)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def slices(texts: list[str], max_chars: int = 4_000_000):
    """``(start, stop)`` of stretches of texts with bounded total length (a longer text is alone)."""
    return stretches(np.fromiter(map(len, texts), np.int64, len(texts)), max_chars)


def stretches(sizes: np.ndarray, most: int):
    """``(start, stop)`` of stretches of bounded total size (a larger item is alone)."""
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def text_stretches(texts: pa.StringArray, most: int = 6_000_000):
    """``(start, stop)`` of stretches of an Arrow string column of bounded total size in bytes."""
    if not len(texts):
        return iter(())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    return stretches(np.diff(offsets), most)
