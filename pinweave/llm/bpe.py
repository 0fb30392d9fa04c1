"""Byte-level BPE through a sentencepiece model serialised from a rank vocabulary."""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from pinweave.llm.rows import map_texts

CACHE_COST = 20_000_000  # a worker forgets what it has encoded when characters, and ENTRY for each entry, reach this
ENTRY = 64
TEXTS = 64  # whose new chunks are encoded in one call
SHIFT = 256  # byte b is written as the character SHIFT + b
TO_CHAR = {b: SHIFT + b for b in range(256)}
NORMAL, UNKNOWN, MODEL_BPE = 1, 2, 2


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | bytes | float) -> bytes:
    """One protobuf field: varint, length-delimited or 32-bit float by the value's type."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def as_pieces(data: bytes) -> str:
    return data.decode("latin-1").translate(TO_CHAR)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model: piece r+1 is token r, scored -r, so merges go by rank; text is taken as it is."""
    piece = lambda text, score, kind: _field(1, _field(1, text.encode()) + _field(2, float(score)) + _field(3, kind))
    pieces = [piece("<unk>", 0, UNKNOWN), *(piece(as_pieces(t), -r, NORMAL) for r, t in enumerate(tokens))]
    trainer = _field(3, MODEL_BPE) + _field(4, len(pieces)) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


def _stands_alone(chunk: str) -> bool:
    """Whether pre-tokens within a chunk depend on nothing outside: one leading blank at most, no white space at either end of the rest."""
    body = chunk[chunk[:1] == " " :]
    return bool(body) and not body[0].isspace() and not body[-1].isspace()


class Codec:
    """Encodes and decodes whole texts. What a chunk between blanks encodes to is remembered within a bound."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.split = tokens, regex.compile(pattern).findall
        self.whole = {t: r for r, t in enumerate(tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(tokens))
        self._forget()

    def _forget(self) -> None:
        self.written, self.read, self.held = {}, {}, 0

    def _ids_of(self, words: set[str]) -> dict[str, list[int]]:
        """Token ids of pre-tokens: a token of the vocabulary is itself, the rest are encoded in one call."""
        out, rest = {}, []
        for w in words:
            rank = self.whole.get(w.encode())
            if rank is None:
                rest.append(w)
            else:
                out[w] = [rank]
        for w, ids in zip(rest, self.model.encode([as_pieces(w.encode()) for w in rest], num_threads=1) if rest else (), strict=True):
            out[w] = [i - 1 for i in ids]
        return out

    def _learn(self, chunks: set[str]) -> None:
        """Encode new chunks; one that does not stand alone is marked with None."""
        parts = {c: self.split(c) if _stands_alone(c) else None for c in chunks}
        ids_of = self._ids_of({w for ws in parts.values() if ws for w in ws})
        for c, ws in parts.items():
            if ws is None:
                self.written[c] = self.read[c] = None
            else:
                ids = ids_of[ws[0]] if len(ws) == 1 else [i for w in ws for i in ids_of[w]]
                self.written[c], self.read[c] = ",".join(map(str, ids)), self.decode(ids)
        self.held += sum(map(len, chunks)) + ENTRY * len(chunks)

    def encode_all(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """For each text its decimal ids joined by commas, and the bytes that they decode to; new chunks of all texts are learned at once."""
        if self.held > CACHE_COST:
            self._forget()
        cut = [t.replace(" ", "\0 ").split("\0") if "\0" not in t else None for t in texts]
        missing = {c for chunks in cut if chunks for c in chunks if c not in self.written}
        if missing:
            self._learn(missing)
        written, read, out = self.written, self.read, []
        for text, chunks in zip(texts, cut, strict=True):
            try:
                out.append((",".join([written[c] for c in chunks]), b"".join([read[c] for c in chunks])))
            except TypeError:  # white space of more than one blank: the whole text is split at once
                words = self.split(text)
                ids_of = self._ids_of(set(words))
                ids = [i for w in words for i in ids_of[w]]
                out.append((",".join(map(str, ids)), self.decode(ids)))
        return out

    def encode_written(self, text: str) -> tuple[str, bytes]:
        return self.encode_all([text])[0]

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in s.split(",")] if (s := self.encode_written(text)[0]) else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


def tokenize(docs: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``ids``, the token
    ids. A null text counts as empty: no tokens and the digests of nothing. Null
    doc_ids, repeated rows and further columns change nothing; an empty table gives
    no rows. The vocabulary (under 1 MB) is the only thing sent to the executors.
    """
    shared = docs.sparkSession.sparkContext.broadcast((load_ranks(path), pattern))

    def make():
        codec = Codec(*shared.value)

        def work(texts):
            both = [x for at in range(0, len(texts), TEXTS) for x in codec.encode_all([t or "" for t in texts[at : at + TEXTS]])]
            out = [[w.count(",") + 1 if w else 0 for w, _ in both], [hashlib.sha256(w.encode()).hexdigest() for w, _ in both], [hashlib.sha256(b).hexdigest() for _, b in both]]
            return [*out, [np.fromstring(w, dtype=np.int32, sep=",") for w, _ in both]] if ids else out

        return work

    fields = [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]
    return map_texts(docs.select("doc_id", "text"), make, [*fields, ("ids", pa.list_(pa.int32()), "array<int>")] if ids else fields)
