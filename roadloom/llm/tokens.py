"""Encoding of texts by a public byte-level BPE vocabulary, with a sentencepiece model made from the vocabulary.

The model is written as it stands, not trained: every token of the vocabulary is a piece whose characters stand for its
bytes and whose score is its negative rank, and normalisation is the identity. As sentencepiece merges the neighbours
whose piece scores highest, it makes the merges of the vocabulary in their order. Texts are cut into pre-tokens first,
which merges never cross.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokens of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space other than newlines beside a newline, or newlines of other kinds: such texts are encoded as one line.
MIXED_SPACE = re.compile(r"^\s|[^\S\n]\n|\n[^\S\n]|[^\S\n]$").search
NEWLINES = re.compile(r"(\n+)").split
CUE_TIME = re.compile(r"\d\d:\d\d:\d\d[,.]\d\d\d --> \d\d:\d\d:\d\d[,.]\d\d\d", re.ASCII).fullmatch
#: Lines and pre-tokens whose ids a task remembers.
LINES, WORDS = 100_000, 200_000


@lru_cache(maxsize=1)
def byte_signs() -> str:
    """256 characters, one for each byte: printable Latin-1 as itself, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in plain else chr(next(spare)) for b in range(256))


def ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float | bool) -> bytes:
    """A protocol-buffer field: bytes by length, float as four bytes, whole numbers as varint."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    return _varint(number << 3) + _varint(int(value))


def model(path: str = VOCABULARY) -> bytes:
    """A serialised sentencepiece BPE model of the vocabulary; piece k is token k, the unknown piece comes after all."""
    signs = byte_signs()
    pieces = sorted(ranks(path).items(), key=lambda p: p[1])
    if [r for _, r in pieces] != list(range(len(pieces))):
        raise ValueError(f"{path}: the ranks must be 0, 1, 2, ...")
    out = [_field(1, _field(1, "".join(signs[b] for b in token).encode()) + _field(2, -float(rank))) for token, rank in pieces]
    unknown = len(pieces)
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, unknown + 1) + _field(40, unknown) + _field(41, 2**64 - 1) + _field(42, 2**64 - 1) + _field(43, 2**64 - 1)
    normal = _field(1, b"identity") + _field(2, b"") + _field(3, False) + _field(4, False) + _field(5, False)
    return b"".join([*out, _field(2, trainer), _field(3, normal)])


class Encoder:
    """encode(text) -> array('i') of ids, decode(ids) -> text. Null and empty texts have no ids."""

    def __init__(self, vocabulary: str | bytes = VOCABULARY) -> None:
        import regex
        import sentencepiece

        self._sp = sentencepiece.SentencePieceProcessor(model_proto=vocabulary if isinstance(vocabulary, bytes) else model(vocabulary))
        self._pre = regex.compile(PATTERN).findall
        self._signs = dict(enumerate(byte_signs()))
        self._bytes = {s: b for b, s in self._signs.items()}
        self._words: dict[str, list[int]] = {}
        self._lines: dict[str, array] = {}

    def _by_words(self, text: str) -> array:
        """Ids of a text by its pre-tokens, each of which is encoded once."""
        found, known = self._pre(text), self._words
        fresh = {w for w in found if w not in known}
        if fresh:
            if len(known) > WORDS:
                known.clear()
                fresh = set(found)
            for w in fresh:  # one call for a list would start a pool of threads each time
                known[w] = self._sp.encode(w.encode().decode("latin-1").translate(self._signs))
        return array("i", [i for w in found for i in known[w]])

    def _kept(self, part: str) -> array:
        got = self._lines.get(part)
        if got is None:
            got = self._by_words(part)
            if len(part) < 300:
                if len(self._lines) >= LINES:
                    self._lines.clear()
                self._lines[part] = got
        return got

    def extend(self, out: array, text: str | None) -> None:
        """Appends the ids of a text to out.

        Where white space has the form of newlines only, lines can be encoded by themselves and remembered: of newlines
        that a non-space follows, all but the last are one pre-token and the last another, at the end of a text they
        are one. Cue times are put together from their parts, as digits, punctuation and ' -->' part pre-tokens.
        """
        if not text:
            return
        if MIXED_SPACE(text):
            out.extend(self._by_words(text))
            return
        kept, get, parts = self._kept, self._lines.get, NEWLINES(text)
        last = len(parts) - 1
        for k, part in enumerate(parts):
            if not part:
                continue
            if k % 2 and k + 1 < last + (parts[last] != ""):
                if len(part) > 1:
                    out.extend(kept(part[:-1]))
                out.extend(kept("\n"))
            elif len(part) == 29 and CUE_TIME(part):
                for piece in (part[:8], part[8:12], part[12:25], part[25:]):
                    out.extend(get(piece) or kept(piece))
            else:
                out.extend(get(part) or kept(part))

    def encode(self, text: str | None) -> array:
        out = array("i")
        self.extend(out, text)
        return out

    def decode(self, ids: list[int] | np.ndarray) -> str:
        signs = "".join(self._sp.id_to_piece(int(i)) for i in ids)
        return bytes(self._bytes[s] for s in signs).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def encoder(vocabulary: str | bytes = VOCABULARY) -> Encoder:
    """One encoder a Python worker, of a vocabulary's path or of its serialised model."""
    return Encoder(vocabulary)


def encoded(docs: DataFrame, text: str = "text", path: str = VOCABULARY, ids: str = "ids") -> DataFrame:
    """docs without `text`, with `ids` (array of int): the empty list for an empty and for a null text.

    One pass without a shuffle; a text is encoded whole, however long. Strings that look like special tokens are
    ordinary text. Other columns pass through; a column already named `ids` is replaced. The driver reads the vocabulary
    and sends its model (a megabyte or two) with the job: executors need no file.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model(path))
    slim = docs.select(*[c for c in docs.columns if c not in (text, ids)], F.col(text).alias("__text"))
    schema = slim.drop("__text").withColumn(ids, F.lit(None).cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for b in batches:
            for s in range(0, b.num_rows, 500):
                part = b.slice(s, 500)
                flat, offsets = array("i"), [0]
                for text in part.column("__text").to_pylist():
                    own.extend(flat, text)
                    offsets.append(len(flat))
                rest = part.select([c for c in part.schema.names if c != "__text"])
                values = pa.array(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32))
                yield rest.append_column(ids, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values))

    return slim.mapInArrow(run, schema)


def token_counts(docs: DataFrame, text: str = "text", path: str = VOCABULARY, size: str = "n_tokens") -> DataFrame:
    """docs without `text`, with the number of its tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(model(path))
    slim = docs.select(*[c for c in docs.columns if c not in (text, size)], F.col(text).alias("__text"))
    schema = slim.drop("__text").withColumn(size, F.lit(None).cast("bigint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value).encode
        for b in batches:
            n = [len(encode(t)) for t in b.column("__text").to_pylist()]
            yield b.select([c for c in b.schema.names if c != "__text"]).append_column(size, pa.array(n, pa.int64()))

    return slim.mapInArrow(run, schema)
