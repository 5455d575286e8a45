"""Byte-level BPE: a sentencepiece model serialised from a rank file, encoding of pre-tokens, decoding by the inverse map."""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CACHED = 1 << 20  # words whose ids a worker keeps; the cache is emptied when it is full
_LONGEST = 48  # longer words are not kept
_BESIDE = re.compile(r"\s\s|\A\s|\s\Z")  # what a text has none of if each space in it stands between two other characters
_CUT = re.compile(r"(?<=\S) (?=\S)")
_TOGETHER = 1 << 19  # characters of texts that are encoded in one call, and what the last of them has more


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 and rank on each line) in the order of their ranks."""
    with open(path, "rb") as f:
        found = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    if [rank for rank, _ in found] != list(range(len(found))):
        raise ValueError("ranks must run from 0 without gaps")
    return [token for _, token in found]


def byte_letters() -> list[str]:
    """One visible character for each byte: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protocol-buffer field: bytes, a float of 32 bits, or an unsigned integer."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def model_proto(tokens: list[bytes]) -> bytes:
    """A sentencepiece model whose piece i is token i in byte letters with score -i, so that merges go by rank.

    Field numbers are those of the public model format: pieces (piece, score, type), trainer settings (BPE, piece count,
    unknown id) and normalizer settings (identity, no added prefix, white space kept as it is)."""
    letters = byte_letters()
    pieces = [("".join(letters[b] for b in token), -float(rank), 1) for rank, token in enumerate(tokens)]
    pieces.append(("<unk>", 0.0, 2))
    out = [_field(1, _field(1, piece.encode()) + _field(2, score) + _field(3, kind)) for piece, score, kind in pieces]
    out.append(_field(2, _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1)))
    out.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class ByteBpe:
    """Encode and decode whole texts; one per worker and vocabulary."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        letters = byte_letters()
        self.latin = {i: c for i, c in enumerate(letters)}
        self.bytes_of = [bytes(bytearray(token)) for token in self._inverse(letters)]
        self.pattern = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.tokens))
        self.cache: dict[str, bytes] = {}  # ids of a part with the space before it

    def _inverse(self, letters: list[str]) -> Iterator[bytes]:
        byte = {c: i for i, c in enumerate(letters)}
        for token in self.tokens:
            piece = "".join(letters[b] for b in token)
            yield bytes(byte[c] for c in piece)

    def _plain(self, texts: list[str]) -> list[bytes]:
        """For each text the ids of its matches of the pattern, one after the other, as little-endian unsigned 32-bit integers."""
        found = [self.pattern.findall(text) for text in texts]
        pieces = [m.encode().decode("latin-1").translate(self.latin) for matches in found for m in matches]
        ids = iter(self.model.encode(pieces, out_type=int, num_threads=1) if pieces else [])
        return [array("I", itertools.chain.from_iterable(itertools.islice(ids, len(matches)))).tobytes() for matches in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. A text is cut before each space that stands between two characters other than white space: the
        pattern never joins what stands on both sides of such a cut, so each part is encoded by itself. What the cache lacks
        is encoded in one call for all texts."""
        if len(self.cache) > CACHED:
            self.cache.clear()
        cache, own = self.cache, {}
        parts = [_CUT.split(text) if _BESIDE.search(text) else text.split(" ") for text in texts]
        new = list({x for p in parts for x in p[1:] if x not in cache})
        first = [p[0] for p in parts]
        made = self._plain(first + [" " + x for x in new])
        for x, ids in zip(new, made[len(first) :], strict=True):
            (cache if len(x) <= _LONGEST else own)[x] = ids
        if own:
            get = lambda x: own[x] if x in own else cache[x]
        else:
            get = cache.__getitem__
        return [a + b"".join(map(get, p[1:])) for a, p in zip(made, parts, strict=False)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_BUILT: dict[tuple[str, str], ByteBpe] = {}


def codec(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _BUILT:
        _BUILT[path, pattern] = ByteBpe(path, pattern)
    return _BUILT[path, pattern]


def encoded(codec: Any, texts: pa.Array) -> Iterator[bytes]:
    """The ids of each text of a column, null as empty, encoded a few texts at a time."""
    some, size = [], 0
    for value in texts:
        some.append(value.as_py() or "")
        size += len(some[-1])
        if size >= _TOGETHER:
            yield from codec.encode(some)
            some, size = [], 0
    yield from codec.encode(some)


_OUT = {
    "ids": (pa.list_(pa.int32()), T.ArrayType(T.IntegerType())),
    "decoded": (pa.binary(), T.BinaryType()),
    "n_tokens": (pa.int64(), T.LongType()),
    "ids_sha256": (pa.string(), T.StringType()),
    "decoded_sha256": (pa.string(), T.StringType()),
}


def byte_bpe(docs: DataFrame, vocabulary: str, pattern: str, keep: Iterable[str] = ("doc_id",), text: str = "text", outputs: Iterable[str] = ("ids", "decoded")) -> DataFrame:
    """Encode each whole text with byte-level BPE and decode its ids again; one row per row, no shuffle.

    vocabulary: a rank file that every executor can read; pattern: what cuts a text into pre-tokens. keep: columns carried
    along. outputs, any of: ids (array<int>), decoded (binary), n_tokens (long), ids_sha256 (of the ids as little-endian
    unsigned 32-bit integers) and decoded_sha256, in lowercase hex.

    Null and empty texts have no ids and decode to nothing; rows with a null in keep, repeated rows and ties stay as they are;
    an empty table gives an empty one; columns not named in keep are left out, whatever their names."""
    keep, outputs = list(keep), list(outputs)
    rows = docs.select(*keep, docs[text].alias("__text"))
    schema = T.StructType([*(docs.schema[k] for k in keep), *(T.StructField(o, _OUT[o][1]) for o in outputs)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary, pattern)
        for batch in batches:
            made: dict[str, list] = {o: [] for o in outputs}
            for ids in encoded(bpe, batch.column(len(keep))):
                if "ids" in made:
                    made["ids"].append(np.frombuffer(ids, "<u4").astype("i4"))
                if "n_tokens" in made:
                    made["n_tokens"].append(len(ids) // 4)
                if "ids_sha256" in made:
                    made["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                if "decoded" in made or "decoded_sha256" in made:
                    back = bpe.decode(ids)
                    if "decoded" in made:
                        made["decoded"].append(back)
                    if "decoded_sha256" in made:
                        made["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(made[o], _OUT[o][0]) for o in outputs)], names=[*keep, *outputs])

    return rows.mapInArrow(run, schema)
