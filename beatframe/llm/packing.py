"""Packing: whole documents as token pieces, first-fit decreasing per randomised group with a tournament tree of capacities."""

from __future__ import annotations

import codecs
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatframe.llm.bpe import byte_letters, encoded
from beatframe.llm.common import trim

SIZE = 4096
END = 2  # the id after each document
GROUP = 4096  # documents of a group, on average
CACHED = 1 << 20  # words whose ids a worker keeps; the cache is emptied when it is full
_LONGEST = 48  # longer words are not kept


# What the tokenizer's pattern finds in small Latin-1 text, in its order: endings, runs of letters, single digits, runs of signs.
_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼-¾\t-\r \x85\xa0]+")


def _plain(text: str) -> bool:
    """Whether the tokenizer's normal form of a text is the text in small letters, and no special token can stand in it."""
    try:
        return "<|" not in text and (text.isascii() or bool(text.encode("latin-1")))
    except UnicodeEncodeError:
        return False


class Words:
    """Ids of texts as little-endian unsigned 32-bit integers. The tokenizer drops white space and joins nothing across it, so
    the ids of a text are those of its parts between spaces, tabs and line ends; parts seen before are looked up. Latin-1
    texts are lowered and their new parts cut into the tokenizer's words here; other parts go through the whole tokenizer."""

    def __init__(self, path: str, cached: int = CACHED) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)  # the same model, for words that are normal and cut already
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        letters = byte_letters()
        self.letters = "".join(" " if b == 32 else letters[b] for b in range(256))
        self.cache: dict[str, bytes] = {}
        self.cached = cached
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _ids(self, parts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _merged(self, words: list[str]) -> list[bytes]:
        """Ids of words as _WORD finds them, encoded in one call and told apart by the ids that end words."""
        if not words:
            return []
        text = codecs.charmap_decode(" ".join(words).encode(), "strict", self.letters)[0]
        ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
        if len(ends) != len(words):
            return self._ids(words)
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _learn(self, small: set[str], others: set[str]) -> dict[str, bytes]:
        """Ids of new parts, of small Latin-1 texts and of others."""
        cache = self.cache
        alone = [x for x in small if x.isalpha()]
        made = [(x, _WORD.findall(x)) for x in small.difference(alone)]
        rest = []
        for x in others:
            if _plain(x):
                made.append((x, _WORD.findall(x.lower())))
            else:
                rest.append(x)
        need = list(set(alone).union(*[words for _, words in made]).difference(cache))
        own = dict(zip(need, self._merged(need), strict=True))
        own.update([(x, b"".join([own[w] if w in own else cache[w] for w in words])) for x, words in made])
        own.update(zip(rest, self._ids(rest), strict=True))
        return own

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > self.cached:
            self.cache.clear()
        cache = self.cache
        plain = [_plain(text) for text in texts]
        parts = [(text.lower() if p else text).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for text, p in zip(texts, plain, strict=True)]
        small = set().union(*compress(parts, plain)).difference(cache)
        others = set().union(*compress(parts, map(not_, plain))).difference(cache, small)
        found = self._learn(small, others) if small or others else {}
        long = [x for x in found if len(x) > _LONGEST]
        cache.update(found)
        out = [b"".join(map(cache.__getitem__, p)) for p in parts]
        for x in long:
            del cache[x]
        return out


_WORDS: dict[str, Words] = {}


def words(path: str, cached: int = CACHED) -> Words:
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    _WORDS[path].cached = cached
    return _WORDS[path]


def forget(path: str) -> None:
    _WORDS.pop(path, None)


def token_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = SIZE, end: int = END, with_ids: bool = True, cached: int = CACHED, kept: bool = True) -> DataFrame:
    """The ids of each whole text and the id `end`, cut into pieces of `size`; the last piece of a document is what remains.

    Columns: key, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), doc_tokens, and ids
    (array<int>) unless with_ids is false. Null and empty texts give one piece with the id `end` alone; null keys and repeated
    rows stay, each row by itself; an empty table gives an empty one; other columns are left out, whatever their names.
    kept: workers keep the tokenizer and the words they have seen for their next task; otherwise each task gives both back."""
    rows = docs.select(key, docs[text].alias("__text"))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
    names = ["start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    schema = T.StructType([docs.schema[key], *(T.StructField(n, T.LongType()) for n in names[:4])] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)
    step, last = 4 * size, np.array([end], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = words(tokenizer, cached)
        for batch in batches:
            at: list[int] = []
            made: list[list] = [[] for _ in names]
            for i, ids in enumerate(encoded(own, batch.column(1))):
                ids += last
                for start in range(0, len(ids), step):
                    piece = ids[start : start + step]
                    at.append(i)
                    row = [start // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4]
                    for to, x in zip(made, row + [np.frombuffer(piece, "<i4")] * with_ids, strict=True):
                        to.append(x)
            columns = [pa.array(x, kind) for x, kind in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=[key, *names])
        if not kept:
            del own
            forget(tokenizer)
        trim()

    return rows.mapInArrow(run, schema)


def first_fit(lengths: list[int], size: int) -> list[int]:
    """The bin of each length, in the order given: the first bin with enough room, found in a tournament tree over the bins.

    Each inner node holds the largest room below it, so the first bin that fits is found by going down, left where possible."""
    leaves = 1 << max(0, (len(lengths) - 1).bit_length())
    room = [size] * (2 * leaves)
    out = []
    for length in lengths:
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < length:
                node += 1
        out.append(node - leaves)
        room[node] -= length
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
    return out


def pack(pieces: DataFrame, groups: int, keys: Iterable[str] = ("doc_id", "start", "ids_crc32"), length: str = "length", size: int = SIZE) -> DataFrame:
    """Put each piece into a sequence of at most `size` tokens: first-fit decreasing in each of `groups` random groups.

    The group of a piece is a hash of keys, the same on every run, so a piece that is made anew after a loss comes to the
    same group. Adds sequence_id (unique over all groups) and offset (from 0 without gaps in each sequence). Ties in length go by
    keys; a piece longer than size is an error; an empty table gives an empty one."""
    keys = list(keys)
    schema = T.StructType([*pieces.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    order = [(length, "descending"), *((k, "ascending") for k in keys)]

    def run(table: pa.Table) -> pa.Table:
        group = table.column("__group")[0].as_py()
        table = table.drop_columns(["__group"]).sort_by(order)
        lengths = table.column(length).to_pylist()
        if lengths and lengths[0] > size:
            raise ValueError(f"a piece of {lengths[0]} tokens is longer than a sequence of {size}")
        bins = first_fit(lengths, size)
        filled = [0] * (max(bins) + 1)
        offsets = []
        for b, n in zip(bins, lengths, strict=True):
            offsets.append(filled[b])
            filled[b] += n
        ids = pa.array(np.array(bins, np.int64) + (group << 32))
        return table.append_column("sequence_id", ids).append_column("offset", pa.array(offsets, pa.int64()))

    grouped = pieces.withColumn("__group", F.pmod(F.xxhash64(F.lit("pack"), *keys), F.lit(groups)))
    return grouped.groupBy("__group").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = SIZE, end: int = END, group: int = GROUP, with_ids: bool = True, cached: int = CACHED, kept: bool = True) -> DataFrame:
    """token_pieces, then pack in as many groups as hold `group` documents on average. A group holds a bounded number of pieces
    whatever the corpus: the pieces of one long document go to many groups. cached: words whose ids a worker keeps; kept: also for its next task."""
    groups = max(1, -(-docs.count() // group))
    return pack(token_pieces(docs, tokenizer, key, text, size, end, with_ids, cached, kept), groups, (key, "start", "ids_crc32"), size=size)
