"""Byte-level BPE and packing against the public tokenizer libraries and round trips."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from beatframe.llm import bpe, packing

TEXTS = ["", None, "  a  b ", "\n\n a\n b \n\n c", " x", "x ", "a b  c", "🙂🙂 ok.", "\x1c\x1d a", "don't  we'll\t\tx", "a" * 3000, " " * 500 + "x", "́a é x.", "\x85 a\x85b", "a <|endoftext|> b<|startoftext|>c.", "İstanbul, İ. Σας ΣΑΣ. ΟΔΟΣ", "A.B., x!., y?. 3. 4,5, É. Ñandú, ß.", "word " * 9000]
RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture
def docs(spark):
    rows = [(i, x, "clash") for i, x in enumerate(TEXTS)] + [(None, "a b", "y"), (3, TEXTS[3], "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_every_token_is_a_piece_of_its_own():
    codec = bpe.codec(RANKS, public_tokenizers.PATTERN)
    letters = bpe.byte_letters()
    for i in range(0, len(codec.tokens), 97):
        assert codec.model.encode("".join(letters[b] for b in codec.tokens[i]), out_type=int) == [i]


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_any_text_encodes_as_the_library_does(reference, text):
    codec = bpe.codec(RANKS, public_tokenizers.PATTERN)
    ids = codec.encode([text, text])[1]
    assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


@settings(max_examples=400, deadline=None)
@given(st.text(" \u00a0\t\nxy"))
def test_white_space_of_all_kinds_encodes_as_the_library_does(reference, text):
    codec = bpe.codec(RANKS, public_tokenizers.PATTERN)
    for t in (text, "x \u00a0 \u00a0 y", text + " word \u00a0 " + text):
        assert np.frombuffer(codec.encode([t, "a b"])[0], "<u4").tolist() == reference.encode_ordinary(t)


def test_documents_as_the_library_encodes_them(docs, reference):
    out = bpe.byte_bpe(docs, RANKS, public_tokenizers.PATTERN, outputs=("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256"))
    rows = out.collect()
    assert len(rows) == len(TEXTS) + 2 and out.columns == ["doc_id", "ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256"]
    for r in rows:
        text = "a b" if r.doc_id is None else TEXTS[r.doc_id] or ""
        want = reference.encode_ordinary(text)
        assert (r.ids, bytes(r.decoded), r.n_tokens) == (want, text.encode(), len(want))
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.byte_bpe(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_parts_have_the_ids_of_the_whole(text):
    own = packing.words(WORDS)
    assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_and_sequences(docs):
    size = 256
    rows = packing.pack_documents(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), WORDS, size=size, group=5).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    for doc_id, text in enumerate(TEXTS):
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]
        pieces = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.start)
        assert [i for r in pieces for i in r.ids] == want and all(r.doc_tokens == len(want) for r in pieces)
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) for r in pieces)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    assert packing.pack_documents(docs.limit(0), WORDS).count() == 0
    assert packing.pack_documents(docs, WORDS, with_ids=False).count() == len(TEXTS) + 2 + 2  # one long text has three pieces


@given(st.lists(st.integers(1, 50), min_size=1, max_size=80))
def test_first_fit_is_the_plain_one(lengths):
    lengths.sort(reverse=True)
    room, want = [], []
    for n in lengths:
        b = next((i for i, r in enumerate(room) if r >= n), len(room))
        if b == len(room):
            room.append(50)
        room[b] -= n
        want.append(b)
    assert packing.first_fit(lengths, 50) == want


def test_tokenizers_are_given_back(spark, tmp_path):
    """Without kept, no worker holds the tokenizer or its words after its task, and the pieces are the same."""
    path = str(tmp_path / "own.json")
    with open(WORDS, "rb") as a, open(path, "wb") as b:
        b.write(a.read())
    docs = spark.createDataFrame([(i, f"a text of {i} words") for i in range(64)], "doc_id long, text string").repartition(8)
    kept = packing.token_pieces(docs, WORDS, with_ids=False)
    assert sorted(packing.token_pieces(docs, path, with_ids=False, kept=False).collect()) == sorted(kept.collect())

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(path in packing._WORDS)])], names=["n"])

    assert spark.range(0, 64, 1, 8).mapInArrow(held, "n long").agg({"n": "sum"}).first()[0] == 0


class Counted:
    """A tokenizer that notes what it is asked to encode."""

    def __init__(self, tokenizer):
        self.tokenizer, self.asked = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.asked += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_words_of_latin_1_are_encoded_once():
    """Capitals, signs and digits beside a known word cost no new encoding, and only other letters go through the whole tokenizer."""
    own = packing.Words(WORDS)
    plain = Tokenizer.from_file(WORDS)
    own.tokenizer, own.merges = Counted(own.tokenizer), Counted(own.merges)
    text = "Größe,%%% it's GRÖSSE größe größe7\x85Größe\n\xa0don't\tÑ×÷²¼ 'Sam"
    assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert own.tokenizer.asked == [] and sum(len(x.split()) for x in own.merges.asked) == len({*"größe ,%%% it 's grösse 7 don 't ñ ×÷ ² ¼ am".split()})
    own.merges.asked.clear()
    for more in ("Größe größe,%%% GRÖSSE 77 'sam it's don't", "Größe Ñ “sam”", "größe<|endoftext|>it"):
        assert np.frombuffer(own.encode([more])[0], "<u4").tolist() == plain.encode(more, add_special_tokens=False).ids
    assert own.merges.asked == [] and own.tokenizer.asked == ["“sam”", "größe<|endoftext|>it"]
