"""Byte-level BPE against the library that the rank files are made for, and whole round trips."""

import base64
import hashlib
import time

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings, strategies as st

from tests.conftest import SMALL
from voxtally.llm import byte_bpe
from voxtally.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
VOCABULARY = byte_bpe.Vocabulary(byte_bpe.rank_file(PATH))
LIBRARY = tiktoken.Encoding(
    "library", pat_str=public_tokenizers.PATTERN, mergeable_ranks=VOCABULARY.ranks, special_tokens={}
)
TEXTS = st.text(
    st.one_of(st.sampled_from("  \n\t\x85　'stremdvlabE9²!.…́é中٣😀"), st.characters(exclude_categories=["Cs"])),
    max_size=60,
)


def encoded(texts):
    ids, many = VOCABULARY.encode([t.encode() for t in texts])
    return [part.tolist() for part in np.split(ids, np.cumsum(many)[:-1])]


@settings(max_examples=500, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=6))
def test_ids_are_those_of_the_library(texts):
    assert encoded(texts) == [LIBRARY.encode_ordinary(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(TEXTS.filter(bool), st.integers(1, 9))
def test_blocks_do_not_matter(text, block):
    points = byte_bpe._code_points(text)
    read = byte_bpe.symbols(points, np.zeros(1, np.int64), VOCABULARY.classes)
    assert byte_bpe.piece_starts(read, block).tolist() == byte_bpe.piece_starts(read, 64).tolist()


def test_pieces_are_the_matches_of_the_pattern():
    text = "It's we'LL  'sing\n\n x'' 've\t!'s  12½ 　end   "
    data, starts, _ = VOCABULARY.cuts([text.encode()])
    bounds = [*starts.tolist(), len(data)]
    pieces = [data[a:b].decode() for a, b in zip(bounds, bounds[1:])]
    assert pieces == regex.findall(public_tokenizers.PATTERN, text)


def test_special_strings_are_plain_text():
    for text in ("<|endoftext|>", "a<|endoftext|> <|startoftext|>", "", " ", "\n"):
        assert encoded([text]) == [LIBRARY.encode_ordinary(text)]


def test_the_library_classifies_every_code_point_alike():
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    text = "".join(c + "a1" for c in every)
    ids, _ = VOCABULARY.encode([text.encode()])
    assert ids.tolist() == LIBRARY.encode_ordinary(text)


@pytest.mark.parametrize("unit", ["a", " ", "'", "\n ", "!", "x1'", "é", "'s"])
def test_a_megabyte_of_one_thing(unit):
    text = (unit * 1_000_000)[:1_000_000].encode()
    began = time.perf_counter()
    data, starts, _ = VOCABULARY.cuts([text])
    assert time.perf_counter() - began < 2 and data == text and starts[0] == 0


def test_merging_long_pieces():
    for piece in (b"ab" * 3000, bytes(range(256)) * 8, b"a" * 5001):
        assert byte_bpe.merge(piece, VOCABULARY.ranks) == LIBRARY._encode_single_piece(piece)


def test_decode_any_slice():
    text = "Grüße, 中文 and 😀s".encode()
    ids, _ = VOCABULARY.encode([text])
    sizes = VOCABULARY.bytes.sizes[ids]
    starts = np.cumsum(sizes) - sizes
    assert VOCABULARY.bytes.decode(ids, starts) == text
    assert VOCABULARY.bytes.decode(ids[2:5], starts[2:5] - starts[2]) == text[starts[2] : starts[5]]


def test_rows_as_they_are(spark):
    texts = [None, "", "same same", "same same", "Zwei\n\nWörter ", "x" * 70_000]
    docs = spark.createDataFrame(
        [(None if i == 2 else i % 4, t, [1], "a") for i, t in enumerate(texts)],
        "doc_id long, text string, ids array<int>, starts string",
    )
    rows = byte_bpe.decode(byte_bpe.encode(docs, PATH), PATH).collect()
    assert sorted((r.doc_id is None, r.doc_id, bytes(r.decoded), r.ids) for r in rows) == sorted(
        (i == 2, None if i == 2 else i % 4, (t or "").encode(), LIBRARY.encode_ordinary(t or ""))
        for i, t in enumerate(texts)
    )
    assert byte_bpe.decode(byte_bpe.encode(docs.limit(0), PATH), PATH).collect() == []


def test_bytes_that_are_no_text(spark):
    docs = spark.sql("SELECT 1L AS doc_id, X'61FF62' AS text")
    assert bytes(byte_bpe.decode(byte_bpe.encode(docs, PATH), PATH).first().decoded) == "a�b".encode()


def test_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op13_byte_bpe"](spark, SMALL).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode_bytes(ids)).hexdigest()


def test_ranks_are_read_from_the_file():
    first = open(PATH, "rb").readline().split()
    assert VOCABULARY.ranks[base64.b64decode(first[0])] == int(first[1])
