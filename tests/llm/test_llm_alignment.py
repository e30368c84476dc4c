"""Linked tokens against a plain reading of both vocabularies, and counts against one dictionary."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tests.conftest import SMALL
from voxtally.llm import alignment as al
from voxtally.llm.queries import QUERIES

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
A = Tokenizer.from_file(PATHS[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
PAIR = al.Pair(*PATHS)


def piece_bytes(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") and len(piece) == 6 else piece.replace("▁", " ").encode()


def visible():
    """The byte that each character of a byte-level token stands for."""
    own = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 173]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


VISIBLE = visible()


def slow(text):
    """(ids A, ids B, groups as lists, links) of one text."""
    if not text:
        return [], [], [], []
    want = b" " + text.encode()
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = B.encode(text)
    side_a = [bytes(VISIBLE[c] for c in A.id_to_token(i)) for i in a]
    side_b = [piece_bytes(i) for i in b]
    if b"".join(side_a) != want or b"".join(side_b) != want:
        return [], [], [], []
    groups, links, left_a, left_b, end_a, end_b = [], [], [], [], 0, 0
    i = j = 0
    while i < len(a) or j < len(b):
        if end_a <= end_b and i < len(a):
            left_a.append(a[i])
            end_a, i = end_a + len(side_a[i]), i + 1
        else:
            left_b.append(b[j])
            end_b, j = end_b + len(side_b[j]), j + 1
        if end_a == end_b and left_a and left_b:
            groups.append((left_a, left_b))
            links.append((left_b[-1], left_a[-1]))
            left_a, left_b = [], []
    return a, b, groups, links


def joined(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def slow_rows(texts):
    read = [slow(t) for t in texts]
    counts = Counter(x for *_, links in read for x in links)
    most = Counter()
    for (b, _), n in counts.items():
        most[b] = max(most[b], n)
    return [
        (
            len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[0]] for x in links),
            sum(counts[x] for x in links), hashlib.sha256(joined(groups).encode()).hexdigest() if a else "",
        )
        for a, b, groups, links in read
    ], counts, most


def fields(r):
    return r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.sampled_from("  ab'sé中▁\n\t0😀<|endoftext|>"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_one_text(text):
    a, b, groups, links = slow(text)
    (ids,) = PAIR.encode([text.encode()])
    assert [x.tolist() for x in ids] == [a, b]
    aligned = al.Aligned(PAIR, *ids)
    assert aligned.written().decode() == joined(groups)
    assert [(x >> 32, x & 0xFFFFFFFF) for x in aligned.pairs().tolist()] == links


@pytest.mark.parametrize("text", ["a ", " ", "  ", "a  ", "a\n ", " a", "a  b ", "中 ", "\n", "a\t \t", "x\x00 "])
def test_spaces_at_the_ends(text):
    (ids,) = PAIR.encode([text.encode()])
    assert [x.tolist() for x in ids] == list(slow(text)[:2]) and len(ids[0])


def test_blocks_come_back():
    columns = [np.array([5, 1 << 40, 7]), np.array([1, 2], "<i4"), np.zeros(0, "<i4")]
    assert [c.tolist() for c in al._unpacked(al._packed(*columns))] == [c.tolist() for c in columns]


def test_merge_counts_each_pair_once():
    rng = np.random.default_rng(1)
    runs, expected = [], Counter()
    for _ in range(9):
        pairs = rng.integers(0, 40, 300) << 32 | rng.integers(0, 5, 300)
        expected.update(pairs.tolist())
        own = [(r, k, f) for r, k, f in al._runs(pairs, np.sort(rng.integers(0, 20, 300)))]
        for r in range(al.RADIXES):
            runs.append([f for radix, _, f in own if radix == r])
    merged = list(al._merged(runs))
    assert merged == sorted(expected.items())
    best = {p: b for p, _, b in al._with_best(iter(merged))}
    for p, n in expected.items():
        assert best[p] == (n == max(m for q, m in expected.items() if q >> 32 == p >> 32))


TEXTS = [None, "", "the same words here", "the same words here", "a ▁ b", "tab\there  x\n", "Ünïcödé 中文 😀",
         "<|endoftext|> the", " the the the", "x" * 3000] + ["the common line"] * 60


@pytest.mark.parametrize("buffer, block, fan, partitions", [(1 << 19, 1 << 14, 16, 4), (7, 3, 2, 1)])
def test_tables_against_plain_counts(spark, monkeypatch, buffer, block, fan, partitions):
    for name, value in (("BUFFER", buffer), ("BLOCK", block), ("FAN", fan), ("PARTITIONS", partitions)):
        monkeypatch.setattr(al, name, value)
    docs = spark.createDataFrame(
        [(None if i == 5 else i % 20, t, i, "row") for i, t in enumerate(TEXTS)],
        "doc_id long, text string, row int, data string",
    ).repartition(5)
    documents, pairs = al.alignment(docs, *PATHS)
    expected, counts, most = slow_rows(TEXTS)
    assert Counter((r.doc_id, *fields(r)) for r in documents.collect()) == Counter(
        (None if i == 5 else i % 20, *row) for i, row in enumerate(expected)
    )
    assert {(r.b_id, r.a_id): (r.links, r.best) for r in pairs.collect()} == {
        x: (n, n == most[x[0]]) for x, n in counts.items()
    }
    written = Counter((r.doc_id, r.groups) for r in al.groups(docs, *PATHS).collect())
    assert written == Counter((None if i == 5 else i % 20, joined(slow(t)[2])) for i, t in enumerate(TEXTS))


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    documents, pairs = al.alignment(docs, *PATHS)
    assert documents.collect() == [] and pairs.collect() == []
    documents, pairs = al.alignment(spark.createDataFrame([(1, None)], "doc_id long, text string"), *PATHS)
    assert [fields(r) for r in documents.collect()] == [(0, 0, 0, 0, 0, 0, "")] and pairs.collect() == []


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    expected, _, _ = slow_rows(texts.values())
    rows = QUERIES["op11_alignment"](spark, SMALL).collect()
    assert {r.doc_id: fields(r) for r in rows} == dict(zip(texts, expected)) and len(rows) == len(texts)
