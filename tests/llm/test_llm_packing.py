"""Token ids against the tokenizer, best fit against one piece after the other, and whole packings."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from voxtally.llm.packing import WordIds, moves, pack

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
IDS = WordIds(PATH)


def encoded(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(
    st.sampled_from(" \n\t\x0b\x0c\x1c\x85 　ab'stLL.,!éÉßÀ²½İΣς́<|endofx>09"), st.characters(exclude_categories=["Cs"]),
), max_size=40))
def test_ids_of_any_text(text):
    assert np.frombuffer(IDS(text.encode()), "<u4").tolist() == encoded(text)


def test_ids_of_special_strings():
    for text in ("a<|endoftext|>b", "<|startoftext|> x", "don't WE'LL it's", "", " ", "x" * 5000):
        assert np.frombuffer(IDS(text.encode()), "<u4").tolist() == encoded(text)


def one_by_one(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [(g, i) for i, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits)[1]] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


def placed(lengths, capacity):
    plan, out = moves(Counter(lengths), capacity), {}
    for n, many in Counter(lengths).items():
        own = plan[plan[:, 0] == n]
        for rank in range(many):
            _, first, sequence, each, offset = own[np.searchsorted(own[:, 1], rank, "right") - 1]
            nth = rank - first
            out.setdefault(sequence + nth // each, []).append((offset + nth % each * n, n))
    return out


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=120))))
def test_moves_are_best_fit_decreasing(case):
    capacity, lengths = case
    sequences = placed(lengths, capacity)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(sequences) == one_by_one(lengths, capacity)


def test_the_plan_does_not_grow_with_the_input():
    few = Counter({n: 10 for n in range(1, 4097)})
    many = Counter({n: 10_000_000 for n in range(1, 4097)})
    assert len(moves(many)) <= 2 * len(moves(few)) + 4096


def test_pack(spark):
    texts = ["word " * n for n in (0, 1, 5, 30, 30, 30, 70, 200)] + [None, "", "É é"] + ["hot"] * 40
    docs = spark.createDataFrame(
        [(i if i != 3 else None, t, 7, "x") for i, t in enumerate(texts)],
        "doc_id long, text string, length long, piece string",
    ).repartition(3)
    rows = pack(docs, PATH, capacity=32).collect()
    expected = Counter()
    for i, t in enumerate(texts):
        ids = [*encoded(t or ""), 1]
        for p, at in enumerate(range(0, len(ids), 32)):
            part = np.array(ids[at : at + 32], "<u4")
            expected[(i if i != 3 else None, p, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in rows) == expected
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 32
    assert len(sequences) == one_by_one([r.length for r in rows], 32)
    assert pack(docs.limit(0), PATH).collect() == []
