"""Texts made to take long: a megabyte of what each pattern has to try and give up again."""

import re
import time

import public_tokenizers
import pytest

from voxtally.llm import language_id, packing, pii_crf, secret_scan, simhash, toxicity
from voxtally.llm.decontaminate import contained
from voxtally.llm.exact_dedup import exact_groups
from voxtally.llm.lm import scored

SIZE = 1_000_000
JUNK = ["<a", "<" + "a" * 99, "<!", "lang ", "lang=" + " " * 99, ".", "!?", "...a", "eyJ", "eyJa.", "token ", "a@", "1.", "1-", "+1 ", "-----BEGIN ", "\n", " ", "é"]


def long_text(unit):
    return (unit * (SIZE // len(unit) + 1))[:SIZE]


def in_seconds(limit, f, *args):
    began = time.perf_counter()
    out = f(*args)
    assert time.perf_counter() - began < limit
    return out


@pytest.mark.parametrize("unit", JUNK)
def test_page_parser(unit):
    in_seconds(2, language_id.visible_text, long_text(unit))
    in_seconds(2, language_id.visible_text, "<html " + long_text(unit) + ">")


def test_one_tag_that_never_ends():
    for html in ("<" + "a" * SIZE, "<html lang" + " " * SIZE + ">", "<html lang=" + " " * SIZE + ">", "<!" + "x" * SIZE):
        in_seconds(2, language_id.visible_text, html)


@pytest.mark.parametrize("unit", JUNK)
def test_clauses(unit):
    in_seconds(5, lambda: list(toxicity.clauses(long_text(unit))))


def test_clauses_are_as_before():
    plain = re.compile(r"[.!?;:\n]+(?=\s|$)|\n")
    for text in ("a..b. c", "a...\nb", "a!\n?b", "x;;\n\n.y z.", "...", "e.g. this: that", "a.\n.b", "?!\n!x. "):
        tokens = [toxicity._TOKEN.findall(p) for p in plain.split(text)]
        assert list(toxicity.clauses(text)) == [t for t in tokens if t]


@pytest.fixture(scope="module")
def junk(spark):
    rows = [(i, long_text(u)) for i, u in enumerate(JUNK)] + [(100, "the first plain text of them all"), (101, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(8)


def test_secrets_of_long_texts(spark, junk):
    findings, _ = secret_scan.scan(junk, path="doc_id")
    in_seconds(60, lambda: findings.count())


def test_jwt_spans_are_those_of_the_plain_pattern(spark):
    part = r"[A-Za-z0-9_-]{8,}"
    plain = re.compile(rf"eyJ{part}\.{part}\.{part}")
    whole = "eyJabcdefgh.abcdefgh-1.ABCDEFGH_2"
    texts = [whole, f"x{whole}", f"eyJ.{whole}", f"é{whole}.{whole} {whole}", f"eyJeyJ{whole[3:]}", "eyJabc.abcdefgh.abcdefgh",
             f"eyJabcdefgh.{whole}", f"-{whole}=", "eyJ" * 9, f"eyJabcdefgh.short.{whole}", f"a.b {whole}\n{whole}", "eyJ-eyJ_.abcdefgh.abcdefgh"]
    rows = spark.createDataFrame(list(enumerate(texts)), "path long, text string")
    findings, _ = secret_scan.scan(rows)
    by_path = secret_scan.findings_by_path(rows, findings)
    got = {r["path"]: [(f["start"], f["end"]) for f in r["findings"] if f["rule"] == "jwt"] for r in by_path.collect()}
    assert got == {i: [m.span() for m in plain.finditer(t)] for i, t in enumerate(texts)}
    assert sum(map(len, got.values())) > 8


@pytest.mark.parametrize("run", [
    lambda spark, d: exact_groups(d),
    lambda spark, d: simhash.near_groups(d),
    lambda spark, d: contained(d, spark.createDataFrame([(1, "lang lang lang lang lang lang")], "item_id long, text string")),
    lambda spark, d: packing.pack(d, public_tokenizers.path("word_bpe_49k.json")),
    lambda spark, d: pii_crf.personal_data(d, pii_crf.potentials(d)),
    lambda spark, d: scored(d),
], ids=["exact", "simhash", "decontamination", "packing", "pii", "lm"])
def test_operators_end(spark, junk, run):
    in_seconds(150, lambda: run(spark, junk).count())
