"""Benchmark containment, secrets and personal data against plain loops."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL, plan_of
from voxtally.llm import pii_crf, secret_scan
from voxtally.llm.decontaminate import contained, without_items
from voxtally.llm.queries import QUERIES

DOCS = "doc_id long, text string, _row string, item_id string"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_contained_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [" ".join(rng.choices(vocabulary, k=n)) for n in (3, 5, 6, 9, 14, 40, 40)] + [None, "", "W1 w2\tw3"]
    docs = [None, "", "w1 w2 w3", " \n"]
    for _ in range(60):
        text = rng.choices(vocabulary, k=rng.randint(1, 300))
        item = words(rng.choice(items))
        for i in range(len(item)):
            if rng.random() < 0.03:
                item[i] = "changed"
        at = rng.randint(0, len(text))
        docs.append(" ".join(text[:at] + item + text[at:]).upper())
    d = spark.createDataFrame([(i if i != 5 else None, t, "a", "b") for i, t in enumerate(docs)] + [(6, docs[6], "", "")], DOCS)
    b = spark.createDataFrame([(i, t, "c") for i, t in enumerate(items)] + [(4, items[4], "c")], "item_id long, text string, _n string")
    expected = set()
    for (i, t), (j, u) in itertools.product(enumerate(docs), enumerate(items)):
        own = shingles(u)
        if own and 5 * len(own & shingles(t)) >= 4 * len(own):
            expected.add((i if i != 5 else None, j, len(own & shingles(t)), len(own)))
    found = contained(d, b)
    assert {tuple(r)[:4] for r in found.collect()} == expected and found.count() == len(expected) > 20
    leaked = {e[0] for e in expected}
    assert {r.doc_id for r in without_items(d, b).collect()} == {*range(len(docs)), None} - {5} - leaked
    assert contained(d.limit(0), b).collect() == [] == contained(d, b.limit(0)).collect()
    assert "Python" not in plan_of(found) and "Arrow" not in plan_of(found)


def test_an_item_takes_only_the_rows_that_hold_it(spark):
    """Rows without id, and rows that share one, of which one holds an item."""
    item, clean = "what is the capital of france", "no question at all is asked in here"
    d = spark.createDataFrame(
        [(i, t, "", "") for i in (None, 7) for t in (f"{item} indeed", clean, None)] + [(None, clean, "", "")], DOCS
    )
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = Counter((r.doc_id, r.text) for r in without_items(d, b).collect())
    assert left == Counter({(None, clean): 2, (None, None): 1, (7, clean): 1, (7, None): 1})


# -- secrets ----------------------------------------------------------------------

ASSIGN = re.compile(r"""((?:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    out += [(m.start(), 3, "pem", m.end()) for m in re.finditer(r"-----BEGIN [A-Z ]*PRIVATE KEY-----", text)]
    jwt = r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
    out += [(m.start(), 4, "jwt", m.end()) for m in re.finditer(jwt, text)]
    return sorted(out)


def versions(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "path long, text string, blob string")


def secret_texts():
    rng = random.Random(4)
    parts = [
        "password", "Token", "API_KEY", "apikey", "secret", ":", "=", " ", '"', "'", "abc", "abcdef12", "AKIA", "ABCDEFGHIJ0123456789",
        "0123456789abcdef", "deadbeef", "é", "😀", "\n", "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK",
    ]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(300)]
    return [None, "", "token:token:abcdef", "token=token=abc", "a" * 100_000, "AKIAAKIA" * 4, *texts, *[texts[0]] * 50]


def test_secrets_against_brute_force(spark):
    texts = secret_texts()
    docs = versions(spark, texts).repartition(5)
    findings, ledger = secret_scan.scan(docs)
    by_path = secret_scan.findings_by_path(docs, findings)
    found = {r.path: [tuple(f) for f in r.findings] for r in by_path.collect()}
    assert found == {i: [(s, k, n, e) for s, k, n, e in secrets(t)] for i, t in enumerate(texts)}
    blobs = len({t or "" for t in texts})
    assert ledger.count() == blobs * len(secret_scan.RULES)
    assert "Python" not in plan_of(by_path) and "Arrow" not in plan_of(by_path)
    empty = docs.limit(0)
    assert secret_scan.findings_by_path(empty, secret_scan.scan(empty)[0]).collect() == []


def test_the_ledger_leaves_out_what_was_scanned(spark):
    first = versions(spark, ["token = abcdefgh", "nothing", None])
    found, ledger = (df.cache() for df in secret_scan.scan(first))
    again, more = secret_scan.scan(first, ledger)
    assert again.count() == 0 and more.count() == 0
    second = versions(spark, ["token = abcdefgh", "secret: zyxwvuts", "secret: zyxwvuts"])
    new, pairs = secret_scan.scan(second, ledger)
    assert {(r.start, r.end) for r in new.collect()} == {(0, 16)} and pairs.count() == len(secret_scan.RULES)
    every = found.union(new)
    spans = secret_scan.findings_by_path(second, every)
    assert [len(r.findings) for r in spans.orderBy("path").collect()] == [1, 1, 1]


def test_the_query_scans_against_a_ledger(spark, monkeypatch):
    given, scan = [], secret_scan.scan

    def watched(versions, ledger=None, *args, **named):
        given.append(ledger)
        return scan(versions, ledger, *args, **named)

    monkeypatch.setattr(secret_scan, "scan", watched)
    QUERIES["op8_secrets"](spark, SMALL)
    assert [c for c, _ in given[0].dtypes] == ["blob", "rule", "version"] and given[0].count() == 0


def test_a_new_rule_version_scans_every_blob_once_more(spark):
    docs = versions(spark, ["token = abcdefgh", "x deadbeef"])
    _, ledger = secret_scan.scan(docs)
    rules = (*secret_scan.RULES[:2], secret_scan.Rule("hex", "[0-9a-f]{8,}", version=2))
    found, pairs = secret_scan.scan(docs, ledger.cache(), rules)
    assert {(r.rule, r.version) for r in pairs.collect()} == {("hex", 2)} and pairs.count() == 2
    assert [(r.rule, r.start, r.end) for r in found.collect()] == [("hex", 2, 10)]


# -- personal data ----------------------------------------------------------------

def personal(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def digits(s):
        return re.sub("[^0-9]", "", s)

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_patterns_against_brute_force():
    rng = random.Random(6)
    signs = "0123456789" * 6 + "+@.-()  ab_%é\n..@@٣"
    for _ in range(30_000):
        text = "".join(rng.choices(signs, k=rng.randint(0, 60)))
        assert pii_crf.base_spans(text) == personal(text)
    assert pii_crf.base_spans("a" * 300_000 + "@" + "1" * 300_000) == []


@pytest.fixture(scope="module")
def model(spark):
    texts = [f"call +49 30 555{i:04d} or mail a{i}@b.org, room {1000000 + i}, +49 30 555{i:04d}" for i in range(200)]
    return pii_crf.potentials(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_repeats_of_a_match_take_its_label(spark, model):
    text = "Ring +49 30 5551234 today. Later: 030 555 1234, and 7654321 is a number. ann@x.org is Ann (at) x (dot) org"
    docs = spark.createDataFrame(
        [(1, text, "b"), (2, None, "b"), (3, "", "b"), (None, "only 030 555 1234 here", "b"), (1, text, "b")],
        "doc_id long, text string, base string",
    )
    rows = pii_crf.personal_data(docs, model).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == 5 and by_id[2].spans == by_id[3].spans == by_id[None].spans == []
    base = [tuple(s) for s in by_id[1].base]
    added = [tuple(s) for s in by_id[1].spans if tuple(s) not in base]
    assert base == personal(text)
    assert [(text[s:e], pii_crf.KINDS[k]) for s, k, e in added] == [("030 555 1234", "phone"), ("Ann (at) x (dot) org", "email")]
    assert pii_crf.personal_data(docs.limit(0), model).collect() == []
    assert pii_crf.potentials(docs.limit(0)).shape == {}


def test_potentials_count_every_document(spark):
    """25,000 documents, a shape only in that whose id has the greatest hash and in one without id."""
    ids = spark.range(25_000).select(F.col("id").alias("doc_id"))
    last = ids.orderBy(F.xxhash64("doc_id").desc()).first().doc_id
    docs = ids.withColumn("text", F.when(F.col("doc_id") == last, "ring +49 (30) 555-1234 now").otherwise("+49 30 5551234"))
    docs = docs.union(spark.createDataFrame([(None, "ring +49 (30) 555-1234 now")], "doc_id long, text string"))
    shape = pii_crf.potentials(docs).shape
    assert set(shape) == {"11 +", "11 ()+-"}
    assert shape["11 ()+-"][3] == pytest.approx(np.log(2.2 / 3))


def test_a_mention_does_not_need_a_match_elsewhere(model):
    """The shape decides, with or without an unrelated match far away."""
    mention = "0305551234"
    sure = np.array([-3.0, -3.0, -3.0, 0.0, -3.0])
    given = pii_crf.Potentials({**model.shape, "10": sure}, model.unseen, 0 * model.chain, model.skip)
    alone, beside = f"ring {mention} now", f"ring {mention} now, or ann@example.org"
    for text in (alone, beside):
        base, spans = pii_crf.all_spans(text, given)
        assert [text[s:e] for s, k, e in spans if (s, k, e) not in base] == [mention]
    assert pii_crf.all_spans("no digits here", given) == ([], [])


def test_messages_are_exact_on_a_tree(model):
    """Without repeats the mentions are a chain, where belief propagation gives the marginals."""
    rng = np.random.default_rng(1)
    labels = [-1] * 5
    found = pii_crf.Mentions([(i, i + 1) for i in range(5)], labels, [f"s{i}" for i in range(5)], [f"k{i}" for i in range(5)])
    own = rng.normal(size=(5, 5))
    chain = rng.normal(size=(5, 5))
    given = pii_crf.Potentials({f"s{i}": own[i] for i in range(5)}, own[0], chain, np.eye(5))
    marginal = np.zeros((5, 5))
    for way in itertools.product(range(5), repeat=5):
        weight = np.exp(sum(own[i, x] for i, x in enumerate(way)) + sum(chain[a, b] for a, b in zip(way, way[1:])))
        for i, x in enumerate(way):
            marginal[i, x] += weight
    assert pii_crf.infer(found, given, rounds=60).tolist() == marginal.argmax(axis=1).tolist()
