"""Learned operators: brute force where there is one, gradients, held-out accuracy, odd input."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tests.conftest import SMALL
from voxtally.llm import language_id, lm, quality, toxicity

MEDIUM = "/root/testdata/sf0.1"
ODD = [(None, "a b", "x"), (1, None, "x"), (1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "word " * 100_000, "x")]


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


# -- language model ---------------------------------------------------------------

def tokens(text):
    return (text or "").encode().lower().split() + [b""]


def expected_scores(rows, order, mass):
    """n_tokens, n_known, N, base and score of each row, n-gram by n-gram."""
    counts = Counter()
    learn = [i is None or fold(i, 10) != 0 for i, _ in rows]
    for (_, text), use in zip(rows, learn):
        if use:
            t = [b" ", *tokens(text)]
            counts.update(tuple(t[i : i + n]) for n in range(1, order + 1) for i in range(len(t) - n + 1))
    total = sum(c for g, c in counts.items() if len(g) == 1 and g != (b" ",))
    different = sum(len(g) == 1 and g != (b" ",) for g in counts)
    out = []
    for _, text in rows:
        t = [b" ", *tokens(text)]
        base = score = 0.0
        for i in range(1, len(t)):
            p = (counts[(t[i],)] + 0.1) / (total + 0.1 * (different + 1))
            base += math.log10(p)
            for n in range(2, min(order, i + 1) + 1):
                p = (counts[tuple(t[i - n + 1 : i + 1])] + mass * p) / (counts[tuple(t[i - n + 1 : i])] + mass)
            score += math.log10(p)
        out.append((len(t) - 1, sum(counts[(x,)] > 0 for x in t[1:]), total, base, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model_against_brute_force(spark, order):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).select("doc_id", "text")
    odd = spark.createDataFrame([r[:2] for r in ODD[:-1]], docs.schema)
    rows = [tuple(r) for r in docs.union(odd).collect()]
    frame = spark.createDataFrame(rows, docs.schema)
    found = lm.scored(frame, order=order, mass=5.0, blocks=7).collect()
    expected = sorted(
        ((-1 if r[0] is None else r[0]), *e) for r, e in zip(rows, expected_scores(rows, order, 5.0))
    )
    got = sorted(
        (-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
        for r in found
    )
    for g, e in zip(got, expected, strict=True):
        assert g[:4] == e[:4] and g[4:] == pytest.approx(e[4:], rel=1e-9)
    assert all(r.held_out == (r.doc_id is not None and fold(r.doc_id, 10) == 0) for r in found)


def test_states_give_probabilities_that_add_up():
    """After any context of the training text, over the vocabulary and one unknown token."""
    texts = [b"a b a c", b"b b", b"c a b"]
    block = lm.Block([_Scalar(t) for t in texts], 2)
    trained = block.trained(np.ones(3, bool))
    vocabulary = [b"a", b"b", b"c"]
    total, different = sum(len(t.split()) + 1 for t in texts), 4
    known = dict(zip(block.keys.tolist(), trained.tolist()))
    for context in vocabulary:
        mass = 0.0
        ends = [*vocabulary, None, b"?"]  # None: the end token
        for word in ends:
            asked = lm.Block([_Scalar(context if word is None else context + b" " + word)], 2)
            counts = np.array([known.get(k, 0) for k in asked.keys.tolist()])
            _, _, whole = asked.walk(counts, total, different, 4.0)
            first = lm.Block([_Scalar(context)], 2)
            if word is None:
                base = _prefix(context, known, total, different)
                mass += 10 ** (whole[0] - base)
            else:
                after = _prefix(context, known, total, different)
                end = _end_after(word, known, total, different)
                mass += 10 ** (whole[0] - after - end)
            assert len(first.keys)
        assert mass == pytest.approx(1.0, abs=1e-9)


class _Scalar:
    def __init__(self, value):
        self.value = value

    def as_py(self):
        return self.value


def _walk(text, known, total, different):
    block = lm.Block([_Scalar(text)], 2)
    counts = np.array([known.get(k, 0) for k in block.keys.tolist()])
    return block.walk(counts, total, different, 4.0)[2][0]


def _end_after(word, known, total, different):
    """log10 of the end token after ``word``, by the formula."""
    read = lm.Reader()
    def key(w): return lm._mix(np.zeros(1, np.uint64), np.array([w], np.uint64))
    w = int(read(word)[0])
    single, end = known.get(int(key(w)[0]), 0), known[int(key(read.end)[0])]
    pair = known.get(int(lm._mix(key(w), np.array([read.end], np.uint64))[0]), 0)
    p = (end + 0.1) / (total + 0.1 * (different + 1))
    return math.log10((pair + 4.0 * p) / (single + 4.0))


def _prefix(context, known, total, different):
    """log10 of ``context`` at the start of a text."""
    return _walk(context, known, total, different) - _end_after(context, known, total, different)


def test_language_model_without_training_rows(spark):
    held = next(i for i in range(1000) if fold(i, 10) == 0)
    row = lm.scored(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (True, 3, 0, 0)
    assert row.base_score == pytest.approx(0.0) and row.score == pytest.approx(0.0)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.scored(empty).collect() == []


def test_the_model_beats_its_base_on_held_out_texts(spark):
    rows = [r for r in lm.scored(spark.read.parquet(f"{SMALL}/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) * 0.98


# -- quality ----------------------------------------------------------------------

def test_gradients():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, quality._FEATURES)) for n in (1, 3, 2)]
    labels = np.array([1.0, 0.0, 1.0])
    model = quality.learn(bags, labels, epochs=3)
    model.layers = {k: v.astype(float) for k, v in model.layers.items()}
    rows, starts = np.concatenate(bags), np.array([0, 1, 4])

    def loss():
        score, _ = model.forward(rows, starts)
        return -np.mean(labels * np.log(score) + (1 - labels) * np.log(1 - score))

    for name, gradient in model.gradients(rows, starts, labels).items():
        layer = model.layers[name]
        for at in list(np.ndindex(layer.shape))[:7]:
            before = layer[at]
            layer[at] = before + 1e-5
            up = loss()
            layer[at] = before - 1e-5
            down = loss()
            layer[at] = before
            assert gradient[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_every_passage_is_read():
    clean, junk = b"the cat sat on a mat " * 30, b"!!! ### $$$ " * 60
    assert len(quality.passages(clean + junk)) == 3 and len(quality.passages(b"")) == 1
    assert len(quality.passages(b"w " * 12_800)) == 100
    assert not np.allclose(quality.passages(clean + junk)[-1], quality.passages(clean)[0])


def test_scores_against_a_plain_loop_over_passages():
    rng = np.random.default_rng(8)
    bags = [rng.normal(size=(n, quality._FEATURES)).astype("<f2") for n in (1, 5, 12, 2)]
    model = quality.learn(bags, np.array([0, 1, 1, 0], np.float32), epochs=3)
    p = {name: np.asarray(layer, float) for name, layer in model.layers.items()}
    expected = []
    for bag in bags:
        codes, energies = [], []
        for row in bag.astype(float):
            x = [(v - m) / s for v, m, s in zip(row, model.mean, model.scale)]
            code = [math.tanh(sum(a * b for a, b in zip(x, column)) + bias) for column, bias in zip(p["A"].T, p["a"])]
            hidden = [
                math.tanh(sum(c * v for c, v in zip(code, vs))) / (1 + math.exp(-sum(c * u for c, u in zip(code, us))))
                for vs, us in zip(p["V"].T, p["U"].T)
            ]
            codes.append(code)
            energies.append(math.exp(sum(h * w for h, w in zip(hidden, p["w"]))))
        mixed = [sum(e * c[i] for e, c in zip(energies, codes)) / sum(energies) for i in range(len(codes[0]))]
        expected.append(1 / (1 + math.exp(-sum(m * c for m, c in zip(mixed, p["c"])) - p["b"].item())))
    rows, starts = np.concatenate(bags), np.cumsum([0, *map(len, bags[:-1])])
    assert np.allclose(model.forward(rows, starts)[0], expected, atol=2e-3)


def test_every_passage_is_learned_from(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "word " * 20_020), (2, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "learn", lambda bags, labels: (bags, labels))
    bags, given = quality.fit(docs, labels, folds=1, held=1)
    assert [len(b) for b in bags] == [157, 1] and given.tolist() == [0.0, 1.0]


def test_batches_add_up_to_all_bags():
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(n, quality._FEATURES)).astype("<f2") for n in (1, 40, 3, 2, 9, 9)]
    labels = np.array([1, 0, 1, 0, 0, 1], np.float32)
    assert [bags[cut] for cut in quality._batches(bags, 10)] == [bags[:1], bags[1:2], bags[2:4], bags[4:5], bags[5:]]
    whole, parts = (quality.learn(bags, labels, epochs=5, batch=n) for n in (1000, 10))
    for name, layer in whole.layers.items():
        assert np.allclose(layer, parts.layers[name], atol=1e-3), name


def accuracy(spark, scores, label, folds, held):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    rows = [r for r in quality.predictions(scores, folds, held).collect() if r.doc_id in labels]
    assert all(r.held_out == (fold(r.doc_id, folds) == held) for r in rows)
    tested = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out]
    ones, zeros = [s for s, y, _ in tested if y], [s for s, y, _ in tested if not y]
    ranks = {s: i for i, s in enumerate(sorted(ones + zeros))}
    area = (sum(ranks[s] + 1 for s in ones) - len(ones) * (len(ones) + 1) / 2) / len(ones) / len(zeros)
    return area, sum(p == y for _, y, p in tested) / len(tested)


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels, sample=1500)
    area, right = accuracy(spark, quality.scored(docs, model), "quality", 5, 0)
    assert area > 0.98 and right > 0.97


def test_quality_of_odd_input(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None, 5), (2, 1, 5), (None, 0, 5)], "doc_id long, quality int, label int")
    model = quality.fit(docs, labels)  # one label only
    rows = quality.scored(docs, model).collect()
    assert len(rows) == len(ODD) and len({r.score for r in rows}) == 1 and 0 < rows[0].score < 1
    kept = quality.kept(docs, model, threshold=0.0)
    assert kept.columns == docs.columns and kept.count() == len(ODD)
    assert quality.kept(docs, model, threshold=1.0).count() == 0
    assert quality.scored(docs.limit(0), quality.fit(docs.limit(0), labels.limit(0))).collect() == []


# -- toxicity ---------------------------------------------------------------------

def grammar(**weights):
    size = len(toxicity.FEATURES)
    return toxicity.Grammar(weights, np.zeros(size), np.zeros(size), np.ones(size), 0.0)


@pytest.mark.parametrize("text, way", [
    ("What a dumbo here.", "plain insult"), ("You dumbo!", "targeted insult"),
    ("He is not a dumbo.", "negated insult"), ("She said: dumbo. No.", "plain insult"),
    ("She said dumbo", "reported insult"), ('"dumbo" was there', "reported insult"),
    ("I will kill you", "targeted threat"), ("not now; a dumbo", "plain insult"),
    ("We never kill", "negated threat"), ("dumbos", "plain insult"),
])
def test_clauses_leave_by_one_arc(text, way):
    marks = grammar(dumbo=2.0).marks(text, {})
    assert [toxicity.FEATURES[i] for i in np.flatnonzero(marks[:8])] == [way]


def test_no_match_in_clean_or_empty_texts():
    for text in ("", "\n. !", "nothing to see, never mind"):
        assert not grammar(dumbo=2.0).marks(text, {})[:11].any()


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    area, right = accuracy(spark, toxicity.scored(docs, model), "toxic", 4, 2)
    assert area > 0.92 and right > 0.96
    assert 10 <= len(model.insults) <= toxicity.ARCS


def test_toxicity_of_odd_input(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, features string")
    labels = spark.createDataFrame([(1, None), (2, 0), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.scored(docs, toxicity.fit(docs, labels)).collect()
    assert len(rows) == len(ODD) and all(0 < r.score < 1 for r in rows)
    assert toxicity.scored(docs.limit(0), toxicity.fit(docs, labels.limit(0))).collect() == []


def slow_features(text, grammar):
    """The features of a text, each match decided by looking over the whole clause again."""
    out, size, matched = [0.0] * 12, 0, 0
    for tokens in toxicity.clauses(text):
        size += len(tokens)
        best = 0.0
        for i, token in enumerate(tokens):
            weight = max([w for b, w in grammar.insults.items() if (token + toxicity.END).startswith(b)], default=0.0)
            weight = max(weight, 0.0)
            if weight == 0 and token not in toxicity.THREATS:
                continue
            before = tokens[:i]
            quoted = sum(t in toxicity.QUOTES for t in before) % 2 == 1
            if quoted or any(t in toxicity.REPORTS and t not in toxicity.NEGATIONS for t in before):
                way = 3
            elif any(t in toxicity.NEGATIONS for t in before[-toxicity.REACH:]):
                way = 2
            else:
                way = 1 if any(t in toxicity.TARGETS for t in tokens) else 0
            out[way + (0 if weight > 0 else 4)] += weight or 1.0
            best = max(best, weight)
        out[8] = max(out[8], best)
        matched += best > 0
    out[9], out[10], out[11] = matched, sum(out[:4]) / max(1, size) ** 0.5, size
    return [math.log1p(x) if n != 8 else x for n, x in enumerate(out)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(
    "idiot idiots idiotic you not never said wrote kill burn people \" « . ! ; house the dich nicht töten zorn zornig".split()
), max_size=30))
def test_matches_against_a_reader_of_whole_clauses(tokens):
    insults = {"idio": 2.0, "idiots" + toxicity.END: 3.5, "zorn": 1.7}
    grammar = toxicity.Grammar(insults, np.zeros(12), np.zeros(12), np.ones(12), 0.0)
    text = " ".join(tokens)
    assert grammar.marks(text, {}) == pytest.approx(slow_features(text, grammar))


# -- languages --------------------------------------------------------------------

def test_visible_text_and_addresses():
    html = (
        '<!DOCTYPE html><HTML dir=ltr lang="de-AT"><script>if (a<b) "</p>"</script><nav>menu<ul></ul></nav>'
        "<!-- no > <p> --><article>Ein <b>Satz</b>&nbsp;hier</article><footer>end</footer>after<style>p{}"
    )
    declared, text = language_id.visible_text(html)
    assert declared == "de" and text.split() == ["Ein", "Satz", "hier", "after"]
    assert language_id.visible_text("") == ("", "") and language_id.visible_text("< <a <b" * 50_000)[0] == ""
    assert language_id.address("https://user@Blog.Some.example.ORG:80/en?x=1") == ("blog.some.example.org", "example.org", "org")
    assert language_id.address("not an address") == ("", "", "")
    assert language_id.address("http://10.0.0.1/") == ("10.0.0.1", "0.1", "")


@pytest.fixture(scope="module")
def labelled(spark):
    texts = {"en": "the house and the garden with this thing", "de": "der hund und die katze nicht schön"}
    return spark.createDataFrame([(t, k, 1) for k, t in texts.items()] * 5 + [(None, "fr", 1), ("x", None, 1)], "text string, lang string, host int")


def test_evidence_is_fused(spark, labelled):
    def page(text, lang=None):
        return f"<html{f' lang={lang}' if lang else ''}><body><p>{text}</p></body></html>"

    english, german = "the garden and the house", "die katze und der hund"
    rows = [(i, f"http://a.one.de/{i}", page(german * 3, "de")) for i in range(30)]
    rows += [(100 + i, f"http://b.two.org/{i}", page(english * 3, "en")) for i in range(30)]
    rows += [
        (200, "http://a.one.de/x", page("")), (201, "http://b.two.org/x", page("")),
        (202, "http://c.one.de/x", page("")), (203, None, page("", "en")), (204, None, None),
        (None, "http://b.two.org/y", page(german * 20, "en")), (205, "http://b.two.org/z", page("??", "xx")),
    ]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, lang string")
    found = {r.page_id: r for r in language_id.identify(pages, labelled).collect()}
    assert len(found) == len(rows)
    said = {i: found[i].lang for i in found}
    assert {said[i] for i in range(30)} == {"de"} and {said[100 + i] for i in range(30)} == {"en"}
    assert [said[i] for i in (200, 201, 202, 203, 205)] == ["de", "en", "de", "en", "en"]
    assert found[None].text_lang == "de" and said[204] in ("de", "en")
    assert all(0.4 < r.confidence <= 1 for r in found.values())


def test_posterior_against_plain_loops(spark, labelled):
    """Every evidence and prior page by page, each without the page itself."""
    english, german = "the garden and the house", "die katze und der hund"
    rows = [(i, f"http://{'ab'[i % 2]}.one.de/{i}", f"<html lang=de><p>{german}") for i in range(7)]
    rows += [(20 + i, f"http://c.two.org/{i}", f"<html lang={'en' if i % 3 else 'de'}><p>{english}") for i in range(6)]
    rows += [(40, "http://d.one.de/", "<p>xyz"), (41, None, None), (42, "http://10.0.0.1/", "<html lang=qq><p>die the"), (43, "nothing", "<p>der garden")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    names, logs = language_id.likelihoods(labelled)
    size = len(names)

    def softmax(x):
        raised = [math.exp(v - max(x)) for v in x]
        return [r / sum(raised) for r in raised]

    read = []
    for page, url, html in rows:
        declared, text = language_id.visible_text(html or "")
        cells = language_id.trigrams(text)
        weight = language_id.WORTH / (len(cells) + language_id.WORTH)
        found = [sum(logs[k][c] for c in cells) * weight for k in range(size)]
        declared = declared if declared in names or not declared else "?"
        read.append((page, language_id.address(url or ""), declared, found, softmax(found)))

    def total(keep):
        return [sum(r[4][k] for r in read if keep(r)) for k in range(size)]

    def smoothed(counts, above):
        return [(c + language_id.BORROWED * a) / (sum(counts) + language_id.BORROWED) for c, a in zip(counts, above)]

    every = [t + 0.5 for t in total(lambda r: True)]
    overall = [t / sum(every) for t in every]
    suffixes = len({r[1][2] for r in read})
    expected = {}
    for page, (host, domain, suffix), declared, found, soft in read:
        place = total(lambda r: r[1] == (host, domain, suffix))
        around = [max(d - h, 0) for d, h in zip(total(lambda r: r[1][1] == domain), place)]
        prior = smoothed([max(h - s, 0) for h, s in zip(place, soft)], smoothed(around, overall))
        said, own = total(lambda r: r[2] == declared), total(lambda r: r[1][2] == suffix)
        logs_ = [
            f + (math.log((said[k] + 0.5) / (every[k] + 0.5 * (size + 1))) if declared else 0)
            + (math.log((max(own[k] - soft[k], 0) + 0.5) / (every[k] + 0.5 * suffixes)) if suffix else 0)
            + math.log(prior[k])
            for k, f in enumerate(found)
        ]
        expected[page] = softmax(logs_)
    for r in language_id.identify(pages, labelled).collect():
        assert r.confidence == pytest.approx(max(expected[r.page_id]), abs=1e-9)
        assert r.lang == names[expected[r.page_id].index(max(expected[r.page_id]))]


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 3)
    docs = spark.createDataFrame([("text", f"l{i}") for i in range(4)], "text string, lang string")
    with pytest.raises(ValueError, match="more than 3"):
        language_id.likelihoods(docs)


def test_languages_of_nothing(spark, labelled):
    pages = spark.createDataFrame([(1, "http://a.de", "<p>x")], "page_id long, url string, html string")
    nobody = language_id.identify(pages, labelled.limit(0)).collect()
    assert [(r.page_id, r.lang, r.confidence) for r in nobody] == [(1, None, None)]
    assert language_id.identify(pages.limit(0), labelled).collect() == []


def test_languages_of_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    declared = {r.page_id: r.html.split('lang="')[1][:2] for r in pages.collect()}
    plain = pages.selectExpr("page_id", "cast(null as string) url", "regexp_replace(html, '<html[^>]*>', '<html>') html")
    rows = language_id.identify(plain, docs).collect()  # by text alone
    assert sum(r.lang == declared[r.page_id] for r in rows) >= 0.98 * len(rows)


def test_a_block_orders_no_single_words(monkeypatch):
    """Words are numbered as they are read: what is put in order are longer n-grams and different keys."""
    sizes, unique = [], np.unique
    monkeypatch.setattr(lm.np, "unique", lambda x, **k: sizes.append(len(x)) or unique(x, **k))
    text = b"one two three two one " * 200
    block = lm.Block([_Scalar(text), _Scalar(None), _Scalar(b"One x")], 2)
    tokens = 1000 + 1 + 1 + 3
    assert len(block.at) == 2 * tokens + 1 and sum(sizes) <= tokens + 2 * len(block.keys)
    read = lm.Reader()
    words = np.concatenate([read(t) for t in (text, None, b"One x")])
    assert block.keys[block.at[:tokens]].tolist() == lm._mix(np.zeros(1, np.uint64), words).tolist()
