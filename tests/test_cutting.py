"""Word lists and cuts of runs without spaces, against plain counting and all possible cuts."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings, strategies as st

from tests.conftest import survey
from voxtally.operators import cutting, labelling, synth


def all_cuts(run):
    if not run:
        yield []
    for size in range(1, len(run) + 1):
        for rest in all_cuts(run[size:]):
            yield [run[:size], *rest]


def worth(words, weights, unknown):
    return sum(weights.get(w, unknown if len(w) == 1 else -math.inf) for w in words)


@settings(max_examples=300, deadline=None)
@given(st.text("甲乙丙", min_size=1, max_size=9), st.dictionaries(
    st.text("甲乙丙丁", min_size=1, max_size=4), st.floats(-9, -0.1), max_size=12))
def test_the_best_of_all_cuts(run, weights):
    places = {(i, n): weights[run[i : i + n]] for i in range(len(run)) for n in range(1, 5)
              if i + n <= len(run) and run[i : i + n] in weights}
    cut = cutting.best_cut(run, places, -10.0)
    best = max(worth(c, weights, -10.0) for c in all_cuts(run))
    assert "".join(cut) == run and worth(cut, weights, -10.0) == pytest.approx(best)


def slow_words(found, longest, least, cohesion, freedom):
    counts, before, after = Counter(), defaultdict(Counter), defaultdict(Counter)
    for run, n in found:
        for i in range(len(run)):
            for k in range(1, min(longest, len(run) - i) + 1):
                gram = run[i : i + k]
                counts[gram] += n
                before[gram][run[i - 1 : i]] += n
                after[gram][run[i + k : i + k + 1]] += n
    total = sum(n for g, n in counts.items() if len(g) == 1)

    def entropy(c):
        size = sum(c.values())
        return -sum(n / size * math.log(n / size) for n in c.values())

    kept = {
        g: n for g, n in counts.items() if len(g) == 1 or (
            n >= least and min(entropy(before[g]), entropy(after[g])) >= freedom - 1e-7
            and min(math.log(n * total / counts[g[:j]] / counts[g[j:]]) for j in range(1, len(g))) >= cohesion - 1e-7
        )
    }
    share = sum(kept.values())
    return {g: (n, round(math.log(n / share), 6)) for g, n in kept.items()}


def test_words_against_plain_counts(spark):
    rng = random.Random(3)
    vocabulary = ["工作", "压力", "很大", "团队", "我", "的", "是", "经理", "公司", "发展"]
    texts = ["".join(rng.choices(vocabulary, k=rng.randrange(1, 8))) + "，" + rng.choice(vocabulary) for _ in range(200)]
    texts += [None, "", "only latin", "甲"] + ["压力很大"] * 40  # a hot run
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = cutting.runs(df)
    counted = Counter(r for t in texts if t for r in re.findall(r"[一-鿿]+", t))
    assert {r["run"]: r["n"] for r in found.collect()} == counted
    got = {r["word"]: (r["n"], r["weight"]) for r in cutting.learn_words(found).collect()}
    assert got == slow_words(counted.items(), 4, 3, 1.5, 0.6)
    assert {"团队", "经理", "公司", "发展", "工作"} <= got.keys()
    assert cutting.learn_words(found.limit(0)).collect() == []


def test_chinese_answers_get_words_themes_and_phrases(spark):
    answers = synth.dataset(spark, 1500).filter("language = 'zh'").select("response_id", "text")
    own = survey(spark, [(0, "x", "我对工作量不满，team 团队很好。"), (1, "y", "no Han here")]).select("response_id", "text")
    df = answers.unionByName(own)
    words = cutting.learn_words(cutting.runs(df))
    cut = cutting.with_cut_tokens(df, "response_id", words).cache()
    assert cut.count() == df.count()
    rows = {r["response_id"]: r["tokens"] for r in cut.collect()}
    assert rows["y"] == ["no", "han", "here"]
    assert "团队" in rows["x"] and "team" in rows["x"] and "".join(rows["x"]) == "我对工作量不满team团队很好"
    themed = labelling.themes(labelling.with_hits(cut)).collect()
    found = Counter(r["primary_theme"] for r in themed)
    assert found["team_collaboration"] > 10 and found["wellbeing_safety"] > 10
    phrases = labelling.key_phrases(cut, "response_id", cut=True).collect()
    assert {"团队", "健康", "包容"} <= {r["phrase"] for r in phrases}
    assert any(r["response_id"].startswith("zh") for r in phrases)


def test_texts_without_runs_are_not_joined(spark):
    df = spark.createDataFrame([(1, None), (2, "plain words"), (3, "")], "id int, text string")
    words = cutting.learn_words(cutting.runs(df))
    got = {r["id"]: r["tokens"] for r in cutting.with_cut_tokens(df, "id", words).collect()}
    assert got == {1: None, 2: ["plain", "words"], 3: []}
