import pytest

from voxtally import constants as K
from voxtally.operators import burnout

COLUMNS = (
    "response_id string, sentiment string, primary_theme string, secondary_themes array<string>, "
    "emotion_tags array<string>, action_signal string"
)


def scored(spark, *rows):
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], COLUMNS)
    return burnout.score(df).orderBy(df["response_id"].cast("int")).collect()


def test_examples(spark):
    rows = scored(
        spark,
        ("very_positive", "team_collaboration", [], ["happy", "motivated"], "positive_share"),
        ("very_negative", "wellbeing_safety", [], ["exhausted", "overwhelmed", "burned out"], "urgent_action"),
        ("negative", "communication", [], [], "monitor"),
        ("negative", "communication", [], [], "urgent_action"),
        ("neutral", "communication", [], [], "no_action"),
    )
    assert [(r["risk_score"], r["risk_level"]) for r in rows] == [
        (0.06, "low"), (0.96, "critical"), (0.41, "medium"), (0.5, "medium"), (0.29, "low"),
    ]
    assert rows[1]["risk_factors"] == [
        "Negative sentiment: very_negative", "High-risk theme: wellbeing_safety",
        "Burnout-correlated emotions detected", "Urgent action signal",
    ]
    assert rows[0]["protective_factors"] == [
        "Positive sentiment baseline", "Protective emotions: motivated",
    ]


def plain(sentiment, primary, secondary, emotions, action):
    """The scoring rules in plain Python."""
    themes = {primary, *secondary}
    theme = 0.9 if themes & set(K.HIGH_RISK_THEMES) else 0.5 if themes & set(K.MEDIUM_RISK_THEMES) else 0.2
    tags = {e.lower() for e in emotions}
    bad, good = len(tags & set(K.BURNOUT_EMOTIONS)), len(tags & set(K.PROTECTIVE_EMOTIONS))
    emotion = max(0.0, min(1.0, bad * 0.35) - min(0.2, good * 0.1))
    parts = (0.4 * K.SENTIMENT_SCORES[sentiment] + 0.3 * theme + 0.2 * emotion
             + 0.1 * (0.9 if action == "urgent_action" else 0.0))
    score = round(min(1.0, max(0.0, parts)), 4)
    return score, next((n for n, c in K.RISK_CUTOFFS.items() if score <= c), "critical")


def test_every_combination(spark):
    emotions = [[], ["Stressed", "stressed"], ["stressed", "anxious"], ["stressed", "anxious", "ignored"],
                ["valued"], ["stressed", "Valued", "engaged", "hopeful"]]
    secondaries = [[], ["career_growth"], ["wellbeing_safety", "career_growth"]]
    rows = [
        (s, t, sec, e, a)
        for s in K.SENTIMENTS for t in K.THEMES for sec in secondaries for e in emotions
        for a in ("urgent_action", "monitor")
    ]
    got = [(r["risk_score"], r["risk_level"]) for r in scored(spark, *rows)]
    assert got == [plain(*r) for r in rows]


def test_secondary_theme_raises_the_score_but_is_no_factor(spark):
    row = scored(spark, ("neutral", "communication", ["wellbeing_safety"], [], "no_action"))[0]
    assert row["risk_score"] == pytest.approx(0.41) and row["risk_factors"] == []


def test_unknown_sentiment_and_order_of_protective(spark):
    row = scored(spark, ("mixed", "other", [], ["Valued", "engaged", "VALUED"], "no_action"))[0]
    assert row["risk_score"] == 0.2
    assert row["protective_factors"] == ["Protective emotions: engaged, valued"]
