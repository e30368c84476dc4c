import json

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from tests.conftest import plan_of, survey
from voxtally import constants as K
from voxtally.operators import validate


def errors(spark, rows):
    lines = validate.error_lines(validate.check_rows(survey(spark, rows)))
    return [r["error"] for r in lines.orderBy("pos", "err_ord").collect()]


def json_errors(spark, *records):
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)]
    checked = validate.check_json(spark.createDataFrame(rows, "pos long, record string"))
    return [r["error"] for r in validate.error_lines(checked).orderBy("pos", "err_ord").collect()]


def test_sample_passes(sample):
    row = validate.summary(validate.check_rows(sample)).first()
    assert row.asDict() == {"valid_count": 3, "invalid_count": 0, "pass_rate": 1.0}


def test_each_rule(spark):
    assert errors(spark, [
        (0, None, None), (1, "a", ""), (2, "b", " " * 5), (3, "c", "x" * 5001), (4, None, "Valid text"),
    ]) == [
        f"Record 0 [?]: ('response_id',) — {K.MSG_MISSING}",
        f"Record 0 [?]: ('text',) — {K.MSG_MISSING}",
        f"Record 1 [a]: ('text',) — {K.MSG_SHORT}",
        f"Record 2 [b]: ('text',) — {K.MSG_BLANK}",
        f"Record 3 [c]: ('text',) — {K.MSG_LONG}",
        f"Record 4 [?]: ('response_id',) — {K.MSG_MISSING}",
    ]


def test_length_before_stripping_and_odd_blanks(spark):
    checked = validate.check_rows(survey(spark, [
        (0, "a", "  ab  "), (1, "b", "​" * 5), (2, "", "good text"),
        (3, "c", "\x1c hello　\n"), (4, "d", "\x1c\x1d\x1e\x1f\x85"), (5, "e", "x" * 5000),
    ]))
    kept = {r["response_id"]: r["text"] for r in validate.valid(checked).collect()}
    assert kept == {"a": "ab", "b": "​" * 5, "": "good text", "c": "hello", "e": "x" * 5000}
    assert [r["response_id"] for r in validate.invalid(checked).collect()] == ["d"]


def test_json_tells_missing_null_and_number_apart(spark):
    good = {"response_id": "a", "text": "long enough"}
    assert json_errors(
        spark, {}, {"response_id": 1, "text": None}, {**good, "department": 3},
        {**good, "department": None, "extra": 1}, {"response_id": True, "text": " " * 6},
    ) == [
        f"Record 0 [?]: ('response_id',) — {K.MSG_MISSING}",
        f"Record 0 [?]: ('text',) — {K.MSG_MISSING}",
        f"Record 1 [1]: ('response_id',) — {K.MSG_NOT_STRING}",
        f"Record 1 [1]: ('text',) — {K.MSG_NOT_STRING}",
        f"Record 2 [a]: ('department',) — {K.MSG_NOT_STRING}",
        f"Record 4 [True]: ('response_id',) — {K.MSG_NOT_STRING}",
        f"Record 4 [True]: ('text',) — {K.MSG_BLANK}",
    ]


def test_half_and_empty(spark):
    half = validate.check_rows(survey(spark, [(0, "a", "Valid text here"), (1, "b", "")]))
    assert validate.summary(half).first()["pass_rate"] == 0.5
    none = validate.check_rows(survey(spark, []))
    assert validate.summary(none).first().asDict() == {
        "valid_count": 0, "invalid_count": 0, "pass_rate": 0.0,
    }


def test_gate(spark, sample):
    assert validate.require_valid(validate.check_rows(sample)).count() == 3
    bad = validate.check_rows(survey(spark, [(i, f"x{i}", "") for i in range(30)]))
    with pytest.raises(validate.NoValidRecords) as raised:
        validate.require_valid(bad)
    assert len(raised.value.errors) == 20
    assert raised.value.errors[0] == f"Record 0 [x0]: ('text',) — {K.MSG_SHORT}"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.one_of(st.none(), st.text(max_size=12)), min_size=1, max_size=20))
def test_rules_agree_with_plain_python(spark, texts):
    texts = [t if t is None else t.replace("\x00", "").encode("utf-8", "ignore").decode() for t in texts]
    checked = validate.split(validate.check_rows(survey(
        spark, [(i, str(i), t) for i, t in enumerate(texts)]
    ))).orderBy("pos").collect()
    for text, row in zip(texts, checked):
        ok = text is not None and len(text) >= 5 and bool(text.strip())
        assert (row["split"] == "valid") == ok
        if ok:
            assert row["text"] == text.strip()


def test_one_scan_no_python(spark):
    from voxtally.plans.queries import QUERIES

    from tests.conftest import SMALL

    for name in ("validate_rows", "validate_errors", "validate_summary"):
        plan = plan_of(QUERIES[name](spark, SMALL))
        assert plan.count("FileScan") == 1, name
        assert "Python" not in plan
