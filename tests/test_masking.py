import pytest

from tests.conftest import plan_of, survey
from voxtally.functions import pii
from voxtally.operators import masking
from pyspark.sql import functions as F

CASES = [
    ("My manager reads ida.berg@firm.example too", "My manager reads [EMAIL] too", ["EMAIL"]),
    ("Ring +1 415-555-0199 after lunch", "Ring +[PHONE] after lunch", ["PHONE"]),
    ("call (743) 555-3824 now", "call ([PHONE] now", ["PHONE"]),
    ("Dr. Ann Lee met Mr. Bob", "[PERSON] met [PERSON]", ["PERSON"]),
    ("Dr. Ann Lee", "[PERSON]", ["PERSON"]),
    ("ref ٠١٢٣٤٥٦٧٨٩ end", "ref [PHONE] end", ["PHONE"]),
    ("你好bob@x.com再见", None, []), ("éa@b.co", None, []),
    ("Mr. Élan spoke", None, []), ("Mr. Anné x", None, []),
    ("ts 2024-01-01 1234567", "ts 2024-[PHONE]", ["PHONE"]),
    ("card 4785380592391139", "card [CREDIT_CARD]", ["CREDIT_CARD"]),
    ("Our shifts are planned far better since spring", None, []),
    ("see https://a.org/x on 3 May 2024", None, []),
    ("", None, []), ("   ", None, []),
    ("mail x@y.zz, call 800-555-1234, ask Mrs. Jones", "mail [EMAIL], call [PHONE], ask [PERSON]",
     ["EMAIL", "PHONE", "PERSON"]),
]


def test_patterns(spark):
    rows = masking.mask(survey(spark, [(i, str(i), c[0]) for i, c in enumerate(CASES)]))
    for case, row in zip(CASES, rows.orderBy("pos").collect()):
        assert row["anonymized_text"] == (case[0] if case[1] is None else case[1])
        assert row["pii_types"] == case[2]
        assert row["pii_detected"] == bool(case[2])


def test_null_text(spark):
    row = masking.mask(survey(spark, [(0, "a", None)])).first()
    assert row["anonymized_text"] is None and row["pii_types"] == [] and not row["pii_detected"]


def test_cards_and_ibans(spark):
    cases = [
        ("pay 4111111111111111 now", "pay [CREDIT_CARD] now", ["CREDIT_CARD"]),
        ("pay 4111111111111112 now", "pay 4111111111111112 now", []),
        ("94111111111111111 and 4111111111111111", "94111111111111111 and [CREDIT_CARD]", ["CREDIT_CARD"]),
        ("to DE89370400440532013000 please", "to [IBAN] please", ["IBAN_CODE"]),
        ("GB82WEST12345698765432", "[IBAN]", ["IBAN_CODE"]),
    ]
    rows = masking.mask(
        survey(spark, [(i, str(i), c[0]) for i, c in enumerate(cases)]),
        entities=["CREDIT_CARD", "IBAN_CODE"],
    ).orderBy("pos").collect()
    assert [(r["anonymized_text"], r["pii_types"]) for r in rows] == [(c[1], c[2]) for c in cases]


@pytest.mark.parametrize("zero", ["٠", "०", "０", "𝟎"])
def test_digits_of_other_scripts(spark, zero):
    def written(text):
        return "".join(chr(ord(zero) + int(c)) if c.isdigit() else c for c in text)

    cases = [
        (f"pay {written('4785380592391139')} now", "pay [CREDIT_CARD] now"),
        (f"pay {written('12345678901234567')} now", None), (f"pay {written('1234567890123')}x now", None),
        (f"to DE{written('89')}370400440532013000 please", "to [IBAN] please"),
    ]
    rows = masking.mask(
        survey(spark, [(i, str(i), c[0]) for i, c in enumerate(cases)]), entities=["CREDIT_CARD", "IBAN_CODE"]
    ).orderBy("pos").collect()
    assert [r["anonymized_text"] for r in rows] == [c[1] or c[0] for c in cases]
    assert masking.mask(survey(spark, [(0, "a", cases[0][0])])).first()["pii_detected"]


def test_cards_before_phones(spark):
    row = masking.mask(survey(spark, [(0, "a", "n 4222222222222 x")]), entities=masking.EVERYTHING).first()
    assert row["anonymized_text"] == "n [CREDIT_CARD] x"


@pytest.mark.parametrize("entity,mask", [
    ("EMAIL_ADDRESS", "[EMAIL]"), ("EMAIL", "[EMAIL]"), ("IBAN_CODE", "[IBAN]"), ("US_SSN", "[US_SSN]"),
])
def test_placeholders(spark, entity, mask):
    assert spark.range(1).select(pii.placeholder(F.lit(entity))).first()[0] == mask


def test_masked_table_columns(sample):
    from voxtally.schemas import MASKED_FIELDS

    assert masking.masked_table(sample).columns == MASKED_FIELDS


def test_each_pattern_once_in_the_plan(spark):
    from voxtally.plans.views import survey_raw

    from tests.conftest import SMALL

    plan = plan_of(masking.mask(survey_raw(spark, SMALL)).select(
        "response_id", "anonymized_text", "pii_types"
    ))
    assert plan.count("regexp_replace(") == 5
    assert "Python" not in plan
