"""Every query of the subpackage over the smallest test tables, with its columns."""

import pytest

from spanloom.llm.queries import ORACLE, QUERIES
from tests.conftest import SMALL

COLUMNS = {
    "p1_found": ["delivery_id", "defect"], "p3_found": ["session_id", "defect"], "p6_found": ["src", "row_id", "pii_type"], "p8_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "lang"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert name not in COLUMNS or df.columns == COLUMNS[name]
    rows = df.collect()
    assert rows and (not name.endswith("_found") or len(set(rows)) == len(rows))


def test_values(spark):
    assert {r.defect for r in QUERIES["p1_found"](spark, SMALL).collect()} <= {"empty", "truncated", "refusal", "copied", "wrong_language"}
    assert {r.pii_type for r in QUERIES["p6_found"](spark, SMALL).collect()} <= {"EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "PERSON"}
    assert {r.lang for r in QUERIES["p10_found"](spark, SMALL).collect()} <= {"en", "de", "fr", "es", "pt", "nl", "ru"}
    assert set(ORACLE) <= set(QUERIES)


def test_shares_are_near_their_targets(spark):
    shares = QUERIES["p9_shares"](spark, "/root/testdata/sf0.01").collect()
    assert all(abs(r.actual_share - r.target_share) < 0.01 and r.repeats <= r.max_repeats for r in shares)
