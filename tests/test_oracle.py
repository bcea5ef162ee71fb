"""One query per family against its SQL; `python -m workload.check <dir>` runs them all."""

import pytest

from workload.check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
NAMES = (
    "rate_burst id_sweep machine_rhythm pattern_agg attach_continuations exact_dupe near_dupe clean_rows link_utm scoreboard_join "
    "score_answers regression_compare split_compare bm25_topk hit_terms page_findings broken_link jargon board_findings boundary_cases "
    "scaffold_findings metric_ratchet"
).split()


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    ok, rows, note = compare(spark, db, name, SF_DIR)
    assert ok, note
    assert not note, note
