"""Plan-shape guards for the scale properties (see PLANS.md)."""

import io
from contextlib import redirect_stdout

from imprint.operators import analytics as AN
from imprint.operators import match as M
from imprint.plans import queries as Q
from tests.conftest import SF001


def _plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_histogram_aggregates_on_the_join(spark):
    fp = Q.stored_fingerprints(spark, SF001)
    text = _plan(AN.distance_histogram(M.match_pairs(fp, shape="broadcast", carry=("image_id",), with_bits=True)))
    lines = text.splitlines()
    partial = next(i for i, ln in enumerate(lines) if "partial_count" in ln)
    join = next(i for i, ln in enumerate(lines) if "BroadcastHashJoin" in ln)
    assert partial < join and not any("Exchange" in ln for ln in lines[partial + 1:join])


def test_block_pair_shape_repartitions_explicitly(spark):
    fp = Q.stored_fingerprints(spark, SF001)
    text = _plan(M.match_pairs(fp, shape="blocks", target_pairs_per_task=1000))
    assert "REPARTITION_BY_NUM" in text and "hashpartitioning(m#" in text


def test_dedup_is_a_hash_aggregate_and_page_filter_is_pushed(spark):
    text = _plan(Q.QUERIES["content_dedup"](spark, SF001))
    assert "HashAggregate" in text and "partial_min" in text and "SortAggregate" not in text
    page = _plan(Q.QUERIES["backlog_page"](spark, SF001))
    assert "TakeOrderedAndProject" in page and "GreaterThanOrEqual(doc_id,500)" in page
