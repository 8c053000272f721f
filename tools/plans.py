"""Write PLANS.md: the physical plans of the key queries (``explain()``), for review.

usage: python tools/plans.py [sf_dir]
"""

import io
import os
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from imprint.operators import analytics as AN  # noqa: E402
from imprint.operators import match as M  # noqa: E402
from imprint.plans import queries as Q  # noqa: E402
from imprint.session import build_session  # noqa: E402

NOTES = {
    "fingerprints": "One scan of embeddings; grids, variants, digest and both hash kernels in one "
                    "projection (ArrowEvalPython batches the two numpy kernels); the only shuffle is the "
                    "first-writer aggregate on (digest, method), partial before the exchange.",
    "match_pairs (broadcast shape)": "Probe side spread round-robin; build side broadcast after a row-count "
                                     "check; distance computed in the join's codegen stage.",
    "match_pairs (block-pair shape)": "Both sides replicated to block pairs and repartitioned on (m, bi, bj) "
                                      "with a fixed count; the join needs no further exchange (when the build "
                                      "side is small the planner may still broadcast it).",
    "distance_histogram": "Partial aggregate directly on the join output: pairs never leave the stage.",
    "content_dedup": "Hash aggregate min(doc_id) per digest with map-side partial aggregation; only doc_id and "
                     "text are read.",
    "fk_orphans": "Anti-joins on key columns only; the parent side is pruned to its key.",
    "backlog_page": "Range filter pushed to the Parquet scan; TakeOrderedAndProject for the page.",
}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session(8)
    fp = Q.stored_fingerprints(spark, sf)
    frames = {
        "fingerprints": Q.QUERIES["fingerprints"](spark, sf),
        "match_pairs (broadcast shape)": M.match_pairs(fp, shape="broadcast"),
        "match_pairs (block-pair shape)": M.match_pairs(fp, shape="blocks", target_pairs_per_task=1_000_000),
        "distance_histogram": AN.distance_histogram(M.match_pairs(fp, carry=("image_id",), with_bits=True)),
        "content_dedup": Q.QUERIES["content_dedup"](spark, sf),
        "fk_orphans": Q.QUERIES["fk_orphans"](spark, sf),
        "backlog_page": Q.QUERIES["backlog_page"](spark, sf),
    }
    out = ["# Physical plans of key queries\n",
           f"Generated by `tools/plans.py` at `{sf}` on local[8] (`explain()`; AQE may re-plan at run time).\n"]
    for name, df in frames.items():
        buf = io.StringIO()
        with redirect_stdout(buf):
            df.explain()
        out.append(f"## {name}\n\n{NOTES[name]}\n\n```\n{buf.getvalue().strip()}\n```\n")
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as fh:
        fh.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
