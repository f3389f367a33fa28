"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from namesake import queries
from namesake.session import build_session

HEADLINE = (
    "edition_dimension",
    "shape_and_phonetic_tokens",
    "gram_embedding",
    "cosine_topk",
    "jaccard_topk",
    "token_jaccard_documents",
    "band_window_counts",
    "blocked_candidates",
    "pair_features",
    "vote_mean_entropy",
    "uncertain_topk_antijoin",
    "committee_fit_score",
    "guaranteed_edges_year_bound",
    "connected_components",
    "strange_ratio",
    "resolve_entities",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times, rows = {}, {}
    for name in HEADLINE:
        # Every query starts from the driver tables, not from an earlier one's stages.
        queries.STAGES.clear()
        start = time.time()
        rows[name] = len(queries.QUERIES[name](spark, sf_dir).collect())
        times[name] = round(time.time() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rows": rows,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
