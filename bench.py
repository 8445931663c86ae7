"""Prints one JSON line: seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], each written to the noop sink.

``queries`` has the median of three warm runs, ``cold`` the run before them.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from docquarry.plans import QUERIES
from docquarry.session import session

HEADLINE = ["search_dictionary", "search_bm25", "relations_copies", "relations_shared_lines", "structure_pages", "evidence_quotes", "retrieval_cosine", "table_pricing", "table_star_join", "table_asof", "events_tumbling", "events_sessions"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    cold, took = {}, {}

    def run(name: str) -> float:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.time() - began

    for name in HEADLINE:
        cold[name] = round(run(name), 3)
        took[name] = round(median(run(name) for _ in range(3)), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "cold": cold, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
