"""Wall time of the headline queries; prints one JSON line.

The driver's tables are one file with one row group each, which Spark reads as one task. Before timing, the text tables
are laid out anew in as many files as there are cores, as a table of any size would lie; the JSON line says so.
"""

import glob
import json
import os
import time

from lexweave.plans import load_all
from lexweave.plans.registry import QUERIES
from lexweave.scale import scratch_path
from lexweave.session import build_session

HEADLINE = [
    "agg1_postings", "agg1_term_stats", "ret1_bm25_topk", "top2_vector_topk", "ret6_hybrid", "ret8_multi_query_vote",
    "ret9_tool_search", "ret10_service_search", "win1_token_windows", "gr2_pagerank", "gr5_statistics", "agg8_event_summary",
    "agg11_confusion", "stm3_session_windows", "stm4_phases", "str9_strip_html", "str20_apply_issues", "win10_resolve_overlaps",
    "join12_box_overlaps", "agg21_duplicate_ids", "win9_near_duplicates", "stm7_incremental_terms",
]


TEXT_TABLES = ("documents", "pages", "conversations")


def laid_out(spark, sf_dir: str, files: int) -> str:
    """A folder with the tables of sf_dir, the text tables in `files` files each."""
    out = scratch_path(spark, "bench")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)
        df = spark.read.parquet(path)
        (df.repartition(files) if name.removesuffix(".parquet") in TEXT_TABLES else df).write.parquet(f"{out}/{name}")
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", cpus, **{
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    tables = laid_out(spark, sf_dir, cpus)
    times: dict[str, float] = {}
    for name in os.environ.get("BENCH_ONLY", "").split() or HEADLINE:
        start = time.perf_counter()
        # The noop sink computes every row and column without moving them to the driver.
        QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "layout": f"text tables in {cpus} files"}))
    spark.stop()


if __name__ == "__main__":
    main()
