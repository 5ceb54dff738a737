"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
Each query is run once to warm up on the smallest tables, then timed over all its rows.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "join2_receipt_view", "pre8_all_filters", "sort2_largest_first", "agg1_totals", "job1_search_page",
    "src13_csv_export", "job16_file_list", "join12_file_with_children", "exp17_references",
    "join5_duplicate_receipts", "job2_all_checks", "job3_flags_from_problems", "pre15_acceptance_gate",
    "job4_register_uploads", "job7_store_receipts", "job12_cascade_delete", "join7_category_uses",
    "num3_amounts_in_lines", "dat1_printed_dates", "join13_line_labels", "src6_delimited_cells",
    "job5_sheet_receipts", "job6_page_receipts", "win6_text_tables", "win14_words_to_lines",
    "job8_learned_labels", "job9_apply_learned", "job13_disagreements_as_text", "job14_reader_benchmark",
    "job17_tagged_questions", "job17_answered_questions", "stm3_latest_status", "stm7_status_counts",
]


def main() -> None:
    from billmill.plans.catalog import QUERIES
    from billmill.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores=cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    small = "/root/testdata/sf0.001"

    def run(name: str, where: str) -> float:
        start = time.perf_counter()
        QUERIES[name].build(spark, where).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in names:
        if os.path.isdir(small):
            run(name, small)
        times[name] = round(run(name, sf_dir), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "receipt_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
