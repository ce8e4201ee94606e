"""Times the headline queries and prints one JSON line.

Settings: BENCH_SF_DIR (folder of the test tables), BENCH_CPUS, BENCH_RUNS (median is reported).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from verbarium.plans import catalog  # noqa: E402
from verbarium.plans.importer import import_dump, import_pages  # noqa: E402
from verbarium.plans.wikitext_view import wikitext_pages  # noqa: E402
from verbarium.session import build_session, scratch_path  # noqa: E402
from verbarium.sources.tables import Store  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINES = [
    catalog.templates,
    catalog.morphology,
    catalog.verb_forms,
    catalog.word_list,
    catalog.reject_counts,
    catalog.page_limit,
    catalog.dump_scan,
    catalog.dump_scan_bz2,
    catalog.all_words,
    catalog.words_by_id,
    catalog.word_by_id,
    catalog.infinitive_of,
    catalog.infinitive_lookups,
    catalog.lookup_missing,
    catalog.lookup_default,
    catalog.person_slots,
    catalog.conjugation_table,
    catalog.conjugation_of_word,
    catalog.conjugation_flat,
    catalog.conjugation_json,
    catalog.users,
    catalog.admin_flag,
    catalog.new_accounts,
    catalog.rejected_accounts,
    catalog.uniqueness,
    catalog.orphans,
    catalog.constraint_report,
]


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def median_time(work) -> float:
    times = []
    for _ in range(RUNS):
        start = time.perf_counter()
        work()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times), 3)


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", CPUS)
    spark.sparkContext.setLogLevel("ERROR")

    def fresh() -> Store:
        return Store(spark, scratch_path(spark, "bench-store"))

    timings = {
        "import_pages": median_time(lambda: import_pages(fresh(), wikitext_pages(spark, SF_DIR))),
    }
    dump = catalog.dump_for(spark, SF_DIR)
    timings["import_dump"] = median_time(lambda: import_dump(fresh(), dump))
    # The remaining queries read a store and dumps that exist already.
    catalog.store_for(spark, SF_DIR)
    catalog.dump_for(spark, SF_DIR, "bzip2")
    for query in HEADLINES:
        timings[query.__name__] = median_time(lambda q=query: consume(q(spark, SF_DIR)))
    result = {
        "metric": "total_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
