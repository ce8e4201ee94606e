"""Imports a generated dump with hot keys and times the steps.

A third of all forms belong to one infinitive and a third of all pages share one title.

Usage: python tools/scale.py [pages] [folder for the dump and the store]
"""

from __future__ import annotations

import os
import sys
import time

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from verbarium.operators import conjugation, quality, words  # noqa: E402
from verbarium.plans.importer import import_dump  # noqa: E402
from verbarium.session import build_session, scratch_path  # noqa: E402
from verbarium.sources.dump import good_pages, read_dump, write_dump  # noqa: E402
from verbarium.sources.tables import Store  # noqa: E402


def generated_pages(spark, count: int):
    n = F.col("id")
    filler = F.repeat(F.lit("Some [[text]] of a dictionary page & a {{l|en|link}} in it.\n"), 15)
    infinitive = F.when(n % 3 == 0, "hot").otherwise(F.concat(F.lit("inf"), n % 100_003))
    title = F.when(n % 3 == 1, "hotform").otherwise(F.concat(F.lit("w"), n))
    template = "{{nl-verb form of|p=%s|n=sg|t=%s|m=ind|"
    text = F.concat(
        F.lit("==English==\n\n===Noun===\n"),
        filler,
        F.lit("\n==Dutch==\n\n===Verb===\n{{nl-verb-form}}\n\n# " + template % (1, "pres")),
        infinitive,
        F.lit("}}\n# " + template % (23, "past")),
        infinitive,
        F.lit("}}\n\n===Notes===\n"),
    )
    # One page in four has a Dutch verb; the others hold no verb at all.
    plain = F.concat(F.lit("==English==\n\n===Noun===\n"), filler)
    return spark.range(0, count * 4, 1, 64).select(
        n.alias("page_id"), title.alias("title"), F.when(n % 4 == 0, text).otherwise(plain).alias("text")
    )


def main() -> None:
    count = int(sys.argv[1]) if len(sys.argv) > 1 else 250_000
    spark = build_session("scale", "local[8]", 64)
    folder = sys.argv[2] if len(sys.argv) > 2 else scratch_path(spark, "scale").removeprefix("file:")
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name: str, work) -> None:
        start = time.time()
        note = work() or ""
        print(f"{name}: {time.time() - start:.1f} s {note}", flush=True)

    def consume(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    pages = generated_pages(spark, count)
    for kind, compression in [("plain", None), ("bz2", "bzip2")]:
        path = f"{folder}/{kind}"
        write_dump(pages, path, compression)
        size = sum(os.path.getsize(f"{path}/{file}") for file in os.listdir(path)) / 1e6
        print(f"{kind} dump: {size:.0f} MB", flush=True)
        timed(f"scan {kind}", lambda p=path: consume(good_pages(read_dump(spark, p))))
        store = Store(spark, f"{folder}/store-{kind}")
        timed(f"import {kind}", lambda s=store, p=path: import_dump(s, p) and None)
    facts, texts = store.verb_forms, store.words
    print(f"{texts.count()} words, {facts.count()} forms", flush=True)
    timed("all words", lambda: consume(words.all_words(facts, texts)))
    timed("infinitives", lambda: consume(words.infinitives(facts, texts)))
    timed("tables", lambda: consume(conjugation.conjugation_tables(facts, texts)))
    timed("slots", lambda: consume(conjugation.conjugation_slots(facts, texts)))
    stored = {"words": texts, "verb_forms": facts, "languages": store.languages, "tenses": store.tenses}
    timed("violations", lambda: quality.violations(stored).count())
    spark.stop()


if __name__ == "__main__":
    main()
