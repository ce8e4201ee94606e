"""Import of dump files as they arrive."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from verbarium.functions import wikitext
from verbarium.operators.rules import RULES, RuleSet
from verbarium.plans.importer import import_decoded
from verbarium.plans.kept import refresh_tables
from verbarium.plans.kept_counts import refresh_counts
from verbarium.sources.dump import decode_chunks, dump_chunk_stream
from verbarium.sources.tables import Store


def incremental_import(
    store: Store,
    folder: str,
    checkpoint: str,
    rules: Mapping[str, RuleSet] = RULES,
    max_files: int | None = None,
    first_batch: int = 0,
    keep_tables: bool = False,
    keep_counts: bool = False,
) -> StreamingQuery:
    """Import all files in ``folder`` that earlier runs with this checkpoint have not seen.

    Each micro-batch is one batch of the store, numbered from ``first_batch`` on. A batch that
    failed half-way is repeated under the same number and replaces what it left behind, so
    every file counts exactly once. Words already known keep their ids. To go on from a bulk
    import, give the number after its last batch, and give the same number in later runs; no
    other import may write to the store in between. ``keep_tables`` brings the kept conjugation
    tables up to date with every batch, ``keep_counts`` the counts for constraint reports.
    """

    def add(chunks: DataFrame, batch: int) -> None:
        pages = decode_chunks(chunks, wikitext.VERB_MARK)
        import_decoded(store, pages, rules, batch=first_batch + batch)
        if keep_tables:
            refresh_tables(store)
        if keep_counts:
            refresh_counts(store)

    chunks = dump_chunk_stream(store.spark, folder, max_files)
    return (
        chunks.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
