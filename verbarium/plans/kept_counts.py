"""Value counts that are kept beside the tables, so that a constraint report reads no facts.

Each batch's languages, words and facts are counted once, by themselves. The counts lie in a folder
per writing of a batch, so those of a batch that is written anew are replaced and the others stay.
A report adds the counts up.

Ids of facts, which nothing refers to, would be as many as the facts. A batch's ids lie between the
last fact of the batch before and its own, so an id in there can only clash within the batch. Kept
are the ids that do, and those that lie elsewhere; only if there are any, they are counted in the facts.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbarium import schemas
from verbarium.operators.quality import constrained, value_counts, violations_in
from verbarium.plans.kept import read_kept
from verbarium.sources.tables import Store, constant_rows

TABLES = ("languages", "words", "verb_forms")
COUNTS = T.StructType(
    [
        T.StructField("table", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("writing", T.StringType()),
    ]
)
COVERED = T.StructType([T.StructField("writings", T.StringType())])


def _folder(store: Store) -> str:
    return f"{store.path}/constraint_counts"


def _covered(store: Store) -> set[str]:
    notes = read_kept(store, f"{_folder(store)}_covered", COVERED).collect()
    return {name for note in notes for name in note["writings"].split(",") if name}


def _name(note: str) -> str:
    """The name of a writing as part of a path."""
    return note.replace("/", "-").split(".")[0]


def batch_counts(store: Store, batch: int) -> DataFrame:
    """(table, column, value, n_rows) of what one batch wrote."""
    # Constraints between all tables, as the report may cover any of them.
    columns = constrained(schemas.UNIQUE)
    parts = []
    for table in TABLES:
        rows, (keys, required) = store.read_batch(table, batch), columns[table]
        counts = value_counts(rows, [c for c in keys if (table, c) != ("verb_forms", "id")], required)
        parts.append(counts.select(F.lit(table).alias("table"), "*"))
    ids = store.read_batch("verb_forms", batch).where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n_rows"))
    before, own = store.progress(before=batch)[2], store.progress(before=batch + 1)[2]
    odd = ids.where((F.col("n_rows") > 1) | (F.col("id") <= before) | (F.col("id") > own))
    parts.append(odd.select(F.lit("verb_forms").alias("table"), F.lit("id").alias("column"), F.col("id").cast("string").alias("value"), "n_rows"))
    return reduce(DataFrame.unionByName, parts)


def refresh_counts(store: Store) -> list[int]:
    """Count the finished batches that are not counted yet; returns their numbers.

    The note comes last: a refresh that breaks off is repeated, into the same folders.
    """
    finished = {_name(note): batch for note, batch in store.writings().items()}
    covered = _covered(store)
    fresh = {name: batch for name, batch in finished.items() if name not in covered}
    for name, batch in fresh.items():
        batch_counts(store, batch).write.mode("overwrite").parquet(f"{_folder(store)}/writing={name}")
    if fresh or covered != set(finished):
        note = constant_rows(store.spark, [(",".join(sorted(finished)),)], COVERED)
        note.write.mode("overwrite").parquet(f"{_folder(store)}_covered")
    return sorted(fresh.values())


def kept_violations(store: Store, others: Mapping[str, DataFrame]) -> DataFrame:
    """The report of ``quality.violations`` on the store as of the last refresh, from the counts.

    ``others`` are the tables that imports do not write, such as tenses, roles and users.
    """
    covered = sorted(_covered(store))
    stored = read_kept(store, _folder(store), COUNTS)
    stored = stored.where(F.col("writing").isin(covered) if covered else F.lit(False))
    summed = stored.groupBy("table", "column", "value").agg(F.sum("n_rows").alias("n_rows"))
    counts = {table: summed.where(F.col("table") == table).drop("table") for table in TABLES}
    fact_id = F.col("column") == "id"
    odd = stored.where((F.col("table") == "verb_forms") & fact_id & F.col("value").isNotNull())
    if not odd.isEmpty():
        ids = odd.select(F.col("value").cast("long").alias("id")).distinct()
        facts = store.read("verb_forms", only=sorted({int(name.split("-")[0]) for name in covered}))
        exact = facts.join(ids, "id", "left_semi").groupBy("id").agg(F.count("*").alias("n_rows"))
        exact = exact.select(F.lit("id").alias("column"), F.col("id").cast("string").alias("value"), "n_rows")
        rest = counts["verb_forms"].where(~fact_id | F.col("value").isNull())
        counts["verb_forms"] = rest.unionByName(exact)
    columns = constrained([*TABLES, *others])
    counts |= {table: value_counts(rows, *columns[table]) for table, rows in others.items() if table in columns}
    return violations_in(counts)
