"""Conjugation tables that are kept beside the facts and follow the imports.

The tables lie in partitions of ``BLOCK`` infinitives. A refresh looks at the batches that are new
since the last one, makes the tables of the blocks they touch anew, from the facts of those blocks
only, and replaces these partitions. The rest stays as it is.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbarium.functions.inflection import SLOTS
from verbarium.operators.conjugation import TENSE_FIELDS, conjugation_tables
from verbarium.operators.words import infinitive_id
from verbarium.sources.tables import Store, constant_rows

BLOCK = 4096

_FORMS = T.StructType([T.StructField(slot, T.ArrayType(T.StringType())) for slot in SLOTS])
TABLE = T.StructType(
    [
        T.StructField("inf_id", T.LongType()),
        T.StructField("Infinitive", T.StringType()),
        *[T.StructField(tense, _FORMS) for tense in TENSE_FIELDS],
        T.StructField("block", T.LongType()),
    ]
)
UPTO = T.StructType([T.StructField("batches", T.StringType())])


def block_of(inf_id: Column) -> Column:
    return F.floor(inf_id / BLOCK)


def _tables(store: Store) -> str:
    return f"{store.path}/conjugation_tables"


def read_kept(store: Store, path: str, schema: T.StructType) -> DataFrame:
    """A table beside the store's own; empty before its first writing."""
    try:
        return store.spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return constant_rows(store.spark, [], schema)


def kept_tables(store: Store) -> DataFrame:
    """inf_id, Infinitive, Present, Past as of the last refresh; see ``conjugation_tables``."""
    return read_kept(store, _tables(store), TABLE).drop("block")


def kept_table(store: Store, word: str) -> DataFrame:
    """The kept table of the infinitive that ``word`` is a form of; empty for an unknown word.

    Two small lookups name the infinitive; then one partition is read.
    """
    target = infinitive_id(store.form_index, store.words, word)
    tables = read_kept(store, _tables(store), TABLE)
    if target is None:
        return tables.drop("block").limit(0)
    return tables.filter((F.col("block") == target // BLOCK) & (F.col("inf_id") == target)).drop("block")


def refresh_tables(store: Store) -> list[int]:
    """Bring the kept tables up to the finished batches; returns the batches that were new.

    What a refresh covers is noted by batch and writing, so a batch that was written anew, whose
    old facts may have touched other blocks, leads to all tables being made again. The note comes
    last: a refresh that breaks off is repeated.
    """
    notes = f"{store.path}/conjugation_tables_upto"
    known = [row["batches"].split(",") for row in read_kept(store, notes, UPTO).collect()]
    covered = {note for note in (known[0] if known else []) if note}
    finished = store.writings()
    fresh = {batch: note for note, batch in finished.items() if note not in covered}
    if not fresh and covered == set(finished):
        return []
    facts = store.verb_forms
    anew = not covered or not covered <= set(finished)
    if not anew:
        new_facts = store.read("verb_forms", only=sorted(fresh))
        touched = new_facts.select(block_of(F.col("inf_id")).alias("block")).distinct()
        low, high = new_facts.agg(F.min("inf_id"), F.max("inf_id")).first()
        # As constants the bounds skip files; at most one row per block remains to be joined.
        low, high = (0, -1) if low is None else (low // BLOCK * BLOCK, (high // BLOCK + 1) * BLOCK - 1)
        near = facts.filter(F.col("inf_id").between(low, high))
        facts = near.withColumn("block", block_of(F.col("inf_id"))).join(touched, "block", "left_semi").drop("block")
    tables = conjugation_tables(facts, store.words).withColumn("block", block_of(F.col("inf_id")))
    tables = tables.select(*[F.col(f.name).cast(f.dataType) for f in TABLE.fields])
    mode = "static" if anew else "dynamic"
    laid_out = tables.repartition("block").sortWithinPartitions("block", "inf_id")
    laid_out.write.mode("overwrite").option("partitionOverwriteMode", mode).parquet(_tables(store), partitionBy="block")
    note = constant_rows(store.spark, [(",".join(sorted(finished)),)], UPTO)
    note.write.mode("overwrite").parquet(notes)
    return sorted(fresh)
