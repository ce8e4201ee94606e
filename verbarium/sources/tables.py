"""The stored dataset: Parquet tables in one folder, written batch by batch."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbarium import schemas

TABLES: dict[str, T.StructType] = {
    "languages": schemas.LANGUAGES,
    "words": schemas.WORDS,
    "verb_forms": schemas.VERB_FORMS,
    "form_index": schemas.FORM_INDEX,
    "rejects": schemas.REJECTS,
    "corrupt": schemas.CORRUPT,
    "users": schemas.USERS,
    "batches": schemas.BATCHES,
}
BATCH = "batch_id"
NOTE = re.compile(rf"/{BATCH}=([0-9]+)/done=true/")
# Tables of an import; their batches count once all of them are written.
IMPORTED = {"languages", "words", "verb_forms", "form_index", "rejects", "corrupt"}


def constant_rows(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A few fixed rows as part of the plan itself, so that reading them starts no job."""
    if not rows:
        nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
        return spark.range(1).filter(F.lit(False)).select(*nulls)
    values, args = [], {}
    for n, row in enumerate(rows):
        cells = []
        for field, value in zip(schema.fields, row):
            # Named, as the order of positional markers is not kept in inline tables.
            args[f"{field.name}{n}"] = value
            cells.append(f"CAST(:{field.name}{n} AS {field.dataType.simpleString()})")
        values.append(f"({', '.join(cells)})")
    names = ", ".join(f"`{name}`" for name in schema.names)
    return spark.sql(f"SELECT * FROM VALUES {', '.join(values)} AS fixed({names})", args=args)


def tenses(spark: SparkSession) -> DataFrame:
    return constant_rows(spark, schemas.TENSES, schemas.TENSE)


def roles(spark: SparkSession) -> DataFrame:
    return constant_rows(spark, schemas.ROLES, schemas.ROLE)


class Store:
    """Tables under ``path``, each split into one folder per batch.

    A batch that is written again replaces its own folders, so a repeated batch changes
    nothing else and leaves no duplicates. Readers see the imports that are noted as finished;
    what a broken one left behind is not read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _folder(self, table: str) -> str:
        return f"{self.path}/{table}"

    def _batches(self, table: str) -> DataFrame:
        schema = T.StructType([*TABLES[table].fields, T.StructField(BATCH, T.LongType())])
        try:
            return self.spark.read.schema(schema).parquet(self._folder(table))
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return constant_rows(self.spark, [], schema)

    def finished(self) -> list[int]:
        """Numbers of the finished imports; a listing of their notes, no job."""
        notes = [NOTE.search(file) for file in self._batches("batches").inputFiles()]
        return sorted({int(note[1]) for note in notes if note})

    def writings(self) -> dict[str, int]:
        """Each finished import's note, which a batch that is written anew gets anew, with its number."""
        notes = [(NOTE.search(file), file) for file in self._batches("batches").inputFiles()]
        return {f"{note[1]}/{file.rsplit('/', 1)[1]}": int(note[1]) for note, file in notes if note}

    def reopen(self, batch: int) -> None:
        """Hide an import until it is finished again."""
        self._note(batch, 0, 0, False)

    def finish(self, batch: int, last_word: int, last_fact: int) -> None:
        """Note that all tables of a batch are written, and where its ids end."""
        self._note(batch, last_word, last_fact, True)

    def _note(self, *values: int | bool) -> None:
        # Whether it is finished shows in the path of the note.
        note = constant_rows(self.spark, [values], schemas.BATCHES)
        note.write.mode("overwrite").parquet(f"{self._folder('batches')}/{BATCH}={values[0]}", partitionBy="done")

    def progress(self, before: int | None = None) -> tuple[int, int, int]:
        """(last finished batch, last word id, last fact id), or (-1, 0, 0)."""
        seen = [batch for batch in self.finished() if before is None or batch < before]
        if not seen:
            return -1, 0, 0
        notes = self._batches("batches").filter(F.col(BATCH) == seen[-1])
        return tuple(notes.select("id", "last_word", "last_fact").first())

    def read(
        self, table: str, before: int | None = None, only: list[int] | None = None
    ) -> DataFrame:
        """A table, or the part of it that batches before ``before``, or ``only`` these, wrote."""
        rows = self._batches(table)
        if only is not None:
            rows = rows.filter(F.col(BATCH).isin(only) if only else F.lit(False))
        if before is not None:
            rows = rows.filter(F.col(BATCH) < before)
        if table in IMPORTED:
            seen = self.finished()
            rows = rows.filter(F.col(BATCH).isin(seen) if seen else F.lit(False))
        return rows.drop(BATCH)

    def read_batch(self, table: str, batch: int) -> DataFrame:
        """What one batch wrote to a table."""
        return self._batches(table).filter(F.col(BATCH) == batch).drop(BATCH)

    def write(self, table: str, df: DataFrame, batch: int) -> None:
        """Write ``df`` as the whole of one batch of a table."""
        columns = [F.col(f.name).cast(f.dataType) for f in TABLES[table].fields]
        folder = f"{self._folder(table)}/{BATCH}={batch}"
        df.select(*columns).write.mode("overwrite").parquet(folder)

    @property
    def languages(self) -> DataFrame:
        return self.read("languages")

    @property
    def words(self) -> DataFrame:
        return self.read("words")

    @property
    def verb_forms(self) -> DataFrame:
        return self.read("verb_forms")

    @property
    def form_index(self) -> DataFrame:
        """Stands in for ``verb_forms`` where a query asks by form for languages and infinitives."""
        return self.read("form_index")

    @property
    def rejects(self) -> DataFrame:
        return self.read("rejects")

    @property
    def corrupt(self) -> DataFrame:
        return self.read("corrupt")

    @property
    def users(self) -> DataFrame:
        return self.read("users")

    @property
    def tenses(self) -> DataFrame:
        return tenses(self.spark)

    @property
    def roles(self) -> DataFrame:
        return roles(self.spark)
