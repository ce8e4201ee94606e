"""The store's constraints as reports of what violates them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbarium import schemas


def null_violations(rows: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """(table, column, n_rows) for required columns with nulls; one pass over the table."""
    counts = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    per_column = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_rows")) for c in columns]
    )
    return (
        counts.select(F.inline(per_column))
        .filter(F.col("n_rows") > 0)
        .select(F.lit(table).alias("table"), "column", "n_rows")
    )


def duplicate_keys(rows: DataFrame, table: str, column: str) -> DataFrame:
    """(table, column, value, n_rows) for values that occur more than once; nulls never clash."""
    return (
        rows.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("string").alias("value"))
        .agg(F.count("*").alias("n_rows"))
        .filter(F.col("n_rows") > 1)
        .select(F.lit(table).alias("table"), F.lit(column).alias("column"), "value", "n_rows")
    )


def orphans(rows: DataFrame, table: str, column: str, parents: DataFrame, key: str) -> DataFrame:
    """(table, column, value, n_rows) for references without a parent row.

    References are counted per value first: the join then sees each value once, however many
    rows share it.
    """
    used = (
        rows.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias(key))
        .agg(F.count("*").alias("n_rows"))
    )
    return used.join(parents.select(key), key, "left_anti").select(
        F.lit(table).alias("table"),
        F.lit(column).alias("column"),
        F.col(key).cast("string").alias("value"),
        "n_rows",
    )


def constrained(tables: Iterable[str]) -> dict[str, tuple[list[str], list[str]]]:
    """Per table with constraints its key columns (unique ones, references, ids that these name)
    and its required columns, as far as ``tables`` are there."""
    tables = list(tables)
    foreign = {(t, c): p for (t, c), p in schemas.FOREIGN.items() if t in tables and p in tables}
    linked = set(foreign) | {(p, "id") for p in foreign.values()}
    found = {}
    for table in tables:
        unique, required = schemas.UNIQUE.get(table, []), schemas.REQUIRED.get(table, [])
        keys = [*unique, *(c for t, c in sorted(linked) if t == table and c not in unique)]
        if keys or required:
            found[table] = keys, required
    return found


def violations(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All violations of the constraints on the given tables, one row each.

    Every table is read and aggregated once (``value_counts``).
    """
    return violations_in({table: value_counts(tables[table], *columns) for table, columns in constrained(tables).items()})


def violations_in(counts: Mapping[str, DataFrame]) -> DataFrame:
    """The violations in tables that are known by their ``value_counts``.

    The values of references and of the ids that they name meet, each once; a reference that
    meets no id is lost. The other violations, which are few, go along.
    """
    foreign = {(t, c): p for (t, c), p in schemas.FOREIGN.items() if t in counts and p in counts}
    linked = set(foreign) | {(p, "id") for p in foreign.values()}
    reports = []
    for table, values in counts.items():
        unique = schemas.UNIQUE.get(table, [])
        missing = F.col("value").isNull()
        repeated = F.col("column").isin(unique) & (F.col("n_rows") > 1)
        parents = {c: foreign.get((table, c), table) for t, c in sorted(linked) if t == table}
        cells = [F.struct(F.when(missing, "not null").when(repeated, "unique").alias("constraint"), F.lit(None).cast("string").alias("parent"))]
        if parents:
            parent = F.element_at(F.create_map(*[F.lit(x) for pair in parents.items() for x in pair]), F.col("column"))
            used = F.when(~missing & F.col("column").isin(list(parents)), "reference")
            cells.append(F.struct(used.alias("constraint"), parent.alias("parent")))
        shown = F.filter(F.array(*cells), lambda cell: cell["constraint"].isNotNull())
        reports.append(values.select(F.lit(table).alias("table"), "column", "value", "n_rows", F.inline(shown)))
    if not reports:
        raise ValueError("none of the tables has constraints")
    # A group of references holds a count per column that refers to the parent, and one of its id.
    found = reduce(DataFrame.unionByName, reports).groupBy("constraint", "parent", "value").agg(
        F.collect_list(F.struct("table", "column", "n_rows")).alias("cells")
    )
    known = F.exists("cells", lambda cell: (cell["table"] == F.col("parent")) & (cell["column"] == "id"))
    kept = F.when((F.col("constraint") != "reference") | ~known, F.col("cells"))
    return found.select("constraint", "value", F.inline(kept)).select("constraint", "table", "column", "value", "n_rows")


def value_counts(rows: DataFrame, keys: list[str], required: list[str]) -> DataFrame:
    """(column, value, n_rows) for the values of ``keys``, and with a null value for those of
    ``required`` that have nulls.

    One pass with a grouping set per key, in the keys' own types; counts combine before the
    shuffle, so a value that very many rows share weighs no more than another. Columns that only
    must not be null are counted in the set of all rows.
    """
    nulls = [F.count_if(F.col(c).isNull()).alias(f"_null{n}") for n, c in enumerate(required)]
    if not keys:
        counts = rows.agg(*nulls).select("*", F.lit(0).alias("_set"), F.lit(0).alias("_n"))
        sets, text = {}, F.lit(None).cast("string")
    else:
        counts = rows.groupingSets([*[[c] for c in keys], []], *keys).agg(F.count("*").alias("_n"), F.grouping_id().alias("_set"), *nulls)
        # A bit per key, the first one highest, is set where the key is not in the set.
        whole = (1 << len(keys)) - 1
        sets = {whole - (1 << (len(keys) - 1 - n)): c for n, c in enumerate(keys)}
        text = F.coalesce(*[F.col(c).cast("string") for c in keys])
        counts = counts.select("_set", "_n", text.alias("_text"), *[f"_null{n}" for n in range(len(required))])
    column = F.lit(None).cast("string")
    for number, c in sets.items():
        column = F.when(F.col("_set") == number, c).otherwise(column)
    cells = [F.struct(column.alias("column"), (F.col("_text") if sets else text).alias("value"), F.col("_n").cast("long").alias("n_rows"))]
    cells = F.filter(F.array(*cells), lambda cell: cell["value"].isNotNull())
    if required:
        missing = F.array(
            *[F.struct(F.lit(c).alias("column"), F.lit(None).cast("string").alias("value"), F.col(f"_null{n}").alias("n_rows")) for n, c in enumerate(required)]
        )
        missing = F.filter(missing, lambda cell: cell["n_rows"] > 0)
        cells = F.when(F.col("_set").isin(list(sets)), cells).otherwise(missing) if sets else missing
    return counts.select(F.inline(cells))


def status_counts(decoded: DataFrame) -> DataFrame:
    """Decoded templates per status."""
    return decoded.groupBy("status").agg(F.count("*").alias("n"))
