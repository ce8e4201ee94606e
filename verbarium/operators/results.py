"""Results as JSON and the message for an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One JSON object per row in column ``json``; ``keep`` names columns that stay beside it."""
    keep = keep or []
    body = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in keep])
    return df.select(*keep, F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def documented_users(users: DataFrame) -> DataFrame:
    """Users under the names of the documented answer; times in UTC."""
    return users.select(
        "id",
        "name",
        F.col("role_id").alias("role"),
        F.col("target_language_id").alias("target-language"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("creation-tz"),
    )


def write_json(df: DataFrame, path: str) -> None:
    """Write one JSON object per row and line; null fields stay visible."""
    df.write.option("ignoreNullFields", "false").json(path)


def is_empty(df: DataFrame) -> bool:
    """Looks for a first row only."""
    return df.isEmpty()


def none_exist(df: DataFrame, resource: str) -> DataFrame:
    """A single error row if ``df`` is empty, otherwise no row."""
    some = df.limit(1).agg(F.count("*").alias("n"))
    return some.filter(F.col("n") == 0).select(F.lit(f"no {resource} exist").alias("error"))
