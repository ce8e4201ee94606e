"""User accounts and their roles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbarium.schemas import USERS

ADMIN = "admin"
DEFAULT_ROLE = "user"


def public_users(users: DataFrame) -> DataFrame:
    """The columns that may be shown; anything else, such as a password, is never read."""
    return users.select(*USERS.names)


def user_by_id(users: DataFrame, user_id: str) -> DataFrame:
    return public_users(users.filter(F.col("id") == user_id))


def by_id(rows: DataFrame, row_id: int) -> DataFrame:
    return rows.filter(F.col("id") == row_id)


def admins(users: DataFrame, roles: DataFrame) -> DataFrame:
    """Users with the admin role."""
    # The roles table is fixed at two rows.
    admin = roles.filter(F.col("role") == ADMIN).select(F.col("id").alias("role_id"))
    return users.join(F.broadcast(admin), "role_id", "left_semi")


def admin_flags(asked: DataFrame, users: DataFrame, roles: DataFrame) -> DataFrame:
    """Adds is_admin to rows with a user id; unknown users are not admins."""
    flagged = admins(users, roles).select("id", F.lit(True).alias("found"))
    return asked.join(flagged, "id", "left").select(
        *asked.columns, F.coalesce("found", F.lit(False)).alias("is_admin")
    )


def accepted_requests(requests: DataFrame, users: DataFrame) -> DataFrame:
    """(name, request_id) of the requests that succeed: the first for a name not in use.

    A request without a name never succeeds. Rows that repeat both name and request_id are one
    request. The first is found by a minimum, which combines before the shuffle, so a name asked for
    very often costs no more than another.
    """
    named = requests.filter(F.col("name").isNotNull())
    first = named.groupBy("name").agg(F.min("request_id").alias("request_id"))
    return first.join(users.select("name"), "name", "left_anti")


def new_accounts(requests: DataFrame, users: DataFrame, roles: DataFrame) -> DataFrame:
    """The accounts that requests (request_id, name) create, in the layout of users."""
    role = roles.filter(F.col("role") == DEFAULT_ROLE).select(F.col("id").alias("role_id"))
    return accepted_requests(requests, users).select(
        F.uuid().alias("id"),
        role.scalar().alias("role_id"),
        "name",
        F.lit(None).cast("int").alias("target_language_id"),
        F.current_timestamp().alias("created_at"),
    )


def rejected_requests(requests: DataFrame, users: DataFrame) -> DataFrame:
    """The other requests, with the error message."""
    accepted = accepted_requests(requests, users)
    # A null name has no equal among the accepted, so it is always rejected.
    return requests.join(accepted, ["name", "request_id"], "left_anti").select(
        "request_id",
        "name",
        F.when(F.col("name").isNull(), "user without a name")
        .otherwise(F.concat(F.lit("user "), F.col("name"), F.lit(" already exists")))
        .alias("error"),
    )
