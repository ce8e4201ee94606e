"""Batch creation of user accounts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from verbarium.operators.accounts import new_accounts, rejected_requests
from verbarium.sources.tables import Store


class Registered(NamedTuple):
    """What a batch of requests led to."""

    created: DataFrame  # id and name of the new accounts
    rejected: DataFrame  # request_id, name, error


def register(store: Store, requests: DataFrame, batch: int) -> Registered:
    """Store the accounts that requests (request_id, name) create.

    A batch that is repeated replaces its own accounts.
    """
    known = store.read("users", before=batch)
    store.write("users", new_accounts(requests, known, store.roles), batch)
    return Registered(store.read_batch("users", batch).select("id", "name"), rejected_requests(requests, known))
