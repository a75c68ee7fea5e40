"""A stream written as versions: one commit per micro-batch.

The batch's number is part of the commit's context, so a batch that Spark runs again after a failure isn't committed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from strata.operators.collections import rows_map_set
from strata.plans.repository import MASTER, Repository


def commit_stream(stream: DataFrame, repo: Repository, key: str, checkpoint: str, branch: str = MASTER, keys: list[str] | None = None, order: str | None = None, **trigger) -> StreamingQuery:
    """Each micro-batch becomes a version of `key`: its rows appended, or upserted by the first of `keys` (the last by `order` holds)."""

    def put(batch: DataFrame, number: int) -> None:
        at = repo._head(key, branch)
        if at is not None and repo.commit(key, at)["ctx"] == f"batch {number}":
            return
        if at is not None:
            old = repo.get(key, version=at)
            batch = rows_map_set(old, batch, keys[0], order) if keys else old.unionByName(batch)
        repo.put(key, batch, branch, ctx=f"batch {number}", keys=keys)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
