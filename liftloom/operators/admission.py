"""Which requests of a log the service lets in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: a project table with no more rows is sent to all tasks
BROADCAST_ROWS = 100_000


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def admit(requests: DataFrame, projects: DataFrame, project_keys: DataFrame) -> DataFrame:
    """Add ``status`` and the project's ``session_conf`` to requests ``(.., project_id, api, api_key)``.

    ``api`` is pulse, predict or action. The key only has to exist and be unlocked; it may belong to another project.
    Both tables are broadcast if they are counted to be small, so that the call log is not shuffled by them. Otherwise
    Spark shuffles them and splits large projects.
    """
    known = _small(projects).select(
        "project_id",
        F.col("session_conf"),
        (F.col("deleted") == "D").alias("_deleted"),
        F.lit(True).alias("_known"),
        *[F.col(f"auth_{api}").alias(f"_auth_{api}") for api in ("pulse", "predict", "action")],
    )
    locks = _small(project_keys).select(F.col("key_string").alias("api_key"), F.col("locked").alias("_locked"))
    needs_key = F.lit(False)
    for api in ("pulse", "predict", "action"):
        needs_key = needs_key | ((F.col("api") == api) & (F.coalesce(f"_auth_{api}", F.lit("")) == "T"))
    lock = F.coalesce("_locked", F.lit("NA"))
    status = (
        F.when(F.col("_known").isNull() | F.coalesce("_deleted", F.lit(False)), 404)
        .when(~needs_key, 200)
        .when(lock == "NA", 403)
        .when(lock != "F", 401)
        .otherwise(200)
    )
    return (
        requests.join(known, "project_id", "left")
        .join(locks, "api_key", "left")
        .select(
            *requests.columns,
            status.alias("status"),
            F.when(status != 404, F.col("session_conf")).alias("session_conf"),
        )
    )
