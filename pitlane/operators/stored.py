"""Derived tables that several queries of one application read: written once to the shared folder, and removed again."""

from __future__ import annotations

import atexit
import os
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pitlane.session import delete_path, scratch_path

_TABLES: dict[tuple[str, str, str], str] = {}
_LOCK = threading.RLock()


def stored(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table `name` derived from the input folder `source`: built and written at the first call of an
    application, read by all. release() removes what an application has written."""
    key = (spark.sparkContext.applicationId, source if "://" in source else os.path.abspath(source), name)
    with _LOCK:
        if key not in _TABLES:
            path = scratch_path(spark, f"stored-{name}-{uuid.uuid4().hex}")
            build().write.mode("overwrite").parquet(path)
            _TABLES[key] = path
        return spark.read.parquet(_TABLES[key])


def release(spark: SparkSession) -> int:
    """Remove the stored tables of this application; how many there were. Later calls of stored() build anew."""
    app = spark.sparkContext.applicationId
    with _LOCK:
        mine = [k for k in _TABLES if k[0] == app]
        for k in mine:
            delete_path(spark, _TABLES.pop(k))
    return len(mine)


@atexit.register
def _at_exit() -> None:
    """An application that ends without release() removes its tables if its session is still there."""
    spark = SparkSession.getActiveSession()
    if spark is not None and _TABLES:
        try:
            release(spark)
        except Exception:  # noqa: BLE001 -- the session is going down; the shared folder's own clean-up remains
            pass
