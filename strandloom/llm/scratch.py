"""Tables in the shared folder that outlive an executor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..operators.lineage import durable, remove, shared_dir

__all__ = ["durable", "remove", "shared_dir", "stored"]


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table of its own in the shared folder.

    Compressed by column, so wide intermediate rows take a fraction of a
    checkpoint's space. The folder may be removed once all results that read
    it have been written.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
