"""Tables written into the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from sieveline.session import checkpoint_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder.

    What is read afterwards does not depend on any executor that computed it: the lineage ends at the files.
    """
    folder = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/sieveline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
