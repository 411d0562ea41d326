"""Parse files as they arrive. A whole file is the unit, so document passes run per micro-batch and need no state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def parse_arrivals(spark: SparkSession, folder: str, schema, handle: Callable[[DataFrame, int], None], checkpoint: str, fmt: str = "parquet"):
    """Run ``handle(batch, id)`` on what is new in ``folder`` and stop when all is read (AvailableNow).

    The checkpoint remembers which files are done, so a rerun only sees later ones; ``handle`` should write under
    its batch id to be repeatable.
    """
    return spark.readStream.format(fmt).schema(schema).load(folder).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
