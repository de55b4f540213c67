"""Arrow batch sizes that bound a Python worker's memory."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows and bytes of a batch that goes to a Python worker.
ROWS, BYTES = 1000, 4 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches held to ROWS and BYTES, for columns of whole texts."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)
    return df


def unused(name: str, columns: list[str]) -> str:
    """name, or a longer one, that no column has in any case."""
    held = {c.lower() for c in columns}
    while name in held:
        name += "_"
    return name
