"""Micro-batched maintenance as Structured Streaming: the catalog has no event streams, only work that arrives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from forgeline.operators.retrieve import active


def embed_arrivals(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, embed: Callable[[list[str]], list[list[float]]], batch: int = 30, files_per_batch: int = 100) -> StreamingQuery:
    """Vectors (id, embedding) for active rows without one in Parquet files that arrive in ``folder``.

    Each file is handled once, whatever restarts come between: the checkpoint folder, which must be shared by all
    executors, remembers it. Stops when everything there is done (availableNow), so a scheduler can repeat it.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    todo = rows.where(active(F.col("status")) & F.col("embedding").isNull()).select("id", F.concat_ws("\n", "short_description", "long_description").alias("t"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            for i in range(0, len(p), batch):
                s = p.iloc[i : i + batch]
                yield pd.DataFrame({"id": s["id"], "embedding": embed(s["t"].tolist())})

    vectors = todo.mapInPandas(run, "id string, embedding array<float>")
    return vectors.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
