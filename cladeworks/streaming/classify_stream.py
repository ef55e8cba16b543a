"""Classification of arriving reads against a loaded index, and a running report.

Each micro-batch is classified by the batch operator (no state per read). Running counts per taxon are kept
as one table per batch id, so a batch that is run again after a failure replaces its own counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cladeworks.functions.kmers import Scheme
from cladeworks.operators.classify import classify


class ClassifyService:
    """A session that keeps an index and its taxonomy at hand and classifies whatever it is given."""

    def __init__(self, index: DataFrame, taxonomy: DataFrame, scheme: Scheme, **options):
        self.index, self.taxonomy, self.scheme, self.options = index, taxonomy, scheme, options

    def classify(self, reads: DataFrame) -> DataFrame:
        return classify(reads, self.index, self.taxonomy, self.scheme, **self.options)

    def start(self, reads: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
        """Classify a stream of ``read_id, mate, seq`` into ``out/calls`` and ``out/counts``, by batch id."""

        def batch(df: DataFrame, batch_id: int) -> None:
            calls = self.classify(df)
            calls.write.mode("overwrite").parquet(f"{out}/calls/batch={batch_id}")
            spark = df.sparkSession
            done = spark.read.parquet(f"{out}/calls/batch={batch_id}")
            done.groupBy("taxon").agg(F.count("*").alias("reads")).write.mode("overwrite").parquet(f"{out}/counts/batch={batch_id}")

        writer = reads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()


def running_counts(df: DataFrame, out: str) -> DataFrame:
    """Reads per taxon over all batches so far."""
    return df.sparkSession.read.parquet(f"{out}/counts").groupBy("taxon").agg(F.sum("reads").alias("reads"))
