"""Pairs of sequences that arrive over time: each micro-batch is compared with all that came before, and with itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.thresholds import P_VALUE
from ..operators.pairs import PAIRS, pair_counts

SEQUENCES = "seq_id long, name string, seq string, len long, other_letters boolean"


def compare_arrivals(stream: DataFrame, out: str, checkpoint: str, model: str = "jc", p_value: float = P_VALUE) -> StreamingQuery:
    """Start a query that keeps the pair counts of a stream of sequences (with the columns of ``from_table``) up to date.

    Below ``out`` each batch writes sequences/batch=k and pairs/batch=k, replacing what an earlier try of it wrote, so
    that a repeated batch leaves each pair once. Ids must not repeat over batches.
    """

    def batch(new: DataFrame, k: int) -> None:
        spark = new.sparkSession
        new.select([c.split()[0] for c in SEQUENCES.split(", ")]).write.mode("overwrite").parquet(f"{out}/sequences/batch={k}")
        every = spark.read.schema(SEQUENCES + ", batch int").option("basePath", f"{out}/sequences").parquet(f"{out}/sequences").filter(F.col("batch") <= k)
        fresh, known = every.filter(F.col("batch") == k).drop("batch"), every.filter(F.col("batch") < k).drop("batch")
        pairs = pair_counts(fresh, model, p_value).unionByName(pair_counts(fresh, model, p_value, queries=known)).unionByName(pair_counts(known, model, p_value, queries=fresh))
        pairs.write.mode("overwrite").parquet(f"{out}/pairs/batch={k}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrived_pairs(spark, out: str) -> DataFrame:
    """The pair counts that a stream has written so far."""
    return spark.read.schema(PAIRS).parquet(f"{out}/pairs").select("subject_id", "query_id", "counts", "seq_len")
