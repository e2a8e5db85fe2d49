import random

from pyspark.sql import functions as F

from helixframe.operators.pairs import pair_counts
from helixframe.operators.sequences import from_table
from helixframe.streaming.incremental import SEQUENCES, arrived_pairs, compare_arrivals


def test_batches_add_up_to_all_pairs(spark, tmp_path):
    rng = random.Random(4)
    base = "".join(rng.choice("ACGT") for _ in range(1500))
    texts = ["".join(rng.choice("ACGT") if rng.random() < 0.05 else x for x in base) for _ in range(5)]
    seqs = from_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for k, some in enumerate((seqs.filter("seq_id < 2"), seqs.filter("seq_id = 2"), seqs.filter("seq_id > 2"))):
        some.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SEQUENCES).parquet(f"{tmp_path}/in")
        compare_arrivals(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        assert arrived_pairs(spark, f"{tmp_path}/out").count() == (2, 6, 20)[k]
    text = lambda df: sorted(map(tuple, df.select("subject_id", "query_id", F.col("counts").cast("string")).collect()))
    assert text(arrived_pairs(spark, f"{tmp_path}/out")) == text(pair_counts(seqs))
