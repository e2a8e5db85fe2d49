"""Sequences, joined genomes and subjects as DataFrames."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.sequence import both_strands, gc_content, has_other_letters, normalize
from ..functions.thresholds import P_VALUE, anchor_threshold
from ..sources.shared import written

#: Letters of a sequence that fits one value.
LONGEST = 1_073_741_823


def from_table(df: DataFrame, seq_id: str = "doc_id", text: str = "text", name: str | None = None) -> DataFrame:
    """(seq_id long, name, seq, len, other_letters) of any table with a text column; rows keep their own identity."""
    raw = F.col(text)
    label = F.col(name) if name else F.col(seq_id).cast("string")
    rows = df.select(F.col(seq_id).cast("long").alias("seq_id"), label.alias("name"), normalize(raw).alias("seq"), has_other_letters(raw).alias("other_letters"))
    return rows.select("seq_id", "name", "seq", F.length("seq").cast("long").alias("len"), "other_letters")


def genome_contigs(df: DataFrame, genome: str = "source", order: str = "doc_id", text: str = "text") -> DataFrame:
    """(name, k, seq, other_letters): the contigs of genomes, normalized once and written; what follows reads letters alone."""
    raw = F.col(text)
    return written(df.select(F.col(genome).alias("name"), F.col(order).alias("k"), normalize(raw).alias("seq"), has_other_letters(raw).alias("other_letters")), "contigs")


def _running(kind: pa.DataType):
    """``inner``, the place within the task: the letters, and a separator each, of a genome's contigs before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            places = []
            for name, n in zip(batch.column("name").to_pylist(), batch.column("n").to_pylist(), strict=True):
                places.append(before[name])
                before[name] += n + 1
            columns = [batch.column("name").cast(kind), batch.column("seq"), batch.column("other_letters"), batch.column("n"), pa.array(places, pa.int64()), pa.array([part] * batch.num_rows, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["name", "seq", "other_letters", "n", "inner", "part"])

    return run


def genome_pieces(contigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sizes, pieces) of joined genomes, none of which is ever one value.

    sizes: (seq_id, name, len, other_letters), ids by name, null last; len counts a ! between contigs. pieces: (seq_id,
    place, seq), each contig with its place in the joined sequence. Contigs are ranged by genome and order, so a large
    genome takes as many tasks as it needs; each adds up its own, and one row for each task and genome tells what lies
    before, and how many names. Both are written.
    """
    kind = contigs.schema["name"].dataType
    ranged = contigs.select("*", F.length("seq").cast("long").alias("n")).repartitionByRange(F.col("name").asc_nulls_last(), "k").sortWithinPartitions(F.col("name").asc_nulls_last(), "k", "seq")
    schema = f"name {kind.simpleString()}, seq string, other_letters boolean, n long, inner long, part int"
    inner = written(ranged.select("name", "seq", "other_letters", "n").mapInArrow(_running(to_arrow_type(kind)), schema), "ranged")
    # a row for each task and genome
    sums = written(inner.groupBy("name", "part").agg(F.sum(F.col("n") + 1).alias("all"), F.bool_or("other_letters").alias("other_letters")), "sums")
    named = sums.groupBy("name").agg((F.sum("all") - 1).alias("len"), F.bool_or("other_letters").alias("other_letters"), F.min("part").alias("first"))
    starts = named.groupBy("first").count()  # as many rows as tasks
    starts = starts.select(F.col("first").alias("at"), (F.sum("count").over(Window.orderBy("first")) - F.col("count")).alias("names"))
    number = F.row_number().over(Window.partitionBy("first").orderBy(F.col("name").asc_nulls_last())) - 1
    sizes = written(named.join(starts, F.col("first") == F.col("at")).select((F.col("names") + number).cast("long").alias("seq_id"), "name", "len", "other_letters"), "sizes")
    before = F.coalesce(F.sum("all").over(Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("name", F.col("part").alias("at"), before.alias("before"))
    sums = sums.join(sizes.select("seq_id", F.col("name").alias("known")), F.col("name").eqNullSafe(F.col("known"))).select("seq_id", F.col("name").alias("of"), "at", "before")
    found = inner.join(sums, F.col("name").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")))
    return sizes, written(found.select("seq_id", (F.col("inner") + F.col("before")).alias("place"), "seq"), "pieces")


def join_contigs(df: DataFrame, genome: str = "source", order: str = "doc_id", text: str = "text") -> DataFrame:
    """One sequence for each genome: its contigs in ``order``, separated by !; ids follow the genomes' names.

    Contigs of a genome meet in one task, as its joined sequence is one value; ``genome_pieces`` has it in pieces. A genome
    above ``LONGEST`` letters, which no run accepts, gets a null sequence and its length. A null name is a genome like others.
    """
    sizes, pieces = genome_pieces(genome_contigs(df, genome, order, text))
    rows = pieces.join(sizes.filter(F.col("len") <= LONGEST).select("seq_id"), "seq_id", "left_semi")
    joined = rows.groupBy("seq_id").agg(F.expr("listagg(seq, '!') within group (order by place)").alias("seq"))
    return sizes.join(joined, "seq_id", "left").select("seq_id", "name", "seq", "len", "other_letters")


def subjects(sequences: DataFrame, p_value: float = P_VALUE) -> DataFrame:
    """``sequences`` with gc, rs (both strands), rs_len = 2 len + 1 and the anchor threshold."""
    rows = sequences.withColumn("gc", gc_content(F.col("seq"))).withColumn("rs", both_strands(F.col("seq"))).withColumn("rs_len", 2 * F.col("len") + 1)
    return rows.withColumn("threshold", anchor_threshold(F.col("gc"), F.col("rs_len"), p_value))
