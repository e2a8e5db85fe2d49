"""Matrices as text: one line for each sequence, or the long form pivoted by rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import name_cell


def number(x: Column, scientific: Column) -> Column:
    """A distance as the matrix prints it: 4 digits, in scientific form where the whole matrix needs it."""
    plain = F.when(scientific, F.format_string("%1.4e", x)).otherwise(F.format_string("%1.4f", x))
    return F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(plain)


#: Columns of a row that are put together at once.
TILE = 1024


def _row_texts(cells: DataFrame, keys: list[str], cell: Column) -> DataFrame:
    """(keys, text): the texts ``cell`` of each row in the order of j, first by tiles of columns, so that no array has a whole row."""
    tiles = cells.select(*keys, F.floor(F.col("j") / TILE).alias("tile"), F.struct("j", cell.alias("text")).alias("cell")).groupBy(*keys, "tile")
    tiles = tiles.agg(F.array_join(F.transform(F.array_sort(F.collect_list("cell")), lambda c: c["text"]), "").alias("text"))
    return tiles.groupBy(*keys).agg(F.expr("listagg(text, '') within group (order by tile)").alias("text"))


def distance_lines(distances: DataFrame, sequences: DataFrame, truncate_names: bool = False) -> DataFrame:
    """(line_no, line): the number of sequences, then names and distances in the order of ids; the diagonal is 0.

    All numbers turn scientific if any distance lies between 0 and 0.001.
    """
    return replicate_lines(distances.withColumn("replicate", F.lit(0)), sequences, truncate_names).drop("replicate")


def replicate_lines(distances: DataFrame, sequences: DataFrame, truncate_names: bool = False) -> DataFrame:
    """(replicate, line_no, line): the matrix of each replicate (distances: replicate, i, j, distance), as ``distance_lines``."""
    small = distances.groupBy("replicate").agg(F.coalesce(F.max((F.col("distance") > 0) & (F.col("distance") < 0.001)), F.lit(False)).alias("small"))
    own = distances.groupBy("replicate", "i").agg(F.lit(0.0).alias("distance")).select("replicate", "i", F.col("i").alias("j"), "distance")
    cells = distances.select("replicate", "i", "j", "distance").unionByName(own).join(small, "replicate")
    rows = _row_texts(cells, ["replicate", "i"], F.concat(F.lit(" "), number(F.col("distance"), F.col("small"))))
    rows = rows.join(sequences.select(F.col("seq_id").alias("i"), "name"), "i")
    lines = rows.select("replicate", (F.col("i") + 1).alias("line_no"), F.concat(name_cell(F.col("name"), truncate_names), "text").alias("line"))
    heads = lines.groupBy("replicate").agg(F.count("*").cast("string").alias("line")).select("replicate", F.lit(0).cast("long").alias("line_no"), "line")
    return heads.unionByName(lines)


def coverage_lines(coverages: DataFrame, sequences: DataFrame) -> DataFrame:
    """(line_no, line): coverages in scientific form, each followed by a space; the diagonal is 1."""
    own = sequences.select(F.col("seq_id").alias("i"), F.col("seq_id").alias("j"), F.lit(1.0).alias("v"))
    cells = coverages.select(F.col("subject_id").alias("i"), F.col("query_id").alias("j"), F.col("coverage").alias("v")).unionByName(own)
    return _row_texts(cells, ["i"], F.concat(number(F.col("v"), F.lit(True)), F.lit(" "))).select(F.col("i").alias("line_no"), F.col("text").alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines (line_no, line) as text files in a folder: read by their names, they give the lines in order.

    Tasks write ranges of lines side by side. A file appears when its task has succeeded, and none if the job fails.
    """
    lines.repartitionByRange("line_no").sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(path)


def write_matrices(lines: DataFrame, path: str) -> None:
    """Numbered lines of several matrices (replicate, line_no, line), one after the other, as ``write_lines``."""
    lines.repartitionByRange("replicate", "line_no").sortWithinPartitions("replicate", "line_no").select("line").write.mode("overwrite").text(path)
