"""Multiple alignment files as joined alignments, and these as interleaved PHYLIP text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

WIDTH = 60


def maf_alignment(spark: SparkSession, path: str, taxa: int) -> DataFrame:
    """(row, name, place, letters): the aligned rows of all blocks whose head names ``mult=`` this many taxa, by name.

    place: where a block's letters stand in the joined row, which is never one value. A block begins at a line that begins
    with a and ends at a blank line; line ends may be CRLF. Names are numbered as they first occur. Rows that differ in
    length raise ValueError.
    """
    text = spark.read.option("lineSep", "\na").text(path)
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    blocks = text.select(at.alias("block"), F.split(F.split(F.replace("value", F.lit("\r")), "\n[ \t]*(\n|\\z)")[0], "\n").alias("lines"))
    parts = blocks.filter(F.col("lines")[0].contains(f"mult={taxa}")).select("block", F.posexplode("lines").alias("line", "text")).filter(F.col("text").startswith("s") & (F.col("line") > 0))
    fields = F.split(F.trim("text"), "\\s+")
    parts = written(parts.select(F.struct("block", "line").alias("at"), fields[1].alias("name"), fields[6].alias("letters")), "blocks")
    names = parts.groupBy("name").agg(F.min("at").alias("first"), F.sum(F.length("letters")).alias("n"))
    sizes = names.agg(F.min("n"), F.max("n")).first()
    if sizes[0] != sizes[1]:
        raise ValueError(f"aligned sequences of {sizes[0]} to {sizes[1]} letters")
    # one row for each taxon
    rows = names.select(F.col("name").alias("of"), (F.row_number().over(Window.orderBy("first")) - 1).alias("row"))
    before = F.sum(F.length("letters")).over(Window.partitionBy("name").orderBy("at")) - F.length("letters")
    return parts.select("name", before.alias("place"), "letters").join(rows, F.col("name") == F.col("of")).select("row", "name", "place", "letters")


def interleaved_lines(alignment: DataFrame) -> DataFrame:
    """(line_no, line): number and length of the sequences, then their letters, 60 in a line, each round by an empty line."""
    taxa, letters = alignment.agg(F.count_distinct("row"), F.coalesce(F.max(F.col("place") + F.length("letters")), F.lit(0))).first()
    head = alignment.sparkSession.createDataFrame([(0, f"{taxa} {letters}")], "line_no long, line string")
    last = F.greatest(F.col("place") + F.length("letters") - 1, F.col("place"))
    cut = alignment.select("*", F.explode(F.sequence(F.floor(F.col("place") / WIDTH), F.floor(last / WIDTH))).alias("round"))
    low = F.greatest(F.col("round") * WIDTH, F.col("place"))
    high = F.least((F.col("round") + 1) * WIDTH, F.col("place") + F.length("letters"))
    cut = cut.select("row", "name", "round", low.alias("low"), F.substring("letters", (low - F.col("place") + 1).cast("int"), (high - low).cast("int")).alias("piece"))
    # rounds of at most WIDTH letters
    cut = cut.groupBy("row", "name", "round").agg(F.expr("listagg(piece, '') within group (order by low)").alias("piece"))
    at = F.col("round") * (taxa + 1) + F.col("row") + 1
    lines = cut.filter("piece <> '' or round = 0").select(at.alias("line_no"), F.when(F.col("round") == 0, F.concat(F.rpad(F.substring("name", 1, 10), 10, " "), F.lit(" "), "piece")).otherwise(F.col("piece")).alias("line"))
    ends = cut.filter("row = 0 and (piece <> '' or round = 0)").select(((F.col("round") + 1) * (taxa + 1)).alias("line_no"), F.lit("").alias("line"))
    return head.unionByName(lines).unionByName(ends)
