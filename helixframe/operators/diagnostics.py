"""Warnings and errors about sequences and pairs as rows (level, code, i, j, message)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequences import LONGEST

SHORT, LITTLE = 1000, 0.2


def _row(rows: DataFrame, level: str, code: str, message, i="seq_id", j=None) -> DataFrame:
    other = F.lit(None).cast("long") if j is None else F.col(j).cast("long")
    return rows.select(F.lit(level).alias("level"), F.lit(code).alias("code"), F.col(i).cast("long").alias("i"), other.alias("j"), message.alias("message"))


def sequence_diagnostics(sequences: DataFrame, truncate_names: bool = False) -> DataFrame:
    """Fatal: empty or too long; soft error: below 1000 letters; warnings: letters other than ACGT, a name that is cut."""
    found = [
        _row(sequences.filter("len = 0"), "fatal", "empty", F.format_string("The sequence %s is empty.", "name")),
        _row(sequences.filter(F.col("len") > LONGEST), "fatal", "too_long", F.format_string("The sequence %s is too long.", "name")),
        _row(sequences.filter((F.col("len") > 0) & (F.col("len") < SHORT)), "soft_error", "short", F.format_string("The sequence %s has fewer than 1000 nucleotides.", "name")),
        _row(sequences.filter("other_letters"), "warning", "non_acgt", F.format_string("The sequence %s has symbols other than ACGT.", "name")),
    ]
    if truncate_names:
        found.append(_row(sequences.filter("length(name) > 10"), "warning", "name_cut", F.format_string("The name %s is cut to ten characters.", "name")))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def check_runnable(sequences: DataFrame, join: bool = False) -> None:
    """Raises ValueError for what stops a run: fewer than two sequences, an empty or an overlong one."""
    n, empty, long = sequences.agg(F.count("*"), F.count_if(F.col("len") == 0), F.count_if(F.col("len") > LONGEST)).first()
    if n < 2:
        raise ValueError("at least two genomes are needed" if join else "at least two sequences are needed")
    if empty or long:
        raise ValueError(f"{empty} empty and {long} overlong sequences")


def pair_diagnostics(distances: DataFrame, coverages: DataFrame) -> DataFrame:
    """Soft errors: a distance that is no number (each ordered pair); for i < j, a coverage below 0.2 in either direction."""
    bad = _row(distances.filter(F.isnan("distance")), "soft_error", "nan", F.lit("No distance could be estimated."), "i", "j")
    cov = coverages.groupBy(F.least("subject_id", "query_id").alias("i"), F.greatest("subject_id", "query_id").alias("j")).agg(
        F.max(F.when(F.col("subject_id") < F.col("query_id"), F.col("coverage"))).alias("there"), F.max(F.when(F.col("subject_id") > F.col("query_id"), F.col("coverage"))).alias("back")
    )
    low = distances.filter(~F.isnan("distance") & (F.col("i") < F.col("j"))).join(cov, ["i", "j"]).filter((F.col("there") < LITTLE) | (F.col("back") < LITTLE))
    return bad.unionByName(_row(low, "soft_error", "low_homology", F.format_string("Very little homology: coverages %.4f and %.4f.", "there", "back"), "i", "j"))


def file_diagnostics(errors: DataFrame) -> DataFrame:
    """The errors of ``read_fasta`` as rows of the same table; i: the file's number in the order of names."""
    return errors.select("level", "code", F.col("file_idx").cast("long").alias("i"), F.lit(None).cast("long").alias("j"), F.col("error").alias("message"))


def exit_status(found: DataFrame) -> int:
    """What a run ends with: 1 if any row is an error, soft or fatal, else 0."""
    return int(not found.filter(F.col("level").isin("soft_error", "fatal")).isEmpty())
