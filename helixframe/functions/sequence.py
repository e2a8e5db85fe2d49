"""Column expressions over nucleotide strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numerics import c_div

#: Order of the 16 cells of a count matrix: subject letter, then query letter.
LETTERS = "ACGT"
CELLS = [a + b for a in LETTERS for b in LETTERS]


def normalize(text: Column) -> Column:
    """Keeps A, C, G, T (either case, made upper case) and the contig separator !, drops all else; null becomes empty."""
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^ACGTacgt!]", ""))


def has_other_letters(text: Column) -> Column:
    """Whether ``normalize`` drops something."""
    return F.length(F.coalesce(text, F.lit(""))) != F.length(normalize(text))


def gc_content(seq: Column) -> Column:
    """Share of G and C among all symbols, separators included; NaN for an empty sequence."""
    return c_div(F.regexp_count(seq, F.lit("[GC]")), F.length(seq))


def revcomp(seq: Column) -> Column:
    """Reverse complement; a separator becomes ;."""
    return F.translate(F.reverse(seq), "ACGT!", "TGCA;")


def both_strands(seq: Column) -> Column:
    """Reverse complement, #, forward strand."""
    return F.concat(revcomp(seq), F.lit("#"), seq)


def genome_name(path: Column) -> Column:
    """A path's last part, cut at its first dot."""
    return F.regexp_extract(path, "([^/.]*)[^/]*$", 1)


def letter_counts(seq: Column) -> list[Column]:
    """Counts of A, C, G and T."""
    return [F.regexp_count(seq, F.lit(x)).cast("long") for x in LETTERS]


def equal_fourths(length: Column) -> list[Column]:
    """An equal run of this length spread over AA, CC, GG and TT; TT takes the rest."""
    n = length.cast("long")
    q = F.floor(n / 4).cast("long")
    return [q, q, q, q + n % 4]


def name_cell(name: Column, truncate: bool = False) -> Column:
    """A name as the first field of a matrix line: padded to 10 characters, or cut to 10 as well."""
    padded = F.when(F.length(name) < 10, F.rpad(name, 10, " ")).otherwise(name)
    return F.rpad(name, 10, " ") if truncate else padded
