"""FASTA files as DataFrames. A file with an error keeps the records before it, and its error becomes a row."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequence import genome_name, has_other_letters, normalize
from .shared import written

RECORDS = "file_idx int, rec_idx long, name string, comment string, raw string, error string"
_NAME = re.compile(rb">(\S*)")
_LINE = re.compile(r"(.*) on line ([0-9]+)\.", re.DOTALL)
_BODY = re.compile(rb"\s*((?:[A-Za-z*\-]\S*\s*)*)")


def parse_fasta(data: bytes) -> Iterator[tuple[str | None, str | None, str | None, str | None]]:
    """(name, comment, sequence, None) for each record, then (None, None, None, error) if the file has one."""

    def error(text: str, at: int) -> tuple[None, None, None, str]:
        return None, None, None, f"{text} on line {1 + data.count(b'\n', 0, at)}."

    text = lambda b: b.decode("utf-8", "replace")
    if not data:
        yield None, None, None, "File is empty."
        return
    if data[:1] != b">":
        yield None, None, None, "File must start with '>'."
        return
    at, end = 0, len(data)
    while at < end:
        if data[at : at + 1] != b">":
            yield error(f"Expected '>' but found '{text(data[at : at + 1])}'", at)
            return
        name = _NAME.match(data, at)
        if name.end() == end:
            yield error("Unexpected EOF in name", end)
            return
        if not name[1]:
            yield error("Empty name", at)
            return
        line = data.find(b"\n", name.end())
        if line < 0:
            yield error("Unexpected EOF in comment", end)
            return
        comment = text(data[name.end() + 1 : line]) if line > name.end() else None
        body = _BODY.match(data, line)
        if not body[1]:
            yield error("Empty sequence", body.end())
            return
        yield text(name[1]), comment, text(b"".join(body[1].split())), None
        at = body.end()


def _qualified(spark: SparkSession, path: str) -> tuple[str, int | None]:
    """A whole path, and the bytes of its file, or None if there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    q = fs.makeQualified(p)
    return q.toString(), fs.getFileStatus(q).getLen() if fs.exists(q) else None


def _parsed(rows: Iterator[tuple[str, int, str]]) -> Iterator[tuple]:
    """(path, start, k, end, name, comment, raw, error, lines) of the rows (path, start, value) of a task, see ``_split_records``.

    What a file's end changes is said twice for the last row of a split: with end true, as if it were the file's last, and
    with end false.
    """
    held: tuple[str, int, str] | None = None
    k = lines = 0

    def of(row: tuple[str, int, str], ends: bool, last: bool) -> Iterator[tuple]:
        path, start, value = row
        data = value.encode("utf-8", "surrogateescape")
        opened = start > 0 or k > 0
        for n, (name, comment, raw, error) in enumerate(parse_fasta((b">" if opened else b"") + data + (b"" if ends else b"\n"))):
            line = None
            if error and (found := _LINE.fullmatch(error)):
                error, line = found[1], lines + int(found[2])
            yield path, start, k, n, ends if last else None, name, comment, raw, error, line

    for row in rows:
        if held is not None:
            same = row[:2] == held[:2]
            yield from of(held, False, not same)
            if not same:
                yield from of(held, True, True)
                yield held[0], held[1], -1, 0, None, None, None, None, None, lines + held[2].count("\n") + 1
            k, lines = (k + 1, lines + held[2].count("\n") + 1) if same else (0, 0)
        held = row
    if held is not None:
        yield from of(held, False, True)
        yield from of(held, True, True)
        yield held[0], held[1], -1, 0, None, None, None, None, None, lines + held[2].count("\n") + 1


_PARSED = "path string, start long, k long, n int, end boolean, name string, comment string, raw string, error string, line long"


def _split_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, rec_idx, name, comment, raw, error) of files that exist, each read by as many tasks as Spark splits it into.

    A line that begins with > always begins a record, so Spark's text source can cut files there. Tasks number the rows of
    a split; sums over a file's splits tell how many records and lines lie before. The first error of a file ends it.
    """
    text = spark.read.option("lineSep", "\n>").text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a few records at a time
        found, size = [], 0
        for row in _parsed((p, int(s), v) for pdf in frames for p, s, v in zip(pdf["path"], pdf["start"], pdf["value"], strict=True)):
            found.append(row)
            size += len(row[7] or "") + 100
            if size > 1 << 24:
                yield pd.DataFrame(found, columns=_NAMES)
                found, size = [], 0
        if found:
            yield pd.DataFrame(found, columns=_NAMES)

    parsed = written(text.mapInPandas(run, _PARSED), "records")
    file = Window.partitionBy("of").orderBy("at")
    splits = parsed.filter("k < 0").select(F.col("path").alias("of"), F.col("start").alias("at"), F.col("line").alias("lines"))
    # one row for each split
    counts = parsed.filter("name is not null and end is not true").groupBy(F.col("path").alias("of"), F.col("start").alias("at")).agg(F.count("*").alias("records"))
    splits = splits.join(counts, ["of", "at"], "left").select("of", "at", F.coalesce(F.sum("lines").over(file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("lines_before"), F.lead("at").over(file).isNull().alias("last"))
    rows = parsed.filter("k >= 0").join(splits, (F.col("path") == F.col("of")) & (F.col("start") == F.col("at"))).filter("end is null or end = last")
    place = F.struct("start", "k", "n")
    first = rows.filter("error is not null").groupBy(F.col("path").alias("of")).agg(F.min(place).alias("stop"))
    rows = rows.drop("of", "at").join(first, F.col("path") == F.col("of"), "left").filter(F.col("stop").isNull() | (place <= F.col("stop")))
    # records before a row: those of earlier splits, and of its own
    kept = rows.groupBy(F.col("path").alias("f"), F.col("start").alias("s")).agg(F.count_if(F.col("name").isNotNull()).alias("records"))
    kept = kept.select("f", "s", F.coalesce(F.sum("records").over(Window.partitionBy("f").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = rows.join(kept, (F.col("path") == F.col("f")) & (F.col("start") == F.col("s")))
    number = F.col("before") + F.row_number().over(Window.partitionBy("path", "start").orderBy("k", "n")) - 1
    error = F.when(F.col("line").isNull(), F.col("error")).otherwise(F.format_string("%s on line %d.", "error", F.col("line") + F.col("lines_before")))
    return rows.select("path", number.cast("long").alias("rec_idx"), "name", "comment", "raw", error.alias("error"))


_NAMES = [c.split()[0] for c in _PARSED.split(", ")]


def fasta_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file_idx, rec_idx, name, comment, raw, error) of files in the given order; "-" is standard input, once.

    A file that can't be opened has one row with its error. Files of any size are read by many tasks; a record is one value.
    """
    found, here, stdin = [], [], False
    for k, p in enumerate(paths):
        if p == "-":
            rows = [(None, None, None, "-: Bad file descriptor")] if stdin else list(parse_fasta(sys.stdin.buffer.read()))
            here += [(k, r, *row) for r, row in enumerate(rows)]
            stdin = True
            continue
        q, size = _qualified(spark, p)
        if size:
            found.append((k, q))
        else:
            here.append((k, 0, None, None, None, f"{p}: No such file or directory" if size is None else "File is empty."))
    out = spark.createDataFrame(here, RECORDS)
    if found:
        order = spark.createDataFrame(found, "file_idx int, q string").withColumn("at", _rooted(F.col("q")))
        path = F.try_url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))  # Spark's readers report it with escapes
        records = _split_records(spark, sorted({q for _, q in found})).withColumn("file", _rooted(path))
        columns = [c.split()[0] for c in RECORDS.split(", ")]
        out = out.unionByName(order.join(records, F.col("at") == F.col("file")).select(columns))
    return out


def _rooted(path: Column) -> Column:
    """A path with one slash after its scheme."""
    return F.regexp_replace(path, "^([a-z0-9]+:)/+", "$1/")


def file_of_filenames(spark: SparkSession, path: str) -> list[str]:
    """The names in a file, one a line, empty lines left out; "-" is standard input. Raises OSError if it can't be opened."""
    if path == "-":
        return [line for line in sys.stdin.buffer.read().decode("utf-8", "replace").split("\n") if line]
    if _qualified(spark, path)[1] is None:
        raise OSError(f"{path}: No such file or directory")
    return [r["value"] for r in spark.read.option("lineSep", "\n").text(path).filter("value <> ''").collect()]


def read_fasta(spark: SparkSession, paths: Sequence[str] = (), paths_from: Sequence[str] = (), join: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sequences, errors): names from ``paths_from`` files come before ``paths``.

    ``join``: the records of a file become one genome named after the file, joined by !; a file without records adds
    none. Sequences have seq_id, name, seq, len, other_letters, numbered by file and record. A list of names that can't be
    opened is an error of its own, without file_idx; the others are read.
    """
    names, unread = [], []
    for f in paths_from:
        try:
            names += file_of_filenames(spark, f)
        except OSError as e:
            unread.append(("soft_error", "list", None, str(e)))
    names += list(paths)
    if len(names) < (2 if join else 1):
        raise ValueError("at least two files are needed to join" if join else "no input files")
    records = fasta_records(spark, names)
    errors = records.filter("error is not null").select(F.lit("soft_error").alias("level"), F.lit("fasta").alias("code"), "file_idx", "error")
    errors = errors.unionByName(spark.createDataFrame(unread, "level string, code string, file_idx int, error string")) if unread else errors
    good = records.filter("error is null").select("file_idx", "rec_idx", "name", normalize(F.col("raw")).alias("seq"), has_other_letters(F.col("raw")).alias("other_letters"))
    if join:
        named = spark.createDataFrame(list(enumerate(names)), "file_idx int, path string").select("file_idx", genome_name(F.col("path")).alias("name"))
        good = good.groupBy("file_idx").agg(F.expr("listagg(seq, '!') within group (order by rec_idx)").alias("seq"), F.bool_or("other_letters").alias("other_letters"))
        good = good.join(named, "file_idx").withColumn("rec_idx", F.lit(0).cast("long"))
    # ids: the records of earlier files, then the place in the file; there is one row for each file here
    sizes = good.groupBy("file_idx").agg(F.count("*").alias("n"))
    before = sizes.select("file_idx", (F.sum("n").over(Window.orderBy("file_idx")) - F.col("n")).alias("before"))
    rows = good.join(before, "file_idx").withColumn("seq_id", F.col("before") + F.col("rec_idx"))
    return rows.select("seq_id", "name", "seq", F.length("seq").cast("long").alias("len"), "other_letters"), errors


def fasta_lines(sequences: DataFrame, width: int = 60) -> DataFrame:
    """(seq_id, value): the text of each sequence's record."""
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    return sequences.select("seq_id", F.concat(F.lit(">"), "name", F.lit("\n"), body).alias("value"))


def write_fasta(sequences: DataFrame, path: str) -> None:
    """Sequences as FASTA files in a folder, in the order of ids within and over files."""
    fasta_lines(sequences).repartitionByRange("seq_id").sortWithinPartitions("seq_id").select("value").write.mode("overwrite").text(path)
