"""One call for a whole run: sequences to distances, matrices, coverages, replicates and diagnostics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.models import distance, model_name
from ..functions.thresholds import P_VALUE
from ..operators import diagnostics, pairs, phylip
from ..sources.fasta import read_fasta
from ..sources.shared import written


@dataclass(frozen=True)
class Options:
    """model: raw, jc, kimura, logdet or ani; bootstrap: matrices in all, the first from the data itself."""

    model: str = "jc"
    p_value: float = P_VALUE
    bootstrap: int = 1
    seed: int = 0
    symmetric: bool = True
    truncate_names: bool = False
    subject_blocks: int | None = None
    query_blocks: int | None = None

    def __post_init__(self) -> None:
        model_name(self.model)
        if not 0 < self.p_value < 1:
            raise ValueError("p_value must lie between 0 and 1")
        if self.bootstrap < 1:
            raise ValueError("bootstrap must be 1 or more")


def _flag(value: object) -> bool:
    """A boolean, or one of the words that stand for one."""
    if isinstance(value, bool):
        return value
    found = {"true": True, "yes": True, "on": True, "1": True, "false": False, "no": False, "off": False, "0": False}.get(str(value).strip().lower())
    if found is None:
        raise ValueError(f"{value!r} is no boolean")
    return found


def _whole(value: object) -> int:
    if isinstance(value, bool) or isinstance(value, float) and not value.is_integer():
        raise ValueError(f"{value!r} is no whole number")
    return int(value)


def _blocks(value: object) -> int | None:
    if value is None:
        return None
    if _whole(value) < 1:
        raise ValueError("blocks must be 1 or more")
    return _whole(value)


def _number(value: object) -> float:
    if isinstance(value, bool):
        raise ValueError(f"{value!r} is no number")
    return float(value)


#: How each option is read.
READ = {"model": str, "p_value": _number, "bootstrap": _whole, "seed": _whole, "symmetric": _flag, "truncate_names": _flag, "subject_blocks": _blocks, "query_blocks": _blocks}


def lenient_options(**given) -> tuple[Options, list[str]]:
    """Options of values as users give them, also as text: a bad one leaves its default, and a message says so."""
    kept, messages = {}, []
    for name, value in given.items():
        try:
            read = READ[name](value)
            Options(**{name: read})
            kept[name] = read
        except KeyError:
            messages.append(f"Ignoring unknown option {name}.")
        except (TypeError, ValueError):
            messages.append(f"Ignoring bad value {value!r} of option {name}.")
    return Options(**kept), messages


@dataclass(frozen=True)
class Result:
    pairs: DataFrame
    distances: DataFrame
    coverages: DataFrame
    replicates: DataFrame
    diagnostics: DataFrame


def replicate_distances(replicates: DataFrame, model: str) -> DataFrame:
    """(replicate, i, j, distance) both ways; counts are doubled first, as each direction carries the draw."""
    doubled = F.transform("counts", lambda c: c * 2)
    once = replicates.select("replicate", "i", "j", doubled.alias("counts")).withColumn("distance", distance(model, F.col("counts")))
    return once.select("replicate", F.explode(F.array(F.struct("i", "j", "distance"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "distance"))).alias("x")).select("replicate", "x.*")


def run(sequences: DataFrame, options: Options = Options(), errors: DataFrame | None = None, messages: Sequence[str] = (), pieces: DataFrame | None = None) -> Result:
    """Compare all pairs of ``sequences`` (seq_id, name, seq, len, other_letters); seq isn't read where ``pieces`` (seq_id, place, seq) are given.

    Raises ValueError for fewer than two sequences and for empty or overlong ones; all else is reported as rows, with the
    ``errors`` of reading files and the ``messages`` of ``lenient_options``. Pairs are walked once and written.
    """
    diagnostics.check_runnable(sequences)
    letters = pairs.in_pieces(sequences) if pieces is None else (pieces, sequences)
    counted = written(pairs.piece_counts(*letters, options.model, options.p_value, options.subject_blocks, options.query_blocks), "pairs")
    d, c = pairs.distances(counted, options.model, options.symmetric), pairs.coverages(counted)
    found = diagnostics.sequence_diagnostics(sequences, options.truncate_names).unionByName(diagnostics.pair_diagnostics(d, c))
    if errors is not None:
        found = found.unionByName(diagnostics.file_diagnostics(errors))
    if messages:
        rows = [("soft_error", "option", None, None, m) for m in messages]
        found = found.unionByName(sequences.sparkSession.createDataFrame(rows, "level string, code string, i long, j long, message string"))
    replicates = replicate_distances(pairs.bootstrap(counted, options.bootstrap, options.seed), options.model)
    return Result(counted, d, c, replicates, found)


def matrix(result: Result, sequences: DataFrame, truncate_names: bool = False) -> DataFrame:
    """The matrix of distances as numbered lines."""
    return phylip.distance_lines(result.distances, sequences, truncate_names)


def replicate_matrices(result: Result, sequences: DataFrame, truncate_names: bool = False) -> DataFrame:
    """The matrices of all replicates as numbered lines; that of the data itself is replicate 0."""
    every = result.distances.select(F.lit(0).alias("replicate"), "i", "j", "distance").unionByName(result.replicates)
    return phylip.replicate_lines(every, sequences, truncate_names)


@dataclass(frozen=True)
class Report:
    """lines: (part, line_no, line), in that order the whole text; status: 1 if any diagnostic is an error, else 0."""

    lines: DataFrame
    diagnostics: DataFrame
    status: int
    result: Result


def compare_files(spark: SparkSession, files: Sequence[str] = (), file_of_filenames: Sequence[str] = (), join: bool = False, verbose: int = 0, **given) -> Report:
    """Compare the sequences of FASTA files, or with ``join`` the files, by options as users give them (see ``lenient_options``).

    The text is the matrix; with ``verbose`` 1 or more the coverages follow it after an empty line and a heading, and with 2
    the matrix has each direction's own distances; then come the matrices of replicates. Bad values and files that can't be
    read are diagnostics. Raises ValueError where nothing can be compared.
    """
    if verbose >= 2:
        given = {**given, "symmetric": False}
    options, messages = lenient_options(**given)
    sequences, errors = read_fasta(spark, files, file_of_filenames, join)
    sequences = written(sequences, "sequences")
    result = run(sequences, options, errors, messages)
    text = replicate_matrices(result, sequences, options.truncate_names)
    parts = [text.select(F.when(F.col("replicate") == 0, 0).otherwise(F.col("replicate") + 1).cast("long").alias("part"), "line_no", "line")]
    if verbose >= 1:
        cover = phylip.coverage_lines(result.coverages, sequences).select(F.lit(1).cast("long").alias("part"), "line_no", "line")
        parts += [spark.createDataFrame([(1, -2, ""), (1, -1, "Coverage:")], "part long, line_no long, line string"), cover]
    lines = parts[0]
    for more in parts[1:]:
        lines = lines.unionByName(more)
    found = written(result.diagnostics, "diagnostics")
    return Report(lines, found, diagnostics.exit_status(found), result)
