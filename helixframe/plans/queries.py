"""The registered queries of the sequence engine, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models
from ..functions.sequence import CELLS, both_strands, equal_fourths, gc_content, genome_name, has_other_letters, letter_counts, name_cell, normalize, revcomp
from ..functions.thresholds import anchor_threshold
from ..operators import aligned, diagnostics, pairs, phylip, traces
from ..operators.sequences import from_table, genome_contigs, genome_pieces, join_contigs
from ..sources.fasta import fasta_records, write_fasta
from ..sources.shared import new_path, written
from .engine import Options, replicate_distances, run

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def genomes(spark: SparkSession, sf_dir: str, by: str = "source") -> tuple[DataFrame, DataFrame]:
    """(sizes, pieces) of the genomes that documents of one source make."""
    return genome_pieces(genome_contigs(documents(spark, sf_dir), by))


def _walked(spark: SparkSession, sf_dir: str, model: str = "jc") -> tuple[DataFrame, DataFrame]:
    """(sizes, pair counts) of these genomes."""
    sizes, pieces = genomes(spark, sf_dir)
    return sizes, written(pairs.piece_counts(pieces, sizes, model), "pairs")


def rounded(c: str, digits: int = 9):
    return F.when(F.isnan(c) | F.col(c).isin(float("inf"), float("-inf")), F.col(c)).otherwise(F.round(c, digits)).alias(c)


def cells(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *(F.col("counts")[k].alias(f"n_{c.lower()}") for k, c in enumerate(CELLS)))


@query
def seq_normalize(spark, sf_dir):
    seq = normalize(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.md5(seq).alias("seq_md5"), F.length(seq).cast("long").alias("len"))


@query
def seq_non_acgt_flag(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", has_other_letters(F.col("text")).alias("other_letters"))


@query
def seq_gc(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", gc_content(normalize(F.col("text"))).alias("gc")).select("doc_id", rounded("gc"))


@query
def seq_revcomp(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(revcomp(normalize(F.col("text")))).alias("revcomp_md5"))


@query
def seq_both_strands(spark, sf_dir):
    rs = both_strands(normalize(F.col("text")))
    return documents(spark, sf_dir).select("doc_id", F.md5(rs).alias("rs_md5"), F.length(rs).cast("long").alias("rs_len"))


@query
def letter_histogram(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", *(c.alias(f"n_{x}") for x, c in zip("acgt", letter_counts(normalize(F.col("text"))), strict=True)))


@query
def equal_run_fourths(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", *(c.alias(n) for n, c in zip(("n_aa", "n_cc", "n_gg", "n_tt"), equal_fourths(F.length(normalize(F.col("text")))), strict=True)))


@query
def genome_join(spark, sf_dir):
    return join_contigs(documents(spark, sf_dir)).select("seq_id", "name", "len", F.md5("seq").alias("seq_md5"), "other_letters")


@query
def genome_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", genome_name(F.col("url")).alias("name"))


@query
def matrix_names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", name_cell(F.col("c_name")).alias("padded"), name_cell(F.col("c_mktsegment"), True).alias("cut"))


@query
def anchor_thresholds(spark, sf_dir):
    """The threshold of each document's sequence, 0 for one without letters."""
    seqs = from_table(documents(spark, sf_dir))
    found = anchor_threshold(gc_content(F.col("seq")), 2 * F.col("len") + 1)
    return seqs.select("seq_id", F.coalesce(found, F.lit(0)).alias("threshold"))


@query
def sequence_validation(spark, sf_dir):
    return diagnostics.sequence_diagnostics(from_table(documents(spark, sf_dir), name="source"), truncate_names=True).select("level", "code", "i")


def _mutants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's sequence and a copy with the letter at place p (from 0) turned by one where (31 doc_id + 7 p) mod 97 is 0."""
    turned = F.transform(F.split("seq", ""), lambda x, p: F.when((F.col("seq_id") * 31 + p * 7) % 97 == 0, F.translate(x, "ACGT", "CGTA")).otherwise(x))
    return from_table(documents(spark, sf_dir)).withColumn("mutant", F.array_join(turned, ""))


def _mutant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned.mutation_counts(_mutants(spark, sf_dir), ["seq_id"], "seq", "mutant")


@query
def mutation_counts(spark, sf_dir):
    return cells(_mutant_counts(spark, sf_dir), "seq_id")


def _model_query(model: str) -> None:
    def f(spark, sf_dir):
        return _mutant_counts(spark, sf_dir).select("seq_id", models.distance(model, F.col("counts")).alias("distance")).select("seq_id", rounded("distance"))

    f.__name__ = f"distance_{model}"
    query(f)


for _m in models.MODELS:
    _model_query(_m)


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned_with_sizes(spark, sf_dir)[0]


def _aligned_with_sizes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes, pieces = genomes(spark, sf_dir, "lang")
    return aligned.aligned_pairs(pieces, sizes), sizes


@query
def aligned_pair_counts(spark, sf_dir):
    return cells(_aligned(spark, sf_dir), "subject_id", "query_id", "seq_len")


@query
def symmetric_counts(spark, sf_dir):
    return cells(pairs.symmetric(_aligned(spark, sf_dir)), "i", "j", "seq_len")


@query
def pair_distances(spark, sf_dir):
    return pairs.distances(_aligned(spark, sf_dir), "raw").select("i", "j", rounded("distance"))


@query
def pair_distances_one_way(spark, sf_dir):
    return pairs.distances(_aligned(spark, sf_dir), "logdet", average=False).select("i", "j", rounded("distance"))


@query
def pair_coverages(spark, sf_dir):
    return pairs.coverages(_aligned(spark, sf_dir)).select("subject_id", "query_id", rounded("coverage"))


@query
def pair_validation(spark, sf_dir):
    p = written(_aligned(spark, sf_dir), "pairs")
    return diagnostics.pair_diagnostics(pairs.distances(p, "jc"), pairs.coverages(p)).select("level", "code", "i", "j")


@query
def distance_matrix_lines(spark, sf_dir):
    counted, sizes = _aligned_with_sizes(spark, sf_dir)
    return phylip.distance_lines(pairs.distances(written(counted, "pairs"), "raw"), sizes)


@query
def coverage_matrix_lines(spark, sf_dir):
    counted, sizes = _aligned_with_sizes(spark, sf_dir)
    return phylip.coverage_lines(pairs.coverages(counted), sizes)


@query
def bootstrap_totals(spark, sf_dir):
    drawn = pairs.bootstrap(_aligned(spark, sf_dir), 4, seed=1)
    return drawn.select("replicate", "i", "j", "seq_len", models.total(F.col("counts")).alias("total"))


@query
def bootstrap_cells(spark, sf_dir):
    drawn = pairs.bootstrap(_aligned(spark, sf_dir), 6, seed=1)
    return cells(drawn, "replicate", "i", "j", "seq_len")


@query
def fasta_scan(spark, sf_dir):
    """Documents through FASTA files and back; the format holds no separators, and nothing for a text without letters."""
    path, docs = new_path(spark, "fasta"), documents(spark, sf_dir)
    seqs = from_table(docs).withColumn("seq", F.replace(F.col("seq"), F.lit("!"), F.lit("")))
    write_fasta(seqs.filter("seq <> ''"), path)
    files = sorted(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path").toPandas()["path"])
    records = fasta_records(spark, files).filter("error is null")
    records = records.select(F.col("name").cast("long").alias("doc_id"), F.md5("raw").alias("seq_md5"), F.length("raw").cast("long").alias("len"))
    return docs.select("doc_id").join(records, "doc_id", "left").withColumn("len", F.coalesce("len", F.lit(0)))


@query
def genome_distance_join(spark, sf_dir):
    """All pairs of the genomes that documents of one source make, by the anchor walk."""
    return pairs.distances(_walked(spark, sf_dir)[1], "jc")


@query
def genome_counts_by_letters(spark, sf_dir):
    return cells(_walked(spark, sf_dir, "logdet")[1], "subject_id", "query_id", "seq_len")


@query
def genome_run(spark, sf_dir):
    """Diagnostics of a whole run over the genomes."""
    sizes, pieces = genomes(spark, sf_dir)
    return run(sizes, Options(model="kimura"), pieces=pieces).diagnostics


@query
def genome_matrix(spark, sf_dir):
    sizes, counted = _walked(spark, sf_dir)
    return phylip.distance_lines(pairs.distances(counted, "jc"), sizes)


@query
def genome_bootstrap(spark, sf_dir):
    return replicate_distances(pairs.bootstrap(_walked(spark, sf_dir)[1], 3, seed=1), "jc")


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sequences: each document's with that of the next id, and with its altered copy (under -1 - doc_id), both ways."""
    altered = _mutants(spark, sf_dir).filter("seq_id is not null")
    copy = F.struct((-1 - F.col("seq_id")).alias("seq_id"), F.col("mutant").alias("seq"))
    sequences = written(altered.select(F.explode(F.array(F.struct("seq_id", "seq"), copy)).alias("x")).select("x.*"), "linked")
    own = sequences.filter("seq_id >= 0").select("seq_id")
    both = F.explode(F.array(*(F.struct(a.alias("subject_id"), b.alias("query_id")) for a, b in ((F.col("seq_id"), -1 - F.col("seq_id")), (-1 - F.col("seq_id"), F.col("seq_id"))))))
    after = own.join(own.select((F.col("seq_id") - 1).alias("subject_id")), F.col("seq_id") == F.col("subject_id")).select("subject_id", (F.col("seq_id") + 1).alias("query_id"))
    return written(traces.sequence_pairs(sequences, own.select(both.alias("x")).select("x.*").unionByName(after)), "pairs")


@query
def longest_matches(spark, sf_dir):
    """Each place's longest match in the other sequence's strands, and where it stands, or -1 if in several places or none."""
    return traces.longest_matches(_linked(spark, sf_dir)).withColumn("only_place", F.coalesce("only_place", F.lit(-1).cast("long")))


@query
def anchor_trace(spark, sf_dir):
    """The anchors of each walk, in the order of the query's places."""
    return traces.anchor_trace(_linked(spark, sf_dir))


@query
def linked_counts_by_fourths(spark, sf_dir):
    return cells(traces.linked_counts(_linked(spark, sf_dir), "jc"), "subject_id", "query_id", "seq_len")


@query
def linked_counts_by_letters(spark, sf_dir):
    return cells(traces.linked_counts(_linked(spark, sf_dir), "ani"), "subject_id", "query_id", "seq_len")


@query
def linked_distances(spark, sf_dir):
    """The distance of each document's sequence from its altered copy, by the walk both ways."""
    counted = traces.linked_counts(_linked(spark, sf_dir).filter("least(subject_id, query_id) < 0"))
    found = pairs.symmetric(counted).select(F.col("j").alias("seq_id"), models.jc(F.col("counts")).alias("distance"))
    return found.select("seq_id", rounded("distance"))
