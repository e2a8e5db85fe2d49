import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import models
from helixframe.functions.draws import multinomial
from helixframe.functions.numerics import c_div, c_ln
from helixframe.functions.sequence import both_strands, gc_content, genome_name, has_other_letters, name_cell, normalize
from helixframe.functions.thresholds import match_probability, thresholds
from helixframe.operators import aligned, diagnostics, pairs, phylip, traces
from helixframe.operators.anchors import Query, State, Subject, walk, walk_block
from helixframe.operators.sequences import from_table, genome_contigs, genome_pieces, join_contigs
from helixframe.plans.engine import Options, compare_files, lenient_options, matrix, replicate_matrices, run
from helixframe.sources import maf
from helixframe.sources.fasta import fasta_records, parse_fasta, read_fasta

S = "TACGAGCACTGGTGGAATTGATGTCCAGTCTTATATGGCGCACCAGGCTGATAGTAGTAGCAGTTTGCTTATCTCATCGCGTGTTTCCGGATGACAGAGA"
Q = "TACGTGCACTGGTGGGATTGATGTCTAGTATTATATGGCGCACCAGGATGATAGTAGTAGCAGTTTGCTTATCCCATCGCGTGTTTGCGGATGACCGAGA"


def revcomp(s):
    return s[::-1].translate(str.maketrans("ACGT!", "TGCA;"))


def strands(s):
    return revcomp(s) + "#" + s


def brute_walk(s, q, least, fourths):
    """The walk by the definition, each longest match from all places of both strands."""
    rs, c = strands(s), [0] * 16
    border = len(rs) // 2

    def lcp(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    def equal(run):
        if fourths:
            f, rest = divmod(len(run), 4)
            for k, n in zip((0, 5, 10, 15), (f, f, f, f + rest)):
                c[k] += n
        else:
            for x in run:
                if x in "ACGT":
                    c[5 * "ACGT".index(x)] += 1

    ls = lq = ln = pos = 0
    right = False
    while pos < len(q):
        t, hit = ls + pos - lq, False
        if t < len(rs) and pos - lq - ln <= least:
            n, at = lcp(q[pos:], rs[t:]), t
            hit = n >= least
        if not hit:
            all_n = [lcp(q[pos:], rs[i:]) for i in range(len(rs))]
            n = max(all_n)
            at, hit = all_n.index(n), all_n.count(n) == 1 and n >= least
        if hit:
            es, eq = ls + ln, lq + ln
            paired = at > es and pos - eq == at - es and (at < border) == (ls < border)
            if paired or right or ln >= 2 * least:
                equal(q[lq:eq])
            if paired:
                for x, y in zip(rs[es : es + pos - eq], q[eq:pos]):
                    if x in "ACGT" and y in "ACGT":
                        c[4 * "ACGT".index(x) + "ACGT".index(y)] += 1
            right, ls, lq, ln = paired, at, pos, n
        pos += n + 1
    if ln >= len(q):
        equal(q)
    elif right or ln >= 2 * least:
        equal(q[lq : lq + ln])
    return c


def test_walk_on_the_worked_pair():
    subject, trace = Subject(strands(S), 7), []
    assert walk(subject, Q, True, trace).tolist() == [20, 0, 1, 0, 2, 19, 1, 1, 0, 0, 20, 0, 0, 1, 0, 25]
    assert [t[:3] for t in trace] == [(5, 106, 10), (16, 117, 9), (31, 132, 16), (48, 149, 25), (74, 175, 12), (87, 188, 8)]
    assert walk(subject, Q, False).tolist() == [17, 0, 1, 0, 2, 15, 1, 1, 0, 0, 25, 0, 0, 1, 0, 27]
    assert walk(subject, revcomp(Q), True).tolist() == [20, 0, 1, 0, 0, 22, 0, 0, 1, 1, 20, 2, 0, 1, 1, 26]
    assert walk(subject, S, False).tolist() == [23, 0, 0, 0, 0, 20, 0, 0, 0, 0, 28, 0, 0, 0, 0, 29]


def test_walk_against_brute_force():
    rng = random.Random(3)
    for k in range(150):
        n = rng.choice([1, 5, 30, 80, 150])
        s = "".join(rng.choice("ACGT" if k % 3 else "AT") for _ in range(n))
        q = [s, "".join(rng.choice("ACGT") for _ in range(n)), revcomp(s), s[n // 3 :] + "!" + s[: n // 3], "".join(rng.choice("ACGT!") if rng.random() < 0.05 else x for x in s) * 2][k % 5]
        s = s[: n // 2] + "!" + s[n // 2 :] if k % 4 == 0 else s
        least = rng.choice([2, 5, 7, 9, 23, 30])
        for fourths in (True, False):
            assert walk(Subject(strands(s), least), q, fourths).tolist() == brute_walk(s, q, least, fourths)


def _odd_pair(rng):
    """A subject with repeats, a query made of parts of it, and a threshold."""
    n, letters = rng.choice([5, 30, 120, 400]), rng.choice(["ACGT", "ACGT", "AC", "ACGT!", "A"])
    s = "".join(rng.choice(letters) for _ in range(n))
    if rng.random() < 0.4:
        s = s + s[rng.randrange(n) :] + s[: rng.randrange(n)]
    q = list(s[rng.randrange(len(s)) :] * rng.choice([1, 1, 2]))
    if rng.random() < 0.3:
        q = list(revcomp("".join(q)).replace(";", "!"))
    for _ in range(rng.choice([0, 1, 3, 10])):
        q[rng.randrange(len(q))] = rng.choice("ACGT")
    return s, "".join(q), rng.choice([3, 5, 8, 23])


def test_walk_in_blocks_and_sections_against_brute_force():
    """Queries cut at random places, states carried as text, subjects indexed by sections, stretches of a few letters."""
    rng = random.Random(3)
    for _ in range(250):
        s, q, least = _odd_pair(rng)
        fourths, whole = rng.random() < 0.5, []
        want = brute_walk(s, q, least, fourths)
        assert walk(Subject(strands(s), least), q, fourths, whole).tolist() == want
        subject, overlap, stretch = Subject(strands(s), least, rng.choice([40, 300, 1 << 25])), rng.choice([30, 64]), rng.choice([7, 1 << 20])
        cuts = [0, *sorted(rng.sample(range(1, len(q)), min(len(q) - 1, rng.choice([1, 2, 5])))), len(q)] if len(q) > 1 else [0, len(q)]
        state, total, trace = State(), np.zeros(16, np.int64), []
        for low, high in zip(cuts, cuts[1:]):
            counts, state = walk_block(subject, Query(q[low : high + overlap], low, high, len(q), stretch), fourths, state, trace)
            state, total = State.from_json(state.to_json()), total + counts
        assert total.tolist() == want and trace == whole


def test_genomes_in_pieces_and_blocks(spark, monkeypatch):
    """No genome is one value, and blocks of queries are walked by different tasks until their states agree."""
    from helixframe.operators import pairs as module

    monkeypatch.setattr(module, "OVERLAP", 64)
    rng = random.Random(8)
    base = "".join(rng.choice("ACGT") for _ in range(3000))
    base += base[500:1500]  # a repeat longer than a block
    copy = lambda rate: "".join(rng.choice("ACGT") if rng.random() < rate else x for x in base)
    genomes = {"a": base, "b": base, "c": copy(0.02), "d": copy(0.1)[700:], "e": "", None: revcomp(copy(0.01))}
    docs = []
    for name, text in genomes.items():
        at = 0
        while at < len(text) or not at:
            step = rng.choice([0, 1, 90, 700])
            docs.append((len(docs), name, text[at : at + step]))
            at += max(step, 1 if not text else 0)
    sizes, pieces = genome_pieces(genome_contigs(spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(3)))
    joined = {}
    for name in genomes:
        joined[name] = "!".join(t for _, n, t in docs if n == name)
    known = {r["seq_id"]: (r["name"], r["len"]) for r in sizes.collect()}
    assert [known[k] for k in range(6)] == [(n, len(joined[n])) for n in ("a", "b", "c", "d", "e", None)]
    for model in ("jc", "ani"):
        got = {(r["subject_id"], r["query_id"]): (r["counts"], r["seq_len"]) for r in pairs.piece_counts(pieces, sizes, model, query_blocks=3, block=300).collect()}
        assert len(got) == 30
        for (i, j), (counts, n) in got.items():
            s, q = joined[known[i][0]], joined[known[j][0]]
            least = int(thresholds(np.array([(s.count("G") + s.count("C")) / len(s)]), np.array([2.0 * len(s) + 1]), 0.025)[0]) if s else None
            assert n == len(q) and counts == (walk(Subject(strands(s), least), q, model == "jc").tolist() if s else [0] * 16)


def _brute_matches(s, q):
    rs, found = strands(s), []
    for i in range(len(q)):
        best, where = 0, []
        for x in range(len(rs)):
            k = next((k for k in range(min(len(q) - i, len(rs) - x)) if q[i + k] != rs[x + k]), min(len(q) - i, len(rs) - x))
            best, where = (k, [x]) if k > best else (best, [*where, x] if k == best else where)
        found.append((i, best, where[0] if best and len(where) == 1 else None))
    return found


#: The worked pair's anchors: (place in query, place in subject, length, whether paired).
TRACE = [(5, 106, 10, False), (16, 117, 9, True), (31, 132, 16, True), (48, 149, 25, True), (74, 175, 12, True), (87, 188, 8, True)]


def test_matches_and_traces_as_rows(spark):
    rng = random.Random(4)
    texts = [S, Q, revcomp(Q), "", *(x for _ in range(10) for x in _odd_pair(rng)[:2])]
    links = [(a, b) for a in range(len(texts)) for b in range(len(texts)) if a != b and (b - a) % 5 < 2 and len(texts[a]) * len(texts[b]) < 30_000] + [(0, 1), (0, 2), (0, 99)]
    rows = traces.sequence_pairs(_seqs(spark, texts), spark.createDataFrame(links, "subject_id long, query_id long"))
    assert rows.count() == len(links) - 1
    for section in (1 << 25, 40):
        got = {}
        for r in traces.longest_matches(rows, section).collect():
            got.setdefault((r["subject_id"], r["query_id"]), []).append((r["place"], r["length"], r["only_place"]))
        for a, b in set(links) - {(0, 1), (0, 2), (0, 99)}:
            assert sorted(got.get((a, b), [])) == _brute_matches(texts[a], texts[b])
    found = traces.anchor_trace(rows.filter("subject_id = 0")).collect()
    assert [tuple(r)[2:] for r in found if r["query_id"] == 1][: len(TRACE)] == TRACE
    assert [tuple(r)[2:4] for r in found if r["query_id"] == 2] == [(5, 5), (14, 14), (27, 27), (53, 53), (76, 76), (85, 85)]
    for model in ("jc", "ani"):
        counted = {(r["subject_id"], r["query_id"]): r["counts"] for r in traces.linked_counts(rows, model).collect()}
        every = pairs.pair_counts(_seqs(spark, texts), model).collect()
        assert len(counted) == len(set(links)) - 1
        assert all(counted[r["subject_id"], r["query_id"]] == r["counts"] for r in every if (r["subject_id"], r["query_id"]) in counted)
    # a pair's cells add up to the letters of its paired anchors and of the gaps between them
    assert sum(counted[0, 1]) == TRACE[-1][0] + TRACE[-1][2] - TRACE[0][0]


def test_thresholds():
    given = [(8, 0.5, 5), (100, 0.5, 7), (1000, 0.3, 10), (1000, 0, 17), (1000, 1, 17), (200000, 0.15, 17), (4900000, 0.508, 15), (1073741823, 0.5, 19)]
    got = thresholds(np.array([g for _, g, _ in given]), np.array([2.0 * n + 1 for n, _, _ in given]), 0.025)
    assert got.tolist() == [t for *_, t in given]
    below, at = (match_probability(x, np.array([0.25]), np.array([100000.0]))[0] for x in (10, 11))
    assert below < 0.975 <= at


def test_expressions(spark):
    rows = spark.createDataFrame([(0, "ACGTTGCA"), (1, "11ACGTNN7682394689NNTGCA11"), (2, "@ACGT_!0TGCA        "), (3, None), (4, "acgu")], "i int, t string")
    seq = normalize(F.col("t"))
    got = [tuple(r) for r in rows.orderBy("i").select(seq, has_other_letters(F.col("t")), both_strands(seq)).collect()]
    assert got == [("ACGTTGCA", False, "TGCAACGT#ACGTTGCA"), ("ACGTTGCA", True, "TGCAACGT#ACGTTGCA"), ("ACGT!TGCA", True, "TGCA;ACGT#ACGT!TGCA"), ("", False, "#"), ("ACG", True, "CGT#ACG")]
    assert math.isnan(rows.filter("i = 3").select(gc_content(seq)).first()[0])
    paths = spark.createDataFrame([("a/b.v2.fa",), ("-",), ("/x/y",)], "p string").select(genome_name(F.col("p"))).collect()
    assert [r[0] for r in paths] == ["b", "-", "y"]
    assert spark.range(1).select(name_cell(F.lit("abc")), name_cell(F.lit("abcdefghijkl")), name_cell(F.lit("abcdefghijkl"), True)).first()[:] == ("abc       ", "abcdefghijkl", "abcdefghij")


def test_c_arithmetic(spark):
    pairs_ = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (-1.0, 0.0), (1.0, 2.0)], "a double, b double")
    got = [r[0] for r in pairs_.select(c_div(F.col("a"), F.col("b"))).collect()]
    assert math.isnan(got[0]) and got[1:] == [math.inf, -math.inf, 0.5]
    got = [r[0] for r in spark.createDataFrame([(-1.0,), (0.0,), (1.0,), (float("nan"),)], "x double").select(c_ln(F.col("x"))).collect()]
    assert math.isnan(got[0]) and got[1:3] == [-math.inf, 0.0] and math.isnan(got[3])


def test_models(spark):
    def of(model, same, other):
        counts = [same // 4, other, 0, 0, 0, same // 4, 0, 0, 0, 0, same // 4, 0, 0, 0, 0, same - 3 * (same // 4)]
        return spark.range(1).select(models.distance(model, F.array(*(F.lit(c).cast("long") for c in counts)))).first()[0]

    assert of("jc", 90, 10) == pytest.approx(0.10732563273050497)
    assert of("jc", 50, 50) == pytest.approx(0.8239592165010822)
    assert of("jc", 1, 3) == math.inf and math.isnan(of("jc", 1, 99)) and math.isnan(of("raw", 3, 0))
    assert of("ANI", 90, 10) == pytest.approx(90) and of("jc", 100, 0) == 0.0
    assert of("kimura", 3, 0) == 0.0 and all(math.isnan(of(m, 0, 0)) for m in models.MODELS)
    f = np.array([[30, 2, 1, 0], [1, 25, 0, 3], [2, 1, 20, 1], [0, 2, 1, 11]], float)
    p = f / f.sum()
    want = -0.25 * (np.log(np.linalg.det(p)) - 0.5 * (np.log(p.sum(0)).sum() + np.log(p.sum(1)).sum()))
    got = spark.range(1).select(models.logdet(F.array(*(F.lit(int(x)).cast("long") for x in f.ravel())))).first()[0]
    assert got == pytest.approx(want)
    with pytest.raises(ValueError):
        models.model_name("other")


def test_fasta_grammar():
    def errors(data):
        return [r[3] for r in parse_fasta(data)]

    assert errors(b"") == ["File is empty."] and errors(b"x") == ["File must start with '>'."]
    assert errors(b"> name\nA\n") == ["Empty name on line 1."]
    assert errors(b">a") == ["Unexpected EOF in name on line 1."] and errors(b">a c") == ["Unexpected EOF in comment on line 1."]
    assert errors(b">a\n") == ["Empty sequence on line 2."] and errors(b">a\n>b\nA\n")[0].startswith("Empty sequence")
    assert errors(b">a\nAC\n1\n") == [None, "Expected '>' but found '1' on line 3."]
    assert list(parse_fasta(b">a one two\r\nAC gt\r\n\r\nNN\n>b\nT")) == [("a", "one two\r", "ACgtNN", None), ("b", None, "T", None)]


def test_fasta_files(spark, tmp_path):
    (tmp_path / "one.v2.fa").write_text(">r1 x\nACGT\nACGT\n>r2\nNNGG\n")
    (tmp_path / "two.fa").write_text(">r1\nTTTT\n1\n")
    (tmp_path / "names").write_text(f"{tmp_path}/two.fa\n\n")
    seqs, errors = read_fasta(spark, [f"{tmp_path}/one.v2.fa", f"{tmp_path}/none.fa"], [f"{tmp_path}/names"])
    assert [tuple(r) for r in seqs.orderBy("seq_id").collect()] == [(0, "r1", "TTTT", 4, False), (1, "r1", "ACGTACGT", 8, False), (2, "r2", "GG", 2, True)]
    assert errors.count() == 2
    joined, _ = read_fasta(spark, [f"{tmp_path}/one.v2.fa", f"{tmp_path}/two.fa"], join=True)
    assert [tuple(r)[:3] for r in joined.orderBy("seq_id").collect()] == [(0, "one", "ACGTACGT!GG"), (1, "two", "TTTT")]
    with pytest.raises(ValueError):
        read_fasta(spark, [f"{tmp_path}/two.fa"], join=True)


FASTA = {
    "good": ">a one two\r\nAC gt\r\n\r\nNN\n>b\nT",
    "many": "".join(f">r{k} c{k}\n" + "ACGT" * (k % 50 + 1) + "\nTT\n" for k in range(60)),
    "stops": "".join(f">r{k}\nACGT\n" for k in range(30)) + "1\n>later\nA\n>again\n\n",
    "empty name": ">a\nA\n> x\nA\n",
    "empty sequence": ">a\nA\n>b\n\n\n>c\nA\n",
    "empty last": ">a\nA\n>b\n\n",
    "end in name": ">a\nA\n>b",
    "end in comment": ">a\nA\n>b c",
    "inside a line": ">a\nA >b x\nC\n  >c\nG >\n",
    "no record": "x\n>a\nA\n",
    "only a line end": "\n",
    "nothing": "",
    "é +%20": ">é\nA\n",
}


def test_fasta_split_over_tasks(spark, tmp_path):
    """Files cut at small byte ranges: records, lines and errors as the whole text gives them, and the same file twice."""
    paths = []
    for k, (name, text) in enumerate(FASTA.items()):
        paths.append(f"{tmp_path}/{k} {name}.fa")
        (tmp_path / f"{k} {name}.fa").write_bytes(text.encode())
    paths.append(paths[0])
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("150", old["spark.sql.files.maxPartitionBytes"]):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = [tuple(r) for r in fasta_records(spark, paths).collect()]
            want = [(k, n, *r) for k, text in enumerate([*FASTA.values(), FASTA["good"]]) for n, r in enumerate(parse_fasta(text.encode()))]
            assert sorted(got, key=lambda r: r[:2]) == want
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_lists_of_names(spark, tmp_path, monkeypatch):
    import io
    import sys

    (tmp_path / "a.fa").write_text(">a\nACGT\n")
    monkeypatch.setattr(sys, "stdin", type("Stdin", (), {"buffer": io.BytesIO(f"{tmp_path}/a.fa\n\n{tmp_path}/none.fa\n".encode())}))
    seqs, errors = read_fasta(spark, [f"{tmp_path}/a.fa"], ["-", f"{tmp_path}/nolist"])
    assert [r["name"] for r in seqs.orderBy("seq_id").collect()] == ["a", "a"]
    found = {(r["code"], r["i"], r["message"].rsplit("/", 1)[1]) for r in diagnostics.file_diagnostics(errors).collect()}
    assert found == {("fasta", 1, "none.fa: No such file or directory"), ("list", None, "nolist: No such file or directory")}


def _seqs(spark, texts):
    return from_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_run_and_blocks(spark):
    seqs = _seqs(spark, [S, Q, revcomp(Q), "ACGT" * 10])
    got = run(seqs, Options(bootstrap=3, seed=5))
    d = {(r["i"], r["j"]): r["distance"] for r in got.distances.collect()}
    assert d[0, 1] == d[1, 0] == pytest.approx(0.06981781729950898) and len(d) == 12
    once = sorted(map(tuple, got.pairs.select("subject_id", "query_id", F.col("counts").cast("string")).collect()))
    for blocks in ((1, 1), (3, 2)):
        other = pairs.pair_counts(seqs, subject_blocks=blocks[0], query_blocks=blocks[1])
        assert sorted(map(tuple, other.select("subject_id", "query_id", F.col("counts").cast("string")).collect())) == once
    reps = got.replicates.collect()
    assert len(reps) == 24 and sorted(map(str, reps)) == sorted(map(str, run(seqs, Options(bootstrap=3, seed=5)).replicates.collect()))
    codes = {(r["code"], r["i"]) for r in got.diagnostics.collect()}
    assert ("short", 0) in codes
    for texts in (["ACGT"], ["ACGT", "NNNN"]):
        with pytest.raises(ValueError):
            run(_seqs(spark, texts))


def test_unrelated_and_little_homology(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    common = word(100)
    seqs = _seqs(spark, [word(3000), word(3000), common + word(3000), common + word(3000)])
    found = {(r["code"], r["i"], r["j"]) for r in run(seqs).diagnostics.collect()}
    assert ("nan", 0, 1) in found and ("nan", 1, 0) in found and ("low_homology", 2, 3) in found


def _turned(letters, places, rng):
    out = letters.copy()
    out[places] = (out[places] + rng.integers(1, 4, len(places))) % 4
    return out


def _text(codes):
    return np.frombuffer(b"ACGT", np.uint8)[codes].tobytes().decode()


def test_acceptance(spark):
    """Pairs of 100,000 letters with a given number of substitutions: at most 5.5 % off, by JC and by raw distance."""
    rng, n, rows = np.random.default_rng(1729), 100_000, []
    wanted = [(m, d, k) for m in ("jc", "raw") for d in (0.0, 0.001, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3) for k in range(2)]
    for at, (m, d, _) in enumerate(wanted):
        share = 0.75 * (1 - math.exp(-4 * d / 3)) if m == "jc" else d
        a = rng.integers(0, 4, n)
        b = _turned(a, rng.choice(n, round(share * n), replace=False), rng)
        rows += [(at, 2 * at, _text(a)), (at, 2 * at + 1, _text(b))]
    seqs = spark.createDataFrame(rows, "pair long, seq_id long, seq string").repartition(8).withColumn("len", F.length("seq").cast("long"))
    counted = pairs.pair_counts_within(seqs, "pair").groupBy("pair").agg(F.array(*(F.sum(F.col("counts")[k]) for k in range(16))).alias("counts"))
    got = {r["pair"]: r for r in counted.select("pair", models.jc(F.col("counts")).alias("jc"), models.raw(F.col("counts")).alias("raw")).collect()}
    for at, (m, d, _) in enumerate(wanted):
        assert abs(got[at][m] - d) <= min(0.055, 0.055 * d), (m, d, got[at][m])


@pytest.mark.parametrize("left, right", [((0, 1, 2), (0, 1, 2)), ((2,), (1, 2)), ((0, 2), (0, 1, 2))])
def test_joined_acceptance(spark, left, right):
    """Contigs of 1,000, 1,000 and 10,000 letters, some of them missing: raw distance within .03 of .1."""
    rng = np.random.default_rng(5)
    contigs = [rng.integers(0, 4, n) for n in (1000, 1000, 10000)]
    share = 0.75 * (1 - math.exp(-0.4 / 3))
    copies = [_turned(c, rng.choice(len(c), round(share * len(c)), replace=False), rng) for c in contigs]
    rows = [("a", k, _text(contigs[k])) for k in left] + [("b", k, _text(copies[k])) for k in right]
    g = join_contigs(spark.createDataFrame(rows, "source string, doc_id long, text string"))
    assert all(abs(r["distance"] - 0.1) < 0.03 for r in pairs.distances(pairs.pair_counts(g), "raw").collect())


def test_aligned_pairs_against_brute_force(spark):
    rng = random.Random(4)
    docs = [(k, rng.choice(["a", "b", "c", None]), None if k % 9 == 0 else "".join(rng.choice("ACGT!x") for _ in range(rng.choice([0, 3, 40])))) for k in range(60)]
    docs += [(60, "a", "ACGT" * 30000), (61, "b", "AGGT" * 20000), (61, "b", "AC")]
    rows = spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(5)
    joined = {r["seq_id"]: r for r in join_contigs(rows).collect()}
    assert [joined[k]["name"] for k in range(4)] == ["a", "b", "c", None] and all(r["len"] == len(r["seq"]) for r in joined.values())
    got = {(r["subject_id"], r["query_id"]): r for r in aligned.aligned_pairs(*genome_pieces(genome_contigs(rows))[::-1]).collect()}
    assert len(got) == 12
    for (a, b), r in got.items():
        want = [0] * 16
        for x, y in zip(joined[a]["seq"], joined[b]["seq"]):
            if x in "ACGT" and y in "ACGT":
                want[4 * "ACGT".index(x) + "ACGT".index(y)] += 1
        # two contigs of one order stand in either order in a joined sequence
        assert r["counts"] == want or 1 in (a, b) and sum(r["counts"]) == sum(want)
        assert r["seq_len"] == joined[b]["len"]
    pieces = rows.select(F.col("doc_id").alias("seq_id"), F.lit(0).cast("long").alias("place"), normalize(F.col("text")).alias("seq")).filter("seq_id < 50")
    many = pieces.select("seq_id", F.length("seq").cast("long").alias("len"))
    assert aligned.aligned_pairs(pieces, many).count() == 50 * 49


def test_mutation_counts(spark):
    rows = spark.createDataFrame([(1, "ACGT", "AGGTA"), (1, "A", "T"), (2, "", "A"), (3, None, None), (4, "A!C", "ACC")], "k int, s string, q string")
    got = {r["k"]: r["counts"] for r in aligned.mutation_counts(rows, ["k"], "s", "q").collect()}
    assert sum(got[1]) == 5 and got[1][0] == 1 and got[1][6] == 1 and got[1][3] == 1 and got[2] == got[3] == [0] * 16 and sum(got[4]) == 2


def test_null_names_are_genomes(spark):
    rows = spark.createDataFrame([(1, None, "ACG"), (2, "x", "GGT"), (3, None, "T")], "doc_id long, source string, text string")
    assert [tuple(r)[:4] for r in join_contigs(rows).orderBy("seq_id").collect()] == [(0, "x", "GGT", 3), (1, None, "ACG!T", 5)]


def test_options_and_one_table_of_errors(spark, tmp_path):
    options, messages = lenient_options(model="nosuch", bootstrap="2", p_value=7)
    assert (options.model, options.bootstrap, options.p_value) == ("jc", 2, 0.025) and len(messages) == 2
    (tmp_path / "a.fa").write_text(f">a\n{S}\n>b\n{Q}\n1\n")
    seqs, errors = read_fasta(spark, [f"{tmp_path}/a.fa", f"{tmp_path}/none.fa"])
    got = run(seqs, options, errors, messages)
    codes = sorted(r["code"] for r in got.diagnostics.collect())
    assert codes == ["fasta", "fasta", "option", "option", "short", "short"] and diagnostics.exit_status(got.diagnostics) == 1
    assert diagnostics.exit_status(got.diagnostics.filter("level = 'warning'")) == 0
    lines = {(r["replicate"], r["line_no"]): r["line"] for r in replicate_matrices(got, seqs).collect()}
    assert set(lines) == {(k, n) for k in (0, 1) for n in (0, 1, 2)} and lines[0, 1] == "a          0.0000 0.0698" and lines[1, 0] == "2"
    assert {(r["line_no"], r["line"]) for r in matrix(got, seqs).collect()} == {(n, x) for (k, n), x in lines.items() if k == 0}


def test_comparing_files(spark, tmp_path):
    """Files and options as a user has them, to lines of text, diagnostics and an exit status."""
    (tmp_path / "a.fa").write_text(f">a x\n{S}\n")
    (tmp_path / "b.fa").write_text(f">b\n{Q[:50]}\n>c\n{Q[50:]}\n")
    got = compare_files(spark, [f"{tmp_path}/a.fa", f"{tmp_path}/b.fa", f"{tmp_path}/none.fa"], join=True, verbose=1, bootstrap="2", model="JC", truncate_names="maybe")
    lines = [r["line"] for r in got.lines.orderBy("part", "line_no").collect()]
    assert lines[0] == "2" and lines[1].startswith("a          0.0000 0.0") and lines[3:5] == ["", "Coverage:"] and len(lines) == 10 and lines[7] == "2"
    assert {r["code"] for r in got.diagnostics.collect()} == {"short", "option", "fasta"} and got.status == 1
    both = compare_files(spark, [f"{tmp_path}/a.fa", f"{tmp_path}/b.fa"], join=True, verbose=2, model="ani")
    assert got.result.distances.count() == 2 and len(both.lines.collect()) == 7 and both.result.coverages.count() == 2


def test_options_of_any_type():
    assert lenient_options(symmetric="false", truncate_names="no", subject_blocks="3", seed="7", p_value="0.05") == (Options(symmetric=False, truncate_names=False, subject_blocks=3, seed=7, p_value=0.05), [])
    options, messages = lenient_options(symmetric="maybe", subject_blocks="x", query_blocks=0, bootstrap=2.5, seed=True, p_value="nan", nosuch=1)
    assert options == Options() and len(messages) == 7 and messages[-1] == "Ignoring unknown option nosuch."
    assert lenient_options(symmetric=0, query_blocks=None, bootstrap="4") == (Options(symmetric=False, bootstrap=4), [])


def test_maf(spark, tmp_path):
    long = "ACGTACGTAC" * 6 + "GG"
    (tmp_path / "x.maf").write_text(f"##maf\na score=1 mult=2\ns one 0 4 + 4 AC-T\ns a_rather_long_name 0 4 + 4 ACGT\n\na mult=3\ns one 0 1 + 1 A\ns three 0 1 + 1 A\n\na mult=2\ns a_rather_long_name 0 4 + 4 {long}\ns one 1 2 + 4 {long}\n")
    (tmp_path / "y.maf").write_bytes((tmp_path / "x.maf").read_bytes().replace(b"\n", b"\r\n"))
    other = [r["line"] for r in maf.interleaved_lines(maf.maf_alignment(spark, str(tmp_path / "y.maf"), 2)).orderBy("line_no").collect()]
    lines = [r["line"] for r in maf.interleaved_lines(maf.maf_alignment(spark, str(tmp_path / "x.maf"), 2)).orderBy("line_no").collect()]
    assert lines == other == ["2 66", "one        " + ("AC-T" + long)[:60], "a_rather_l " + ("ACGT" + long)[:60], "", long[-6:], long[-6:], ""]


def test_matrix_text(spark):
    seqs = spark.createDataFrame([(0, "a", "", 0), (1, "long_name_here", "", 0)], "seq_id long, name string, seq string, len long")
    d = spark.createDataFrame([(0, 1, 0.0004), (1, 0, float("nan"))], "i long, j long, distance double")
    assert [r["line"] for r in phylip.distance_lines(d, seqs).orderBy("line_no").collect()] == ["2", "a          0.0000e+00 4.0000e-04", "long_name_here nan 0.0000e+00"]
    d = spark.createDataFrame([(0, 1, 0.25), (1, 0, float("inf"))], "i long, j long, distance double")
    assert [r["line"] for r in phylip.distance_lines(d, seqs, True).orderBy("line_no").collect()] == ["2", "a          0.0000 0.2500", "long_name_ inf 0.0000"]
    c = spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.25)], "subject_id long, query_id long, coverage double")
    assert [r["line"] for r in phylip.coverage_lines(c, seqs).orderBy("line_no").collect()] == ["1.0000e+00 5.0000e-01 ", "2.5000e-01 1.0000e+00 "]


def test_joined_contigs_and_names(spark):
    docs = spark.createDataFrame([(2, "b", "GG"), (1, "b", "xAC"), (3, "a", None)], "doc_id long, source string, text string")
    assert [tuple(r) for r in join_contigs(docs).orderBy("seq_id").collect()] == [(0, "a", "", 0, False), (1, "b", "AC!GG", 5, True)]
    codes = {(r["code"], r["i"]) for r in diagnostics.sequence_diagnostics(join_contigs(docs)).collect()}
    assert codes == {("empty", 0), ("short", 1), ("non_acgt", 1)}


def test_matrix_files(spark, tmp_path, monkeypatch):
    """Rows put together by tiles, written by many tasks, read again in the order of files; nothing is left of a failed job."""
    monkeypatch.setattr(phylip, "TILE", 7)
    n = 60
    rows = [(r, i, j, ((i * 31 + j * 7 + r) % 97) / 100) for r in range(2) for i in range(n) for j in range(n) if i != j]
    d = spark.createDataFrame(rows, "replicate int, i long, j long, distance double").repartition(5)
    names = spark.createDataFrame([(k, f"name{k}") for k in range(n)], "seq_id long, name string")
    lines = phylip.replicate_lines(d, names)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small as they are
    try:
        phylip.write_matrices(lines, f"{tmp_path}/out")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(tmp_path.glob("out/part-*"))
    got = "".join(f.read_text() for f in files)
    cell = lambda r, i, j: 0.0 if i == j else ((i * 31 + j * 7 + r) % 97) / 100
    want = "".join(f"{n}\n" + "".join(f"name{i}".ljust(10) + "".join(f" {cell(r, i, j):.4f}" for j in range(n)) + "\n" for i in range(n)) for r in range(2))
    assert got == want and len(files) > 1
    bad = lines.withColumn("line", F.when(F.col("line_no") == 30, F.raise_error(F.lit("no"))).otherwise(F.col("line")).cast("string"))
    with pytest.raises(Exception):
        phylip.write_matrices(bad, f"{tmp_path}/bad")
    assert not list(tmp_path.glob("bad/part-*"))


def test_draws(spark):
    """Cells of a multinomial over many keys: totals, means, variances and covariances, for large and for small counts."""
    for counts in ([400, 0, 3, 1, 0, 90_000, 2, 0, 7, 0, 50_000, 1, 0, 0, 0, 120_000], [3, 0, 1, 0, 0, 2, 0, 0, 0, 0, 9, 0, 0, 0, 0, 1], [0] * 16, [0, 0, 0, 5] + [0] * 12):
        column = F.array(*(F.lit(c).cast("long") for c in counts))
        rows = spark.range(4000).select(multinomial(column, F.concat(F.lit("seed/"), F.col("id").cast("string"))).alias("c")).collect()
        got, total = np.array([r["c"] for r in rows], float), sum(counts)
        assert (got.sum(axis=1) == total).all() and (got >= 0).all()
        p = np.array(counts) / max(total, 1)
        assert (got[:, p == 0] == 0).all()
        sd = np.sqrt(np.maximum(total * p * (1 - p), 1e-12))
        assert (np.abs(got.mean(axis=0) - total * p) < 5 * sd / np.sqrt(4000) + 1e-9).all()
        assert np.allclose(got.var(axis=0), sd**2, rtol=0.15, atol=0.05)
        if total > 1000:
            assert np.corrcoef(got[:, 5], got[:, 15])[0, 1] == pytest.approx(-np.sqrt(p[5] * p[15] / ((1 - p[5]) * (1 - p[15]))), abs=0.06)


def test_lanes_against_the_plain_walk(monkeypatch):
    """Lanes, words in large groups, letters in files and cut queries give the anchors and counts of a walk place by place."""
    from helixframe.operators import anchors, lanes

    rng = random.Random(5)
    monkeypatch.setattr(anchors, "IN_MEMORY", 100)
    for _ in range(120):
        for name, choices in {"LANE": (16, 64, 200), "LEAD": (0, 8, 50), "SEGMENT": (300, 1 << 22), "FEW": (0, 1, 64), "ROUNDS": (0, 1, 16)}.items():
            monkeypatch.setattr(lanes, name, rng.choice(choices))
        s, q, least = _odd_pair(rng)
        q, fourths, want, got, state, total = q * rng.choice([1, 1, 3]), rng.random() < 0.5, [], [], State(), np.zeros(16, np.int64)
        counts = walk(Subject(strands(s), least), q, fourths, want).tolist()
        subject, overlap = Subject(strands(s), least, rng.choice([40, 300, 1 << 25])), rng.choice([30, 64])
        cuts = [0, *sorted(rng.sample(range(1, len(q)), min(len(q) - 1, rng.choice([0, 1, 3])))), len(q)] if len(q) > 1 else [0, len(q)]
        for low, high in zip(cuts, cuts[1:]):
            more, state = lanes.walk_lanes(subject, Query(q[low : high + overlap], low, high, len(q)), fourths, state, got)
            state, total = State.from_json(state.to_json()), total + more
        assert got == want and total.tolist() == counts


def test_memory_of_an_indexed_pair(monkeypatch):
    """Building an index takes a few bytes a symbol, a walk over it next to none for each letter of the query."""
    import tracemalloc

    from helixframe.operators import anchors, lanes

    letters = np.frombuffer(b"ACGT", np.uint8)[np.random.default_rng(2).integers(0, 4, 800_000)].tobytes()
    for name in ("SORTED", "STRETCH", "IN_MEMORY"):
        monkeypatch.setattr(anchors, name, 1 << 16)
    monkeypatch.setattr(lanes, "SEGMENT", 1 << 16)
    both, query = strands(letters.decode()).encode(), Query(letters[3:400_000] + letters[500_000:])
    tracemalloc.start()
    try:
        for section, most in ((1 << 24, 16), (1 << 20, 8)):
            tracemalloc.reset_peak()
            subject = Subject(both, 15, section)
            assert subject.index.n == len(both)
            assert tracemalloc.get_traced_memory()[1] < most * len(both)
            tracemalloc.reset_peak()
            before = tracemalloc.get_traced_memory()[0]
            counts, _ = lanes.walk_lanes(subject, query, True)
            assert counts.sum() == len(query.bytes) - 1 and tracemalloc.get_traced_memory()[1] - before < 8 * len(query.bytes)
            del subject
    finally:
        tracemalloc.stop()


def test_long_genomes_in_blocks_by_lanes(spark, monkeypatch):
    from helixframe.operators import pairs as module

    monkeypatch.setattr(module, "LONG", 100)
    monkeypatch.setattr(module, "LEAD", 200)
    rng = random.Random(6)
    base = "".join(rng.choice("ACGT") for _ in range(4000)) * 2 + "AC" * 400
    texts = [base, "".join(rng.choice("ACGT") if rng.random() < 0.02 else x for x in base)[500:], "", revcomp(base[1000:7000]) + "!" + base[:900]]
    rows = _seqs(spark, texts)
    found = pairs.piece_counts(*pairs.in_pieces(rows), "ani", block=1500).collect()
    assert len(found) == 12
    plain = {(r["subject_id"], r["query_id"]): r["counts"] for r in pairs.pair_counts_within(rows.withColumn("k", F.lit(0).cast("long")), "k", "ani").collect()}
    assert all(r["counts"] == plain[r["subject_id"], r["query_id"]] for r in found)


def test_longest_matches_at_once_and_by_tasks(spark, monkeypatch):
    """Places are compared together or, where words are common or matches long, one by one; the letters of few files are dealt to many tasks."""
    from helixframe.operators import anchors

    rng = random.Random(10)
    for _ in range(40):
        monkeypatch.setattr(anchors, "AT_ONCE", rng.choice([1, 3, 20]))
        s, q, _ = _odd_pair(rng)
        q = q[:150]
        lengths, only = Subject(strands(s), 1).longest_matches(Query(q), 0, 2 * len(s) + 1)
        assert [(k, n, x if x >= 0 else None) for k, (n, x) in enumerate(zip(lengths.tolist(), only.tolist()))] == _brute_matches(s, q)
    monkeypatch.undo()
    monkeypatch.setattr(traces, "LETTERS", 100)
    texts = ["".join(rng.choice("ACGT") for _ in range(90)) for _ in range(12)]
    rows = traces.sequence_pairs(_seqs(spark, texts), spark.createDataFrame([(a, a + 1) for a in range(11)], "subject_id long, query_id long")).coalesce(1)
    found = traces.longest_matches(rows)
    assert found.groupBy(F.spark_partition_id()).count().count() > 3
    assert {(r["subject_id"], r["place"], r["length"], r["only_place"]) for r in found.collect()} == {(a, *x) for a in range(11) for x in _brute_matches(texts[a], texts[a + 1])}
