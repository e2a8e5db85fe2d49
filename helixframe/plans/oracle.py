"""The same queries as SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

from ..functions.sequence import CELLS
from ..functions.thresholds import P_VALUE

SEQS = "seqs AS (SELECT doc_id AS seq_id, source, lang, coalesce(text, '') AS raw, upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt!]', '', 'g')) AS seq FROM documents)"
COUNTED = ", ".join(f"count(*) FILTER (WHERE s = '{c[0]}' AND q = '{c[1]}') AS n_{c.lower()}" for c in CELLS)
NAMES = [f"n_{c.lower()}" for c in CELLS]
TOTAL = "(" + " + ".join(NAMES) + ")"
OFF = "(" + " + ".join(n for n, c in zip(NAMES, CELLS, strict=True) if c[0] != c[1]) + ")"
TRANSITIONS, TRANSVERSIONS = "(n_ag + n_ga + n_ct + n_tc)", "(n_ac + n_ca + n_at + n_ta + n_gc + n_cg + n_gt + n_tg)"


def _div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE))"


def _ln(x: str) -> str:
    return f"(CASE WHEN isnan({x}) OR ({x}) < 0 THEN 'NaN'::DOUBLE WHEN ({x}) = 0 THEN '-Infinity'::DOUBLE ELSE ln({x}) END)"


def _floor(x: str) -> str:
    return f"(CASE WHEN ({x}) <= 0 THEN 0.0 ELSE ({x}) END)"


RAW = f"(CASE WHEN {TOTAL} <= 3 THEN 'NaN'::DOUBLE ELSE {_div(OFF, TOTAL)} END)"


def _det() -> str:
    """The determinant of the shares by expansion along rows."""
    m = {c: _div(f"n_{c.lower()}", TOTAL) for c in CELLS}

    def minor(rows: str, cols: str) -> str:
        if len(rows) == 1:
            return m[rows + cols]
        return "(" + " ".join(f"{'+-'[k % 2]} {m[rows[0] + c]} * {minor(rows[1:], cols.replace(c, ''))}" for k, c in enumerate(cols)) + ")"

    return minor("ACGT", "ACGT")


def _logdet() -> str:
    margins = [_div("(" + " + ".join(n for n, c in zip(NAMES, CELLS, strict=True) if c[side] == x) + ")", TOTAL) for side in (0, 1) for x in "ACGT"]
    return f"-0.25 * ({_ln('det')} - 0.5 * ({' + '.join(_ln(x) for x in margins)}))"


JC = _floor(f"-0.75 * {_ln(f'1.0 - (4.0::DOUBLE / 3.0::DOUBLE) * {RAW}')}")
P, Q = _div(TRANSITIONS, TOTAL), _div(TRANSVERSIONS, TOTAL)
MODEL = {
    "raw": RAW,
    "jc": JC,
    "kimura": _floor(f"-0.25 * {_ln(f'(1.0 - 2.0 * {Q}) * (1.0 - 2.0 * {P} - {Q}) * (1.0 - 2.0 * {P} - {Q})')}"),
    "logdet": _floor(_logdet()),
    "ani": f"(1.0 - {RAW}) * 100.0",
}


def _round(x: str) -> str:
    return f"(CASE WHEN isnan({x}) OR isinf({x}) THEN {x} ELSE round({x}, 9) END)"


MUTANTS = f"""{SEQS}, letters AS (SELECT seq_id, unnest(range(length(seq))) AS p, unnest(string_split(seq, '')) AS s FROM seqs WHERE seq <> ''),
    turned AS (SELECT seq_id, s, CASE WHEN (seq_id * 31 + p * 7) % 97 = 0 THEN translate(s, 'ACGT', 'CGTA') ELSE s END AS q FROM letters),
    found AS (SELECT seq_id, {COUNTED} FROM turned GROUP BY seq_id),
    counted AS (SELECT seq_id, {', '.join(f'coalesce({n}, 0) AS {n}' for n in NAMES)} FROM seqs LEFT JOIN found USING (seq_id))"""


def _genomes(by: str) -> str:
    return f"""{SEQS}, genomes AS (SELECT row_number() OVER (ORDER BY {by}) - 1 AS seq_id, {by} AS name, string_agg(seq, '!' ORDER BY seq_id) AS seq, bool_or(length(raw) <> length(seq)) AS other_letters
    FROM seqs GROUP BY {by})"""


PAIRED = f"""{_genomes('lang')}, letters AS (SELECT seq_id, unnest(range(1, length(seq) + 1)) AS p, unnest(string_split(seq, '')) AS x FROM genomes),
    counted AS (SELECT a.seq_id AS subject_id, b.seq_id AS query_id, {COUNTED.replace('s =', 'a.x =').replace('q =', 'b.x =')} FROM letters a JOIN letters b ON a.p = b.p AND a.seq_id <> b.seq_id GROUP BY ALL),
    paired AS (SELECT counted.*, length(g.seq) AS seq_len FROM counted JOIN genomes g ON g.seq_id = query_id),
    summed AS (SELECT least(subject_id, query_id) AS i, greatest(subject_id, query_id) AS j, {', '.join(f'sum({n})::BIGINT AS {n}' for n in NAMES)}, sum(seq_len)::BIGINT AS seq_len FROM paired GROUP BY ALL),
    both_ways AS (SELECT i, j, {RAW} AS raw, {JC} AS jc FROM summed UNION ALL SELECT j, i, {RAW}, {JC} FROM summed),
    covered AS (SELECT subject_id, query_id, {_div(TOTAL, 'seq_len')} AS coverage FROM paired)"""

PROBABILITY = f"""least(1.0, list_sum(list_transform(range(x + 1), lambda k: pow(2.0, x) * (pow(gc / 2.0, k) * pow(0.5 - gc / 2.0, x - k))
    * pow(1.0 - pow(gc / 2.0, k) * pow(0.5 - gc / 2.0, x - k), l) * (factorial(x::INTEGER)::DOUBLE / (factorial(k::INTEGER)::DOUBLE * factorial((x - k)::INTEGER)::DOUBLE)))))"""

#: Words of this many letters are looked up in pairs; shorter matches by their words' counts.
WORD = 8
LINKED = f"""{SEQS.replace('seqs AS', 'own AS')}, mutants AS (SELECT seq_id, array_to_string(list_transform(string_split(seq, ''), lambda x, i: CASE WHEN (seq_id * 31 + (i - 1) * 7) % 97 = 0 THEN translate(x, 'ACGT', 'CGTA') ELSE x END), '') AS seq FROM own),
    given AS (SELECT seq_id, seq FROM own UNION ALL SELECT -1 - seq_id, seq FROM mutants),
    links AS (SELECT a.seq_id AS sid, b.seq_id AS qid FROM own a JOIN own b ON a.seq_id = b.seq_id - 1 UNION ALL SELECT seq_id, -1 - seq_id FROM own WHERE seq_id IS NOT NULL UNION ALL SELECT -1 - seq_id, seq_id FROM own WHERE seq_id IS NOT NULL)"""


def _matches() -> str:
    """Longest matches: of short words by their counts, of words of WORD letters by runs of words on a diagonal."""
    return f"""{LINKED},
    subjects AS (SELECT seq_id AS sid, translate(reverse(seq), 'ACGT!', 'TGCA;') || '#' || seq AS rs FROM given),
    words AS MATERIALIZED (SELECT sid, b + unnest(range(least(64, length(rs) - b))) AS x, unnest(list_transform(range(least(64, length(rs) - b)), lambda i: substring(piece, i + 1, {WORD}))) AS w
        FROM (SELECT sid, rs, b, substring(rs, b + 1, 64 + {WORD}) AS piece FROM (SELECT sid, rs, unnest(range(0, length(rs), 64)) AS b FROM subjects))),
    places AS MATERIALIZED (SELECT seq_id AS qid, b + unnest(range(least(64, length(seq) - b))) AS p, unnest(list_transform(range(least(64, length(seq) - b)), lambda i: substring(piece, i + 1, {WORD}))) AS w
        FROM (SELECT seq_id, seq, b, substring(seq, b + 1, 64 + {WORD}) AS piece FROM (SELECT seq_id, seq, unnest(range(0, length(seq), 64)) AS b FROM given))),
    kmers AS (SELECT sid, left(w, k) AS w, min(x) AS x, count(*) AS n FROM words, range(1, {WORD}) t(k) WHERE length(w) >= k GROUP BY ALL),
    asked AS MATERIALIZED (SELECT sid, qid, p, w, left(w, k) AS v FROM links JOIN places USING (qid) CROSS JOIN range(1, {WORD + 1}) t(k) WHERE length(w) >= k),
    short AS (SELECT sid, qid, p, max({{'length': length(v), 'n': n, 'x': x}}) AS best FROM asked JOIN (SELECT sid, w AS v, x, n FROM kmers) USING (sid, v) GROUP BY ALL),
    seeds AS (SELECT sid, qid, p, x - p AS d FROM (SELECT sid, qid, p, v FROM asked WHERE length(v) = {WORD}) JOIN (SELECT sid, x, w AS v FROM words) USING (sid, v)),
    diagonals AS MATERIALIZED (SELECT sid, qid, d, p, max(p) OVER (PARTITION BY sid, qid, d, g) - p + {WORD} AS n FROM (SELECT *, p - row_number() OVER (PARTITION BY sid, qid, d ORDER BY p) AS g FROM seeds)),
    long AS (SELECT sid, qid, p, max(n) AS n, arg_max({{'several': c, 'x': x}}, n) AS best FROM (SELECT sid, qid, p, n, count(*) AS c, min(p + d) AS x FROM diagonals GROUP BY ALL) GROUP BY ALL),
    matches AS MATERIALIZED (SELECT sid, qid, p, coalesce(long.n, short.best.length, 0)::BIGINT AS n, CASE WHEN long.best.several = 1 THEN long.best.x WHEN long.n IS NULL AND short.best.n = 1 THEN short.best.x END AS x
        FROM links JOIN places USING (qid) LEFT JOIN short USING (sid, qid, p) LEFT JOIN long USING (sid, qid, p))"""


def _anchors() -> str:
    """The walk, one place a step; a match on the last anchor's diagonal has its length from the diagonal's runs."""
    return f"""RECURSIVE {_matches()},
    likely AS (SELECT seq_id AS sid, length(regexp_replace(seq, '[^GC]', '', 'g'))::DOUBLE / length(seq) AS gc, 2.0 * length(seq) + 1 AS l FROM given WHERE seq <> ''),
    thresholds AS (SELECT sid, min(x) AS t FROM (SELECT sid, x, {PROBABILITY} AS p FROM (SELECT *, unnest(range(1, 33)) AS x FROM likely)) WHERE p >= 1 - {P_VALUE} GROUP BY sid),
    pairs AS MATERIALIZED (SELECT sid, qid, rs, seq AS q, t FROM links JOIN subjects USING (sid) JOIN thresholds USING (sid) JOIN given ON seq_id = qid),
    walk AS (SELECT sid, qid, 0::BIGINT AS pos, 0::BIGINT AS s, 0::BIGINT AS b, 0::BIGINT AS n, false AS paired, false AS hit FROM pairs
        UNION ALL SELECT sid, qid, pos + len + 1, CASE WHEN ok THEN here ELSE s END, CASE WHEN ok THEN pos ELSE b END, CASE WHEN ok THEN len ELSE n END, CASE WHEN ok THEN here > s + n AND pos - b - n = here - s - n AND (here < border) = (s < border) ELSE paired END, ok
        FROM (SELECT *, coalesce(len >= t AND here IS NOT NULL, false) AS ok
            FROM (SELECT a.*, CASE WHEN lucky THEN ahead ELSE x END AS here, CASE WHEN lucky THEN coalesce(o.n, list_max(list_filter(range({WORD}), lambda k: pos + k <= length(q) AND ahead + k <= length(rs) AND substring(q, pos + 1, k) = substring(rs, ahead + 1, k)))) ELSE m.n END AS len
                FROM (SELECT *, pos - b - n <= t AND ahead + t <= length(rs) AND pos + t <= length(q) AND substring(q, pos + 1, t) = substring(rs, ahead + 1, t) AS lucky
                    FROM (SELECT w.*, rs, q, t, length(rs) // 2 AS border, s + pos - b AS ahead FROM walk w JOIN pairs ON w.sid = pairs.sid AND w.qid = pairs.qid WHERE pos < length(q))) a
                LEFT JOIN matches m ON m.sid = a.sid AND m.qid = a.qid AND m.p = a.pos LEFT JOIN diagonals o ON o.sid = a.sid AND o.qid = a.qid AND o.p = a.pos AND o.d = a.ahead - a.pos))),
    anchors AS MATERIALIZED (SELECT sid, qid, b, s, n, paired FROM walk WHERE hit)"""


def _linked(fourths: bool) -> str:
    """Cells of the runs of anchors that count, and of the gaps between partners."""
    same = "sum(n // 4) AS n_aa, sum(n // 4) AS n_cc, sum(n // 4) AS n_gg, sum(n // 4 + n % 4) AS n_tt" if fourths else "count(*) FILTER (a = 'A') AS n_aa, count(*) FILTER (a = 'C') AS n_cc, count(*) FILTER (a = 'G') AS n_gg, count(*) FILTER (a = 'T') AS n_tt"
    of = "equal" if fourths else "(SELECT sid, qid, left(w, 1) AS a FROM (SELECT sid, qid, b + unnest(range(n)) AS p FROM equal) JOIN places USING (qid, p))"
    run = lambda c: f"coalesce(any_value(e.n_{c.lower()}), 0)" if c[0] == c[1] else "0"
    sums = ", ".join(f"(count(*) FILTER (g.s = '{c[0]}' AND g.q = '{c[1]}') + {run(c)})::BIGINT AS n_{c.lower()}" for c in CELLS)
    return f"""{_anchors()},
    turns AS (SELECT anchors.*, t, length(q) AS total, coalesce(lead(paired) OVER w, false) AS onward, coalesce(lag(b + anchors.n) OVER w, 0) AS from_q, coalesce(lag(s + anchors.n) OVER w, 0) AS from_s
        FROM anchors JOIN pairs USING (sid, qid) WINDOW w AS (PARTITION BY sid, qid ORDER BY b)),
    equal AS (SELECT sid, qid, b, n FROM turns WHERE onward OR paired OR n >= 2 * t OR n >= total),
    gaps AS (SELECT sid, qid, left(y.w, 1) AS s, left(z.w, 1) AS q FROM (SELECT sid, qid, from_q + unnest(range(b - from_q)) AS p, from_s + unnest(range(b - from_q)) AS x FROM turns WHERE paired)
        JOIN places z USING (qid, p) JOIN words y USING (sid, x)),
    runs AS (SELECT sid, qid, {same} FROM {of} GROUP BY ALL),
    counted AS (SELECT l.sid AS subject_id, l.qid AS query_id, any_value(length(seq))::BIGINT AS seq_len, {sums} FROM links l JOIN given ON seq_id = l.qid LEFT JOIN runs e USING (sid, qid) LEFT JOIN gaps g USING (sid, qid) GROUP BY l.sid, l.qid)"""


def _uniform(key: str) -> str:
    return f"((('0x' || substring(md5({key}), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0)"


#: The cells of draws, one cell a step: exact sums for small means, a rounded normal number for larger ones.
DRAWN = f"""drawn AS (SELECT r::INTEGER AS replicate, i, j, seq_len, [{', '.join(NAMES)}] AS counts, 0 AS k, {TOTAL} AS n, {TOTAL} AS rest, []::BIGINT[] AS got FROM summed, range(1, 6) t(r)
    UNION ALL SELECT replicate, i, j, seq_len, counts, k + 1, n - d, rest - c, list_append(got, d)
    FROM (SELECT *, CASE WHEN n = 0 OR c = 0 THEN 0 WHEN c >= rest THEN n WHEN p > 0.5 THEN n - x ELSE x END::BIGINT AS d
        FROM (SELECT *, CASE WHEN n * q <= 30.0 THEN least(n, list_reduce(list_transform(range(120), lambda t: {{'term': exp(n * ln(1 - q)), 'total': exp(n * ln(1 - q)), 'k': t}}),
                lambda s, y: CASE WHEN u > s.total THEN {{'term': s.term * (n - y.k + 1) / y.k * (q / (1 - q)), 'total': s.total + s.term * (n - y.k + 1) / y.k * (q / (1 - q)), 'k': y.k}} ELSE s END).k)
                ELSE greatest(0, least(n, floor(n * q + sqrt(n * q * (1 - q)) * z + (1 - 2 * q) * (z * z - 1) / 6 + 0.5))) END AS x
            FROM (SELECT *, CASE WHEN c = 0 OR c >= rest THEN 0.5 ELSE least(p, 1 - p) END AS q, sqrt(-2 * ln(u)) * cos(2 * pi() * v) AS z
                FROM (SELECT *, c::DOUBLE / CASE WHEN rest > 0 THEN rest ELSE 1 END AS p, {_uniform('key')} AS u, {_uniform("key || '/v'")} AS v
                    FROM (SELECT *, counts[k + 1] AS c, concat_ws('/', '1', replicate, i, j, k) AS key FROM drawn WHERE k < 16))))))"""
LINKED_SUM = f"linked AS (SELECT greatest(subject_id, query_id) AS seq_id, {', '.join(f'sum({n})::BIGINT AS {n}' for n in NAMES)} FROM counted WHERE least(subject_id, query_id) < 0 GROUP BY 1)"

ORACLE = {
    "seq_normalize": f"WITH {SEQS} SELECT seq_id AS doc_id, md5(seq) AS seq_md5, length(seq) AS len FROM seqs",
    "seq_non_acgt_flag": f"WITH {SEQS} SELECT seq_id AS doc_id, length(raw) <> length(seq) AS other_letters FROM seqs",
    "seq_gc": f"WITH {SEQS} SELECT seq_id AS doc_id, CASE WHEN seq = '' THEN 'NaN'::DOUBLE ELSE round(length(regexp_replace(seq, '[^GC]', '', 'g'))::DOUBLE / length(seq), 9) END AS gc FROM seqs",
    "seq_revcomp": f"WITH {SEQS} SELECT seq_id AS doc_id, md5(translate(reverse(seq), 'ACGT!', 'TGCA;')) AS revcomp_md5 FROM seqs",
    "seq_both_strands": f"WITH {SEQS} SELECT seq_id AS doc_id, md5(translate(reverse(seq), 'ACGT!', 'TGCA;') || '#' || seq) AS rs_md5, 2 * length(seq) + 1 AS rs_len FROM seqs",
    "letter_histogram": f"WITH {SEQS} SELECT seq_id AS doc_id, " + ", ".join(f"length(seq) - length(replace(seq, '{x}', '')) AS n_{x.lower()}" for x in "ACGT") + " FROM seqs",
    "equal_run_fourths": f"WITH {SEQS} SELECT seq_id AS doc_id, length(seq) // 4 AS n_aa, length(seq) // 4 AS n_cc, length(seq) // 4 AS n_gg, length(seq) // 4 + length(seq) % 4 AS n_tt FROM seqs",
    "genome_join": f"WITH {_genomes('source')} SELECT seq_id, name, length(seq) AS len, md5(seq) AS seq_md5, other_letters FROM genomes",
    "genome_names": "SELECT page_id, regexp_extract(url, '([^/.]*)[^/]*$', 1) AS name FROM pages",
    "matrix_names": "SELECT c_custkey, CASE WHEN length(c_name) < 10 THEN rpad(c_name, 10, ' ') ELSE c_name END AS padded, left(rpad(c_mktsegment, 10, ' '), 10) AS cut FROM customer",
    "anchor_thresholds": f"""WITH {SEQS}, t AS (SELECT seq_id, length(regexp_replace(seq, '[^GC]', '', 'g'))::DOUBLE / length(seq) AS gc, 2.0 * length(seq) + 1 AS l FROM seqs WHERE seq <> ''),
        u AS (SELECT *, unnest(range(1, 33)) AS x FROM t), p AS (SELECT seq_id, x, {PROBABILITY} AS p FROM u)
        SELECT seq_id, coalesce(min(x) FILTER (WHERE p >= 1 - {P_VALUE}), 0)::INTEGER AS threshold FROM seqs LEFT JOIN p USING (seq_id) GROUP BY seq_id""",
    "sequence_validation": f"""WITH {SEQS} SELECT 'fatal' AS level, 'empty' AS code, seq_id AS i FROM seqs WHERE seq = ''
        UNION ALL SELECT 'soft_error', 'short', seq_id FROM seqs WHERE length(seq) BETWEEN 1 AND 999
        UNION ALL SELECT 'warning', 'non_acgt', seq_id FROM seqs WHERE length(raw) <> length(seq)
        UNION ALL SELECT 'warning', 'name_cut', seq_id FROM seqs WHERE length(source) > 10""",
    "mutation_counts": f"WITH {MUTANTS} SELECT * FROM counted",
    **{f"distance_{m}": f"WITH {MUTANTS}, d AS (SELECT seq_id, {x} AS distance FROM (SELECT *, {_det() if m == 'logdet' else '0'} AS det FROM counted)) SELECT seq_id, {_round('distance')} AS distance FROM d" for m, x in MODEL.items()},
    "aligned_pair_counts": f"WITH {PAIRED} SELECT subject_id, query_id, seq_len, {', '.join(NAMES)} FROM paired",
    "symmetric_counts": f"WITH {PAIRED} SELECT i, j, seq_len, {', '.join(NAMES)} FROM summed",
    "pair_distances": f"WITH {PAIRED} SELECT i, j, {_round('raw')} AS distance FROM both_ways",
    "pair_distances_one_way": f"WITH {PAIRED}, d AS (SELECT subject_id AS i, query_id AS j, {MODEL['logdet']} AS distance FROM (SELECT *, {_det()} AS det FROM paired)) SELECT i, j, {_round('distance')} AS distance FROM d",
    "pair_coverages": f"WITH {PAIRED} SELECT subject_id, query_id, round(coverage, 9) AS coverage FROM covered",
    "pair_validation": f"""WITH {PAIRED} SELECT 'soft_error' AS level, 'nan' AS code, i, j FROM both_ways WHERE isnan(jc)
        UNION ALL SELECT 'soft_error', 'low_homology', i, j FROM both_ways b WHERE NOT isnan(jc) AND i < j
        AND EXISTS (SELECT 1 FROM covered c WHERE coverage < 0.2 AND least(subject_id, query_id) = i AND greatest(subject_id, query_id) = j)""",
    "distance_matrix_lines": f"""WITH {PAIRED}, small AS (SELECT coalesce(bool_or(raw > 0 AND raw < 0.001), false) AS s FROM both_ways),
        c AS (SELECT i, j, raw FROM both_ways UNION ALL SELECT seq_id, seq_id, 0.0 FROM genomes),
        t AS (SELECT i, j, CASE WHEN isnan(raw) THEN 'nan' WHEN s THEN printf('%1.4e', raw) ELSE printf('%1.4f', raw) END AS x FROM c, small)
        SELECT 0 AS line_no, (SELECT count(*) FROM genomes)::VARCHAR AS line
        UNION ALL SELECT i + 1, rpad(any_value(name), greatest(10, length(any_value(name)))::INTEGER, ' ') || string_agg(' ' || x, '' ORDER BY j) FROM t JOIN genomes ON seq_id = i GROUP BY i""",
    "coverage_matrix_lines": f"""WITH {PAIRED}, c AS (SELECT subject_id AS i, query_id AS j, coverage FROM covered UNION ALL SELECT seq_id, seq_id, 1.0 FROM genomes)
        SELECT i AS line_no, string_agg(printf('%1.4e', coverage) || ' ', '' ORDER BY j) AS line FROM c GROUP BY i""",
    "bootstrap_totals": f"WITH {PAIRED} SELECT r::INTEGER AS replicate, i, j, seq_len, {TOTAL} AS total FROM summed, range(1, 4) t(r)",
    "bootstrap_cells": f"WITH RECURSIVE {PAIRED}, {DRAWN} SELECT replicate, i, j, seq_len, {', '.join(f'got[{k + 1}] AS {n}' for k, n in enumerate(NAMES))} FROM drawn WHERE k = 16",
    "fasta_scan": f"WITH {SEQS}, f AS (SELECT seq_id, replace(seq, '!', '') AS seq FROM seqs) SELECT seq_id AS doc_id, CASE WHEN seq <> '' THEN md5(seq) END AS seq_md5, length(seq) AS len FROM f",
    "longest_matches": f"WITH {_matches()} SELECT sid AS subject_id, qid AS query_id, p AS place, n AS length, coalesce(x, -1)::BIGINT AS only_place FROM matches",
    "anchor_trace": f"WITH {_anchors()} SELECT sid AS subject_id, qid AS query_id, b AS query_place, s AS subject_place, n AS length, paired FROM anchors",
    "linked_counts_by_fourths": f"WITH {_linked(True)} SELECT subject_id, query_id, seq_len, {', '.join(NAMES)} FROM counted",
    "linked_counts_by_letters": f"WITH {_linked(False)} SELECT subject_id, query_id, seq_len, {', '.join(NAMES)} FROM counted",
    "linked_distances": f"WITH {_linked(True)}, {LINKED_SUM}, d AS (SELECT seq_id, {JC} AS distance FROM linked) SELECT seq_id, {_round('distance')} AS distance FROM d",
}
