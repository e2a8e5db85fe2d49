"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numerics import bind
from .common import free_prefix, new_path, read_table
from .conversations import repair_conversations
from .fingerprint import compare_with_next, fit_rarity
from .html_text import extract_main_text, train_extractor
from .jaccard import jaccard_components
from .languages import predict_languages, train_languages
from .media import read_media, store_media
from .mixing import mix_sources
from .packing import pack_documents, stored_sequences, write_matrices
from .quality import score_quality, train_quality
from .runs import collapse_runs
from .secrets import scan_secrets, train_secrets
from .warc import read_warc, write_warc

#: A document of at least this score is taken for label 1.
QUALITY_CUT = 0.3


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def op1_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "warc")
    write_warc(read_table(spark, sf_dir, "pages"), out)
    return read_warc(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = scan_secrets(docs, train_secrets(docs))
    return found.withColumn("candidate", F.sha2("candidate", 256)).withColumnRenamed("candidate", "candidate_sha256")


def op4_media_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(store_media(read_table(spark, sf_dir, "documents")))


def op5_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_sequences(write_matrices(read_table(spark, sf_dir, "documents"), new_path(spark, "matrices")))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return extract_main_text(pages, train_extractor(pages))


def op7_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return compare_with_next(docs, fit_rarity(docs))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_quality(docs, read_table(spark, sf_dir, "labels").filter(~held_out()))
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


def op10_mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    own = free_prefix(docs.columns)
    return mix_sources(docs).select("doc_id", *(F.col(f"{own}{c}").alias(c) for c in ("source", "lang", "topic", "tokens", "probability", "kept")))


def planted_period(doc_id: Column, text: Column) -> Column:
    """``text``, or for one document in ten its words with a tail that repeats the words from some place on."""
    h = F.crc32(doc_id.cast("string"))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def repeated(v: Column) -> Column:
        g, n = F.floor(v["h"] / 10), F.size(v["words"])
        return bind(F.struct(v["words"].alias("words"), (g % n).alias("a"), (1 + F.floor((n - g % n) / (3 + g % 8))).alias("p")), lambda x: tail(x, n))

    def tail(x: Column, n: Column) -> Column:
        place = lambda i: F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"])
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: x["words"][place(i).cast("int")]), " ")

    changed = bind(F.struct(words.alias("words"), h.alias("h")), lambda v: F.when(F.size(v["words"]) > 0, repeated(v)).otherwise(""))
    return F.when((h % 10 == 0) & text.isNotNull(), changed).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = collapse_runs(docs.select("doc_id", planted_period(F.col("doc_id"), F.col("text")).alias("text")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"])))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = found.withColumn("best", longest).withColumn("listed", F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.col1")).alias("length"), F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.col1") / F.col("best.period")).alias("exponent_milli"), F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of conversations with faults by a hash of conversation and turn: dropped, emptied, cut, repeated or with another role."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(known("text"), "[.!?]", "")).otherwise(known("text"))
    copies = F.explode(F.when(h == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.filter(h != 0).select("conv_id", "turn", F.when(h == 4, "user").otherwise(known("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    report, _ = repair_conversations(damaged(rows))
    every = rows.select(F.col("conv_id").alias("every")).distinct()
    found = every.join(report, F.col("every").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("every", "conv_id")
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return found.withColumns(zeros | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))})


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    found = predict_languages(docs, train_languages(docs.filter(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: SQL for the queries that SQL can express.
ORACLE = {
    "op1_warc_writer": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, octet_length(payload) AS n, sha256(payload) AS h FROM p),
        f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h)
        SELECT page_id, n AS payload_bytes, h AS payload_digest,
               CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
        FROM d JOIN f USING (h)""",
    # equal words of a text at each distance, in stretches; a stretch's least distance is its period
    "op11_periodic_runs": r"""
        WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
            xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT),
                lambda h, b: list_reduce(range(8), lambda x, k: xor(x >> 1, (x & 1) * 3988292384), xor(h, b)), 4294967295::BIGINT)) AS h FROM documents),
        sized AS (SELECT *, len(w) AS n, h // 10 AS g, coalesce(h % 10 = 0, false) AND len(w) > 0 AS planted FROM texts),
        parted AS (SELECT *, CASE WHEN planted THEN g % n END AS a, CASE WHEN planted THEN 1 + (n - g % n) // (3 + g % 8) END AS q FROM sized),
        words AS MATERIALIZED (SELECT doc_id, n, i, w[1 + CASE WHEN i >= a THEN a + (i - a) % q ELSE i END] AS x FROM (SELECT *, unnest(range(n)) AS i FROM parted)),
        alike AS (SELECT doc_id, u.i, v.i - u.i AS p FROM words u JOIN words v USING (doc_id, x) WHERE v.i > u.i AND 4 * (v.i - u.i) <= u.n),
        islands AS (SELECT doc_id, p, min(i) AS s, count(*) + p AS size FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS k FROM alike) GROUP BY doc_id, p, k),
        runs AS MATERIALIZED (SELECT doc_id, s, size, min(p) AS p FROM islands WHERE size >= greatest(6, 4 * p) GROUP BY doc_id, s, size),
        sums AS (SELECT doc_id, count(*) AS n_runs, max({'size': size, 's': -s, 'p': -p}) AS best, string_agg(s || ',' || size || ',' || p || chr(10), '' ORDER BY s, p) AS listed FROM runs GROUP BY doc_id),
        dropped AS (SELECT DISTINCT doc_id, unnest(range(s + p, s + size)) AS i FROM runs),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, (-best.s)::BIGINT AS start, best.size::BIGINT AS length, (-best.p)::BIGINT AS period, (1000 * best.size // -best.p)::BIGINT AS exponent_milli,
            sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
        FROM documents LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    # crc32 bit by bit; a conversation's rows one after the other, the least (cost, audit) of each state of the pattern kept
    "op12_conversation_repair": r"""
        WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            xor(4294967295, list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT),
                lambda h, b: list_reduce(range(8), lambda x, k: xor(x >> 1, (x & 1) * 3988292384), xor(h, b)), 4294967295::BIGINT)) % 20 AS h FROM conversations),
        damaged AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(range(CASE h WHEN 3 THEN 2 ELSE 1 END)) AS c FROM src WHERE h <> 0),
        placed AS (SELECT *, row_number() OVER rows AS n, left(role, 1) || left(lead(role) OVER rows, 1) AS pair
            FROM damaged WINDOW rows AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        faulty AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ \t\n\v\f\r]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][ \t\n\v\f\r]*\z') THEN 'truncated' ELSE '' END AS fault FROM placed),
        moves(st, letter, initial, nxt, price) AS (VALUES (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0), (0, 'R', '', 2, 2), (1, 'R', '', 2, 2), (2, 'R', '', 3, 2), (3, 'R', '', 2, 2), (0, 'D', '', 0, 3), (1, 'D', '', 1, 3), (2, 'D', '', 2, 3), (3, 'D', '', 3, 3)),
        inserted(st, nxt, price, letters) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (1, 2, 2, 'I'), (2, 3, 2, 'I'), (3, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 3, 4, 'II'), (2, 2, 4, 'II'), (3, 3, 4, 'II')),
        walk AS (SELECT conv_id, 0::BIGINT AS n, nxt AS st, {'cost': price, 'audit': letters} AS best FROM (SELECT DISTINCT conv_id FROM placed), inserted WHERE st = 0
            UNION ALL SELECT w.conv_id, w.n + 1, i.nxt, min({'cost': w.best.cost + m.price + i.price + CASE WHEN m.letter <> 'D' AND f.fault = 'truncated' THEN 1 ELSE 0 END, 'audit': w.best.audit || m.letter || i.letters})
            FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.n + 1
            JOIN moves m ON m.st = w.st AND (m.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate') AND (m.letter = 'R' OR m.initial = left(f.role, 1))) JOIN inserted i ON i.st = m.nxt GROUP BY ALL),
        sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
            count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM faulty GROUP BY conv_id),
        chosen AS (SELECT s.conv_id, min(best) AS best FROM sums s JOIN walk w ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND w.n = s.rows AND w.st IN (0, 3) GROUP BY s.conv_id),
        letters AS (SELECT conv_id, unnest(string_split(best.audit, '')) AS x, unnest(range(length(best.audit))) AS j FROM chosen WHERE best.audit <> ''),
        counted AS (SELECT *, count(*) FILTER (x <> 'I') OVER so_far AS n, count(*) FILTER (x <> 'D') OVER so_far AS m FROM letters WINDOW so_far AS (PARTITION BY conv_id ORDER BY j)),
        joined AS (SELECT c.*, CASE WHEN x <> 'I' THEN f.role END AS role, CASE WHEN x <> 'I' THEN f.text ELSE '' END AS text FROM counted c LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.n = c.n WHERE x <> 'D'),
        opened AS (SELECT *, bool_or(m = 1 AND x = 'K' AND left(role, 1) = 's') OVER (PARTITION BY conv_id) AS led FROM joined),
        texts AS (SELECT conv_id, string_agg(CASE WHEN x = 'K' THEN role WHEN (m + led::INTEGER) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS repaired FROM opened GROUP BY conv_id)
        SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
            coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN chosen c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM a.conv_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
