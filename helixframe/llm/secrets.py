"""Secret scan: regular expressions propose candidates, a random forest removes the false positives.

All of it is DataFrame expressions and Spark's own random forest; no Python runs on the executors. The forest reads a
candidate's length, character transitions, dictionary coverage, path and neighbouring words, and learns from labelled
findings: rows of (candidate, before, after, path, label).
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from math import log
from operator import or_

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, free_prefix, materialize

#: Characters on either side of a candidate that its features may read.
NEAR = 48
#: Documents from which the contexts of labelled findings are drawn.
SAMPLE_DOCS = 150
#: A word of the dictionary stands in at least this share of all documents, and in this many.
WORD_SHARE, WORD_DOCS = 1e-4, 2
#: Words of a dictionary that is sent to all tasks, at some 20 bytes each.
SMALL_DICTIONARY = 500_000
#: Neighbouring words that are read on either side; findings that a word must stand near to count; added to its counts.
NEAR_WORDS, WORD_FINDINGS, PRIOR = 3, 20, 4.0
TREES, DEPTH, SEED, CUT = 24, 8, 11, 0.5

KEY_WORDS = "token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|bearer"
BENIGN_WORDS = "sha\\d*|commit|md5|digest|checksum|uuid|guid|id|version|hash|etag|file|build|ref|integrity|rev|revision|serial|order|image|session"
FAKE_WORDS = "example|sample|dummy|placeholder|changeme|your[_-]|xxxx|test|fake|todo|redacted|mail"
PREFIXES = "^(?:AKIA|ASIA|ghp_|gho_|ghs_|ghu_|ghr_|github_pat_|glpat-|[rs]k_live_|[rs]k_test_|sk-|xox[abprs]-|AIza|eyJ|SG\\.|npm_|-----BEGIN)"
RUN = "[A-Za-z0-9+/_=.\\-]"
CANDIDATES = (
    "-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\\s]*+-----END [A-Z ]*PRIVATE KEY-----",
    f"(?<!{RUN})(?=[A-Za-z+/_=.\\-]*+[0-9])(?=[0-9+/_=.\\-]*+[A-Za-z]){RUN}{{16,}}",
)
#: Known prefixes, each with its own alphabet and length; digits are not asked for.
PREFIXED = "(?:^|[^A-Za-z0-9])(" + "|".join((
    "(?:AKIA|ASIA)[A-Z0-9]{16}", "gh[opsur]_[A-Za-z0-9]{30,}", "github_pat_[A-Za-z0-9_]{20,}", "glpat-[A-Za-z0-9_\\-]{20,}", "[rs]k_(?:live|test)_[A-Za-z0-9]{10,}",
    "sk-[A-Za-z0-9_\\-]{20,}", "xox[abprs]-[A-Za-z0-9\\-]{10,}", "AIza[A-Za-z0-9_\\-]{35}", "npm_[A-Za-z0-9]{36}", "SG\\.[A-Za-z0-9_\\-]{16,}\\.[A-Za-z0-9_\\-]{16,}", "eyJ[A-Za-z0-9_\\-]{10,}(?:\\.[A-Za-z0-9_\\-]+){0,2}",
)) + ")"
#: A part of each alternative of PREFIXED, and, in lower case, of KEY_WORDS.
PREFIX_STEMS = ("AKIA", "ASIA", "gho_", "ghp_", "ghs_", "ghu_", "ghr_", "github_pat_", "glpat-", "k_live_", "k_test_", "sk-", "xox", "AIza", "npm_", "SG.", "eyJ")
KEY_STEMS = ("token", "secret", "passw", "pwd", "api", "access", "private", "auth", "credential", "bearer")
ASSIGNED = f"(?i:(?:{KEY_WORDS})[a-z0-9_.\\-]{{0,24}}[\"']?(?:\\s{{0,3}}(?:[:=]|=>|:=)|\\s{{1,3}}is\\s)\\s{{0,3}}[\"']?)([^\\s\"'`,;<>]{{4,}})"
#: Patterns, each with the group that is the candidate.
PATTERNS = (*((p, 0) for p in CANDIDATES), (PREFIXED, 1), (ASSIGNED, 1))


def _constant_map(values: dict, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), f"map<string,{kind}>")


def _places(pattern: str, group: int) -> Column:
    """(start, candidate) of every match in a text, from 0; the candidate is the group that ends the match.

    A match is looked for from the end of the one before: where its string stands first, the pattern matches too.
    """
    every = (F.regexp_extract_all("text", F.lit(pattern), F.lit(g)) for g in (0, group))
    found = F.zip_with(*every, lambda a, c: F.struct(a.alias("all"), c.alias("candidate")))
    none = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,candidate:string>>").alias("got"))

    def step(state: Column, m: Column) -> Column:
        end = F.call_function("locate", m["all"], F.col("text"), state["at"]) + F.length(m["all"])
        return F.struct(end.alias("at"), F.concat(state["got"], F.array(F.struct((end - F.length(m["candidate"]) - 1).alias("start"), m["candidate"].alias("candidate")))).alias("got"))

    return F.aggregate(found, none, step)["got"]


def candidates(docs: DataFrame, path: str = "source", key: str | None = None) -> DataFrame:
    """(__row, doc_id, path, candidate, start, length, occurrences, before, after): each place of the candidates of each row.

    ``start`` is the place in characters, from 0; ``occurrences`` counts the candidate's string in the whole text, but
    not inside longer runs of letters and digits, as redaction replaces it. __row is the column ``key`` or else numbers the rows. Null and empty texts have none.
    """
    where = F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")
    row = F.col(key) if key else F.monotonically_increasing_id()
    found = F.array_distinct(F.concat(*(_places(p, g) for p, g in PATTERNS)))
    # numbered before rows are multiplied
    rows = docs.filter(has_candidates()).select(row.alias("__row"), "doc_id", where.alias("path"), "text")
    rows = rows.select("*", F.explode(found).alias("x")).select("*", "x.*").drop("x")
    return rows.select(
        "__row",
        "doc_id",
        "path",
        "candidate",
        F.col("start").cast("long").alias("start"),
        F.length("candidate").cast("long").alias("length"),
        F.expr(f"substring(text, greatest(start + 1 - {NEAR}, 1), least(start, {NEAR}))").alias("before"),
        F.expr(f"substring(text, start + 1 + length(candidate), {NEAR})").alias("after"),
        "text",
    ).select("*", F.regexp_count("text", alone(F.col("candidate"), *stands_alone())).cast("long").alias("occurrences")).drop("text")


def stands_alone() -> tuple[Column, Column]:
    """Whether a candidate's place has no letter or digit right before it, and none right after it."""
    return ~F.col("before").rlike("[A-Za-z0-9]$"), ~F.col("after").rlike("^[A-Za-z0-9]")


def alone(candidate: Column, left: Column, right: Column) -> Column:
    """The pattern of a candidate's string that isn't part of a longer run of letters and digits on these sides."""
    quoted = F.concat(F.lit("\\Q"), F.replace(candidate, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.concat(F.when(left, "(?<![A-Za-z0-9])").otherwise(""), quoted, F.when(right, "(?![A-Za-z0-9])").otherwise(""))


def has_candidates() -> Column:
    """Whether a row has any candidate; a null text has none.

    A pattern is tried where what it can't match without is there, which is much faster to look for.
    """
    text, low = F.col("text"), F.lower("text")
    any_of = lambda c, words: reduce(or_, (c.contains(w) for w in words))
    found = (any_of(text, ["PRIVATE KEY-----"]) & text.rlike(CANDIDATES[0])) | (text.rlike(f"{RUN}{{16}}") & text.rlike(CANDIDATES[1]))
    found = found | (any_of(text, PREFIX_STEMS) & text.rlike(PREFIXED)) | (any_of(low, KEY_STEMS) & text.rlike(ASSIGNED))
    return F.coalesce(found, F.lit(False))


def near_words() -> tuple[Column, Column]:
    """The last words before a candidate, the nearest first, and the first ones after it."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]{2,}"), F.lit(0))
    return F.slice(F.reverse(words("before")), 1, NEAR_WORDS), F.slice(words("after"), 1, NEAR_WORDS)


def _features(transitions: dict[str, float], neighbours: dict[str, float]) -> dict[str, Column]:
    c, n = F.col("candidate"), F.greatest(F.length("candidate"), F.lit(1))
    share = lambda p: F.regexp_count(c, F.lit(p)) / n
    flag = lambda col, p: F.coalesce(col.rlike(p), F.lit(False)).cast("double")
    chars = F.split(c, "")
    odds = _constant_map(transitions, "double")
    # neighbouring letters by two slices, in one walk over a candidate of any length
    low, rest = F.split(F.lower(c), ""), F.greatest(F.length(c) - 1, F.lit(1))
    pairs = F.zip_with(F.slice(low, 1, rest), F.slice(low, 2, rest), lambda a, b: F.concat(a, b))
    likely = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.coalesce(F.element_at(odds, p), F.lit(-8.0))) / F.size(pairs)
    says = _constant_map(neighbours, "double")
    odds_of = lambda w: F.coalesce(F.element_at(says, w), F.lit(0.0))
    earlier, later = near_words()
    freq = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)) / F.size(chars))
    return {
        "length": n.cast("double"),
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "symbols": share("[^A-Za-z0-9]"),
        "changes": F.regexp_count(c, F.lit("(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])")) / n,
        "transitions": likely,
        "covered": F.coalesce("__covered", F.lit(0)) / n,
        "entropy": -F.aggregate(freq, F.lit(0.0), lambda a, p: a + p * F.log2(p)),
        "distinct": F.size(F.array_distinct(chars)) / n,
        "hex": flag(c, "^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "uuid": flag(c, "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-"),
        "known": flag(c, PREFIXES),
        "dots": share("\\."),
        "slashes": share("/"),
        "fake": flag(F.lower(c), f"{FAKE_WORDS}|(.)\\1{{5,}}"),
        "quoted": flag(F.col("before"), "[\"'`]$"),
        "assigned": flag(F.col("before"), "[:=]\\s*[\"'`]?$"),
        "after_at": flag(F.col("before"), "[@/]$"),
        "key_word": flag(F.lower("before"), f"(?:{KEY_WORDS})[a-z0-9_.\\-]{{0,24}}[\"']?\\s*(?:[:=]|is|\\s)\\s*[\"'`]?$"),
        "key_near": flag(F.lower("before"), KEY_WORDS),
        "benign_word": flag(F.lower("before"), f"\\b(?:{BENIGN_WORDS})[\"']?\\s*[:=#]?\\s*[\"'`]?$"),
        "nearest_word": odds_of(F.coalesce(F.get(earlier, F.lit(0)), F.lit(""))),
        "words_before": F.aggregate(earlier, F.lit(0.0), lambda a, w: a + odds_of(w)),
        "words_after": F.aggregate(later, F.lit(0.0), lambda a, w: a + odds_of(w)),
        "closed": flag(F.col("after"), "^[\"'`]"),
        "fake_path": flag(F.lower("path"), "test|example|fixture|mock|sample|doc"),
        "path_depth": F.coalesce(F.regexp_count("path", F.lit("/")), F.lit(0)).cast("double"),
    }


@dataclass(frozen=True)
class SecretModel:
    """words: a written table of one column w, the dictionary; the others are read by the features."""

    forest: RandomForestClassificationModel
    words: DataFrame
    transitions: dict[str, float]
    neighbours: dict[str, float]

    def score(self, found: DataFrame) -> DataFrame:
        """``found`` (candidate, before, after, path and more) with a column score: the probability of a secret."""
        scored = self.forest.transform(_vectors(found, self.words, self.transitions, self.neighbours))
        return scored.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def _with_coverage(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found``, written, with __covered: the letters of each candidate that lie in words of the dictionary.

    The dictionary is sent to all tasks if it is small (counted), and joined by its words otherwise.
    """
    rows = materialize(found.withColumn("__n", F.monotonically_increasing_id()), "found")
    runs = rows.select("__n", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit("[a-z]{3,}"), F.lit(0))).alias("w"))
    known = F.broadcast(words) if words.count() <= SMALL_DICTIONARY else words
    covered = runs.join(known, "w").groupBy("__n").agg(F.sum(F.length("w")).alias("__covered"))
    return rows.join(covered, "__n", "left").drop("__n")


def _vectors(found: DataFrame, words: DataFrame, transitions: dict[str, float], neighbours: dict[str, float]) -> DataFrame:
    f = _features(transitions, neighbours)
    names = [f"f_{k}" for k in f]
    rows = _with_coverage(found, words)
    rows = rows.select(*(c for c in rows.columns if c != "__covered"), *(c.cast("double").alias(f"f_{k}") for k, c in f.items()))
    return VectorAssembler(inputCols=names, outputCol="features").transform(rows).drop(*names)


def _sample(docs: DataFrame) -> DataFrame:
    """The documents whose words surround labelled findings."""
    return docs.filter("length(text) > 0").orderBy(F.xxhash64("doc_id", "text"), "doc_id").select("doc_id", "text").limit(SAMPLE_DOCS)


def labelled_findings(docs: DataFrame) -> DataFrame:
    """(candidate, before, after, path, label): findings of known kind set between words of a bounded sample of texts.

    Without any text the findings stand alone, so that a model can always be trained.
    """
    spark = docs.sparkSession
    drawn = _sample(docs).select(F.concat(F.lit("d"), F.coalesce(F.col("doc_id").cast("string"), F.xxhash64("text").cast("string"))).alias("seed"), F.split(F.trim("text"), "\\s+").alias("w"))
    seeds = drawn.unionByName(spark.range(64).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("seed"), F.array(F.lit("value")).alias("w")))
    word = lambda k: F.element_at("w", (F.pmod(F.xxhash64("seed", F.lit(k)), F.size("w")) + 1).cast("int"))
    hexes = lambda k, n: F.substring(F.sha2(F.concat("seed", F.lit(f"/{k}")), 512), 1, n)
    b64 = lambda k, n: F.substring(F.base64(F.unhex(F.sha2(F.concat("seed", F.lit(f"/{k}")), 512))), 1, n)
    digits = lambda k, n: F.substring(F.regexp_replace(F.sha2(F.concat("seed", F.lit(f"/{k}")), 512), "[a-f]", ""), 1, n)
    letters = F.lower(F.regexp_replace(F.concat(word(1), word(2), word(3)), "[^\\p{L}]", ""))
    some = lambda k, n: F.substring(F.translate(F.sha2(F.concat("seed", F.lit(f"/{k}")), 512), "0123456789", "ghkmpqtvxz"), 1, n)
    plain = F.substring(F.concat(F.lower(F.regexp_replace(word(9), "[^\\p{L}]", "")), F.lit("need")), 1, 12)
    lit = F.lit
    # fixed values: text before, value, text after, whether it is a secret
    kinds = [
        *((lit(f'{k}{s}'), v, lit('"'), 1) for k, s, v in (
            ("token", ' = "', hexes(1, 40)), ("TOKEN", ' = "', F.upper(hexes(2, 40))), ("api_key", '="', hexes(3, 32)), ("secret", ': "', b64(4, 40)),
            ("password", ' = "', b64(5, 20)), ("access_key", ' = "', b64(6, 32)), ("auth_token", ': "', hexes(7, 64)), ("client_secret", ' = "', b64(8, 24)),
        )),
        (lit("Authorization: Bearer "), F.concat(lit("eyJ"), b64(9, 60)), lit(""), 1),
        (lit("aws "), F.concat(lit("AKIA"), F.upper(hexes(10, 16))), lit(""), 1),
        (lit("use "), F.concat(lit("ghp_"), F.regexp_replace(b64(11, 36), "[+/]", "x")), lit(""), 1),
        (lit("pwd="), b64(12, 18), lit(""), 1),
        (lit("key "), F.concat(lit("sk_live_"), hexes(13, 24)), lit(""), 1),
        (lit("token="), hexes(14, 40), lit(""), 1),
        (lit("aws_access_key_id = "), F.concat(lit("AKIA"), F.upper(some(15, 16))), lit(""), 1),
        (lit('secret_key = "'), some(16, 24), lit('"'), 1),
        (lit("password is "), some(17, 12), lit(""), 1),
        (lit('password = "'), F.concat(some(18, 4), digits(19, 3)), lit('"'), 1),
        (lit("password is "), plain, lit(""), 0),
        (lit("secret: "), plain, lit(""), 0),
        (lit("auth="), F.element_at(F.array(lit("none"), lit("true"), lit("null"), lit("basic")), F.length(plain) % 4 + 1), lit(""), 0),
        (lit("commit "), hexes(21, 40), lit(""), 0),
        (lit("sha256:"), hexes(22, 64), lit(""), 0),
        (lit('digest = "'), hexes(23, 64), lit('"'), 0),
        (lit('id = "'), F.concat_ws("-", hexes(24, 8), hexes(25, 4), hexes(26, 4), hexes(27, 12)), lit('"'), 0),
        (lit("uuid "), F.concat_ws("-", hexes(28, 8), hexes(29, 4), hexes(30, 4), hexes(31, 12)), lit(""), 0),
        (lit("user@"), F.concat(lit("mail"), digits(32, 1), lit(".example.com")), lit(""), 0),
        (lit("https://"), F.concat(letters, lit(".example.org/en/"), digits(33, 4)), lit(""), 0),
        (lit(""), F.concat(letters, digits(34, 2)), lit(""), 0),
        (lit('token = "'), F.concat(lit("your_token_here_"), digits(35, 2)), lit('"'), 0),
        (lit('password = "'), lit("xxxxxxxxxxxxxxxx1"), lit('"'), 0),
        (lit('secret: "'), F.concat(letters, lit("_"), word(4)), lit('"'), 0),
        (lit("token: "), F.concat(letters, lit("-"), letters), lit(""), 0),
        (lit('api_key = "'), lit("EXAMPLEKEY1234567890"), lit('"'), 0),
        (lit("file "), F.concat(lit("IMG_2023"), digits(36, 4), lit("_"), digits(37, 6), lit(".jpg")), lit(""), 0),
        (lit("at "), F.concat(lit("2023-04-0"), digits(38, 1), lit("T12:00:"), digits(39, 2), lit("Z")), lit(""), 0),
        (lit("version "), F.concat(lit("v"), digits(40, 2), lit("."), digits(41, 2), lit("."), digits(42, 4), lit("-release")), lit(""), 0),
        (lit("etag: "), hexes(43, 32), lit(""), 0),
        (lit("build/"), F.concat(letters, lit("/"), letters, lit("_v2.py")), lit(""), 0),
        (lit("integrity="), F.concat(lit("sha512-"), b64(44, 64)), lit(""), 0),
    ]
    rows = seeds.select("seed", "w", F.explode(F.array(*(F.struct(b.alias("b"), v.alias("v"), a.alias("a"), lit(y).alias("y"), lit(k).alias("k")) for k, (b, v, a, y) in enumerate(kinds)))).alias("x"))
    pick = F.pmod(F.xxhash64("seed", "x.k"), lit(5))
    return rows.select(
        F.col("x.v").alias("candidate"),
        F.substring(F.concat(word(5), lit(" "), word(6), lit(" "), "x.b"), -NEAR, NEAR).alias("before"),
        F.substring(F.concat("x.a", lit(" "), word(7)), 1, NEAR).alias("after"),
        F.when(pick == 0, F.concat(lit("app/config/"), word(8))).when((pick == 1) & (F.col("x.y") == 0), lit("tests/fixtures/data.txt")).otherwise(F.concat(lit("src"), pick.cast("string"))).alias("path"),
        F.col("x.y").cast("double").alias("label"),
    )


def corpus_words(docs: DataFrame) -> DataFrame:
    """(w, n, docs): how often each run of three letters or more occurs in all texts, and in how many of them."""
    runs = docs.filter("length(text) > 0").select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)).alias("ws"))
    both = runs.select(F.explode(F.array(F.struct(F.lit(0).alias("once"), "ws"), F.struct(F.lit(1).alias("once"), F.array_distinct("ws").alias("ws")))).alias("x"))
    return both.select("x.once", F.explode("x.ws").alias("w")).groupBy("w").agg(F.sum(1 - F.col("once")).alias("n"), F.sum("once").alias("docs"))


def neighbour_odds(findings: DataFrame) -> dict[str, float]:
    """How much more often each neighbouring word stands by secrets than by others, in smoothed log odds."""
    earlier, later = near_words()
    near = findings.select("label", F.explode(F.array_distinct(F.concat(earlier, later))).alias("w"))
    rows = near.groupBy("w").agg(F.sum("label").alias("yes"), F.count("*").alias("n")).filter(F.col("n") >= WORD_FINDINGS).orderBy("w")
    # a few words for each labelled finding at most
    return {r["w"]: log((r["yes"] + PRIOR) / (r["n"] - r["yes"] + PRIOR)) for r in rows.collect()}


def train_secrets(docs: DataFrame, findings: DataFrame | None = None) -> SecretModel:
    """Fit on ``findings`` (default: those of ``labelled_findings``), with the dictionary and transitions of all ``docs``."""
    words = materialize(corpus_words(docs), "words")
    least = max(WORD_DOCS, WORD_SHARE * docs.count())
    common = materialize(words.filter(F.col("docs") >= least).select("w"), "dictionary")
    pairs = words.select("n", F.explode(F.expr("transform(sequence(1, length(w) - 1), i -> substring(w, i, 2))")).alias("p")).groupBy("p").agg(F.sum("n").alias("n"))
    seen = {r["p"]: r["n"] for r in pairs.collect()}  # at most 26 * 26
    drop_materialized(words)
    first: dict[str, int] = {}
    for p, n in seen.items():
        first[p[0]] = first.get(p[0], 0) + n
    odds = {p: log(n / first[p[0]]) for p, n in sorted(seen.items())}
    # a bounded table, written once and read in one order, for a model that repeats
    findings = materialize((labelled_findings(docs) if findings is None else findings).select("candidate", "before", "after", "path", "label"), "findings")
    neighbours = neighbour_odds(findings)
    rows = _vectors(findings, common, odds, neighbours).select("features", "label", F.xxhash64("candidate", "before", "after", "path").alias("h"))
    rows = materialize(rows.coalesce(1).sortWithinPartitions("h", "label").select("features", "label"), "vectors").coalesce(1)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=2).fit(rows)
    drop_materialized(findings, rows)
    return SecretModel(forest, common, odds, neighbours)


def _judged(docs: DataFrame, model: SecretModel, path: str, key: str | None = None) -> DataFrame:
    """One row for each distinct candidate of each row: its first place, and the score of the place that looks worst.

    left, right: whether it stands alone on these sides wherever it is a candidate.
    """
    scored = model.score(candidates(docs, path, key))
    left, right = stands_alone()
    same = [F.first(c).alias(c) for c in ("doc_id", "path", "length")]
    return scored.groupBy("__row", "candidate").agg(
        *same, F.max("occurrences").alias("occurrences"), F.min("start").alias("start"), F.max("score").alias("score"), F.bool_and(left).alias("left"), F.bool_and(right).alias("right")
    )


def scan_secrets(docs: DataFrame, model: SecretModel, path: str = "source") -> DataFrame:
    """One row for each distinct candidate of each row of ``docs``, scored; repeated rows give repeated findings.

    A candidate is a secret if it is one at any of its places. Columns: doc_id, path, candidate, start (its first
    place), length, occurrences, score (the highest of its places), is_secret.
    """
    return _judged(docs, model, path).select("doc_id", "path", "candidate", "start", "length", "occurrences", "score", (F.col("score") >= CUT).alias("is_secret"))


def redact_secrets(docs: DataFrame, model: SecretModel, path: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every occurrence of a found secret replaced by ``mark``, and n_chars, where present, made to fit.

    A secret's string stays where it is part of a longer run of letters and digits, unless it was found so. Rows without
    candidates pass straight through; the others are written with a key of their own, by which they meet their findings:
    neither null ids nor repeated ones matter. Null and empty texts stay as they are, and so do other columns, whatever
    their names. An empty table gives an empty one.
    """
    own = free_prefix(docs.columns)
    key, hits = f"{own}key", f"{own}hits"
    rows = materialize(docs.filter(has_candidates()).withColumn(key, F.monotonically_increasing_id()), "candidates")
    found = _judged(rows, model, path, key).filter(F.col("score") >= CUT)
    hit = F.struct((-F.col("length")).alias("o"), "candidate", alone(F.col("candidate"), F.col("left"), F.col("right")).alias("pattern"))
    found = found.groupBy(F.col("__row").alias(key)).agg(F.sort_array(F.collect_set(hit)).alias(hits))
    some = rows.join(found, key, "left")
    put = F.lit(mark.replace("\\", "\\\\").replace("$", "\\$"))
    text = F.when(F.col(hits).isNull(), F.col("text")).otherwise(F.aggregate(hits, F.col("text"), lambda t, h: F.regexp_replace(t, h["pattern"], put)))
    some = some.withColumn("text", text).drop(hits, key)
    if "n_chars" in docs.columns:
        some = some.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.filter(~has_candidates()).unionByName(some.select(docs.columns))
