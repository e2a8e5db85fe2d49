"""Runs of words, repaired conversations and languages against brute force, and on odd tables."""

import hashlib
import os
import random
import re
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from helixframe.llm import conversations, languages, runs
from helixframe.llm.conversations import cheapest_edits, repair_conversations
from helixframe.llm.queries import ORACLE, queries

DATA = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, runs int, key string, score string"


def documents(spark, rows):
    """Rows (doc_id, text, lang) with columns whose names an operator might use for itself."""
    return spark.createDataFrame([(k, t, g, "s", 0, 1, "x", "y") for k, t, g in rows], DOCS)


def brute_runs(words, least=6, exponent=4):
    found = {}
    for p in range(1, len(words) // exponent + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least, exponent * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i) + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least, exponent", [(6, 4), (3, 2), (3, 3)])
def test_runs_against_brute_force(least, exponent, monkeypatch):
    monkeypatch.setattr(runs, "PAIRS", 50)
    rng = random.Random(1)
    for _ in range(120):
        texts = []
        for _ in range(rng.randint(1, 5)):
            n, kinds = rng.choice([0, 1, 5, 6, 7, 20, 60, 150]), rng.choice([1, 2, 3, 30])
            w = [rng.randrange(kinds) for _ in range(n)]
            if n > 20 and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(3, 10)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        got = runs.find_runs([np.array(w, np.int64) for w in texts], least, exponent)
        assert [tuple(r) for r in got.tolist()] == [(k, *r) for k, w in enumerate(texts) for r in brute_runs(w, least, exponent)]


def test_extensions_over_long_repeats():
    rng = np.random.default_rng(3)
    piece = rng.integers(0, 5, 700)
    word = np.concatenate((piece, np.full(400, 7), piece, np.full(300, 7), piece[:650], [9], piece))
    levels = runs.recompress(np.concatenate(([10], word, [11])))
    assert len(levels) < 80 and sum(len(x.symbols) for x in levels) < 12 * len(word)
    a, b = rng.integers(1, len(word) + 1, (2, 3000))
    a, b = a[a != b], b[a != b]
    text = np.concatenate(([10], word, [11]))
    for back in (False, True):
        got = runs.extension(levels, a, b, back)
        for x, y, n in zip(a.tolist(), b.tolist(), got.tolist()):
            if back:
                k = next(k for k in range(len(text)) if text[x - 1 - k] != text[y - 1 - k])
            else:
                k = next(k for k in range(len(text)) if text[x + k] != text[y + k])
            assert n == k


def brute_collapsed(words):
    found = brute_runs(words)
    gone = {k for s, n, p in found for k in range(s + p, s + n)}
    return found, " ".join(w for k, w in enumerate(words) if k not in gone)


def test_collapsed_texts(spark):
    texts = [None, "", " \t\n", "one", "a " * 6, "a b c d " * 4, "x y x y" * 5, "la la la la la la and la la la la la la la", "a b a b a b a b c c c c c c c a b", "ü ü\tü\nü\x0bü\x0cü\rü", "b" * 300_000, "w " * 50_000]
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(None, texts[7], None), (4, texts[4], None), (4, texts[4], None)]
    got = sorted(map(tuple, runs.collapse_runs(documents(spark, rows).repartition(3)).collect()), key=str)
    want = []
    for k, t, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found, kept = ([(0, 50_000, 1)], "w") if len(words) > 1000 else brute_collapsed(words)
        want.append((k, [tuple(r) for r in found], kept))
    assert [(k, [tuple(r) for r in found], kept) for k, found, kept in got] == sorted(want, key=str)
    assert runs.collapse_runs(documents(spark, [])).count() == 0


@needs_tables
def test_periodic_runs_query(spark):
    got = {r["doc_id"]: r.asDict() for r in queries()["op11_periodic_runs"](spark, DATA).collect()}
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    planted = 0
    for k, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if len(words) > 1200:
            continue
        h, n = zlib.crc32(str(k).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, planted = [words[i if i < a else a + (i - a) % p] for i in range(n)], planted + 1
        found, kept = brute_collapsed(words)
        s, n, p = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        listed = "".join(f"{','.join(map(str, r))}\n" for r in found)
        assert got[k] == {"doc_id": k, "n_runs": len(found), "start": s, "length": n, "period": p, "exponent_milli": n and 1000 * n // p, "runs_sha256": hashlib.sha256(listed.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(kept.encode()).hexdigest()}
    assert planted > 5


def every_edit(rows):
    """The least (cost, audit) of all edits, by trying them all."""
    found = []

    def go(i, roles, cost, audit, inserted):
        if cost > 3 * len(rows):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            found.append((cost, audit))
        if inserted < 3:
            for x in "ua":
                go(i, roles + x, cost + 2, audit + "I", inserted + 1)
        if i < len(rows):
            go(i + 1, roles, cost + 3, audit + "D", 0)
            if rows[i] != "D":
                more = int(rows[i].isupper())
                go(i + 1, roles + rows[i].lower(), cost + more, audit + "K", 0)
                for x in "ua":
                    go(i + 1, roles + x, cost + 2 + more, audit + "R", 0)

    go(0, "", 0, "", 0)
    return min(found)


def test_cheapest_edits_against_all_edits():
    rng = random.Random(2)
    for rows in [*("".join(x) for n in range(3) for x in product("DsuaoSUAO", repeat=n)), *("".join(rng.choice("DsuaoSUAO") for _ in range(4)) for _ in range(40))]:
        assert cheapest_edits(rows) == every_edit(rows), rows


def brute_conversation(rows):
    """The report of one conversation's (turn, role, text), by plain loops and the checked search."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, marks = [], []
    for k, (_, role, text) in enumerate(rows):
        real = [c for c in text if c not in " \t\n\v\f\r"]
        fault = "blank" if not real else "duplicate" if (role, text) in [r[1:] for r in rows[:k]] else "truncated" if real[-1] not in ".!?" else None
        faults.append(fault)
        x = role[:1] if role[:1] in list("sua") else "o"
        marks.append("D" if fault in ("blank", "duplicate") else x.upper() if fault else x)
    cost, audit = cheapest_edits(marks)
    lines, state, at = [], "", 0
    for e in audit:
        other = "assistant" if state == "u" else "user"
        role, text = ("", "") if e == "I" else rows[at][1:]
        at += e != "I"
        if e == "D":
            continue
        role = role if e == "K" else other
        lines.append((role, text))
        state = role[:1]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in lines))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest), lines


@pytest.mark.parametrize("segment", [conversations.SEGMENT, 7])
def test_conversations_against_brute_force(spark, segment):
    """Also by segments: a conversation longer than one, with null ids, null and tied turns, repeated rows."""
    rng, rows = random.Random(5), []
    for k in range(40):
        for t in range(rng.choice([1, 3, 8, 60])):
            rows.append((None if k == 3 else k, rng.choice([t, t, None, 2 * t]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(["hi.", "ok!", " ", "", "no end", "x?\n", None, f"t{rng.randrange(99)}."])))
    rows += [(50, 0, "user", "y" * 200_000), (50, 1, "assistant", "z.")]
    table = spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, segment string, n int").repartition(5)
    report, repaired = repair_conversations(table, segment)
    lines = {}
    for r in repaired.orderBy("conv_id", "segment", "at").collect():
        lines.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    groups = {}
    for k, t, role, text in rows:
        groups.setdefault(k, []).append((t, " " if role is None else role, " " if text is None else text))
    got = {r[0]: tuple(r)[1:] for r in report.collect()}
    want = {k: brute_conversation(g) for k, g in groups.items()}
    assert got == {k: w[0] for k, w in want.items()}
    assert lines == {k: w[1] for k, w in want.items() if w[1]}
    assert repair_conversations(table.limit(0))[0].count() == 0


@needs_tables
def test_conversation_query(spark):
    rows = spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    groups = {}
    for k, t, role, text in rows:
        h = zlib.crc32(f"{k}:{t}".encode()) % 20
        own = groups.setdefault(k, [])
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            own += [(t, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    got = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in queries()["op12_conversation_repair"](spark, DATA).collect()}
    assert got == {k: brute_conversation(g)[0] for k, g in groups.items()}


@needs_tables
@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_conversation_repair"])
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    found = con.execute(ORACLE[name])
    columns, want = [d[0] for d in found.description], found.fetchall()
    got = queries()[name](spark, DATA).select(columns)
    assert len(got.columns) == len(columns) == {"op11_periodic_runs": 8, "op12_conversation_repair": 9}[name] and len(want) > 10
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_odd_conversations(spark):
    """Dropped conversations, null columns and an empty table, by the query's own damage."""
    from helixframe.llm.queries import damaged

    gone = next(k for k in range(999) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = spark.createDataFrame([(gone, 0, "user", "hi."), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    left = damaged(rows).collect()
    assert all(r["conv_id"] is None and r["role"] in (" ", "user") for r in left)
    assert damaged(rows.limit(0)).count() == 0


@pytest.mark.parametrize("block", [64, 2])
def test_posteriors_against_all_labellings(block, monkeypatch):
    monkeypatch.setattr(languages, "BLOCK", block)
    rng, sizes, k = np.random.default_rng(0), [1, 3, 0, 6, 2], 3
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    e, step, first = rng.normal(0, 2, (bounds[-1], k)), rng.normal(0, 1, (k, k)), rng.normal(0, 1, k)
    got = languages.posteriors(e, bounds, step, first)
    for low, high in zip(bounds[:-1], bounds[1:]):
        n = int(high - low)
        total = np.zeros((n, k))
        for y in product(range(k), repeat=n):
            if n:
                score = first[y[0]] + sum(e[low + t, y[t]] for t in range(n)) + sum(step[y[t - 1], y[t]] for t in range(1, n))
                total[np.arange(n), list(y)] += np.exp(score)
        assert np.allclose(total / np.maximum(total.sum(axis=1, keepdims=True), 1e-300), got[low:high])


def test_slopes_against_differences():
    rng, k = np.random.default_rng(1), 3
    given = [rng.normal(0, 1, (2, 4, k)), rng.normal(0, 1, (k, k)), rng.normal(0, 1, k)]
    want = rng.integers(0, k, (2, 4))

    def loss(e, step, first):
        total = 0
        for c in range(2):
            score = lambda y: first[y[0]] + sum(e[c, t, y[t]] for t in range(4)) + sum(step[y[t - 1], y[t]] for t in range(1, 4))
            total += np.log(sum(np.exp(score(y)) for y in product(range(k), repeat=4))) - score(want[c])
        return total

    for at, slope in enumerate(languages._gradient(given[0], want, given[1], given[2])):
        for index in np.ndindex(slope.shape):
            up, down = [x.copy() for x in given], [x.copy() for x in given]
            up[at][index] += 1e-5
            down[at][index] -= 1e-5
            assert abs((loss(*up) - loss(*down)) / 2e-5 - slope[index]) < 1e-5


def brute_features(word):
    """Affixes and byte n-grams of a word between spaces."""
    b = word.encode()
    spaced = b" " + b + b" "
    affixes = [(x[:k], x[-k:]) for x in [b] for k in range(1, 5) if len(b) >= k]
    return affixes, [spaced[k : k + 2] for k in range(len(spaced) - 1)], [spaced[k : k + 3] for k in range(len(spaced) - 2)]


def test_features_against_plain_loops():
    texts = ["The thing, a", "", None, "Öl123und x", "enkeit"]
    data, begins, ends, bounds = languages._words(pa.array(texts))
    words = [data[a:b].tobytes().decode() for a, b in zip(begins, ends)]
    assert words == ["the", "thing", "a", "öl", "und", "x", "enkeit"] and bounds.tolist() == [0, 3, 3, 3, 6, 7]
    hashes = np.arange(len(words), dtype=np.uint64)
    fixed, grams, first = languages._features(data, begins, ends, hashes, np.array([2], np.uint64), np.array([5]))
    ends_ = np.append(first[1:], len(grams))
    number = lambda b: np.array([int.from_bytes(b)], np.uint64)
    for k, word in enumerate(words):
        affixes, pairs, triples = brute_features(word)
        assert fixed[k, 1] == (5 if k == 2 else 1)
        for n in range(4):
            want = [int(languages._bucket(number(x), kind + n)[0]) for x, kind in zip(affixes[n], (10, 20))] if n < len(affixes) else [0, 0]
            assert fixed[k, 2 + 2 * n : 4 + 2 * n].tolist() == want
        want = sorted(int(languages._bucket(number(x), kind)[0]) for xs, kind in ((pairs, 30), (triples, 31)) for x in xs)
        assert sorted(x for x in grams[first[k] : ends_[k]].tolist() if x) == want


@needs_tables
def test_languages_of_held_out_documents(spark):
    rows = queries()["op13_language_id"](spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and 200 < len(held) < 300
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.99 * len(held)


def test_languages_of_odd_and_switching_texts(spark):
    rng = random.Random(3)
    words = {"aa": ["alo", "belo", "celo", "dalo"], "bb": ["rith", "sith", "tuth", "wath"]}
    text = lambda g, n: " ".join(rng.choice(words[g]) for _ in range(n))
    rows = [(k, text(g, 40), g) for k in range(60) for g in words] + [(1, None, "aa"), (None, text("bb", 9), "bb"), (2, text("aa", 9), None)]
    model = languages.train_languages(documents(spark, rows))
    assert model.languages == ("aa", "bb")
    mixed = f"{text('aa', 12).upper()}. {text('bb', 15)}, {text('aa', 20)}"
    odd = [(1, mixed), (2, None), (3, ""), (4, "12 … 3"), (5, "é"), (None, text("bb", 5)), (6, text("aa", 90_000)), (7, text("aa", 3)), (7, text("aa", 3))]
    got = {}
    for r in languages.predict_languages(documents(spark, [(k, t, None) for k, t in odd]), model, spans=True).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert [tuple(s) for s in got[1][0]["spans"]] == [(0, 12, "aa"), (12, 15, "bb"), (27, 20, "aa")]
    assert all((got[k][0]["lang_pred"], got[k][0]["score"]) == ("und", 0) for k in (2, 3, 4)) and got[5][0]["lang_pred"] in words
    assert [got[k][0]["lang_pred"] for k in (None, 6, 7)] == ["bb", "aa", "aa"] and len(got[7]) == 2
    # what stands around a text changes nothing
    assert languages.predict_languages(documents(spark, [(1, mixed, None)]), model).first()["score"] == got[1][0]["score"]
    nothing = languages.train_languages(documents(spark, []))
    assert languages.predict_languages(documents(spark, [(1, "abc", None)]), nothing, spans=True).first()["lang_pred"] == "und"
