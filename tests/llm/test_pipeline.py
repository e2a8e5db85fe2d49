"""Stages of corpus_pipeline.py against brute force, with null and repeated ids."""

import hashlib
from collections import Counter

import corpus_pipeline

from test_operators import DOCS, brute_components, prose


def test_near_duplicates_with_null_and_repeated_ids(spark):
    near = prose(1, 80)
    rows = [(7, near), (7, near), (7, near + " end"), (None, near + " stop"), (7, prose(2, 40)), (9, prose(3, 40)), (9, prose(4, 40)), (3, prose(4, 40))]
    rows += [(None, prose(5, 40)), (None, prose(5, 40) + " x"), (None, prose(5, 40)), (None, ""), (None, ""), (4, None), (9, "one"), (None, "ONE")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], DOCS).repartition(3)
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect())
    groups = {}
    for at, (n, component) in brute_components({k: t for k, (_, t) in enumerate(rows)}).items():
        groups.setdefault(component, []).append(rows[at])
    assert sum(got.values()) == len(groups) and sorted(map(len, groups.values())) == [1] * 5 + [2, 2, 3, 4]
    for group in groups.values():
        ids = [k for k, _ in group if k is not None]
        assert sum(got[row] for row in set(group) if row[0] == (min(ids) if ids else None)) >= 1


def test_secrets_with_null_and_repeated_ids(spark):
    token = hashlib.sha1(b"5").hexdigest()
    bad, clean = f'token = "{token}" and more', f"the commit {token} is in no way secret"
    rows = [(None, bad), (None, clean), (1, bad), (1, clean), (1, None), (1, bad)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], DOCS)
    got = Counter((r["doc_id"], r["text"], r["n_chars"]) for r in corpus_pipeline.secret_stage(spark, docs, "").collect())
    marked = 'token = "[SECRET]" and more'
    assert got == Counter((k, t, len(t or "")) for k, t in ((k, marked if t == bad else t) for k, t in rows))


def test_pipeline_of_an_odd_table(spark, tmp_path):
    """The whole of it over nulls, repeats, empty and long texts, clashing names and a map, each stage by plain rules."""
    near, token = prose(1, 80), hashlib.sha1(b"5").hexdigest()
    texts = [near, near, near + " end", prose(2, 90), prose(2, 90), "", "", None, "one", f'token = "{token}" and more', prose(7, 20_000)] + [prose(k, 60) for k in range(10, 40)]
    rows = [(None if k % 7 == 6 else k % 25, t, "en", f"s{k % 3}", len(t or ""), "mine", {"a": k}, k) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS + ", score string, extra map<string,int>, __source int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(25)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    read, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = read.collect()
        made = stage(spark, read, str(tmp_path))
        assert made.columns == docs.columns
        made.write.parquet(f"{tmp_path}/{name}")
        read = spark.read.parquet(f"{tmp_path}/{name}")
        after = read.collect()
        seen[name] = (before, after)
        if name != "secret scans":  # what stays is as it was, in any column
            assert not Counter(map(str, after)) - Counter(map(str, before))
    before, after = seen["n-gram Jaccard join"]
    want = {c for _, c in brute_components({k: r["text"] for k, r in enumerate(before)}).values()}
    assert len(after) == len(want) < len(before)
    before, after = seen["secret scans"]
    assert sorted((r["text"] or "").replace(token, "[SECRET]") for r in before) == sorted(r["text"] or "" for r in after) and len(before) == len(after)
    kept, pieces = seen["mixing sources to target weights"][1], corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == Counter(r["doc_id"] for r in kept)
    for sequence in {r["sequence_id"] for r in pieces}:
        own = sorted((r["offset"], r["length"]) for r in pieces if r["sequence_id"] == sequence)
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0 and sum(own[-1]) <= 1024
