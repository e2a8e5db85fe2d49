"""Repair of conversations: the cheapest edits that let the roles' initials read ``(s?(ua)+)?``.

A depth-first branch-and-bound search with an explicit stack. A node is (rows done, state of the pattern); children come in
the order of their letters, so audits are met in ASCII order and of equal costs the first is the least. A child goes if its
cost and the bound of what is left don't undercut the incumbent, or if its node was met before at no higher cost. The bound
is the least cost of the rows that follow from each state, audits left aside. The first incumbent is one above the root's
bound; when the stack is empty, the incumbent is proved.

A conversation of at most SEGMENT rows is held by one task. A longer one is cut: each segment is searched from every state
to every state, the segments of a conversation are joined over these sixteen answers, and its rows are never together but
where their text is hashed, one after the other.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .common import materialize

#: Rows, and code points of text, of a conversation that one task holds; rows of a segment of a longer one.
SEGMENT, MOST_CHARS = 20_000, 1 << 26
SPACE, ENDS = " \t\n\v\f\r", ".!?"
#: Costs of edits, and of a truncated row that stays.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: States: nothing yet, after s, after u, after a; the state that a symbol leads to. From each, one of u and a may follow.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
FREE = (USER, USER, ASSISTANT, USER)
FINAL = (START, ASSISTANT)
ROLE = {USER: "user", ASSISTANT: "assistant"}
NEVER = 1 << 60
#: A row as the search sees it: the initial that it would keep, or D where it must go; upper case if truncated.
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def is_blank(text: str) -> bool:
    return not text.strip(SPACE)


def is_truncated(text: str) -> bool:
    return text.rstrip(SPACE)[-1:] not in tuple(ENDS)


def _moves(row: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, state, cost) of the edits of a row in a state, in the order of letters."""
    if row == "D":
        return [("D", state, DELETE)]
    more = TRUNCATED if row.isupper() else 0
    kept = NEXT[state].get(row.lower())
    return [("D", state, DELETE)] + ([("K", kept, more)] if kept is not None else []) + [("R", FREE[state], REROLE + more)]


MOVES = {row: [_moves(row, x) for x in range(4)] for row in "DsuaoSUAO"}


def suffix_bounds(rows: Sequence[str], exits: Sequence[int], tail: bool) -> list[list[int]]:
    """For each number of rows done, the least cost from each state to one of ``exits``; tail: insertions may end it."""

    def inserted(x: list[int]) -> list[int]:
        for _ in range(3):
            x = [min(x[s], INSERT + x[FREE[s]]) for s in range(4)]
        return x

    least = [0 if s in exits else NEVER for s in range(4)]
    bounds = [inserted(least) if tail else least]
    for row in reversed(rows):
        after, moves = bounds[-1], MOVES[row]
        bounds.append(inserted([min(cost + after[to] for _, to, cost in moves[s]) for s in range(4)]))
    return bounds[::-1]


def cheapest_edits(rows: Sequence[str], entry: int = START, exits: Sequence[int] = FINAL, tail: bool = True) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits, of equal ones the ASCII-least audit; None if no exit can be reached.

    ``rows``: for each row ``s``, ``u``, ``a`` or ``o`` (any other), upper case if truncated, or ``D`` if it must go.
    """
    n, bounds = len(rows), suffix_bounds(rows, exits, tail)
    if bounds[0][entry] >= NEVER:
        return None
    best_cost, best_audit = bounds[0][entry] + 1, None
    dominated: dict[tuple[int, int], int] = {}
    path: list[str] = []
    stack = [(0, entry, 0, 0, "")]
    while stack:
        i, state, cost, depth, letter = stack.pop()
        if cost + bounds[i][state] >= best_cost or dominated.get((i, state), NEVER) <= cost:
            continue
        dominated[i, state] = cost
        del path[depth - 1 if depth else 0 :]
        if letter:
            path.append(letter)
        if i == n and state in exits:
            best_cost, best_audit = cost, "".join(path)
            continue
        children = [(i + 1, to, cost + more, depth + 1, x) for x, to, more in MOVES[rows[i]][state]] if i < n else []
        if i < n or tail:
            children.append((i, FREE[state], cost + INSERT, depth + 1, "I"))
        stack += sorted(children, key=lambda c: c[4], reverse=True)
    return best_cost, best_audit


def repaired_lines(audit: str, roles: Sequence[str], texts: Sequence[str], state: int = START) -> Iterator[tuple[str, str]]:
    """(role, text) of what an audit makes of rows, from a state on."""
    at = 0
    for letter in audit:
        if letter == "I":
            state = FREE[state]
            yield ROLE[state], ""
            continue
        if letter == "K":
            state = NEXT[state][roles[at][:1]]
            yield roles[at], texts[at]
        elif letter == "R":
            state = FREE[state]
            yield ROLE[state], texts[at]
        at += 1


def _legal(a: str, b: str) -> bool:
    return a[:1] + b[:1] in ("su", "ua", "au")


def _conversation(turns: list[int | None], roles: list[str], texts: list[str]) -> tuple[list, list[tuple[str, str]]]:
    """The report's fields and the repaired lines of one conversation, its rows in order."""
    faults, seen, rows = Counter(), set(), []
    for role, text in zip(roles, texts, strict=True):
        fault = "blank" if is_blank(text) else "duplicate" if (role, text) in seen else "truncated" if is_truncated(text) else ""
        seen.add((role, text))
        faults[fault] += 1
        kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
        rows.append("D" if fault in ("blank", "duplicate") else kind.upper() if fault else kind)
    cost, audit = cheapest_edits(rows)
    lines = list(repaired_lines(audit, roles, texts))
    known = [t for t in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(not _legal(a, b) for a, b in zip(roles, roles[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    return [gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest], lines


_FIELDS = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
_LINES = [("segment", pa.int64()), ("at", pa.int64()), ("role", pa.string()), ("text", pa.string())]


def _whole(kind: pa.DataType, lines: bool):
    """Reports, or repaired lines, of the conversations of a task whose rows arrive in order."""
    schema = pa.schema([("conv_id", kind), *(_LINES if lines else _FIELDS)])

    def made(key, turns: list, roles: list, texts: list) -> list[tuple]:
        report, repaired = _conversation(turns, roles, texts)
        return [(key, 0, n, r, t) for n, (r, t) in enumerate(repaired)] if lines else [(key, *report)]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [], [])
        for part in batches:
            out = []
            for k, *row in zip(*(part.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                if k != key and held[0]:
                    out += made(key, *held)
                    held = ([], [], [])
                key = k
                for x, v in zip(held, row, strict=True):
                    x.append(v)
            yield batch(out)
        if held[0]:
            yield batch(made(key, *held))

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's number among its conversation's rows in this task."""
    part, before = TaskContext.get().partitionId(), Counter()
    for batch in batches:
        inner = []
        for k in batch.column("conv_id").to_pylist():
            inner.append(before[k])
            before[k] += 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inner, pa.int64()), pa.array([part] * len(inner), pa.int32())], names=[*batch.schema.names, "inner", "part"])


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with their number in the conversation, ``n``; no conversation is in one task."""
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    order = ["conv_id", "turn", "role", "text"]
    ranged = rows.withColumn("digest", digest).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, turn long, role string, text string, digest string, inner long, part int"
    inner = materialize(ranged.select(*order, "digest").mapInArrow(_counted, schema), "turns")
    sums = inner.groupBy("conv_id", "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("conv_id").alias("of"), F.col("part").alias("at"), before.alias("before"))
    found = inner.join(sums, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")))
    return found.select(*order, "digest", (F.col("inner") + F.col("before")).alias("n"))


def _faults(text: Column, again: Column) -> Column:
    space = "[ \\t\\n\\x0B\\f\\r]"
    return F.when(~text.rlike(f"[^{space[1:-1]}]"), "blank").when(again, "duplicate").when(~text.rlike(f"[.!?]{space}*\\z"), "truncated").otherwise("")


def _segment(pdf: pd.DataFrame) -> pd.DataFrame:
    """Costs and audits between all states over a segment, its border initials and its illegal neighbours."""
    pdf = pdf.sort_values("n")
    rows, initials = pdf["row"].tolist(), pdf["initial"].tolist()
    found = [[cheapest_edits(rows, a, [b], tail=False) for b in range(4)] for a in range(4)]
    ends = [cheapest_edits(rows, a) for a in range(4)]
    flat = [x for line in found for x in line] + ends
    return pd.DataFrame([{"conv_id": pdf["conv_id"].iloc[0], "segment": pdf["segment"].iloc[0], "first": initials[0], "last": initials[-1], "illegal": sum(not _legal(a, b) for a, b in zip(initials, initials[1:])), "costs": [x[0] if x else NEVER for x in flat], "audits": [x[1] if x else None for x in flat]}])


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """A conversation's cheapest way over its segments: each one's entry state and audit, the whole cost, illegal borders."""
    pdf = pdf.sort_values("segment")
    costs, audits = pdf["costs"].tolist(), pdf["audits"].tolist()
    least = [int(c) for c in costs[-1][16:]]  # from each state over the last segment to the end
    bounds = [least]
    for c in costs[-2::-1]:
        bounds.append([min(int(c[4 * a + b]) + bounds[-1][b] for b in range(4)) for a in range(4)])
    bounds.reverse()
    state, chosen = START, []
    for k in range(len(costs) - 1):
        # no audit of a segment begins another of it, as insertions stand before rows: the least one leads on
        audit, to = min((audits[k][4 * state + b], b) for b in range(4) if costs[k][4 * state + b] < NEVER and costs[k][4 * state + b] + bounds[k + 1][b] == bounds[k][state])
        chosen.append((state, audit))
        state = to
    chosen.append((state, audits[-1][16 + state]))
    firsts, lasts = pdf["first"].tolist(), pdf["last"].tolist()
    illegal = int(pdf["illegal"].sum()) + sum(not _legal(a, b) for a, b in zip(lasts, firsts[1:]))
    return pd.DataFrame([{"conv_id": pdf["conv_id"].iloc[0], "segment": s, "entry": e, "edits": x, "cost": bounds[0][START], "illegal": illegal} for s, (e, x) in zip(pdf["segment"], chosen, strict=True)])


def _segment_lines(rows: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("n")
    lines = list(repaired_lines(chosen["edits"].iloc[0], rows["role"].tolist(), rows["text"].tolist(), int(chosen["entry"].iloc[0])))
    return pd.DataFrame([(chosen["conv_id"].iloc[0], chosen["segment"].iloc[0], n, r, t) for n, (r, t) in enumerate(lines)], columns=["conv_id", "segment", "at", "role", "text"])


def _hashed(kind: pa.DataType):
    """The digest of each conversation's lines, which arrive in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda k, h: pa.RecordBatch.from_arrays([pa.array([k], kind), pa.array([h.hexdigest()])], names=["conv_id", "repaired_sha256"])
        key, digest = None, None
        for part in batches:
            for k, role, text in zip(*(part.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if digest is not None and k == key:
                    digest.update(b"\n")
                else:
                    if digest is not None:
                        yield out(key, digest)
                    key, digest = k, hashlib.sha256()
                digest.update(f"{role}:{text}".encode())
        if digest is not None:
            yield out(key, digest)

    return run


def _long(rows: DataFrame, segment: int, kind: DataType) -> tuple[DataFrame, DataFrame]:
    """Reports and repaired lines of conversations of any length."""
    key, name = kind.simpleString(), to_arrow_type(kind)
    numbered = _in_order(rows)
    first = numbered.groupBy("conv_id", "digest").agg(F.min("n").alias("first")).select(F.col("conv_id").alias("of"), F.col("digest").alias("same"), "first")
    fault = _faults(F.col("text"), F.col("n") > F.col("first"))
    numbered = numbered.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("same"))).withColumn("fault", fault).drop("of", "same", "first", "digest")
    initial = F.substring("role", 1, 1)
    kept = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    row = F.when(F.col("fault").isin("blank", "duplicate"), "D").when(F.col("fault") == "truncated", F.upper(kept)).otherwise(kept)
    numbered = materialize(numbered.withColumns({"row": row, "initial": initial, "segment": F.floor(F.col("n") / segment)}), "rows")
    tables = numbered.select("conv_id", "segment", "n", "row", "initial").groupBy("conv_id", "segment").applyInPandas(_segment, f"conv_id {key}, segment long, first string, last string, illegal long, costs array<long>, audits array<string>")
    chosen = materialize(tables.groupBy("conv_id").applyInPandas(_joined, f"conv_id {key}, segment long, entry int, edits string, cost long, illegal long"), "edits")
    at = ["conv_id", "segment"]
    lines = numbered.select(*at, "n", "role", "text").groupBy(*at).cogroup(chosen.select(*at, "entry", "edits").groupBy(*at)).applyInPandas(_segment_lines, f"conv_id {key}, segment long, at long, role string, text string")
    lines = materialize(lines, "lines")
    digests = lines.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "at").select("conv_id", "role", "text").mapInArrow(_hashed(name), f"conv_id {key}, repaired_sha256 string")
    faults = [F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")]
    counts = numbered.groupBy("conv_id", "turn").agg(*faults).groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"), *(F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")))
    audits = chosen.groupBy("conv_id").agg(F.max("illegal").alias("illegal"), F.max("cost").alias("cost"), F.expr("listagg(edits, '') within group (order by segment)").alias("audit"))
    by = lambda df, c: df.withColumnRenamed("conv_id", c)
    report = counts.join(by(audits, "of"), F.col("conv_id").eqNullSafe(F.col("of"))).join(by(digests, "again"), F.col("conv_id").eqNullSafe(F.col("again")), "left")
    report = report.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))
    return report.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"), lines


def repair_conversations(rows: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """(report, repaired) of a table (conv_id, turn, role, text).

    report: a row for each conversation: gaps between its turns; rows whose first fault is blank, duplicate or truncated;
    neighbours whose initials are not su, ua or au; cost and audit of the cheapest edits; the digest of its repaired
    ``role:text`` lines. repaired: (conv_id, segment, at, role, text), in that order the lines themselves.

    Rows are ordered by turn (nulls first), then role and text; a null role or text is one space; a null conv_id is a
    conversation like others. Repeated rows are duplicates. Other columns are left out, and an empty table gives none.
    A conversation of more than ``segment`` rows or MOST_CHARS code points is worked on by segments. Its hash is sequential, so
    its repaired text passes through one task, a batch at a time.
    """
    kind = rows.schema["conv_id"].dataType
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"))
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars"))
    long = materialize(sizes.filter((F.col("rows") > segment) | (F.col("chars") > MOST_CHARS)).select(F.col("conv_id").alias("of"), F.lit(True).alias("long")), "long")
    any_long = not long.isEmpty()
    same = F.col("conv_id").eqNullSafe(F.col("of"))
    short = rows.join(long, same, "left_anti") if any_long else rows
    ordered = short.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    key, name = kind.simpleString(), to_arrow_type(kind)
    report = ordered.mapInArrow(_whole(name, False), f"conv_id {key}, {REPORT}")
    repaired = ordered.mapInArrow(_whole(name, True), f"conv_id {key}, segment long, at long, role string, text string")
    if any_long:
        long_report, long_lines = _long(rows.join(long, same, "left_semi"), segment, kind)
        report, repaired = report.unionByName(long_report), repaired.unionByName(long_lines)
    return report, repaired
