"""Repair of conversation structure: Dijkstra on the lattice of (turn index, grammar state).

A well-formed conversation is ``(s?(ua)+)?`` by role initials. A node of the lattice is how many rows were read and
which state the grammar is in; an edit is an edge. The search pops nodes by (cost, edits so far) and stops at the first
accepting end, so it visits few nodes of a conversation that is nearly right. Both parts of the key grow along every
edge, and two ways to one node of equal cost are never prefixes of each other, so the first visit is the best.

A conversation of more than BLOCK rows is cut into blocks by ranges of its turns, however many it has. Each block is
searched from every state it can be entered in; of what it finds only costs and the order of the edit texts leave the
task. Those small tables are chained from block to block, which settles where each block is entered and left, and each
block then writes its own repaired turns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from heapq import heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from claimweave.llm.common import Scratch, small_batches

BLOCK = 2048
START, SYSTEM, USER, ANSWERED = range(4)
#: The grammar: state and role initial to state. Accepting: nothing yet, or an answer given.
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ANSWERED, (ANSWERED, "u"): USER}
ACCEPTING = (START, ANSWERED)
#: The role that may come next in a state, for inserted and changed rows.
WANTED = {START: "user", SYSTEM: "user", USER: "assistant", ANSWERED: "user"}
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
CHANGE, DROP, ADD, CUT_OFF = 2, 3, 2, 1
_SPACE = " \t\n\v\f\r"
TURNS = "array<struct<role:string,text:string>>"
_OUT = f"z boolean, c long, chunk int, chunks int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns {TURNS}"


def fault(text: str, seen: bool) -> int:
    """The first fault of a row: blank, seen before, or without an end."""
    said = text.rstrip(_SPACE)
    return BLANK if not said else DUPLICATE if seen else FINE if said[-1] in ".!?" else TRUNCATED


def searched(roles: Sequence[str], faults: Sequence[int], state: int = START, whole: bool = True) -> Iterator[tuple[int, int, str]]:
    """``(state, cost, edits)`` of the ends of the lattice, cheapest first, ties by the edits' text.

    Edits are K(eep), R(erole), D(elete) and I(nsert). Without ``whole`` nothing is inserted after the last row, since
    what comes before a row belongs to that row's block.
    """
    n, done, heap = len(roles), set(), [(0, "", 0, state)]
    while heap:
        cost, audit, i, s = heappop(heap)
        if (i, s) in done:
            continue
        done.add((i, s))
        if i == n:
            yield s, cost, audit
        wanted = WANTED[s]
        after = STEP[s, wanted[0]]
        if (i < n or whole) and (i, after) not in done:
            heappush(heap, (cost + ADD, audit + "I", i, after))
        if i == n:
            continue
        if (i + 1, s) not in done:
            heappush(heap, (cost + DROP, audit + "D", i + 1, s))
        if faults[i] in (FINE, TRUNCATED):
            cost += CUT_OFF * (faults[i] == TRUNCATED)
            if (kept := STEP.get((s, roles[i][:1]))) is not None and (i + 1, kept) not in done:
                heappush(heap, (cost, audit + "K", i + 1, kept))
            if (i + 1, after) not in done:
                heappush(heap, (cost + CHANGE, audit + "R", i + 1, after))


def replayed(roles: Sequence[str], texts: Sequence[str], audit: str, state: int = START) -> list[tuple[str, str]]:
    """The (role, text) rows that edits leave."""
    out, i = [], 0
    for edit in audit:
        if edit != "D":
            role = roles[i] if edit == "K" else WANTED[state]
            out.append((role, "" if edit == "I" else texts[i]))
            state = STEP[state, role[:1]]
        i += edit != "I"
    return out


def illegal_pairs(roles: Sequence[str]) -> int:
    return sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))


def _repaired(turns: list, roles: list[str], texts: list[str]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit and turns of one conversation in order."""
    seen, faults = set(), []
    for row in zip(roles, texts):
        faults.append(fault(row[1], row in seen))
        seen.add(row)
    known = {t for t in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    cost, audit = next((cost, audit) for s, cost, audit in searched(roles, faults) if s in ACCEPTING)
    return gaps, *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal_pairs(roles), cost, audit, replayed(roles, texts, audit)


def _short(rows: DataFrame) -> DataFrame:
    """One chunk per conversation, each read by one task, a conversation at a time."""
    schema = pa.schema(
        [("z", pa.bool_()), ("c", pa.int64()), ("chunk", pa.int32()), ("chunks", pa.int32())]
        + [(k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        + [("audit", pa.string()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]
    )

    def told(key: tuple, held: list) -> dict:
        *rest, turns = _repaired(*map(list, zip(*held)))
        return dict(zip(schema.names, (*key, 0, 1, *rest, [{"role": r, "text": t} for r, t in turns])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            out = []
            for z, c, *row in zip(*(b.column(k).to_pylist() for k in ("z", "c", "turn", "role", "text"))):
                if (z, c) != key:
                    if held:
                        out.append(told(key, held))
                    key, held = (z, c), []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist([told(key, held)], schema)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("z", "c", F.col("turn").asc_nulls_first(), "role", "text")
    return rows.repartition(parts, "z", "c").sortWithinPartitions(*order).mapInArrow(run, _OUT)


def _judged(rows: DataFrame, block: int) -> DataFrame:
    """Rows of long conversations with ``part, block, fault``: in order within a part, parts in order of the turns."""
    own = rows.withColumns({"h": F.xxhash64("role", "text"), "g": F.xxhash64(F.lit(1), "text", "role")})
    many = own.groupBy("z", "c", "h", "g").agg(F.count("*").alias("n"), F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("f"))
    many = many.where("n > 1").select("z", "c", "h", "g", F.lit(True).alias("many"), F.col("f.turn").alias("first"))
    marked = own.join(many, ["z", "c", "h", "g"], "left").select(
        "z", "c", "turn", "role", "text", (F.col("many") & ~F.col("turn").eqNullSafe(F.col("first"))).alias("later"), F.col("many")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, k, before = TaskContext.get().partitionId(), None, 0, None
        for b in batches:
            blocks, places, faults = [], [], []
            for z, c, *row, later, many in zip(*(b.column(x).to_pylist() for x in b.schema.names)):
                if (z, c) != key:
                    key, k, before = (z, c), 0, None
                blocks.append(k // block)
                places.append(k)
                faults.append(fault(row[2], bool(many) and (later or row == before)))
                k, before = k + 1, row
            columns = [b.column("z"), b.column("c"), pa.array([part] * len(blocks), pa.int32()), pa.array(blocks, pa.int32())]
            columns += [pa.array(places, pa.int64()), b.column("turn"), b.column("role"), b.column("text"), pa.array(faults, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["z", "c", "part", "block", "place", "turn", "role", "text", "fault"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("z", "c", F.col("turn").asc_nulls_first(), "role")
    ranged = marked.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")
    return ranged.mapInArrow(run, "z boolean, c long, part int, block int, place long, turn long, role string, text string, fault int")


def _summary(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One block: for each way through it the cost and the place of its edits among those of the block."""
    rows = rows.sort_values("place")
    roles, faults = list(rows["role"]), list(rows["fault"])
    ways = [(s, *w) for s in range(4) for w in searched(roles, faults, s, whole=False)]
    rank = {a: k for k, a in enumerate(sorted({w[3] for w in ways}))}
    counts = [sum(f == x for f in faults) for x in (BLANK, DUPLICATE, TRUNCATED)]
    out = (*key, *counts, illegal_pairs(roles), roles[0][:1], roles[-1][:1], [x for s, e, cost, a in ways for x in (s, e, cost, rank[a])])
    return pd.DataFrame([out], columns=["z", "c", "part", "block", "blank", "duplicate", "truncated", "illegal", "first", "last", "ways"])


def chained(blocks: list[list[tuple[int, int, int, int]]]) -> tuple[int, list[tuple[int, int]], str]:
    """Blocks of ways (entered, left, cost, rank of the edits) -> the least cost, the states of each block, inserts at the end.

    Of the best way to each state only its cost and its order among the four are kept, which is all that a comparison of
    the ways to the next block's states needs.
    """
    now, steps = {START: (0, 0)}, []
    for ways in blocks:
        best: dict[int, tuple] = {}
        for enter, leave, cost, rank in ways:
            if enter in now:
                key = (now[enter][0] + cost, now[enter][1], rank, enter)
                best[leave] = min(best.get(leave, key), key)
        order = {k: n for n, k in enumerate(sorted({(v[1], v[2]) for v in best.values()}))}
        steps.append({leave: v[3] for leave, v in best.items()})
        now = {leave: (v[0], order[v[1], v[2]]) for leave, v in best.items()}
    tail = {START: "", ANSWERED: "", USER: "I", SYSTEM: "II"}
    cost, _, end = min((cost + ADD * len(tail[s]), order, s) for s, (cost, order) in now.items())
    out, s = [], end
    for back in reversed(steps):
        out.append((back[s], s))
        s = back[s]
    return cost, out[::-1], tail[end]


def _decided(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Where each block of one conversation is entered and left, from their summaries alone."""
    rows = rows.sort_values(["part", "block"])
    cost, steps, tail = chained([list(zip(*[iter(map(int, w))] * 4)) for w in rows["ways"]])
    firsts, lasts = list(rows["first"]), list(rows["last"])
    between = sum(a + b not in ("su", "ua", "au") for a, b in zip(lasts, firsts[1:]))
    out = rows[["z", "c", "part", "block"]].assign(chunk=range(len(rows)), chunks=len(rows))
    totals = {k: int(rows[k].sum()) for k in ("blank", "duplicate", "truncated")}
    out = out.assign(**totals, illegal=int(rows["illegal"].sum()) + between, cost=cost)
    return out.assign(enter=[s for s, _ in steps], leave=[e for _, e in steps], tail=[""] * (len(rows) - 1) + [tail])


def _written(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The repaired turns of one block."""
    rows = rows.sort_values("place")
    roles, texts, one = list(rows["role"]), list(rows["text"]), rows.iloc[0]
    found = searched(roles, list(rows["fault"]), int(one["enter"]), whole=False)
    audit = next(a for s, _, a in found if s == one["leave"]) + one["tail"]
    turns = [{"role": r, "text": t} for r, t in replayed(roles, texts, audit, int(one["enter"]))]
    return pd.DataFrame(
        {k: [one[k]] for k in ("z", "c", "chunk", "chunks", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
        | {"audit": [audit], "turns": [turns]}
    )


def _long(rows: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """Chunks of conversations of more than a block, block by block."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    judged, at = scratch.table(_judged(rows, block), "judged"), ("z", "c", "part", "block")
    told = judged.select(*at, "place", "role", "fault").repartition(parts, *at).groupBy(*at).applyInPandas(
        _summary,
        "z boolean, c long, part int, block int, blank long, duplicate long, truncated long, illegal long, first string, last string, ways array<long>"
    )
    counts = "blank long, duplicate long, truncated long, illegal long, cost long"
    where = told.groupBy("z", "c").applyInPandas(
        _decided, f"z boolean, c long, part int, block int, chunk int, chunks int, {counts}, enter int, leave int, tail string"
    )
    span = judged.groupBy("z", "c").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    )
    where = scratch.table(where.join(span, ["z", "c"]), "decided")
    return judged.join(where, [*at]).repartition(parts, *at).groupBy(*at).applyInPandas(_written, _OUT)


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` -> chunks of repaired conversations, least cost first by (cost, edits).

    Columns: conv_id, chunk and chunks (a conversation of up to ``block`` rows is one chunk), the counts gaps, blank,
    duplicate, truncated, illegal and the cost of the whole conversation, audit (the chunk's edits) and turns (its
    repaired rows). Rows are taken by turn, nulls first; rows of one turn by role, then text. Null roles and texts count
    as one space; a null conv_id is a conversation like any other. Repeated rows are duplicates. Empty tables give
    none, and columns of other names are never read.
    """
    spark = rows.sparkSession
    small_batches(spark)
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    conv = F.col("conv_id").cast("long")
    own = rows.select(conv.isNull().alias("z"), F.coalesce(conv, F.lit(0)).alias("c"), F.col("turn").cast("long").alias("turn"), said("role"), said("text"))
    scratch = Scratch(spark, "dialogue")
    long = scratch.table(own.groupBy("z", "c").agg(F.count("*").alias("n")).where(F.col("n") > block).select("z", "c"), "long")
    if long.isEmpty():
        out = _short(own)
    else:
        out = _short(own.join(long, ["z", "c"], "left_anti")).unionByName(_long(own.join(long, ["z", "c"], "left_semi"), scratch, block))
    return out.select(F.when(~F.col("z"), F.col("c")).alias("conv_id"), *(c for c in out.columns if c not in ("z", "c")))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32 of ``conv_id:turn`` modulo 20: see the query. Nulls count as one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", said("conv_id"), said("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    role = F.when(kind == 4, "user").otherwise(said("role"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("__n")).drop("__n")


def _lines(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def _streamed(chunks: DataFrame) -> DataFrame:
    """``conv_id, audit, repaired_sha256`` of conversations in several chunks, read in order, a chunk at a time.

    A digest is of all its bytes in order, so one task reads a conversation, but holds one chunk of it and its edits.
    """
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, audits, h, begun = None, [], None, False
        tell = lambda: pa.RecordBatch.from_arrays(
            [pa.array([key], pa.int64()), pa.array(["".join(audits)]), pa.array([h.hexdigest()])], ["conv_id", "audit", "repaired_sha256"]
        )
        for b in batches:
            for conv, chunk, audit, text, empty in zip(*(b.column(k).to_pylist() for k in ("conv_id", "chunk", "audit", "text", "empty"))):
                if chunk == 0:
                    if h is not None:
                        yield tell()
                    key, audits, h, begun = conv, [], hashlib.sha256(), False
                audits.append(audit)
                if not empty:
                    h.update((b"\n" if begun else b"") + text.encode())
                    begun = True
        if h is not None:
            yield tell()

    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = chunks.select("conv_id", "chunk", "audit", _lines(F.col("turns")).alias("text"), (F.size("turns") == 0).alias("empty"))
    return rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(
        run, "conv_id long, audit string, repaired_sha256 string"
    )


def digests(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per distinct conv_id of ``ids``, from the chunks of repair(): the counts, cost, audit, repaired_sha256.

    Conversations without a chunk have zeros, no edits, and the digest of an empty text.
    """
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    chunks = Scratch(chunks.sparkSession, "dialogue").table(chunks, "chunks")
    one = chunks.where("chunks = 1").select("conv_id", *counts, "audit", F.sha2(_lines(F.col("turns")), 256).alias("repaired_sha256"))
    many = chunks.where("chunks > 1")
    if not many.isEmpty():
        text = _streamed(many)
        heads = many.where("chunk = 0").select(F.col("conv_id").alias("__c"), *counts)
        one = one.unionByName(text.join(heads, F.col("conv_id").eqNullSafe(F.col("__c"))).drop("__c"))
    asked = ids.select(F.col("conv_id").cast("long").alias("__id")).distinct()
    out = asked.join(one, F.col("__id").eqNullSafe(F.col("conv_id")), "left")
    zeros = (F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts)
    return out.select(
        F.col("__id").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


def _crc_table() -> list[int]:
    """The 256 steps of CRC-32 by its polynomial, since the SQL has no such function."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


#: A recursion over the rows of each conversation, all states at once, instead of a search.
ORACLE = f"""
WITH RECURSIVE r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
    h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT)),
        lambda a, b: xor(a >> 8, {_crc_table()}[1 + (xor(a, b) & 255)])), 4294967295::BIGINT) % 20 AS d FROM r),
    m AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
        CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, substr(role, 1, 1) AS x FROM m),
    f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
        WHEN regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 0 ELSE 3 END AS fault,
        lag(x) OVER (PARTITION BY conv_id ORDER BY i) || x AS pair FROM o),
    g AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
        count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1),
    ins(a, b, c, e, t) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']),
        (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 2, 2, 'I', ['user:']), (1, 3, 4, 'II', ['user:', 'assistant:']), (2, 3, 2, 'I', ['assistant:']),
        (3, 2, 2, 'I', ['user:'])),
    op(a, b, x, c, e, role) AS (VALUES (0, 1, 's', 0, 'K', NULL), (0, 2, 'u', 0, 'K', NULL), (1, 2, 'u', 0, 'K', NULL), (2, 3, 'a', 0, 'K', NULL),
        (3, 2, 'u', 0, 'K', NULL), (0, 2, NULL, 2, 'R', 'user'), (1, 2, NULL, 2, 'R', 'user'), (2, 3, NULL, 2, 'R', 'assistant'),
        (3, 2, NULL, 2, 'R', 'user'), (0, 0, NULL, 3, 'D', NULL), (1, 1, NULL, 3, 'D', NULL), (2, 2, NULL, 3, 'D', NULL), (3, 3, NULL, 3, 'D', NULL)),
    w AS (SELECT conv_id, n, 0::BIGINT AS i, 0 AS s, {{'c': 0::BIGINT, 'e': '', 't': []::VARCHAR[]}} AS best FROM g
        UNION ALL
        SELECT w.conv_id, w.n, w.i + 1, op.b, min({{'c': w.best.c + ins.c + op.c + CASE WHEN op.e <> 'D' AND f.fault = 3 THEN 1 ELSE 0 END,
            'e': w.best.e || ins.e || op.e, 't': w.best.t || ins.t || CASE WHEN op.e = 'D' THEN []::VARCHAR[]
            ELSE [coalesce(op.role, f.role) || ':' || f.text] END}})
        FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN ins ON ins.a = w.s JOIN op ON op.a = ins.b
        WHERE (op.e = 'D' OR f.fault IN (0, 3)) AND (op.x IS NULL OR op.x = f.x) GROUP BY w.conv_id, w.n, w.i, op.b),
    z AS (SELECT conv_id, min({{'c': w.best.c + ins.c, 'e': w.best.e || ins.e, 't': w.best.t || ins.t}}) AS best
        FROM w JOIN ins ON ins.a = w.s WHERE w.i = w.n AND ins.b IN (0, 3) GROUP BY 1)
SELECT q.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
    coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
    coalesce(best.e, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM q.conv_id
LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM q.conv_id
"""
