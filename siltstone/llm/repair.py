"""Conversation structure repair by Dial's bucket-queue shortest paths over turns and role states."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import crc32_sql, discard, written

SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States of the roles so far: nothing, s, one that ends in u, one that ends in a. The role that a state lacks next, and where it leads.
NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
#: Where a kept role leads: (initial, state) -> state.
MOVES = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
STATES, FAR = range(4), 1 << 60
#: Cost of ending in each state, by inserting what it lacks; the inserts are these roles.
CLOSING = {0: (), 1: ("user", "assistant"), 2: ("assistant",), 3: ()}
END = tuple(INSERT * len(CLOSING[q]) for q in STATES)
#: A turn is coded by its initial and what has to happen to it: a capital letter is truncated, "-" has to go.
EDITS = "conv_id long, part long, open boolean, entry int, exit int, seq long, edit string, role string, text string, cost long"


def arcs(code: str, q: int) -> list[tuple[str, int, int]]:
    """(edit, state after, cost) of what can be done with a turn in a state, in the order of the edits' initials."""
    found = [("D", q, DELETE)]
    if code != "-":
        more = TRUNCATED if code.isupper() else 0
        if (code.lower(), q) in MOVES:
            found.append(("K", MOVES[code.lower(), q], KEEP + more))
        found.append(("R", NEXT[q][1], REROLE + more))
    return found


_BACK: dict[str, list[tuple[int, int, int]]] = {}


def back(code: str) -> list[list[tuple[int, int]]]:
    """For each state after a turn, the (state before, cost) that lead to it."""
    if code not in _BACK:
        _BACK[code] = [[(q, w) for q in STATES for _, to, w in arcs(code, q) if to == after] for after in STATES]
    return _BACK[code]


INSERTED = [[q for q in STATES if NEXT[q][1] == after] for after in STATES]


def distances(codes: str, after: tuple[int, ...]) -> list[list[int]]:
    """Least cost from each (turn, state) to the end, by a queue of buckets, one for each cost.

    after is what remains from each state past the last turn. Arcs cost 0 to 6, so a settled bucket only
    feeds the six behind it and itself.
    """
    n = len(codes)
    dist = [[FAR] * 4 for _ in range(n + 1)]
    least = min(after)
    buckets: list[list[tuple[int, int]]] = []

    def put(i: int, q: int, d: int) -> None:
        if d < dist[i][q]:
            dist[i][q] = d
            while len(buckets) <= d - least:
                buckets.append([])
            buckets[d - least].append((i, q))

    for q in STATES:
        if after[q] < FAR:
            put(n, q, after[q])
    at = 0
    while at < len(buckets):
        for i, q in buckets[at]:  # arcs of cost 0 append to the bucket that is being read
            d = at + least
            if dist[i][q] != d:
                continue
            if i < n:
                for before in INSERTED[q]:
                    put(i, before, d + INSERT)
            if i:
                for before, cost in back(codes[i - 1])[q]:
                    put(i - 1, before, d + cost)
        buckets[at] = []
        at += 1
    return dist


@lru_cache(1 << 14)
def matrix(codes: str) -> tuple[int, ...]:
    """Least costs from each state before the turns to each state past them, row by row."""
    ends = [distances(codes, tuple(0 if q == to else FAR for q in STATES))[0] for to in STATES]
    return tuple(ends[to][q] for q in STATES for to in STATES)


@lru_cache(1 << 14)
def walk(codes: str, after: tuple[int, ...], entry: int) -> tuple[str, int]:
    """The least string of edits along tight arcs from a state, and the state past the last turn."""
    dist = distances(codes, after)
    found, i, q = [], 0, entry
    while i < len(codes):
        left = dist[i][q]
        choices = [(e, i + 1, to, w) for e, to, w in arcs(codes[i], q)] + [("I", i, NEXT[q][1], INSERT)]
        edit, i, q = min((e, j, to) for e, j, to, w in choices if dist[j][to] + w == left)
        found.append(edit)
    return "".join(found), q


def faults(turns: DataFrame) -> DataFrame:
    """Different turns in the order of conversations and turns, with their first fault: a stored table.

    at grows with the order; its high bits number the range of the order that one task sorted. n is how often
    a turn stands there. fault is blank, duplicate (its role and text stand earlier in its conversation),
    truncated or null. Repeats beyond the first are duplicates unless they are blank.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    rows = rows.groupBy(*order).agg(F.count("*").alias("n"))
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    said = F.rtrim(F.col("text"), F.lit(SPACES))
    placed = written(placed.withColumn("blank", said == "").withColumn("cut", ~F.substring(said, -1, 1).isin(".", "!", "?")), "turns")
    key = ["conv_id", "role", F.sha2(F.col("text").cast("binary"), 256).alias("sha")]
    seen = placed.filter(~F.col("blank")).groupBy(*key).agg(F.min("at").alias("first"), F.count("*").alias("times")).filter("times > 1")
    seen = seen.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), "sha", "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.sha2(F.col("text").cast("binary"), 256) == F.col("sha"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first") < F.col("at"), "duplicate").when(F.col("cut"), "truncated")
    marked = placed.join(seen, same, "left").select("conv_id", "turn", "role", "text", "n", "at", F.shiftright("at", 33).alias("part"), fault.alias("fault"))
    out = written(marked, "marked")
    discard(placed)
    return out


def codes_of(roles: list[str], counts: list[int], found: list[str | None]) -> str:
    """A code for each turn, repeats included."""
    out = []
    for role, n, fault in zip(roles, counts, found, strict=True):
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        out.append("-" if fault in ("blank", "duplicate") else initial.upper() if fault == "truncated" else initial)
        if n > 1:
            out.append("-" * (n - 1))
    return "".join(out)


def pieces(part: pa.Table) -> Iterator[tuple[int | None, bool, pa.Table]]:
    """(conv_id, open, turns in order) of the conversations of a range; the first and last may go on in other ranges."""
    part = part.take(pa.array(np.argsort(part.column("at").to_numpy())))
    ids = part.column("conv_id").combine_chunks()
    # null ids come first in the order
    key, none = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
    start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (none[1:] != none[:-1]))))
    stop = np.append(start[1:], len(key))
    for k, (a, b) in enumerate(zip(start.tolist(), stop.tolist(), strict=True)):
        yield ids[a].as_py(), k in (0, len(start) - 1), part.slice(a, b - a)


def chain_costs(marked: DataFrame) -> DataFrame:
    """(conv, of_part, after) of each piece of a conversation at the edge of a range: what remains from each state past it.

    There are at most two such pieces a range.
    """

    def run(part: pa.Table) -> pa.Table:
        ends = [(c, part.column("part")[0].as_py(), list(matrix(coded(t)))) for c, is_open, t in pieces(part) if is_open]
        return pa.table(list(map(list, zip(*ends, strict=True))), schema=pa.schema([("conv", pa.int64()), ("of_part", pa.int64()), ("costs", pa.list_(pa.int64()))]))

    def back_to_front(part: pa.Table) -> pa.Table:
        part = part.sort_by([("of_part", "descending")])
        left, found = END, []
        for costs in part.column("costs").to_pylist():
            found.append(list(left))
            left = tuple(min(FAR, *(costs[4 * q + to] + left[to] for to in STATES)) for q in STATES)
        return pa.table([part.column("conv"), part.column("of_part"), pa.array(found, pa.list_(pa.int64()))], names=["conv", "of_part", "after"])

    costs = marked.groupBy("part").applyInArrow(run, "conv long, of_part long, costs array<long>")
    return costs.groupBy("conv").applyInArrow(back_to_front, "conv long, of_part long, after array<long>")


def coded(turns: pa.Table) -> str:
    return codes_of(*(turns.column(c).to_pylist() for c in ("role", "n", "fault")))


def edits(marked: DataFrame) -> DataFrame:
    """The cheapest edits of every conversation, the least in ASCII among equals: a stored table of EDITS, ordered by part and seq.

    A range of the order is one group; of a conversation that spans ranges, every piece first tells its costs
    from state to state, then what remains past each piece is known, each piece is walked from the states that
    it can be entered in, and the walk that follows from the first piece stays. role and text are the repaired
    turn's, or for a deletion those of the turn that goes.
    """
    after = written(chain_costs(marked), "after")

    def run(part: pa.Table) -> pa.Table:
        out: list[tuple] = []
        number = part.column("part")[0].as_py()
        for conv, is_open, turns in pieces(part):
            codes, left = coded(turns), turns.column("after")[0].as_py()
            left = tuple(left) if is_open else END
            said = [x for role, text, n in zip(*(turns.column(c).to_pylist() for c in ("role", "text", "n")), strict=True) for x in [(role, text)] * n]
            for entry in STATES if is_open else (0,):
                audit, q = walk(codes, left, entry)
                state, at, rows = entry, 0, []
                for edit in audit:
                    wanted, to = NEXT[state]
                    if edit == "I":
                        rows.append((edit, wanted, "", INSERT))
                        state = to
                        continue
                    (role, text), more = said[at], TRUNCATED if codes[at].isupper() else 0
                    at += 1
                    if edit == "D":
                        rows.append((edit, role, text, DELETE))
                    elif edit == "K":
                        rows.append((edit, role, text, KEEP + more))
                        state = MOVES[role[:1], state]
                    else:
                        rows.append((edit, wanted, text, REROLE + more))
                        state = to
                if not is_open:
                    rows += [("I", role, "", INSERT) for role in CLOSING[q]]
                out += [(conv, number, is_open, entry, q, k, *row) for k, row in enumerate(rows)]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in EDITS.split(", ")]
        columns = [[*c] for c in zip(*out, strict=True)] if out else [[]] * len(kinds)
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    here = F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("part") == F.col("of_part"))
    rows = marked.join(F.broadcast(after), here, "left").select("conv_id", "role", "text", "n", "at", "part", "fault", "after")
    walked = written(rows.groupBy("part").applyInArrow(run, EDITS), "walked")

    def front_to_back(part: pa.Table) -> pa.Table:
        exits: dict[int, dict[int, int]] = {}
        for number, entry, out in zip(*(part.column(c).to_pylist() for c in ("part", "entry", "exit")), strict=True):
            exits.setdefault(number, {})[entry] = out
        q, found = 0, []
        for number in sorted(exits):
            found.append((part.column("conv_id")[0].as_py(), number, q, None))
            q = exits[number][q]
        found[-1] = (*found[-1][:3], q)
        return pa.table([pa.array(c, t) for c, t in zip(map(list, zip(*found, strict=True)), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["conv", "of_part", "of_entry", "last"])

    # one row for each piece and state: at most eight a range
    ways = walked.filter("open").select("conv_id", "part", "entry", "exit").distinct()
    path = written(ways.groupBy("conv_id").applyInArrow(front_to_back, "conv long, of_part long, of_entry int, last int"), "path")
    chosen = walked.join(F.broadcast(path), here & (F.col("entry") == F.col("of_entry")), "left_semi").filter("open")
    closing = F.create_map(*(x for q in STATES for x in (F.lit(q), F.array(*map(F.lit, CLOSING[q])) if CLOSING[q] else F.array().cast("array<string>"))))
    closed = path.filter("last is not null").select("conv", "of_part", F.posexplode(F.try_element_at(closing, F.col("last"))).alias("k", "role"))
    seq = F.lit(1 << 60) + F.col("k")
    closed = closed.select(
        F.col("conv").alias("conv_id"), F.col("of_part").alias("part"), F.lit(True).alias("open"), F.lit(0).alias("entry"), F.lit(0).alias("exit"),
        seq.alias("seq"), F.lit("I").alias("edit"), "role", F.lit("").alias("text"), F.lit(INSERT).cast("long").alias("cost"),
    )
    out = written(walked.filter("not open").unionByName(chosen).unionByName(closed), "edits")
    discard(after, walked, path)
    return out


def initials(before: Column, now: Column) -> Column:
    return (before.isNotNull() & ~F.concat(F.substring(before, 1, 1), F.substring(now, 1, 1)).isin("su", "ua", "au")).cast("long")


def findings(marked: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal) of each conversation that has turns."""
    at = Window.partitionBy("conv_id", "part").orderBy("at")
    n, fault = F.col("n"), F.col("fault")
    rows = marked.withColumn("wrong", initials(F.lag("role").over(at), F.col("role")) + n - 1)  # a role twice is never right
    blank = F.sum(F.when(fault == "blank", n).otherwise(0))
    again = F.sum(F.when(fault == "duplicate", n).when(fault == "blank", 0).otherwise(n - 1))
    cut = F.sum(F.when(fault == "truncated", 1).otherwise(0))
    parts = rows.groupBy("conv_id", "part").agg(
        F.sum("wrong").alias("wrong"), blank.alias("blank"), again.alias("duplicate"), cut.alias("truncated"), F.min_by("role", "at").alias("head"), F.max_by("role", "at").alias("tail"),
    )
    parts = parts.withColumn("wrong", F.col("wrong") + initials(F.lag("tail").over(Window.partitionBy("conv_id").orderBy("part")), F.col("head")))
    found = parts.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")), F.sum("wrong").alias("illegal"))
    gap = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    gaps = marked.select("conv_id", "turn").distinct().groupBy("conv_id").agg(gap.alias("gaps"))
    gaps = gaps.withColumnRenamed("conv_id", "c")
    return found.join(gaps, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c").withColumnRenamed("conv_id", "conv")


def digests(made: DataFrame) -> DataFrame:
    """(conv_of, cost, audit, repaired_sha256) of each conversation: its edits are streamed in order, however many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cost, audit, sha, some = (), 0, [], hashlib.sha256(), False

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]], pa.int64()), pa.array([cost], pa.int64()), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])],
                ["conv_of", "cost", "audit", "repaired_sha256"],
            )

        for batch in batches:
            for conv, edit, line, paid in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if now != (conv,):
                    if now:
                        yield told()
                    now, cost, audit, sha, some = (conv,), 0, [], hashlib.sha256(), False
                cost += paid
                audit.append(edit)
                if edit != "D":
                    sha.update(b"\n" + line if some else line)
                    some = True
        if now:
            yield told()

    line = F.concat("role", F.lit(":"), "text").cast("binary").alias("line")
    rows = made.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").select("conv_id", "edit", line, "cost")
    return rows.mapInArrow(run, "conv_of long, cost long, audit string, repaired_sha256 string")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summaries, edits) of conversations given as turns(conv_id, turn, role, text).

    edits is described at edits(); those that are not deletions, in order, are the repaired conversation,
    whose role initials are nothing, or an s or none before one or more ua. summaries has for each conversation
    gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256. Turns are in order of turn
    (nulls first), then role, then text; null roles and texts are one space, so that a null text is blank;
    null ids are one conversation; repeated rows are repeated turns, duplicates or blank; a role of another
    initial can only be changed or go; an empty table gives none; other columns are ignored.
    """
    marked = faults(turns)
    made = edits(marked)
    told = digests(made).join(findings(marked), F.col("conv_of").eqNullSafe(F.col("conv")))
    return told.select(F.col("conv_of").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"), made


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with turns dropped (0), emptied (1), without end marks (2), repeated (3) or of a wrong role (4), by crc32(conv_id:turn) % 20."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    d = F.crc32(key.cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), d.alias("d"))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("d") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.filter("d != 0").select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repaired_digests(conversations: DataFrame) -> DataFrame:
    """The summaries of damaged conversations, with zeros for those of which nothing is left."""
    told, _ = repair(damaged(conversations))
    ids = conversations.select(F.col("conv_id").cast("long").alias("own")).distinct()
    none = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    found = ids.join(told, F.col("own").eqNullSafe(F.col("conv_id")), "left")
    return found.select(F.col("own").alias("conv_id"), *(F.coalesce(c, none.get(c, F.lit(0).cast("long"))).alias(c) for c in columns))


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: The best of the rest for each state goes from the last turn to the first as (cost, audit, repaired), whose order settles ties.
SQL = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS d
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM keyed),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, rtrim(text, {_BLANK}) AS said
  FROM damaged),
marked AS (
  SELECT *, CASE WHEN said = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, left(role, 1) AS r,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed),
told AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id),
best AS (
  SELECT conv_id, n + 1 AS i, {{'c': 0, 'a': '', 'p': ''}} AS q0, {{'c': 6, 'a': 'II', 'p': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS q1,
    {{'c': 3, 'a': 'I', 'p': chr(10) || 'assistant:'}} AS q2, {{'c': 0, 'a': '', 'p': ''}} AS q3
  FROM told
  UNION ALL
  SELECT conv_id, i, list_min([e0, {{'c': 3 + f2.c, 'a': 'I' || f2.a, 'p': chr(10) || 'user:' || f2.p}}]), list_min([e1, {{'c': 3 + f2.c, 'a': 'I' || f2.a, 'p': chr(10) || 'user:' || f2.p}}]), f2,
    list_min([e3, {{'c': 3 + e2.c, 'a': 'I' || e2.a, 'p': chr(10) || 'user:' || e2.p}}])
  FROM (
    SELECT *, list_min([e2, {{'c': 3 + e3.c, 'a': 'I' || e3.a, 'p': chr(10) || 'assistant:' || e3.p}}]) AS f2
    FROM (
      SELECT m.conv_id, m.i, {{expr_0}} AS e0, {{expr_1}} AS e1, {{expr_2}} AS e2, {{expr_3}} AS e3
      FROM (SELECT *, i AS at, CASE WHEN fault IN ('b', 'd') THEN 1000000 WHEN fault = 't' THEN 3 ELSE 0 END AS more FROM marked) AS m
      JOIN best AS b ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.i = b.i - 1)))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(q0.c, 0)::BIGINT AS cost, coalesce(q0.a, '') AS audit, sha256(coalesce(substr(q0.p, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o LEFT JOIN told AS t ON t.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best AS b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.i = 1
"""


def _choices(q: int) -> str:
    """SQL for the best edit of a turn in a state, inserts aside."""

    def option(edit: str, to: int, cost: str, role: str | None) -> str:
        said = f"chr(10) || {role} || ':' || text || b.q{to}.p" if role else f"b.q{to}.p"
        return f"{{'c': {cost} + b.q{to}.c, 'a': '{edit}' || b.q{to}.a, 'p': {said}}}"

    found = [option("D", q, "4", None), option("R", NEXT[q][1], "3 + more", f"'{NEXT[q][0]}'")]
    found += [option("K", to, f"CASE WHEN r = '{r}' THEN more ELSE 1000000 END", "role") for (r, state), to in MOVES.items() if state == q]
    return f"list_min([{', '.join(found)}])"


for _q in STATES:
    SQL = SQL.replace(f"{{expr_{_q}}}", _choices(_q))
