"""Repair of a conversation's structure at least cost.

Rows stand in the order of turn (nulls first), then role, then text. Each is kept,
re-roled, deleted, or has an empty turn put in before it, so that the initials of the
roles become ``(s?(ua)+)?``. The lattice has four nodes before each row (nothing yet, after
the system turn, after a user, after an assistant) and arcs of whole-number cost.

Shortest paths come from the auction algorithm (Bertsekas 1991): nodes have prices that
never exceed arc cost plus the price at the arc's end; a path grows along the arc that
attains the minimum, or shrinks and raises the price of its last node. When it reaches the
end, the price of its start is the exact cost. The lattice is cut into blocks, solved from
the last to the first: the four exact prices at a border are the ends of the block before,
so the work is linear in the rows. On every cheapest path all arcs are tight (price =
cost + price at the end); among tight arcs that lead on, the trace takes the least letter.

A conversation of up to ``CHUNK`` rows is solved where its rows lie sorted. Of a longer
one, each chunk first gives its costs from every border node to every border node (small
rows), these are combined from the last chunk to the first, and then its rows stream
through with the exact prices at each chunk's end: no task holds more than a chunk of it.
Which rows repeat an earlier one is then told by a window over (conversation, row digest).

Edge cases: a null role or text is one space, so it is blank or has no legal initial, as an
empty role has none; a null turn comes first; a null ``conv_id`` is a conversation of its
own; equal rows are duplicates of the first; other columns are not read; an empty table
gives an empty result. Exact duplicates are told by SHA-256 of role and text in long
conversations, by role and text themselves in others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

#: Rows of a conversation that are held and solved at once, and rows of a lattice block.
CHUNK, BLOCK = 2048, 16

_SPACE = " \t\n\x0b\x0c\r"
#: Nodes: nothing yet, after the system turn, after a user, after an assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
INF = 1 << 40
#: What the end costs: an open turn is closed by inserted ones.
END = (0, 2 * INSERT, INSERT, 0)
_TAIL = ("", "II", "I", "")

BLANK, DUPLICATE, CUT, FINE = range(4)


def text_fault(text: str) -> int:
    last = text.rstrip(_SPACE)[-1:]
    return BLANK if not last else FINE if last in ".!?" else CUT


def row_arcs(role: str, fault: int) -> list[list[tuple[str, int, bool, int]]]:
    """Per node its arcs over a row, by letter: (letter, cost, to the next row, node)."""
    out = []
    for q in range(4):
        arcs = [("D", DELETE, True, q), ("I", INSERT, False, _NEXT[q])]
        if fault >= CUT:
            extra = TRUNCATED if fault == CUT else 0
            first = role[:1]
            kept = SYSTEM if first == "s" and q == NONE else _NEXT[q] if first == ("a" if q == USER else "u") else None
            if kept is not None:
                arcs.append(("K", KEEP + extra, True, kept))
            arcs.append(("R", REROLE + extra, True, _NEXT[q]))
        out.append(arcs)
    return out


def _prices(arcs: list, ends: tuple[int, ...], starts: tuple[int, ...]) -> list[list[int]]:
    """Node prices of a block whose last border has the prices ``ends``, exact at ``starts``
    and wherever tight arcs lead to the end. INF where no path leads to the end."""
    m = len(arcs)
    able = [[False] * 4 for _ in range(m)] + [[x < INF for x in ends]]
    for i in range(m - 1, -1, -1):
        for _ in range(3):  # inserted turns lead on within a border
            for q in range(4):
                able[i][q] = able[i][q] or any(able[i + go][to] for _, _, go, to in arcs[i][q])
    low = min(ends)
    price = [[low if x else INF for x in row] for row in able[:m]] + [list(ends)]
    for start in starts:
        if price[0][start] >= INF:
            continue
        path, i, q = [], 0, start
        while i < m:
            best, at = INF, None
            for _, cost, go, to in arcs[i][q]:
                reached = cost + price[i + go][to]
                if reached < best:
                    best, at = reached, (i + go, to)
            if best > price[i][q]:
                price[i][q] = best  # contract
                if path:
                    i, q = path.pop()
            else:
                path.append((i, q))  # extend
                i, q = at
    return price


def borders(arcs: list, ends: tuple[int, ...], first: tuple[int, ...] = (0, 1, 2, 3)) -> tuple[list, tuple[int, ...]]:
    """Prices of all blocks of a chunk, and those of its first border."""
    blocks = []
    for at in range((len(arcs) - 1) // BLOCK * BLOCK, -1, -BLOCK):
        part = arcs[at : at + BLOCK]
        price = _prices(part, ends, first if not at else (0, 1, 2, 3))
        blocks.append((part, price))
        ends = tuple(price[0])
    return blocks[::-1], ends


def trace(blocks: list, q: int) -> tuple[list[tuple[str, int, int]], int]:
    """The least letters along tight arcs from a first node: per row its letters, the node
    before them and the node after; and the last node."""
    out = []
    for arcs, price in blocks:
        m = len(arcs)
        alive = [[False] * 4 for _ in range(m)] + [[x < INF for x in price[m]]]
        tight = [[[] for _ in range(4)] for _ in range(m)]
        for i in range(m - 1, -1, -1):
            for _ in range(3):
                for p in range(4):
                    tight[i][p] = [a for a in arcs[i][p] if alive[i + a[2]][a[3]] and price[i][p] == a[1] + price[i + a[2]][a[3]]]
                    alive[i][p] = bool(tight[i][p])
        letters, before, i = "", q, 0
        while i < m:
            letter, _, go, to = tight[i][q][0]
            letters, q = letters + letter, to
            if go:
                out.append((letters, before, q))
                letters, before, i = "", q, i + 1
    return out, q


# ---------------------------------------------------------------- rows


def in_order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def cleaned(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


class _Chunk:
    """Rows in order, of one conversation, that are solved together."""

    def __init__(self):
        self.rows, self.ends = [], END

    def solve(self, q: int):
        blocks, first = borders([row_arcs(role, fault) for role, _, fault in self.rows], self.ends, (q,))
        steps, q = trace(blocks, q)
        return steps, q, first


def _repaired(rows, steps) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that a chunk gives; deleted rows with a null role."""
    for (role, text, _), (letters, q, _) in zip(rows, steps):
        for letter in letters:
            if letter == "D":
                yield letter, None, text
                continue
            q = SYSTEM if letter == "K" and q == NONE and role[:1] == "s" else _NEXT[q]
            yield letter, role if letter == "K" else _ROLE[q], "" if letter == "I" else text


def _conversations(batches: Iterator[pa.RecordBatch], turns: bool, most: int) -> Iterator[tuple]:
    """Sorted rows in; a report row per conversation out, or its repaired turns."""
    now: tuple | None = None
    total: int | None = None

    def flush(last: bool):
        nonlocal q, total
        if chunk.rows:
            if last and not long:
                chunk.ends = END
            steps, q_next, first = chunk.solve(q)
            if total is None:
                total = first[q]
            for edit, role, text in _repaired(chunk.rows, steps):
                yield from put(edit, role, text)
            q = q_next
        if last:
            for _ in _TAIL[q]:
                q = _NEXT[q]
                yield from put("I", _ROLE[q], "")
        chunk.rows, chunk.ends = [], END

    def put(edit, role, text):
        nonlocal place
        if turns:
            yield now[0], place, edit, role, text
        else:
            audit.append(edit)
            if role is not None:
                digest.update((b"\n" if digest_any[0] else b"") + f"{role}:{text}".encode())
                digest_any[0] = True
        place += 1

    def end():
        yield from flush(True)
        if not turns:
            gaps = top - low + 1 - distinct if distinct else 0
            yield now[0], gaps, counts[BLANK], counts[DUPLICATE], counts[CUT], illegal, total, "".join(audit), digest.hexdigest()

    for conv, turn, role, text, ends, repeat in _runs(batches):
        if now is None or conv != now[0]:
            if now is not None:
                yield from end()
            now, chunk, q, place, total = (conv,), _Chunk(), NONE, 0, None
            audit, digest, digest_any, seen = [], hashlib.sha256(), [False], set()
            counts, illegal, before = [0] * 4, 0, None
            low = top = last_turn = None
            distinct, n, long = 0, 0, ends is not None
        if n and n % most == 0:
            yield from flush(False)
        if long and not chunk.rows:
            chunk.ends = tuple(ends)
        fault = text_fault(text)
        if not long:
            repeat = (role, text) in seen
            seen.add((role, text))
        if repeat and fault != BLANK:
            fault = DUPLICATE
        counts[fault] += 1
        if before is not None and before[:1] + role[:1] not in ("su", "ua", "au"):
            illegal += 1
        before = role
        if turn is not None:
            low = turn if low is None else low
            distinct += turn != last_turn
            top = last_turn = turn
        chunk.rows.append((role, text, fault))
        n += 1
    if now is not None:
        yield from end()


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, edit string, role string, text string"


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], most: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def cut():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield cut()
            held = []
    if held:
        yield cut()


def _walk(turns: bool, most: int):
    long, text = pa.int64(), pa.string()
    kinds = [long, long, text, text, text] if turns else [long] * 7 + [text] * 2
    names = [c.split()[0] for c in (TURNS if turns else REPORT).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_conversations(batches, turns, most), names, kinds)

    return run


# ---------------------------------------------------------------- long conversations


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk, sorted rows in: the costs from each node of its first border to each node
    of its last one, INF where there is no way."""

    def made():
        now, arcs = None, []

        def matrix():
            flat = []
            for target in range(4):
                flat += borders(arcs, tuple(0 if t == target else INF for t in range(4)))[1]
            return *now, flat

        for conv, chunk, role, fault in _runs(batches):
            if now is not None and (conv, chunk) != now:
                yield matrix()
                arcs = []
            now = (conv, chunk)
            arcs.append(row_arcs(role, fault))
        if arcs:
            yield matrix()

    yield from _batches(made(), ["conv_id", "chunk", "costs"], [pa.int64(), pa.int64(), pa.list_(pa.int64())])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a conversation from the last to the first in: the exact prices at each
    chunk's end."""

    def made():
        now, ends = object(), END
        for conv, chunk, costs in _runs(batches):
            if conv != now:
                now, ends = conv, END
            yield conv, chunk, list(ends)
            ends = tuple(min(INF, *(costs[4 * t + q] + ends[t] for t in range(4))) for q in range(4))

    yield from _batches(made(), ["conv_id", "chunk", "ends"], [pa.int64(), pa.int64(), pa.list_(pa.int64())])


def _with_ends(rows: DataFrame, most: int) -> DataFrame:
    """Rows of long conversations with the exact prices at the end of their chunk."""
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    first = Window.partitionBy("conv_id", "digest").orderBy(F.col("turn").asc_nulls_first())
    told = rows.withColumn("digest", digest).withColumn("repeat", F.row_number().over(first) > 1).drop("digest")
    # dealt by ranges, so that a conversation may lie in many; then places by adding up
    told = told.repartitionByRange(*in_order(), F.col("repeat")).sortWithinPartitions(*in_order(), "repeat")
    told = stage(told.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "long")
    sizes = told.groupBy("conv_id", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("conv_id").alias("_conv"), F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), "_low")
    placed = told.join(starts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_part") == F.col("_of")))
    placed = stage(placed.select("conv_id", "turn", "role", "text", "repeat", F.floor((F.col("_start") + F.col("_at") - F.col("_low")) / most).alias("chunk"), F.col("_at").alias("at")), "placed")
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(F.col("repeat"), DUPLICATE).when(last.isin(".", "!", "?"), FINE).otherwise(CUT)
    slim = placed.select("conv_id", "chunk", "at", F.substring("role", 1, 1).alias("role"), fault.alias("fault")).repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "at")
    costs = slim.select("conv_id", "chunk", "role", "fault").mapInArrow(_costs, "conv_id long, chunk long, costs array<long>")
    back = stage(costs, "costs").repartition("conv_id").sortWithinPartitions("conv_id", F.col("chunk").desc())
    ends = stage(back.mapInArrow(_combine, "conv_id long, chunk long, ends array<long>"), "ends")
    ends = ends.select(F.col("conv_id").alias("_conv"), F.col("chunk").alias("_chunk"), "ends")
    return placed.join(ends, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk"))).select("conv_id", "turn", "role", "text", "ends", "repeat")


def _ready(rows: DataFrame, most: int) -> DataFrame:
    rows = cleaned(rows)
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > most)
    long = stage(sizes.select(F.col("conv_id").alias("_long")), "long_ids")
    is_long = F.col("conv_id").eqNullSafe(F.col("_long"))
    out = rows.join(long, is_long, "left_anti").select("*", F.lit(None).cast("array<long>").alias("ends"), F.lit(False).alias("repeat"))
    if not long.isEmpty():
        out = out.unionByName(_with_ends(rows.join(long, is_long, "left_semi"), most))
    return out.repartition("conv_id").sortWithinPartitions(*in_order(), "repeat")


def repair_report(rows: DataFrame, most: int = CHUNK) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit`` (the edits' letters) and ``repaired_sha256``."""
    return _ready(rows, most).mapInArrow(_walk(False, most), REPORT)


def repaired_turns(rows: DataFrame, most: int = CHUNK) -> DataFrame:
    """The repaired conversations: ``conv_id, place, edit, role, text``; a deleted row has a
    null role."""
    return _ready(rows, most).mapInArrow(_walk(True, most), TURNS)
