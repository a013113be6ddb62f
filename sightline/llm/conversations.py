"""Repair of conversations by a lazily determinised weighted automaton.

A conversation is repaired by edits of its rows (keep, give another role, delete, insert) so
that its roles read ``(s?(ua)+)?``. The grammar has four states; the least cost to finish from
each of them, with the rows from some place on, is a vector of four numbers. These vectors less
their least number are the states of a deterministic automaton that reads a conversation from
its last row to its first: few ever occur, and they and their transitions are made when they are
first met. Reading is then a look into a table for each row and gives the costs. Against the
direction of reading, so in the order of rows, the arcs on which the costs agree (tight arcs)
give the edits; the least letter that is tight is taken.

Rows lie in Spark's ranges of (conversation, turn, role, text), so that a conversation may span
any number of partitions. What a partition does to the piece of a conversation at its edge is a
4x4 matrix of costs, read from four unit vectors by the same table. The driver sees one row a
partition: two such matrices, and where a trace ends that starts in each state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import broadcast_if_small, checkpointed, parallelism, released, stored

#: Costs of the edits, and what a truncated row adds that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Grammar states: nothing yet, after s, after u, after a. The role that may be inserted or given in each, and where it leads.
NEXT_ROLE, NEXT = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 4, 2, 0)
INFINITE = 1 << 60
CLASSES = ("s", "u", "a", None)
#: A row that must be deleted; others are 1 + 2 * class of the role's initial + truncated.
FORCED = 0
SPACE = r"\x20\x09-\x0D"
#: Bytes of repaired text in one row where a conversation spans partitions.
CHUNK = 4_000_000


def closed(v: Iterable[int]) -> tuple[int, ...]:
    """The costs if rows may be inserted first."""
    v = list(v)
    for _ in range(3):
        v = [min(x, INSERT + v[NEXT[q]]) for q, x in enumerate(v)]
    return tuple(v)


class Automaton:
    """States are normalised vectors of costs to finish; the table of transitions grows as rows are read."""

    def __init__(self) -> None:
        self.number: dict[tuple[int, ...], int] = {}
        self.vectors: list[tuple[int, ...]] = []
        self.table: list[list[tuple[int, int] | None]] = []
        self.arcs: dict[tuple[int, int, int], tuple[str, int]] = {}

    def state(self, v: Iterable[int]) -> tuple[int, int]:
        """The state of a vector, and the least number in it."""
        v = tuple(v)
        least = min(v)
        v = tuple(x - least if x < INFINITE // 2 else INFINITE for x in v)
        if v not in self.number:
            self.number[v] = len(self.vectors)
            self.vectors.append(v)
            self.table.append([None] * (1 + 2 * len(CLASSES)))
        return self.number[v], least

    @staticmethod
    def before(v: tuple[int, ...], symbol: int) -> tuple[int, ...]:
        """The costs before a row, from those after it."""
        if symbol == FORCED:
            return closed(DELETE + x for x in v)
        initial, cut = CLASSES[(symbol - 1) // 2], TRUNCATED * ((symbol - 1) % 2)
        best = []
        for q in range(4):
            best.append(min(DELETE + v[q], REROLE + cut + v[NEXT[q]]))
            if initial in KEPT[q]:
                best[q] = min(best[q], cut + v[KEPT[q][initial]])
        return closed(best)

    def read(self, state: int, symbol: int) -> tuple[int, int]:
        found = self.table[state][symbol]
        if found is None:
            found = self.table[state][symbol] = self.state(self.before(self.vectors[state], symbol))
        return found

    def scan(self, symbols: list[tuple[int, int]], right: Iterable[int]) -> tuple[list[int], tuple[int, ...]]:
        """The states after each row (of ``(symbol, times)``, read from the last), and the costs before the first.
        A symbol that repeats is FORCED from its second time on, which leaves the state as it is."""
        state, cost = self.state(right)
        after = [0] * len(symbols)
        for i in range(len(symbols) - 1, -1, -1):
            symbol, times = symbols[i]
            after[i] = state
            cost += DELETE * (times - 1)
            state, more = self.read(state, symbol)
            cost += more
        return after, tuple(x + cost if x < INFINITE // 2 else INFINITE for x in self.vectors[state])

    def arc(self, after: int, symbol: int, q: int) -> tuple[str, int]:
        """The least letters of tight arcs from grammar state ``q`` before a row over it, and the state after it."""
        key = (after, symbol, q)
        if key not in self.arcs:
            v, letters = self.vectors[after], ""
            w = self.before(v, symbol)
            cut = TRUNCATED * ((symbol - 1) % 2) if symbol != FORCED else 0
            initial = CLASSES[(symbol - 1) // 2] if symbol != FORCED else None
            while True:
                if w[q] == DELETE + v[q]:
                    letters += "D"
                    break
                if w[q] == INSERT + w[NEXT[q]]:
                    letters, q = letters + "I", NEXT[q]
                elif symbol != FORCED and initial in KEPT[q] and w[q] == cut + v[KEPT[q][initial]]:
                    letters, q = letters + "K", KEPT[q][initial]
                    break
                else:
                    letters, q = letters + "R", NEXT[q]
                    break
            self.arcs[key] = (letters, q)
        return self.arcs[key]

    def trace(self, symbols: list[tuple[int, int]], after: list[int], q: int) -> tuple[list[str], int]:
        """The letters of each row, and the grammar state after the last."""
        out = []
        for (symbol, times), state in zip(symbols, after):
            letters, q = self.arc(state, symbol, q)
            out.append(letters + "D" * (times - 1))
        return out, q

    def matrix(self, symbols: list[tuple[int, int]]) -> list[tuple[int, ...]]:
        """By grammar state after the rows: the least cost from each state before them."""
        return [self.scan(symbols, closed(0 if i == q else INFINITE for i in range(4)))[1] for q in range(4)]


def ending(q: int) -> str:
    """The rows that are inserted after the last one."""
    return {0: "", 1: "II", 2: "I", 3: ""}[q]


def through(matrix: list[list[int]], right: Iterable[int]) -> list[int]:
    """The costs before a piece with this matrix, from those after it."""
    right = list(right)
    return [min(matrix[b][a] + right[b] for b in range(4)) for a in range(4)]


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: equal rows of a turn together; n is 0 for those that are dropped."""
    known = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fate = F.crc32(key.cast("binary")) % 20
    return known.withColumn("fate", fate).select(
        "conv_id", "turn",
        F.when(F.col("fate") == 0, "").when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") < 2, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1).alias("n"),
    ).groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def _ordered(rows: DataFrame) -> DataFrame:
    """The rows with fault and symbol, in ranges of their order; ``part`` is the partition."""
    facts = rows.withColumn("blank", ~F.col("text").rlike(f"[^{SPACE}]")).withColumn("digest", F.sha2("text", 256))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    said = facts.filter("n > 0 and not blank").groupBy("conv_id", "role", "digest")
    again = checkpointed(said.agg(F.min(place).alias("first"), F.count("*").alias("places")).filter("places > 1").select(
        F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("first.turn").alias("first_turn")))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    later = F.col("d").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    joined = facts.join(broadcast_if_small(again), same, "left").select(
        "conv_id", "turn", "role", "text", "n", "blank", (later & ~F.col("blank")).alias("duplicate"),
        (~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")).alias("truncated"), initial.alias("initial"), kind.alias("kind"),
    )
    symbol = F.when(F.col("blank") | F.col("duplicate"), FORCED).otherwise(1 + 2 * F.col("kind") + F.col("truncated").cast("int"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc()]
    ranged = joined.withColumn("symbol", symbol).repartitionByRange(parallelism(rows.sparkSession), *order, F.substring("text", 1, 64).asc())
    kept = ranged.sortWithinPartitions(*order, F.col("text").asc()).drop("kind")
    return checkpointed(kept.withColumn("part", F.spark_partition_id()))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple]]]:
    """(conversation, its rows that weren't dropped) of a partition in order."""
    rows, current, begun = [], None, False
    for batch in batches:
        names = [x for x in batch.schema.names if x not in ("conv_id", "n", "part")]
        for conv, n, *rest in zip(batch.column("conv_id").to_pylist(), batch.column("n").to_pylist(), *(batch.column(x).to_pylist() for x in names)):
            if not begun or conv != current:
                if begun:
                    yield current, rows
                rows, current, begun = [], conv, True
            if n:
                rows.append((n, *rest))
    if begun:
        yield current, rows


def _symbols(rows: list[tuple], at: int) -> list[tuple[int, int]]:
    return [(r[at], r[0]) for r in rows]


def _edges(ordered: DataFrame) -> list[dict]:
    """Of each partition with rows: its first and last conversation, what their pieces do, and their outer initials."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, first, last, count, part = Automaton(), None, None, 0, None

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal part
            for b in batches:
                if b.num_rows:
                    part = b.column("part")[0].as_py()
                    yield b

        for conv, rows in _pieces(seen()):
            count, last = count + 1, (conv, rows)
            first = first or last
        if count:
            out = {"part": [part], "alone": [count == 1]}
            for name, (conv, rows) in (("first", first), ("last", last)):
                out |= {f"{name}_conv": [conv], f"{name}_matrix": [automaton.matrix(_symbols(rows, 1))], f"{name}_initials": [[rows[0][2], rows[-1][2]] if rows else []]}
            yield pa.record_batch(pa.table(out, schema=schema).to_batches()[0])

    matrix, initials = pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())
    schema = pa.schema([("part", pa.int32()), ("alone", pa.bool_())] + [(f"{x}_{y}", t) for x in ("first", "last") for y, t in (("conv", pa.int64()), ("matrix", matrix), ("initials", initials))])
    kinds = "part int, alone boolean, " + ", ".join(f"{x}_conv long, {x}_matrix array<array<long>>, {x}_initials array<string>" for x in ("first", "last"))
    return sorted((r.asDict() for r in ordered.select("conv_id", "n", "symbol", "initial", "part").mapInArrow(work, kinds).collect()), key=lambda r: r["part"])


def _ends(ordered: DataFrame, right: dict[int, list[int]]) -> dict[int, list[int]]:
    """Of each partition whose last conversation goes on: where a trace over that piece ends, by its first state."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, last, part = Automaton(), None, None

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal part
            for b in batches:
                if b.num_rows:
                    part = b.column("part")[0].as_py()
                    yield b

        for last in _pieces(seen()):
            pass
        if last and part in right:
            symbols = _symbols(last[1], 1)
            after, _ = automaton.scan(symbols, right[part])
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([[automaton.trace(symbols, after, q)[1] for q in range(4)]], pa.list_(pa.int64()))], names=["part", "ends"])

    found = ordered.filter(F.col("part").isin([*right])) if len(right) < 1000 else ordered
    return {r["part"]: r["ends"] for r in found.select("conv_id", "n", "symbol", "part").mapInArrow(work, "part int, ends array<long>").collect()}


def _borders(ordered: DataFrame) -> dict[int, dict]:
    """By partition: ``right``, the costs after its last piece, if that goes on in another partition; ``left``, the
    grammar state before its first one and the initial of the row before, if that has begun in another one."""
    edges = _edges(ordered)
    right: dict[int, list[int]] = {}
    for a, b in reversed(list(zip(edges, edges[1:]))):
        if a["last_conv"] == b["first_conv"]:
            right[a["part"]] = through(b["first_matrix"], right.get(b["part"], FINAL) if b["alone"] else FINAL)
    ends = _ends(ordered, right) if right else {}
    borders: dict[int, dict] = {p: {"right": v} for p, v in right.items()}
    q, initial = 0, None
    for a, b in zip(edges, edges[1:]):
        if a["part"] not in right:
            q, initial = 0, None
            continue
        if not a["alone"]:
            q, initial = 0, None
        q = ends[a["part"]][q]
        initial = a["last_initials"][-1] if a["last_initials"] else initial
        borders.setdefault(b["part"], {})["left"] = (q, initial)
    return borders


RESULT = "conv_id long, piece long, at long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, chunk binary"


def _repaired(ordered: DataFrame, borders: dict[int, dict]) -> DataFrame:
    """RESULT: one row for each conversation within one partition; for pieces of others, rows with ``piece``, of which the first has the counts."""
    fields = [x.split(" ") for x in RESULT.split(", ")]
    schema = pa.schema([(name, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[kind]) for name, kind in fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, border, part, out, size = Automaton(), {}, None, [], 0

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal part, border
            for b in batches:
                if b.num_rows:
                    part = b.column("part")[0].as_py()
                    border = borders.get(part, {})
                    yield b

        def of(conv: int | None, rows: list[tuple], opened: bool, goes_on: bool) -> Iterator[tuple]:
            symbols = _symbols(rows, 1)
            q, initial = border["left"] if opened else (0, None)
            right = border["right"] if goes_on else FINAL
            after, cost = automaton.scan(symbols, right)
            letters, end = automaton.trace(symbols, after, q)
            counts, lines, state = [0, 0, 0, 0], [], q
            for (n, symbol, first, blank, duplicate, truncated, role, text), some in zip(rows, letters):
                counts[0] += n if blank else 0
                counts[1] += 0 if blank else n if duplicate else n - 1
                counts[2] += bool(truncated and not blank and not duplicate)
                counts[3] += n - 1 + (initial is not None and initial + first not in ("su", "ua", "au"))
                initial = first
                for x in some[: len(some) - n + 1]:
                    if x == "D":
                        continue
                    lines.append(f"{role}:{text}" if x == "K" else f"{NEXT_ROLE[state]}:" + (text if x == "R" else ""))
                    state = KEPT[state][first] if x == "K" else NEXT[state]
            spent = cost[q] - (right[end] if goes_on else 0)
            audit = "".join(letters)
            if not goes_on:
                audit += ending(end)
                for _ in ending(end):
                    lines.append(f"{NEXT_ROLE[state]}:")
                    state = NEXT[state]
            if not opened and not goes_on:
                yield conv, None, None, *counts, spent, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), None
                return
            whole = "\n".join(lines).encode() if lines else None
            yield conv, part, 0, *counts, spent, audit, None, None if whole is None else whole[:CHUNK]
            for k, a in enumerate(range(CHUNK, len(whole or b""), CHUNK)):
                yield conv, part, k + 1, 0, 0, 0, 0, 0, "", None, whole[a : a + CHUNK]

        def flushed() -> pa.RecordBatch:
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)

        opened = True
        for (conv, rows), is_last in _ahead(_pieces(seen())):
            for row in of(conv, rows, opened and "left" in border, is_last and "right" in border):
                out.append(row)
                size += len(row[8]) + len(row[10] or b"")
            opened = False
            if size > CHUNK or len(out) >= 2000:
                yield flushed()
                out, size = [], 0
        if out:
            yield flushed()

    columns = ordered.select("conv_id", "n", "symbol", "initial", "blank", "duplicate", "truncated", "role", "text", "part")
    return columns.mapInArrow(released(work), RESULT)


def _ahead(items: Iterator) -> Iterator[tuple]:
    """Each item, and whether it is the last."""
    held = None
    for x in items:
        if held is not None:
            yield held, False
        held = x
    if held is not None:
        yield held, True


def _put_together(parts: DataFrame) -> DataFrame:
    """Conversations of several pieces: sums, audits in order, and the hash of the text as it streams by."""
    names = [x.split(" ")[0] for x in RESULT.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: list | None = None

        def done() -> pa.RecordBatch:
            conv, counts, audit, digest, _ = current
            values = [conv, None, None, *counts, "".join(audit), digest.hexdigest(), None]
            return pa.record_batch([pa.array([x], f.type) for x, f in zip(values, schema)], schema=schema)

        schema = None
        for batch in batches:
            schema = batch.schema
            for row in zip(*(batch.column(x).to_pylist() for x in names)):
                if current is None or current[0] != row[0]:
                    if current is not None:
                        yield done()
                    current = [row[0], [0] * 5, [], hashlib.sha256(), False]
                current[1] = [a + b for a, b in zip(current[1], row[3:8])]
                current[2].append(row[8])
                if row[10] is not None:
                    if current[4] and row[2] == 0:
                        current[3].update(b"\n")
                    current[3].update(row[10])
                    current[4] = True
        if current is not None:
            yield done()

    by = [F.col("conv_id").asc_nulls_first(), "piece", "at"]
    return parts.repartition("conv_id").sortWithinPartitions(*by).mapInArrow(released(work), RESULT)


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    ``rows`` holds conv_id, turn, role and text; other columns are ignored. A row's fate (dropped,
    emptied, stripped of its ends of sentences, repeated, made a user's) is set by a hash of conv_id
    and turn. Nulls in role and text read as one space, in conv_id and turn too where they are
    hashed; rows with a null conv_id are one conversation, null turns come first. Rows of one turn
    are ordered by role and text. A conversation of which all rows are dropped has zeros, an empty
    audit and the hash of the empty string; an empty table gives an empty result.

    Equal rows of a turn travel as one row with their number. No conversation has to fit in one
    task: it is cut by ranges, its pieces are joined by matrices of costs. Only the SHA-256 of a
    conversation that spans partitions is taken in one task, past which its text streams, since
    that hash is defined byte after byte; the audit is one string of the result.
    """
    known = stored(damaged(rows))
    ordered = _ordered(known)
    found = stored(_repaired(ordered, _borders(ordered)))
    whole = found.filter("piece is null").unionByName(_put_together(found.filter("piece is not null")))
    turns = known.groupBy("conv_id").agg(
        F.coalesce(F.max(F.when(F.col("n") > 0, F.col("turn"))) - F.min(F.when(F.col("n") > 0, F.col("turn"))) + 1 - F.count_distinct(F.when(F.col("n") > 0, F.col("turn"))), F.lit(0)).cast("long").alias("gaps")
    ).withColumnRenamed("conv_id", "c")
    return whole.join(turns, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
