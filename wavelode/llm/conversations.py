"""Repair of conversations' structure by the cheapest edits, decided by minima of big integers.

A path of edits is one integer: its high digits are the cost, its low digits the letters of the audit
from the left, one digit of three bits each in the letters' ASCII order, zeros after the last letter. Of
equal cost the least such integer is the ASCII-least audit, so an ordinary minimum per node of a layered
graph (rows of a conversation times what the role's pattern expects next) decides everything. Adding the
same end to two paths keeps their order: two paths to a node that cost the same are never one the start
of the other, as they have a letter for each of the same rows and every insertion more costs more.

A conversation may be longer than a task should hold, so it is worked out in parts: rows are range
partitioned, every part becomes a table of least integers from each state to each, and these compose.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kind_of, stored

#: Edits and their digits, in ASCII order: delete, insert, keep, rerole.
LETTERS = "DIKR"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
BITS = 3
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
#: States: nothing yet, after a system turn, after a user's, after an assistant's.
STATES = range(4)
ENDS = (0, 3)
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
#: Row faults as they are coded for the parts.
SOUND, TRUNCATED, DUPLICATE, BLANK = 0, 1, 2, 3
CHUNK = 128
#: Characters that aren't part of a word.
BLANKS = " \t\n\v\f\r"
FOLLOWING = ("su", "ua", "au")


def digits(letters: int, count: int, width: int) -> int:
    return letters << BITS * (width - count)


class Parts:
    """Least integers from state to state over some rows: {(from, to): (cost, count, letters)}, letters as
    `count` digits."""

    def __init__(self, least: dict[tuple[int, int], tuple[int, int, int]]):
        self.least = least

    @classmethod
    def of(cls, rows: list[tuple[str, int, int]]) -> Parts:
        """rows: (initial, fault, times). Of a row that stands `times` times only the first may be kept."""
        width = sum(n for _, _, n in rows) + 2 * (2 * len(rows) + 1)
        least = {}
        for start in STATES:
            at = {start: (0, 0)}
            for initial, fault, times in rows:
                at = cls.inserted(at, width)
                free, to = fault in (SOUND, TRUNCATED), {}
                for state, path in at.items():
                    cls.better(to, state, cls.edge(path, DELETE, width))
                    if free:
                        extra = int(fault == TRUNCATED)
                        if (state, initial) in KEPT:
                            cls.better(to, KEPT[state, initial], cls.edge(path, KEEP, width, extra))
                        cls.better(to, NEXT[state], cls.edge(path, REROLE, width, extra))
                at = to
                if times > 1:  # the rest is deleted; an insertion before a deletion is never less than one after
                    run = ((1 << BITS * (times - 1)) - 1) // ((1 << BITS) - 1) * DELETE
                    more = COST[DELETE] * (times - 1) << BITS * width
                    at = {s: (v + more + digits(run, k + times - 1, width), k + times - 1) for s, (v, k) in at.items()}
            for end, (value, count) in cls.inserted(at, width).items():
                low = value & ((1 << BITS * width) - 1)
                least[start, end] = (value >> BITS * width, count, low >> BITS * (width - count))
        return cls(least)

    @staticmethod
    def edge(path: tuple[int, int], letter: int, width: int, extra: int = 0) -> tuple[int, int]:
        value, count = path
        return value + (COST[letter] + extra << BITS * width) + digits(letter, count + 1, width), count + 1

    @staticmethod
    def better(at: dict[int, tuple[int, int]], state: int, path: tuple[int, int]) -> None:
        if state not in at or path < at[state]:
            at[state] = path

    @classmethod
    def inserted(cls, at: dict[int, tuple[int, int]], width: int) -> dict[int, tuple[int, int]]:
        """With no, one or two insertions; more come back to a state that was there for less."""
        out = dict(at)
        for _ in range(2):
            for state, path in list(out.items()):
                cls.better(out, NEXT[state], cls.edge(path, INSERT, width))
        return out

    def then(self, other: Parts) -> tuple[Parts, dict[tuple[int, int], int]]:
        """The two one after the other, and the state between them that each least path goes through."""
        width = max(k for _, k, _ in self.least.values()) + max(k for _, k, _ in other.least.values())
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        for (start, mid), (c1, k1, l1) in self.least.items():
            for end in STATES:
                if (mid, end) in other.least:
                    c2, k2, l2 = other.least[mid, end]
                    value = (c1 + c2 << BITS * width) + digits(l1, k1, width) + digits(l2, k1 + k2, width)
                    if (start, end) not in found or value < found[start, end][0]:
                        found[start, end] = (value, k1 + k2, mid)
        least, mids = {}, {}
        for key, (value, count, mid) in found.items():
            low = value & ((1 << BITS * width) - 1)
            least[key], mids[key] = (value >> BITS * width, count, low >> BITS * (width - count)), mid
        return Parts(least), mids


def spelled(count: int, letters: int) -> str:
    """Digits as letters."""
    return oct(letters)[2:].translate(str.maketrans("1234", LETTERS)) if count else ""


def numbered(audit: str) -> int:
    return int(audit.translate(str.maketrans(LETTERS, "1234")) or "0", 8)


def fault_of(text: Column, first: Column) -> Column:
    """A row's first fault: blank, duplicate, truncated or none."""
    some = F.rtrim(text, F.lit(BLANKS))
    ended = F.substring(some, -1, 1).isin(".", "!", "?")
    return F.when(some == "", BLANK).when(~first, DUPLICATE).when(~ended, TRUNCATED).otherwise(SOUND)


def arranged(rows: DataFrame) -> DataFrame:
    """(conv_id, part, place, turn, role, text, n, fault): rows in their order, equal ones once with their number.

    Order is by turn, nulls first, then role and text, so that equal rows stand side by side. place
    grows along a conversation and part is the range partition it lies in, so a very long conversation
    has many. The table is written.
    """
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    units = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = units.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("t")).agg(F.min(when).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("t"))
    units = units.join(firsts, same).withColumn("fault", fault_of(F.col("text"), when.eqNullSafe(F.col("first")))).drop("c", "r", "t", "first")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    line = units.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    return stored(line.withColumn("part", F.shiftright("place", 33)), "conversation-rows")


def _runs(batches: Iterator[pa.RecordBatch], key: tuple[str, ...], fields: tuple[str, ...]):
    """(key, row) of sorted batches, row by row."""
    for batch in batches:
        names = batch.schema.names
        columns = {name: batch.column(names.index(name)).to_pylist() for name in (*key, *fields)}
        yield from zip(zip(*[columns[k] for k in key], strict=True), zip(*[columns[f] for f in fields], strict=True), strict=True)


class _Part:
    """What a part's rows add up to, as they come."""

    def __init__(self):
        self.stack: list[tuple[int, Parts]] = []
        self.rows: list[tuple[str, int, int]] = []
        self.counts = [0, 0, 0, 0]
        self.illegal, self.turns = 0, 0
        self.first = self.last = self.turn0 = self.turn1 = None

    def add(self, turn, initial: str, fault: int, times: int) -> None:
        self.illegal += times - 1
        if self.first is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in FOLLOWING
        self.last = initial
        if turn is not None:
            self.turn0 = turn if self.turn0 is None else self.turn0
            self.turns += turn != self.turn1
            self.turn1 = turn
        self.counts[fault] += times if fault == BLANK else 1
        if fault != BLANK:
            self.counts[DUPLICATE] += times - 1
        self.rows.append((initial, fault, times))
        if len(self.rows) == CHUNK:
            self.chunk()

    def chunk(self) -> None:
        """Chunks join like carries of a counter, so that long parts are built from halves."""
        size, made = 1, Parts.of(self.rows)
        self.rows = []
        while self.stack and self.stack[-1][0] <= size:
            n, before = self.stack.pop()
            size, made = size + n, before.then(made)[0]
        self.stack.append((size, made))

    def whole(self) -> Parts:
        if self.rows:
            self.chunk()
        made = self.stack[-1][1]
        for _, before in reversed(self.stack[:-1]):
            made = before.then(made)[0]
        return made


PART = (
    "part long, first string, last string, turn0 long, turn1 long, turns long, blank long, duplicate long, truncated long, illegal long, "
    "ends array<int>, costs array<long>, audits array<string>"
)


PART_COLUMNS = ["conv_id", *[c.split()[0] for c in PART.split(", ")]]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def part_tables(rows: DataFrame) -> DataFrame:
    """A row for each (conv_id, part): counts, ends, and the least cost and audit from each state to each."""

    def work(batches):
        def row(key, p: _Part) -> tuple:
            least = sorted(p.whole().least.items())
            b = p.counts
            table = [4 * s + e for (s, e), _ in least], [c for _, (c, _, _) in least], [spelled(k, v) for _, (_, k, v) in least]
            return (*key, p.first, p.last, p.turn0, p.turn1, p.turns, b[BLANK], b[DUPLICATE], b[TRUNCATED], p.illegal, *table)

        names, schema, now, part, done = PART_COLUMNS, None, None, None, []
        for batch in batches:
            if schema is None:
                longs, text = pa.int64(), pa.string()
                kinds = [batch.schema.field("conv_id").type, longs, text, text, *[longs] * 7, pa.list_(pa.int32()), pa.list_(longs), pa.list_(text)]
                schema = pa.schema(list(zip(names, kinds, strict=True)))
            for key, (turn, initial, fault, n) in _runs(iter([batch]), ("conv_id", "part"), ("turn", "initial", "fault", "n")):
                if part is None or key != now:
                    if part is not None:
                        done.append(row(now, part))
                    now, part = key, _Part()
                part.add(turn, initial, fault, n)
            if done:
                yield _batch(done, schema)
                done = []
        if part is not None:
            yield _batch([row(now, part)], schema)

    narrow = rows.select("conv_id", "part", "place", F.col("turn").cast("long").alias("turn"), F.substring("role", 1, 1).alias("initial"), "fault", "n")
    sorted_ = narrow.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "place")
    return sorted_.mapInArrow(work, f"conv_id {kind_of(rows, 'conv_id')}, {PART}")


def audited(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(audits, pieces) of arranged() rows.

    audits: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. pieces: conv_id, part, state
    (at the part's start) and piece, the part's letters. A conversation's parts meet in one task: as many
    rows as it has parts, with its audit's letters for each pair of states.
    """

    def conversation(rows: list[dict]) -> tuple:
        tables = [Parts({(e // 4, e % 4): (c, len(a), numbered(a)) for e, c, a in zip(r["ends"], r["costs"], r["audits"], strict=True)}) for r in rows]
        whole, through = tables[0], []
        for t in tables[1:]:
            whole, mids = whole.then(t)
            through.append(mids)
        width = max(k for _, k, _ in whole.least.values())
        value = lambda c, k, low: (c << BITS * width) + digits(low, k, width)
        end = min((e for s, e in whole.least if s == 0 and e in ENDS), key=lambda e: value(*whole.least[0, e]))
        cost, count, letters = whole.least[0, end]
        states = [end]
        for mids in reversed(through):
            states.insert(0, mids[0, states[0]])
        starts = [0, *states[:-1]]
        pieces = [spelled(*t.least[start, stop][1:]) for start, stop, t in zip(starts, states, tables, strict=True)]
        illegal = sum(r["illegal"] for r in rows) + sum(a["last"] + b["first"] not in FOLLOWING for a, b in zip(rows, rows[1:], strict=False))
        known = [r for r in rows if r["turn0"] is not None]
        turns = sum(r["turns"] for r in known) - sum(a["turn1"] == b["turn0"] for a, b in zip(known, known[1:], strict=False))
        gaps = known[-1]["turn1"] - known[0]["turn0"] + 1 - turns if known else 0
        counts = [sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated")]
        return (rows[0]["conv_id"], gaps, *counts, illegal, cost, spelled(count, letters), [r["part"] for r in rows], starts, pieces)

    def work(batches):
        schema, rows = None, []
        for batch in batches:
            if schema is None:
                longs, text = pa.int64(), pa.string()
                kinds = [batch.schema.field("conv_id").type, *[longs] * 6, text, pa.list_(longs), pa.list_(pa.int32()), pa.list_(text)]
                schema = pa.schema(list(zip(["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "parts", "states", "pieces"], kinds, strict=True)))
            done = []
            for r in batch.to_pylist():
                if rows and rows[0]["conv_id"] != r["conv_id"]:
                    done.append(conversation(rows))
                    rows = []
                rows.append(r)
            if done:
                yield _batch(done, schema)
        if rows:
            yield _batch([conversation(rows)], schema)

    schema = (
        f"conv_id {kind_of(rows, 'conv_id')}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
        "parts array<long>, states array<int>, pieces array<string>"
    )
    parts = part_tables(rows).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    found = stored(parts.mapInArrow(work, schema), "conversation-audits")
    pieces = found.select("conv_id", F.explode(F.arrays_zip("parts", "states", "pieces")).alias("p"))
    return found.drop("parts", "states", "pieces"), pieces.select("conv_id", F.col("p.parts").alias("part"), F.col("p.states").alias("state"), F.col("p.pieces").alias("piece"))


def repaired(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """(conv_id, part, seq, edit, turn, role, text): the conversations as edited, in the order of part and seq.

    Inserted turns have edit I, an empty text and no turn. A part's letters come first in its stream of rows.
    """
    kinds = dict(rows.dtypes)

    def work(batches):
        key0, letters, at, state, seq, schema = None, "", 0, 0, 0, None
        out: list[tuple] = []

        def inserts():
            nonlocal at, state, seq
            while letters[at : at + 1] == "I":
                state = NEXT[state]
                out.append((*key0, seq, "I", None, ROLE[state], ""))
                at, seq = at + 1, seq + 1

        for batch in batches:
            if schema is None:
                f = batch.schema.field
                names = ["conv_id", "part", "seq", "edit", "turn", "role", "text"]
                schema = pa.schema(list(zip(names, [f("conv_id").type, pa.int64(), pa.int64(), pa.string(), f("turn").type, pa.string(), pa.string()], strict=True)))
            for key, (place, turn, role, text, n, start, piece) in _runs(iter([batch]), ("conv_id", "part"), ("place", "turn", "role", "text", "n", "state", "piece")):
                if place < 0:
                    if key0 is not None:
                        inserts()
                    key0, letters, at, state, seq = key, piece, 0, start, 0
                    continue
                for time in range(n):
                    inserts()
                    edit = letters[at]
                    at += 1
                    if edit == "D":
                        continue
                    state = KEPT[state, role[:1]] if edit == "K" else NEXT[state]
                    out.append((*key, seq, edit, turn, role if edit == "K" else ROLE[state], text))
                    seq += 1
            if len(out) > 10_000:
                yield _batch(out, schema)
                out = []
        if key0 is not None:
            inserts()
        if out:
            yield _batch(out, schema)

    heads = pieces.select("conv_id", "part", F.lit(-1).cast("long").alias("place"), F.lit(None).cast(kinds["turn"]).alias("turn"), F.lit(None).cast("string").alias("role"),
                          F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n"), "state", "piece")
    body = rows.select("conv_id", "part", "place", "turn", "role", "text", "n", F.lit(0).alias("state"), F.lit("").alias("piece"))
    line = heads.unionByName(body).repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "place")
    return line.mapInArrow(work, f"conv_id {kinds['conv_id']}, part long, seq long, edit string, turn {kinds['turn']}, role string, text string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(audits, conversations) of rows (conv_id, turn, role, text; other columns are ignored).

    audits has a row per conversation: gaps in its turns, rows with each first fault, illegal successions,
    the least cost and the audit; conversations has the edited rows, see repaired(). A null role or text
    counts as one space, a null conv_id as a conversation of its own; null turns come first. Rows
    of one turn are taken by role and text; repeated rows are duplicates after the first. A role that
    begins with anything but s, u or a (or is empty) can't be kept. An empty table gives empty results.
    """
    rows = arranged(rows)
    audits, pieces = audited(rows)
    return audits, repaired(rows, pieces)


def text_hashes(conversations: DataFrame) -> DataFrame:
    """(conv_id, sha256): lowercase hex of `role:text` of a conversation's rows, joined by newlines.

    The hash is sequential, so a conversation's rows pass through one task, but as a stream.
    """

    def work(batches):
        now, state, schema = (), None, None
        done: list[tuple] = []
        for batch in batches:
            if schema is None:
                schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("sha256", pa.string())])
            for key, (role, text) in _runs(iter([batch]), ("conv_id",), ("role", "text")):
                line = f"{role}:{text}".encode()
                if key != now:
                    if state is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256(line)
                else:
                    state.update(b"\n" + line)
            if done:
                yield _batch(done, schema)
                done = []
        if state is not None:
            yield _batch([(*now, state.hexdigest())], schema)

    line = conversations.select("conv_id", "part", "seq", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return line.mapInArrow(work, f"conv_id {kind_of(conversations, 'conv_id')}, sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults by crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text,
    2 takes `.!?` out of it, 3 repeats it, 4 makes it a user's. Nulls count as one space, but for turn and conv_id
    themselves, which stay null."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("d"))
    role = F.when(F.col("d") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("d") == 3, 2).otherwise(1)))
    return rows.where("d <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("t")).drop("t")


def audit_digests(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each different conv_id of ids: what repair() says of it in rows, and the hash of its repaired text;
    a conversation without rows has zeros, an empty audit and the hash of the empty text."""
    audits, conversations = repair(rows)
    every = ids.select("conv_id").distinct()
    joined = every.join(audits.withColumnRenamed("conv_id", "a"), F.col("conv_id").eqNullSafe(F.col("a")), "left").drop("a")
    hashes = text_hashes(conversations).withColumnRenamed("conv_id", "h")
    joined = joined.join(hashes, F.col("conv_id").eqNullSafe(F.col("h")), "left")
    longs = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return joined.select("conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", empty).alias("repaired_sha256"))
