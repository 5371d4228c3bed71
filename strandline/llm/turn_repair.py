"""Repair of the turns of conversations: the cheapest edits that make their roles an optional system turn and then pairs
of user and assistant.

Edits: Keep a row (0), Rerole it to user or assistant (1), Delete it (2; blank and duplicate rows must go), Insert a user or
assistant turn with an empty text anywhere (5); a truncated row that stays costs 5 more. The audit is the initials of the
edits in order; of the cheapest ones, that which comes first in ASCII.

The method is weighted determinisation, done lazily. A nondeterministic automaton has four states: nothing said, after
the system turn, after a user turn, after an assistant turn. For the rows behind a place, the cheapest cost to finish
from each of these four is a vector; less its minimum it is one of few, and each that occurs becomes a state of the
deterministic automaton. A transition table (state, kind of row) -> (state, cost taken off) is filled as pairs occur, so
the scan of a conversation, from its last row to its first, is a lookup for each row, and sums up the cost. The trace runs
against the scan, from the first row to the last: an arc is tight if its cost and the vector behind it make up the vector
before it, and of the tight arcs that with the least letter is taken; it too is kept by (state, kind, place).

Spread: the rows are range partitioned by (conv_id, turn, role, text), so a long conversation lies in several partitions,
in order. Inside a partition each conversation is a segment. Only the first and the last segment can go on in another
partition: for these a small job brings the matrix of costs (4 x 4) and, when the vector behind each is known, the place
where a trace that begins at each of the four ends; the driver links them up (two rows of 16 numbers for each partition).
Then each partition traces its own segments. A segment, at most a partition, is held by its task. The digest of a
conversation is a chain over its repaired texts and its audit is one string, so these meet in one task, which holds no more
than the audit and one piece of text.

Rows: by turn (null first), role, text. A null (conv_id, turn, role, text) counts as one space in damage(); repair() takes
a null role or text as a space too, and conv_id null as a conversation. A turn that is null has no part in gaps. Role
initials are the first code point of the role; a role with another initial than s, u or a can be reroled or deleted, an
empty role likewise. Rows that are equal in all four columns are a run, of which all but the first are duplicates. A text of
any length is kept whole. An empty table gives no row. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_join, lean, sieved

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: 0 nothing said, 1 after system, 2 after user, 3 after assistant.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLES = {"u": "user", "a": "assistant"}
ACCEPTING = (0, 3)
STATES = range(4)
FAR = 1 << 40
#: Kinds of rows: 0 must go, else 1 + the initial's place in INITIALS * 2 + 1 if truncated.
INITIALS = "sua?"
SPACE = " \t\n\x0b\x0c\r"
PIECE = 1 << 20


class Automaton:
    """The deterministic automaton, as far as rows have asked for it."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.table: dict[tuple[int, int], tuple[int, int]] = {}
        self.arcs: dict[tuple[int, int, int], tuple[str, int, int, str | None]] = {}
        self.end, self.end_cost = self.state(self.closed([0 if q in ACCEPTING else FAR for q in STATES]))

    def state(self, vector: list[int]) -> tuple[int, int]:
        """The number of a vector less its minimum, and the minimum."""
        low = min(vector)
        key = tuple(min(x - low, FAR) for x in vector)
        if key not in self.numbers:
            self.numbers[key] = len(self.vectors)
            self.vectors.append(key)
        return self.numbers[key], low

    @staticmethod
    def closed(vector: list[int]) -> list[int]:
        """Costs when turns may be inserted first."""
        for _ in STATES:
            for (q, r), to in MOVES.items():
                if r in ROLES:
                    vector[q] = min(vector[q], INSERT + vector[to])
        return vector

    @staticmethod
    def edits(kind: int, q: int) -> list[tuple[str, int, int, str | None]]:
        """What can be done to a row at q, by letter: (letter, cost, state behind, role if it stays; '' is its own)."""
        out: list[tuple[str, int, int, str | None]] = [("D", DELETE, q, None)]
        if kind:
            initial, more = INITIALS[(kind - 1) // 2], TRUNCATED * ((kind - 1) % 2)
            if (q, initial) in MOVES:
                out.append(("K", more, MOVES[q, initial], ""))
            out += [("R", REROLE + more, MOVES[q, r], name) for r, name in ROLES.items() if (q, r) in MOVES]
        return out

    def before(self, state: int, kind: int) -> list[int]:
        """The vector before a row of a kind, from that behind it."""
        behind = self.vectors[state]
        return self.closed([min(c + behind[to] for _, c, to, _ in self.edits(kind, q)) for q in STATES])

    def step(self, state: int, kind: int) -> tuple[int, int]:
        if (found := self.table.get((state, kind))) is None:
            found = self.table[state, kind] = self.state(self.before(state, kind))
        return found

    def arc(self, state: int, kind: int, q: int) -> tuple[str, int, int, str | None]:
        """The trace over a row from q, with the insertions before it: letters, cost, state behind, role if it stays.
        kind -1: the end, with the insertions that are still needed."""
        if (found := self.arcs.get((state, kind, q))) is None:
            letters, cost, at = "", 0, q
            here = self.vectors[state] if kind < 0 else self.before(state, kind)
            while True:
                tight = [] if kind < 0 else [x for x in self.edits(kind, at) if x[1] + self.vectors[state][x[2]] == here[at]]
                if kind < 0 and at in ACCEPTING:
                    found = letters, cost, at, None
                    break
                more = [to for (p, r), to in MOVES.items() if p == at and r in ROLES and INSERT + here[to] == here[at]]
                if tight and (tight[0][0] < "I" or not more):
                    found = letters + tight[0][0], cost + tight[0][1], tight[0][2], tight[0][3]
                    break
                letters, cost, at = letters + "I", cost + INSERT, more[0]
            self.arcs[state, kind, q] = found
        return found

    def scan(self, runs: list[tuple[int, int]], state: int) -> tuple[list[int], int]:
        """States behind each run (kind, how many rows), and before the first; the cost taken off."""
        out, total = [0] * (len(runs) + 1), 0
        out[-1] = state
        for k in range(len(runs) - 1, -1, -1):
            kind, n = runs[k]
            if kind:
                state, off = self.step(state, kind)
            else:  # a row that must go leaves the vector as it is
                off = DELETE * n
            total += off
            out[k] = state
        return out, total

    def matrix(self, runs: list[tuple[int, int]]) -> list[list[int]]:
        """Cheapest costs over the runs from each state to each."""
        out = [[FAR] * 4 for _ in STATES]
        for to in STATES:
            state, low = self.state([0 if q == to else FAR for q in STATES])
            states, cost = self.scan(runs, state)
            for q in STATES:
                out[q][to] = min(FAR, self.vectors[states[0]][q] + cost + low)
        return out

    def exits(self, runs: list[tuple[int, int]], state: int) -> list[int]:
        """Where a trace that begins at each state ends (0 for those that no trace reaches)."""
        states, _ = self.scan(runs, state)
        out = []
        for q in STATES:
            if self.vectors[states[0]][q] < FAR:
                for k, (kind, _) in enumerate(runs):
                    if kind:
                        q = self.arc(states[k + 1], kind, q)[2]
            out.append(q)
        return out


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults by crc32('conv_id:turn') % 20: 0 drops a row, 1 empties its text, 2 takes its
    .!? away, 3 repeats it, 4 makes it a user's. A null is one space."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), told("role").alias("role"), told("text").alias("text"), fault.alias("_f")).filter("_f <> 0")
    text = F.when(F.col("_f") == 1, "").when(F.col("_f") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_f") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return t.select("conv_id", "turn", F.when(F.col("_f") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_c")).drop("_c")


def _kind(role: Column, text: Column) -> Column:
    last = F.rtrim(text, F.lit(SPACE))
    at = F.position(F.substring(role, 1, 1), F.lit(INITIALS[:-1]))
    initial = F.when((F.length(role) == 0) | (at == 0), len(INITIALS)).otherwise(at)
    whole = F.right(last, F.lit(1)).isin(".", "!", "?")
    return F.when(F.length(last) == 0, 0).otherwise(initial * 2 - 1 + (~whole).cast("int")).cast("int")


def _nulls_first(turn: str) -> Column:
    return F.struct(F.col(turn).isNotNull().alias("given"), F.col(turn).alias("turn"))


def ordered(rows: DataFrame) -> DataFrame:
    """The rows in order, a run of equal ones as one row: conv_id, turn, role, text, kind, first (no earlier row has the
    role and text), m (rows in the run). Only rows that repeat are shuffled to find out who is first."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    t = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), told("role").alias("role"), told("text").alias("text"))
    key = F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    t = t.withColumn("kind", _kind(F.col("role"), F.col("text"))).withColumn("key", key).withColumn("h", F.xxhash64("key"))
    again = cut(t.groupBy("key", "h").agg(F.count(F.lit(1)).alias("n"), F.min(_nulls_first("turn")).alias("lead")).filter("n > 1"))
    alone, rest = sieved(t, again.select("h").distinct(), "h")
    runs = rest.groupBy("key", "turn").agg(F.first("conv_id").alias("conv_id"), F.first("role").alias("role"), F.first("text").alias("text"), F.first("kind").alias("kind"), F.count(F.lit(1)).alias("m"))
    runs = hot_join(runs, again.select("key", "lead"), ["key"], again.select("key", "n"), "left")
    kept = ["conv_id", "turn", "role", "text", "kind"]
    runs = runs.select(*kept, (F.col("lead").isNull() | (F.col("lead") == _nulls_first("turn"))).alias("first"), "m")
    both = alone.select(*kept, F.lit(True).alias("first"), F.lit(1).cast("long").alias("m")).unionByName(runs)
    # ranges by the head of the text only, as their bounds come from a sample on the driver; the full order agrees with it
    ranges = both.repartitionByRange(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.substring("role", 1, 32), F.substring("text", 1, 32))
    return ranges.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, bool, int | None, list[tuple]]]:
    """(is the partition's first, its last, conv_id, rows) of each conversation of a partition, in order."""
    def runs() -> Iterator[tuple[int | None, list[tuple]]]:
        conv, held = None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and row[0] != conv:
                    yield conv, held
                    held = []
                conv = row[0]
                held.append(row)
        if held:
            yield conv, held

    first, before = True, None
    for s in runs():
        if before is not None:
            yield first, False, *before
            first = False
        before = s
    if before is not None:
        yield first, True, *before


def _runs(rows: list[tuple], kind: int, first: int, m: int) -> list[tuple[int, int]]:
    """Runs of kinds: of equal rows the first may stay."""
    out: list[tuple[int, int]] = []
    for r in rows:
        if not r[kind] or not r[first]:
            out.append((0, r[m]))
        else:
            out.append((r[kind], 1))
            if r[m] > 1:
                out.append((0, r[m] - 1))
    return out


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the first and the last conversation of each partition: partition, last, conv_id, matrix."""
    dfa, part = Automaton(), TaskContext.get().partitionId()
    for first, last, conv, rows in _segments(batches):
        if first or last:
            flat = [x for line in dfa.matrix(_runs(rows, 1, 2, 3)) for x in line]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([last]), pa.array([conv], pa.int64()), pa.array([flat], pa.list_(pa.int64()))], ["part", "last", "conv_id", "matrix"])


def _exits(behind: dict[tuple[int, bool], tuple[list[int], bool]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dfa, part = Automaton(), TaskContext.get().partitionId()
        for first, last, conv, rows in _segments(batches):
            if (first or last) and (part, last) in behind:
                state, _ = dfa.state(list(behind[part, last][0]))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([last]), pa.array([dfa.exits(_runs(rows, 1, 2, 3), state)], pa.list_(pa.int64()))], ["part", "last", "exits"])

    return run


TRACED = "conv_id long, part int, piece int, audit string, text string, stays boolean, cost long, blank long, duplicate long, truncated long, illegal long, lo long, hi long, turns long, first_turn long, last_turn long, first_initial string, last_initial string"
_ARROW = [("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int32()), ("audit", pa.string()), ("text", pa.string()), ("stays", pa.bool_()), *((c, pa.int64()) for c in ("cost", "blank", "duplicate", "truncated", "illegal", "lo", "hi", "turns", "first_turn", "last_turn")), ("first_initial", pa.string()), ("last_initial", pa.string())]
_LEGAL = ("su", "ua", "au")


def _trace(places: dict[tuple[int, bool], tuple[list[int], int, bool]], most: int):
    """Each segment's audit, figures and repaired lines, in pieces of about `most` code points of text."""
    schema = pa.schema(_ARROW)

    def pieces(dfa: Automaton, part: int, conv: int | None, rows: list[tuple], state: int, q: int, ends: bool) -> Iterator[tuple]:
        runs = _runs(rows, 4, 5, 6)
        states, _ = dfa.scan(runs, state)
        tally = [0, 0, 0, 0, 0]  # cost, blank, duplicate, truncated, illegal
        letters: list[str] = []
        lines: list[str] = []
        size, k, told, initials = 0, 0, 0, None
        turns = [r[1] for r in rows if r[1] is not None]
        fixed = [min(turns, default=None), max(turns, default=None), len(set(turns)), rows[0][1], rows[-1][1], rows[0][2][:1], rows[-1][2][:1]]
        for r in rows:
            _, _, role, text, kind, first, m = r
            mine = role[:1]
            tally[4] += (initials is not None and initials + mine not in _LEGAL) + (m - 1) * (mine + mine not in _LEGAL)
            initials = mine
            stays = bool(kind) and first
            tally[1] += 0 if kind else m
            tally[2] += (m - stays) if kind else 0
            tally[3] += int(stays and not kind % 2)
            for kind_, n in runs[k : k + 1 + (stays and m > 1)]:
                k += 1
                if not kind_:
                    letters.append("D" * n)
                    tally[0] += DELETE * n
                    continue
                told, cost, to, named = dfa.arc(states[k], kind_, q)
                tally[0] += cost
                letters.append(told)
                for c in told[:-1]:
                    r_, q = next((r_, to_) for (p, r_), to_ in MOVES.items() if p == q and r_ in ROLES)
                    lines.append(f"{ROLES[r_]}:")
                if named is not None:
                    lines.append(f"{named or role}:{text}")
                    size += len(lines[-1])
                q = to
            if size >= most:
                yield "".join(letters), "\n".join(lines), True, *tally, *fixed
                letters, lines, size, tally, fixed = [], [], 0, [0] * 5, [None, None, 0, None, None, None, None]
        if ends:
            told, cost, _, _ = dfa.arc(dfa.end, -1, q)
            tally[0] += cost
            letters.append(told)
            for _ in told:
                r_, q = next((r_, to_) for (p, r_), to_ in MOVES.items() if p == q and r_ in ROLES)
                lines.append(f"{ROLES[r_]}:")
        yield "".join(letters), "\n".join(lines), bool(lines), *tally, *fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dfa, part = Automaton(), TaskContext.get().partitionId()
        out, size = [], 0
        for first, last, conv, rows in _segments(batches):
            behind, q, ends = places[part, last] if (first or last) and (part, last) in places else (None, 0, True)
            state = dfa.end if behind is None else dfa.state(list(behind))[0]
            for k, p in enumerate(pieces(dfa, part, conv, rows, state, q, ends)):
                out.append((conv, part, k, *p))
                size += len(p[1])
                if size >= most or len(out) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=schema)

    return run


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_TOLD = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation from its pieces, which come in order; no text is held beyond its piece."""
    names = [x.split()[0] for x in _TOLD.split(", ")]
    types = [pa.int64()] * 7 + [pa.string()] * 2
    out: list[tuple] = []

    def told(s: dict) -> tuple:
        gaps = 0 if s["lo"] is None else s["hi"] - s["lo"] + 1 - s["turns"]
        return s["conv"], gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], s["cost"], "".join(s["audit"]), s["sha"].hexdigest()

    s = None
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            conv, _, piece, audit, text, stays, cost, blank, duplicate, truncated, illegal, lo, hi, turns, first_turn, last_turn, first_initial, last_initial = r
            if s is not None and conv != s["conv"]:
                out.append(told(s))
                s = None
            if s is None:
                s = {"conv": conv, "audit": [], "sha": hashlib.sha256(), "any": False, "lo": None, "hi": None, "turns": 0, "last": None, "initial": None, "cost": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
            for k, v in (("cost", cost), ("blank", blank), ("duplicate", duplicate), ("truncated", truncated), ("illegal", illegal), ("turns", turns)):
                s[k] += v
            if piece == 0:  # a segment begins
                s["turns"] -= first_turn is not None and first_turn == s["last"]
                s["illegal"] += s["initial"] is not None and s["initial"] + first_initial not in _LEGAL
                s["last"], s["initial"] = last_turn, last_initial
                if lo is not None:
                    s["lo"], s["hi"] = min(lo, s["lo"] if s["lo"] is not None else lo), max(hi, s["hi"] if s["hi"] is not None else hi)
            s["audit"].append(audit)
            if stays:
                s["sha"].update(("\n" if s["any"] else "").encode() + text.encode())
                s["any"] = True
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out = []
    if s is not None:
        out.append(told(s))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def _link(rows: DataFrame) -> dict[tuple[int, bool], tuple[list[int], int, bool]]:
    """(partition, is its last conversation) -> (vector behind, state before, is it the conversation's end), for the
    conversations that can lie in more than one partition."""
    narrow = rows.select("conv_id", "kind", "first", "m")
    ends = sorted(narrow.mapInArrow(_matrices, "part int, last boolean, conv_id long, matrix array<bigint>").collect(), key=lambda r: (r.part, r.last))
    final = Automaton.closed([0 if q in ACCEPTING else FAR for q in STATES])
    behind: dict[tuple[int, bool], tuple[list[int], bool]] = {}
    after = None
    for r in reversed(ends):
        own = after is None or after.conv_id != r.conv_id
        vector = final if own else [min(after.matrix[4 * q + to] + behind[after.part, after.last][0][to] for to in STATES) for q in STATES]
        behind[r.part, r.last] = vector, own
        after = r
    crossing = {(r.part, r.last): behind[r.part, r.last] for a, r, b in zip([None, *ends], ends, [*ends[1:], None]) if (a and a.conv_id == r.conv_id) or (b and b.conv_id == r.conv_id)}
    if not crossing:
        return {}
    out: dict[tuple[int, bool], tuple[list[int], int, bool]] = {}
    exits = {(r.part, r.last): r.exits for r in narrow.mapInArrow(_exits(crossing), "part int, last boolean, exits array<bigint>").collect()}
    q, conv, begun = 0, None, False
    for r in ends:
        if (r.part, r.last) in crossing:
            if not begun or conv != r.conv_id:
                q = 0
            vector, own = crossing[r.part, r.last]
            out[r.part, r.last] = vector, q, own
            q, conv, begun = exits[r.part, r.last][q], r.conv_id, True
    return out


def repair(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """By conversation: gaps, blank, duplicate, truncated, illegal (adjacent role initials not su, ua or au), cost, audit,
    repaired_sha256 (of the repaired role:text, joined by line feeds)."""
    lean(rows.sparkSession)
    return chained(traced(rows, piece))


def traced(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """The repaired conversations in pieces: conv_id, part, piece (their order), audit, text (lines role:text), stays (is
    there a line), and the figures of the piece."""
    held = cut(ordered(rows))
    return cut(held.mapInArrow(_trace(_link(held), piece), TRACED))


def chained(pieces: DataFrame) -> DataFrame:
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").mapInArrow(_chain, _TOLD)


def reported(turns: DataFrame, rows: DataFrame) -> DataFrame:
    """repair(rows) for every conv_id of turns; those without rows have zeros, an empty audit and the digest of nothing."""
    all_of = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = repair(rows).alias("f")
    joined = all_of.alias("a").join(found, F.col("a.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return joined.select("a.conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in FIGURES], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", none).alias("repaired_sha256"))
