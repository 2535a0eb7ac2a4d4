"""Repair of a conversation's turn structure by iterative-deepening A*.

Each row of a conversation has at most one fault: it is *blank*, a *duplicate*
of an earlier row (same role and text), or *truncated* (its last visible
character ends no sentence). Edits turn the rows into an optional system turn and
pairs of user and assistant: keep a row (cost 0), give it the role that fits (2),
delete it (3; the only way for blank and duplicate rows), or insert an empty
turn (2). A truncated row that stays costs 1 more. The cheapest edits are wanted,
and of these the ASCII-least string of initials (D, I, K, R).

``search`` finds them by depth-first search in ASCII order under a cost bound that
is raised to the least cost that a failed search asked for. A table holds, for
each (row, role state) that failed, what it needs at least; no state is entered
again with less. The first path accepted is the answer.

Conversations of any length: rows are range-partitioned in order, so a hot
conversation spreads over partitions, and searched in blocks of ``BLOCK`` rows of
that order. Where a conversation crosses a block's edge, its pieces are first
measured (least cost between any two states), chained backwards (one small row per
piece), and every piece is then searched with the costs that remain behind it,
once for each state it may be entered in. No edits of a piece are a prefix of
others (inserts belong before a row), so the pieces' least strings make the
whole's least string. Only the digest of the repaired text follows the whole
conversation in order, as a digest must, with running state.

Rows of equal turn are taken by role and text, null turns first. Null roles and
texts are one space, as is a null id or turn in the damage key; a null
conversation id is a conversation. Equal rows of one turn are counted, not
repeated. Other columns are not read. Ids and turns are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

# rows of the total order that are searched together; divides 2^33, the places of a partition
BLOCK = 4096
# characters of a text that range partitioning may cut by
CUT_CHARS = 32
FLUSH_ROWS = 2048

VISIBLE, ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"

# role states: nothing yet, after system, after user, after assistant
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
# what a kept initial leads to, and where the role that always fits leads to
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FITS = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
# fixed values: the price of each edit
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
# edits behind the last row
TAIL = ("", "II", "I", "")
END = tuple(INSERT * len(t) for t in TAIL)

# a row as the search sees it: initial of its role, must it go, is it truncated, further copies that must go
Item = tuple[str, bool, bool, int]


def edits_of(item: Item, state: int) -> list[tuple[str, int, int, int]]:
    """``(initial, cost, rows consumed, next state)`` in ASCII order."""
    initial, gone, cut, copies = item
    more = DELETE * copies
    out = [("D", DELETE + more, 1, state), ("I", INSERT, 0, FITS[state])]
    if not gone:
        if (state, initial) in KEEPS:
            out.append(("K", CUT_OFF * cut + more, 1, KEEPS[state, initial]))
        out.append(("R", REROLE + CUT_OFF * cut + more, 1, FITS[state]))
    return out


def search(items: list[Item], entry: int, exits: tuple[int | None, ...]) -> tuple[str, int, int] | None:
    """``(edits, exit state, cost with exits)``: cheapest, then ASCII-least; ``exits`` are the costs behind each state (None: closed)."""
    n = len(items)
    reached = {entry} | ({USER, ASSISTANT} if n else set())
    if entry == START and any(initial == "s" and not gone for initial, gone, _, _ in items):
        reached.add(SYSTEM)
    if all(exits[s] is None for s in reached):
        return None
    last = [1 << 60 if e is None else e for e in exits]
    least = min(last)
    # what a state needs at least: forced costs of the rows ahead, raised by every failure
    need = [[0] * 4 for _ in range(n)] + [last]
    ahead = least
    for i in range(n - 1, -1, -1):
        _, gone, cut, copies = items[i]
        ahead += DELETE * copies + (DELETE if gone else CUT_OFF * cut)
        need[i] = [ahead] * 4
    while True:
        bound = need[0][entry]
        # frames: row, state, budget, edits, next edit, least need seen
        frames = [[0, entry, bound, edits_of(items[0], entry) if n else (), 0, 1 << 61]]
        while frames:
            frame = frames[-1]
            i, state, left, edits, k, seen = frame
            if i == n:
                letters = []
                for f in frames[:-1]:
                    letter = f[3][f[4] - 1][0]
                    letters.append(letter + "D" * items[f[0]][3] if letter != "I" else letter)
                return "".join(letters), state, bound
            if k == len(edits):
                need[i][state] = max(need[i][state], seen)
                frames.pop()
                if frames:
                    up = frames[-1]
                    up[5] = min(up[5], up[3][up[4] - 1][1] + seen)
                continue
            frame[4] = k + 1
            _, cost, step, state_next = edits[k]
            wants = need[i + step][state_next]
            if wants > left - cost:
                frame[5] = min(seen, cost + wants)
            else:
                j = i + step
                frames.append([j, state_next, left - cost, edits_of(items[j], state_next) if j < n else (), 0, 1 << 61])


def damage(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, n)`` after the planted damage; ``n`` counts equal rows, 0 where all were dropped."""
    space = F.lit(" ")

    def told(name: str):
        return F.coalesce(F.col(name).cast("string"), space)

    key = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    role, text = told("role"), told("text")
    made = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(key == 4, "user").otherwise(role).alias("role"),
        F.when(key == 1, "").when(key == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(key == 0, 0).when(key == 3, 2).otherwise(1).alias("n"),
    )
    return made.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Counted rows with ``fault`` of their first copy (B, D, T or empty); further copies are duplicates, or blank if blank."""
    place = F.struct(F.col("turn").isNotNull().alias("told"), F.col("turn").alias("turn"))
    firsts = rows.filter("n > 0").groupBy("conv_id", "role", "text").agg(F.min(place).alias("first"))
    firsts = firsts.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("text").alias("_t"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("text") == F.col("_t"))
    fault = (
        F.when(~F.col("text").rlike(VISIBLE), "B").when(~place.eqNullSafe(F.col("first")), "D").when(~F.col("text").rlike(ENDED), "T").otherwise("")
    )
    return rows.join(firsts, same, "left").select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))


def in_order(rows: DataFrame) -> DataFrame:
    """Written in the order of conversations, turns, roles and texts; ``at`` numbers the rows in that order."""
    cut = [F.col("conv_id"), F.col("turn"), F.col("role"), F.substring("text", 1, CUT_CHARS)]
    ordered = rows.repartitionByRange(*cut).sortWithinPartitions("conv_id", "turn", "role", "text")
    return materialise(ordered.withColumn("at", F.monotonically_increasing_id()), "turns")


def _item(initial: str, fault: str, n: int) -> Item:
    gone = fault in ("B", "D")
    return initial, gone, fault == "T", n - 1


class _Pieces:
    """Pieces of conversations in a stream of ordered rows of blocks."""

    def __init__(self) -> None:
        self.key = None
        self.items: list[Item] = []
        self.at = 0
        self.opens = False

    def push(self, block: int, conv: int | None, at: int, initial: str, fault: str, n: int) -> tuple | None:
        """A finished piece ``(conv, at, items, at the block's start, at its end)``, if this row begins another."""
        done = None
        if self.key != (block, conv):
            new_block = self.key is None or self.key[0] != block
            done = self.take(new_block)
            self.key, self.at, self.opens = (block, conv), at, new_block
        if n:
            self.items.append(_item(initial, fault, n))
        return done

    def take(self, closes: bool) -> tuple | None:
        done = None if self.key is None else (self.key[1], self.at, self.items, self.opens, closes)
        self.items = []
        return done


_MEASURED = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("at", T.LongType()), T.StructField("costs", T.ArrayType(T.LongType()))])
_CHAINED = T.StructType([*_MEASURED.fields[:2], T.StructField("exits", T.ArrayType(T.LongType())), T.StructField("first", T.BooleanType()), T.StructField("last", T.BooleanType())])
_FOUND = T.StructType([*_MEASURED.fields[:2], T.StructField("edits", T.ArrayType(T.StringType())), T.StructField("leads", T.ArrayType(T.LongType()))])


def _batch(rows: list[tuple], kind: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(kind)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], names=schema.names)


def _streamed(kind: T.StructType, make) -> object:
    """A ``mapInArrow`` function from ``make() -> (per row, at the end)``, both giving lists of output rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, end = make()
        out: list[tuple] = []
        for batch in batches:
            for values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                out += row(*values)
                if len(out) >= FLUSH_ROWS:
                    yield _batch(out, kind)
                    out = []
        out += end()
        if out:
            yield _batch(out, kind)

    return run


def _measure():
    """Least costs between states of the pieces that touch an edge of their block."""
    pieces = _Pieces()

    def told(piece: tuple | None) -> list[tuple]:
        if piece is None or not (piece[3] or piece[4]):
            return []
        conv, at, items, _, _ = piece
        costs: list[int | None] = []
        for entry in STATES:
            for exit_ in STATES:
                found = search(items, entry, tuple(0 if s == exit_ else None for s in STATES))
                costs.append(None if found is None else found[2])
        return [(conv, at, costs)]

    return lambda *row: told(pieces.push(*row)), lambda: told(pieces.take(True))


def _chain():
    """Costs behind each piece, from a conversation's last piece to its first."""
    held: dict = {"conv": None, "piece": None, "behind": END}

    def flush(first: bool) -> list[tuple]:
        if held["piece"] is None:
            return []
        at, behind, last = held["piece"]
        return [(held["conv"], at, list(behind), first, last)]

    def row(conv, at, costs):
        new = held["piece"] is None or conv != held["conv"]
        out = flush(new)
        behind = END if new else held["behind"]
        held.update(conv=conv, piece=(at, behind, new))
        held["behind"] = tuple(min(c + b for c, b in zip(costs[4 * q : 4 * q + 4], behind, strict=True) if c is not None) for q in STATES)
        return out

    return row, lambda: flush(True)


def _find():
    """Edits of every piece, for each state it may be entered in. Rows with ``exits`` stand before the piece they tell of."""
    pieces, known = _Pieces(), {}

    def told(piece: tuple | None) -> list[tuple]:
        if piece is None:
            return []
        conv, at, items, _, _ = piece
        exits, first, last = known.pop(at, (END, True, True))
        edits, leads = [], []
        for entry in (START,) if first else STATES:
            found, state, _ = search(items, entry, tuple(exits))
            edits.append(found + (TAIL[state] if last else ""))
            leads.append(state)
        return [(conv, at, edits, leads)]

    def row(block, conv, at, initial, fault, n, exits, first, last):
        if exits is not None:
            known[at] = (exits, first, last)
            return []
        return told(pieces.push(block, conv, at, initial, fault, n))

    return row, lambda: told(pieces.take(True))


REPORT = T.StructType(
    [T.StructField("conv_id", T.LongType())]
    + [T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]
)


class _Report:
    """One conversation, row after row: running counts, digest and edits."""

    def __init__(self, conv: int | None):
        self.conv = conv
        self.count = {"B": 0, "D": 0, "T": 0, "": 0}
        self.illegal = self.cost = self.turns = 0
        self.low = self.high = self.turn = self.before = None
        self.state, self.audit, self.digest, self.empty = START, [], hashlib.sha256(), True
        self.edits, self.next, self.leads = "", 0, START

    def say(self, role: str, text: str) -> None:
        self.digest.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False

    def inserts(self) -> None:
        while self.next < len(self.edits) and self.edits[self.next] == "I":
            self.cost += INSERT
            self.state = FITS[self.state]
            self.say(ROLE[self.state], "")
            self.next += 1

    def open(self, edits: list[str], leads: list[int]) -> None:
        at = self.state if len(edits) > 1 else 0
        self.edits, self.next = edits[at], 0
        self.audit.append(self.edits)

    def row(self, turn: int | None, role: str, text: str, n: int, fault: str) -> None:
        if not n:
            return
        initial = role[:1]
        self.count[fault] += 1
        self.count["B" if fault == "B" else "D"] += n - 1
        self.illegal += n - 1 + (self.before is not None and self.before + initial not in ("su", "ua", "au"))
        self.before = initial
        if turn is not None:
            self.turns += turn != self.turn
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
        self.inserts()
        edit = self.edits[self.next]
        self.next += n
        self.cost += DELETE * (n - 1)
        if edit == "D":
            self.cost += DELETE
            return
        self.cost += CUT_OFF * (fault == "T")
        if edit == "K":
            self.state = KEEPS[self.state, initial]
            self.say(role, text)
        else:
            self.cost += REROLE
            self.state = FITS[self.state]
            self.say(ROLE[self.state], text)

    def done(self) -> tuple:
        self.inserts()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        c = self.count
        return self.conv, gaps, c["B"], c["D"], c["T"], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


def _report():
    held: dict = {"now": None}

    def row(conv, at, kind, turn, role, text, n, fault, edits, leads):
        out = []
        if held["now"] is None or held["now"].conv != conv:
            out = [held["now"].done()] if held["now"] else []
            held["now"] = _Report(conv)
        if kind == 0:
            held["now"].inserts()
            held["now"].open(edits, leads)
        else:
            held["now"].row(turn, role, text, n, fault)
        return out

    return row, lambda: [held["now"].done()] if held["now"] else []


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The report of every conversation of counted rows ``(conv_id, turn, role, text, n)``."""
    turns = in_order(with_faults(rows))
    slim = turns.select(F.floor(F.col("at") / block).cast("long").alias("block"), "conv_id", "at", F.substring("role", 1, 1).alias("initial"), "fault", F.col("n").cast("long").alias("n"))
    measured = slim.repartition("block").sortWithinPartitions("at").mapInArrow(_streamed(_MEASURED, _measure), _MEASURED)
    chained = measured.repartition("conv_id").sortWithinPartitions("conv_id", F.col("at").desc()).mapInArrow(_streamed(_CHAINED, _chain), _CHAINED)
    ahead = chained.select(F.floor(F.col("at") / block).cast("long").alias("block"), "conv_id", "at", "exits", "first", "last")
    both = slim.unionByName(ahead, allowMissingColumns=True)
    found = both.repartition("block").sortWithinPartitions("at", F.col("exits").isNull()).mapInArrow(_streamed(_FOUND, _find), _FOUND)
    lines = turns.select("conv_id", "at", F.lit(1).alias("kind"), "turn", "role", "text", F.col("n").cast("long").alias("n"), "fault")
    told = lines.unionByName(found.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    return told.repartition("conv_id").sortWithinPartitions("conv_id", "at", "kind").mapInArrow(_streamed(REPORT, _report), REPORT)
