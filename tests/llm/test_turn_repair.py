from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from tallyline.llm import turn_repair
from tallyline.llm.shared import ship

STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
RIGHT = {"": "user", "s": "user", "u": "assistant", "a": "user"}


def cheapest(rows):
    """Dijkstra over (cost, edits): rows are (role, text, fault)."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, edits, i, state, said = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, edits, said
        fit = RIGHT[state]
        heapq.heappush(heap, (cost + 2, edits + "I", i, fit[0], (*said, f"{fit}:")))
        if i == len(rows):
            continue
        role, text, fault = rows[i]
        heapq.heappush(heap, (cost + 3, edits + "D", i + 1, state, said))
        if fault not in ("B", "D"):
            cut = fault == "T"
            if (state, role[:1]) in STEP:
                heapq.heappush(heap, (cost + cut, edits + "K", i + 1, role[:1], (*said, f"{role}:{text}")))
            heapq.heappush(heap, (cost + 2 + cut, edits + "R", i + 1, fit[0], (*said, f"{fit}:{text}")))


def plain(conversations):
    made: dict = {}
    for conv, turn, role, text in conversations:
        of = made.setdefault(conv, [])
        key = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if key == 1 else re.sub("[.!?]", "", text) if key == 2 else text
        of += [(turn, "user" if key == 4 else role, text)] * (0 if key == 0 else 2 if key == 3 else 1)
    out = []
    for conv, rows in made.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faulty = set(), []
        for _, role, text in rows:
            visible = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "B" if not visible else "D" if (role, text) in seen else "T" if visible[-1] not in ".!?" else ""
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [t for t, _, _ in rows if t is not None]
        pairs = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _, _), (b, _, _) in zip(faulty, faulty[1:]))
        cost, edits, said = cheapest(faulty)
        count = {f: sum(x[2] == f for x in faulty) for f in "BDT"}
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, count["B"], count["D"], count["T"], pairs, cost, edits, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return out


def key(row):
    return tuple((v is None, v if v is not None else 0) for v in row[:1])


def book(rng, convs, longest):
    rows = []
    for conv in range(convs):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "u2", None])
            text = rng.choice(["Yes.", "Yes.", "no", "What? ", "", " \n", None, "end!\t", "a. ", "é…", f"text {rng.randint(0, 5)}."])
            at = rng.choice([turn, turn, turn * 2, None, 0])
            rows.append((conv, at, role, text))
            if rng.random() < 0.15:
                rows.append((conv, at, role, text))
    return rows


def test_search_equals_dijkstra_and_pieces_equal_the_whole():
    rng = random.Random(4)
    for _ in range(400):
        items = [(rng.choice(["s", "u", "a", "t", ""]), rng.choice(["", "", "T", "B"]), rng.choice([0, 0, 0, 1, 3])) for _ in range(rng.randint(0, 12))]
        rows = [(i or " ", "", f) for i, fault, n in items for f in [fault] + ["D"] * n]
        own = [(i, f == "B", f == "T", n) for i, f, n in items]
        edits, state, cost = turn_repair.search(own, turn_repair.START, turn_repair.END)
        want = cheapest(rows)
        assert (cost, edits + turn_repair.TAIL[state]) == want[:2]


@pytest.mark.parametrize("block", [1, 2, 8, 4096])
def test_repair_equals_plain_version(spark, block):
    ship(spark)
    rng = random.Random(9)
    rows = book(rng, 40, 9) + [(50, t % 7, "user", "again and again.") for t in range(60)] + book(rng, 1, 300)
    rows += [(None, None, None, None), (None, 3, "user", "hi."), (60, 0, "assistant", "word " * 50_000)]
    rows += [(c, 0, "user", "x.") for c in range(100, 160)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, cost string").repartition(6)
    got = [tuple(r) for r in turn_repair.repair(turn_repair.damage(frame), block).collect()]
    want = plain(rows)
    assert any(w[7] == "" and w[8] == hashlib.sha256(b"").hexdigest() for w in want)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_empty_table_and_hot_conversation(spark):
    frame = spark.createDataFrame([(1, t % 500, ["user", "assistant", "user"][t % 3], f"text {t % 900}{'.!? '[t % 4]}") for t in range(3000)], "conv_id long, turn long, role string, text string")
    assert turn_repair.repair(turn_repair.damage(frame.limit(0))).count() == 0
    got = [tuple(r) for r in turn_repair.repair(turn_repair.damage(frame), 64).collect()]
    assert got == plain([tuple(r) for r in frame.collect()])
