"""Repair of turns against a search over all edits, conversations over many partitions, hostile rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandline.llm import turn_repair as tr

SCHEMA = "conv_id long, turn long, role string, text string"
MOVES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAMES = {"u": "user", "a": "assistant"}


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def brute(rows):
    """(turn, role, text) of a conversation: all edits tried, the cheapest prefix kept for each last role."""
    rows = order(rows)
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(tr.SPACE)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    def inserts(at):
        out = [(0, "", at, [])]
        for _ in range(3):
            cost, letters, q, lines = out[-1]
            r, to = next((r, to) for (p, r), to in MOVES.items() if p == q and r in NAMES)
            out.append((cost + 5, letters + "I", to, [*lines, f"{NAMES[r]}:"]))
        return out

    best = {"": (0, "", [])}
    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = defaultdict(list)
        for at, (cost, letters, lines) in best.items():
            for c, more, q, said in inserts(at):
                new[q].append((cost + c + 2, letters + more + "D", lines + said))
                if fault in ("", "t"):
                    worse = 5 * (fault == "t")
                    if (q, role[:1]) in MOVES and role:
                        new[MOVES[q, role[:1]]].append((cost + c + worse, letters + more + "K", [*lines, *said, f"{role}:{text}"]))
                    for r, name in NAMES.items():
                        if (q, r) in MOVES:
                            new[MOVES[q, r]].append((cost + c + worse + 1, letters + more + "R", [*lines, *said, f"{name}:{text}"]))
        best = {q: min(v, key=lambda x: x[:2]) for q, v in new.items()}
    cost, audit, lines = min(((cost + c, letters + more, lines + said) for at, (cost, letters, lines) in best.items() for c, more, q, said in inserts(at) if q in ("", "a")), key=lambda x: x[:2])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, *(faults.count(k) for k in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def brute_damage(rows):
    out = []
    told = lambda x: " " if x is None else str(x)
    for c, t, role, text in rows:
        f = zlib.crc32(f"{told(c)}:{told(t)}".encode()) % 20
        role, text = told(role), told(text)
        if f:
            text = "" if f == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if f == 2 else text
            out += [(c, t, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)
    return out


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def by_conversation(rows):
    by = defaultdict(list)
    for c, *r in rows:
        by[c].append((r[0], *(" " if x is None else x for x in r[1:])))
    return by


def wild(rng, convs, turns):
    roles, texts = ["user", "assistant", "system", "tool", "", None, "unknown"], ["fine.", "Ok!", "cut", "", " \n\t", None, "é?  ", "a. ", "same.", "same.", ".", "x" * 50]
    return [(None if c == 0 else c, rng.choice([None, *range(n), *range(n)]), rng.choice(roles[: rng.choice((2, 3, 7))]), rng.choice(texts)) for c in range(convs) for n in [rng.randint(1, turns)] for _ in range(n)]


@pytest.mark.parametrize("seed,convs,turns", [(1, 150, 9), (2, 40, 40), (3, 3, 200)])
def test_equals_brute_force(spark, seed, convs, turns):
    rows = wild(random.Random(seed), convs, turns)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"kind": F.lit(1), "first": F.lit("x"), "m": F.lit(2)}).repartition(5)
    assert got(tr.repair(df, piece=40)) == {c: brute(v) for c, v in by_conversation(rows).items()}


def test_one_conversation_over_many_partitions(spark):
    """A third of all rows and more in one conversation, among them one row a hundred times: several tasks share it."""
    rng = random.Random(5)
    rows = [(7, t, rng.choice(("user", "assistant", "system")), rng.choice(("a.", "b", "c!", "")) + str(rng.randint(0, 400)) + rng.choice((".", "!", ""))) for t in range(900)] + [(7, 450, "user", "again.")] * 100 + wild(rng, 60, 8)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(4)
        pieces = tr.traced(df)
        mine = [r.n for r in pieces.groupBy("conv_id", "part").agg(F.sum(F.length("audit")).alias("n")).filter("conv_id = 7").collect()]
        assert len(mine) > 6 and max(mine) < 500
        assert got(tr.chained(pieces)) == {c: brute(v) for c, v in by_conversation(rows).items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_damage_and_report(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(("user", "assistant", None)), rng.choice(("Yes. No!", "cut?", None, "x"))) for c in range(200) for t in range(rng.randint(1, 4))] + [(None, None, "user", "a."), (None, 3, "user", "b.")]
    df = spark.createDataFrame(rows, SCHEMA)
    hurt = brute_damage(rows)
    key = lambda r: tuple((x is not None, x) if not isinstance(x, str) else (True, x) for x in r)
    assert sorted(map(tuple, tr.damage(df).collect()), key=key) == sorted(hurt, key=key)
    want = {c: brute(v) for c, v in by_conversation(hurt).items()}
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    found = got(tr.reported(df, tr.damage(df)))
    assert found == {c: want.get(c, none) for c in {r[0] for r in rows}} and none in found.values()


def test_empty_and_long(spark):
    assert tr.reported(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, 0, "user", "x" * 3_000_000 + "."), (1, 1, "assistant", "y " * 1_500_000)]
    assert got(tr.repair(spark.createDataFrame(rows, SCHEMA))) == {1: brute([r[1:] for r in rows])}


def test_the_automaton_is_small():
    """Few vectors occur, however long the rows are: the table is what makes the scan cheap."""
    dfa, rng = tr.Automaton(), random.Random(3)
    for _ in range(300):
        dfa.scan([(rng.randint(0, 8), 1) for _ in range(60)], dfa.end)
    assert len(dfa.vectors) < 60 and len(dfa.table) < 500
