"""Structure repair (operator 12): every edit sequence tried on short conversations, blocks against whole ones, and the query's digests."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafpress.llm import repair

SPACE = " \t\n\x0b\x0c\r"
GOAL = re.compile(r"(s?(ua)+)?")


def every_way(initials, kinds):
    """(cost, audit) of the cheapest sequence of edits, ASCII-least, by trying them all: up to two turns inserted at each place."""
    inserts = ["", "u", "a", "uu", "ua", "au", "aa"]
    found = None
    for acts in product("DKua", repeat=len(initials)):
        if any(x in "bd" and a != "D" for x, a in zip(kinds, acts)):
            continue
        for put in product(inserts, repeat=len(initials) + 1):
            roles = "".join(p + ("" if a == "D" else r if a == "K" else a) for p, a, r in zip(put, [*acts, "D"], [*initials, ""]))
            if not GOAL.fullmatch(roles):
                continue
            cost = sum(5 * len(p) for p in put) + sum(2 if a == "D" else (a != "K") + 5 * (k == "t") for a, k in zip(acts, kinds))
            audit = "".join("I" * len(p) + ("R" if a and a in "ua" else a) for p, a in zip(put, [*acts, ""]))
            found = min(found, (cost, audit)) if found else (cost, audit)
    return found


def stepwise(initials, kinds):
    """The same by a table over prefixes that carries whole audits; also the roles of the repaired turns."""
    best = {"^": (0, "", ())}
    for k, (r, kind) in enumerate(zip(initials, kinds)):
        new = {}
        for s, (cost, audit, out) in best.items():
            ways = [(s, cost + 2, audit + "D", out)]
            if kind not in "bd":
                for x in "sua" if r == "s" else "ua":
                    if s + x in repair.BETWEEN:
                        put = repair.BETWEEN[s + x]
                        ways.append((x, cost + 5 * len(put) + (r != x) + 5 * (kind == "t"), audit + "I" * len(put) + ("K" if r == x else "R"), (*out, *((None, p) for p in put), (k, None if r == x else x))))
            for x, *way in ways:
                new[x] = min(new[x], tuple(way), key=lambda w: w[:2]) if x in new else tuple(way)
        best = new
    ends = [(cost + 5 * len(repair.ENDING[s]), audit + "I" * len(repair.ENDING[s]), (*out, *((None, p) for p in repair.ENDING[s]))) for s, (cost, audit, out) in best.items()]
    return min(ends, key=lambda w: w[:2])


def test_the_stepwise_table_equals_every_way():
    rng = random.Random(1)
    for n in (0, 1, 2, 3):
        for _ in range(8):
            initials, kinds = "".join(rng.choices("suao", k=n)), "".join(rng.choices("--tbd", k=n))
            assert stepwise(initials, kinds)[:2] == every_way(initials, kinds)


rows_ = st.lists(st.tuples(st.sampled_from("suao"), st.sampled_from("---tbd")), max_size=14)


@settings(max_examples=1500, deadline=None)
@given(rows_, st.integers(1, 6))
def test_search_and_blocks_equal_the_table(rows, size):
    initials, kinds = "".join(r for r, _ in rows), "".join(k for _, k in rows)
    cost, audit, _ = stepwise(initials, kinds)
    assert repair.solve(initials, kinds, "^", repair.END, True)[:2] == (cost, audit)
    # The same through blocks: matrices backwards, roles forwards.
    cuts = [(initials[i : i + size], kinds[i : i + size]) for i in range(0, len(initials), size)]
    after, behind = list(repair.END), []
    for a, b in reversed(cuts):
        behind.append(after)
        m = repair.matrix(a, b)
        after = [min(m[4 * i + j] + after[j] for j in range(4)) for i in range(4)]
    role, total, said = "^", 0, ""
    for k, ((a, b), prices) in enumerate(zip(cuts, reversed(behind))):
        part = repair.solve(a, b, role, tuple(prices), k + 1 == len(cuts))
        role = repair.STATES[repair.leaves(a, b, tuple(prices))[repair.STATES.index(role)]]
        total, said = total + part[0], said + part[1]
    assert (total, said) == (cost, audit) if cuts else cost == 0


def expected(rows):
    """The report and digest of each conversation (rows after damage) by definition."""
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, (r[2] or "").encode(), r[3] is not None, (r[3] or "").encode())
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=key)
        seen, kinds, initials = set(), "", ""
        for _, _, role, text in mine:
            body = (text or "").strip(SPACE)
            kinds += "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "-"
            seen.add((role, text))
            initials += role[0] if role and role[0] in "sua" else "o"
        cost, audit, made = stepwise(initials, kinds)
        lines = [f"{repair.ROLES[x]}:" if k is None else f"{repair.ROLES[x] if x else mine[k][2]}:{mine[k][3]}" for k, x in made]
        turns = [t for _, t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))
        out[conv] = (gaps, *(kinds.count(x) for x in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("block_rows", [1, 3, 1024])
def test_equals_brute_force(spark, block_rows):
    rng = random.Random(6)
    say = lambda: rng.choice([None, "", " \t", "yes.", "no", "really? ", "so!\n", "\x85", "　", "a", "b.", "c."])
    roles = ["user", "assistant", "system", "tool", None, "", "ula", "User"]
    rows = [(rng.choice([None, 1, 2, 3, 4, 5]), rng.choice([None, 0, 1, 2, 3, 4, 5, 9]), rng.choice(roles[:3] if rng.random() < 0.8 else roles), say()) for _ in range(120)]
    rows += [(6, k // 2, rng.choice(roles[:3]), f"turn {k % 50}" + rng.choice(["", ".", "?"])) for k in range(260)]  # many blocks
    rows += [(7, 1, "user", "same text.")] * 150  # one row that fills a conversation
    rows += [(8, None, "user", "x."), (8, None, "assistant", "long " * 50_000), (9, -(1 << 63), "user", "a."), (9, (1 << 63) - 1, "assistant", "b.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {r.conv: tuple(r[c] for c in COLUMNS) for r in repair.with_digest(*repair.repair_conversations(df, block_rows=block_rows)).collect()}
    want = expected(rows)
    assert got[9][0] is None  # no long holds these gaps
    want[9] = (None, *want[9][1:])
    assert got == want


def test_clashing_names_and_empty_tables(spark):
    names = ["conv", "block", "pos", "turns", "lines", "kinds", "initials", "k", "of", "before", "audit", "_n", "_line", "entry", "after"]
    df = spark.createDataFrame([(1, 0, "user", "a."), (1, 1, "assistant", "b.")], "conv_id long, turn long, role string, text string").select("*", *(F.lit("x").alias(c) for c in names))
    (row,) = repair.with_digest(*repair.repair_conversations(df)).collect()
    assert row.audit == "KK" and row.cost == 0
    assert repair.with_digest(*repair.repair_conversations(df.where("false"))).count() == 0


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def test_query_on_a_whole_table(spark, sf, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    # Conversations whose rows all go, and nulls everywhere.
    rows += [(c, 0, "user", "gone.") for c in range(1000, 1060)] + [(None, None, None, None), (None, 3, "user", None), (2000, None, "user", "x.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in {r[0] for r in rows}} | expected(damage(rows))
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.op12_structure_repair(spark, str(tmp_path)).collect()}
    assert got == want and any(g[6] == "" for g in got.values())
