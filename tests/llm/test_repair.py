"""Conversation repair against a plain dynamic program, by both routes."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from strandwise.llm import conversations, queries, repair

from ..compare import connect, same

SMALL = "/root/testdata/sf0.001"
DDL = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def plain(rows):
    """Forward over rows with the least (cost, letters) per node; any number of inserts."""
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text, turn))
    out = {}
    for conv, group in groups.items():
        group.sort(key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        seen, counts, best = set(), [0, 0, 0, 0], {"": (0, "", [])}

        def inserted(best):
            done = dict(best)
            for _ in range(3):
                for q, (cost, letters, lines) in list(done.items()):
                    role = "assistant" if q == "u" else "user"
                    new = (cost + 5, letters + "I", [*lines, f"{role}:"])
                    done[role[0]] = min(done.get(role[0], new), new)
            return done

        for _, _, role, text, _ in group:
            last = text.rstrip(SPACE)[-1:]
            fault = 0 if not last else 1 if (role, text) in seen else 2 if last not in ".!?" else 3
            seen.add((role, text))
            counts[fault] += 1
            more, after = 5 * (fault == 2), {}
            for q, (cost, letters, lines) in inserted(best).items():
                ways = [(q, cost + 2, "D", [])]
                if fault > 1:
                    to = "assistant" if q == "u" else "user"
                    ways.append((to[0], cost + 1 + more, "R", [f"{to}:{text}"]))
                    if role[:1] == to[0] or role[:1] == "s" and not q:
                        ways.append((role[0], cost + more, "K", [f"{role}:{text}"]))
                for to, c, letter, line in ways:
                    new = (c, letters + letter, lines + line)
                    after[to] = min(after.get(to, new), new)
            best = after
        cost, letters, lines = min(v for q, v in inserted(best).items() if q in ("", "a"))
        turns = {g[4] for g in group if g[4] is not None}
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(group, group[1:])]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts[:3], sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def rows():
    random.seed(8)
    texts = ["One.", "Two!", "three", "", " \n", "Four? ", "Five.\t", "Six… ", None, "é."]
    roles = ["user"] * 5 + ["assistant"] * 5 + ["system", "tool", "", None, "User", "sys"]
    turn = lambda: random.choice([None, *range(12)])
    out = [(c, turn(), random.choice(roles), random.choice(texts)) for c in range(120) for _ in range(random.randint(1, 9))]
    out += [(500, i // 2, random.choice(roles), f"{random.choice(texts)}{i if i % 3 else ''}.") for i in range(90)]
    out += [(None, 1, "user", "Who?"), (None, 2, "assistant", "No one."), (501, None, None, None), (502, 1, "user", "x" * 300_000), (503, -3, "assistant", "a."), (503, 5, "assistant", "a.")]
    return out


@pytest.mark.parametrize("most", [2048, 4, 17])
def test_against_a_plain_version(spark, rows, most):
    frame = spark.createDataFrame(rows, DDL).withColumns({c: F.lit("x") for c in ("chunk", "ends", "repeat", "audit", "n")}).repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_report(frame, most).collect()}
    assert got == plain(rows)


def test_turns_give_the_digest(spark, rows):
    frame = spark.createDataFrame(rows, DDL)
    report = {r.conv_id: r for r in repair.repair_report(frame).collect()}
    turns = {}
    for r in repair.repaired_turns(frame, 5).orderBy("conv_id", "place").collect():
        turns.setdefault(r.conv_id, []).append(r)
    for conv, found in turns.items():
        assert "".join(r.edit for r in found) == report[conv].audit
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in found if r.role is not None).encode()).hexdigest() == report[conv].repaired_sha256
    assert repair.repair_report(spark.createDataFrame([], DDL)).count() == 0


def test_auction_prices_against_relaxation():
    """Prices at a border are the exact distances to the end."""
    random.seed(1)
    for _ in range(60):
        arcs = [repair.row_arcs(random.choice("uuaas"), random.choice([0, 1, 2, 3, 3, 3])) for _ in range(random.randint(1, 50))]
        ends = random.choice([repair.END, (0, repair.INF, repair.INF, repair.INF), (repair.INF, repair.INF, 3, repair.INF)])
        far = list(ends)
        for row in reversed(arcs):
            near = [min([repair.INF, *(c + far[to] for _, c, go, to in row[q] if go)]) for q in range(4)]
            for _ in range(4):
                near = [min(near[q], 5 + near[repair._NEXT[q]]) for q in range(4)]
            far = [min(x, repair.INF) for x in near]
        assert list(repair.borders(arcs, ends)[1]) == far


def test_matches_sql(spark):
    same(queries.QUERIES["op12_conversation_repair"](spark, SMALL).toPandas(), connect(SMALL).sql(conversations.REPAIR_SQL).df())
