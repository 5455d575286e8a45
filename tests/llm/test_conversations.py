"""Repairs of conversations against a plain search over edits."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from beatframe.llm import conversations
from beatframe.llm.conversations import FORCED, KEPT, Tables, cost_of

ROLES = {2: "user", 3: "assistant"}


def cheapest(rows):
    """(cost, audit, repaired lines) of rows (role, text, gone, cut off), row by row from the end."""
    best = {0: (0, "", ()), 1: (4, "II", ("user:", "assistant:")), 2: (2, "I", ("assistant:",)), 3: (0, "", ())}
    for role, text, gone, cut_off in reversed(rows):
        own = {}
        for s in range(4):
            found = [(3 + best[s][0], "D" + best[s][1], best[s][2])]
            if not gone:
                to = KEPT.get((s, "sua".index(role[0]))) if role[:1] in ("s", "u", "a") else None
                for cost, letter, n, line in ((0, "K", to, f"{role}:{text}"), (2, "R", FORCED[s], f"{ROLES[FORCED[s]]}:{text}")):
                    if n is not None:
                        found.append((cost + cut_off + best[n][0], letter + best[n][1], (line, *best[n][2])))
            own[s] = min(found)
        best = {}
        for s in range(4):
            a, b = FORCED[s], FORCED[FORCED[s]]
            best[s] = min(own[s], (2 + own[a][0], "I" + own[a][1], (f"{ROLES[a]}:", *own[a][2])), (4 + own[b][0], "II" + own[b][1], (f"{ROLES[a]}:", f"{ROLES[b]}:", *own[b][2])))
    return best[0]


def plain(rows, damaged=True):
    out = []
    for conv in {r[0] for r in rows}:
        made = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = (" " if x is None else x for x in (role, text))
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 9
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            made += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        made.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, judged, counts = set(), [], [0, 0, 0]
        for _, role, text in made:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            judged.append((role, text, fault in (0, 1), int(fault == 2)))
        turns = {t for t, _, _ in made if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(made, made[1:], strict=False))
        cost, audit, lines = cheapest(judged) if judged else (0, "", ())
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1, 2, 3, 4])
def test_block_tables_equal_the_plain_search(block):
    rng, tables = random.Random(block), Tables(block)
    for n in [*range(12), 40] * 12:
        symbols = [rng.randrange(9) for _ in range(n)]
        rows = [("suax"[x // 2] if x < 8 else "u", "", x == 8, x % 2) for x in symbols]
        x = np.array(symbols, int)
        _, letters = tables.trace(x, 0, 0, True)
        assert (cost_of(letters, x), letters.decode()) == cheapest(rows)[:2]
        every = tables.through(x, np.arange(len(tables.vectors)))
        assert every[0] == tables.through(x[: n // 2], tables.through(x[n // 2 :], np.array([0])))[0]


def made_up(seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "why", "a.b", "", " \n", "é?", "x" * 3000 + ".", None, "Done. \t"]
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", None, "User"]
    rows = [(c, rng.choice([None, *range(8)]) if rng.random() < 0.2 else t, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"{rng.random()}.") for c in [None, *range(25)] for t in range(rng.randint(1, 9))]
    return rows + [(99, t, "user" if t % 2 else "assistant", rng.choice(["one.", "two", f"{t}."])) for t in range(203)] + rows[:5]


@pytest.mark.parametrize(("chunk", "damaged"), [(4096, True), (8, True), (8, False)])
def test_equals_the_plain_search(spark, monkeypatch, chunk, damaged):
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    rows = made_up(chunk)
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, cost int, pos string")
    assert sorted((tuple(r) for r in conversations.repair(table, damaged=damaged).collect()), key=repr) == plain(rows, damaged)


def test_empty_table_and_conversations_without_rows(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in conversations.repair(table).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversations.repair(table.limit(0)).count() == 0
