"""Conversation repair against every possible edit of short conversations, a plain loop over long ones, and its SQL on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tagmill.llm import repair

from ..oracle import same_rows

SCHEMA = "conv_id long, turn long, role string, text string, audit string, place int"
WORD = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
FULL = {"u": "user", "a": "assistant"}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def faults(turns):
    """What each turn of a conversation (turn, role, text), in order, suffers from."""
    seen, out = set(), []
    for _, role, text in turns:
        words = WORD.findall(text)
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def in_order(rows):
    turns = [(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows]
    return sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))


def exhaustive(rows):
    """The least (cost, audit) and its lines among all edits with up to two insertions in each gap."""
    turns = in_order(rows)
    kinds, best = faults(turns), None
    gaps = itertools.product(["", "I", "II"], repeat=len(turns) + 1)
    for gap, letters in itertools.product(list(gaps), itertools.product("DKR", repeat=len(turns))):
        state, cost, lines, fine = "", 3 * sum(map(len, gap)), [], True
        for k in range(len(turns) + 1):
            for _ in gap[k]:
                state = NEXT[state]
                lines.append(f"{FULL[state]}:")
            if k == len(turns):
                break
            letter, (_, role, text) = letters[k], turns[k]
            if letter == "D":
                cost += 4
                continue
            if kinds[k] in ("blank", "duplicate"):
                fine = False
                break
            cost += 3 * (kinds[k] == "truncated")
            if letter == "R":
                cost, state = cost + 3, NEXT[state]
                lines.append(f"{FULL[state]}:{text}")
            elif role[:1] and (role[0] == NEXT[state] or (role[0] == "s" and state == "")):
                state = role[0]
                lines.append(f"{role}:{text}")
            else:
                fine = False
                break
        if fine and state in ("", "a"):
            audit = "".join(g + x for g, x in zip(gap, [*letters, ""], strict=True))
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, "\n".join(lines))
    return best


def brute(rows):
    """Every column but the edits' for one conversation."""
    turns = in_order(rows)
    kinds, numbers = faults(turns), {t for t, _, _ in turns if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    return gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal


def test_every_edit_of_short_conversations(spark):
    rng = random.Random(5)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None], ["One.", "Two", "Three!", " ", None, "Four? ", "x"]
    rows = [(c, rng.choice([None, 0, 1, 2, 5]), rng.choice(roles), rng.choice(texts)) for c in [None, *range(120)] for _ in range(rng.choice([1, 2, 2, 3, 3, 4]))]
    found = {r.conv_id: r for r in repair.repair(frame(spark, rows).select("conv_id", "turn", "role", "text")).collect()}
    of: dict = {}
    for c, *rest in rows:
        of.setdefault(c, []).append(tuple(rest))
    assert set(found) == set(of)
    for c, own in of.items():
        cost, audit, text = exhaustive(own)
        r = found[c]
        assert (r.cost, r.audit, r.repaired_sha256) == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), own
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal) == brute(own), own


def test_odd_rows_against_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(7)
    roles, texts = ["user", "assistant", "user", "assistant", "system", None, "", "tool"], ["Hi there.", "No end", "Why?", None, "", "\n", "Ünï.", "A.B!c"]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(150) for t in range(rng.randint(1, 9))]
    rows += [(None, None, "user", "Lost."), (None, 3, None, None), (7, None, "system", "First."), (7, None, "system", "First."), (500, 2, "user", "x")]
    path = str(tmp_path / "conversations.parquet")
    frame(spark, rows).coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    same_rows(repair.op12_conversation_repair(spark, str(tmp_path)), con, repair.REPAIR_SQL)


def test_one_conversation_over_many_units(spark, monkeypatch):
    monkeypatch.setattr(repair, "PIECE", 4)
    monkeypatch.setattr(repair, "FAN", 3)
    monkeypatch.setattr(repair, "BATCH", 50)
    rng = random.Random(9)
    texts = [f"Text {k}." for k in range(400)] + ["Cut", ""]
    hot = [(1, t, rng.choice(["user", "assistant"]), rng.choice(texts)) for t in range(600)]
    rows = hot + [(c, t, "user" if t % 2 == 0 else "assistant", f"Fine {c} {t}.") for c in range(2, 40) for t in range(4)]
    found = {r.conv_id: r for r in repair.repair(frame(spark, rows).select("conv_id", "turn", "role", "text")).collect()}
    assert {(r.cost, r.audit) for c, r in found.items() if c != 1} == {(0, "KKKK")}
    turns = in_order([r[1:] for r in hot])
    kinds = faults(turns)
    best = {0: (0, "")}
    for (_, role, _), kind in zip(turns, kinds, strict=True):
        fault = repair.FINE if not kind else repair.CUT_OFF if kind == "truncated" else repair.UNWANTED
        new: dict = {}
        for (begin, to), (price, letters) in repair.moves(role[:1], fault).items():
            if begin in best:
                way = (best[begin][0] + price, best[begin][1] + letters)
                new[to] = min(new.get(to, way), way)
        best = new
    want = min((best[s][0] + c, best[s][1] + a) for s, c, a in repair.endings() if s in best)
    assert (found[1].cost, found[1].audit) == want
    assert (found[1].gaps, found[1].blank, found[1].duplicate, found[1].truncated, found[1].illegal) == brute([r[1:] for r in hot])


def test_damage_and_conversations_without_turns(spark):
    rows = [(c, t, "assistant", f"a.b!{c}?") for c in range(80) for t in (0, 1, None)] + [(None, 4, None, None)]
    got = sorted(repr(tuple(r)) for r in repair.damaged(frame(spark, rows)).collect())
    want = []
    for c, t, role, text in rows:
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        row = (c, t, "user" if d == 4 else role, "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text)
        want += [repr(row)] * (0 if d == 0 else 2 if d == 3 else 1)
    assert got == sorted(want)
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    [row] = repair.damaged_and_repaired(frame(spark, [(gone, 0, "user", "Hi.")])).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert repair.damaged_and_repaired(frame(spark, [])).count() == 0


@pytest.mark.parametrize("state", range(4))
def test_endings_lead_to_an_end(state):
    assert repair.endings()[state] == [(0, 0, ""), (1, 6, "II"), (2, 3, "I"), (3, 0, "")][state]
