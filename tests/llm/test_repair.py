"""Conversation repair against dynamic programming without matrices, and against all edits of small conversations."""

import hashlib
import itertools
import random
import zlib

import pytest

from gyre.llm import repair as R

SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [] if kind == 0 else [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    """(role, text, fault) in order."""
    seen, out = set(), []
    for _, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])):
        solid = text.rstrip(SPACE)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def plain(rows, conv):
    """One conversation: the least (cost, audit, lines) for each state, turn by turn."""
    own = faults([r for r in rows if r[0] == conv])
    initials = [r[1][:1] for r in own]
    best = {"": (0, "", ())}

    def put(into, state, way):
        if state not in into or way < into[state]:
            into[state] = way

    def inserted(states):
        out = dict(states)
        for _ in range(4):
            for state, (c, a, lines) in list(out.items()):
                to, role = ("a", "assistant") if state == "u" else ("u", "user")
                put(out, to, (c + 2, a + "I", (*lines, role + ":")))
        return out

    for _, role, text, fault in own:
        after = {}
        for state, (c, a, lines) in inserted(best).items():
            put(after, state, (c + 3, a + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            for new in {"u": ["a"], "": ["s", "u"]}.get(state, ["u"]):
                if role[:1] == new:
                    put(after, new, (c + extra, a + "K", (*lines, f"{role}:{text}")))
                if new != "s":
                    full = {"u": "user", "a": "assistant"}[new]
                    put(after, new, (c + 2 + extra, a + "R", (*lines, f"{full}:{text}")))
        best = after
    cost, audit, lines = min(v for k, v in inserted(best).items() if k in ("", "a")) if own else (0, "", ())
    turns = {r[0] for r in own if r[0] is not None}
    count = lambda f: sum(r[3] == f for r in own)
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in itertools.pairwise(initials))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made(seed, convs=60, longest=14):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Is it?", "It is", "", " \n", "One. ", "a b\x0b", "Long text that ends. And goes on", "é.", "same."]
    roles = ["user", "assistant", "system", "tool", "", "ux", None]
    rows = []
    for c in [*range(convs), None]:
        n = r.randint(0, longest)
        rows += [(c, r.choice([t, t, t, t + 3, None, 1]), r.choice(roles[:2]) if r.random() < 0.7 else r.choice(roles), r.choice([*texts, None])) for t in range(n)]
    return rows


def operator(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = R.repaired(R.damaged(turns), turns.select("conv_id").distinct())
    from pyspark.sql import functions as F

    lines = R.joined_hash(found.rows.select("conv_id", "place", F.concat_ws(":", "role", "text").alias("line")))
    hashes = {r.conv_id: r.sha256 for r in lines.collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return sorted(((*r, hashes.get(r.conv_id, empty)) for r in found.conversations.collect()), key=str)


@pytest.mark.parametrize("run", [4096, 3])
def test_against_plain_version(spark, monkeypatch, run):
    """Also with runs of three turns, so that conversations are put together from many runs and levels."""
    monkeypatch.setattr(R, "RUN", run)
    monkeypatch.setattr(R, "FAN", 2)
    rows = made(run)
    rows += [(500, i, ["user", "assistant"][i % 2], f"turn {i}.") for i in range(200)]
    hurt = damage(rows)
    want = sorted((plain(hurt, c) for c in {r[0] for r in rows}), key=str)
    assert operator(spark, rows) == want
    assert {x for w in want for x in w[7]} == set("DIKR")


def test_query_over_a_table_with_all_kinds_of_rows(spark, tmp_path):
    from gyre.llm.queries import op11_conversation_repair

    rows = made(9, convs=20)
    spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted((tuple(r) for r in op11_conversation_repair(spark, str(tmp_path)).collect()), key=str)
    hurt = damage(rows)
    assert got == sorted((plain(hurt, c) for c in {r[0] for r in rows}), key=str)


def test_empty_table(spark):
    assert operator(spark, []) == []


def test_products_are_associative_and_match_all_edits():
    r = random.Random(1)
    kinds = [(i, f, t) for i in ("s", "u", "a", "") for f in (False, True) for t in (False, True)]
    for _ in range(60):
        turns = [r.choice(kinds) for _ in range(r.randint(1, 9))]
        matrices = [R.turn_matrix(*k) for k in turns]
        left = matrices[0]
        for m in matrices[1:]:
            left = R.product(left, m)
        assert R.reduced(matrices) == left
    for turns in itertools.product(kinds[:10], repeat=2):
        ways = []
        # up to two insertions in each of three places, and each turn's edit
        for marks in itertools.product(range(3), repeat=3):
            for edits in itertools.product("KRD", repeat=2):
                for new in itertools.product("ua", repeat=2):
                    for ins in itertools.product("ua", repeat=sum(marks)):
                        roles, audit, cost, left, ok = "", "", 0, list(ins), True
                        for k in range(3):
                            for _ in range(marks[k]):
                                roles, audit, cost = roles + left.pop(0), audit + "I", cost + 2
                            if k < 2:
                                initial, faulty, cut = turns[k]
                                ok &= edits[k] == "D" or not faulty
                                audit += edits[k]
                                cost += {"K": 0, "R": 2, "D": 3}[edits[k]] + (cut and edits[k] != "D")
                                roles += "" if edits[k] == "D" else (initial or "?") if edits[k] == "K" else new[k]
                        body = roles[1:] if roles[:1] == "s" else roles
                        if ok and (roles == "" or (body and len(body) % 2 == 0 and body == "ua" * (len(body) // 2))):
                            ways.append((cost, audit))
        assert R.cheapest(R.reduced([R.turn_matrix(i, f, t and not f) for i, f, t in turns])) == min(ways)


def test_replay_counts_every_turn():
    for audit in ("IKKRII", "DIKDKKDI", "DD", "KKKKK", "RI"):
        place = 0
        for at, inserted, edit, _, after in R.replayed(audit):
            assert at == place
            place += inserted + (edit != "D") + after
        assert place == len(audit) - audit.count("D")
