"""Conversation repair against an exhaustive search, and its query's edge cases."""

import hashlib
import random
import zlib

import pytest

from isochron.llm import conversation_repair as C

SPACES = " \t\n\x0b\x0c\r"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, audit, repaired) of (role, text, must, cut) rows, forward over all states with every audit kept."""
    best = {"": (0, "", ())}

    def inserted(states):
        for _ in range(3):
            for s, (cost, audit, out) in list(states.items()):
                to = NEXT[s]
                found = (cost + 3, audit + "I", (*out, f"{NAMES[to]}:"))
                states[to] = min(states.get(to, found), found)
        return states

    for role, text, must, cut in rows:
        after = {}
        for s, (cost, audit, out) in inserted(best).items():
            ways = [(s, (cost + 4, audit + "D", out))]
            if not must:
                more = 3 * cut
                if role[:1] == NEXT[s] or (role[:1] == "s" and s == ""):
                    ways.append((role[:1], (cost + more, audit + "K", (*out, f"{role}:{text}"))))
                ways.append((NEXT[s], (cost + 3 + more, audit + "R", (*out, f"{NAMES[NEXT[s]]}:{text}"))))
            for to, found in ways:
                after[to] = min(after.get(to, found), found)
        best = after
    return min(v for s, v in inserted(best).items() if s in ("", "a"))


def expected(table):
    """The report's rows by conv_id, from (conv_id, turn, role, text) rows."""
    out = {}
    for conv in dict.fromkeys(r[0] for r in table):
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            kind, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
            if kind == 0:
                continue
            text = "" if kind == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if kind == 2 else text
            rows += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
        rows.sort(key=lambda r: (r[:2], r[2].encode(), r[3].encode()))
        seen, judged, counts, odd = set(), [], [0, 0, 0], 0
        for i, (_, _, role, text) in enumerate(rows):
            blank, again, cut = not text.strip(SPACES), (role, text) in seen, text.rstrip(SPACES)[-1:] not in tuple(".!?")
            seen.add((role, text))
            for k, fault in enumerate((blank, again and not blank, cut and not again and not blank)):
                counts[k] += fault
            judged.append((role, text, blank or again, cut))
            odd += i > 0 and rows[i - 1][2][:1] + role[:1] not in ("su", "ua", "au")
        turns = [t for known, t, *_ in rows if known]
        cost, audit, lines = cheapest(judged)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, odd, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def reported(spark, table, schema="conv_id long, turn long, role string, text string"):
    frame = spark.createDataFrame(table, schema)
    rows = C.report(C.damage(frame), frame).collect()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(got) == len(rows)
    return got


def any_table(seed, conversations, most):
    rng = random.Random(seed)
    texts = [None, "", " \t", "One.", "Two", "Three! ", "Four?\n", "é", "a ", "...", "x" * 50_000 + "."]
    roles = [None, "", "system", "user", "assistant", "tool", "unknown", "Assistant"]
    weights = [1, 1, 2, 6, 6, 1, 1, 1]
    out = []
    for conv in range(conversations):
        own = None if conv == 3 else conv
        for _ in range(rng.randint(0, most)):
            out.append((own, rng.choice([None, *range(-2, 12)]), rng.choices(roles, weights)[0], rng.choice(texts)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    table = any_table(seed, 150, 9)
    assert reported(spark, table) == expected(table)


def test_long_conversations_in_segments(spark, monkeypatch):
    """Segments of four rows: the driver chains them, and the audit is the same."""
    monkeypatch.setattr(C, "SEGMENT", 4)
    rng = random.Random(5)
    table = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", f"{t}."])) for c in (1, None, 3) for t in range(90)] + any_table(7, 30, 12)
    assert reported(spark, table) == expected(table)


def test_hot_copies_are_one_row(spark):
    table = [(1, 5, "user", "Same.")] * 3000 + [(1, 6, "assistant", "Yes.")] + [(2, t, "user", f"{t}.") for t in range(500)]
    got = reported(spark, table)
    assert got == expected(table) and got[1][2] >= 2999


def test_powers_are_repeated_products():
    for symbol in range(9):
        once, many = C._power(symbol, 0), C._power(symbol, 0)
        for _ in range(12):
            many = C._product(many, once)
        assert C.matrix(((symbol, 13),)) == many
        assert C._before(symbol, 13, C._FINAL) == C._applied(many, C._FINAL)


def test_repaired_rows(spark):
    frame = spark.createDataFrame([(7, 0, "system", "Be brief."), (7, 1, "user", "Hm?"), (7, 1, "user", "Hm?"), (7, 3, "user", "And?")], "conv_id long, turn long, role string, text string")
    got = [(r.place, r.edit, r.turn, r.role, r.text) for r in sorted(C.repair(frame).collect(), key=lambda r: r.place)]
    assert got == [(0, "K", 0, "system", "Be brief."), (1, "K", 1, "user", "Hm?"), (2, "R", 3, "assistant", "And?")]


def test_empty_table_and_clashing_columns(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert reported(spark, [], schema) == {}
    frame = spark.createDataFrame([(1, 0, "user", "Hello.", "x", 1, 2)], f"{schema}, audit string, id int, n int")
    assert C.report(C.damage(frame), frame).count() == 1
