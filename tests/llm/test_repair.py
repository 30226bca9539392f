"""Conversation repair: brute force over scripts, chunks against alignment, odd rows, SQL."""

import hashlib
import random
import re

from ridgeline.llm import repair

ROLES = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Cheapest, then least, script over (role initial, must go, cut off) by trying all."""
    best = None

    def go(i, out, cost, audit, inserted):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", out):
            best = min(best or (cost, audit), (cost, audit))
        if inserted < 3:
            for c in "ua":
                follow(i, out + c, cost + 3, audit + "I", inserted + 1)
        if i < len(rows):
            kind, forced, cut = rows[i]
            go(i + 1, out, cost + 4, audit + "D", 0)
            if not forced:
                if kind in "sua":
                    follow(i + 1, out + kind, cost + 3 * cut, audit + "K", 0)
                for c in "ua":
                    follow(i + 1, out + c, cost + 3 + 3 * cut, audit + "R", 0)

    def follow(i, out, *rest):
        if re.fullmatch("s?(ua)*u?", out):
            go(i, out, *rest)

    go(0, "", 0, "", 0)
    return best


def made(n, seed, kinds="suuaax"):
    r = random.Random(seed)
    rows = [(r.choice(kinds), r.random() < 0.25, r.random() < 0.3) for _ in range(n)]
    return [(k, f, c and not f) for k, f, c in rows]


def codes(rows):
    return bytes(repair.code(ROLES[k], f, False, c) for k, f, c in rows)


def test_alignment_equals_brute_force():
    for seed in range(400):
        rows = made(1 + seed % 6, seed)
        assert repair.align(codes(rows)) == brute(rows), rows


def test_chunks_equal_alignment():
    for seed, n in enumerate((1, 2, 9, 40, 90)):
        turns = list(codes(made(n, seed, "suaua")))
        cuts = sorted(random.Random(seed).sample(range(n + 1), min(3, n)))
        parts = [turns[a:b] for a, b in zip([0, *cuts], [*cuts, n])]
        ends = [list(repair._END)]
        for part in reversed(parts):
            ends.insert(0, repair._back(part, ends[0])[0].tolist())
        state, audit = 0, ""
        for part, end in zip(parts, ends[1:]):
            for op, state in repair._forth(part, repair._back(part, end), state):
                audit += op
        assert repair.align(bytes(turns)) == (ends[0][0], audit + repair._closing(state))


def conversations():
    r = random.Random(11)
    rows = []
    for conv in range(12):
        for turn in range(r.randrange(1, 30)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = r.choice(["Yes.", "no", " ", "", None, "What? \n", f"t{turn}!", "é…", "x " * 300 + "."])
            rows.append((conv, r.choice([turn, turn, turn, None, 3]), role, text))
    rows += [(None, 1, "user", "Hi."), (None, 2, "user", "Hi."), (None, 3, "assistant", "Hi.")]
    rows += [(99, 5, "user", "Again.")] * 400 + [(99, None, "assistant", "")] * 200
    return rows


def facts(rows):
    return {r.conv: tuple(r)[2:] for r in rows}


def test_long_conversations_equal_short_ones(spark):
    data = spark.createDataFrame(conversations(), SCHEMA)
    data = data.selectExpr("*", "1 as place", "'x' as print", "0 as chunk")
    short = facts(repair.summaries(repair.repair(data, most_turns=10_000)).collect())
    long = facts(repair.summaries(repair.repair(data.repartition(5), most_turns=6)).collect())
    assert short == long and len(short) == 14


def test_edits_give_the_repaired_text(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello"), (1, 1, "user", "Hello"), (1, 2, "user", "And?"), (1, 4, "assistant", "Yes.")]
    edits = repair.repair(spark.createDataFrame(rows, SCHEMA))
    found = edits.orderBy("place").collect()
    assert "".join(r.op for r in found) == "KDDKK"
    assert [r.fault for r in found] == ["", "truncated", "duplicate", "", ""]
    text = "\n".join(f"{r.role}:{r.text}" for r in found if r.op != "D")
    row = repair.summaries(edits).first()
    assert (row.gaps, row.blank, row.duplicate, row.truncated, row.illegal, row.cost) == (1, 0, 1, 1, 2, 8)
    assert row.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_audit_keeps_every_id(spark):
    # crc32("4:0") % 20 == 0 is looked for, so that a conversation loses all its rows.
    import zlib

    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    data = spark.createDataFrame([(gone, 0, "user", "Hi."), (None, 7, None, None)], SCHEMA)
    rows = {r.conv_id: r for r in repair.audit(data).collect()}
    assert set(rows) == {gone, None}
    assert (rows[gone].cost, rows[gone].audit) == (0, "")
    assert rows[gone].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert repair.audit(data.limit(0)).count() == 0
