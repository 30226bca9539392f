"""Repair of conversations whose turns are damaged: the cheapest edits to ``(s?(ua)+)?``.

Turns are kept (0), given the role user or assistant (3), deleted (4) or inserted (3, empty
text); a truncated turn that stays costs 3 more, a blank or repeated one must go. Each
possible length of the alternating target is aligned with the turns by dynamic programming
over (turn, target place) from the end. The cost of the best alignment so far bounds how far
a later one may stray from the diagonal and which lengths are worth a try at all. Among the
cheapest, backtracing takes the least letter at each place, so that audits of different
lengths are compared as strings.

A conversation with more than ``MOST_TURNS`` turns, or more than ``MOST_BYTES`` of text, is not
held by one task. Its turns are sorted by range into chunks. Because the target alternates,
a chunk is described by 4 x 4 costs between what may come next before and after it; those are
chained, and every chunk then finds its own edits. That is exact and gives the same audits
(tests compare both ways), so the bound decides only which way is taken. Aligning all lengths
of such a conversation would cost the square of its turns, which is why the chunks do not.

Turns are taken by ``turn`` (nulls first), then role, then a hash of role and text. The first
letter of a role tells system, user and assistant; a turn of another role, or of none, cannot
be kept as it is.

Defined cases: null roles and texts are one space (so a null text is blank); rows with a null
conversation id are one conversation; repeated rows are repeated turns; an empty table gives
an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ridgeline.workdir import new_run_dir, write_table

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
MOST_TURNS = 128
MOST_BYTES = 32 << 20
#: Characters at the end of a text that say nothing.
_BLANKS = " \t\n\v\f\r"
_SYSTEM, _USER, _ASSISTANT, _OTHER = range(4)
_KIND = {"s": _SYSTEM, "u": _USER, "a": _ASSISTANT}
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
_FAR = 1 << 40
#: What came last: nothing, the system turn, a user turn, an assistant turn.
_STATES = 4
#: The state that a user or assistant turn leads to, which is also the kind that is due.
_DUE = (_USER, _USER, _ASSISTANT, _USER)
_AFTER = (2, 2, 3, 2)
#: Least inserts that make the conversation complete.
_END = (0, 2 * INSERT, INSERT, 0)


def code(role: str, blank: bool, duplicate: bool, truncated: bool) -> int:
    """A turn as one small number: its kind, whether it must go, whether it is cut off."""
    forced = blank or duplicate
    return _KIND.get(role[:1], _OTHER) | forced << 2 | (truncated and not forced) << 3


def _target(length: int) -> np.ndarray:
    """Kinds of the target of a length: a system turn first if the length is odd."""
    kinds = np.where(np.arange(length) % 2 == length % 2, _USER, _ASSISTANT)
    if length % 2:
        kinds[0] = _SYSTEM
    return kinds


def _align(codes: np.ndarray, length: int, most: int) -> tuple[int, str | None]:
    """Least cost of turning the turns into the target of ``length``, with its least audit.

    Only places whose distance from the diagonal can be paid with ``most`` are computed; the
    audit is None if the cost is above it.
    """
    n, forced = len(codes), int(((codes & 4) > 0).sum())
    surplus = length - n
    if max(forced, -surplus) * DELETE + (surplus + max(forced, -surplus)) * INSERT > most:
        return _FAR, None
    deletes = (most - INSERT * surplus) // (DELETE + INSERT)
    inserts = surplus + deletes
    offsets = np.arange(-deletes, inserts + 1)
    target = _target(length)
    padded = np.append(target, _OTHER + 1)
    steps = INSERT * np.arange(len(offsets))
    costs = np.full((n + 1, len(offsets)), _FAR, dtype=np.int64)

    def finish(row: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Inserts before the next turn: each costs a step to the right, none makes a system turn."""
        inside = (places >= 0) & (places <= length)
        row = np.where(inside, row, _FAR)
        best = np.minimum.accumulate((row + steps)[::-1])[::-1] - steps
        if length % 2:
            best = np.where(places == 0, row, best)
        return np.where(inside, best, _FAR)

    places = n + offsets
    costs[n] = finish(np.where(places == length, 0, _FAR), places)
    for i in range(n - 1, -1, -1):
        places = i + offsets
        row = np.full(len(offsets), _FAR, dtype=np.int64)
        row[1:] = costs[i + 1, :-1] + DELETE
        if not codes[i] & 4:
            due = padded[np.clip(places, 0, length)]
            change = np.where(due == (codes[i] & 3), KEEP, np.where((due == _USER) | (due == _ASSISTANT), REROLE, _FAR))
            row = np.minimum(row, costs[i + 1] + change + CUT * (codes[i] >> 3))
        costs[i] = finish(row, places)
    cost = int(costs[0, deletes])
    if cost > most:
        return cost, None
    audit, i, j = [], 0, 0
    while i < n or j < length:
        at = j - i + deletes
        here = costs[i, at]
        if i < n and at > 0 and costs[i + 1, at - 1] + DELETE == here:
            letter = "D"
        elif j < length and target[j] != _SYSTEM and at + 1 < len(offsets) and costs[i, at + 1] + INSERT == here:
            letter = "I"
        else:
            letter = "K" if target[j] == codes[i] & 3 else "R"
        audit.append(letter)
        i += letter != "I"
        j += letter != "D"
    return cost, "".join(audit)


def align(codes: bytes) -> tuple[int, str]:
    """Cost and audit of the cheapest edits: all target lengths, the likeliest first."""
    turns = np.frombuffer(codes, dtype=np.uint8).astype(np.int64)
    best = len(turns) * DELETE, "D" * len(turns)
    likely = len(turns) - int(((turns & 4) > 0).sum())
    for length in sorted(range(2, 2 * len(turns) + 4 + best[0] // INSERT), key=lambda x: abs(x - likely)):
        if (length - likely) * INSERT > best[0]:
            break
        cost, audit = _align(turns, length, best[0])
        if audit is not None:
            best = min(best, (cost, audit))
    return best


@lru_cache(maxsize=1 << 16)
def _align_short(codes: bytes) -> tuple[int, str]:
    return align(codes)


def replay(ops: Iterable[str], roles: Iterator[str], state: int = 0) -> Iterator[tuple[str, str]]:
    """(edit, role afterwards) for each letter of an audit; ``roles`` are the turns' own."""
    for op in ops:
        if op == "D":
            yield op, next(roles)
            continue
        kind = _DUE[state]
        if op == "K":
            role = next(roles)
            kind = _KIND[role[:1]]
        else:
            role = _ROLE[kind]
            if op == "R":
                next(roles)
        state = kind + 1
        yield op, role


# --- chunks of long conversations ---------------------------------------------


def _back(codes: list[int], ending: list[int]) -> np.ndarray:
    """Least cost from before each turn to the chunk's end, per state; ``ending`` is what follows."""
    found = np.empty((len(codes) + 1, _STATES), dtype=np.int64)
    found[len(codes)] = later = list(ending)
    for i in range(len(codes) - 1, -1, -1):
        now = [x + DELETE for x in later]
        if not codes[i] & 4:
            kind, cut = codes[i] & 3, CUT * (codes[i] >> 3)
            for state in range(_STATES):
                now[state] = min(now[state], later[_AFTER[state]] + cut + (0 if kind == _DUE[state] else REROLE))
            if kind == _SYSTEM:
                now[0] = min(now[0], later[1] + cut)
        for _ in range(_STATES - 1):
            now = [min(now[state], now[_AFTER[state]] + INSERT) for state in range(_STATES)]
        found[i] = later = now
    return found


def _forth(codes: list[int], costs: np.ndarray, state: int) -> Iterator[tuple[str, int]]:
    """The least letters along the least costs, each with the state after it."""
    for i, turn in enumerate(codes):
        op = "I"
        while op == "I":
            here, kind, cut = costs[i, state], turn & 3, CUT * (turn >> 3)
            if costs[i + 1, state] + DELETE == here:
                op = "D"
            elif costs[i, _AFTER[state]] + INSERT == here:
                state = _AFTER[state]
            elif kind == _SYSTEM and state == 0 and costs[i + 1, 1] + cut == here:
                op, state = "K", 1
            else:
                op, state = "K" if kind == _DUE[state] else "R", _AFTER[state]
            yield op, state


def _closing(state: int) -> str:
    return "I" * (_END[state] // INSERT)


# --- DataFrames -----------------------------------------------------------------

_EDITS = "op string, turn long, own_role string, role string, text string, fault string"


def _order() -> list:
    return [F.asc_nulls_first("turn"), "role", "print"]


def _conv_key(conv_id: Column) -> Column:
    """A text that is not null and tells every id apart, null included."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def prepared(conversations: DataFrame) -> DataFrame:
    """(conv, conv_id, turn, role, text, print, blank, truncated) with nulls replaced."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit(" ")) for c in ("role", "text"))
    body = F.rtrim(F.col("text"), F.lit(_BLANKS))
    return (
        conversations.select(
            _conv_key(conversations["conv_id"]).alias("conv"), conversations["conv_id"].alias("conv_id"),
            conversations["turn"].cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        )
        .withColumn("print", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
        .withColumn("blank", body == "")
        .withColumn("truncated", (body != "") & ~F.right(body, F.lit(1)).isin(".", "!", "?"))
    )


def _fault(blank: bool, duplicate: bool, truncated: bool) -> str:
    return "blank" if blank else "duplicate" if duplicate else "truncated" if truncated else ""


def _edit_schema(rows: DataFrame) -> str:
    return f"conv string, conv_id {rows.schema['conv_id'].dataType.simpleString()}, place long, {_EDITS}"


def _batch(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)


def _arrow_schema(conv_type: pa.DataType) -> pa.Schema:
    kinds = [pa.string(), conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    names = ["conv", "conv_id", "place", *(x.split()[0] for x in _EDITS.split(", "))]
    return pa.schema(list(zip(names, kinds)))


def _edit_short(rows: DataFrame) -> DataFrame:
    """Edits of conversations that one task may hold."""
    fields = ["conv", "conv_id", "turn", "role", "text", "print", "blank", "truncated"]

    def edits(turns: list[tuple]) -> Iterator[tuple]:
        seen, codes, faults = set(), [], []
        for _, _, _, role, _, same, blank, truncated in turns:
            codes.append(code(role, blank, same in seen, truncated))
            faults.append(_fault(blank, same in seen, truncated))
            seen.add(same)
        _, audit = (_align_short if len(codes) <= 64 else align)(bytes(codes))
        conv, conv_id, at = turns[0][0], turns[0][1], 0
        for place, (op, role) in enumerate(replay(audit, iter([t[3] for t in turns]))):
            if op == "I":
                yield conv, conv_id, place, op, None, None, role, "", ""
            else:
                turn = turns[at]
                yield conv, conv_id, place, op, turn[2], turn[3], role, turn[4], faults[at]
                at += 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            schema, out = _arrow_schema(batch.schema.field("conv_id").type), []
            for row in zip(*(batch.column(c).to_pylist() for c in fields)):
                if held and held[0][0] != row[0]:
                    out += edits(held)
                    held = []
                    if len(out) > 10_000:
                        yield _batch(out, schema)
                        out = []
                held.append(row)
            if out:
                yield _batch(out, schema)
        if held:
            yield _batch(list(edits(held)), schema)

    dealt = rows.select(*fields).repartition("conv").sortWithinPartitions("conv", *_order())
    return dealt.mapInArrow(task, _edit_schema(rows))


def _edit_long(rows: DataFrame) -> DataFrame:
    """Edits of long conversations, chunk by chunk; no task holds more than a chunk's turns."""
    spark = rows.sparkSession
    # Equal turns are one row with a count: all but the first of them must go.
    equal = rows.groupBy("conv", "conv_id", "turn", "role", "print", "blank", "truncated").agg(
        F.any_value("text").alias("text"), F.count(F.lit(1)).alias("copies")
    )
    written = write_table(
        equal.repartitionByRange("conv", *_order())
        .sortWithinPartitions("conv", *_order())
        .withColumn("place", F.monotonically_increasing_id())
        .withColumn("chunk", F.shiftright("place", 33)),
        new_run_dir(spark, "repair-turns"),
    )
    first = written.groupBy("conv", "print").agg(F.min("place").alias("first"))
    turns = written.join(first, ["conv", "print"]).withColumn("duplicate", F.col("place") > F.col("first"))
    turns = write_table(turns.drop("first"), new_run_dir(spark, "repair-marked"))
    narrow = ["conv", "chunk", "place", "role", "blank", "duplicate", "truncated", "copies"]

    def coded(rows: Iterable[tuple]) -> list[int]:
        """Codes of a chunk; further copies of a turn are one more number each."""
        codes = []
        for role, blank, duplicate, truncated, copies in rows:
            codes.append(code(role, blank, duplicate, truncated))
            codes.extend([code(role, blank, True, False)] * (copies - 1))
        return codes

    def by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:2] != row[:2]:
                    yield held
                    held = []
                held.append(row)
        if held:
            yield held

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", "place")

    def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Costs between the states before and after each chunk."""
        for rows in by_chunk(batches):
            codes = coded(r[3:] for r in rows)
            costs = [_back(codes, [0 if s == end else _FAR for s in range(_STATES)])[0] for end in range(_STATES)]
            flat = np.concatenate(costs).tolist()
            yield pa.RecordBatch.from_pydict({"conv": [rows[0][0]], "chunk": [rows[0][1]], "costs": [flat]})

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each chunk is followed by, from the last chunk of a conversation to the first."""
        conv, ending = None, []
        for batch in batches:
            for name, chunk, costs in zip(*(c.to_pylist() for c in batch.columns)):
                last = name != conv
                if last:
                    conv, ending = name, list(_END)
                yield pa.RecordBatch.from_pydict({"conv": [name], "chunk": [chunk], "ending": [ending], "last": [last]})
                cost = np.array(costs, dtype=np.int64).reshape(_STATES, _STATES)  # [after, before]
                ending = (cost + np.array(ending)[:, None]).min(axis=0).tolist()

    def leaving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state after each chunk for every state before it."""
        for rows in by_chunk(batches):
            codes = coded(r[3:8] for r in rows)
            costs = _back(codes, rows[0][8])
            ends = []
            for state in range(_STATES):
                for _, state in _forth(codes, costs, state):
                    pass
                ends.append(state)
            yield pa.RecordBatch.from_pydict({"conv": [rows[0][0]], "chunk": [rows[0][1]], "ends": [ends]})

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, 0
        for batch in batches:
            for name, chunk, ends in zip(*(c.to_pylist() for c in batch.columns)):
                conv, state = name, state if name == conv else 0
                yield pa.RecordBatch.from_pydict({"conv": [name], "chunk": [chunk], "entry": [state]})
                state = ends[state]

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for rows in by_chunk(batches):
            schema = schema or _arrow_schema(conv_type)
            codes = coded(r[3:8] for r in rows)
            ending, last, entry = rows[0][8:11]
            conv_id, conv = rows[0][13], rows[0][0]
            state, out, at, copy, place = entry, [], 0, 0, rows[0][2]

            def walked():
                nonlocal state
                for op, state in _forth(codes, _back(codes, ending), state):
                    yield op, state
                if last:
                    for op in _closing(state):
                        state = _AFTER[state]
                        yield op, state

            for op, after in walked():
                role = _ROLE.get(after - 1)
                if op == "I":
                    out.append((conv, conv_id, place, op, None, None, role, "", ""))
                else:
                    row = rows[at]
                    fault = _fault(row[4], row[5] or copy > 0, row[6])
                    out.append((conv, conv_id, place, op, row[11], row[3], row[3] if op in "DK" else role, row[12], fault))
                    copy += 1
                    if copy == row[7]:
                        at, copy = at + 1, 0
                place += 1
                if len(out) >= 10_000:
                    yield _batch(out, schema)
                    out = []
            if out:
                yield _batch(out, schema)

    conv_type = to_arrow_type(rows.schema["conv_id"].dataType)
    costs = dealt(turns.select(*narrow)).mapInArrow(crossing, "conv string, chunk long, costs array<long>")
    endings = write_table(
        costs.repartition("conv").sortWithinPartitions("conv", F.desc("chunk"))
        .mapInArrow(backward, "conv string, chunk long, ending array<long>, last boolean"),
        new_run_dir(spark, "repair-endings"),
    )
    ends = dealt(turns.select(*narrow).join(endings.drop("last"), ["conv", "chunk"]).select(*narrow, "ending")).mapInArrow(
        leaving, "conv string, chunk long, ends array<long>"
    )
    entries = ends.repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(
        forward, "conv string, chunk long, entry long"
    )
    known = write_table(endings.join(entries, ["conv", "chunk"]), new_run_dir(spark, "repair-chunks"))
    ready = turns.join(known, ["conv", "chunk"]).select(*narrow, "ending", "last", "entry", "turn", "text", "conv_id")
    return dealt(ready).mapInArrow(edited, _edit_schema(rows))


def repair(conversations: DataFrame, most_turns: int = MOST_TURNS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Edits of all conversations (conv_id, turn, role, text), one row each.

    Returns (conv, conv_id, place, op, turn, own_role, role, text, fault): ``op`` is K, R, D or I,
    ``place`` orders the edits of a conversation, ``role`` is the role afterwards and
    ``own_role`` the turn's own; the repaired conversation is the rows without D.
    """
    rows = prepared(conversations)
    sizes = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = sizes.where((F.col("n") > most_turns) | (F.col("bytes") > most_bytes)).select("conv")
    long = write_table(long, new_run_dir(rows.sparkSession, "repair-long"))
    if long.isEmpty():
        return _edit_short(rows)
    return _edit_short(rows.join(long, "conv", "left_anti")).unionByName(_edit_long(rows.join(long, "conv", "left_semi")))


def summaries(edits: DataFrame) -> DataFrame:
    """Per conversation: faults, gaps, cost, audit and the hash of the repaired text.

    Edits stream by in order; of a conversation only its audit, its last turn and the state of
    the hash are held. The hash is over the text in its order, so one task reads it.
    """
    kind = edits.schema["conv_id"].dataType.simpleString()
    fields = ["conv", "conv_id", "op", "turn", "own_role", "role", "text", "fault"]
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = f"conv string, conv_id {kind}, {', '.join(f'{x} long' for x in numbers)}, audit string, repaired_sha256 string"
    price = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = None

        def begin(row):
            return {
                "conv_id": row[1], "audit": [], "sha": hashlib.sha256(), "kept": 0, "cost": 0, "blank": 0, "duplicate": 0,
                "truncated": 0, "illegal": 0, "turns": 0, "first": None, "last": None, "before": None,
            }

        def take(held, row):
            _, _, op, turn, own, role, text, fault = row
            held["audit"].append(op)
            held["cost"] += price[op] + (CUT if fault == "truncated" and op in "KR" else 0)
            if op != "I":
                if fault:
                    held[fault] += 1
                if held["before"] is not None and held["before"][:1] + own[:1] not in ("su", "ua", "au"):
                    held["illegal"] += 1
                held["before"] = own
                if turn is not None:
                    held["turns"] += turn != held["last"]
                    held["first"] = turn if held["first"] is None else held["first"]
                    held["last"] = turn
            if op != "D":
                held["sha"].update((f"\n{role}:{text}" if held["kept"] else f"{role}:{text}").encode())
                held["kept"] += 1

        def end(conv, held):
            span = held["last"] - held["first"] + 1 if held["first"] is not None else 0
            counted = [span - held["turns"], *(held[x] for x in numbers[1:])]
            return conv, held["conv_id"], *counted, "".join(held["audit"]), held["sha"].hexdigest()

        for batch in batches:
            out, conv_type = [], batch.schema.field("conv_id").type
            kinds = [pa.string(), conv_type, *[pa.int64()] * len(numbers), pa.string(), pa.string()]
            names = pa.schema(list(zip(["conv", "conv_id", *numbers, "audit", "repaired_sha256"], kinds)))
            for row in zip(*(batch.column(c).to_pylist() for c in fields)):
                if row[0] != conv:
                    if conv is not None:
                        out.append(end(conv, held))
                    conv, held = row[0], begin(row)
                take(held, row)
            if out:
                yield _batch(out, names)
        if conv is not None:
            yield _batch([end(conv, held)], names)

    dealt = edits.repartition("conv").sortWithinPartitions("conv", "place")
    return dealt.select(*fields).mapInArrow(task, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """The conversations with faults put in by a hash of (conv_id, turn): turns dropped, emptied,
    stripped of their sentence ends, repeated, or said by the user."""
    conv_id, turn = conversations["conv_id"], conversations["turn"]
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit(" ")) for c in ("role", "text"))
    name = F.concat(F.coalesce(conv_id.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    fate = F.col("fate")
    return (
        conversations.select(conv_id.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(name) % 20).alias("fate"))
        .where(fate != 0)
        .select(
            "conv_id", "turn", F.when(fate == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
            F.when(fate == 1, F.lit("")).when(fate == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
            F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
        .drop("copy")
    )


def audit(conversations: DataFrame) -> DataFrame:
    """``summaries`` of the repaired ``damaged`` conversations, with a row for every original id."""
    found = summaries(repair(damaged(conversations)))
    ids = conversations.select(_conv_key(conversations["conv_id"]).alias("conv"), conversations["conv_id"].alias("conv_id"))
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    nothing = hashlib.sha256(b"").hexdigest()
    return ids.distinct().join(found.drop("conv_id"), "conv", "left").select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
