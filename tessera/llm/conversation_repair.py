"""Conversation structure repair: faults of each conversation's turns, and the cheapest edits that mend it.

The rows are put into the order (conversation, turn, role, text) over range partitions, so one
conversation may lie in many tasks. A task walks its rows once: a conversation that begins and ends
inside is repaired at once by the auction algorithm of ``auction``; what crosses a task's border, or is over
``TURNS`` turns or ``CHARS`` characters, becomes segments. Each segment is condensed to its 16 costs between
states; per conversation the auction over these gives the prices at the borders (one narrow row for
each segment meets in a task); all segments are then traced in parallel for each state they may be entered
in, and the last step walks them in order, carrying the state, the letters and a running
SHA-256. Only that hash and the letters, each one value of the result, need a whole conversation in one
task, a segment at a time.

Edge cases: a null role or text is one space (in the damage's key too), so the row is blank or of no known
initial; null turns come first; rows of one turn are in order of their role, then of a hash of their
text; equal rows are duplicates but for one; a null conversation id is a conversation; one that
has lost all rows gives zeros, no edits and the hash of nothing; an empty table gives no rows. Roles and texts
are told apart by a 64-bit hash within a conversation. Further columns are not read, whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import named
from tessera.llm import auction
from tessera.llm.store import stored

#: Largest segment: turns, and characters but for its last turn.
TURNS, CHARS = 512, 1 << 20
#: Rows that are handed on at once, and their characters at most.
OUT_ROWS, OUT_CHARS = 256, 1 << 22
#: The places of the damage: of 20, those that drop, empty, strip ends, repeat, make a user.
DROP, EMPTY, STRIP, REPEAT, USER = range(5)
PLACES = 20
#: White space, and the characters that end a whole turn (fixed values).
BLANKS, ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")

_TOLD = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_RESULT = "conv_id long, " + ", ".join(f"{c} long" for c in _TOLD) + ", audit string, repaired_sha256 string"
_SEGMENT = (_RESULT + ", whole boolean, seq long, no_turn boolean, turn long, role string, h long, turns long, low long, "
            "high long, first string, last string, codes string, roles array<string>, texts array<string>, costs array<long>")
_KEY = ["conv_id", "turn", "role", "h", "seq"]


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage; a dropped row stays, marked ``gone``, for its conversation's sake."""
    some = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    conv, turn = named("conv_id"), named("turn")
    place = F.pmod(F.crc32(F.concat(some(conv), F.lit(":"), some(turn))), F.lit(PLACES))
    out = rows.select(conv.cast("long").alias("conv_id"), turn.cast("long").alias("turn"), some(named("role")).alias("role"),
                      some(named("text")).alias("text"), place.alias("place"))
    text = F.when(F.col("place") == EMPTY, "").when(F.col("place") == STRIP, F.translate("text", "".join(ENDS), "")).otherwise(
        F.col("text"))
    role = F.when(F.col("place") == USER, "user").otherwise(F.col("role"))
    out = out.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("place") == DROP).alias("gone"), "place")
    times = F.array_repeat(F.lit(0), F.when(F.col("place") == REPEAT, 2).otherwise(1))
    return out.withColumn("copy", F.explode(times)).drop("place", "copy")


def undamaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` as they are, for ``repair``."""
    some = lambda c: F.coalesce(named(c), F.lit(" ")).alias(c)
    return rows.select(*(named(c).cast("long").alias(c) for c in ("conv_id", "turn")), some("role"), some("text"),
                       F.lit(False).alias("gone"))


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` with ``fault``: blank, duplicate (of an earlier row), truncated, or none of them (empty)."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    rows = rows.withColumn("h", F.xxhash64("role", "text")).withColumn("seq", F.monotonically_increasing_id())
    rows = stored(rows.withColumn("end", F.substring(bare, -1, 1)), "turns")
    # Only what occurs again is looked up; its first row in order is no duplicate.
    place = F.struct("turn", "seq")
    again = rows.filter(~F.col("gone")).groupBy("conv_id", "role", "h").agg(
        F.min(place).alias("earliest"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.col("conv_id").alias("conv_id_"), F.col("role").alias("role_"), F.col("h").alias("h_"), "earliest")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in ("conv_id", "role", "h")]
    told = rows.join(again, same, "left").select(*rows.columns, "earliest")
    late = F.coalesce(F.struct("turn", "seq") > F.col("earliest"), F.lit(False))
    fault = F.when(F.col("end") == "", "blank").when(late, "duplicate").when(
        ~F.col("end").isin(*ENDS), "truncated").otherwise("")
    return told.withColumn("fault", fault).drop("end", "earliest")


def _code(role: str, fault: str) -> str:
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return initial.upper() if fault in ("blank", "duplicate") else initial + ("+" if fault == "truncated" else "")


class _Out:
    """Rows of a schema, given out as record batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.chars = schema, [], 0

    def add(self, row: dict, chars: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.chars += chars
        if len(self.rows) >= OUT_ROWS or self.chars >= OUT_CHARS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_pylist(self.rows, self.schema)
        self.rows, self.chars = [], 0


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


class _Segment:
    """Turns of one conversation that follow each other, and what is told of them."""

    def __init__(self, row: dict):
        self.row = {"conv_id": row["conv_id"], "seq": row["seq"], "no_turn": row["turn"] is None, "turn": row["turn"] or 0,
                    "role": row["role"], "h": row["h"], "turns": 0, "low": 0, "high": 0, "first": "", "last": "",
                    **dict.fromkeys(_TOLD, 0)}
        self.codes, self.roles, self.texts, self.chars = [], [], [], 0

    def add(self, row: dict) -> None:
        told, role, turn = self.row, row["role"], row["turn"]
        if row["gone"]:
            return
        if row["fault"]:
            told[row["fault"]] += 1
        if self.roles:
            told["illegal"] += _illegal(self.roles[-1], role)
        if turn is not None and (not told["turns"] or turn != told["high"]):
            told["low"] = turn if not told["turns"] else told["low"]
            told["high"] = turn
            told["turns"] += 1
        self.codes.append(_code(role, row["fault"]))
        self.roles.append(role)
        self.texts.append(row["text"])
        self.chars += len(row["text"])

    def result(self, whole: bool) -> dict:
        told = self.row
        if whole:
            told["gaps"] = told["high"] - told["low"] + 1 - told["turns"] if told["turns"] else 0
            told["cost"], told["audit"] = auction.repair(tuple(self.codes))
            lines, _ = auction.repaired(told["audit"], self.roles, self.texts)
            told["repaired_sha256"] = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        else:
            told.update(first=self.roles[0][:1] if self.roles else None, last=self.roles[-1][:1] if self.roles else None,
                        codes=" ".join(self.codes), roles=self.roles, texts=self.texts,
                        costs=list(auction.distances(tuple(self.codes))))
        return {**told, "whole": whole}


def _illegal(a: str, b: str) -> int:
    return int(a[:1] + b[:1] not in ("su", "ua", "au"))


def _walk(schema: pa.Schema, turns: int, chars: int):
    """Whole conversations with their repair, and segments of those that may go on in other tasks."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, inside = _Out(schema), None, False  # inside: all rows of the conversation so far are in ``now``
        for batch in batches:
            for row in batch.to_pylist():
                if now is None or now.row["conv_id"] != row["conv_id"]:
                    if now is not None:
                        yield from out.add(now.result(inside), now.chars)
                    inside, now = now is not None, _Segment(row)
                elif len(now.codes) >= turns or now.chars >= chars:
                    yield from out.add(now.result(False), now.chars)
                    inside, now = False, _Segment(row)
                now.add(row)
        if now is not None:
            yield from out.add(now.result(False), now.chars)
        yield from out.flush()
    return walk


_PLAN = "seq long, idx long, exits array<long>, " + ", ".join(f"{c} long" for c in _TOLD[:-1])


def _plan(parts: pd.DataFrame) -> pd.DataFrame:
    """The prices after each of a conversation's segments, and the conversation's faults (on the first)."""
    parts = parts.sort_values(["not_null", "turn", "role", "h", "seq"])
    prices = auction.boundary_prices([tuple(int(x) for x in c) for c in parts["costs"]])
    told = {c: int(parts[c].sum()) for c in ("blank", "duplicate", "truncated", "illegal")}
    before, spans, distinct = None, [], 0
    for first, last, n, low, high in zip(*(parts[c] for c in ("first", "last", "turns", "low", "high"))):
        if first is not None:
            told["illegal"] += before is not None and _illegal(before, first)
            before = last
        if n:
            distinct += int(n) - (bool(spans) and spans[-1] == int(low))
            spans += [int(low), int(high)]
    told["gaps"] = spans[-1] - spans[0] + 1 - distinct if spans else 0
    first = range(len(parts))
    return pd.DataFrame({"seq": parts["seq"].to_numpy(), "idx": list(first), "exits": prices,
                         **{c: [int(told[c]) if i == 0 else 0 for i in first] for c in _TOLD[:-1]}})


_TRACED = ("conv_id long, idx long, codes string, roles array<string>, texts array<string>, letters array<string>, "
           "ends array<long>, " + ", ".join(f"{c} long" for c in _TOLD[:-1]))


def _trace(schema: pa.Schema):
    """Letters of each segment and the state after it, for every state that it may be entered in."""
    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                codes, exits = tuple(r["codes"].split()), tuple(r.pop("exits"))
                found = auction.segment_traces(codes, exits)
                r["letters"], r["ends"] = [x for x, _ in found], [e for _, e in found]
            yield pa.RecordBatch.from_pylist(rows, schema)
    return trace


def _letters_cost(letters: str, codes: list[str]) -> int:
    cost, at = 0, 0
    for x in letters:
        if x == "I":
            cost += auction.INSERT
            continue
        cost += {"D": auction.DELETE, "K": auction.KEEP, "R": auction.REROLE}[x]
        cost += auction.TRUNCATED if x != "D" and codes[at].endswith("+") else 0
        at += 1
    return cost


class _Follower:
    """One conversation's segments in their order: state, letters, cost and running hash."""

    def __init__(self, row: dict):
        self.row = {c: row[c] for c in ("conv_id", *_TOLD[:-1])}
        self.state, self.letters, self.cost, self.hash, self.lines = auction.START, [], 0, hashlib.sha256(), 0

    def take(self, letters: str, codes: list[str], roles: list[str], texts: list[str]) -> None:
        lines, self.state = auction.repaired(letters, roles, texts, self.state)
        for line in lines:
            self.hash.update((b"\n" if self.lines else b"") + line.encode())
            self.lines += 1
        self.cost += _letters_cost(letters, codes)
        self.letters.append(letters)

    def result(self) -> dict:
        self.take(auction.end_trace(self.state), [], [], [])
        return {**self.row, "cost": self.cost, "audit": "".join(self.letters), "repaired_sha256": self.hash.hexdigest()}


def _follow(schema: pa.Schema):
    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now = _Out(schema), None
        for batch in batches:
            for r in batch.to_pylist():
                if now is None or now.row["conv_id"] != r["conv_id"]:
                    if now is not None:
                        yield from out.add(now.result(), len(now.letters))
                    now = _Follower(r)
                now.take(r["letters"][now.state], r["codes"].split(), r["roles"], r["texts"])
        if now is not None:
            yield from out.add(now.result(), 0)
        yield from out.flush()
    return follow


def repair(rows: DataFrame, turns: int = TURNS, chars: int = CHARS) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation.

    ``rows``: conv_id, turn, role, text, gone (of ``damaged`` or ``undamaged``).
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = with_faults(rows).repartitionByRange(n, *_KEY).sortWithinPartitions(*_KEY)
    walked = stored(dealt.mapInArrow(_walk(_arrow(spark, _SEGMENT), turns, chars), _SEGMENT), "conversations")
    whole = walked.filter("whole").select("conv_id", *_TOLD, "audit", "repaired_sha256")
    pieces = walked.filter("NOT whole")
    narrow = pieces.select("conv_id", (~F.col("no_turn")).alias("not_null"), "turn", "role", "h", "seq", "turns", "low", "high",
                           "first", "last", "costs", *_TOLD[1:-1])
    plan = narrow.groupBy("conv_id").applyInPandas(_plan, _PLAN)
    traced = pieces.select("conv_id", "seq", "codes", "roles", "texts").join(plan, "seq").drop("seq").mapInArrow(
        _trace(_arrow(spark, _TRACED)), _TRACED)
    followed = traced.repartition(n, "conv_id").sortWithinPartitions("conv_id", "idx").mapInArrow(
        _follow(_arrow(spark, _RESULT)), _RESULT)
    return whole.unionByName(followed)
