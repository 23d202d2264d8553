"""Conversation repair against a plain search over all edits."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from _oracle import connect
from conftest import SF_SMALL
from tessera.llm import auction, conversation_repair, queries

_BLANK = " \t\n\x0b\x0c\r"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _damage(rows):
    for conv, turn, role, text in rows:
        some = lambda x: " " if x is None else str(x)
        role, text = some(role), some(text)
        place = zlib.crc32(f"{some(conv)}:{some(turn)}".encode()) % 20
        if place == 1:
            text = ""
        if place == 2:
            text = re.sub("[.!?]", "", text)
        if place == 4:
            role = "user"
        for _ in range(0 if place == 0 else 2 if place == 3 else 1):
            yield conv, turn, role, text


def _search(turns):
    """Least (cost, letters) by Dijkstra over (turns consumed, roles so far); ``turns``: initial, must go, truncated."""
    states = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "")], set()
    while True:
        cost, letters, i, state = heapq.heappop(heap)
        if i == len(turns) and state in ("", "a"):
            return cost, letters
        if (i, state) in done:
            continue
        done.add((i, state))
        for r in states[state].replace("s", ""):
            heapq.heappush(heap, (cost + 2, letters + "I", i, r))
            if i < len(turns) and not turns[i][1]:
                heapq.heappush(heap, (cost + 2 + turns[i][2], letters + "R", i + 1, r))
        if i < len(turns):
            initial, gone, cut = turns[i]
            heapq.heappush(heap, (cost + 3, letters + "D", i + 1, state))
            if not gone and initial and initial in states[state]:
                heapq.heappush(heap, (cost + cut, letters + "K", i + 1, initial))


def _expected(rows, damage=True):
    convs = {r[0]: [] for r in rows}
    for r in _damage(rows) if damage else rows:
        convs[r[0]].append(r)
    out = []
    for conv, turns in convs.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0))
        seen, kinds, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text in turns:
            bare = text.rstrip(_BLANK)
            fault = ("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
            if fault:
                count[fault] += 1
            kinds.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
        cost, letters = _search(kinds)
        lines, last, i = [], "", 0
        for x in letters:
            if x == "D":
                i += 1
                continue
            role = turns[i][2] if x == "K" else "assistant" if last == "u" else "user"
            lines.append(f"{role}:{'' if x == 'I' else turns[i][3]}")
            last, i = role[:1], i + (x != "I")
        numbers = [t for _, t, _, _ in turns if t is not None]
        pairs = [a[0] + b[0] for a, b in itertools.pairwise(kinds)]
        out.append((conv, max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *count.values(),
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, letters,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def _got(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.fixture(scope="module")
def table_rows():
    return connect(SF_SMALL).sql("SELECT conv_id, turn, role, text FROM conversations").fetchall()


def test_query_equals_a_plain_search(spark, table_rows):
    assert _got(queries.QUERIES["op13_conversation_repair"](spark, SF_SMALL)) == _expected(table_rows)


def _frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_segments_give_the_same(spark):
    rnd, rows = random.Random(3), []
    for conv, n in [(1, 300), (2, 3), (3, 41), (None, 25), (5, 1), (6, 90)]:
        for t in range(n):
            rows.append((conv, None if t == 0 else t + t // 7, rnd.choice(["user", "assistant", "system", "other", "", None]),
                         rnd.choice([f"text {t}.", f"cut {t}", "Same.", "", " \n", None, "ü" * 50 + "!"])))
    want = _expected(rows)
    for turns, chars in ((4, 1 << 20), (512, 60), (1, 1), (512, 1 << 20)):
        assert _got(conversation_repair.repair(conversation_repair.damaged(_frame(spark, rows)), turns, chars)) == want


def test_odd_tables(spark):
    extra = _frame(spark, [(1, 1, "user", "A.")]).selectExpr("*", "1 AS `a.b`", "2 AS h", "3 AS seq", "4 AS gone")
    assert len(_got(conversation_repair.repair(conversation_repair.damaged(extra)))) == 1
    assert _got(conversation_repair.repair(conversation_repair.undamaged(extra)))[0][5:8] == (0, 2, "KI")
    assert conversation_repair.repair(conversation_repair.damaged(_frame(spark, []))).count() == 0
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:7".encode()) % 20 == 0)
    assert _got(conversation_repair.repair(conversation_repair.damaged(_frame(spark, [(lost, 7, "user", "A.")])))) == [
        (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    # One row a third of all: all but one of them are duplicates.
    same = [(9, 1, "user", "Again.")] * 60 + [(i, 1, "user", "A.") for i in range(100, 220)]
    got = {r[0]: r for r in _got(conversation_repair.repair(conversation_repair.undamaged(_frame(spark, same)), 16))}
    assert got[9][3] == 59 and got[9][6] == 59 * 3 + 2 and len(got) == 121


def test_prices_are_a_dual_solution():
    rnd = random.Random(8)
    for _ in range(200):
        codes = tuple(rnd.choice(["s", "u", "a", "x", "u+", "a+", "U", "A"]) for _ in range(rnd.randint(0, 12)))
        lattice = auction.whole_lattice(codes)
        cost = lattice.auction(auction.START)
        kinds = [(c[0].lower(), c[0].isupper(), int(c.endswith("+"))) for c in codes]
        assert (cost, lattice.trace(auction.START)[0]) == _search(kinds)
        assert all(lattice.price[i][s] <= a[1] + lattice.price[i + a[2]][a[3]]
                   for i, layer in enumerate(lattice.layers) for s, arcs in enumerate(layer) for a in arcs)
