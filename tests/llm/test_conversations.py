"""Conversation repair against exhaustive search and a plain version."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from actilens.llm import conversations

ROWS = "conv_id long, turn long, role string, text string"
GOOD = re.compile("(s?(ua)+)?").fullmatch
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def scripts(kinds, at=0):
    """All (cost, audit, initials) that cost at most as much as to delete all rows."""
    found, most = [], 2 * len(kinds)

    def walk(k, cost, audit, initials):
        if cost > most:
            return
        for i in "ua":
            walk(k, cost + 5, audit + "I", initials + i)
        if k == len(kinds):
            found.append((cost, audit, initials))
            return
        initial, fault = kinds[k]
        walk(k + 1, cost + 2, audit + "D", initials)
        if fault != "d":
            extra = 5 if fault == "t" else 0
            walk(k + 1, cost + extra, audit + "K", initials + (initial or "?"))
            for i in "ua":
                walk(k + 1, cost + 1 + extra, audit + "R", initials + i)

    walk(0, 0, "", "")
    return [f for f in found if GOOD(f[2])]


def shortest(kinds):
    """Best first over (row, state)."""
    heap, seen = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, k, state = heapq.heappop(heap)
        if (k, state) in seen:
            continue
        seen.add((k, state))
        if k == len(kinds) and state in (0, 3):
            return cost, audit
        for i in "ua":
            if (state, i) in NEXT:
                heapq.heappush(heap, (cost + 5, audit + "I", k, NEXT[state, i]))
        if k < len(kinds):
            initial, fault = kinds[k]
            heapq.heappush(heap, (cost + 2, audit + "D", k + 1, state))
            for i, c, e in ((initial, 0, "K"), ("u", 1, "R"), ("a", 1, "R")):
                if fault != "d" and (state, i) in NEXT:
                    heapq.heappush(heap, (cost + c + 5 * (fault == "t"), audit + e, k + 1, NEXT[state, i]))


kind = st.tuples(st.sampled_from(["s", "u", "u", "a", "a", "t", ""]), st.sampled_from(["", "", "", "t", "d"]))


@settings(max_examples=150, deadline=None)
@given(st.lists(kind, max_size=5))
def test_parse_is_the_cheapest_script(kinds):
    assert conversations.best(conversations.span_cells(kinds)) == min(scripts(kinds))[:2] == shortest(kinds)


@settings(max_examples=60, deadline=None)
@given(st.lists(kind, max_size=60), st.integers(1, 20))
def test_every_cut_gives_the_same_cells(kinds, cut):
    whole = conversations.span_cells(kinds)
    assert conversations.combined(conversations.span_cells(kinds[:cut]), conversations.span_cells(kinds[cut:])) == whole
    assert conversations.best(whole) == shortest(kinds)


def plain(rows):
    space = lambda x: " " if x is None else x
    groups = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text, kind = space(role), space(text), zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, mine in groups.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        kinds, counts, seen = [], collections.Counter(), set()
        for _, role, text in mine:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            kinds.append((role[:1], "d" if fault in ("b", "d") else fault))
        turns = {t for t, *_ in mine if t is not None}
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
        cost, audit = shortest(kinds)
        size, lines, at = len(audit) - audit.count("D"), [], 0
        roles = ["system"] * (size % 2) + ["user", "assistant"] * (size // 2)
        for e in audit:
            role, text = ("", "") if e == "I" else mine[at][1:]
            at += e != "I"
            if e != "D":
                lines.append(f"{role if e == 'K' else roles[len(lines)]}:{text}")
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, digest))
    return sorted(out, key=str)


def talks(n, rng):
    rows = []
    for conv in range(n):
        turn = 0
        for _ in range(rng.randrange(1, 9)):
            turn += rng.choice([1, 1, 1, 2])
            text = rng.choice(["Yes.", "no", "", " \t", "What now? ", "done!\n", f"it is {turn}."])
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), text))
    return rows


@pytest.mark.parametrize("held", [conversations.HELD_BYTES, 20])
def test_damage_and_repair(spark, monkeypatch, held):
    monkeypatch.setattr(conversations, "HELD_BYTES", held)
    rng = random.Random(held)
    rows = talks(120, rng)
    rows += [(1000, k // 2, rng.choice(["user", "assistant"]), rng.choice(["a.", "b!", f"{k}", f"{k}."])) for k in range(700)]
    rows += [(2000, 5, "user", "again.")] * 40 + [(None, None, None, None), (None, None, "user", "hi."), (None, 3, "", "x"), (3000, None, "user", None)]
    rows += [(4000 + k, 1, "user", "Only one.") for k in range(60)]
    docs = spark.createDataFrame(rows, ROWS).repartition(5).withColumn("n", F.lit("x")).withColumn("fault", F.lit("y")).withColumn("c", F.lit(1))
    got = conversations.damaged_rows(docs)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_given_and_empty_tables(spark, small_folder):
    docs = spark.read.parquet(f"{small_folder}/conversations.parquet")
    assert sorted(map(tuple, conversations.damaged_rows(docs).collect()), key=str) == plain([tuple(r) for r in docs.select("conv_id", "turn", "role", "text").collect()])
    assert conversations.damaged_rows(docs.limit(0)).collect() == []


def test_repaired_rows():
    rows = [("system", "s."), ("assistant", "a."), ("user", ""), ("user", "u.")]
    kinds = [("s", ""), ("a", ""), ("u", "d"), ("u", "")]
    _, audit = conversations.best(conversations.span_cells(kinds))
    assert audit == "KRDR"
    assert conversations.repaired_text(rows, audit) == [("system", "s."), ("user", "a."), ("assistant", "u.")]
