"""Conversation repair: a weighted interval parse of each conversation against the grammar of well-formed ones.

A well-formed conversation has the role initials ``(s?(ua)+)?``. Its automaton has four states; the nonterminals of the
repair grammar are pairs of states, ``X[p,q]`` for what leads from p to q, and its rules are in Chomsky normal form:
``X[p,q] -> X[p,r] X[r,q]`` for two neighbouring spans, and for a span of one row Delete (p to p), Keep and Rerole (along
an arrow of the automaton). A cell holds the cheapest (cost, audit) of its span. Insertions need no row, so they are a closure: every
cell is joined with the cheapest chains of insertions on both sides.

Spans are combined bottom-up by length 1, 2, 4, ...; since the middle is a state and cells are closed, each way to cut a span
gives the same cell, so one cut a span is enough and a parse takes n steps instead of n ** 3. Two audits of the same span
and cost are never prefixes of each other (an edit more costs more), so the least audit of a span is made of least
audits of its parts.

Rows are dealt over tasks by ranges of (conversation, turn), so a conversation with a third of all rows is many tasks. What
lies inside a range is finished there. Pieces of the first and the last conversation of a task, and of one with more than
``HELD_BYTES`` of text, become cells; these meet in order, and the text of such a conversation runs through one SHA-256,
which is a chain by definition, row after row.

Defined cases: null text, role, id and turn are one space where their text is needed; a null id is a conversation of its
own; a null turn comes first and is left out of gaps; rows of the same turn come in the order of role and text; rows that
are the same in all columns are counted, not moved; roles count by their initial, an empty one has none and cannot be
kept; a text may be as long as memory lets one row be; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actilens.llm.common import partitions, stored

#: Costs of the edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Arrows of the automaton of ``(s?(ua)+)?``: state, initial, next state.
ARROWS = ((0, "s", 1), (0, "u", 2), (1, "u", 2), (2, "a", 3), (3, "u", 2))
STATES, FINAL = 4, (0, 3)
#: Text of one conversation that a task holds while its parse is not complete.
HELD_BYTES = 8 << 20
BLANKS = " \t\n\x0b\x0c\r"

#: Cells of a span by state pair: (cost, audit), or None where nothing leads from one to the other.
Cells = list[list[tuple[int, str] | None]]


def combined(left: Cells, right: Cells) -> Cells:
    """Cells of two neighbouring spans taken together: the rule X[p,q] -> X[p,r] X[r,q]."""
    out: Cells = [[None] * STATES for _ in range(STATES)]
    for p, row in enumerate(left):
        for r, first in enumerate(row):
            if first is None:
                continue
            for q, second in enumerate(right[r]):
                if second is None:
                    continue
                cost, old = first[0] + second[0], out[p][q]
                if old is None or cost < old[0] or cost == old[0] and first[1] + second[1] < old[1]:
                    out[p][q] = (cost, first[1] + second[1])
    return out


@lru_cache(1)
def insertions() -> Cells:
    """The closure of insertions over an empty span: no chain of them needs more steps than there are states."""
    cells: Cells = [[(0, "") if p == q else None for q in range(STATES)] for p in range(STATES)]
    step = [list(row) for row in cells]
    for p, initial, q in ARROWS:
        if initial in "ua":
            step[p][q] = (INSERT, "I")
    for _ in range(STATES):
        cells = combined(cells, step)
    return cells


@lru_cache(64)
def row_cells(initial: str, fault: str) -> Cells:
    """Closed cells of a span of one row: ``fault`` is "d" (must go), "t" (truncated) or ""."""
    cells: Cells = [[(DELETE, "D") if p == q else None for q in range(STATES)] for p in range(STATES)]
    extra = TRUNCATED if fault == "t" else 0
    for p, arrow, q in ARROWS if fault != "d" else ():
        edits = [(KEEP + extra, "K")] * (arrow == initial) + [(REROLE + extra, "R")] * (arrow in "ua")
        if edits:
            cells[p][q] = min(edits)
    return combined(combined(insertions(), cells), insertions())


def by_length(spans: list[Cells]) -> Cells:
    """Cells of a whole row of neighbouring spans, combined bottom-up by length."""
    while len(spans) > 1:
        spans = [combined(*spans[k : k + 2]) if k + 1 < len(spans) else spans[k] for k in range(0, len(spans), 2)]
    return spans[0] if spans else insertions()


@lru_cache(1 << 14)
def short_cells(kinds: tuple[tuple[str, str], ...]) -> Cells:
    return by_length([row_cells(*k) for k in kinds])


def span_cells(kinds: list[tuple[str, str]], short: int = 16) -> Cells:
    """Cells of rows given by (initial, fault); short spans are remembered, since most conversations look alike."""
    return by_length([short_cells(tuple(kinds[k : k + short])) for k in range(0, len(kinds), short)])


def best(cells: Cells) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair, the least audit of several."""
    return min(c for q in FINAL if (c := cells[0][q]) is not None)


class Repaired:
    """The SHA-256 of a repaired conversation, fed with its rows in order."""

    def __init__(self, audit: str):
        self.edits, self.audit = 0, audit
        self.odd = (len(audit) - audit.count("D")) % 2  # one system row before the pairs
        self.digest, self.at = hashlib.sha256(), 0

    def _put(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.at else "") + f"{role}:{text}").encode())
        self.at += 1

    def _inserted(self) -> None:
        while self.edits < len(self.audit) and self.audit[self.edits] == "I":
            self._put(self._role(), "")
            self.edits += 1

    def _role(self) -> str:
        return "assistant" if (self.at - self.odd) % 2 else "user"

    def row(self, role: str, text: str) -> None:
        self._inserted()
        edit = self.audit[self.edits]
        self.edits += 1
        if edit != "D":
            self._put(role if edit == "K" else self._role(), text)

    def hex(self) -> str:
        self._inserted()
        return self.digest.hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` and ``n`` (0: dropped, 2: repeated) after the damage of the contract."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    plain = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("k"))
    copies = F.when(F.col("k") == 0, 0).when(F.col("k") == 3, 2).otherwise(1).cast("long")
    return plain.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("n"))


def judged(rows: DataFrame) -> DataFrame:
    """Rows (``conv_id``, ``turn``, ``role``, ``text``, ``n`` copies) with their first fault: ``fault`` of the first copy
    (blank, duplicate, truncated or empty); further copies are duplicates of it, or blank.

    Equal rows become one in the map tasks. The first turn of each role and text comes from an aggregate over a digest, met by a
    join that AQE may split, so no window holds a role and text that very many rows share.
    """
    same = F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256))
    items = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("same", same)
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = items.where("n > 0").groupBy(F.col("conv_id").alias("c"), F.col("same").alias("x")).agg(F.min(turn).alias("first"))
    met = items.join(first, (F.col("same") == F.col("x")) & F.col("conv_id").eqNullSafe(F.col("c")), "left")
    bare = F.rtrim("text", F.lit(BLANKS))
    fault = (
        F.when(bare == "", "b").when(F.col("first") != turn, "d").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "t").otherwise("")
    )
    return met.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))


FOUND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PIECE = (
    f"{FOUND}, n_rows long, blanks long, duplicates long, truncations long, illegals long, first_initial string, last_initial string, "
    "low long, high long, turns long, costs array<long>, audits array<string>"
)
COUNTS = ("n_rows", "blanks", "duplicates", "truncations", "illegals", "turns")


class Piece:
    """What is known of neighbouring rows of one conversation: counts, ends and the kinds of the rows."""

    def __init__(self):
        self.counts = dict.fromkeys(COUNTS, 0)
        self.first = self.last = self.low = self.high = None
        self.kinds: list[tuple[str, str]] = []
        self.rows: list[tuple[str, str, int]] = []
        self.held = 0

    def add(self, turn: int | None, role: str, text: str, n: int, fault: str) -> None:
        if not n:
            return
        initial, counts = role[:1], self.counts
        counts["n_rows"] += n
        counts["blanks"] += n if fault == "b" else 0
        counts["duplicates"] += n if fault == "d" else 0 if fault == "b" else n - 1
        counts["truncations"] += fault == "t"
        legal = ("su", "ua", "au")
        counts["illegals"] += (self.last is not None and self.last + initial not in legal) + (n - 1) * (initial * 2 not in legal)
        if turn is not None and turn != self.high:
            counts["turns"] += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.first, self.last = initial if self.first is None else self.first, initial
        gone = fault in ("b", "d")
        self.kinds.append((initial, "d" if gone else fault))
        self.kinds += [("", "d")] * (n - 1)
        self.held += len(text)
        if self.held <= HELD_BYTES:
            self.rows.append((role, text, n))
        else:
            self.rows = []

    def result(self, cost: int, audit: str, digest: str | None) -> dict:
        c = self.counts
        gaps = self.high - self.low + 1 - c["turns"] if c["turns"] else 0
        return {
            "gaps": gaps, "blank": c["blanks"], "duplicate": c["duplicates"], "truncated": c["truncations"], "illegal": c["illegals"],
            "cost": cost, "audit": audit, "repaired_sha256": digest,
        }

    def finished(self) -> dict:
        cost, audit = best(span_cells(self.kinds))
        text = Repaired(audit)
        for role, content, n in self.rows:
            for _ in range(n):
                text.row(role, content)
        return self.result(cost, audit, text.hex())

    def cells(self) -> dict:
        flat = [c or (-1, "") for row in span_cells(self.kinds) for c in row]
        ends = {"first_initial": self.first, "last_initial": self.last, "low": self.low, "high": self.high}
        return self.counts | ends | {"costs": [c for c, _ in flat], "audits": [a for _, a in flat]}


def joined_pieces(pieces: Iterable) -> dict:
    """The result of a conversation from its pieces in order, without the digest of its text."""
    whole, spans = Piece(), []
    for p in pieces:
        for name in COUNTS:
            whole.counts[name] += p[name]
        if not p["n_rows"]:
            continue
        if whole.last is not None and whole.last + p["first_initial"] not in ("su", "ua", "au"):
            whole.counts["illegals"] += 1
        whole.last = p["last_initial"]
        if p["low"] is not None:
            whole.counts["turns"] -= p["low"] == whole.high
            whole.low, whole.high = p["low"] if whole.low is None else whole.low, p["high"]
        flat = [None if c < 0 else (c, a) for c, a in zip(p["costs"], p["audits"])]
        spans.append([flat[k : k + STATES] for k in range(0, STATES**2, STATES)])
    return whole.result(*best(by_length(spans)), None)


def _pieces(rows: DataFrame) -> DataFrame:
    """A row for each conversation that lies inside one task, and cells (with ``n_rows``) for the pieces of the others."""
    id_type = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {id_type}, part int, {PIECE}"
    names = [f.split()[0] for f in PIECE.split(", ")]
    order = [F.asc("conv_id"), F.asc("turn"), F.asc("role"), F.asc("text")]
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, key, edge, out, part = None, None, True, [], 0

        def flush(last: bool) -> None:
            whole = not edge and not last and piece.held <= HELD_BYTES
            found = dict.fromkeys(names) | (piece.finished() if whole else piece.cells())
            out.append({"conv_id": key, "part": part} | found)

        arrow = None
        for batch in batches:
            arrow = arrow or {"conv_id": batch.schema.field("conv_id").type}
            for at in range(0, batch.num_rows, 1000):
                columns = [batch.column(c).slice(at, 1000).to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "fault", "part")]
                for conv, turn, role, text, n, fault, part in zip(*columns):
                    if piece is None or conv != key:
                        if piece is not None:
                            flush(last=False)
                            edge = False
                        piece, key = Piece(), conv
                    piece.add(turn, role, text, n, fault)
                if out:
                    yield _batch(out, names, arrow["conv_id"])
                    out.clear()
        if piece is not None:
            flush(last=True)
            yield _batch(out, names, arrow["conv_id"])

    return stored(dealt.mapInArrow(run, schema), "conversation-pieces")


def _batch(rows: list[dict], names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    text = {"audit", "repaired_sha256", "first_initial", "last_initial"}
    kinds = {"conv_id": id_type, "part": pa.int32(), "costs": pa.list_(pa.int64()), "audits": pa.list_(pa.string())}
    every = ["conv_id", "part", *names]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string() if c in text else pa.int64())) for c in every], every)


def _digests(rows: DataFrame, results: DataFrame) -> DataFrame:
    """``conv_id`` and the digest of the repaired text of the conversations in ``results``: the audit comes first, then the
    rows in order, so nothing but the row at hand and the audit is held."""
    id_type = rows.schema["conv_id"].dataType.simpleString()
    head = results.select("conv_id", F.lit(0).alias("o"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(1).cast("long").alias("n"))
    wanted = results.select(F.col("conv_id").alias("c"))
    body = rows.join(wanted, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi").where("n > 0")
    lines = head.unionByName(body.select("conv_id", F.lit(1).alias("o"), F.col("turn").cast("long").alias("turn"), "role", "text", "n"))
    dealt = lines.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "o", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, key = None, None
        done = lambda kind: pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([text.hex()])], ["conv_id", "repaired_sha256"])
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if not row["o"]:
                    if text is not None:
                        yield done(kind)
                    text, key = Repaired(row["text"]), row["conv_id"]
                else:
                    for _ in range(row["n"]):
                        text.row(row["role"], row["text"])
        if text is not None:
            yield done(kind)

    return dealt.mapInArrow(run, f"conv_id {id_type}, repaired_sha256 string")


def repaired(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` and ``repaired_sha256`` of
    every conversation in ``rows`` (``conv_id``, ``turn``, ``role``, ``text``, ``n`` copies; of 0 copies there is only the id)."""
    items = stored(judged(rows), "conversation-rows")
    pieces = _pieces(items)
    columns = ["conv_id", *(f.split()[0] for f in FOUND.split(", "))]
    inside = pieces.where("n_rows is null").select(columns)
    id_type = items.schema["conv_id"].dataType.simpleString()

    def meet(group: pa.Table) -> pa.Table:
        lines = group.sort_by("part").to_pylist()
        found = {c: pa.array([v], pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c, v in joined_pieces(lines).items()}
        return pa.table({"conv_id": group.column("conv_id").slice(0, 1)} | found)

    # A conversation has a piece for each task at most, whatever the number of its rows.
    met = pieces.where("n_rows is not null").groupBy("conv_id").applyInArrow(meet, f"conv_id {id_type}, {FOUND}")
    met = stored(met, "conversation-edges")
    texts = _digests(items, met).withColumnRenamed("conv_id", "c")
    edges = met.drop("repaired_sha256").join(texts, F.col("conv_id").eqNullSafe(F.col("c"))).select(columns)
    return inside.unionByName(edges)


def repaired_text(rows: Iterable[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The repaired (role, text) rows of one conversation from its rows in order and its audit."""
    out: list[tuple[str, str]] = []
    text = Repaired(audit)
    text._put = lambda role, content: (out.append((role, content)), setattr(text, "at", text.at + 1))  # type: ignore[method-assign]
    for role, content in rows:
        text.row(role, content)
    text.hex()
    return out


def damaged_rows(conversations: DataFrame) -> DataFrame:
    """The rows of query op12."""
    return repaired(damaged(conversations))
