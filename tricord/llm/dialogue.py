"""Operator 11: conversation structure repair by lazy weighted determinisation.

Conversations shall read ``(s?(ua)+)?`` in their roles' initials. Edits: Keep (0), Rerole to user or
assistant (2), Delete (3; the only one for a blank or repeated row), Insert an empty user or assistant
row (2); a truncated row that stays adds 1. The grammar and the edits form a small weighted automaton
whose arcs read a row's class (initial and fault) or nothing. What it costs to end from each of its
states is a vector; less its smallest number it is a state of the determinised automaton, made
when first met and kept in a transition table with what was taken off. A conversation is scanned from
its end to its start, a table look-up a row, which gives the cost; then arcs whose cost is exactly
the difference of the vectors they join are traced the other way, the ASCII-least edit first, which gives the
audit: a letter per edit.

Only classes are scanned, a byte a row; texts are shuffled once and pass through a task as a stream beside
the audit, so a conversation of any length needs memory in proportion to its audit. Its rows are
read by one task, as its audit and its hash are one sequence. Duplicates are found in groups of equal
role and text, not in groups of a conversation.

Rows: null roles and texts are one space; a null turn comes first; rows of one turn go by role and the text's SHA-256;
repeated rows are duplicates of each other; rows without a conversation id are one conversation, with a null id; a role counts by its first letter, so ``superuser`` opens a
conversation as ``system`` does; very long texts are taken whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow_rows

SPACE = " \t\n\x0b\x0c\r"
#: A row's class is 4 * (place of its role's initial in INITIALS, or 3) + its fault.
INITIALS, OTHER = "sua", 3
FINE, TRUNCATED, DUPLICATE, BLANK = range(4)
#: The grammar: state -> (initial, next state); conversations end in ENDS. State 0 is the start.
GRAMMAR = {0: (("s", 1), ("u", 2)), 1: (("u", 2),), 2: (("a", 3),), 3: (("u", 2),)}
ENDS = (0, 3)
MADE = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 2, 3, 2, 1
NEVER = 1 << 30


class Determinised:
    """The determinised automaton, as far as it has been met."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.ids: dict[tuple[int, ...], int] = {}
        self.next: dict[int, tuple[int, int]] = {}  # after << 4 | class -> state, cost taken off
        self.moves: dict[int, tuple[str, int]] = {}  # (after << 4 | class) << 2 | grammar state -> edits, grammar state
        self.end, self.least = self._state([0 if q in ENDS else NEVER for q in GRAMMAR])

    @staticmethod
    def _arcs(kind: int) -> Iterator[tuple[int, str, int, int]]:
        """(from, edit, to, cost) of the edits that use up a row of this class."""
        initial, fault = divmod(kind, 4)
        more = LEFT_TRUNCATED if fault == TRUNCATED else 0
        for q, out in GRAMMAR.items():
            yield q, "D", q, DELETE
            for letter, to in out if fault < DUPLICATE else ():
                if INITIALS[initial : initial + 1] == letter:
                    yield q, "K", to, more
                if letter in MADE:
                    yield q, "R", to, REROLE + more

    @staticmethod
    def _inserts() -> Iterator[tuple[int, str, int, int]]:
        return ((q, "I", to, INSERT) for q, out in GRAMMAR.items() for letter, to in out if letter in MADE)

    def _state(self, costs: list[int]) -> tuple[int, int]:
        """The state of a vector, closed under inserts, and its smallest number."""
        for _ in GRAMMAR:
            for q, _, to, cost in self._inserts():
                costs[q] = min(costs[q], costs[to] + cost)
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.ids:
            self.ids[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.ids[vector], least

    def step(self, key: int) -> tuple[int, int]:
        if key not in self.next:
            after, costs = self.vectors[key >> 4], [NEVER] * len(GRAMMAR)
            for q, _, to, cost in self._arcs(key & 15):
                costs[q] = min(costs[q], cost + after[to])
            self.next[key] = self._state(costs)
        return self.next[key]

    def move(self, key: int, q: int) -> tuple[str, int]:
        """The ASCII-least edits up to and with the one that uses up the row, all on tight arcs, and the grammar state then."""
        if key << 2 | q not in self.moves:
            state, off = self.step(key)
            here, after, at, said = self.vectors[state], self.vectors[key >> 4], q, ""
            while not said or said[-1] == "I":
                tight = [(e, to) for f, e, to, c in self._arcs(key & 15) if f == at and c + after[to] == here[at] + off]
                tight += [(e, to) for f, e, to, c in self._inserts() if f == at and c + here[to] == here[at]]
                edit, at = min(tight)
                said += edit
            self.moves[key << 2 | q] = said, at
        return self.moves[key << 2 | q]

    def repair(self, kinds: bytes | bytearray) -> tuple[int, str]:
        """(cost, audit) of a conversation's classes."""
        state, cost, step = self.end, self.least, self.next
        seen = array("H", bytes(2 * len(kinds)))
        for i in range(len(kinds) - 1, -1, -1):  # the scan: from the end to the start
            seen[i] = state
            key = state << 4 | kinds[i]
            state, off = step.get(key) or self.step(key)
            cost += off
        cost, q, audit, moves = cost + self.vectors[state][0], 0, [], self.moves
        for after, kind in zip(seen, kinds, strict=True):  # the trace
            key = after << 4 | kind
            said, q = moves.get(key << 2 | q) or self.move(key, q)
            audit.append(said)
        ending = self.vectors[self.end]
        while q not in ENDS:
            q = next(to for f, _, to, c in self._inserts() if f == q and c + ending[to] == ending[q])
            audit.append("I")
        return cost, "".join(audit)


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): some rows dropped (0 copies), emptied, without marks, repeated (2 copies) or said by a user."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    k, text = F.crc32(name) % 20, F.coalesce("text", F.lit(" "))
    text = F.when(k == 1, "").when(k == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(k == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("copies"))


def _as_rows(turns: DataFrame) -> DataFrame:
    copies = F.col("copies").cast("long") if "copies" in turns.columns else F.lit(1).cast("long")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), copies.alias("copies"))
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _class(role: Column, fault: Column) -> Column:
    initial = F.substring(role, 1, 1)
    place = F.lit(OTHER)
    for k, letter in enumerate(INITIALS):
        place = F.when(initial == letter, k).otherwise(place)
    return (place * 4 + fault).cast("int")


def audits(turns: DataFrame) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit.

    ``turns`` has conv_id, turn (integer), role, text and, if wanted, copies: rows of 0 copies only
    name their conversation. Texts don't leave the scan, only their digests.
    """
    trimmed = F.rtrim("text", F.lit(SPACE))
    fault = F.when(trimmed == "", BLANK).when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    gone = F.col("copies") == 0
    rows = _as_rows(turns).select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "digest", fault.alias("fault"), "copies")
    rows = rows.select("conv_id", *[F.when(~gone, F.col(c)).alias(c) for c in ("turn", "role", "digest", "fault")], "copies")
    rows = rows.groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.sum("copies").alias("copies"))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn"))) > 1
    first = _class(F.col("role"), F.when(again & (F.col("fault") != BLANK), DUPLICATE).otherwise(F.col("fault")))
    later = _class(F.col("role"), F.when(F.col("fault") != BLANK, DUPLICATE).otherwise(F.col("fault")))
    rows = rows.select("conv_id", "turn", "role", "digest", "copies", first.alias("first"), later.alias("later"))
    rows = rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "digest")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        machine, made, held, at = Determinised(), [], 0, None

        def close() -> None:
            nonlocal held
            kinds, distinct, low, high = at[1:]
            count = [0] * 16
            for k in range(16):
                count[k] = kinds.count(k)
            initials = kinds.translate(bytes(k >> 2 for k in range(256)))
            s, u, a = range(3)
            # pairs don't overlap themselves: su, ua and au have different letters
            legal = sum(initials.count(bytes(p)) for p in ((s, u), (u, a), (a, u)))
            cost, audit = machine.repair(kinds)
            gaps = high - low + 1 - distinct if distinct else 0
            made.append((at[0], gaps, *[sum(count[f::4]) for f in (BLANK, DUPLICATE, TRUNCATED)], max(0, len(kinds) - 1) - legal, cost, audit))
            held += len(audit) + 100

        def flush():
            nonlocal held
            columns, held = list(zip(*made, strict=True)), 0
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        names, types = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"], [None] + [pa.int64()] * 6 + [pa.string()]
        for batch in batches:
            types[0] = batch.schema.field("conv_id").type
            for rows in arrow_rows(batch, "conv_id", "turn", "copies", "first", "later", at_once=8192):
                for conv, turn, copies, one, more in zip(*rows, strict=True):
                    if at is None or at[0] != conv:
                        if at:
                            close()
                            if held > 1 << 22:
                                yield flush()
                        at = [conv, bytearray(), 0, None, None]
                    if copies:
                        at[1] += bytes([one]) + bytes([more]) * (copies - 1)
                        if turn is not None and turn != at[4]:
                            at[2], at[3], at[4] = at[2] + 1, turn if at[3] is None else at[3], turn
        if at:
            close()
            yield flush()

    schema = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    return rows.select("conv_id", "turn", "copies", "first", "later").mapInArrow(run, schema)


def _edits(batches: Iterator) -> Iterator[tuple]:
    """From sorted rows, a conversation's audit first: (conv_id, found, edit, role, text), and (conv_id, found, None, None, None) at its end."""
    audit, i, found, conv, q = "", 0, None, None, 0
    names = ("conv_id", "found", "role", "text", "copies")

    def inserts() -> Iterator[tuple]:
        nonlocal i, q
        while i < len(audit) and audit[i] == "I":
            letter, q = next((x, to) for x, to in GRAMMAR[q] if x in MADE)
            i += 1
            yield conv, found, "I", MADE[letter], ""

    for batch in batches:
        for rows in arrow_rows(batch, *names, at_once=256):
            for of, head, role, text, copies in zip(*rows, strict=True):
                if head is not None:
                    if found is not None:
                        yield from inserts()
                        yield conv, found, None, None, None
                    conv, found, audit, i, q = of, head, head["audit"], 0, 0
                for _ in range(copies):
                    yield from inserts()
                    edit, i = audit[i], i + 1
                    if edit == "R":
                        letter, q = next((x, to) for x, to in GRAMMAR[q] if x in MADE)
                        role = MADE[letter]
                    elif edit == "K":
                        q = next(to for x, to in GRAMMAR[q] if x == role[:1])
                    yield conv, found, edit, role, text
    if found is not None:
        yield from inserts()
        yield conv, found, None, None, None


def _beside(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Rows and their conversation's audit, which comes first, sorted in the partition of the conversation."""
    names = [c for c in found.columns if c != "conv_id"]
    rows = _as_rows(turns).where("copies > 0").withColumns({"found": F.lit(None).cast(f"struct<{', '.join(f'{c}: {found.schema[c].dataType.simpleString()}' for c in names)}>"), "turn": F.col("turn").cast("long")})
    heads = found.select("conv_id", F.lit(0).cast("long").alias("copies"), F.struct(*names).alias("found"))
    both = rows.unionByName(heads, allowMissingColumns=True).withColumn("is_row", F.col("found").isNull())
    both = both.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "is_row", F.asc_nulls_first("turn"), "role", "digest")
    return both.select("conv_id", "found", "role", "text", "copies")


def repair(turns: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The repaired conversations: (conv_id, place, role, text, edit), ``place`` from 0; deleted rows have no place."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        made, held, place = [], 0, 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names)
        names, types = ["conv_id", "place", "role", "text", "edit"], [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
        for conv, _, edit, role, text in _edits(batches):
            if edit is None:
                place = 0
                continue
            made.append((conv, None if edit == "D" else place, role, text, edit))
            place, held = place + (edit != "D"), held + len(text) + 50
            if held > 1 << 22:
                yield flush()
                made, held = [], 0
        if made:
            yield flush()

    kind = to_arrow_type(turns.schema["conv_id"].dataType)
    schema = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, place long, role string, text string, edit string"
    return _beside(turns, found if found is not None else audits(turns)).mapInArrow(run, schema)


def repair_digest(turns: DataFrame) -> DataFrame:
    """``audits`` and repaired_sha256, of the repaired rows as ``role:text`` joined by newlines."""
    found = audits(turns)
    names = [c for c in found.columns if c != "conv_id"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        made, held, sha, some = [], 0, hashlib.sha256(), False
        types = [kind] + [pa.int64()] * 6 + [pa.string()] * 2
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], ["conv_id", *names, "repaired_sha256"])
        for conv, of, edit, role, text in _edits(batches):
            if edit is None:
                made.append((conv, *[of[c] for c in names], sha.hexdigest()))
                held, sha, some = held + len(of["audit"]) + 200, hashlib.sha256(), False
                if held > 1 << 22:
                    yield flush()
                    made, held = [], 0
            elif edit != "D":
                sha.update(("\n" * some + f"{role}:{text}").encode())
                some = True
        if made:
            yield flush()

    kind = to_arrow_type(turns.schema["conv_id"].dataType)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    return _beside(turns, found).mapInArrow(run, f"{fields}, repaired_sha256 string")
