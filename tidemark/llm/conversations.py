"""Conversations with broken turns: what is wrong with them, and the cheapest repair.

The rows of a conversation stand in order of turn (nulls first), rows of one turn in order
of role and the digest of the text. A row's first fault counts: blank (nothing but white
space), duplicate (role and text seen earlier), truncated (the last character that is not
white space is none of ``.!?``). The repair deletes blank and duplicate rows and leaves
initials of roles that read ``(s?(ua)+)?``; ``lattice`` finds its edits.

No conversation is held whole anywhere. Equal rows are counted first. Rows without their
texts are dealt by ranges of (conversation, turn, role, digest), so that a long conversation
lies over many tasks, and read as a stream: each stretch of up to ``PART`` turns is searched
on its own, conversations that lie inside one at once, the others by joining the costs
between the states at their borders. Then texts and audits meet in one sorted stream per
conversation, and the repaired text is digested as it passes: that digest can only be worked
out in order, so one task reads all of a conversation, holding its audit and a batch of rows.

Null conversations form one conversation of their own. Null roles and texts count as one
space: no known role, and blank. Rows that are repeated count as duplicates. Empty texts are
blank. A conversation named in ``ids`` that has no rows gets zeros, an empty audit and the
digest of nothing; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.plans.materialize import materialize

from . import lattice

#: Turns searched at a time.
PART = 1024
SPACE = " \t\n\x0b\x0c\r"
#: Faults in a row's code; the code is 4 * role class + fault.
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
ORDER = ("conv", "turn", "role", "digest")
LEGAL = ("su", "ua", "au")
INITIALS = "sua "


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with the damage that their digest asks for.

    Of crc32(``conv_id:turn``) modulo 20: 0 drops a row, 1 empties its text, 2 takes ``.!?``
    out of it, 3 repeats the row, 4 makes it the user's. A null counts as one space.
    """
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    lot = F.crc32(F.concat(conv, F.lit(":"), turn)) % 20
    return rows.filter(lot != 0).select(
        "conv_id",
        "turn",
        F.when(lot == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(lot == 1, F.lit("")).when(lot == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(lot == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _told(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows in the names used here, with the digest of the text."""
    told = F.coalesce(F.col(f"`{text}`"), F.lit(" "))
    return rows.select(
        F.col(f"`{conv}`").alias("conv"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"),
        F.unhex(F.sha2(told, 256)).alias("digest"),
        told.alias("text"),
    )


def _coded(told: DataFrame) -> DataFrame:
    """One row per different row: its order, its code, and how many duplicates of it follow.

    ``code`` is that of the first of them.
    """
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1)
    once = told.select(*ORDER, last.alias("last")).groupBy(*ORDER).agg(F.count(F.lit(1)).alias("n"), F.first("last").alias("last"))
    seen = once.groupBy(*(F.col(c).alias(f"_{c}") for c in ("conv", "role", "digest"))).agg(F.min(F.struct("turn")).alias("first"))
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    kind = F.instr(F.lit("sua"), F.substring("role", 1, 1))
    kind = F.when((kind > 0) & (F.col("role") != ""), kind - 1).otherwise(3)
    earlier = ~F.col("turn").eqNullSafe(F.col("first.turn"))
    fault = F.when(F.col("last") == "", BLANK).when(earlier, DUPLICATE).when(F.col("last").rlike("[.!?]"), NONE).otherwise(TRUNCATED)
    return once.join(seen, same).select(*ORDER, (4 * kind + fault).cast("byte").alias("code"), "n")


def _symbols(codes: bytes) -> bytes:
    return codes.translate(bytes(lattice.MUST_GO if c % 4 in (BLANK, DUPLICATE) else c // 4 * 2 + (c % 4 == TRUNCATED) for c in range(256)))


class _Part:
    """A stretch of consecutive rows of one conversation."""

    def __init__(self, head: tuple, no: int):
        self.head, self.no, self.codes = head, no, bytearray()
        self.turns, self.low, self.high = 0, None, None

    def add(self, turn, codes: bytes) -> None:
        self.codes += codes
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn

    def row(self, whole: bool) -> dict:
        codes = bytes(self.codes)
        initials = "".join(INITIALS[c // 4] for c in codes)
        ways = [(0, 0, *lattice.repair(_symbols(codes)))] if whole else lattice.crossings(_symbols(codes))
        faults = [sum(c % 4 == f for c in codes) for f in (BLANK, DUPLICATE, TRUNCATED)]
        return dict(zip(ORDER, self.head)) | {
            "no": self.no,
            "whole": whole,
            "ways": [dict(zip(("a", "b", "cost", "audit"), w)) for w in ways],
            "faults": faults,
            "illegal": sum(initials[n : n + 2] not in LEGAL for n in range(len(initials) - 1)),
            "first": initials[0],
            "last": initials[-1],
            "turns": self.turns,
            "low": self.low,
            "high": self.high,
        }


def _parts(coded: DataFrame, part: int) -> DataFrame:
    """Stretches with the costs between their borders; ``whole`` for whole conversations."""
    schema = _schema(
        "no long, whole boolean, ways array<struct<a: int, b: int, cost: long, audit: string>>, faults array<long>, illegal long, "
        "first string, last string, turns long",
        [coded.schema[c] for c in ORDER],
        [T.StructField(c, coded.schema["turn"].dataType) for c in ("low", "high")],
    )
    arrow = to_arrow_schema(schema)

    def run(batches):
        now, sure = None, False  # sure: the conversation began here, whole
        for batch in batches:
            out = []
            for *head, code, n in zip(*(batch.column(c).to_pylist() for c in (*ORDER, "code", "n"))):
                if now is None or head[0] != now.head[0]:
                    if now is not None:
                        out.append(now.row(sure and now.no == 0))
                    sure, now = now is not None, _Part(head, 0)
                again = bytes([code if code % 4 == BLANK else code - code % 4 + DUPLICATE])
                for codes in (bytes([code]), *(again * min(part, n - 1 - k) for k in range(0, n - 1, part))):
                    if len(now.codes) >= part:
                        out.append(now.row(False))
                        now = _Part(head, now.no + 1)
                    now.add(head[1], codes)
            yield pa.RecordBatch.from_pylist(out, arrow)
        if now is not None:  # may go on in the next partition
            yield pa.RecordBatch.from_pylist([now.row(False)], arrow)

    return coded.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(run, schema)


def _schema(ddl: str, before=(), after=()) -> T.StructType:
    return T.StructType([*before, *T.StructType.fromDDL(ddl).fields, *after])


def _joined(parts: DataFrame) -> DataFrame:
    """Cost, audit and counts of conversations that lie in several parts."""
    schema = _schema("cost long, audit string, gaps long, faults array<long>, illegal long", [parts.schema["conv"]])
    arrow = to_arrow_schema(schema)

    def closed(now: dict) -> dict:
        cost, audit = min(now["ways"][s] for s in lattice.FINAL if s in now["ways"])
        gaps = 0 if now["high"] is None else now["high"] - now["low"] + 1 - now["turns"]
        return {c: now[c] for c in ("conv", "faults", "illegal")} | {"cost": cost, "audit": audit, "gaps": gaps}

    def run(batches):
        now = None
        for batch in batches:
            for row in batch.to_pylist():
                ways = [(w["a"], w["b"], w["cost"], w["audit"]) for w in row["ways"]]
                if now is None or row["conv"] != now["conv"]:
                    if now is not None:
                        yield pa.RecordBatch.from_pylist([closed(now)], arrow)
                    now = row | {"ways": lattice.joined({lattice.EMPTY: (0, "")}, ways)}
                    continue
                now["ways"] = lattice.joined(now["ways"], ways)
                now["faults"] = [a + b for a, b in zip(now["faults"], row["faults"])]
                now["illegal"] += row["illegal"] + (now["last"] + row["first"] not in LEGAL)
                now["turns"] += row["turns"] - (row["low"] is not None and row["low"] == now["high"])
                now["low"] = row["low"] if now["low"] is None else now["low"]
                now["high"] = now["high"] if row["high"] is None else row["high"]
                now["last"] = row["last"]
        if now is not None:
            yield pa.RecordBatch.from_pylist([closed(now)], arrow)

    order = [*ORDER, "no"]
    return parts.repartition("conv").sortWithinPartitions(*order).mapInArrow(run, schema)


def _audits(told: DataFrame, part: int) -> DataFrame:
    """conv, cost, audit, gaps, faults and illegal of every conversation with rows."""
    parts = materialize(_parts(_coded(told), part))
    way = F.col("ways")[0]
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    whole = parts.filter("whole").select("conv", way["cost"].alias("cost"), way["audit"].alias("audit"), gaps.alias("gaps"), "faults", "illegal")
    return whole.unionByName(_joined(parts.filter("not whole")))


class _Edits:
    """Applies an audit to the rows of a conversation as they pass."""

    def __init__(self, audit: str):
        self.edits, self.state = iter(audit), lattice.EMPTY

    def _next(self, edit: str, role: str | None, text: str) -> tuple[str, str, str]:
        if role is None:
            role = "assistant" if self.state == lattice.USER else "user"
        self.state = "sua".index(role[0]) + 1
        return edit, role, text

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the turns that this row adds."""
        for edit in self.edits:
            if edit == "I":
                yield self._next(edit, None, "")
                continue
            if edit != "D":
                yield self._next(edit, role if edit == "K" else None, text)
            return

    def rest(self) -> Iterator[tuple[str, str, str]]:
        for edit in self.edits:
            yield self._next(edit, None, "")


#: What a row of the sorted stream is: a conversation's name, its audit, or a turn.
NAME, AUDIT, TURN = range(3)


def _stream(told: DataFrame, audits: DataFrame, ids: DataFrame) -> DataFrame:
    """Names, audits and turns of every conversation in one partition, in this order."""
    counts = F.concat(F.array("cost", "gaps", "illegal"), F.col("faults"))
    named = ids.select("conv", F.lit(NAME).alias("what")).distinct()
    found = audits.select("conv", F.lit(AUDIT).alias("what"), F.col("audit").alias("text"), counts.alias("counts"))
    rows = told.select("*", F.lit(TURN).alias("what"))
    rows = rows.unionByName(found, allowMissingColumns=True).unionByName(named, allowMissingColumns=True)
    order = ["conv", "what", *ORDER[1:]]
    return rows.repartition("conv").sortWithinPartitions(*order).select("conv", "what", "role", "text", "counts")


def _events(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv", "what", "role", "text", "counts")))


def verdicts(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    ids: DataFrame | None = None, part: int = PART,
) -> DataFrame:
    """One row per conversation: faults, cost and audit of the repair, digest of the repaired text.

    ``ids`` names further conversations that may have no rows.
    """
    told = _told(rows, conv, turn, role, text)
    ids = told.select("conv") if ids is None else ids.select(F.col(f"`{conv}`").alias("conv"))
    schema = _schema(
        "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string",
        [T.StructField(conv, told.schema["conv"].dataType)],
    )
    arrow = to_arrow_schema(schema)

    def run(batches):
        out, name, edits = [], None, None

        def close():
            for line in edits.rest():
                write(line)
            cost, gaps, illegal, blank, duplicate, truncated = counts
            found = (name, gaps, blank, duplicate, truncated, illegal, cost, audit, digest.hexdigest())
            out.append(dict(zip(arrow.names, found)))

        def write(line):
            nonlocal lines
            digest.update(f"{chr(10) if lines else ''}{line[1]}:{line[2]}".encode())
            lines += 1

        for key, what, said, told_, found in _events(batches):
            if what == NAME:
                if edits is not None:
                    close()
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out.clear()
                name, audit, counts, edits = key, "", [0] * 6, _Edits("")
                digest, lines = hashlib.sha256(), 0
            elif what == AUDIT:
                audit, counts, edits = told_, found, _Edits(told_)
            else:
                for line in edits.row(said, told_):
                    write(line)
        if edits is not None:
            close()
        yield pa.RecordBatch.from_pylist(out, arrow)

    return _stream(told, _audits(told, part), ids).mapInArrow(run, schema)


def repaired(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part: int = PART
) -> DataFrame:
    """The turns of all conversations after the repair: place from 0, edit (K, R or I), role and text."""
    told = _told(rows, conv, turn, role, text)
    schema = _schema("place long, edit string, role string, text string", [T.StructField(conv, told.schema["conv"].dataType)])
    arrow = to_arrow_schema(schema)

    def run(batches):
        name, edits, place, out, size = None, _Edits(""), 0, [], 0
        for key, what, said, told_, _ in _events(batches):
            if what == NAME:
                lines = list(edits.rest())
            else:
                lines = edits.row(said, told_) if what == TURN else ()
            for line in lines:
                out.append(dict(zip(arrow.names, (name, place, *line))))
                place, size = place + 1, size + len(line[2])
            if what == NAME:
                name, place, edits = key, 0, _Edits("")
            elif what == AUDIT:
                edits = _Edits(told_)
            if size > 1 << 22 or len(out) > 1 << 14:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out, size = [], 0
        out += [dict(zip(arrow.names, (name, place + n, *line))) for n, line in enumerate(edits.rest())]
        yield pa.RecordBatch.from_pylist(out, arrow)

    return _stream(told, _audits(told, part), told.select("conv")).mapInArrow(run, schema)
