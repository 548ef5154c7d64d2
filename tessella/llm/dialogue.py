"""Conversation structure repair by generalised LR parsing with weighted edits.

Roles must spell ``(s?(ua)+)?`` (system, user, assistant). The grammar is S -> empty | T | s T,
T -> u a | T u a, parsed bottom-up with its LR(0) table. All readings of a conversation are kept at once on
a graph-structured stack: stacks share their lower parts, and of two stacks with an equal top only the one
with the smaller (cost, audit) goes on, since equal tops take the same continuations in this grammar. A row
is kept, reroled or deleted, and rows are inserted between; the audit is the string of these edits (K, R, D,
I), ties between cheapest audits go to the least in ASCII. Audits are linked lists that share their
beginnings, so comparing two of them only looks at what differs.

Plan. Equal rows of a turn become one row with a count. Rows are range-sorted by (conversation, turn, role,
text) and numbered; first occurrences of a (role, text) come from a minimum over hashes. Only the code of a
row (initial of the role and fault) is parsed. A conversation that lies inside one task's range is parsed
there; one that may go on in another task, or is longer than ``FRAGMENT_ROWS``, is parsed in fragments, from
each possible stack top to each, and fragments are joined in order, again by minimum. So a conversation of any
length is spread over tasks. Decisions go back to the rows by number; texts never enter the parser.

Defined cases: null roles and texts are one space; a null turn sorts first and is no turn for gaps; a null
conversation id is a conversation; rows of a turn are ordered by role and text; repeated rows are duplicates; an
empty role has no legal initial; texts of any length pass by untouched; a conversation without rows, if its id is
given, has zeros and an empty audit; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import batches_of, step, table

INITIALS = "sua"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
FRAGMENT_ROWS = 4096
#: Codes of a row: three for each initial (s, u, a, other).
SOUND, CUT_SHORT, MUST_GO = 0, 1, 2
LEGAL = np.zeros((4, 4), bool)
LEGAL[[0, 1, 2], [1, 2, 1]] = True

# LR(0) table: states 1 after s, 2 and 6 after u, 3 and 4 after T; 5 and 7 reduce u a and T u a.
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 5, (3, "u"): 6, (4, "u"): 6, (6, "a"): 7}
REDUCE = {5: 2, 7: 3}
GOTO = {0: 3, 1: 4}
ACCEPT = (0, 3, 4)
WAITS_FOR_A = (2, 6)
#: A stack for each top, for fragments that start in the middle; START is the beginning of a conversation.
BOTTOM = (0, None)
STACKS = {0: BOTTOM, 1: (1, BOTTOM), 2: (2, BOTTOM), 3: (3, BOTTOM), 4: (4, (1, BOTTOM)), 6: (6, (3, BOTTOM))}
START = 8
#: Empty audit; others are (audit before, letters, length, note).
EMPTY = (None, "", 0, None)


@lru_cache(maxsize=None)
def advance(stack: tuple, symbol: str) -> tuple | None:
    """The stack after one symbol and the reductions it allows; None where the table has no action."""
    if (state := SHIFT.get((stack[0], symbol))) is None:
        return None
    stack = (state, stack)
    while stack[0] in REDUCE:
        for _ in range(REDUCE[stack[0]]):
            stack = stack[1]
        stack = (GOTO[stack[0]], stack)
    return stack


def earlier(a: tuple, b: tuple) -> bool:
    """Is audit ``a`` below ``b`` in ASCII order? Walks back to what both share."""
    left, right = [], []
    while a is not b:
        if a[2] >= b[2]:
            left.append(a[1])
            a = a[0]
        else:
            right.append(b[1])
            b = b[0]
    return "".join(reversed(left)) < "".join(reversed(right))


def letters(audit: tuple) -> str:
    out = []
    while audit is not EMPTY:
        out.append(audit[1])
        audit = audit[0]
    return "".join(reversed(out))


def offer(heads: dict, cost: int, audit: tuple, stack: tuple) -> bool:
    """Merge a stack into those with the same top."""
    old = heads.get(stack[0])
    if old is None or cost < old[0] or (cost == old[0] and earlier(audit, old[1])):
        heads[stack[0]] = (cost, audit, stack)
        return True
    return False


def insert_rows(heads: dict) -> dict:
    work = list(heads)
    while work:
        cost, audit, stack = heads[work.pop()]
        for symbol in "ua":
            if (new := advance(stack, symbol)) and offer(heads, cost + INSERT, (audit, "I", audit[2] + 1, None), new):
                work.append(new[0])
    return heads


def parse(codes: Iterable[int], copies: Iterable[int] | None, start: int) -> dict:
    """Best (cost, audit, stack) for each stack top after the rows."""
    heads = insert_rows({0: (0, EMPTY, BOTTOM)}) if start == START else {start: (0, EMPTY, STACKS[start])}
    for k, code in enumerate(codes):
        initial, fault = divmod(code, 3)
        more = int(copies[k]) - 1 if copies is not None else 0
        after: dict = {}
        extra = TRUNCATED if fault == CUT_SHORT else 0
        for cost, audit, stack in heads.values():
            size = audit[2] + 1
            offer(after, cost + DELETE, (audit, "D", size, None), stack)
            if fault == MUST_GO:
                continue
            if initial < 3 and (new := advance(stack, INITIALS[initial])):
                offer(after, cost + extra, (audit, "K", size, None), new)
            for symbol in "ua":
                if new := advance(stack, symbol):
                    offer(after, cost + REROLE + extra, (audit, "R", size, None), new)
        if more:
            # Further copies are deleted at once: rows inserted among them come later in the least audit.
            gone = "D" * more
            after = {top: (cost + DELETE * more, (audit, gone, audit[2] + more, None), stack) for top, (cost, audit, stack) in after.items()}
        heads = insert_rows(after)
    return heads


def cheapest(heads: dict) -> tuple:
    """The best of the accepted stacks."""
    out: dict = {}
    for top in ACCEPT:
        if top in heads:
            cost, audit, _ = heads[top]
            offer(out, cost, audit, BOTTOM)
    return out[0]


def decode(codes: bytes, copies: np.ndarray | None, audit: str, start: int) -> list[str]:
    """For each row its edits: u and a insert a row, K keeps, U and A rerole, D deletes."""
    out, at, want = [], 0, "a" if start in WAITS_FOR_A else "u"

    def inserted() -> str:
        nonlocal at, want
        made = ""
        while at < len(audit) and audit[at] == "I":
            made += want
            want = "a" if want == "u" else "u"
            at += 1
        return made

    for k, code in enumerate(codes):
        edits = inserted()
        letter = audit[at]
        at += 1 if copies is None else int(copies[k])
        if letter == "R":
            edits += want.upper()
        else:
            edits += letter
        if letter == "R" or (letter == "K" and code >= 3):
            want = "a" if want == "u" else "u"
        out.append(edits)
    if codes:
        out[-1] += inserted()
    return out


@lru_cache(maxsize=200_000)
def solved(codes: bytes) -> tuple[int, str, list[str]]:
    """Cost, audit and decisions of a short conversation; few patterns make up most of them."""
    cost, audit, _ = cheapest(parse(codes, None, START))
    return cost, letters(audit), decode(codes, None, letters(audit), START)


def illegal_pairs(codes: np.ndarray, copies: np.ndarray) -> int:
    initial = codes // 3
    return int((~LEGAL[initial[:-1], initial[1:]]).sum() + (copies - 1).sum())


FINAL = [("at", pa.int64()), ("ops", pa.list_(pa.string())), ("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64())]
FINAL_DDL = "at long, ops array<string>, cost long, audit string, illegal long"
PARTS = [
    *FINAL, ("whole", pa.bool_()), ("codes", pa.binary()), ("copies", pa.binary()), ("entries", pa.list_(pa.int32())), ("exits", pa.list_(pa.int32())),
    ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())),
]
PARTS_DDL = f"{FINAL_DDL}, whole boolean, codes binary, copies binary, entries array<int>, exits array<int>, costs array<long>, audits array<string>"


def _parse_stream(fragment_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of ``at``. Conversations at either end of an unbroken run may go on elsewhere."""
        out: list[dict] = []
        conv, begin, codes, copies, open_start = None, None, [], [], True
        held, expected, schema = 0, None, None

        def emit(open_end: bool) -> None:
            nonlocal codes, copies, held
            if not held:
                return
            code, many = np.concatenate(codes).astype(np.uint8), np.concatenate(copies)
            codes, copies, held = [], [], 0
            plain = bool((many == 1).all())
            row = {"conv": conv, "at": begin, "illegal": illegal_pairs(code.astype(np.int64), many), "whole": not (open_start or open_end)}
            if row["whole"]:
                if plain and len(code) <= 16:
                    row["cost"], row["audit"], row["ops"] = solved(code.tobytes())
                else:
                    cost, audit, _ = cheapest(parse(code.tolist(), None if plain else many, START))
                    row["cost"], row["audit"] = cost, letters(audit)
                    row["ops"] = decode(code.tobytes(), None if plain else many, row["audit"], START)
            else:
                row |= {"codes": code.tobytes(), "copies": None if plain else many.astype("<i8").tobytes(), "entries": [], "exits": [], "costs": [], "audits": []}
                for entry in (START, *STACKS) if open_start else (START,):
                    for top, (cost, audit, _) in parse(code.tolist(), None if plain else many, entry).items():
                        for name, value in zip(("entries", "exits", "costs", "audits"), (entry, top, cost, letters(audit)), strict=True):
                            row[name].append(value)
            out.append(row)

        def flush() -> pa.RecordBatch:
            rows = list(out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            schema = pa.schema([("conv", batch.column(1).type), *PARTS])
            at, code, many = (np.asarray(batch.column(k)) for k in (0, 2, 3))
            label = np.asarray(batch.column(1).dictionary_encode("encode").indices)
            names = batch.column(1)
            cuts = np.flatnonzero((label[1:] != label[:-1]) | (at[1:] != at[:-1] + 1)) + 1
            edges = [0, *cuts.tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                name, follows = names[a].as_py(), expected is not None and int(at[a]) == expected
                if not (follows and name == conv):
                    emit(open_end=not follows)
                    conv, begin, open_start = name, int(at[a]), not follows
                for first in range(a, b, fragment_rows):
                    last = min(b, first + fragment_rows)
                    if held and held + last - first > fragment_rows:
                        emit(open_end=True)
                        open_start, begin = True, int(at[first])
                    codes.append(code[first:last])
                    copies.append(many[first:last])
                    held += last - first
                expected = int(at[b - 1]) + 1
            if len(out) >= 512:
                yield flush()
        emit(open_end=True)
        if out:
            yield flush()
    return run


def _join_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments come in order of conversation and place; a conversation's are joined one after the other."""
    conv, heads, parts, illegal, last = None, {}, [], 0, None
    schema = None

    def finish() -> pa.RecordBatch:
        cost, audit, _ = cheapest(heads)
        chosen, at = [], audit
        while at is not EMPTY:
            chosen.append(at)
            at = at[0]
        chosen.reverse()
        rows = []
        for (begin, codes, copies), (_, piece, _, entry) in zip(parts, chosen, strict=True):
            rows.append({"conv": conv, "at": begin, "ops": decode(codes, copies, piece, 0 if entry == START else entry)})
        rows[0] |= {"cost": cost, "audit": "".join(c[1] for c in chosen), "illegal": illegal}
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)

    for batch in batches:
        schema = pa.schema([("conv", batch.schema.field("conv").type), *FINAL])
        for row in batch.to_pylist():
            if parts and row["conv"] != conv:
                yield finish()
                parts = []
            if not parts:
                conv, heads, illegal = row["conv"], {START: (0, EMPTY, (START, None))}, 0
            codes, copies = row["codes"], None if row["copies"] is None else np.frombuffer(row["copies"], "<i8")
            illegal += row["illegal"] + (int(not LEGAL[last, codes[0] // 3]) if parts else 0)
            last = codes[-1] // 3
            parts.append((row["at"], codes, copies))
            after: dict = {}
            for entry, top, cost, piece in zip(row["entries"], row["exits"], row["costs"], row["audits"], strict=True):
                if entry in heads:
                    before, audit, _ = heads[entry]
                    offer(after, before + cost, (audit, piece, audit[2] + len(piece), entry), (top, None))
            heads = after
    if parts:
        yield finish()


def damage(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with planted faults, by a hash of conversation and turn; nulls are one space."""
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled(id_col), F.lit(":"), filled(turn_col)).cast("binary")) % 20
    rows = conversations.select(F.col(id_col), F.col(turn_col), filled(role_col).alias(role_col), filled(text_col).alias(text_col), kind.alias("__kind")).where("__kind <> 0")
    text = F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.regexp_replace(text_col, "[.!?]", "")).otherwise(F.col(text_col))
    return rows.select(
        id_col, turn_col, F.when(F.col("__kind") == 4, "user").otherwise(F.col(role_col)).alias(role_col), text.alias(text_col),
        F.explode(F.when(F.col("__kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("__copy"),
    ).drop("__copy")


class Repaired(NamedTuple):
    """``report``: one row for each conversation; ``rows``: the repaired conversations, ordered by (``place``, ``part``)."""

    report: DataFrame
    rows: DataFrame


def repair(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repaired:
    """Report (id, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``) and repaired rows (id, ``place``, ``part``, role, text)."""
    spark = conversations.sparkSession
    filled = [F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(new) for name, new in ((role_col, "role"), (text_col, "text"))]
    rows = conversations.select(F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), *filled)
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    placed = step(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))

    initial = F.substring("role", 1, 1)
    bare = F.rtrim("text", F.lit(SPACE))
    facts = step(placed.select(
        "at", "conv", "turn", "copies", F.xxhash64("role", "text").alias("h"), F.xxhash64(F.lit(1), "text", "role").alias("g"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("initial"),
        (bare == "").alias("empty"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("short"),
    ))
    first = facts.groupBy("conv", "h", "g").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    facts = facts.drop("h", "g").join(first, "at", "left")
    sound = ~F.col("empty") & F.col("first").isNotNull()
    facts = step(facts.select(
        "at", "conv", "turn", "copies", (F.col("initial") * 3 + F.when(~sound, MUST_GO).when(F.col("short"), CUT_SHORT).otherwise(SOUND)).alias("code"),
        F.when(F.col("empty"), F.col("copies")).otherwise(0).alias("blank"),
        F.when(F.col("empty"), 0).otherwise(F.col("copies") - F.when(sound, 1).otherwise(0)).alias("duplicate"),
        F.when(sound & F.col("short"), 1).otherwise(0).alias("truncated"),
    ))
    kind = facts.schema["conv"].dataType.simpleString()
    with batches_of(spark, 10_000):
        ordered = facts.select("at", "conv", "code", "copies").repartitionByRange("at").sortWithinPartitions("at")
        parts = step(ordered.mapInArrow(_parse_stream(FRAGMENT_ROWS), f"conv {kind}, {PARTS_DDL}"))
        fields = ["conv", *[name for name, _ in FINAL]]
        broken = parts.where("NOT whole").drop("whole", "ops", "cost", "audit").repartition("conv").sortWithinPartitions("conv", "at")
        done = step(parts.where("whole").select(*fields).unionByName(broken.mapInArrow(_join_stream, f"conv {kind}, {FINAL_DDL}")))

    turns = facts.groupBy("conv", "turn").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    report = turns.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")],
    )
    decided = done.where("cost IS NOT NULL").select(F.col("conv").alias("other"), "illegal", "cost", "audit")
    report = report.join(decided, F.col("conv").eqNullSafe(F.col("other"))).select(
        F.col("conv").alias(id_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    edits = done.select("at", F.posexplode("ops").alias("k", "edits")).select((F.col("at") + F.col("k")).alias("at"), "edits")
    made = placed.join(edits.where("edits <> 'D'"), "at").select("conv", "at", "role", "text", F.posexplode(F.split("edits", "")).alias("part", "edit"))
    made = made.where("edit IN ('K', 'U', 'A', 'u', 'a')")
    role = F.when(F.col("edit") == "K", F.col("role")).when(F.lower("edit") == "u", "user").otherwise("assistant")
    text = F.when(F.col("edit").isin("u", "a"), "").otherwise(F.col("text"))
    return Repaired(report, made.select(F.col("conv").alias(id_col), F.col("at").alias("place"), "part", role.alias(role_col), text.alias(text_col)))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, digest, schema = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        schema = pa.schema([("conv", batch.column(0).type), ("sha256", pa.string())])
        names, hexes = [], []
        for name, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if digest is not None and name == conv:
                digest.update(b"\n")
            else:
                if digest is not None:
                    names.append(conv)
                    hexes.append(digest.hexdigest())
                conv, digest = name, hashlib.sha256()
            digest.update(line)
        yield table({"conv": names, "sha256": hexes}, schema)
    if digest is not None:
        yield table({"conv": [conv], "sha256": [digest.hexdigest()]}, schema)


def digests(rows: DataFrame, id_col: str = "conv_id", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines, read as a stream: id, ``sha256``."""
    lines = rows.select(F.col(id_col).alias("conv"), F.concat(role_col, F.lit(":"), text_col).cast("binary").alias("line"), "place", "part")
    lines = lines.repartition("conv").sortWithinPartitions("conv", "place", "part").select("conv", "line")
    kind = lines.schema["conv"].dataType.simpleString()
    with batches_of(rows.sparkSession, 1024):
        return step(lines.mapInArrow(_digests, f"conv {kind}, sha256 string")).withColumnRenamed("conv", id_col)
