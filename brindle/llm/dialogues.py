"""Repair of conversations by the cheapest edits, each distinct sequence of roles and faults solved once.

A conversation's rows, in the order of their turns, become a signature of one character a row: the role's initial, in upper
case where the text is cut off, or a sign for a row that has to go. Signatures are few where conversations are many; each
distinct one is solved once and the audit, a string of edits, is joined back and replayed on the rows.

Edits: Keep (0), Rerole to user or assistant (1), Delete (2), Insert an empty row of user or assistant (5); a row that is cut
off and stays adds 5. The roles that are left must read ``(s?(ua)+)?``. Roles of replayed rows follow from the audit: they
alternate from user on, after a system row that was kept.

A conversation's rows are never gathered: windows number them, marks are strung together in blocks of BLOCK rows, and rows
stream past the audit and into the digest in order, so what is held for a conversation is a character a row.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Stash

#: Rows of a conversation whose marks are strung together at a time.
BLOCK = 65_536
#: Rows of a batch that leaves a task.
OUT_ROWS = 4096
_SPACE = "\x20\t\n\x0b\x0c\r"
_BLANK, _DUPLICATE = "_", "="
_MUST_GO = _BLANK + _DUPLICATE
KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
CUT_OFF = 5

# States of what has been put out: nothing; a user to be answered; a full exchange; a system row.
_NOTHING, _ASKED, _ANSWERED, _SYSTEM = range(4)
_NEXT = ({"s": _SYSTEM, "u": _ASKED}, {"a": _ANSWERED}, {"u": _ASKED}, {"u": _ASKED})
#: More inserts than this in a row only lead back to a state that was left.
_INSERTS = 2


@functools.lru_cache(maxsize=1 << 16)
def _step(mark: str, below: tuple[float, ...]) -> tuple[float, tuple[float, ...], tuple[tuple[tuple[str, int], ...], ...]]:
    """(base, costs, choices) of a suffix that begins with ``mark`` and goes on with one of costs ``below`` by state.

    ``mark`` is empty behind the last row. ``costs`` are by state and above ``base``, so that few distinct ones occur.
    ``choices[k][state]`` is the cheapest (edit, next state) where k more inserts may follow, the least letter among equals.
    """
    inf = float("inf")
    options: list[list[tuple[float, str, int]]] = [[] for _ in _NEXT]
    for state, then in enumerate(_NEXT):
        if not mark:
            options[state].append((0.0 if state in (_NOTHING, _ANSWERED) else inf, "", state))
            continue
        options[state].append((DELETE + below[state], "D", state))
        if mark not in _MUST_GO:
            extra = CUT_OFF if mark.isupper() else 0
            if (to := then.get(mark.lower())) is not None:
                options[state].append((KEEP + extra + below[to], "K", to))
            options[state] += [(REROLE + extra + below[to], "R", to) for role, to in then.items() if role != "s"]
    level = [min(o) for o in options]
    levels = [level]
    for _ in range(_INSERTS):
        level = [min(o + [(INSERT + level[to][0], "I", to) for role, to in _NEXT[state].items() if role != "s"]) for state, o in enumerate(options)]
        levels.append(level)
    base = min(c for c, _, _ in level)
    return base, tuple(c - base for c, _, _ in level), tuple(tuple((e, to) for _, e, to in choices) for choices in levels)


def solve(signature: str) -> tuple[int, str]:
    """(cost, audit) of a signature: the cheapest edits in order, the least string in ASCII among equals.

    The recursion over suffixes is memoised on a row's mark and the costs behind it, which all signatures of a process share,
    and runs from the last row to the first, so its depth does not grow with the conversation.
    """
    base, costs, end = _step("", ())
    total, made = base, [end]
    for mark in reversed(signature):
        base, costs, choices = _step(mark, costs)
        total += base
        made.append(choices)
    total += costs[_NOTHING]
    audit, state = [], _NOTHING
    for choices in reversed(made):
        for k in range(_INSERTS, -1, -1):
            edit, state = choices[k][state]
            audit.append(edit)
            if edit != "I":
                break
    return int(total), "".join(audit)


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with the planted faults: by a hash of conv_id and turn a row is dropped, emptied,
    stripped of sentence ends, repeated or given to the user. Nulls of any column count as one space; conv_id and turn stay null."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    by = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    text = F.when(by == 1, F.lit("")).when(by == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(by == 4, F.lit("user")).otherwise(space("role"))
    copies = F.when(by == 0, 0).when(by == 3, 2).otherwise(1)
    made = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("_"))
    return made.drop("_")


def marked(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with ``pos`` in their conversation from 1, ``mark``, ``fresh`` (its turn is a new one)
    and ``illegal`` (the initial before and its own do not go together).

    The order is turn, nulls first, then role and text; the first of equal rows is no duplicate. All windows share one exchange.
    """
    of, by_turn = Window.partitionBy("conv_id"), F.asc_nulls_first("turn")
    seen = rows.withColumn("seen", F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(by_turn)) > 1)
    order = of.orderBy(by_turn, "role", "text", "seen")
    initial = F.substring("role", 1, 1)
    pair = F.concat(F.lag(initial).over(order), initial)
    last = F.substring(F.rtrim(F.col("text"), F.lit(_SPACE)), -1, 1)
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    mark = F.when(last == "", _BLANK).when(F.col("seen"), _DUPLICATE).when(~last.isin(".", "!", "?"), F.upper(role)).otherwise(role)
    fresh = F.col("turn").isNotNull() & ~F.lag("turn").over(order).eqNullSafe(F.col("turn"))
    return seen.select("conv_id", "turn", "role", "text", F.row_number().over(order).alias("pos"), mark.alias("mark"), fresh.alias("fresh"), F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"))


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, signature, gaps, blank, duplicate, truncated, illegal) of marked rows; marks are strung together block by block."""
    one = lambda c: F.sum(c.cast("bigint"))
    string = lambda by, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, c))), lambda x: x[c]), "")
    block = F.floor((F.col("pos") - 1) / BLOCK).alias("block")
    parts = rows.groupBy("conv_id", block).agg(
        string("pos", "mark").alias("part"), F.min("turn").alias("first"), F.max("turn").alias("last"), one(F.col("fresh")).alias("turns"),
        one(F.col("mark") == _BLANK).alias("blank"), one(F.col("mark") == _DUPLICATE).alias("duplicate"), one(F.col("mark").isin("S", "U", "A", "X")).alias("truncated"), one(F.col("illegal")).alias("illegal"),
    )
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    gaps = F.coalesce(F.max("last") - F.min("first") + 1 - F.sum("turns"), F.lit(0)).cast("bigint").alias("gaps")
    return parts.groupBy("conv_id").agg(string("block", "part").alias("signature"), gaps, *sums)


def audits(signed: DataFrame, stash: Stash) -> DataFrame:
    """``signed`` (signature) with ``cost`` and ``audit``. Each distinct signature is solved once.

    A signature that more than one in a thousand conversations have is one of fewer than a thousand, which are broadcast; the
    others' groups are small and meet in an ordinary join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [solve(s) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in made], pa.int64()), pa.array([a for _, a in made], pa.string()), batch.column(2)], ["key", "cost", "audit", "n"])

    keyed = signed.withColumn("key", F.sha2("signature", 256))
    once = keyed.groupBy("key").agg(F.first("signature").alias("signature"), F.count("*").alias("n"))
    solved = stash.keep(once.select("key", "signature", "n").mapInArrow(run, "key string, cost bigint, audit string, n bigint"), "solved")
    often = F.col("n") * 1000 > keyed.count()
    common, rare = solved.where(often), solved.where(~often)
    near = keyed.join(F.broadcast(common), "key", "left")
    far = near.where(F.col("n").isNull()).drop("cost", "audit", "n").join(rare, "key")
    return near.where(F.col("n").isNotNull()).unionByName(far).drop("key", "n")


class _Out:
    """Rows of a task, in batches of OUT_ROWS."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows = schema, []

    def add(self, *row) -> bool:
        self.rows.append(row)
        return len(self.rows) >= OUT_ROWS

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [() for _ in self.schema]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)


def repaired(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text) of what the audits (conv_id, audit) make of the marked rows, ordered by conv_id and pos in each partition.

    Each conversation's audit heads its rows, which stream past it.
    """
    kind = rows.schema["conv_id"].dataType
    heads = solved.select("conv_id", F.lit(0).alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text"))
    dealt = heads.unionByName(rows.select("conv_id", "pos", "role", "text")).repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    schema = pa.schema([("conv_id", pa.string() if kind.simpleString() == "string" else pa.int64()), ("pos", pa.int32()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(schema)
        conv, audit, at, made, asked = None, "", 0, 0, False

        def inserts(at: int, asked: bool) -> tuple[int, bool, list[str]]:
            roles = []
            while at < len(audit) and audit[at] == "I":
                roles.append("assistant" if asked else "user")
                at, asked = at + 1, not asked
            return at, asked, roles

        for batch in batches:
            for c, pos, role, text in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                rest = []
                if pos == 0:
                    conv, audit, at, made, asked = c, text, 0, 0, False
                else:
                    edit = audit[at]
                    at += 1
                    if edit != "D":
                        if edit == "R":
                            role = "assistant" if asked else "user"
                        asked = role[:1] == "u"
                        rest.append((role, text))
                at, asked, more = inserts(at, asked)
                for role, text in rest + [(r, "") for r in more]:
                    made += 1
                    if out.add(conv, made, role, text):
                        yield out.take()
            if out.rows:
                yield out.take()

    return dealt.mapInArrow(run, f"conv_id {kind.simpleString()}, pos int, role string, text string")


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of ``role:text`` joined by newlines, of rows that come in order, a conversation at a time."""
    kind = rows.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", pa.string() if kind.simpleString() == "string" else pa.int64()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, sha = _Out(schema), None, None
        for batch in batches:
            for c, pos, role, text in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if pos == 1:
                    if sha is not None and out.add(conv, sha.hexdigest()):
                        yield out.take()
                    conv, sha = c, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
        if sha is not None:
            out.add(conv, sha.hexdigest())
        if out.rows:
            yield out.take()

    return rows.mapInArrow(run, f"conv_id {kind.simpleString()}, repaired_sha256 string")


def repair(conversations: DataFrame, stash: Stash | None = None) -> DataFrame:
    """The planted faults and their repair: each conv_id of ``conversations`` (conv_id, turn, role, text) once, with gaps, blank,
    duplicate, truncated, illegal, cost (bigint), audit and repaired_sha256.

    Null conv_ids are one conversation; null turns come first and count for no gap; null roles and texts are one space. Rows of
    one turn follow by role and text; repeated rows are duplicates. A role with another initial than s, u, a can only be given
    another role or go. A conversation of which nothing is left after the damage has zeros, an empty audit and the digest of an
    empty text. An empty table gives an empty one. Texts of any length stream through; other columns are not read.
    """
    stash = stash or Stash(conversations.sparkSession, "dialogues")
    only = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    rows = stash.keep(marked(damaged(only)), "rows")
    solved = stash.keep(audits(signatures(rows), stash), "audits")
    sums = digests(repaired(rows, solved))
    every = only.select("conv_id").distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    found = solved.select(F.col("conv_id").alias("_a"), *counts, "audit")
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("_a")), "left").join(sums.withColumnRenamed("conv_id", "_b"), F.col("conv_id").eqNullSafe(F.col("_b")), "left")
    empty = F.lit(hashlib.sha256().hexdigest())
    filled: list[Column] = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts]
    return out.select("conv_id", *filled, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
