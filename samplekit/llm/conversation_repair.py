"""Repair of the structure of conversations: a weighted generalised LR parse over the grammar of roles.

Rows are dealt out by range of (conversation, turn), so that a conversation of a third of all rows is spread over many tasks, and
parsed in order as they stream by. A conversation that lies whole in one partition is repaired at once. One that is cut by
the edge of a partition, or has more rows than a segment holds, is parsed segment by segment, each from every stack that the grammar can be in;
what leads from stack to stack is then joined up in order. Only the digest of such a conversation's text, a chain by definition,
goes through one task, which holds a row at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from samplekit.llm.common import materialize
from samplekit.llm.role_grammar import GIVEN, ROLES, START, Automaton, Frontier, cheapest, follow_on, parse, pieces

BLANK = " \t\n\x0b\x0c\r"
SEGMENT_ROWS, SEGMENT_CHARS = 20_000, 16 << 20  # of a conversation that a task holds at once
PART_ROWS = 500_000  # rows for which there is one partition at least
LEGAL = ("su", "ua", "au")
COUNTS = ("blank", "duplicate", "truncated", "illegal")
TABLE = "array<struct<entry: array<int>, leaves: array<int>, cost: bigint, audit: string, gives: string>>"
PASS_SCHEMA = f"""kind string, conv_id long, no_id boolean, segment long, idx long, role string, text string, {', '.join(f'{c} long' for c in COUNTS)},
  first_initial string, last_initial string, cost long, audit string, repaired_sha256 string, ways {TABLE}"""


def _space(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def _spaced(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _space("role").alias("role"), _space("text").alias("text"))


def damage(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) as the test of the repair wants them, by crc32 of "conv_id:turn" modulo 20: 0 goes, 1 loses its text, 2 its sentence ends, 3 is there twice, 4 gets the role user. Nulls are one space, but ids and turns stay null."""
    how = F.crc32(F.concat(_space("conv_id"), F.lit(":"), _space("turn")).cast("binary")) % 20
    text = F.when(how == 1, "").when(how == 2, F.translate(_space("text"), ".!?", "")).otherwise(_space("text"))
    own = rows.select("conv_id", "turn", F.when(how == 4, "user").otherwise(_space("role")).alias("role"), text.alias("text"), how.alias("how")).where("how <> 0")
    return own.withColumn("copy", F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("how", "copy")


def _with_faults(rows: DataFrame) -> DataFrame:
    """rows with row_no and fault: "b", "d", "t" or "", the first of blank, duplicate (role and text seen earlier in the conversation) and truncated. A written table."""
    whole = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("conv_id", "role", "text")]
    own = materialize(rows.withColumns({"k1": F.xxhash64(*whole), "k2": F.xxhash64(F.lit(1), *whole), "row_no": F.monotonically_increasing_id()}))
    order = F.struct(F.col("turn").isNotNull().alias("has"), "turn", "row_no")
    told_twice = own.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1").drop("n")
    last = F.substring(F.rtrim(F.col("text"), F.lit(BLANK)), -1, 1)
    fault = F.when(F.length(last) == 0, "b").when(order > F.col("first"), "d").when(~last.isin(".", "!", "?"), "t").otherwise("")
    return own.join(told_twice, ["k1", "k2"], "left").select("conv_id", "turn", "role", "text", F.xxhash64("role", "text").alias("tie"), "row_no", fault.alias("fault"))


class _Open:
    """The part of a conversation that a task has read and not yet handed on."""

    def __init__(self, conv_id: int | None, *, cut: bool) -> None:
        self.conv_id, self.cut = conv_id, cut
        self.rows: list[tuple[str, str, str]] = []  # role, text, fault
        self.chars = 0

    def add(self, role: str, text: str, fault: str) -> None:
        self.rows.append((role, text, fault))
        self.chars += len(text)

    def full(self, most: int) -> bool:
        return len(self.rows) >= most or self.chars >= SEGMENT_CHARS

    def counts(self) -> dict[str, object]:
        initials = [role[:1] for role, _, _ in self.rows]
        faults = [fault for _, _, fault in self.rows]
        out = {name: faults.count(fault) for name, fault in zip(COUNTS, "bdt")}
        return out | {"illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "first_initial": initials[0], "last_initial": initials[-1]}

    def symbols(self) -> list[tuple[str, bool, bool]]:
        return [(role[:1], fault in ("b", "d"), fault == "t") for role, _, fault in self.rows]


def _repaired(audit: str, gives: str, rows: Iterator[tuple[str, str, str]]) -> Iterator[tuple[str, str]]:
    """Role and text of the rows that the edits leave."""
    for edit, initial in zip(audit, gives, strict=True):
        role, text = ("", "") if edit == "I" else next(rows)[:2]
        if edit != "D":
            yield role if edit == "K" else GIVEN[initial], text


def _whole(grammar: Automaton, own: _Open, with_rows: bool) -> Iterator[dict[str, object]]:
    way = cheapest(grammar, parse(grammar, own.symbols()))
    steps = pieces(way)
    audit, gives = "".join(e for e, _ in steps), "".join(g for _, g in steps)
    left = list(_repaired(audit, gives, iter(own.rows)))
    text = "\n".join(f"{role}:{text}" for role, text in left)
    key = {"conv_id": own.conv_id, "no_id": own.conv_id is None}
    yield {"kind": "whole", "cost": way[0], "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest(), **key, **own.counts()}
    for idx, (role, text) in enumerate(left) if with_rows else ():
        yield {"kind": "repaired", "idx": idx, "role": role, "text": text, **key}


def _cut(grammar: Automaton, own: _Open, segment: int) -> Iterator[dict[str, object]]:
    symbols, ways = own.symbols(), []
    for entry in grammar.stacks():
        for leaves, way in parse(grammar, symbols, entry).items():
            steps = pieces(way)
            ways.append({"entry": list(entry), "leaves": list(leaves), "cost": way[0], "audit": "".join(e for e, _ in steps), "gives": "".join(g for _, g in steps)})
    key = {"conv_id": own.conv_id, "no_id": own.conv_id is None, "segment": segment}
    yield {"kind": "segment", "ways": ways, **key, **own.counts()}
    for idx, (role, text, _) in enumerate(own.rows):
        yield {"kind": "row", "idx": idx, "role": role, "text": text, **key}


def _batches(rows: Iterator[dict[str, object]], schema: pa.Schema, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held: list[dict[str, object]] = []
    size = 0
    for row in rows:
        held.append(row)
        size += 200 + sum(len(v) for v in row.values() if isinstance(v, str)) + sum(2 * len(w["audit"]) for w in row.get("ways") or ())  # type: ignore[attr-defined]
        if size > limit:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _columns(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def _parsed(rows: Iterator[tuple], with_rows: bool, segment_rows: int) -> Iterator[dict[str, object]]:
    """What a partition in order says: whole conversations, and segments of those at its edges or beyond a segment's size."""
    grammar, context = Automaton(ROLES, "C"), TaskContext.get()
    segment, own = (context.partitionId() if context else 0) << 32, None
    for conv_id, role, text, fault in rows:
        new = own is None or conv_id != own.conv_id
        if own is not None and (new or own.full(segment_rows)):
            yield from _whole(grammar, own, with_rows) if new and not own.cut else _cut(grammar, own, segment)
            segment += 1
            own = _Open(conv_id, cut=not new)
        elif own is None:
            own = _Open(conv_id, cut=True)
        own.add(role, text, fault)
    if own is not None:
        yield from _cut(grammar, own, segment)


def _joined(rows: Iterator[tuple]) -> Iterator[dict[str, object]]:
    """Of the segments of one conversation after the other, in order: its totals, and for each segment the part of the cheapest audit that falls to it."""
    grammar = Automaton(ROLES, "C")
    for (conv_id, no_id), parts in groupby(rows, key=lambda r: r[:2]):
        frontier: Frontier = {(0,): START}
        segments, totals, last = [], dict.fromkeys(COUNTS, 0), None
        for _, _, segment, ways, *counts, first_initial, last_initial in parts:
            frontier = follow_on(frontier, [(tuple(w["entry"]), tuple(w["leaves"]), w["cost"], w["audit"], w["gives"]) for w in ways])
            segments.append(segment)
            for name, n in zip(COUNTS, counts, strict=True):
                totals[name] += n
            totals["illegal"] += last is not None and last + first_initial not in LEGAL
            last = last_initial
        way = cheapest(grammar, frontier)
        steps = pieces(way)
        yield {"kind": "total", "conv_id": conv_id, "no_id": no_id, "cost": way[0], "audit": "".join(e for e, _ in steps), **totals}
        for segment, (edits, gives) in zip(segments, steps, strict=True):
            yield {"kind": "plan", "conv_id": conv_id, "no_id": no_id, "segment": segment, "idx": -1, "audit": edits, "role": gives}


def _applied(rows: Iterator[tuple], with_rows: bool) -> Iterator[dict[str, object]]:
    """Plans, each followed by the rows of its segment: the digest of each conversation, and its repaired rows if asked for."""
    for (conv_id, no_id), parts in groupby(rows, key=lambda r: r[:2]):
        key, digest, idx = {"conv_id": conv_id, "no_id": no_id}, hashlib.sha256(), 0
        for role, text in _by_plan(parts):
            digest.update(f"{chr(10) if idx else ''}{role}:{text}".encode())
            if with_rows:
                yield {"kind": "repaired", "idx": idx, "role": role, "text": text, **key}
            idx += 1
        yield {"kind": "digest", "repaired_sha256": digest.hexdigest(), **key}


def _by_plan(parts: Iterator[tuple]) -> Iterator[tuple[str, str]]:
    for _, segment in groupby(parts, key=lambda r: r[2]):
        (*_, gives, _, edits) = next(segment)
        yield from _repaired(edits, gives, ((role, text, "") for *_, role, text, _ in segment))


def _run(df: DataFrame, names: tuple[str, ...], work: Callable[..., Iterator[dict[str, object]]], *more: object) -> DataFrame:
    schema = to_arrow_schema(_parse_datatype_string(PASS_SCHEMA))
    return df.select(*names).mapInArrow(lambda batches: _batches(work(_columns(batches, *names), *more), schema), PASS_SCHEMA)


def repair(rows: DataFrame, *, with_rows: bool = False, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Repair of conversations, from rows (conv_id, turn, role, text) in the order of turn, nulls first; ties by a hash of role and text.

    One row of kind "whole" for each conv_id, also for the null one: blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. With with_rows also
    rows of kind "repaired": conv_id, idx (place from 0), role, text. Nulls in role and text are one space; a role is known by its first letter; other columns aren't read; rows that are alike
    in all columns are duplicates of the first; an empty table gives no row. A conversation may have any number of rows, of any length: a task holds segment_rows of them at once.
    """
    own = _with_faults(_spaced(rows))
    parts = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), own.count() // PART_ROWS + 1)
    order = ["conv_id", "turn", "tie", "row_no"]
    ordered = own.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    done = materialize(_run(ordered, ("conv_id", "role", "text", "fault"), _parsed, with_rows, segment_rows))
    key, counts = ["conv_id", "no_id"], [*COUNTS, "first_initial", "last_initial"]
    segments = done.where("kind = 'segment'").repartition(*key).sortWithinPartitions(*key, "segment")
    joined = materialize(_run(segments, (*key, "segment", "ways", *counts), _joined))
    plans = joined.where("kind = 'plan'").union(done.where("kind = 'row'"))
    applied = _run(plans.repartition(*key).sortWithinPartitions(*key, "segment", "idx"), (*key, "segment", "role", "text", "audit"), _applied, with_rows)
    applied = materialize(applied) if with_rows else applied
    digests = applied.where("kind = 'digest'").select(F.struct(*key).alias("of"), F.col("repaired_sha256").alias("digest"))
    totals = joined.where("kind = 'total'").join(digests, F.struct(*key).eqNullSafe(F.col("of"))).withColumns({"kind": F.lit("whole"), "repaired_sha256": F.col("digest")})
    shown = ["kind", "conv_id", "idx", "role", "text", *COUNTS, "cost", "audit", "repaired_sha256"]
    out = done.where("kind in ('whole', 'repaired')").select(*shown).union(totals.select(*shown))
    return out.union(applied.where("kind = 'repaired'").select(*shown)) if with_rows else out


def op13_conversation_repair(conversations: DataFrame, **how: int) -> DataFrame:
    """The contract's row for every conv_id of the table, the null one included, after its damage; a conversation of which no row is left has zeros, an empty audit and the hash of nothing."""
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    damaged = damage(own)
    turns = damaged.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    repaired = repair(damaged, **how).drop("kind", "idx", "role", "text")
    ids = own.select("conv_id").distinct()
    renamed = [df.withColumnRenamed("conv_id", name) for df, name in ((turns, "turns_of"), (repaired, "repair_of"))]
    joined = ids.join(renamed[0], F.col("conv_id").eqNullSafe(F.col("turns_of")), "left").join(renamed[1], F.col("conv_id").eqNullSafe(F.col("repair_of")), "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *COUNTS, "cost")]
    return joined.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
