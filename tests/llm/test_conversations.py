"""Conversation repair against brute force: every sequence of edits on short conversations, and a plain parse on longer ones."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from samplekit.llm import conversation_repair as repair
from samplekit.llm import role_grammar as grammar

BLANK = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, cost long, kind string, audit string"


def spaced(value):
    return " " if value is None else str(value)


def damaged(rows):
    for conv_id, turn, role, text in rows:
        how = zlib.crc32(f"{spaced(conv_id)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        yield from [(conv_id, turn, "user" if how == 4 else role, text)] * (0 if how == 0 else 2 if how == 3 else 1)


def faults(rows):
    seen = set()
    for role, text in rows:
        bare = text.rstrip(BLANK)
        yield "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
        seen.add((role, text))


def all_edits(rows, marks, inserts=3):
    """Every way to edit the rows into the grammar, as (cost, audit, repaired rows); at most so many rows are inserted at one place."""
    found = []

    def go(k, cost, audit, out):
        if k == len(rows):
            for n in range(inserts):
                for new in itertools.product(("user", "assistant"), repeat=n):
                    done = [*out, *((r, "") for r in new)]
                    if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in done)):
                        found.append((cost + 5 * n, audit + "I" * n, done))
            return
        for n in range(inserts):
            for new in itertools.product(("user", "assistant"), repeat=n):
                so_far, paid, told = [*out, *((r, "") for r in new)], cost + 5 * n, audit + "I" * n
                go(k + 1, paid + 2, told + "D", so_far)
                if marks[k] in ("b", "d"):
                    continue
                more = 5 * (marks[k] == "t")
                go(k + 1, paid + more, told + "K", [*so_far, rows[k]])
                for role in ("user", "assistant"):
                    go(k + 1, paid + 1 + more, told + "R", [*so_far, (role, rows[k][1])])

    go(0, 0, "", [])
    return min(found, key=lambda f: f[:2])


def dynamic(rows, marks):
    """The same by states of the grammar: expects s or u, u, a, u or the end."""
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    full = {"u": "user", "a": "assistant"}

    def closed(ways):
        for _ in range(4):
            for state, (cost, audit, out) in list(ways.items()):
                for x in "ua":
                    if (state, x) in after:
                        new = (cost + 5, audit + "I", [*out, (full[x], "")])
                        to = after[state, x]
                        if to not in ways or new[:2] < ways[to][:2]:
                            ways[to] = new
        return ways

    ways = closed({0: (0, "", [])})
    for (role, text), mark in zip(rows, marks, strict=True):
        further = {}

        def offer(to, new):
            if to not in further or new[:2] < further[to][:2]:
                further[to] = new

        for state, (cost, audit, out) in ways.items():
            offer(state, (cost + 2, audit + "D", out))
            if mark in ("b", "d"):
                continue
            more = 5 * (mark == "t")
            if role[:1] in ("s", "u", "a") and (state, role[:1]) in after:
                offer(after[state, role[:1]], (cost + more, audit + "K", [*out, (role, text)]))
            for x in "ua":
                if (state, x) in after:
                    offer(after[state, x], (cost + 1 + more, audit + "R", [*out, (full[x], text)]))
        ways = closed(further)
    return min((ways[s] for s in (0, 3) if s in ways), key=lambda f: f[:2])


def digest(out):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def expected(rows, solve=dynamic):
    out = {}
    for conv_id in {r[0] for r in rows}:
        own = sorted((r for r in damaged([r for r in rows if r[0] == conv_id])), key=lambda r: (r[1] is not None, r[1] or 0))
        pairs = [(r, t) for *_, r, t in own]
        marks, turns = list(faults(pairs)), {t for _, t, *_ in own if t is not None}
        cost, audit, left = solve(pairs, marks) if own else (0, "", [])
        illegal = sum((a[:1] + b[:1]) not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(pairs))
        out[conv_id] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(marks.count(x) for x in "bdt"), illegal, cost, audit, digest(left))
    return out


def got(df):
    rows = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def conversation(r, conv_id, n):
    texts = ["Yes.", "No", "", " \n", "Why? ", "é!\t", "x." * 30, None, "Go on."]
    turns = sorted(r.sample(range(3 * n + 1), n))
    return [(conv_id, t, r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), f"{k}{x}" if (x := r.choice(texts)) and r.random() < 0.8 else x) for k, t in enumerate(turns)]


def test_parse_against_every_sequence_of_edits():
    r = random.Random(5)
    automaton = grammar.Automaton(grammar.ROLES, "C")
    assert len(automaton.stacks()) <= 10
    for k in range(150):
        rows = [(x[2] or " ", x[3] or " ") for x in conversation(r, 0, 3 if k < 3 else r.randint(0, 2))]
        marks = list(faults(rows))
        if k % 2:
            marks = ["" if m == "t" else m for m in marks]
        cost, audit, out = all_edits(rows, marks)
        way = grammar.cheapest(automaton, grammar.parse(automaton, [(role[:1], m in ("b", "d"), m == "t") for (role, _), m in zip(rows, marks, strict=True)]))
        edits = "".join(e for e, _ in grammar.pieces(way))
        assert (way[0], edits) == (cost, audit)
        assert dynamic(rows, marks)[:2] == (cost, audit)


def test_grammar_without_bounded_stacks_is_an_error():
    with pytest.raises(ValueError, match="left recursive"):
        grammar.Automaton({"C": (("u", "C", "a"), ("u", "a"))}, "C").stacks()


@pytest.mark.parametrize("segment_rows", [20_000, 3])
def test_against_brute_force(spark, segment_rows):
    r = random.Random(segment_rows)
    rows = [x for c in range(60) for x in conversation(r, c, r.randint(1, 12))]
    rows += [(None, t, "user", f"{t}.") for t in range(5)] + [(77, None, "assistant", "alone."), (78, None, "system", None), (79, 4, "user", "same."), (79, 4, "user", "same."), (79, 4, "user", "same.")]
    rows += [(c, 0, "user", "goes.") for c in range(1000, 1100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    df = spark.createDataFrame([(*x, 1, "k", "a") for x in rows], SCHEMA).repartition(5)
    want = expected(rows)
    assert got(repair.op13_conversation_repair(df, segment_rows=segment_rows)) == want
    assert got(repair.op13_conversation_repair(df.repartition(1))) == want
    assert any(v[5] == 0 and v[6] == "" for v in want.values()) and max(v[5] for v in want.values()) >= 20
    assert repair.op13_conversation_repair(df.limit(0)).count() == 0


def test_one_conversation_of_most_rows_is_dealt_out(spark):
    """A conversation far longer than a segment: its parse is spread, its rows come out repaired."""
    r = random.Random(9)
    rows = conversation(r, 1, 900) + [x for c in range(2, 12) for x in conversation(r, c, 30)] + [(1, 5000, "user", "Again and again.")] * 300
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    want = expected(rows)
    assert got(repair.op13_conversation_repair(df, segment_rows=50)) == want
    clean = repair.repair(repair.damage(df), with_rows=True, segment_rows=50).where("kind = 'repaired'").collect()
    for conv_id, w in want.items():
        out = [(x.role, x.text) for x in sorted((x for x in clean if x.conv_id == conv_id), key=lambda x: x.idx)]
        assert digest(out) == w[-1]
    own = repair._with_faults(repair._spaced(repair.damage(df)))
    order = ["conv_id", "turn", "tie", "row_no"]
    sizes = [x["count"] for x in own.repartitionByRange(8, *order).groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * sum(sizes) / 8 + 50
