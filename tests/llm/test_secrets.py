"""Secret scans against a letter-by-letter version, on planted secrets and on clean texts."""

from __future__ import annotations

import hashlib
import random
import re
import string
import time

from pyspark.sql import functions as F

from samplekit.llm import secret_scan as secrets

TOKEN = set(string.ascii_letters + string.digits + "+/_.=~-")
LETTERS = string.ascii_letters + string.digits


def rnd(r, n, letters=LETTERS):
    return "".join(r.choice(letters) for _ in range(n))


def base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def novel(text, dictionary, share):
    body = text.encode().decode("latin-1")  # one character a byte
    low = body.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    near = [False] * len(body)
    for word in (w.decode() for w in secrets.SENSITIVE):
        at = low.find(word)
        while at >= 0:
            stop, breaks = at + len(word), 0
            for p in range(at, len(body)):
                if p >= stop + secrets.REACH:
                    break
                breaks += p >= stop and body[p] == "\n"
                if breaks == 2:
                    break
                near[p] = True
            at = low.find(word, at + len(word))
    places, p = [], 0
    while p < len(body):
        if near[p] and body[p] in TOKEN:
            end = p
            while end < len(body) and body[end] in TOKEN:
                end += 1
            at = p
            pieces = re.split("=", body[p:end].rstrip("="))
            for k, piece in enumerate(pieces):
                tail = end if k == len(pieces) - 1 else at + len(piece)
                value = body[at:tail]
                inner = value.lstrip("=.-/")
                start = at + len(value) - len(inner)
                stop = start + len(inner.rstrip(".-/"))
                if stop - start >= secrets.TOKEN_CHARS:
                    places.append((start, stop))
                at += len(piece) + 1
            p = end
        else:
            p += 1
    taken = [(len(text[:a].encode()), len(text[:z].encode())) for a, _, z in base(text)]
    found, meter = [], secrets.Novelty(dictionary)
    for start, stop in places:
        if any(a < stop and start < z for a, z in taken):
            continue
        raw = body.encode("latin-1")
        value = body[start:stop]
        kinds = ["d" if c.isdigit() else "l" if c.islower() and c.isascii() else "u" if c.isupper() and c.isascii() else "" for c in value]
        changes = sum(bool(a != b and a and b) and (a, b) != ("u", "l") for a, b in zip(kinds, kinds[1:]))
        if changes < 4 or 5 * changes < len(value):
            continue
        if meter.marginal(raw[max(0, start - 192) : start], raw[start:stop], raw[stop : stop + 192]) >= share * (stop - start):
            place = lambda at: len(raw[:at].decode())
            found.append((place(start), 3, place(stop)))
    return found


def expected(rows, dictionary):
    for i, text in rows:
        own = sorted(base(text)), sorted(base(text) + novel(text, dictionary, 0.4))
        shown = [",".join(f"{secrets.KINDS[k]}:{a}:{z}" for a, k, z in spans) for spans in own]
        counts = [sum(k == n for _, k, _ in own[0]) for n in range(3)]
        yield (i, *counts, hashlib.sha256(shown[0].encode()).hexdigest(), shown[1])


COLUMNS = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def planted(r):
    """Texts, and the secret in each that the fixed patterns miss."""
    value = rnd(r, 40, LETTERS + "+/")
    yield f"export AWS_SECRET_ACCESS_KEY={value}\nnext line", value
    value = rnd(r, 36)
    yield f"é Authorization: Bearer {value}, then more é text", value
    value = rnd(r, 32)
    yield f"connect(\n  private_key:\n    '{value}')", value
    value = rnd(r, 24)
    yield f"postgres://user:{value}@host/base", value
    value = "ghp_" + rnd(r, 30)
    yield f'auth "{value}"', value


def test_against_brute_force(spark, docs, nothing):
    r = random.Random(3)
    rows = [(1000 + k, text) for k, (text, _) in enumerate(x for _ in range(12) for x in planted(r))]
    rows += [(2000, 'Password: "hunter22" and passwd=abc token :  0badc0ffee ſecret = abcdefg SECRET=abcdef'), (2001, f"é AKIA{rnd(r, 20, string.ascii_uppercase)} AKIA12 {'deadbeef' * 3} {'0' * 23}"), (2002, f"token={'a1' * 40} key {'ab12' * 20}"), (2003, f"key = {rnd(r, 9000)} done"), (2004, "api_key\n= x1y2z3"), (2005, f"key=={rnd(r, 30)}== ==="), (2006, "token : secret = password=token=abcdef"), (2006, "token : secret = password=token=abcdef")]
    both = docs.select("doc_id", "text", "spans", "term").unionByName(spark.createDataFrame([(*x, "s", "t") for x in rows], "doc_id long, text string, spans string, term string")).repartition(4)
    dictionary = secrets.identifiers(both)
    want = sorted(expected([(x.doc_id, x.text or "") for x in both.collect()], dictionary), key=str)
    got = rows_of(secrets.op12_secret_scan(both))
    long = {w[0] for w in want if w[0] == 2003}
    assert [g for g in got if g[0] not in long] == [w for w in want if w[0] not in long]
    assert rows_of(secrets.op12_secret_scan(both.repartition(1))) == got
    assert next(g[-1] for g in got if g[0] == 2003) == "novel:6:9006"
    assert secrets.op12_secret_scan(nothing).count() == 0
    assert secrets.identifiers(nothing) == b""


def test_planted_secrets_are_found_and_words_left_alone(spark):
    from conftest import words

    r = random.Random(8)
    plants = [x for _ in range(60) for x in planted(r)]
    names = ["keyManagerFactoryBean", "session_token_expiry_seconds", "private static final AuthenticationProvider", "auth2FlowStep version v2.14.3-release on 2024-05-06", "tokenizer4 of utf8 texts", "certificate 1234567890123456"]
    clean = [f"{words(k, 30)} {names[k % len(names)]} {words(k + 500, 30)}" for k in range(120)]
    rows = [(k, f"{words(k, 20)}\n{text}") for k, (text, _) in enumerate(plants)] + [(10_000 + k, t) for k, t in enumerate(clean)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hit = 0
    for x in secrets.find_secrets(df).join(df, "doc_id").collect():
        spans = [x.text[s.start : s.stop] for s in x.spans]
        if x.doc_id >= 10_000:
            assert not spans, (x.text, spans)
        else:
            hit += plants[x.doc_id][1] in " ".join(spans)
    assert hit >= 0.97 * len(plants), hit


def test_masked_texts_and_clashing_names(spark):
    secret = rnd(random.Random(1), 40)
    rows = [(1, f"a token={secret} b é {'0123456789abcdef' * 2}", "x", 1, 2), (2, None, "y", 3, 4), (None, "plain", None, 5, 6), (3, f"Bearer {secret}!", "z", 7, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, body long, clean long")
    got = secrets.mask_secrets(df)
    assert got.columns == df.columns
    assert {(r.doc_id, r.row, r.body, r.clean): r.text for r in got.collect()} == {(1, "x", 1, 2): "a [assign] b é [hex]", (2, "y", 3, 4): None, (None, None, 5, 6): "plain", (3, "z", 7, 8): "Bearer [novel]!"}


def test_long_texts_of_marks_alone(spark):
    df = spark.createDataFrame([(1, "token " * 200_000), (2, "key=" * 200_000), (3, "a1b2C3d4" * 100_000)], "doc_id long, text string").withColumn("n", F.lit(1))
    began = time.time()
    assert {r.doc_id: r.spans for r in secrets.op12_secret_scan(df).collect()} == {1: "", 2: "", 3: ""}
    assert time.time() - began < 40
