"""Secrets: fixed patterns, then strings in sensitive places that a compressor finds new.

The dictionary that primes the compressor is learnt from the corpus: the words and identifiers that most documents hold, counted over
all of them. A candidate is a run of token characters on a line behind a word that speaks of secrets. Its novelty is what it adds to
the compressed size of the code around it, under that dictionary: names, words and what the surroundings repeat
add little, random strings add nearly all of their bytes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplekit.llm.common import id_and_bytes, materialize, slices

#: Kinds in the order in which they are listed, and their patterns; all of ASCII, so that bytes do.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
ASSIGNED = (b"passw", b"secret", b"token", b"apikey", b"api_key")  # without one of these nothing is assigned
#: Words that make a place sensitive, in either case, within longer names as well.
SENSITIVE = (b"key", b"auth", b"bearer", b"credential", b"passw", b"passphrase", b"passcode", b"pwd", b"secret", b"token", b"private", b"signature", b"certificate", b"session", b"cookie", b"jwt", b"akia", b"://")
HEX_MARKS = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_.=~-]+")
#: Identifiers and words that may enter the dictionary: none with a digit, as secrets that are copied about have.
IDENTIFIER = "[A-Za-z_]{4,32}"
CHANGES = re.compile(rb"(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]|(?<=[a-z])[A-Z]")
TOKEN_CHARS = 12  # of a candidate at least
REACH = 96  # bytes behind a sensitive word in which a candidate begins, on its line or the next one
AROUND = 192  # bytes of code before and behind a candidate
LONGEST = 4096  # bytes of a candidate that one measure covers
DICTIONARY_BYTES = 48 << 10
FOUND = "doc_id long, key long, spans array<struct<kind: string, start: bigint, stop: bigint, novelty: double>>"


def identifiers(docs: DataFrame, *, text_col: str = "text", most_bytes: int = DICTIONARY_BYTES, least_docs: int = 3) -> bytes:
    """The words and identifiers of most documents, ties in alphabetical order, as one text of most_bytes or fewer, the most frequent last: compressors reach what is near for less. Counts cover all documents; only what fits in the text comes to the driver."""
    runs = F.array_distinct(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"{IDENTIFIER}+"), F.lit(0)))
    counts = materialize(docs.select(F.explode(runs).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") >= least_docs) & (F.length("word") <= 32)))
    enough, found, least = most_bytes // 5, 0, 0
    for row in counts.groupBy(F.floor(F.log2("n")).alias("level")).count().orderBy(F.desc("level")).collect():  # one row for each power of two
        found, least = found + row["count"], 2 ** row.level
        if found >= enough:
            break  # the most frequent are all at this level or above, so that a task hands on few others
    best = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(enough).collect()
    out, size = [], 0
    for row in best:
        size += len(row.word) + 1
        if size > most_bytes:
            break
        out.append(row.word)
    return " ".join(reversed(out)).encode()


class Novelty:
    """Marginal compressed bytes under a dictionary."""

    def __init__(self, dictionary: bytes) -> None:
        raw = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(dictionary) >= 8 else None
        self.packer = zstandard.ZstdCompressor(level=6, dict_data=raw, write_checksum=False, write_content_size=False, write_dict_id=False)

    def marginal(self, before: bytes, candidate: bytes, behind: bytes) -> int:
        """Bytes that the candidate adds to its surroundings."""
        return len(self.packer.compress(before + candidate + behind)) - len(self.packer.compress(before + behind))


def _base(body: bytes, low: bytes) -> list[tuple[int, int, int]]:
    """kind's number, start, stop of base spans, in bytes. low: the body in lower case; what can't match isn't searched."""
    out = []
    if any(word in low for word in ASSIGNED):
        out += [(0, m.start(), m.end()) for m in ASSIGN.finditer(body) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in body:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(body) if m.end() - m.start() >= 20]
    if b"x" * 24 in body.translate(HEX_MARKS):
        out += [(2, m.start(), m.end()) for m in HEX.finditer(body)]
    return out


def _places(low: bytes, word: bytes) -> Iterator[tuple[int, int]]:
    at = low.find(word)
    while at >= 0:
        yield at, at + len(word)
        at = low.find(word, at + len(word))


def _candidates(body: bytes, low: bytes) -> Iterator[tuple[int, int]]:
    """Token runs that begin behind a sensitive word, each once, in order."""
    told = 0
    for start, end in sorted(place for word in SENSITIVE for place in _places(low, word)):
        stop = min(len(body), end + REACH)
        first = body.find(b"\n", end, stop)
        second = body.find(b"\n", first + 1, stop) if first >= 0 else -1
        stop = second if second >= 0 else stop
        at = max(told, start)
        while at < stop and (m := CANDIDATE.search(body, at)) and m.start() < stop:
            at = told = m.end()
            yield from _parts(body, m.start(), m.end())


def _parts(body: bytes, start: int, stop: int) -> Iterator[tuple[int, int]]:
    """What stands between a run's signs of equality, those at its end left to it, without signs around it."""
    filled = start + len(body[start:stop].rstrip(b"="))
    while start < stop:
        sign = body.find(b"=", start, filled)
        end = sign if sign >= 0 else stop
        low, high = end - len(body[start:end].lstrip(b"=.-/")), start + len(body[start:end].rstrip(b".-/"))
        if high - low >= TOKEN_CHARS:
            yield low, high
        start = end + 1


def _varied(value: bytes) -> bool:
    """Whether letters meet digits, or capitals follow small letters, at a fifth of the places and four or more: names, dates and versions do so less often."""
    return len(CHANGES.findall(value)) >= max(4, len(value) / 5)


def novel_spans(body: bytes, low: bytes, novelty: Novelty, taken: list[tuple[int, int, int]], share: float) -> list[tuple[int, int, float]]:
    """start, stop and novelty (added bytes a byte) of candidates outside base spans whose novelty is share or more."""
    out, edges = [], sorted((a, z) for _, a, z in taken)
    starts = np.array([a for a, _ in edges], np.int64)
    reach = np.maximum.accumulate(np.array([z for _, z in edges], np.int64)) if edges else starts
    for start, stop in _candidates(body, low):
        before = int(np.searchsorted(starts, stop, "left"))  # spans that begin before the candidate's end
        if before and reach[before - 1] > start or not _varied(body[start:stop]):
            continue
        left, right = body[max(0, start - AROUND) : start], body[stop : stop + AROUND]
        added = sum(novelty.marginal(left, body[at : min(stop, at + LONGEST)], right) for at in range(start, stop, LONGEST)) / (stop - start)
        if added >= share:
            out.append((start, stop, added))
    return out


def _scan(dictionary: bytes, share: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("novelty", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        for batch in slices(batches):
            spans = []
            for body in batch.column("body"):
                text = body.as_py()
                low = text.lower()
                base = _base(text, low)
                found: list[tuple[int, int, int, float | None]] = [(a, k, z, None) for k, a, z in base]
                found += [(a, 3, z, new) for a, z, new in novel_spans(text, low, novelty, base, share)]
                if found:
                    points = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
                    place = lambda at, points=points: int(points[at - 1]) if at else 0
                    found = [(place(a), k, place(z), new) for a, k, z, new in found]
                spans.append([{"kind": KINDS[k], "start": a, "stop": z, "novelty": new} for a, k, z, new in sorted(found, key=lambda f: f[:3])])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(spans, pa.list_(kind))], ["doc_id", "key", "spans"])

    return scan


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: float = 0.4, dictionary: bytes | None = None) -> DataFrame:
    """Per row of docs: doc_id, key (xxhash64 of the text), spans (array of kind, start, stop, novelty), in code points, ends exclusive, by start, then in the order of KINDS.

    share: compressed bytes that a byte of a candidate must add. dictionary: what primes the compressor; that of docs where none is given. Null and empty texts have no spans, a null
    id stays null, repeated rows each give a row, an empty table gives none, other columns aren't read. A candidate that touches a base span isn't listed again;
    one of over 4096 bytes is measured in parts.
    """
    words = identifiers(docs, text_col=text_col) if dictionary is None else dictionary
    return id_and_bytes(docs, id_col, text_col).withColumn("key", F.xxhash64("body")).mapInArrow(_scan(words, share), FOUND)


def mask_secrets(docs: DataFrame, *, text_col: str = "text", share: float = 0.4, dictionary: bytes | None = None) -> DataFrame:
    """docs with each run of overlapping spans of text_col replaced by its first kind in brackets, "[hex]". All columns and rows stay; a null text stays null."""
    words = identifiers(docs, text_col=text_col) if dictionary is None else dictionary
    held = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"))

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(words)
        for batch in slices(batches):
            texts = []
            for body in batch.column("body"):
                text, out, at = body.as_py(), [], 0
                low = text.lower()
                base = _base(text, low)
                spans = sorted([(a, k, z) for k, a, z in base] + [(a, 3, z) for a, z, _ in novel_spans(text, low, novelty, base, share)])
                for a, k, z in spans:
                    if a >= at:
                        out += [text[at:a], f"[{KINDS[k]}]".encode()]
                    at = max(at, z)
                texts.append(b"".join((*out, text[at:])).decode())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "clean"])

    row = held.schema["row"].dataType.simpleString()
    done = held.mapInArrow(mask, f"row {row}, clean string")
    return done.select(*(F.when(F.col("row")[c].isNotNull(), F.col("clean")).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))


def op12_secret_scan(docs: DataFrame) -> DataFrame:
    """The contract's row for every row of docs; odd rows are those of find_secrets."""
    found = find_secrets(docs)
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    base = listed(F.filter("spans", lambda s: s["kind"] != "novel"))
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts[:3], F.sha2(base, 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), counts[3])
