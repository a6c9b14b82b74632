"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton holds every run of words of every item. The words of a training text are fed to it one
by one; its state says which run of item words ends here and how long that run is. A run as long as the
window (or a whole item, where that is shorter) is a hit.

Automata are built on the driver, one for each block of items, and sent as flat arrays. Runs of words whose neighbours
are neighbours in some item are found by sorted arrays first, so that only what can be a hit is fed to the automata.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from samplekit.llm.common import LOWER, id_and_bytes, keep_only, materialize, remembered, slices, starts_of

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Lower case; every ASCII character that is no letter or digit becomes a space.
TO_WORDS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).translate(LOWER)
BLOCK_BYTES = 2 << 20  # of item text in one automaton: about 150 MB while it is built, 25 MB as arrays
PASS_BYTES = 256 << 20  # of automata that one pass over the documents holds
Items = list[tuple[str | None, list[bytes]]]


class SuffixAutomaton:
    """Of all items (id, words). window: words of a window; an item of fewer words is one window. ids: numbers of words, which new words are added to."""

    def __init__(self, items: Items, window: int, ids: dict[bytes, int] | None = None) -> None:
        self.window = window
        self.ids = {} if ids is None else ids
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.windows: list[tuple[int, str | None]] = []  # states at which windows end
        self.short: list[tuple[int, int, str | None]] = []  # those at which short items end, with their words
        for item, words in items:
            state = 0
            for k, word in enumerate(words, 1):
                state = self._append(state, self.ids.setdefault(word, len(self.ids)))
                if k >= window:
                    self.windows.append((state, item))
            if 0 < len(words) < window:
                self.short.append((state, len(words), item))

    def suffix_state(self, state: int, words: int) -> int:
        """That of the last so many words of a state."""
        while self.length[self.link[state]] >= words:
            state = self.link[state]
        return state

    def _new(self, length: int, link: int, steps: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(steps)
        return len(self.length) - 1

    def _append(self, last: int, word: int) -> int:
        """The state of the text so far and one more word."""
        if word in self.next[last]:
            there = self.next[last][word]
            return there if self.length[there] == self.length[last] + 1 else self._split(last, word, there)
        new, state = self._new(self.length[last] + 1, 0, {}), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            there = self.next[state][word]
            self.link[new] = there if self.length[there] == self.length[state] + 1 else self._split(state, word, there)
        return new

    def _split(self, state: int, word: int, there: int) -> int:
        """Shorter runs of a state get a state of their own."""
        copy = self._new(self.length[state] + 1, self.link[there], dict(self.next[there]))
        self.link[there] = copy
        while state >= 0 and self.next[state].get(word) == there:
            self.next[state][word] = copy
            state = self.link[state]
        return copy


@dataclass
class Flat:
    """An automaton as arrays. Steps are sorted by state << 32 | word."""

    window: int
    steps: np.ndarray
    targets: np.ndarray
    link: np.ndarray
    length: np.ndarray
    owner: np.ndarray  # of a state: that of its last `window` words
    near_short: np.ndarray  # of a state: the nearest one on its links, itself included, at which a short item ends
    owners: np.ndarray  # owners and the numbers of the items that have them, sorted
    owned: np.ndarray
    names: list[str | None]
    short: dict[int, list[tuple[int, str | None]]]  # by state: words and item

    @classmethod
    def of(cls, own: SuffixAutomaton) -> Flat:
        size = len(own.length)
        length, link = np.array(own.length, np.int32), np.array(own.link, np.int32)
        counts = np.fromiter(map(len, own.next), np.int64, size)
        words = np.fromiter((w for steps in own.next for w in steps), np.uint64, int(counts.sum()))
        targets = np.fromiter((t for steps in own.next for t in steps.values()), np.int32, len(words))
        keys = np.repeat(np.arange(size, dtype=np.uint64), counts) << np.uint64(32) | words
        order = np.argsort(keys)
        owner, near = np.zeros(size, np.int32), np.zeros(size, np.int32)
        short: defaultdict[int, set[tuple[int, str | None]]] = defaultdict(set)
        for state, words_in, item in own.short:
            short[own.suffix_state(state, words_in)].add((words_in, item))
        for state in np.argsort(length, kind="stable")[1:].tolist():
            up = own.link[state]
            near[state] = state if state in short else near[up]
            if own.length[state] >= own.window:
                owner[state] = state if own.length[up] < own.window else owner[up]
        number: defaultdict[str | None, int] = defaultdict()
        number.default_factory = number.__len__
        item = np.fromiter((number[i] for _, i in own.windows), np.int64, len(own.windows))
        pairs = np.unique(owner[np.fromiter((state for state, _ in own.windows), np.int64, len(own.windows))].astype(np.int64) << 32 | item)
        owned = (pairs & 0xFFFFFFFF).astype(np.int32), list(number)
        return cls(own.window, keys[order], targets[order], link, length, owner, near, (pairs >> 32).astype(np.int32), *owned, {k: list(v) for k, v in short.items()})

    @property
    def nbytes(self) -> int:
        arrays = (self.steps, self.targets, self.link, self.length, self.owner, self.near_short, self.owners, self.owned)
        return sum(x.nbytes for x in arrays) + 200 * (len(self.names) + len(self.short))

    def scan(self, words: list[int], first: int, spans: list[list[int]], found: set[str | None]) -> int:
        """Adds what is hit in a run of words, of which `first` is the number of the first one; the longest run of item words."""
        steps, owners, longest, state, run = memoryview(self.steps), memoryview(self.owners), 0, 0, 0
        for at, word in enumerate(words, first):
            while True:
                key = state << 32 | word
                place = bisect_left(steps, key)
                if place < len(steps) and steps[place] == key:
                    state, run = int(self.targets[place]), run + 1
                    break
                if not state:
                    break
                state = int(self.link[state])
                run = int(self.length[state])
            longest = max(longest, run)
            hit = 0
            if run >= self.window:
                owner = int(self.owner[state])
                found.update(self.names[i] for i in self.owned[bisect_left(owners, owner) : bisect_right(owners, owner)].tolist())
                hit = self.window
            short = int(self.near_short[state])
            while short:
                for size, item in self.short[short]:
                    if size <= run:
                        found.add(item)
                        hit = max(hit, size)
                short = int(self.near_short[self.link[short]])
            if hit:
                spans.append([at + 1 - hit, at + 1])
        return longest


def merged(spans: list[list[int]]) -> list[tuple[int, int]]:
    """Spans united where they touch, in order."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


class Matcher:
    """Several automata with one numbering of words."""

    def __init__(self, ids: dict[bytes, int], automata: list[Flat]) -> None:
        self.ids = ids
        self.automata = automata
        # Of each word that follows another in an item there is a state whose last word is the first and a step by the second.
        last = [np.full(len(a.link), -1, np.int64) for a in automata]
        pairs, shortest = [], []
        for a, word in zip(automata, last, strict=True):
            word[a.targets] = (a.steps & np.uint64(0xFFFFFFFF)).astype(np.int64)
            before = word[(a.steps >> np.uint64(32)).astype(np.int64)]
            inside = before >= 0
            pairs.append(before[inside].astype(np.uint64) << np.uint64(32) | (a.steps[inside] & np.uint64(0xFFFFFFFF)))
            shortest += [a.window] * bool(len(a.owners)) + [size for own in a.short.values() for size, _ in own]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)
        self.shortest = min(shortest, default=0)

    def _numbers(self, bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words, one text after the other (-1: in no item), and where each text starts; one more at the end."""
        bodies = pa.array(bodies.to_pylist(), pa.binary()) if bodies.offset else bodies
        offsets = np.frombuffer(bodies.buffers()[1], np.int32, len(bodies) + 1)
        raw = (bodies.buffers()[2] or pa.py_buffer(b"")).to_pybytes().translate(TO_WORDS)
        split = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(bodies), pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)))
        flat = split.flatten()
        full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        coded = flat.dictionary_encode()
        known = np.fromiter((self.ids.get(w, -1) for w in coded.dictionary.view(pa.binary()).to_pylist()), np.int64, len(coded.dictionary))
        numbers = known[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
        return numbers[full], starts_of(full)[starts_of(pc.list_value_length(split).to_numpy())]

    def __call__(self, bodies: pa.Array) -> tuple[np.ndarray, dict[int, tuple[list[tuple[int, int]], set[str | None], int]]]:
        """Words of each text, and by the number of a text with runs long enough: merged spans, items found, longest run."""
        words, starts = self._numbers(bodies)
        out: dict[int, tuple[list[tuple[int, int]], set[str | None], int]] = {}
        if not self.shortest or not len(words):
            return np.diff(starts), out
        key = np.where((words[:-1] >= 0) & (words[1:] >= 0), words[:-1] << 32 | words[1:], -1)
        place = np.searchsorted(self.pairs, np.maximum(key, 0).astype(np.uint64))
        joined = (key >= 0) & (place < len(self.pairs))
        joined[joined] = self.pairs[place[joined]] == key[joined].astype(np.uint64)
        inner = starts[1:-1]
        joined[inner[(inner > 0) & (inner < len(words))] - 1] = False
        low = np.flatnonzero(np.concatenate(([True], ~joined)))
        high = np.append(low[1:], len(words))
        some = (words[low] >= 0) & (high - low >= self.shortest)
        runs: defaultdict[int, list[tuple[int, int]]] = defaultdict(list)
        for text, a, z in zip((np.searchsorted(starts, low[some], "right") - 1).tolist(), low[some].tolist(), high[some].tolist(), strict=True):
            runs[text].append((a, z))
        for text, own in runs.items():
            spans: list[list[int]] = []
            found: set[str | None] = set()
            longest = max(flat.scan(words[a:z].tolist(), a - int(starts[text]), spans, found) for a, z in own for flat in self.automata)
            out[text] = (merged(spans), found, longest)
        return np.diff(starts), out


def item_blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[Items]:
    """Distinct items in blocks of about block_bytes of text; partitions come to the driver one after the other."""
    own = items.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body")).distinct()
    block: Items = []
    size = 0
    for r in own.toLocalIterator():
        words = bytes(r["body"]).translate(TO_WORDS).split()
        if block and size + len(r["body"]) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r["item"], words))
        size += len(r["body"])
    if block:
        yield block


def passes(items: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int, pass_bytes: int) -> Iterator[tuple[dict[bytes, int], list[Flat]]]:
    """Automata that one pass over the documents holds, and the numbers of their words. Without items there is one pass without automata."""
    ids: dict[bytes, int] = {}
    held: list[Flat] = []
    for block in item_blocks(items, item_col, text_col, block_bytes):
        flat = Flat.of(SuffixAutomaton(block, window, ids))
        if held and sum(x.nbytes for x in held) + flat.nbytes > pass_bytes:
            yield dict(ids), held
            held = []
        held.append(flat)
    yield ids, held


SPAN = StructType([StructField("start", LongType()), StructField("stop", LongType())])
HITS = StructType([StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("item_ids", ArrayType(StringType())), StructField("longest", LongType()), StructField("spans", ArrayType(SPAN))])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_HITS = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("longest", pa.int64()), ("spans", _SPANS)])
_matchers: dict[str, Matcher] = remembered()


def matcher(key: str, shared) -> Matcher:  # noqa: ANN001
    """One for each Python worker, which several tasks share one after the other."""
    if key not in _matchers:
        _matchers.clear()
        keep_only(_matchers)
        _matchers[key] = Matcher(*shared.value)
    return _matchers[key]


def _with_hits(docs: DataFrame, shared, text_col: str, hits_col: str, add: bool, cut: bool) -> DataFrame:  # noqa: ANN001
    """docs with hits_col; with `add`, docs have that of other items already and these are added; with `cut`, the words that are hit leave the text."""
    key = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = matcher(key, shared)
        for batch in slices(batches, text_col, own=_matchers):
            n_words, got = own(pc.fill_null(batch.column(text_col).cast(pa.binary()), b""))
            before = batch.column(hits_col).to_pylist() if add else [None] * batch.num_rows
            hits = []
            for k, (n, old) in enumerate(zip(n_words.tolist(), before, strict=True)):
                spans, found, longest = got.get(k, ([], set(), 0))
                if old:
                    spans = merged([*map(list, spans), *([s["start"], s["stop"]] for s in old["spans"])])
                    found, longest = found | set(old["item_ids"]), max(longest, old["longest"])
                hits.append({"n_words": n, "n_hit": sum(z - a for a, z in spans), "item_ids": sorted(x for x in found if x is not None), "longest": longest, "spans": [{"start": a, "stop": z} for a, z in spans]})
            if cut and any(h["spans"] for h in hits):
                texts = [without_spans(t.encode(), [(s["start"], s["stop"]) for s in h["spans"]]).decode("utf-8", "replace") if h["spans"] else t for t, h in zip(batch.column(text_col).to_pylist(), hits, strict=True)]
                batch = batch.set_column(batch.schema.get_field_index(text_col), text_col, pa.array(texts, pa.string()))
            kept = [c for c in batch.schema.names if c != hits_col]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(hits, _HITS)], names=[*kept, hits_col])

    return docs.mapInArrow(scan, StructType([*docs.drop(hits_col).schema.fields, StructField(hits_col, HITS)]))


def with_hits(docs: DataFrame, items: DataFrame, *, text_col: str, hits_col: str, item_col: str = "item_id", item_text_col: str = "text", window: int = 13, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES, cut: bool = False) -> DataFrame:
    """docs with hits_col: n_words, n_hit, item_ids (sorted), longest (run of item words that was followed), spans (of word numbers).

    Rows stay what they are, whatever their ids. Items of more than one pass are matched pass by pass, each on the written rows of the one before.
    cut: take the words that are hit out of text_col.
    """
    todo = passes(items, item_col, item_text_col, window, block_bytes, pass_bytes)
    out, automata = docs, next(todo)
    while automata:
        following = next(todo, None)
        if out is not docs:
            out = materialize(out)
        shared = docs.sparkSession.sparkContext.broadcast(automata)
        out = _with_hits(out, shared, text_col, hits_col, out is not docs, cut and following is None)
        automata = following
    return out


def find_contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, item_ids (sorted), longest, spans (of word numbers). how: see with_hits.

    Null or empty texts have no words and no hits; a null id stays null; repeated rows each give a row;
    an item without an id hits words but isn't listed; without items nothing is hit. Other columns are
    not read.
    """
    return with_hits(id_and_bytes(docs, id_col, text_col), items, text_col="body", hits_col="hits", **how).select("doc_id", "hits.*")  # type: ignore[arg-type]


def contaminated(hit: str = "n_hit", words: str = "n_words", one_in: int = 20) -> F.Column:
    """Coverage rule: at least one word in one_in is hit."""
    return (F.col(hit) > 0) & (F.col(hit) * one_in >= F.col(words))


def without_spans(body: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in WORD.finditer(body)]
    out, at = [], 0
    for start, stop in spans:
        out.append(body[at : places[start][0]])
        at = places[stop - 1][1]
    return b"".join([*out, body[at:]])


def decontaminate(docs: DataFrame, items: DataFrame, *, text_col: str = "text", **how: object) -> DataFrame:
    """docs without contaminated rows; of the others text_col without the words that are hit. how: see with_hits.

    One pass over the documents for each pass of items. Null texts stay null; rows are told apart by nothing, so repeated ones and those without an id stay.
    """
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).alias("text"))
    marked = with_hits(held, items, text_col="text", hits_col="hits", cut=True, **how).where(~contaminated("hits.n_hit", "hits.n_words"))  # type: ignore[arg-type]
    return marked.select(*(F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op8_decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per row of docs the contract's columns. Odd rows are those of find_contamination: each row gives one, without words 0 and not contaminated."""
    hits = find_contamination(docs, items)
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


OP8_SQL = r"""
WITH lowered AS (SELECT 'd' AS kind, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 'i', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark)
, worded AS (SELECT kind, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered)
, item_windows AS (
  SELECT DISTINCT id AS item, size, list_aggregate(list_slice(w, i, i + size - 1), 'string_agg', ' ') AS words
  FROM (SELECT id, w, least(len(w), 13) AS size, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM worded WHERE kind = 'i' AND len(w) > 0))
, doc_windows AS (
  SELECT id, size, i, list_aggregate(list_slice(w, i, i + size - 1), 'string_agg', ' ') AS words
  FROM (SELECT id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM worded CROSS JOIN (SELECT DISTINCT size FROM item_windows) WHERE kind = 'd' AND len(w) >= size))
, met AS (SELECT d.id, d.i, d.size, m.item FROM doc_windows d JOIN item_windows m ON m.words = d.words AND m.size = d.size)
, hit AS (SELECT id, count(*) AS n_hit FROM (SELECT DISTINCT id, unnest(range(i, i + size)) AS place FROM met) GROUP BY id)
, found AS (SELECT id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT id, cast(item AS VARCHAR) AS item FROM met) GROUP BY id)
SELECT w.id AS doc_id, len(w.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.w) AS contaminated
FROM worded w LEFT JOIN hit USING (id) LEFT JOIN found USING (id) WHERE w.kind = 'd'
"""
