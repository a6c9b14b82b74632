"""Best-fit packing of token pieces into sequences by bin completion.

Pieces of one length are interchangeable, so what is packed is the histogram of lengths: at most one row for
each token count up to a sequence's capacity, however many documents there are. Bin completion takes the largest
length left, enumerates undominated fillings of the room beside it, and commits the best one as often as the
counts allow; branches whose waste can't beat the best packing known are pruned. Sequences of that packing that waste room are
then taken apart together with others and searched again. The plan that comes out says which
ranks of each length go to which sequences. Spark ranks the pieces within their length and looks their places up; a piece as long
as a sequence has one to itself.
"""

from __future__ import annotations

import bisect
import json
import os
import random
import unicodedata
import zlib
from array import array
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from samplekit.llm.common import gather, id_and_bytes, keep_only, materialize, remembered, shipped, slices, starts_of

KNOWN_BYTES = 120 << 20  # of parts of words and their ids that a Python worker remembers, about
PART_BYTES = 170  # what a dictionary takes for a part besides its letters
EARLY = 2
SALTED_ROWS = 200_000  # pieces of one length, about, that are ranked together


SPACE, LETTER, DIGIT, MARK, APOSTROPHE, OTHER = range(6)


def _kinds() -> bytes:
    """By byte: white space, letter, digit, punctuation, apostrophe, or anything else."""
    kinds = np.full(256, OTHER, np.uint8)
    for kind, chars in ((MARK, range(33, 127)), (LETTER, range(65, 91)), (LETTER, range(97, 123)), (DIGIT, range(48, 58)), (APOSTROPHE, b"'"), (SPACE, b" \t\n\x0b\x0c\r")):
        kinds[list(chars)] = kind
    return kinds.tobytes()


def _edges() -> bytes:
    """By kinds of two bytes, 8 * first + second: whether no token spans them, whatever is around them. An apostrophe may begin a contraction; other characters may join punctuation or compose with a letter."""
    edges = np.zeros((32, 8), bool)
    edges[[SPACE, DIGIT], :] = edges[:, [SPACE, DIGIT]] = True
    edges[LETTER, MARK] = edges[LETTER, APOSTROPHE] = edges[MARK, LETTER] = True
    return edges.tobytes()


KINDS, EDGES = _kinds(), _edges()
NO_LETTERS = (0xC397, 0xC3B7, 0xC4B0)  # of U+00C0 to U+017F: two signs, and the one letter that is two characters in lower case


def _byte_level() -> dict[int, str]:
    """The letters that byte-level tokenizers write bytes with: a printable one for itself, the others from 256 on."""
    itself = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in itself]
    return {b: chr(b) for b in itself} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_LEVEL = _byte_level()


def _is_letters(part: bytes) -> str:
    """The part in lower case and composed form if it is Latin letters alone, else nothing."""
    text = unicodedata.normalize("NFC", part.decode("utf-8", "replace")).lower()
    return text if text.isalpha() and max(text) < "\u0370" else ""


def _cuts_letters(path: str) -> bool:
    """Whether a tokenizers file composes, lower-cases, cuts words into runs of letters and others, and writes bytes."""
    with open(path) as file:
        kind = json.load(file)
    norm = [n["type"] for n in (kind.get("normalizer") or {}).get("normalizers", [])]
    pre = (kind.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = pre[0].get("pattern", {}).get("Regex", "") if pre else ""
    return norm == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in pre] == ["Split", "ByteLevel"] and split.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class WordEncoder:
    """Token ids of whole texts, for a tokenizer that never joins text across ASCII white space.

    Texts are cut at white space and, where the tokenizer lower-cases and splits words at the edge of letters, as `cuts`
    says, at edges of letters, digits and punctuation that no token spans. Each distinct part goes through the tokenizer
    once, Latin letters alone straight to its model; texts are then put together from the parts' ids.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cuts = _cuts_letters(path)
        self.number: dict[bytes, int] = {}
        self.held = 0
        self.sizes, self.ids, self.seen = np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Only the parts seen most stay, half of what fits."""
        parts = list(self.number)
        order = np.argsort(-self.seen, kind="stable")
        own = np.fromiter(map(len, parts), np.int64, len(parts)) + PART_BYTES + 4 * self.sizes
        room = np.cumsum(own[order])
        kept = np.sort(order[: int(np.searchsorted(room, KNOWN_BYTES // 2))])
        self.ids = self.ids[gather(starts_of(self.sizes)[kept], self.sizes[kept])]
        self.sizes, self.seen = self.sizes[kept], self.seen[kept] // 2
        self.number = {parts[k]: n for n, k in enumerate(kept.tolist())}
        self.held = int(room[len(kept) - 1]) if len(kept) else 0

    def _numbers(self, parts: list[bytes]) -> np.ndarray:
        """Numbers of distinct parts; those that are new are encoded."""
        if self.held > KNOWN_BYTES:
            self._forget()
        number = self.number
        if new := [p for p in parts if p not in number]:
            number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
            sizes, ids = np.zeros(len(new), np.int64), array("I")
            for k, part in enumerate(new):
                before = len(ids)
                ids.extend(self._part_ids(part))
                sizes[k] = len(ids) - before
            self.sizes, self.seen = np.concatenate([self.sizes, sizes]), np.concatenate([self.seen, np.zeros(len(sizes), np.int64)])
            self.ids = np.concatenate([self.ids, np.frombuffer(ids, np.uint32)])
            self.held += sum(map(len, new)) + PART_BYTES * len(new) + 4 * len(ids)
        return np.fromiter(map(number.__getitem__, parts), np.int64, len(parts))

    def _part_ids(self, part: bytes) -> list[int]:
        if self.cuts:
            if part.isalpha():  # of ASCII
                return [t.id for t in self.model.tokenize(part.decode().lower())]
            if letters := _is_letters(part):
                return [t.id for t in self.model.tokenize(letters.encode().decode("latin-1").translate(BYTE_LEVEL))]
        return self.tokenizer.encode(part.decode("utf-8", "replace"), add_special_tokens=False).ids

    def _parts(self, text: bytes, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The parts of all texts, and which of them is each text's first; one more at the end. starts: where texts begin in `text`, and its end."""
        body, kinds = np.frombuffer(text, np.uint8), np.frombuffer(bytearray(text.translate(KINDS)), np.uint8)
        edge = np.zeros(len(body) + 1, bool)
        edge[starts] = True
        if self.cuts:
            lead = np.flatnonzero(body[:-1] - np.uint8(0xC3) < 3)  # begins U+00C0 to U+017F
            pair = body[lead].astype(np.int64) << 8 | body[lead + 1]
            lead = lead[(pair & 0xC0 == 0x80) & ~np.isin(pair, NO_LETTERS) & ~edge[lead + 1]]
            kinds[lead] = kinds[lead + 1] = LETTER
            apart = np.frombuffer((kinds[:-1] << 3 | kinds[1:]).tobytes().translate(EDGES), bool)
            upper = body - np.uint8(65) < 26
            upper[:-1] &= kinds[1:] != OTHER  # as what follows may compose with a small letter only
            if b"<|" in text:  # words with what may be a special token stay whole
                word = np.cumsum(kinds == SPACE)
                whole = np.isin(word, word[:-1][(body[:-1] == ord("<")) & (body[1:] == ord("|"))]) & (kinds != SPACE)
                apart = apart & ~(whole[:-1] & whole[1:])
                upper &= ~whole
            body = body | upper.view(np.uint8) << 5
        else:
            apart = (kinds[:-1] == SPACE) | (kinds[1:] == SPACE)
        edge[1:-1] |= apart
        inside = kinds != SPACE
        edge = edge[:-1] & inside
        own = body[inside]
        cuts = np.append(np.flatnonzero(edge[inside]), len(own)).astype(np.int32)
        first = np.searchsorted(np.flatnonzero(edge), starts)
        return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(own)]), first

    def encode(self, bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and where each text starts; one more at the end. bodies: binary, UTF-8."""
        starts = starts_of(pc.binary_length(bodies).to_numpy())
        text = b"".join(bodies.to_pylist())
        if not text:
            return np.zeros(0, np.uint32), starts
        split, first = self._parts(text, starts)
        coded = split.dictionary_encode()
        parts = self._numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        self.seen += np.bincount(parts, minlength=len(self.seen))
        lengths = self.sizes[parts]
        ids = self.ids[gather(starts_of(self.sizes)[parts], lengths)]
        return ids, starts_of(lengths)[first]


_encoders: dict[str, WordEncoder] = remembered()


def encoder(path: str) -> WordEncoder:
    """One for each Python worker, which several tasks share one after the other."""
    if path not in _encoders:
        keep_only(_encoders)
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Per piece of a document: doc_id, piece, start, length, ids_crc32, and its ids where asked for.

    A document is its ids and end_id; only one of more than `size` is cut. tokenizer: path of a tokenizers file, one
    that never joins text across ASCII white space. Null texts are empty: end_id alone.
    """

    docs.sparkSession.sparkContext.addFile(tokenizer)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder = encoder(shipped(tokenizer))
        for batch in slices(batches, limit=4 << 20, own=_encoders):
            ids, at = own_encoder.encode(batch.column("body"))
            docs_out, piece, start, length, crc, kept = [], [], [], [], [], []
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                own = np.append(ids[at[k] : at[k + 1]], np.uint32(end_id)).astype("<u4")
                for n, low in enumerate(range(0, len(own), size)):
                    part = own[low : low + size]
                    docs_out.append(doc)
                    piece.append(n)
                    start.append(low)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(part.astype(np.int32))
            arrays = [pa.array(docs_out, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(kept, pa.list_(pa.int32()))] * with_ids, names=NAMES + ["ids"] * with_ids)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return id_and_bytes(docs, id_col, text_col).mapInArrow(cut, schema)


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]


@dataclass(frozen=True)
class Filling:
    """`times` sequences that each hold pieces of these lengths, largest first."""

    lengths: tuple[int, ...]
    times: int


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether all pieces of b fit into the places of those of a: then whatever b leaves over a leaves over too, or less."""
    if len(b) > 8 or sum(b) > sum(a):
        return False
    room = list(a)

    def put(k: int) -> bool:
        if k == len(b):
            return True
        for i in range(len(room)):
            if room[i] >= b[k]:
                room[i] -= b[k]
                if put(k + 1):
                    return True
                room[i] += b[k]
        return False

    return put(0)


def _completions(counts: np.ndarray, room: int, most: int, tries: int) -> list[tuple[int, ...]]:
    """Undominated fillings of the room by lengths left, least waste first, large pieces before small ones; no more than `most`. tries: bound on the steps."""
    lengths = np.flatnonzero(counts[: room + 1]).tolist()
    found: list[tuple[int, tuple[int, ...]]] = []
    steps = 0

    def fill(top: int, left: int, chosen: tuple[int, ...]) -> None:
        nonlocal steps
        steps += 1
        fits = bisect.bisect_right(lengths, left, 0, top)
        done = len(found)
        for i in range(fits - 1, -1, -1):
            if steps > tries or len(found) >= 4 * most and found[-1][0] == 0:
                break
            take = lengths[i]
            if chosen and len(found) > done and i < fits - 6:
                break
            if chosen.count(take) < counts[take]:
                fill(i + 1, left - take, (*chosen, take))
        if len(found) == done:
            found.append((left, chosen))

    fill(len(lengths), room, ())
    out: list[tuple[int, ...]] = []
    for _, option in sorted(set(found), key=lambda x: (x[0], [-v for v in x[1]])):
        if not any(_dominates(other, option) for other in out):
            out.append(option)
            if len(out) == most:
                break
    return out


def least_sequences(counts: np.ndarray, capacity: int) -> int:
    """A bound on all packings of counts (by length): for each least length, pieces too long for one another need a sequence each, and what the rest can't put beside them needs more."""
    lengths = np.arange(capacity + 1)
    many, size = np.cumsum(counts), np.cumsum(counts * lengths)
    total, half = int(many[-1]), capacity // 2
    small = np.flatnonzero(counts[: half + 1])
    bound = max(-(-int(size[-1]) // capacity), total - int(many[half]))
    if len(small):
        alone = total - many[capacity - small]  # nothing of `small` or more fits beside them
        beside = many[capacity - small] - many[half]
        room = beside * capacity - (size[capacity - small] - size[half])
        rest = size[half] - np.where(small > 0, size[small - 1], 0)
        bound = max(bound, int((alone + beside + np.maximum(0, -(-(rest - room) // capacity))).max()))
    return bound


@dataclass
class Branch:
    """A choice and all those before it; what is left is worked out when the branch is taken up."""

    before: Branch | None
    filling: Filling | None
    bins: int

    def fillings(self) -> list[Filling]:
        out, at = [], self
        while at.filling is not None:
            out.append(at.filling)
            at = at.before  # type: ignore[assignment]
        return out[::-1]


def search(counts: np.ndarray, capacity: int, *, branches: int, nodes: int, below: int = 1 << 62) -> list[Filling] | None:
    """The best packing in fewer than `below` sequences that is found by committing up to `nodes` fillings.

    The search takes up the latest branch left, and each EARLY-th time the earliest, so that early choices are
    reconsidered too. It ends at the bound on all packings.
    """
    bound = least_sequences(counts, capacity)
    best: list[Filling] | None = None
    spent, turn = 0, 1
    waiting: deque[Branch] = deque([Branch(None, None, 0)])
    while waiting and below > bound and (spent < nodes or best is None and below == 1 << 62):
        branch = waiting.pop() if turn % EARLY else waiting.popleft()
        turn += 1
        left = counts.copy()
        for filling in branch.fillings():
            for k in filling.lengths:
                left[k] -= filling.times
        while branch.bins + least_sequences(left, capacity) < below:
            some = np.flatnonzero(left)
            if not len(some):
                best, below = branch.fillings(), branch.bins
                break
            if spent >= nodes and not (best is None and below == 1 << 62):
                break
            spent += 1
            first = int(some[-1])
            left[first] -= 1
            options = _completions(left, capacity - first, branches, 3000)
            left[first] += 1
            following = []
            for option in options:
                filling = (first, *option)
                times = min(int(left[k]) // n for k, n in Counter(filling).items())
                following.append(Branch(branch, Filling(filling, times), branch.bins + times))
            waiting.extend(reversed(following[1:]))
            branch = following[0]
            for k in branch.filling.lengths:  # type: ignore[union-attr]
                left[k] -= branch.filling.times  # type: ignore[union-attr]
    return best


def pack_histogram(histogram: dict[int, int], capacity: int, *, branches: int = 3, nodes: int = 3000, rounds: int = 60, apart: int = 24) -> list[Filling]:
    """Fillings that hold each length as often as the histogram has it, in as few sequences as the search finds.

    A node of the search commits one filling as often as counts allow. Its first branches follow least waste, which is
    best fit; the best complete packing is the incumbent. A branch is cut when what it has used, and what no packing of
    the rest can do without, leave no room for a better packing; no branch is given up before `nodes` fillings. Then, up to `rounds` times, `apart` sequences or so,
    those that waste most and others, are searched again for a packing in one less. All ends at the bound on all packings.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for k, n in histogram.items():
        counts[k] += n
    bound = least_sequences(counts, capacity)
    best = search(counts, capacity, branches=branches, nodes=nodes) or []
    bins = Counter({f.lengths: 0 for f in best})
    for f in best:
        bins[f.lengths] += f.times
    order = random.Random(capacity)
    failed = 0
    while bins.total() > bound and failed < rounds:
        waste = {k: capacity - sum(k) for k in bins}
        total = sum(waste[k] * n for k, n in bins.items())
        if total < capacity:
            break
        loose = sorted((k for k in bins if waste[k]), key=lambda k: (waste[k] * order.random(), k), reverse=True)
        taken: Counter[tuple[int, ...]] = Counter()
        free = 0
        for k in loose:
            if free >= capacity and taken.total() >= apart // 2:
                break
            n = min(bins[k], max(1, apart // 4))
            taken[k] += n
            free += n * waste[k]
        full = [k for k in bins if not waste[k]]
        for k in order.sample(full, min(len(full), max(2, apart - taken.total()))):
            taken[k] += 1
        own = np.zeros(capacity + 1, np.int64)
        for k, n in taken.items():
            for length in k:
                own[length] += n
        found = search(own, capacity, branches=branches, nodes=400, below=taken.total()) if free >= capacity else None
        failed += 1
        if found:
            failed = 0
            bins -= taken
            for f in found:
                bins[f.lengths] += f.times
    return [Filling(k, n) for k, n in sorted(bins.items(), reverse=True) if n]


@dataclass
class Places:
    """By length: from which rank on, in which sequence and at what offset the pieces of that length lie."""

    first: dict[int, np.ndarray]
    sequence: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]

    @classmethod
    def of(cls, fillings: list[Filling]) -> Places:
        runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        used: dict[int, int] = defaultdict(int)
        sequence = 0
        for filling in fillings:
            offset = 0
            for length in filling.lengths:
                runs[length].append((used[length], sequence, offset))
                used[length] += filling.times
                offset += length
            sequence += filling.times
        first, sequences, offsets = ({k: np.array([r[i] for r in own], np.int64) for k, own in runs.items()} for i in range(3))
        return cls(first, sequences, offsets)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for k in np.unique(length).tolist():
            own = length == k
            run = np.searchsorted(self.first[k], rank[own], "right") - 1
            sequence[own] = self.sequence[k][run] + rank[own] - self.first[k][run]
            offset[own] = self.offset[k][run]
        return sequence, offset


def with_ranks(pieces: DataFrame, salts: int = 64) -> DataFrame:
    """pieces with rank, from 0 within their length: counted by hash parts first, so that no length is ranked in one task."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "salt", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("within", F.row_number().over(inside) - 1)
    return ranked.join(offsets, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within")).drop("salt", "before", "within")


def pack(pieces: DataFrame, *, size: int = 2048) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32, more), a written table, with sequence_id and offset, gapless from 0 in each sequence.

    Only the histogram of lengths, of at most `size` rows, and its packing come to the driver. Pieces of `size` have sequences of their own, with
    ids below 0, and need no rank.
    """
    histogram = {r["length"]: r["rows"] for r in pieces.where(F.col("length") < size).groupBy("length").agg(F.count("*").alias("rows")).collect()}
    places = pieces.sparkSession.sparkContext.broadcast(Places.of(pack_histogram(histogram, size)))
    ranked = with_ranks(pieces.where(F.col("length") < size), max(64, -(-max(histogram.values(), default=0) // SALTED_ROWS)))
    columns = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.value.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    placed = ranked.select(*columns, F.col("rank").cast("long")).mapInArrow(place, f"{kinds}, sequence_id long, offset long")
    alone = pieces.where(F.col("length") == size).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.union(alone)


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most `size` tokens.

    Null or empty texts give one piece, end_id alone. A null id stays null; repeated rows each give their pieces; an
    empty table gives none. Other columns aren't read.
    """
    return pack(materialize(token_pieces(docs, tokenizer, id_col=id_col, text_col=text_col, size=size, end_id=end_id, with_ids=with_ids)), size=size)


def op2_best_fit_packing(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per piece of every row the contract's columns. Odd rows are those of pack_documents: each row gives a piece at least."""
    return pack_documents(docs, tokenizer, with_ids=False)
