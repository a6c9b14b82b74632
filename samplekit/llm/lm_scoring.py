"""Document probabilities from a lattice of subwords.

A word's probability is the sum over all its segmentations into pieces of a given vocabulary, found by a forward
recursion in log space; a text's is the product over its words and one end. A word seen in training is one more
edge of its lattice, as long as the word, by its discounted count; the discounts of all words are shared out by the
pieces. Piece probabilities are estimated on the distinct training words. As a text's probability depends only on how
often it has which words, documents are read once into bags of word numbers, by chunks that each have a dictionary of
their own; every distinct word is counted and scored once for the whole corpus, and what it got goes back to the chunks
that have it. Words of one length go through the recursion together.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplekit.llm.common import LOWER, id_and_bytes, materialize, shipped, slices

CHUNK_WORDS, CHUNK_TOKENS = 400_000, 12_000_000  # distinct words and tokens after which a task begins another chunk
BLOCK = 20_000
START = "▁"  # stands before a word's first piece
LEAST_PRODUCT = 1e-250  # of a word's probability, below which plain products lose digits
LONG_WORD = 64  # characters from which a word goes through the recursion on its own
PART_BYTES = 24 << 20  # of text that a partition of words, or of chunks, stands for
LN10 = math.log(10)
FACTOR = np.uint64(0x9E3779B97F4A7C15)

BAGS = "chunk long, doc_id long, held_out boolean, n_tokens long, bag binary, first int, words array<binary>, n_train array<long>"
_BAGS = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("bag", pa.binary()), ("first", pa.int32()), ("words", pa.list_(pa.binary())), ("n_train", pa.list_(pa.int64()))])


def _packed(numbers: np.ndarray) -> bytes:
    """Distinct numbers ascending and their counts, as byte planes of differences."""
    own, counts = np.unique(numbers, return_counts=True)
    pair = np.concatenate([np.diff(own, prepend=0), counts]).astype("<u4")
    return zstandard.compress(np.ascontiguousarray(pair.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(bag), np.uint8)
    pair = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    half = len(pair) // 2
    return np.cumsum(pair[:half]), pair[half:]


def word_bags(docs: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of documents (bag) and rows of dictionaries (words from number `first` on, with their training counts), by chunk."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk = TaskContext.get().partitionId(), 0  # type: ignore[union-attr]
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        held: list[tuple[int | None, bool, np.ndarray]] = []
        tokens = 0

        def chunk_rows() -> Iterator[pa.RecordBatch]:
            key = part << 24 | chunk
            names = list(number)
            counts = np.zeros(len(names), np.int64)
            train = np.zeros(len(names), np.int64)
            for _, out, ids in held:
                got = np.bincount(ids, minlength=len(names)) if len(ids) > len(names) // 8 else None
                for into in (counts,) if out else (counts, train):
                    if got is None:
                        np.add.at(into, ids, 1)
                    else:
                        into += got
            order = np.argsort(-counts, kind="stable")  # frequent words get small numbers
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            for low in range(0, len(held), 4096):
                rows = [{"chunk": key, "doc_id": doc, "held_out": out, "n_tokens": len(ids) + 1, "bag": _packed(place[ids])} for doc, out, ids in held[low : low + 4096]]
                yield pa.RecordBatch.from_pylist(rows, _BAGS)
            for low in range(0, len(order), BLOCK):
                own = order[low : low + BLOCK]
                yield pa.RecordBatch.from_pylist([{"chunk": key, "first": low, "words": [names[i] for i in own.tolist()], "n_train": train[own]}], _BAGS)

        for batch in slices(batches, limit=4 << 20):
            for doc, out, body in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("body").to_pylist(), strict=True):
                words = body.translate(LOWER).split()
                held.append((doc, out, np.fromiter(map(number.__getitem__, words), np.int32, len(words))))
                tokens += len(words)
                if len(number) > CHUNK_WORDS or tokens > CHUNK_TOKENS:
                    yield from chunk_rows()
                    number.clear()
                    held, tokens, chunk = [], 0, chunk + 1
        yield from chunk_rows()

    flagged = docs.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    return id_and_bytes(flagged, id_col, text_col, "held_out").mapInArrow(read, BAGS)


class Lattice:
    """log10 probabilities of words under piece probabilities. logs: of pieces; byte_logs: of the bytes of characters that are no piece."""

    def __init__(self, logs: dict[str, float], byte_logs: list[float]) -> None:
        self.logs = logs
        self.byte_logs = byte_logs
        self.longest = max(map(len, logs), default=1)

    def word(self, word: str) -> float:
        text, logs = START + word, self.logs
        ahead: list[list[float]] = [[] for _ in range(len(text) + 1)]
        ahead[0].append(0.0)
        for i, char in enumerate(text):
            if not (into := ahead[i]):
                continue
            most = max(into)
            here = most + math.log10(sum(10 ** (x - most) for x in into)) if len(into) > 1 else most
            for j in range(i + 1, min(len(text), i + self.longest) + 1):
                if (log := logs.get(text[i:j])) is not None:
                    ahead[j].append(here + log)
            if char not in logs:
                ahead[i + 1].append(here + sum(self.byte_logs[b] for b in char.encode("utf-8", "surrogatepass")))
        into = ahead[-1]
        most = max(into)
        return most + math.log10(sum(10 ** (x - most) for x in into))


    def shares(self, word: str) -> dict[str, float]:
        """How often each piece is expected in the word, over all segmentations: forward sums times backward sums."""
        text, logs = START + word, self.logs
        n = len(text)
        edges: list[tuple[int, int, str, float]] = []
        forward = [0.0] * (n + 1)
        forward[0] = 1.0
        for i, char in enumerate(text):
            if forward[i] == 0.0:
                continue
            for j in range(i + 1, min(n, i + self.longest) + 1):
                if (log := logs.get(text[i:j])) is not None:
                    edges.append((i, j, text[i:j], 10**log))
                    forward[j] += forward[i] * 10**log
            if char not in logs:
                edges.append((i, i + 1, "", 10 ** sum(self.byte_logs[b] for b in char.encode("utf-8", "surrogatepass"))))
                forward[i + 1] += forward[i] * edges[-1][3]
        backward = [0.0] * (n + 1)
        backward[n] = 1.0
        out: dict[str, float] = {}
        for i, j, piece, p in reversed(edges):
            backward[i] += p * backward[j]
            if piece and forward[n] > 0:
                out[piece] = out.get(piece, 0.0) + forward[i] * p * backward[j] / forward[n]
        return out if forward[n] > LEAST_PRODUCT else self._log_shares(text)

    def _log_shares(self, text: str) -> dict[str, float]:
        """The same by sums in log space, for texts whose products are too small for a float."""
        n = len(text)
        edges: list[tuple[int, int, str, float]] = []
        ahead: list[list[float]] = [[] for _ in range(n + 1)]
        ahead[0].append(0.0)
        forward = [-math.inf] * (n + 1)
        for i in range(n + 1):
            forward[i] = _log_sum(ahead[i])
            if i == n or forward[i] == -math.inf:
                continue
            for j in range(i + 1, min(n, i + self.longest) + 1):
                if (log := self.logs.get(text[i:j])) is not None:
                    edges.append((i, j, text[i:j], log))
                    ahead[j].append(forward[i] + log)
            if text[i] not in self.logs:
                edges.append((i, i + 1, "", sum(self.byte_logs[b] for b in text[i].encode("utf-8", "surrogatepass"))))
                ahead[i + 1].append(forward[i] + edges[-1][3])
        behind: list[list[float]] = [[] for _ in range(n + 1)]
        behind[n].append(0.0)
        out: dict[str, float] = {}
        at = n
        backward = [-math.inf] * n + [0.0]
        for i, j, piece, log in reversed(edges):
            if i != at:
                backward[at] = _log_sum(behind[at])
                at = i
            behind[i].append(log + backward[j])
            if piece:
                out[piece] = out.get(piece, 0.0) + 10 ** (forward[i] + log + backward[j] - forward[n])
        return out


class Words:
    """A lattice for many words at once: pieces are found by the hashes of their characters, by length."""

    def __init__(self, lattice: Lattice) -> None:
        self.lattice = lattice
        self.names = list(lattice.logs)
        self.logs = np.fromiter(lattice.logs.values(), np.float64, len(self.names)) * LN10
        of_length: defaultdict[int, list[int]] = defaultdict(list)
        for k, name in enumerate(self.names):
            of_length[len(name)].append(k)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length, own in of_length.items():
            hashes = np.zeros(len(own), np.uint64)
            for column in self._characters([self.names[k] for k in own], length).T:
                hashes = hashes * FACTOR + column + np.uint64(1)
            order = np.argsort(hashes)
            self.tables[length] = hashes[order], np.array(own)[order]

    @staticmethod
    def _characters(texts: list[str], length: int) -> np.ndarray:
        return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), length).astype(np.uint64)

    def _edges(self, texts: list[str], length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray | None, np.ndarray]]:
        """From, to, which texts have an edge there, its piece (None: the bytes of a character that is no piece), its log."""
        characters = self._characters(texts, length)
        for i in range(length):
            hashes = np.zeros(len(texts), np.uint64)
            for j in range(i + 1, min(length, i + self.lattice.longest) + 1):
                hashes = hashes * FACTOR + characters[:, j - 1] + np.uint64(1)
                known, pieces = self.tables.get(j - i, (hashes[:0], np.zeros(0, np.int64)))
                found = np.zeros(len(texts), bool)
                if len(known):
                    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    found = known[at] == hashes
                    rows = np.flatnonzero(found)
                    if len(rows):
                        piece = pieces[at[rows]]
                        yield i, j, rows, piece, self.logs[piece]
                if j == i + 1 and not found.all():
                    rows = np.flatnonzero(~found)
                    values, which = np.unique(characters[rows, i], return_inverse=True)
                    own = [sum(self.lattice.byte_logs[b] for b in chr(v).encode("utf-8", "surrogatepass")) * LN10 for v in values.tolist()]
                    yield i, j, rows, None, np.array(own)[which]

    def _by_length(self, words: list[str]) -> Iterator[tuple[np.ndarray, list[str], int]]:
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + len(START)
        for length in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == length)
            yield rows, [START + words[k] for k in rows.tolist()], length

    def _forward(self, texts: list[str], length: int) -> tuple[np.ndarray, list]:
        forward = np.full((length + 1, len(texts)), -np.inf)
        forward[0] = 0.0
        edges = []
        for edge in self._edges(texts, length):
            i, j, rows, _, log = edge
            forward[j, rows] = np.logaddexp(forward[j, rows], forward[i, rows] + log)
            edges.append(edge)
        return forward, edges

    def scores(self, words: list[str]) -> np.ndarray:
        """log10 probability of each word."""
        out = np.zeros(len(words))
        for rows, texts, length in self._by_length(words):
            if length > LONG_WORD:
                out[rows] = [self.lattice.word(words[k]) for k in rows.tolist()]
            else:
                out[rows] = self._forward(texts, length)[0][-1] / LN10
        return out

    def expected(self, words: list[str]) -> np.ndarray:
        """How often each piece is expected in the words, over all segmentations."""
        out = np.zeros(len(self.names))
        number = {name: k for k, name in enumerate(self.names)}
        for rows, texts, length in self._by_length(words):
            if length > LONG_WORD:
                for k in rows.tolist():
                    for piece, n in self.lattice.shares(words[k]).items():
                        out[number[piece]] += n
                continue
            forward, edges = self._forward(texts, length)
            backward = np.full_like(forward, -np.inf)
            backward[-1] = 0.0
            for i, j, at, piece, log in reversed(edges):
                ahead = log + backward[j, at]
                backward[i, at] = np.logaddexp(backward[i, at], ahead)
                if piece is not None:
                    out += np.bincount(piece, np.exp(forward[i, at] + ahead - forward[-1, at]), len(out))
        return out


def _log_sum(logs: list[float]) -> float:
    if not logs:
        return -math.inf
    most = max(logs)
    return most + math.log10(sum(10 ** (x - most) for x in logs))


def tokenizer_counts(words: DataFrame, vocabulary: str) -> dict[str, float]:
    """How often the vocabulary's own segmentation of the distinct training words has each piece; at most one row a piece comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _pieces(vocabulary)
        total: Counter[str] = Counter()
        for batch in batches:
            for ids in own.encode([w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()], num_threads=1):
                total.update(map(own.id_to_piece, ids))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(map(float, total.values())), pa.float64())], names=["piece", "n"])

    return _summed(words.mapInArrow(count, "piece string, n double"))


def expected_counts(words: DataFrame, lattice: Lattice) -> dict[str, float]:
    """How often each piece is expected in the distinct training words, however long they are."""
    shared = words.sparkSession.sparkContext.broadcast((lattice.logs, lattice.byte_logs))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Words(Lattice(*shared.value))
        total = np.zeros(len(own.names))
        for batch in slices(batches, "word", 1 << 20):
            total += own.expected([w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([own.names[k] for k in some.tolist()], pa.string()), pa.array(total[some])], names=["piece", "n"])

    return _summed(words.mapInArrow(count, "piece string, n double"))


def _summed(counts: DataFrame) -> dict[str, float]:
    return {r["piece"]: r["n"] for r in counts.groupBy("piece").agg(F.sum("n").alias("n")).collect()}


def _pieces(vocabulary: str):  # noqa: ANN202
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=shipped(vocabulary))


def lattice_of(counts: dict[str, float], vocabulary: str) -> Lattice:
    """Piece probabilities; each piece is given a tenth of a count more."""
    own = _pieces(vocabulary)
    names = [own.id_to_piece(i) for i in range(own.get_piece_size()) if not own.is_control(i) and not own.is_unknown(i)]
    total = math.log10(sum(counts.get(x, 0.0) for x in names) + 0.1 * len(names))
    logs = {x: math.log10(counts.get(x, 0.0) + 0.1) - total for x in names}
    byte_logs = [logs.pop(f"<0x{b:02X}>", -total - 1) for b in range(256)]
    return Lattice(logs, byte_logs)


def _discounts(of: list[int]) -> tuple[float, float, float]:
    """What words seen once, twice and more often give up, by how many words have 1, 2, 3 and 4 occurrences."""
    once, twice, thrice, four = of
    if not once or not twice or not thrice:
        return (0.5, 0.5, 0.5)
    share = once / (once + 2 * twice)
    wanted = (1 - 2 * share * twice / once, 2 - 3 * share * thrice / twice, 3 - 4 * share * four / thrice)
    return tuple(min(max(d, 0.1), k - 0.1) for k, d in zip((1, 2, 3), wanted, strict=True))  # type: ignore[return-value]


def score_documents(docs: DataFrame, vocabulary: str, *, held_out: Column | None = None, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Words are lower-cased (A-Z) and cut at ASCII white space; one end follows. Null or empty texts have the end alone. A null id
    stays null and counts for training; repeated rows each give a row; an empty table gives none. Other columns aren't
    read. held_out: documents that nothing is learnt from; by default those whose id as text has crc32 mod 7 = 2.
    vocabulary: path of a sentencepiece model whose pieces are used. rounds: of expectation and maximisation of their probabilities.
    """
    docs.sparkSession.sparkContext.addFile(vocabulary)
    out = F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 7 == 2 if held_out is None else held_out
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0
    parts = max(8, -(-total // PART_BYTES))
    bags = materialize(word_bags(docs, out, id_col=id_col, text_col=text_col))
    entries = bags.where("words is not null").select("chunk", "first", F.posexplode(F.arrays_zip("words", "n_train")).alias("at", "entry"))
    seen = entries.select("chunk", (F.col("first") + F.col("at")).alias("number"), F.col("entry.words").alias("word"), F.col("entry.n_train").alias("n_train"))
    words = materialize(seen.groupBy("word").agg(F.sum("n_train").alias("c")).repartition(parts, "word"))
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), *(F.count_if(x).alias(k) for k, x in (("v", F.col("c") > 0), *((f"of{k}", F.col("c") == k) for k in (1, 2, 3, 4))))).first()
    ends = bags.where("bag is not null and not held_out").count()
    n, v = sums["n"] + ends, sums["v"] + (ends > 0)
    trained = words.where("c > 0").select("word")
    lattice = lattice_of(tokenizer_counts(trained, vocabulary), vocabulary)
    for _ in range(rounds):
        lattice = lattice_of(expected_counts(trained, lattice), vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((lattice.logs, lattice.byte_logs))
    base_total = math.log10(n + v + 1)
    discounts = _discounts([sums[f"of{k}"] for k in (1, 2, 3, 4)])
    often = sums["v"] - sums["of1"] - sums["of2"]
    spare = (discounts[0] * sums["of1"] + discounts[1] * sums["of2"] + discounts[2] * (often + (ends > 0))) / n if n else 0.5  # what the discounts leave to the lattice
    end_log = math.log10(max(ends - discounts[2], 0.5) / n) if ends else math.log10(0.5)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Words(Lattice(*shared.value))
        for batch in slices(batches, "word", 1 << 20):
            c = batch.column("c").to_numpy()
            pieces = own.scores([w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]) + math.log10(spare)
            taken = np.choose(np.clip(c, 1, 3) - 1, discounts)
            whole = np.where(c > 0, np.log10(np.maximum(c - taken, 1e-9) / max(n, 1)), -np.inf)
            logs = np.logaddexp(pieces * LN10, whole * LN10) / LN10
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(logs)], names=["word", "c", "log"])

    def add_up(key: tuple, bag: pa.Table, scored: pa.Table) -> pa.Table:
        at = scored.column("number").to_numpy()
        c = np.zeros(len(at), np.int64)
        log = np.zeros(len(at))
        c[at], log[at] = scored.column("c").to_numpy(), scored.column("log").to_numpy()
        base = np.log10(c + 1.0) - base_total
        known, base_sum, sums = [], [], []
        for packed in bag.column("bag").to_pylist():
            ids, times = _unpacked(packed)
            known.append(int(times[c[ids] > 0].sum()) + (ends > 0))
            base_sum.append(float((base[ids] * times).sum()) + math.log10(ends + 1) - base_total)
            sums.append(float((log[ids] * times).sum()) + end_log)
        return pa.table({**{k: bag.column(k) for k in ("doc_id", "held_out", "n_tokens")}, "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array([n] * len(bag), pa.int64()), "base_score": pa.array(base_sum, pa.float64()), "score": pa.array(sums, pa.float64())})

    scored = materialize(words.mapInArrow(score, f"word {words.schema['word'].dataType.simpleString()}, c long, log double"))
    scored = seen.join(scored, "word").select(F.col("chunk").alias("of"), "number", "c", "log")  # a word has one row a chunk, of which each has hundreds of thousands: no word is hot
    texts = bags.where("bag is not null").select("chunk", "doc_id", "held_out", "n_tokens", "bag")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    texts, scored = texts.repartition(parts, "chunk"), scored.repartition(parts, "of")
    return texts.groupBy("chunk").cogroup(scored.groupBy("of")).applyInArrow(add_up, schema)


def op7_lm_scoring(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per row of docs the contract's columns. Odd rows are those of score_documents: each row gives one, without words that of the end alone."""
    return score_documents(docs, vocabulary)
