"""Groups of spelling variants: words that differ from a far more frequent one by a single letter.

The vocabulary is cut into shards by what one error leaves equal: a word is cut in pieces, and two near words agree on all that
lies before and behind the piece that holds their first difference. A shard keeps the letters of that piece alone as an index
of bits, one bitset over its words for each (position, letter). Recurrences over the letters of a word, for all words of
a shard and 64 words of the index at a time, carry the set without an error, the set with one replaced letter, and the set with
one letter more, which reads the index one position on. A shard that is too large is cut again by pieces of half the length, down to
single letters, so that no task gets more than a bounded number of words that it compares with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplekit.llm.common import materialize

#: What a word is made of, and which code points count as capitals.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_WORDS = 4096  # of a shard, before it is cut again
BLOCK_WORDS = 1024  # words of small shards that are compared in one go
NEAR_SCHEMA = "word string, n_near long, best_n long, best string"


def count_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_letters: int = 6, min_count: int = 5, typo_every: int | None = None) -> DataFrame:
    """word, n: runs of letters with A-Z in lower case, of min_letters or more, seen min_count times or more in whole texts.

    typo_every: plants errors, for tests: a run whose crc32 of "<doc_id>:<run>" it divides loses the letter at that number modulo its length; a
    null id is empty there. Null texts have no words, repeated rows count each, an empty table gives no row, other columns aren't read.
    """
    runs = F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), UPPER, LOWER), F.lit(f"[{LETTERS}]{{{min_letters},}}+"), F.lit(0))
    own = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("word"))
    if typo_every is not None:
        mark = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        at = (mark % F.length("word")).cast("int")
        cut = F.concat(F.substr("word", F.lit(1), at), F.substr(F.col("word"), at + 2))
        own = own.select(F.when(mark % typo_every == 0, cut).otherwise(F.col("word")).alias("word")).where(F.length("word") >= min_letters)
    return own.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _cut(k: Column, pieces: Column) -> Column:
    return F.floor(F.col("s") * k / pieces).cast("int")


def _sharded(entries: DataFrame) -> DataFrame:
    """entries (word, n, s, k, pieces) with key and middle: all but the k-th of so many pieces of a word of s letters, which may have one more there; and that piece."""
    low, high = _cut(F.col("k"), F.col("pieces")), _cut(F.col("k") + 1, F.col("pieces"))
    behind = F.col("s") - high
    long = entries.withColumns({"low": low, "high": high}).where("high > low")
    rest = F.concat(F.substr("word", F.lit(1), F.col("low")), F.lit(":"), F.substr(F.col("word"), F.length("word") - behind + 1))
    middle = F.substr(F.col("word"), F.col("low") + 1, F.length("word") - behind - F.col("low"))
    return long.select("word", "n", "s", "k", "pieces", (F.col("high") - F.col("low")).alias("width"), F.concat_ws(":", "s", "k", "pieces", rest).alias("key"), middle.alias("middle"))


def _entries(words: DataFrame, least: int) -> DataFrame:
    """Each word twice two times: as one of its own length or as the longer one of a pair, in the shard of either half."""
    own = words.withColumn("s", F.explode(F.array(F.length("word"), F.length("word") - 1))).where(F.col("s") >= least)
    return own.withColumns({"k": F.explode(F.array(F.lit(0), F.lit(1))), "pieces": F.lit(2)})


def shards(words: DataFrame, *, most_words: int = MOST_WORDS) -> DataFrame:
    """word, n, s, k, pieces, width, key, middle: near words meet under exactly one key, that of the piece with their first difference. Keys of more than most_words are cut again while their piece has two letters or more."""
    least = words.agg(F.min(F.length("word"))).first()[0] or 1
    own = materialize(_sharded(_entries(words, least)))
    done: list[DataFrame] = []
    while True:
        large = materialize(own.where("width > 1").groupBy("key").count().where(F.col("count") > most_words).select("key"))
        if large.isEmpty():
            return _union([*done, own])
        done.append(own.join(large, "key", "left_anti").select(*own.columns))
        again = own.join(large, "key", "left_semi").select("word", "n", "s", F.explode(F.array(F.col("k") * 2, F.col("k") * 2 + 1)).alias("k"), (F.col("pieces") * 2).alias("pieces"))
        own = materialize(_sharded(again))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


class PositionIndex:
    """Words of whole shards as bitsets by position and letter, and the search for near ones among them."""

    def __init__(self, middles: list[str], widths: list[int], shard: list[int]) -> None:
        """middles: letters of each word's piece, as many as its shard's width or one more; shard: its number, ascending."""
        self.width, self.size = np.array(widths), np.array([len(m) for m in middles])
        self.rows = -(-len(middles) // 64) * 64
        self.letters = np.full((len(middles), int(self.size.max()) + 1), 0, np.uint8)  # 0: no letter
        for row, middle in zip(self.letters, middles, strict=True):
            row[: len(middle)] = np.frombuffer(middle.encode("latin-1"), np.uint8)
        numbers, self.shard = np.unique(shard, return_inverse=True)
        self.members = self._bits(self.shard[None, :] == np.arange(len(numbers))[:, None])

    def _bits(self, marks: np.ndarray) -> np.ndarray:
        """Rows of marks over the words as rows of 64-bit words."""
        padded = np.zeros((len(marks), self.rows), bool)
        padded[:, : marks.shape[1]] = marks
        return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)

    def _position(self, at: int) -> np.ndarray:
        """Bitsets of all 256 letters at a position; only letters that occur there are set."""
        column = self.letters[:, at]
        found = np.unique(column)
        out = np.zeros((256, self.rows // 64), np.uint64)
        out[found] = self._bits(column[None, :] == found[:, None])
        return out

    def near(self, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (word of its shard's width, near word), places in the list. last: whether a word's piece is the last of its shard's, where a letter more may stand behind all others."""
        short = np.flatnonzero(self.size == self.width)
        short = short[np.argsort(-self.width[short], kind="stable")]  # those with letters left come first
        same = self._bits((self.size == self.width)[None, :])[0]
        none = self.members[self.shard[short]]
        one, longer = np.zeros_like(none), np.zeros_like(none)
        here = self._position(0)
        for i in range(int(self.width[short].max(initial=0))):
            there = self._position(i + 1)
            on = slice(0, int(np.count_nonzero(self.width[short] > i)))
            letter = self.letters[short[on], i]
            hit = here[letter]
            longer[on] = (longer[on] | none[on]) & there[letter]  # a letter of the index skipped, the next one agrees
            one[on] = (one[on] & hit) | (none[on] & ~hit)
            none[on] &= hit
            here = there
        end = last[short][:, None]
        found = (one & same) | (np.where(end, longer | none, longer & ~none) & ~same)
        marks = np.unpackbits(found.view(np.uint8), axis=1, bitorder="little", count=len(self.size))
        q, w = np.nonzero(marks)
        return short[q], w


def _near_in_block(words: list[str], counts: list[int], middles: list[str], widths: list[int], lasts: list[bool], shard: list[int]) -> dict[str, list]:
    q, w = PositionIndex(middles, widths, shard).near(np.array(lasts))
    sizes = np.array([len(m) for m in middles]) - np.array(widths)
    grown = sizes[w] == 1  # of equal lengths both find each other
    target, source = np.concatenate((q, w[grown])), np.concatenate((w, q[grown]))
    order = np.empty(len(words), np.int64)
    order[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    n = np.array(counts)
    by = np.lexsort((order[source], -n[source], target))
    target, source = target[by], source[by]
    heads, sums = np.unique(target, return_index=True)[1], np.unique(target, return_counts=True)[1]
    return {"word": [words[i] for i in target[heads]], "n_near": sums.tolist(), "best_n": n[source[heads]].tolist(), "best": [words[i] for i in source[heads]]}


def _near_in_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: whole shards are put together to blocks."""
    names = ("word", "n", "middle", "width", "last")
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    block: tuple[list, ...] = ([], [], [], [], [])
    shard: list[int] = []
    own: list[tuple] = []
    key, number, letters = None, 0, 0

    def closed() -> None:
        if len(own) > 1:  # a word alone has none near it
            for into, values in zip(block, zip(*own), strict=True):
                into.extend(values)
            shard.extend([number] * len(own))
        own.clear()

    def found() -> Iterator[pa.RecordBatch]:
        if shard:
            words, counts, middles, widths, lasts = block
            yield pa.RecordBatch.from_pydict(_near_in_block(words, counts, middles, widths, lasts, shard), schema=schema)
            shard.clear()
            for x in block:
                x.clear()

    for batch in batches:
        for k, *row in zip(*(batch.column(c).to_pylist() for c in ("key", *names)), strict=True):
            if k != key:
                letters += sum(len(r[2]) for r in own) if len(own) > 1 else 0
                closed()
                key, number = k, number + 1
                if len(shard) >= BLOCK_WORDS or letters > 1 << 20:
                    yield from found()
                    letters = 0
            own.append(tuple(row))
    closed()
    yield from found()


def near_words(words: DataFrame, *, most_words: int = MOST_WORDS) -> DataFrame:
    """word, n_near, best_n, best of words (word, n; distinct, letters up to U+00FF) that have others at exactly one inserted, deleted or replaced letter: how many, and the most frequent of them, ties to the smallest."""
    own = shards(words, most_words=most_words).withColumn("last", F.col("k") == F.col("pieces") - 1)
    found = own.repartition("key").sortWithinPartitions("key").select("key", "word", "n", "middle", "width", "last").mapInArrow(_near_in_shards, NEAR_SCHEMA)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form): the end of the chain of forms. Ways double each round; forms are ever more frequent, so chains have no rings and are short."""
    own = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        further = own.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        joined = materialize(own.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        own = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return own


def spelling_variants(words: DataFrame, *, ratio: int = 5, most_words: int = MOST_WORDS) -> DataFrame:
    """words (word, n) with form, root, n_near, form_n.

    form: the most frequent near word if it is seen ratio times as often or more, ties to the smallest, else null; root: the end of the chain of forms, the word itself
    where it has none; n_near: near words, 0 if none. An empty vocabulary gives no row.
    """
    near = materialize(near_words(words, most_words=most_words))
    forms = materialize(words.join(near, "word").where(F.col("best_n") >= F.col("n") * ratio).select("word", F.col("best").alias("form"), F.col("best_n").alias("form_n")))
    out = words.join(near.select("word", "n_near"), "word", "left").join(forms, "word", "left").join(roots(forms), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), F.col("n").cast("long").alias("n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"))


def op11_spelling_variants(docs: DataFrame) -> DataFrame:
    """The contract's row for every word of 6 letters and 5 occurrences or more, after one run in 199 has lost a letter."""
    return spelling_variants(materialize(count_words(docs, typo_every=199)))
