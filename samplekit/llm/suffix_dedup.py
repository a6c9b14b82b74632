"""Removal of repeated substrings by distributed prefix doubling over content-defined positions.

A suffix is ranked by its first bytes, and ranks are refined by those of the suffix further on, until a rank is unique or
reaches past the threshold of 50 bytes. Ranks are hashes here, so that a refinement needs no sort over the whole corpus, and
not every suffix is ranked: of each 50-byte window, only the position whose 24 bytes have the least hash takes part.
Equal windows choose equal positions, so nothing is missed, and one in fourteen positions remains.

Round one ranks the positions by 24 bytes; those whose rank one document alone has leave. Round two ranks, by all 50 bytes, the
windows that chose the positions left; a window goes from every document but the first that has it. Both rounds meet by
rank in buckets that grow in number with the corpus. What a map task can decide from its own texts it decides, so
that the inside of a passage on a third of all pages costs one record a task. At its edges the text beside it differs from page to
page: windows of positions whose rank very many rows have are therefore dealt out by all their bytes, not by that rank.
Texts are looked at in pieces of a bounded size that overlap by a window less one byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplekit.llm.common import gather, id_and_bytes, materialize, slices, starts_of

GRAM = 24
RANK_BYTES, WINDOW_BYTES = 20 << 20, 6 << 20  # of text that a bucket of ranks, and one of windows, stands for
PART_BYTES = 12 << 20  # of text that is looked at together, documents by their hash
TASK_RECORDS = 1_200_000
PIECE_BYTES = 3 << 20  # of texts that are looked at at once
HOT_ROWS, MOST_HOT = 4096, 1_000_000  # rows from which on a rank is very common; as many ranks of 8 bytes are broadcast at most
HOT = -1  # stands for a part where a record names a common rank
NO_ID = np.iinfo(np.int64).max  # a document without an id comes after all others
U64 = np.uint64


def _byte_values() -> np.ndarray:
    x = np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(27))


BYTE = _byte_values()


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a * U64(0xD6E8FEB86659FD93)
    out += b
    out *= U64(0xFF51AFD7ED558CCD)
    out ^= out >> U64(32)
    return out


def ranks(text: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes from each position on, put together from those of 1, 2, 4, ... bytes."""
    level, span = BYTE[text], 1
    out, done = None, 0
    while True:
        if size & span:
            out = level if out is None else _mixed(out[: len(text) - done - span + 1], level[done:])
            done += span
        span *= 2
        if span > size:
            return out  # type: ignore[return-value]
        level = _mixed(level[: -span // 2] if len(level) > span // 2 else level[:0], level[span // 2 :])


class Windows:
    """Of texts one after the other: maximal runs of windows that chose the same position."""

    def __init__(self, bodies: list[bytes], width: int) -> None:
        self.text = np.frombuffer(b"".join(bodies), np.uint8)
        self.starts = starts_of(np.fromiter(map(len, bodies), np.int64, len(bodies)))
        n = len(self.text)
        self.place = self.first = self.last = self.doc = np.zeros(0, np.int64)
        self.rank = np.zeros(0, U64)
        if n < width:
            return
        rank = ranks(self.text, GRAM)
        low = (rank & U64(0xFFFFFFFF00000000)) | np.arange(len(rank), dtype=U64)
        reach, span = width - GRAM + 1, 1
        while span * 2 <= reach:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < reach:
            low = np.minimum(low[: len(low) - (reach - span)], low[reach - span :])
        lengths = np.diff(self.starts)
        full = np.flatnonzero(lengths >= width)
        at = gather(self.starts[full], lengths[full] - width + 1)
        doc = np.repeat(full, lengths[full] - width + 1)
        chosen = (low[at] & U64(0xFFFFFFFF)).astype(np.int64)
        edge = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])))) if len(at) else np.zeros(0, np.int64)
        if len(edge):
            self.place, self.doc, self.first = chosen[edge], doc[edge], at[edge]
            self.last = at[np.append(edge[1:], len(at)) - 1]
            self.rank = rank[self.place]


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _packed(*columns: np.ndarray) -> bytes:
    return zstandard.compress(len(columns[0]).to_bytes(4, "little") + b"".join(map(_planes, columns)), 3)


def _unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n, at, out = int.from_bytes(raw[:4], "little"), 4, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def pieces(bodies: list[bytes], width: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Texts, or parts of long ones, in groups of about PIECE_BYTES: the bytes, which text each is of, and where it begins there. Each window is in one part."""
    held: list[bytes] = []
    of: list[int] = []
    begins: list[int] = []
    size = 0
    for k, body in enumerate(bodies):
        for begin in range(0, max(1, len(body) - width + 1), PIECE_BYTES):
            part = body[begin : begin + PIECE_BYTES + width - 1] if len(body) > PIECE_BYTES else body
            if held and size + len(part) > PIECE_BYTES:
                yield held, np.array(of), np.array(begins)
                held, of, begins, size = [], [], [], 0
            held.append(part)
            of.append(k)
            begins.append(begin)
            size += len(part)
    if held:
        yield held, np.array(of), np.array(begins)


def _by_part(part: np.ndarray, rows: np.ndarray, values: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Parts of the table and, for each, its rows with their values, packed. A row is told apart by its part and its number, which come from two hashes."""
    if not len(rows):
        return pa.array([], pa.int64()), pa.array([], pa.binary())
    part = part.astype(np.int64)
    order = np.lexsort((rows, part))
    rows, values, part = rows[order], values[order], part[order]
    edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    ends = np.append(edges[1:], len(part))
    blobs = [_packed(rows[a:z], values[a:z]) for a, z in zip(edges.tolist(), ends.tolist(), strict=True)]
    return pa.array(part[edges], pa.int64()), pa.array(blobs, pa.binary())


def _of_rows(found: pa.Table, rows: np.ndarray, kind: str) -> list[np.ndarray]:
    """The values that the blobs of a part hold for each of its rows."""
    got = [_unpacked(blob, "<u8", kind) for blob in found.column("blob").to_pylist()]
    if not got:
        return [np.zeros(0, kind)] * len(rows)
    row, value = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.argsort(row, kind="stable")
    row, value = row[order], value[order]
    low, high = np.searchsorted(row, rows, "left"), np.searchsorted(row, rows, "right")
    return [value[a:z] for a, z in zip(low.tolist(), high.tolist(), strict=True)]


#: Records of a bucket have no part; what a task has decided itself has one and passes through.
KEYED = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("blob", pa.binary())])
FOUND = pa.schema([("part", pa.int64()), ("blob", pa.binary())])


def shared_positions(docs: DataFrame, width: int, buckets: int, hot_rows: int) -> DataFrame:
    """part, blob: rows and their positions (32-bit numbers) whose first GRAM bytes stand in another row too; of part HOT, ranks that more than hot_rows rows have. docs: doc_id, body, row, part."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def records() -> Iterator[pa.RecordBatch]:
            key, row, part, at = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, U64),) * 4
            order = np.lexsort((row, key))
            key, row, part, at = key[order], row[order], part[order], at[order]
            new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
            group = np.cumsum(new) - 1
            firsts = np.flatnonzero(new)
            times = np.diff(np.append(firsts, len(key)))
            several = row[firsts] != row[np.append(firsts[1:], len(key)) - 1] if len(key) else np.zeros(0, bool)
            known = several[group]
            parts, blobs = _by_part(part[known], row[known], at[known].astype("<u4"))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts)) % buckets, pa.int64()), parts, blobs], schema=KEYED)
            sent = ~known
            sent[firsts] = True
            key, row, part, at, known, times = key[sent], row[sent], part[sent], at[sent], known[sent], np.where(known, times[group], 1)[sent]
            bucket = (key % U64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            key, row, part, at, known, times = key[by], row[by], part[by], at[by], known[by], times[by]
            ends = np.searchsorted(bucket[by], np.arange(buckets + 1))
            names, first, number = np.unique(row, return_index=True, return_inverse=True)
            part_of = part[first]
            for b in range(buckets):
                own = slice(ends[b], ends[b + 1])
                if ends[b] < ends[b + 1]:
                    used, local = np.unique(number[own], return_inverse=True)
                    head = _packed(names[used], part_of[used].astype("<u8"))
                    body = _packed(np.diff(key[own] // U64(buckets), prepend=U64(0)), local.astype("<u4"), at[own].astype("<u4"), known[own].astype("u1"), times[own].astype("<u4"))
                    blob = len(head).to_bytes(4, "little") + b.to_bytes(8, "little") + head + body
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([None], pa.int64()), pa.array([blob], pa.binary())], schema=KEYED)

        for batch in slices(batches):
            rows, parts = batch.column("row").to_numpy().view(U64), batch.column("part").to_numpy().view(U64)
            for bodies, of, begins in pieces(batch.column("body").to_pylist(), width):
                own = Windows(bodies, width)
                place, once = np.unique(own.place, return_index=True)
                doc = own.doc[once]
                held.append((own.rank[once] >> U64(16), rows[of[doc]], parts[of[doc]], (place - own.starts[doc] + begins[doc]).astype(U64)))
                count += len(place)
                if count > TASK_RECORDS:
                    yield from records()
                    held, count = [], 0
        if held:
            yield from records()

    def meet(found: pa.Table) -> pa.Table:
        keys, rows, parts, ats, knowns, times = [], [], [], [], [], []
        for blob in found.filter(found.column("part").is_null()).column("blob").to_pylist():
            n, bucket = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:12], "little")
            names, part_of = _unpacked(blob[12 : 12 + n], "<u8", "<u8")
            step, local, at, known, many = _unpacked(blob[12 + n :], "<u8", "<u4", "<u4", "u1", "<u4")
            keys.append(np.cumsum(step) * U64(buckets) + U64(bucket))
            for value, into in ((names[local], rows), (part_of[local], parts), (at, ats), (known, knowns), (many, times)):
                into.append(value)
        out = [found.filter(found.column("part").is_valid()).select(["part", "blob"])]
        if keys:
            key, row, part, at, known, many = (np.concatenate(x) for x in (keys, rows, parts, ats, knowns, times))
            order = np.argsort(key, kind="stable")
            key, row, part, at, known, many = key[order], row[order], part[order], at[order], known[order].astype(bool), many[order].astype(np.int64)
            firsts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            shared = (np.minimum.reduceat(row, firsts) != np.maximum.reduceat(row, firsts)) | np.logical_or.reduceat(known, firsts)
            keep = np.repeat(shared, np.diff(np.append(firsts, len(key)))) & ~known  # rows with a known rank were sent whole by their task
            out.append(pa.Table.from_arrays(_by_part(part[keep], row[keep], at[keep].astype("<u4")), schema=FOUND))
            hot = key[firsts][np.add.reduceat(many, firsts) > hot_rows]
            if len(hot):
                out.append(pa.Table.from_arrays([pa.array([HOT], pa.int64()), pa.array([hot.astype("<u8").tobytes()], pa.binary())], schema=FOUND))
        return pa.concat_tables([t.cast(FOUND) for t in out])

    return docs.mapInArrow(rank, "bucket long, part long, blob binary").groupBy("bucket").applyInArrow(meet, "part long, blob binary")


def repeated_windows(pressed: DataFrame, places: DataFrame, hot: np.ndarray, width: int, buckets: int) -> DataFrame:
    """part, blob: rows and ranges (start, stop << 32) of windows that a row with a smaller id has too. pressed: part, doc_id, row, ztext; places: of shared_positions; hot: common ranks, sorted."""
    common = pressed.sparkSession.sparkContext.broadcast(hot)

    def windows(docs: pa.Table, found: pa.Table) -> pa.Table:
        wanted = _of_rows(found, docs.column("row").to_numpy().view(U64), "<u4")
        some = np.flatnonzero([len(x) > 0 for x in wanted])
        batches = list(_window_records(docs.take(pa.array(some)), [wanted[i].astype(np.int64) for i in some.tolist()], common.value, width, buckets))
        return pa.Table.from_batches(batches, KEYED)

    def meet(part: pa.Table) -> pa.Table:
        out = [part.filter(part.column("part").is_valid()).select(["part", "blob"])]
        texts, sizes, docs, rows, starts, parts = [], [], [], [], [], []
        for blob in part.filter(part.column("part").is_null()).column("blob").to_pylist():
            a, z = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little")
            row, doc, of_part = _unpacked(blob[8 : 8 + a], "<u8", "<u8", "<u8")
            local, start, size = _unpacked(blob[8 + a : 8 + a + z], "<u4", "<u4", "<u4")
            for value, into in ((doc.view(np.int64)[local], docs), (row[local], rows), (of_part[local], parts), (start, starts), (size, sizes)):
                into.append(value)
            texts.append(zstandard.decompress(blob[8 + a + z :]))
        if texts:
            doc, row, of_part, start, size = (np.concatenate(x) for x in (docs, rows, parts, starts, sizes))
            text, start, size = b"".join(texts), start.astype(np.int64), size.astype(np.int64)
            runs = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(starts_of(size).astype(np.int32)), pa.py_buffer(text)])
            coded = runs.dictionary_encode().indices.to_numpy()
            least = np.full(coded.max() + 1, NO_ID, np.int64)
            np.minimum.at(least, coded, doc)
            done = doc > least[coded]  # another row has the whole run
            out.append(pa.Table.from_arrays(_by_part(of_part[done], row[done], _pairs(start[done], start[done] + size[done])), schema=FOUND))
            left = np.flatnonzero(~done)
            flat = np.frombuffer(text, np.uint8)[gather(starts_of(size)[left], size[left])]
            doc, row, of_part, start, size = doc[left], row[left], of_part[left], start[left], size[left]
            del texts, text, runs  # there is always a least one, so some rows are left
            run, low, high = _gone(flat, doc, start, size, width)
            out.append(pa.Table.from_arrays(_by_part(of_part[run], row[run], _pairs(low, high)), schema=FOUND))
        return pa.concat_tables([t.cast(FOUND) for t in out])

    records = pressed.groupBy("part").cogroup(places.groupBy("part")).applyInArrow(windows, "bucket long, part long, blob binary")
    return records.groupBy("bucket").applyInArrow(meet, "part long, blob binary")


def _pairs(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(U64) | high.astype(U64) << U64(32)


def _gone(text: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of text and the ranges of their windows that a run of a smaller document has too."""
    begins = starts_of(size)
    count = size - width + 1
    at = gather(begins[:-1], count)
    run = np.repeat(np.arange(len(size)), count)
    rank = ranks(text, width)[at]
    order = np.argsort(rank, kind="stable")
    sorted_rank = rank[order]
    new = np.concatenate(([True], sorted_rank[1:] != sorted_rank[:-1]))
    same = np.flatnonzero(~new)
    eight = np.ndarray(max(0, len(text) - 7), "<u8", np.ascontiguousarray(text), strides=(1,))  # the 8 bytes from each place on
    for low in range(0, len(same), 1 << 18):  # ranks are hashes: the windows themselves decide
        part = same[low : low + (1 << 18)]
        a, b = at[order[part - 1]], at[order[part]]
        equal = np.ones(len(part), bool)
        for k in [*range(0, width - 8, 8), width - 8]:
            equal &= eight[a + k] == eight[b + k]
        new[part[~equal]] = True
    firsts = np.flatnonzero(new)
    least = np.minimum.reduceat(doc[run[order]], firsts)
    gone = np.zeros(len(at), bool)
    gone[order] = doc[run[order]] > np.repeat(least, np.diff(np.append(firsts, len(at))))
    hit = np.flatnonzero(gone)
    if not len(hit):
        return hit, hit, hit
    cut = np.concatenate(([True], (run[hit][1:] != run[hit][:-1]) | (hit[1:] != hit[:-1] + 1)))
    first, last = hit[cut], hit[np.append(np.flatnonzero(cut)[1:], len(hit)) - 1]
    place = at - begins[run] + start[run]
    return run[first], place[first], place[last] + width


def _window_records(docs: pa.Table, places: list[np.ndarray], hot: np.ndarray, width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    if not len(docs):
        return
    rows = docs.column("row").to_numpy().view(U64)
    ids = docs.column("doc_id").fill_null(NO_ID).to_numpy()
    part = int(docs.column("part")[0].as_py())
    low = 0
    sizes = [zstandard.frame_content_size(z) for z in docs.column("ztext").to_pylist()]
    while low < len(docs):
        high, size = low, 0
        while high < len(docs) and (high == low or size + sizes[high] <= PIECE_BYTES):
            size += sizes[high]
            high += 1
        texts = [zstandard.decompress(z) for z in docs.column("ztext").slice(low, high - low).to_pylist()]
        for bodies, of, begins in pieces(texts, width):
            yield from _slice_records(bodies, rows[low + of], ids[low + of], begins, [places[low + k] for k in of.tolist()], part, hot, width, buckets)
        low = high


def _slice_records(bodies: list[bytes], rows: np.ndarray, ids: np.ndarray, begins: np.ndarray, places: list[np.ndarray], part: int, hot: np.ndarray, width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    own = Windows(bodies, width)
    wanted = np.zeros(len(own.text) + 1, bool)
    for k, at in enumerate(places):
        inside = at[(at >= begins[k]) & (at < begins[k] + len(bodies[k]))] - begins[k]
        wanted[own.starts[k] + inside] = True
    runs = np.flatnonzero(wanted[own.place])
    if not len(runs):
        return
    first, last, doc, rank = own.first[runs], own.last[runs], own.doc[runs], own.rank[runs] >> U64(16)
    common = hot[np.minimum(np.searchsorted(hot, rank), len(hot) - 1)] == rank if len(hot) else np.zeros(len(rank), bool)
    if common.any():  # their windows go one by one, by all their bytes
        many = (last - first + 1)[common]
        at = gather(first[common], many)
        of_window = np.repeat(doc[common], many)
        first, last = np.concatenate([first[~common], at]), np.concatenate([last[~common], at])
        doc, rank = np.concatenate([doc[~common], of_window]), np.concatenate([rank[~common], ranks(own.text, width)[at] >> U64(16)])
    size = last + width - first
    flat = own.text.tobytes()
    texts = [flat[a : a + n] for a, n in zip(first.tolist(), size.tolist(), strict=True)]
    coded = pa.array(texts, pa.binary()).dictionary_encode().indices.to_numpy()
    id_of = ids[doc]
    least = np.full(coded.max() + 1, NO_ID, np.int64)
    np.minimum.at(least, coded, id_of)
    known = id_of > least[coded]  # a smaller document of this task has the same run
    start = first - own.starts[doc] + begins[doc]
    done = np.flatnonzero(known)
    if len(done):
        parts, blobs = _by_part(np.full(len(done), part), rows[doc[done]], _pairs(start[done], start[done] + size[done]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts)) % buckets, pa.int64()), parts, blobs], schema=KEYED)
    left = np.flatnonzero(~known)
    bucket = (rank % U64(buckets)).astype(np.int64)[left]
    left = left[np.argsort(bucket, kind="stable")]
    bucket = np.sort(bucket)
    for own_bucket in np.split(np.arange(len(left)), np.flatnonzero(np.diff(bucket)) + 1):
        mine = left[own_bucket]
        used, local = np.unique(doc[mine], return_inverse=True)
        head = _packed(rows[used], ids[used].view(U64), np.full(len(used), part, "<u8"))
        body = _packed(local.astype("<u4"), start[mine].astype("<u4"), size[mine].astype("<u4"))
        text = zstandard.compress(b"".join(texts[i] for i in mine.tolist()), 3)
        blob = len(head).to_bytes(4, "little") + len(body).to_bytes(4, "little") + head + body + text
        yield pa.RecordBatch.from_arrays([pa.array([int(bucket[own_bucket[0]])], pa.int64()), pa.array([None], pa.int64()), pa.array([blob], pa.binary())], schema=KEYED)


def merged(pairs: np.ndarray) -> list[tuple[int, int]]:
    """Ranges united where they touch, in order."""
    out: list[tuple[int, int]] = []
    for pair in np.sort(pairs << U64(32) | pairs >> U64(32)).tolist():
        start, stop = pair >> 32, pair & 0xFFFFFFFF
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 50, with_text: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start and stop, in bytes), and text where asked for.

    Every byte goes that a string of `width` bytes covers which also starts in a row with a smaller id. Null texts are empty; rows
    without an id come after all others, and lose nothing to one another; nor do rows that repeat an id. Each row gives a row; an
    empty table gives none. Other columns aren't read. text holds what is left, bytes that no longer form characters replaced. hot_rows: see HOT_ROWS; more
    where MOST_HOT ranks could have as many. Texts of 4 GB and more can't be told their places in 32 bits and are an error.
    """
    if width < GRAM:
        raise ValueError(f"width must be {GRAM} or more: {width}")
    own = id_and_bytes(docs, id_col, text_col).withColumn("row", F.xxhash64("doc_id", "body"))
    sizes = own.agg(F.coalesce(F.sum(F.octet_length("body").cast("long")), F.lit(0)).alias("total"), F.max(F.octet_length("body")).alias("longest")).first()
    total = sizes["total"]
    if (sizes["longest"] or 0) >= 1 << 32:
        raise ValueError("a text of 4 GB or more")
    parts = max(8, -(-total // PART_BYTES))
    own = own.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "doc_id", "body"), F.lit(parts)))

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("doc_id"), batch.column("row"), pa.array([press.compress(b) for b in batch.column("body").to_pylist()], pa.binary())], names=["part", "doc_id", "row", "ztext"])

    pressed = own.select("doc_id", "body", "row", "part").mapInArrow(small, "part long, doc_id long, row long, ztext binary")
    places = materialize(shared_positions(own, width, max(8, -(-total // RANK_BYTES)), max(hot_rows, total // GRAM // MOST_HOT)))
    hot = np.sort(np.frombuffer(b"".join(bytes(r["blob"]) for r in places.where(F.col("part") == HOT).select("blob").collect()), U64))
    gone = repeated_windows(pressed, places.where(F.col("part") != HOT), hot, width, max(8, -(-total // WINDOW_BYTES)))

    def finish(docs: pa.Table, found: pa.Table) -> pa.Table:
        ranges = _of_rows(found, docs.column("row").to_numpy().view(U64), "<u8")
        rows = []
        for doc, pressed_text, pairs in zip(docs.column("doc_id").to_pylist(), docs.column("ztext").to_pylist(), ranges, strict=True):
            body = zstandard.decompress(pressed_text)
            spans = merged(pairs)
            edges = [0, *(x for span in spans for x in span), len(body)]
            kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            row = {"doc_id": doc, "n_bytes": len(body), "n_removed": len(body) - len(kept), "n_spans": len(spans), "kept_sha256": hashlib.sha256(kept).hexdigest(), "spans": [{"start": a, "stop": b} for a, b in spans]}
            rows.append(row | ({"text": kept.decode("utf-8", "replace")} if with_text else {}))
        return pa.Table.from_pylist(rows, out)

    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]
    out = pa.schema(fields + [("text", pa.string())] * with_text)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, stop: long>>" + ", text string" * with_text
    return pressed.groupBy("part").cogroup(gone.groupBy("part")).applyInArrow(finish, schema)


def op1_suffix_dedup(docs: DataFrame) -> DataFrame:
    """Per row of docs the contract's columns. Odd rows are those of remove_repeats: each row gives one, an empty text with nothing removed."""
    return remove_repeats(docs).drop("spans")
