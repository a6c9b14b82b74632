"""SimHash near-duplicates through vantage-point trees.

Two fingerprints of 64 bits that differ in 3 bits or fewer differ in at most 1 bit in one of their halves.
Per half, a vantage-point tree over a bounded sample deals the distinct fingerprints out to shards: a
fingerprint lives in the leaf that its distances to the vantage points lead to, and visits every leaf that
the triangle bounds cannot rule out for a distance of 1. As each level of a tree makes more fingerprints visit, leaves that
would grow with the corpus are cut further by value: of the two 16-bit blocks of a half, one is equal in both. Each shard compares
those that live there with all that visit it, exactly and over all 64 bits, and passes on a spanning forest of the links found,
never all pairs; a shard that is crowded all the same is compared in blocks, by several tasks.
Components of the forests' edges are found by alternating star contractions.

Three bits of 64 reach few pairs of a similarity of 0.8 on shingles. drop_near_duplicates therefore takes candidates from bands
of minimum hashes too, and confirms every candidate by the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplekit.llm.common import LOWER, id_and_bytes, keyed_rows, materialize, slices, starts_of

SEED = 42
SPARE = 1 << 22  # pairs that a shard compares at once


def _shingle_hashes(bodies: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, repeats included, and how many each text has."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(bodies), np.int64)
    for k, body in enumerate(bodies):
        words = body.translate(LOWER).split()
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= width:
            hashes.append(digest(joined, SEED))
            counts[k] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        firsts = np.concatenate(([0], ends[:-width])).tolist()
        lasts = (ends[width - 1 :] - 1).tolist()
        hashes += [digest(joined[a:b], SEED) for a, b in zip(firsts, lasts, strict=True)]
        counts[k] = len(firsts)
    return np.array(hashes, np.uint64), counts


def _majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each text: the bits set in over half of its hashes."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        starts = starts_of(counts[full])[:-1]
        for bit in range(64):
            ones = np.add.reduceat(((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), starts)
            out[full] |= (2 * ones > counts[full]).astype(np.uint64) << np.uint64(bit)
    return out


def _fingerprints(bodies: list[bytes], width: int) -> np.ndarray:
    return _majority_bits(*_shingle_hashes(bodies, width))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Per row: doc_id and fp, the fingerprint as a signed long. No words: fingerprint zero."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=2 << 20):
            fps = _fingerprints(batch.column("body").to_pylist(), width)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return id_and_bytes(docs, id_col, text_col).mapInArrow(hashed, "doc_id long, fp long")


class VantageTree:
    """Of a sample of half fingerprints; every leaf's share of the sample is about `leaf`."""

    def __init__(self, sample: np.ndarray, leaf: int, radius: int) -> None:
        self.radius = radius
        self.point: list[int] = []
        self.limit: list[int] = []
        self.kids: list[tuple[int, int]] = []
        self.leaves = 0
        self.root = self._grow(np.unique(sample), leaf)

    def _grow(self, own: np.ndarray, leaf: int) -> int:
        """The node's number; of a leaf, less than 0."""
        if len(own) > leaf:
            best = None
            for point in own[np.linspace(0, len(own) - 1, 8).astype(int)]:
                far = np.bitwise_count(own ^ point).astype(np.int64)
                limit = int(np.median(far))
                near = int((far <= limit).sum())
                if near < len(own):
                    both = int(((far > limit - self.radius) & (far <= limit + self.radius)).sum())  # live on one side, visit the other
                    best = min(best or (1 << 60, 0, 0), (both + abs(2 * near - len(own)) // 4, int(point), limit))
            if best:
                _, point, limit = best
                node = len(self.point)
                self.point.append(point)
                self.limit.append(limit)
                self.kids.append((0, 0))
                far = np.bitwise_count(own ^ np.uint32(point)).astype(np.int64)
                self.kids[node] = (self._grow(own[far <= limit], leaf), self._grow(own[far > limit], leaf))
                return node
        self.leaves += 1
        return -self.leaves

    def route(self, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, the leaves that they live in or visit, and whether they live there."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        todo = [(self.root, np.arange(len(halves)), np.ones(len(halves), bool))]
        while todo:
            node, rows, home = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                out.append((rows, np.full(len(rows), -node), home))
                continue
            far = np.bitwise_count(halves[rows] ^ np.uint32(self.point[node])).astype(np.int64)
            limit, near = self.limit[node], far <= self.limit[node]
            left, right = far - self.radius <= limit, far + self.radius > limit
            todo.append((self.kids[node][0], rows[left], (home & near)[left]))
            todo.append((self.kids[node][1], rows[right], (home & ~near)[right]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3  # type: ignore[return-value]


def _forest(fps: np.ndarray, home: np.ndarray, bits: int) -> np.ndarray:
    """Of each fingerprint in a shard: the first one of its component, by links of those that live here."""
    root = np.arange(len(fps))
    living = np.flatnonzero(home)
    step = max(1, SPARE // max(1, len(fps)))
    for low in range(0, len(living), step):
        rows = living[low : low + step]
        a, b = np.nonzero(np.bitwise_count(fps[rows, None] ^ fps[None, :]) <= bits)
        a = rows[a]
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root[root] != root).any():
                root = root[root]
    return root


class Dealer:
    """Deals fingerprints out to shards, by a tree for each half of 32 bits and, below its leaves, by value in `parts` parts."""

    def __init__(self, sample: np.ndarray, rows: int, bits: int, leaf: int, most_leaves: int) -> None:
        leaves = min(most_leaves, max(1, rows // leaf))
        self.trees = [VantageTree((sample >> np.uint64(shift)).astype(np.uint32), max(1, len(sample) // leaves), bits // 2) for shift in (0, 32)]
        self.parts = max(1, min(1 << 16, rows // (leaf * leaves)))

    def __call__(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, the shards that they live in or visit, and whether they live there."""
        out = []
        for half, (tree, shift) in enumerate(zip(self.trees, (0, 32), strict=True)):
            own = (fps >> np.uint64(shift)).astype(np.uint32)
            rows, leaves, home = tree.route(own)
            shard = leaves * 2 + half
            if self.parts == 1:
                out.append((rows, shard, home))
                continue
            for block in (0, 1):  # halves that differ in 1 bit have one block of 16 bits in common
                value = (own[rows] >> np.uint32(16 * block)) & np.uint32(0xFFFF)
                part = (value * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.int64) % self.parts
                out.append((rows, (shard * 2 + block) * self.parts + part, home))
        rows, shard, home = (np.concatenate(x) for x in zip(*out, strict=True))
        return rows, shard, home.astype(bool)


def near_edges(distinct: DataFrame, *, bits: int = 3, leaf: int = 1024, most: int = 50_000, most_leaves: int = 256, crowd: int = 16_384) -> DataFrame:
    """Edges (a, b), b smaller, whose components are those of all links of up to `bits` differing bits.

    distinct: node (long, unique), fp (long, unique). most: fingerprints, about, that the trees are fitted on, taken in
    the order of a hash; every fingerprint is then dealt out by them. leaf: fingerprints that should live in a shard; most_leaves: of a tree; beyond, leaves
    are cut by value. crowd: rows of a shard from which it is compared in blocks of so many. bits is 3 or fewer.
    """
    rows = distinct.count()
    share = min(1.0, most / max(rows, 1))
    picked = distinct.select("fp") if share == 1.0 else distinct.select("fp").where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = np.array([r[0] for r in picked.limit(2 * most).collect()], np.int64).view(np.uint64)
    shared = distinct.sparkSession.sparkContext.broadcast(Dealer(sample, rows, bits, leaf, most_leaves))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, shards, home = shared.value(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            rows = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(shards), batch.column("node").take(rows), batch.column("fp").take(rows), pa.array(home)], names=["shard", "node", "fp", "home"])

    def link(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node", ignore_index=True)
        node = part["node"].to_numpy()
        root = _forest(part["fp"].to_numpy().view(np.uint64), part["home"].to_numpy(), bits)
        far = root != np.arange(len(node))
        return pd.DataFrame({"a": node[far], "b": node[root[far]]})

    dealt = distinct.select("node", "fp").mapInArrow(deal, "shard long, node long, fp long, home boolean")
    crowded = materialize(dealt.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("shard", F.ceil(F.col("n") / crowd).cast("int").alias("blocks")))
    if crowded.isEmpty():
        dealt = dealt.withColumn("block", F.lit(0))
    else:
        dealt = _in_blocks(dealt.join(crowded, "shard", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))))
    return dealt.groupBy("shard", "block").applyInPandas(link, "a long, b long").distinct()


def _in_blocks(rows: DataFrame) -> DataFrame:
    """rows (shard, node, home, blocks, more) once for each pair of blocks, with block: those of the first block live there, those of the second visit."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    lives = F.transform(every, lambda k: F.struct((own * F.col("blocks") + k).alias("block"), F.col("home").alias("home")))
    visits = F.transform(F.filter(every, lambda k: k != own), lambda k: F.struct((k * F.col("blocks") + own).alias("block"), F.lit(False).alias("home")))
    lives = F.when(F.col("home"), lives).otherwise(F.slice(lives, own + 1, 1))  # one that only visits is compared in its own block and as a visitor
    kept = [c for c in rows.columns if c not in ("home", "blocks")]
    return rows.select(*kept, F.explode(F.concat(lives, visits)).alias("b")).select(*kept, "b.home", "b.block")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Per node of an edge: node and component, the smallest node that it is linked to, by large and small stars."""
    edges = materialize(edges)
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = materialize(small.where("a <> b").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def hex_of(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = 3) -> DataFrame:
    """Per row of docs: doc_id, fp, component_id (the smallest doc_id reachable by links), n_same (rows of this fingerprint).

    Texts without words have fingerprint zero and link like others. Null texts have no words. Fingerprints are what is linked, so that rows which
    repeat an id with another text are linked by their text alone. A row without an id links like others but is no smallest id; a component
    of such rows alone has none (null). Repeated rows each give a row; an empty table gives none. Other columns aren't read.
    """
    own = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, width=width))
    distinct = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_same")))
    found = components(near_edges(distinct.select(F.col("fp").alias("node"), "fp"), bits=bits))
    placed = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n_same", F.coalesce("component", "fp").alias("component"))
    ids = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialize(placed.join(ids, "component").select("fp", "n_same", "component_id"))
    return _beside_fingerprints(own, named).select("doc_id", "fp", "component_id", "n_same")


HOT_ROWS = 1_000_000  # rows of one fingerprint from which it is broadcast: a table has few such


def _beside_fingerprints(own: DataFrame, named: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """own with the columns of named by fp. Rows of fingerprints that many share, texts without words for one, stay where they are."""
    hot = materialize(named.where(F.col("n_same") > hot_rows))
    if hot.isEmpty():
        return own.join(named, "fp")
    rest = own.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(named, "fp")
    return own.join(F.broadcast(hot), "fp").unionByName(rest)


ROWS_IN_BAND, BANDS = 6, 21  # a similarity of 0.8 meets in one band at least with a probability of 0.998
_r = np.random.default_rng(SEED)
_FACTORS = _r.integers(0, 1 << 32, ROWS_IN_BAND * BANDS, dtype=np.uint32) | np.uint32(1)
_ADDENDS = _r.integers(0, 1 << 32, ROWS_IN_BAND * BANDS, dtype=np.uint32)


def _minima(hashes: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
    """The least value of each hash function over the shingles of each text; all texts have some."""
    starts, short = starts_of(counts)[:-1], (hashes >> np.uint64(17)).astype(np.uint32)
    for factor, addend in zip(_FACTORS, _ADDENDS, strict=True):
        yield np.minimum.reduceat(short * factor + addend, starts)


def _bands(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each text with words: a hash of each band of minimum hashes. One row a text; texts without words have none, rows of zeros."""
    out = np.zeros((len(counts), BANDS), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        for k, least in enumerate(_minima(hashes, counts[full])):
            band = k // ROWS_IN_BAND
            out[full, band] = (out[full, band] ^ least) * np.uint64(0xFF51AFD7ED558CCD)
            out[full, band] ^= out[full, band] >> np.uint64(32)
    return out


def signatures(docs: DataFrame, *keep: str, text_col: str = "text", width: int = 5) -> DataFrame:
    """keep, k1 and k2 (128 bits of the words of a text), fp, bands (empty for a text without words)."""
    own = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=2 << 20):
            bodies = batch.column("body").to_pylist()
            hashes, counts = _shingle_hashes(bodies, width)
            whole = [b" ".join(b.translate(LOWER).split()) for b in bodies]
            keys = [pa.array(np.array([xxhash.xxh64_intdigest(w, seed) for w in whole], np.uint64).view(np.int64)) for seed in (1, 2)]
            bands = [x.view(np.int64) if n else x[:0].view(np.int64) for x, n in zip(_bands(hashes, counts), counts.tolist(), strict=True)]
            columns = [*(batch.column(c) for c in keep), *keys, pa.array(_majority_bits(hashes, counts).view(np.int64)), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "k1", "k2", "fp", "bands"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own.schema if f.name != "body")
    return own.mapInArrow(sign, f"{kinds}k1 long, k2 long, fp long, bands array<long>")


def shingle_sets(texts: DataFrame, *, width: int) -> DataFrame:
    """node, sketch (16 bits of each minimum hash) and shingles (their distinct hashes, ascending), from node and body. A text without words has none."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=2 << 20):
            hashes, counts = _shingle_hashes(batch.column("body").to_pylist(), width)
            full = np.flatnonzero(counts)
            if not len(full):
                continue
            sketches = np.column_stack([x.astype(np.uint16) for x in _minima(hashes, counts[full])])
            sets = [np.unique(x).tobytes() for x in np.split(hashes, np.cumsum(counts[full])[:-1])]
            columns = [batch.column("node").take(pa.array(full)), pa.array([x.tobytes() for x in sketches], pa.binary()), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "sketch", "shingles"])

    return texts.mapInArrow(distinct, "node long, sketch binary, shingles binary")


def _similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Of two ascending sets of hashes: whether so large a share of all is in both."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return same >= similarity * (len(both) - same)


SLACK = 0.14  # four deviations of a similarity of 0.8 as the sketches estimate it


def _linked(node: np.ndarray, home: np.ndarray, sketches: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between those that live here and all. Sketches rule pairs out, shingles decide, pairs that are linked already aren't looked at."""
    root = np.arange(len(node))
    out = []
    for i in np.flatnonzero(home).tolist():
        near = (sketches == sketches[i]).mean(axis=1) >= similarity - SLACK
        near[i] = False
        for j in np.flatnonzero(near).tolist():
            if root[i] != root[j] and _similar(sets[i], sets[j], similarity):
                out.append((int(max(node[i], node[j])), int(min(node[i], node[j]))))
                root[root == root[j]] = root[i]
    return out


MOST_KEYS = 1_000_000  # keys, of 60 bytes each, up to which they are broadcast
LEADERS, FOLLOWERS = 4, 20_000  # texts of a crowded group that its others are held against first; of those, how many one task holds against one


def _to_leaders(crowded: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) from members (band, h, node) of crowded groups to one leader each, the one of the most similar sketch, and between leaders. Leaders are those of least hash, the same in all
    groups that hold them. Sketches are sent for each pair of a member and a leader, shingles once for each member whose sketch is near."""
    least = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("x"), F.col("node").alias("lead"))).alias(f"l{k}") for k in range(LEADERS)]
    leaders = crowded.groupBy("band", "h").agg(*least).select("band", "h", F.explode(F.array(*(F.col(f"l{k}.lead") for k in range(LEADERS)))).alias("lead")).distinct()
    leaders = materialize(leaders)
    small = F.broadcast(leaders) if leaders.count() <= MOST_KEYS else leaders
    pairs = materialize(crowded.join(small, ["band", "h"]).where("node <> lead").select("node", "lead").distinct())
    parts = materialize(pairs.groupBy("lead").agg(F.ceil(F.count("*") / FOLLOWERS).cast("int").alias("parts")))
    small = F.broadcast(parts) if parts.count() <= MOST_KEYS else parts
    own = parts.join(sets, F.col("lead") == F.col("node")).select("lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("sketch").alias("lead_sketch"), F.col("shingles").alias("lead_shingles"))
    dealt = lambda rows: rows.join(small, "lead").select("node", "lead", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    sketched = dealt(pairs).join(sets.select("node", "sketch"), "node").join(own.select("lead", "part", "lead_sketch"), ["lead", "part"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("sketch", "lead_sketch"))
            share = (a == b).mean(axis=1) if batch.num_rows else np.zeros(0)
            rows = pa.array(np.flatnonzero(share >= similarity - SLACK))
            yield pa.RecordBatch.from_arrays([batch.column("node").take(rows), batch.column("lead").take(rows), pa.array(share).take(rows)], names=["node", "lead", "share"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("node").to_numpy(), batch.column("lead").to_numpy()
            same = [_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity) for x, y in zip(batch.column("shingles").to_pylist(), batch.column("lead_shingles").to_pylist(), strict=True)]
            rows = np.flatnonzero(same)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)[rows]), pa.array(np.minimum(a, b)[rows])], names=["a", "b"])

    found = materialize(sketched.mapInArrow(near, "node long, lead long, share double"))
    best = found.groupBy("node").agg(F.max_by("lead", F.struct("share", "lead")).alias("lead"))
    among = found.select("node", "lead").join(parts.select(F.col("lead").alias("node")), "node", "left_semi")  # leaders meet all others, or their followers would fall apart
    whole = dealt(best.union(among).distinct()).join(sets.select("node", "shingles"), "node").join(own.select("lead", "part", "lead_shingles"), ["lead", "part"])
    return materialize(whole.select("node", "lead", "shingles", "lead_shingles").mapInArrow(confirm, "a long, b long"))


def _left_over(crowded: DataFrame, links: DataFrame, crowd: int) -> DataFrame:
    """shard, node, home, block of what is still to be compared in crowded groups that their leaders have not made one: the members outside of a group's largest component, in
    blocks, with chunks of all its members. A group needs no more rows than it has members for each `crowd` of those outside."""
    placed = crowded.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = placed.groupBy("band", "h", "component").agg(F.count("*").alias("own"))
    main = sizes.groupBy("band", "h").agg(F.max_by("component", F.struct("own", "component")).alias("main"), F.max("own").alias("most"), F.sum("own").alias("all"))
    open_groups = materialize(main.where(F.col("most") < F.col("all")))
    small = F.broadcast(open_groups) if open_groups.count() <= MOST_KEYS else open_groups
    rows = placed.join(small, ["band", "h"]).withColumns({"home": F.col("component") != F.col("main"), "chunks": F.ceil(F.col("all") / crowd).cast("int"), "parts": F.ceil((F.col("all") - F.col("most")) / crowd).cast("int")})
    chunk, part = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    cell = lambda i, j, home: F.struct((i * F.col("chunks") + j).alias("block"), F.lit(home).alias("home"))
    visits = F.transform(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: ~F.col("home") | (i != part)), lambda i: cell(i, chunk, False))
    lives = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: cell(part, j, True))).otherwise(F.array().cast("array<struct<block: int, home: boolean>>"))
    return rows.select(F.struct("band", "h").alias("shard"), "node", F.explode(F.concat(visits, lives)).alias("b")).select("shard", "node", "b.home", "b.block")


def similar_links(distinct: DataFrame, docs: DataFrame, *, width: int, similarity: float, bits: int, crowd: int = 2048) -> DataFrame:
    """Links (a, b) whose components are those of all candidates of that similarity. distinct: node, r1, r2 (a row of docs that has the text), fp, bands. docs: r1, r2, text.

    Candidates share a band, a fingerprint, or a link of fingerprints. A group of candidates is compared in a task; one of more than `crowd` texts is held against a few
    leaders first, and only what they have not made one is compared in blocks, by several tasks. Only texts of candidates are read again.
    """
    of_fp = materialize(distinct.groupBy("fp").agg(F.min("node").alias("node")))
    edges = near_edges(of_fp, bits=bits).select(F.lit(-1).alias("band"), F.xxhash64("a", "b").alias("h"), F.explode(F.array("a", "b")).alias("node"))
    groups = distinct.select(F.posexplode("bands").alias("band", "h"), "node").union(distinct.select(F.lit(-2), "fp", "node")).union(edges)
    several = groups.groupBy("band", "h").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(groups.join(several, ["band", "h"]))
    wanted = materialize(members.select("node").distinct().join(distinct.select("node", "r1", "r2"), "node"))
    small = F.broadcast(wanted) if wanted.count() <= MOST_KEYS else wanted
    texts = docs.join(small, ["r1", "r2"]).select("node", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body"))
    sets = materialize(shingle_sets(texts, width=width).dropDuplicates(["node"]))
    placed = members.where(F.col("n") <= crowd).select(F.struct("band", "h").alias("shard"), "node", F.lit(True).alias("home"), F.lit(0).alias("block"))
    crowded = members.where(F.col("n") > crowd).select("band", "h", "node").join(sets.select("node"), "node", "left_semi")
    led = None
    if not crowded.isEmpty():
        led = _to_leaders(crowded, sets, similarity)
        placed = placed.union(_left_over(crowded, led, crowd))
    schema = "a long, b long"

    def link(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node", ignore_index=True)
        sketches = np.stack([np.frombuffer(x, np.uint16) for x in part["sketch"]])
        sets = [np.frombuffer(x, np.uint64) for x in part["shingles"]]
        return pd.DataFrame(_linked(part["node"].to_numpy(), part["home"].to_numpy(), sketches, sets, similarity), columns=["a", "b"], dtype="int64")

    found = placed.join(sets, "node").groupBy("shard", "block").applyInPandas(link, schema)
    return (found if led is None else found.union(led)).distinct()


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, bits: int = 3, crowd: int = 2048) -> DataFrame:
    """One row of each group of near copies: that of the smallest id, one without an id only where none has one.

    Texts are linked if they have so large a share of their shingles of `width` words in common; copies are texts of the same words. Null, empty and
    blank texts are copies of each other. Rows are told apart by 128 bits of all columns of docs, so that rows without an id or with a
    repeated one are documents of their own; rows alike in all columns are one. Of ties one row stays. All columns of docs stay; an empty table stays empty.
    """
    keyed = keyed_rows(docs)
    lean = keyed.select("r1", "r2", F.col(f"row.`{id_col}`").cast("long").alias("own_id"), F.col(f"row.`{text_col}`").alias("text"))
    own = materialize(signatures(lean, "r1", "r2", "own_id", width=width))
    least = F.min(F.struct("r1", "r2")).alias("r")
    numbered = own.groupBy("k1", "k2").agg(least, F.first("fp").alias("fp"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id())
    distinct = materialize(numbered.select("node", "k1", "k2", "r.r1", "r.r2", "fp", "bands"))
    links = similar_links(distinct, lean, width=width, similarity=similarity, bits=bits, crowd=crowd)
    found = components(links)
    named = distinct.select("node", "k1", "k2").join(found, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component"))
    order = F.struct(F.col("own_id").isNull().alias("no_id"), "own_id", "r1", "r2")
    kept = own.select("own_id", "r1", "r2", "k1", "k2").join(named, ["k1", "k2"]).groupBy("component").agg(F.min(order).alias("first")).select("first.r1", "first.r2")
    return keyed.join(kept, ["r1", "r2"], "left_semi").dropDuplicates(["r1", "r2"]).select("row.*")


def op5_simhash(docs: DataFrame) -> DataFrame:
    """Per row of docs the contract's columns. Odd rows are those of near_duplicates: each row gives one; without words it has fingerprint zero."""
    return near_duplicates(docs).select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")
