"""Quality rules: fixed limits on repetition and length, then robust multivariate outliers.

The statistics of each document become a vector of transformed values. Per language and source the
minimum covariance determinant is estimated from several starts by concentration steps, each of them a grouped
aggregation over all documents: distances, their histogram, the cut that holds the nearest h documents, then the mean
and covariance of those. Of the starts the one of least determinant goes on until its cut stands still. Documents beyond a
chi-square limit of the squared Mahalanobis distance go.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samplekit.llm.common import id_and_bytes, materialize, slices, starts_of

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punct")
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PUNCT = b"!\"'(),-./:;?@[\\]^_`{}~+="
#: Name, expression and least standard deviation of each transformed statistic. The floors say which differences are immaterial, and keep a covariance regular where a statistic hardly varies.
VECTOR: tuple[tuple[str, str, float], ...] = (
    ("size", "ln(1 + n_words)", 0.5),
    ("word_length", "ln((1 + word_chars) / (1 + n_words))", 0.1),
    ("symbols", "sqrt(n_symbols / (1 + word_chars))", 0.04),
    ("dup_lines", "sqrt(n_dup_lines / (1 + n_lines))", 0.12),
    ("repeats", "sqrt(n_repeat_words / (1 + n_words))", 0.12),
    ("upper", "sqrt(n_upper / (1 + word_chars))", 0.05),
    ("punct", "sqrt(n_punct / (1 + word_chars))", 0.05),
)
NAMES = [name for name, _, _ in VECTOR]
PAIRS = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[i:]]
FINE = 32  # histogram bins for each doubling of a squared distance


def repeated_words(ids: np.ndarray, docs: np.ndarray, n_docs: int, width: int = 5) -> np.ndarray:
    """Per document: words in windows of so many words that the document has twice or more.

    ids and docs: of each word, its number and its document's. Windows meet by a hash of their numbers
    and are then compared word by word.
    """
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(n_docs, np.int64)
    inside = docs[:n] == docs[width - 1 :]
    at = np.flatnonzero(inside)
    key = (docs[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(width):
        key = (key ^ (ids[at + k].astype(np.uint64) + np.uint64(1))) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    hits = np.zeros(n, bool)
    if same.any():
        first, second = at[order[:-1][same]], at[order[1:][same]]
        equal = docs[first] == docs[second]
        for k in range(width):
            equal &= ids[first + k] == ids[second + k]
        hits[first[equal]] = hits[second[equal]] = True
        if not equal.all():  # different windows with one hash: count those documents by the windows themselves
            odd = np.unique(np.concatenate([docs[first[~equal]], docs[second[~equal]]]))
            for doc in odd.tolist():
                places = defaultdict(list)
                for i in at[docs[at] == doc].tolist():
                    places[tuple(ids[i : i + width].tolist())].append(i)
                for found in places.values():
                    hits[found] = len(found) > 1
    marks = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(hits)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + width, -1)
    covered = np.cumsum(marks[:-1]) > 0
    return np.bincount(docs[covered], minlength=n_docs).astype(np.int64)


def _dup_lines(body: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier one; lines with a word."""
    lines = [line for line in body.split(b"\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines)), len(lines)


def _without(body: bytes, drop: bytes) -> int:
    return len(body) - len(body.translate(None, drop))


def count_statistics(docs: DataFrame, *keep: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the columns named in keep, and COUNTS, of the whole texts. A null text has no words and no lines."""
    own = id_and_bytes(docs, id_col, text_col, *keep)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=3 << 20):
            bodies = batch.column("body").to_pylist()
            split = [body.split() for body in bodies]
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            number: defaultdict[bytes, int] = defaultdict()
            number.default_factory = number.__len__
            ids = np.fromiter((i for words in split for i in map(number.__getitem__, words)), np.int64, int(sizes.sum()))
            lines = [_dup_lines(body) for body in bodies]
            columns = {
                "n_words": sizes,
                "word_chars": [len(body.translate(None, SPACES).decode("utf-8", "replace")) for body in bodies],
                "n_symbols": [_without(body, SYMBOLS) for body in bodies],
                "n_dup_lines": [a for a, _ in lines],
                "n_repeat_words": repeated_words(ids, np.repeat(np.arange(len(bodies)), sizes), len(bodies)),
                "n_lines": [b for _, b in lines],
                "n_upper": [_without(body, UPPER) for body in bodies],
                "n_punct": [_without(body, PUNCT) for body in bodies],
            }
            kept = [batch.column(c) for c in ("doc_id", *keep)]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(np.asarray(columns[c], np.int64)) for c in COUNTS)], names=["doc_id", *keep, *COUNTS])

    fields = [own.schema[c] for c in ("doc_id", *keep)]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return own.mapInArrow(count, f"{kept}, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed(words: str = "n_words", repeats: str = "n_repeat_words") -> Column:
    return (F.col(words) < 10) | (F.col(repeats) * 100 > F.col(words) * 20)


def chi2_quantile(p: float, df: int) -> float:
    """By the cube-root normal approximation."""
    z = NormalDist().inv_cdf(p)
    return df * (1 - 2 / (9 * df) + z * math.sqrt(2 / (9 * df))) ** 3


def _shape(sums: pd.DataFrame) -> pd.DataFrame:
    """Mean, inverse covariance and log determinant from the sums of each cell and start."""
    floors = np.diag([floor**2 for _, _, floor in VECTOR])
    rows = []
    for r in sums.to_dict("records"):
        n = max(r["n"], 1)
        mean = np.array([r[f"s_{a}"] / n for a in NAMES])
        cov = np.zeros((len(NAMES), len(NAMES)))
        for a, b in PAIRS:
            i, j = NAMES.index(a), NAMES.index(b)
            cov[i, j] = cov[j, i] = r[f"s_{a}_{b}"] / n - mean[i] * mean[j]
        inverse = np.linalg.inv(cov + floors)
        rows.append({"cell": r["cell"], "start": r["start"], "cut": r["cut"], "logdet": np.linalg.slogdet(cov + floors)[1]} | {f"m_{a}": m for a, m in zip(NAMES, mean, strict=True)} | {f"v_{a}_{b}": inverse[NAMES.index(a), NAMES.index(b)] for a, b in PAIRS})
    return pd.DataFrame(rows, columns=["cell", "start", "cut", "logdet", *(f"m_{a}" for a in NAMES), *(f"v_{a}_{b}" for a, b in PAIRS)])


SHAPE = "cell string, start int, cut long, logdet double, " + ", ".join([*(f"m_{a} double" for a in NAMES), *(f"v_{a}_{b} double" for a, b in PAIRS)])
KEYS = ["cell", "start"]


def _fitted(rows: DataFrame, weight: Column | None = None) -> DataFrame:
    """One row per cell and start, of numbers whose count doesn't depend on the rows. weight: of each row in the products; cut: of the cell, where rows have it."""
    weight = F.lit(1.0) if weight is None else weight
    cut = F.max("cut") if "cut" in rows.columns else F.lit(0)
    sums = rows.groupBy(*KEYS).agg(F.count("*").alias("n"), cut.cast("long").alias("cut"), *(F.sum(a).alias(f"s_{a}") for a in NAMES), *(F.sum(F.col(a) * F.col(b) * weight).alias(f"s_{a}_{b}") for a, b in PAIRS))
    return sums.mapInPandas(lambda parts: (_shape(p) for p in parts), SHAPE)


def _distance() -> Column:
    """Squared Mahalanobis distance."""
    parts = [(F.col(a) - F.col(f"m_{a}")) * (F.col(b) - F.col(f"m_{b}")) * F.col(f"v_{a}_{b}") * (1.0 if a == b else 2.0) for a, b in PAIRS]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return F.greatest(total, F.lit(0.0))


class Cells:
    """Estimates for all cells at once. rows: cell and NAMES. small: whether what has a row for each cell may be broadcast."""

    def __init__(self, rows: DataFrame, small: bool) -> None:
        self.rows = rows
        self.small = small

    def beside(self, rows: DataFrame, of_cells: DataFrame, keys: list[str]) -> DataFrame:
        return rows.join(F.broadcast(of_cells) if self.small else of_cells, keys)

    def measured(self, rows: DataFrame, shape: DataFrame) -> DataFrame:
        """A row for each start that its cell has in shape."""
        far = self.beside(rows, shape.drop("cut"), ["cell"]).select(*rows.columns, "start", _distance().alias("d2"))
        return far.withColumn("bin", F.floor(F.log2(F.col("d2") + 1e-6) * FINE))

    def cut(self, measured: DataFrame, share: float) -> DataFrame:
        """Per cell and start: the first bin up to which that share of the rows lies. There are a few thousand bins at most."""
        bins = measured.groupBy(*KEYS, "bin").agg(F.count("*").alias("rows"))
        every = Window.partitionBy(*KEYS)
        upto = every.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counted = bins.withColumn("upto", F.sum("rows").over(upto)).withColumn("all", F.sum("rows").over(every))
        return counted.where(F.col("upto") >= F.ceil(F.col("all") * share)).groupBy(*KEYS).agg(F.min("bin").alias("cut"))

    def medians(self) -> DataFrame:
        """cell, m_ and w_ of each statistic: its median and its scaled median deviation with the floor."""
        middle = self.rows.groupBy("cell").agg(*(F.percentile_approx(n, 0.5, 1000).alias(f"m_{n}") for n in NAMES))
        away = [F.percentile_approx(F.abs(F.col(n) - F.col(f"m_{n}")), 0.5, 1000).alias(f"w_{n}") for n in NAMES]
        spread = self.beside(self.rows, middle, ["cell"]).groupBy("cell").agg(*(F.first(f"m_{n}").alias(f"m_{n}") for n in NAMES), *away)
        wide = [F.sqrt(F.pow(F.col(f"w_{n}") * 1.4826, 2) + floor**2).alias(f"w_{n}") for n, _, floor in VECTOR]
        return spread.select("cell", *(f"m_{n}" for n in NAMES), *wide)

    def starts(self) -> DataFrame:
        """Three shapes of each cell: medians and median deviations (0), all rows (1), the directions of all rows from the medians (2)."""
        middle = materialize(self.medians())
        inverse = [(1 / F.pow(f"w_{x}", 2) if x == y else F.lit(0.0)).alias(f"v_{x}_{y}") for x, y in PAIRS]
        plain = middle.select("cell", F.lit(0).alias("start"), F.lit(0).cast("long").alias("cut"), F.lit(0.0).alias("logdet"), *(f"m_{n}" for n in NAMES), *inverse)
        whole = _fitted(self.rows.select("cell", F.lit(1).alias("start"), *NAMES))
        centred = self.beside(self.rows, middle, ["cell"])
        centred = centred.select("cell", F.lit(2).alias("start"), *((F.col(n) - F.col(f"m_{n}")).alias(n) for n in NAMES), *(F.col(f"w_{n}") for n in NAMES))
        length = sum((F.pow(F.col(n) / F.col(f"w_{n}"), 2) for n in NAMES), F.lit(0.0))
        # Signs are centred on the medians already; their mean is put back to nothing by halves of opposite sign.
        both = centred.withColumn("sign", F.explode(F.array(F.lit(1.0), F.lit(-1.0))))
        signs = _fitted(both.select("cell", "start", *((F.col(n) * F.col("sign")).alias(n) for n in NAMES), length.alias("length")), len(NAMES) / F.greatest("length", F.lit(1e-9)))
        moved = self.beside(signs.drop(*(f"m_{n}" for n in NAMES)), middle, ["cell"]).select(plain.columns)
        return plain.unionByName(whole).unionByName(moved)

    def step(self, shape: DataFrame, share: float) -> DataFrame:
        """Shapes of the nearest share of rows, with the cut that holds them."""
        measured = self.measured(self.rows, shape)
        near = self.beside(measured, self.cut(measured, share), KEYS).where(F.col("bin") <= F.col("cut"))
        return materialize(_fitted(near))

    def least_determinant(self, share: float, first: int, most: int) -> DataFrame:
        """One shape for each cell: `first` steps from every start, then those of the least determinant until no cut moves, or `most` steps."""
        shape = materialize(self.starts())
        for _ in range(first):
            shape = self.step(shape, share)
        best = Window.partitionBy("cell").orderBy("logdet", "start")
        shape = materialize(shape.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth"))
        for _ in range(most - first):
            following = self.step(shape, share)
            moved = self.beside(following.select(*KEYS, "cut"), shape.select(*KEYS, F.col("cut").alias("before")), KEYS).where("cut <> before")
            shape = following
            if moved.isEmpty():
                break
        return shape


def mcd_distances(stats: DataFrame, *, by: tuple[str, str] = ("lang", "source"), least: int = 200, share: float = 0.75, first: int = 2, steps: int = 8, most_cells: int = 50_000) -> DataFrame:
    """stats (doc_id, by, COUNTS) with cell and d2, the squared robust distance of a row in its cell.

    A cell is a language and source; with fewer than `least` rows the language, and below that all rows. Shape and scale
    of a language or of all rows are those of all its rows, large sources included.
    share: of a cell's rows that the determinant is kept least over; first, steps: concentration steps from every start, and in all.
    most_cells: up to which what has a row for each cell (300 bytes) is broadcast. A null language or source is a value of its own. Ties at the cut
    go in together.
    """
    a, b = (F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in by)
    rows = stats.select("*", *(F.expr(e).alias(n) for n, e, _ in VECTOR)).withColumn("part", F.concat(F.lit("1"), a)).withColumn("whole", F.concat_ws("\1", F.concat(F.lit("2"), a), b))
    sizes = rows.groupBy("part", "whole").agg(F.count("*").alias("rows"))
    of_part = Window.partitionBy("part")
    sizes = sizes.withColumn("in_part", F.sum("rows").over(of_part)).withColumn("fewest", F.min("rows").over(of_part))
    sizes = sizes.crossJoin(F.broadcast(sizes.agg(F.min("in_part").alias("fewest_in_part"))))
    large = {"whole": F.col("rows") >= least, "part": (F.col("in_part") >= least) & (F.col("fewest") < least)}
    fits = [F.when(large["whole"], F.col("whole")), F.when(large["part"], F.col("part")), F.when(F.col("fewest_in_part") < least, F.lit("0"))]
    cell = F.when(large["whole"], F.col("whole")).when(large["part"], F.col("part")).otherwise("0")
    cells = materialize(sizes.select("whole", cell.alias("cell"), F.array_compact(F.array(*fits)).alias("fits")))
    small = cells.count() <= most_cells
    rows = materialize(rows.join(F.broadcast(cells) if small else cells, "whole").drop("whole", "part"))
    own = rows.drop("fits")
    each = Cells(rows.select(F.explode("fits").alias("cell"), *NAMES), small)  # each row counts in every cell that it is part of
    shape = each.least_determinant(share, first, steps)
    middle = each.cut(each.measured(each.rows, shape), 0.5)
    scale = middle.select("cell", (F.pow(2.0, F.col("cut") / FINE) / chi2_quantile(0.5, len(NAMES))).alias("scale"))
    scaled = each.beside(each.measured(own, shape), scale, ["cell"])
    return scaled.withColumn("d2", F.col("d2") / F.greatest("scale", F.lit(1.0))).drop("scale", "bin", "start", *NAMES)


def judge_quality(docs: DataFrame, *keep: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", beyond: float = 1e-7) -> DataFrame:
    """Per row of docs: doc_id, the columns named in keep, COUNTS, base_failed, kept, d2.

    beyond: share of regular documents that the distance may reject. Null or empty texts have no words and
    fail the base; a null id stays null; repeated rows each give a row; an empty table gives none. Other
    columns aren't read.
    """
    renamed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), *keep)
    stats = materialize(count_statistics(renamed, "lang", "source", *keep))
    far = mcd_distances(stats)
    return far.select("doc_id", *keep, *COUNTS, base_failed().alias("base_failed"), (~base_failed() & (F.col("d2") <= chi2_quantile(1 - beyond, len(NAMES)))).alias("kept"), "d2")


def op10_quality_rules(docs: DataFrame) -> DataFrame:
    """Per row of docs the contract's columns and d2. Odd rows are those of judge_quality: each row gives one, without words it has failed."""
    return judge_quality(docs).select("doc_id", *COUNTS[:5], "base_failed", "kept", F.round("d2", 3).alias("d2"))
