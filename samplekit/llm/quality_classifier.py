"""Quality classifier with hierarchical empirical Bayes.

A document's own evidence is the sum of the log odds of its features, of which those are kept that labelled
documents tell apart clearly; a logistic curve makes it a Bayes factor. The curve is fitted on labelled documents whose
evidence comes from the other half of them, so that no document vouches for itself. The rate of
the class on a host, and on a path of the host, is estimated from all its documents and shrunk towards
the level above it by as much as hosts, and paths, differ; a document meets the rates of its site without itself. Document and
site then combine in log odds.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplekit.llm.common import LOWER, id_and_bytes, materialize, slices

#: Kinds of characters, for the shape of a word: a letter, A capital, 0 digit; others stand for themselves.
_SHAPE = bytes(97 if c >= 0x80 or 97 <= c <= 122 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
FOLDS = 2
KINDS = (b"w", b"p", b"s")


def _shape(word: bytes) -> bytes:
    kinds = word.translate(_SHAPE)
    return bytes(c for i, c in enumerate(kinds) if not i or kinds[i - 1] != c)[:6]


def bare(word: bytes) -> bytes:
    return word.translate(LOWER).strip(b".,;:!?$%&*#|")


class Features:
    """Of a text: its bare words, their beginnings, and how large a share of its words has a shape or repeats the one before."""

    def __init__(self) -> None:
        self.known: dict[bytes, tuple[bytes, tuple[bytes, ...]]] = {}

    def _of(self, word: bytes) -> tuple[bytes, tuple[bytes, ...]]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 300_000:
                self.known.clear()
            low = bare(word)
            got = self.known[word] = (_shape(word), (b"w" + low, *(b"p" + low[:k] for k in (4, 5) if len(low) > k)))
        return got

    def __call__(self, body: bytes) -> set[bytes]:
        words = body.split()
        shapes: Counter[bytes] = Counter()
        out: set[bytes] = set()
        for word, n in Counter(words).items():
            shape, own = self._of(word)
            shapes[shape] += n
            out.update(own)
        shapes[b"again"] = sum(map(bytes.__eq__, words[1:], words[:-1]))
        for shape, n in shapes.items():
            if n and 50 * n >= len(words):
                out.add(b"s%d" % (3 if 4 * n >= len(words) else 2 if 10 * n >= len(words) else 1) + shape)
        return out


def feature_counts(labelled: DataFrame, targets: list[str]) -> DataFrame:
    """feature and, for each target, class and fold, how many labelled documents have it (no_ and yes_ columns). labelled: body, fold, targets (0, 1 or null)."""
    names = [f"{c}_{k}_{f}" for k in targets for f in range(FOLDS) for c in ("no", "yes")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in slices(batches, limit=16 << 20):
            marks = zip(*(batch.column(k).to_pylist() for k in ("fold", *targets)), strict=True)
            totals: defaultdict[tuple, Counter[bytes]] = defaultdict(Counter)  # by fold and marks
            for body, mark in zip(batch.column("body").to_pylist(), marks, strict=True):
                totals[mark].update(features(body))
            place = {feature: i for i, feature in enumerate(set().union(*totals.values()))}
            table = np.zeros((len(names), len(place)), np.int64)
            for (fold, *ys), own in totals.items():
                at, n = np.fromiter(map(place.__getitem__, own), np.int64, len(own)), np.fromiter(own.values(), np.int64, len(own))
                for t, y in enumerate(ys):
                    if y is not None:
                        table[2 * (FOLDS * t + fold) + y, at] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(place), pa.binary()), *map(pa.array, table)], names=["feature", *names])

    found = labelled.mapInArrow(count, "feature binary, " + ", ".join(f"{n} long" for n in names))
    return found.groupBy("feature").agg(*(F.sum(n).alias(n) for n in names))


def _odds(yes: Column, no: Column, all_yes: int, all_no: int) -> tuple[Column, Column]:
    """Log odds of a feature, and the root of its likelihood ratio against equal rates."""
    both = yes + no

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)

    cells = [(yes, both * all_yes), (no, both * all_no), (all_yes - yes, (all_yes + all_no - both) * all_yes), (all_no - no, (all_yes + all_no - both) * all_no)]
    ratio = sum((term(seen, share / float(all_yes + all_no)) for seen, share in cells), F.lit(0.0))
    return F.log((yes + 0.5) / (all_yes - yes + 0.5)) - F.log((no + 0.5) / (all_no - no + 0.5)), F.sqrt(F.greatest(ratio, F.lit(0.0)))


def feature_weights(labelled: DataFrame, targets: list[str], *, clear: float = 4.0, least_seen: int = 4, most_features: int = 50_000) -> dict[str, dict[bytes, float]]:
    """By target, the log odds of its features; by "target/fold", those from all other folds.

    Kept are features of least_seen documents or more whose likelihood ratio has a root of `clear` or more; of more than most_features, the clearest.
    """
    sides = [F.count_if((F.col(k) == y) & (F.col("fold") == f)).alias(f"{c}_{k}_{f}") for k in targets for f in range(FOLDS) for y, c in enumerate(("no", "yes"))]
    sizes = labelled.agg(*sides).first().asDict()
    parts = {k: list(range(FOLDS)) for k in targets} | {f"{k}/{f}": [g for g in range(FOLDS) if g != f] for k in targets for f in range(FOLDS)}
    weighed, roots = [], []
    for name, folds in parts.items():
        k = name.split("/")[0]
        yes, no = (sum((F.col(f"{c}_{k}_{f}") for f in folds), F.lit(0)) for c in ("yes", "no"))
        all_yes, all_no = (sum(sizes[f"{c}_{k}_{f}"] for f in folds) for c in ("yes", "no"))
        odds, root = _odds(yes, no, all_yes, all_no) if all_yes and all_no else (F.lit(0.0), F.lit(0.0))
        kept = (yes + no >= least_seen) & (root >= clear)
        weighed.append(F.when(kept, odds).alias(name))
        roots.append(F.when(kept, root).otherwise(0.0))
    rows = feature_counts(labelled, targets).select("feature", *weighed, F.greatest(*roots).alias("z")).where("z > 0").orderBy(F.desc("z"), "feature").limit(most_features).collect()
    return {name: {bytes(r["feature"]): r[name] for r in rows if r[name] is not None} for name in parts}


class Words:
    """Of the words of several texts, one text after the other: which bare words and beginnings of words each text has, of those that have a weight."""

    def __init__(self, coded: pa.DictionaryArray, sizes: np.ndarray, known: list[tuple[bytes, int]], words: set[bytes], parts: set[bytes]) -> None:
        self.n = len(sizes)
        at, doc = coded.indices.to_numpy(), np.repeat(np.arange(self.n), sizes)
        lows = [low for low, _ in known]
        self.words, self.of_word = self._pairs(doc, at, [low if low in words else None for low in lows])
        begins = [self._pairs(doc, at, [low[:size] if len(low) > size and low[:size] in parts else None for low in lows]) for size in (4, 5)]
        self.parts, self.of_part = [x for x, _ in begins], [x for _, x in begins]

    @staticmethod
    def _pairs(doc: np.ndarray, at: np.ndarray, values: list[bytes | None]) -> tuple[list[bytes], tuple[np.ndarray, np.ndarray]]:
        """Distinct values, and the distinct pairs of a text and one of them. values: of each distinct word."""
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        own = np.fromiter((-1 if v is None else number[v] for v in values), np.int64, len(values))[at] if values else np.zeros(0, np.int64)
        some = np.flatnonzero(own >= 0)
        pairs = np.unique(doc[some] * max(len(number), 1) + own[some])
        return list(number), (pairs // max(len(number), 1), pairs % max(len(number), 1))

    def sums(self, names: list[bytes], pairs: tuple[np.ndarray, np.ndarray], odds: dict[bytes, float]) -> np.ndarray:
        own = np.fromiter((odds.get(x, 0.0) for x in names), np.float64, len(names))
        return np.bincount(pairs[0], own[pairs[1]], self.n) if len(names) else np.zeros(self.n)


class Evidence:
    """Sums of log odds by kind of feature, of many texts at once."""

    def __init__(self, odds: dict[bytes, float]) -> None:
        self.words, self.parts, self.shapes = ({k[1:]: v for k, v in odds.items() if k[:1] == kind} for kind in KINDS)

    def __call__(self, texts: Words) -> np.ndarray:
        out = np.zeros((texts.n, len(KINDS)))
        out[:, 0] = texts.sums(texts.words, texts.of_word, self.words)
        for names, pairs in zip(texts.parts, texts.of_part, strict=True):
            out[:, 1] += texts.sums(names, pairs, self.parts)
        return out

    def of_shapes(self, counts: np.ndarray, sizes: np.ndarray, names: list[bytes]) -> np.ndarray:
        """counts: of each text and shape, its words."""
        table = np.array([[0.0, *(self.shapes.get(b"%d" % k + name, 0.0) for k in (1, 2, 3))] for name in names])
        level = np.where(4 * counts >= sizes[:, None], 3, np.where(10 * counts >= sizes[:, None], 2, np.where(50 * counts >= sizes[:, None], 1, 0)))
        level[counts == 0] = 0
        return table[np.arange(len(names))[None, :], level].sum(axis=1)


def _shape_counts(coded: pa.DictionaryArray, sizes: np.ndarray, known: list[tuple[bytes, int]], shapes: int) -> np.ndarray:
    """Words of each text by shape; the last column counts words that repeat the one before."""
    at = coded.indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    number = np.fromiter((k for _, k in known), np.int64, len(known))
    out = np.zeros((len(sizes), shapes + 1), np.int64)
    if len(at):
        out[:, :shapes] = np.bincount(text * shapes + number[at], minlength=len(sizes) * shapes).reshape(len(sizes), shapes)
        out[:, shapes] = np.bincount(text[1:][(at[1:] == at[:-1]) & (text[1:] == text[:-1])], minlength=len(sizes))
    return out


def evidence(docs: DataFrame, weights: dict[str, dict[bytes, float]]) -> DataFrame:
    """docs (doc_id, body, more) without body, with an array for each of the named weights: the sums of log odds over words, beginnings and shapes."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kept = [c for c in docs.columns if c != "body"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [Evidence(odds) for odds in shared.value.values()]
        some_words, some_parts = set().union(*(p.words for p in parts)), set().union(*(p.parts for p in parts))
        for batch in slices(batches):
            split = pc.ascii_split_whitespace(batch.column("body").view(pa.string()))
            flat, lengths = split.flatten(), pc.list_value_length(split).to_numpy()
            full = pc.not_equal(flat, "")
            sizes = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[full.to_numpy(zero_copy_only=False)], minlength=len(lengths))
            coded = flat.filter(full).dictionary_encode()
            number: defaultdict[bytes, int] = defaultdict()
            number.default_factory = number.__len__
            known = [(bare(w), number[_shape(w)]) for w in coded.dictionary.view(pa.binary()).to_pylist()]
            counts = _shape_counts(coded, sizes, known, len(number))
            texts, sums = Words(coded, sizes, known, some_words, some_parts), []
            for own in parts:
                got = own(texts)
                got[:, 2] = own.of_shapes(counts, sizes, [*number, b"again"])
                sums.append(pa.array(list(got), pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *sums], names=[*kept, *weights])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "body")
    return docs.mapInArrow(score, f"{kinds}, " + ", ".join(f"`{k}` array<double>" for k in weights))


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def curve(y: np.ndarray, x: np.ndarray, ridge: float = 1e-4) -> tuple[list[float], float]:
    """Slopes, none below 0, and intercept of the log Bayes factor as a plane over the sums of evidence, by Newton steps; both classes weigh the same."""
    if len(set(y.tolist())) < 2:
        return [0.0] * x.shape[1], 0.0
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean()) / len(y)
    scale = np.maximum(x.std(axis=0), 1e-9)
    own = np.column_stack([x / scale, np.ones(len(y))])
    penalty = np.diag([ridge] * x.shape[1] + [0.0])
    beta = np.zeros(own.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(own @ beta, -30, 30)))
        step = np.linalg.solve((own * (weight * p * (1 - p))[:, None]).T @ own + penalty + 1e-12 * np.eye(len(beta)), own.T @ (weight * (y - p)) - penalty @ beta)
        beta += step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-9:
            break
    return [max(0.0, float(b)) for b in beta[:-1] / scale], float(beta[-1])


def _strength(groups: DataFrame, k: str, up: Column) -> float:
    """The weight of the level above, in documents: what the variance between groups leaves of that within."""
    mean = F.col(f"{k}_total") / F.col("n")
    pooled = groups.agg(F.sum("n").alias("n"), F.sum(F.col("n") * (mean - up) ** 2).alias("between"), F.count("*").alias("groups"), F.sum(up * (1 - up) * F.col("n")).alias("within")).first()
    if not pooled["n"] or not pooled["groups"]:
        return 10.0
    within = (pooled["within"] or 0.0) / pooled["n"]
    between = max(0.0, (pooled["between"] or 0.0) / pooled["n"] - within * pooled["groups"] / pooled["n"])
    return min(1000.0, max(2.0, within / between if between > 1e-9 else 1000.0))


def with_sites(rows: DataFrame, priors: dict[str, float], *, most_sites: int = 200_000) -> DataFrame:
    """rows (host, path and, for each of priors, its column of log Bayes factors) with the columns host, path and p of each.

    The rate of a host is shrunk towards the prior and that of a path towards its host; a row meets both without itself.
    most_sites: up to which the rates of all paths, of about 50 bytes each, are broadcast.
    """
    alone = {k: 1 / (1 + F.exp(-(F.col(k) + math.log(prior / (1 - prior))))) for k, prior in priors.items()}
    paths = materialize(rows.groupBy("host", "path").agg(F.count("*").alias("n"), *(F.sum(p).alias(f"{k}_total") for k, p in alone.items())))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), *(F.sum(f"{k}_total").alias(f"{k}_total") for k in priors))
    named = hosts.select("host", F.col("n").alias("host_n"), *(F.col(f"{k}_total").alias(f"{k}_host_total") for k in priors))
    sites = materialize(paths.join(named, "host"))
    out = rows.join(F.broadcast(sites) if sites.count() <= most_sites else sites, ["host", "path"])
    for k, prior in priors.items():
        strong = _strength(hosts, k, F.lit(float(prior)))
        of_host = (F.col(f"{k}_host_total") + strong * prior) / (F.col("host_n") + strong)
        weak = _strength(sites.withColumn("up", of_host), k, F.col("up"))
        out = out.withColumn(f"{k}_alone", alone[k])
        out = out.withColumn(f"{k}_host", (F.col(f"{k}_host_total") - F.col(f"{k}_alone") + strong * prior) / (F.col("host_n") - 1 + strong))
        out = out.withColumn(f"{k}_path", (F.col(f"{k}_total") - F.col(f"{k}_alone") + weak * F.col(f"{k}_host")) / (F.col("n") - 1 + weak))
        out = out.withColumn(f"{k}_p", 1 / (1 + F.exp(-(F.col(k) + _logit(F.col(f"{k}_path"))))))
    return out.drop("n", "host_n", *(f"{k}_{x}" for k in priors for x in ("alone", "total", "host_total")))


def classify(docs: DataFrame, labels: DataFrame, targets: dict[str, Column], *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", most_labelled: int = 40_000, least_seen: int = 4, most_features: int = 50_000) -> DataFrame:
    """Per row of docs: doc_id, host, path and, for each target: its evidence, host and path rate without the row, and posterior probability.

    targets: by name, a 0/1 column of labels, whose key is id_col. At most about most_labelled labelled documents, the first
    by a hash of the id, are learnt from, by features of least_seen of them or more, the most_features clearest; all documents are scored and count
    for the sites. Null texts are empty; a null host or path is a value of its own; labels that are null or without a document don't count; an id
    that is labelled twice counts twice. Repeated rows each give a row; ties between features go by their bytes. Without labels of both classes the
    evidence is 0 and the rate 1/2. An empty table gives no rows. Other columns aren't read.
    """
    own = id_and_bytes(docs.withColumns({"host": F.coalesce(F.col(host_col).cast("string"), F.lit("")), "path": F.coalesce(F.col(path_col).cast("string"), F.lit(""))}), id_col, text_col, "host", "path")
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), *(c.cast("int").alias(k) for k, c in targets.items()))
    share = min(1.0, most_labelled / max(1, marks.count()))
    if share < 1.0:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    fold = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    labelled = materialize(own.select("doc_id", "body").join(marks, "doc_id").select("doc_id", "body", fold, *targets))
    weights = feature_weights(labelled, list(targets), least_seen=least_seen, most_features=most_features)
    apart = {name: odds for name, odds in weights.items() if "/" in name}
    known = evidence(labelled.select("doc_id", "body", "fold", *(F.col(k).alias(f"is_{k}") for k in targets)), apart).collect()  # most_labelled rows of numbers
    scored = evidence(own, {k: weights[k] for k in targets})
    priors = {}
    for k in targets:
        rows = sorted((r for r in known if r[f"is_{k}"] is not None), key=lambda r: r["doc_id"])
        y = np.array([r[f"is_{k}"] for r in rows], np.int64)
        slopes, intercept = curve(y, np.array([r[f"{k}/{r['fold']}"] for r in rows], np.float64).reshape(len(rows), len(KINDS)))
        priors[k] = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
        scored = scored.withColumn(k, sum((F.col(k)[i] * x for i, x in enumerate(slopes)), F.lit(intercept)))
    return with_sites(materialize(scored), priors)


def op9_quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: rates of its host and path, scores, and kept: more likely good than not, and not more likely toxic than not. Odd rows are those of classify."""
    targets = {"quality": (F.col("quality") == 1).cast("int"), "toxic": (F.col("toxic") == 1).cast("int")}
    rows = classify(docs, labels, targets)
    scores = [F.round(f"{k}_{x}", 4).alias(f"{k}_{y}") for k in targets for x, y in (("host", "host"), ("path", "path"), ("p", "score"))]
    return rows.select("doc_id", *scores, ((F.col("quality_p") >= 0.5) & (F.col("toxic_p") < 0.5)).alias("kept"))
