"""Removal of boilerplate lines that many sites share, with DataFrame functions only.

Each line's hash gets a HyperLogLog sketch of the sites that it is seen on; sketches of map tasks merge by aggregation,
so that a line on a third of all pages costs one sketch a task. Lines whose estimate is near the limit get an exact
count of distinct sites; the others are decided by the sketch, whose error they are beyond. While the lines found are few, their
hashes stand in the plan and documents are cut in one scan; beyond that each document meets its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplekit.llm.common import materialize

BLANK = " \t\r"
LG_K = 12
FEW = 5000  # lines up to which their hashes stand in the plan


def _key(line: Column) -> Column:
    """128 bits of a line's trimmed text."""
    text = F.btrim(line, F.lit(BLANK))
    return F.struct(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_words: int) -> DataFrame:
    """Distinct lines of each row with min_words words or more: doc_id, text_key, site, k1, k2."""
    pieces = F.array_distinct(F.split(F.col(text_col), "\n"))
    long = F.filter(pieces, lambda x: _is_long(x, min_words))
    key = F.xxhash64(F.col(text_col)).alias("text_key")
    rows = docs.select(F.col(id_col).alias("doc_id"), key, F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.explode(long).alias("line"))
    return rows.select("doc_id", "text_key", "site", _key(F.col("line")).alias("k")).select("doc_id", "text_key", "site", "k.k1", "k.k2")


def boilerplate_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """k1, k2 of lines on min_sites sites or more, from rows (k1, k2, site)."""
    sketches = lines.groupBy("k1", "k2").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.count("*").alias("rows"))
    spread = sketches.where(F.col("rows") >= min_sites).select("k1", "k2", F.hll_sketch_estimate("sketch").alias("sites"))
    slack = max(2, int(min_sites * 5 * 1.04 / 2 ** (LG_K / 2)) + 1)
    spread = materialize(spread.where(F.col("sites") >= min_sites - slack))
    near = spread.where(F.col("sites") <= min_sites + slack).select("k1", "k2")
    exact = lines.join(near, ["k1", "k2"], "left_semi").select("k1", "k2", "site").distinct().groupBy("k1", "k2").agg(F.count("*").alias("sites"))
    return spread.where(F.col("sites") > min_sites + slack).select("k1", "k2").union(exact.where(F.col("sites") >= min_sites).select("k1", "k2"))


def _is_long(line: Column, min_words: int) -> Column:
    return F.size(F.split(F.btrim(line, F.lit(BLANK)), "[ \t\r]+")) >= min_words


def _kept_by_plan(rows: DataFrame, common: DataFrame, min_words: int) -> DataFrame:
    """rows (text) with kept, the lines that stay; the few lines that go are literals."""
    split = F.split("text", "\n")
    keys = common.collect()  # FEW rows at most
    first, second = ([r[k] for r in keys] for k in ("k1", "k2"))
    if not keys:
        return rows.withColumn("kept", split)
    gone = lambda x: _key(x)["k1"].isin(first) & _key(x)["k2"].isin(second) & _is_long(x, min_words)
    return rows.withColumn("kept", F.filter(split, lambda x: ~gone(x)))


def _kept_by_join(rows: DataFrame, lines: DataFrame, common: DataFrame, min_words: int) -> DataFrame:
    """rows (id, text) with kept; each document meets those of its own lines that go. Those without an id meet all of theirs, so they have a key of their text."""
    drop = lines.join(common, ["k1", "k2"]).groupBy(F.struct("doc_id", "text_key").alias("of")).agg(F.collect_set(F.struct("k1", "k2")).alias("keys"))
    with_keys = rows.join(drop, F.struct(F.col("id").alias("doc_id"), F.xxhash64("text").alias("text_key")) == F.col("of"), "left")
    split = F.split("text", "\n")
    kept = F.filter(split, lambda x: ~_is_long(x, min_words) | ~F.array_contains(F.col("keys"), _key(x)))
    return with_keys.withColumn("kept", F.when(F.col("keys").isNull(), split).otherwise(kept))


def _cut_rows(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_sites: int, min_words: int, few: int) -> DataFrame:
    """row (all columns of docs), text, and kept, the lines of the text that stay."""
    lines = _lines(docs, id_col, text_col, site_col, min_words)
    common = materialize(boilerplate_lines(lines, min_sites).distinct())
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return _kept_by_plan(rows, common, min_words) if common.count() <= few else _kept_by_join(rows, lines, common, min_words)


def without_boilerplate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10, min_words: int = 3, few: int = FEW) -> DataFrame:
    """docs, its columns and no others, with text_col without boilerplate lines: see remove_boilerplate. No column of docs can have a name that clashes."""
    cut = _cut_rows(docs, id_col, text_col, site_col, min_sites, min_words, few)
    return cut.select(*(F.array_join("kept", "\n").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def remove_boilerplate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10, min_words: int = 3, few: int = FEW, stats_col: str = "line_stats") -> DataFrame:
    """docs with text_col without lines that stand on min_sites sites or more, and stats_col (struct: lines, removed); an error if docs has a column of that name.

    A line is what stands between line feeds, compared without spaces, tabs and carriage returns at its ends; one of fewer
    than min_words words stays. A null text stays null (no lines); a null site is a site of its own. All rows stay, also
    those left empty and those without an id; rows that repeat an id lose what they have of the lines. Order and repeats of the lines that stay are
    kept. All columns of docs stay. few: lines up to which they are literals of the plan; the rows are the same beyond.
    """
    if stats_col.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs has a column {stats_col} already: name another in stats_col")
    cut = _cut_rows(docs, id_col, text_col, site_col, min_sites, min_words, few)
    split = F.split("text", "\n")
    stats = F.struct(F.coalesce(F.size(split), F.lit(0)).cast("long").alias("lines"), F.coalesce(F.size(split) - F.size("kept"), F.lit(0)).cast("long").alias("removed"))
    none = F.struct(F.lit(0).cast("long").alias("lines"), F.lit(0).cast("long").alias("removed"))
    columns = [F.array_join("kept", "\n").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return cut.select(*columns, F.when(F.col("text").isNull(), none).otherwise(stats).alias(stats_col))


def op3_line_dedup(docs: DataFrame) -> DataFrame:
    """Per document: its lines, how many went, and the text that is left, as length and hash."""
    clean = remove_boilerplate(docs.select("doc_id", "text", "source"))
    return clean.select("doc_id", F.col("line_stats.lines").alias("n_lines"), F.col("line_stats.removed").alias("n_removed"), F.length("text").cast("long").alias("kept_chars"), F.md5(F.encode("text", "UTF-8")).alias("kept_md5"))


OP3_SQL = """
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS site, pos, line, trim(line, ' ' || chr(9) || chr(13)) AS text_of,
    len(regexp_split_to_array(trim(line, ' ' || chr(9) || chr(13)), '[ ' || chr(9) || chr(13) || ']+')) >= 3 AS long
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
), common AS (SELECT text_of FROM lines WHERE long GROUP BY text_of HAVING count(DISTINCT site) >= 10)
, marked AS (SELECT l.*, c.text_of IS NOT NULL AND l.long AS gone FROM lines l LEFT JOIN common c USING (text_of))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
  length(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_chars,
  md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_md5
FROM marked GROUP BY doc_id
"""
