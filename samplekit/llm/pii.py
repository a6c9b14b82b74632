"""Personal data: fixed patterns, then terms that reveal the entities found, with DataFrame functions only.

The patterns give the protected entities (an address, a number). How strongly a term reveals an entity is
estimated from the corpus: the information that the term carries about the entity is their pointwise mutual
information over documents, log2 p(t, e) / (p(t) p(e)), and the share of the entity's own information -log2 p(e)
that it makes up is the disclosure. Terms beyond the disclosure limit, seen beside the entity in enough different
lines, are found wherever they occur; generalise puts the kind of what was found in its place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplekit.llm.common import materialize

#: The kinds in the order in which they are listed, what must occur in a text for a match, and the
#: pattern. Repeats are possessive where nothing that follows could take a character back; the matches are the same.
KINDS: tuple[tuple[str, str, str], ...] = (
    ("email", "@", r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", ".", r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", "", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
#: Terms are what stands between white space and ASCII punctuation.
SEPARATOR = r"[\x20\x09-\x0D\p{Punct}]"
FEW_TERMS = 100_000  # up to which terms are broadcast
SKETCH, NEAR = 32, 0.6  # hashes that stand for a line's terms; share of common terms from which a line is a near copy
PART_LINES = 1000  # lines of an entity that one part compares, and parts that a larger one unites
MATCH = "struct<start: bigint, stop: bigint, value: string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the sum over the digits, every second one from the right doubled, ends in 0."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    digits = _digits(value)
    if kind == "card":
        return F.length(digits).between(16, 19) & F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _matches(text: Column, pattern: Column) -> Column:
    """All leftmost matches that don't overlap, as MATCH, in code points. What stands between them gives their places."""
    between = F.transform(F.split(text, pattern, -1), F.length)
    values = F.regexp_extract_all(text, pattern, F.lit(0))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{MATCH}>").alias("out"))

    def step(state: Column, pair: Column) -> Column:
        low = state["at"] + pair["gap"]
        high = low + F.length(pair["value"])
        return F.struct(high.cast("bigint").alias("at"), F.concat(state["out"], F.array(F.struct(low.cast("bigint").alias("start"), high.cast("bigint").alias("stop"), pair["value"].alias("value")))).alias("out"))

    pairs = F.transform(values, lambda v, i: F.struct(v.alias("value"), F.get(between, i).alias("gap")))
    return F.aggregate(pairs, start, step, lambda s: s["out"])


def base_spans(text: Column, kind: str) -> Column:
    """Valid matches of a kind, as array<MATCH>; empty for a null text."""
    _, needs, pattern = next(k for k in KINDS if k[0] == kind)
    none = F.array().cast(f"array<{MATCH}>")
    likely = F.contains(text, F.lit(needs)) if needs else text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")
    if kind == "ip":
        likely = likely & text.rlike(pattern)
    return F.when(likely, F.filter(_matches(text, F.lit(pattern)), lambda m: _valid(kind, m["value"]))).otherwise(none)


def _of_kind(kind: str) -> Column:
    return F.transform(kind, lambda m: F.struct(F.lit(kind).alias("kind"), m["value"].alias("value")))


def _terms(text: Column) -> Column:
    return F.split(text, f"{SEPARATOR}+")


def revealing_terms(found: DataFrame, docs: DataFrame, total: int, *, least_lines: int, disclosure: float, term_chars: int) -> DataFrame:
    """term, kind: terms that reveal an entity of that kind beyond the limit.

    found: doc_id, text, entities (array of kind and value) of documents with entities; docs: doc_id, text of all `total`
    documents. Of the lines that a term and an entity share, one counts if it is no near copy of one that counted, by their terms
    without the term and without those of the entity. Probabilities are shares of all documents.
    """
    line = found.select("doc_id", "entities", F.explode(F.split("text", "\n")).alias("line"))
    beside = line.select("doc_id", "line", F.explode("entities").alias("e")).where(F.contains(F.col("line"), F.col("e.value")))
    often = materialize(beside.groupBy("e").agg(F.count("*").alias("n")).where(F.col("n") >= least_lines))  # no term of another is in enough lines
    beside = beside.join(F.broadcast(often) if often.count() <= FEW_TERMS else often, "e")
    part = F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("line"))), 1 + F.floor(F.col("n") / PART_LINES))
    upper = F.pmod(F.xxhash64("part"), 1 + F.floor(F.col("n") / PART_LINES**2))
    terms = beside.select("doc_id", "e", part.alias("part"), "n", _terms(F.col("line")).alias("terms"))
    terms = terms.select("doc_id", "e", "part", upper.alias("upper"), F.slice(_sketch("terms", _terms(F.col("e.value"))), 1, SKETCH + 1).alias("sketch"), F.explode("terms").alias("term"))
    terms = terms.where((F.length("term") >= term_chars) & ~F.col("term").rlike("[0-9]") & ~F.contains(F.col("e.value"), F.col("term")))
    terms = terms.withColumn("sketch", F.slice(F.array_remove("sketch", F.xxhash64("term")), 1, SKETCH))
    # What a part hands on is bounded: least_lines sketches, and numbers.
    parts = terms.groupBy("e", "term", "upper", "part").agg(_different(F.collect_set("sketch"), least_lines).alias("own"), F.size(F.collect_set("doc_id")).alias("ids"), F.max(F.col("doc_id").isNull().cast("int")).alias("no_id"))
    for keys in (["e", "term", "upper"], ["e", "term"]):
        parts = parts.groupBy(*keys).agg(_different(F.flatten(F.collect_list("own")), least_lines).alias("own"), F.sum("ids").alias("ids"), F.max("no_id").alias("no_id"))
    pairs = parts.where(F.size("own") >= least_lines).withColumn("both", F.col("ids") + F.col("no_id"))
    pairs = materialize(pairs.select(F.col("e.kind").alias("kind"), F.col("e.value").alias("value"), "term", "both"))
    words = docs.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    wanted = materialize(pairs.select("term").distinct())
    if wanted.count() <= FEW_TERMS:
        of_term = words.join(F.broadcast(wanted), "term").groupBy("term").agg(F.count("*").alias("with_term"))
    else:  # counted before the join, so that no task gets all rows of a common word
        of_term = words.groupBy("term").agg(F.count("*").alias("with_term")).join(wanted, "term", "left_semi")
    of_entity = found.select("doc_id", F.explode("entities").alias("e")).groupBy(F.col("e.kind").alias("kind"), F.col("e.value").alias("value")).agg(F.count("*").alias("with_entity"))
    told = pairs.join(of_entity, ["kind", "value"]).join(of_term, "term")
    pmi = F.log2(F.col("both") * F.lit(float(total)) / (F.col("with_entity") * F.col("with_term")))
    own = F.log2(F.lit(float(total)) / F.col("with_entity"))
    return told.where((own > 0) & (pmi >= own * disclosure)).groupBy("term").agg(F.min("kind").alias("kind"))


def _sketch(terms: str, without: Column) -> Column:
    """Hashes of the distinct terms but those in `without`, ascending."""
    return F.sort_array(F.transform(F.array_except(F.col(terms), F.concat(without, F.array(F.lit("")))), lambda t: F.xxhash64(t)))


def _near(a: Column, b: Column) -> Column:
    """Whether two lines share NEAR of the terms of both: exactly up to SKETCH terms, and estimated by the least SKETCH hashes beyond."""
    least = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(F.array_intersect(least, a), b)) >= F.size(least) * NEAR


def _different(sketches: Column, most: int) -> Column:
    """Those, in ascending order, that are no near copies of earlier ones; no more than `most`, the number that decides."""
    none = F.array().cast("array<array<bigint>>")
    return F.aggregate(F.sort_array(sketches), none, lambda own, s: F.when((F.size(own) >= most) | F.exists(own, lambda o: _near(o, s)), own).otherwise(F.concat(own, F.array(s))))


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_lines: int = 3, disclosure: float = 0.8, term_chars: int = 4) -> DataFrame:
    """Per row of docs: doc_id, key (xxhash64 of the text), email, ip, card, phone (arrays of start, stop, value), terms (array of start, stop, value, kind).

    Places are in code points, ends exclusive. Null and empty texts have none; a null id stays null; repeated rows each give
    a row; an empty table gives none. Other columns aren't read. least_lines: different lines, near copies counted once, in which a term
    must stand beside an entity; disclosure: share of the entity's information that it must give away; term_chars: characters that a term has at
    least. A term with a digit is none. Where terms tie on a place the longer match isn't sought: the leftmost that the pattern finds stands.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kinds = [k for k, _, _ in KINDS]
    some = reduce(lambda a, b: a | b, (F.size(k) > 0 for k in kinds))
    matched = own.select("doc_id", F.xxhash64("text").alias("key"), "text", *(base_spans(F.col("text"), k).alias(k) for k in kinds))
    base = materialize(matched.select("doc_id", "key", *kinds, F.when(some, F.col("text")).alias("text")))
    entities = F.array_distinct(F.flatten(F.array(*(_of_kind(k) for k in kinds))))
    found = base.where("text is not null").select("doc_id", "text", entities.alias("entities"))
    telling = materialize(revealing_terms(found, own, base.count(), least_lines=least_lines, disclosure=disclosure, term_chars=term_chars))
    seen = own.select("doc_id", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).join(telling, "term")
    per_doc = seen.groupBy("doc_id").agg(F.map_from_entries(F.collect_set(F.struct("term", "kind"))).alias("told")).withColumnRenamed("doc_id", "told_id")
    told = own.join(per_doc, F.col("doc_id").eqNullSafe(F.col("told_id")))
    pattern = F.concat(F.lit(f"(?<=^|{SEPARATOR})(?:"), F.array_join(F.map_keys("told"), "|"), F.lit(f")(?=$|{SEPARATOR})"))  # terms hold no character that patterns use
    terms = F.transform(
        _matches(F.col("text"), pattern),
        lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), m["value"].alias("value"), F.try_element_at("told", m["value"]).alias("kind")),
    )
    told = told.select("told_id", F.xxhash64("text").alias("told_key"), terms.alias("terms")).dropDuplicates(["told_id", "told_key"])
    both = base.drop("text").join(told, F.col("doc_id").eqNullSafe(F.col("told_id")) & (F.col("key") == F.col("told_key")), "left")
    return both.select("doc_id", "key", *kinds, F.coalesce("terms", F.array().cast("array<struct<start: bigint, stop: bigint, value: string, kind: string>>")).alias("terms"))


def _ends(kind: str) -> Column:
    return F.transform(kind, lambda m: F.struct(m["start"].alias("start"), (-m["stop"]).alias("end"), F.lit(kind).alias("kind")))


def generalise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """docs with what was found replaced in text_col by its kind in brackets, "[email]"; a term by that of the entity that it reveals. how: see find_personal_data.

    Of spans that overlap the earlier one counts, of those that begin together the longer. A null text stays null; all rows and columns of docs stay, those
    of an empty table none.
    """
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("own_key"))
    found = find_personal_data(own.select(F.col("id").alias("doc_id"), "text"), **how)  # type: ignore[arg-type]
    spans = [_ends(k) for k, _, _ in KINDS]
    spans.append(F.transform("terms", lambda m: F.struct(m["start"].alias("start"), (-m["stop"]).alias("end"), m["kind"].alias("kind"))))
    listed = found.select("doc_id", "key", F.array_sort(F.concat(*spans)).alias("spans")).where(F.size("spans") > 0)
    rows = own.join(listed.dropDuplicates(["doc_id", "key"]), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("key")), "left")
    text = F.col("text")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        between = F.substr(text, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        further = F.struct((-span["end"]).alias("at"), F.concat(state["out"], between, F.lit("["), span["kind"], F.lit("]")).alias("out"))
        return F.when(span["start"] >= state["at"], further).otherwise(state)

    done = F.aggregate("spans", start, step)
    clean = F.concat(done["out"], F.substr(text, (done["at"] + 1).cast("int")))
    cleaned = F.when(F.col("spans").isNull(), text).otherwise(clean)
    return rows.select(*(cleaned.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def _listed(kind: Column, spans: str) -> Column:
    return F.transform(spans, lambda m: F.concat_ws(":", kind, m["start"].cast("string"), m["stop"].cast("string")))


def op6_pii(docs: DataFrame) -> DataFrame:
    """Per row of docs the contract's columns. Odd rows are those of find_personal_data: each row gives one, without spans 0 and the hash of nothing."""
    found = find_personal_data(docs)
    kinds = [k for k, _, _ in KINDS]
    base = F.flatten(F.array(*(_listed(F.lit(k), k) for k in kinds)))
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in kinds), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, _listed(F.lit("term"), "terms")), ",").alias("spans"))
