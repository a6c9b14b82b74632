"""Queries of per-row features and pixel jobs, with SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from samplekit.operators import features, images
from samplekit.plans import bindings as b

#: Reflect-101 neighbours in 8 x 8 pixels: p(i, j) with rows and columns mirrored at the border.
_P = "pixels[1 + 8 * (7 - abs(7 - abs(y + {dy}))) + (7 - abs(7 - abs(x + {dx})))]"


def _p(dy: int, dx: int) -> str:
    return _P.format(dy=dy, dx=dx)


_LAP = f"{_p(-1, 0)} + {_p(1, 0)} + {_p(0, -1)} + {_p(0, 1)} - 4 * {_p(0, 0)}"
_GX = f"{_p(-1, 1)} - {_p(-1, -1)} + 2 * ({_p(0, 1)} - {_p(0, -1)}) + {_p(1, 1)} - {_p(1, -1)}"
_GY = f"{_p(1, -1)} - {_p(-1, -1)} + 2 * ({_p(1, 0)} - {_p(-1, 0)}) + {_p(1, 1)} - {_p(-1, 1)}"
#: Rows and columns of the images, to meet each of them.
_PIXELS = "cross join (select unnest(range(8))::int as y) cross join (select unnest(range(8))::int as x)"


def _quality_sql(table: str, out: str) -> str:
    """Common table expressions: the measures of the images of a table, and the composite score with its gate."""
    return f""", {out}_cells as (select sample_id, {_p(0, 0)} as v, {_LAP} as l, {_GX} as gx, {_GY} as gy from {table} {_PIXELS})
, {out}_sums as (
  select sample_id, var_pop(l) as lap, avg(sqrt(gx * gx + gy * gy)) as grad, var_pop(gx * gx + gy * gy) as energy,
    stddev_pop(v) as contrast, avg(v) as mean_brightness
  from {out}_cells group by sample_id)
, {out}_measures as (
  select sample_id, 0.7::double * lap + 0.3::double * grad as sharpness, contrast, mean_brightness,
    (0.6::double * lap + 0.4::double * energy) / 1000 as blur_score
  from {out}_sums)
, {out} as (
  select *, 0.35::double * least(sharpness / 100, 1) + 0.25::double * least(contrast / 50, 1)
      + 0.20::double * (1 - abs(mean_brightness - 128) / 128) + 0.20::double * least(blur_score / 100, 1) as composite_score
  from {out}_measures)"""


QUALITY = b.IMAGES + _quality_sql("images", "q")
GAMMA = """, brighter as (
  select sample_id, list_transform(pixels, lambda x: least(255.0::double, round_even(abs(floor(pow(x / 255, 1 / 1.2::double) * 255) * 1.1::double + 5), 0))) as pixels
  from images)"""
#: Images of 1.5 times the pixel less half of its Gaussian mean over 13 x 13 neighbours, sigma 2.
ENHANCED = GAMMA + f"""
, line as (select unnest(range(-6, 7))::int as d), weights as (select d, exp(-(d * d)::double / 8) / (select sum(exp(-(d * d)::double / 8)) from line) as w from line)
, across as (select sample_id, y, x, sum(h.w * {_P.format(dy="0", dx="h.d")}) as v from brighter {_PIXELS} cross join weights h group by sample_id, y, x)
, rows_of as (select sample_id, list(v order by y, x) as pixels from across group by sample_id)
, blurred as (select sample_id, y, x, sum(h.w * {_P.format(dy="h.d", dx="0")}) as v from rows_of {_PIXELS} cross join weights h group by sample_id, y, x)
, sharper as (
  select b.sample_id, b.y, b.x, least(255, greatest(0, round_even(1.5::double * g.pixels[1 + 8 * b.y + b.x] - 0.5::double * b.v, 0))) as v
  from blurred b join brighter g using (sample_id))
, enhanced as (select sample_id, list(v order by y, x) as pixels from sharper group by sample_id)"""
_SHARP = f"least(255, greatest(0, round_even(3.0::double * {_p(0, 0)} - 0.6::double * ({_p(-1, 0)} + {_p(1, 0)} + {_p(0, -1)} + {_p(0, 1)}), 0)))"
FRAME = b.IMAGES + f"""
, sharper as (select sample_id, y, x, least(255, greatest(0, round_even(0.7::double * {_p(0, 0)} + 0.3::double * {_SHARP}, 0))) as v from images {_PIXELS})
, enhanced as (select sample_id, list(v order by y, x) as pixels from sharper group by sample_id)"""
AS_TEXT = " select sample_id, list_aggregate(list_transform(pixels, lambda v: v::int::varchar), 'string_agg', ',') as pixels from enhanced"
RESIZED = b.IMAGES + """
, kernel as (select d, k, greatest(0, least(7, 2 * d + k - 3)) as s, 3.5::double - k as t from (select unnest(range(4))::int as d) cross join (select unnest(range(8))::int as k))
, taps as (select d, s, sum(sin(pi() * t) * sin(pi() * t / 4) / (t * t)) / any_value(total) as w from kernel join (select d, sum(sin(pi() * t) * sin(pi() * t / 4) / (t * t)) as total from kernel group by d) using (d) group by d, s)
, cells as (select sample_id, y.d as y, x.d as x, greatest(0, least(255, round_even(sum(y.w * x.w * pixels[y.s * 8 + x.s + 1]), 0))) as v from images cross join taps y cross join taps x group by 1, 2, 3)
 select sample_id, list_aggregate(list(v::int::varchar order by y, x), 'string_agg', ',') as pixels from cells group by sample_id"""
TURNED = b.IMAGES + """
, cells as (select sample_id, y, x, case sample_id % 5 when 0 then pixels[x * 8 + 8 - y] when 1 then pixels[y * 8 + 8 - x] when 2 then pixels[x * 8 + y + 1]
    when 3 then greatest(0, least(255, round_even(1.2::double * pixels[y * 8 + x + 1] + 28.05::double, 0))) else pixels[y * 8 + x + 1] end as v
  from images cross join (select unnest(range(8))::int as y) cross join (select unnest(range(8))::int as x))
 select sample_id, list_aggregate(list(v::int::varchar order by y, x), 'string_agg', ',') as pixels, any_value(['rotate90 true', 'flip true', 'transpose true', 'brightness_contrast true', 'image_compression false'][sample_id % 5 + 1]) as steps
 from cells group by sample_id"""
GATE = "composite_score >= 0.6::double and mean_brightness between 40 and 220 and blur_score > 80 and contrast > 15"
TWO_STAGE = QUALITY + ENHANCED + _quality_sql("enhanced", "r") + f"""
 select q.sample_id, round(q.composite_score, 6) as composite_score, round(r.composite_score, 6) as final_composite, round(r.contrast, 4) as final_contrast
 from (select * from q where {GATE}) q join (select * from r where {GATE}) r using (sample_id)"""
_MEMBER_ENDS = ", ".join(f"'{end}_{v}': {{}}" for v in images.VALUES for end in ("low", "high"))


def _member_sql(name: str, ranges: tuple[tuple[float, float], ...]) -> str:
    ends = [str(float(x)) for pair in ranges for x in pair] + ["null"] * 2 * (len(images.VALUES) - len(ranges))
    return f"{{'name': '{name}', " + _MEMBER_ENDS.format(*(f"{x}::double" for x in ends)) + "}"


def _entry_sql(step: int, p: float, members: tuple) -> str:
    return f"{{'step': {step}, 'p': {p}, 'members': [{', '.join(_member_sql(*m) for m in members)}]}}"


PLAN = "unnest([" + ", ".join(_entry_sql(i, p, m) for i, (p, m) in enumerate(images.PLANS["medium"])) + "])"


def _u(seed: int) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', cast(sample_id as varchar), cast(epoch as varchar), cast(s.step as varchar))), 1, 8))::bigint::double / 4294967296)"


PLANNED = b.SAMPLES + f"""
, steps as (select {PLAN} as s), e as (select sample_id, epoch, s from samples cross join (select unnest([0, 1]) as epoch) cross join steps)
, t as (select *, s.members[1 + floor({_u(43)} * len(s.members))::int] as m from e where {_u(42)} < s.p)
 select sample_id, epoch, s.step as step, m.name as transform, """ + ", ".join(
    f"round(m.low_{v} + {_u(44 + i)} * (m.high_{v} - m.low_{v}), 5) as {v}" for i, v in enumerate(images.VALUES)
) + " from t"


def _planned(spark, d):  # noqa: ANN001, ANN202
    return images.augmentation_plan(b.samples(spark, d), "medium", 2).withColumns({v: F.round(v, 5) for v in images.VALUES})


def _text(column: str, form: str = "int"):  # noqa: ANN202
    return F.array_join(F.transform(column, lambda x: x.cast(form).cast("string")), ",").alias("pixels")


def _turned(spark, d):  # noqa: ANN001, ANN202
    """One transform for each sample, by its number."""
    kind = F.element_at(F.array(*(F.struct(F.lit(n).alias("transform"), F.lit(v).cast("double").alias("value"), F.lit(w).cast("double").alias("second")) for n, v, w in (("rotate90", 1, None), ("flip", 1, None), ("transpose", None, None), ("brightness_contrast", 0.11, 0.2), ("image_compression", 80, None)))), (F.col("sample_id") % 5 + 1).cast("int"))
    plan = b.images(spark, d).select("sample_id", F.lit(0).alias("epoch"), F.lit(0).alias("step"), kind.alias("k")).select("sample_id", "epoch", "step", "k.*", F.lit(None).cast("double").alias("third"))
    done = images.apply_augmentation(b.images(spark, d), plan)
    return done.select("sample_id", _text("pixels"), F.array_join(F.transform("steps", lambda s: F.concat_ws(" ", s["transform"], s["applied"].cast("string"))), ",").alias("steps"))


def _gray(spark, d):  # noqa: ANN001, ANN202
    """Each run of three pixels taken as one colour."""
    runs = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct(*(F.get("pixels", i * 3 + k).alias(c) for k, c in enumerate("rgb"))))
    colours = b.images(spark, d).select("sample_id", F.posexplode(runs).alias("place", "c")).select("sample_id", "place", "c.*")
    return colours.select("sample_id", "place", features.gray().alias("gray"))


GRAY = b.IMAGES + """, runs as (select sample_id, pixels, unnest(range(21)) as place from images)
 select sample_id, place::int as place,
  floor(pixels[1 + 3 * place] * 0.299::double + pixels[2 + 3 * place] * 0.587::double + pixels[3 + 3 * place] * 0.114::double + 0.5::double)::bigint as gray from runs"""
FIGURES = {
    "global": "(v - avg(v) over ()) / nullif(stddev_pop(v) over (), 0)", "standardize": "(v - avg(v) over (partition by place)) / nullif(stddev_pop(v) over (partition by place), 0)",
    "min_max": "(v - min(v) over (partition by place)) / nullif(max(v) over (partition by place) - min(v) over (partition by place), 0)",
}
NORMALISED = b.IMAGES + ", m as (select sample_id, unnest(range(64))::int as place, unnest(pixels) as v from images) select sample_id, place, round(coalesce({w}, 0), 6) as value from m"
STANDARDISED = b.IMAGES + """, m as (select sample_id, pixels, list_avg(pixels) as mean, nullif(list_stddev_pop(pixels), 0) as dev from images)
 select sample_id, place::int as place, round(coalesce((pixels[1 + place] - mean) / dev, 0), 6) as value from (select *, unnest(range(64)) as place from m)"""


def _standardised(spark, d):  # noqa: ANN001, ANN202
    return b.images(spark, d).select("sample_id", F.posexplode(features.standardised("pixels")).alias("place", "value")).withColumn("value", F.round("value", 6))


QUERIES = {
    "b02_b05_pixel_quality": (
        lambda spark, d: images.with_quality(b.images(spark, d)).select("sample_id", *(F.round(c, 3).alias(c) for c in ("sharpness", "contrast", "mean_brightness", "blur_score"))),
        QUALITY + " select sample_id, " + ", ".join(f"round({c}, 3) as {c}" for c in images.MEASURES) + " from q",
    ),
    "b01_gray": (_gray, GRAY),
    "b03_contrast": (
        lambda spark, d: b.images(spark, d).select("sample_id", F.round(features.contrast_of("pixels"), 6).alias("contrast"), F.round(features.mean_of("pixels"), 6).alias("mean")),
        b.IMAGES + " select sample_id, round(list_stddev_pop(pixels), 6) as contrast, round(list_avg(pixels), 6) as mean from images",
    ),
    "b08_two_stage_gate": (lambda spark, d: _two_stage(spark, d), TWO_STAGE),
    "b10_enhance_images": (
        lambda spark, d: images.enhance_images(b.images(spark, d)).select("sample_id", _text("pixels")),
        b.IMAGES + ENHANCED + AS_TEXT,
    ),
    "b10_gamma_scale": (
        lambda spark, d: b.images(spark, d).withColumn("pixels", features.gamma_corrected("pixels")).select("sample_id", F.array_join(F.transform(features.scaled("pixels"), lambda x: x.cast("int").cast("string")), ",").alias("pixels")),
        b.IMAGES + " select sample_id, list_aggregate(list_transform(pixels, lambda x: least(255.0::double, round_even(abs(floor(pow(x / 255, 1 / 1.2::double) * 255) * 1.1::double + 5), 0))::int::varchar), 'string_agg', ',') as pixels from images",
    ),
    "b11_frame_sharpen": (
        lambda spark, d: images.enhance_images(b.images(spark, d), ("frame_sharpen",)).select("sample_id", _text("pixels")),
        FRAME + AS_TEXT,
    ),
    "b12_resize": (
        lambda spark, d: images.resize_images(b.images(spark, d), 4, 4).select("sample_id", _text("pixels")),
        RESIZED,
    ),
    "b13_b14_ranges": (
        lambda spark, d: b.images(spark, d).withColumn("unit", features.unit_range("pixels")).select("sample_id", *(F.round(features.mean_of(c), 6).alias(n) for c, n in (("unit", "unit_mean"), (features.signed_range("unit"), "signed_mean")))),
        b.IMAGES + " select sample_id, round(list_avg(list_transform(pixels, lambda x: x / 255)), 6) as unit_mean, round(list_avg(list_transform(pixels, lambda x: (x / 255 - 0.5::double) * 2)), 6) as signed_mean from images",
    ),
    "b15_one_hot": (
        lambda spark, d: spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", features.one_hot("label", 10).alias("h")).select("vec_id", F.array_join(F.transform("h", lambda x: x.cast("int").cast("string")), "").alias("one_hot"), features.argmax("h").alias("decoded")),
        "select vec_id, list_aggregate(list_transform(range(10), lambda i: case when i = label then '1' else '0' end), 'string_agg', '') as one_hot, label::int as decoded from embeddings",
    ),
    "b18_byte_range": (
        lambda spark, d: b.images(spark, d).withColumn("pixels", F.when(F.col("sample_id") % 2 == 0, features.unit_range("pixels")).otherwise(F.col("pixels"))).select("sample_id", F.round(features.mean_of(features.byte_range("pixels")), 6).alias("mean")),
        b.IMAGES + " select sample_id, round(list_avg(pixels), 6) as mean from images",
    ),
    "b21_augmentation_plan": (_planned, PLANNED),
    "b22_planned_transforms": (_turned, TURNED),
    "b22_apply_augmentation": (
        lambda spark, d: images.apply_augmentation(b.images(spark, d), images.augmentation_plan(b.images(spark, d), "heavy", 2), 2),
        None,
    ),
    "b23_cast_float": (
        lambda spark, d: b.images(spark, d).select("sample_id", F.col("pixels").cast("array<float>").alias("pixels")).select("sample_id", F.round(F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x), 3).alias("total")),
        b.IMAGES + " select sample_id, round(list_sum(list_transform(pixels, lambda x: x::float::double)), 3) as total from images",
    ),
    **{f"b13_normalise_{m}": ((lambda m: lambda spark, d: features.normalised(b.images(spark, d), m).select("sample_id", F.posexplode("pixels").alias("place", "value")).withColumn("value", F.round("value", 6)))(m), NORMALISED.format(w=w)) for m, w in FIGURES.items()},
    "x_standardise": (_standardised, STANDARDISED),
}


def _two_stage(spark, d):  # noqa: ANN001, ANN202
    raw = b.images(spark, d)
    before = features.with_composite(images.with_quality(raw))
    after = features.with_composite(images.with_quality(images.enhance_images(raw)))
    both = features.two_stage_gate(before, after, 0.6)
    rounded = [F.round(c, n).alias(k) for c, n, k in (("composite_score", 6, "composite_score"), ("final.composite_score", 6, "final_composite"), ("final.contrast", 4, "final_contrast"))]
    return both.select("sample_id", *rounded)
