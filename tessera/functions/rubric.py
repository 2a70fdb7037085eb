"""Ordered-category scores: stages, bands, cumulative probabilities, prediction sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The rubric and the stage of each of its scores.
RUBRIC = (0.0, 0.5, 1.0, 1.5, 2.0, 3.0)
STAGES = (0.0, 20.0, 40.0, 60.0, 80.0, 100.0)


def _doubles(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def nearest_score(x: Column) -> Column:
    """The rubric score nearest to x; of equally near ones the smaller."""
    return F.element_at(F.array_sort(F.transform(_doubles(RUBRIC), lambda s: F.struct(F.abs(x - s).alias("d"), s.alias("s")))), 1)["s"]


def stage_index(score: Column) -> Column:
    """Stage of a rubric score; null for others."""
    out = None
    for s, stage in zip(RUBRIC, STAGES, strict=True):
        out = F.when(score == s, F.lit(stage)) if out is None else out.when(score == s, F.lit(stage))
    return out




def three_band(score: Column) -> Column:
    return F.when(score < 1, "none_low").when(score < 2, "mild_mod").when(score.isNotNull(), "severe")


def four_band(score: Column) -> Column:
    return F.when(score < 0.5, "0").when(score < 1, "0.5").when(score < 2, "1_1.5").when(score.isNotNull(), "2_3")


def threshold_targets(score: Column) -> Column:
    """array<int>: whether the score exceeds each rubric score but the last."""
    return F.array(*((score > s).cast("int") for s in RUBRIC[:-1]))


def monotone(p: Column) -> Column:
    """Running minimum: cumulative probabilities that never rise."""
    start = F.array().cast("array<double>")
    return F.aggregate(p, start, lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(F.least(F.element_at(acc, -1), x)))))


def class_probabilities(p: Column) -> Column:
    """Probabilities of the classes from monotone cumulative ones."""
    above = F.concat(F.array(F.lit(1.0)), p)
    below = F.concat(p, F.array(F.lit(0.0)))
    return F.zip_with(above, below, lambda a, b: a - b)


def burden(p: Column) -> Column:
    """100 times the mean of the cumulative probabilities."""
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x) * 100 / F.size(p)


def prediction_set(q: Column, coverage: float) -> Column:
    """Indices of the likeliest classes until their probabilities reach `coverage`, ascending; ties to the smaller index."""
    ranked = F.array_sort(F.transform(q, lambda x, i: F.struct((-x).alias("n"), i.cast("int").alias("i"))))
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<int>").alias("set"))
    taken = F.aggregate(
        ranked, start,
        lambda acc, r: F.when(acc["sum"] >= coverage - 1e-12, acc).otherwise(F.struct((acc["sum"] - r["n"]).alias("sum"), F.concat(acc["set"], F.array(r["i"])).alias("set"))),
    )
    return F.array_sort(taken["set"])


def entropy(q: Column) -> Column:
    """Natural-log entropy; zero probabilities add nothing."""
    return F.aggregate(q, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log(x)).otherwise(0.0))


def top_two_margin(q: Column) -> Column:
    """Largest minus second largest."""
    ranked = F.sort_array(q, asc=False)
    return ranked[0] - ranked[1]


def box_iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes (x0, y0, x1, y1); 0 if neither has an area."""
    zero = F.lit(0.0)
    wide = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda r: F.greatest(zero, r[2] - r[0]) * F.greatest(zero, r[3] - r[1])
    union = area(a) + area(b) - wide * high
    return F.when(union > 0, wide * high / union).otherwise(zero)


def run_length_area(rle: Column) -> Column:
    """Sum of the counts whose value isn't zero, from value, count, value, count, ..."""
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.size(rle) / 2).cast("int") - 1)), lambda i: F.when(rle[2 * i] != 0, rle[2 * i + 1]).otherwise(0))
    return F.when(F.size(rle) >= 2, F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long"))


def interval_set(low: Column, high: Column) -> Column:
    """Rubric scores whose stage lies in [low, high]; if none does, the score of the stage nearest to the middle."""
    pairs = F.array(*(F.struct(F.lit(g).alias("stage"), F.lit(s).alias("score")) for s, g in zip(RUBRIC, STAGES, strict=True)))
    inside = F.transform(F.filter(pairs, lambda r: (r["stage"] >= low) & (r["stage"] <= high)), lambda r: r["score"])
    middle = (low + high) / 2
    near = F.element_at(F.array_sort(F.transform(pairs, lambda r: F.struct(F.abs(r["stage"] - middle).alias("d"), r["score"].alias("s")))), 1)["s"]
    return F.when(F.size(inside) > 0, inside).otherwise(F.array(near))


def conformity(q: Column, truth: Column) -> Column:
    """Sum of the class probabilities from the largest down to that of class number `truth`, at most 1."""
    own = F.element_at(q, truth + 1)
    above = F.aggregate(F.transform(q, lambda x, i: F.when((x > own) | ((x == own) & (i <= truth)), x).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    return F.least(F.lit(1.0), above)


def openness_grade(x: Column) -> Column:
    """0 for 0.6 or more, 1 for 0.4, 2 for 0.2, else 3."""
    return F.when(x >= 0.6, 0).when(x >= 0.4, 1).when(x >= 0.2, 2).otherwise(3)


def tile_starts(length: Column, tile: int, stride: int) -> Column:
    """Starts of tiles at each stride, and of one flush with the end."""
    end = F.greatest(F.lit(0), length - tile).cast("int")
    return F.array_sort(F.array_distinct(F.concat(F.sequence(F.lit(0), end, F.lit(stride)), F.array(end))))


def angle_from_top(dx: Column, dy: Column) -> Column:
    """Degrees in [0, 360), counter-clockwise from straight up; dy grows downwards."""
    return F.pmod(F.degrees(F.atan2(-dx, -dy)), F.lit(360.0))


def residual_set(stage: Column, residual: Column) -> Column:
    """Texts of the scores whose stage is within the residual, or of the nearest alone."""
    pairs = F.array(*(F.struct(F.lit(f"{s:g}").alias("score"), F.lit(v).alias("stage"), F.lit(s).alias("s")) for s, v in zip(RUBRIC, STAGES, strict=True)))
    near = F.filter(pairs, lambda x: F.abs(x["stage"] - stage) <= residual)
    nearest = F.array_sort(F.transform(pairs, lambda x: F.struct(F.abs(x["stage"] - stage).alias("d"), x["s"].alias("s"), x["score"].alias("score"))))[0]["score"]
    return F.when(F.size(near) > 0, F.transform(near, lambda x: x["score"])).otherwise(F.array(nearest))


def class_index(score: Column) -> Column:
    """Place of a rubric score from 0; null for others."""
    return F.nullif(F.array_position(_doubles(RUBRIC), score).cast("int") - 1, F.lit(-1))
