"""Column expressions on paths, file names and the identities that they tell."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import clean, slug

#: Treatment groups by the first letters of a sample and by name.
GROUPS_BY_PREFIX = {"M": "vehicle", "S": "sorafenib", "D": "sor_plus_dox", "L": "sor_plus_lis"}
GROUPS_BY_NAME = {"vehicle": "vehicle", "sorafenib": "sorafenib", "sor + dox": "sor_plus_dox", "sor and dox": "sor_plus_dox", "sor + lis": "sor_plus_lis", "sor and lis": "sor_plus_lis"}


def looked_up(c: Column, table: Mapping[str, str], otherwise: Column) -> Column:
    """The table's value for the text; `otherwise` for texts that it lacks."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[c], otherwise)


def treatment_group(sample: Column) -> Column:
    """By the sample's leading letters; empty for unknown ones."""
    text = F.upper(clean(sample))
    letters = F.regexp_extract(text, "^([A-Z]+)", 1)
    return looked_up(F.when(letters != "", letters).otherwise(text), GROUPS_BY_PREFIX, F.lit(""))


def group_name(c: Column) -> Column:
    """A group's canonical name: known spellings, else the slug; empty for a blank."""
    text = F.regexp_replace(F.replace(F.lower(clean(c)), F.lit("&"), F.lit("and")), r"\s+", " ")
    return looked_up(text, GROUPS_BY_NAME, F.when(text == "", "").otherwise(slug(text)))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_stem(path: Column) -> Column:
    """The file name without its last suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def folder_name(path: Column) -> Column:
    """Name of the folder that holds the file; empty without one."""
    return F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)


def relative_to(path: Column, root: str) -> Column:
    """The path below `root`; paths elsewhere as they are."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)


def resolved(path: Column, runtime: str, manifest: str) -> Column:
    """Absolute paths as they are, `raw_data/` ones below the runtime's root, others below the manifest's; empty for missing ones."""
    text = clean(path)
    return F.when((text == "") | (F.lower(text) == "nan"), "").when(text.startswith("/"), text).when(text.rlike("^raw_data(/|$)"), F.concat(F.lit(runtime + "/"), text)).otherwise(F.concat(F.lit(manifest + "/"), text))


def subject_of_path(path: Column) -> Column:
    """The folder, unless it is `images` or `masks`; else the stem without `_mask` and `_image<n>`."""
    folder, bare = folder_name(path), F.regexp_replace(file_stem(path), "_mask$", "")
    return F.when((folder != "") & ~folder.isin("images", "masks"), folder).otherwise(F.regexp_replace(bare, r"(?i)(?<=.)_image\d+$", ""))


def mask_identity(path: Column) -> Column:
    """subject_image_id of a mask (`<subject>-<n>_mask` or `<subject>_Image<n>_mask`, png or tif); null for others."""
    stem = file_stem(path)
    subject, number = F.regexp_extract(stem, r"^([A-Za-z0-9]+)(?:-|_Image)(\d+)_mask$", 1), F.regexp_extract(stem, r"^([A-Za-z0-9]+)(?:-|_Image)(\d+)_mask$", 2)
    fine = (subject != "") & path.rlike(r"(?i)\.(png|tif|tiff)$") & ~stem.rlike(r"-0\d*_mask$")
    return F.when(fine, F.concat(subject, F.lit("-"), number.cast("int").cast("string")))


def mask_file(subject_image_id: Column, suffix: Column) -> Column:
    return F.concat(subject_image_id, F.lit("_mask"), F.lower(suffix))


def token(c: Column, default: str = "unknown") -> Column:
    """Letters and digits in lower case with underscores between; `default` for nothing."""
    text = clean(c)
    out = F.lower(F.regexp_replace(F.regexp_replace(F.when((text == "") | (F.lower(text) == "nan"), default).otherwise(text), "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    return F.when(out == "", default).otherwise(out)


def subject_group(cohort: Column, sample: Column, path: Column) -> Column:
    """`cohort:subject`: the sample up to `_Image`, else the folder unless `images`, else the stem up to an underscore."""
    folder, own = folder_name(path), clean(sample)
    subject = F.when(own != "", F.substring_index(own, "_Image", 1)).when((folder != "") & (folder != "images"), folder).otherwise(F.substring_index(file_stem(path), "_", 1))
    return F.concat(F.when(clean(cohort) == "", "unknown_cohort").otherwise(cohort), F.lit(":"), subject)


def derived_identity(cohort: Column, sample: Column, date: Column, batch: Column, image: Column, path: Column) -> dict[str, Column]:
    """subject_id, sample_id, image_id from a manifest row that has none: `<subject>--<date>` samples carry their own date, else source date, batch or `undated`."""
    own = clean(sample)
    dated = r"(?i)^(.+?)--([0-9]{4}-[0-9]{2}-[0-9]{2})(?:_Image.*)?$"
    is_dated = own.rlike(dated)
    subject = F.when(is_dated, F.regexp_extract(own, dated, 1)).otherwise(F.substring_index(subject_group(F.lit("x"), sample, path), ":", -1))
    given = lambda c: (clean(c) != "") & (F.lower(clean(c)) != "nan")
    when = F.when(is_dated, F.regexp_extract(own, dated, 2)).when(given(date), clean(date)).when(given(batch), clean(batch)).otherwise("undated")
    subject_id = F.concat(token(cohort, "unknown_cohort"), F.lit("__"), token(subject))
    sample_id = F.concat(subject_id, F.lit("__"), token(when, "undated"))
    name = F.when(clean(image) != "", file_stem(clean(image))).otherwise(file_stem(path))
    return {"subject_id": subject_id, "sample_id": sample_id, "image_id": F.concat(sample_id, F.lit("__"), token(name))}


def strongest_id(*ids: Column) -> Column:
    """The first that isn't blank, or empty."""
    return F.coalesce(*(F.nullif(clean(c), F.lit("")) for c in ids), F.lit(""))


def crop_box(text: Column) -> Column:
    """A JSON list of numbers as whole numbers, `[1, 2]`; other texts trimmed."""
    numbers = F.from_json(F.trim(text), "array<double>")
    whole = F.concat(F.lit("["), F.array_join(F.transform(numbers, lambda x: x.cast("bigint").cast("string")), ", "), F.lit("]"))
    return F.when(F.trim(text).startswith("[") & numbers.isNotNull(), whole).otherwise(F.coalesce(F.trim(text), F.lit("")))


def whole_number(c: Column) -> Column:
    """A text's number cut to a whole one; null for others."""
    value = c.cast("string").try_cast("double")
    return F.when(~F.isnan(value), value.cast("bigint"))


def clipped(c: Column, bound: float = 20.0) -> Column:
    """Within the bound; NaN and null as 0, infinities at the bound."""
    return F.greatest(F.lit(-bound), F.least(F.lit(bound), F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))))


def openness_class(openness: Column) -> Column:
    return F.when(openness >= 0.7, "Normal").when(openness >= 0.5, "Mild Endotheliosis").when(openness >= 0.3, "Moderate Endotheliosis").when(openness >= 0.1, "Severe Endotheliosis").otherwise("Critical Endotheliosis")


def merged_box(a: Column, b: Column) -> Column:
    """Union of two structs x0, y0, x1, y1, area; areas add up."""
    return F.struct(
        F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"), (a["area"] + b["area"]).alias("area")
    )
