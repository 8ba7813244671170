"""File-name expressions: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE = r"(?i)\.(png|jpg|jpeg|bmp|tif|tiff)$"
MISSING = "NA"


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^./]*$", "")


def source_stem(name: Column) -> Column:
    """Image extension off, whatever its case, then a final _roi_<digits>."""
    return F.regexp_replace(F.regexp_replace(name, IMAGE, ""), r"_roi_[0-9]+$", "")


def roi_prefix(name: Column) -> Column:
    """What stands before the first _roi_; the whole name if there is none."""
    return F.substring_index(name, "_roi_", 1)


def metadata(name: Column) -> dict[str, Column]:
    """The six fields of `date-experiment-plate-magnification_well_roi_id.ext`, all NA unless the whole form is there."""
    stem = without_extension(name)
    head, object_id = F.regexp_extract(stem, r"^(.*)_roi_(.*)$", 1), F.regexp_extract(stem, r"^(.*)_roi_(.*)$", 2)
    left, well = F.regexp_extract(head, r"^(.*)_(.*)$", 1), F.regexp_extract(head, r"^(.*)_(.*)$", 2)
    parts = F.split(left, "-")
    good = (head != "") & (left != "") & (F.size(parts) == 4)
    field = lambda k: F.when(good, F.get(parts, k)).otherwise(MISSING)
    return {
        "date": field(0), "experiment": field(1), "plate": field(2), "magnification": field(3),
        "well": F.when(good, well).otherwise(MISSING), "object_id": F.when(good, object_id).otherwise(MISSING),
    }


def image_number(name: Column) -> Column:
    """Digits before _png, else before _jpg, _jpeg, _tif, in that order; null if none fits."""
    found = [F.regexp_extract(name, rf"([0-9]+)_{kind}", 1) for kind in ("png", "jpg", "jpeg", "tif")]
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in found))


def mapped_key(name: Column) -> Column:
    """Extension and _copy off, in lower case: the key of name-mapping tables."""
    return F.lower(F.regexp_replace(without_extension(name), r"_copy$", ""))


def species_key(name: Column) -> Column:
    """tif extension, ` copy` or `_copy`, and `_overlay` off, in lower case."""
    x = F.regexp_replace(F.lower(name), r"\.tiff?$", "")
    return F.regexp_replace(F.regexp_replace(x, r"[ _]copy$", ""), r"_overlay$", "")


def hosted_name(name: Column) -> Column:
    """`X_png.rf.<hash>.ext` back to `X.png`; other names stay."""
    return F.regexp_replace(name, r"^(.*)_(png|jpg|jpeg|tif)\.rf\.[^.]*\.[^.]*$", "$1.$2")


def as_tif(name: Column) -> Column:
    return F.concat(without_extension(name), F.lit(".tif"))


def well_name(index: Column) -> Column:
    """A01 to H12 of a 96-well plate by index 0 to 95."""
    row = F.substring(F.lit("ABCDEFGH"), F.floor(index / 12).cast("int") + 1, F.lit(1))
    return F.concat(row, F.lpad((index % 12 + 1).cast("string"), 2, "0"))


def synthesized(date: Column, experiment: Column, plate: Column, magnification: Column, well: Column, k: Column) -> Column:
    return F.concat(F.concat_ws("-", date, experiment, plate, magnification), F.lit("_"), well, F.lit("_roi_"), k.cast("string"), F.lit(".png"))


def restored(name: Column) -> Column:
    """A synthesized name back to `experiment/plate/well.tif`; null if it isn't one."""
    form = r"^([0-9]+)-([A-Za-z0-9]+)-([A-Za-z0-9]+)-([A-Za-z0-9]+)_([A-H][0-9]{2})"
    part = lambda k: F.regexp_extract(name, form, k)
    return F.when(name.rlike(form), F.concat(part(2), F.lit("/"), part(3), F.lit("/"), part(5), F.lit(".tif")))


def label_text(category: Column, drop: str = "worm") -> Column:
    """Underscores to spaces, the word `drop` off, the first letter raised."""
    words = F.filter(F.split(F.lower(category), "[_ ]"), lambda w: (w != drop) & (w != ""))
    text = F.array_join(words, " ")
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 20))


def folder_name(label: Column) -> Column:
    """Final dots and blanks go; other characters that folders shouldn't have become `_`."""
    return F.regexp_replace(F.regexp_replace(label, r"[. ]+$", ""), r'[<>:"/\\|?*\s]+', "_")


def augmented_name(stem: Column, suffix: Column, k: Column, extension: Column) -> Column:
    return F.concat(stem, suffix, F.lit("_"), k.cast("string"), extension)


def is_augmented(name: Column) -> Column:
    return without_extension(name).rlike(r"_aug_[0-9]{1,3}$")


def ranked_name(rank: Column, percent: Column, category: Column, file: Column) -> Column:
    sign = F.when(percent < 0, "neg").otherwise("pos")
    return F.format_string("rank%02d_abs%07.3fpct_%s_%s_%s", rank, F.abs(percent), sign, category, file)
