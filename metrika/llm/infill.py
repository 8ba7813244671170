"""Fill-in-middle transformation of whole texts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, whole_row

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
#: A unit is one code point, line ends included.
UNIT = "(?s)."


def hashes(id_col: Column, seed: str = "1") -> list[Column]:
    """h1 to h4: the first four 8-digit groups of the hex sha256 of `seed:` and the decimal id, as longs; a null id is empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def checked(*sentinels: str) -> None:
    """An error where an output could be parsed in two ways: an empty sentinel, or one that can overlap itself or another."""
    for i, x in enumerate(sentinels):
        for j, y in enumerate(sentinels):
            if not x or (i != j and x in y) or any(x[-k:] == y[:k] for k in range(1, min(len(x), len(y)))):
                raise ValueError(f"sentinels {x!r} and {y!r} can't be told apart")


def infill(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: str = PREFIX, suffix: str = SUFFIX, middle: str = MIDDLE,
    plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW, seed: str = "1",
) -> DataFrame:
    """docs with the columns _n, _form, _prefix_chars, _middle_chars and _output beside its own.

    A text is an array of its n code points. Its prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units, its
    middle after the larger; the suffix is the rest. _form is `plain` where the text is empty, holds one of the three
    sentinels or h3 % 100 >= plain_from; of the others, `spm` where h4 % 100 < spm_below, else `psm`. _output is the text
    (plain), `<P>`prefix`<S>`suffix`<M>`middle (psm) or `<S>`suffix`<P>`prefix`<M>`middle (spm); lengths are null in plain.

    The choice depends on the id alone, so a lost executor's rows come out the same again. Each row is worked on by itself:
    no shuffle, and equal or repeated rows give equal results. A null text counts as empty, a null id as the empty string. A
    text of any length is one row; its units are an array of one string each. An empty table gives an empty result. Columns
    of docs may have any other names; those of these five are replaced.
    """
    checked(prefix, suffix, middle)
    own = ("_n", "_form", "_prefix_chars", "_middle_chars", "_output")
    text = text_or_empty(text_col)
    rows = docs.select(whole_row(docs).alias("all"), text.alias("text"), F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)).alias("units"), *(h.alias(f"h{k}") for k, h in enumerate(hashes(F.col(f"`{id_col}`"), seed), 1)))
    n = F.size("units").cast("long")
    one, two = F.col("h1") % (n + 1), F.col("h2") % (n + 1)
    held = F.contains("text", F.lit(prefix)) | F.contains("text", F.lit(suffix)) | F.contains("text", F.lit(middle))
    form = F.when((F.col("text") == "") | held | (F.col("h3") % 100 >= plain_from), "plain").when(F.col("h4") % 100 < spm_below, "spm").otherwise("psm")
    rows = rows.select("all", "text", "units", n.alias("n"), F.least(one, two).cast("int").alias("a"), F.greatest(one, two).cast("int").alias("b"), form.alias("form"))
    units, a, b = F.col("units"), F.col("a"), F.col("b")
    first, second, third = (F.array_join(F.slice(units, start + 1, size), "") for start, size in ((F.lit(0), a), (a, b - a), (b, F.size(units) - b)))
    p, s, m = map(F.lit, (prefix, suffix, middle))
    output = F.when(F.col("form") == "psm", F.concat(p, first, s, third, m, second)).when(F.col("form") == "spm", F.concat(s, third, p, first, m, second)).otherwise(F.col("text"))
    cut = F.col("form") != "plain"
    made = [F.col("n"), F.col("form"), F.when(cut, a.cast("long")), F.when(cut, (b - a).cast("long")), output]
    return rows.select(*(F.col("all")[c].alias(c) for c in docs.columns if c not in own), *(c.alias(x) for c, x in zip(made, own, strict=True)))


def restored(output: Column, form: Column, prefix: str = PREFIX, suffix: str = SUFFIX, middle: str = MIDDLE) -> Column:
    """The text, parsed out of an output at its sentinels; none of them is in a text that was cut, so each stands once."""
    part = F.split(output, "|".join(rf"\Q{x}\E" for x in (prefix, suffix, middle)), -1)
    first, third, second = F.get(part, F.when(form == "psm", 1).otherwise(2)), F.get(part, F.when(form == "psm", 2).otherwise(1)), F.get(part, F.lit(3))
    return F.when(form == "plain", output).otherwise(F.concat(first, second, third))

