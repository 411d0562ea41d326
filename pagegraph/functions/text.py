"""Text and scalar functions as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip_ws(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def without_digits(c: Column) -> Column:
    """Without decimal digits of any script."""
    return F.regexp_replace(c, r"\p{Nd}+", "")


def heal_hyphens(c: Column) -> Column:
    """Words cut by a hyphen at a line's end become one."""
    return F.regexp_replace(c, r"(?U)(\w+)-\s*\n\s*(\w+)", "$1$2")


def join_blocks(left: Column, right: Column) -> Column:
    """Text of two blocks: a closing hyphen glues, else a space parts them."""
    return F.when(F.endswith(left, F.lit("-")), F.concat(left.substr(F.lit(1), F.length(left) - 1), right)).otherwise(F.concat(left, F.lit(" "), right))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def rotation_angle(matrix: Column) -> Column:
    """Degrees of a glyph's matrix, one decimal, 0 without one."""
    b, a = F.try_element_at(matrix, F.lit(2)), F.try_element_at(matrix, F.lit(1))
    return F.when(F.coalesce(F.size(matrix), F.lit(0)) < 2, F.lit(0.0)).otherwise(F.bround(F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0)), 1))


def bbox_from_metadata(md: Column) -> list[Column]:
    """x0, top, x1, bottom out of ``bbox=[a, b, c, d]``; null without one."""
    number = r"([\d.]+)"
    pattern = rf"bbox=\[{number},\s*{number},\s*{number},\s*{number}\]"
    found = F.coalesce(F.regexp_like(md, F.lit(pattern)), F.lit(False))
    return [F.when(found, F.regexp_extract(md, pattern, i).cast("double")) for i in (1, 2, 3, 4)]


def metadata_ordinal(md: Column) -> Column:
    """Digits after the last underscore at the end; null if there are none."""
    return F.nullif(F.regexp_extract(md, r"_(\d+)$", 1), F.lit(""))


def compress(c: Column) -> Column:
    return F.bround(c, 0).cast("int")


def nfkc(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the NFKC form. Distinct values are few next to rows: they are normalised once and joined back."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(**{out: [unicodedata.normalize("NFKC", t) for t in f[column]]})

    words = df.where(F.col(column).isNotNull()).select(column).distinct().mapInPandas(run, f"{column} string, {out} string")
    return df.join(words, column, "left")
