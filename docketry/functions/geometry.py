"""Scores between a label and a word from their boxes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_center(df: DataFrame) -> DataFrame:
    """Boxes with their center as cx and cy; every box below is a struct that has them."""
    return df.withColumns({
        "cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2})


def height(box: Column) -> Column:
    return F.greatest(F.lit(1.0), box["y1"] - box["y0"])


def unit_of(label: Column) -> Column:
    """Height of a label; 10 for a flat one."""
    span = label["y1"] - label["y0"]
    return F.when(span == 0, 10.0).otherwise(span)


def reach_of(label: Column) -> Column:
    """Vertical distance beyond which a word on the page scores 0 or less: 'near' fades
    out after 13.34 units, 'below' ends after 6, 'same row' needs touching boxes."""
    unit = unit_of(label)
    return F.greatest(unit * 13.5, unit / 2 + 1.5)


def width_of_reach(label: Column, word: Column) -> Column:
    """Sideways distance beyond which a word scores 0 or less: a row fades out after
    22.5 units, and a word below has to overlap the label."""
    return F.greatest(
        unit_of(label) * 22.6, (label["x1"] - label["x0"] + word["x1"] - word["x0"]) / 2 + 1)


def shared(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def relation_score(label: Column, word: Column) -> Column:
    """struct(score, relation) of a word as the value of a label.

    Below in the same column: 100 less 6 per unit down, up to 6 units. Same row:
    90 less 4 per unit sideways. Else 40 less 3 per unit of distance, at least 0.
    """
    unit = unit_of(label)
    down = word["cy"] - label["cy"]
    aside = F.abs(word["cx"] - label["cx"])
    in_column = shared(label["x0"], label["x1"], word["x0"], word["x1"]) > 0
    below = (word["y0"] >= label["y1"] - unit * 0.3) & in_column & (down > 0) & (down <= unit * 6)
    in_row = (
        shared(label["y0"], label["y1"], word["cy"] - 1, word["cy"] + 1) > 0
    ) | (F.abs(down) <= unit * 0.6)
    away = F.sqrt(aside * aside + down * down)

    def scored(score: Column, name: str) -> Column:
        return F.struct(score.alias("score"), F.lit(name).alias("relation"))

    return (
        F.when(label["page"] != word["page"], scored(F.lit(0.0), "other_page"))
        .when(below, scored(100.0 - (down / unit) * 6.0, "below"))
        .when(in_row, scored(90.0 - (aside / unit) * 4.0, "same_row"))
        .otherwise(scored(F.greatest(F.lit(0.0), 40.0 - (away / unit) * 3.0), "near"))
    )


def is_label_itself(label: Column, word: Column) -> Column:
    return (F.abs(word["cx"] - label["cx"]) < 1) & (F.abs(word["cy"] - label["cy"]) < 1)
