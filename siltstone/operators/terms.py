"""Document frequencies of terms, the rarity border, and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.tokens import MASK


def term_counts(sequences: DataFrame, *by: str) -> DataFrame:
    """(by..., term, df): in how many lines each term stands. sequences: tokens, and lines (how often) if counted."""
    often = F.col("lines") if "lines" in sequences.columns else F.lit(1)
    once = sequences.select(*by, often.alias("lines"), F.explode(F.array_distinct("tokens")).alias("term")).where(F.col("term") != MASK)
    return once.groupBy(*by, "term").agg(F.sum("lines").cast("long").alias("df"))


def border(counts: DataFrame, rate: float) -> DataFrame:
    """One row (border): the rarity border of a table of terms with df.

    Terms by falling df, as long as their cumulative share of all counts is below the rate: the border
    is the second smallest df among those (the only one if there is one, the largest of all if there
    is none; 0 without terms). Only the histogram of df is sorted, never the vocabulary.
    """
    levels = counts.groupBy("df").agg(F.sum("df").cast("long").alias("mass"))
    falling = Window.orderBy(F.desc("df")).rowsBetween(Window.unboundedPreceding, -1)
    total = levels.agg(F.sum("mass").alias("total"), F.max("df").alias("top"))
    cut = levels.withColumn("before", F.coalesce(F.sum("mass").over(falling), F.lit(0))).crossJoin(F.broadcast(total))
    inside = cut.where((F.col("before") + F.col("df")).cast("double") / F.col("total").cast("double") < F.lit(rate))
    least = inside.agg(F.sort_array(F.collect_set("df")).alias("d"))
    return total.crossJoin(F.broadcast(least)).select(F.coalesce(F.get("d", F.least(F.lit(1), F.size("d") - 1)), F.col("top"), F.lit(0)).cast("long").alias("border"))


def line_border(dfs: Column, border_: Column, rate: float) -> Column:
    """The border of a line: that of all, or the df that the line's match rate asks for, if that is less.

    dfs: the line's frequencies, 0 for masked tokens. The share `rate` of a line's most frequent tokens
    stays unmasked; masked ones in that share leave the border as it is.
    """
    if not 0 < rate:
        return border_
    falling = F.sort_array(dfs, asc=False)
    place = F.greatest(F.floor(F.size(dfs) * F.lit(float(rate))).cast("int"), F.lit(1)) - 1
    asked = F.get(falling, place)
    return F.least(border_, F.when(asked > 0, asked).otherwise(border_))


def idf(df: Column, total: Column) -> Column:
    return F.log(total / df) + 1


def score(masked: Column, dfs: Column, total: Column) -> Column:
    """The mean inverse document frequency of a line's unmasked tokens (repeats count); 0 without any."""
    open_ = F.filter(F.zip_with(masked, dfs, lambda t, d: F.when(t != MASK, idf(d, total))), lambda v: v.isNotNull())
    return F.when(F.size(open_) > 0, F.aggregate(open_, F.lit(0.0), lambda a, v: a + v) / F.size(open_)).otherwise(0.0)
