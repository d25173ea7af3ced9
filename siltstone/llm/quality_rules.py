"""Quality rules: a table of thresholds compiled into one projection of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
SYMBOLS = "#*$%&|<>"

# The most frequent function words of four languages.
STOP_WORDS = {
    "en": "the of and to a in is it that for on with as was be by this are or from at an",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas plus avec",
    "es": "de la que el en y a los del se las por un para con no una su al es lo",
}

#: (name, ratio, least, most): a document is kept if every ratio lies between its bounds.
THRESHOLDS = (
    ("words", "n_words", 20, None),
    ("mean_word_length", "word_chars / n_words", 2, 16),
    ("symbols_per_word", "n_symbols / n_words", None, 0.3),
    ("shouts_per_word", "n_shouts / n_words", None, 0.3),
    ("stop_word_share", "n_stop_words / n_words", 0.01, None),
    ("duplicate_line_share", "n_dup_lines / n_lines", None, 0.5),
    ("repeated_word_share", "n_repeat_words / n_words", None, 0.3),
)


def _let(value: Column, use) -> Column:
    """use(value) with value evaluated once."""
    return F.transform(F.array(value), use)[0]


def _repeated_words(words: Column) -> Column:
    """Words that lie in a WINDOW-word window found twice or more; windows are compared by 64-bit hash."""

    def joined(hashes: Column, step: int) -> Column:
        return _let(hashes, lambda h: F.zip_with(h, F.slice(h, step + 1, F.greatest(F.size(h), F.lit(1))), lambda a, b: F.xxhash64(a, b)))

    windows = joined(joined(joined(F.transform(words, lambda w: F.xxhash64(w)), 1), 2), 4)
    windows = _let(windows, lambda h: F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))))

    def places(h: Column) -> Column:
        """Starts of the windows found more than once: neighbours in order of their hash."""
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        none = F.lit(None).cast("struct<h:bigint,i:int>")
        back = lambda s: F.zip_with(F.concat(F.array(none), s), s, lambda p, c: F.struct(c["h"].alias("h"), c["i"].alias("i"), (p["h"] == c["h"]).alias("same")))
        near = lambda s: F.zip_with(back(s), F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), lambda c, n: F.when(F.coalesce(c["same"], F.lit(False)) | F.coalesce(c["h"] == n["h"], F.lit(False)), c["i"]))
        return F.sort_array(F.filter(_let(ordered, near), lambda i: i.isNotNull()))

    def covered(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    counted = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(places(h), covered))
    return _let(windows, counted)


def measures(text: Column) -> dict[str, Column]:
    """The counts that the rules use, each of the whole text; null is empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    blanks = "\t\n\x0b\x0c\r"
    words = F.array_remove(F.split(F.translate(text, blanks, " " * len(blanks)), " "), "")
    stop = sorted({w for line in STOP_WORDS.values() for w in line.split()})
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " " + blanks, "")) > 0)
    bare = F.translate(text, " " + blanks, "")
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(bare).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeated_words(words),
        "n_lines": F.size(lines).cast("long"),
        "n_shouts": (F.length(text) - F.length(F.translate(text, "!", ""))).cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(stop))).cast("long"),
    }


def verdict(thresholds=THRESHOLDS) -> Column:
    """The table as one condition over the measures; a ratio without a value (no words) fails."""
    parts = []
    for _, ratio, least, most in thresholds:
        ratio = f"try_divide({ratio.replace(' / ', ', ')})" if " / " in ratio else ratio
        if least is not None:
            parts.append(f"({ratio}) >= {least}")
        if most is not None:
            parts.append(f"({ratio}) <= {most}")
    return F.expr("coalesce(" + " and ".join(parts) + ", false)")


def _measured(documents: DataFrame) -> DataFrame:
    """documents as the struct column `row`, beside the measures; names can't clash."""
    rows = documents.select(F.struct(*[documents[c] for c in documents.columns]).alias("row"))
    return rows.select("row", *[c.alias(name) for name, c in measures(F.col("row.text")).items()])


BASE_FAILED = "(n_words < 20 or 100 * n_repeat_words > 30 * n_words)"


def rated(documents: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """doc_id, the measures, base_failed and kept for every row.

    Null or blank texts have no words and fail. Repeated rows are rated each; null ids stay null;
    other columns are ignored; an empty table gives an empty result.
    """
    rows = _measured(documents.select("doc_id", "text")).withColumns({"base_failed": F.expr(BASE_FAILED), "verdict": verdict(thresholds)})
    return rows.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("verdict")).alias("kept"))


def passing(documents: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """The rows of documents that are kept, with their own columns."""
    kept = _measured(documents).where(~F.expr(BASE_FAILED) & verdict(thresholds))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in documents.columns])
