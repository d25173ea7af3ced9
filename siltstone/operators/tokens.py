"""Messages to token sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.config import Config
from siltstone.functions.dialects import java_regex
from siltstone.functions.scalars import is_real_number

MASK = "*"


def words(msg: Column, separators: str) -> Column:
    """The lower-cased parts of a message between separators."""
    between = "".join(c if c.isalnum() else "\\" + c for c in " " + separators)
    return F.filter(F.split(F.lower(msg), f"[{between}]"), lambda w: w != "")


def undotted(word: Column) -> Column:
    """A word without one full stop at its end; a lone full stop stays."""
    return F.when((F.length(word) > 1) & word.endswith("."), word.substr(F.lit(1), F.length(word) - 1)).otherwise(word)


def protected(token: Column, config: Config) -> Column:
    """True for keywords and what a key regex finds: such tokens are never masked as rare or as numbers."""
    found = [token.isin([k.lower() for k in config.keywords])] if config.keywords else []
    found += [token.rlike(java_regex(p)) for p in config.key_regexes]
    return reduce(lambda a, b: a | b, found, F.lit(False))


def labelled(msg: Column, config: Config) -> Column:
    """An array of (t, x): the token, masked if it is ignored, and the form that a display string hides."""

    def label(word: Column) -> Column:
        ignored = [word.isin([k.lower() for k in config.ignorewords])] if config.ignorewords else []
        ignored += [word.rlike(java_regex(p)) for p in config.ignore_regexes]
        token = undotted(word)
        number = is_real_number(token) & ~protected(token, config) if config.ignore_numbers else F.lit(False)
        if not ignored and not config.ignore_numbers:
            return F.struct(token.alias("t"), token.alias("x"))
        hidden = reduce(lambda a, b: a | b, ignored, F.lit(False))
        return F.struct(F.when(hidden | number, MASK).otherwise(token).alias("t"), F.when(hidden, word).otherwise(token).alias("x"))

    return F.transform(words(msg, config.separators), label)


def tokens(msg: Column, config: Config) -> Column:
    """The token sequence of a message; ignored words, and numbers if asked, are masked."""
    if not config.ignorewords and not config.ignore_regexes and not config.ignore_numbers:
        return F.transform(words(msg, config.separators), undotted)
    return F.transform(labelled(msg, config), lambda s: s["t"])


def display(msg: Column, hidden: Column, separators: str) -> Column:
    """The message with each part between separators that is in `hidden` (whatever its case) masked."""
    inside = "".join("\\" + c for c in separators)
    parts = F.regexp_extract_all(msg, F.lit(f"([^{inside}]+|[{inside}])"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(F.array_contains(hidden, F.lower(p)), MASK).otherwise(p)), "")
