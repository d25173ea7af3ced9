"""Many fixed words in texts: whole-word and substring matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole_words(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(id, word): the words (a column word) that stand in a text (id, text) with no letter a-z beside them.

    Texts and words are compared in lower case. What a word has of runs of a-z are whole runs of the text, so an
    equi-join on a word's longest run finds candidates, however many words there are; words with other
    characters are then looked up in those texts. Words without a letter have no run: they are an array beside each text.
    """
    low = texts.select("id", F.lower("text").alias("text"))
    runs = F.transform(F.split("word", "[^a-z]+"), lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))
    listed = words.select(F.lower("word").alias("word")).distinct().where("word <> ''").withColumn("run", F.array_max(runs)["x"])
    parts = low.select("id", F.explode(F.array_distinct(F.split("text", "[^a-z]+"))).alias("run")).where("run <> ''")
    found = parts.join(listed, "run").select("id", "word", (F.col("run") == F.col("word")).alias("sure"))
    there = "regexp_like(text, concat('(^|[^a-z])\\\\Q', word, '\\\\E($|[^a-z])'))"
    mixed = low.join(found.where("not sure").select("id", "word").distinct(), "id").where(there).select("id", "word")
    bare = listed.where("run = ''").agg(F.collect_set("word").alias("words"))
    bare = low.crossJoin(F.broadcast(bare)).select("id", "text", F.explode(F.filter("words", lambda w: F.contains(F.col("text"), w))).alias("word"))  # one row of words
    return found.where("sure").select("id", "word").union(mixed).union(bare.where(there).select("id", "word")).distinct()


def substrings(texts: DataFrame, words: list[str]) -> DataFrame:
    """(id, word): the words of a short list that are found anywhere in a text, overlapping or not."""
    listed = F.array(*[F.lit(w) for w in words])
    return texts.select("id", F.explode(F.filter(listed, lambda w: F.contains(F.col("text"), w))).alias("word"))
