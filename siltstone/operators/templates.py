"""Lines to log templates: rare terms masked, equal masked sequences grouped, ranked and shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from siltstone.config import Config
from siltstone.functions.workspace import stored
from siltstone.operators.parsing import matches
from siltstone.operators.terms import border, line_border, score, term_counts
from siltstone.operators.tokens import MASK, display, labelled, protected, tokens

#: Terms whose frequencies are broadcast; the others, which are rare, are joined by a shuffle.
FREQUENT = 20_000
LONGEST = 64
#: Terms whose frequencies rows look up where they lie, at most; the places of others are joined.
LOOKED_UP = 2_000_000


def split(joined: Column) -> Column:
    """The tokens of a sequence that was joined by spaces, which no token has."""
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))


def by_sequence(rows: DataFrame, *aggregates: Column) -> DataFrame:
    """Rows (tokens and others) aggregated by their tokens: joined, what it is, and tokens. Stored; as one string, a sequence takes a third of the room."""
    found = rows.withColumn("joined", F.array_join("tokens", " ")).groupBy("joined").agg(*aggregates)
    return stored(found, "sequences").withColumn("tokens", split(F.col("joined")))


def sequences(messages: DataFrame, config: Config) -> DataFrame:
    """Distinct token sequences of messages (msg, and epoch, ord and line if there) with what groups need of their lines.

    They are stored: term counts, masks and groups all read them. joined: the tokens with spaces between.
    """
    rows = messages.withColumn("tokens", tokens(F.col("msg"), config))
    aggregates = [F.count("*").alias("lines")]
    if "epoch" in messages.columns:
        line = F.col("line") if "line" in messages.columns else F.col("msg")
        ord_ = F.col("ord") if "ord" in messages.columns else F.col("epoch")
        aggregates += [F.min("epoch").alias("created"), F.max("epoch").alias("updated"), F.max(F.struct(ord_.alias("ord"), F.col("msg").alias("msg"), line.alias("line"))).alias("last")]
    return by_sequence(rows, *aggregates)


def with_df(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows (term and others) with their terms' df; masks and null terms have none, other unknown terms go.

    The most frequent terms, which are all hot keys, are broadcast; only rare ones are joined by a shuffle.
    """
    top = counts.where(F.length("term") <= LONGEST).orderBy(F.desc("df"), "term").limit(FREQUENT)
    known = rows.join(F.broadcast(top.select("term", "df")), "term", "left")
    done = known.where(F.col("df").isNotNull() | F.col("term").isNull() | (F.col("term") == MASK))
    rare = known.where(F.col("df").isNull() & F.col("term").isNotNull() & (F.col("term") != MASK)).drop("df").join(counts.select("term", "df"), "term")
    return done.unionByName(rare)


def looked_up(counts: DataFrame, most: int):
    """An Arrow table of the most frequent terms (term, df), as many as `most` at most; and the frequency of all others.

    Those are all terms (of at most LONGEST characters) from a frequency on, found by the histogram of frequencies. The
    frequency is None if the others have several; often they all stand in one line, and nothing is left to be looked up.
    """
    levels = counts.groupBy("df").agg(F.count("*").alias("terms"), F.max(F.length("term")).alias("longest"))
    falling = Window.orderBy(F.desc("df")).rowsBetween(Window.unboundedPreceding, 0)
    kept = levels.withColumn("sofar", F.sum("terms").over(falling))
    below = F.when(F.col("sofar") > most, F.col("df"))
    least, longest, *rest = kept.agg(F.min(F.when(F.col("sofar") <= most, F.col("df"))), F.max(F.when(F.col("sofar") <= most, F.col("longest"))), F.min(below), F.max(below)).first()
    frequent = counts.where(F.lit(least is not None) & (F.col("df") >= F.lit(least)) & (F.length("term") <= LONGEST)).select("term", "df")
    return frequent.toArrow().combine_chunks(), (rest[0] or 0) if rest[0] == rest[1] and (longest or 0) <= LONGEST else None


def with_dfs(distinct: DataFrame, counts: DataFrame, most: int = LOOKED_UP) -> DataFrame:
    """Distinct rows (joined, not null, and others) with dfs, the frequencies of their tokens in order; masks and unknown terms have 0.

    Frequent terms are looked up where a row lies, so rows are not taken apart; only the places of rarer
    terms are joined with counts, and what they find comes back to their rows.
    """
    frequent, rest = looked_up(counts, most)

    def look(batches, rare):  # whole within itself: executors need not have this module
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        terms, known = (frequent[c].chunk(0) if frequent.num_rows else pa.array([], frequent.schema.field(c).type) for c in ("term", "df"))
        def larger(batches):
            """Batches of some MB: a search table of terms is built for each."""
            held = []
            for batch in batches:
                held.append(batch)
                if sum(b.nbytes for b in held) >= 8 << 20:
                    yield pa.concat_batches(held)
                    held = []
            if held:
                yield pa.concat_batches(held)

        for batch in larger(batches):
            parts = pc.split_pattern(batch.column("joined"), " ")
            lengths = np.where(pc.equal(batch.column("joined"), "").to_numpy(zero_copy_only=False), 0, parts.value_lengths().to_numpy())
            starts = np.r_[0, np.cumsum(lengths)]
            flat = parts.flatten()
            flat = flat.filter(pc.not_equal(flat, ""))  # the part of an empty sequence
            df = known.take(pc.index_in(flat, value_set=terms))
            missing = df.is_null().to_numpy(zero_copy_only=False) & pc.not_equal(flat, MASK).to_numpy(zero_copy_only=False)
            if rare:
                at = np.flatnonzero(missing)
                row = np.searchsorted(starts, at, "right") - 1
                places = pa.array(at - starts[row], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(row)), batch.column("b").take(pa.array(row)), places, flat.take(pa.array(at))], ["a", "b", "pos", "term"])
                continue
            df = np.where(missing, rest or 0, pc.fill_null(df, 0).to_numpy(zero_copy_only=False))
            if rest is None:
                found = batch.column("found")
                row = np.repeat(np.arange(len(found)), pc.fill_null(found.value_lengths(), 0).to_numpy())
                pos, dfs = (found.flatten().field(k).to_numpy() for k in (0, 1))
                df[starts[row] + pos] = dfs
            dfs = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(df, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), dfs], [*columns, "dfs"])

    columns = distinct.columns
    schema = StructType([*distinct.schema.fields, StructField("dfs", ArrayType(LongType()))])
    if rest is not None:
        return distinct.mapInArrow(lambda batches: look(batches, False), schema)
    keyed = distinct.withColumns({"a": F.xxhash64("joined"), "b": F.hash("joined")})
    places = keyed.select("a", "b", "joined").mapInArrow(lambda batches: look(batches, True), "a long, b int, pos int, term string")
    found = places.join(counts.select("term", "df"), "term").groupBy("a", "b").agg(F.collect_list(F.struct("pos", "df")).alias("found"))
    rows = keyed.join(found, ["a", "b"], "left").select(*columns, "found")
    return rows.mapInArrow(lambda batches: look(batches, False), schema)


def once(value: Column, f) -> Column:
    """f(value), with the value evaluated once a row.

    Spark puts the expressions of columns into those that use them: inside a lambda function of an
    array they would be evaluated for each of its elements.
    """
    return F.transform(F.array(value), f)[0]


def masked_rows(distinct: DataFrame, config: Config, counts: DataFrame | None = None, border_: DataFrame | None = None) -> DataFrame:
    """by_sequence() rows (tokens, joined, lines and others) with masked, dfs, border, border_line and score, without joined.

    counts: the terms' frequencies; border_: one row, border. Rows without tokens (null) go.
    """
    counts = stored(term_counts(distinct) if counts is None else counts, "terms")
    if border_ is None:
        border_ = distinct.sparkSession.range(1).select(F.lit(config.term_count_border).cast("long").alias("border")) if config.term_count_border else border(counts, config.term_count_border_rate)
    total = (counts.agg(F.sum("df").alias("total"))).crossJoin(F.broadcast(border_))
    others = [c for c in distinct.columns if c not in ("tokens", "joined")]
    lines = with_dfs(distinct.where(F.col("joined").isNotNull()).select("joined", *others), counts).crossJoin(F.broadcast(total))

    def seen(dfs, edge):
        hidden = lambda t, d: (t == MASK) | (~protected(t, config) & (d < edge))
        return F.struct(dfs.alias("dfs"), edge.alias("border_line"), F.zip_with(split(F.col("joined")), dfs, lambda t, d: F.when(hidden(t, d), MASK).otherwise(t)).alias("masked"))

    of = once(F.col("dfs"), lambda dfs: once(line_border(dfs, F.col("border"), config.min_match_rate), lambda edge: seen(dfs, edge)))
    lines = lines.withColumn("_of", of).select(split(F.col("joined")).alias("tokens"), *others, "border", "total", "_of.*")
    return lines.select("tokens", *others, "masked", "dfs", "border", "border_line", score(F.col("masked"), F.col("dfs"), F.col("total")).alias("score"))


def masks(distinct: DataFrame, config: Config, counts: DataFrame | None = None, border_: DataFrame | None = None) -> DataFrame:
    """tokens, masked, dfs, border, border_line and score of each distinct token sequence, as masked_rows() has them."""
    return masked_rows(distinct, config, counts, border_).select("tokens", "masked", "dfs", "border", "border_line", "score")


def masked_sequences(messages: DataFrame, config: Config, **given) -> DataFrame:
    """The distinct sequences with their lines' aggregates and masks."""
    return masked_rows(sequences(messages, config), config, **given)


def templates(messages: DataFrame, config: Config, **given) -> DataFrame:
    """(template, count): how many lines have each masked sequence, joined by spaces."""
    found = masked_sequences(messages.select("msg"), config, **given)
    return found.groupBy(F.array_join("masked", " ").alias("template")).agg(F.sum("lines").cast("long").alias("count"))


def groups(messages: DataFrame, config: Config, **given) -> DataFrame:
    """group_id, masked, display, count, created, updated, score and last_message of each template.

    messages: msg, epoch, and ord and line if there. The display string and the last message are
    those of the last line by ord. group_id is a hash of the masked sequence.
    """
    rows = masked_sequences(messages, config, **given)
    found = rows.groupBy("masked").agg(F.sum("lines").cast("long").alias("count"), F.min("created").alias("created"), F.max("updated").alias("updated"), F.max("last").alias("last"), F.max("score").alias("score"))
    hidden = F.array_distinct(F.filter(F.zip_with(labelled(F.col("last.msg"), config), "masked", lambda s, m: F.when(m == MASK, s["x"])), lambda x: x.isNotNull()))
    return found.select(F.xxhash64("masked").alias("group_id"), "masked", display(F.col("last.msg"), hidden, config.separators).alias("display"), "count", "created", "updated", "score", F.col("last.line").alias("last_message"))


def in_range(found: DataFrame, least: int = 0, most: int = 0, updated_from: int = 0, search=(), exclude=()) -> DataFrame:
    """Groups by count (most 0: any), time of the last line, and what their display strings hold."""
    kept = found.where((F.col("count") >= least) & (F.col("updated") >= updated_from)).where(matches(F.col("display"), search, exclude))
    return kept.where(F.col("count") <= most) if most else kept


def top(found: DataFrame, n: int = 10, ascending: bool = False) -> DataFrame:
    """The n largest groups, less rare ones first among equals; ascending: the smallest, rarer ones first. n <= 0: all."""
    order = (F.asc("count"), F.desc("score")) if ascending else (F.desc("count"), F.asc("score"))
    ranked = found.orderBy(*order, "group_id")
    return ranked.limit(n) if n > 0 else ranked


def regrouped(found: DataFrame, config: Config) -> DataFrame:
    """Existing groups (display, count, created, updated) under another border or match rate: counts of those that meet are added.

    Groups may come in parts (a display string in several rows): all that counts is summed up here.
    """
    rows = found.select(F.col("display").alias("msg"), "count", "created", "updated")
    rows = rows.withColumn("tokens", tokens(F.col("msg"), config))
    again = rows.select(F.array_join("tokens", " ").alias("joined"), F.col("count").alias("lines"), "created", "updated")  # equal ones meet at the end
    merged = masked_rows(stored(again, "sequences").withColumn("tokens", split(F.col("joined"))), config)
    return merged.groupBy(F.array_join("masked", " ").alias("template")).agg(F.sum("lines").cast("long").alias("count"), F.min("created").alias("created"), F.max("updated").alias("updated"))


def ranked_ids(found: DataFrame) -> DataFrame:
    """Groups with a readable id too: the first second times 100,000, and the place among groups of that second."""
    order = Window.partitionBy("created").orderBy("group_id")
    return found.withColumn("readable_id", F.col("created") * 100_000 + F.row_number().over(order))
