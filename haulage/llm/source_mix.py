"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key ``-ln(u) / weight`` with ``u`` from a hash of its id and
``weight`` its quality weight; a source's documents in key order are a weighted random order.
A source takes its complete epochs first (every document ``floor(target / source size)`` times)
and then documents in key order until the rest of its word budget is reached.

The order within a source is never sorted whole: keys fall into buckets (quantiles of the
exponential law), bucket sizes are prefix-summed, and the one bucket per source in which the
budget ends is cut into buckets again, between its least and greatest key, until it is small,
whatever the weights are; only what is left is sorted. The result is one row per source, the
last place that is taken, against which every row is held where it stands: a source that holds
most rows is never gathered. Built-in DataFrame functions throughout.

Defined cases: null or empty text has size 0 and is taken 0 words; a null source is a source of
its own, last in order; documents whose weight is null, NaN, 0 or less come after all others of
their source, in random order; sources of size 0 have target 0; rows without an id draw by their text;
ties are ordered by id, size and text, and equal rows are taken one by one, any of them first;
extra columns are ignored by the report and kept by ``mixed``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haulage.llm.common import NULL_ID, cut, prepare, shown_id

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 1024
END_ROWS = 100_000        # of one source, sorted in one task
LAST_KEY = 1e300          # keys of rows without a weight begin here
MAX_EPOCHS = 3
SYMBOL_CHARS = "#*$%&|<>"


def n_words(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def quality_weight(text: Column) -> Column:
    """Between 0.25 and 1: falls with the share of symbol characters in the text."""
    length = F.length(text)
    symbols = length - F.length(F.translate(text, SYMBOL_CHARS, ""))
    return F.when(F.coalesce(length, F.lit(0)) == 0, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.25), 1.0 - 5.0 * symbols.cast("double") / length))


def uniform(key: Column, text: Column, salt: str) -> Column:
    """A number in (0, 1) that depends on the key (without one, the text) and salt alone: 52 bits of an MD5."""
    name = F.coalesce(key.cast("string"), F.md5(text), F.lit("null"))
    digits = F.substring(F.md5(F.concat(F.lit(salt + ":"), name)), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(2.0**52)


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of (source, source_size), one row per source.

    Weights 1, 2, 3 repeat over the sources in code point order, null last; they share the total.
    A source stops at ``max_epochs`` times its size and the excess is shared again by weight:
    in order of cap / weight, the first sources that the common rate would lift over their caps
    get the caps, all others the rate times their weight.
    """
    # one row per source: these windows see the list of sources, not the documents
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.select("source", "source_size",
                           ((F.row_number().over(named) - 1) % 3 + 1).cast("double").alias("weight"),
                           (F.col("source_size") * max_epochs).cast("double").alias("cap"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rated = weighed.select("*", ((F.sum(F.col("source_size").cast("double")).over(whole)
                                  - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                                 / (F.sum("weight").over(whole)
                                    - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))).alias("rate"),
                           F.row_number().over(by_cap).alias("nth"))
    # the first source under its cap sets the rate for itself and all after it
    free = F.when(F.col("rate") * F.col("weight") <= F.col("cap"), F.col("nth"))
    common = (rated.withColumn("free", F.min(free).over(whole))
              .withColumn("common", F.max(F.when(F.col("nth") == F.col("free"), F.col("rate"))).over(whole)))
    target = F.when(F.col("nth") < F.coalesce("free", F.col("nth") + 1), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("common") * F.col("weight")))
    return common.select("source", "source_size", target.alias("target"))


_PLACE = ("_mix_key", "_mix_id", "_mix_size", "_mix_tag")


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight: Column | None, salt: str) -> list[Column]:
    """Columns of a row's place in the order of its source; only equal rows share a place."""
    text = F.col(f"`{text_col}`").cast("string")
    weight = quality_weight(text) if weight is None else weight
    drawn = -F.log(uniform(F.col(f"`{id_col}`"), text, salt))
    weight = weight.cast("double")
    key = F.when((weight > 0) & ~F.isnan(weight), F.least(drawn / weight, F.lit(LAST_KEY / 10))).otherwise(LAST_KEY * (1 + drawn))
    return [F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("_mix_id"),
            F.col(f"`{source_col}`").cast("string").alias("_mix_source"), n_words(text).alias("_mix_size"),
            F.xxhash64(text).alias("_mix_tag"), key.alias("_mix_key")]


def _ends(keyed: DataFrame, bucket: Column, begin: Column) -> DataFrame:
    """Per source the bucket in which its budget ends: its least and greatest key, its rows, and
    the words ahead of it (``begin``: those ahead of all buckets). None where the budget takes all."""
    filled = (keyed.groupBy("_mix_source", bucket.alias("bucket")).agg(
        F.sum("_mix_size").alias("filled"), F.count("*").alias("n"), F.min("_mix_key").alias("low"), F.max("_mix_key").alias("high"),
        F.first("budget").alias("budget"), F.first(begin).alias("ahead")))
    # buckets x sources rows at most
    upto = Window.partitionBy("_mix_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = filled.withColumn("begin", F.col("ahead") + F.coalesce(F.sum("filled").over(upto), F.lit(0)))
    found = (begins.where("begin + filled > budget").groupBy("_mix_source")
             .agg(F.min(F.struct("bucket", "begin", "budget", "n", "low", "high")).alias("e")))
    return cut(found.select(F.col("_mix_source").alias("e_source"), "e.begin", "e.budget", "e.n", "e.low", "e.high"), "mix-ends")


def _inside(keyed: DataFrame, ends: DataFrame) -> DataFrame:
    """The rows of the buckets in which budgets end: those between a bucket's least and greatest key."""
    return keyed.join(ends, F.col("_mix_source").eqNullSafe(F.col("e_source")) & F.col("_mix_key").between(F.col("low"), F.col("high")))


def _cuts(keyed: DataFrame, max_epochs: int, buckets: int, end_rows: int) -> DataFrame:
    """One row per source: sizes, complete epochs, the last place of the partial one and how many
    of the equal rows at that place go in."""
    sources = keyed.groupBy(F.col("_mix_source").alias("source")).agg(F.sum("_mix_size").alias("source_size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budgets = cut(source_targets(sources, max_epochs).select(
        "source", "source_size", "target", epochs.alias("epochs"),
        (F.col("target") - epochs * F.col("source_size")).alias("budget")), "mix-budgets")
    # 1 - exp(-key) rises with the key and is spread evenly where weights are 1
    first = F.floor((1 - F.exp(-F.col("_mix_key"))) * buckets)
    budgeted = keyed.join(budgets.select(F.col("source").alias("b_source"), "budget"), F.col("_mix_source").eqNullSafe(F.col("b_source")))
    ends = _ends(budgeted, first, F.lit(0).cast("long"))
    while ends.where((F.col("n") > end_rows) & (F.col("low") < F.col("high"))).limit(1).count():
        # where two keys differ, the least and the greatest of a bucket fall into different ones
        step = F.when(F.col("low") < F.col("high"), F.floor((F.col("_mix_key") - F.col("low")) / (F.col("high") - F.col("low")) * buckets)).otherwise(0)
        ends = _ends(_inside(keyed, ends), step, F.col("begin"))
    in_order = Window.partitionBy("_mix_source").orderBy(*_PLACE).rowsBetween(Window.unboundedPreceding, -1)
    last = _inside(keyed, ends).withColumn("before", F.col("begin") + F.coalesce(F.sum("_mix_size").over(in_order), F.lit(0)))
    # the document that crosses the budget goes in when that ends nearer to it
    taken = last.where((F.col("before") < F.col("budget")) & (2 * (F.col("budget") - F.col("before")) >= F.col("_mix_size")))
    places = (taken.groupBy(F.col("_mix_source").alias("p_source"), F.struct(*_PLACE).alias("place")).agg(F.count("*").alias("n"))
              .groupBy("p_source").agg(F.max(F.struct("place", "n")).alias("p")))
    return cut(budgets.join(ends.select("e_source", "low", "high"), F.col("source").eqNullSafe(F.col("e_source")), "left")
               .join(places, F.col("source").eqNullSafe(F.col("p_source")), "left")
               .select(F.col("source").alias("_cut_source"), F.col("source_size").alias("_cut_size"), F.col("target").alias("_cut_target"),
                       F.col("epochs").alias("_cut_epochs"), F.coalesce("low", F.lit(float("inf"))).alias("_cut_low"), F.col("high").alias("_cut_high"),
                       F.col("p.place").alias("_cut_place"), F.col("p.n").alias("_cut_n")), "mix-cuts")


def _placed(keyed: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows with ``_mix_copies``, how often the mix takes them. Each row is decided where it stands;
    only the equal rows at the last place of a source are numbered."""
    met = keyed.join(cuts, F.col("_mix_source").eqNullSafe(F.col("_cut_source")))
    place, key = F.struct(*_PLACE), F.col("_mix_key")
    inside = key.between(F.col("_cut_low"), F.col("_cut_high"))
    at_end = F.coalesce(inside & (place == F.col("_cut_place")), F.lit(False))
    before = (key < F.col("_cut_low")) | F.coalesce(inside & (place < F.col("_cut_place")), F.lit(False))
    most = met.where(~at_end).withColumn("_mix_copies", F.col("_cut_epochs") + before.cast("long"))
    equal = Window.partitionBy("_mix_source").orderBy(*_PLACE)
    last = (met.where(at_end).withColumn("_mix_nth", F.row_number().over(equal))
            .withColumn("_mix_copies", F.col("_cut_epochs") + (F.col("_mix_nth") <= F.col("_cut_n")).cast("long")).drop("_mix_nth"))
    return most.unionByName(last)


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weight: Column | None = None, salt: str = "mix", buckets: int = BUCKETS,
             max_epochs: int = MAX_EPOCHS, end_rows: int = END_ROWS) -> DataFrame:
    """Per document row: doc_id, size, source_size, target (both of its source), taken (words), copies."""
    prepare(docs.sparkSession)
    # the texts are read once; what follows sees narrow rows
    keyed = cut(docs.select(_keyed(docs, id_col, text_col, source_col, weight, salt)), "mix-keys")
    return _placed(keyed, _cuts(keyed, max_epochs, buckets, end_rows)).select(
        shown_id("_mix_id").alias("doc_id"), F.col("_mix_size").alias("size"), F.col("_cut_size").alias("source_size"),
        F.col("_cut_target").alias("target"), (F.col("_mix_size") * F.col("_mix_copies")).alias("taken"),
        F.col("_mix_copies").alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None,
          salt: str = "mix", buckets: int = BUCKETS, max_epochs: int = MAX_EPOCHS, end_rows: int = END_ROWS) -> DataFrame:
    """The mix itself: every row as often as the plan takes it, with all its columns. A row finds
    its place by the one-row-per-source cuts, so texts are not shuffled."""
    prepare(docs.sparkSession)
    columns = _keyed(docs, id_col, text_col, source_col, weight, salt)
    # words are counted once: the cuts read the narrow columns of what is written here
    rows = cut(docs.select("*", *columns), "mix-rows")
    narrow = rows.select("_mix_source", "_mix_size", *(c for c in _PLACE if c != "_mix_size"))
    placed = _placed(rows, _cuts(narrow, max_epochs, buckets, end_rows)).where("_mix_copies > 0")
    return (placed.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies"))))
            .select(*(F.col(f"`{c}`") for c in docs.columns)))
