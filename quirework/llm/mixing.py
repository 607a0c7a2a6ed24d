"""Operator 4: mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Each source's documents are shuffled by a digest of their id and laid end to end; the stream is cut into blocks
of equally many words. A block is a share of the mix that ``SLOTS`` sets, or shorter, so that what is taken of a source has
``LEAST_SLOTS`` blocks, or one for each word. Slot i of the mix has the golden-ratio point
frac(i * phi); the source in whose share of the unit interval it falls gets the slot, and a share is as wide as the source has
blocks to give. The k-th slot of a source takes its k-th block, going round the stream again after its end, until its
target is reached to the word. The points come within a few slots of that: a source's slots beyond its last block stay empty, and
blocks beyond its last slot follow after the last point's. No document comes more than ``LIMIT`` times.

Defined results: sources rank by code point with null last and weigh 3, 1, 2, repeating; a null text
has no words; documents without words take nothing; a source without words has target 0; rows that
repeat one doc_id take their own places; an empty table gives an empty table. Extra columns are
ignored, whatever their names. The table of sources is walked in one task: it has a row per source.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm.common import WORD, compact, durable, hex_digits, one_of_each, raw_print, running_total, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2
#: The golden ratio's fraction, and what 2**20 steps of it leave.
PHI = (math.sqrt(5) - 1) / 2
PHI_20 = (2**20 * PHI) % 1
#: The unit interval's cells, by which slots find their source with an equi-join.
CELLS = 4096
#: Slots that the mix is cut into, about, and those of a source at least, if it gives as many words.
SLOTS, LEAST_SLOTS = 2**16, 2**8


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source_key, source, source_size, target) from (source, size); one row per source.

    All targets rise together in proportion to weight and stop at LIMIT times the source's size.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("source_key") - 1) % len(WEIGHTS) + 1).cast("int"))
    sources = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("source_key", F.row_number().over(rank))
        .withColumn("_w", weight)
        .withColumn("_cap", F.col("source_size") * LIMIT)
    )
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), "source_key")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * SHARE - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum(
        "_w"
    ).over(onward)
    fits = F.when(level <= F.col("_cap") / F.col("_w"), F.struct(F.col("_cap") / F.col("_w"), "source_key", level))
    first = F.min("_fits").over(everything)
    return (
        sources.withColumn("_fits", fits)
        .withColumn("_level", F.coalesce(first["col3"], F.lit(0.0)))
        .select(
            "source_key",
            "source",
            "source_size",
            F.least(F.col("_level") * F.col("_w"), F.col("_cap").cast("double")).alias("target"),
        )
    )


def planned(sources: DataFrame) -> tuple[DataFrame, int]:
    """Sources with words to give and their share of the unit interval; the number of slots.

    A source gives its stream ``rounds`` times and then its first ``rest`` words, in blocks of ``block`` words: ``blocks`` to a
    round, ``n`` in all.
    """
    plan = sources.where("source_size > 0 and target >= 1").withColumn("_quota", F.floor("target").cast("long"))
    total = plan.agg(F.coalesce(F.sum("_quota"), F.lit(0))).first()[0]
    own = F.greatest(F.lit(1), F.least(F.lit(-(-total // SLOTS)), F.expr(f"_quota div {LEAST_SLOTS}")))
    plan = plan.withColumn("block", own.cast("long")).withColumn("rounds", F.expr("_quota div source_size"))
    plan = plan.withColumn("rest", F.expr("_quota % source_size")).withColumn("blocks", F.expr("(source_size + block - 1) div block"))
    plan = plan.withColumn("n", F.expr("rounds * blocks + (rest + block - 1) div block"))
    run = Window.orderBy("source_key").rowsBetween(Window.unboundedPreceding, -1)
    plan = durable(plan.withColumn("_from", F.coalesce(F.sum("n").over(run), F.lit(0)).cast("long")))
    slots = plan.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    share = lambda edge: edge / F.lit(max(slots, 1))
    ends = (share(F.col("_from")).alias("_lo"), share(F.col("_from") + F.col("n")).alias("_hi"))
    return plan.select("source_key", "block", "blocks", "rounds", "rest", "n", *ends), slots


def schedule(plan: DataFrame, slots: int) -> DataFrame:
    """The mix's slots that are filled: (slot, source_key, k), k counting the source's slots from 0 to n - 1."""
    cells = plan.withColumn(
        "_cell",
        F.explode(F.sequence(F.floor(F.col("_lo") * CELLS), F.least(F.floor(F.col("_hi") * CELLS), F.lit(CELLS - 1)))),
    )
    high, low = F.shiftright(F.col("id"), 20), F.col("id").bitwiseAND(2**20 - 1)
    point = (high * F.lit(PHI_20) + low * F.lit(PHI)) % 1
    points = plan.sparkSession.range(slots).select(F.col("id").alias("slot"), point.alias("_u"))
    points = points.withColumn("_cell", F.floor(F.col("_u") * CELLS))
    drawn = points.join(cells, "_cell").where("_u >= _lo and _u < _hi")
    k = F.row_number().over(Window.partitionBy("source_key").orderBy("slot")) - 1
    drawn = durable(drawn.select("slot", "source_key", k.cast("long").alias("k"), "n").where("k < n").drop("n"))
    some = drawn.groupBy("source_key").agg(F.count(F.lit(1)).alias("_some"))
    # What the points left out, in turns: a block of each such source, then the next.
    left = plan.join(some, "source_key", "left").withColumn("_some", F.coalesce("_some", F.lit(0)))
    left = left.where("_some < n").select("source_key", "_some", F.explode(F.sequence("_some", F.col("n") - 1)).alias("k"))
    turn = F.row_number().over(Window.orderBy(F.col("k") - F.col("_some"), "source_key")) - 1
    return drawn.unionByName(left.select((F.lit(slots) + turn).cast("long").alias("slot"), "source_key", "k"))


def _placed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every document with its place in its source's stream and the words taken of it; the schedule.

    The k-th slot takes the k-th block, so a stream is taken whole some times and once more up to some word.
    """
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    words = word_count(docs["text"]).alias("size")
    sizes = compact(docs.select(docs["doc_id"], docs["source"], words, raw_print(docs, "source").alias("print")))
    digits = hex_digits(sizes.count())
    sources = durable(source_targets(sizes))
    plan, slots = planned(sources)
    filled = durable(schedule(plan, slots))
    given = plan.select("source_key", "block", "blocks", F.col("rounds").alias("_rounds"), F.col("rest").alias("_rest"))
    told = sources.withColumnRenamed("source", "_of").join(given, "source_key", "left")
    told = durable(told.fillna(0, ["_rounds", "_rest"]).fillna(1, ["block"]))
    placed = (
        sizes.join(told, sizes["source"].eqNullSafe(told["_of"]))
        .drop("_of")
        .withColumn("_digest", digest)
        .withColumn("_chunk", F.substring("_digest", 1, digits))
    )
    order = ["_digest", F.col("doc_id").asc_nulls_first(), "size", "print"]
    placed = running_total(placed, "source_key", "_chunk", order, "size", "first_word").drop("_digest", "_chunk")
    once_more = F.greatest(F.lit(0).cast("long"), F.least("size", F.col("_rest") - F.col("first_word")))
    placed = placed.withColumn("_more", once_more).withColumn("_block", F.expr("first_word div block"))
    return durable(placed.withColumn("taken", (F.col("_rounds") * F.col("size") + F.col("_more")).cast("long"))), filled


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, first_word and first_slot.

    first_word is its place in its source's stream; first_slot is the slot of the mix where it first comes, null if it does not.
    """
    placed, filled = _placed(docs)
    slots = filled.select(F.col("source_key").alias("_key"), F.col("k").alias("_k"), F.col("slot").alias("first_slot"))
    found = placed.join(slots, (placed["source_key"] == slots["_key"]) & (placed["_block"] == slots["_k"]) & (placed["taken"] > 0), "left")
    return found.select("doc_id", "size", "source_size", "target", "taken", "source", "first_word", "first_slot")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents, in its order: each comes at the slot of its first word, as often as it is taken.

    One per source may come cut to its first words. A text that is cut has its words joined by single spaces, and
    n_chars, where there is such a column, is its new length. Of rows that are alike in doc_id, text and source each has
    its own places, but all show the other columns of one of them. Documents without words do not come.
    """
    placed, filled = _placed(docs)
    part = lambda turn, words: F.struct(turn.cast("long").alias("turn"), words.cast("long").alias("words"))
    rounds = F.transform(F.sequence(F.lit(1), "_rounds"), lambda t: part(t - 1, F.col("size")))
    parts = F.concat(
        F.when(F.col("_rounds") > 0, rounds).otherwise(F.array().cast("array<struct<turn:bigint,words:bigint>>")),
        F.when(F.col("_more") > 0, F.array(part(F.col("_rounds"), F.col("_more")))).otherwise(F.array()),
    )
    copies = placed.where("taken > 0").withColumn("_part", F.explode(parts))
    copies = copies.withColumn("k", F.col("_part.turn") * F.col("blocks") + F.col("_block")).join(filled, ["source_key", "k"])
    copies = durable(
        copies.select(
            F.col("doc_id").alias("__qw_id"), F.col("print").alias("__qw_print"), F.col("slot").alias("__qw_slot"),
            F.col("first_word").alias("__qw_first"), F.col("_part.words").alias("__qw_part"), F.col("size").alias("__qw_size"),
        )
    )
    named = placed.select("doc_id", "print", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "print").alias("name"))
    once = one_of_each(docs, named, "name", "source")
    sized = once.withColumn("__qw_own", raw_print(once, "source"))
    match = sized["doc_id"].eqNullSafe(copies["__qw_id"]) & (sized["__qw_own"] == copies["__qw_print"])
    out = sized.join(copies, match)
    words = F.slice(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("__qw_part").cast("int"))
    cut = F.col("__qw_part") < F.col("__qw_size")
    out = out.withColumn("__qw_text", F.when(cut, F.array_join(words, " ")).otherwise(F.col("text")))
    picked = []
    for field in docs.schema.fields:
        column = F.col(f"`{field.name}`")
        if field.name == "text":
            column = F.col("__qw_text").alias("text")
        elif field.name == "n_chars":
            length = F.length("__qw_text").cast(field.dataType)
            column = F.when(cut, length).otherwise(F.col("n_chars")).alias("n_chars")
        picked.append(column)
    return out.sort("__qw_slot", "__qw_first", F.col("__qw_id").asc_nulls_last(), "__qw_print").select(*picked)
