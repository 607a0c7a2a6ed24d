"""Duplicates: a disjunctive match rule as shared keys, and the greedy partition in input order, in rounds.

Two rows match if their DOIs are equal, or if their titles are equal and the years or the first authors are, or neither
row has any. Each of these is a key that both hold, so a row has at most three keys, and rows match if they share one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.text import blank_to_null, doi_dedupe, match_text, year_of
from quirework.storage import discard, durable

KEYS = ("k_doi", "k_title", "k_year", "k_author")


def match_keys(citations: DataFrame) -> DataFrame:
    """Adds what the match rule compares: DOI, title, year, first author; null where missing."""
    first = F.get("author", 0)
    author = blank_to_null(match_text(F.coalesce(blank_to_null(first["family"]), blank_to_null(first["literal"]))))
    return (
        citations.withColumn("k_doi", doi_dedupe(F.col("DOI")))
        .withColumn("k_title", blank_to_null(match_text(F.col("title"))))
        .withColumn("k_year", year_of(F.col("issued")))
        .withColumn("k_author", author)
    )


def title_evidence(a: str, b: str) -> Column:
    """For equal titles: equal years, or equal first authors, or none of the four known."""
    col = lambda side, k: F.col(f"{side}.{k}")
    none = F.lit(True)
    for side in (a, b):
        none = none & col(side, "k_year").isNull() & col(side, "k_author").isNull()
    same = F.coalesce(col(a, "k_year") == col(b, "k_year"), F.lit(False)) | F.coalesce(col(a, "k_author") == col(b, "k_author"), F.lit(False))
    return same | none


def matching_pairs(left: DataFrame, right: DataFrame, within: list[str], extra: Column | None = None) -> DataFrame:
    """DUP-1: distinct (within..., a_pos, b_pos) of rows that match. left and right have match_keys() and pos.

    Equal DOIs and equal titles are two joins on equality, so both are hash or merge joins.
    """
    a, b = left.select(*within, "pos", *KEYS).alias("a"), right.select(*within, "pos", *KEYS).alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in within]
    more = F.lit(True) if extra is None else extra
    by_doi = a.join(b, reduce(lambda x, y: x & y, [*same, F.col("a.k_doi") == F.col("b.k_doi")])).where(more)
    by_title = a.join(b, reduce(lambda x, y: x & y, [*same, F.col("a.k_title") == F.col("b.k_title")])).where(more & title_evidence("a", "b"))
    pick = [*[F.col(f"a.{k}").alias(k) for k in within], F.col("a.pos").alias("a_pos"), F.col("b.pos").alias("b_pos")]
    return by_doi.select(*pick).unionByName(by_title.select(*pick)).distinct()


def held_keys(citations: DataFrame, *within: str) -> DataFrame:
    """(within..., pos, key): the keys by which rows match, one row each. Rows without any do not come."""
    sign = "\x01"  # no normalised field holds it
    title, year, author = F.col("k_title"), F.col("k_year").cast("string"), F.col("k_author")
    key = lambda kind, *parts: F.concat(F.lit(kind), *[x for p in parts for x in (F.lit(sign), p)])
    alone = F.when(year.isNull() & author.isNull(), key("t", title))
    keys = F.array_compact(F.array(key("d", F.col("k_doi")), key("y", title, year), key("a", title, author), alone))
    return match_keys(citations).select(*within, "pos", F.explode(keys).alias("key"))


def first_duplicates(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """DUP-2: each incoming row that matches a stored one, with the position of the first that it matches.

    A window over each key's rows tells its first stored one: nothing is joined, so nothing is broadcast. Where both sides are
    one table its keys are made once, and where that is dealt by bibliography already nothing is dealt anew.
    """
    held = held_keys(incoming, "bibliography_id").withColumn("_in", F.lit(True))
    if incoming is existing:
        held = held.withColumn("_at", F.col("pos"))
    else:
        stored = held_keys(existing, "bibliography_id").withColumn("_in", F.lit(False)).withColumn("_at", F.col("pos"))
        held = held.withColumn("_at", F.lit(None).cast(stored.schema["pos"].dataType)).unionByName(stored)
    of_key = Window.partitionBy("bibliography_id", "key")
    first = F.min("_at").over(of_key)
    some = F.lit(True) if incoming is existing else F.bool_or(~F.col("_in")).over(of_key)
    found = held.where("bibliography_id IS NOT NULL").select("*", first.alias("_first"), some.alias("_some")).where("_in AND _some")
    return found.groupBy("bibliography_id", "pos").agg(F.min("_first").alias("duplicate_of"))


def partition_duplicates(citations: DataFrame) -> DataFrame:
    """DUP-3: citations with ``duplicate``, by the greedy rule in the order of pos within each bibliography.

    A row is a duplicate when it matches a kept row before it; rejected rows count for nothing, so the rule
    isn't transitive. In each round a row that is the first open one of all its keys is kept, and what shares a key with it
    is rejected; a round costs windows over keys and over rows, never pairs, so copies of one record cost no more than other
    rows. There are as many rounds as the longest run of rows of which each waits for the one before. Rows that share
    no key are kept without any, and only those that share one are written. A null bibliography_id or pos keeps a row.
    """
    row, key = ["bibliography_id", "pos"], ["bibliography_id", "key"]
    of_key, of_row = Window.partitionBy(*key), Window.partitionBy(*row)
    held = held_keys(citations, "bibliography_id").where("bibliography_id IS NOT NULL AND pos IS NOT NULL")
    several = F.min("pos").over(of_key) < F.max("pos").over(of_key)
    open_ = durable(held.select(*row, "key", several.alias("_several")).where("_several").drop("_several"))
    rejected = []
    while open_.take(1):
        told = open_.withColumn("_leads", F.col("pos") == F.min("pos").over(of_key))
        told = told.withColumn("_kept", F.bool_and("_leads").over(of_row))
        # A kept row is the first of each of its keys, so a key that holds one is claimed by it.
        told = told.withColumn("_claimed", F.bool_or("_kept").over(of_key))
        told = durable(told.withColumn("_hit", F.bool_or("_claimed").over(of_row)).select(*row, "key", "_kept", "_hit"))
        gone = durable(told.where("_hit AND NOT _kept").select(*row).distinct())
        rest = durable(told.where("NOT _hit").select(*row, "key"))
        discard(open_, told)
        rejected.append(gone)
        open_ = rest
    discard(open_)
    if not rejected:
        return citations.withColumn("duplicate", F.lit(False))
    marked = reduce(DataFrame.unionByName, rejected).withColumn("duplicate", F.lit(True))
    # What is rejected grows with the data, and its files are far smaller than its rows: it is never broadcast.
    return citations.join(marked.hint("merge"), row, "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))


def repeats_of_key(citations: DataFrame, key: list[Column]) -> DataFrame:
    """The rows after the first of each key within a bibliography; rows with a null in the key never repeat."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(key)]
    rows = citations.select("*", *named)
    window = Window.partitionBy("bibliography_id", *[f"_k{i}" for i in range(len(key))]).orderBy("pos")
    known = reduce(lambda x, y: x & y, [F.col(f"_k{i}").isNotNull() for i in range(len(key))])
    placed = rows.where(known).withColumn("_n", F.row_number().over(window)).where("_n > 1")
    return placed.drop("_n", *[f"_k{i}" for i in range(len(key))])
