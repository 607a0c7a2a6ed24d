"""Operator 7: exact deduplication by progressive refinement, in DataFrame functions only.

Rows are grouped by length, then by a hash of their first characters, then by a full digest; only rows that
share length and prefix with another go on to the last step. Texts are equal when they are identical after
each run of white space becomes one space, so a length is known only once the whole text was read: one pass
over the texts writes length, prefix hash and digest (some 60 bytes a row), and the steps read those.

Defined results: a null text counts as empty; empty texts equal each other; the smallest doc_id
of a group stays (a null doc_id only if the group has no other); rows that repeat one doc_id with
the same text count separately in ``group_size`` and share their decision in ``exact_dedup``, while
``drop_exact_copies`` keeps one of them; an empty table gives an empty table. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import SPACES, durable, let, one_of_each, raw_print


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def scanned(docs: DataFrame, prefix: int = 256) -> DataFrame:
    """(doc_id, print, size, head, digest) of every row, written: the only reading of texts."""
    told = let(
        normalised(docs["text"]),
        lambda t: F.struct(
            F.length(t).alias("size"), F.xxhash64(F.substring(t, 1, prefix)).alias("head"), F.sha2(t, 256).alias("digest")
        ),
    )
    rows = docs.select(docs["doc_id"], raw_print(docs).alias("print"), told.alias("_told"))
    return durable(rows.select("doc_id", "print", "_told.*"))


def exact_groups(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of every text that more than one of the scanned rows has."""
    keys = durable(rows.groupBy("size", "head").agg(F.count(F.lit(1)).alias("_n")))
    lengths = keys.groupBy("size").agg(F.sum("_n").alias("_in_size")).where("_in_size > 1").select("size")
    survivors = durable(keys.where("_n > 1").join(lengths, "size", "left_semi").select("size", "head"))
    alive = rows.join(survivors, ["size", "head"], "left_semi")
    # Written, so that a join with it has two plain shuffles and Spark can split the rows of a hot text.
    return durable(
        alive.groupBy("digest")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )


def exact_dedup(docs: DataFrame, prefix: int = 256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = scanned(docs, prefix).select("doc_id", "size", "head", "digest")
    keep_id = F.when(F.col("group_size").isNotNull(), F.col("keep_id")).otherwise(F.col("doc_id"))
    return rows.join(exact_groups(rows), "digest", "left").select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, prefix: int = 256) -> DataFrame:
    """One row of each group of equal texts, that with the smallest doc_id, with all its columns."""
    rows = scanned(docs, prefix)
    copied = durable(rows.join(exact_groups(rows).select("digest"), "digest", "left_semi").select("doc_id", "print", "digest"))
    return one_of_each(docs, copied, "digest")
