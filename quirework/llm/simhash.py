"""Operator 9: SimHash near-duplicates by an index of byte positions with count filtering.

A fingerprint has 64 bits, eight bytes. Two of them that differ in at most four bits agree in at least
four bytes. The index posts each fingerprint under 20 sets of three byte positions with the bytes there, chosen
so that any four positions hold one of the sets. A pair's shared positional bytes are tallied; it is retained
with four or more, at the first set that it shares, and its bits are compared. Equal fingerprints are collapsed
before and expanded after, so copies make no pairs.

A posting with more than ``DENSE`` fingerprints is not paired off. Its members agree in three bytes; two
of them differ in at most four bits of the other 40 just when some 40-bit value lies within two bits of
both. Each member lists the 821 values within two bits of its own, and all that list a value link to the
smallest that does: exact links, a fixed number per member, no pairs. With more than ``MANY`` fingerprints all
70 sets of four positions are used instead, so that postings stay short.

Defined results: a null text counts as empty; texts without words have fingerprint zero and are linked
like any other; rows that repeat are each reported; an empty table gives an empty table. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm.components import connected
from quirework.llm.common import carried, compact, durable, in_small_batches, one_of_each, raw_print, restored

SHINGLE = 4
BITS = 4
#: Fingerprints that one posting pairs off at most; denser ones link through shared neighbours.
DENSE = 256
#: Distinct fingerprints from which on sets of four positions are used.
MANY = 50_000_000


def position_sets(of_four: bool = False) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any four of the eight positions hold one of them."""
    if of_four:
        return list(combinations(range(8), 8 - BITS))
    # Turan's construction: three classes in a ring; a set lies in one class or has two of it and one of the next.
    classes = [(0, 1, 2), (3, 4, 5), (6, 7)]
    sets = [c for group in classes for c in combinations(group, 3)]
    for k, group in enumerate(classes):
        sets += [(*pair, other) for pair in combinations(group, 2) for other in classes[(k + 1) % 3]]
    return [tuple(sorted(s)) for s in sets]


def fingerprint(text: bytes, seed: int = 42) -> int:
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.fromiter(map(len, words), np.int64, len(words)).cumsum() + np.arange(len(words))
    n = max(1, len(words) - SHINGLE + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        ones += np.unpackbits(hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, print, fp): fp is the fingerprint as a signed long, print names the row's text."""

    def scan(batches):
        for batch in batches:
            prints = [fingerprint(t.encode("utf-8", "surrogatepass")) if isinstance(t, str) else 0 for t in batch.pop("text")]
            yield batch.assign(fp=np.array(prints, np.uint64).astype(np.int64))

    rows = carried(in_small_batches(docs), raw_print(docs).alias("print"), docs["text"])
    return restored(rows.mapInPandas(scan, "doc_id long, no_id boolean, print long, fp long"))


def _mask(positions) -> int:
    value = sum(0xFF << (56 - 8 * p) for p in positions)
    return value - (1 << 64) if value >= 1 << 63 else value


def _shared(diff: Column) -> list[Column]:
    return [diff.bitwiseAND(F.lit(_mask([p]))) == 0 for p in range(8)]


def fingerprint_links(fps: DataFrame, of_four: bool = False) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect all pairs within BITS bits."""
    sets = position_sets(of_four)
    masks = F.array(*[F.lit(_mask(s)) for s in sets])
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings = (
        fps.select("fp")
        .repartition(tasks)
        .select("fp", F.posexplode(masks).alias("set", "mask"))
        .select("fp", "set", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    )
    sizes = durable(postings.groupBy("set", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    sparse = postings.join(sizes.where(F.col("n") <= DENSE), ["set", "key"]).select("set", "key", "fp")
    diff = F.col("a").bitwiseXOR(F.col("b"))
    tally = sum((x.cast("int") for x in _shared(diff)), F.lit(0))
    first = F.coalesce(*[F.when(diff.bitwiseAND(F.lit(_mask(s))) == 0, F.lit(k)) for k, s in enumerate(sets)])
    pairs = (
        sparse.withColumnRenamed("fp", "a")
        .join(sparse.withColumnRenamed("fp", "b"), ["set", "key"])
        .where((F.col("a") < F.col("b")) & (tally >= 8 - BITS) & (F.bit_count(diff) <= BITS) & (F.col("set") == first))
        .select("a", "b")
    )
    dense_sizes = sizes.where(F.col("n") > DENSE)
    if not dense_sizes.take(1):
        return pairs
    dense = postings.join(dense_sizes, ["set", "key"])
    near = dense.select("set", "key", "fp", F.explode(_around(F.col("fp"), F.col("set"), sets)).alias("value"))
    hubs = near.groupBy("set", "key", "value").agg(F.min("fp").alias("a"), F.max("fp").alias("_z"))
    hubs = hubs.where("a < _z").select("set", "key", "value", "a")
    stars = near.join(hubs, ["set", "key", "value"]).where("a < fp").select("a", F.col("fp").alias("b")).distinct()
    return pairs.unionByName(stars)


def _around(fp: Column, which: Column, sets: list[tuple[int, ...]]) -> Column:
    """fp and all values that differ from it in one or two bits outside the bytes of the position set."""
    free = F.array(*[F.array(*[F.lit(_bit(8 * (7 - p) + i)) for p in range(8) if p not in s for i in range(8)]) for s in sets])
    bits = F.element_at(free, which + 1)
    one = F.transform(bits, lambda x: fp.bitwiseXOR(x))
    two = F.flatten(
        F.transform(bits, lambda x, i: F.transform(F.slice(bits, i + 2, F.size(bits)), lambda y: fp.bitwiseXOR(x).bitwiseXOR(y)))
    )
    return F.concat(F.array(fp), one, two)


def _bit(n: int) -> int:
    return 1 << n if n < 63 else -(1 << 63)


def _rooted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents' fingerprints, and (fp, least, root) of each distinct one: its component is named by root."""
    prints = compact(fingerprints(docs))
    classes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = connected(fingerprint_links(classes.select("fp"), classes.count() > MANY))
    roots = classes.join(labels, classes["fp"] == labels["node"], "left")
    return prints, durable(roots.select("fp", "least", F.coalesce("root", "fp").alias("root")))


def simhash_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    prints, roots = _rooted(docs)
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = durable(roots.join(least, "root").select("fp", "component_id"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(named, "fp").select("doc_id", text, "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each component with all its columns: the one with the smallest doc_id, nulls last.

    Rows of one doc_id with unlike texts are documents of their own; of rows that repeat all through one stays. Texts
    without words are one component. An empty table gives an empty table.
    """
    prints, roots = _rooted(docs)
    members = durable(prints.join(roots.select("fp", "root"), "fp").select("doc_id", "print", "root"))
    return one_of_each(docs, members, "root")
