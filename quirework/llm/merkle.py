"""Operator 12: a Merkle manifest of a dataset, with proofs by coordinate lookup, in DataFrame functions only.

Every document is a leaf, the digest of its fields. Leaves of a source ascend by doc_id and are hashed in runs of
three, level by level, to the source's subroot; subroots, ordered by source, are hashed likewise to the root. All
nodes are written as a table of coordinates (tree, level, idx). A proof is looked up there: the siblings that a leaf
needs follow from its index and the number of leaves alone; these coordinates are exploded, joined to the node table,
ordered, concatenated and folded.

Trees are built and looked up in strata of six levels: a stratum's blocks have at most 729 members, and siblings
above a stratum are the same for a whole block, so they are looked up once for a block and handed down. So no node,
near the root or not, is joined by more than 729 rows, whatever the size of a source.

Defined results: a null field is hashed as ``-``, apart from an empty one; a null doc_id comes first and is not
tampered with; rows that repeat a doc_id are ordered by their leaf, and rows that repeat wholly are leaves each;
a null source is a source, the first; an empty table gives an empty table. Columns other than the five are ignored,
whatever their names. Texts are hashed whole, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import discard, durable
from quirework.llm.ranks import ranked

#: Members of a run, and levels of a stratum.
RUN, STRATUM = 3, 6
BLOCK = RUN**STRATUM
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(*values: Column) -> Column:
    """sha256 of the values' concatenation; of nothing where there are none."""
    return F.sha2(F.concat(*values) if values else F.lit(""), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(docs: DataFrame, text: Column) -> Column:
    return digest_of(*[field(text if name == "text" else docs[name]) for name in FIELDS])


def without_newlines(docs: DataFrame) -> Column:
    """The text as an intruder leaves it: without newlines where the checksum of doc_id is even, else as it is."""
    even = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(docs["text"], F.lit("\n"), F.lit(""))).otherwise(docs["text"])


def heights(n: str) -> str:
    """SQL of the levels above the leaves of a tree of n leaves."""
    powers = ", ".join(f"{RUN**k}L" for k in range(39))
    return f"size(filter(array({powers}), p -> p < {n}))"


def _runs(digests: Column) -> Column:
    """The digests one level up, in order."""
    starts = F.sequence(F.lit(1), F.size(digests), F.lit(RUN))
    return F.transform(starts, lambda at: digest_of(F.array_join(F.slice(digests, at, RUN), "")))


def trees(leaves: DataFrame) -> list[DataFrame]:
    """The node table of all trees, a written part for each stratum: (tree, n, level, idx, digest).

    leaves: (tree, n, idx, digest) as text, idx from 0 to n - 1. The part of a stratum holds its levels but, from the second
    on, the lowest, which is the highest of the part below. The last node of a tree, its root, has the level heights(n).
    """
    parts, units, base = [], leaves, 0
    while True:
        blocks = units.groupBy("tree", "n", F.expr(f"idx div {BLOCK}").alias("_block"))
        members = blocks.agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("_m"))
        lowest = F.array(F.transform("_m", lambda m: m["digest"]))
        grown = F.aggregate(F.sequence(F.lit(1), F.lit(STRATUM)), lowest, lambda up, _: F.concat(up, F.array(_runs(F.element_at(up, -1)))))
        levels = members.select("tree", "n", "_block", F.posexplode(grown).alias("_k", "_nodes"))
        levels = levels.where((F.lit(base) + F.col("_k") <= F.expr(heights("n"))) & (F.lit(base == 0) | (F.col("_k") > 0)))
        nodes = levels.select("tree", "n", (F.col("_k") + base).alias("level"), "_block", "_k", F.posexplode("_nodes").alias("_at", "_hex"))
        first = F.expr(f"_block * element_at(array({', '.join(f'{RUN ** (STRATUM - k)}L' for k in range(STRATUM + 1))}), _k + 1)")
        parts.append(durable(nodes.select("tree", "n", "level", (first + F.col("_at")).alias("idx"), F.unhex("_hex").alias("digest"))))
        base += STRATUM
        tallest = parts[0].agg(F.max(F.expr(heights("n")))).first()[0]
        if tallest is None or tallest <= base:
            return parts
        above = parts[-1].where((F.col("level") == base) & (F.expr(heights("n")) > base))
        units = above.select("tree", "n", "idx", F.lower(F.hex("digest")).alias("digest"))


def roots(parts: list[DataFrame]) -> DataFrame:
    """(tree, digest as text) of the root of each tree."""
    nodes = parts[0]
    for part in parts[1:]:
        nodes = nodes.unionByName(part)
    return nodes.where(F.col("level") == F.expr(heights("n"))).select("tree", F.lower(F.hex("digest")).alias("digest"))


def _siblings(base: int) -> Column:
    """(level, place in the level) of the siblings that a node idx of level ``base`` needs within its stratum."""
    found = []
    for k in range(STRATUM):
        own, here = f"(idx div {RUN**k})", f"({heights('n')} > {base + k})"
        width = f"((n + {RUN ** (base + k)}L - 1) div {RUN ** (base + k)}L)"
        run = ", ".join(f"{own} div {RUN} * {RUN} + {j}" for j in range(RUN))
        kept = f"filter(array({run}), s -> {here} and s <> {own} and s < {width})"
        found.append(f"transform({kept}, s -> struct({base + k} as level, s as sibling))")
    return F.expr(f"concat({', '.join(found)})")


def _segments(units: DataFrame, nodes: DataFrame, base: int) -> DataFrame:
    """(tree, n, _block, idx, rows, steps) of units (tree, n, idx, row): what stands left and right of each one's path in a stratum.

    One look-up per sibling: its coordinates are joined to the nodes. ``rows`` holds the unit's own row or null.
    """
    asked = units.select("tree", "n", "idx", F.explode(_siblings(base)).alias("_at")).select("tree", "n", "idx", "_at.*")
    keyed = nodes.select("tree", "level", F.col("idx").alias("sibling"), "digest")
    told = asked.join(keyed, ["tree", "level", "sibling"])
    block = F.expr(f"idx div {BLOCK}").alias("_block")
    own = units.select("tree", "n", block, "idx", F.lit(None).cast("struct<level:int,sibling:bigint,digest:binary>").alias("_node"), "row")
    node = F.struct(F.col("level").cast("int").alias("level"), "sibling", "digest").alias("_node")
    gathered = own.unionByName(told.select("tree", "n", block, "idx", node, F.lit(None).cast(units.schema["row"].dataType).alias("row")))
    # A block's rows stay together for the join with what its block needs further up.
    gathered = gathered.repartition("tree", "_block").groupBy("tree", "n", "_block", "idx")
    gathered = gathered.agg(F.array_sort(F.collect_list("_node")).alias("_nodes"), F.max("row").alias("row"))

    def side(sign: str, k: int) -> str:
        wanted = f"filter(_nodes, x -> x.level = {base + k} and x.sibling {sign} idx div {RUN**k})"
        return f"array_join(transform({wanted}, x -> lower(hex(x.digest))), '')"

    steps = ", ".join(f"struct({side('<', k)} as left, {side('>', k)} as right)" for k in range(STRATUM))
    taken = f"slice(array({steps}), 1, greatest(0, least({STRATUM}, {heights('n')} - {base})))"
    return gathered.select("tree", "n", "_block", "idx", "row", F.expr(taken).alias("steps"))


def proofs(leaves: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """(tree, idx, row, steps) of leaves (tree, n, idx, row): the path's neighbours, level by level up to the tree's root."""
    above = None
    for k in reversed(range(len(parts))):
        base = k * STRATUM
        if k:
            blank = F.lit(None).cast("struct<none:int>").alias("row")
            units = parts[k - 1].where((F.col("level") == base) & (F.expr(heights("n")) > base)).select("tree", "n", "idx", blank)
        else:
            units = leaves
        # A stratum's lowest level is the highest of the part below.
        nodes = parts[k].unionByName(parts[k - 1].where(F.col("level") == base)) if k else parts[k]
        own = _segments(units, nodes, base)
        if k + 1 < len(parts):
            own = own.join(above, ["tree", "_block"], "left")
            own = own.withColumn("steps", F.concat("steps", F.coalesce("_upper", F.expr("slice(steps, 1, 0)"))))
        above = own.select("tree", F.col("idx").alias("_block"), F.col("steps").alias("_upper"))
        above = durable(above) if k else above
    return own.select("tree", "idx", "row", "steps")


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; and source, idx, n_siblings."""
    leaf, forged = leaf_digest(docs, docs["text"]), leaf_digest(docs, without_newlines(docs))
    fields = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].alias("source"), leaf.alias("leaf"), forged.alias("forged"))
    # Rows that repeat wholly are told apart by where they were read, so that no range of the order is larger for them.
    written = durable(fields.withColumn("forged", F.expr("nullif(forged, leaf)")).withColumn("_salt", F.monotonically_increasing_id()))
    placed = ranked(written, "source", "doc_id", "leaf", "_salt")
    discard(written)
    sources = durable(placed.groupBy("source").agg(F.min("rank").alias("tree"), F.count(F.lit(1)).alias("n")).withColumnRenamed("source", "_of"))
    leaves = placed.join(sources, placed["source"].eqNullSafe(sources["_of"]))
    leaves = leaves.select("tree", "n", (F.col("rank") - F.col("tree")).alias("idx"), F.struct("doc_id", "source", "leaf", "forged").alias("row"))
    parts = trees(leaves.select("tree", "n", "idx", F.col("row.leaf").alias("digest")))
    subroots = durable(roots(parts).withColumnRenamed("digest", "subroot"))
    # A tree's number is the place of its first leaf, so trees are numbered in the order of their sources.
    upper = ranked(subroots, "tree")
    count = subroots.count()
    tops = upper.select(F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), F.col("rank").alias("idx"), "subroot", F.col("tree").alias("of"))
    top_parts = trees(tops.select("tree", "n", "idx", F.col("subroot").alias("digest")))
    top_steps = proofs(tops.select("tree", "n", "idx", F.struct("of", "subroot").alias("row")), top_parts)
    top_steps = durable(top_steps.select(F.col("row.of").alias("tree"), F.col("row.subroot").alias("subroot"), F.col("steps").alias("_top")))
    root = durable(roots(top_parts).select(F.col("digest").alias("root"))).first()
    proved = proofs(leaves, parts).join(top_steps, "tree")
    proved = proved.select("row.*", "idx", "subroot", F.lit(root["root"] if root else None).cast("string").alias("root"), F.concat("steps", "_top").alias("steps"))
    beside = F.array_join(F.transform("steps", lambda step: F.concat(step["left"], step["right"])), "")
    start = F.coalesce("forged", "leaf")
    folded = F.aggregate("steps", start, lambda digest, step: digest_of(step["left"], digest, step["right"]))
    out = proved.select("doc_id", "leaf", "subroot", "root", digest_of(beside).alias("proof_sha256"), folded.alias("folded_root"), "source", "idx", (F.length(beside) / 64).cast("int").alias("n_siblings"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
