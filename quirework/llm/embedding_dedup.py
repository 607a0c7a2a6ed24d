"""Operator 6: near-duplicate embeddings by E8 lattice hashing.

Unit vectors are projected to eight dimensions by a random matrix for each table and decoded to the nearest
point of the E8 lattice. Each vector is posted under its point; each also asks at the ``PROBES`` neighbouring
points nearest to it. Vectors that meet, with equal labels, are compared by cosine in double precision.

Equal vectors with equal labels are collapsed to one class before and expanded after, so copies make no
pairs. A class is known by the digest of its label and vector, whatever ids its rows have. Every vector of every size is
indexed; recall against brute force is measured in the tests, also for pairs at the very threshold.

Defined results: vectors or labels that are null, vectors without length, and vectors with null or
non-finite components link with nothing; vectors of unequal length never meet; labels of any type are compared as
they are written, so '01' is not '1'; rows that share a vec_id, or have none, are rows of their own; component_id is
null only where no row of the component has an id; an empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import durable, in_small_batches
from quirework.llm.components import connected

#: Of pairs whose cosine is the least that links, these find all but fewer than one in thousands (tests).
TABLES = 6
PROBES = 8
#: Lattice cells per unit of projected length.
SCALE = 1.3
LEAST = 0.98
SEED = 20


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        v = np.array([0.5 if bits >> k & 1 else -0.5 for k in range(8)])
        if (v < 0).sum() % 2 == 0:
            out.append(v)
    return np.array(out)


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    near = np.rint(x)
    miss = x - near
    worst = np.abs(miss).argmax(1)
    rows = np.arange(len(x))
    odd = near.sum(1) % 2 != 0
    step = np.where(miss[rows, worst] >= 0, 1.0, -1.0)
    near[rows[odd], worst[odd]] += step[odd]
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, which is D8 and D8 moved by one half in every coordinate."""
    whole, half = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(1) < ((x - whole) ** 2).sum(1)
    return np.where(closer[:, None], half, whole)


def _keys(points: np.ndarray) -> np.ndarray:
    """A 64-bit name of each lattice point (last axis); points that share a name by chance are told apart by cosine."""
    doubled = np.rint(points * 2).astype(np.int64).astype(np.uint64)
    name = np.full(doubled.shape[:-1], 1469598103934665603, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(8):
            name = (name ^ doubled[..., k]) * np.uint64(0x9E3779B97F4A7C15)
            name ^= name >> np.uint64(29)
    return name.astype(np.int64)


def postings(classes: DataFrame, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(class_id, of, at, key, home): home marks a vector's own cell, the others are cells that it asks at."""
    shortest = _shortest()

    def project(batches):
        for batch in batches:
            if not len(batch):
                continue
            sizes = batch["embedding"].map(len)
            for size, part in batch.groupby(sizes.to_numpy()):
                x = np.array(part["embedding"].tolist(), float).reshape(len(part), int(size))
                # Divided twice, so that the squares of very long or short vectors stay finite.
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for at in range(tables):
                    rng = np.random.default_rng([SEED, at, int(size)])
                    y = x @ rng.standard_normal((int(size), 8)) * SCALE + rng.random(8)
                    home = nearest_e8(y)
                    near = np.argsort(-((y - home) @ shortest.T), axis=1, kind="stable")[:, :probes]
                    cells = np.concatenate([home[:, None, :], home[:, None, :] + shortest[near]], axis=1)
                    names, wide = _keys(cells), probes + 1
                    yield pd.DataFrame(
                        {
                            "class_id": np.repeat(part["class_id"].to_numpy(), wide),
                            "of": np.repeat(part["of"].to_numpy(), wide),
                            "at": np.int32(at),
                            "key": names.ravel(),
                            "home": np.tile(np.arange(wide) == 0, len(part)),
                        }
                    )

    # A hash of the label keeps others' vectors apart; the labels themselves are compared with the vectors.
    rows = classes.select("class_id", F.xxhash64("label").alias("of"), "embedding")
    return in_small_batches(rows).mapInPandas(project, "class_id long, of long, at int, key long, home boolean")


def cosine(x: pd.Series, y: pd.Series) -> pd.Series:
    """In double precision; below every threshold for vectors of unequal length. One pass for all pairs of one length."""
    out = np.full(len(x), -2.0)
    sizes, others = x.map(len).to_numpy(), y.map(len).to_numpy()
    for size in np.unique(sizes[sizes == others]):
        these = np.flatnonzero((sizes == size) & (others == size))
        u, v = (np.stack(s.to_numpy()[these]).astype(float, copy=False) for s in (x, y))
        u, v = (m / np.abs(m).max(axis=1, keepdims=True) for m in (u, v))
        dot = np.einsum("ij,ij->i", u, v)
        out[these] = dot / (np.sqrt(np.einsum("ij,ij->i", u, u)) * np.sqrt(np.einsum("ij,ij->i", v, v)))
    return pd.Series(out)


def class_links(classes: DataFrame, least: float = LEAST, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(a, b): classes a < b whose vectors meet in some table and have cosine >= least."""
    posted = postings(classes, tables, probes)
    homes = posted.where("home").select("of", "at", "key", F.col("class_id").alias("p"))
    asks = posted.select("of", "at", "key", F.col("class_id").alias("q"))
    met = homes.join(asks, ["of", "at", "key"]).where("p <> q")
    pairs = met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    left = classes.select(F.col("class_id").alias("a"), F.col("label").alias("_s"), F.col("embedding").alias("x"))
    right = classes.select(F.col("class_id").alias("b"), F.col("label").alias("_t"), F.col("embedding").alias("y"))
    same = pairs.join(left, "a").join(right, "b").where("_s = _t")
    return same.where(F.pandas_udf(cosine, "double")("x", "y") >= least).select("a", "b")


def embedding_components(vectors: DataFrame, least: float = LEAST, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    e = vectors["embedding"]
    wide = F.transform(e, lambda v: v.cast("double"))
    sound = (
        vectors["label"].isNotNull()
        & e.isNotNull()
        & F.forall(wide, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
        & F.exists(wide, lambda v: v != 0)
    )
    # 0.0 and -0.0 are one value: adding 0.0 makes them equal.
    values = F.transform(wide, lambda v: v + F.lit(0.0)).alias("embedding")
    rows = vectors.select(vectors["vec_id"], vectors["label"].cast("string").alias("label"), values, F.coalesce(sound, F.lit(False)).alias("_ok"))
    rows = rows.withColumn("_digest", F.when(F.col("_ok"), F.sha2(F.to_json(F.struct("label", "embedding")), 256)))
    sound_rows = rows.where("_ok")
    members = durable(sound_rows.select("vec_id", "_digest"))
    # Numbered as they are written: what is read again has the same numbers each time.
    classes = durable(
        sound_rows.groupBy("_digest")
        .agg(
            F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("members"),
            F.first("label").alias("label"), F.first("embedding").alias("embedding"),
        )
        .withColumn("class_id", F.monotonically_increasing_id())
    )
    links = durable(class_links(classes.select("class_id", "label", "embedding"), least, tables, probes))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weights = classes.select(F.col("class_id").alias("b"), "members")
    beyond = both.join(weights, "b").groupBy("a").agg(F.sum("members").alias("beyond"))
    labels = connected(links)
    names = classes.select("_digest", "class_id", "least", "members")
    rooted = durable(
        names.join(beyond, names["class_id"] == beyond["a"], "left")
        .join(labels, names["class_id"] == labels["node"], "left")
        .select(
            "_digest",
            (F.col("members") - 1 + F.coalesce("beyond", F.lit(0))).cast("long").alias("n_links"),
            F.coalesce("root", "class_id").alias("root"),
            "least",
        )
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    told = durable(rooted.join(smallest, "root").select("_digest", "n_links", "component_id"))
    linked = members.join(told, "_digest").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("_ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
