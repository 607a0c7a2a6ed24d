"""Operator 11: main text of pages, by marks of the article and by differencing each page with those of nearest URL.

Pages of a host are put in the order of their URL paths, so that a page's neighbours are those which share most of its
path. Each page is paired with the one before and the one after; all blocks of a pair are aligned by a longest common
subsequence, and shared blocks are deleted. Every page goes this way. An exact check of what is left and what was deleted follows: what
stands in an element that marks the article (``article``, ``main``, or else a class or id that says so) is the page's own, also where a
copy of it is near, and is restored; what stands in menus, headers, footers, sidebars, notices, adverts, forms and reader comments is
dropped, and so is all outside the article of a page that marks one. On pages which mark no article the pairs alone decide on what no
frame holds. A pair that shares ``COPY`` of the shorter page's text, frames not counted, is one of copies, and deletes nothing; nor does a
block that stands in the other page's marked article.

Defined results: null and empty html give an empty text; a page whose url is null or has no host has no pair; rows that repeat
are read alike, once in the pairing; a page alone on its host keeps all that no mark drops; an empty table gives an empty
table. Columns other than page_id, url and html are ignored, whatever their names. Pages are read whole, in linear time, and the
alignment of long ones needs bounded memory. All Unicode white space counts as such.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import durable, in_small_batches
from quirework.llm.html_blocks import FRAME, MAIN, OPEN, blocks_of
from quirework.llm.ranks import ranked

#: Share of the shorter page's text that makes two pages copies.
COPY = 0.8
#: Pages that are aligned in one group, beside one more at each end.
TOGETHER = 256
#: Bits of one alignment that are held at once.
HELD = 2**28

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def _rows(a: list, b: list) -> list[int]:
    """For each line of a, the bits of b's lines at which the longest common subsequence with a's lines so far does not grow."""
    places: dict = {}
    for j, line in enumerate(b):
        places[line] = places.get(line, 0) | 1 << j
    every = (1 << len(b)) - 1
    now, rows = every, []
    for line in a:
        hit = now & places.get(line, 0)
        now = ((now + hit) | (now - hit)) & every
        rows.append(now)
    return rows


def _grown(a: list, b: list) -> np.ndarray:
    """Length of the longest common subsequence of a and each beginning of b, from none to all of it."""
    last = (_rows_last(a, b)).to_bytes((len(b) + 7) // 8, "little")
    bits = np.unpackbits(np.frombuffer(last, np.uint8), count=len(b), bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _rows_last(a: list, b: list) -> int:
    places: dict = {}
    for j, line in enumerate(b):
        places[line] = places.get(line, 0) | 1 << j
    every = (1 << len(b)) - 1
    now = every
    for line in a:
        hit = now & places.get(line, 0)
        now = ((now + hit) | (now - hit)) & every
    return now


def common_subsequence(a: list, b: list) -> list[tuple[int, int]]:
    """Places (in a, in b) of a longest common subsequence, ascending; lines are compared as bits, HELD of them at once."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    found = [(k, k) for k in range(start)]
    here, there = set(a), set(b)
    at_a = [k for k in range(start, len(a) - end) if a[k] in there]
    at_b = [k for k in range(start, len(b) - end) if b[k] in here]
    left, right = [a[k] for k in at_a], [b[k] for k in at_b]
    if left and right:
        if len(left) > 1 and len(left) * len(right) > HELD:
            half = len(left) // 2
            before, after = _grown(left[:half], right), _grown(left[half:][::-1], right[::-1])[::-1]
            cut = int(np.argmax(before + after))
            inner = common_subsequence(left[:half], right[:cut])
            inner += [(i + half, j + cut) for i, j in common_subsequence(left[half:], right[cut:])]
        else:
            rows, inner, i, j = _rows(left, right), [], len(left), len(right)
            while i and j:
                if rows[i - 1] >> (j - 1) & 1:
                    j -= 1
                else:
                    i -= 1
                    if not i or rows[i - 1] >> (j - 1) & 1:
                        j -= 1
                        inner.append((i, j))
            inner.reverse()
        found += [(at_a[i], at_b[j]) for i, j in inner]
    return found + [(len(a) - k, len(b) - k) for k in range(end, 0, -1)]


def shared_blocks(one: list[int], other: list[int], sizes: list[int], other_sizes: list[int]) -> list[tuple[int, int]]:
    """Places of the blocks that two pages share, in each; none where the pages are copies."""
    pairs = common_subsequence(one, other)
    return [] if sum(sizes[i] for i, _ in pairs) >= COPY * min(sum(sizes), sum(other_sizes)) else pairs


def read_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, key, lines, sizes, main): of all blocks of each page the digests, the sizes (none of a frame's), and whether the article holds them."""

    def scan(batches):
        for batch in batches:
            lines, sizes, main = [], [], []
            for page in batch.column("html").to_pylist():
                blocks = blocks_of(page)
                lines.append([xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63 for text, _ in blocks])
                sizes.append([0 if part == FRAME else len(text) for text, part in blocks])
                main.append([part == MAIN for _, part in blocks])
            columns = [pa.array(lines, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())), pa.array(main, pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("page_id", "url", "key")], *columns], names=["page_id", "url", "key", "lines", "sizes", "main"]
            )

    return _fields(pages).mapInArrow(scan, "page_id long, url string, key long, lines array<long>, sizes array<int>, main array<boolean>")


def _fields(pages: DataFrame) -> DataFrame:
    fields = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")]
    return in_small_batches(pages).select(*fields, F.xxhash64("page_id", "url", "html").alias("key"))


def checked_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, url, key, marked, texts, places): the blocks that the check may let pass, with their places among all blocks of the page.

    Of a page that marks its article those in it, of another those that no frame holds.
    """

    def scan(batches):
        for batch in batches:
            marked, texts, places = [], [], []
            for page in batch.column("html").to_pylist():
                blocks = blocks_of(page)
                own = any(part == MAIN for _, part in blocks)
                passed = [k for k, (_, part) in enumerate(blocks) if part == (MAIN if own else OPEN)]
                marked.append(own)
                texts.append([blocks[k][0] for k in passed])
                places.append(passed)
            columns = [pa.array(marked, pa.bool_()), pa.array(texts, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("page_id", "url", "key")], *columns], names=["page_id", "url", "key", "marked", "texts", "places"]
            )

    return _fields(pages).mapInArrow(scan, "page_id long, url string, key long, marked boolean, texts array<string>, places array<int>")


def differences(read: DataFrame) -> DataFrame:
    """(page_id, key, own) of each page that has a host: for each block whether no page of nearest URL shares it."""
    host, path = F.lower(F.regexp_extract("url", HOST, 1)), F.regexp_extract("url", PATH, 1)
    lone = read.withColumn("host", host).where("host <> ''").withColumn("path", path)
    lone = lone.groupBy("host", "path", "page_id", "key").agg(*[F.first(c).alias(c) for c in ("lines", "sizes", "main")])
    placed = ranked(durable(lone), "host", "path", "page_id", "key")
    group = F.expr(f"rank div {TOGETHER}")
    # The first page of a group is also the group's before, and its last the group's after.
    nearby = F.array_distinct(F.array(group, F.greatest(F.lit(0).cast("long"), F.expr(f"(rank - 1) div {TOGETHER}")), F.expr(f"(rank + 1) div {TOGETHER}")))
    dealt = placed.withColumn("home", group).select("*", F.explode(nearby).alias("together"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank").reset_index(drop=True)
        pages = list(rows.itertuples())
        lines, sizes, main = [[getattr(p, k).tolist() for p in pages] for k in ("lines", "sizes", "main")]
        own = [[True] * len(held) for held in lines]
        for k, (one, other) in enumerate(zip(pages, pages[1:], strict=False)):
            if one.host != other.host or other.rank != one.rank + 1:
                continue
            for i, j in shared_blocks(lines[k], lines[k + 1], sizes[k], sizes[k + 1]):
                own[k][i] &= main[k + 1][j]
                own[k + 1][j] &= main[k][i]
        rows = rows.assign(own=own)
        # What a group's neighbours say of its ends is said in the group's own rows: each has the pages on both sides.
        rows = rows[rows["home"] == rows["together"]]
        return pd.DataFrame({"no_id": rows["no_id"], "page_id": rows["page_id"], "key": rows["key"], "own": rows["own"]})

    given = dealt.select("together", "home", "rank", "host", "lines", "sizes", "main", "key", F.col("page_id").isNull().alias("no_id"), F.coalesce("page_id", F.lit(0).cast("long")).alias("page_id"))
    told = given.groupBy("together").applyInPandas(compare, "no_id boolean, page_id long, key long, own array<boolean>")
    return told.select(F.when(~F.col("no_id"), F.col("page_id")).alias("page_id"), "key", "own")


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, marked (whether the page marks its article), n_shared (blocks that its neighbours share).

    Every page is differenced; the check then restores what the page marks as its article.
    """
    told = durable(differences(durable(read_pages(pages)))).withColumnsRenamed({"page_id": "_id", "key": "_key"})
    rows = checked_blocks(pages)
    # Neither side is small enough to be broadcast.
    rows = rows.join(told.hint("merge"), rows["page_id"].eqNullSafe(told["_id"]) & (rows["key"] == told["_key"]), "left")
    kept = F.filter("texts", lambda _, k: F.coalesce(F.get("own", F.get("places", k)), F.lit(True)) | F.col("marked"))
    shared = F.when(F.col("own").isNull(), 0).otherwise(F.size(F.filter("own", lambda own: ~own))).cast("long")
    out = rows.select("page_id", "url", F.array_join(kept, "\n").alias("text"), "marked", shared.alias("n_shared"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "marked", "n_shared")
