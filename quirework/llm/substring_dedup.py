"""Operator 2: substring dedup. FM-indexes, one per shard, find the windows of words that earlier documents have.

A window is 13 consecutive words. Each has an anchor, the least hash of its runs of five words, so equal
windows have equal anchors. Anchors that only one document has are left; maximal runs of windows with one
shared anchor are the segments, and they are dealt to shards by anchor: a shard holds every occurrence of each of
its windows. There a compressed FM-index is built over the words of all its documents' segments, and each segment
is streamed through it: backward search over the wavelet matrix gives matching statistics, and a window that is
matched in full gets the smallest doc_id of its interval. Words covered by a window that an earlier document has go.

Shards hold ``SHARD_BYTES`` or so. An anchor with more than ``HOT_BYTES`` of segments has shards of its own, as
many as it needs, to which its segments are dealt by document. Each finds the first document of its windows; one
row for each window and shard is then matched in a second index, and what that says goes back to the shards.

Defined results: a null text has no words; empty texts keep nothing and digest the empty string; a null
doc_id is later than all others, and two of them are not earlier than each other; nor are documents that share a
doc_id; an empty table gives an empty table. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import carried, discard, durable, in_small_batches, raw_print, release, restored
from quirework.llm.fm_index import FMIndex, matching_statistics

WINDOW = 13
GRAM = 5
#: Bytes of segments in a shard, about, and those from which on an anchor has shards of its own.
SHARD_BYTES, HOT_BYTES = 1_000_000, 250_000
#: No doc_id is larger. Where it stands for "none" a flag says so.
LAST = 2**63 - 1

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xD6E8FEB86659FD93)


def _words(text) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []


def window_anchors(words: list[bytes], window: int) -> np.ndarray:
    """The anchor of each window, as signed numbers."""
    import xxhash

    if len(words) < window:
        return np.empty(0, np.int64)
    a = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    gram = min(GRAM, window)
    with np.errstate(over="ignore"):
        g = a[: len(a) - gram + 1].copy()
        for k in range(1, gram):
            g = g * _MIX + a[k : len(a) - gram + 1 + k]
        g ^= g >> np.uint64(32)
        g *= _MIX2
        g ^= g >> np.uint64(32)
    span, width = window - gram + 1, 1
    while width * 2 <= span:
        g, width = np.minimum(g[:-width], g[width:]), width * 2
    if width < span:
        g = np.minimum(g[: len(g) - span + width], g[span - width :])
    return g.view(np.int64)


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, no_id, row, anchor) of each document's anchors, each once."""

    def scan(batches):
        for batch in batches:
            found = [np.unique(window_anchors(_words(text), window)) for text in batch.pop("text")]
            if found:
                many = batch.iloc[np.repeat(np.arange(len(batch)), [len(x) for x in found])]
                yield many.assign(anchor=np.concatenate(found))

    return docs.select("doc_id", "no_id", "row", "text").mapInPandas(scan, "doc_id long, no_id boolean, row long, anchor long")


def _shared_anchors(docs: DataFrame, window: int) -> DataFrame:
    """(row, anchors): those anchors of a document that another document has too."""
    anchors = durable(_anchors(docs, window))
    known = F.when(~F.col("no_id"), F.col("doc_id"))
    met = anchors.groupBy("anchor").agg(F.min(known).alias("a"), F.max(known).alias("z"), F.max("no_id").alias("n"))
    shared = durable(met.where("a < z or (a is not null and n)").select("anchor"))
    # Both sides are plain: Spark can split the rows of an anchor that many documents have.
    both = anchors.select("row", "anchor").join(shared, "anchor", "left_semi")
    flagged = durable(both.groupBy("row").agg(F.collect_set("anchor").alias("anchors")))
    discard(anchors, shared)
    return flagged


SEGMENT = "doc_id long, no_id boolean, row long, start long, anchor long, seg binary"


def _segments(docs: DataFrame, window: int) -> DataFrame:
    """Maximal runs of windows with one shared anchor."""

    def scan(batches):
        for batch in batches:
            rows: dict[str, list] = {k.split()[0]: [] for k in SEGMENT.split(", ")}
            ids = zip(batch["doc_id"], batch["no_id"], batch["row"], strict=True)
            for (doc_id, no_id, row), text, shared in zip(ids, batch["text"], batch["anchors"], strict=True):
                words = _words(text)
                anchors = window_anchors(words, window)
                hot = np.isin(anchors, np.asarray(shared, np.int64))
                if not hot.any():
                    continue
                cuts = np.flatnonzero(np.diff(anchors)) + 1
                begins = np.concatenate(([0], cuts))
                ends = np.concatenate((cuts, [len(anchors)]))
                keep = hot[begins]
                begins, ends = begins[keep], ends[keep]
                joined = b" ".join(words)
                stops = np.fromiter(map(len, words), np.int64, len(words)).cumsum() + np.arange(len(words))
                opens = np.concatenate(([0], stops[:-1] + 1))
                left, right = opens[begins].tolist(), stops[ends + window - 2].tolist()
                rows["seg"] += [joined[a:b] for a, b in zip(left, right, strict=True)]
                rows["start"] += begins.tolist()
                rows["anchor"] += anchors[begins].tolist()
                rows["doc_id"] += [doc_id] * len(begins)
                rows["no_id"] += [no_id] * len(begins)
                rows["row"] += [row] * len(begins)
            yield pd.DataFrame(rows)

    return docs.select("doc_id", "no_id", "row", "text", "anchors").mapInPandas(scan, SEGMENT)


class Shard:
    """All windows of some segments, matched against each other through one FM-index.

    The index holds every segment. Of equal ones the first is streamed through it, as all would get the same answer.
    """

    def __init__(self, segs: list[bytes], ids: np.ndarray, known: np.ndarray, window: int):
        number: dict[bytes, int] = {}
        kinds: dict[bytes, int] = {}
        kind = np.fromiter((kinds.setdefault(seg, len(kinds)) for seg in segs), np.int64, len(segs))
        spelled = [np.array([*(number.setdefault(w, len(number) + 1) for w in seg.split(b" ")), 0], np.int64) for seg in kinds]
        s = np.concatenate([spelled[k] for k in kind])
        sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
        lengths = sizes[kind]
        opens = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        index = FMIndex(s, len(number) + 1, window)
        holder = np.repeat(np.arange(len(segs)), lengths)[index.order]
        ids = np.where(known, ids, LAST)
        # The windows of one segment of each kind.
        one = np.empty(len(kinds), np.int64)
        one[kind[::-1]] = np.arange(len(segs))[::-1]
        counts = sizes - window
        before = np.concatenate(([0], np.cumsum(counts)[:-1]))
        at = np.repeat(opens[one] - before, counts) + np.arange(counts.sum())
        matched, lo, hi = matching_statistics(index, s, at, window)
        first, has, name = np.repeat(ids[one], counts), np.repeat(known[one], counts), -1 - np.arange(len(at))
        which = np.flatnonzero(matched == window)
        if len(which):
            ranges, back = np.unique(lo[which], return_inverse=True)
            ends = np.zeros(len(ranges), np.int64)
            ends[back] = hi[which]
            edges = np.stack([ranges, ends], 1).ravel()
            first[which] = np.minimum.reduceat(np.append(ids[holder], LAST), edges)[::2][back]
            has[which] = np.maximum.reduceat(np.append(known[holder], False), edges)[::2][back]
            name[which] = lo[which]
        #: Of each window its segment and its place there, the first document that has it, whether that has an id, and the
        #: window's name within the shard, which is not negative where it stands elsewhere too.
        self.owner = np.repeat(np.arange(len(segs)), counts[kind])
        self.place = np.arange(len(self.owner)) - np.repeat(np.concatenate(([0], np.cumsum(counts[kind])[:-1])), counts[kind])
        of = before[kind][self.owner] + self.place
        self.first, self.known, self.name = first[of], has[of], name[of]


HITS = "doc_id long, no_id boolean, row long, begin long, end long"


def _hits(part: pd.DataFrame, shard: Shard, window: int) -> pd.DataFrame:
    """The intervals of words whose windows have a first document that is earlier than their own; part's segments come first."""
    within = shard.owner < len(part)
    owner, place = shard.owner[within], shard.place[within]
    own, no_id = part["doc_id"].to_numpy(np.int64)[owner], part["no_id"].to_numpy(bool)[owner]
    late = np.flatnonzero(shard.known[within] & (no_id | (shard.first[within] < own)))
    runs = np.flatnonzero(np.append(True, (np.diff(late) != 1) | (np.diff(owner[late]) != 0)))[: len(late)]
    last = late[np.append(runs[1:], len(late)) - 1] if len(late) else late
    opens = late[runs] if len(late) else late
    held = part.iloc[owner[opens]]
    start = held["start"].to_numpy(np.int64)
    return pd.DataFrame(
        {
            "doc_id": held["doc_id"].to_numpy(np.int64), "no_id": held["no_id"].to_numpy(bool), "row": held["row"].to_numpy(np.int64),
            "begin": start + place[opens], "end": start + place[last] + window,
        }
    )


def _shard_of(part: pd.DataFrame, window: int) -> Shard:
    return Shard(part["seg"].tolist(), part["doc_id"].to_numpy(np.int64), ~part["no_id"].to_numpy(bool), window)


def cold_hits(segments: DataFrame, shards: int, window: int) -> DataFrame:
    """Intervals of segments that are dealt to shards by their anchor."""

    def search(part: pd.DataFrame) -> pd.DataFrame:
        return _hits(part, _shard_of(part, window), window)

    dealt = segments.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(search, HITS)


def _window_words(seg: bytes, place: int, window: int) -> bytes:
    return b" ".join(seg.split(b" ")[place : place + window])


FOUND = "anchor long, salt long, doc_id long, no_id boolean, seg binary"


def hot_hits(segments: DataFrame, hot: DataFrame, shards_of: int, window: int) -> DataFrame:
    """Intervals of segments of anchors that have shards of their own; hot: (anchor, shards)."""
    salt = F.pmod(F.xxhash64("row", "start"), F.col("shards"))
    dealt = durable(segments.join(hot, "anchor").withColumn("salt", salt).drop("shards"))

    def gather(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        """Each window of the shard once, with the first document that has it there."""
        shard = _shard_of(part, window)
        _, at = np.unique(shard.name, return_index=True)
        segs = part["seg"].tolist()
        words = [_window_words(segs[o], p, window) for o, p in zip(shard.owner[at].tolist(), shard.place[at].tolist(), strict=True)]
        return pd.DataFrame(
            {"anchor": key[0], "salt": key[1], "doc_id": shard.first[at], "no_id": ~shard.known[at], "seg": words}
        )

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        """The same rows, with the first document of all shards."""
        shard = _shard_of(part, window)
        return part[["anchor", "salt", "seg"]].assign(doc_id=shard.first, no_id=~shard.known)[[c.split()[0] for c in FOUND.split(", ")]]

    def give_back(part: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        """Each window takes its document from the row that stands for it: both are matched in one index."""
        segs = part["seg"].tolist() + told["seg"].tolist()
        ids = np.concatenate([np.full(len(part), LAST), told["doc_id"].to_numpy(np.int64)])
        known = np.concatenate([np.zeros(len(part), bool), ~told["no_id"].to_numpy(bool)])
        return _hits(part, Shard(segs, ids, known, window), window)

    found = durable(dealt.groupBy("anchor", "salt").applyInPandas(gather, FOUND))
    by_words = found.withColumn("shard", F.pmod(F.xxhash64("seg"), F.lit(shards_of)))
    settled = durable(by_words.groupBy("shard").applyInPandas(settle, FOUND))
    hits = durable(dealt.groupBy("anchor", "salt").cogroup(settled.groupBy("anchor", "salt")).applyInPandas(give_back, HITS))
    discard(dealt, found, settled)
    return hits


def covered_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, no_id, row, intervals): the words of a document in windows that also start in an earlier one.

    docs: doc_id, no_id (where it is set there is no doc_id), row (tells rows apart up to equal ones) and text.
    """
    spark = docs.sparkSession
    flagged = _shared_anchors(docs, window)
    release(spark)
    segments = durable(_segments(docs.join(flagged, "row"), window))
    discard(flagged)
    release(spark)
    length = F.length("seg").cast("long")
    total = segments.agg(F.sum(length)).first()[0] or 0
    sizes = segments.groupBy("anchor").agg(F.sum(length).alias("bytes"))
    hot = sizes.where(F.col("bytes") > HOT_BYTES).select("anchor", F.ceil(F.col("bytes") / SHARD_BYTES).alias("shards"))
    hot = durable(hot)
    shards = total // SHARD_BYTES + 1
    some = bool(hot.take(1))
    cold = segments.join(hot, "anchor", "left_anti") if some else segments
    hits = durable(cold_hits(cold, shards, window))
    written = [segments, hot, hits]
    if some:
        written.append(hot_hits(segments, hot, shards, window))
        hits = hits.unionByName(written[-1])
    release(spark)
    # Rows that are alike in id and text share their intervals.
    interval = F.struct("begin", "end")
    covered = durable(hits.groupBy("doc_id", "no_id", "row").agg(F.collect_set(interval).alias("intervals")))
    discard(*written)
    release(spark)
    return covered


SCHEMA = "doc_id long, no_id boolean, n_words long, n_removed long, kept_sha256 string, kept_text string"


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept_text (kept words, joined by one space)."""
    rows = carried(in_small_batches(docs), F.xxhash64(docs["doc_id"], raw_print(docs)).alias("row"), docs["text"])
    covered = covered_windows(rows, window)

    def clean(batches):
        for batch in batches:
            out = []
            told = zip(batch["doc_id"], batch["no_id"], batch["text"], batch["begins"], batch["ends"], strict=True)
            for doc_id, no_id, text, begins, ends in told:
                words = _words(text)
                drop = np.zeros(len(words) + 1, np.int64)
                if begins is not None:
                    np.add.at(drop, np.asarray(begins, np.int64), 1)
                    np.add.at(drop, np.asarray(ends, np.int64), -1)
                gone = np.cumsum(drop[:-1]) > 0
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
                joined = b" ".join(kept)
                digest = hashlib.sha256(joined).hexdigest()
                out.append((doc_id, no_id, len(words), len(words) - len(kept), digest, joined.decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    joined = rows.join(covered, ["doc_id", "no_id", "row"], "left")
    columns = ["doc_id", "no_id", "text", F.col("intervals.begin").alias("begins"), F.col("intervals.end").alias("ends")]
    return restored(joined.select(*columns).mapInPandas(clean, SCHEMA))
