"""Operator 3: packing token sequences by non-negative least squares over length patterns.

Documents are tokenised and cut into pieces of ``window`` tokens and one rest. The histogram of rests
(at most window - 1 numbers, however many documents) goes to the driver. There, patterns of two or three
lengths that fill a window exactly are enumerated, and non-negative least squares finds how often to use
each so that the histogram is used up; the counts are rounded down, and what is left is packed greedily,
longest first with the longest that fits. Pieces find their place by their rank among those of equal length.

Defined results: a null text counts as empty and is one token, the end mark; rows that repeat are packed
each; an empty table gives an empty table. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import carried, compact, in_small_batches, restored, running_total

WINDOW = 2048
END = 1
#: Longer texts, and such as hold a special token, are encoded by the slower of two equal encoders.
LONG = 300_000
#: Fixed value: how byte-level BPE parts a text before it merges.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes stand for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> ids of the tokenizer file, without special tokens added.

    A byte-level BPE vocabulary whose ids follow its merges is encoded by an engine that is five times as fast
    and gives the same ids; anything else, and texts that hold special tokens, by the file's own library.
    """
    import tiktoken
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    special = [t["content"] for t in told["added_tokens"]]
    own = lambda text: model.encode(text, add_special_tokens=False).ids
    vocabulary, before = told["model"].get("vocab", {}), told.get("pre_tokenizer") or {}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in told["model"].get("merges", [])]
    ids = [vocabulary.get(m, -1) for m in merged]
    simple = (
        told["model"]["type"] == "BPE"
        and told["normalizer"] is None
        and before.get("type") == "ByteLevel"
        and before.get("use_regex", True)
        and not before.get("add_prefix_space")
        and ids == sorted(ids)
    )
    if not simple:
        return own
    byte_of = _byte_of()
    ranks = {bytes(byte_of[c] for c in token): n for token, n in vocabulary.items() if token not in special}
    fast = tiktoken.Encoding("own", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str):
        if len(text) > LONG or any(s in text for s in special):
            return own(text)
        return fast.encode_ordinary(text)

    return encode


def token_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of every piece of every document."""

    def scan(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, no_id, text in zip(batch["doc_id"], batch["no_id"], batch["text"], strict=True):
                ids = encode(text) if isinstance(text, str) else []
                tokens = np.array([*ids, END], "<u4")
                for start in range(0, len(tokens), window):
                    part = tokens[start : start + window]
                    rows.append((doc_id, no_id, start, len(part), zlib.crc32(part.tobytes()), len(tokens)))
            yield pd.DataFrame(rows, columns=["doc_id", "no_id", "start", "length", "ids_crc32", "doc_tokens"])

    schema = PIECES.replace("doc_id long,", "doc_id long, no_id boolean,")
    return restored(carried(in_small_batches(docs), F.col("text")).mapInPandas(scan, schema))


def patterns_for(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths (0: none) that sum to window: all pairs, and triples near one, two and three thirds."""
    here = np.zeros(window + 1, bool)
    here[lengths] = True
    found = [(a, window - a, 0) for a in range((window + 1) // 2, window) if here[a] and here[window - a]]
    for a in lengths:
        rest = window - int(a)
        for share in (2, 3, 4):
            for b in range(rest // share, max(0, rest // share - 8), -1):
                if b and rest - b and here[b] and here[rest - b]:
                    found.append(tuple(sorted((int(a), rest - b, b), reverse=True)))
                    break
    return np.array(sorted(set(found)), np.int64).reshape(-1, 3)


def least_squares(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 2000, settled: float = 1e-5) -> np.ndarray:
    """Counts >= 0 that bring the patterns' use of each length near the histogram (multiplicative updates).

    It ends where a round lowers the squared distance by less than ``settled`` of it.
    """
    counts = np.full(len(patterns), histogram.sum() / max(1, 3 * len(patterns)))
    wanted = np.where(patterns > 0, histogram[patterns], 0).sum(1).astype(float)
    before = np.inf
    for _ in range(rounds):
        used = np.bincount(patterns.ravel(), np.repeat(counts, 3), len(histogram))
        used[0] = 0
        distance = float(((used - histogram) ** 2).sum())
        if distance >= before * (1 - settled):
            break
        before = distance
        counts *= wanted / np.maximum(np.where(patterns > 0, used[patterns], 0).sum(1), 1e-9)
    return counts


def solve(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times): patterns that use up the histogram exactly. histogram[l]: pieces of length l < window."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    plan: list[tuple[tuple[int, ...], int]] = []
    patterns = patterns_for(np.nonzero(left)[0], window)
    if len(patterns):
        counts = least_squares(patterns, left)
        for row in np.argsort(-counts, kind="stable"):
            lengths, need = np.unique(patterns[row][patterns[row] > 0], return_counts=True)
            times = int(min(np.floor(counts[row]), (left[lengths] // need).min()))
            if times > 0:
                left[lengths] -= need * times
                plan.append((tuple(int(x) for x in patterns[row] if x), times))
    while left.any():
        gap, pattern, spare = window, [], left.copy()
        while gap > 0 and (fits := np.nonzero(spare[: gap + 1])[0]).size:
            pattern.append(int(fits[-1]))
            spare[fits[-1]] -= 1
            gap -= int(fits[-1])
        lengths, need = np.unique(pattern, return_counts=True)
        times = int((left[lengths] // need).min())
        left[lengths] -= need * times
        plan.append((tuple(pattern), times))
    return plan


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: what token_pieces gives, with sequence_id and offset."""
    pieces = compact(token_pieces(docs, tokenizer, window))
    histogram = np.zeros(window + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``window`` rows
        histogram[row["length"]] = row["count"]
    total = int(histogram.sum())
    plan = [((window,), int(histogram[window]))] * bool(histogram[window]) + solve(histogram[:window], window)
    places, first, next_rank = [], 0, np.zeros(window + 1, np.int64)
    for lengths, times in plan:
        offset = 0
        for length in lengths:
            places.append((length, next_rank[length], first, offset))
            next_rank[length] += times
            offset += length
        first += times
    places.sort()
    table = np.array(places, np.int64).reshape(-1, 4)
    base = np.zeros(window + 2, np.int64)
    base[1:] = np.cumsum(histogram)
    starts = base[table[:, 0]] + table[:, 1]

    def place(batches):
        for batch in batches:
            length, rank = batch["length"].to_numpy(np.int64), batch.pop("_rank").to_numpy(np.int64)
            at = np.searchsorted(starts, base[length] + rank, "right") - 1
            yield batch.assign(sequence_id=table[at, 2] + rank - table[at, 1], offset=table[at, 3])

    chunks = max(256, int(total**0.5))
    keyed = pieces.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(chunks)))
    keyed = keyed.withColumn("_one", F.lit(1).cast("long"))
    order = [F.col("doc_id").asc_nulls_first(), "start", "ids_crc32", "doc_tokens"]
    ranked = running_total(keyed, "length", "_chunk", order, "_one", "_rank")
    columns = [F.col(c) for c in ("start", "length", "ids_crc32", "doc_tokens")]
    schema = PIECES.replace("doc_id long,", "doc_id long, no_id boolean,") + ", sequence_id long, offset long"
    return restored(carried(ranked, *columns, F.col("_rank")).mapInPandas(place, schema))
