"""Operator 10: toxicity by compression distance.

zstandard's trainer makes two dictionaries from labelled rows: one of ordinary texts, cut into samples; one of the
toxic texts' contrast, which is what is left of them when the words without a marked gram are taken out. A byte 5-gram is
marked that more toxic than ordinary documents hold, or hold more than once (``RATIO`` times as frequent, and
more than ``CONTRAST`` standard errors apart); whole toxic texts would train a dictionary of ordinary words.
Windows of a text are compressed with the ordinary dictionary, with both, with the toxic one and with none. What
the toxic dictionary saves (at most, in the best three windows, on average, beyond chance) is calibrated by a
logistic regression. Its rows are training rows that had no part in the dictionaries that compress them: each half
is measured with dictionaries of the other half. Scoring uses dictionaries of all rows.

Texts are of several kinds, languages for the most part, told by their own pairs of letters: kinds are centres of the training
rows' letter profiles, found without any column but the text. Each kind whose training rows mark any gram has dictionaries and a
calibration of its own; texts of other kinds are scored with those of all rows together. A score depends on the text alone.

Labels are learned from rows with crc32(doc_id as text) mod 5 not 0, from a sample of at most ``SAMPLE`` rows and
``LEARNED_BYTES`` bytes of each class, taken by a hash of the id, with their whole texts; the classes are weighed by their numbers
among all labelled training rows. Scoring reads whole texts.

Defined results: a null text counts as empty; without training rows of both classes, or where too few are toxic to mark a gram,
every score is the share of toxic rows (0 with none); rows that repeat are each scored; an empty table gives an empty
table. Labels that are null, or repeat, count as they stand. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm.common import carried, in_small_batches, restored

SAMPLE, LEARNED_BYTES = 3000, 2**26
GRAM = 5
CONTRAST = 4.5
RATIO = 8
#: Rows that a gram or a word must be in to count: so many, and this share of the toxic ones.
LEAST_ROWS, LEAST_SHARE = 4, 0.01
#: Bytes of the windows compressed with the ordinary dictionary and with both, and of those with the toxic one and none.
WIDE, CLOSE = 160, 64
ORDINARY_BYTES = 8192
TOXIC_BYTES = 4096
#: Lengths of the trainer's segments, and of the samples of ordinary text.
ORDINARY_SEGMENT, TOXIC_SEGMENT, SAMPLE_BYTES = 64, 24, 1024
#: Kinds of text at most; a kind is one whose centre is less like each other one (cosine) than this.
KINDS, APART = 16, 0.9
#: zstandard does not find what stands in the last bytes of a dictionary.
PADDING = 16


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[int, bytes]], dict[int, int]]:
    """The bounded sample, (toxic, text in lower case), and the number of all training rows of each class."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    sample = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        sample = part if sample is None else sample.unionByName(part)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    so_far = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    rows = rows.withColumn("_bytes", F.sum(F.octet_length("text")).over(so_far)).where(F.col("_bytes") <= LEARNED_BYTES)
    found = sorted((r["doc_id"], r["toxic"], encoded(r["text"]).lower()) for r in rows.collect())
    return [(toxic, text) for _, toxic, text in found], counts


def _letters() -> np.ndarray:
    """A number below 64 for each byte: letters, whatever their case, and bytes of signs beyond ASCII; 0 for all others."""
    of = np.zeros(256, np.uint16)
    of[ord("a") : ord("z") + 1] = of[ord("A") : ord("Z") + 1] = np.arange(1, 27)
    of[128:] = 27 + np.arange(128) % 37
    return of


LETTERS, PAIRS = _letters(), 1024
#: The place of each pair of these numbers in a profile: multiplicative hashing.
FOLDED = (np.arange(64 * 64, dtype=np.uint64) * np.uint64(2654435761) % np.uint64(2**32) >> np.uint64(22)).astype(np.int64)


def profile(text: bytes) -> np.ndarray:
    """How often each letter follows each other one in a text: roots of shares, of length one; zeros without letters."""
    signs = LETTERS[np.frombuffer(text, np.uint8)]
    counts = np.bincount(FOLDED[signs[:-1] * np.uint16(64) + signs[1:]], minlength=PAIRS)
    counts[0] = 0
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def kinds(profiles: np.ndarray) -> np.ndarray:
    """Centres of the kinds of texts: one after the other, from the texts least like those found, as long as they stay apart."""
    unit = lambda x: x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))
    lettered = profiles[profiles.any(1)]
    if not len(lettered):
        return np.zeros((0, profiles.shape[1]))
    centres = unit(lettered.mean(0, keepdims=True))
    while len(centres) < KINDS:
        strange = np.argsort((lettered @ centres.T).max(1), kind="stable")[: max(5, len(lettered) // 50)]
        more = np.vstack([centres, unit(lettered[strange].mean(0, keepdims=True))])
        for _ in range(30):
            of = (lettered @ more.T).argmax(1)
            moved = unit(np.array([lettered[of == k].sum(0) if (of == k).any() else more[k] for k in range(len(more))]))
            if np.allclose(moved, more):
                break
            more = moved
        if (more @ more.T - np.eye(len(more))).max() > APART:
            break
        centres = more
    return centres


def without_copies(rows: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """The first of each group of rows that share a least shingle under one of four orders.

    A text that was copied many times would else lend its words to its label.
    """
    import xxhash

    orders = np.array([0, 0x9E3779B97F4A7C15, 0x3C6EF372FE94F82A, 0xDAA66D2C7DDF743F], np.uint64)
    seen: set[tuple[int, int]] = set()
    kept = []
    for label, text in rows:
        words = text.split()
        shingles = [b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.uint64, len(shingles))
        keys = {(k, int((hashes ^ order).min())) for k, order in enumerate(orders)}
        if not keys & seen:
            kept.append((label, text))
        seen |= keys
    return kept


def marked_grams(rows: list[tuple[int, bytes]], least: float) -> set[bytes]:
    """Grams that more toxic than ordinary rows hold, or hold more than once."""
    total = Counter(toxic for toxic, _ in rows)
    once, again = {0: Counter(), 1: Counter()}, {0: Counter(), 1: Counter()}
    for toxic, text in rows:
        grams = Counter(text[k : k + GRAM] for k in range(len(text) - GRAM + 1))
        once[toxic].update(grams.keys())
        again[toxic].update(gram for gram, n in grams.items() if n > 1)
    marked = set()
    for seen in (once, again):
        for gram, n in seen[1].items():
            if n >= least:
                p, q = (n + 0.5) / (total[1] + 1), (seen[0][gram] + 0.5) / (total[0] + 1)
                if p > RATIO * q and p - q > CONTRAST * (p * (1 - p) / total[1] + q * (1 - q) / total[0]) ** 0.5:
                    marked.add(gram)
    return marked


def contrast(rows: list[tuple[int, bytes]]) -> list[bytes]:
    """Of each toxic row the parts of words from their first marked gram to their last; rows without any are left out."""
    marked = marked_grams(rows, max(LEAST_ROWS, LEAST_SHARE * sum(toxic for toxic, _ in rows)))
    samples = []
    for text in (text for toxic, text in rows if toxic):
        parts = []
        for word in (b" " + w for w in text.split()):
            hits = [k for k in range(len(word) - GRAM + 1) if word[k : k + GRAM] in marked]
            if hits:
                parts.append(word[hits[0] : hits[-1] + GRAM])
        if parts:
            samples.append(b"".join(parts))
    return samples


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """zstandard's dictionary of samples. Those too few or too short for its trainer are the content themselves."""
    import zstandard

    for copies in (1, 10):
        try:
            return zstandard.train_dictionary(size, samples * copies, k=segment, d=6).as_bytes()
        except zstandard.ZstdError:
            continue
    return b"".join(samples)[-size:]


def dictionaries(rows: list[tuple[int, bytes]]) -> tuple[bytes, bytes] | None:
    """(ordinary, toxic); none where no gram is marked."""
    toxic = contrast(rows) if {label for label, _ in rows} == {0, 1} else []
    ordinary = [text[k : k + SAMPLE_BYTES] for label, text in rows if not label for k in range(0, len(text), SAMPLE_BYTES)]
    if not toxic or not ordinary:
        return None
    return trained(ordinary, ORDINARY_BYTES, ORDINARY_SEGMENT), trained(toxic, TOXIC_BYTES, TOXIC_SEGMENT)


def compressor(content: bytes | None, size: int):
    """For windows of a size. Trained dictionaries are loaded as plain content, so that only what matches them tells, not their entropy tables."""
    import zstandard

    strategy, match = ("GREEDY", 5) if size == CLOSE else ("BTOPT", 6)
    params = zstandard.ZstdCompressionParameters(
        window_log=15, hash_log=15, chain_log=15, search_log=4, target_length=64, min_match=match,
        strategy=getattr(zstandard, f"STRATEGY_{strategy}"), write_checksum=False, write_content_size=False, write_dict_id=False,
    )
    if content is None:
        return zstandard.ZstdCompressor(compression_params=params)
    loaded = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    loaded.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=loaded)


class Measure:
    """Turns a text into what the toxic dictionary of a pair saves in its windows."""

    def __init__(self, contents: tuple[bytes, bytes]):
        ordinary, toxic = contents
        both = ordinary + toxic + bytes(PADDING)
        ordinary += bytes(len(both) - len(ordinary))
        self.pairs = [
            (WIDE, compressor(ordinary, WIDE), compressor(both, WIDE)),
            (CLOSE, compressor(None, CLOSE), compressor(toxic, CLOSE)),
        ]

    def features(self, text: bytes) -> list[float]:
        """For each window size, bytes saved: in the best window, in the best three, on average, beyond chance, and in how many."""
        out: list[float] = []
        for size, without, with_it in self.pairs:
            saved = [
                len(without.compress(part)) - len(with_it.compress(part))
                for part in (text[k : k + size] for k in range(0, len(text), size))
            ] or [0]
            best = sorted(saved)[-3:]
            gains = sum(s - 2 for s in saved if s > 2)
            kilobytes = max(len(text), size) / 1024
            hits = sum(s > 2 for s in saved)
            out += [best[-1], sum(best) / 3, sum(saved) / kilobytes, min(gains, 80), gains / kilobytes]
            out.append(hits / len(saved) * 20 if size == CLOSE else min(8, hits))
        return [float(np.clip(x, -60, 80)) for x in out]


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method with a small ridge; the last coefficient is the intercept."""
    design = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(design.shape[1], 1e-3 * len(x))
    ridge[-1] = 1e-6
    beta = np.zeros(design.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (y - p)) - ridge * beta
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(ridge + 1e-9)
        step = np.linalg.solve(curve, slope)
        beta = beta + step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return beta


class Part:
    """Two dictionaries and their calibration, learned from rows of one kind or of all."""

    def __init__(self, contents: tuple[bytes, bytes], rows: list[tuple[int, bytes]], by_class: dict[int, float]):
        self.contents = contents
        x, y = zip(*self._measured(rows), strict=True)
        x, y = np.array(x), np.array(y, float)
        weight = np.array([by_class[label] for label in y.astype(int)])
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        self.beta = calibrate((x - self.mean) / self.scale, y, weight * len(y) / weight.sum())

    def _measured(self, rows: list[tuple[int, bytes]]) -> list[tuple[list[float], int]]:
        """Each row's features by dictionaries that it had no part in; by all rows' where a half marks nothing."""
        classes = [[r for r in rows if r[0] == label] for label in (0, 1)]
        halves = [[r for rows_of in classes for r in rows_of[k::2]] for k in (0, 1)]
        pairs = [dictionaries(half) for half in halves]
        if None in pairs:
            measure = Measure(self.contents)
            return [(measure.features(text), label) for label, text in rows]
        out = []
        for contents, other in zip(pairs, reversed(halves), strict=True):
            measure = Measure(contents)
            out += [(measure.features(text), label) for label, text in other]
        return out

    def scorer(self):
        measure = Measure(self.contents)

        def score(text: bytes) -> float:
            x = (np.array(measure.features(text.lower())) - self.mean) / self.scale
            return float(1 / (1 + np.exp(-np.clip(x @ self.beta[:-1] + self.beta[-1], -30, 30))))

        return score


class Model:
    """What scoring needs, small enough to travel with each task: dictionaries and a few numbers for each kind of text."""

    def __init__(self, rows: list[tuple[int, bytes]], counts: dict[int, int]):
        known = sum(counts.values())
        self.share = counts.get(1, 0) / known if known else 0.0
        here = Counter(label for label, _ in rows)
        by_class = {label: counts[label] / n for label, n in here.items()}
        profiles = np.array([profile(text) for _, text in rows], np.float32).reshape(len(rows), PAIRS)
        self.centres = kinds(profiles)
        of = (profiles @ self.centres.T).argmax(1) if len(self.centres) else np.zeros(len(rows), int)
        del profiles
        self.parts: dict[int | None, Part] = {}
        for kind in [*range(len(self.centres)), None]:
            part = without_copies([row for row, k in zip(rows, of, strict=True) if kind in (None, k)])
            contents = dictionaries(part)
            if contents:
                self.parts[kind] = Part(contents, part, by_class)

    def scorer(self):
        """text to score."""
        scorers = {kind: part.scorer() for kind, part in self.parts.items()}
        other = scorers.get(None, lambda text: self.share)

        def score(text: bytes) -> float:
            kind = int((self.centres @ profile(text)).argmax()) if len(self.centres) else None
            return scorers.get(kind, other)(text)

        return score


def encoded(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return Model(*training_rows(docs, labels))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""

    def scan(batches):
        score = model.scorer()
        for batch in batches:
            values = [score(encoded(t)) for t in batch["text"]]
            yield batch[["doc_id", "no_id"]].assign(score=np.array(values, float))

    rows = carried(in_small_batches(docs), F.col("text"))
    scored = restored(rows.mapInPandas(scan, "doc_id long, no_id boolean, score double"))
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model does not reject, with all their columns.

    Each row is judged by its own text: rows that repeat share their decision. Without labelled rows of both classes the
    share of toxic rows decides on all alike. An empty table gives an empty table.
    """
    model = train(docs, labels)

    def keep(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = model.scorer()
        for texts in columns:
            yield pd.Series([score(encoded(t)) < 0.5 for t in texts], dtype=bool)

    return in_small_batches(docs).where(F.pandas_udf(keep, "boolean")(docs["text"]))
