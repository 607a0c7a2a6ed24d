"""Operator 13: alignment of two tokenizers' tokens, and how often their ids are linked in a corpus.

Each text is encoded by a byte-level BPE (A) and by a sentencepiece model (B). The running sums of the tokens' byte lengths
are their ends; ends that both have (``intersect1d``) cut the text into groups, ``searchsorted`` gives each token its group,
and each group's A and B tokens are linked by repeating indices. This is done for the parts of texts that spaces set apart, which
neither tokenizer joins, many at a time; a text's groups and links are those of its parts. The distinct pairs of a text
count once; they are summed by pair and salt, then by pair.

A text's links then need the counts of their pairs. The most frequent pairs, at most ``COMMON``, are broadcast; all rarer ones
are joined to the table of pairs by shuffle. Both give the same figures: the bound only decides which way a pair takes,
and a rare pair has few texts, so that no key of that join is hot.

Defined results: a text that is null or empty, or whose tokens do not spell a space and the text, has no tokens: zeros and
an empty ``groups_sha256``. Rows that repeat are texts each, also in the counts. A null doc_id stays null. An empty table
gives an empty table. Columns other than doc_id and text are ignored, whatever their names. Texts are encoded whole; links are
made ``LINKS`` at a time, so that a long text or a group of many tokens needs bounded memory beside its distinct pairs.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import durable, in_small_batches
from quirework.llm.packing import LONG, PARTS, _byte_of

#: Pairs that are broadcast at most, and links that are made at once.
COMMON, LINKS = 2**18, 2**21
#: Parts of a pair's key before the last sum, and classes of counts: COUNT_BINS to each doubling.
SALTS, COUNT_BINS = 16, 16
#: An id's place in a pair: A id times this, plus B id.
PLACE = 2**20
#: Parts of texts that a worker remembers before it forgets them all, and signs of parts that are encoded at once.
KNOWN, TOGETHER = 2**19, 2**15

NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
SCHEMA = f"doc_id long, {', '.join(f'{n} long' for n in NUMBERS)}, groups_sha256 string, pairs array<long>, links array<long>"


@lru_cache(maxsize=2)
def encoder_a(path: str):
    """(text -> ids, bytes of each id) of a byte-level BPE; the strings of special tokens are plain text."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    special = {t["content"] for t in told["added_tokens"]}
    byte_of = _byte_of()
    ranks = {bytes(byte_of[c] for c in token): n for token, n in told["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("a", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    spelled = [b""] * (max(ranks.values()) + 1)
    for token, n in ranks.items():
        spelled[n] = token

    def encode(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids if len(text) > LONG else fast.encode_ordinary(text)

    return encode, spelled


@lru_cache(maxsize=2)
def encoder_b(path: str):
    """(text -> ids, bytes of each id) of a sentencepiece model, which puts the space before the text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(n) for n in range(model.get_piece_size())]
    spelled = [bytes([int(p[1:-1], 16)]) if model.is_byte(n) else p.replace("\u2581", " ").encode() for n, p in enumerate(pieces)]
    if any("\u2581" in p.lstrip("\u2581") for p in pieces):
        raise ValueError("pieces that hold a space after another sign would join the parts of a text")
    return model.encode, spelled


class Encoders:
    """Both encoders, with the byte lengths of their ids."""

    def __init__(self, path_a: str, path_b: str):
        (self.encode_a, self.spelled_a), (self.encode_b, self.spelled_b) = encoder_a(path_a), encoder_b(path_b)
        self.bytes_a, self.bytes_b = (np.array([len(t) for t in spelled], np.int64) for spelled in (self.spelled_a, self.spelled_b))
        self.size = max(len(self.spelled_a), len(self.spelled_b))
        self.written = [f"{n}{sign}" for sign in ",|;" for n in range(self.size)]

    def __call__(self, text: str) -> tuple[list[int], list[int]] | None:
        """The text's ids of A and B; None where either does not spell a space and the text."""
        ids_a, ids_b = self.encode_a(" " + text), self.encode_b(text)
        whole = (" " + text).encode("utf-8", "surrogatepass")
        same = b"".join(map(self.spelled_a.__getitem__, ids_a)) == whole and b"".join(map(self.spelled_b.__getitem__, ids_b)) == whole
        return (ids_a, ids_b) if same else None


class Aligned:
    """Parts laid end to end: tokens' ids and groups. A part's end is a cut, so groups never span parts."""

    def __init__(self, a: np.ndarray, sizes_a: np.ndarray, b: np.ndarray, sizes_b: np.ndarray, encoders: Encoders):
        self.a, self.b, self.sizes_a, self.sizes_b, self.encoders = a, b, sizes_a, sizes_b, encoders
        ends_a, ends_b = np.cumsum(encoders.bytes_a[a]), np.cumsum(encoders.bytes_b[b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        self.in_a, self.in_b = np.bincount(self.group_a, minlength=len(cuts)), np.bincount(self.group_b, minlength=len(cuts))
        self.first_a, self.first_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        self.part_of_a = np.repeat(np.arange(len(sizes_a)), sizes_a)
        self.part_of_group = self.part_of_a[self.first_a]

    def numbers(self) -> np.ndarray:
        """The NUMBERS of each part, a row each."""
        n = len(self.sizes_a)
        links = np.bincount(self.part_of_group, self.in_a * self.in_b, n).astype(np.int64)
        return np.stack([self.sizes_a, self.sizes_b, np.bincount(self.part_of_group, minlength=n), links], axis=1)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(part, pair, links) of the distinct pairs of each part, ordered by part."""
        fan = self.in_b[self.group_a]
        reach, at = np.cumsum(fan), 0
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while at < len(fan):
            done = reach[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(reach, done + LINKS, "right")))
            width = fan[at:to]
            left = np.repeat(np.arange(at, to), width)
            right = self.first_b[self.group_a[left]] + np.arange(len(left)) - np.repeat(np.cumsum(width) - width, width)
            key, count = np.unique(joined(self.part_of_a[left], self.a[left] * PLACE + self.b[right]), return_counts=True)
            if at:
                key, count = summed(np.concatenate([keys, key]), np.concatenate([counts, count]))
            keys, counts, at = key, count, to
        return (*parted(keys), counts)

    def written(self) -> list[str]:
        """Each part's groups as ``a1,a2|b1;a3|b2,b3``."""
        size, words = self.encoders.size, self.encoders.written
        said = np.empty(len(self.a) + len(self.b), np.int64)
        place_a = np.arange(len(self.a)) + self.first_b[self.group_a]
        place_b = np.arange(len(self.b)) + self.first_a[self.group_b] + self.in_a[self.group_b]
        said[place_a], said[place_b] = self.a, self.b
        said[place_a[self.first_a + self.in_a - 1]] += size
        said[place_b[self.first_b + self.in_b - 1]] += 2 * size
        ends, codes = np.cumsum(self.sizes_a + self.sizes_b).tolist(), said.tolist()
        return ["".join(map(words.__getitem__, codes[start:end]))[:-1] for start, end in zip([0, *ends], ends, strict=False)]


def joined(owner: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """One number for an owner below 2**23 and its pair."""
    return owner * PLACE**2 + pair


def parted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return keys // PLACE**2, keys % PLACE**2


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


class Parts:
    """The parts of texts that are known so far, with their numbers, written groups and distinct pairs.

    A text is parted at each single space between signs that are not white space. Neither tokenizer joins what stands on
    both sides of such a space: A's parts begin at it, and no piece of B holds a space after another sign. So many
    parts are encoded as one text, which is cut at their ends.
    """

    APART = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, encoders: Encoders):
        self.encoders = encoders
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.said: list[str | None] = []
        self.numbers = np.zeros((0, len(NUMBERS)), np.int64)
        self.first, self.pair, self.links = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encoded(self, parts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(ids of A, how many of each part, the same of B): parts in order. A part that is not spelled has no ids."""
        encoders = self.encoders
        smooth = not any(p[0].isspace() or p[-1].isspace() for p in parts)
        ids = encoders(" ".join(parts)) if smooth else None
        if ids is None and len(parts) > 1:
            return [x for p in parts for x in self.encoded([p])]
        if ids is None:
            ids = encoders(parts[0])
        if ids is None:
            return [(np.zeros(0, np.int64), np.zeros(1, np.int64)) * 2]
        ends, out = np.cumsum([len(p.encode("utf-8", "surrogatepass")) + 1 for p in parts]), []
        for own, lengths in zip(ids, (encoders.bytes_a, encoders.bytes_b), strict=True):
            own = np.array(own, np.int64)
            upto = np.searchsorted(np.cumsum(lengths[own]), ends, "right")
            out += [own, np.diff(upto, prepend=0)]
        return [tuple(out)]

    def learn(self, parts: list[str]) -> None:
        if not parts:
            return
        bunches, signs = [[]], 0
        for part in parts:
            signs += len(part) + 1
            if bunches[-1] and signs > TOGETHER:
                bunches.append([])
                signs = len(part) + 1
            bunches[-1].append(part)
        told = [np.concatenate(x) for x in zip(*[x for bunch in bunches for x in self.encoded(bunch)], strict=True)]
        new = Aligned(*told, self.encoders)
        for part in parts:
            self.place[part] = len(self.place)
        spelled = new.sizes_a > 0
        self.said += [text if good else None for text, good in zip(new.written(), spelled.tolist(), strict=True)]
        of, pair, links = new.pairs()
        upto = np.searchsorted(of, np.arange(1, len(parts) + 1))
        self.first = np.concatenate([self.first, self.first[-1] + upto])
        self.numbers = np.concatenate([self.numbers, new.numbers()])
        self.pair, self.links = np.concatenate([self.pair, pair]), np.concatenate([self.links, links])

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For each text its NUMBERS and the digest of its groups; (text, pair, links) of the distinct pairs of each."""
        if len(self.place) > KNOWN or len(self.pair) > 8 * KNOWN:
            self.forget()
        parted_texts = [self.APART.split(text) if text else [] for text in texts]
        place = self.place
        self.learn(list({p: None for parts in parted_texts for p in parts if p not in place}))
        numbers, digests, held = np.zeros((len(texts), len(NUMBERS)), np.int64), [], []
        for k, parts in enumerate(parted_texts):
            own = [place[p] for p in parts]
            said = [self.said[i] for i in own]
            if None in said or not own:
                held.append(np.zeros(0, np.int64))
                digests.append("")
                continue
            held.append(np.array(own, np.int64))
            numbers[k] = self.numbers[held[-1]].sum(0)
            digests.append(hashlib.sha256(";".join(said).encode()).hexdigest())
        own = np.concatenate([*held, np.zeros(0, np.int64)])
        text = np.repeat(np.arange(len(texts)), [len(x) for x in held])
        width = self.first[own + 1] - self.first[own]
        at = np.repeat(self.first[own] - (np.cumsum(width) - width), width) + np.arange(width.sum())
        keys, links = summed(joined(np.repeat(text, width), self.pair[at]), self.links[at])
        return (numbers, digests, *parted(keys), links)


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, links): each text's distinct pairs and how often it links them."""

    def scan(batches):
        parts = Parts(Encoders(path_a, path_b))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            numbers, digests, text, pair, links = parts.texts(texts)
            offsets = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (pair, links)]
            columns = [pa.array(column, pa.int64()) for column in numbers.T]
            columns = [batch.column("doc_id"), *columns, pa.array(digests, pa.string()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *NUMBERS, "groups_sha256", "pairs", "links"])

    fields = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return fields.mapInArrow(scan, SCHEMA)


def pair_counts(texts: DataFrame) -> DataFrame:
    """(pair, count, best): in how many rows of ``texts`` each pair is linked; best: no pair of its A id has more."""
    salted = texts.select(F.explode("pairs").alias("pair"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt"))
    parts = salted.groupBy("pair", "salt").agg(F.count(F.lit(1)).alias("part"))
    counts = durable(parts.groupBy("pair").agg(F.sum("part").alias("count")))
    first = F.expr(f"pair div {PLACE}")
    highest = counts.groupBy(first.alias("_a")).agg(F.max("count").alias("_most"))
    told = counts.join(highest, first == F.col("_a"))
    return durable(told.select("pair", "count", (F.col("count") == F.col("_most")).alias("best")))


def common_pairs(counts: DataFrame, most: int) -> DataFrame:
    """Of pair_counts the most frequent, whole classes of equal magnitude, at most ``most`` pairs; with their class."""
    classes = counts.withColumn("class", F.floor(F.log2("count") * COUNT_BINS).cast("int"))
    chosen, left = None, most
    # One row for each class: at most 64 * COUNT_BINS.
    for row in classes.groupBy("class").count().orderBy(F.desc("class")).collect():
        left -= row["count"]
        if left < 0:
            break
        chosen = row["class"]
    return classes.where(F.col("class") >= F.lit(chosen)).drop("class") if chosen is not None else counts.limit(0)


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, most: int = COMMON) -> DataFrame:
    """One row per document: doc_id, the NUMBERS, n_best, count_sum, groups_sha256; ``most`` pairs are broadcast at most."""
    texts = durable(aligned(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()))
    counts = pair_counts(texts)
    common = F.broadcast(durable(common_pairs(counts, most)))
    linked = texts.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("_link")).select("row", F.col("_link.pairs").alias("pair"), F.col("_link.links").alias("links"))
    sums = (F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("count")).alias("count_sum"))
    often = linked.join(common, "pair").groupBy("row").agg(*sums)
    seldom = linked.join(common, "pair", "left_anti").join(counts.hint("merge"), "pair").groupBy("row").agg(*sums)
    both = often.unionByName(seldom).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = texts.drop("pairs", "links").join(both, "row", "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    return out.select("doc_id", *NUMBERS, *zero, "groups_sha256")
