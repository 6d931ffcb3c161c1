"""Language-model scoring with a log-frequency Bloom filter.

Counts of word pairs are quantised: a count c has level 1 + floor(log2 c), and the filter holds
a pair once for each level up to its own. A level is read back by probing level 1, 2, ... until
a probe fails; it stands for the middle of its range. Beside the filter lie, for each word h of
the vocabulary, its exact count c(h) and M(h), the sum of what the levels of its pairs stand
for. A word w after h has the probability

    (value(h w) + K * p(w)) / (M(h) + K),    p(w) = (c(w) + 1) / (N + V + 1)

(p(w) alone after an unknown h). Both p and the pair term sum to 1 over the vocabulary and one
unknown word, so the whole does, but for pairs that pass the filter by chance. A pair passes
level 1 by chance once in 2^16; a history thus gains m = V / 2^16 in all, hardly ever more than
m + 4 sqrt(m) + 2. K is 50 times that, so the sum over the vocabulary stays within 0.02 of 1. A
higher level, which only pairs that passed before can reach, is passed by chance once in 2^13. A
text is its words
and an end; the end also stands before the first word. The base score uses exact word counts.

The filter is cut into shards by the top bits of a pair's hash, as many as the corpus needs for
shards of a bounded size. Texts are counted some million tokens at a time, and what such a batch
has for a shard is one row of packed numbers (none where it has nothing, so there are never
more rows than n-grams); a shard is built by one task, from as many tokens as any other shard.
What each shard knows of M is summed by word. If filter and words have at most `broadcast_mb`,
they are broadcast, in parts with a range of hashes each, so that the driver holds one part at a
time. Beyond that the texts' batches ask the shards for their words and pairs, packed, and shards
answer as they are built (`_score_packed`). Both ways give the same scores, but for the pairs that
pass a filter by chance: shards are cut by other hashes there.

Defined results: a null text is empty and has one token, the end; a null doc_id is not held out;
without training texts a base score is 0 per token, and so is a score; rows that repeat give a
result each; extra columns are ignored; an empty table gives an empty result. Words are compared
by 64-bit hash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm.common import arrow_rows, crc_mod, hand_back, materialize, mix64, release, shared_dir, table, word_hashes

END = np.uint64(0x3C79AC492BA7B653)
FIRST, PROBES = 16, 13  # hash functions of level 1, and of the levels above
_SHARD_GRAMS = 6_000_000  # tokens of the corpus for each shard
_SLICE = 150_000  # tokens scored at a time
_GATHERED = 6_000_000  # tokens counted at a time
_PIECE = 250_000  # pairs hashed at a time
_BINS = 3  # bits: a batch of tokens is sorted in so many parts
_BATCH = 1000  # texts sent to Python at a time
_PART_BYTES = 16_000_000  # of the model, gathered and broadcast at a time
_TEXT_FOR_MODEL = 4  # a model is tried for a broadcast if the texts have at most a fourth of its bound
_TOGETHER = 4_500_000  # tokens that ask the shards together
_COMMON = 4096  # words whose pairs are dealt out by their own hash


def _pair(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(h * np.uint64(0x9FB21C651E98DF25) + w + np.uint64(0x2545F4914F6CDD1D))


def _tokens(text: str | None) -> np.ndarray:
    return np.append(word_hashes((text or "").encode("utf-8", "surrogatepass")), END)


def _places(grams: np.ndarray, level: int, bits: np.ndarray, probes: int) -> Iterator[np.ndarray]:
    """For each probe: the bit of each n-gram at its level, in filters of so many bits."""
    with np.errstate(over="ignore"):
        g = mix64(grams + np.uint64(0xA0761D6478BD642F) * np.uint64(level))
        h = mix64(g + np.uint64(0xE7037ED1A0B428DB))
        a, b = g >> np.uint64(32), h | np.uint64(1)
        for _ in range(probes):
            yield ((a & np.uint64(0xFFFFFFFF)) * bits) >> np.uint64(32)
            a = a + (b >> np.uint64(32)) + np.uint64(1)
            b = b * np.uint64(0x9E3779B97F4A7C15)


def smoothing(v: int) -> float:
    """K for a vocabulary of so many words."""
    by_chance = v / 2**FIRST
    return 50.0 * (by_chance + 4.0 * by_chance**0.5 + 2.0)


def _levels(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1]


def _value(levels: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of 2^(q-1) .. 2^q - 1; 0 for level 0."""
    return np.where(levels > 0, 1.5 * 2.0 ** (levels - 1) - 0.5, 0.0)


def _build(grams: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The packed filter of distinct n-grams of these levels."""
    size = max(64, int((grams.size * FIRST + (levels - 1).sum() * PROBES) / np.log(2)))
    bits = np.zeros(-(-size // 8) * 8, dtype=np.uint8)
    for q in range(1, int(levels.max(initial=0)) + 1):
        for place in _places(grams[levels >= q], q, np.uint64(bits.size), FIRST if q == 1 else PROBES):
            bits[place] = 1
    return np.packbits(bits, bitorder="little")


class Shards:
    """The filters of one or more shards, ready to be probed."""

    def __init__(self, rows: Iterable, layout: list[tuple[int, int]], shift: int) -> None:
        """layout: the shard and the bytes of its filter. Rows come in any order; each is copied
        to its place and let go."""
        self.shift = shift
        self.offset = np.zeros(1 << (64 - shift), dtype=np.uint64)
        self.bits = np.ones(1 << (64 - shift), dtype=np.uint64)
        places, at = {}, 1  # a shard without a row has one bit, not set
        for shard, filter_bytes in sorted(layout):
            places[shard] = at
            self.offset[shard], self.bits[shard] = at * 8, filter_bytes * 8
            at += filter_bytes
        self.filter = np.zeros(at, dtype=np.uint8)
        for r in rows:
            part = np.frombuffer(r["bits"], dtype=np.uint8)
            self.filter[places[r["shard"]] : places[r["shard"]] + part.size] = part

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """The level of each n-gram, by probing until a probe fails."""
        shard = (grams >> np.uint64(self.shift)).astype(np.int64) if self.shift < 64 else np.zeros(grams.size, dtype=np.int64)
        out = np.zeros(grams.size, dtype=np.int64)
        alive, q = np.arange(grams.size), 0
        while alive.size:
            q += 1
            offset, bits = self.offset[shard[alive]], self.bits[shard[alive]]
            hit = np.ones(alive.size, dtype=bool)
            for place in _places(grams[alive], q, bits, FIRST if q == 1 else PROBES):
                at = place + offset
                hit &= (self.filter[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0
            alive = alive[hit]
            out[alive] = q
        return out


class Words:
    """Exact counts of the vocabulary, and M of each word as a history. Both are small for most
    words, and M is a multiple of a half: such words take a byte each for n and 2 M beside their
    hash; the others stand whole in a second table."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, mass: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        large = ((counts >= 255) | (mass * 2 >= 255) | (mass * 2 % 1 != 0))[order]
        self.small = tuple(np.where(large, 255, x[order]).astype(np.uint8) for x in (counts, mass * 2))
        self.large = tuple(x[order][large] for x in (hashes, counts, mass))

    @property
    def counts(self) -> np.ndarray:
        return self.look_up(self.hashes)[0]

    def look_up(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The count and M of each word; 0 for unknown ones."""
        if self.hashes.size == 0:
            return np.zeros(words.size, dtype=np.int64), np.zeros(words.size)
        at = np.minimum(np.searchsorted(self.hashes, words), self.hashes.size - 1)
        known = self.hashes[at] == words
        counts, twice = (np.where(known, x[at], 0) for x in self.small)
        counts, mass = counts.astype(np.int64), twice / 2.0
        whole = np.flatnonzero(counts == 255)
        at = np.searchsorted(self.large[0], words[whole])
        counts[whole], mass[whole] = self.large[1][at], self.large[2][at]
        return counts, mass


class _Parts:
    """Shards or words in parts: each has the hashes from its low one up to that of the next."""

    def __init__(self, parts: list[tuple[int, Shards | Words]]) -> None:
        self.lows = np.array([low for low, _ in parts], dtype=np.uint64)
        self.parts = [part for _, part in parts]

    def _met(self, keys: np.ndarray) -> Iterator[tuple[Shards | Words, np.ndarray]]:
        """Each part that has some of the keys, and where these are."""
        of = np.searchsorted(self.lows, keys, side="right") - 1
        for i, part in enumerate(self.parts):
            here = np.flatnonzero(of == i)
            if here.size:
                yield part, here


class ShardParts(_Parts):
    def levels(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(grams.size, dtype=np.int64)
        for part, here in self._met(grams):
            out[here] = part.levels(grams[here])
        return out


class WordParts(_Parts):
    @property
    def hashes(self) -> np.ndarray:
        return np.concatenate([part.hashes for part in self.parts])

    @property
    def counts(self) -> np.ndarray:
        return np.concatenate([part.counts for part in self.parts])

    def look_up(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts, mass = np.zeros(words.size, dtype=np.int64), np.zeros(words.size)
        for part, here in self._met(words):
            counts[here], mass[here] = part.look_up(words[here])
        return counts, mass


def base_logs(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    return np.log10((counts + 1.0) / (n + (v + 1.0)))


def model_probabilities(pair: np.ndarray, mass: np.ndarray, count: np.ndarray, n: int, v: int) -> np.ndarray:
    """Probabilities of words from the levels of their pairs, M of the words before and their
    own counts."""
    alone, k = (count + 1.0) / (n + v + 1.0), smoothing(v)
    return np.where(mass > 0, (_value(pair) + k * alone) / (mass + k), alone)


def _summed(keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys, numbers = keys[order], numbers[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if keys.size else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(numbers, first) if keys.size else numbers


_PARTS = ("words", "words_n", "pairs", "pairs_n", "before", "before_n")


def train(docs: DataFrame, shard_grams: int = _SHARD_GRAMS) -> tuple[DataFrame, DataFrame, int, int, int]:
    """From docs (text): the shards (shard, bits), the words (word, n, mass), the shards' shift,
    N and V."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    top = max(0, int(np.ceil(np.log2(max(1.0, size / 6 / shard_grams)))))  # a token has some 6 bytes
    shift = 64 - top
    edges = np.arange(1, 1 << top, dtype=np.uint64) << np.uint64(shift) if top else np.zeros(0, dtype=np.uint64)

    def packed(tokens: list[np.ndarray]) -> Iterator[dict]:
        """What the tokens have for each shard: words and pairs in order, and the pairs' histories
        as runs, so that a history is not repeated for each of its pairs."""
        starts = np.cumsum([0, *(t.size for t in tokens)])[:-1]
        all_tokens = np.concatenate(tokens)
        tokens.clear()
        h = np.concatenate(([END], all_tokens[:-1]))
        h[starts] = END
        pairs = np.empty_like(h)
        for at in range(0, h.size, _PIECE):
            pairs[at : at + _PIECE] = _pair(h[at : at + _PIECE], all_tokens[at : at + _PIECE])
        # A range of hashes at a time: what sorting takes beside the tokens is that of a part.
        few = min(top, _BINS)
        for b in range(1 << few):
            of = lambda x: x >> np.uint64(64 - few) == np.uint64(b) if few else np.ones(x.size, dtype=bool)  # noqa: B023, E731
            shards = np.arange(b << (top - few), (b + 1) << (top - few))
            inner = edges[shards[:-1]]
            words, n = np.unique(all_tokens[of(all_tokens)], return_counts=True)
            here = of(pairs)
            found, at, m = np.unique(pairs[here], return_index=True, return_counts=True)
            before = h[here][at]
            word_cuts, pair_cuts = np.searchsorted(words, inner), np.searchsorted(found, inner)
            parts = zip(*(np.split(x, cuts) for x, cuts in ((words, word_cuts), (n, word_cuts), (found, pair_cuts), (m, pair_cuts), (before, pair_cuts))), strict=True)
            for shard, (a, k, c, d, e) in zip(shards.tolist(), parts, strict=True):
                if a.size or c.size:
                    order = np.argsort(e, kind="stable")
                    runs, counts = np.unique(e, return_counts=True)
                    values = (a, k.astype(np.uint32), c[order], d[order].astype(np.uint32), runs, counts.astype(np.uint32))
                    yield {"shard": shard, **{name: x.tobytes() for name, x in zip(_PARTS, values, strict=True)}}

    schema = pa.schema([("shard", pa.int32()), *((k, pa.binary()) for k in _PARTS)])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            for row in packed(held):
                yield pa.RecordBatch.from_pylist([row], schema)
            held.clear()
            waiting = 0

        for b in batches:
            for text in b.column("text"):
                held.append(_tokens(text.as_py()))
                waiting += held[-1].size
                if waiting >= _GATHERED:
                    yield from flush()
        if held:
            yield from flush()
        hand_back()

    def build(group: pd.DataFrame) -> pd.DataFrame:
        def all_of(name: str, kind: type) -> np.ndarray:
            return np.concatenate([np.frombuffer(x, dtype=kind) for x in group[name]])

        words, n = _summed(all_of("words", np.uint64), all_of("words_n", np.uint32).astype(np.int64))
        pairs, counts = all_of("pairs", np.uint64), all_of("pairs_n", np.uint32).astype(np.int64)
        before = np.repeat(all_of("before", np.uint64), all_of("before_n", np.uint32))
        order = np.argsort(pairs, kind="stable")
        pairs, counts, before = pairs[order], counts[order], before[order]
        first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1]))) if pairs.size else np.zeros(0, dtype=np.int64)
        levels = _levels(np.add.reduceat(counts, first)) if pairs.size else np.zeros(0, dtype=np.int64)
        bits = _build(pairs[first], levels)
        histories, mass = _summed(before[first], _value(levels))
        row = {"shard": group["shard"].iloc[0], "bits": bits, "words": words, "words_n": n, "before": histories, "mass": mass.astype(np.float32)}
        out = pd.DataFrame([{k: x.tobytes() if isinstance(x, np.ndarray) else x for k, x in row.items()}])
        hand_back()
        return out

    gathered = docs.select("text").mapInArrow(gather, "shard int, " + ", ".join(f"{k} binary" for k in _PARTS))
    with arrow_rows(spark, _BATCH):
        built = materialize(gathered.groupBy("shard").applyInPandas(build, "shard int, bits binary, words binary, words_n binary, before binary, mass binary"), large_rows=True)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """word, n and what a shard adds to M, a million rows at a time."""
        for b in batches:
            for r in b.to_pylist():
                words, n = np.frombuffer(r["words"], dtype=np.int64), np.frombuffer(r["words_n"], dtype=np.int64)
                before, mass = np.frombuffer(r["before"], dtype=np.int64), np.frombuffer(r["mass"], dtype=np.float32).astype(np.float64)
                for at in range(0, words.size, 1_000_000):
                    part = slice(at, at + 1_000_000)
                    yield pa.RecordBatch.from_arrays([pa.array(words[part]), pa.array(n[part]), pa.nulls(words[part].size, pa.float64())], ["word", "n", "mass"])
                for at in range(0, before.size, 1_000_000):
                    part = slice(at, at + 1_000_000)
                    yield pa.RecordBatch.from_arrays([pa.array(before[part]), pa.nulls(before[part].size, pa.int64()), pa.array(mass[part])], ["word", "n", "mass"])

    rows = built.select("words", "words_n", "before", "mass").mapInArrow(known, "word long, n long, mass double")
    words = materialize(rows.groupBy("word").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass")))
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    return built.select("shard", "bits"), words, shift, n, v


_SCORES = "n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, held_out: Column, broadcast_mb: int = 256, shard_grams: int = _SHARD_GRAMS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score. The model learns from the rows that are not held out."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    text_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    small = text_bytes <= broadcast_mb * 1_000_000 / _TEXT_FOR_MODEL and broadcast_mb > 0
    if small:
        shards, words, shift, n, v = train(rows.where("NOT held_out"), shard_grams)
        small = (shards.agg(F.sum(F.length("bits"))).first()[0] or 0) + 24 * v <= broadcast_mb * 1_000_000
    if small:
        model = [spark.sparkContext.broadcast(part) for part in _parts(shards, words, shift, v)]

        @F.pandas_udf(_SCORES)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            shards_, words_ = _opened(part.value for part in model)
            for texts in batches:
                out, held, waiting = [], [], 0
                for text in texts:
                    held.append(_tokens(text))
                    waiting += held[-1].size
                    if waiting >= _SLICE:
                        out.append(_score_slice(shards_, words_, held, n, v))
                        held, waiting = [], 0
                if held:
                    out.append(_score_slice(shards_, words_, held, n, v))
                yield pd.concat(out, ignore_index=True) if out else pd.DataFrame({"n_tokens": [], "n_known": [], "base_score": [], "score": []})
            hand_back()

        with arrow_rows(spark, _BATCH):
            scored = materialize(rows.select("doc_id", "held_out", run("text").alias("s")))
    else:
        scored, n = _score_packed(rows, text_bytes, shard_grams)
    return scored.select("doc_id", "held_out", "s.n_tokens", "s.n_known", F.lit(n).cast("long").alias("train_tokens"), "s.base_score", "s.score")


def _parts(shards: DataFrame, words: DataFrame, shift: int, v: int) -> Iterator[tuple[int, Shards | Words]]:
    """The model, within the bound of a broadcast, as parts of about `_PART_BYTES` (a shard is never
    cut): the lowest hash of each, and its shards or words. One is read at a time."""
    groups: list[list[tuple[int, int]]] = []
    for one in sorted(tuple(r) for r in shards.select("shard", F.length("bits")).collect()):
        if not groups or sum(size for _, size in groups[-1]) + one[1] > _PART_BYTES:
            groups.append([])
        groups[-1].append(one)
    for layout in groups:
        rows = shards.where(F.col("shard").isin([shard for shard, _ in layout])).collect()
        part = Shards(rows, layout, shift)
        del rows
        yield layout[0][0] << shift, part
        del part
        hand_back()
    top = max(0, int(np.ceil(np.log2(max(1.0, 24 * v / _PART_BYTES)))))
    for i in range(1 << top):
        here = F.shiftrightunsigned("word", 64 - top) == i if top else F.lit(True)
        rows = words.where(here).select("word", "n", "mass").toArrow()
        columns = [rows.column(k).to_numpy().astype(kind, copy=False) for k, kind in (("word", np.int64), ("n", np.int64), ("mass", np.float64))]
        del rows
        yield i << (64 - top), Words(columns[0].view(np.uint64), *columns[1:])
        del columns
        hand_back()


def _opened(parts: Iterable[tuple[int, Shards | Words]]) -> tuple[ShardParts, WordParts]:
    found = list(parts)
    return ShardParts([x for x in found if isinstance(x[1], Shards)]), WordParts([x for x in found if isinstance(x[1], Words)])


def _gathered(shards: DataFrame, words: DataFrame, shift: int) -> tuple[ShardParts, WordParts]:
    """All of the model in one place."""
    return _opened(_parts(shards, words, shift, words.count()))


def _score_slice(shards: Shards, known: Words, texts: list[np.ndarray], n: int, v: int) -> pd.DataFrame:
    starts = np.concatenate(([0], np.cumsum([t.size for t in texts])[:-1]))
    tokens = np.concatenate(texts)
    before = np.concatenate(([END], tokens[:-1]))
    before[starts] = END
    words, back = np.unique(np.append(tokens, END), return_inverse=True)
    count, mass = known.look_up(words)
    of_end, back = back[-1], back[:-1]
    history = np.concatenate(([of_end], back[:-1]))
    history[starts] = of_end
    pairs, at = np.unique(_pair(before, tokens), return_inverse=True)
    p = model_probabilities(shards.levels(pairs)[at], mass[history], count[back], n, v)
    return pd.DataFrame(
        {
            "n_tokens": [t.size for t in texts],
            "n_known": np.add.reduceat((count > 0)[back].astype(np.int64), starts),
            "base_score": np.add.reduceat(base_logs(count, n, v)[back], starts),
            "score": np.add.reduceat(np.log10(p), starts),
        }
    )


@dataclass
class _Layout:
    """The distinct pairs of a batch, in the order in which they go to the shards and come back."""

    pairs: np.ndarray  # distinct, in order
    of: np.ndarray  # the pair of each token
    first: np.ndarray  # a token of each pair
    order: np.ndarray  # of the words by hash
    common: np.ndarray  # of the words by hash: the place among the common words, or -1
    runs: np.ndarray  # of the words by hash: the pairs after them; 0 for common ones
    rare: np.ndarray  # pairs after words that are not common, by history
    rest: np.ndarray  # the other pairs
    rest_of: np.ndarray  # their histories' places among the common words

    def shards(self, words: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, slice, slice, slice]]:
        """Of each shard that has any: its words by hash, and its parts of rare and of rest."""
        at = np.searchsorted(words[self.order], edges)
        ends = np.concatenate(([0], np.cumsum(self.runs)))
        cuts = zip(*(np.concatenate(([0], x, [n])) for x, n in ((at, words.size), (ends[at], self.rare.size), (np.searchsorted(self.pairs[self.rest], edges), self.rest.size))), strict=True)
        before = next(cuts)
        for shard, after in enumerate(cuts):
            parts = [slice(int(a), int(b)) for a, b in zip(before, after, strict=True)]
            if any(p.stop > p.start for p in parts):
                yield shard, *parts
            before = after


def _histories(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The word before each; before the first of a text it is the end, as after its last."""
    before = np.concatenate((codes[-1:], codes[:-1]))
    before[starts] = codes[-1]
    return before


def _laid_out(words: np.ndarray, codes: np.ndarray, starts: np.ndarray, common: np.ndarray) -> _Layout:
    """codes: the place of each token among the words. common: word hashes in order."""
    before = _histories(codes, starts)
    pairs = np.empty(codes.size, dtype=np.uint64)
    for at in range(0, codes.size, _PIECE):
        part = slice(at, at + _PIECE)
        pairs[part] = _pair(words[before[part]], words[codes[part]])
    by = np.argsort(pairs)
    pairs = pairs[by]
    fresh = np.concatenate(([True], pairs[1:] != pairs[:-1]))
    of = np.empty(codes.size, dtype=np.uint32)
    of[by] = np.cumsum(fresh, dtype=np.uint32) - np.uint32(1)
    first, pairs = by[fresh], pairs[fresh]
    del by, fresh
    order = np.argsort(words)
    place = np.empty(words.size, dtype=np.int64)
    place[order] = np.arange(words.size)
    known = np.full(words.size, -1)
    if common.size:
        at = np.minimum(np.searchsorted(common, words[order]), common.size - 1)
        known = np.where(common[at] == words[order], at, -1)
    history = place[before[first]]
    is_rare = known[history] < 0
    rare = np.flatnonzero(is_rare)
    rare = rare[np.argsort(history[rare], kind="stable")]
    runs = np.bincount(history[rare], minlength=words.size)
    rest = np.flatnonzero(~is_rare)
    return _Layout(pairs, of, first, order, known, runs, rare, rest, known[history[rest]])


def _shut(numbers: np.ndarray) -> bytes:
    """Numbers that are mostly small: each byte of them apart, compressed."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if int(numbers.max(initial=0)) <= np.iinfo(k).max)
    planes = np.ascontiguousarray(numbers.astype(kind)[:, None].view(np.uint8).T)
    head = np.array([planes.shape[0], numbers.size], dtype=np.int64).tobytes()
    return head + (pa.compress(planes.tobytes(), "zstd", asbytes=True) if numbers.size else b"")


def _opened_numbers(data: bytes) -> np.ndarray:
    width, size = np.frombuffer(data[:16], dtype=np.int64).tolist()
    if not size:
        return np.zeros(0, dtype=np.int64)
    planes = np.frombuffer(pa.decompress(data[16:], width * size, "zstd", asbytes=True), dtype=np.uint8).reshape(width, size)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


_ASKS = ("words", "words_n", "runs", "pairs", "pairs_n", "rest", "rest_n", "rest_of")
_SHUT = ("words_n", "runs", "pairs_n", "rest_n", "rest_of")
_ANSWERS = ("words_n", "mass", "pairs", "rest")


def _score_packed(rows: DataFrame, size: int, shard_grams: int) -> tuple[DataFrame, int]:
    """rows (doc_id, held_out, text) with their scores, by a model of any size, and N.

    Texts are kept as batches of numbered words. Each batch sends its distinct words and pairs to
    the shards once, with their counts among training texts; a shard counts, builds its filter,
    probes it for all that it was sent, and answers each batch in the order of its question. A pair
    lies in its history's shard, which so knows M; pairs after common words, which would crowd a
    shard, are dealt out by their own hash, and what the shards know of M of these words is summed.
    Batches lie in buckets, so that answers come to them and they are not shuffled.
    """
    spark = rows.sparkSession
    top = max(0, int(np.ceil(np.log2(max(1.0, size / 6 / shard_grams)))))
    edges = np.arange(1, 1 << top, dtype=np.uint64) << np.uint64(64 - top) if top else np.zeros(0, dtype=np.uint64)
    id_field = rows.select("doc_id").schema[0]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        ids: list = []
        out: list[bool] = []
        waiting, number = 0, TaskContext.get().partitionId() << 32

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            nonlocal waiting, number
            sizes = pa.array([t.size for t in held], pa.int64())
            tokens = np.concatenate(held)
            held.clear()
            words, at, n = np.unique(tokens, return_inverse=True, return_counts=True)
            del tokens
            order = np.argsort(-n, kind="stable")  # small numbers for common words
            place = np.empty(words.size, dtype=np.uint32)
            place[order] = np.arange(words.size, dtype=np.uint32)
            codes = place[at]
            del at
            row = [pa.array([number]), *(pa.ListArray.from_arrays([0, len(x)], x) for x in (pa.array(ids, kind), pa.array(out, pa.bool_()), sizes))]
            row += [pa.array([x], pa.binary()) for x in (words[order].tobytes(), _shut(n[order][:_COMMON]), _shut(codes))]
            ids.clear()
            out.clear()
            waiting, number = 0, number + 1
            return pa.RecordBatch.from_arrays(row, ["batch", "doc_id", "held_out", "sizes", "words", "n", "codes"])

        for b in batches:
            kind = b.schema.field("doc_id").type
            for doc_id, is_out, text in zip(*(b.column(k) for k in ("doc_id", "held_out", "text")), strict=True):
                held.append(_tokens(text.as_py()))
                ids.append(doc_id.as_py())
                out.append(is_out.as_py())
                waiting += held[-1].size
                if waiting >= _TOGETHER:
                    yield flush(kind)
        if held:
            yield flush(kind)
        hand_back()

    schema = f"batch long, doc_id array<{id_field.dataType.simpleString()}>, held_out array<boolean>, sizes array<long>, words binary, n binary, codes binary"
    path, name = shared_dir(spark), f"lm_{uuid.uuid4().hex}"
    buckets = min(100_000, max(8, 4 * int(size / 6 / _TOGETHER)))
    plain = {"compression": "none", "parquet.hadoop.vectored.io.enabled": "false"}  # as materialize() does for large rows
    with arrow_rows(spark, _BATCH):
        rows.select("doc_id", "held_out", "text").mapInArrow(numbered, schema).write.bucketBy(buckets, "batch").options(path=path, **plain).saveAsTable(name)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    texts = spark.table(name)

    def commonest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words, n in zip(b.column("words"), b.column("n"), strict=True):
                n = _opened_numbers(n.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(words.as_py(), dtype=np.int64)[: n.size]), pa.array(n.astype(np.int64))], ["word", "n"])

    found = texts.select("words", "n").mapInArrow(commonest, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(_COMMON)
    common = np.sort(np.array([r["word"] for r in found.collect()], dtype=np.int64).view(np.uint64))

    def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, _Layout]:
        words, codes, sizes = np.frombuffer(row["words"], dtype=np.uint64), _opened_numbers(row["codes"]), np.array(row["sizes"])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        return words, codes, starts, _laid_out(words, codes, starts, common)

    asked = pa.schema([("shard", pa.int32()), ("batch", pa.int64()), *((k, pa.binary()) for k in _ASKS)])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {k: b.column(k)[i].as_py() for k in ("batch", "held_out", "sizes", "words", "codes")}
                words, codes, _, x = opened(row)
                learnt = np.repeat(~np.array(row["held_out"]), row["sizes"])
                n = np.bincount(codes[learnt], minlength=words.size)[x.order]
                m = np.bincount(x.of[learnt], minlength=x.pairs.size)
                del codes, learnt
                by_hash = words[x.order]
                for shard, w, p, r in x.shards(words, edges):
                    rare, rest = x.rare[p], x.rest[r]
                    values = (by_hash[w].tobytes(), _shut(n[w]), _shut(x.runs[w]), x.pairs[rare].tobytes(), _shut(m[rare]), x.pairs[rest].tobytes(), _shut(m[rest]), _shut(x.rest_of[r]))
                    yield pa.RecordBatch.from_pylist([{"shard": shard, "batch": row["batch"], **dict(zip(_ASKS, values, strict=True))}], asked)
        hand_back()

    def answer(group: pa.Table) -> pa.Table:
        def each(name: str) -> list[np.ndarray]:
            return [_opened_numbers(x.as_py()) if name in _SHUT else np.frombuffer(x.as_py(), dtype=np.uint64) for x in group.column(name)]

        def joined(parts: list[np.ndarray]) -> np.ndarray:
            return np.concatenate([x.astype(np.int64) for x in parts])

        asked_words, rare, rest = each("words"), each("pairs"), each("rest")
        words, at = np.unique(np.concatenate(asked_words), return_inverse=True)
        n = np.bincount(at, joined(each("words_n")), words.size).astype(np.int64)
        history = np.concatenate((np.repeat(at, joined(each("runs"))), words.size + joined(each("rest_of")))).astype(np.uint32)
        pairs = np.concatenate([*rare, *rest])
        by = np.argsort(pairs)
        pairs = pairs[by]
        fresh = np.concatenate((np.ones(min(1, pairs.size), dtype=bool), pairs[1:] != pairs[:-1]))
        of = np.empty(pairs.size, dtype=np.uint32)
        of[by] = np.cumsum(fresh, dtype=np.uint32) - np.uint32(1)
        pairs, history = pairs[fresh], history[by[fresh]]
        del by, fresh
        counts = np.bincount(of, joined([*each("pairs_n"), *each("rest_n")]), pairs.size)
        levels, learnt = _levels(counts), counts > 0
        mass = 2 * np.bincount(history, _value(levels), words.size + common.size)
        del history, counts
        bits = _build(pairs[learnt], levels[learnt])
        probed, shards = np.empty(pairs.size, dtype=np.uint8), Shards([{"shard": 0, "bits": bits}], [(0, bits.size)], 64)
        for i in range(0, pairs.size, _PIECE):
            probed[i : i + _PIECE] = shards.levels(pairs[i : i + _PIECE])
        probed = probed[of]
        of_words, of_pairs = (np.split(x, np.cumsum([p.size for p in parts])[:-1]) for x, parts in ((at, asked_words), (probed, [*rare, *rest])))
        values = [(-1, np.array([n.sum(), (n > 0).sum()]), mass[words.size :], np.zeros(0), np.zeros(0))]
        values += [(b, n[w], mass[w], p, r) for b, w, p, r in zip(group.column("batch").to_pylist(), of_words, of_pairs[: len(rare)], of_pairs[len(rare) :], strict=True)]
        shard = group.column("shard")[0].as_py()
        out = pa.Table.from_pylist([{"shard": shard, "batch": b, **{k: _shut(x) for k, x in zip(_ANSWERS, v, strict=True)}} for b, *v in values], answered)
        hand_back()
        return out

    answered = pa.schema([("shard", pa.int32()), ("batch", pa.int64()), *((k, pa.binary()) for k in _ANSWERS)])
    asks = texts.select("batch", "held_out", "sizes", "words", "codes").mapInArrow(ask, "shard int, batch long, " + ", ".join(f"{k} binary" for k in _ASKS))
    answers = materialize(asks.groupBy("shard").applyInArrow(answer, "shard int, batch long, " + ", ".join(f"{k} binary" for k in _ANSWERS)), large_rows=True)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """N at place -1, V at -2, and twice M of the common words at theirs."""
        for b in batches:
            for numbers, mass in zip(b.column("words_n"), b.column("mass"), strict=True):
                value = np.concatenate([_opened_numbers(x.as_py()).astype(np.int64) for x in (numbers, mass)])
                place = np.concatenate(([-1, -2], np.arange(value.size - 2)))
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(value)], ["place", "value"])

    sums = answers.where("batch = -1").select("words_n", "mass").mapInArrow(known, "place long, value long").groupBy("place").agg(F.sum("value").alias("value"))
    total = {r["place"]: r["value"] for r in sums.collect()}
    n_all, v = total.get(-1, 0), total.get(-2, 0)
    common_mass = np.array([total.get(i, 0) for i in range(common.size)]) / 2.0

    def finish(text: pa.Table, answers: pa.Table) -> pa.Table:
        row = {k: text.column(k)[0].as_py() for k in ("sizes", "words", "codes")}
        words, codes, starts, x = opened(row)
        by_shard = np.argsort(answers.column("shard").to_numpy()).tolist()
        got = {k: np.concatenate([_opened_numbers(answers.column(k)[i].as_py()).astype(np.int64) for i in by_shard]) for k in _ANSWERS}
        n, mass, levels = np.empty(words.size, dtype=np.int64), np.empty(words.size), np.empty(x.pairs.size, dtype=np.uint8)
        n[x.order] = got["words_n"]
        mass[x.order] = np.where(x.common >= 0, common_mass[x.common], got["mass"] / 2.0) if common.size else got["mass"] / 2.0
        levels[x.rare], levels[x.rest] = got["pairs"], got["rest"]
        before = _histories(codes, starts)[x.first]
        model = np.log10(model_probabilities(levels, mass[before], n[codes[x.first]], n_all, v))
        lists = [text.column(k).combine_chunks().flatten() for k in ("doc_id", "held_out", "sizes")]
        sums = [np.add.reduceat(y, starts) for y in ((n > 0).astype(np.int64)[codes], base_logs(n, n_all, v)[codes], model[x.of])]
        out = pa.Table.from_arrays([*lists, *map(pa.array, sums)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
        hand_back()
        return out

    both = texts.groupBy("batch").cogroup(answers.where("batch >= 0").groupBy("batch"))
    scored = both.applyInArrow(finish, f"doc_id {id_field.dataType.simpleString()}, held_out boolean, {_SCORES}")
    scored = materialize(scored.select("doc_id", "held_out", F.struct("n_tokens", "n_known", "base_score", "score").alias("s")))
    spark.sql(f"DROP TABLE {name}")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    release(answers)
    return scored, n_all


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the score of every document; a seventh is held out."""
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), crc_mod("doc_id", 7) == 2)
