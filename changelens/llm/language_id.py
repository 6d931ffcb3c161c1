"""Language identification by nearest centroid.

A text is a TF-IDF vector of hashed character 1- to 3-grams over its lower-cased letters
(everything else is a word boundary), with length one. Each language has several centroids
from spherical k-means over its labelled texts; a text takes the language of the centroid
with the largest cosine. It is rejected by distance if that cosine is below the floor of the
language and the text's length: the `quantile` of what labelled texts of the language and
about that length reach, less `slack` of it (twice the slack for texts of under 512 n-grams,
whose cosines scatter more).

The model is fitted on at most about `fit_rows` labelled texts, dealt evenly over the
languages and chosen by a hash; whole texts are used for fitting and for prediction.

Defined results: a text that is null or has no letter gets `und`, score 0 and is rejected;
rows of a null language are not learned from but are predicted; without any labelled text
everything is `und`; ties go to the language that sorts first; a text shorter than all
labelled ones of its language is not rejected by distance; repeated rows and extra columns
pass through (but for lang_pred, score and rejected, which are replaced); an empty table gives
an empty result; a null doc_id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm.common import bounded, crc_mod, hand_back, table

DIM = 4096
_CHUNK = 1 << 20
_BLOCK = 256  # texts scored by one matrix product
_CLASSES = 21  # of length
_FLOOR_ROWS = 20


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    out = np.zeros(0x110000, dtype=bool)
    for lo in range(0, 0x110000, 0x1000):
        if 0xD800 <= lo < 0xE000:
            continue
        out[lo : lo + 0x1000] = [chr(c).isalpha() for c in range(lo, lo + 0x1000)]
    return out


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed 1- to 3-grams of a whole text; None without a letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.zeros(DIM, dtype=np.int64)
    any_letter = False
    carry = np.array([32], dtype=np.uint32)  # the two marks before a chunk: n-grams span chunks
    for at in range(0, points.size, _CHUNK):
        part = points[at : at + _CHUNK]
        known = _letters()[part]
        any_letter = any_letter or bool(known.any())
        seq = np.concatenate((carry, np.where(known, part, np.uint32(32))))
        gap = seq == 32
        seq = seq[np.concatenate(([True], ~(gap[1:] & gap[:-1])))]
        fresh = carry.size
        hashed = seq * np.uint32(0x9E3779B1)
        two = (hashed[:-1] ^ (seq[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
        three = (two[:-1] ^ (seq[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        for grams, n in ((hashed, 1), (two, 2), (three, 3)):
            new = grams[max(0, fresh - n + 1) :] if fresh > 1 or n > 1 else grams[fresh:]
            out += np.bincount(new >> np.uint32(20), minlength=DIM)
        carry = seq[-2:]
    return out if any_letter else None


def length_class(grams: int) -> int:
    return min(int(grams).bit_length(), _CLASSES - 1)


@dataclass(frozen=True)
class Model:
    """idf of each hashed gram, unit centroids and their languages, and the least cosine
    accepted per centroid and length class."""

    idf: np.ndarray
    centroids: np.ndarray
    owners: tuple[str, ...]
    floors: np.ndarray

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and rejection of each text."""
        n = len(texts)
        langs, scores, rejected = ["und"] * n, np.zeros(n), np.ones(n, dtype=bool)
        if not self.owners:
            return langs, scores, rejected
        for at in range(0, n, _BLOCK):
            rows, where, sizes = [], [], []
            for i in range(at, min(n, at + _BLOCK)):
                counts = gram_counts(texts[i])
                if counts is not None:
                    rows.append(counts)
                    where.append(i)
                    sizes.append(length_class(counts.sum()))
            if not rows:
                continue
            cosines = weigh(np.stack(rows), self.idf) @ self.centroids.T
            best = cosines.argmax(axis=1)
            top = np.clip(cosines[np.arange(len(where)), best].astype(float), 0.0, 1.0)
            scores[where] = top
            rejected[where] = top < self.floors[best, sizes]
            for i, c in zip(where, best, strict=True):
                langs[i] = self.owners[c]
        return langs, scores, rejected


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of counts as unit TF-IDF vectors."""
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1), dtype=np.float32), 0).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Up to k unit centroids of unit rows: farthest-first start, then Lloyd steps by cosine."""
    centres = [x.mean(axis=0)]
    far = np.full(len(x), np.inf)
    for _ in range(1, min(k, len(x))):
        far = np.minimum(far, 1 - x @ (centres[-1] / max(np.linalg.norm(centres[-1]), 1e-12)))
        if far.max() <= 1e-6:
            break
        # a far but not an extreme row, so that one odd text does not become a centroid
        centres.append(x[np.argsort(far, kind="stable")[int(0.95 * (len(x) - 1))]])
    c = np.stack(centres)
    for _ in range(rounds):
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        to = (x @ c.T).argmax(axis=1)
        new = np.stack([x[to == j].mean(axis=0) if (to == j).any() else c[j] for j in range(len(c))])
        if np.allclose(new, c):
            break
        c = new
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def _floors(cosines: np.ndarray, sizes: np.ndarray, quantile: float, slack: float) -> np.ndarray:
    """The least cosine accepted per length class, from those of labelled texts. A class needs
    _FLOOR_ROWS texts in it and the classes beside it; others are interpolated."""
    out = np.full(_CLASSES, np.nan)
    for k in range(_CLASSES):
        near = cosines[abs(sizes - k) <= 1]
        if near.size >= _FLOOR_ROWS and (sizes == k).any():
            out[k] = np.quantile(near, quantile) * (1 - slack * (2 if k < 10 else 1))
    known = np.flatnonzero(~np.isnan(out))
    if known.size == 0:
        return np.zeros(_CLASSES)
    out = np.interp(np.arange(_CLASSES), known, out[known])
    out[: known[0]] = 0.0  # shorter than any class seen: distance tells nothing
    return out


def fit(labelled: DataFrame, fit_rows: int = 4000, clusters: int = 4, quantile: float = 0.005, slack: float = 0.15) -> Model:
    """Fit on the rows of labelled (text, lang, and a column doc_id that only draws the
    sample). About fit_rows texts are used, evenly over the languages, and never more than
    twice as many; of rows that repeat one."""
    empty = Model(np.zeros(DIM, np.float32), np.zeros((0, DIM), np.float32), (), np.zeros((0, _CLASSES)))
    labelled = labelled.select("doc_id", "text", "lang").where("lang IS NOT NULL")
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    languages = counts.count()
    if languages == 0:
        return empty
    # Rows that share a doc_id, or have none, are drawn one by one.
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20))
    drawn = labelled.join(bounded(counts, 100_000), "lang").where(place < F.lit(fit_rows / languages * (1 << 20)) / F.col("n"))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(h, lang, gram_counts(t)) for h, lang, t in zip(b["h"], b["lang"], b["text"], strict=True)]
            found = [x for x in found if x[2] is not None]
            if not found:  # Arrow takes no frame of binary columns without rows
                continue
            yield pd.DataFrame(
                {
                    "h": [h for h, _, _ in found],
                    "lang": [lang for _, lang, _ in found],
                    "at": [np.flatnonzero(c).astype(np.int16).tobytes() for _, _, c in found],
                    "n": [np.minimum(c[c > 0], 2**31 - 1).astype(np.int32).tobytes() for _, _, c in found],
                }
            )

    rows = drawn.select(F.xxhash64("doc_id", "text").alias("h"), "lang", "text").mapInPandas(vectors, "h long, lang string, at binary, n binary")
    rows = rows.dropDuplicates(["h", "lang"]).orderBy("h", "lang").limit(2 * fit_rows).collect()
    if not rows:
        return empty
    rows.sort(key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["n"])))
    x = np.zeros((len(rows), DIM), dtype=np.int32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], dtype=np.int16)] = np.frombuffer(r["n"], dtype=np.int32)
    idf = (np.log((1 + len(rows)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    sizes = np.array([length_class(s) for s in x.sum(axis=1)])
    v = weigh(x, idf)
    names = np.array([r["lang"] for r in rows])
    centroids, owners, floors = [], [], []
    for lang in sorted(set(names)):
        mine = v[names == lang]
        c = _cluster(mine, clusters)
        centroids.append(c)
        owners += [lang] * len(c)
        floors += [_floors((mine @ c.T).max(axis=1), sizes[names == lang], quantile, slack)] * len(c)
    return Model(idf, np.concatenate(centroids).astype(np.float32), tuple(owners), np.stack(floors))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs (with a column text) and lang_pred, score, rejected. Only texts go to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM x (clusters x languages + 1) floats

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores, rejected = shared.value.score(list(texts))
            yield pd.DataFrame({"lang_pred": langs, "score": scores, "rejected": rejected})
        hand_back()

    kept = [f"`{c}`" for c in docs.columns if c not in ("lang_pred", "score", "rejected", "_p")]
    return docs.select(*kept, run("text").alias("_p")).select(*kept, "_p.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the language of every document; a third of the labels is held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    model = fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    found = predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")
