"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is binned; cyclic boosting adds one shallow tree at a time, feature
after feature, into a lookup table per feature, and then into tables over the feature pairs
that still explain the residual. A score is the logistic of a sum of table look-ups, for a
whole batch at once.

The model is fitted on at most about `fit_rows` labelled texts, chosen by a hash; features
always read whole texts, and every text is scored.

Defined results: a null doc_id is not held out and not learned from; a null text counts as empty, and an empty text is scored like any other;
labels that are null are not learned from, labels that repeat for a document count once (the
smallest); without labels of both kinds the score is the smoothed share of label 1; repeated rows
and extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm.common import crc_mod, hand_back, table, word_hashes

FEATURES = (
    "log_words", "mean_word", "upper", "symbols", "odd_symbols", "digits", "exclamations",
    "distinct_words", "top_word", "repeated_next", "distinct_pairs", "repeated_lines", "line_words", "bare_tokens",
)


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _table("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _table("0123456789")
_SPACE = _table(" \t\n\r\x0b\x0c")
_PROSE = _table(".,;:'\"()-?")
_WIDE = np.arange(256) >= 128
_BARE = ~(_UPPER | _LOWER | _DIGIT | _WIDE)


def features(text: str | None) -> np.ndarray:
    """The features of a whole text. Rates are shrunk as if some clean prose stood before
    the text, so that a single event in a short text is no signal."""
    data = (text or "").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, dtype=np.uint8)
    out = np.zeros(len(FEATURES))
    counts = np.bincount(raw, minlength=256)
    n = max(1, int(counts[~_SPACE].sum()))
    upper, lower = int(counts[_UPPER].sum()), int(counts[_LOWER].sum())
    symbols = int(counts[_BARE & ~_SPACE].sum())
    words = word_hashes(data)
    w = words.size
    out[0] = np.log1p(w)
    out[1] = n / max(1, w)
    out[2] = upper / (upper + lower + 40)
    out[3] = symbols / (n + 40)
    out[4] = int(counts[_BARE & ~_SPACE & ~_PROSE].sum()) / (n + 40)
    out[5] = int(counts[_DIGIT].sum()) / (n + 200)
    out[6] = int(counts[ord("!")]) / (n + 40)
    if w:
        tops = np.unique(words, return_counts=True)[1]
        out[7] = (tops.size + 20) / (w + 20) ** 0.85
        out[8] = tops.max() / (w + 20)
        inside = ~_SPACE[raw]
        token = np.cumsum(np.diff(np.concatenate(([False], inside)).astype(np.int8)) == 1)
        lettered = np.zeros(w + 1, dtype=bool)
        lettered[token[inside & ~_BARE[raw]]] = True
        out[13] = (w - lettered[1:].sum()) / (w + 4)
    out[9] = (words[1:] == words[:-1]).sum() / (w + 20)
    with np.errstate(over="ignore"):
        pairs = words[1:] * np.uint64(0x9E3779B97F4A7C15) + words[:-1]
    out[10] = (np.unique(pairs).size + 21) / (max(1, w) + 20)
    lines = [x for x in data.split(b"\n") if x.strip()]
    out[11] = (len(lines) - len(set(lines))) / (len(lines) + 4)
    out[12] = np.log1p(w / len(lines)) if lines else 0
    return out


@dataclass(frozen=True)
class Model:
    """Bin edges and additive tables: one per feature, one per chosen pair of features."""

    intercept: float
    edges: tuple = ()
    tables: tuple = ()
    coarse: tuple = ()
    pairs: tuple = field(default_factory=tuple)

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.intercept)
        for j, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            logit += values[np.searchsorted(edges, x[:, j], side="right")]
        for i, j, values in self.pairs:
            logit += values[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _edges(col: np.ndarray, bins: int) -> np.ndarray:
    """Cut points between quantiles, halfway between neighbouring values."""
    values = np.unique(col)
    if values.size <= 1:
        return np.zeros(0)
    at = np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
    nxt = values[np.minimum(np.searchsorted(values, at, side="right"), values.size - 1)]
    return np.unique((at + nxt)[at < nxt] / 2)


def _step(g: np.ndarray, h: np.ndarray, leaves: int, damp: float) -> np.ndarray:
    """A tree of so many leaves over ordered bins: the value of each bin."""
    cg, ch = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best, at = 1e-9, None
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a < 2:
                continue
            k = np.arange(a + 1, b)
            gl, hl, gr, hr = cg[k] - cg[a], ch[k] - ch[a], cg[b] - cg[k], ch[b] - ch[k]
            gain = gl**2 / (hl + damp) + gr**2 / (hr + damp) - (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + damp)
            if gain.max() > best:
                best, at = gain.max(), int(k[gain.argmax()])
        if at is None:
            break
        cuts = sorted([*cuts, at])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + damp)
    return out


def _quarter(g: np.ndarray, h: np.ndarray, damp: float) -> tuple[float, np.ndarray]:
    """The best cut of a grid into four parts: its gain and the value of each cell."""
    gs, hs = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, out = 0.0, np.zeros_like(g)
    total = gs[-1, -1] ** 2 / (hs[-1, -1] + damp)
    for a in range(g.shape[0] - 1):
        g1, h1 = gs[a, :-1], hs[a, :-1]
        g2, h2 = gs[a, -1] - g1, hs[a, -1] - h1
        g3, h3 = gs[-1, :-1] - g1, hs[-1, :-1] - h1
        g4, h4 = gs[-1, -1] - g1 - g2 - g3, hs[-1, -1] - h1 - h2 - h3
        gain = sum(x**2 / (y + damp) for x, y in ((g1, h1), (g2, h2), (g3, h3), (g4, h4))) - total
        if gain.size and gain.max() > best:
            b = int(gain.argmax())
            best = float(gain[b])
            out = np.empty_like(g)
            out[: a + 1, : b + 1], out[: a + 1, b + 1 :] = g1[b] / (h1[b] + damp), g2[b] / (h2[b] + damp)
            out[a + 1 :, : b + 1], out[a + 1 :, b + 1 :] = g3[b] / (h3[b] + damp), g4[b] / (h4[b] + damp)
    return best, out


def boost(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 60, rate: float = 0.2, leaves: int = 3, n_pairs: int = 6, pair_bins: int = 8, pair_rounds: int = 20, damp: float = 5.0) -> Model:
    """Fit the tables to features x and labels y (0 or 1)."""
    share = (y.sum() + 1) / (len(y) + 2)
    intercept = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Model(intercept)
    d = x.shape[1]
    edges = [_edges(x[:, j], bins) for j in range(d)]
    at = [np.searchsorted(edges[j], x[:, j], side="right") for j in range(d)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    logit = np.full(len(y), intercept)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(d):
            g, h = gradient()
            size = len(tables[j])
            add = rate * _step(np.bincount(at[j], g, size), np.bincount(at[j], h, size), leaves, damp)
            tables[j] += add
            logit += add[at[j]]
    coarse = [_edges(x[:, j], pair_bins) for j in range(d)]
    rough = [np.searchsorted(coarse[j], x[:, j], side="right") for j in range(d)]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, h = gradient()
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        cell = rough[i] * shape[1] + rough[j]
        n = shape[0] * shape[1]
        return cell, np.bincount(cell, g, n).reshape(shape), np.bincount(cell, h, n).reshape(shape)

    gains = sorted(((_quarter(*grid(i, j)[1:], damp)[0], -i, -j) for i in range(d) for j in range(i + 1, d)), reverse=True)
    chosen = [(-i, -j) for gain, i, j in gains[:n_pairs] if gain > 0]
    pair_tables = {p: np.zeros((len(coarse[p[0]]) + 1, len(coarse[p[1]]) + 1)) for p in chosen}
    for _ in range(pair_rounds):
        for p in chosen:
            cell, g, h = grid(*p)
            add = rate * _quarter(g, h, damp)[1]
            pair_tables[p] += add
            logit += add.reshape(-1)[cell]
    return Model(intercept, tuple(edges), tuple(tables), tuple(coarse), tuple((i, j, t) for (i, j), t in pair_tables.items()))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000) -> Model:
    """Fit on the labelled rows: docs (doc_id, text), labels (doc_id, quality). About
    fit_rows of them are used, and never more than twice as many; of rows that repeat one. doc_id
    only joins and draws the sample."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = known.count()
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, fit_rows / max(1, n)))
    rows = docs.select("doc_id", "text").where(drawn).join(known.where(drawn), "doc_id")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"h": b["h"], "quality": b["quality"].astype(float), "x": [features(t) for t in b["text"]]})

    got = rows.select(F.xxhash64("doc_id", "text").alias("h"), "quality", "text").mapInPandas(measure, "h long, quality double, x array<double>")
    got = got.dropDuplicates(["h"]).orderBy("h").limit(2 * fit_rows).collect()
    got = sorted((float(r["quality"] > 0.5), tuple(r["x"])) for r in got)
    x = np.array([r[1] for r in got]).reshape(-1, len(FEATURES))
    return boost(x, np.array([r[0] for r in got]))


def score(docs: DataFrame, model: Model, keep: float = 0.7) -> DataFrame:
    """docs (with a column text) and score, predicted. Only texts go to Python."""

    @F.pandas_udf("score double, predicted int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            s = model.score(np.array([features(t) for t in texts]).reshape(-1, len(FEATURES)))
            yield pd.DataFrame({"score": s, "predicted": (s >= keep).astype(np.int32)})
        hand_back()

    kept = [f"`{c}`" for c in docs.columns if c not in ("score", "predicted", "_p")]
    return docs.select(*kept, run("text").alias("_p")).select(*kept, "_p.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the quality of every document; a quarter of the labels is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = fit(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    found = score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "score", "predicted")
