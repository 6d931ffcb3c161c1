"""Token ids of texts by a public tokenizer file, whole Arrow batches at a time.

The tokenizer drops white space and no token spans it, so a text's ids are those of its
white-space chunks in a row. The chunks of a batch are dictionary-encoded, each distinct one
gets its ids once, and the ids of all texts are gathered from them by position.

A chunk of Latin letters with a run of marks behind it is two pieces that the tokenizer would
cut it into anyway. Arrow cuts and lower-cases all chunks at once; each distinct piece is looked
up once, and new ones go to the tokenizer's own model, without its normaliser.
Any other chunk goes through the whole chain. The ids of the first `cache_chunks` pieces and as
many other chunks are kept for later batches, as numbers in a row. Python workers live
on, and whatever else runs in them later has to share their memory.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from changelens.llm.common import hand_back

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
CACHE_CHUNKS = 600_000  # some 200 MB a Python worker; fewer where other stages share its memory
_SIMPLE = r"(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<marks>[!-&(-/:-@\[-`{-~]*)"  # letters, then marks but no apostrophe
_LONGEST = 64  # longer chunks are not kept
SLICE_MB = 4  # of text whose chunks are looked up at a time; some 45 MB a Python worker for each


def _gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of pool that begin at starts, one behind the other, and where each run begins
    (and the last one ends)."""
    bounds = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(sizes)))
    return pool[np.repeat(starts - bounds[:-1], sizes) + np.arange(bounds[-1])], bounds


def _joined(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, and where each list begins (and the last one ends)."""
    ids = np.fromiter(itertools.chain.from_iterable(found), dtype="<u2")
    return ids, np.cumsum([0, *map(len, found)])


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class _Kept:
    """Strings with their ids, the first `most` of those that are not long."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.places = {"": 0}
        self.ids, self.bounds = np.zeros(0, dtype="<u2"), np.zeros(2, dtype=np.int64)

    def find(self, strings: list[str], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where those of each string begin in it and how many they are."""
        at = np.fromiter(map(self.places.get, strings, itertools.repeat(-1)), dtype=np.int64, count=len(strings))
        pool, bounds = self.ids, self.bounds
        missing = np.flatnonzero(at < 0)
        if missing.size:
            new = [strings[i] for i in missing.tolist()]
            ids, ends = encode(new)
            at[missing] = bounds.size - 1 + np.arange(missing.size)
            pool, bounds = np.concatenate((pool, ids)), np.concatenate((bounds, bounds[-1] + ends[1:]))
            self._keep(new, ids, ends)
        return pool, bounds[at], bounds[at + 1] - bounds[at]

    def _keep(self, new: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        room = self.most - len(self.places)
        if room <= 0:
            return
        on = np.flatnonzero(np.fromiter(map(len, new), dtype=np.int64, count=len(new)) <= _LONGEST)[:room]
        kept, ends = _gather(ids, ends[on], ends[on + 1] - ends[on])
        self.places.update(zip([new[i] for i in on.tolist()], range(self.bounds.size - 1, self.bounds.size - 1 + on.size), strict=True))
        self.ids, self.bounds = np.concatenate((self.ids, kept)), np.concatenate((self.bounds, self.bounds[-1] + ends[1:]))


class Encoder:
    """Ids of texts as little-endian 16-bit numbers."""

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        # The model's spelling of letters beyond ASCII, a sign for each byte.
        spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {c: spelled.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        # A special token within such a chunk would itself be letters with marks behind.
        special = any(re.fullmatch(_SIMPLE, t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.simple = rf"[^\x00-\x{{10FFFF}}]{_SIMPLE}" if special else f"^{_SIMPLE}$"  # the former matches nothing
        self.chunks, self.pieces = _Kept(cache_chunks), _Kept(cache_chunks)

    def _model(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces that are normal and cut already, in a row, and their bounds."""
        tokenize = self.tokenizer.model.tokenize
        return _joined([[t.id for t in tokenize(p if p.isascii() else p.translate(self.bytes))] for p in pieces])

    def _whole(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks by the whole chain, and their bounds."""
        return _joined([e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)])

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks in a row, and their bounds."""
        cut = pc.extract_regex(chunks, self.simple)
        odd = cut.is_null().to_numpy(zero_copy_only=False)
        letters, marks = (pc.fill_null(pc.struct_field(cut, name), "").dictionary_encode() for name in ("letters", "marks"))
        lower = pc.utf8_lower(letters.dictionary).dictionary_encode()
        n = len(lower.dictionary)
        pool, starts, sizes = self.pieces.find(_strings(lower.dictionary) + _strings(marks.dictionary), self._model)
        use = np.empty((len(chunks), 2), dtype=np.int64)
        use[:, 0] = lower.indices.to_numpy()[letters.indices.to_numpy()]
        use[:, 1] = n + marks.indices.to_numpy()
        starts, sizes = starts[use], sizes[use]
        if odd.any():
            more, first, size = self.chunks.find(_strings(chunks.filter(pa.array(odd))), self._whole)
            starts[odd, 0], sizes[odd, 0] = pool.size + first, size
            pool = np.concatenate((pool, more))
        ids, bounds = _gather(pool, starts.ravel(), sizes.ravel())
        return ids, bounds[::2]

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text begins (and the last one ends).
        A null text has no ids."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        split = pc.ascii_split_whitespace(texts)
        # White space at an end leaves an empty chunk, which has no ids.
        coded = split.flatten().dictionary_encode()
        pool, bounds = self._distinct(coded.dictionary)
        use = coded.indices.to_numpy()
        ids, ends = _gather(pool, bounds[use], bounds[use + 1] - bounds[use])
        return ids, ends[np.asarray(split.offsets) - split.offsets[0].as_py()]

    def encode(self, text: str | None) -> bytes:
        return self.encode_batch(pa.array([text], pa.string()))[0].tobytes()


def _slices(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """texts in parts of about so many bytes."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + size, side="right")))
        yield texts.slice(at, end - at)
        at = end


def with_end(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Each text's ids with END_ID behind them, as binary values."""
    ended = np.insert(ids, bounds[1:], np.uint16(END_ID)).astype("<u2", copy=False)
    at = (bounds + np.arange(bounds.size)) * 2
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), bounds.size - 1, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(ended.tobytes())]).cast(pa.binary())


@cache
def _encoder(path: str, cache_chunks: int) -> Encoder:
    return Encoder(path, cache_chunks)


def forget() -> None:
    """Let go of the tokenizer and its caches, some 40 MB, in a worker that goes on with other work."""
    if _encoder.cache_info().currsize:
        _encoder.cache_clear()
        hand_back()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def token_ids(text: str, path: str | None = None, cache_chunks: int = CACHE_CHUNKS, slice_mb: int = SLICE_MB) -> Column:
    """The ids of the text column as little-endian 16-bit numbers, END_ID last. The path is
    one that executors can open; the default is looked up on each executor."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(path or default_path(), cache_chunks)
        for texts in batches:
            parts = [with_end(*encoder.encode_batch(part)) for part in _slices(texts, slice_mb << 20)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.binary())
        hand_back()

    return run(text)
