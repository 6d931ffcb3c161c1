"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is normalised (a space in front, spaces written as U+2581) and cut into symbols, at
first its code points. All adjacent symbols whose concatenation is a piece stand on an agenda;
the pair of the highest score, then the leftmost, is merged, its new neighbours join the
agenda, and so on until it is empty. A symbol that is no piece becomes its UTF-8 bytes.

Two code points that are adjacent in no piece never meet in one symbol, so a text is cut there
beforehand without any change of result. The agenda then runs once for each distinct chunk of
a slice of an Arrow batch, and the ids of all texts are gathered from them by position. The
ids of the chunks that came last are kept for later batches, at most twice `cache_chunks`.

Decoding gathers the pieces' bytes, drops control pieces and the space that normalising put in
front, and replaces each byte that is not UTF-8.

`tokenize` can hold each text's ids and decoded text against the sentencepiece library, batch
by batch, in the column `agrees`.

Defined results: a null text is empty, an empty text has the two ids of begin and end and
decodes to an empty text; rows that repeat give a result each; texts of any length are encoded
whole; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm.common import hand_back, table

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = range(1, 7)
_SHORT = 48  # up to so many symbols the agenda is a list, beyond that a heap
_NONE = 1 << 60
_LONGEST = 64  # longer chunks are not kept
_SECTION = 1 << 20  # code points of a text that are cut into chunks at a time
_SLICE = 2 << 20  # bytes of text that are encoded or decoded at a time


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message as (number, value)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class Vocabulary:
    """Pieces, scores and settings of a model file."""

    def __init__(self, path: str, cache_chunks: int = 200_000) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        proto = list(_fields(self.library.serialized_model_proto()))
        trainer, normalizer = (dict(_fields(next((v for k, v in proto if k == n), b""))) for n in (2, 3))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0):
            raise ValueError("not a merge-type vocabulary with byte fallback")
        if normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24, 0):
            raise ValueError("a normaliser that does more than mark spaces")
        self.text: list[str] = []
        score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        kinds = []
        for number, value in proto:
            if number == 1:
                piece = dict(_fields(value))
                text, kind = piece[1].decode(), piece.get(3, _NORMAL)
                if kind in (_USER, _UNUSED):
                    raise ValueError("pieces that are user-defined or unused")
                if kind == _NORMAL:
                    score[text], self.id[text] = struct.unpack("<f", piece[2])[0], len(kinds)
                self.text.append(text)
                kinds.append(kind)
        # A piece's order on the agenda: 0 for the highest score, the same for equal scores.
        order = {x: i for i, x in enumerate(sorted(set(score.values()), reverse=True))}
        self.order = {t: order[x] for t, x in score.items()}
        self.kind = np.array(kinds)
        self.byte = np.zeros(256, dtype=np.int64)
        for i in np.flatnonzero(self.kind == _BYTE).tolist():
            self.byte[int(self.text[i][3:5], 16)] = i
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        # What each id decodes to.
        surface = {_CONTROL: lambda t: b"", _BYTE: lambda t: bytes([int(t[3:5], 16)]), _UNKNOWN: lambda t: trainer.get(44, " ⁇ ".encode()), _NORMAL: lambda t: t.replace(SPACE, " ").encode()}
        out = [surface[k](t) for k, t in zip(kinds, self.text, strict=True)]
        self.length = np.array([len(b) for b in out], dtype=np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        self.bytes = np.frombuffer(b"".join(out), dtype=np.uint8)
        self.spaced = np.array([k == _NORMAL and t.startswith(SPACE) for k, t in zip(kinds, self.text, strict=True)])
        # The code points of pieces get numbers, 0 is any other; which pairs are adjacent in a piece.
        several = [t for t in self.id if len(t) > 1]
        points = sorted({ord(c) for t in several for c in t})
        self.number = np.zeros(0x110000, dtype=np.int32)
        self.number[points] = np.arange(1, len(points) + 1)
        self.adjacent = np.zeros((len(points) + 1, len(points) + 1), dtype=bool)
        for t in several:
            n = self.number[[ord(c) for c in t]]
            self.adjacent[n[:-1], n[1:]] = True
        self.cache_chunks = cache_chunks
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    # --- encoding ----------------------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """The symbols that the agenda leaves of a normalised text."""
        order, none = self.order.get, _NONE
        symbols = list(text)
        n = len(symbols)
        if n > _SHORT:
            return self._merge_long(symbols)
        agenda = [order(a + b, none) for a, b in zip(symbols, symbols[1:], strict=False)]
        while agenda and (best := min(agenda)) != none:
            i = agenda.index(best)
            piece = symbols[i] + symbols.pop(i + 1)
            symbols[i] = piece
            del agenda[i]
            if i < len(agenda):
                agenda[i] = order(piece + symbols[i + 1], none)
            if i:
                agenda[i - 1] = order(symbols[i - 1] + piece, none)
        return symbols

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The same with the agenda in a heap; an entry is the piece's order and the left place."""
        order = self.order.get
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(o, i) for i in range(n - 1) if (o := order(symbols[i] + symbols[i + 1])) is not None]
        heapify(agenda)
        while agenda:
            o, i = heappop(agenda)
            j = after[i]
            if j == n or not symbols[i]:
                continue
            piece = symbols[i] + symbols[j]
            if order(piece) != o:
                continue  # one of the two has been merged since
            symbols[i] = piece
            symbols[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (o := order(piece + symbols[k])) is not None:
                    heappush(agenda, (o, i))
            h = before[i]
            if h >= 0 and (o := order(symbols[h] + piece)) is not None:
                heappush(agenda, (o, h))
        return [s for s in symbols if s]

    def _chunk(self, text: str) -> bytes:
        symbols = self.merge(text)
        ids = list(map(self.id.get, symbols))
        if None in ids:
            ids = [i for s, x in zip(symbols, ids, strict=True) for i in ([x] if x is not None else self.byte[list(s.encode())].tolist())]
        return array("I", ids).tobytes()

    def _chunks(self, texts: list[str]) -> list[bytes]:
        known, out = self.chunks, []
        for t in texts:
            ids = known.get(t)
            if ids is None:
                ids = self.older.get(t) or self._chunk(t)
                if len(t) <= _LONGEST:
                    if len(known) >= self.cache_chunks:
                        self.older, self.chunks = known, (known := {})
                    known[t] = ids
            out.append(ids)
        return out

    def _sections(self, text: str) -> Iterator[str]:
        """A normalised text in parts of some _SECTION code points that no symbol spans."""
        at = 0
        while at < len(text):
            end = min(at + _SECTION, len(text))
            while end < len(text) and self.adjacent[self.number[ord(text[end - 1])], self.number[ord(text[end])]]:
                end += 1
            yield text[at:end]
            at = end

    def _section_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, not empty, in a row, and how many each has."""
        joined = "".join(texts)
        points = self.number[np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")]
        cut = np.ones(points.size, dtype=bool)
        cut[1:] = ~self.adjacent[points[:-1], points[1:]]
        first = np.concatenate(([0], np.cumsum([len(t) for t in texts])[:-1]))
        cut[first] = True
        raw = np.frombuffer(joined.encode(), dtype=np.uint8)
        starts = np.flatnonzero((raw & 0xC0) != 0x80)[cut]
        offsets = np.append(starts, raw.size).astype(np.int64)
        chunks = pa.LargeStringArray.from_buffers(starts.size, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)).dictionary_encode()
        found = self._chunks(chunks.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) >> 2
        pool = np.frombuffer(b"".join(found), dtype="<u4")
        use = chunks.indices.to_numpy()
        lengths = sizes[use]
        ends = np.cumsum(lengths)
        from_ = (np.cumsum(sizes) - sizes)[use] - (ends - lengths)
        ids = pool[np.repeat(from_, lengths) + np.arange(ends[-1])]
        return ids, np.add.reduceat(lengths, np.flatnonzero(np.isin(np.flatnonzero(cut), first)))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, begin and end included."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[str] = []
        of: list[int] = []

        def flush() -> None:
            if held:
                ids, sizes = self._section_ids(held)
                for i, x in zip(of, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                    parts[i].append(x)
                held.clear()
                of.clear()

        waiting = 0
        for i, text in enumerate(texts):
            if text:
                for section in self._sections(SPACE + text.replace(" ", SPACE)):
                    held.append(section)
                    of.append(i)
                    waiting += len(section)
                    if waiting >= _SECTION:
                        flush()
                        waiting = 0
        flush()
        begin, end = np.array([self.begin], dtype="<u4"), np.array([self.end], dtype="<u4")
        return [np.concatenate((begin, *p, end)) for p in parts]

    # --- decoding ----------------------------------------------------------------------

    def decode(self, rows: list[np.ndarray]) -> list[str]:
        """The text of each row of ids."""
        out = []
        for ids in rows:
            ids = ids[self.kind[ids] != _CONTROL].astype(np.int64)
            lengths = self.length[ids]
            ends = np.cumsum(lengths)
            raw = self.bytes[np.repeat(self.start[ids] - (ends - lengths), lengths) + np.arange(ends[-1] if ids.size else 0)].tobytes()
            if ids.size and self.spaced[ids[0]]:
                raw = raw[1:]
            try:
                out.append(raw.decode())
            except UnicodeDecodeError:
                out.append(_decode_bytewise(raw))
        return out


def _decode_bytewise(raw: bytes) -> str:
    """UTF-8 with U+FFFD for each single byte that is not part of a code point."""
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as e:
            out += [raw[: e.start].decode(), "�"]
            raw = raw[e.start + 1 :]
    return "".join(out)


@cache
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch in parts of about _SLICE bytes of text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + _SLICE, side="right")))
        yield batch.slice(at, end - at)
        at = end


def tokenize(docs: DataFrame, path: str | None = None, check: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids (little-endian 32-bit numbers), decoded and agrees:
    whether the library gives the same ids and the same text (null without check). The path is
    one that executors can open; the default is looked up on each executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(path or default_path())
        for batch in batches:
            for part in _slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                rows = v.encode(texts)
                decoded = v.decode(rows)
                agrees = [None] * len(rows)
                if check:
                    theirs = v.library.encode(texts, add_bos=True, add_eos=True, num_threads=1, return_type="numpy")
                    again = v.library.decode(theirs, num_threads=1) if theirs else []
                    agrees = [np.array_equal(a, b) and c == d for a, b, c, d in zip(rows, theirs, decoded, again, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([r.astype("<u4").tobytes() for r in rows], pa.binary()), pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())],
                    ["doc_id", "ids", "decoded", "agrees"],
                )
        hand_back()

    schema = docs.select("doc_id").schema.add("ids", "binary").add("decoded", "string").add("agrees", "boolean")
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: ids and decoded text of every document, each held against the library."""
    return tokenize(table(spark, sf_dir, "documents"), check=True).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "agrees",
    )
