"""Packing token sequences by patterns of lengths, fitted with non-negative least squares.

1. Each text is tokenised, closed with ``end_id``, and cut into pieces of at most ``size`` tokens (all but
   the first are full). One row per piece is written: its length and checksum, not its tokens.
2. The histogram of lengths (at most ``size`` counts, whatever the table's size) goes to the driver. There
   every pattern of at most ``docs`` lengths that fills a sequence exactly is a column, and repeat counts
   are fitted to the histogram by projected gradient steps (shorter lengths weigh less: they fill gaps).
   Counts are rounded as far as the histogram has the lengths; the rest is packed best fit, longest first,
   also by length. The plan lists patterns with repeat counts, so its size does not grow with the table.
3. Pieces of a length are numbered in parallel (within hash buckets, plus the buckets' offsets), and the
   number's place in the plan gives the sequence and the offset. No length or bucket is gathered anywhere.

Defined results: a null text is empty and is one piece, ``end_id`` alone; null or repeated ids keep their
rows; equal pieces of one id are interchangeable; an empty table packs to nothing; further columns go.
"""

from __future__ import annotations

import base64
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stacklens.llm.common import materialize, texts

RANKS, MODEL = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
SPECIAL = {"<|endoftext|>": 50256}
BUCKETS = 256
_ENCODERS: dict[int, object] = {}


def encoder(ranks: str, pattern: str):
    """The encoder of a rank file's text, built once in a worker; special strings in a text are their ids."""
    if (key := zlib.crc32(ranks.encode())) not in _ENCODERS:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(str.split, ranks.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens=SPECIAL)
    return _ENCODERS[key]


def library(model: str):
    """The tokenizers library's tokenizer of a model file's text, without cuts or padding, built once in a worker."""
    if (key := zlib.crc32(model.encode())) not in _ENCODERS:
        from tokenizers import Tokenizer

        _ENCODERS[key] = tokenizer = Tokenizer.from_str(model)
        tokenizer.no_truncation()
        tokenizer.no_padding()
    return _ENCODERS[key]


def pieces(docs: DataFrame, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
           path: str | None = None, model_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every text's pieces.

    ``path`` is the vocabulary as ranks, which one library encodes fast; ``model_path`` is the same vocabulary for
    the slower one, which takes the texts that the first gives up on (runs of hundreds of thousands of blanks).
    """
    import public_tokenizers

    def read(name: str):
        with open(name, encoding="utf-8") as f:
            return docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary, of fixed size

    ranks, model = read(path or public_tokenizers.path(RANKS)), read(model_path or public_tokenizers.path(MODEL))
    pattern = public_tokenizers.PATTERN

    def ids_of(text: str) -> np.ndarray:
        try:
            return encoder(ranks.value, pattern).encode_to_numpy(text, allowed_special="all")
        except ValueError:
            return np.array(library(model.value).encode(text, add_special_tokens=False).ids, np.int64)

    def run(batches):
        end = np.array([end_id], "<u4")
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.concatenate([ids_of(text), end]).astype("<u4")
                data, at, n = memoryview(ids.tobytes()), 0, len(ids)
                length = (n - 1) % size + 1
                for piece in range((n + size - 1) // size):
                    for col, v in zip(rows, (doc, piece, at, length, zlib.crc32(data[4 * at:4 * (at + length)])), strict=True):
                        col.append(v)
                    at, length = at + length, size
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece long, start long, length long, ids_crc32 long")


@dataclass
class Plan:
    """Patterns (lengths in order) with repeat counts."""

    patterns: list[tuple[tuple[int, ...], int]]

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.patterns)

    def places(self) -> tuple[np.ndarray, ...]:
        """For ranges of numbers within a length, sorted by (length, first number): the key of the range,
        the sequence of its first number, and the offset in the sequence."""
        used: dict[int, int] = {}
        rows, sequence = [], 0
        for lengths, n in self.patterns:
            offset = 0
            for length in lengths:
                rows.append((length << 44 | used.get(length, 0), sequence, offset))
                used[length] = used.get(length, 0) + n
                offset += length
            sequence += n
        return tuple(np.array(c, np.int64) for c in zip(*sorted(rows), strict=True)) if rows else (np.zeros(0, np.int64),) * 3


def exact_patterns(lengths: np.ndarray, size: int, docs: int) -> np.ndarray:
    """Every multiset of at most ``docs`` of the lengths that sums to ``size``, as rows padded with zeros."""
    have = np.zeros(size + 1, bool)
    have[lengths] = True
    out = [[size] + [0] * (docs - 1)] if have[size] else []

    def extend(prefix: list[int], rest: int) -> None:
        if rest <= size and have[rest] and rest <= prefix[-1]:
            out.append(prefix + [rest] + [0] * (docs - len(prefix) - 1))
        if len(prefix) + 2 <= docs:
            # the next is no longer than the last, and what remains needs no longer one
            for nxt in range(min(prefix[-1], rest - 1), 0, -1):
                if have[nxt] and nxt * (docs - len(prefix)) >= rest:
                    extend(prefix + [nxt], rest - nxt)

    for first in range(size - 1, 0, -1):
        if have[first] and first * docs >= size:
            extend([first], size - first)
    return np.array(out, np.int64).reshape(-1, docs)


def fit(histogram: np.ndarray, patterns: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative repeat counts x with A x close to the histogram, by accelerated projected gradients."""
    size = len(histogram) - 1
    weight = np.sqrt(np.arange(size + 1) / size)
    weight[0] = 0.0
    w2 = weight ** 2
    forward = lambda x: sum(np.bincount(patterns[:, d], x, size + 1) for d in range(patterns.shape[1]))
    back = lambda r: r[patterns].sum(axis=1)  # noqa: E731  w2[0] is 0, so padding adds nothing
    v = np.ones(len(patterns))
    for _ in range(30):
        v = back(w2 * forward(v))
        bound = np.linalg.norm(v)
        v /= bound
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - back(w2 * (forward(y) - histogram)) / (1.02 * bound))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def best_fit(histogram: np.ndarray, open_bins: dict[int, list] | None = None) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts by length: equal sequences are handled together."""
    size = len(histogram) - 1
    room: dict[int, list[tuple[tuple[int, ...], int]]] = open_bins or {}
    for length in range(size, 0, -1):
        left = int(histogram[length])
        for space in sorted(s for s in room if s >= length):
            while left and room.get(space):
                lengths, n = room[space].pop()
                each = space // length
                whole = min(n, left // each)
                some = left - whole * each if whole < n else 0
                if whole:
                    room.setdefault(space - each * length, []).append((lengths + (length,) * each, whole))
                if some:
                    room.setdefault(space - some * length, []).append((lengths + (length,) * some, 1))
                if n - whole - bool(some):
                    room[space].append((lengths, n - whole - bool(some)))
                left -= whole * each + some
            if not left:
                break
        if left:
            each = size // length
            if left // each:
                room.setdefault(size - each * length, []).append(((length,) * each, left // each))
            if left % each:
                room.setdefault(size - left % each * length, []).append(((length,) * (left % each), 1))
        room = {s: g for s, g in room.items() if g}
    return [x for group in room.values() for x in group]


def plan(histogram: np.ndarray, docs: int = 3) -> Plan:
    """Fit, round and pack the residual of a histogram of lengths (index 0 unused)."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    patterns = exact_patterns(np.flatnonzero(left), len(left) - 1, docs)
    out: list[tuple[tuple[int, ...], int]] = []
    if len(patterns):
        x = fit(left.astype(float), patterns)
        for j in np.argsort(-x, kind="stable"):
            if x[j] < 0.5:
                break
            lengths = tuple(int(v) for v in patterns[j] if v)
            n = min([int(np.floor(x[j] + 0.5)), *(int(left[v]) // lengths.count(v) for v in set(lengths))])
            if n > 0:
                for v in lengths:
                    left[v] -= n
                out.append((lengths, n))
    return Plan(out + best_fit(left))


def pack(docs: DataFrame, size: int = 1024, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = materialize(pieces(docs, size, **options)
                      .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(BUCKETS)).cast("int")))
    # at most size * BUCKETS rows
    counts = cut.groupBy("length", "bucket").count().toPandas().sort_values(["length", "bucket"])
    by_length = counts.groupby("length")["count"]
    histogram = np.zeros(size + 1, np.int64)
    histogram[by_length.sum().index.to_numpy(int)] = by_length.sum().to_numpy()
    before = np.zeros((size + 1, BUCKETS), np.int64)
    before[counts["length"], counts["bucket"]] = by_length.cumsum() - counts["count"]
    key, sequence, offset = plan(histogram).places()
    shared = docs.sparkSession.sparkContext.broadcast((before, key, sequence, offset))  # bounded by size, BUCKETS and the plan

    def place(batches):
        before, key, sequence, offset = shared.value
        for b in batches:
            if b.num_rows:
                length, bucket, at = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5, 6))
                number = length << 44 | (before[length, bucket] + at - 1)
                i = np.searchsorted(key, number, side="right") - 1
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence[i] + number - key[i]), pa.array(offset[i])],
                                                 ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    return (cut.withColumn("at", F.row_number().over(order).cast("long"))
            .mapInArrow(place, "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long"))


def op7_packing(docs: DataFrame) -> DataFrame:
    return pack(docs)
