"""Best-fit packing of token sequences by exact-complement hashing over the histogram of lengths.

A plan needs only how many pieces there are of each length, at most one row for each of ``capacity``
lengths. Starting from the longest length left, the gap behind it is looked up in an index of single
lengths, sums of two and sums of three, under the counts still available; a combination that fills the
gap exactly is consumed as often as the counts allow. Where none exists the longest length that fits goes
in (best fit) and the remaining gap is looked up again. Each use of a pattern exhausts a length or leaves
less of it than one more use needs, so the plan has a few thousand rows at any input size.

Pieces find their place by their rank among the pieces of equal length. Ranks come from a window over
(length, salt) and a prefix sum of the salts' counts, so that a length which a third of all pieces share
is dealt over many tasks.

Defined cases: null or empty texts are one piece, the end token; pieces of equal length are ordered by
(id, piece), equal rows share out the places in any order; an empty table gives an empty table; other
columns of the documents are not read.
"""

from __future__ import annotations

import gc
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docproof.llm.common import by_bytes, path_of, stored

#: Words whose ids a Python worker keeps, in two generations.
TABLE_WORDS = 500_000
#: Pieces of one length that one task ranks, about.
SALT_ROWS = 100_000


#: The pre-tokenizer's pattern for lower-case text up to U+017F, its classes of letters, numbers and white space written out.
_LETTER, _NUMBER, _SPACE = "a-zªµºß-öø-ÿĀ-ſ", "0-9²³¹¼½¾", r"\t\n\x0b\x0c\r \x85\xa0"
_WORD = re.compile(f"[{_LETTER}]+|[{_NUMBER}]|'(?:s|t|re|ve|m|ll|d)|[^{_SPACE}{_LETTER}{_NUMBER}]+")
#: The same for ASCII, where matching is faster.
_ASCII_WORD = re.compile(r"[a-z]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\t\n\x0b\x0c\r a-z0-9]+")
_BEYOND = re.compile("[^\x00-\u017f]")


class WordTable:
    """Ids of each distinct pre-token; texts with other characters or special tokens go to the library whole.

    Two generations bound the table: words in use move to the younger one, which becomes the older when it is
    full, so frequent words stay. New words go to the library many at a time, between spaces, and are told
    apart by the vocabulary's word ends.
    """

    def __init__(self, file: str, most: int = TABLE_WORDS):
        from tokenizers import Tokenizer

        self.library, self.most, self.ids, self.old = Tokenizer.from_file(file), most, {}, {}
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        probe = "It's 10% o' über_all, WORD'LL\x1f no¼\xa0x"
        self.splits = True
        self.splits = self.encode([probe])[0] == self._whole(probe)  # another tokenizer file: whole texts

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _cut(self, text: str) -> list[str] | None:
        if not self.splits or "<|" in text:
            return None
        if text.isascii():
            return _ASCII_WORD.findall(text.lower())
        return None if _BEYOND.search(text) else _WORD.findall(text.lower())

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.ids]
        if len(self.ids) + len(new) > self.most // 2:
            self.ids, self.old = {}, self.ids
            new = list(words)
        kept = [w for w in new if w in self.old]
        self.ids.update(zip(kept, map(self.old.__getitem__, kept)))
        new = [w for w in new if w not in self.ids]
        for at in range(0, len(new), 500):
            part = new[at : at + 500]
            ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) * 4 + 4
            if len(stops) == len(part):
                data, cuts = ids.tobytes(), stops.tolist()
                self.ids.update(zip(part, map(data.__getitem__, map(slice, [0, *cuts[:-1]], cuts))))
            else:
                self.ids.update(zip(part, map(self._whole, part)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as bytes, little-endian unsigned 32-bit."""
        cut = [self._cut(t) for t in texts]
        self.learn(set().union(*(c for c in cut if c)))
        return [self._whole(t) if c is None else b"".join(map(self.ids.__getitem__, c)) for t, c in zip(texts, cut)]


#: A worker's tables, by file, for all tasks that it runs.
_TABLES: dict[str, WordTable] = {}


def encode_pieces(
    df: DataFrame, file: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = 4096
) -> DataFrame:
    """Per piece: id_col, piece, start, length, ids (binary): a document's ids and end_id, cut every ``capacity`` tokens."""
    file = file or path_of("word_bpe_49k.json")
    size, last = 4 * capacity, end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the table holds many small objects and no cycles
        table = _TABLES.get(file) or _TABLES.setdefault(file, WordTable(file))
        for batch in by_bytes(batches, 1, 4 << 20):
            rows, piece, start, ids = [], [], [], []
            for row, text in enumerate(table.encode([t or "" for t in batch.column(1).to_pylist()])):
                text += last
                for k, at in enumerate(range(0, len(text), size)):
                    rows.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    ids.append(text[at : at + size])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["key", "piece", "start", "length", "ids"],
            )

    source = df.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, piece int, start bigint, length bigint, ids binary").withColumnRenamed("key", id_col)


class Complements:
    """Index of the lengths available, of their pair sums and of their triple sums, as bit sets."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.capacity = counts, len(counts) - 1
        self.present = 0
        self.mirrored = 0
        for n in np.flatnonzero(counts).tolist():
            self._set(n)

    def _set(self, n: int) -> None:
        self.present |= 1 << n
        self.mirrored |= 1 << (self.capacity - n)

    def use(self, lengths: dict[int, int], times: int) -> None:
        for n, k in lengths.items():
            self.counts[n] -= k * times
            if not self.counts[n]:
                self.present &= ~(1 << n)
                self.mirrored &= ~(1 << (self.capacity - n))

    def left(self, n: int, taken: dict[int, int]) -> int:
        return int(self.counts[n]) - taken.get(n, 0)

    def pairs(self, total: int) -> int:
        """Bit a is set where a and total - a are both available."""
        shift = self.capacity - total
        return self.present & (self.mirrored >> shift if shift >= 0 else self.mirrored << -shift) & ((1 << total) - 1) & ~1

    def single(self, gap: int, taken: dict[int, int]) -> tuple[int, ...]:
        return (gap,) if self.left(gap, taken) > 0 else ()

    def pair(self, gap: int, taken: dict[int, int]) -> tuple[int, ...]:
        found = self.pairs(gap)
        while found:
            a = found.bit_length() - 1
            b = gap - a
            if a < b:
                return ()
            if self.left(a, taken) > (a == b) and self.left(b, taken) > (a == b):
                return (a, b)
            found &= ~(1 << a)
        return ()

    def triple(self, gap: int, taken: dict[int, int]) -> tuple[int, ...]:
        rest = self.present & ((1 << max(gap - 1, 0)) - 1) & ~1
        while rest:
            a = rest.bit_length() - 1
            if 3 * a < gap:
                return ()
            if self.left(a, taken) > 0 and (found := self.pair(gap - a, taken | {a: taken.get(a, 0) + 1})) and found[0] <= a:
                return (a, *found)
            rest &= ~(1 << a)
        return ()

    def largest(self, most: int, taken: dict[int, int]) -> int:
        rest = self.present & ((1 << (most + 1)) - 1) & ~1
        while rest:
            a = rest.bit_length() - 1
            if self.left(a, taken) > 0:
                return a
            rest &= ~(1 << a)
        return 0


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(number of sequences, pieces of each length in one of them), for every pattern."""
    counts = np.zeros(capacity + 1, np.int64)
    for n, k in histogram.items():
        counts[n] = k
    index, out = Complements(counts), []
    while index.present:
        first = index.present.bit_length() - 1
        used, gap = {first: 1}, capacity - first
        while gap:
            found = index.single(gap, used) or index.pair(gap, used) or index.triple(gap, used)
            if not found:
                best = index.largest(gap, used)
                found = (best,) if best else ()
            if not found:
                break
            for n in found:
                used[n] = used.get(n, 0) + 1
                gap -= n
        times = min(int(index.counts[n]) // k for n, k in used.items())
        index.use(used, times)
        out.append((times, used))
    return out


def pack(pieces: DataFrame, id_col: str = "doc_id", capacity: int = 4096) -> DataFrame:
    """The rows of ``pieces`` with sequence_id and offset; lengths are between 1 and ``capacity``."""
    spark = pieces.sparkSession
    pieces = stored(pieces, "pieces")
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for times, used in plan(histogram, capacity):
        offset = 0
        for n, k in used.items():
            runs.setdefault(n, []).append((taken.get(n, 0), k, sequence, offset))
            taken[n] = taken.get(n, 0) + k * times
            offset += n * k
        sequence += times
    #: The plan: as many rows as patterns have lengths, whatever the input's size.
    table = spark.sparkContext.broadcast({n: np.array(r, np.int64).T for n, r in runs.items()})

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        out = np.zeros((len(n), 2), np.int64)
        for size in np.unique(n).tolist():
            at = np.flatnonzero(n == size)
            begin, each, first, offset = table.value[size]
            k = np.searchsorted(begin, r[at], side="right") - 1
            past = r[at] - begin[k]
            out[at, 0] = first[k] + past // each[k]
            out[at, 1] = offset[k] + past % each[k] * size
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    salts = max(1, sum(histogram.values()) // SALT_ROWS)
    keyed = pieces.withColumn("_salt", F.pmod(F.xxhash64(F.col(id_col), F.col("piece")), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    share = keyed.groupBy("length", "_salt").count().select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_salt").orderBy(id_col, "piece")
    ranked = keyed.withColumn("_inside", F.row_number().over(inside) - 1).join(share, ["length", "_salt"])
    placed = ranked.withColumn("_place", place("length", F.col("_inside") + F.col("_before")))
    return placed.select(*pieces.columns, F.col("_place.sequence_id").alias("sequence_id"), F.col("_place.offset").alias("offset"))


def packed_documents(docs: DataFrame) -> DataFrame:
    """Pieces of all documents with the checksum of their ids and their place."""
    pieces = encode_pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(pieces)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
