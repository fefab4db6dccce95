"""Removal of long byte strings that occur more than once, by interval expansion on a Burrows-Wheeler transform.

A window is a byte string of ``size``. Its anchor is the leftmost of its k-grams with the smallest hash, so
equal windows have equal anchors at equal places. The windows of a text that share one anchor occurrence are
its context: at most 2 * size - k bytes. Contexts are grouped by anchor over all texts:

* a context that stands there twice or more repeats as a whole;
* the distinct contexts of an anchor are concatenated in one task, many anchors together, and the
  Burrows-Wheeler transform of that text is searched breadth first: the interval of all suffixes is extended
  backwards by every symbol, and an interval that ends at a place without a common-prefix value gives that
  place the current depth and is extended in turn. Values so come in increasing order; expansion stops at
  ``size``, and the places left without a value are neighbours that share ``size`` bytes or more;
* an anchor with very many distinct contexts (the edge of a passage that very many texts share) is dealt out
  further: windows are grouped by blocks of places relative to the anchor and by the bytes that all windows of
  a block share, with smaller blocks in each round, down to single windows.

Every window of every text lies in one context, and bytes are compared in the end, so nothing is lost and
(up to 128-bit hashes of equal contexts) nothing is wrongly found.

Texts are written once, in buckets by their row's key, and move no more: contexts are cut, and spans removed,
where they lie. A task counts equal contexts of a batch first and sends one of them, so a passage that a
third of all rows share is a row for each batch; the joins on a group read written tables, which Spark may split.

Defined cases: a null or empty text has no bytes; texts shorter than ``size`` keep all; rows with equal text,
whatever their ids, count as places of their own, rows with equal ids too; a very long text is searched whole;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docproof.llm.common import by_bytes, laid_out, stored

#: Bytes of the anchoring k-gram; distinct contexts of an anchor that one task takes; bytes of one transform.
GRAM, MOST_CONTEXTS, TRANSFORM_BYTES = 32, 1000, 1 << 17
#: Places relative to the anchor in one block, by round of dealing out.
BLOCKS = (48, 6, 1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Powers:
    """Powers of the hash's base and of its inverse, as far as the longest text so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _BASE, np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _INVERSE, np.uint64)]), dtype=np.uint64)


def gram_hashes(data: np.ndarray, gram: int, powers: Powers) -> np.ndarray:
    powers.reach(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers.up[: len(data)], dtype=np.uint64)])
    h = (sums[gram:] - sums[:-gram]) * powers.down[: len(data) - gram + 1]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def sliding_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, from running minima of blocks to either side."""
    pad = -len(h) % width
    blocks = np.concatenate([h, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(h) - width + 1
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def contexts(data: np.ndarray, size: int, gram: int, powers: Powers) -> list[tuple[int, int, int, int]]:
    """(anchor's hash, place of the anchor, first and last start of the windows that have it)."""
    if len(data) < size:
        return []
    h = gram_hashes(data, gram, powers)
    least = sliding_minimum(h, size - gram + 1)
    values = np.unique(least[np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))])
    at = np.searchsorted(values, h)
    held = np.flatnonzero(values[np.minimum(at, len(values) - 1)] == h)
    n = np.int64(len(h) + 1)
    keys = np.sort(at[held] * n + held)
    starts = np.arange(len(least))
    place = keys[np.searchsorted(keys, np.searchsorted(values, least) * n + starts)] % n
    cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([cut[1:] - 1, [len(place) - 1]])
    return list(zip(h[place[cut]].view(np.int64).tolist(), place[cut].tolist(), cut.tolist(), last.tolist()))


def suffix_array(text: np.ndarray, separators: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of codes of which the first ``separators`` values occur once, by doubling of prefixes.

    Where they fit, both halves of a key and the suffix's number are sorted as one integer.
    """
    n, base = len(text), np.int64(separators + 257)
    width = 3
    padded = np.concatenate([text, np.zeros(width - 1, np.int64)])
    key = (padded[:n] * base + padded[1 : n + 1]) * base + padded[2 : n + 2]
    packed, number = n < 1 << 21 and int(base) ** width < 1 << 42, np.arange(n)
    while True:
        if packed:
            value = np.sort((key << 21) | number)
            order = (value & ((1 << 21) - 1)).astype(np.int32)
            value >>= 21
        else:
            order = np.argsort(key)
            value = key[order]
        fresh = np.concatenate([[True], value[1:] != value[:-1]])
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
        if fresh.all():
            return order, rank
        key = rank.astype(np.int64) << 21 if packed else rank.astype(np.int64) * (n + 1)
        key[: n - width] += rank[width:] + np.int64(1)
        width *= 2


def repeated_starts(parts: list[bytes], size: int) -> list[np.ndarray]:
    """For each part, the starts of strings of ``size`` bytes that also start elsewhere in any part."""
    m = len(parts)
    lengths = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(lengths + 1) - 1
    text = np.empty(int(ends[-1]) + 1, np.int64)
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[ends] = np.arange(m)
    text[inside] = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64) + m
    order, rank = suffix_array(text, m)
    n = len(text)
    first = np.full(n + 2, -1, np.int32)  # the suffixes' first symbols, with a border on either side
    first[1:-1] = text[order]
    back = rank[order - 1]  # where the suffix one symbol longer stands: the transform's backward step
    owner = np.full(n + 2, -1, np.int32)
    known = np.zeros(n + 1, bool)  # places with a common-prefix value
    known[0] = known[n] = True
    lo, hi, stamp = np.zeros(1, np.int64), np.full(1, n, np.int64), 0
    for _ in range(size):
        if not len(lo):
            break
        width = hi - lo
        mine = np.repeat(np.arange(stamp, stamp + len(lo), dtype=np.int32), width)
        q = back[np.arange(len(mine)) + np.repeat(lo - np.cumsum(width) + width, width)]
        owner[q + 1] = mine
        symbol = first[q + 1]
        end = np.sort(q[(owner[q + 2] != mine) | (first[q + 2] != symbol)]) + 1
        begin = np.sort(q[(owner[q] != mine) | (first[q] != symbol)])
        stamp += len(lo)
        new = ~known[end]
        known[end[new]] = True
        lo, hi = begin[new], end[new]
    equal = np.flatnonzero(~known[:n])  # suffixes at these ranks share ``size`` bytes with the one before
    starts = np.unique(order[np.concatenate([equal, equal - 1])])
    part = np.searchsorted(ends, starts)
    origin = np.concatenate([[0], ends[:-1] + 1])
    split = np.searchsorted(part, np.arange(m + 1))
    return [starts[split[i] : split[i + 1]] - origin[i] for i in range(m)]


def runs(starts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """The union of [s, s + size) as maximal runs."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > size)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), (starts[np.concatenate([cut, [len(starts) - 1]])] + size).tolist()))


#: A context: group, hash of its bytes, its row's key (128 bits), place of the anchor, first and last start, times it stands there.
#: Of found ones (n = 0) only the key and the starts count: a batch holds an equal one, so they repeat.
_ITEM = "group bigint, ctx bigint, rk bigint, rk2 bigint, place int, lo int, hi int, n bigint"


def _records(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    kinds = [{"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[k] for k in kinds]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], list(names))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


class Counted:
    """Contexts of one batch: equal ones of a group become one with their number, and found rows for all."""

    def __init__(self):
        self.seen: dict[tuple[int, int], list] = {}
        self.found: list[tuple] = []

    def add(self, group: int, ctx: int, rk: int, rk2: int, place: int, lo: int, hi: int, n: int) -> None:
        held = self.seen.get((group, ctx))
        if held is None:
            self.seen[group, ctx] = [group, ctx, rk, rk2, place, lo, hi, n]
            return
        if held[7] == 1:
            self.found.append((0, 0, *held[2:7], 0))
        if n == 1:
            self.found.append((0, 0, rk, rk2, place, lo, hi, 0))
        held[7] += n

    def records(self) -> pa.RecordBatch:
        return _records([*map(tuple, self.seen.values()), *self.found], _ITEM)


def anchored(texts: DataFrame, size: int, gram: int) -> DataFrame:
    """All contexts of texts(rk, rk2, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        powers = Powers()
        for batch in by_bytes(batches, 2):
            counted = Counted()
            for rk, rk2, data in zip(*(c.to_pylist() for c in batch.columns)):
                for h, place, lo, hi in contexts(np.frombuffer(data, np.uint8), size, gram, powers):
                    counted.add(h, _signed(xxhash.xxh3_64_intdigest(data[lo : hi + size])), rk, rk2, place, lo, hi, 1)
            yield counted.records()

    return texts.mapInArrow(run, _ITEM)


def _with_texts(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(rk2, data, asked): the texts that hold the items, each with all of its own; asked are structs with an rk2 that must be the text's."""
    held = items.groupBy("rk").agg(F.collect_list(F.struct("group", "rk", "rk2", "place", "lo", "hi", "n")).alias("asked"))
    return texts.join(held, "rk").select("rk2", "data", "asked")


def _asked(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[dict]]]:
    for rk2, data, asked in zip(*(c.to_pylist() for c in batch.columns)):
        yield data, [x for x in asked if x["rk2"] == rk2]


def blocks(texts: DataFrame, items: DataFrame, size: int, block: int) -> DataFrame:
    """Items dealt out: windows whose starts lie in one block relative to the anchor, grouped by the bytes that all windows of the block hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            counted, done = Counted(), set()
            for data, asked in _asked(batch):
                for x in asked:
                    for b in range((x["place"] - x["hi"]) // block, (x["place"] - x["lo"]) // block + 1):
                        last, first = x["place"] - b * block, x["place"] - (b + 1) * block + 1
                        lo, hi = max(first, x["lo"]), min(last, x["hi"])
                        group = _signed(xxhash.xxh3_64_intdigest(data[last : first + size], seed=(x["group"] + b * 0x9E3779B97F4A7C15) % (1 << 64)))
                        one = (group, x["rk"], x["rk2"], x["place"], lo, hi)
                        if one not in done:
                            done.add(one)
                            counted.add(group, _signed(xxhash.xxh3_64_intdigest(data[lo : hi + size])), *one[1:], x["n"])
            yield counted.records()

    return _with_texts(texts, items).mapInArrow(run, _ITEM)


def transformed(texts: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """Spans (rk, rk2, lo, hi) of the items' windows that repeat in another item of their group."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            yield _records([(x["group"], x["rk"], x["rk2"], x["lo"], x["n"], data[x["lo"] : x["hi"] + size]) for data, asked in _asked(batch) for x in asked], "group bigint, rk bigint, rk2 bigint, lo int, n bigint, part binary")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()

        def result(rows: list[tuple]) -> pa.RecordBatch:
            out = []
            # A row that stands there more than once gives its contexts more than once.
            rows = list({(r[0], r[5]): r for r in rows}.values())
            for (_, rk, rk2, lo, n, _), starts in zip(rows, repeated_starts([r[5] for r in rows], size) if rows else ()):
                if n == 1:
                    out += [(rk, rk2, lo + a, lo + b) for a, b in runs(starts, size)]
            return _records(out, "rk bigint, rk2 bigint, lo int, hi int")

        rows, held, group = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != group and held >= TRANSFORM_BYTES:
                    yield result(rows)
                    rows, held = [], 0
                group = row[0]
                rows.append(row)
                held += len(row[5])
        yield result(rows)

    parts = _with_texts(texts, items).mapInArrow(cut, "group bigint, rk bigint, rk2 bigint, lo int, n bigint, part binary")
    return parts.repartition("group").sortWithinPartitions("group").mapInArrow(search, "rk bigint, rk2 bigint, lo int, hi int")


def repeats(texts: DataFrame, size: int, gram: int = GRAM) -> DataFrame:
    """(rk, rk2, spans): the maximal runs of bytes of each text(rk, rk2, data) that lie in a repeated string."""
    long = texts.where(F.length("data") >= size).select("rk", "rk2", "data")
    made, found = stored(anchored(long, size, gram), "contexts"), []
    for block in (*BLOCKS, 0):
        found.append(made.where("n = 0").select("rk", "rk2", "lo", (F.col("hi") + size).alias("hi")))
        items = made.where("n > 0")
        twice = stored(items.groupBy("group").agg(F.sum("n").alias("all")).where("all > 1").select("group"), "twice")
        items = stored(items.join(twice, "group"), "contexts")
        one = F.min(F.struct("rk", "rk2", "place", "lo", "hi"))
        distinct = stored(items.groupBy("group", "ctx").agg(F.sum("n").alias("n"), one.alias("one")), "distinct")
        whole = items.where("n = 1").join(distinct.where("n > 1").select("group", "ctx"), ["group", "ctx"])
        found.append(whole.select("rk", "rk2", "lo", (F.col("hi") + size).alias("hi")))
        groups = distinct.groupBy("group").agg(F.count("*").alias("d"), F.count_if(F.col("n") == 1).alias("single")).where("d > 1 and single > 0")
        groups = stored(groups.select("group", "d"), "groups")
        chosen = stored(distinct.join(groups, "group").select("group", "ctx", "one.*", "n", "d"), "chosen")
        if chosen.isEmpty():
            break
        found.append(transformed(long, chosen.where(F.col("d") <= MOST_CONTEXTS), size))
        rest = chosen.where(F.col("d") > MOST_CONTEXTS)
        if not block or rest.isEmpty():
            break
        made = stored(blocks(long, rest, size, block), "contexts")

    @F.pandas_udf("array<struct<lo:int,hi:int>>")
    def merged(spans: pd.Series) -> pd.Series:
        out = []
        for each in spans:
            joined: list[dict] = []
            for a, b in sorted((s["lo"], s["hi"]) for s in each):
                if joined and a <= joined[-1]["hi"]:
                    joined[-1]["hi"] = max(b, joined[-1]["hi"])
                else:
                    joined.append({"lo": a, "hi": b})
            out.append(joined)
        return pd.Series(out)

    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("rk", "rk2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")).select("rk", "rk2", merged("spans").alias("spans"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 400) -> DataFrame:
    """Per row: id_col, n_bytes, spans (removed runs of bytes) and kept (the remaining bytes)."""
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), data.alias("data"))
    rows = rows.withColumns({"rk": F.xxhash64("id", "data"), "rk2": F.xxhash64(F.lit("second"), "id", "data")})
    rows = laid_out(rows.repartition("rk"), "rk", "texts")
    spans = stored(repeats(rows, size), "spans").select(F.col("rk").alias("_rk"), F.col("rk2").alias("_rk2"), "spans")
    #: The second condition is written so that the join stays one on rk alone, where the rows lie.
    joined = rows.join(spans, (F.col("rk") == F.col("_rk")) & (F.col("rk2").bitwiseXOR(F.col("_rk2")) == 0), "left")

    @F.pandas_udf("binary")
    def rest(data: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for d, each in zip(data, spans):
            at, kept = 0, []
            for s in each if d is not None else ():
                kept.append(d[at : s["lo"]])
                at = s["hi"]
            out.append(None if d is None else b"".join([*kept, d[at:]]))
        return pd.Series(out, dtype=object)

    touched = F.col("spans").isNotNull()
    done = joined.select("id", "data", "spans", touched.alias("touched"), rest(F.when(touched, F.col("data")), "spans").alias("rest"))
    spans = F.coalesce("spans", F.array().cast("array<struct<lo:int,hi:int>>"))
    return done.select(F.col("id").alias(id_col), F.length("data").cast("bigint").alias("n_bytes"), spans.alias("spans"), F.when(F.col("touched"), F.col("rest")).otherwise(F.col("data")).alias("kept"))


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    done = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
