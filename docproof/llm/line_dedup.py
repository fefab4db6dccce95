"""Substring dedup by hashing lines, paragraphs, sentences and anchors of passages.

A unit is a line (or paragraph) or a sentence in it, of ``min_words`` words or more. Units are normalised (lower
case, runs of white space as one space), their digests grouped over all documents, and of each digest the
occurrence that ranks first by (document, position) stays; the others are removed, with their offsets in the
original text. A sentence's first occurrence is never in a removed line: that line's first occurrence holds
the sentence too, earlier. A line of one sentence is the same unit as that sentence inside another line.

A passage of ``PASSAGE`` words or more may begin and end anywhere. Of every ``PASSAGE - GRAM + 1`` neighbouring
runs of ``GRAM`` words the one of the least hash is an anchor, so equal passages hold equal anchors. An anchor's
words and up to ``REACH`` on either side are compared with those of an earlier occurrence; ``PASSAGE`` or more
in a row that are equal go. A word that goes has an equal one at an earlier place, so the first stays.

Each row is written once, in buckets by its key, and texts move no more. A task sends one occurrence of each
digest, the first of its batch; later ones are settled where they are. So a digest that a third of all rows
share is a row for each batch, not for each document. Anchors of two documents that lie equally far apart are
compared in one stretch.

The returned text is the original without the removed spans, character by character: a span takes the white
space behind it with it, or that before it at the end of a line, and the separator if nothing of its lines is left.

Defined cases: a null text has no units and stays null; an empty text stays empty; a document whose units all
go keeps an empty text; rows with equal ids (null included, which rank first) rank by their text's hash, and
fully equal rows in any one order, so that one of them keeps its units; a very long text is taken whole; an
empty table gives an empty table; other columns are kept as they are, but for one named removed_spans, which
the operator's own replaces.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docproof.llm.common import by_bytes, laid_out, stored

MIN_WORDS = 8
#: Words of a passage at least, of an anchor, and compared on either side of one; words whose hashes a task keeps.
PASSAGE, GRAM, REACH, TABLE_WORDS = 32, 16, 24, 300_000
#: Stretches of one document that a row asks for.
ASKED = 1000
_END = re.compile(r"[.!?]+\s+")


def units_of(text: str, separator: str = "\n", min_words: int = MIN_WORDS) -> list[tuple[int, int, bytes]]:
    """(start, end, digest) of each unit: lines first, then the sentences of lines with more than one."""
    out, at = [], 0
    for line in text.split(separator):
        words = line.lower().split()
        if len(words) >= min_words:
            out.append((at, at + len(line), hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass")).digest()))
            begin = 0
            cuts = [m.end() for m in _END.finditer(line)]
            if cuts and cuts[-1] != len(line):
                cuts.append(len(line))
            for end in cuts if len(cuts) > 1 else ():
                words = line[begin:end].lower().split()
                if len(words) >= min_words:
                    out.append((at + begin, at + end, hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass")).digest()))
                begin = end
        at += len(line) + len(separator)
    return out


class Words:
    """Hashes of lower-case words and the anchors among them."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def hashes(self, text: str) -> np.ndarray:
        words, known = text.lower().split(), self.known
        if len(known) > TABLE_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors among words with the hashes ``h``, places counted in words."""
    if len(h) < PASSAGE:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    n = len(h) - GRAM + 1
    mixed = np.full(n, GRAM, np.uint64)
    for k in range(GRAM):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[k : n + k]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    least = np.lib.stride_tricks.sliding_window_view(mixed, PASSAGE - GRAM + 1).argmin(axis=1)
    at = np.unique(least + np.arange(len(least)))
    return at, mixed[at].view(np.int64)


def stretch(h: np.ndarray, first: int, last: int) -> tuple[int, np.ndarray]:
    """(place of the first word, 32 bits of each word): the anchors from ``first`` to ``last`` with what is around them."""
    begin = max(0, first - REACH)
    return begin, h[begin : last + GRAM + REACH].astype(np.uint32)


def equal_runs(own: np.ndarray, at: int, there: np.ndarray) -> list[tuple[int, int]]:
    """Places [a, b) in ``own`` (32 bits of each word) of the runs of PASSAGE words or more that equal ``there``, laid on from ``at``."""
    begin, end = max(0, at), min(len(own), at + len(there))
    same = np.zeros(max(0, end - begin) + 2, np.int8)
    same[1:-1] = own[begin:end] == there[begin - at : end - at] if end > begin else 0
    turn = np.diff(same)
    a, b = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    long = b - a >= PASSAGE
    return list(zip((a[long] + begin).tolist(), (b[long] + begin).tolist()))


def word_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of the text from the first to the last word of each run."""
    if not runs:
        return []
    words = [m.span() for m in re.finditer(r"\S+", text)]
    return [(words[a][0], words[b - 1][1]) for a, b in runs]


def without(text: str, spans: list[tuple[int, int]], separator: str = "\n") -> tuple[str, list[tuple[int, int]]]:
    """The text without the spans, and the spans joined and grown over white space and separators that would be left over."""
    joined: list[list[int]] = []
    for a, b in sorted(spans):
        if joined and (a <= joined[-1][1] or not text[joined[-1][1] : a].strip()):
            joined[-1][1] = max(b, joined[-1][1])
        else:
            joined.append([a, b])
    out, at, done = [], 0, []
    for a, b in joined:
        line, end = text.rfind(separator, 0, a), text.find(separator, b)
        line, end = line + len(separator) if line >= 0 else 0, end if end >= 0 else len(text)
        if not text[b:end].strip():  # up to the end of the line
            b = end
            if text[line:a].strip():
                a = line + len(text[line:a].rstrip())
            elif end < len(text):
                a, b = line, end + len(separator)
            else:
                a = max(0, line - len(separator))
        else:
            b += len(text[b:end]) - len(text[b:end].lstrip())
        a = max(a, at)
        out.append(text[at:a])
        done.append((a, b))
        at = b
    out.append(text[at:])
    merged: list[tuple[int, int]] = []
    for a, b in done:
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    return "".join(out), merged


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The layout: row (other columns), id, text, rk and rk2 (128 bits that name the row), tie and num (0 where no id stands twice), in buckets by rk."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(0)]
    rows = docs.select(F.struct(*others).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if rows.groupBy("id").count().where("count > 1").isEmpty():
        rows = rows.withColumns({"tie": F.lit(0).cast("bigint"), "num": F.lit(0).cast("bigint")})
    else:
        rows = rows.withColumns({"tie": F.xxhash64("text"), "num": F.monotonically_increasing_id()})
    return laid_out(rows.withColumns(_names("", "rk", "rk2")).repartition("rk"), "rk", "rows")


def _names(of: str, rk: str, rk2: str) -> dict[str, Column]:
    own = [F.col(f"{of}{c}") for c in ("id", "tie", "num")]
    return {rk: F.xxhash64(*own), rk2: F.xxhash64(F.lit("second"), *own)}


def candidates(rows: DataFrame, separator: str, min_words: int) -> DataFrame:
    """id, tie, num, start, end, d0, d1, kind: 0 for units and 1 for anchors (start in words) that are first in their batch, 2 for spans that go since the batch holds an earlier one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        words = Words()
        for batch in by_bytes(batches, 3):
            texts = batch.column(3).to_pylist()
            rank = np.empty(len(texts), np.int64)
            order = pc.sort_indices(pa.table(batch.columns[:3], ["id", "tie", "num"]), sort_keys=[(c, "ascending") for c in ("id", "tie", "num")], null_placement="at_start")
            rank[order.to_numpy()] = np.arange(len(texts))
            row, start, end, digest, hashes = [], [], [], [], []
            places, values = [], []
            for k, text in enumerate(texts):
                for a, b, d in units_of(text, separator, min_words):
                    row.append(k)
                    start.append(a)
                    end.append(b)
                    digest.append(d)
                hashes.append(words.hashes(text))
                at, v = anchors(hashes[-1])
                places.append(at)
                values.append(v)
            counts = [len(p) for p in places]
            halves = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            n, m = len(row), sum(counts)
            row = np.concatenate([np.array(row, np.int64), np.repeat(np.arange(len(texts)), counts)])
            start = np.concatenate([np.array(start, np.int64), *places])
            end = np.concatenate([np.array(end, np.int64), np.full(m, -1)])
            d0, d1 = np.concatenate([halves[:, 0], *values]), np.concatenate([halves[:, 1] | 1, np.zeros(m, np.int64)])
            by = np.lexsort((start, rank[row], d1, d0))
            fresh = np.ones(n + m, bool)
            fresh[1:] = (d0[by][1:] != d0[by][:-1]) | (d1[by][1:] != d1[by][:-1])
            first = np.empty(n + m, np.int64)
            first[by] = by[np.maximum.accumulate(np.where(fresh, np.arange(n + m), 0))]
            later = first != np.arange(n + m)
            spans = [(int(row[k]), int(start[k]), int(end[k])) for k in np.flatnonzero(later[:n])]
            #: Anchors whose first occurrence in the batch lies equally far away are compared in one stretch.
            again = n + np.flatnonzero(later[n:])
            there, shift = row[first[again]], start[again] - start[first[again]]
            by = np.lexsort((start[again], shift, there, row[again]))
            again, there, shift = again[by], there[by], shift[by]
            new = np.ones(len(again), bool)
            new[1:] = (row[again][1:] != row[again][:-1]) | (there[1:] != there[:-1]) | (shift[1:] != shift[:-1])
            begin = np.flatnonzero(new)
            runs: dict[int, list] = {}
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(again)][: len(begin)]):
                own = int(row[again[a]])
                at, data = stretch(hashes[int(there[a])], int(start[again[a]] - shift[a]), int(start[again[b - 1]] - shift[a]))
                if found := equal_runs(hashes[own].astype(np.uint32), at + int(shift[a]), data):
                    runs.setdefault(own, []).extend(found)
            for own, found in runs.items():
                spans += [(own, a, b) for a, b in word_spans(texts[own], found)]
            kept, g = np.flatnonzero(~later), len(spans)
            gone = np.array(spans, np.int64).reshape(-1, 3)
            take = pa.array(np.concatenate([row[kept], gone[:, 0]]))
            mix = (np.arange(g, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)  # dealt evenly
            columns = [*(batch.column(c).take(take) for c in range(3))]
            columns += [pa.array(np.concatenate([x[kept], y]).astype(np.int32)) for x, y in ((start, gone[:, 1]), (end, gone[:, 2]))]
            columns += [pa.array(np.concatenate([d0[kept], mix])), pa.array(np.concatenate([d1[kept], np.zeros(g, np.int64)]))]
            columns.append(pa.array(np.concatenate([(kept >= n).astype(np.int8), np.full(g, 2, np.int8)])))
            yield pa.RecordBatch.from_arrays(columns, ["id", "tie", "num", "start", "end", "d0", "d1", "kind"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "tie", "num", "text").where("text is not null").mapInArrow(run, f"id {kind}, tie bigint, num bigint, start int, end int, d0 bigint, d1 bigint, kind tinyint")


def settled(units: DataFrame) -> DataFrame:
    """id, tie, num, start, end, first: the candidates that are not the first of their digest; for anchors, first is where that stands."""
    kind = units.schema["id"].dataType.simpleString()
    order = ["kind", "d0", "d1", "id", "tie", "num", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the first occurrence of the digest that the last batch ended with
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            d0, d1, kinds = (batch.column(c).to_numpy() for c in (5, 6, 7))
            fresh = np.ones(len(d0), bool)
            fresh[1:] = (d0[1:] != d0[:-1]) | (d1[1:] != d1[:-1]) | (kinds[1:] != kinds[:-1])
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(d0)), 0))
            gone = ~fresh | (kinds == 2)
            if held is not None:
                gone[0] = False
            if kinds[-1] != 2:
                held = batch.slice(int(first[-1]), 1)
            else:
                held = None
            at = np.flatnonzero(gone)
            take, there = pa.array(at), pa.array(first[at])
            anchor = kinds[at] == 1
            named = [batch.column(c).take(there) for c in range(4)]
            source = pa.StructArray.from_arrays(named, ["id", "tie", "num", "at"], mask=pa.array(~anchor))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(5)), source], ["id", "tie", "num", "start", "end", "first"])

    dealt = units.repartition("d0").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, f"id {kind}, tie bigint, num bigint, start int, end int, first struct<id:{kind},tie:bigint,num:bigint,at:int>")


def compared(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rk, rk2, at, words: for documents with anchors, the words of earlier occurrences, to be laid on from the place ``at``."""
    named = gone.where("end < 0").select("*", "first.at").withColumns(_names("", "rk", "rk2") | _names("first.", "frk", "frk2"))
    shift = (F.col("start") - F.col("at")).alias("shift")
    asked = named.groupBy("rk", "rk2", "frk", "frk2", shift).agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    asked = stored(asked, "asked")
    #: Very many documents may ask for stretches of one: they are dealt over copies of it.
    parts = asked.groupBy("frk").agg(F.ceil(F.count("*") / ASKED).alias("parts"))
    asked = asked.join(parts, "frk").withColumn("part", F.pmod(F.xxhash64("rk", "shift"), "parts"))
    lists = asked.groupBy("frk", "frk2", "part").agg(F.collect_list(F.struct("rk", "rk2", "shift", "lo", "hi")).alias("asked"))
    texts = rows.select(F.col("rk").alias("frk"), F.col("rk2").alias("own"), "text").join(lists, "frk").select("text", "own", "frk2", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in by_bytes(batches, 0):
            out = [[], [], [], []]
            for text, own, wanted, each in zip(*(c.to_pylist() for c in batch.columns)):
                if own != wanted:  # two rows with one key
                    continue
                h = words.hashes(text)
                for a in each:
                    at, data = stretch(h, a["lo"], a["hi"])
                    for column, value in zip(out, (a["rk"], a["rk2"], at + a["shift"], data.tobytes())):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["rk", "rk2", "at", "words"])

    return texts.mapInArrow(run, "rk bigint, rk2 bigint, at int, words binary")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` with their own columns, the text without its repeated units, and removed_spans (offsets in code points)."""
    names = [c for c in docs.columns if c != "removed_spans"]
    rows = keyed(docs.select(*(F.col(f"`{c}`") for c in names)), id_col, text_col)
    gone = stored(settled(candidates(rows, separator, min_words)), "gone")
    spans = gone.where("end >= 0").withColumns(_names("", "rk", "rk2")).select("rk", "rk2", F.struct("start", "end").alias("span"), F.lit(None).cast("struct<at:int,words:binary>").alias("found"))
    found = compared(rows, gone).select("rk", "rk2", F.lit(None).cast("struct<start:int,end:int>").alias("span"), F.struct("at", "words").alias("found"))
    each = spans.unionByName(found).groupBy("rk", "rk2").agg(F.collect_list("span").alias("spans"), F.collect_list("found").alias("found"))
    each = each.select(F.col("rk").alias("_rk"), F.col("rk2").alias("_rk2"), "spans", "found")
    #: The second condition is written so that the join stays one on rk alone, where the rows lie.
    whole = rows.join(each, (F.col("rk") == F.col("_rk")) & (F.col("rk2").bitwiseXOR(F.col("_rk2")) == 0), "left")

    @F.pandas_udf("text string, removed array<struct<start:int,end:int>>")
    def cut(text: pd.Series, spans: pd.Series, found: pd.Series) -> pd.DataFrame:
        words, texts, removed = Words(), [], []
        for t, x, y in zip(text, spans, found):
            rest, gone = None, []
            if t is not None:
                gone = [(s["start"], s["end"]) for s in x]
                if len(y):
                    own = words.hashes(t).astype(np.uint32)
                    gone += word_spans(t, [r for a in y for r in equal_runs(own, a["at"], np.frombuffer(a["words"], np.uint32))])
                rest, gone = without(t, gone, separator)
            texts.append(rest)
            removed.append([{"start": a, "end": b} for a, b in gone])
        return pd.DataFrame({"text": pd.Series(texts, dtype=object), "removed": removed})

    touched = F.col("spans").isNotNull()
    done = whole.select("row", "text", touched.alias("touched"), cut(F.when(touched, F.col("text")), "spans", "found").alias("c"))
    text = F.when(F.col("touched"), F.col("c.text")).otherwise(F.col("text"))
    return done.select(*(text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names), F.col("c.removed").alias("removed_spans"))


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: what is left of its text and the removed spans of the original."""
    done = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("doc_id", F.size("removed_spans").alias("n_spans"), F.aggregate("removed_spans", F.lit(0), lambda n, s: n + s.end - s.start).alias("n_removed"), "removed_spans", "text")
