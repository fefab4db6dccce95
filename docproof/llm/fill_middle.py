"""Fill-in-middle transformation by an Aho-Corasick scan for events.

One automaton finds what can end a unit, the ASCII white space characters, and the sentinels. A unit is a run of
other characters with the white space before it, so between two events that stand k > 1 characters apart lies one
unit's end, whatever the k - 1 characters are: the number of units up to each event is a running count of such gaps,
and the end of unit r is the event whose count first reaches r. Characters between events are never looked at.

Which texts are cut, where, and in which order follows from a hash of the seed and the id alone, so it is the same
on every attempt of a task and at every partitioning.

Defined cases: a null or empty text has no units and stays plain; a text that holds a sentinel stays plain, whatever
it says else; texts of any length are whole; cuts that coincide give an empty middle; equal ids are cut at equal
ranks; a null id hashes as the empty string; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docproof.llm.common import by_bytes

#: Fixed values of the contract: sentinels before prefix, suffix and middle, and the white space that parts units.
SENTINELS = ("<P>", "<S>", "<M>")
SPACES = "\t\n\x0b\x0c\r "


class EventScan:
    """The automaton over white space and sentinels; it is built once for each task."""

    def __init__(self, sentinels: tuple[str, str, str] = SENTINELS):
        import ahocorasick

        self.sentinels = sentinels
        self.automaton = ahocorasick.Automaton()
        for c in SPACES:
            self.automaton.add_word(c, 0)
        for s in sentinels:
            self.automaton.add_word(s, 1)
        self.automaton.make_automaton()

    def ends(self, text: str) -> tuple[np.ndarray, bool]:
        """The end of every unit of a text (code points, ascending), and whether a sentinel stands in it."""
        found = np.fromiter((2 * at + kind for at, kind in self.automaton.iter(text)), np.int64)
        marked = bool((found & 1).any())
        events = found[found & 1 == 0] >> 1 if marked else found >> 1
        size = len(text)
        before = np.concatenate(([-1], events))
        behind = np.concatenate((events, [size]))
        ends = behind[behind - before > 1]
        if size and len(events) and events[-1] == size - 1:  # white space that no unit follows is one of its own
            ends = np.append(ends, size)
        return ends, marked

    def cut(self, text: str, h: tuple[int, int, int, int], rate: int, spm: int) -> tuple[str, int, str, int | None, int | None]:
        """The new text, its number of units, its form, and the code points of prefix and middle."""
        ends, marked = self.ends(text)
        n = len(ends)
        if not text or marked or h[2] % 100 >= rate:
            return text, n, "plain", None, None
        first, last = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        a, b = (int(ends[r - 1]) if r else 0 for r in (first, last))
        p, s, m = self.sentinels
        if h[3] % 100 < spm:
            return f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}", n, "spm", a, b - a
        return f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}", n, "psm", a, b - a


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80, sentinels: tuple[str, str, str] = SENTINELS
) -> DataFrame:
    """Per row: id_col, n, form, prefix_chars, middle_chars and output.

    ``rate`` percent of the texts are cut, ``spm`` percent of those put the suffix first.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    source = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.substring(digest, 1, 32).alias("hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = EventScan(sentinels)
        for batch in by_bytes(batches, 1):
            hashes = (tuple(int(h[k : k + 8], 16) for k in range(0, 32, 8)) for h in batch.column(2).to_pylist())
            done = [scan.cut(t, h, rate, spm) for t, h in zip(batch.column(1).to_pylist(), hashes)]
            output, n, form, prefix, middle = map(list, zip(*done)) if done else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                ["key", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string").withColumnRenamed("key", id_col)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text from which ``transform`` made an output of that form: a cut text holds each sentinel once."""
    p, s, m = sentinels

    def between(start: str, end: str) -> Column:
        return F.substring_index(F.substring_index(output, start, -1), end, 1)

    middle = F.substring_index(output, m, -1)
    psm, spm = F.concat(between(p, s), middle, between(s, m)), F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_middle(spark, sf_dir: str) -> DataFrame:
    """Forms, lengths and digests of every document's new text, and of the text restored from it."""
    done = transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
