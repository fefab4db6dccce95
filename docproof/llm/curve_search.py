"""Approximate nearest neighbours over shifted Hilbert curves.

Vectors are rotated at random and projected onto a few axes, several times; each projection is shifted and
read along a Hilbert curve. Every curve's order is cut into pieces of equal size (range partitioning by
quantiles of its keys); a query goes to the pieces within ``reach`` of its own, a share of all rows on either
side, is compared with their vectors in blocks, and the finds of all curves merge and are ranked by exact
distance.

A piece is asked by a share of all queries: they are dealt in parts of about ``ASKED``, each with a copy of the
piece. There are ``LEAST_PIECES`` pieces or more, so a window is the same share of the rows at every size.

The window is a share of the rows, since in data without structure (independent directions in 64 dimensions,
say) neighbours lie hardly closer together on a curve than other rows: a fixed number of rows would lose
recall as the table grows. So the work is (queries x rows), in matrix products.

Equal vectors are one entry with the smallest ``k + 1`` of their ids, which no result can exceed: a vector that
a third of all rows hold costs one entry.

Defined cases: vectors that are null, empty, zero, hold a null or non-finite component, or have another length
than most, take no part, nor do null ids; rows of one id and vector are one row; rows that share a query's id
are its own; ties go to the smaller id; a table without vectors gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docproof.llm.common import stored

#: Curves, axes of each, bits of an axis, bits that part equal cells, share of rows on either side.
CURVES, AXES, BITS, TIE_BITS, REACH = 8, 4, 12, 5, 0.12
#: Pieces of a curve at least, where each has LEAST_ROWS; rows of a piece about; queries that one task compares with a piece.
LEAST_PIECES, LEAST_ROWS, PIECE_ROWS, ASKED = 100, 8, 16_384, 4096


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of cells (n, axes) along the Hilbert curve, by Gray-code transposition of all rows at once."""
    x = [c.copy() for c in cells.T.astype(np.int64)]
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(len(x)):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            if i:
                x[i] ^= swap
        bit >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flip = np.where((x[-1] & bit) != 0, flip ^ (bit - 1), flip)
        bit >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | (((axis ^ flip) >> b) & 1)
    return key


def rotations(dim: int, curves: int, axes: int) -> np.ndarray:
    """(dim, curves * axes): orthonormal axes of each curve; fixed, so every task has the same."""
    rng = np.random.default_rng(20240229)
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, min(axes, dim))))[0] for _ in range(curves)], axis=1)


def _vectors(rows: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(vec_id, entry, vector): valid vectors as bytes of doubles, and 128 bits that name equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, dim) + 0.0  # no negative zeros
            data = [v.tobytes() for v in values]
            entry = [hashlib.blake2b(d, digest_size=16).digest() for d in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(entry, pa.binary()), pa.array(data, pa.binary())], ["vec_id", "entry", "vector"])

    return rows.select(F.col(id_col).cast("bigint"), F.col(vector_col)).mapInArrow(run, "vec_id bigint, entry binary, vector binary")


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, dim)


def nearest(rows: DataFrame, queries=None, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", reach: float = REACH, curves: int = CURVES) -> DataFrame:
    """query_id, rank, vec_id, score for the rows that the condition ``queries`` names (ids divisible by 100)."""
    value = F.col(vector_col).cast("array<double>")
    sound = F.col(id_col).isNotNull() & (F.size(value) > 0) & F.exists(value, lambda v: v != 0)
    sound &= ~F.exists(value, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.select(F.col(id_col), value.alias(vector_col)).where(sound)
    sizes = rows.groupBy(F.size(vector_col).alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if sizes is None:
        return rows.sparkSession.createDataFrame([], schema)
    dim = sizes["dim"]
    valid = stored(_vectors(rows.where(F.size(vector_col) == dim), id_col, vector_col, dim), "vectors")
    asking = valid.where(F.expr("vec_id % 100 = 0") if queries is None else queries).select(F.col("vec_id").alias("query_id"), "entry").distinct()
    smallest = valid.distinct().withColumn("r", F.row_number().over(Window.partitionBy("entry").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    entries = smallest.groupBy("entry").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("vector").alias("vector"))
    entries = entries.join(asking.select("entry", F.lit(True).alias("asked")).distinct(), "entry", "left")
    entries = stored(entries.withColumn("asked", F.coalesce("asked", F.lit(False))), "entries")
    axes = min(AXES, dim)
    turn, shifts = rotations(dim, curves, axes), np.random.default_rng(7).random(curves * axes)

    def extent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high = np.full(curves * axes, np.inf), np.full(curves * axes, -np.inf)
        for batch in batches:
            at = _matrix(batch["vector"], dim) @ turn
            low, high = np.minimum(low, at.min(0, initial=np.inf)), np.maximum(high, at.max(0, initial=-np.inf))
        yield pd.DataFrame({"axis": range(curves * axes), "low": low, "high": high})

    bounds = entries.select("vector").mapInPandas(extent, "axis int, low double, high double").groupBy("axis").agg(F.min("low"), F.max("high")).orderBy("axis").collect()  # a row for each axis
    low, high = np.array([b[1] for b in bounds]), np.array([b[2] for b in bounds])

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            unit = (_matrix(batch["vector"], dim) @ turn - low) / np.maximum(high - low, 1e-300)
            cells = ((np.clip(unit, 0, 1) + shifts) * 0.5 * ((1 << BITS) - 1)).astype(np.int64)
            tie = np.array([e[0] >> (8 - TIE_BITS) for e in batch["entry"]], np.int64)
            out = {f"k{c}": (hilbert_keys(cells[:, c * axes : (c + 1) * axes], BITS) << TIE_BITS) | tie for c in range(curves)}
            yield pd.DataFrame({"entry": batch["entry"], "ids": batch["ids"], "vector": batch["vector"], "asked": batch["asked"], **out})

    names = [f"k{c}" for c in range(curves)]
    keyed = stored(entries.mapInPandas(keys, "entry binary, ids array<bigint>, vector binary, asked boolean, " + ", ".join(f"{c} bigint" for c in names)), "keys")
    n = keyed.count()
    pieces = max(1, min(LEAST_PIECES, n // LEAST_ROWS), -(-n // PIECE_ROWS))
    quantiles = keyed.approxQuantile(names, [i / pieces for i in range(1, pieces)], 0.1 / pieces) if pieces > 1 else [[]] * curves  # curves x pieces numbers
    edges = [np.array(q, np.float64) for q in quantiles]
    wide = int(np.ceil(reach * pieces))
    parts = max(1, -(-keyed.where("asked").count() * (2 * wide + 1) // (pieces * ASKED)))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c in range(curves):
                own = np.searchsorted(edges[c], batch[f"k{c}"].to_numpy(np.float64), side="right")
                for part in range(parts):
                    yield pd.DataFrame({"curve": c, "piece": own, "part": part, "entry": batch["entry"], "ids": batch["ids"], "vector": batch["vector"]})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            part = np.array([int.from_bytes(e[:8], "little") % parts for e in batch["entry"]], np.int64)
            for c in range(curves):
                own = np.searchsorted(edges[c], batch[f"k{c}"].to_numpy(np.float64), side="right")
                for d in range(-wide, wide + 1):
                    there = (own + d >= 0) & (own + d < pieces)
                    yield pd.DataFrame({"q_curve": c, "q_piece": (own + d)[there], "q_part": part[there], "q_entry": batch["entry"][there], "q_vector": batch["vector"][there]})

    dealt = keyed.mapInPandas(deal, "curve int, piece int, part int, entry binary, ids array<bigint>, vector binary")
    asked = keyed.where("asked").mapInPandas(ask, "q_curve int, q_piece int, q_part int, q_entry binary, q_vector binary")

    def search(_, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(q) and len(c):
            there, squares = _matrix(c["vector"], dim), None
            squares = (there**2).sum(1)
            ids, names_ = list(c["ids"]), list(c["entry"])
            smallest, few = np.array([int(i[0]) for i in ids]), min(k + 1, len(c))
            for at in range(0, len(q), 256):
                part = q.iloc[at : at + 256]
                here = _matrix(part["q_vector"], dim)
                rough = squares - 2 * here @ there.T
                #: All that rounding may have put behind the last of the nearest, ties included.
                reach_ = 4 * (dim + 4) * np.finfo(np.float64).eps * (np.sqrt(squares.max()) + np.sqrt((here**2).sum(1))) ** 2
                most = np.partition(rough, few - 1, axis=1)[:, few - 1] + reach_
                for name, v, near, limit in zip(part["q_entry"], here, rough, most):
                    row = np.flatnonzero(near <= limit)
                    exact = np.sqrt(((there[row] - v) ** 2).sum(1))
                    order = np.lexsort((smallest[row], exact))[: k + 1]
                    out += [(name, names_[i], ids[i], d) for i, d in zip(row[order].tolist(), exact[order].tolist())]
        return pd.DataFrame(out, columns=["query", "entry", "ids", "score"])

    found = asked.groupBy("q_curve", "q_piece", "q_part").cogroup(dealt.groupBy("curve", "piece", "part")).applyInPandas(search, "query binary, entry binary, ids array<bigint>, score double")
    once = found.groupBy("query", "entry").agg(F.first("ids").alias("ids"), F.min("score").alias("score"))
    each = once.select("query", "score", F.explode("ids").alias("vec_id"))
    top = each.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1)
    own = asking.join(top, asking.entry == top["query"]).where("vec_id <> query_id")
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op5_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
