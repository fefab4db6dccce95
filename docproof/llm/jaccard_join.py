"""N-gram Jaccard join with a token-group matrix.

A document's tokens are 64-bit hashes of its distinct word shingles. Equal sets are one node. Two sets whose
similarity reaches the threshold share a token among the first of each in any one order of all tokens (the
prefix); of the smaller set, a shorter prefix is enough.

1. Tokens are counted over all documents in an array of ``BUCKETS`` counters, whose size does not depend on the
   input; the order of tokens is by the counter's level, rare ones first, then by hash. So prefixes hold rare
   tokens, and a passage that very many documents share opens no long lists.
2. Each node is compared with the node it shares most of its ``SEEDS`` smallest tokens with: large groups of
   near copies join up in one linear step, which gives components. What this misses is left to step 3.
3. Nodes of one component, in parts of about ``GROUP`` members, are the groups: similar documents. The
   matrix of prefix tokens against groups names, for every node, the groups of other components that share a
   token early enough; the group's token union bounds the overlap of the node with any member, and only where
   the bound reaches the threshold is the group opened and the members compared exactly.
4. All links found make the components of the result.

Every pair that could link across two components of step 2 is bounded or compared, so no link between
components is lost, and no pairs are listed inside a group.

One text of each node is written once, in buckets; later steps fetch tokens from there and move no texts.

Defined cases: a null text, or one without words, has no tokens, links with nothing and is its own component;
a text with fewer words than a shingle is one token; rows with equal ids count as rows of one id; an id of
null takes part, and a component of null ids alone is null; very long texts are taken whole, one at a time;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import gc
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docproof.llm.common import by_bytes, laid_out, stored

#: Words whose hashes a task keeps; tokens that pick a first partner; members of a group; nodes compared with a group in one task.
TABLE_WORDS, SEEDS, GROUP, ASKED = 300_000, 8, 256, 1024
#: Counters of tokens, in slices that are added up apart.
BUCKETS, SLICES = 1 << 22, 256


class Shingler:
    """Token sets of whole texts."""

    def __init__(self, size: int):
        self.size, self.words = size, {}

    def tokens(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.empty(0, np.int64)
        known = self.words
        if len(known) > TABLE_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(self.size, len(words))
        mixed = np.full(len(words) - size + 1, size, np.uint64)
        for k in range(size):
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(words) - size + 1 + k]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return np.unique((mixed ^ (mixed >> np.uint64(29))).view(np.int64))


def set_name(tokens: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def needed(n, percent: int):
    """Least overlap of a set of n with any set it may link with."""
    return -(-percent * n // 100)


def enough(n: int, m: int, percent: int) -> int:
    """Least overlap of linked sets of n and m."""
    return -(-percent * (n + m) // (100 + percent))


def bucket_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens.view(np.uint64) >> np.uint64(64 - (BUCKETS - 1).bit_length())).astype(np.int64)


def signatures(texts: DataFrame, size: int) -> DataFrame:
    """Rows of two kinds: id, rk, n, set and seeds (the first tokens by hash) of each row of texts(id, rk, text); slice and counts of a task's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        shingler, counts, kind = Shingler(size), np.zeros(BUCKETS, np.uint32), None
        names = ["id", "rk", "n", "set", "seeds", "slice", "counts"]
        for batch in by_bytes(batches, 2):
            found = [shingler.tokens(text) for text in batch.column(2).to_pylist()]
            counts += np.bincount(bucket_of(np.concatenate([np.empty(0, np.int64), *found])), minlength=BUCKETS).astype(np.uint32)
            kind, m = batch.schema.field(0).type, len(found)
            columns = [batch.column(0), batch.column(1), pa.array(map(len, found), pa.int64()), pa.array([set_name(t) if len(t) else None for t in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([t[:SEEDS] for t in found], pa.list_(pa.int64())), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
        if kind is not None:
            slices = [(k, zlib.compress(part.tobytes(), 1)) for k, part in enumerate(counts.reshape(SLICES, -1)) if part.any()]
            m = len(slices)
            empty = [pa.nulls(m, kind), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([k for k, _ in slices], pa.int32()), pa.array([c for _, c in slices], pa.binary())], names)

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, rk bigint, n bigint, set binary, seeds array<bigint>, slice int, counts binary")


def levels(counted: DataFrame) -> np.ndarray:
    """One byte for each counter: 0 for counts within the noise of the array, else the logarithm of what is above it.

    The noise of a counter grows with the square root of the input. What comes to the driver are SLICES rows.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[k] = sums.get(k, np.int64(0)) + np.frombuffer(zlib.decompress(data), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.astype(np.float32).tobytes() for s in sums.values()], pa.binary())], ["slice", "sums"])

    sums = np.zeros((SLICES, BUCKETS // SLICES), np.float32)
    for k, data in counted.repartition("slice").mapInArrow(add, "slice int, sums binary").collect():
        sums[k] = np.frombuffer(data, np.float32)
    usual = float(np.median(sums))
    above = (sums.ravel() - usual) / np.sqrt(usual + 1)
    return np.where(above > 4, np.minimum(8 * np.log2(np.maximum(above, 0) + 1), 255), 0).astype(np.uint8)


def fetch_tokens(layout: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, tokens) of the given nodes(node, rk), from the texts that stand for them."""
    some = layout.join(nodes.select("rk", F.col("node").alias("asked")), "rk").select("text", "node", "asked", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        shingler = Shingler(size)
        for batch in by_bytes(batches, 0):
            node, data = [], []
            for text, own, asked, name in zip(*(c.to_pylist() for c in batch.columns)):
                if own == asked and set_name(t := shingler.tokens(text)) == name:  # else two rows have one key
                    node.append(own)
                    data.append(t.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(data, pa.binary())], ["node", "tokens"])

    return some.mapInArrow(run, "node bigint, tokens binary")


def prefixes(layout: DataFrame, order: np.ndarray, size: int, percent: int) -> DataFrame:
    """(node, n, rare, prefix) of every node: its first tokens in the order, and how many in a thousand of all its tokens are rare."""
    level = layout.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        shingler, rank = Shingler(size), level.value
        for batch in by_bytes(batches, 0):
            rows = []
            for text, node, name in zip(*(c.to_pylist() for c in batch.columns)):
                if set_name(t := shingler.tokens(text)) == name:  # else two rows have one key
                    own = rank[bucket_of(t)]
                    rows.append((node, len(t), 1000 * int((own == 0).sum()) // len(t), t[np.argsort(own, kind="stable")[: len(t) - needed(len(t), percent) + 1]]))
            columns = list(zip(*rows)) if rows else [()] * 4
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["node", "n", "rare", "prefix"])

    return layout.select("text", "node", "set").mapInArrow(run, "node bigint, n int, rare int, prefix array<bigint>")


def components(links: DataFrame) -> DataFrame:
    """(node, root) from links(a, b): neighbours of every node move to its smallest one, in turns over larger and smaller neighbours."""
    edges = stored(links.select("a", "b").where("a <> b").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, "links")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = stored(small, "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def similar(a: int, b: int, common: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def may_link(c, n, low, high, percent: int):
    """Whether a set of n and one of low to high tokens can reach the threshold, with c common ones in the long prefix of the larger and the short one of the smaller.

    Common tokens up to the end of the prefix that ends first are among the c; behind it the larger set has
    needed(its size) - 1 tokens, the smaller enough(its size, its size) - 1. Both grow with the size: the largest
    rest against the least need holds for every size of the range.
    """
    smaller, larger = F.least(n, high), F.greatest(n, high)
    rest = F.greatest(F.ceil(2 * percent * smaller / (100 + percent)), F.ceil(percent * larger / 100)) - 1
    return c + rest >= F.ceil(percent * (n + low) / (100 + percent))


def linked(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b) that reach the threshold, compared exactly; a node b that very many are compared with is dealt over copies of it."""
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / ASKED).alias("parts"))
    dealt = pairs.join(parts, "b").withColumn("part", F.pmod(F.xxhash64("a"), "parts"))
    left = tokens.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    right = tokens.select(F.col("node").alias("b"), F.col("tokens").alias("tb")).join(parts, "b").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))

    @F.pandas_udf("boolean")
    def close(ta: pd.Series, tb: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(ta, tb):
            x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
            out.append(similar(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)), percent))
        return pd.Series(out)

    return dealt.join(left, "a").join(right.drop("parts"), ["b", "part"]).where(close("ta", "tb")).select("a", "b")


def opened(queries: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links(a, b) of queries(root, salt, part, node, tokens) with the members(root, salt, part, node, tokens) of the groups they are sent to."""

    def run(key, asked: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(t, np.int64) for t in group["member_tokens"]]
        union, names = (np.unique(np.concatenate(sets)), list(group["member"])) if sets else (np.empty(0, np.int64), [])
        out = []
        for node, data in zip(asked["asked"], asked["asked_tokens"]):
            x = np.frombuffer(data, np.int64)
            inside = x[np.isin(x, union, assume_unique=True)]
            if len(inside) < needed(len(x), percent):
                continue
            for name, y in zip(names, sets):
                if similar(len(x), len(y), min(len(inside), len(y)), percent) and similar(len(x), len(y), len(np.intersect1d(inside, y, assume_unique=True)), percent):
                    out.append((node, name))
                    break  # the members are one component: one link joins it
        return pd.DataFrame(out, columns=["a", "b"])

    keys = ["root", "salt", "part"]
    fresh = members.select(*(F.col(k).alias(f"group_{k}") for k in keys), F.col("node").alias("member"), F.col("tokens").alias("member_tokens"))
    asked = queries.select(*(F.col(k).alias(f"asked_{k}") for k in keys), F.col("node").alias("asked"), F.col("tokens").alias("asked_tokens"))
    asked, fresh = asked.groupBy(*(f"asked_{k}" for k in keys)), fresh.groupBy(*(f"group_{k}" for k in keys))
    return asked.cogroup(fresh).applyInPandas(run, "a bigint, b bigint")


def first_links(layout: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """Links(a, b) of nodes of sets(node, rk, n, seeds, rare) with one they share many seeds with: of the nodes that hold a seed, the one with the least share of rare tokens leads, since copies were made of it."""
    seeds = sets.select("node", "n", "rare", F.size("seeds").alias("seeds"), F.explode("seeds").alias("token"))
    leaders = seeds.groupBy("token").agg(F.count("*").alias("c"), F.min(F.struct("rare", "node", "n")).alias("leader")).where("c > 1").select("token", "leader")
    best = seeds.join(leaders, "token").where(F.col("node") != F.col("leader.node")).groupBy("node", "n", "seeds", "leader").agg(F.count("*").alias("c"))
    n, m = F.col("n"), F.col("leader.n")
    best = best.where((3 * F.col("c") >= F.col("seeds")) & (100 * F.least(n, m) >= percent * F.greatest(n, m)))
    best = best.groupBy("node").agg(F.max_by("leader.node", F.struct("c", -F.col("leader.rare"), "leader")).alias("leader"))
    pairs = stored(best.select(F.col("node").alias("a"), F.col("leader").alias("b")), "pairs")
    both = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(sets.select("node", "rk"), "node")
    tokens = stored(fetch_tokens(layout, both, size), "tokens")
    return stored(linked(pairs, tokens, percent), "first")


def near_groups(entries: DataFrame, percent: int) -> DataFrame:
    """(node, root, salt): nodes of entries(token, node, n, at, root, members) and the groups of other components that may hold a partner."""
    #: One shuffle of the entries; the groups by token, and the join with them, stay where it has dealt them.
    dealt = entries.repartition("token")
    whole = F.max("node").isNotNull() & F.max("members").isNotNull()  # both uses read all columns, so Spark shuffles once
    n = F.col("n")
    short = F.col("at") <= n - F.ceil(2 * percent * n / (100 + percent))  # the prefix that is enough beside sets as large or larger
    mixed = dealt.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.bool_or(short).alias("short"), whole.alias("whole")).where("x <> y and short and whole").select("token")
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / GROUP)).cast("int")
    entries = stored(dealt.join(mixed, "token").withColumns({"salt": salt, "short": short}), "entries")
    #: The matrix: per token and group, the least place and the range of sizes of its members.
    matrix = entries.groupBy("token", "root", "salt", "members", "short").agg(F.min("at").alias("j"), F.min("n").alias("least"), F.max("n").alias("most"))
    asked = entries.select("token", "node", "n", F.col("at").alias("i"), F.col("root").alias("own"), F.col("members").alias("own_members"), F.col("short").alias("own_short"))
    smaller = (F.col("own") != F.col("root")) & (F.struct("own_members", "own") < F.struct("members", "root"))
    #: Only members of sizes that fit can link, and all their common tokens are in entries with such sizes.
    fitting = (100 * F.col("most") >= percent * F.col("n")) & (percent * F.col("least") <= 100 * F.col("n"))
    near = asked.join(matrix, "token").where(smaller & fitting & (F.col("short") | F.col("own_short")))
    near = near.groupBy("node", "root", "salt").agg(F.min("i").alias("i"), F.min("j").alias("j"), F.count("*").cast("int").alias("c"), F.max("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    low = F.greatest(F.col("least"), F.ceil(percent * F.col("n") / 100))  # sizes in the group that may link
    high = F.least(F.col("most"), F.floor(100 * F.col("n") / percent))
    #: The places of the first common token, and the number of common tokens, still allow the threshold at some size.
    possible = (
        (low <= high)
        & (percent * (F.col("n") + low) <= (100 + percent) * (F.col("n") - F.col("i")))
        & (percent * F.col("n") + (100 + percent) * F.col("j") <= 100 * high)
        & may_link(F.col("c"), F.col("n"), low, high, percent)
    )
    return stored(near.where(possible).select("node", "root", "salt"), "near")


class Solved:
    """What the steps leave: rows(id, rk, n, set), sets(set, id, rk, n, node), their components and the layout of one text for each node."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, others: tuple[str, ...] = ()):
        text = F.col(text_col).cast("string")
        texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("rk"), text.alias("text"), *others)
        signed = stored(signatures(texts.select("id", "rk", "text"), size), "signatures")
        self.rows = signed.where("slice is null").select("id", "rk", "n", "set", "seeds")
        order = levels(signed.where("slice is not null").select("slice", "counts"))
        self.repeated = not self.rows.groupBy("rk").count().where("count > 1").isEmpty()  # the same id and text
        sets = self.rows.where("set is not null").groupBy("set").agg(F.min(F.struct("id", "rk")).alias("first"), F.first("n").alias("n"), F.first("seeds").alias("seeds"))
        sets = sets.select("set", "first.id", "first.rk", "n", "seeds", F.monotonically_increasing_id().alias("node"))
        self.sets = sets = stored(sets, "sets")  # numbered as written
        chosen = texts.drop("id").join(sets.select("rk", "node", "set"), "rk")
        self.layout = laid_out(chosen.dropDuplicates(["rk", "node"]) if self.repeated else chosen, "rk", "texts")

        kept = stored(prefixes(self.layout, order, size, percent), "prefixes")
        first = first_links(self.layout, sets.join(kept.select("node", "rare"), "node"), size, percent)
        roots = components(first)
        members = roots.join(roots.groupBy("root").agg(F.count("*").alias("members")), "root")
        placed = sets.select("node", "rk").join(members, "node", "left").select("node", "rk", F.coalesce("root", "node").alias("root"), F.coalesce("members", F.lit(1)).alias("members"))
        placed = stored(placed, "placed")
        entries = kept.drop("rare").join(placed.select("node", "root", F.col("members").cast("int").alias("members")), "node")
        near = near_groups(entries.select(F.posexplode("prefix").alias("at", "token"), "node", "n", "root", "members"), percent)

        #: Very many nodes may be sent to one group: they are dealt over copies of it.
        parts = near.groupBy("root", "salt").agg(F.ceil(F.count("*") / ASKED).alias("parts"))
        near = near.join(parts, ["root", "salt"]).withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
        members = parts.join(placed.select("root", F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / GROUP)).cast("int").alias("salt"), "node"), ["root", "salt"])
        members = members.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
        wanted = members.select("node").unionByName(near.select("node")).distinct().join(sets.select("node", "rk"), "node")
        tokens = stored(fetch_tokens(self.layout, wanted, size), "tokens")
        more = opened(near.join(tokens, "node"), members.join(tokens, "node"), percent)
        roots = components(first.unionByName(more))
        rooted = sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
        self.components = rooted.join(least, "root").select("set", "node", "id", "rk", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """Per row: id_col, n_shingles, component_id (the smallest id reachable by links)."""
    solved = Solved(docs, id_col, text_col, size, percent)
    own = solved.components.select("set", "component_id")
    joined = solved.rows.select("id", "n", "set").join(own, "set", "left")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("set").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """The rows of ``docs``, one of each component: that with the smallest (id, text). Rows without words stay; of equal rows one stays."""
    names, own = docs.columns, F.struct(F.col(id_col), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("\x00"))).alias("text"))
    others = [F.col(f"`{c}`") for c in names if c != text_col] or [F.lit(0)]
    keyed = docs.select(F.struct(*others).alias("_row"), own.alias("_own"), F.col(text_col).cast("string").alias("_text"))
    solved = Solved(keyed, "_own", "_text", size, percent, ("_row",))
    kept = solved.components.where(F.col("id") == F.col("component_id")).select("rk", F.col("node").alias("_node"))
    #: Compared so that the join stays one on rk alone, where the rows lie.
    kept = solved.layout.join(kept, "rk").where(F.col("node").bitwiseXOR(F.col("_node")) == 0).select("_row", F.col("text").alias("_text"))
    bare = keyed.where(~F.coalesce(F.col("_text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    bare = (bare.dropDuplicates(["_own"]) if solved.repeated else bare).select("_row", "_text")
    return kept.unionByName(bare).select(*(F.col("_text").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in names))
