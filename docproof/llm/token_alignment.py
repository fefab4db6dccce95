"""Alignment of two tokenizations by elementary intervals.

Both tokenizers cut the same bytes. The union of their ends parts the bytes into elementary intervals, each of which
lies in one token of either side, its owners, found by binary search: each interval is one overlap. Ends that both
sides have close groups, and the product of a group's tokens are its links. ``elementary`` does that for arrays of ends.

Work is done in blocks of some megabytes of text. A block is one row: its documents' figures, the block's distinct id
pairs with the number of documents that hold each, and each document's pairs as places in that list. How many
documents of the corpus hold a pair is a sum over blocks, joined back to (block, pair) and not to (document, pair);
the counts then meet the block's row, which lies in buckets and does not move.

No token of either side goes on behind the start of a marked word (white space, then a space, or a space, then a
character), so the words of a text are aligned one by one and each distinct one once for as long as a worker's table
holds it. That is checked for the vocabularies; where it does not hold, texts are aligned whole.

Defined cases: null and empty texts, and texts that either side does not give back byte by byte (such as with
U+2581), have no tokens: zeros and an empty digest; texts of any length are whole, taken in slices that end between
words; equal rows give equal rows, and each counts as a document; an empty table gives an empty table; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docproof.llm.common import by_bytes, laid_out, path_of

#: Bytes of text of a block, about, and code points of a slice of a long text.
BLOCK_BYTES, SLICE = 8 << 20, 1 << 20
#: A worker's table is emptied beyond so many words or characters.
TABLE_WORDS, TABLE_CHARS = 250_000, 16 << 20
#: Words that are aligned at a time.
PART = 30_000
#: (document, pair) entries that a block holds before equal ones are added up.
ENTRIES = 2_000_000
#: Fixed value: the pre-tokenizer's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MARK = "▁"
#: Spaces before which a text can be parted for both sides: not within white space, nor within a run of spaces.
_CUT = re.compile(r"(?<!\s) |(?<! ) (?=\S)")
_RUNS = re.compile(r"\s\s")


def elementary(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per elementary interval the token of each side that holds it and its group; both arrays ascend and have the same last end."""
    cuts = np.union1d(ends_a, ends_b)
    owner_a, owner_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    closes = (ends_a[owner_a] == cuts) & (ends_b[owner_b] == cuts)
    return owner_a, owner_b, np.cumsum(closes) - closes


def _spread(counts: np.ndarray) -> np.ndarray:
    """0 .. c-1 for each c of counts, one behind the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


class ByteSide:
    """A byte-level vocabulary: ids of texts and bytes of ids."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte-level alphabet: other bytes follow from U+0100 on
        hidden = [b for b in range(256) if b not in visible]
        byte = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
        vocabulary = model["vocab"]
        self.size = max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes = [b""] * self.size
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(byte[c] for c in token)
        merged = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        pre = spec["pre_tokenizer"] or {}
        usual = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if usual and merged == sorted(m for m in merged if m is not None) and not model.get("ignore_merges"):
            import tiktoken

            rank = {b: i for i, b in enumerate(self.bytes) if b}
            fast = tiktoken.Encoding("first", pat_str=PATTERN, mergeable_ranks=rank, special_tokens={})
            self.encode, self.splits = lambda texts: [fast.encode_ordinary(t) for t in texts], True
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(file)
            library.encode_special_tokens = True
            self.encode, self.splits = lambda texts: [e.ids for e in library.encode_batch(texts, add_special_tokens=False)], False


class PieceSide:
    """A SentencePiece model: ids of texts (each gets a space in front) and bytes of ids."""

    def __init__(self, file: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=file)
        self.size = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(self.size)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.marker = self.library.piece_to_id(MARK)
        probe = " a  b c\n\tééﬁ　 "
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) and self.library.decode(self.library.encode(probe)) == probe

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [ids or [self.marker] for ids in self.library.encode(texts, num_threads=1)]


class WordTable:
    """The alignment of each distinct word: figures, the groups as text, and id pairs with the links that they have."""

    def __init__(self, first: str, second: str):
        self.a, self.b = ByteSide(first), PieceSide(second)
        self.splits = self.a.splits and self.b.splits
        self.widths = [np.fromiter(map(len, side.bytes), np.int64, side.size) for side in (self.a, self.b)]
        self.names = list(map(str, range(max(self.a.size, self.b.size))))
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str | None] = []  # None: not given back byte by byte
        self.stats = np.zeros((0, 4), np.int64)  # tokens of both sides, groups, links
        self.starts = np.zeros(1, np.int64)
        self.pairs = self.links = np.zeros(0, np.int64)

    def words(self, text: str) -> list[str]:
        """The words of space + text, each without its first space."""
        if not self.splits:
            return [text]
        text = " " + text
        return (text.split(" ") if not _RUNS.search(text) else _CUT.split(text))[1:]

    def slices(self, text: str) -> Iterator[str]:
        """A long text in parts that begin before a word; the parts' words are the text's."""
        at = 0
        while self.splits and len(text) - at > SLICE:
            cut = _CUT.search(text, at + SLICE)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.end()
        yield text[at:]

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.index]
        if len(self.index) + len(new) > TABLE_WORDS or self.chars > TABLE_CHARS:
            self.clear()
            new = list(words)
        for at in range(0, len(new), PART):
            self._learn(new[at : at + PART])

    def _learn(self, new: list[str]) -> None:
        coded_a, coded_b = self.a.encode([" " + w for w in new]), self.b.encode(new)
        bytes_a, bytes_b = self.a.bytes.__getitem__, self.b.bytes.__getitem__
        ends = []
        for k, w in enumerate(new):
            own = (" " + w).encode()
            if b"".join(map(bytes_a, coded_a[k])) == own == b"".join(map(bytes_b, coded_b[k])):
                ends.append(len(own))
            else:
                coded_a[k], coded_b[k] = [], []
                ends.append(0)
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        self.chars += sum(map(len, new))
        self._align(coded_a, coded_b, np.cumsum(ends))

    def _align(self, coded_a: list[list[int]], coded_b: list[list[int]], word_ends: np.ndarray) -> None:
        ids_a, ids_b = (np.fromiter(itertools.chain.from_iterable(coded), np.int64) for coded in (coded_a, coded_b))
        ends_a, ends_b = np.cumsum(self.widths[0][ids_a]), np.cumsum(self.widths[1][ids_b])
        owner_a, owner_b, group = elementary(ends_a, ends_b)
        group_a, group_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        group_a[owner_a], group_b[owner_b] = group, group
        n_groups = int(group[-1]) + 1 if len(group) else 0
        each_a, each_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        last = np.cumsum(each_a) - 1
        word_of = np.searchsorted(word_ends, ends_a[last])  # words without tokens end where the one before ends
        n_words = len(coded_a)
        counted = [np.bincount(word_of, w, n_words).astype(np.int64) for w in (each_a, each_b, np.ones(n_groups))]
        links = np.zeros(n_words, np.int64)
        np.add.at(links, word_of, each_a * each_b)
        #: Per group each distinct id of one side with each of the other, with the product of their numbers.
        (of_a, a, times_a), (of_b, b, times_b) = self._distinct(group_a, ids_a), self._distinct(group_b, ids_b)
        wide = np.bincount(of_b, minlength=n_groups)
        first = np.cumsum(wide) - wide
        left = np.repeat(np.arange(len(a)), wide[of_a])
        right = first[of_a[left]] + _spread(wide[of_a])
        pairs, times = a[left] * self.b.size + b[right], times_a[left] * times_b[right]
        per_word = np.bincount(word_of[of_a[left]], minlength=n_words)
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(per_word)))
        self.pairs, self.links = np.concatenate((self.pairs, pairs)), np.concatenate((self.links, times))
        self.stats = np.concatenate((self.stats, np.stack([*counted, links], axis=1)))
        text_a, text_b = list(map(self.names.__getitem__, ids_a.tolist())), list(map(self.names.__getitem__, ids_b.tolist()))
        to_a, to_b = np.cumsum(each_a).tolist(), np.cumsum(each_b).tolist()
        shown, i, j = [], 0, 0
        for x, y in zip(to_a, to_b):
            shown.append(f"{text_a[i]}|{text_b[j]}" if x - i == 1 and y - j == 1 else f"{','.join(text_a[i:x])}|{','.join(text_b[j:y])}")
            i, j = x, y
        at = 0
        for n, valid in zip(counted[2].tolist(), map(bool, coded_a)):
            self.groups.append(";".join(shown[at : at + n]) if valid else None)
            at += n

    def _distinct(self, group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = max(self.a.size, self.b.size)
        key, n = np.unique(group * size + ids, return_counts=True)
        return key // size, key % size, n


class Block:
    """Documents of a block and their entries (document, pair, links)."""

    def __init__(self, pair_space: int):
        self.space, self.bytes, self.held = pair_space, 0, 0
        self.ids, self.stats, self.digests, self.keys, self.times, self.lost = [], [], [], [], [], set()

    def add(self, table: WordTable, places: np.ndarray, owners: np.ndarray) -> None:
        """Words at ``places`` of the table, each of the document in ``owners``."""
        words = len(table.groups)
        both, n = np.unique(owners * words + places, return_counts=True)
        owner, place = both // words, both % words
        wide = table.starts[place + 1] - table.starts[place]
        row = np.repeat(np.arange(len(place)), wide)
        entry = table.starts[place][row] + _spread(wide)
        self.keys.append(owner[row] * self.space + table.pairs[entry])
        self.times.append(table.links[entry] * n[row])
        self.held += len(entry)
        if self.held > ENTRIES:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        """Equal entries added up, in order."""
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, times = np.concatenate(self.keys), np.concatenate(self.times)
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        keys, times = keys[first], np.add.reduceat(times, first) if len(first) else times
        self.keys, self.times, self.held = [keys], [times], 0
        return keys, times

    def row(self, number: int, kind: pa.DataType) -> pa.RecordBatch:
        keys, times = self.merge()
        owner, pair = keys // self.space, keys % self.space
        pairs, at, documents = np.unique(pair, return_inverse=True, return_counts=True)
        stats = np.array(self.stats, np.int64).reshape(-1, 4)
        columns = {
            "block": pa.array([number], pa.int64()), "ids": pa.array([self.ids], pa.list_(kind)), **{n: pa.array([stats[:, k]], pa.list_(pa.int64())) for k, n in enumerate(STATS)},
            "digests": pa.array([self.digests], pa.list_(pa.string())), "sizes": pa.array([np.bincount(owner, minlength=len(self.ids))], pa.list_(pa.int64())),
            "places": pa.array([at.astype("<i4").tobytes()], pa.binary()), "times": pa.array([times.astype("<i8").tobytes()], pa.binary()),
            "pairs": pa.array([pairs], pa.list_(pa.int64())), "documents": pa.array([documents], pa.list_(pa.int64())),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


STATS = ("n_a", "n_b", "n_groups", "n_links")
#: A worker's tables, by files, for all tasks that it runs.
_TABLES: dict[tuple[str, str], WordTable] = {}


def _table(first: str, second: str) -> WordTable:
    return _TABLES.get((first, second)) or _TABLES.setdefault((first, second), WordTable(first, second))


def _read(table: WordTable, texts: list[str]) -> Iterator[tuple[list[int], list[list[str]]]]:
    """Documents' numbers and words, in portions of some megabytes; the words of a portion are in the table."""
    owners, portions, held = [], [], 0
    for k, text in enumerate(texts):
        for part in table.slices(text) if text else ():
            owners.append(k)
            portions.append(table.words(part))
            held += len(part)
            if held >= 2 * SLICE:
                table.learn(set().union(*portions))
                yield owners, portions
                owners, portions, held = [], [], 0
    if owners:
        table.learn(set().union(*portions))
        yield owners, portions


def _source(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    source = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return source, source.schema["key"].dataType.simpleString()


def groups(docs: DataFrame, first: str | None = None, second: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, groups): the groups of every document as ``a1,a2|b1;a3|b2,b3``, ids of both sides in order; null without tokens."""
    first, second = first or path_of("byte_bpe_50k.json"), second or path_of("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(first, second)
        for batch in by_bytes(batches, 1, 2 << 20):
            said: list[list | None] = [[] for _ in range(len(batch))]
            for owners, portions in _read(table, batch.column(1).to_pylist()):
                for k, words in zip(owners, portions):
                    own = [table.groups[table.index[w]] for w in words]
                    said[k] = None if said[k] is None or None in own else said[k] + own
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([";".join(s) if s else None for s in said], pa.string())], ["key", "groups"])

    source, kind = _source(docs, id_col, text_col)
    return source.mapInArrow(run, f"key {kind}, groups string").withColumnRenamed("key", id_col)


def blocks(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each block of documents, written in buckets by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, number = _table(first, second), TaskContext.get().partitionId() << 32
        space = table.a.size * table.b.size
        block, kind = Block(space), None
        for batch in by_bytes(batches, 1, 2 << 20):
            kind = batch.column(0).type
            texts, base = batch.column(1).to_pylist(), len(block.ids)
            block.ids += batch.column(0).to_pylist()
            stats, digests, lost = np.zeros((len(texts), 4), np.int64), [None] * len(texts), set()
            for owners, portions in _read(table, texts):
                placed = [np.fromiter(map(table.index.__getitem__, words), np.int64, len(words)) for words in portions]
                for k, at in zip(owners, placed):
                    said = [table.groups[i] for i in at.tolist()]
                    if k in lost or None in said:
                        lost.add(k)
                        continue
                    if digests[k] is None:
                        digests[k] = hashlib.sha256()
                    else:
                        digests[k].update(b";")
                    digests[k].update(";".join(said).encode())
                    stats[k] += table.stats[at].sum(axis=0)
                whole = [i for i, k in enumerate(owners) if k not in lost]
                if whole:
                    block.add(table, np.concatenate([placed[i] for i in whole]), np.concatenate([np.full(len(placed[i]), base + owners[i]) for i in whole]))
            for k in lost:
                stats[k], digests[k] = 0, None
            block.lost |= {base + k for k in lost}
            block.stats += stats.tolist()
            block.digests += [d.hexdigest() if d else "" for d in digests]
            block.bytes += batch.nbytes
            if block.bytes >= BLOCK_BYTES:
                yield _finished(block, number, kind)
                block, number = Block(space), number + 1
        if block.ids:
            yield _finished(block, number, kind)

    source, kind = _source(docs, id_col, text_col)
    schema = f"block bigint, ids array<{kind}>, {', '.join(f'{n} array<bigint>' for n in STATS)}, digests array<string>, sizes array<bigint>, places binary, times binary, pairs array<bigint>, documents array<bigint>"
    return laid_out(source.mapInArrow(run, schema), "block", "aligned")


def _finished(block: Block, number: int, kind: pa.DataType) -> pa.RecordBatch:
    """The block's row; a text of several slices that is not given back in a later one loses what the earlier ones entered."""
    if block.lost:
        keys, times = block.merge()
        keep = ~np.isin(keys // block.space, list(block.lost))
        block.keys, block.times = [keys[keep]], [times[keep]]
    return block.row(number, kind)


def _entries(aligned: DataFrame) -> DataFrame:
    each = aligned.select("block", F.posexplode(F.arrays_zip("pairs", "documents")).alias("at", "p"))
    return each.select("block", "at", F.col("p.pairs").alias("pair"), F.col("p.documents").alias("documents"))


def pair_counts(aligned: DataFrame, second_size: int) -> DataFrame:
    """(pair, documents, best): in how many documents a pair is linked, and whether no other pair of its first id is in more; first id = pair // second_size."""
    counts = _entries(aligned).groupBy("pair").agg(F.sum("documents").alias("documents"))
    own = F.floor(F.col("pair") / second_size).alias("a")
    most = counts.groupBy(own).agg(F.max("documents").alias("most"))  # one row for each id of the first vocabulary at most
    joined = counts.select("*", own).join(F.broadcast(most), "a")
    return joined.select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))


def align(docs: DataFrame, first: str | None = None, second: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    first, second = first or path_of("byte_bpe_50k.json"), second or path_of("piece_bpe_32k.model")
    aligned = blocks(docs, first, second, id_col, text_col)
    counts = pair_counts(aligned, PieceSide(second).size).withColumnRenamed("documents", "n")
    known = _entries(aligned).drop("documents").join(counts, "pair").select(F.col("block").alias("of"), "at", "n", "best")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        flat = {n: left.column(n).combine_chunks().flatten() for n in ("ids", *STATS, "digests", "sizes")}
        n, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        at = right.column("at").to_numpy()
        n[at], best[at] = right.column("n").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        places = np.frombuffer(left.column("places")[0].as_py(), "<i4")
        times = np.frombuffer(left.column("times")[0].as_py(), "<i8")
        ends = np.cumsum(flat["sizes"].to_numpy())

        def summed(values: np.ndarray) -> pa.Array:
            upto = np.concatenate(([0], np.cumsum(values)))
            return pa.array(np.diff(upto[np.concatenate(([0], ends))]), pa.int64())

        return pa.table([flat["ids"], *(flat[s] for s in STATS), summed(times * best[places]), summed(times * n[places]), flat["digests"]], ["key", *STATS, "n_best", "count_sum", "groups_sha256"])

    kind = aligned.schema["ids"].dataType.elementType.simpleString()
    schema = f"key {kind}, {', '.join(f'{n} bigint' for n in (*STATS, 'n_best', 'count_sum'))}, groups_sha256 string"
    return aligned.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(finish, schema).withColumnRenamed("key", id_col)


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
