"""Token counts by a finite-state transducer compiled from a SentencePiece BPE model.

A text is read one character at a time by a deterministic transducer whose transitions carry the change
in the number of emitted tokens (a merge may lower it). The segmentation of a prefix is fixed by its last
piece: piece t is last at position i if the piece p that is last at i - len(t) and t stay apart when p + t
is segmented alone. A state is therefore the longest suffix read that begins some piece, with the last
pieces and relative counts at the positions inside it; transitions are compiled when first used.

A text of over ``CHUNK`` characters is cut into chunks, which are rows of their own and spread over the cluster.
The state map of a chunk is a head (the characters before its first run of markers), which leads one start
state to one end state with a count, and behind it a known count and the state of its open last word, since at
a run of markers every start state leads to the same state. The start state of a head is that after the
``LEAD`` characters before the chunk. Such maps compose associatively, by a prefix scan over the chunks of a
text; where the state that arrives is another than the map's, the head is read again from it, so counts are
exact in any case.

Defined cases: null or empty texts have no tokens; whole texts of any length; equal rows give equal
counts; an empty table stays empty; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import gc
import pickle
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docproof.llm.common import by_bytes, path_of

MARK = "▁"
_RUN = re.compile(" +[^ ]*")
#: Characters in a chunk, states and words that a task keeps; tables are emptied beyond, results stay the same.
CHUNK, STATES, WORDS = 1 << 16, 150_000, 300_000
#: Characters before a chunk that its start state is read from.
LEAD = 64


class Transducer:
    """Compiled for one model; a state is a number, ``step[state][character]`` is (state, change of the count)."""

    def __init__(self, model: str, states: int = STATES):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model)
        normal = [i for i in range(library.get_piece_size()) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))]
        self.score = {library.id_to_piece(i): library.get_score(i) for i in normal}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.score):
            raise ValueError("pieces of this model cross whitespace markers")
        self.beginnings = {p[:k] for p in self.score for k in range(1, len(p) + 1)}
        #: Pieces of markers alone may tie, so a run is cut as the library does, from the left.
        self.runs = {len(p) for p in self.score if set(p) == {MARK}}
        self.most = states
        self._split: dict[str, tuple[str, str] | None] = {}
        self._apart: dict[tuple[str, str], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.number: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.step: list[dict[str, tuple[int, int]]] = []

    def segment(self, text: str) -> list[str]:
        """BPE of a short string by its definition: merge the best pair, the leftmost of equals, until none is left."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((-self.score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The last merge of a piece that segments to itself; None if it doesn't or is a single character."""
        if piece not in self._split:
            parts = list(piece)
            while len(parts) > 2:
                best = min(((-self.score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score), default=None)
                if best is None:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            self._split[piece] = (parts[0], parts[1]) if len(parts) == 2 and len(piece) > 1 else None
        return self._split[piece]

    def _is_whole(self, piece: str) -> bool:
        return len(piece) == 1 or self._halves(piece) is not None

    def _stay_apart(self, left: str, right: str) -> bool:
        """Whether no merge joins the two pieces: undo their merges from the latest, looking for a pair across the cut that was better."""
        key = (left, right)
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) > 4 * self.most:
                self._apart.clear()
            known = self._apart[key] = self._apart_by_merges(left, right)
        return known

    def _apart_by_merges(self, left: str, right: str) -> bool:
        score, late = self.score, float("inf")  # the pair across the cut exists until a merge of order ``late``
        order = lambda p: -score[p] if len(p) > 1 else -1.0
        after = False  # of two merges of one order the left comes first
        while True:
            joined = left + right
            if joined in score and (order(joined) < late or (order(joined) == late and after)):
                return False
            a, b = order(left), order(right)
            if a < 0 and b < 0:
                return True
            if a > b:
                late, after, left = a, False, self._halves(left)[1]
            else:
                late, after, right = b, True, self._halves(right)[0]

    def weight(self, char: str) -> int:
        """Tokens of a single character: one, or its bytes where it is no piece."""
        return 1 if char in self.score else len(char.encode())

    def run_tokens(self, n: int) -> int:
        """Tokens of n markers in a row, grown from the left piece by piece."""
        if n <= 0:
            return 0
        sizes: list[int] = []
        for _ in range(n):
            sizes.append(1)
            while len(sizes) > 1 and sizes[-2] + sizes[-1] in self.runs:
                sizes[-2:] = [sum(sizes[-2:])]
        return len(sizes)

    def state(self, key: tuple) -> int:
        if key not in self.number:
            self.number[key] = len(self.keys)
            self.keys.append(key)
            self.step.append({})
        return self.number[key]

    def start(self) -> int:
        """After one marker: the position before it (nothing read) and the one behind it."""
        return self.state((MARK, (("", -1), (MARK, 0))))

    def compile(self, state: int, char: str) -> tuple[int, int]:
        """The transition for ``char``: history holds, per position in the suffix, the last piece and the count relative to now."""
        suffix, history = self.keys[state]
        read = suffix + char
        found = None
        for size in range(1, min(len(read), len(history)) + 1):
            piece = read[-size:]
            if size > 1 and (piece not in self.score or not self._is_whole(piece)):
                continue
            if history[-size] is None:
                continue
            last, count = history[-size]
            if last == "" and size < len(read):
                continue
            if last == "" or self._stay_apart(last, piece):
                found = (piece, count + (self.weight(piece) if size == 1 else 1))
                break
        if found is None:
            raise AssertionError(f"no segmentation of {read!r}")
        piece, change = found
        while read and read not in self.beginnings:
            read = read[1:]
        size, beginnings = len(read), self.beginnings
        past = [(history[k - size][0], history[k - size][1] - change) if read[k:] in beginnings else None for k in range(size)] if size else []
        target = self.state((read, (*past, (piece, 0))))
        self.step[state][char] = (target, change)
        return target, change

    def feed(self, state: int, text: str) -> tuple[int, int]:
        """End state and number of tokens added."""
        step, total = self.step, 0
        for char in text:
            move = step[state].get(char)
            state, change = move if move is not None else self.compile(state, char)
            total += change
        return state, total


class Lanes:
    """The transducer's transitions for frequent characters as one table, so that many words take a step at once."""

    #: Columns: printable ASCII, then the lower-case letters of Latin-1; words with other characters go one by one.
    FAST = [*range(0x20, 0x7F), 0x09, 0x0A, *range(0xDF, 0xFE)]

    def __init__(self, machine: Transducer):
        self.machine = machine
        self.column = np.full(0x110000, 255, np.uint8)
        self.column[self.FAST] = np.arange(len(self.FAST), dtype=np.uint8)
        self.reset()

    def reset(self) -> None:
        #: (target + 1) * 64 + change + 32; 0: not compiled yet.
        self.table = np.zeros((4096, 128), np.int32)

    def feed(self, words: list[str]) -> list[int]:
        """Tokens of marker + word for each word."""
        if len(self.machine.keys) > self.machine.most:
            self.machine._reset()
            self.reset()
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = self.column[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        order = np.argsort(-sizes, kind="stable")
        begin = (np.cumsum(sizes) - sizes)[order]
        rare = np.zeros(len(words), bool)
        if len(codes):
            rare[np.searchsorted(np.cumsum(sizes), np.flatnonzero(codes == 255), side="right")] = True
        order_rare = rare[order]
        keep = ~order_rare
        begin, left = begin[keep], sizes[order][keep]
        state = np.full(len(left), self.machine.start(), np.int64)
        total = np.ones(len(left), np.int64)
        for at in range(int(left[0]) if len(left) else 0):
            m = int(np.searchsorted(-left, -at, side="left"))  # lanes are in order of falling length
            char = codes[begin[:m] + at]
            move = self.moves(state[:m], char)
            state[:m] = (move >> 6) - 1
            total[:m] += (move & 63) - 32
        out = np.zeros(len(words), np.int64)
        out[order[keep]] = total
        for i in np.flatnonzero(rare).tolist():
            out[i] = 1 + self.machine.feed(self.machine.start(), words[i])[1]
        return out.tolist()

    def moves(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        self.grow()
        move = self.table[state, char]
        lacking = np.flatnonzero(move == 0)
        if len(lacking):
            for pair in np.unique(state[lacking] * 256 + char[lacking]).tolist():
                s, c = divmod(pair, 256)
                known = self.machine.step[s].get(chr(self.FAST[c])) or self.machine.compile(s, chr(self.FAST[c]))
                self.table[s, c] = (known[0] + 1) * 64 + known[1] + 32
            self.grow()
            move = self.table[state, char]
        return move

    def grow(self) -> None:
        while len(self.table) < len(self.machine.keys):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])


class Counter:
    """Counts of whole texts; words met before are known maps from the state at a marker to a count.

    A word is written without its first marker, so 'a' stands behind one marker and ' a' behind two.
    """

    def __init__(self, model: str, chunk: int = CHUNK, words: int = WORDS, states: int = STATES):
        self.machine = Transducer(model, states)
        self.lanes = Lanes(self.machine)
        self.chunk, self.most, self.known = chunk, words, {}

    def learn(self, words: set[str]) -> None:
        known = self.known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > self.most:
            known.clear()
            new = list(words)
        plain = [w for w in new if w and w[0] != " "]
        known.update(zip(plain, self.lanes.feed(plain)))
        for w in new:
            if not w or w[0] == " ":
                known[w] = self.after_run(w)

    def after_run(self, word: str) -> int:
        """Tokens of a word behind two markers or more, or of markers alone."""
        body = word.lstrip(" ")
        markers = len(word) - len(body) + 1
        if not body:
            return self.machine.run_tokens(markers)
        total = 1 + self.machine.feed(self.machine.start(), body)[1]
        if first_piece(self.machine, MARK + body) == MARK:  # the last marker stays single and joins the run
            return total - 1 + self.machine.run_tokens(markers)
        return total + self.machine.run_tokens(markers - 1)

    def cut(self, text: str) -> list[tuple[str, str]]:
        """Chunks of a text, each with the characters before it; none ends inside a run of markers."""
        out, at = [], 0
        while at < len(text):
            end = min(len(text), at + self.chunk)
            while end < len(text) and text[end] == " ":
                end += 1
            out.append((text[max(0, at - LEAD) : at], text[at:end]))
            at = end
        return out

    @staticmethod
    def words(chunk: str) -> tuple[str, list[str]]:
        """(head before the first run of markers, words behind)."""
        if chunk.startswith(" ") and "  " not in chunk:
            return "", chunk[1:].split(" ")
        found = _RUN.findall(chunk)
        return chunk[: len(chunk) - sum(map(len, found))], [w[1:] for w in found]

    def read(self, key: tuple, text: str) -> tuple[tuple, int]:
        """Key of the state after ``text``, and the tokens added."""
        state, n = self.machine.feed(self.machine.state(key), text)
        return self.machine.keys[state], n

    def chunk_map(self, lead: str, chunk: str) -> tuple:
        """((head, start, end, tokens), None or (tokens behind it, last word)); the open last word is (state, tokens, None), or its text where it begins with a marker."""
        begin = self.machine.keys[self.machine.start()]
        head, words = self.words(chunk)
        start = self.read(begin, lead.rsplit(" ", 1)[-1])[0] if head else begin
        first = (head, start, *self.read(start, head))
        if not words:
            return first, None
        self.learn(set(words[:-1]))
        known, last = sum(map(self.known.__getitem__, words[:-1])), words[-1]
        if last[:1] == " ":
            return first, (known, (None, 0, last))
        state, n = self.read(begin, last)
        return first, (known, (state, 1 + n, None))

    def along(self, state: tuple, head: tuple) -> tuple[tuple, int]:
        """State and tokens after a head that is entered in ``state``."""
        return head[2:] if head[1] == state else self.read(state, head[0])

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two neighbouring chunks; associative."""
        (head, start, end, n), behind = a
        if behind is None:
            to, more = self.along(end, b[0])
            return (head + b[0][0], start, to, n + more), b[1]
        tokens, (state, m, text) = behind
        if text is None:
            to, more = self.along(state, b[0])
            last = (to, m + more, None)
        else:
            last = (None, 0, text + b[0][0])
        if b[1] is None:
            return a[0], (tokens, last)
        return a[0], (tokens + self.closed(last) + b[1][0], b[1][1])

    def closed(self, last: tuple) -> int:
        """Tokens of a last word that is over."""
        if last[2] is None:
            return last[1]
        self.learn({last[2]})
        return self.known[last[2]]

    def total(self, maps: list[tuple]) -> int:
        """Tokens of a text from the maps of its chunks: neighbours compose, level by level, until one is left."""
        while len(maps) > 1:
            maps = [self.compose(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        tokens, last = maps[0][1]
        return tokens + self.closed(last)

    def chunks(self, text: str) -> list[tuple[str, str]]:
        """Chunks of a text as the model reads it."""
        return self.cut(" " + text.replace(MARK, " ")) if text else []

    def count(self, texts: list[str]) -> list[int]:
        parts = [self.chunks(t) for t in texts]
        short = [self.words(c[0][1])[1] if len(c) == 1 else [] for c in parts]
        self.learn({w for words in short for w in words})
        counts = [sum(map(self.known.__getitem__, words)) for words in short]
        return [self.total([self.chunk_map(*c) for c in own]) if len(own) > 1 else n for own, n in zip(parts, counts)]


@cache
def counter_of(model: str, chunk: int) -> Counter:
    """A worker's tables, for all tasks that it runs."""
    return Counter(model, chunk)


def first_piece(machine: Transducer, text: str) -> str:
    """First piece of a segmentation, from the last pieces at each position, read backwards."""
    history, counts = ["", MARK], None
    suffix, state = MARK, machine.start()
    for char in text[1:]:
        move = machine.step[state].get(char)
        state = (move or machine.compile(state, char))[0]
        history.append(machine.keys[state][1][-1][0])
    at = len(history) - 1
    while at > len(history[at]):
        at -= len(history[at])
    return history[at]


def count_tokens(df: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, chunk: int = CHUNK) -> DataFrame:
    """Per row: id_col, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    model = model or path_of("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the tables hold many small objects and no cycles
        counter = counter_of(model, CHUNK)
        for batch in by_bytes(batches, 2, 4 << 20):
            counts = counter.count([t or "" for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["key", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = df.select(F.col(id_col).alias("key"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    counted = source.where(F.length("text") < chunk).mapInArrow(run, f"key {kind}, n_bytes bigint, n_tokens bigint")
    counted = counted.unionByName(_long_texts(source.where(F.length("text") >= chunk), kind, model, chunk))
    return counted.select(F.col("key").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _long_texts(source: DataFrame, kind: str, model: str, chunk: int) -> DataFrame:
    """(key, n_bytes, n_tokens) of long texts: chunks are rows, each task maps its own, and the maps of a text compose."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(model, chunk)
        for batch in by_bytes(batches, 2, 4 << 20):
            parts = [counter.chunks(t) for t in batch.column(2).to_pylist()]
            take = pa.array([i for i, own in enumerate(parts) for _ in own], pa.int64())
            number = pa.array([k for own in parts for k in range(len(own))], pa.int32())
            texts = [pa.array([c[k] for own in parts for c in own], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in (0, 1, 3)), number, *texts], ["key", "n_bytes", "row", "number", "lead", "chunk"])

    def map_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(model, chunk)
        for batch in by_bytes(batches, 5, 4 << 20):
            maps = [pickle.dumps(counter.chunk_map(*c)) for c in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(maps, pa.binary())], ["key", "n_bytes", "row", "number", "map"])

    def scan(table: pa.Table) -> pa.Table:
        maps = table.sort_by("number").column("map").to_pylist()
        total = counter_of(model, chunk).total([pickle.loads(m) for m in maps])
        return table.slice(0, 1).select(["key", "n_bytes"]).append_column("n_tokens", pa.array([total], pa.int64()))

    rows = source.withColumn("row", F.monotonically_increasing_id())
    parts = rows.mapInArrow(cut, f"key {kind}, n_bytes bigint, row bigint, number int, lead string, chunk string")
    maps = parts.repartition("row", "number").mapInArrow(map_, f"key {kind}, n_bytes bigint, row bigint, number int, map binary")
    return maps.groupBy("row").applyInArrow(scan, f"key {kind}, n_bytes bigint, n_tokens bigint")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
