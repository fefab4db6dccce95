"""SentencePiece encoding and decoding through a table of distinct marked words.

The model's normaliser writes every space as the marker U+2581 and puts one marker before the text.
Where no piece has a marker after another character, no merge crosses the start of a run of markers, so
a text is the concatenation of *marked words* (a run of markers and what follows up to the next run),
each of which has the same ids wherever it stands. Each worker segments a distinct marked word once,
with the library, and joins the ids back by position; decoding goes through the same table.

Defined cases: a null or empty text has the ids [begin, end] (or none) and decodes to ''; texts of any
length are whole; equal rows give equal results; an empty table gives an empty table; other columns of
the input, whatever their names, are not read.
"""

from __future__ import annotations

import gc
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docproof.llm.common import by_bytes, path_of

MARK = "▁"
_WORD = re.compile(" +[^ ]*")
#: A worker's table is emptied beyond so many words, which bounds its memory; words seen again are segmented anew.
TABLE_WORDS = 300_000


class WordTable:
    """Ids (little-endian unsigned 32-bit) and decoded text of each distinct marked word that a worker has seen."""

    def __init__(self, model: str, most: int = TABLE_WORDS):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = (self.library.id_to_piece(i) for i in range(self.library.get_piece_size()))
        #: Otherwise texts are segmented whole.
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) and self._plain()
        self.marker = self.library.piece_to_id(MARK)
        self.most, self.ids, self.texts = most, {}, {}

    def _plain(self) -> bool:
        """Whether the normaliser only marks spaces and adds one marker: no other rewriting crosses words."""
        probe = " a  b▁c\n\tééﬁ　 "
        return self.library.decode(self.library.encode(probe)) == probe.replace(MARK, " ")

    def learn(self, words: set[str]) -> None:
        """Segment the words that the table lacks, each once."""
        new = [w for w in words if w not in self.ids]
        if len(self.ids) + len(new) > self.most:
            self.ids.clear()
            self.texts.clear()
            new = list(words)
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            #: The library adds the first marker, but none to an empty text; decoding strips that marker again.
            found = [ids or [self.marker] for ids in self.library.encode(part, num_threads=1)]
            self.ids.update(zip(part, (array("I", ids).tobytes() for ids in found)))
            self.texts.update(zip(part, (f" {t}" for t in self.library.decode(found, num_threads=1))))

    @staticmethod
    def words(text: str) -> list[str]:
        """Marked words, each written without its first marker: 'a' stands behind one marker and ' a' behind two."""
        text = text.replace(MARK, " ")
        if "  " not in text and not text.startswith(" "):
            return text.split(" ")
        return [w[1:] for w in _WORD.findall(" " + text)]

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids as bytes and the decoded text, for each text of a batch."""
        if not self.splits:
            found = [self.library.encode(t) for t in texts]
            return [(array("I", i).tobytes(), self.library.decode(i)) for i in found]
        marked = [self.words(t) if t else [] for t in texts]
        self.learn(set().union(*marked))
        ids, back = self.ids.__getitem__, self.texts.__getitem__
        return [(b"".join(map(ids, words)), "".join(map(back, words))[1:]) for words in marked]


#: A worker's tables, by model, for all tasks that it runs.
_TABLES: dict[str, WordTable] = {}


def encode(
    df: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", begin: bool = True, end: bool = True
) -> DataFrame:
    """Per row: id_col, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded (string)."""
    model = model or path_of("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the tables hold many small objects and no cycles
        table = _TABLES.get(model) or _TABLES.setdefault(model, WordTable(model))
        first = table.library.bos_id().to_bytes(4, "little") if begin else b""
        last = table.library.eos_id().to_bytes(4, "little") if end else b""
        for batch in by_bytes(batches, 1, 4 << 20):
            done = table.encode([t or "" for t in batch.column(1).to_pylist()])
            ids = [first + i + last for i, _ in done]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([t for _, t in done], pa.string())],
                ["key", "n_tokens", "ids", "decoded"],
            )

    source = df.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, n_tokens bigint, ids binary, decoded string").withColumnRenamed("key", id_col)


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    done = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
