"""Reading services: what turns images into words, how failures are told, and images as a source of words.

A service is any object with ``extract``; one that also has ``extract_region`` can read parts of an image again. It is
sent to the executors, and each image is read where its bytes are. A failure is one of three codes and concerns its
image alone: ``timeout``, ``unavailable`` (the service does not start) or ``processing``. Messages of services are
dropped, for they may hold what stands on a label.
"""

from __future__ import annotations

import importlib
import posixpath
import threading
import time
from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple, Protocol, runtime_checkable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docproof.operators.refinement import Reading
from docproof.plans.stages import cut
from docproof.sources.records import MEDIA_TYPES

WORD = "page int, block int, paragraph int, line int, left int, top int, width int, height int, confidence double, text string"
READ = f"words array<struct<ordinal:int,{','.join(':'.join(c.split()) for c in WORD.split(','))}>>, image_width int, image_height int, text string, duration_ms double, error string"
#: Fixed value: seconds that a service has for an image or a region.
SECONDS = 5.0


class Unavailable(RuntimeError):
    """The service cannot be started."""


class Unreadable(RuntimeError):
    """The service runs but cannot read this image."""


class Word(NamedTuple):
    page: int | None
    block: int | None
    paragraph: int | None
    line: int | None
    left: int | None
    top: int | None
    width: int | None
    height: int | None
    confidence: float | None
    text: str


class Page(NamedTuple):
    words: list[Word]
    width: int
    height: int


class Service(Protocol):
    def extract(self, image: bytes, media_type: str | None) -> Page: ...


@runtime_checkable
class RegionalService(Protocol):
    def extract_region(self, image: bytes, media_type: str | None, box: tuple[int, int, int, int], mode: int) -> Page:
        """The words of a region; mode is 6 for a block of lines and 7 for one line."""
        ...


class PlainPages:
    """Reads plain text in UTF-8 as a page of fixed pitch: a letter is 10 wide, a row 20 high; a region says the words whose centres lie in it."""

    LETTER, ROW = 10, 20

    def extract(self, image: bytes, media_type: str | None) -> Page:
        try:
            rows = image.decode().split("\n")
        except UnicodeDecodeError as e:
            raise Unreadable from e
        words = []
        for k, row in enumerate(rows):
            at = 0
            for w in row.split(" "):
                if w:
                    words.append(Word(1, 1, 1, k, at * self.LETTER, k * self.ROW, len(w) * self.LETTER, self.ROW, 1.0, w))
                at += len(w) + 1
        return Page(words, self.LETTER * max(map(len, rows)), self.ROW * len(rows))

    def extract_region(self, image: bytes, media_type: str | None, box: tuple[int, int, int, int], mode: int) -> Page:
        left, top, width, height = box
        held = [w for w in self.extract(image, media_type).words if left <= w.left + w.width / 2 <= left + width and top <= w.top + w.height / 2 <= top + height]
        return Page([w._replace(left=w.left - left, top=w.top - top) for w in held], width, height)


def _asked(call: Callable[[], Page], seconds: float) -> dict:
    """A row of ``READ``. A call that takes too long is given up; its thread ends with the worker at the latest."""
    said: list[tuple[Page | None, str | None]] = []

    def run():
        try:
            said.append((call(), None))
        except TimeoutError:
            said.append((None, "timeout"))
        except Unavailable:
            said.append((None, "unavailable"))
        except Exception:
            said.append((None, "processing"))

    start = time.perf_counter()
    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    page, error = said[0] if said else (None, "timeout")
    row = dict.fromkeys(("words", "image_width", "image_height", "text")) | {"duration_ms": (time.perf_counter() - start) * 1000, "error": error}
    if page is None:
        return row
    lines: dict[tuple, list[str]] = {}
    for w in page.words:
        lines.setdefault(tuple(w[:4]) if any(x is not None for x in w[:4]) else (len(lines), w), []).append(w.text)
    return row | {"words": [{"ordinal": k, **Word(*w)._asdict()} for k, w in enumerate(page.words)], "image_width": page.width, "image_height": page.height, "text": "\n".join(map(" ".join, lines.values()))}


def _whole(service: Service, seconds: float, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [{"doc_id": r["doc_id"], **_asked(partial(_extract, service, r), seconds)} for r in batch.to_pylist()]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _extract(service: Service, row: dict) -> Page:
    if row["content"] is None:
        raise Unreadable
    return service.extract(row["content"], row["media_type"])


def _regions(service: RegionalService, seconds: float, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [{"doc_id": r["doc_id"], "field": p["field"], **_asked(partial(_extract_region, service, r, p), seconds)} for r in batch.to_pylist() for p in r["regions"]]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _extract_region(service: RegionalService, row: dict, region: dict) -> Page:
    if row["content"] is None:
        raise Unreadable
    return service.extract_region(row["content"], row["media_type"], (region["left"], region["top"], region["width"], region["height"]), region["mode"])


def _reading(rows: DataFrame, *keys: str) -> Reading:
    word = F.explode("words").alias("w")
    return Reading(rows.select(*keys, "text", "duration_ms", "error"), rows.select(*keys, word, "image_width", "image_height").select(*keys, "w.*", "image_width", "image_height"))


def read(images: DataFrame, service: Service, seconds: float = SECONDS) -> Reading:
    """What a service reads on images(doc_id, content, media_type): outcomes of all, words of those without an error.

    The rows are written once, so a service is asked once for an image; a lost executor's images are read again. A null
    image is a processing error; one without words has an empty text; images of equal ids are read each.
    """
    schema = StructType([images.schema["doc_id"], *StructType.fromDDL(READ)])
    run = partial(_whole, service, seconds, to_arrow_schema(schema))
    return _reading(cut(images.select("doc_id", "content", "media_type").mapInArrow(run, schema)), "doc_id")


def region_reader(images: DataFrame, service: Service, seconds: float = SECONDS) -> Callable[[DataFrame], Reading] | None:
    """What ``refinement.refine`` takes as its reader; None for a service that cannot read regions.

    The regions of an image, three at most, are put together first, so each image moves once. A plan whose image is not
    there is a processing error.
    """
    if not isinstance(service, RegionalService):
        return None

    def reader(planned: DataFrame) -> Reading:
        region = F.struct("field", *(F.col(c).cast("int").alias(c) for c in ("left", "top", "width", "height", "mode")))
        asked = planned.groupBy("doc_id").agg(F.collect_list(region).alias("regions"))
        schema = StructType([images.schema["doc_id"], planned.schema["field"], *StructType.fromDDL(READ)])
        run = partial(_regions, service, seconds, to_arrow_schema(schema))
        rows = cut(images.select("doc_id", "content", "media_type").join(asked, "doc_id").mapInArrow(run, schema))
        own = _reading(rows, "doc_id", "field")
        absent = planned.select("doc_id", "field").join(rows.select("doc_id", "field"), ["doc_id", "field"], "left_anti")
        none = absent.select("doc_id", "field", F.lit(None).cast("string").alias("text"), F.lit(0.0).alias("duration_ms"), F.lit("processing").alias("error"))
        return Reading(own.outcomes.unionByName(none), own.words)

    return reader


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class LabelWords(DataSource):
    """``spark.read.format("label_words").option("path", folder).option("service", "module:Class").load()``: a row of ``READ`` for each image of a folder.

    Options: seconds, files_per_task (16), suffixes (comma-joined, by default those of images). The driver lists names
    alone; files are opened in tasks. Conditions on the path (=, in) choose files before any is read. It is for folders
    of images; tables of bytes go through ``read``.
    """

    @classmethod
    def name(cls) -> str:
        return "label_words"

    def schema(self) -> str:
        return f"path string, {READ}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _LabelWordsReader(dict(self.options))


def named(service: str) -> Service:
    """An instance of what stands at module:name."""
    module, _, name = service.partition(":")
    return getattr(importlib.import_module(module), name)()


class _LabelWordsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.service = options["path"], options.get("service", "docproof.sources.reading:PlainPages")
        self.seconds, self.per_task = float(options.get("seconds", SECONDS)), int(options.get("files_per_task", "16"))
        self.suffixes = tuple(options.get("suffixes", ",".join(MEDIA_TYPES)).split(","))
        self.only: set[str] | None = None

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("path",):
                chosen = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = chosen if self.only is None else self.only & chosen
            else:
                yield f

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder.removeprefix("file:"))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, folder = self._system()
        found = system.get_file_info(fs.FileSelector(folder, recursive=True))
        paths = sorted(f.path for f in found if f.is_file and posixpath.splitext(f.path)[1][1:].lower() in self.suffixes)
        kept = [p for p in paths if self.only is None or p in self.only]
        return [_Files(kept[k : k + self.per_task]) for k in range(0, len(kept), self.per_task)] or [_Files([])]

    def read(self, partition: _Files):
        service, (system, _) = named(self.service), self._system()
        for path in partition.paths:
            with system.open_input_stream(path) as file:
                image = file.read()
            row = _asked(partial(service.extract, image, MEDIA_TYPES.get(posixpath.splitext(path)[1][1:].lower())), self.seconds)
            words = None if row["words"] is None else [tuple(w.values()) for w in row["words"]]
            yield path, words, row["image_width"], row["image_height"], row["text"], row["duration_ms"], row["error"]


def register(spark: SparkSession) -> None:
    """Makes the format label_words known to a session, which then hands conditions down to sources written in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(LabelWords)
