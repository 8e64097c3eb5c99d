"""Folders of media files as Spark data sources.

    register(spark)
    spark.read.format("chronoweft_subtitles").load(folder)     # .srt, .vtt
    spark.read.format("chronoweft_recogniser").load(folder)    # .json, with channels or flat
    spark.read.format("chronoweft_turns").load(folder)         # .txt, "0.318 -- 6.865 speaker_00"
    spark.read.format("chronoweft_scripts").load(folder)       # .docx, .txt
    texts.write.format("chronoweft_subtitles").save(folder)    # rec_id, value: a file for each recording

The driver lists names and sizes only.  A task gets neighbouring files of about ``bytesPerTask`` bytes (64 MB unless
given) and reads one after the other; nothing is shuffled.  ``rec_id`` is a file's path below the folder without its
suffix.  Files of other suffixes, hidden files and those whose names begin with an underscore are passed over.
A file that cannot be read has no rows, or stops the job with ``mode`` set to failfast; bytes that are not UTF-8
become U+FFFD.  The path must lie in a file system that Arrow reaches; ``readers`` takes texts that Spark has read.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from chronoweft.sources.folders import filesystem
from chronoweft.sources.readers import docx

#: Rows of an Arrow batch.
ROWS = 8192
_CLOCK = r"(?:([0-9]+):)?([0-9]+):([0-9]+)(?:[,.]([0-9]+))?"
_TIMING = re.compile(rf"{_CLOCK}\s*-->\s*{_CLOCK}")
_MARKUP = re.compile(r"</?[a-z][^>]*>|<[0-9][0-9:.,]*>|\{\\[^}]*\}", re.IGNORECASE)
_TURN = re.compile(r"([0-9.]+)\s+--\s+([0-9.]+)\s+speaker_([0-9]+)")


# ---- what a file holds ---------------------------------------------------------------------


def _seconds(hours: str | None, minutes: str, seconds: str, fraction: str | None) -> float:
    return int(hours or 0) * 3600 + int(minutes) * 60 + int(seconds) + (int(fraction) / 10 ** len(fraction) if fraction else 0.0)


def subtitle_rows(text: str) -> Iterator[tuple]:
    """i, start, end, text of each cue with words.

    A timing line opens a cue, which lasts to the next one, to a blank line below words, or to a bare number right
    above the next timing line.
    """
    lines = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    times = [_TIMING.search(line) for line in lines]
    opened = [k for k, t in enumerate(times) if t]
    i = 0
    for k, until in zip(opened, [*opened, len(lines)][1:], strict=True):
        said: list[str] = []
        for j in range(k + 1, until):
            number = j + 1 == until < len(lines) and lines[j].strip().isdecimal() and lines[j].strip().isascii()
            if number or (said and not lines[j].strip()):
                break
            if lines[j].strip():
                said.append(lines[j])
        words = re.sub(r"[ \t]+\n", "\n", _MARKUP.sub("", "\n".join(said))).strip()
        if words:
            i += 1
            t = times[k].groups()
            yield i, _seconds(*t[:4]), _seconds(*t[4:]), words


def turn_rows(text: str) -> Iterator[tuple]:
    """start, end, speaker of each turn that lasts."""
    for m in _TURN.finditer(text):
        try:
            start, end = float(m[1]), float(m[2])
        except ValueError:
            continue
        if end > start:
            yield start, end, int(m[3])


def _number(value, unit: float) -> float | None:
    return float(value) / unit if isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value) else None


def recogniser_rows(text: str) -> Iterator[tuple]:
    """ord, text, start, end, conf, speaker of each word; times of the flat form are milliseconds."""
    doc = json.loads(text)
    flat = isinstance(doc, dict) and isinstance(doc.get("words"), list)
    words, unit = (doc["words"], 1000.0) if flat else ([], 1.0)
    if not flat:
        try:
            words = doc["results"]["channels"][0]["alternatives"][0]["words"] or []
        except (KeyError, IndexError, TypeError):
            words = []
    for k, w in enumerate(words):
        if not isinstance(w, dict):
            continue
        said = next((w[n] for n in ("punctuated_word", "word", "text") if isinstance(w.get(n), str)), "").strip()
        if said:
            speaker = w.get("speaker")
            yield k, said, _number(w.get("start"), unit) or 0.0, _number(w.get("end"), unit) or 0.0, _number(w.get("confidence"), 1.0), None if speaker is None else str(speaker)


def script_rows(raw: bytes, name: str) -> Iterator[tuple]:
    """text of a script."""
    text = docx(raw) if name.lower().endswith(".docx") else raw.decode("utf-8", "replace").removeprefix("﻿")
    if text is None:
        raise ValueError("not a .docx file")
    yield (text,)


# ---- the sources ---------------------------------------------------------------------------


@dataclass
class Files(InputPartition):
    """Files of one task: path and rec_id."""

    files: list[tuple[str, str]]


class _Reader(DataSourceReader):
    def __init__(self, source: _Source) -> None:
        self.path, self.schema_ddl, self.suffixes, self.rows = source.options["path"], source.columns, source.suffixes, source.rows
        self.most = int(source.options.get("bytespertask", 64 << 20))
        self.strict = source.options.get("mode", "permissive").lower() == "failfast"

    def partitions(self) -> list[InputPartition]:
        system, root = filesystem(self.path)
        top = system.get_file_info(root)
        if top.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        single = top.type == pafs.FileType.File
        found = [top] if single else system.get_file_info(pafs.FileSelector(root, recursive=True))
        base = len(root.rpartition("/")[0] if single else root.rstrip("/")) + 1
        tasks: list[Files] = []
        room = 0
        for info in sorted(found, key=lambda f: f.path):
            below = info.path[base:]
            if info.type != pafs.FileType.File or any(p.startswith((".", "_")) for p in below.split("/")) or not below.lower().endswith(self.suffixes):
                continue
            # opening a file counts as some bytes too
            cost = info.size + (256 << 10)
            if not tasks or room < cost:
                tasks.append(Files([]))
                room = self.most
            tasks[-1].files.append((info.path, unquote(below.rpartition(".")[0])))
            room -= cost
        return tasks or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = filesystem(self.path)
        names = [c.strip().split(" ")[0] for c in self.schema_ddl.split(",")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[c.strip().split(" ")[1]] for c in self.schema_ddl.split(",")]
        held: list[tuple] = []
        for path, rec in partition.files:
            try:
                with system.open_input_stream(path) as f:
                    raw = f.read()
                # whole files, so that one that breaks off gives nothing
                mine = list(self.rows(raw, path))
            except Exception:
                if self.strict:
                    raise
                continue
            held += [(rec, *row) for row in mine]
            while len(held) >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held[:ROWS], strict=True), kinds, strict=True)], names=names)
                held = held[ROWS:]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


class _Source(DataSource):
    """A folder whose files have the given suffixes; ``rows`` gives a file's rows without rec_id."""

    kind, columns, suffixes = "", "", ()

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return self.columns

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self)

    @staticmethod
    def rows(raw: bytes, name: str) -> Iterator[tuple]:
        raise NotImplementedError


class _TextWriter(DataSourceArrowWriter):
    """A file for each row: written under another name first, so that a reader or a task that runs again never meets a part of it."""

    def __init__(self, path: str, suffix: str) -> None:
        self.path, self.suffix = path, suffix

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = filesystem(self.path)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for rec, text in zip(batch.column("rec_id").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if rec is None:
                    raise ValueError("a text without rec_id has no file name")
                name = quote(str(rec), safe="")
                name = "%" + format(ord(name[0]), "02X") + name[1:] if name[:1] in ("_", ".") else name
                hidden = f"{root}/.{uuid.uuid4().hex}"
                with system.open_output_stream(hidden) as f:
                    f.write((text or "").encode())
                system.move(hidden, f"{root}/{name}{self.suffix}")
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        system, root = filesystem(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list) -> None:
        """Files that were written whole stay; the folder has no _SUCCESS."""


class _Written(_Source):
    def schema(self) -> str:
        return self.columns

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if {"rec_id", "value"} - set(schema.names):
            raise ValueError("columns rec_id and value are needed")
        system, root = filesystem(self.options["path"])
        if system.get_file_info(root).type == pafs.FileType.Directory and overwrite:
            system.delete_dir_contents(root)
        return _TextWriter(self.options["path"], self.options.get("suffix", self.suffixes[0]))


class Subtitles(_Written):
    kind, columns, suffixes = "chronoweft_subtitles", "rec_id string, i long, start double, end double, text string", (".srt", ".vtt")

    @staticmethod
    def rows(raw: bytes, name: str) -> Iterator[tuple]:
        return subtitle_rows(raw.decode("utf-8", "replace"))


class Recogniser(_Written):
    kind, columns, suffixes = "chronoweft_recogniser", "rec_id string, ord long, text string, start double, end double, conf double, speaker string", (".json",)

    @staticmethod
    def rows(raw: bytes, name: str) -> Iterator[tuple]:
        return recogniser_rows(raw.decode("utf-8-sig", "replace"))


class Turns(_Written):
    kind, columns, suffixes = "chronoweft_turns", "rec_id string, start double, end double, speaker long", (".txt",)

    @staticmethod
    def rows(raw: bytes, name: str) -> Iterator[tuple]:
        return turn_rows(raw.decode("utf-8", "replace"))


class Scripts(_Source):
    kind, columns, suffixes = "chronoweft_scripts", "rec_id string, text string", (".docx", ".txt")

    @staticmethod
    def rows(raw: bytes, name: str) -> Iterator[tuple]:
        return script_rows(raw, name)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    for source in (Subtitles, Recogniser, Turns, Scripts):
        spark.dataSource.register(source)
