"""The notations as Spark data sources: spark.read.format("provenance") and df.write.format("provenance").

Reading gives the flat rows of statements.FLAT (or, for rdf, quads in plain columns), which
records() turns into records; writing takes (doc_id, text) and makes a file of each document.
Files are reached through pyarrow's file systems, so a path is a folder or file of a local
disk, hdfs, s3 or gs; files of a folder are dealt over tasks.

Options: notation (json, xml, jsonld, rdf, or any, the default, for the first that fits; a
writer's gives the suffix), partitions (tasks of a read, 16 by default).
"""

from __future__ import annotations

import uuid
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators import triples
from . import statements
from .parse_turtle import terms
from .read import _FLAT_QUADS, _PARTS, PARSERS, UnknownFormat, _any

NAME = "provenance"


def _files(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class ProvenanceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _notation(self) -> str:
        name = self.options.get("notation", "any").lower()
        if name not in ("any", "rdf", *PARSERS):
            raise UnknownFormat(name)
        return name

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in _FLAT_QUADS) if self._notation() == "rdf" else statements.FLAT

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._notation(), int(self.options.get("partitions", "16")))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("notation", "json").lower(), schema.names, overwrite)


class _Reader(DataSourceReader):
    def __init__(self, path: str, notation: str, parts: int):
        self.path, self.notation, self.parts = path, notation, parts

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, inner = _files(self.path)
        if system.get_file_info(inner).type == fs.FileType.File:
            return [Files([inner])]
        found = system.get_file_info(fs.FileSelector(inner, recursive=True))
        paths = sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")
        return [Files(paths[i :: self.parts]) for i in range(min(self.parts, len(paths)))] or [Files([])]

    def read(self, partition: Files):
        system, _ = _files(self.path)
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                text = f.read().decode()
            doc = unquote(path.rsplit("/", 1)[-1].rsplit(".", 1)[0])
            if self.notation == "rdf":
                for r in terms(text):
                    yield (doc, r["graph"], *(r["s"][x] for x in _PARTS), r["p"], *(r["o"][x] for x in _PARTS))
                continue
            try:
                rows = list((PARSERS[self.notation] if self.notation in PARSERS else _any)(text))
            except Exception as error:  # a text that can't be read is told in its row
                rows = [{"what": "error", "lex": f"{type(error).__name__}: {error}"}]
            for r in rows:
                yield (doc, r.get("scope") or "", *(r.get(c) for c in statements._FIELDS[2:]))


class _Writer(DataSourceWriter):
    """A document is written beside its place and moved there, so a task that runs again does no harm."""

    def __init__(self, path: str, suffix: str, names: list[str], overwrite: bool):
        if not {"doc_id", "text"} <= set(names):
            raise ValueError("documents to write have doc_id and text")
        self.path, self.suffix = path, suffix
        system, inner = _files(path)
        system.create_dir(inner, recursive=True)
        if overwrite:
            system.delete_dir_contents(inner)

    def write(self, rows) -> WriterCommitMessage:
        system, inner = _files(self.path)
        for row in rows:
            name = quote(row["doc_id"], safe="")
            beside = f"{inner}/.{uuid.uuid4().hex}"
            with system.open_output_stream(beside) as f:
                f.write((row["text"] or "").encode())
            system.move(beside, f"{inner}/{name}.{self.suffix}")
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        system, inner = _files(self.path)
        system.open_output_stream(f"{inner}/_SUCCESS").close()


def register(spark: SparkSession) -> None:
    """Makes format("provenance") known to a session."""
    spark.dataSource.register(ProvenanceSource)


def records(rows: DataFrame) -> DataFrame:
    """Records of what the source has read."""
    if "s_kind" not in rows.columns:
        return statements.to_records(rows)
    term = lambda c: F.struct(*[F.col(f"{c}_{x}").alias(x) for x in _PARTS]).alias(c)
    return triples.from_quads(rows.select("doc_id", "graph", term("s"), "p", term("o")))
