"""Result files: JSON lines with a manifest, written through a data source, and small tables as markdown.

Tasks write below a folder of the job; only when all have succeeded are the files that their messages name moved beside each other and
counted in manifest.json, so neither failed attempts nor failed jobs leave anything.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from dayweave.sources.files import listed, located, qualified

MANIFEST = "manifest.json"


@dataclass
class Written(WriterCommitMessage):
    file: str
    n_rows: int
    n_bytes: int


class LinesWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.uri, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex
        self.suffix = options.get("suffix", "jsonl")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        where, root = located(self.uri)
        name, n = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.{self.suffix}", 0
        where.create_dir(f"{root}/_job-{self.job}", recursive=True)
        at = f"{root}/_job-{self.job}/{name}"
        with where.open_output_stream(at) as out:
            for rb in iterator:
                lines = [x for x in rb.column(0).cast(pa.binary()).to_pylist() if x is not None]
                out.write(b"".join(x + b"\n" for x in lines))
                n += len(lines)
        return Written(name, n, where.get_file_info(at).size)

    def commit(self, messages: list[Written | None]) -> None:
        where, root = located(self.uri)
        if self.overwrite:
            for old in listed(self.uri):
                if not old.path.rpartition("/")[2].startswith("_job-"):
                    where.delete_file(old.path)
        files = sorted((m for m in messages if m is not None and m.n_rows), key=lambda m: m.file)
        for m in files:
            where.move(f"{root}/_job-{self.job}/{m.file}", f"{root}/{m.file}")
        before = [] if self.overwrite else _read_manifest(where, root)
        held = before + [{"file": m.file, "n_rows": m.n_rows, "n_bytes": m.n_bytes} for m in files]
        where.create_dir(root, recursive=True)
        with where.open_output_stream(f"{root}/{MANIFEST}.new") as out:
            out.write(json.dumps({"n_rows": sum(f["n_rows"] for f in held), "n_bytes": sum(f["n_bytes"] for f in held), "files": held}).encode())
        try:
            where.move(f"{root}/{MANIFEST}.new", f"{root}/{MANIFEST}")
        except OSError:  # some file systems don't move over a file
            where.delete_file(f"{root}/{MANIFEST}")
            where.move(f"{root}/{MANIFEST}.new", f"{root}/{MANIFEST}")
        self._clear(where, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*located(self.uri))

    def _clear(self, where, root: str) -> None:
        from pyarrow import fs

        at = f"{root}/_job-{self.job}"
        if where.get_file_info(at).type == fs.FileType.Directory:
            where.delete_dir(at)


def _read_manifest(where, root: str) -> list[dict]:
    from pyarrow import fs

    if where.get_file_info(f"{root}/{MANIFEST}").type != fs.FileType.File:
        return []
    with where.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())["files"]


class LinesSink(DataSource):
    """Writes a column of texts as lines. Options: path, suffix."""

    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return "line string"

    def writer(self, schema, overwrite: bool) -> LinesWriter:
        return LinesWriter(self.options, overwrite)


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    """One line of JSON for each row, nulls written out, and a manifest of files, rows and bytes. Append adds to the manifest's files;
    overwrite replaces them. One writer at a time."""
    spark = df.sparkSession
    spark.dataSource.register(LinesSink)
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    df.select(line.alias("line")).write.format("lines").mode(mode).option("suffix", "jsonl").save(qualified(spark, path))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, n_rows, n_bytes of each file that a sink's manifest names."""
    m = spark.read.json(f"{path.rstrip('/')}/{MANIFEST}", schema="files array<struct<file: string, n_rows: long, n_bytes: long>>", multiLine=True)
    return m.select(F.inline("files"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a JSON lines sink; files that its manifest doesn't name are not read."""
    files = [f"{path.rstrip('/')}/{r.file}" for r in manifest(spark, path).collect()]  # one row a file
    return spark.read.schema(schema).json(files) if files else spark.createDataFrame([], schema)


def markdown(df: DataFrame, digits: int = 3, most: int = 100) -> str:
    """A small result as a markdown table, in df's order; ValueError beyond `most` rows, which is no table to read."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")

    def cell(x) -> str:
        if x is None:
            return "n/a"
        if isinstance(x, float):
            return f"{x:.{digits}f}"
        text = x.isoformat() if isinstance(x, datetime.date) else str(x)
        return text.replace("|", "\\|").replace("\n", " ")

    numeric = [t in ("int", "bigint", "double", "float", "smallint") for _, t in df.dtypes]
    lines = [df.columns, ["---:" if n else "---" for n in numeric], *([cell(x) for x in r] for r in rows)]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines) + "\n"
