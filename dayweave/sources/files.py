"""Files that tasks open themselves: through pyarrow's file systems, by the URI under which Spark knows them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme of the file system that Spark takes it to be on, so that tasks find it there whatever their own default is."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString()


def located(uri: str):
    """The file system of a URI or local path, and the path within it."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def listed(uri: str, recursive: bool = False) -> list:
    """The entries of a folder by path, without opening any; a file stands for itself; an empty list if there is nothing."""
    from pyarrow import fs

    where, path = located(uri)
    info = where.get_file_info(path)
    if info.type == fs.FileType.File:
        return [info]
    return sorted(where.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=recursive)), key=lambda f: f.path)


def write_files(df: DataFrame, path: str) -> DataFrame:
    """Writes each row (name, text) as a file below path, folders in names included; a task that runs again writes the same over. A frame
    of name and n_bytes, and nothing is written until it is read, so stage it."""
    uri = qualified(df.sparkSession, path)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = located(uri)
        for rb in batches:
            sizes = []
            for name, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                where.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
                with where.open_output_stream(f"{root}/{name}") as out:
                    out.write(text or b"")
                sizes.append(len(text or b""))
            yield pa.RecordBatch.from_arrays([rb.column(0).cast(pa.string()), pa.array(sizes, pa.int64())], names=["name", "n_bytes"])

    return df.select("name", F.col("text").cast("binary").alias("text")).mapInArrow(put, "name string, n_bytes long")
