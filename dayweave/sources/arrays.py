"""Archives of numpy arrays as a data source: `spark.read.format("npz").option("arrays", "skeletons,labels").load(path)`.

Row k of an archive is entry k of each of its arrays. Archives up to PART_BYTES are one partition each and are planned from the listing
alone; of larger ones only the array headers are read to plan ranges of rows, so one archive of any size is read by many tasks, each of which
seeks to its rows (or, in compressed archives, skips to them) and holds a few hundred at a time.
"""

from __future__ import annotations

import math
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from dayweave.sources.files import listed, located, qualified

#: Bytes of an archive, or of a range of its rows, that make a partition; bytes of rows held at a time.
PART_BYTES, HELD_BYTES = 64 << 20, 4 << 20


@dataclass
class Header:
    """What an array's header says, and where its first entry lies in the uncompressed member."""

    dtype: np.dtype
    shape: tuple[int, ...]
    begin: int

    @property
    def row_bytes(self) -> int:
        return self.dtype.itemsize * math.prod(self.shape[1:])


def header(member) -> Header:
    version = np.lib.format.read_magic(member)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(member)
    if fortran and len(shape) > 1:
        raise ValueError("arrays in column order cannot be read by rows")
    if dtype.hasobject or not shape:
        raise ValueError("arrays of objects and single values have no rows to read")
    return Header(dtype, shape, member.tell())


class Archive:
    def __init__(self, uri: str):
        where, path = located(uri)
        self.file = where.open_input_file(path)
        self.zip = zipfile.ZipFile(self.file)
        self.members = {i.filename.removesuffix(".npy"): i for i in self.zip.infolist()}

    def __enter__(self) -> Archive:
        return self

    def __exit__(self, *_) -> None:
        self.zip.close()
        self.file.close()

    def header(self, name: str) -> Header:
        with self.zip.open(self.members[name]) as m:
            return header(m)

    def rows(self, name: str, first: int, last: int, step: int) -> Iterator[np.ndarray]:
        """Entries first to last - 1, step at a time."""
        with self.zip.open(self.members[name]) as m:
            h = header(m)
            m.seek(h.begin + first * h.row_bytes)
            for at in range(first, last, step):
                n = min(step, last - at)
                raw = m.read(n * h.row_bytes)
                if len(raw) < n * h.row_bytes:
                    raise ValueError(f"{name} ends before row {last}")
                yield np.frombuffer(raw, h.dtype).reshape(n, *h.shape[1:])


def _kind(dtype: np.dtype, many: bool) -> T.DataType:
    one = {"f": T.DoubleType() if dtype.itemsize > 4 else T.FloatType(), "i": T.LongType(), "u": T.LongType(), "b": T.BooleanType(), "U": T.StringType(), "S": T.StringType()}.get(dtype.kind)
    if one is None:
        raise ValueError(f"no column type for {dtype}")
    return T.ArrayType(one) if many else one


def _column(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    flat = x.reshape(-1)
    if flat.dtype.kind == "S":
        flat = np.char.decode(flat, "utf-8")
    inner = kind.value_type if pa.types.is_list(kind) else kind
    values = pa.array(flat.astype(str).tolist() if flat.dtype.kind == "U" else flat.astype(inner.to_pandas_dtype()), inner)
    if not pa.types.is_list(kind):
        return values
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * math.prod(x.shape[1:]), pa.int32()), values)


@dataclass
class Rows(InputPartition):
    uri: str
    first: int
    last: int | None


class NpzReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict, names: list[str]):
        self.schema, self.names = schema, names
        self.uri, self.part = options["path"], int(options.get("partbytes", PART_BYTES))

    def partitions(self) -> list[Rows]:
        out = []
        for info in archives(self.uri):
            if info.size <= self.part:
                out.append(Rows(info.path, 0, None))
                continue
            with Archive(self.within(info.path)) as a:
                heads = [a.header(n) for n in self.names if n in a.members]
            n = heads[0].shape[0]
            step = max(1, self.part // max(1, sum(h.row_bytes for h in heads)))
            out += [Rows(info.path, at, min(n, at + step)) for at in range(0, n, step)]
        return out or [Rows("", 0, 0)]

    def within(self, path: str) -> str:
        """A listed path, as a URI of the file system that was listed."""
        scheme = self.uri.split("://")[0] if "://" in self.uri else ""
        host = self.uri.split("://")[1].split("/")[0] if scheme else ""
        return path if not scheme or scheme == "file" else f"{scheme}://{path}" if path.startswith(host) else f"{scheme}://{host}{path}"

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if not part.uri:
            return
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        root = located(self.uri)[1].rstrip("/") + "/"
        shown = part.uri.removeprefix(root) if part.uri.startswith(root) else part.uri.rpartition("/")[2]
        with Archive(self.within(part.uri)) as a:
            there = [n for n in self.names if n in a.members]
            if not there:
                raise ValueError(f"{part.uri} has none of the arrays {self.names}")
            heads = {n: a.header(n) for n in there}
            sizes = {h.shape[0] for h in heads.values()}
            if len(sizes) > 1:
                raise ValueError(f"the arrays of {part.uri} differ in length: {({n: h.shape[0] for n, h in heads.items()})}")
            last = sizes.pop() if part.last is None else part.last
            step = max(1, min(8192, HELD_BYTES // max(1, sum(h.row_bytes for h in heads.values()))))
            walks = {n: a.rows(n, part.first, last, step) for n in there}
            for at in range(part.first, last, step):
                n = min(step, last - at)
                columns = {"archive": pa.array([shown] * n), "row": pa.array(range(at, at + n), pa.int64())}
                for name, walk in walks.items():
                    columns[name] = _column(next(walk), schema.field(name).type)
                    columns[f"{name}_shape"] = pa.array([list(heads[name].shape[1:])] * n, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def archives(uri: str) -> list:
    """Archives at a file, below a folder, or in a folder by a pattern of names."""
    from pyarrow import fs

    folder, _, name = uri.rpartition("/")
    found = [i for i in listed(folder) if fnmatchcase(i.path.rpartition("/")[2], name)] if any(c in name for c in "*?[") else listed(uri, recursive=True)
    return [i for i in found if i.type == fs.FileType.File and i.path.endswith(".npz")]


class NpzSource(DataSource):
    """Options: path, arrays (names, comma-separated), partBytes. Columns: archive (its
    path below the one given, or its name), row, each array (arrays of more than one dimension flat,
    with <name>_shape); an array that an archive lacks is null there. Types are those of the first archive that has the array."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def _names(self) -> list[str]:
        return [n.strip() for n in self.options["arrays"].split(",")]

    def schema(self) -> T.StructType:
        fields, missing = {}, self._names()
        reader = NpzReader(T.StructType(), self.options, [])
        for info in archives(self.options["path"]):
            with Archive(reader.within(info.path)) as a:
                for n in [n for n in missing if n in a.members]:
                    h = a.header(n)
                    fields[n] = [T.StructField(n, _kind(h.dtype, len(h.shape) > 1)), *([T.StructField(f"{n}_shape", T.ArrayType(T.IntegerType()))] if len(h.shape) > 1 else [])]
            missing = [n for n in missing if n not in fields]
            if not missing:
                break
        return T.StructType([T.StructField("archive", T.StringType()), T.StructField("row", T.LongType()), *(f for n in self._names() for f in fields.get(n, [T.StructField(n, T.StringType())]))])

    def reader(self, schema: T.StructType) -> NpzReader:
        return NpzReader(schema, self.options, self._names())


def arrays(spark: SparkSession, path: str, names: list[str], part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of all archives at path (a file, a folder, or a pattern of names in one)."""
    spark.dataSource.register(NpzSource)
    return spark.read.format("npz").option("arrays", ",".join(names)).option("partBytes", part_bytes).load(qualified(spark, path))


def saved_logits(spark: SparkSession, path: str, logits: str = "logits", labels: str = "labels") -> DataFrame:
    """archive, row, logits (array), label: what an evaluation run saved, for the metrics to read."""
    a = arrays(spark, path, [logits, labels])
    return a.select("archive", "row", F.col(f"`{logits}`").cast("array<double>").alias("logits"), F.col(f"`{labels}`").cast("int").alias("label"))


def write_archives(df: DataFrame, path: str, columns: list[str], compressed: bool = False, rows: int = 4096) -> DataFrame:
    """Writes columns (numbers, texts, or arrays of one length) as archives of at most `rows` rows below path: a frame of file, n_rows and
    n_bytes, one row an archive.

    A task names its archives by partition and place, so that a task that runs again writes the same files over. Nothing is written until
    the frame is read, so stage it.
    """
    uri = qualified(df.sparkSession, path)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        where, root = located(uri)
        where.create_dir(root, recursive=True)
        part, made, held = TaskContext.get().partitionId(), 0, []

        def flush(some: pa.Table) -> pa.RecordBatch:
            name = f"part-{part:06d}-{made:06d}.npz"
            table = {c: _matrix(some.column(c).combine_chunks()) for c in columns}
            with where.open_output_stream(f"{root}/{name}") as f:
                (np.savez_compressed if compressed else np.savez)(f, **table)
            return pa.RecordBatch.from_pydict({"file": [name], "n_rows": [len(some)], "n_bytes": [where.get_file_info(f"{root}/{name}").size]})

        for rb in batches:
            held.append(rb)
            while sum(map(len, held)) >= rows:
                whole = pa.Table.from_batches(held)
                yield flush(whole.slice(0, rows))
                made, held = made + 1, whole.slice(rows).to_batches()
        if sum(map(len, held)):
            yield flush(pa.Table.from_batches(held))

    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(put, "file string, n_rows long, n_bytes long")


def _matrix(column: pa.Array) -> np.ndarray:
    if pa.types.is_list(column.type):
        flat = column.flatten().to_numpy(zero_copy_only=False)
        if len(flat) % max(1, len(column)) or len(set(np.diff(column.offsets.to_numpy()))) > 1:
            raise ValueError("an array column of an archive needs arrays of one length")
        return flat.reshape(len(column), -1)
    return np.array(column.to_pylist(), str) if pa.types.is_string(column.type) else column.to_numpy(zero_copy_only=False)
