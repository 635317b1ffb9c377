"""Names of files as a data source: `spark.read.format("names").load(folder)`; nothing is opened.

Every folder below the given one is a partition of its own that its task lists, so the driver lists folders only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from dayweave.operators.labels import crop_name, video_id
from dayweave.sources.files import listed, qualified

NAMES = "folder string, name string, bytes long"
#: Names sent on at a time.
AT_ONCE = 20_000


@dataclass
class Folder(InputPartition):
    uri: str
    shown: str
    recursive: bool


class NamesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.depth = options["path"].rstrip("/"), int(options.get("depth", 1))

    def partitions(self) -> list[Folder]:
        from pyarrow import fs

        out, level = [], [(self.uri, "")]
        for depth in range(self.depth + 1):
            below = []
            for uri, shown in level:
                out.append(Folder(uri, shown, depth == self.depth))
                if depth < self.depth:
                    names = [i.path.rpartition("/")[2] for i in listed(uri) if i.type == fs.FileType.Directory]
                    below += [(f"{uri}/{n}", f"{shown}/{n}".lstrip("/")) for n in names]
            level = below
        return out

    def read(self, part: Folder) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        found = [i for i in listed(part.uri, part.recursive) if i.type == fs.FileType.File]
        root = part.uri.split("://")[-1].removeprefix("file:").strip("/")
        for at in range(0, len(found), AT_ONCE):
            some = found[at : at + AT_ONCE]
            inside = [i.path.strip("/").removeprefix(root).strip("/").rpartition("/") for i in some]
            folders = ["/".join(x for x in (part.shown, below) if x) for below, _, _ in inside]
            yield pa.RecordBatch.from_pydict({"folder": folders, "name": [n for _, _, n in inside], "bytes": [i.size for i in some]}, schema=pa.schema([("folder", pa.string()), ("name", pa.string()), ("bytes", pa.int64())]))


class NamesSource(DataSource):
    """Options: path, depth (levels of folders that are partitions of their own, 1; what lies deeper is listed with them). Columns: NAMES."""

    @classmethod
    def name(cls) -> str:
        return "names"

    def schema(self) -> str:
        return NAMES

    def reader(self, schema) -> NamesReader:
        return NamesReader(self.options)


def names(spark: SparkSession, path: str, depth: int = 1) -> DataFrame:
    """folder (relative to path, empty for path itself), name and bytes of every file below path."""
    spark.dataSource.register(NamesSource)
    return spark.read.format("names").option("depth", depth).load(qualified(spark, path))


# ---- crops --------------------------------------------------------------------------------------------------------

#: Ids that one of the two layouts gives to junk and distractors; from so many ids on a folder is of the other.
RESERVED, MANY_IDS = ("-1", "0000"), 900


def _crop(files: DataFrame, reserved: tuple[str, ...]) -> DataFrame:
    c = files.withColumn("crop", crop_name(F.col("name"), reserved))
    plain = crop_name(F.col("name"))
    why = F.when(F.col("name").startswith("."), "hidden").when(~F.col("name").rlike(r"\.(jpg|jpeg|png)$"), "not an image").when(plain.isNull(), "not a crop's name").when(F.col("crop").isNull(), "reserved id")
    return c.select("folder", "name", "crop.pid", "crop.camera", "crop.frame", why.alias("reject_reason"))


def crops(files: DataFrame, layout: Column | None = None) -> DataFrame:
    """Of names: folder, name, pid, camera, frame, reject_reason; nothing but names is looked at. layout is "market" where reserved ids
    are junk (in the other layout 0000 is a person); none given: decided for each top folder by how many ids it has."""
    top = F.split_part(F.col("folder"), F.lit("/"), F.lit(1))
    if layout is None:
        seen = _crop(files, ()).filter("reject_reason is null").groupBy(F.split_part(F.col("folder"), F.lit("/"), F.lit(1)).alias("_top")).agg(F.count_distinct("pid").alias("_ids"))
        files = files.join(seen, top == F.col("_top"), "left").withColumn("_market", F.coalesce("_ids", F.lit(0)) <= MANY_IDS).drop("_top", "_ids")
    else:
        files = files.withColumn("_market", layout == "market")
    keep = F.col("_market")
    return _crop(files.filter(keep), RESERVED).unionByName(_crop(files.filter(~keep), ()))


def videos(files: DataFrame) -> DataFrame:
    """Of names: folder, name, subject, take, camera, reject_reason, by the one id that the name must hold."""
    v = files.withColumn("_v", video_id(F.col("name")))
    return v.select("folder", "name", "_v.subject", "_v.take", "_v.camera", F.when(F.col("_v").isNull(), "no single id in the name").alias("reject_reason"))
