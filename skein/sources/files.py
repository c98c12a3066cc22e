"""Project files as a Spark data source. Spark's own file sources leave out names that begin with _ or a dot."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skein.functions import text as X
from skein.shared import ship

#: Files whose bytes one task reads.
BATCH = 64


class _Batch(InputPartition):
    def __init__(self, root: str, paths: list[tuple[int, str]]):
        self.root, self.paths = root, paths


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root, self.ignored = options["path"], {x for x in options.get("ignore", "").split("\n") if x}
        self.batch = int(options.get("batch", BATCH))

    def partitions(self):
        """Names only are listed on the driver; ignored folders aren't entered."""
        found = []
        suffixes = {*X.CODE_SUFFIXES, *X.DOCUMENT_SUFFIXES, *X.PDF_SUFFIXES, *X.IMAGE_SUFFIXES, *X.VIDEO_SUFFIXES}
        for folder, inner, names in os.walk(self.root):
            inner[:] = [d for d in inner if d not in self.ignored]
            found += [os.path.relpath(os.path.join(folder, n), self.root).replace(os.sep, "/") for n in names if n not in self.ignored and Path(n).suffix.lower() in suffixes]
        ordered = list(enumerate(sorted(found, key=lambda p: p.split("/"))))
        return [_Batch(self.root, ordered[k : k + self.batch]) for k in range(0, len(ordered), self.batch)] or [_Batch(self.root, [])]

    def read(self, partition) -> Iterator[tuple]:
        for seq, rel in partition.paths:
            try:
                data = Path(partition.root, rel).read_bytes()
            except OSError:
                continue
            yield rel, rel.rsplit("/", 1)[-1], seq, len(data), hashlib.sha1(data).hexdigest(), data


class ProjectFiles(DataSource):
    """format("skein_files"), options path, ignore (folder names, one a line) and batch."""

    @classmethod
    def name(cls) -> str:
        return "skein_files"

    def schema(self) -> str:
        return "rel_path string, name string, file_seq long, length long, sha1 string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_files(spark: SparkSession, root: str, extra_ignored: tuple[str, ...] = (), extra_sensitive: tuple[str, ...] = ()) -> DataFrame:
    """All known files below root, with modality, language, force_local and reason; code first in file_seq.

    Ignored and sensitive folders are judged on the path below root. root must be readable by the executors."""
    ship(spark)
    spark.dataSource.register(ProjectFiles)
    found = spark.read.format("skein_files").option("path", str(root)).option("ignore", "\n".join((*X.NOISE_DIRS, *extra_ignored))).load()
    path = F.col("rel_path")
    found = found.withColumns({"modality": X.file_modality(path), "language": X.file_language(path)})
    # bytes that aren't UTF-8 become replacement characters, as the patterns only look for ASCII
    text = F.when(X.suffix(path).isin(*X.SCANNED_SUFFIXES), F.col("content").cast("string"))
    decided = found.withColumn("_s", X.security(path, text, extra_sensitive))
    order = F.when(F.col("modality") == "code", F.col("file_seq")).otherwise(F.col("file_seq") + F.lit(1 << 32))
    return decided.select("rel_path", "name", "modality", "language", order.alias("file_seq"), "length", "sha1", "content", "_s.force_local", "_s.reason")
