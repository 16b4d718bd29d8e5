"""Folders kept alike: a manifest of content hashes, what differs, and files written and removed where Spark runs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.ledger import is_there

STATES = ("written", "removed", "unchanged")


def _named(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """name (below folder), length and content of the files of a folder; none if there is no folder. Spark leaves out empty
    files, so these are neither written nor removed."""
    if not is_there(spark, folder):
        return spark.createDataFrame([], "name string, length long, content binary")
    base = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    inside = F.regexp_replace(F.col("path"), r"^[a-zA-Z][\w+.-]*:(?://[^/]*)?", "")
    plain = F.url_decode(F.replace(inside, F.lit("+"), F.lit("%2B")))
    return files.select(F.substr(plain, F.lit(len(root) + 2)).alias("name"), "length", "content")


def manifest(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """name, length and sha256 of each file below a folder whose name fits a pattern such as *.json."""
    return _named(spark, folder, pattern).select("name", "length", F.sha2("content", 256).alias("sha256"))


def differences(source: DataFrame, target: DataFrame) -> DataFrame:
    """name and state of two manifests: written (new or other content), removed (no longer in source), unchanged."""
    both = source.select("name", F.col("sha256").alias("_s")).join(target.select("name", F.col("sha256").alias("_t")), "name", "full_outer")
    state = F.when(F.col("_s").isNull(), "removed").when(F.col("_s") == F.col("_t"), "unchanged").otherwise("written")
    return both.select("name", state.alias("state"))


def counted(changes: DataFrame) -> dict[str, int]:
    """How many files have each state."""
    held = {r["state"]: r["count"] for r in changes.groupBy("state").count().collect()}
    return {s: held.get(s, 0) for s in STATES}


def synchronised(spark: SparkSession, source: str, target: str, pattern: str = "*", dry_run: bool = False) -> dict[str, int]:
    """Makes target's files that fit pattern those of source, and counts them by state. Only files of other content are
    written and only those that source lacks are removed, by the tasks that compare them; a second run changes nothing, and
    one that was stopped is finished by the next. dry_run: counts alone. Paths as pyarrow knows them (file, hdfs, s3)."""
    held = _named(spark, source, pattern)
    changes = differences(held.select("name", F.sha2("content", 256).alias("sha256")), manifest(spark, target, pattern))
    if dry_run:
        return counted(changes)

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pyarrow.fs.FileSystem.from_uri(target)
        for batch in batches:
            for name, state, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path = f"{root}/{name}"
                if state == "removed":
                    if system.get_file_info(path).type != pyarrow.fs.FileType.NotFound:  # a task that runs again
                        system.delete_file(path)
                elif state == "written":
                    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    with system.open_output_stream(path + ".part") as out:
                        out.write(content)
                    system.move(path + ".part", path)
            yield batch.select(["name", "state"])

    done = changes.join(held.select("name", "content"), "name", "left").select("name", "state", F.when(F.col("state") == "written", F.col("content")).alias("content"))
    return counted(done.mapInArrow(applied, "name string, state string"))


def stale_files(stored: DataFrame, folder: DataFrame) -> DataFrame:
    """name and issue of the files that don't fit a stored manifest: missing, unlisted or changed."""
    found = differences(stored, folder).where("state <> 'unchanged'")
    there = stored.select("name").withColumn("_listed", F.lit(True))
    issue = F.when(F.col("state") == "removed", "unlisted").when(F.col("_there"), "changed").otherwise("missing")
    return found.join(there, "name", "left").join(folder.select("name").withColumn("_there", F.lit(True)), "name", "left").select("name", issue.alias("issue"))


def complete_documents(docs: DataFrame, key: str, parts: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(docs that have all parts, key and missing of the others): a null, an empty text and an empty list are no part."""
    kinds = dict(docs.dtypes)
    has = {p: F.coalesce((F.size(p) if kinds[p].startswith(("array", "map")) else F.length(F.trim(F.col(p).cast("string")))) > 0, F.lit(False)) for p in parts}
    missing = F.array_compact(F.array(*(F.when(~h, p) for p, h in has.items())))
    judged = docs.withColumn("_missing", missing)
    return judged.where(F.size("_missing") == 0).drop("_missing"), judged.where(F.size("_missing") > 0).select(key, F.col("_missing").alias("missing"))
