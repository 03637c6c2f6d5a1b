"""Lines repeated across the documents of one source.

Method: incremental per-source line-count tables. A state table on disk holds, for each source and line, its
distinct positions, at most `threshold` of them (more cannot change whether the line has crossed). It lies in
buckets by source, those of a source divided by line, so that a source with a third of all rows is spread as well.
A new partition's lines (the delta) are merged into the buckets that they touch, the others staying as they are;
lines that reach the threshold in a merge have crossed, and only documents that contain a newly crossed line, or new
ones that contain a crossed line, are rebuilt. A merge writes new bucket files and then names them in the manifest,
so that one that is interrupted changes nothing.

Lines are split at '\\n' and numbered from 1. Two lines are the same if they agree after lower-casing,
turning runs other than a-z and 0-9 into one space, trimming, and turning runs of digits into '#'.
Lines without a letter, rows with a null text, source or position never count. Repeated rows add
nothing, since positions are distinct. Line keys are 128-bit hashes of the normal form.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.base import stored

#: Buckets by source, and their divisions by line.
SOURCES, DIVISIONS = 8, 8
KEY = ["source", "h1", "h2"]
_STATE = "source string, h1 long, h2 long, position int"


def normal_line(line: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(line), "[^a-z0-9]+", " "))
    return F.regexp_replace(plain, "[0-9]+", "#")


def lines(docs: DataFrame, *more: str) -> DataFrame:
    """(id, source, position, line_no, h1, h2, more) of each countable line of docs (id, source, position, text, more)."""
    d = docs.where(F.col("text").isNotNull() & F.col("source").isNotNull() & F.col("position").isNotNull())
    one = d.select("id", "source", "position", *more, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    one = one.withColumn("line", normal_line(F.col("line"))).where(F.col("line").rlike("[a-z]"))
    return one.select("id", "source", "position", *more, (F.col("line_no") + 1).alias("line_no"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _least(positions: DataFrame, threshold: int) -> DataFrame:
    """At most threshold positions of each line. The smallest are kept, so that the limit applies before the shuffle as
    well, and a line in a third of all rows never fills a task."""
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy("position"))
    return positions.withColumn("rank", rank).where(F.col("rank") <= threshold).drop("rank")


class LineCounts:
    """The state in a folder; each bucket is a table of its own, and the manifest names the present one of each."""

    def __init__(self, spark: SparkSession, path: str, threshold: int = 10):
        self.spark, self.path, self.threshold = spark, path, threshold

    def _file(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest.json")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _manifest(self) -> dict[str, int]:
        """Bucket to the merge that wrote it."""
        fs, path = self._file()
        return json.loads("".join(r[0] for r in self.spark.read.text(path.toString()).collect())) if fs.exists(path) else {}

    def _commit(self, manifest: dict[str, int]) -> None:
        fs, path = self._file()
        beside = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.toString() + ".new")
        out = fs.create(beside, True)
        out.write(bytearray(json.dumps(manifest), "ascii"))
        out.close()
        fs.delete(path, False)
        fs.rename(beside, path)

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """(source, h1, h2, position) of the state, of some buckets or all."""
        parts: dict[int, list[int]] = {}
        for b, merge in self._manifest().items():
            if buckets is None or int(b) in buckets:
                parts.setdefault(merge, []).append(int(b))
        out = self.spark.createDataFrame([], _STATE)
        for merge, own in parts.items():
            files = self.spark.read.schema(_STATE + ", bucket int").parquet(f"{self.path}/merge={merge}")
            out = out.unionByName(files.where(F.col("bucket").isin(own)).drop("bucket"))
        return out

    def vacuum(self) -> None:
        """Removes merges of which the manifest names no bucket any more."""
        fs, path = self._file()
        used = {f"merge={m}" for m in self._manifest().values()}
        for status in fs.listStatus(path.getParent()):
            if status.getPath().getName().startswith("merge=") and status.getPath().getName() not in used:
                fs.delete(status.getPath(), True)

    def crossed(self) -> DataFrame:
        return _full(self.rows(), self.threshold)

    def merge(self, new: DataFrame) -> DataFrame:
        """Takes the lines (source, h1, h2, position) of a partition into the state; (source, h1, h2) of those newly crossed."""
        bucket = F.pmod(F.xxhash64("source"), F.lit(SOURCES)).cast("int") * DIVISIONS + F.pmod("h1", F.lit(DIVISIONS)).cast("int")
        delta = stored(_least(new.select(*KEY, "position").distinct(), self.threshold).withColumn("bucket", bucket), "delta")
        touched = sorted(r[0] for r in delta.select("bucket").distinct().collect())  # a number a bucket
        manifest = self._manifest()
        if not touched:
            return self.spark.createDataFrame([], "source string, h1 long, h2 long")
        before, merge = self.rows(touched), max([0, *manifest.values()]) + 1
        after = _least(before.unionByName(delta.drop("bucket")).distinct(), self.threshold).withColumn("bucket", bucket) if manifest else delta
        after.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/merge={merge}")
        now = self.spark.read.schema(_STATE + ", bucket int").parquet(f"{self.path}/merge={merge}").drop("bucket")
        fresh = _full(now, self.threshold)
        if manifest:
            fresh = fresh.join(_full(before, self.threshold), KEY, "left_anti")
        self._commit(manifest | {str(b): merge for b in touched})
        return fresh


def _full(state: DataFrame, threshold: int) -> DataFrame:
    """(source, h1, h2) of the lines whose state is full."""
    return state.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold).drop("n")


def occurrences(all_lines: DataFrame, full: DataFrame) -> DataFrame:
    """(id, line_no) of each occurrence of a crossed line. The crossed lines are far fewer than the lines,
    and Spark broadcasts them only below its threshold; else a line in very many rows is split by AQE."""
    return all_lines.join(full, KEY, "left_semi").select("id", "line_no")


def to_rebuild(all_lines: DataFrame, merge: int, fresh: DataFrame, crossed: DataFrame) -> DataFrame:
    """(id) of the documents that merge number `merge` changes, of lines with the number of their merge: older ones with a
    newly crossed line, and new ones with any crossed line."""
    old = occurrences(all_lines.where(F.col("merge") < merge), fresh)
    new = occurrences(all_lines.where(F.col("merge") == merge), crossed)
    return old.unionByName(new).select("id").distinct()


def rebuild(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """(id, text) without the lines gone (id, line_no), of the documents that have any."""
    numbers = gone.groupBy("id").agg(F.collect_set("line_no").alias("gone"))
    kept = F.expr("filter(split(text, '\\n'), (x, i) -> not array_contains(gone, i + 1))")
    return docs.select("id", "text").join(numbers, "id").select("id", F.array_join(kept, "\n").alias("text"))
