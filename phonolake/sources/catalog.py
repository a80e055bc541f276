"""Archive catalogue: files, sidecars, montage documents, output plans and tags."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File extensions by container.
FORMATS = {
    "wav": "wave", "wave": "wave", "aif": "aiff", "aiff": "aiff", "aifc": "aiff", "w64": "wave64", "dsf": "dsd",
    "dff": "dsd", "mp3": "compressed", "m4a": "compressed", "flac": "compressed", "wma": "compressed", "aac": "compressed",
}


def file_catalogue(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, length, time and format of every file. The content column is pruned, so no file is read."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    )
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return files.select(
        "path", "length", F.col("modificationTime").alias("modified"), extension.alias("extension"),
        F.coalesce(F.try_element_at(known, extension), F.lit("other")).alias("format"),
    )


PIECE = 4 << 20  # bytes of a file in memory at a time


def _hashes(batches):
    """SHA-256 of every path's file, read piece by piece."""
    from pyarrow import fs

    for batch in batches:
        found = []
        for path in batch["path"]:
            # Listed paths are not percent-encoded: a local name is taken as it stands.
            local = path.startswith(("/", "file:"))
            system, place = (fs.LocalFileSystem(), re.sub(r"^file:(//)?", "", path)) if local else fs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with system.open_input_stream(place) as source:
                while piece := source.read(PIECE):
                    digest.update(piece)
            found.append(digest.hexdigest())
        yield batch.assign(hash=found)


def duplicate_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Groups of files with equal content. Only files whose length occurs more than once are read and hashed, in pieces:
    the content column would hold a whole file in a row, and those of all files before the join."""
    files = file_catalogue(spark, path, pattern).select("path", "length")
    repeated = files.groupBy("length").count().filter("count > 1").select("length")
    hashed = files.join(repeated, "length", "left_semi").mapInPandas(_hashes, "path string, length long, hash string")
    return hashed.groupBy("hash", "length").agg(F.count(F.lit(1)).alias("copies"), F.min("path").alias("first_path")).filter("copies > 1")


MARKER = T.StructType([T.StructField("name", T.StringType()), T.StructField("position", T.LongType())])
REGION = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("cd_order", T.IntegerType()),
])
SIDECAR = T.StructType([
    T.StructField("markers", T.ArrayType(MARKER)), T.StructField("regions", T.ArrayType(REGION)),
    T.StructField("audio_length_bytes", T.LongType()), T.StructField("audio_write_ticks", T.LongType()),
])


def valid_sidecars(sidecars: DataFrame, files: DataFrame) -> DataFrame:
    """Sidecar(path, json) rows whose stored length and time still match the file; without a stamp they are accepted."""
    parsed = sidecars.select("path", F.from_json("json", SIDECAR).alias("s")).select("path", "s.*")
    stamped = F.col("audio_length_bytes").isNotNull() & F.col("audio_write_ticks").isNotNull()
    joined = parsed.join(files.select("path", "length", "ticks"), "path", "left")
    matches = F.col("audio_length_bytes").eqNullSafe(F.col("length")) & F.col("audio_write_ticks").eqNullSafe(F.col("ticks"))
    return joined.filter(~stamped | matches).select(
        "path", F.coalesce("markers", F.array().cast(T.ArrayType(MARKER))).alias("markers"),
        F.coalesce("regions", F.array().cast(T.ArrayType(REGION))).alias("regions"),
    )


CLIP = T.StructType([
    T.StructField("clip_id", T.LongType()), T.StructField("source_id", T.LongType()),
    T.StructField("source_start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("timeline_start", T.LongType()),
])
MONTAGE = T.StructType([T.StructField("title", T.StringType()), T.StructField("clips", T.ArrayType(CLIP))])


def parse_montages(documents: DataFrame) -> DataFrame:
    """documents(timeline_id, json) to clip rows."""
    return documents.select("timeline_id", F.from_json("json", MONTAGE).alias("m")).select(
        "timeline_id", F.explode("m.clips").alias("c")
    ).select("timeline_id", "c.*")


def output_plan(files: DataFrame, folder: str, extension: str, existing: DataFrame) -> DataFrame:
    """files(item, path) to target paths with a status; paths compare without regard to case.

    The first item of equal targets is the smallest one: a grouped minimum, no per-path window.
    """
    name = F.regexp_replace(F.element_at(F.split("path", r"[/\\]"), -1), r"\.[^.]*$", "")
    planned = files.withColumn("output", F.concat(F.lit(folder + "/"), name, F.lit(extension))).withColumn("_key", F.lower("output"))
    sources = files.select(F.lower("path").alias("_key")).distinct().withColumn("_is_source", F.lit(True))
    joined = planned.join(sources, "_key", "left")
    winners = joined.filter("_is_source IS NULL").groupBy("_key").agg(F.min("item").alias("_winner"))
    there = existing.select(F.lower("path").alias("_key")).distinct().withColumn("_exists", F.lit(True))
    return joined.join(winners, "_key", "left").join(there, "_key", "left").select(
        "item", "output",
        F.when(F.col("_is_source"), "failed: output collides with a source file")
        .when(F.col("item") != F.col("_winner"), "failed: output path collision")
        .when(F.col("_exists"), "exists")
        .otherwise("ready")
        .alias("status"),
    )


# Tag keys of the three containers and the field each one means.
TAG_FIELDS = {
    "INAM": "title", "IART": "artist", "IPRD": "album", "ITRK": "track", "IGNR": "genre", "ICRD": "year", "ICMT": "comment",
    "TIT2": "title", "TPE1": "artist", "TALB": "album", "TRCK": "track", "TCON": "genre", "TDRC": "year", "COMM": "comment",
    "NAME": "title", "AUTH": "artist",
}
FIELDS = ["title", "artist", "album", "track", "genre", "year", "comment"]


def normalise_tags(tags: DataFrame) -> DataFrame:
    """tags(file_id, key, value) of any container to one row of seven fields; annotation lines are unfolded."""
    mapping = F.create_map(*[F.lit(x) for pair in TAG_FIELDS.items() for x in pair])
    plain = tags.select("file_id", F.try_element_at(mapping, F.col("key")).alias("field"), F.trim("value").alias("value")).filter(
        "field IS NOT NULL AND value <> ''"
    ).withColumn("line", F.lit(0))
    lines = tags.filter("key = 'ANNO'").select("file_id", F.posexplode(F.split("value", "\n")).alias("line", "text"))
    text = F.trim("text")
    label = F.lower(F.regexp_extract(text, "^(Album|Track|Genre|Year): ", 1))
    unfolded = lines.select(
        "file_id", F.when(label != "", label).otherwise("comment").alias("field"),
        F.when(label != "", F.trim(F.regexp_replace(text, "^[A-Za-z]+: ", ""))).otherwise(text).alias("value"), "line",
    ).filter("value <> ''")
    both = plain.unionByName(unfolded)
    comment = F.array_join(F.transform(F.array_sort(F.collect_list(
        F.when(F.col("field") == "comment", F.struct("line", "value")))), lambda x: x["value"]), "\n")
    last = lambda f: F.coalesce(F.max_by("value", F.when(F.col("field") == f, F.col("line"))), F.lit(""))
    return both.groupBy("file_id").agg(*[last(f).alias(f) for f in FIELDS if f != "comment"], comment.alias("comment"))


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace exactly the partitions present in ``df``; running it again gives the same files' worth of rows."""
    (
        df.repartition(*by, *[c for c in ("block", "n", "bin") if c in df.columns][:1])
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    )
