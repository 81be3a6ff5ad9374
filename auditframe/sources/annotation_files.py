"""Annotation files and image archives as DataFrames.

Annotation JSON is read whole, one document per file, and flattened by joins with its
category lists: a category id means what its *name* says, never its position. Archives are
read with the ``binaryFile`` source; members are hashed where they are read.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.functions.numeric import FDI

CATEGORY = "ARRAY<STRUCT<id: INT, name: STRING>>"
COCO = (
    "images ARRAY<STRUCT<id: INT, file_name: STRING, height: INT, width: INT>>, "
    "annotations ARRAY<STRUCT<id: INT, image_id: INT, bbox: ARRAY<DOUBLE>, category_id_1: INT, category_id_2: INT, category_id_3: INT>>, "
    f"categories_1 {CATEGORY}, categories_2 {CATEGORY}, categories_3 {CATEGORY}"
)
LABEL = r"^(\d+)-(.+)-(\d{2})$"


class UnreadableAnnotation(ValueError):
    """An annotation file says something that its format has no place for."""


def box_of(xywh: Column) -> Column:
    """x, y, width, height to corners."""
    return F.struct(xywh[0].alias("x1"), xywh[1].alias("y1"), (xywh[0] + xywh[2]).alias("x2"), (xywh[1] + xywh[3]).alias("y2"))


def documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, json) of each annotation file."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("json"))


def _names(docs: DataFrame, column: str, allowed: range) -> DataFrame:
    """(file, id, number) of a category list; names outside the allowed numbers raise."""
    rows = docs.select("file", F.explode(column).alias("c")).select("file", "c.id", F.col("c.name").try_cast("int").alias("number"), "c.name")
    bad = rows.filter(F.col("number").isNull() | ~F.col("number").isin(*allowed)).limit(3).collect()
    if bad:
        raise UnreadableAnnotation(f"{column}: not a number in {allowed.start}-{allowed.stop - 1}: {[r.name for r in bad]}")
    return rows.select("file", "id", "number")


def _teeth(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    images = docs.select("file", F.explode("images").alias("i")).select("file", F.col("i.id").alias("image"), "i.file_name", "i.height", "i.width")
    notes = docs.select("file", F.explode("annotations").alias("a")).select("file", F.col("a.image_id").alias("image"), F.col("a.id").alias("note"), box_of(F.col("a.bbox")).alias("box"), "a.category_id_1", "a.category_id_2", "a.category_id_3")
    for column, allowed in (("categories_1", range(1, 5)), ("categories_2", range(1, 9))):
        named = _names(docs, column, allowed).withColumnRenamed("id", f"category_id_{column[-1]}").withColumnRenamed("number", f"n{column[-1]}")
        notes = notes.join(F.broadcast(named), ["file", f"category_id_{column[-1]}"])
    return images, notes.withColumn("fdi", F.col("n1") * 10 + F.col("n2"))


def read_coco(docs: DataFrame) -> DataFrame:
    """(file_name, height, width, findings array of (finding, fdi, box)) of quadrant, tooth and diagnosis lists; images without any stay."""
    parsed = docs.select("file", F.from_json("json", COCO).alias("d")).select("file", "d.*")
    images, notes = _teeth(parsed)
    diagnoses = parsed.select("file", F.explode("categories_3").alias("c")).select("file", F.col("c.id").alias("category_id_3"), F.lower("c.name").alias("finding"))
    found = notes.join(F.broadcast(diagnoses), ["file", "category_id_3"])
    lists = found.groupBy("file", "image").agg(F.array_sort(F.collect_list(F.struct("note", "finding", "fdi", "box"))).alias("findings"))
    empty = F.filter(F.col("findings"), lambda x: F.lit(False))
    return images.join(lists, ["file", "image"], "left").select("file_name", "height", "width", F.coalesce("findings", F.coalesce(empty, F.array().cast("array<struct<note:int,finding:string,fdi:int,box:struct<x1:double,y1:double,x2:double,y2:double>>>"))).alias("findings"))


def read_enumeration(docs: DataFrame) -> DataFrame:
    """(file_name, fdi, box) of every tooth box."""
    parsed = docs.select("file", F.from_json("json", COCO).alias("d")).select("file", "d.*")
    images, notes = _teeth(parsed)
    return notes.join(images, ["file", "image"]).select("file_name", "fdi", "box")


def read_labelme(docs: DataFrame) -> DataFrame:
    """(file, code, word, fdi) of each shape; labels are ``code-word-FDI``."""
    shapes = docs.select("file", F.explode(F.from_json("json", "shapes ARRAY<STRUCT<label: STRING>>")["shapes"]).alias("s")).select("file", "s.label")
    bad = shapes.filter(~F.coalesce(F.col("label").rlike(LABEL), F.lit(False))).limit(3).collect()
    if bad:
        raise UnreadableAnnotation(f"label is not code-word-FDI: {[r.label for r in bad]}")
    part = lambda i: F.regexp_extract("label", LABEL, i)
    rows = shapes.select("file", part(1).cast("int").alias("code"), part(2).alias("word"), part(3).cast("int").alias("fdi"))
    wrong = rows.filter(~F.col("fdi").isin(*FDI)).limit(3).collect()
    if wrong:
        raise UnreadableAnnotation(f"no such tooth: {[r.fdi for r in wrong]}")
    return rows


#: Bytes hashed at once.
PIECE = 1 << 20


def _opened(uri: str):
    system, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return system.open_input_file(path)


def archive_listing(spark: SparkSession, paths: str | list[str], prefix: str = "", suffix: str = ".png") -> DataFrame:
    """(uri, archive, archive_size, member, name, size, crc) of direct members below ``prefix``; deeper folders are left out. Reads directories of archives only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with _opened(uri) as file, zipfile.ZipFile(file) as archive:
                    rows = []
                    for info in archive.infolist():
                        rest = info.filename[len(prefix) :]
                        if info.filename.startswith(prefix) and rest.endswith(suffix) and rest and "/" not in rest:
                            rows.append({"uri": uri, "archive": uri.rpartition("/")[2], "archive_size": file.size(), "member": rest, "name": info.filename, "size": info.file_size, "crc": info.CRC})
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows)

    names = spark.read.format("binaryFile").load(paths).select("path")  # the content column is pruned: files are not read
    return names.mapInArrow(run, "uri string, archive string, archive_size long, member string, name string, size long, crc long")


def read_members(listing: DataFrame, content: bool = True) -> DataFrame:
    """``listing`` with ``sha`` and, if wanted, ``content``. Members are spread over tasks, whichever archive they lie in, and hashed by pieces."""
    kinds = "uri string, archive string, archive_size long, member string, name string, size long, crc long, sha string" + (", content binary" if content else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, file, archive = None, None, None
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if row["uri"] != now:
                        if archive is not None:
                            archive.close()
                            file.close()
                        now, file = row["uri"], _opened(row["uri"])
                        archive = zipfile.ZipFile(file)
                    digest, parts = hashlib.sha256(), []
                    with archive.open(row["name"]) as member:
                        while piece := member.read(PIECE):
                            digest.update(piece)
                            if content:
                                parts.append(piece)
                    yield pa.RecordBatch.from_pylist([row | {"sha": digest.hexdigest()} | ({"content": b"".join(parts)} if content else {})])
        finally:
            if archive is not None:
                archive.close()
                file.close()

    rows = listing.select("uri", "archive", "archive_size", "member", "name", "size", "crc")
    return rows.repartition("uri", F.pmod(F.xxhash64("name"), F.lit(64))).sortWithinPartitions("uri", "name").mapInArrow(run, kinds)


def archive_members(spark: SparkSession, paths: str | list[str], prefix: str = "", suffix: str = ".png") -> DataFrame:
    """Listing, digest and content of all members."""
    return read_members(archive_listing(spark, paths, prefix, suffix))


def verified(files: DataFrame, published: dict[str, str]) -> DataFrame:
    """``files`` (path, content) if each has its published SHA-256, else an error: unverified archives are not read."""
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha")).collect()
    wrong = sorted(r.name for r in rows if published.get(r.name) != r.sha)
    if wrong:
        raise ValueError(f"checksum differs or is not published: {wrong[:3]}")
    return files


def new_members(listing: DataFrame, cache: DataFrame) -> DataFrame:
    """Members that the cache has not hashed yet: keyed by archive, its size, member, size and checksum, so a new release is hashed again."""
    key = ["archive", "archive_size", "member", "size", "crc"]
    return listing.join(cache.select(*key), key, "left_anti")


def store_content(members: DataFrame, path: str) -> DataFrame:
    """Write each content once, addressed by its digest; contents that are there already are left alone, and one that is not its digest's is an error."""
    spark = members.sparkSession
    rows = members.groupBy("sha").agg(F.first("content").alias("content"))
    try:
        rows = rows.join(spark.read.parquet(path).select("sha"), "sha", "left_anti")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    right = F.when(F.sha2("content", 256) == F.col("sha"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("content is not what its digest says: "), "sha")).cast("binary"))
    rows.select("sha", right.alias("content")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def load_release(annotated: DataFrame, boxes: DataFrame, index: DataFrame, subset: str, box_subset: str, evaluation_only: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """``(images, conflicts)`` of a release.

    ``annotated``: (file, annotations) of ``subset``; ``boxes``: (file, fdi) of every tooth of ``box_subset``; ``index``: (subset, file, sha). Files meet contents by an inner
    join, a file without content being an error. An image has the tooth inventory of the box files with its bytes; where such
    copies disagree it has none, and is a conflict. ``copies_in``: the other subsets with its bytes; ``training_copies``: those but ``evaluation_only``.
    """
    of = lambda name: index.filter(F.col("subset") == name).select("file", "sha")
    for rows, name in ((annotated, subset), (boxes, box_subset)):
        lost = rows.select("file").distinct().join(of(name), "file", "left_anti").orderBy("file").limit(3).collect()
        if lost:
            raise UnreadableAnnotation(f"annotated but not in the release: {[r.file for r in lost]}")
    teeth = boxes.join(of(box_subset), "file").groupBy("sha", "file").agg(F.sort_array(F.collect_set("fdi")).alias("teeth"))
    per = teeth.groupBy("sha").agg(F.count_distinct("teeth").alias("kinds"), F.min("teeth").alias("teeth"))
    conflicts = per.filter("kinds > 1").select("sha", F.lit("copies have different inventories").alias("reason"))
    places = index.groupBy("sha").agg(F.sort_array(F.collect_set("subset")).alias("all"))
    rows = annotated.join(of(subset), "file").join(per.filter("kinds = 1").select("sha", F.col("teeth").alias("teeth_present")), "sha", "left").join(places, "sha")
    others = F.array_except("all", F.array(F.lit(subset)))
    training = F.array_except(others, F.array(*map(F.lit, evaluation_only)).cast("array<string>"))
    return rows.select("file", "sha", "annotations", "teeth_present", others.alias("copies_in"), training.alias("training_copies")), conflicts
