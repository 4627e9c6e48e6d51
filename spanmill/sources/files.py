"""Readers and writers of the tables around masks. Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmill.operators.cohort import template_update
from spanmill.plans.session import shared_path

#: The layouts of the tables.
SCHEMAS = {
    "train": "id STRING, encoding STRING",
    "submission": "id STRING, predicted STRING",
    "slides": "image_file STRING, width_pixels INT, height_pixels INT, patient_number INT",
    "cohort": "Kaggle_ID STRING, Donor_ID STRING, Race STRING, Sex STRING, Tissue_Preservation_Method STRING, Age DOUBLE, Weight_kg DOUBLE, Height_cm DOUBLE, BMI DOUBLE, Number_of_Glomeruli DOUBLE",
    "tile_stats": "filename_img STRING, filename_rle STRING, num_masked_pixels BIGINT, ratio_masked_area DOUBLE, std_img DOUBLE",
    "roi_stats": "idx STRING, index INT, cy DOUBLE, cx DOUBLE, left INT, top INT, width INT, height INT, area INT",
    "scores": "dice DOUBLE, recall DOUBLE, precision DOUBLE",
    "consensus": "method STRING, file STRING, exp STRING, iou DOUBLE",
}


def read_csv(spark: SparkSession, paths: str | list[str], layout: str, header: bool = True, data_path: bool = False) -> DataFrame:
    """CSV of a known layout; several paths are one scan; data_path adds the file of each row. Bad rows are an error."""
    out = spark.read.schema(SCHEMAS.get(layout, layout)).option("header", header).option("mode", "FAILFAST").csv(paths)
    return out.withColumn("data_path", F.input_file_name()) if data_path else out


def read_scores(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of dice, recall, precision without header; lines of at most one character are skipped."""
    lines = spark.read.text(paths).filter(F.length("value") > 1)
    parts = F.split("value", ",")
    return lines.select(*[F.get(parts, F.lit(k)).cast("double").alias(c) for k, c in enumerate(("dice", "recall", "precision"))])


def read_geojson_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """As read_geojson(), of files that hold a list of features per line."""
    return read_geojson(spark, paths, whole=False)


def read_geojson(spark: SparkSession, paths: str | list[str], whole: bool = True) -> DataFrame:
    """file, pos, name, parts: one row per feature; parts are the first rings of a polygon or multipolygon.

    Coordinates are read as text first and parsed by the geometry's type, since one schema can't
    hold both depths. A feature without class has a null name. whole: a file is one list, else each line is.
    """
    feature = "array<struct<type:string,id:string,geometry:struct<type:string,coordinates:string>,properties:struct<classification:struct<name:string,colorRGB:bigint>>>>"
    text = spark.read.text(paths, wholetext=whole).select(F.input_file_name().alias("file"), F.from_json("value", feature).alias("f"))
    rows = text.select("file", F.posexplode("f").alias("pos", "f")).select("file", "pos", F.col("f.properties.classification.name").alias("name"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"))
    polygon, multi = F.from_json("c", "array<array<array<double>>>"), F.from_json("c", "array<array<array<array<double>>>>")
    parts = F.when(F.col("kind") == "MultiPolygon", F.transform(multi, lambda p: F.get(p, F.lit(0)))).otherwise(F.slice(polygon, 1, 1))
    points = F.transform(parts, lambda ring: F.transform(ring, lambda q: F.struct(F.get(q, F.lit(0)).alias("x"), F.get(q, F.lit(1)).alias("y"))))
    return rows.select("file", F.col("pos").cast("long").alias("pos"), "name", points.alias("parts"))


def geojson_text(objects: DataFrame, keys: list[str], ring: str = "ring", name: str = "glomerulus") -> DataFrame:
    """keys, geojson: all objects of a key as one list of features, in the order of their rings."""
    points = F.transform(ring, lambda q: F.array(q["x"], q["y"]))
    feature = F.struct(F.lit("Feature").alias("type"), F.lit("PathAnnotationObject").alias("id"), F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates")).alias("geometry"), F.struct(F.struct(F.lit(name).alias("name"), F.lit(-3140401).alias("colorRGB")).alias("classification"), F.lit(True).alias("isLocked"), F.array().cast("array<string>").alias("measurements")).alias("properties"))
    return objects.groupBy(*keys).agg(F.to_json(F.sort_array(F.collect_list(feature))).alias("geojson"))


def list_files(spark: SparkSession, path: str, pattern: str = "*", banned: tuple[str, ...] = ()) -> DataFrame:
    """path, length of the files below a folder by glob, without those whose path holds a banned string; none is an error."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length")
    for b in banned:
        found = found.filter(~F.col("path").contains(b))
    if found.isEmpty():
        raise FileNotFoundError(f"{path} has no {pattern}")
    return found


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """archive, member, data: the files in ZIP archives, without folders and __MACOSX. One archive is read by one task."""
    schema = "archive string, member string, data binary"

    def members(batches):
        import io
        import zipfile

        import pandas as pd

        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in z.infolist():
                        if not m.is_dir() and "__MACOSX" not in m.filename:
                            yield pd.DataFrame({"archive": [p], "member": [m.filename], "data": [z.read(m)]})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content").mapInPandas(members, schema)


def write_submission(rows: DataFrame, path: str) -> None:
    """id, predicted as CSV with header."""
    rows.select("id", "predicted").write.mode("overwrite").option("header", True).csv(path)


def append_log(rows: DataFrame, path: str, schema: T.StructType) -> None:
    """Append rows to a CSV log whose columns are fixed; other columns are an error."""
    if rows.columns != schema.fieldNames():
        raise ValueError(f"the log has columns {schema.fieldNames()}, not {rows.columns}")
    rows.write.mode("append").option("header", True).csv(path)


def append_run(rows: DataFrame, path: str) -> None:
    """Append rows to an experiment log, or begin it; they may lack columns that it has, and have others."""
    rows.write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """An experiment log with the columns of all its rows, null where a row lacks one; a column of two types is an error."""
    return spark.read.option("mergeSchema", True).parquet(path)


def read_wide_labels(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """name, label, value of CSV files whose header names the labels after the first column: a row per name and label, null where nothing is told."""
    wide = spark.read.option("header", True).csv(path)
    name, *labels = wide.columns
    long = wide.unpivot([name], labels, "label", "value")
    return long.select(F.col(name).alias("name"), "label", F.trim("value").cast("int").alias("value"))


def round_trip(template: DataFrame) -> DataFrame:
    """Write id, predicted; append a row; update even ids; read all back."""
    spark = template.sparkSession
    path = shared_path(spark, "submission")
    kind = T.StructType([T.StructField("id", T.LongType()), T.StructField("predicted", T.StringType())])
    append_log(template, path, kind)
    append_log(spark.createDataFrame([(-1, "added")], kind), path, kind)
    held = spark.read.schema(kind).option("header", True).csv(path)
    return template_update(held, held.filter("id % 2 = 0").withColumn("predicted", F.concat(F.lit("new "), "predicted")), "id", "predicted").select("id", "predicted")


def write_scores(rows: DataFrame, path: str) -> None:
    """dice, recall, precision of the pairs that were revised, as lines without header; pairs that stayed the same are left out."""
    rows.filter(F.col("kind") == "revised").select("dice", "recall", "precision").write.mode("overwrite").csv(path)


def write_cohort(rows: DataFrame, path: str) -> None:
    """A cohort table as CSV with header, all columns it has."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, as an archive or a list made on the driver, on any file system that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(data))
    out.close()
