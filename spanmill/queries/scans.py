"""Files: tables are written in the formats around masks, then read by the readers; and masks that arrive as a stream."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from spanmill.operators import geometry, match, rle
from spanmill.plans.session import shared_path, table
from spanmill.queries.base import RECTS, Registry, m1d, rects, rnd
from spanmill.queries.masks import _SUMS, _text, rle_encode
from spanmill.queries.objects import _SIDES, _pairs
from spanmill.sources import files
from spanmill.streaming import arrivals

_r = Registry()
QUERIES, SQL = _r.queries, _r.sql
query = _r.query


@query(_text("truth = 1") + " SELECT CAST(slide AS VARCHAR) AS id, string_agg(lo + 1 || ' ' || hi - lo, ' ' ORDER BY lo) AS encoding, 'part' || slide % 3 AS source FROM runs GROUP BY slide")
def scan_csv_with_source(spark, sf):
    """A file of masks per folder, read as one table with the file of each row."""
    base = shared_path(spark, "masks")
    rows = rle_encode(spark, sf).select(F.col("slide").cast("string").alias("id"), F.col("rle").alias("encoding"), (F.col("slide") % 3).alias("k"))
    for k in range(3):
        rows.filter(F.col("k") == k).select("id", "encoding").write.option("header", True).csv(f"{base}/part{k}")
    read = files.read_csv(spark, [f"{base}/part{k}" for k in range(3)], "train", data_path=True)
    return read.select("id", "encoding", F.regexp_extract("data_path", r"/(part\d)/", 1).alias("source"))


@query(_SIDES + ", m AS (SELECT 2.0 * inter / (aa + ab) AS dice, inter / CAST(ab AS DOUBLE) AS recall, inter / CAST(aa AS DOUBLE) AS precision FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY 2.0 * inter / (aa + ab) DESC, b) = 1) SELECT round(dice, 6) AS dice, round(recall, 6) AS recall, round(precision, 6) AS precision FROM m WHERE dice >= 0.2 AND dice < 0.999")
def score_lines(spark, sf):
    """Scores of revised objects written as lines and read again."""
    scored = match.best_match(_pairs(spark, sf).withColumn("dice", 2.0 * F.col("inter") / (F.col("aa") + F.col("ab"))), "a", "b", "dice")
    rows = scored.select("dice", (F.col("inter") / F.col("ab")).alias("recall"), (F.col("inter") / F.col("aa")).alias("precision"), match.classify(F.col("dice"), 0.2).alias("kind"))
    files.write_scores(rows, path := shared_path(spark, "scores"))
    return files.read_scores(spark, path).select(*[rnd(F.col(c)).alias(c) for c in ("dice", "recall", "precision")])


@query(f"WITH {RECTS} SELECT 'glomerulus' AS name, x0 AS min_x, y0 AS min_y, CAST(5 AS BIGINT) AS vertices, CAST(1 AS BIGINT) AS parts FROM rects")
def scan_geojson(spark, sf):
    """A list of features per slide written to a file each, and read feature by feature."""
    ring = geometry.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    texts = files.geojson_text(rects(spark, sf).select("slide", "id", ring.alias("ring")), ["slide"])
    texts.select("geojson").write.option("maxRecordsPerFile", 1).text(path := shared_path(spark, "features"))
    read = files.read_geojson(spark, path).withColumn("p", F.get("parts", F.lit(0)))
    low = lambda k: F.array_min(F.transform("p", lambda q: q[k])).cast("long")
    return read.select("name", low("x").alias("min_x"), low("y").alias("min_y"), F.size("p").cast("long").alias("vertices"), F.size("parts").cast("long").alias("parts"))


@query("SELECT 'a' || n_regionkey % 2 || '.zip' AS archive, 'r' || n_regionkey || '/' || n_name || '.txt' AS member, CAST(length(n_name) AS BIGINT) AS bytes FROM nation")
def scan_zip(spark, sf):
    """Archives of small files; folders and foreign members are left out."""
    base = shared_path(spark, "archives")
    rows = table(spark, sf, "nation").select("n_regionkey", "n_name").collect()  # 25 rows, to make two archives of
    for k in (0, 1):
        with zipfile.ZipFile(held := io.BytesIO(), "w") as z:
            z.mkdir("r0")
            z.writestr("__MACOSX/r0/x", b"x")
            for r in rows:
                if r["n_regionkey"] % 2 == k:
                    z.writestr(f"r{r['n_regionkey']}/{r['n_name']}.txt", r["n_name"])
        files.write_bytes(spark, f"{base}/a{k}.zip", held.getvalue())
    return files.read_zip(spark, base).select(F.element_at(F.split("archive", "/"), -1).alias("archive"), "member", F.octet_length("data").cast("long").alias("bytes"))


@query("SELECT CAST(c_nationkey AS BIGINT) AS folder, CAST(sum(length(c_name) + 1) AS BIGINT) AS bytes FROM customer WHERE c_nationkey <> 4 GROUP BY 1")
def scan_listing(spark, sf):
    """Files below a folder by pattern, without those with a banned part: names in a folder per nation, of which one is banned."""
    base = shared_path(spark, "listing")
    table(spark, sf, "customer").select("c_nationkey", "c_name").repartition("c_nationkey").write.partitionBy("c_nationkey").text(base)
    found = files.list_files(spark, base, "*.txt", ("c_nationkey=4/",))
    return found.groupBy(F.regexp_extract("path", r"c_nationkey=(\d+)/", 1).cast("long").alias("folder")).agg(F.sum("length").cast("long").alias("bytes"))


@query("SELECT c_name AS Donor_ID, c_acctbal AS Age, CAST(c_nationkey AS DOUBLE) AS BMI FROM customer")
def cohort_file(spark, sf):
    """A cohort table written with header and read in its layout."""
    layout = "Donor_ID STRING, Age DOUBLE, BMI DOUBLE"
    files.write_cohort(table(spark, sf, "customer").select(F.col("c_name").alias("Donor_ID"), F.col("c_acctbal").alias("Age"), F.col("c_nationkey").cast("double").alias("BMI")), path := shared_path(spark, "cohort"))
    return files.read_csv(spark, path, layout)


@query(_SUMS + " SELECT CAST(slide AS VARCHAR) AS id, round((2 * i + 1e-8) / (p + t + 1e-8), 6) AS dice FROM s")
def stream_scores(spark, sf):
    """Masks that arrive as files are scored batch by batch."""
    px = m1d(spark, sf)
    base = shared_path(spark, "arrivals")
    text = lambda c, n: rle.spans_to_text(rle.encode_spans(px.filter(F.col(c) == 1), ["slide"]), ["slide"], n)
    masks = px.select("slide").distinct().join(text("pred", "predicted"), "slide", "left").join(text("truth", "expected"), "slide", "left")
    masks.select(F.col("slide").cast("string").alias("id"), "predicted", "expected").repartition(3, "id").write.parquet(f"{base}/in")
    arrivals.score_arrivals(arrivals.read_masks(spark, f"{base}/in", 1), f"{base}/out", f"{base}/progress").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("id", rnd(F.col("dice")).alias("dice"))
