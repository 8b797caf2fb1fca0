"""COCO and YOLO detection data as tables, both ways, and their parity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COCO = """images array<struct<id:long,file_name:string,width:double,height:double,contributor:string,batch_id:string>>,
annotations array<struct<id:long,image_id:long,category_id:int,bbox:array<double>,score:double>>, categories array<struct<id:int,name:string>>"""
BOX = "array<struct<x_center:double,y_center:double,width:double,height:double,class_id:int,class_name:string,confidence:double>>"


def read_coco(spark: SparkSession, path: str, contributor: str | None = None) -> DataFrame:
    """(image_id, file_name, width, height, contributor, batch_id, boxes): every image, with its boxes of four numbers only,
    centres and sizes relative to the image, category names or 'unknown'."""
    doc = spark.read.schema(COCO).option("multiLine", True).json(path)
    images = doc.select(F.inline("images")).withColumnRenamed("id", "image_id")
    names = doc.select(F.inline("categories")).select(F.col("id").alias("category_id"), "name")
    notes = doc.select(F.inline("annotations")).where(F.size("bbox") == 4).drop("id")
    notes = notes.join(names, "category_id", "left").join(images.select("image_id", F.col("width").alias("w"), F.col("height").alias("h")), "image_id")
    b = F.col("bbox")
    box = F.struct(((b[0] + b[2] / 2) / F.col("w")).alias("x_center"), ((b[1] + b[3] / 2) / F.col("h")).alias("y_center"), (b[2] / F.col("w")).alias("width"), (b[3] / F.col("h")).alias("height"), F.col("category_id").alias("class_id"), F.coalesce("name", F.lit("unknown")).alias("class_name"), F.coalesce("score", F.lit(1.0)).alias("confidence"))
    boxes = notes.groupBy("image_id").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    out = images.join(boxes, "image_id", "left").withColumn("boxes", F.coalesce("boxes", F.expr(f"cast(array() as {BOX})")))
    return out.withColumn("contributor", F.coalesce("contributor", F.lit(contributor or "unknown")))


def read_yolo(spark: SparkSession, root: str, names: dict[int, str] | None = None, images: str = "images", labels: str = "labels") -> DataFrame:
    """(stem, boxes): every image of the folder; lines of five numbers or more, the sixth a confidence (default 1)."""
    stem = lambda c: F.regexp_extract(c, r"([^/]+)\.[^./]+$", 1)
    pics = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jpg,jpeg,png,bmp}").load(f"{root}/{images}").select(stem(F.col("path")).alias("stem"))
    lines = spark.read.text(f"{root}/{labels}", recursiveFileLookup=True).select(stem(F.col("_metadata.file_path")).alias("stem"), F.split(F.trim("value"), r"\s+").alias("v")).where(F.size("v") >= 5)
    known = F.create_map(*[F.lit(x) for kv in (names or {-1: ""}).items() for x in kv])
    n = lambda i: F.col("v")[i].cast("double")
    cls = F.col("v")[0].cast("double").cast("int")
    box = F.struct(n(1).alias("x_center"), n(2).alias("y_center"), n(3).alias("width"), n(4).alias("height"), cls.alias("class_id"), F.coalesce(F.try_element_at(known, cls), F.concat(F.lit("class_"), cls.cast("string"))).alias("class_name"), F.when(F.size("v") > 5, F.try_element_at("v", F.lit(6)).cast("double")).otherwise(1.0).alias("confidence"))
    boxes = lines.groupBy("stem").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    return pics.join(boxes, "stem", "left").withColumn("boxes", F.coalesce("boxes", F.expr(f"cast(array() as {BOX})")))


def read_names(text: str) -> dict[int, str]:
    """Class names of a data.yaml: 'names: [a, b]', 'names:' with '- a' lines, or with '0: a' lines."""
    out: dict[int, str] = {}
    inside = False
    for line in text.splitlines():
        s = line.strip()
        if s.startswith("names:"):
            inside, rest = True, s[6:].strip()
            if rest.startswith("["):
                return {i: x.strip().strip("'\"") for i, x in enumerate(rest.strip("[]").split(",")) if x.strip()}
        elif inside and s.startswith("- "):
            out[len(out)] = s[2:].strip().strip("'\"")
        elif inside and ":" in s and s.split(":")[0].strip().isdigit():
            k, v = s.split(":", 1)
            out[int(k)] = v.strip().strip("'\"")
        elif inside and s and not line.startswith((" ", "\t")):
            break
    return out


def write_yolo(df: DataFrame, path: str, stem: str = "stem") -> None:
    """One text file folder per stem: 'class x y w h confidence' lines."""
    line = F.transform("boxes", lambda b: F.concat_ws(" ", b["class_id"].cast("string"), b["x_center"].cast("string"), b["y_center"].cast("string"), b["width"].cast("string"), b["height"].cast("string"), b["confidence"].cast("string")))
    df.select(F.col(stem).alias("stem"), F.explode(line).alias("value")).write.partitionBy("stem").text(path)


def load(spark: SparkSession, path: str, kind: str = "auto", **options) -> DataFrame:
    """Reads by kind; 'auto' takes .json for COCO and anything else for a YOLO folder; an unknown kind raises."""
    if kind == "auto":
        kind = "coco" if path.endswith(".json") else "yolo"
    if kind not in ("coco", "yolo"):
        raise ValueError(f"unknown format {kind!r}")
    return (read_coco if kind == "coco" else read_yolo)(spark, path, **options)


def parity(a: DataFrame, b: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """(stem, status) of two (stem, boxes) tables: same, only_a, only_b, count, boxes."""
    close = lambda x, y: (F.abs(x["x_center"] - y["x_center"]) <= tolerance) & (F.abs(x["y_center"] - y["y_center"]) <= tolerance) & (F.abs(x["width"] - y["width"]) <= tolerance) & (F.abs(x["height"] - y["height"]) <= tolerance) & (x["class_id"] == y["class_id"])
    j = a.select("stem", F.array_sort("boxes").alias("ba")).join(b.select("stem", F.array_sort("boxes").alias("bb")), "stem", "full_outer")
    same = F.forall(F.zip_with("ba", "bb", close), lambda x: F.coalesce(x, F.lit(False)))
    return j.select("stem", F.when(F.col("bb").isNull(), "only_a").when(F.col("ba").isNull(), "only_b").when(F.size("ba") != F.size("bb"), "count").when(same, "same").otherwise("boxes").alias("status"))


def corners(b: Column) -> dict[str, Column]:
    """x1, y1, x2, y2 of a centre box."""
    return {"x1": b["x_center"] - b["width"] / 2, "y1": b["y_center"] - b["height"] / 2, "x2": b["x_center"] + b["width"] / 2, "y2": b["y_center"] + b["height"] / 2}


def nms(df: DataFrame, image: str = "image_id", threshold: float = 0.5) -> DataFrame:
    """Greedy suppression within class over rows (image, class_id, score, x1, y1, x2, y2)."""
    import pandas as pd

    def keep(g: pd.DataFrame) -> pd.DataFrame:
        g, out = g.sort_values("score", ascending=False, kind="stable"), []
        while len(g):
            top = g.iloc[0]
            out.append(top)
            w = (g[["x2"]].clip(upper=top.x2).x2 - g[["x1"]].clip(lower=top.x1).x1).clip(lower=0)
            h = (g[["y2"]].clip(upper=top.y2).y2 - g[["y1"]].clip(lower=top.y1).y1).clip(lower=0)
            area = lambda r: (r.x2 - r.x1) * (r.y2 - r.y1)
            over = w * h / (area(g) + area(top) - w * h)
            g = g[(over <= threshold).values & (pd.RangeIndex(len(g)) > 0)]
        return pd.DataFrame(out, columns=g.columns)

    return df.groupBy(image, "class_id").applyInPandas(keep, df.schema)


def read_manifests(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """manifest.json files under root, one row each with its folder; unreadable ones have nulls."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").load(root)
    return f.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("dir"), F.sha2("content", 256).alias("sha256"), F.from_json(F.col("content").cast("string"), schema).alias("manifest"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A registry of one JSON object a line; blank lines are skipped, malformed lines raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_archives(spark: SparkSession, path: str, member: str = "manifest.json", most: int = 1 << 20) -> DataFrame:
    """(archive, name, size, sha256, content) of every file in tar archives under path, streamed and not unpacked.

    content stands for members named ``member`` of at most ``most`` bytes; digests cover whole members.  An archive that
    can't be read has one row with null name.
    """
    import hashlib
    import io
    import tarfile
    from collections.abc import Iterator

    import pandas as pd

    columns = ["archive", "name", "size", "sha256", "content"]

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for archive, data in zip(part["path"], part["content"], strict=True):
                rows = []
                try:
                    with tarfile.open(fileobj=io.BytesIO(data), mode="r|*") as t:
                        for m in t:
                            if not m.isfile():
                                continue
                            f, h, kept = t.extractfile(m), hashlib.sha256(), b""
                            named = m.name.rsplit("/", 1)[-1] == member and m.size <= most
                            while chunk := f.read(1 << 20):
                                h.update(chunk)
                                kept += chunk if named else b""
                            rows.append((archive, m.name, m.size, h.hexdigest(), kept.decode("utf-8", "replace") if named else None))
                except (tarfile.TarError, EOFError, OSError):
                    rows = [(archive, None, None, None, None)]
                yield pd.DataFrame(rows, columns=columns)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInPandas(scan, "archive string, name string, size long, sha256 string, content string")


def best_folder(wanted: DataFrame, files: DataFrame, name: str = "file_name", folder: str = "folder") -> DataFrame:
    """The folder that holds most of the wanted file names, ties to the smaller path: (folder, hits)."""
    hits = files.join(wanted.select(name).distinct(), name, "left_semi").groupBy(folder).agg(F.countDistinct(name).alias("hits"))
    return hits.orderBy(F.desc("hits"), folder).limit(1)
