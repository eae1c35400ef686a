"""Manifests, listings and the dataset contract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.keys import file_stem

# fixed values: class folder names and their codes
CLASS_DIRS = {"불꽃": "fl", "연기": "sm", "정상": "none"}
IMAGE_EXT = r"(?i)\.(jpg|jpeg|png|bmp|webp)$"


def manifest(paths: DataFrame) -> DataFrame:
    """``…/class/place/clip/JSON/name.json`` paths to manifest rows; content is never read."""
    part = F.split("path", "/")
    at = lambda i: F.try_element_at(part, F.lit(i))
    stem = file_stem(F.col("path"))
    tail = F.element_at(F.split(stem, "_"), -1)
    frame = F.when(tail.rlike(r"^\d+$"), tail.try_cast("int")).otherwise(-1)
    codes = F.create_map(*[F.lit(v) for kv in CLASS_DIRS.items() for v in kv])
    return (
        paths.filter(F.col("path").endswith(".json"))
        .select("path", at(-5).alias("cls_kr"), at(-4).alias("place_kr"), at(-3).alias("clip"), stem.alias("stem"), frame.alias("frame"))
        .select(
            "cls_kr", F.coalesce(F.element_at(codes, F.col("cls_kr")), F.lit("?")).alias("cls_code"), "place_kr", "clip", "frame", "stem",
            F.col("path").alias("json_path"),
            F.concat_ws("\\", "cls_kr", "place_kr", "clip", F.lit("JPG"), F.concat("stem", F.lit(".jpg"))).alias("img_rel"),
        )
    )


def manifest_stats(rows: DataFrame, cls: str = "cls_kr", place: str = "place_kr", clip: str = "clip") -> DataFrame:
    """Counts in total, per class and per place, and distinct (class, clip), in one pass.

    Distinct pairs are pre-aggregated per (class, place, clip), so the rollup
    only sees one row per clip.
    """
    clips = rows.groupBy(cls, place, clip).agg(F.count(F.lit(1)).alias("_n"))
    return (
        clips.groupingSets([[], [cls], [place]], cls, place)
        .agg(
            F.sum("_n").alias("rows"),
            F.countDistinct(F.struct(cls, clip)).alias("clips"),
            F.grouping_id().alias("level"),
        )
        .select("level", cls, place, "rows", "clips")
    )


def listing(paths: DataFrame) -> DataFrame:
    """Media files of a tree: images outside infrared and thermal folders, and videos."""
    p = F.col("path")
    image = p.rlike(IMAGE_EXT) & ~p.rlike("(?i)infrared|thermal")
    video = p.rlike(r"(?i)\.mp4$")
    return paths.withColumn("kind", F.when(image, "image").when(video, "video")).filter(F.col("kind").isNotNull())


def sampled_listing(files: DataFrame, keys: Sequence[str], limit: int, bucket: Column) -> DataFrame:
    """At most ``limit`` evenly spaced images per category; videos are never cut."""
    from ..operators.curation import pick_even

    images = pick_even(files.filter("kind = 'image'"), keys, ["path"], bucket, limit)
    return images.unionByName(files.filter("kind = 'video'"))


CONTRACT_SCHEMA = "category string, mode string, media string, gt string, classes map<string,string>, use string, note string"

# fixed values: words in a category name that mean people
PERSON_WORDS = r"(?i)사람|침입|쓰러짐|배회|스토킹|이상행동|다각도|person|human|llvip|flir"


def guess_mode(category: Column) -> Column:
    return F.when(category.rlike(PERSON_WORDS), "person").otherwise("fire")


def probe(files: DataFrame) -> DataFrame:
    """Media kind and label format per category from file names and text heads.

    ``files`` has ``category, path`` and, for text files, ``head`` (the first
    few thousand characters).  XML markers come before JSON, JSON before txt.
    """
    p, head = F.col("path"), F.coalesce("head", F.lit(""))
    xml, js, txt = p.rlike(r"(?i)\.xml$"), p.rlike(r"(?i)\.json$"), p.rlike(r"(?i)\.txt$")
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    seen = files.groupBy("category").agg(
        has(p.rlike(r"(?i)\.mp4$")).alias("video"),
        has(xml & (head.contains("<keypoint>") | head.contains("<objectname>"))).alias("point_xml"),
        has(xml & (head.contains("<Alarm") | head.contains("StartTime"))).alias("event_xml"),
        has(xml & head.contains("<annotation>") & head.contains("<object>")).alias("voc_xml"),
        has(js & head.contains('"videos"') & head.contains('"annotations"')).alias("multiview_json"),
        has(js & head.contains('"event_frame"')).alias("span_json"),
        has(js & head.contains('"images"') & head.contains('"annotations"')).alias("coco_json"),
        has(txt).alias("yolo_txt"),
    )
    order = ("point_xml", "event_xml", "voc_xml", "multiview_json", "span_json", "coco_json", "yolo_txt")
    gt = F.lit("none")
    for name in reversed(order):
        gt = F.when(F.col(name), name).otherwise(gt)
    return seen.select("category", F.when(F.col("video"), "video").otherwise("image").alias("media"), gt.alias("gt"))


def resolve_contract(categories: DataFrame, written: DataFrame, probed: DataFrame) -> DataFrame:
    """The written contract first, then what probing found, then defaults."""
    w = written.select("category", F.struct("mode", "media", "gt", "classes", "use").alias("_w"))
    q = probed.select("category", F.struct("media", "gt").alias("_q"))
    c = categories.select("category").distinct().join(w, "category", "left").join(q, "category", "left")
    return c.select(
        "category", F.coalesce("_w.mode", guess_mode(F.col("category"))).alias("mode"),
        F.coalesce("_w.media", "_q.media", F.lit("video")).alias("media"), F.coalesce("_w.gt", "_q.gt", F.lit("none")).alias("gt"),
        F.col("_w.classes").alias("classes"), F.coalesce("_w.use", F.lit("train")).alias("use"),
    )


def parse_contract(text: str) -> dict[str, dict]:
    """The written contract: categories with their fields, as YAML."""
    try:
        import yaml
    except ImportError as missing:
        raise ImportError("a contract in YAML needs the yaml package; use JSON lines instead") from missing
    found = yaml.safe_load(text) or {}
    if not isinstance(found, dict):
        raise ValueError("a contract maps categories to their fields")
    return {str(category): dict(fields or {}) for category, fields in found.items()}


def contract_text(contract: dict[str, dict]) -> str:
    import yaml

    return yaml.safe_dump(contract, allow_unicode=True, sort_keys=True, default_flow_style=None)


def changed_contract(text: str, category: str, **fields) -> str:
    """The contract with fields of one category set; a field set to None is taken out."""
    contract = parse_contract(text)
    own = {**contract.get(category, {}), **fields}
    return contract_text({**contract, category: {k: v for k, v in own.items() if v is not None}})


def contract_table(spark: SparkSession, text: str) -> DataFrame:
    """A row per category, as ``resolve_contract`` takes it; class keys and values become text."""
    text_of = lambda v: None if v is None else str(v)
    rows = [
        (category, *[text_of(f.get(c)) for c in ("mode", "media", "gt")], {str(k): str(v) for k, v in f["classes"].items()} if f.get("classes") else None,
         text_of(f.get("use")), text_of(f.get("note")))
        for category, f in parse_contract(text).items()
    ]
    return spark.createDataFrame(rows, CONTRACT_SCHEMA)


def read_contract(spark: SparkSession, path: str) -> DataFrame:
    """The contract as YAML (``.yaml``, ``.yml``) or as JSON lines.  It has a line per category and is read whole."""
    if path.lower().endswith((".yaml", ".yml")):
        return contract_table(spark, spark.read.text(path, wholetext=True).first()["value"])
    return spark.read.schema(CONTRACT_SCHEMA).json(path)
