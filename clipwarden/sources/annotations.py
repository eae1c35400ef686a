"""Ground truth and labels from their many file formats.

Every parser takes documents (``text`` plus key columns) and returns typed
rows; ``text.read_documents`` provides the documents.  Boxes come out
normalised, top-left ``x, y, w, h``, in the class convention of
``functions.keys.map_class``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import timecode as T
from ..functions.keys import map_class, named_class
from .text import elements, leaf

_XYWH = ("x", "y", "w", "h")


def _round5(*cols: Column) -> list[Column]:
    return [F.bround(c, 5).alias(n) for c, n in zip(cols, _XYWH)]


# ---- events ---------------------------------------------------------------------


def event_xml(docs: DataFrame, keys: Sequence[str] = ("clip",), default_dur: float | None = 10.0) -> DataFrame:
    """First alarm of a document: start and duration in seconds, NULL without one."""
    first = F.get(elements(F.col("text"), "Alarm"), 0)
    dur = T.hms_to_s(leaf(first, "AlarmDuration")).cast("double")
    if default_dur is not None:
        dur = F.when(dur > 0, dur).otherwise(float(default_dur))
    start = T.hms_to_s(leaf(first, "StartTime"), None).cast("double")
    return docs.select(*keys, start.alias("start_s"), F.when(first.isNotNull(), dur).alias("dur_s"))


def alarm_spans(docs: DataFrame, keys: Sequence[str] = ("clip",)) -> DataFrame:
    """Every alarm with a start: ``start_s, dur_s, kind``; short clock texts are padded."""
    spans = F.transform(
        elements(F.col("text"), "Alarm"),
        lambda a: F.struct(
            T.clock_to_s(leaf(a, "StartTime")).alias("start_s"),
            T.clock_to_s(F.coalesce(leaf(a, "AlarmDuration"), F.lit("0:0:0"))).alias("dur_s"),
            F.coalesce(leaf(a, "AlarmDescription"), F.lit("")).alias("kind"),
        ),
    )
    return docs.select(*keys, F.posexplode(spans).alias("pos", "_s")).select(*keys, "pos", "_s.*").filter(
        F.col("start_s").isNotNull()
    )


def earliest_alarm(docs: DataFrame, keys: Sequence[str] = ("clip",)) -> DataFrame:
    starts = F.transform(elements(F.col("text"), "Alarm"), lambda a: T.clock_to_s(leaf(a, "StartTime")))
    return docs.select(*keys, F.array_min(F.array_compact(starts)).alias("start_s"))


_SPAN_JSON = """struct<annotations:struct<event_frame:array<array<double>>,event_class:string,event_caption:string>>"""


def span_json(docs: DataFrame, keys: Sequence[str] = ("clip",), fps: str = "fps") -> DataFrame:
    """Frame spans to whole seconds, half-even."""
    j = docs.withColumn("_j", F.from_json("text", _SPAN_JSON)).select(
        *keys, F.coalesce(F.nullif(F.col(fps), F.lit(0.0)), F.lit(30.0)).alias("_fps"), "_j.annotations.*"
    )
    f = j.select("*", F.posexplode("event_frame").alias("pos", "_f")).filter(F.size("_f") > 0)
    s0 = F.get("_f", 0) / F.col("_fps")
    e0 = F.coalesce(F.get("_f", 1) / F.col("_fps"), s0)
    return f.select(
        *keys, "pos", F.bround(s0).cast("int").alias("start_s"),
        F.greatest(F.bround(e0 - s0).cast("int"), F.lit(0)).alias("dur_s"),
        F.coalesce("event_class", F.lit("event")).alias("kind"), F.coalesce("event_caption", F.lit("")).alias("note"),
    )


def conditions(docs: DataFrame, keys: Sequence[str] = ("clip",)) -> DataFrame:
    """Recording conditions; documents with neither a time of day nor an alarm are skipped."""
    x = F.col("text")
    value = lambda tag: F.coalesce(leaf(x, tag), F.lit(""))
    first = F.get(elements(x, "Alarm"), 0)
    return docs.filter((value("TimeOfDay") != "") | first.isNotNull()).select(
        *keys, value("TimeOfDay").alias("tod"), value("Snow").alias("snow"), value("Rain").alias("rain"),
        value("Fog").alias("fog"), value("Location").alias("loc"),
        T.hms_to_s(leaf(first, "StartTime"), None).alias("start_s"),
    )


def weather_tags(cond: DataFrame) -> Column:
    """Weather fields that say anything but no."""
    said = lambda c: F.when(~F.lower(F.col(c)).isin("", "no", "none"), F.lit(c))
    return F.array_compact(F.array(said("snow"), said("fog"), said("rain")))


# ---- points, actions, zones ----------------------------------------------------------

_POINT_XML = """struct<size:struct<width:int,height:int>,header:struct<fps:double>,object:array<struct<objectname:string,{}>>>"""
_POSITIONS = "position:array<struct<keyframe:int,keypoint:struct<x:double,y:double>>>"
_ACTIONS = "action:array<struct<actionname:string,frame:array<struct<start:double,end:double>>>>"


def _point_docs(docs: DataFrame, keys: Sequence[str], part: str) -> DataFrame:
    """The objects of each document with ``part`` of what they hold: the parser converts nothing else."""

    def of_objects(x: Column) -> Column:
        whole = [x["size"]["width"].alias("frame_w"), x["size"]["height"].alias("frame_h"), F.coalesce(x["header"]["fps"], F.lit(30.0)).alias("fps")]
        return F.transform(x["object"], lambda o: F.struct(*whole, o.alias("_o")))

    # inside a generator, as filters on the size would move below the parser and parse each document again
    parsed = F.transform(F.array(F.from_xml("text", _POINT_XML.format(part))), of_objects)
    objects = docs.select(*keys, F.posexplode(F.get(parsed, 0)).alias("_i", "_s")).select(*keys, "_i", "_s.*")
    number = F.regexp_extract(F.coalesce("_o.objectname", F.lit("")), r"(\d+)$", 1)
    return objects.withColumn("obj", F.when(number != "", number.try_cast("int")).otherwise(F.col("_i") + 1))


def keyframe_points(docs: DataFrame, keys: Sequence[str] = ("clip",)) -> DataFrame:
    """One normalised point per object and keyframe, on the half-second grid."""
    p = _point_docs(docs, keys, _POSITIONS).select(*keys, "frame_w", "frame_h", "fps", "obj", F.explode("_o.position").alias("_p"))
    seen = F.col("_p.keypoint.x").isNotNull() & F.col("_p.keypoint.y").isNotNull()
    return p.filter((F.col("frame_w") > 0) & (F.col("frame_h") > 0) & seen).select(
        *keys, "obj", T.tick(F.col("_p.keyframe") / F.col("fps")).alias("tick"),
        F.bround(F.col("_p.keypoint.x") / F.col("frame_w"), 5).alias("x"),
        F.bround(F.col("_p.keypoint.y") / F.col("frame_h"), 5).alias("y"),
    )


def actions(docs: DataFrame, keys: Sequence[str] = ("clip",)) -> DataFrame:
    """Action spans per object in seconds."""
    a = _point_docs(docs, keys, _ACTIONS).select(*keys, "fps", "obj", F.explode("_o.action").alias("_a"))
    f = a.select(*keys, "fps", "obj", F.col("_a.actionname").alias("action"), F.explode("_a.frame").alias("_f"))
    return f.select(
        *keys, "obj", "action", (F.col("_f.start") / F.col("fps")).alias("start_s"), (F.col("_f.end") / F.col("fps")).alias("end_s")
    )


def zone_maps(docs: DataFrame, tags: Sequence[str], loc: str = "clip") -> DataFrame:
    """Zone polygons: one row per location and tag found."""

    def polygon(tag: str) -> Column:
        body = F.get(elements(F.col("text"), tag), 0)
        points = F.transform(
            elements(body, "Point"),
            lambda p: F.struct(
                F.get(F.split(p, ","), 0).try_cast("double").alias("x"), F.get(F.split(p, ","), 1).try_cast("double").alias("y")
            ),
        )
        return F.when(body.isNotNull(), F.struct(F.lit(tag).alias("tag"), points.alias("poly")))

    rows = F.array_compact(F.array(*[polygon(t) for t in tags]))
    return docs.select(F.col(loc).alias("loc"), F.inline(rows))


# ---- boxes ----------------------------------------------------------------------------


def yolo_txt(docs: DataFrame, contract: DataFrame, keys: Sequence[str] = ("image",)) -> DataFrame:
    """``cls cx cy w h`` lines; shorter lines are skipped.  ``contract`` has category, mode, classes."""
    lines = docs.join(contract, "category").select(
        *keys, "mode", "classes", F.posexplode(F.split("text", r"\r?\n")).alias("line", "_l")
    )
    part = F.split(F.trim("_l"), r"\s+")
    num = lambda i: F.get("_p", i).try_cast("double")
    rows = lines.withColumn("_p", part).filter(F.size("_p") >= 5).select(
        *keys, "mode", "classes", "line", num(0).cast("int").alias("key"), *[num(i).alias(c) for i, c in ((1, "cx"), (2, "cy"), (3, "bw"), (4, "bh"))]
    )
    cls = map_class(F.col("key"), F.lit(None).cast("string"), F.col("mode"), F.col("classes"))
    return rows.select(
        *keys, "line", cls.alias("cls"),
        *_round5(F.col("cx") - F.col("bw") / 2, F.col("cy") - F.col("bh") / 2, F.col("bw"), F.col("bh")),
    ).filter(F.col("cls").isNotNull() & F.col("x").isNotNull())


_COCO = """struct<images:array<struct<id:long,file_name:string,width:double,height:double>>,
annotations:array<struct<image_id:long,category_id:long,bbox:array<double>>>,
categories:array<struct<id:long,name:string>>>"""


def coco_tables(docs: DataFrame, keys: Sequence[str] = ("path",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, annotations and categories of COCO documents as three tables."""
    j = docs.select(*keys, F.from_json("text", _COCO.replace("\n", "")).alias("_j"))
    return (
        j.select(*keys, F.inline("_j.images")),
        j.select(*keys, F.posexplode("_j.annotations").alias("pos", "_a")).select(*keys, "pos", "_a.*"),
        j.select(*keys, F.inline("_j.categories")),
    )


def coco_boxes(
    images: DataFrame, annotations: DataFrame, categories: DataFrame, contract: DataFrame, keys: Sequence[str] = ("path",)
) -> DataFrame:
    """Three-way equi-join to normalised boxes; images without a size give none.

    The tables may come from ``coco_tables`` or from any columnar copy; images
    and annotations join on (document, image id), categories are few.
    """
    named = annotations.join(
        categories.select(*keys, F.col("id").alias("category_id"), F.col("name").alias("_name")), [*keys, "category_id"], "left"
    )
    sized = images.filter((F.col("width") > 0) & (F.col("height") > 0)).select(
        *keys, F.col("id").alias("image_id"), F.element_at(F.split("file_name", "/"), -1).alias("image"), "width", "height", "category"
    )
    rows = named.join(sized, [*keys, "image_id"]).join(contract, "category")
    cls = map_class(F.col("category_id"), F.col("_name"), F.col("mode"), F.col("classes"))
    b = [F.get("bbox", i) for i in range(4)]
    return rows.select(
        *keys, "image", "pos", cls.alias("cls"),
        *_round5(b[0] / F.col("width"), b[1] / F.col("height"), b[2] / F.col("width"), b[3] / F.col("height")),
    ).filter(F.col("cls").isNotNull())


_VOC = """struct<size:struct<width:double,height:double>,object:array<struct<name:string,
bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>>"""


def voc_xml(docs: DataFrame, contract: DataFrame, keys: Sequence[str] = ("image",)) -> DataFrame:
    """Corner boxes of named objects; documents without a size give none."""

    def sized(x: Column) -> Column:
        w, h = x["size"]["width"], x["size"]["height"]
        return F.when((w > 0) & (h > 0), F.transform(x["object"], lambda o: F.struct(w.alias("_w"), h.alias("_h"), o.alias("_o"))))

    # inside a generator, as a filter on the size would move below the parser and parse each document again
    parsed = F.transform(F.array(F.from_xml("text", _VOC.replace("\n", ""))), sized)
    x = docs.join(contract, "category").select(*keys, "mode", "classes", F.posexplode(F.get(parsed, 0)).alias("pos", "_s"))
    o = x.select("*", "_s.*")
    b = F.col("_o.bndbox")
    z = lambda c: F.coalesce(b[c], F.lit(0.0))
    # one row each or none, so that the class is found once
    cls = map_class(F.lit(None).cast("int"), F.coalesce("_o.name", F.lit("")), F.col("mode"), F.col("classes"))
    kept = F.explode(F.array_compact(F.array(cls))).alias("cls")
    return o.filter(b.isNotNull()).select("*", kept).select(
        *keys, "pos", "cls",
        *_round5(z("xmin") / F.col("_w"), z("ymin") / F.col("_h"), (z("xmax") - z("xmin")) / F.col("_w"), (z("ymax") - z("ymin")) / F.col("_h")),
    )


_IMAGE_JSON = """struct<images:array<struct<width:double,height:double>>,categories:array<struct<id:long,name:string>>,
annotations:array<struct<category_id:long,bbox:array<double>>>>"""


def named_json(docs: DataFrame, keys: Sequence[str] = ("image",)) -> DataFrame:
    """Per-image JSON with named categories; an image without usable boxes is a negative.

    Returns one row per image with its ``boxes`` in centre form.
    """
    j = docs.select(*keys, F.from_json("text", _IMAGE_JSON.replace("\n", "")).alias("_j")).filter(F.size("_j.images") > 0)
    w, h = F.get("_j.images", 0)["width"], F.get("_j.images", 0)["height"]
    names = F.map_from_entries(F.transform("_j.categories", lambda c: F.struct(c["id"], c["name"])))

    def box(a: Column) -> Column:
        cls = named_class(F.element_at(names, a["category_id"]))
        b = [F.get(a["bbox"], i) for i in range(4)]
        row = F.struct(
            cls.alias("cls"), ((b[0] + b[2] / 2) / w).alias("cx"), ((b[1] + b[3] / 2) / h).alias("cy"),
            (b[2] / w).alias("w"), (b[3] / h).alias("h"),
        )
        return F.when(cls.isNotNull(), row)

    boxes = F.array_compact(F.transform(F.coalesce("_j.annotations", F.array()), box))
    return j.select(*keys, boxes.alias("boxes"), (F.size(boxes) == 0).alias("negative"))


_PIXEL_JSON = """struct<image:struct<width:double,height:double>,annotations:array<struct<categories_id:int,bbox:array<double>>>>"""
PIXEL_CLASSES = {1: 0, 2: 1}  # fixed values: source category to class, all others have no box


def pixel_json(docs: DataFrame, keys: Sequence[str] = ("stem",)) -> DataFrame:
    """Pixel boxes to clamped centre boxes; broken or empty documents are negatives."""
    from ..functions.geometry import pixel_box_to_yolo

    j = docs.select(*keys, F.from_json("text", _PIXEL_JSON).alias("_j"))
    mapped = F.create_map(*[F.lit(v) for kv in PIXEL_CLASSES.items() for v in kv])

    def box(a: Column) -> Column:
        cls = F.element_at(mapped, a["categories_id"])
        b = pixel_box_to_yolo(*[F.get(a["bbox"], i) for i in range(4)], F.col("_j.image.width"), F.col("_j.image.height"))
        return F.when(cls.isNotNull(), F.struct(cls.alias("cls"), b["cx"].alias("cx"), b["cy"].alias("cy"), b["w"].alias("w"), b["h"].alias("h")))

    boxes = F.array_compact(F.transform(F.coalesce("_j.annotations", F.array()), box))
    return j.select(*keys, F.when(F.col("_j.image").isNull(), F.slice(boxes, 1, 0)).otherwise(boxes).alias("boxes"))


_MULTIVIEW = """struct<videos:array<struct<filename:string,view:string,width:double,height:double>>,
annotations:struct<event_class:string,
  evidence:map<string,struct<frame_id:array<int>,obj_bbox:array<array<double>>,obj_id:array<string>,evidence_text:string>>>>"""


def _multiview(docs: DataFrame) -> DataFrame:
    from ..functions.keys import file_stem

    j = docs.select(F.from_json("text", _MULTIVIEW.replace("\n", "")).alias("_j"))
    v = j.select("_j.annotations", F.explode("_j.videos").alias("_v"))
    return v.select(
        file_stem(F.col("_v.filename")).alias("clip"), F.col("_v.view").alias("view"), F.col("_v.width").alias("frame_w"),
        F.col("_v.height").alias("frame_h"), F.col("annotations.event_class").alias("event_class"),
        F.element_at("annotations.evidence", F.coalesce("_v.view", F.lit(""))).alias("_e"),
    )


def multiview_boxes(docs: DataFrame, clips: DataFrame) -> DataFrame:
    """Evidence boxes of the matching view; ``clips`` gives the frame rate."""
    m = _multiview(docs).join(clips.select("clip", "fps"), "clip")
    zipped = F.arrays_zip(F.col("_e.frame_id").alias("frame_id"), F.col("_e.obj_bbox").alias("bbox"), F.col("_e.obj_id").alias("obj_id"))
    r = m.filter((F.col("frame_w") > 0) & (F.col("frame_h") > 0)).select("clip", "frame_w", "frame_h", "fps", F.posexplode(zipped).alias("pos", "_z"))
    b = [F.get("_z.bbox", i) for i in range(4)]
    return r.filter(b[3].isNotNull() & F.col("_z.frame_id").isNotNull()).select(
        "clip", T.tick(F.col("_z.frame_id") / F.col("fps")).alias("tick"),
        F.coalesce("_z.obj_id", (F.col("pos") + 1).cast("string")).alias("obj"),
        *_round5(b[0] / F.col("frame_w"), b[1] / F.col("frame_h"), (b[2] - b[0]) / F.col("frame_w"), (b[3] - b[1]) / F.col("frame_h")),
    )


def multiview_events(docs: DataFrame, clips: DataFrame) -> DataFrame:
    """The frame range named in the evidence text, in seconds."""
    m = _multiview(docs).join(clips.select("clip", "fps"), "clip")
    f0 = F.regexp_extract("_e.evidence_text", r"(\d+)\s*~\s*(\d+)", 1).try_cast("int")
    f1 = F.regexp_extract("_e.evidence_text", r"(\d+)\s*~\s*(\d+)", 2).try_cast("int")
    return m.filter(f0.isNotNull()).select(
        "clip", F.coalesce("event_class", F.lit("event")).alias("kind"),
        F.bround(f0 / F.col("fps"), 1).alias("start_s"), F.bround((f1 - f0) / F.col("fps"), 1).alias("dur_s"),
    )


# ---- locating and dispatching --------------------------------------------------------------


def label_candidates(images: DataFrame) -> DataFrame:
    """Where an image's label file may lie, best place first (``image, candidate, priority``)."""
    p = F.col("image")
    bare = F.regexp_replace(p, r"\.[^./]*$", "")
    stem = F.element_at(F.split(bare, "/"), -1)
    parts = F.split(p, "/")
    root = F.array_join(F.slice(parts, 1, 3), "/")
    parent = F.get(parts, F.size(parts) - 2)
    before = F.substring_index(p, "/images/", -1)
    head = F.expr("substring(image, 1, length(image) - length(substring_index(image, '/images/', -1)) - length('/images/'))")
    in_tree = p.contains("/images/")
    sub = F.regexp_replace(before, r"\.[^./]*$", "")
    deep = F.size(parts) >= 4
    options = [
        F.concat(bare, F.lit(".txt")),
        F.when(in_tree, F.concat(head, F.lit("/labels/"), sub, F.lit(".txt"))),
        F.when(in_tree, F.concat(head, F.lit("/labels/"), stem, F.lit(".txt"))),
        F.when(deep, F.concat(root, F.lit("/labels/"), parent, F.lit("/"), stem, F.lit(".txt"))),
        F.when(deep, F.concat(root, F.lit("/labels/"), stem, F.lit(".txt"))),
    ]
    return images.select("image", F.posexplode(F.array(*options)).alias("priority", "candidate")).filter(
        F.col("candidate").isNotNull()
    )


def locate_labels(images: DataFrame, label_files: DataFrame) -> DataFrame:
    """First existing candidate per image; NULL without one."""
    found = label_candidates(images).join(label_files.select(F.col("path").alias("candidate")).distinct(), "candidate")
    best = found.groupBy("image").agg(F.min_by("candidate", "priority").alias("label_path"), F.min("priority").alias("priority"))
    return images.join(best, "image", "left")


ADAPTERS: dict[str, Callable[..., DataFrame]] = {
    "event_xml": alarm_spans,
    "span_json": span_json,
    "point_xml": keyframe_points,
    "multiview_json": multiview_boxes,
    "yolo_txt": yolo_txt,
    "coco_json": coco_boxes,
    "voc_xml": voc_xml,
    "named_json": named_json,
    "pixel_json": pixel_json,
}


def register_adapter(name: str, fn: Callable[..., DataFrame]) -> None:
    """Adds a format: a function from documents to typed rows."""
    ADAPTERS[name] = fn


def parse(fmt: str, docs: DataFrame, *args, **kwargs) -> DataFrame:
    return ADAPTERS[fmt](docs, *args, **kwargs)


def yolo_lines(boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Boxes (top-left) to label text: one document per image, bounded by its boxes."""
    line = F.format_string(
        "%d %.6f %.6f %.6f %.6f", F.col("cls").cast("int"), F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2, F.col("w"), F.col("h")
    )
    return boxes.select(*keys, line.alias("_l")).groupBy(*keys).agg(
        F.array_join(F.sort_array(F.collect_list("_l")), "\n").alias("text")
    )
