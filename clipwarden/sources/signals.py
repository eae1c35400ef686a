"""Signals, tracks, dumps and curves from their exchange files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

_ROWS = "array<array<double>>"
# fixed values: the field names of the three shapes
_SIGNAL = f"map<string,struct<rows:{_ROWS},sig:{_ROWS},fire_smoke:{_ROWS},gt:double,gt_start:double>>"


def _clips(docs: DataFrame, *kept: str) -> DataFrame:
    """Clips of signal documents, whatever their shape: ``clip, _rows, _start``."""
    clips = docs.select(*kept, F.explode(F.from_json("text", _SIGNAL)).alias("clip", "_v"))
    start = F.coalesce("_v.gt", "_v.gt_start")
    return clips.select(*kept, "clip", F.coalesce("_v.rows", "_v.sig", "_v.fire_smoke").alias("_rows"), F.when(start >= 0, start).alias("start_s"))


def signal_json(docs: DataFrame) -> DataFrame:
    """Signal rows of ``{"<clip>": {"rows": [[t, fire, smoke], …]}}``, also named ``sig`` or ``fire_smoke``."""
    rows = _clips(docs).select("clip", F.explode("_rows").alias("_r"))
    return rows.select("clip", *[F.get("_r", i).alias(n) for i, n in enumerate(("t", "fire", "smoke"))])


def signal_truth(docs: DataFrame) -> DataFrame:
    """Event start of each clip, named ``gt`` or ``gt_start``; -1 and null both mean none."""
    return _clips(docs).select("clip", "start_s")


def signal_with_truth(docs: DataFrame) -> DataFrame:
    """Signal rows with the event start of their clip, in one scan; a clip without samples has one row of nulls."""
    rows = _clips(docs).select("clip", "start_s", F.explode_outer("_rows").alias("_r"))
    return rows.select("clip", "start_s", *[F.get("_r", i).alias(n) for i, n in enumerate(("t", "fire", "smoke"))])


_TRACKS = "struct<t:double,boxes:array<array<double>>>"


def track_lines(lines: DataFrame, key: str = "clip") -> DataFrame:
    """One JSON line per sample to ``t`` and typed boxes; empty samples stay.

    ``lines`` is a text scan (``value``) with the clip from the file name, so a
    long clip is read by many tasks.
    """
    j = lines.select(key, F.from_json("value", _TRACKS).alias("_j")).filter(F.col("_j.t").isNotNull())
    box = lambda b: F.struct(
        F.get(b, 0).cast("int").alias("id"), F.get(b, 1).alias("conf"),
        *[F.get(b, i + 2).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))],
    )
    return j.select(key, F.col("_j.t").alias("t"), F.transform(F.coalesce("_j.boxes", F.array()), box).alias("boxes"))


def untracked_lines(lines: DataFrame, key: str = "clip", with_class: bool = False) -> DataFrame:
    """Boxes without ids: ``[conf, corners]`` or ``[cls, conf, corners]``."""
    j = lines.select(key, F.from_json("value", _TRACKS).alias("_j")).filter(F.col("_j.t").isNotNull())
    o = 1 if with_class else 0
    box = lambda b: F.struct(
        (F.get(b, 0).cast("int") if with_class else F.lit(0)).alias("cls"), F.get(b, o).alias("conf"),
        *[F.get(b, i + o + 1).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))],
    )
    return j.select(key, F.col("_j.t").alias("t"), F.transform(F.coalesce("_j.boxes", F.array()), box).alias("boxes"))


def keypoint_lines(lines: DataFrame, key: str = "clip") -> DataFrame:
    """Flat ``5 + 51`` values per person to a box and 17 keypoints."""
    j = lines.select(key, F.from_json("value", _TRACKS).alias("_j")).filter(F.col("_j.t").isNotNull())
    people = j.select(key, F.col("_j.t").alias("t"), F.posexplode("_j.boxes").alias("slot", "_b"))
    kp = F.transform(
        F.sequence(F.lit(0), F.lit(16)),
        lambda i: F.struct(
            F.get("_b", i * 3 + 5).cast("float").alias("x"), F.get("_b", i * 3 + 6).cast("float").alias("y"),
            F.get("_b", i * 3 + 7).cast("float").alias("c"),
        ),
    )
    return people.select(
        key, "t", "slot", F.get("_b", 0).alias("conf"), *[F.get("_b", i + 1).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))], kp.alias("kp")
    )


def flat_boxes(samples: DataFrame, key: str = "clip") -> DataFrame:
    """Nested samples to one row per box, with its place in the sample."""
    return samples.select(key, "t", F.posexplode("boxes").alias("box_no", "_b")).select(key, "t", "box_no", "_b.*")
