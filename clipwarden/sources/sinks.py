"""Writing results: alarm XML, JSON lines, label text, CSV, reports, build metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import timecode as T

# fixed values: event names in alarm files
DESCRIPTIONS = {"fire": "FireDetection", "intrusion": "Intrusion", "loiter": "Loitering", "fall": "Falldown"}


def alarm_documents(alarms: DataFrame, item: str, root: str = "Library", dur_s: float = 10.0, ext: str = ".mp4") -> DataFrame:
    """One alarm document per clip; a clip without an alarm gets an empty list."""
    t = F.col("alarm")
    entry = F.format_string(
        "      <Alarm>\n        <StartTime>%s</StartTime>\n        <AlarmDescription>%s</AlarmDescription>\n"
        "        <AlarmDuration>%s</AlarmDuration>\n      </Alarm>\n    ",
        T.hms(t), F.lit(DESCRIPTIONS[item]), T.hms(F.lit(dur_s)),
    )
    body = F.when(t.isNotNull(), F.concat(F.lit("\n"), entry)).otherwise("")
    text = F.concat(
        F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<{root}>\n  <Clip>\n    <Header>\n      <AlarmEvents>'),
        F.when(t.isNotNull(), "1").otherwise("0"),
        F.lit("</AlarmEvents>\n      <Filename>"), F.col("clip").cast("string"), F.lit(ext),
        F.lit("</Filename>\n    </Header>\n    <Alarms>"), body, F.lit(f"</Alarms>\n  </Clip>\n</{root}>"),
    )
    return alarms.select("clip", text.alias("text"))


def write_alarm_xml(alarms: DataFrame, path: str, item: str) -> None:
    """All alarms as rows of one XML dataset, many clips to a file."""
    out = alarms.select(
        F.col("clip").cast("string").alias("Filename"),
        F.when(
            F.col("alarm").isNotNull(),
            F.struct(
                T.hms(F.col("alarm")).alias("StartTime"), F.lit(DESCRIPTIONS[item]).alias("AlarmDescription"),
                T.hms(F.lit(10.0)).alias("AlarmDuration"),
            ),
        ).alias("Alarm"),
    )
    out.write.mode("overwrite").format("xml").option("rootTag", "Clips").option("rowTag", "Clip").save(path)


def write_documents(docs: DataFrame, path: str, key: str = "clip") -> None:
    """One folder per key with its text, for consumers that want single files."""
    docs.select(key, "text").write.mode("overwrite").partitionBy(key).text(path, lineSep="\n")


def write_jsonl(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; quotes inside a value are doubled, empty texts stay apart from nulls."""
    df.write.mode("overwrite").options(header=True, escape='"', emptyValue='""', nullValue="").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``write_csv`` wrote, line ends inside values included; blanks around values are theirs."""
    return spark.read.options(
        header=True, escape='"', multiLine=True, nullValue="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).schema(schema).csv(path)


def build_counts(frames: DataFrame, by: Sequence[str] = ("split", "src")) -> DataFrame:
    """Counts to store next to a built set."""
    return frames.groupBy(*by).agg(F.count(F.lit(1)).alias("frames"), F.sum(F.size("boxes")).alias("boxes"))


def report(results: DataFrame, best: DataFrame) -> str:
    """Markdown report of a finished result mart.

    Both inputs are marts with one row per experiment, so collecting them is
    bounded by the number of experiments and not by data.
    """
    top = best.orderBy("item").collect()
    out = ["## Best per item", "", "| item | F1 | hit/miss/false | experiment | rule |", "|---|---|---|---|---|"]
    out += [f"| {r.item} | **{r.f1}** | {r.tp}/{r.fn}/{r.fp} | {r.name} | {(r.rule or '')[:46]} |" for r in top]
    rows = results.orderBy("item", F.desc("f1"), "name").collect()
    item = None
    for r in rows:
        if r.item != item:
            item = r.item
            out += ["", f"## {item}", "", "| experiment | F1 | hit | miss | false | rule |", "|---|---|---|---|---|---|"]
        out.append(f"| {r.name} | {r.f1:.2f} | {r.tp} | {r.fn} | {r.fp} | {(r.rule or '')[:44]} |")
    return "\n".join(out)


def evaluation_values(table: DataFrame) -> dict[str, dict[str, dict[str, float]]]:
    """An evaluation table as nested values, ready for JSON: a few numbers per class, whatever was evaluated."""
    found: dict[str, dict[str, dict[str, float]]] = {}
    for r in table.orderBy("section", "name", "metric").toLocalIterator():
        found.setdefault(r["section"], {}).setdefault(r["name"], {})[r["metric"]] = r["value"]
    return found


def evaluation_report(values: dict, names: dict[str, str] | None = None) -> str:
    """Markdown of an evaluation: detection by class, then the alarm matrix of images with its rates."""
    classes, alarm = values.get("class", {}), values.get("alarm", {}).get("images", {})
    mean = lambda m: sum(v.get(m) or 0.0 for v in classes.values()) / max(1, len(classes))
    out = ["## Detection", "", f"mAP50 **{mean('map50'):.3f}**, mAP50-95 **{mean('map5095'):.3f}**", "", "| class | AP50 | precision | recall |", "|---|---|---|---|"]
    for name, v in sorted(classes.items()):
        out.append(f"| {(names or {}).get(name, name)} | " + " | ".join(f"{v.get(m) or 0.0:.3f}" for m in ("map50", "precision", "recall")) + " |")
    n = {k: int(alarm.get(k) or 0) for k in ("tp", "fn", "fp", "tn")}
    rate = {k: alarm.get(k) or 0.0 for k in ("precision", "recall", "f1", "far")}
    out += [
        "", "## Alarms", "", f"{sum(n.values()):,} images", "", "| | alarm | none |", "|---|---|---|", f"| event | {n['tp']} | {n['fn']} |", f"| normal | {n['fp']} | {n['tn']} |",
        "", f"precision **{rate['precision']:.3f}**, recall **{rate['recall']:.3f}**, F1 **{rate['f1']:.3f}**, false alarms of normal images **{rate['far']:.3f}**",
    ]
    return "\n".join(out)
