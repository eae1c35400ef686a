"""Readers and writers on real files."""

import json

import pytest
from pyspark.sql import functions as F

from clipwarden.operators import curation, joins
from clipwarden.sources import annotations as A, label_sets, manifest as M, raw_folders, signals as G, sinks, text as X


def test_documents_manifest_and_listing(spark, tmp_path):
    for name in ("F_1_00007", "F_1_x"):
        p = tmp_path / "불꽃" / "plant" / "clip1" / "JSON"
        p.mkdir(parents=True, exist_ok=True)
        (p / f"{name}.json").write_text("{}")
    rows = {r.stem: r for r in M.manifest(X.read_paths(spark, str(tmp_path), "*.json")).collect()}
    assert rows["F_1_00007"].frame == 7 and rows["F_1_x"].frame == -1
    assert rows["F_1_x"].place_kr == "plant" and rows["F_1_x"].clip == "clip1"
    assert curation.numeric_frames(M.manifest(X.read_paths(spark, str(tmp_path), "*.json"))).count() == 2


def test_listing_opens_no_file(spark, tmp_path):
    (tmp_path / "a.json").write_text("x" * 100)
    plan = X.read_paths(spark, str(tmp_path)).select("path")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_event_files(spark, tmp_path):
    body = "<Lib><Alarms><Alarm><StartTime>00:01:40</StartTime><AlarmDescription>x &amp; y</AlarmDescription></Alarm></Alarms></Lib>"
    (tmp_path / "c1.xml").write_text(body)
    (tmp_path / "c2.xml").write_text("<Lib><Alarms></Alarms></Lib>")
    (tmp_path / "c3.xml").write_text("<Lib><Alarm><StartTime>1:40</StartTime></Ala")
    docs = X.read_documents(spark, str(tmp_path), "*.xml")
    got = {r.clip: (r.start_s, r.dur_s) for r in A.event_xml(docs).collect()}
    assert got["c1"] == (100.0, 10.0) and got["c2"] == (None, None)
    assert [(r.clip, r.kind) for r in A.alarm_spans(docs).collect()] == [("c1", "x & y")]


def test_tracks_keep_empty_samples(spark, tmp_path):
    lines = [{"t": 0.0, "boxes": []}, {"t": 0.5, "boxes": [[3, 0.71, 10, 20, 50, 140], [4, 0.5, 1, 2, 3, 4]]}]
    (tmp_path / "clip9.jsonl").write_text("\n".join(json.dumps(x) for x in lines))
    raw = spark.read.text(str(tmp_path)).select(F.col("value"), F.lit("clip9").alias("clip"))
    rows = G.track_lines(raw).orderBy("t").collect()
    assert [len(r.boxes) for r in rows] == [0, 2]
    assert rows[1].boxes[0].id == 3 and rows[1].boxes[0].y2 == 140.0


def test_sinks_round_trip(spark, tmp_path):
    alarms = spark.createDataFrame([("a", 100.4), ("b", None)], "clip string, alarm double")
    sinks.write_alarm_xml(alarms, str(tmp_path / "xml"), "fire")
    back = spark.read.format("xml").option("rowTag", "Clip").load(str(tmp_path / "xml"))
    assert {r.Filename for r in back.collect()} == {"a", "b"}
    docs = {r.clip: r.text for r in sinks.alarm_documents(alarms, "fire").collect()}
    assert "<StartTime>00:01:40</StartTime>" in docs["a"] and "<Alarms></Alarms>" in docs["b"]
    sinks.write_documents(sinks.alarm_documents(alarms, "fire"), str(tmp_path / "docs"))
    assert (tmp_path / "docs" / "clip=a").is_dir()
    sinks.write_jsonl(alarms, str(tmp_path / "j"))
    sinks.write_csv(alarms, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    assert "nc: 2" in label_sets.descriptor("/d", ["fire", "smoke"])


def test_report(spark):
    rows = spark.createDataFrame([("fire", "e1", 75.0, 6, 4, 0, "r")], "item string, name string, f1 double, tp int, fn int, fp int, rule string")
    text = sinks.report(rows, rows)
    assert "| fire | **75.0** | 6/4/0 | e1 | r |" in text


def test_evaluation_report(spark):
    from clipwarden.operators import marts

    classes = spark.createDataFrame([(0, 0.5, 0.25, 0.8, 0.4), (1, 0.3, 0.1, 1.0, None)], "cls int, map50 double, map5095 double, precision double, recall double")
    alarms = spark.createDataFrame([(6, 1, 2, 11, 0.857, 0.75, 0.8, 0.083)], "tp long, fp long, fn long, tn long, precision double, recall double, f1 double, far double")
    values = sinks.evaluation_values(marts.evaluation_table(classes, alarms))
    assert json.loads(json.dumps(values)) == values and values["class"]["1"]["recall"] is None
    text = sinks.evaluation_report(values, {"0": "fire"})
    assert "mAP50 **0.400**" in text and "| fire | 0.500 | 0.800 | 0.400 |" in text and "| 1 | 0.300 | 1.000 | 0.000 |" in text
    assert "20 images" in text and "| event | 6 | 2 |" in text and "| normal | 1 | 11 |" in text and "**0.083**" in text


def test_leak_assertion(spark):
    train = spark.createDataFrame([("a",), ("b",)], "clip string")
    with pytest.raises(ValueError, match="held-out"):
        joins.assert_disjoint(train, spark.createDataFrame([("b",)], "clip string"))
    joins.assert_disjoint(train, spark.createDataFrame([("c",)], "clip string"))


def test_merge_blocks_weaker_sources(spark):
    ddl = "clip string, tick int, cls int, x double, y double, w double, h double"
    row = lambda t, c: ("a", t, c, 0.1, 0.1, 0.2, 0.2)
    hand = spark.createDataFrame([row(0, -1), row(1, 0), row(1, 1)], ddl)
    auto = spark.createDataFrame([row(0, 0), row(2, 0)], ddl)
    got = {(r.tick, r.src): len(r.boxes) for r in curation.merge_sources({"hand": hand, "auto": auto}).collect()}
    assert got == {(0, "hand"): 0, (1, "hand"): 2, (2, "auto"): 1}


def test_grid_snap_is_half_even(spark):
    from clipwarden.functions.timecode import snap

    df = spark.createDataFrame([(0.25,), (0.75,), (1.25,)], "t double")
    assert [r.s for r in df.select(snap(F.col("t")).alias("s")).collect()] == [0.0, 1.0, 1.0]


def test_adapter_registry(spark):
    A.register_adapter("upper", lambda docs: docs.select(F.upper("text").alias("text")))
    assert A.parse("upper", spark.createDataFrame([("a",)], "text string")).first().text == "A"


def test_scorer_plug_point(spark):
    from clipwarden.operators.scorer import score_images

    def make():
        return lambda batch: batch["n"].map(lambda n: [dict(cls=i % 2, conf=0.2 * (i + 1), x1=0.0, y1=0.0, x2=1.0, y2=1.0) for i in range(n)])

    df = spark.createDataFrame([("a", 0), ("b", 3)], "stem string, n int")
    got = {r.stem: (r.n_det, round(r.max_conf, 2), r.top_class) for r in score_images(df, make, "stem string").collect()}
    assert got == {"a": (0, 0.0, None), "b": (2, 0.6, 0)}


def test_raw_folders_read_heads_only(spark, tmp_path):
    for name, text in (
        ("fire_a/x/1.xml", "<Alarm><StartTime>" + "é" * 5000), ("fire_a/2.mp4", "m" * 9000), ("person_b/deep/er/3.json", '{"images": [], "annotations": []}'),
        ("person_b/4.txt", "0 0.5 0.5 0.1 0.1"), ("empty_c/5.jpg", "j"),
    ):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (tmp_path / "loose.txt").write_text("no category")
    files = raw_folders.raw_folders(spark, str(tmp_path))
    rows = {r.path[len(str(tmp_path)) + 1 :]: r for r in files.collect()}
    assert set(rows) == {"fire_a/x/1.xml", "fire_a/2.mp4", "person_b/deep/er/3.json", "person_b/4.txt", "empty_c/5.jpg"}
    assert {k: len(r.head.encode()) for k, r in rows.items() if r.head} == {"fire_a/x/1.xml": 4000, "person_b/deep/er/3.json": 33, "person_b/4.txt": 17}
    assert rows["fire_a/2.mp4"].head is None and rows["fire_a/2.mp4"].size == 9000
    written = M.contract_table(spark, "fire_a: {use: none}\nother: {gt: coco_json}\n")
    got = {r.category: (r.mode, r.media, r.gt, r.use) for r in M.resolve_contract(files, written, M.probe(files)).collect()}
    assert got == {
        "fire_a": ("fire", "video", "event_xml", "none"), "person_b": ("person", "image", "coco_json", "train"), "empty_c": ("fire", "image", "none", "train"),
    }


def test_contract_text_round_trip(spark, tmp_path):
    text = M.changed_contract("", "b", mode="fire", classes={0: 1, "smoke": "drop"}, note="씨: 'x'")
    text = M.changed_contract(text, "a", use="none", gt="voc_xml")
    text = M.changed_contract(text, "a", gt=None)
    assert M.parse_contract(text) == {"a": {"use": "none"}, "b": {"mode": "fire", "classes": {0: 1, "smoke": "drop"}, "note": "씨: 'x'"}}
    (tmp_path / "c.yaml").write_text(text)
    rows = {r.category: r for r in M.read_contract(spark, str(tmp_path / "c.yaml")).collect()}
    assert rows["b"].classes == {"0": "1", "smoke": "drop"} and rows["a"].use == "none" and rows["a"].mode is None
    assert M.contract_table(spark, "").count() == 0
    with pytest.raises(ValueError):
        M.parse_contract("- a\n- b\n")


def test_label_sets_appear_whole_or_not_at_all(spark, tmp_path):
    ddl = "split string, image string, text string"
    rows = [("train", "a/x 1.jpg", "0 0.5 0.5 0.1 0.1\n1 0.2 0.2 0.1 0.1"), ("train", "b/x 1.jpg", None), ("val", "c.png", "1 0.5 0.5 0.1 0.1"), ("test", "d.png", "")]
    path = tmp_path / "set"
    label_sets.write_label_set(spark.createDataFrame(rows, ddl).repartition(3), str(path), ["fire", "smoke"])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["set"]
    assert sorted((path / "train.txt").read_text().splitlines()) == ["a/x 1.jpg", "b/x 1.jpg"]
    assert (path / "labels" / "train" / "a_x_1.txt").read_text() == rows[0][2] + "\n" and (path / "labels" / "train" / "b_x_1.txt").read_text() == ""
    assert sorted(p.name for p in path.iterdir()) == ["data.yaml", "labels", "meta.json", "test.txt", "train.txt", "val.txt"]
    assert json.loads((path / "meta.json").read_text()) == {"boxes": {"train": 2, "val": 1}, "images": {"test": 1, "train": 2, "val": 1}}
    assert f"train: {path}/train.txt" in (path / "data.yaml").read_text()
    # a row without a split fails its task, and nothing of the set stays
    broken = spark.createDataFrame([*rows, (None, "e.png", "0 0 0 0 0")], ddl).repartition(3)
    with pytest.raises(Exception, match="split"):
        label_sets.write_label_set(broken, str(tmp_path / "other"), [])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["set"]
    with pytest.raises(Exception, match="there already"):
        label_sets.write_label_set(spark.createDataFrame(rows, ddl), str(path), [])
    label_sets.write_label_set(spark.createDataFrame(rows[2:3], ddl), str(path), ["x"], overwrite=True)
    assert (path / "train.txt").read_text() == "" and sorted(p.name for p in tmp_path.iterdir()) == ["set"]


def test_documents_of_many_lines_are_one_row(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "clip_1.xml").write_text("<Clip>\n  <StartTime>00:00:05</StartTime>\n</Clip>\n")
    rows = X.read_documents(spark, str(tmp_path / "d")).collect()
    assert [(r.clip, r.text.count("\n")) for r in rows] == [("clip_1", 3)]


def test_own_formats_as_a_table_function(spark):
    from clipwarden.sources import adapters

    def pairs(text):
        for part in text.split():
            yield part, len(part)

    adapters.register_formats(spark, {"words": adapters.Format("word string, size int", pairs), "lines": adapters.Format("line string", lambda t: [(x,) for x in t.splitlines()])})
    docs = spark.createDataFrame([(1, "a bb\nccc"), (2, None), (3, "")], "id long, text string")
    assert sorted(map(tuple, adapters.parsed(docs, "words", ["id"]).collect())) == [(1, "a", 1), (1, "bb", 2), (1, "ccc", 3)]
    assert sorted(map(tuple, adapters.parsed(docs, "lines", ["id"]).collect())) == [(1, "a bb"), (1, "ccc")]
    with pytest.raises(Exception, match="names a format"):
        adapters.parsed(docs, "other", ["id"])


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_score_line_is_cut_up_once(spark):
    from clipwarden.sources import logs

    text = "  r1 → 71.50  (정검 6 미검 4 오검 0)  f1\n(정검 1\nr2 → x (정검 1 미검 2 오검 3)\nloading"
    log = logs.lines(spark.createDataFrame([("a", text), ("b", None)], "file string, text string"))
    for arrow in (True, False):
        got = logs.score_lines(log, arrow)
        assert [(r.file, r.line_no, r.rule, r.f1, r.tp, r.fn, r.fp) for r in got.collect()] == [("a", 0, "r1" if arrow else "f1", 71.5, 6, 4, 0)]
        assert _plan(got).count("regexp_extract") == 4


def test_a_progress_line_is_cut_up_once(spark):
    from clipwarden.sources import logs

    text = "scan\r  3/80  84.8G  1.1 0.9  325  640: 12% ━━ 7/1681 1.9it/s 11:25<2:05\r   all  601  798  0.5  0.25  0.4  0.3\rall: of it"
    got = logs.training_progress(spark.createDataFrame([("a", text), ("b", "all 1 2 0.5 0.5 0.5 0.5")], "name string, text string"))
    assert [(r.name, r.epoch, r.epochs, r.pct, r.it, r.its, r.it_s, r.precision, r.map5095) for r in got.collect()] == [("a", 3, 80, 12, 7, 1681, 1.9, 0.5, 0.3)]
    assert _plan(got).count("split(") < 20


def test_own_formats_send_rows_in_batches(spark):
    from clipwarden.sources import adapters

    adapters.register_formats(spark, {"words": adapters.Format("n bigint, w string", lambda t: enumerate(t.split()))}, "parse_words")
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "o long, text string")
    got = adapters.parsed(docs, "words", ["o"], "parse_words")
    assert sorted(map(tuple, got.collect())) == [(1, 0, "a"), (1, 1, "b")]
    # the Arrow form makes a batch for each call
    assert "ArrowEval" not in got._jdf.queryExecution().executedPlan().toString()


def test_listed_label_files_are_read_without_a_listing(spark, tmp_path):
    from clipwarden.sources import label_sets
    from clipwarden.sources.text import read_documents

    rows = [("train", f"s_{k % 3}/img {k}.jpg", f"0 0.5 0.5 0.1 0.{k}\r\n1 é" if k % 4 else None) for k in range(1, 41)]
    images = spark.createDataFrame(rows, "split string, image string, text string")
    path = f"{tmp_path}/set"
    label_sets.write_label_set(images, path, ["fire"])
    paths = label_sets.label_paths(images.unionByName(images))
    assert paths.count() == 40
    got = {(r.clip, r.text) for r in read_documents(spark, f"file:{path}/labels", "*.txt", paths).collect()}
    # Spark's reader has no row for an empty file
    assert {g for g in got if g[1]} == {(r.clip, r.text) for r in read_documents(spark, f"{path}/labels", "*.txt").collect()}
    assert len(got) == 40 and sum(not text for _, text in got) == 10
    assert sorted(r.value for r in spark.read.text(f"{path}/train.txt").collect()) == sorted(r[1] for r in rows)


def test_xml_is_parsed_once_for_what_is_read(spark):
    voc = """<annotation><size><width>{}</width><height>100</height></size><object><name>Flame</name><bndbox><xmin>20</xmin><ymin>10</ymin>
    <xmax>60</xmax><ymax>40</ymax></bndbox></object><object><name>tree</name><bndbox><xmin>1</xmin></bndbox></object><object><name>fire</name></object></annotation>"""
    docs = spark.createDataFrame([("a", "c", voc.format(200)), ("b", "c", voc.format(0)), ("d", "c", "<annotation></annotation>")], "image string, category string, text string")
    contract = spark.createDataFrame([("c", "fire", None)], "category string, mode string, classes map<string,string>")
    boxes = A.voc_xml(docs, contract)
    assert [tuple(r) for r in boxes.collect()] == [("a", 0, 0, 0.1, 0.1, 0.2, 0.3)]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(boxes).count("from_xml(") == 1

    text = """<annotation><size><width>600</width><height>480</height></size><header><fps>25</fps></header><object><objectname>p_4</objectname>
    <position><keyframe>50</keyframe><keypoint><x>60</x><y>48</y></keypoint></position><position><keyframe>75</keyframe></position>
    <action><actionname>walk</actionname><frame><start>50</start><end>100</end></frame></action></object></annotation>"""
    points = spark.createDataFrame([("a", text), ("b", text.replace("600", "0"))], "clip string, text string")
    found, spans = A.keyframe_points(points), A.actions(points)
    assert [tuple(r) for r in found.collect()] == [("a", 4, 4, 0.1, 0.1)]
    assert sorted(tuple(r) for r in spans.collect()) == [("a", 4, "walk", 2.0, 4.0), ("b", 4, "walk", 2.0, 4.0)]
    assert plan(found).count("from_xml(") == 1 and "actionname" not in plan(found) and "keyframe" not in plan(spans)
