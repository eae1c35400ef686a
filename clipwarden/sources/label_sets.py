"""Label sets a trainer can read, written as one: all of it appears, or nothing.

    labels/<split>/<image>.txt   lines of class and box
    <split>.txt                  images, one a line
    data.yaml, meta.json         descriptor and counts

Tasks write into a staging folder beside the target: a text per image, and a
list of their own.  The commit on the driver joins the lists part by part,
writes the descriptor and renames the folder.  Tasks that run twice write the
same texts; lists count only where a task was committed.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .raw_folders import local_path


def label_name(image: str) -> str:
    """File name of an image's labels: its path without the ending, so that folders keep names apart."""
    return os.path.splitext(image.strip("/"))[0].replace("/", "_").replace(" ", "_")


@dataclass
class Written(WriterCommitMessage):
    lists: dict[str, str] = field(default_factory=dict)
    images: dict[str, int] = field(default_factory=dict)
    boxes: dict[str, int] = field(default_factory=dict)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.target, self.overwrite = local_path(options["path"]), overwrite
        self.names = json.loads(options.get("names", "[]"))
        self.stage = f"{self.target.rstrip('/')}.staging-{uuid.uuid4().hex}"
        if os.path.exists(self.target) and not overwrite:
            raise ValueError(f"there already: {self.target}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task, lists, images, boxes = uuid.uuid4().hex, {}, Counter(), Counter()
        try:
            for batch in iterator:
                for split, image, text in zip(*(batch.column(c).to_pylist() for c in ("split", "image", "text"))):
                    if not split or not image or "/" in split:
                        raise ValueError(f"a label needs a split and an image: {split!r}, {image!r}")
                    folder = f"{self.stage}/labels/{split}"
                    if split not in lists:
                        os.makedirs(folder, exist_ok=True)
                        os.makedirs(f"{self.stage}/lists", exist_ok=True)
                        lists[split] = open(f"{self.stage}/lists/{task}-{split}.txt", "w", encoding="utf-8")
                    path = f"{folder}/{label_name(image)}.txt"
                    with open(f"{path}.{task}", "w", encoding="utf-8") as out:
                        out.write(text + "\n" if text else "")
                    os.replace(f"{path}.{task}", path)
                    lists[split].write(image + "\n")
                    images[split] += 1
                    boxes[split] += text.count("\n") + 1 if text else 0
        finally:
            for out in lists.values():
                out.close()
        return Written({s: out.name for s, out in lists.items()}, dict(images), dict(boxes))

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        os.makedirs(self.stage, exist_ok=True)
        for split in sorted({"train", "val"} | {s for m in done for s in m.lists}):
            with open(f"{self.stage}/{split}.txt", "wb") as out:
                for m in done:
                    if split in m.lists:
                        with open(m.lists[split], "rb") as part:
                            shutil.copyfileobj(part, out)
        shutil.rmtree(f"{self.stage}/lists", ignore_errors=True)
        with open(f"{self.stage}/data.yaml", "w", encoding="utf-8") as out:
            out.write(descriptor(self.target, self.names))
        counts = {k: dict(sum((Counter(getattr(m, k)) for m in done), Counter())) for k in ("images", "boxes")}
        with open(f"{self.stage}/meta.json", "w", encoding="utf-8") as out:
            json.dump(counts, out, ensure_ascii=False, indent=1, sort_keys=True)
        old = None
        if self.overwrite and os.path.exists(self.target):
            old = f"{self.target.rstrip('/')}.replaced-{uuid.uuid4().hex}"
            os.rename(self.target, old)
        os.rename(self.stage, self.target)
        if old:
            shutil.rmtree(old, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.stage, ignore_errors=True)


class LabelSet(DataSource):
    @classmethod
    def name(cls) -> str:
        return "label_set"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


def descriptor(root: str, names: Sequence[str]) -> str:
    """The data descriptor of a training set."""
    return f"path: {root}\ntrain: {root}/train.txt\nval: {root}/val.txt\nnc: {len(names)}\nnames: {list(names)}\n"


def write_label_set(labels: DataFrame, path: str, names: Sequence[str], overwrite: bool = False) -> None:
    """Writes ``split, image, text`` as a label set; an empty or null text is an image without objects.

    Images are dealt to as many tasks as a shuffle has: their number makes the
    work, and a table of few bytes would come in few parts.
    """
    labels.sparkSession.dataSource.register(LabelSet)
    n = int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    writer = labels.select("split", "image", "text").repartition(n, "image").write.format("label_set").option("names", json.dumps(list(names)))
    writer.mode("overwrite" if overwrite else "append").save(path)


def label_paths(images: DataFrame) -> DataFrame:
    """``path`` of the label file of each listed ``split, image``, below ``labels``; each file once."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            splits, listed = batch.column("split").to_pylist(), batch.column("image").to_pylist()
            yield pa.RecordBatch.from_pydict({"path": pa.array([f"{s}/{label_name(i)}.txt" for s, i in zip(splits, listed)], pa.string())})

    return images.select("split", "image").mapInArrow(name, "path string").distinct()
