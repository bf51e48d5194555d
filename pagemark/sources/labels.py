"""Label files as a Spark data source: a text file of boxes for each picture, and a list of classes.

A folder holds labels/<split>/<img_id>.txt, one line a box (class, centre and size as shares of the picture), and data.yaml. Tasks write to a
folder of their own; a commit moves what they wrote and then writes data.yaml, an abort leaves nothing behind. Reading
gives a row a box, some files a task.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import lru_cache

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from .shared import opened

NAME = "label_files"
SCHEMA = "split string, img_id string, class_id int, cx double, cy double, w double, h double"
#: Files that one task reads, at least.
FILES = 64
#: Tasks that read a folder, at most, and moves of a commit at once.
TASKS, MOVES = 1024, 32
_UNSAFE = re.compile(r"[^\w.\- ]")


class LabelFiles(DataSource):
    """Options: path; classes (a JSON list of their names, for writing)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        names = schema.names
        if [x.split()[0] for x in SCHEMA.split(", ")] != names:
            raise ValueError(f"{NAME} takes the columns {SCHEMA}, not {names}")
        return _Writer(self.options["path"], json.loads(self.options.get("classes", "[]")), overwrite)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]  #: split and img_id


class _Writer(DataSourceWriter):
    def __init__(self, path: str, classes: list[str], overwrite: bool):
        self.path, self.classes, self.overwrite = path, classes, overwrite
        self.staged = f"_staged-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        system, root = opened(self.path)
        task = f"{root}/{self.staged}/{uuid.uuid4().hex}"
        done: list[tuple[str, str]] = []
        now, lines = None, []

        def flush() -> None:
            if now is not None:
                system.create_dir(f"{task}/{now[0]}", recursive=True)
                with system.open_output_stream(f"{task}/{now[0]}/{now[1]}.txt") as out:
                    out.write("\n".join(lines).encode())
                done.append((f"{task}/{now[0]}/{now[1]}.txt", f"{now[0]}/{now[1]}.txt"))

        for r in rows:
            which = (_safe(r.split), _safe(r.img_id))
            if which != now:
                flush()
                now, lines = which, []
            lines.append(f"{r.class_id} {r.cx:.6f} {r.cy:.6f} {r.w:.6f} {r.h:.6f}")
        flush()
        return _Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = opened(self.path)
        files = [x for m in messages if m is not None for x in m.files]
        if len({name for _, name in files}) < len(files):
            self.abort(messages)
            raise ValueError("boxes of one picture were written by several tasks; use write_labels")
        if self.overwrite and system.get_file_info(f"{root}/labels").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/labels")
        for folder in sorted({name.split("/")[0] for _, name in files}):
            system.create_dir(f"{root}/labels/{folder}", recursive=True)
        with ThreadPoolExecutor(MOVES) as pool:
            for _ in pool.map(lambda k: [system.move(place, f"{root}/labels/{name}") for place, name in files[k : k + FILES]], range(0, len(files), FILES)):
                pass
        told = [f"path: {root}", "train: images/train", "val: images/val", f"nc: {len(self.classes)}", "names:", *(f"  {k}: {json.dumps(c, ensure_ascii=False)}" for k, c in enumerate(self.classes))]
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/data.yaml") as out:
            out.write("\n".join([*told, ""]).encode())
        self._clear(system, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/{self.staged}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.staged}")


@lru_cache(10_000)
def _safe(name: str) -> str:
    """A name as a file's."""
    return _UNSAFE.sub("_", name) or "_"


@dataclass
class _Some(InputPartition):
    files: list[str]


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        system, root = opened(self.path)
        found = system.get_file_info(fs.FileSelector(f"{root}/labels", recursive=True, allow_not_found=True))
        files = sorted(x.path for x in found if x.is_file and x.path.endswith(".txt"))
        some = max(FILES, -(-len(files) // TASKS))
        return [_Some(files[k : k + some]) for k in range(0, len(files), some)] or [_Some([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, _ = opened(self.path)
        for path in partition.files:
            split, name = path.split("/")[-2:]
            with system.open_input_stream(path) as file:
                for line in file.read().decode().split("\n"):
                    if line:
                        kind, *box = line.split(" ")
                        yield (split, name[:-4], int(kind), *map(float, box))


def write_labels(boxes: DataFrame, folder: str, classes: list[str], split: str = "train") -> None:
    """boxes (img_id, class_id, x1, y1, x2, y2, w, h: pixels) as label files; a picture's lines in the order of their boxes."""
    spark = boxes.sparkSession
    spark.dataSource.register(LabelFiles)
    share = boxes.selectExpr(f"'{_safe(split)}' AS split", "CAST(img_id AS string) AS img_id", "CAST(class_id AS int) AS class_id", "(x1 + x2) / 2.0 / w AS cx", "(y1 + y2) / 2.0 / h AS cy", "(x2 - x1) / CAST(w AS double) AS w", "(y2 - y1) / CAST(h AS double) AS h")
    typed = share.selectExpr(*(f"CAST({x.split()[0]} AS {x.split()[1]}) AS {x.split()[0]}" for x in SCHEMA.split(", ")))
    typed.repartition("img_id").sortWithinPartitions("img_id", "cx", "cy", "w", "h", "class_id").write.format(NAME).mode("overwrite").option("path", folder).option("classes", json.dumps(classes)).save()


def read_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes of label files."""
    spark.dataSource.register(LabelFiles)
    return spark.read.format(NAME).option("path", folder).load()
