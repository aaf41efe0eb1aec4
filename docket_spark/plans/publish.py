"""Versioned publication on any Hadoop file system.

A generation is written complete under its own folder; readers follow a one-line pointer file that
is replaced last. A job that dies anywhere before that leaves the previous generation current.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

GENERATIONS = "_generations"
POINTER = "_current"
REPORT = "report.json"


class SharedFiles:
    """Small control files next to the data, through Spark's own file system layer."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def qualified(self, path: str) -> str:
        return self._fs(path).makeQualified(self._path(path)).toString()

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def delete(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)

    def read_text(self, path: str) -> str:
        stream = self._fs(path).open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        stream = self._fs(path).create(self._path(path), False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def _rename(self, source: str, target: str, mode: str) -> None:
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._path(self.qualified(target)).toUri(), self._conf
        )
        option = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._jvm.java.lang.reflect.Array.newInstance(option.NONE.getClass(), 1)
        options[0] = getattr(option, mode)
        context.rename(self._path(source), self._path(target), options)

    def move_new(self, source: str, target: str) -> None:
        """Rename; fails when the target exists."""
        self._rename(source, target, "NONE")

    def replace_text(self, path: str, text: str) -> None:
        pending = f"{path}.{uuid.uuid4().hex}"
        self.write_text(pending, text)
        self._rename(pending, path, "OVERWRITE")


def require_separate(spark: SparkSession, *paths: str) -> None:
    """Inputs and outputs must be different places, none inside another."""
    files = SharedFiles(spark)
    places = [files.qualified(path).rstrip("/") + "/" for path in paths]
    for i, left in enumerate(places):
        for right in places[i + 1 :]:
            if left.startswith(right) or right.startswith(left):
                raise ValueError("source, data and report locations must not overlap")


def publish_generation(
    spark: SparkSession,
    root: str,
    write: Callable[[str], Any],
    report: Callable[[str], Mapping[str, Any]],
    base: str | None = None,
) -> dict[str, Any]:
    """Write data, derive its report from what was written, then switch the pointer.

    ``base`` is the folder of the generation this one was made from. If another one is current by
    the time of the switch, nothing is published, so that no update is lost.

    ``write`` gets the new generation's folder. ``report`` gets the same folder and raises when
    the written data does not reconcile; the generation is then removed and never seen.
    """
    files = SharedFiles(spark)
    name = uuid.uuid4().hex
    folder = f"{root}/{GENERATIONS}/{name}"
    try:
        write(folder)
        content = dict(report(folder))
        files.write_text(
            f"{folder}/{REPORT}", json.dumps(content, indent=2, sort_keys=True, default=str) + "\n"
        )
        if base is not None and current_folder(spark, root) != base:
            raise RuntimeError("the base generation was replaced meanwhile; refresh again")
    except Exception:
        files.delete(folder)
        raise
    files.replace_text(f"{root}/{POINTER}", name + "\n")
    return content


def current_folder(spark: SparkSession, root: str) -> str:
    """Folder of the current generation; an absent or malformed pointer is an error."""
    files = SharedFiles(spark)
    pointer = f"{root}/{POINTER}"
    if not files.exists(pointer):
        raise FileNotFoundError(f"no current generation under {root}")
    name = files.read_text(pointer).strip()
    if len(name) != 32 or set(name) - set("0123456789abcdef"):
        raise ValueError("pointer must name one generation")
    folder = f"{root}/{GENERATIONS}/{name}"
    if not files.exists(f"{folder}/{REPORT}"):
        raise ValueError("pointer names an incomplete generation")
    return folder


def has_current(spark: SparkSession, root: str) -> bool:
    return SharedFiles(spark).exists(f"{root}/{POINTER}")


def current_report(spark: SparkSession, root: str) -> tuple[dict[str, Any], str]:
    """Report of the current generation and the SHA-256 of its bytes."""
    text = SharedFiles(spark).read_text(f"{current_folder(spark, root)}/{REPORT}")
    return json.loads(text), hashlib.sha256(text.encode()).hexdigest()


def write_run(
    spark: SparkSession, root: str, outputs: Mapping[str, DataFrame], run_id: str | None = None
) -> str:
    """Write one run's outputs as JSON under its id. A run id is used once and never replaced."""
    run_id = uuid.uuid4().hex if run_id is None else run_id
    if not run_id or "/" in run_id or run_id in {".", ".."} or run_id.startswith("_"):
        raise ValueError("run_id must be a single directory name")
    files = SharedFiles(spark)
    target = f"{root}/{run_id}"
    if files.exists(target):
        raise FileExistsError(f"run already exists: {target}")
    staging = f"{root}/_staging-{uuid.uuid4().hex}"
    try:
        for name, frame in outputs.items():
            frame.write.mode("errorifexists").json(f"{staging}/{name}")
        files.move_new(staging, target)
    except Exception:
        files.delete(staging)
        raise
    return target
