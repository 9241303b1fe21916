"""Sinks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from dialoom.functions.jpeg import to_jpeg
from dialoom.sources import exists, file_system


def write_json_lines(df: DataFrame, path: str, mode: str = "error") -> None:
    """One object per line, written in parallel. Null fields stay (as ``null``)."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def _stream(spark: SparkSession, path: str, parts: Iterable[str]) -> None:
    """Write text to one file of any file system that the session knows, a megabyte at a time."""
    target, fs = file_system(spark, path)
    out, held, size = fs.create(target, True), [], 0
    try:
        for part in parts:
            held.append(part)
            size += len(part)
            if size >= 1 << 20:
                out.write(bytearray("".join(held).encode()))
                held, size = [], 0
        out.write(bytearray("".join(held).encode()))
    finally:
        out.close()


def write_json_array(df: DataFrame, path: str) -> int:
    """One pretty-printed top-level array in one file, for tools that need just that.

    Rows stream through the driver partition by partition; use :func:`write_json_lines`
    for anything large. Returns the number of rows.
    """
    n = 0

    def parts() -> Iterator[str]:
        nonlocal n
        yield "["
        for row in df.toLocalIterator():
            body = json.dumps(row.asDict(recursive=True), ensure_ascii=False, indent=2, default=str)
            yield (",\n" if n else "\n") + "\n".join("  " + line for line in body.split("\n"))
            n += 1
        yield "\n]\n" if n else "]\n"

    _stream(df.sparkSession, path, parts())
    return n


def write_predictions(df: DataFrame, path: str) -> int:
    """Predictions as one JSON array with the four fields that readers expect; returns their number."""
    return write_json_array(df.select("id", "question", "ground_truth", "prediction"), path)


def write_report(report: DataFrame, path: str) -> dict:
    """The one row of an evaluation report as a JSON object; returns it without the detail rows."""
    row = report.first().asDict(recursive=True)
    for x in row["results"]:
        x.pop("row_id", None)
        x.pop("pred_id", None)
    _stream(report.sparkSession, path, [json.dumps(row, ensure_ascii=False, indent=2, default=str)])
    return {k: v for k, v in row.items() if k != "results"}


def prepare_once(outputs: dict[str, DataFrame], folder: str) -> dict:
    """Write each named output below ``folder`` unless all of them are there; returns their counts and the status."""
    spark = next(iter(outputs.values())).sparkSession
    paths = {name: f"{folder.rstrip('/')}/{name}.jsonl" for name in outputs}
    cached = all(exists(spark, p) for p in paths.values())
    if not cached:
        for name, df in outputs.items():
            write_json_lines(df, paths[name], "overwrite")
    return {name: spark.read.text(p).count() for name, p in paths.items()} | {"status": "cached" if cached else "prepared"}


def write_images(df: DataFrame, folder: str, encoder: Callable[[bytes], bytes] = to_jpeg) -> DataFrame:
    """Write pictures as ``image_{id}.jpg`` on the executors; returns (id, path, image_ok).

    A picture that is there already is not written again. ``encoder`` turns bytes into the bytes to
    store: by default RGB JPEG of quality 95, with ``bytes`` as they are. A picture it fails on gets
    ``image_ok`` false, and so does a null one. ``folder`` must be a path that every executor mounts.
    """

    def save(batches):
        import os

        os.makedirs(folder, exist_ok=True)
        for pdf in batches:
            paths, good = [], []
            for key, data in zip(pdf["id"], pdf["image"]):
                path = os.path.join(folder, f"image_{key}.jpg")
                fine = os.path.exists(path)
                if not fine and data is not None:
                    try:
                        body = encoder(bytes(data))
                        part = f"{path}.{os.getpid()}.part"
                        with open(part, "wb") as f:
                            f.write(body)
                        os.replace(part, path)
                        fine = True
                    except Exception:  # an unreadable picture is a row, not a failure
                        fine = False
                paths.append(path)
                good.append(fine)
            yield pdf[["id"]].assign(path=paths, image_ok=good)

    return df.select("id", "image").mapInPandas(save, "id bigint, path string, image_ok boolean")
