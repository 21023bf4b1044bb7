"""Writers: single named files where the format asks for one, Spark's writers for tables that grow."""

from __future__ import annotations

import contextlib
import csv
import io
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared


def _spark() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def guard(path: str, overwrite: bool = False) -> str:
    """``path``, unless something is there and may not be replaced; on whatever store it names."""
    if shared.exists(_spark(), path) and not overwrite:
        raise FileExistsError(f"{path} exists; pass overwrite to replace it")
    return path


@contextlib.contextmanager
def _opened(path: str) -> Iterator[io.TextIOWrapper]:
    """A text file to write, on whatever store its path names; it takes its place once it is whole."""
    store, there = shared.hadoop(_spark(), path)
    if store.getScheme() == "file":
        store = store.getRaw()  # without a checksum file beside each
    aside = there.suffix(f".{uuid.uuid4().hex}.tmp")
    raw = store.create(aside, True)
    held = bytearray()

    def flush() -> None:
        if held:
            raw.write(bytes(held))
            held.clear()

    class Out(io.RawIOBase):
        def writable(self) -> bool:
            return True

        def write(self, data) -> int:
            held.extend(data)
            if len(held) > 1 << 20:
                flush()
            return len(data)

    text = io.TextIOWrapper(Out(), encoding="utf-8", newline="", write_through=True)
    try:
        yield text
        text.flush()
        flush()
        raw.close()
    except BaseException:
        raw.close()
        store.delete(aside, False)
        raise
    store.delete(there, True)
    if not store.rename(aside, there):
        raise OSError(f"could not write {path}")


def append_columns(existing: list[str], new: list[str]) -> list[str]:
    """``existing`` in their order, then the new names that they lack."""
    return [*existing, *[c for c in new if c not in existing]]


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, order: list | None = None, overwrite: bool = False) -> None:
    """One named CSV, streamed row by row through the driver; missing columns and nulls are blank."""
    guard(path, overwrite)
    columns = columns or df.columns
    rows = df.orderBy(*order) if order else df
    rows = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])
    with _opened(path) as f:
        out = csv.writer(f)
        out.writerow(columns)
        for r in rows.toLocalIterator():
            out.writerow(r)


def write_jsonl(df: DataFrame, path: str, order: list | None = None, overwrite: bool = False, compression: str | None = None) -> None:
    """JSON lines as a folder of part files that read back in order; ``compression`` is that of Spark's JSON writer."""
    if order:
        df = df.orderBy(*order)
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path, compression=compression)


def write_manifest(df: DataFrame, path: str, added: list[str] = (), overwrite: bool = False) -> None:
    """A manifest CSV: source columns in their order, then the added ones, rows in ``row_idx`` order."""
    columns = append_columns([c for c in df.columns if c not in ("row_idx", *added)], list(added))
    write_csv(df, path, columns, ["row_idx"] if "row_idx" in df.columns else None, overwrite)


def png_bytes(mask: list[list[bool]]) -> bytes:
    """An 8-bit grey PNG of a mask, 0 and 255."""
    h, w = len(mask), len(mask[0])
    raw = b"".join(b"\0" + bytes(255 if v else 0 for v in row) for row in mask)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def task_store(path: str):
    """(file system, path in it) in a task, where there is no JVM to ask."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + quote(os.path.abspath(path.removeprefix("file:"))))


def write_files(files: DataFrame, path: str = "path", content: str = "content") -> int:
    """Writes each row's bytes to its path, by the tasks, on whatever store it names; a file takes its place once it is whole.  How many."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, data in zip(b.column(path).to_pylist(), b.column(content).to_pylist(), strict=True):
                store, there = task_store(p)
                store.create_dir(os.path.dirname(there), recursive=True)
                aside = f"{there}.{uuid.uuid4().hex}.tmp"
                with store.open_output_stream(aside) as f:
                    f.write(data)
                store.move(aside, there)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return files.select(path, content).mapInArrow(made, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_masks(masks: DataFrame, path_column: str = "mask_path") -> int:
    """Writes each row's ``mask`` to its path as a PNG.  How many."""

    @F.pandas_udf("binary")
    def png(values: pd.Series) -> pd.Series:
        return pd.Series([png_bytes([list(r) for r in m]) for m in values], dtype="object")

    return write_files(masks.select(F.col(path_column).alias("path"), png("mask").alias("content")))


def write_json(document: dict, path: str, overwrite: bool = True) -> None:
    guard(path, overwrite)
    write_text(json.dumps(document, indent=2, sort_keys=True, ensure_ascii=False) + "\n", path)


def write_text(text: str, path: str) -> None:
    with _opened(path) as f:
        f.write(text)


def append_status(path: str, model: str, status: str, result_md: str = "", message: str = "") -> None:
    """Adds a line: what is there is read and written anew, as not every store can append."""
    line = json.dumps({"model": model, "status": status, "result_md": result_md, "message": message}, ensure_ascii=False) + "\n"
    before = ""
    if shared.exists(_spark(), path):
        before = bytes(_spark().read.format("binaryFile").load(path).first().content).decode("utf-8")
    write_text(before + line, path)
