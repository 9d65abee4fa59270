"""Files written by executors: saved documents, attachments, PNG and SVG pages."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save(rows: DataFrame, name: str, content: str, folder: str) -> tuple[int, int]:
    """Writes a file for each row into the folder, byte for byte (text in UTF-8), and returns their number and bytes.

    Names must be unique (policy.unique_names) and plain; a null content makes no file. The
    folder must be one that all executors share. A file appears whole, under another name
    first, so a task that runs again replaces what it wrote. Nothing is collected but two sums.
    """
    found = rows.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content")).where("content is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
        store.create_dir(base, recursive=True)
        for batch in batches:
            size = 0
            for i in range(batch.num_rows):
                file, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if not file or file in (".", "..") or set(file) & set("/\\\0"):
                    raise ValueError(f"not a plain file name: {file!r}")
                first = f"{base}/.{uuid.uuid4().hex}"
                with store.open_output_stream(first) as out:
                    out.write(data)
                store.move(first, f"{base}/{file}")
                size += len(data)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([size], pa.int64())], ["files", "bytes"])

    total = found.mapInArrow(run, "files long, bytes long").agg(F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    return total.files, total.bytes
