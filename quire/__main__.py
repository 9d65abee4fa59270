"""python -m quire COMMAND FILES [--page N] [--out FOLDER] [--password TEXT]: facets of files as JSON lines, or files in a folder.

FILES is a path, a folder or a glob. Commands with files: render and images (PNG), svg, attachments.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import layout, policy
from .sources import pdf, sinks

TABLES = {"info": ["document", "info", "encryption", "diagnostics"], "fonts": ["fonts"], "annotations": ["annotations", "markup"], "outline": ["outline"], "forms": ["fields", "widgets"], "layers": ["layers", "radio_groups"], "graphics": ["elements"], "images": ["images"], "attachments": ["attachments"]}
FILES = {"render": ("bitmaps", "png", "png"), "svg": ("svg", "svg", "svg"), "images": ("images", "png", "png"), "attachments": ("attachments", "data", "")}


def _named(rows: DataFrame, command: str) -> DataFrame:
    """rows with unique file names: attachments have their own, others have the file's, the page and the place."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    parts = [stem, *[(F.col(c) + int(c == "page")).cast("string") for c in ("page", "seq") if c in rows.columns]]
    name = F.col("name") if command == "attachments" else F.concat(F.array_join(F.array(*parts), "-"), F.lit(f".{FILES[command][2]}"))
    keys = [c for c in ("path", "page", "seq") if c in rows.columns]
    return policy.unique_names(rows.withColumn("of", F.lit(0)).withColumn("name", name), ["of"], "name", keys)


def main(arguments: list[str], spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser("quire", description=__doc__)
    parser.add_argument("command", choices=sorted({*TABLES, *FILES, "text", "version"}))
    parser.add_argument("files", nargs="?")
    parser.add_argument("--page", type=int, help="a page's number, from 1")
    parser.add_argument("--layout", choices=("physical", "raw", "reading"), default="physical")
    parser.add_argument("--out")
    parser.add_argument("--password")
    asked = parser.parse_args(arguments)
    if asked.command == "version":
        print("quire 2")
        return 0
    if not asked.files:
        parser.error("FILES is missing")
    spark = spark or SparkSession.builder.getOrCreate()
    files = pdf.read_files(spark, asked.files)
    if asked.password is not None:
        files = files.withColumn("owner_password", F.lit(asked.password)).withColumn("user_password", F.lit(asked.password))
    writes = asked.command in FILES and (asked.out or asked.command not in TABLES)
    facets = [FILES[asked.command][0]] if writes else ["runs"] if asked.command == "text" else TABLES[asked.command]
    parsed = pdf.parse(files, [*facets, "document"] if "document" not in facets else facets, ["path"])
    failed = parsed.where("error is not null or document[0].locked").select("path", F.coalesce("error.message", F.lit("locked")).alias("message"))
    if asked.page is not None:
        short = parsed.where(F.lit(asked.page < 1) | (F.col("document")[0]["pages"] < asked.page)).select("path", F.lit(f"no page {asked.page}").alias("message"))
        failed = failed.unionByName(short)
    of_page = lambda rows: rows.where(F.col("page") == asked.page - 1) if asked.page is not None and "page" in rows.columns else rows
    if writes:
        facet, content, _ = FILES[asked.command]
        if not asked.out:
            parser.error("--out is missing")
        count, size = sinks.save(_named(of_page(pdf.table(parsed, facet, ["path"])), asked.command), "file_name", content, asked.out)
        print(f"{count} files, {size} bytes")
    elif asked.command == "text":
        for row in layout.page_text(of_page(pdf.table(parsed, "runs", ["path"])), ["path", "page"], asked.layout).orderBy("path", "page").toLocalIterator():
            print(row.text, end="\f\n")
    else:
        for facet in facets:
            for row in of_page(pdf.table(parsed, facet, ["path"])).select(F.to_json(F.struct(F.lit(facet).alias("table"), "*")).alias("line")).toLocalIterator():
                print(row.line)
    status = 0
    for row in failed.toLocalIterator():
        print(f"error: {row.path}: {row.message}", file=sys.stderr)
        status = 1
    return status


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
