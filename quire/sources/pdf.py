"""PDF files as tables.

`parse` reads each document once, in Arrow batches, and gives a row with the asked facets
as nested columns; `table` makes a facet's rows of it. A file that cannot be read is a row
with `error`, never a failed job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .document import Document
from .objects import PdfError

_BOX = "struct<l double, b double, r double, t double>"
_RUN = "seq int, text string, left double, bottom double, right double, top double, rotation int, space_after boolean, font_name string, font_size double, vertical boolean, rtl boolean"
FACETS = {
    "document": "version string, pages int, encrypted boolean, locked boolean, linearized boolean, xref_repaired boolean, page_mode string, page_layout string, form_type string, has_javascript boolean, xmp string, id_permanent string, id_update string",
    "info": "key string, value string",
    "pages": f"page int, media {_BOX}, crop {_BOX}, bleed {_BOX}, trim {_BOX}, art {_BOX}, rotate int, duration double",
    "labels": "start_page int, prefix string, style string, first int",
    "runs": f"page int, {_RUN}",
    "page_runs": f"page int, runs array<struct<{_RUN}>>",
    "fonts": "page int, resource string, base string, subtype string, encoding string, embedded string, is_subset boolean, to_unicode boolean",
    "elements": "page int, seq int, parent int, kind string, paint string, mode string, color array<double>",
    "images": "page int, seq int, width int, height int, error string, png binary",
    "operators": "page int, seq int, operator string, operands int",
    "attachments": "seq int, name string, description string, mime string, declared_size long, created string, modified string, data binary",
    "destinations": "name string, page int, kind string, left double, top double, right double, bottom double, zoom double",
    "outline": "node int, parent int, nth int, title string, is_open boolean, is_italic boolean, is_bold boolean, color array<double>, page int, zoom double",
    "layers": "seq int, id string, name string, intents array<string>, base string, is_on boolean, is_off boolean, view_state boolean, is_locked boolean",
    "annotations": f"page int, idx int, id string, subtype string, rect {_BOX}, flags int, is_open boolean, layer_visible boolean, parent_id string, popup_id string, contents string, title string, uri string, target_page int, n_points int",
    "markup": "page int, idx int, name string, subject string, icon string, modified string, reply_type string, state string, state_model string, intent string, rich_text string, default_style string, opacity double, color array<double>, interior array<double>, border struct<width double, horizontal_radius double, vertical_radius double, style string, dash array<double>>, quads array<double>, vertices array<double>, line array<double>, callout array<double>, differences array<double>, ink array<array<double>>, line_ends array<string>, has_appearance boolean",
    "objects": "obj int, gen int, kind string, type string, subtype string, length long, refs array<int>",
    "radio_groups": "`group` int, nth int, id string",
    "fields": "field int, parent int, nth int, name string, type string, flags int, values array<string>, defaults array<string>, appearance string, chosen array<int>, options array<struct<export string, display string>>, is_terminal boolean, n_widgets int",
    "actions": "owner string, path array<int>, kind string, uri string, name string, page int",
    "widgets": f"field int, idx int, page int, rect {_BOX}, flags int, states array<string>, state string",
    "svg": "page int, svg string",
    "bitmaps": "page int, width int, height int, png binary",
    "encryption": "version int, revision int, bits int, stream string, string string, embedded string, encrypt_metadata boolean, permissions int, is_owner boolean, is_locked boolean",
    "xref": "obj int, kind string, field1 long, field2 int",
    "diagnostics": "seq int, severity string, code string, message string, offset long",
}
CONTENT = ("runs", "page_runs", "fonts", "elements", "images", "operators")

#: A batch of parsed files ends at so many, or so many bytes of them, whichever comes first.
BATCH_FILES, BATCH_BYTES = 64, 1 << 18


def read_files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """path, content of files, as a batch or as they come."""
    if stream:
        return spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").load(path).select("path", "content")
    return spark.read.format("binaryFile").load(path).select("path", "content")


def facets_of(content: bytes, facets: list[str], owner: str | None = None, user: str | None = None, repair: bool = True, limits: dict | None = None) -> dict:
    """The facets of one file, each a list of rows; error is null or (kind, message)."""
    out: dict = {"error": None, **{f: None for f in facets}}
    try:
        document = Document(bytes(content), owner, user, repair, limits)
        whole = document.facet_content(set(facets)) if not document.locked and set(facets) & set(CONTENT) else {}
        for f in sorted(facets, key=lambda x: x == "diagnostics"):
            out[f] = whole.get(f, []) if f in CONTENT else [] if document.locked and f in ("annotations", "labels", "markup", "objects", "radio_groups") else getattr(document, f"facet_{f}")()
    except PdfError as e:
        out["error"] = {"kind": e.kind, "message": str(e)}
    except (RecursionError, MemoryError) as e:
        out["error"] = {"kind": "limit", "message": type(e).__name__}
    except Exception as e:  # noqa: BLE001  a damaged file must not end the job
        out["error"] = {"kind": "format", "message": f"{type(e).__name__}: {e}"}
    return out


def parse(files: DataFrame, facets: list[str], keys: list[str], repair: bool = True, limits: dict | None = None) -> DataFrame:
    """keys, error and the facets of each row of files (keys, content, and owner_password, user_password if there). Nothing is shuffled."""
    own = [c for c in ("owner_password", "user_password") if c in files.columns]
    chosen = files.select(*keys, "content", *own)
    nested = ", ".join(f"{f} array<struct<{FACETS[f]}>>" for f in facets)
    schema = StructType([*chosen.select(*keys).schema.fields, *StructType.fromDDL(f"error struct<kind string, message string>, {nested}").fields])
    arrow = to_arrow_schema(schema)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in rows:
            for i in range(batch.num_rows):
                one = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                found = facets_of(one["content"] or b"", facets, one.get("owner_password"), one.get("user_password"), repair, limits)
                held.append({**{k: one[k] for k in keys}, **found})
                size += len(one["content"] or b"")
                if size >= BATCH_BYTES or len(held) >= BATCH_FILES:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return chosen.mapInArrow(run, schema)


def table(parsed: DataFrame, facet: str, keys: list[str]) -> DataFrame:
    """A facet's rows."""
    return parsed.select(*keys, F.explode(facet).alias("_row")).select(*keys, "_row.*")
