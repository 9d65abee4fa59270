"""One PDF file as rows of facets: raw facts only, which the views turn into answers."""

from __future__ import annotations

import re

from .content import Page
from .crypto import Security
from .filters import decode
from .fonts import Font
from .images import image_facts, png
from .objects import Name, Objects, PdfError, Ref, Stream, text
from .render import raster, svg

ACTIONS = {"GoTo", "GoToR", "GoToE", "Launch", "URI", "Named", "JavaScript", "SubmitForm", "ResetForm", "ImportData", "Hide", "SetOCGState", "Sound", "Movie"}
INHERITED = ("MediaBox", "CropBox", "BleedBox", "TrimBox", "ArtBox", "Resources", "Rotate")
FORM_KEYS = ("FT", "Ff", "V", "DV", "DA", "Q", "MaxLen", "Opt", "TI", "I")

# Border styles by their names in files.
BORDERS = {"D": "Dashed", "B": "Beveled", "I": "Inset", "U": "Underline"}
KINDS = ((Stream, "stream"), (dict, "dictionary"), (list, "array"), (Name, "name"), (bytes, "string"), (bool, "boolean"), (int, "integer"), (float, "real"))


def number(x) -> float | None:
    return float(x) if type(x) in (int, float) else None


class Document:
    def __init__(self, content: bytes, owner_password: str | None = None, user_password: str | None = None, repair: bool = True, limits: dict | None = None):
        self.objects = Objects(content, repair, limits)
        self.fonts: dict[Ref, Font] = {}
        self.repair, self.security, self.locked = repair, None, False
        spec = self.objects.get(self.objects.trailer, "Encrypt", dict)
        if spec:
            words = [w.encode("latin-1" if self.objects.get(spec, "V", int) != 5 else "utf-8", "replace") for w in (owner_password, user_password) if w is not None] + [b""]
            self.security = Security(self.objects, spec, words)
            self.locked = self.security.key is None
            if self.locked:
                self.objects.note("security.locked", "no password opens the document")
            else:
                skip = self.objects.trailer.get("Encrypt")
                held = spec
                self.objects.cache.clear()
                self.objects.members.clear()
                self.objects.decrypt = self.security.decrypt
                if isinstance(skip, Ref):
                    self.objects.cache[skip.obj] = held
        self.catalog = self.objects.get(self.objects.trailer, "Root", dict) or {}
        self.pages: list[dict] = [] if self.locked else self._pages()
        self.refs = {p["ref"]: i for i, p in enumerate(self.pages) if p["ref"]}
        self.layers, self.states = ([], {}) if self.locked else self._layers()
        self._names: dict[str, object] | None = None

    def get(self, holder, key, kind=None):
        return self.objects.get(holder, key, kind)

    # pages

    def _pages(self) -> list[dict]:
        out, seen = [], set()
        root = self.catalog.get("Pages")

        def walk(value, inherited: dict, depth: int) -> None:
            ref = value if isinstance(value, Ref) else None
            node = self.objects.resolve(value)
            if not isinstance(node, dict) or depth > self.objects.limits["depth"] or (ref and ref in seen):
                if depth > self.objects.limits["depth"]:
                    raise PdfError("limit", "the page tree is too deep")
                raise PdfError("format", "bad node in the page tree")
            if ref:
                seen.add(ref)
            own = inherited | {k: node[k] for k in INHERITED if k in node}
            kids = self.get(node, "Kids", list)
            if kids is None or self.get(node, "Type") == "Page":
                out.append({"ref": ref, "dict": node, **{k: self.objects.resolve(own.get(k)) for k in INHERITED}})
                if len(out) > self.objects.limits["pages"]:
                    raise PdfError("limit", "too many pages")
                return
            for kid in kids:
                try:
                    walk(kid, own, depth + 1)
                except (PdfError, RecursionError) as e:
                    if not self.repair or isinstance(e, PdfError) and e.kind == "limit":
                        raise
                    self.objects.note("page-tree.repaired", str(e))

        try:
            walk(root, {}, 0)
        except PdfError as e:
            if not self.repair or e.kind == "limit":
                raise
            self.objects.note("page-tree.repaired", str(e))
        if not out and self.repair:
            for n, entry in sorted(self.objects.entries.items()):
                ref = Ref(n, 0 if entry.kind == "c" else entry.b)
                try:
                    node = self.objects.resolve(ref)
                except PdfError:
                    continue
                if isinstance(node, dict) and node.get("Type") == "Page":
                    out.append({"ref": ref, "dict": node, **{k: self.objects.resolve(node.get(k)) for k in INHERITED}})
        told = self.get(self.get(self.catalog, "Pages"), "Count", int)
        if told is not None and told != len(out):
            self.objects.note("page-tree.count-mismatch", f"/Count is {told}, pages are {len(out)}")
        return out

    def box(self, value) -> dict | None:
        cells = [number(self.objects.resolve(x)) for x in value] if isinstance(value, list) else []
        return dict(zip("lbrt", cells)) if len(cells) == 4 and None not in cells else None

    def facet_pages(self) -> list[dict]:
        return [
            {"page": i, "media": self.box(p["MediaBox"]), "crop": self.box(p["CropBox"]), "bleed": self.box(p["BleedBox"]), "trim": self.box(p["TrimBox"]), "art": self.box(p["ArtBox"]), "rotate": p["Rotate"] if type(p["Rotate"]) is int else 0, "duration": self.get(p["dict"], "Dur", float)}
            for i, p in enumerate(self.pages)
        ]

    def facet_labels(self) -> list[dict]:
        return [{"start_page": k, "prefix": text(self.get(v, "P")), "style": str(self.get(v, "S") or ""), "first": self.get(v, "St", int) or 1} for k, v in self.tree(self.get(self.catalog, "PageLabels"), "Nums") if type(k) is int and isinstance(v, dict)]

    def tree(self, root, leaf: str):
        """(key, value) of a name or number tree, in its order."""
        out, seen = [], set()

        def walk(node, depth: int) -> None:
            node = self.objects.resolve(node)
            if not isinstance(node, dict) or id(node) in seen or depth > self.objects.limits["depth"]:
                return
            seen.add(id(node))
            items = self.get(node, leaf, list) or []
            out.extend((self.objects.resolve(k), self.objects.resolve(v)) for k, v in zip(items[::2], items[1::2]))
            for kid in self.get(node, "Kids", list) or []:
                walk(kid, depth + 1)

        walk(root, 0)
        return out

    # document

    def facet_document(self) -> list[dict]:
        s, ids = self.security, self.get(self.objects.trailer, "ID", list) or []
        ids = [self.objects.resolve(x) for x in ids]
        whole = len(ids) == 2 and all(isinstance(x, bytes) for x in ids)
        form = self.get(self.catalog, "AcroForm", dict)
        xmp = None if self.locked else self.get(self.catalog, "Metadata", Stream)
        script = self.get(self.get(self.catalog, "Names", dict), "JavaScript") is not None or self.get(self.get(self.catalog, "OpenAction", dict), "S") == "JavaScript"
        first = re.match(rb"%PDF[^\n\r]*[\r\n]+(?:%[^\n\r]*[\r\n]+)?\s*\d+\s+\d+\s+obj\s*<<[^>]*/Linearized", self.objects.data[:4096])
        return [{
            "version": (str(self.get(self.catalog, "Version") or "") or self.objects.version.decode()), "pages": len(self.pages), "encrypted": s is not None, "locked": self.locked, "linearized": bool(first), "xref_repaired": self.objects.repaired,
            "page_mode": str(self.get(self.catalog, "PageMode") or "UseNone"), "page_layout": str(self.get(self.catalog, "PageLayout") or "NoLayout"), "form_type": "None" if form is None else "Xfa" if "XFA" in form else "AcroForm", "has_javascript": script,
            "xmp": decode(xmp, self.objects, self.objects.limits["decoded_bytes"]).decode("utf-8", "replace") if xmp else "", "id_permanent": ids[0].hex() if whole else None, "id_update": ids[1].hex() if whole else None,
        }]

    def facet_info(self) -> list[dict]:
        info = {} if self.locked else self.get(self.objects.trailer, "Info", dict) or {}
        shown = lambda v: text(v) if isinstance(v, (bytes, Name)) else str(v).lower() if isinstance(v, bool) else f"{v:g}" if type(v) in (int, float) else ""
        return [{"key": k, "value": shown(self.objects.resolve(v))} for k, v in sorted(info.items())]

    def facet_encryption(self) -> list[dict]:
        s = self.security
        return [{"version": s.version, "revision": s.revision, "bits": s.bits, "stream": s.stream, "string": s.string, "embedded": s.embedded, "encrypt_metadata": s.metadata, "permissions": s.p, "is_owner": s.owner, "is_locked": self.locked}] if s else []

    def facet_diagnostics(self) -> list[dict]:
        return [{"seq": i, "severity": a, "code": b, "message": c, "offset": d} for i, (a, b, c, d) in enumerate(self.objects.diagnostics)]

    def facet_xref(self) -> list[dict]:
        return [{"obj": n, "kind": e.kind, "field1": e.a, "field2": e.b} for n, e in sorted(self.objects.entries.items())]

    def facet_attachments(self) -> list[dict]:
        out = []
        for key, spec in [] if self.locked else self.tree(self.get(self.get(self.catalog, "Names", dict), "EmbeddedFiles"), "Names"):
            holder = self.get(spec, "EF", dict) or {}
            stream = self.get(holder, "UF", Stream) or self.get(holder, "F", Stream)
            if stream is None:
                continue
            params = self.get(stream, "Params", dict) or {}
            data = decode(stream, self.objects, self.objects.limits["decoded_bytes"])
            out.append({"seq": len(out), "name": text(self.get(spec, "UF")) or text(self.get(spec, "F")) or text(key), "description": text(self.get(spec, "Desc")), "mime": str(self.get(stream, "Subtype") or ""), "declared_size": self.get(params, "Size", int), "created": text(self.get(params, "CreationDate")), "modified": text(self.get(params, "ModDate")), "data": data})
        return out

    # destinations, actions, outline

    def named(self) -> dict[str, object]:
        if self._names is None:
            self._names = {str(k): v for k, v in (self.get(self.catalog, "Dests", dict) or {}).items()}
            self._names |= {text(k): v for k, v in self.tree(self.get(self.get(self.catalog, "Names", dict), "Dests"), "Names")}
        return self._names

    def destination(self, value) -> dict | None:
        seen = set()
        value = self.objects.resolve(value)
        while isinstance(value, (bytes, Name)) or isinstance(value, dict):
            if isinstance(value, dict):
                value = self.objects.resolve(value.get("D"))
                continue
            key = text(value) if isinstance(value, bytes) else str(value)
            if key in seen:
                self.objects.note("destination.named.circular", f"destination {key} leads to itself")
                return None
            seen.add(key)
            value = self.objects.resolve(self.named().get(key))
        if not isinstance(value, list) or not value:
            return None
        target = value[0]
        page = self.refs.get(target) if isinstance(target, Ref) else target if type(target) is int else None
        rest = [number(self.objects.resolve(x)) for x in value[2:]] + [None] * 4
        kind = str(self.objects.resolve(value[1])) if len(value) > 1 else "Fit"
        at = {"XYZ": {"left": rest[0], "top": rest[1], "zoom": rest[2]}, "FitH": {"top": rest[0]}, "FitBH": {"top": rest[0]}, "FitV": {"left": rest[0]}, "FitBV": {"left": rest[0]}, "FitR": {"left": rest[0], "bottom": rest[1], "right": rest[2], "top": rest[3]}}.get(kind, {})
        return {"page": page, "kind": kind, **{k: at.get(k) for k in ("left", "top", "right", "bottom", "zoom")}}

    def facet_destinations(self) -> list[dict]:
        out = []
        for name in sorted({} if self.locked else self.named()):
            found = self.destination(name.encode("latin-1", "replace") if name.isascii() else Name(name))
            out.append({"name": name, **(found or {"page": None, "kind": None, "left": None, "top": None, "right": None, "bottom": None, "zoom": None})})
        return out

    def action(self, value, scope: str) -> list[dict]:
        """The action and those after it, each with its path."""
        out, seen = [], set()

        def walk(value, path: list[int]) -> None:
            got = self.objects.resolve(value)
            if not isinstance(got, dict):
                return
            if id(got) in seen or len(path) > self.objects.limits["depth"]:
                self.objects.note(f"{scope}.action.circular", "an action follows itself")
                return
            seen.add(id(got))
            kind = str(self.get(got, "S") or "")
            at = self.destination(got.get("D")) if kind == "GoTo" else None
            out.append({"path": path, "kind": kind if kind in ACTIONS else "Unsupported", "uri": text(self.get(got, "URI")) or None, "name": str(self.get(got, "N") or "") or None, "page": at["page"] if at else None})
            after = self.get(got, "Next")
            for i, x in enumerate(after if isinstance(after, list) else [got.get("Next")] if after is not None else []):
                walk(x, [*path, i])

        walk(value, [0])
        return out

    def facet_outline(self) -> list[dict]:
        out, seen = [], set()
        todo = [(self.get(self.catalog, "Outlines", dict) or {}, None)]
        if self.locked:
            return []
        while todo:
            holder, parent = todo.pop()
            value, nth, before = holder.get("First"), 0, None
            while value is not None:
                node = self.objects.resolve(value)
                if not isinstance(node, dict):
                    self.objects.note("outline.node.invalid", "an outline item is no dictionary")
                    break
                if id(node) in seen:
                    self.objects.note("outline.node.repeated", "an outline item comes twice")
                    break
                seen.add(id(node))
                if len(out) >= self.objects.limits["outline_items"]:
                    raise PdfError("limit", "too many outline items")
                if self.get(node, "Prev", dict) is not before and before is not None:
                    self.objects.note("outline.prev.mismatch", "/Prev is not the item before")
                target = self.destination(node.get("Dest")) if "Dest" in node else None
                actions = self.action(node.get("A"), "outline")
                flags = self.get(node, "F", int) or 0
                color = [number(self.objects.resolve(x)) or 0.0 for x in self.get(node, "C", list) or []]
                out.append({"node": len(out), "parent": parent, "nth": nth, "title": text(self.get(node, "Title")), "is_open": (self.get(node, "Count", int) or 0) > 0, "is_italic": bool(flags & 1), "is_bold": bool(flags & 2), "color": color, "page": target["page"] if target else actions[0]["page"] if actions else None, "zoom": target["zoom"] if target else None})
                todo.append((node, len(out) - 1))
                before, value, nth = node, node.get("Next"), nth + 1
        return out

    # layers

    def _layers(self) -> tuple[list[dict], dict]:
        spec = self.get(self.catalog, "OCProperties", dict)
        if not spec:
            return [], {}
        config = self.get(spec, "D", dict) or {}
        listed = lambda k: {x for x in self.get(config, k, list) or [] if isinstance(x, Ref)}
        on, off, locked = listed("ON"), listed("OFF"), listed("Locked")
        base = str(self.get(config, "BaseState") or "ON")
        out, states = [], {}
        for i, ref in enumerate(dict.fromkeys(x for x in self.get(spec, "OCGs", list) or [] if isinstance(x, Ref))):
            group = self.objects.resolve(ref)
            if not isinstance(group, dict):
                self.objects.note("optional-content.group.invalid", "a layer is no dictionary")
                continue
            intent = self.get(group, "Intent")
            intents = [str(self.objects.resolve(x)) for x in intent] if isinstance(intent, list) else [str(intent or "View")]
            view = self.get(self.get(self.get(group, "Usage", dict), "View", dict), "ViewState")
            automatic = any(self.get(x, "Event") == "View" and ref in (self.get(x, "OCGs", list) or []) for x in map(self.objects.resolve, self.get(config, "AS", list) or []))
            view = (view == "ON") if view is not None and automatic else None
            out.append({"seq": i, "id": f"{ref.obj}:{ref.gen}", "name": text(self.get(group, "Name")), "intents": list(dict.fromkeys(intents)), "base": base, "is_on": ref in on, "is_off": ref in off, "view_state": view, "is_locked": ref in locked})
            states[ref] = view if view is not None else False if ref in off else True if ref in on else base != "OFF"
        return out, states

    def facet_layers(self) -> list[dict]:
        return self.layers

    def expression(self, value, depth: int = 0) -> bool:
        if isinstance(value, Ref) and value in self.states:
            return self.states[value]
        got = self.objects.resolve(value)
        if not isinstance(got, list) or not got or depth > 32:
            return True
        parts = [self.expression(x, depth + 1) for x in got[1:]]
        return {"And": all(parts), "Or": any(parts), "Not": not parts[0] if len(parts) == 1 else True}.get(str(got[0]), True)

    def layer_visible(self, value) -> bool:
        if value is None or not self.states:
            return True
        if isinstance(value, Ref) and value in self.states:
            return self.states[value]
        got = self.objects.resolve(value)
        if not isinstance(got, dict) or self.get(got, "Type") != "OCMD":
            return True
        if "VE" in got:
            return self.expression(got["VE"])
        groups = self.get(got, "OCGs")
        groups = groups if isinstance(groups, list) else [got.get("OCGs")]
        on = [self.states[g] for g in dict.fromkeys(x for x in groups if isinstance(x, Ref)) if g in self.states]
        return {"AllOn": all(on), "AnyOff": not all(on), "AllOff": not any(on)}.get(str(self.get(got, "P") or ""), any(on)) if on else True

    def marked_visible(self, resources: dict, operands: list) -> bool:
        if len(operands) < 2 or operands[0] != "OC":
            return True
        return self.layer_visible((self.get(resources, "Properties", dict) or {}).get(str(operands[1])))

    # content

    def page(self, i: int, wanted: set[str] | None = None) -> Page:
        p = self.pages[i]
        return Page(self, p["dict"], p["Resources"] if isinstance(p["Resources"], dict) else {}, wanted)

    def facet_content(self, wanted: set[str]) -> dict[str, list[dict]]:
        """Those of runs, page_runs, fonts, elements, images and operators that are wanted, of all pages, each page interpreted once."""
        out: dict[str, list[dict]] = {"runs": [], "page_runs": [], "fonts": [], "elements": [], "images": [], "operators": []}
        for i in range(len(self.pages)):
            page = self.page(i, wanted)
            out["runs"] += [{"page": i, **r} for r in page.runs] if "runs" in wanted else []
            out["page_runs"] += [{"page": i, "runs": page.runs}] if "page_runs" in wanted else []
            out["elements"] += "elements" in wanted and [{"page": i, "seq": e["seq"], "parent": e["parent"], "kind": e["kind"], "paint": e.get("paint"), "mode": e.get("mode"), "color": list(e.get("color") or [])} for e in page.elements] or []
            out["operators"] += "operators" in wanted and [{"page": i, "seq": k, "operator": op, "operands": n} for k, (op, n) in enumerate(page.operators)] or []
            resources = self.pages[i]["Resources"]
            for name in sorted(self.get(resources, "Font", dict) or {}) if "fonts" in wanted and isinstance(resources, dict) else []:
                f = page.font(resources, name)
                out["fonts"].append({"page": i, "resource": name, "base": f.base, "subtype": f.subtype, "encoding": f.encoding, "embedded": f.embedded, "is_subset": f.is_subset, "to_unicode": f.to_unicode is not None})
            for e in page.elements if "images" in wanted else []:
                if e["kind"] == "image" and e["parent"] is None:
                    out["images"].append({"page": i, "seq": e["seq"], **image_facts(self, e["image"], resources if isinstance(resources, dict) else {})})
        return out

    def facet_svg(self) -> list[dict]:
        return [{"page": i, "svg": svg(self, i)} for i in range(len(self.pages))]

    def facet_bitmaps(self) -> list[dict]:
        out = []
        for i in range(len(self.pages)):
            pixels = raster(self, i)
            out.append({"page": i, "width": pixels.shape[1], "height": pixels.shape[0], "png": png(pixels)})
        return out

    def facet_actions(self) -> list[dict]:
        """Actions of outline items, annotations and the document's opening, a row per node of each one's tree."""
        owners: list[tuple[str, object, str]] = [("open", self.catalog.get("OpenAction"), "document")]
        for i, p in enumerate(self.pages):
            for k, value in enumerate(self.get(p["dict"], "Annots", list) or []):
                got = self.objects.resolve(value)
                if isinstance(got, dict) and "A" in got:
                    owners.append((f"annotation {i} {k}", got["A"], "annotation"))
        return [{"owner": owner, **row} for owner, value, scope in owners for row in self.action(value, scope)]

    def facet_widgets(self) -> list[dict]:
        """Widgets of fields with their pages: by the page's annotations, else by /P, else unmapped. The state of a button is V before AS for check boxes and radio buttons, AS before V for others, if the appearance has it, then Off, then the first by name."""
        out, placed = [], {}
        for i, p in enumerate(self.pages):
            for value in self.get(p["dict"], "Annots", list) or []:
                placed.setdefault(id(self.objects.resolve(value)), i)

        def walk(value, field: int, kind: str, flags: int, chosen, depth: int) -> int:
            got = self.objects.resolve(value)
            if not isinstance(got, dict) or depth > self.objects.limits["depth"]:
                return field
            own, field = field, field + 1
            kind, flags = str(self.get(got, "FT") or kind), self.get(got, "Ff", int) if self.get(got, "Ff", int) is not None else flags
            chosen = got.get("V", chosen)
            kids = self.get(got, "Kids", list) or []
            below = [k for k in kids if "T" in (self.objects.resolve(k) or {})]
            for k in below:
                field = walk(k, field, kind, flags, chosen, depth + 1)
            for i, w in enumerate([] if below else kids or [value]):
                w = self.objects.resolve(w)
                if isinstance(w, dict):
                    states = self.get(self.get(w, "AP", dict), "N")
                    names = sorted(states) if isinstance(states, dict) else []
                    v, now = self.objects.resolve(chosen), self.get(w, "AS")
                    order = [v, now] if kind == "Btn" and not flags & 1 << 16 else [now, v]
                    state = next((str(x) for x in [*order, "Off", *names] if x is not None and str(x) in names), None)
                    page = placed.get(id(w), self.refs.get(w.get("P")))
                    out.append({"field": own, "idx": i, "page": page, "rect": self.box(self.get(w, "Rect")), "flags": self.get(w, "F", int) or 0, "states": names, "state": state})
            return field

        field = 0
        for x in [] if self.locked else self.get(self.get(self.catalog, "AcroForm", dict), "Fields", list) or []:
            field = walk(x, field, "", 0, None, 0)
        return out

    # annotations and forms

    def facet_annotations(self) -> list[dict]:
        out = []
        for i, p in enumerate(self.pages):
            items = self.get(p["dict"], "Annots", list) or []
            for k, value in enumerate(items):
                got = self.objects.resolve(value)
                box = self.box(self.get(got, "Rect")) if isinstance(got, dict) else None
                if box is None:
                    self.objects.note("annotation.invalid", "an annotation has no rectangle")
                    continue
                name = f"{value.obj}:{value.gen}" if isinstance(value, Ref) else f"direct:{k + 1}"
                ref = lambda key: (lambda r: f"{r.obj}:{r.gen}" if isinstance(r, Ref) else None)(got.get(key))  # noqa: B023, E731
                target = self.destination(got.get("Dest")) if "Dest" in got else None
                actions = self.action(got.get("A"), "annotation")
                points = sum(len(self.get(got, x, list) or []) // 2 for x in ("QuadPoints", "Vertices", "L", "CL")) + sum(len(self.objects.resolve(x) or []) // 2 for x in self.get(got, "InkList", list) or [])
                out.append({"page": i, "idx": k, "id": name, "subtype": str(self.get(got, "Subtype") or ""), "rect": box, "flags": self.get(got, "F", int) or 0, "is_open": self.get(got, "Open") is True, "layer_visible": self.layer_visible(got.get("OC")), "parent_id": ref("IRT") or ref("Parent"), "popup_id": ref("Popup"), "contents": text(self.get(got, "Contents")), "title": text(self.get(got, "T")), "uri": next((a["uri"] for a in actions if a["uri"]), None), "target_page": target["page"] if target else next((a["page"] for a in actions if a["page"] is not None), None), "n_points": points})
        return out

    def numbers(self, value) -> list[float | None]:
        """A number for each entry of an array, null where there is none; empty if it is no array."""
        got = self.objects.resolve(value)
        return [number(self.objects.resolve(x)) for x in got] if isinstance(got, list) else []

    def border(self, got: dict) -> dict:
        """Width, radii, style and dash of /Border, then of /BS; sizes below 0 are 0, and dashes below 0 are left out."""
        old = (self.numbers(got.get("Border")) + [None] * 3)[:3]
        listed = self.get(got, "Border", list) or []
        dash = self.numbers(listed[3]) if len(listed) > 3 else []
        style, width = "Dashed" if any(x is not None for x in dash) else "Solid", 1.0 if old[2] is None else old[2]
        own = self.get(got, "BS", dict)
        if own is not None:
            told = number(self.get(own, "W"))
            width, style = width if told is None else told, BORDERS.get(str(self.get(own, "S") or ""), "Solid")
            dash = self.numbers(own["D"]) if "D" in own else dash
        return {"width": max(width, 0.0), "horizontal_radius": max(old[0] or 0.0, 0.0), "vertical_radius": max(old[1] or 0.0, 0.0), "style": style, "dash": [x for x in dash if x is not None and x >= 0]}

    def facet_markup(self) -> list[dict]:
        """What annotations have besides place and target, as read: arrays of numbers become points in a view (texts.point_pairs, texts.ink_paths)."""
        out = []
        words = {"name": "NM", "subject": "Subj", "icon": "Name", "modified": "M", "reply_type": "RT", "state": "State", "state_model": "StateModel", "intent": "IT", "rich_text": "RC", "default_style": "DS"}
        lists = {"quads": "QuadPoints", "vertices": "Vertices", "line": "L", "callout": "CL", "differences": "RD"}
        for i, p in enumerate(self.pages):
            for k, value in enumerate(self.get(p["dict"], "Annots", list) or []):
                got = self.objects.resolve(value)
                if not isinstance(got, dict) or self.box(self.get(got, "Rect")) is None:
                    continue
                said = lambda key: (lambda x: str(x) if isinstance(x, Name) else text(x))(self.get(got, key))  # noqa: B023, E731
                color = lambda key: [x for x in self.numbers(got.get(key)) if x is not None]  # noqa: B023, E731
                opacity, ends = number(self.get(got, "CA")), self.get(got, "LE")
                ends = ends if isinstance(ends, list) else [ends]
                out.append({"page": i, "idx": k, **{n: said(key) for n, key in words.items()}, "opacity": 1.0 if opacity is None else min(max(opacity, 0.0), 1.0), "color": color("C"), "interior": color("IC"), "border": self.border(got), **{n: self.numbers(got.get(key)) for n, key in lists.items()}, "ink": [self.numbers(x) for x in self.get(got, "InkList", list) or []], "line_ends": [str(x) for x in map(self.objects.resolve, ends) if isinstance(x, Name)], "has_appearance": self.get(self.get(got, "AP", dict), "N") is not None})
        return out

    # objects and layer groups

    def facet_objects(self) -> list[dict]:
        """Every object that the cross-references name: its kind, type and the objects that it refers to, each once. One that cannot be read has the kind error."""
        out = []
        for n, entry in sorted(self.objects.entries.items()):
            if entry.kind == "f":
                continue
            generation = 0 if entry.kind == "c" else entry.b
            try:
                value = self.objects.resolve(Ref(n, generation))
            except PdfError as e:
                self.objects.note("object.unreadable", f"object {n}: {e}")
                out.append({"obj": n, "gen": generation, "kind": "error", "type": None, "subtype": None, "length": None, "refs": []})
                continue
            head = value.dict if isinstance(value, Stream) else value if isinstance(value, dict) else {}
            named = lambda key: str(head[key]) if isinstance(head.get(key), Name) else None  # noqa: B023, E731
            refs, todo = {}, [head if head else value]
            while todo:
                x = todo.pop()
                if isinstance(x, Ref):
                    refs[x.obj] = None
                elif isinstance(x, dict | list):
                    todo += list(x.values() if isinstance(x, dict) else x)
            kind = next((k for t, k in KINDS if isinstance(value, t)), "null")
            out.append({"obj": n, "gen": generation, "kind": kind, "type": named("Type"), "subtype": named("Subtype"), "length": len(value.data) if isinstance(value, Stream) else None, "refs": sorted(refs)})
        return out

    def facet_radio_groups(self) -> list[dict]:
        """Layers of which one at most is shown at a time, by group; a layer comes once in each."""
        config = self.get(self.get(self.catalog, "OCProperties", dict), "D", dict)
        groups = map(self.objects.resolve, self.get(config, "RBGroups", list) or [])
        listed = [list(dict.fromkeys(x for x in g if isinstance(x, Ref) and x in self.states)) for g in groups if isinstance(g, list)]
        return [{"group": i, "nth": k, "id": f"{x.obj}:{x.gen}"} for i, g in enumerate(x for x in listed if x) for k, x in enumerate(g)]

    def facet_fields(self) -> list[dict]:
        """Terminal and inner fields in the order of the form's tree, with their own keys: inheritance is a view."""
        out, seen = [], set()
        form = self.get(self.catalog, "AcroForm", dict) or {}

        def strings(value) -> list[str] | None:
            value = self.objects.resolve(value)
            if value is None:
                return None
            return [text(self.objects.resolve(x)) for x in value] if isinstance(value, list) else [text(value)] if isinstance(value, (bytes, Name)) else [str(value)]

        def walk(value, parent: int | None, nth: int, names: list[str], depth: int) -> None:
            got = self.objects.resolve(value)
            if not isinstance(got, dict):
                self.objects.note("form.field.invalid", "a field is no dictionary")
                return
            if id(got) in seen or depth > self.objects.limits["depth"]:
                self.objects.note("form.field.circular", "a field contains itself")
                return
            seen.add(id(got))
            kids = self.get(got, "Kids", list) or []
            below = [k for k in kids if "T" in (self.objects.resolve(k) or {})]
            part = text(self.get(got, "T"))
            own = [*names, part] if part else names
            options = []
            for x in self.get(got, "Opt", list) or []:
                x = self.objects.resolve(x)
                pair = [text(self.objects.resolve(y)) for y in x] if isinstance(x, list) else [text(x), text(x)]
                options.append({"export": pair[0], "display": pair[-1]})
            out.append({"field": len(out), "parent": parent, "nth": nth, "name": ".".join(own), "type": str(self.get(got, "FT") or "") or None, "flags": self.get(got, "Ff", int), "values": strings(got.get("V")), "defaults": strings(got.get("DV")), "appearance": text(self.get(got, "DA")) or None, "chosen": [x for x in self.get(got, "I", list) or [] if type(x) is int], "options": options, "is_terminal": not below, "n_widgets": 0 if below else max(1, len(kids))})
            at = len(out) - 1
            for i, kid in enumerate(below):
                walk(kid, at, i, own, depth + 1)

        for i, x in enumerate([] if self.locked else self.get(form, "Fields", list) or []):
            walk(x, None, i, [], 0)
        return out
