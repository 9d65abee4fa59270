"""Files written from tables, the command line, and facets of annotations, objects and radio groups."""

import json

import pytest
from pyspark.sql import functions as F

from quire import __main__ as command
from quire import synth
from quire.sources import pdf, sinks
from quire.sources.document import Document


def test_saved_files_are_the_same_bytes(spark, tmp_path):
    files = {f"f{i}.bin": bytes([i]) * i * 1000 for i in range(20)}
    rows = spark.createDataFrame([*files.items(), ("none", None)], "name string, content binary").repartition(4)
    for _ in range(2):
        assert sinks.save(rows, "name", "content", str(tmp_path / "out")) == (20, sum(map(len, files.values())))
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == files
    assert sinks.save(rows.limit(0), "name", "content", str(tmp_path / "none")) == (0, 0)


@pytest.mark.parametrize("name", ["../up", "a/b", "..", ""])
def test_names_outside_the_folder_are_refused(spark, tmp_path, name):
    with pytest.raises(Exception, match="not a plain file name"):
        sinks.save(spark.createDataFrame([(name, b"x")], "name string, content binary"), "name", "content", str(tmp_path / "out"))
    assert not (tmp_path / "up").exists()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(synth.text_pdf(" ".join(f"w{i}" for i in range(330)), attachments=[("x.txt", b"held", "Flate")], outline=[("top", None, 0)]))
    return tmp_path


def test_commands(spark, folder, capsys):
    run = lambda *a: (command.main([*a], spark), capsys.readouterr())
    path, out = f"{folder}/in/*.pdf", folder / "out"
    assert run("text", path, "--page", "2")[1].out.split() == [f"w{i}" for i in range(320, 330)]
    rows = [json.loads(x) for x in run("outline", path)[1].out.splitlines()]
    assert [(r["table"], r["title"]) for r in rows] == [("outline", "top")]
    assert run("attachments", path, "--out", str(out))[0] == 0 and (out / "x.txt").read_bytes() == b"held"
    assert run("render", path, "--out", str(out))[0] == 0 and (out / "a-1.png").read_bytes()[:4] == b"\x89PNG" and (out / "a-2.png").exists()
    assert run("svg", path, "--out", str(out), "--page", "1")[0] == 0 and (out / "a-1.svg").exists() and not (out / "a-2.svg").exists()
    status, told = run("text", path, "--page", "3")
    assert status == 1 and "no page 3" in told.err
    (folder / "in" / "b.pdf").write_bytes(b"no file of this kind")
    status, told = run("info", path)
    assert status == 1 and "b.pdf" in told.err and '"pages":2' in told.out
    assert run("version")[0] == 0


def test_markup_is_read_whole():
    notes = [b"/Subtype /Line /Rect [0 0 5 5] /L [0 0 5 5] /IC [0 (x) 1] /BS << /W -2 /S /B >> /LE /Butt /CA 7 /AP << /N 1 0 R >>", b"/Subtype /Text /Rect [0 0 5]", b"/Subtype /Text /Rect [0 0 5 5] /Border [1] /Name /Key /Contents (c)"]
    line, note = Document(synth.text_pdf("", notes=notes)).facet_markup()
    assert line["line"] == [0, 0, 5, 5] and line["interior"] == [0, 1] and line["line_ends"] == ["Butt"] and line["opacity"] == 1 and line["has_appearance"]
    assert line["border"] == {"width": 0.0, "horizontal_radius": 0.0, "vertical_radius": 0.0, "style": "Beveled", "dash": []}
    assert note["idx"] == 2 and note["icon"] == "Key" and note["border"]["width"] == 1 and note["border"]["horizontal_radius"] == 1 and not note["has_appearance"] and note["ink"] == []


def test_objects_refer_to_each_other():
    rows = {r["obj"]: r for r in Document(synth.text_pdf("one page")).facet_objects()}
    root = next(r for r in rows.values() if r["type"] == "Catalog")
    tree = next(rows[n] for n in root["refs"] if rows[n]["type"] == "Pages")
    page = next(rows[n] for n in tree["refs"])
    assert page["type"] == "Page" and tree["obj"] in page["refs"]
    assert any(rows[n]["kind"] == "stream" and rows[n]["length"] > 0 for n in page["refs"])


def test_locked_files_have_no_objects(spark):
    files = spark.createDataFrame([(1, synth.text_pdf("x", revision=3, user=b"secret"))], "id int, content binary")
    row = pdf.parse(files, ["markup", "objects", "radio_groups"], ["id"]).select("error", F.size("markup"), F.size("objects"), F.size("radio_groups")).first()
    assert tuple(row) == (None, 0, 0, 0)
