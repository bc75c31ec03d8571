import json

from inkstream.sources import files, projects


def test_a_book_is_read_with_what_is_missing(spark, tmp_path):
    words = [{"text": "one", "start": 0, "end": 0.5}, {"text": "two", "start": 0.6, "end": 1.0, "confidence": 0.5}]
    chapters = [{"id": f"c{i}", "index": i, "title": f"T{i}", "text_path": f"c{i}.txt", "alignment_path": f"c{i}.align"} for i in (1, 2, 3)]
    (tmp_path / "book.json").write_text(json.dumps({"schema": 1, "id": "b", "people": [{"id": "p", "name": "A", "role": "author"}], "chapters": chapters}))
    (tmp_path / "odd.json").write_text(json.dumps({"schema": 2, "id": "b b", "people": [{"name": "A"}, {"name": "a"}], "chapters": [{"id": "x", "index": 1, "text_path": "../up"}, {"id": "x", "index": 1}]}))
    (tmp_path / "bad.json").write_text("{nothing")
    (tmp_path / "c1.txt").write_text("One two.")
    (tmp_path / "c1.align").write_text(json.dumps({"transcript": words, "pickups": [{"id": "a", "kind": "sub", "status": "open", "t_start": 0, "t_end": 1}]}))
    (tmp_path / "c2.align").write_text(json.dumps({"transcript": words[::-1], "pickups": [{"id": "a", "kind": "odd", "status": "open", "t_start": 0, "t_end": 1}] * 2}))
    read = projects.projects(spark, str(tmp_path / "*.json"))
    errors = {r.path.rsplit("/")[-1]: sorted(r.errors) for r in read.collect()}
    assert errors["book.json"] == [] and "json" in errors["bad.json"]
    assert errors["odd.json"] == sorted(["schema", "id", "names", "chapter ids", "chapter numbers", "paths"])
    aligned = projects.alignments(spark, str(tmp_path / "*.align"))
    assert {r.path[-8:]: sorted(r.errors) for r in aligned.collect()} == {"c1.align": [], "c2.align": ["ids", "order", "pickups"]}
    scripts = files.text_files(spark, str(tmp_path / "*.txt"))
    book = projects.book_chapters(read.where("id = 'b'"), scripts, aligned).orderBy("index").collect()
    assert [(r.chapter_id, r.text, len(r.heard)) for r in book] == [("c1", "One two.", 2), ("c2", "", 0), ("c3", "", 0)]


def test_projects_are_written_as_they_are_read(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2, "y", "Y", "y.txt", None), ("b", 1, "x", "X", "x.txt", "x.wav")], "book string, n int, id string, title string, text_path string, audio_path string")
    (tmp_path / "p.json").write_text(projects.project_json(rows, "book", "n").first().json)
    read = projects.projects(spark, str(tmp_path / "p.json")).first()
    assert read.errors == [] and [(c.id, c["index"], c.audio_path) for c in read.chapters] == [("x", 1, "x.wav"), ("y", 2, None)]


def test_words_of_recognisers(spark):
    lines = ['{"segments": [{"words": [{"word": " a", "start": 0, "end": 1, "probability": 0.5}]}, {"words": [{"word": "b", "start": 1, "end": 2}]}]}', '{"words": [{"text": "c", "start": 2, "end": 3, "confidence": 0.9}, {"text": "", "start": 3, "end": 4}, {"text": "d"}]}', "no json"]
    found = projects.recognised_words(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "take int, line string")).orderBy("take", "seq").collect()
    assert [(r.take, r.text, r.confidence) for r in found] == [(0, "a", 0.5), (0, "b", None), (1, "c", 0.9)]
