"""The library from files to exams, with stand-ins for the model and the recogniser."""

import io
import json
import zipfile

import pytest

from quire.library import Library
from quire.providers import HashingEmbedder
from quire.sources import artifacts, documents

P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
TREE = "A binary tree holds nodes, and each node of the binary tree holds two children. Walking a binary tree visits every node once. "
GRAPH = "A graph search visits the nodes of a graph by breadth or by depth. The graph search keeps a queue of nodes. "


def slides(*texts, picture=True):
    """A presentation whose slides are shown in the reverse order of their files."""
    out = io.BytesIO()
    n = len(texts)
    with zipfile.ZipFile(out, "w") as z:
        shown = "".join(f'<p:sldId id="{k}" r:id="r{k}"/>' for k in range(n, 0, -1))
        z.writestr("ppt/presentation.xml", f"<p:presentation {P}><p:sldIdLst>{shown}</p:sldIdLst></p:presentation>")
        links = "".join(f'<Relationship Id="r{k}" Target="slides/slide{k}.xml"/>' for k in range(1, n + 1))
        z.writestr("ppt/_rels/presentation.xml.rels", f"<Relationships>{links}</Relationships>")
        for k, text in enumerate(reversed(texts), 1):
            shapes = "".join(f"<p:sp><p:txBody><a:p><a:r><a:t>{line}</a:t></a:r></a:p></p:txBody></p:sp>" for line in text.split("\n") if line)
            pic = '<p:pic><p:blipFill><a:blip r:embed="i1"/></p:blipFill></p:pic>' if picture else ""
            z.writestr(f"ppt/slides/slide{k}.xml", f"<p:sld {P}>{shapes}{pic}</p:sld>")
            z.writestr(f"ppt/slides/_rels/slide{k}.xml.rels", '<Relationships><Relationship Id="i1" Target="../media/image1.png"/></Relationships>')
        z.writestr("ppt/media/image1.png", b"picture")
    return out.getvalue()


class Reader:
    def text(self, content):
        if content != b"picture":
            raise ValueError("no picture")
        return " seen in the picture "


class Teacher:
    """Answers by what it is asked for."""

    model = "teacher"

    def complete(self, system, user, max_tokens):
        if "KEEP" in system:
            return "KEEP: 1, 0, 99"
        if "one term a line" in system.lower():
            return "binary tree\n\nhttp\nbinary tree\nqueue"
        if "exam question" in system:
            quote = user.split("CONTEXT:\n")[1].split("\n")[1][:40]
            return json.dumps({"question": f"What of {user[:60]}?", "options": {"A": "a", "B": "b", "C": "c", "D": "d"}, "answer": "A", "explanation": [{"text": f'It says "{quote}"', "sources": ["[1]"]}]})
        if "summar" in system.lower() and "RETRIEVED" in user:
            return "The passages deal with trees and graphs."
        return "A binary tree holds nodes (CH01/p1)." if "holds" in user.split("CONTEXT:")[0] else "no"


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    (folder / "CH01.pptx").write_bytes(slides("1-1 Trees and their uses in the course\n" + TREE * 3, "1-2 Walks over trees in order of nodes\n" + TREE * 4))
    (folder / "CH02.pptx").write_bytes(slides("2-1 Graphs and how they are searched\n" + GRAPH * 6, ""))
    (folder / "bad.pptx").write_bytes(b"no zip")
    (folder / "notes.txt").write_bytes(b"x")
    made = Library(spark, str(tmp_path_factory.mktemp("library")), HashingEmbedder(64), Teacher())
    status = {r.name: r.status for r in made.upload("my course", "ppt", str(folder)).collect()}
    assert status == {"CH01.pptx": "saved", "CH02.pptx": "saved", "bad.pptx": "saved", "notes.txt": "skipped"}
    read = {r.doc_id: r.status for r in made.preprocess("my_course", "ppt", documents.SlideReader(), Reader()).collect()}
    assert read["bad"] == "failed"
    name = made.merge("my_course", "ppt", pick="1,2")
    made.build_index("my_course", "ppt", name)
    made.name = name
    return made


def test_pages_and_browsing(library):
    keys = {(r.doc_id, r.page): r for r in library.page_keys("my_course", "ppt", "CH02").collect()}
    assert set(keys) == {("CH02", 1), ("CH02", 2)} and keys["CH02", 1].has_text and not keys["CH02", 2].has_text
    assert keys["CH02", 2].has_ocr and keys["CH02", 2].image_count == 1
    page = library.page("my_course", "ppt", "CH01", page=2).first()
    assert page.text.startswith("1-2 Walks") and (page.previous, page.next) == (1, None) and page.ocr == "seen in the picture"
    assert [(r.subject, r.chapters) for r in library.materials().collect()] == [("my_course", ["CH01_CH02"])] == [("my_course", [library.name])]
    assert library.image_url("./data/page_001_img_01.png").endswith("/raw_img/page_001_img_01.png")
    assert library.preprocess("my_course", "ppt", documents.SlideReader()).where("status = 'done'").count() == 0  # nothing is read twice
    for bad in (lambda: library.page("my_course", "ppt", "CH09"), lambda: library.image_url("none.png"), lambda: library.exam("my_course", "ppt", "CH09")):
        with pytest.raises(FileNotFoundError):
            bad()
    for bad in (lambda: library.merge("my_course", "ppt"), lambda: library.merge("my_course", "ppt", "1", "1-2"), lambda: library.chapters("my_course", "doc"), lambda: library.search("my_course", "ppt", library.name, " ")):
        with pytest.raises(ValueError):
            bad()


def test_a_failed_batch_is_not_there(library, spark, tmp_path, tmp_path_factory):
    folder = tmp_path_factory.mktemp("five")
    for c in range(1, 6):
        (folder / f"CH0{c}.pptx").write_bytes(slides(*(f"{c}-{p} The common word and page {p} of chapter {c}" for p in (1, 2))))
    made = Library(spark, str(tmp_path), HashingEmbedder(32), Teacher())
    made.upload("five", "ppt", str(folder))
    add, reads = made._add, tmp_path_factory.mktemp("reads")

    class Counting(documents.SlideReader):
        def pages(self, content):
            import uuid

            (reads / uuid.uuid4().hex).write_text("x")
            return super().pages(content)

    def failing(table, *rest):
        if table == "pages":
            raise OSError("no room")
        add(table, *rest)

    made._add = failing
    with pytest.raises(OSError):
        made.preprocess("five", "ppt", documents.SlideReader())
    made._add = add
    assert made.pages("five", "ppt").count() == 0 == made._listed("pictures", made.PICTURES).count()
    made.preprocess("five", "ppt", Counting())
    assert made.pages("five", "ppt").count() == 10 == made._listed("pictures", made.PICTURES).count() and len(list(reads.iterdir())) == 5
    name = made.merge("five", "ppt", pick="3,1,5")
    made.build_index("five", "ppt", name)
    assert [(r.doc_id, r.page) for r in made.search("five", "ppt", name, "common word", k=4).collect()] == [("CH03", 1), ("CH03", 2), ("CH01", 1), ("CH01", 2)]


def test_search_and_answers(library):
    hits = library.search("my_course", "ppt", library.name, "ＧＲＡＰＨ search").collect()
    assert [(r.rank, r.branch, r.doc_id, r.page) for r in hits] == [(1, 0, "CH02", 1)]
    got = {r.question: r for r in library.ask("my_course", "ppt", library.name, ["binary tree holds nodes", "graph search", "zzz qqq"]).collect()}
    assert got["binary tree holds nodes"].origin == "answer" and got["binary tree holds nodes"].cites[0] == "CH01/p1"
    assert got["graph search"].origin == "summary"
    assert got["zzz qqq"].origin == "none"
    library.model, teacher = __import__("quire.providers", fromlist=["x"]).SilentModel(), library.model
    try:
        row = library.ask("my_course", "ppt", library.name, ["graph search"]).first()
    finally:
        library.model = teacher
    assert row.origin == "template" and row.answer.startswith("[TEMPLATE FALLBACK] graph search\n") and row.answer.endswith("SOURCES: [1]")


def test_keywords(library):
    assert library.keywords("my_course", "ppt", library.name, lang="en").count() == 0
    tips = library.make_tips("my_course", "ppt", library.name, "en", 5, with_model=True).collect()
    assert tips and {r.doc_id for r in tips} <= {"CH01", "CH02"} and all(r.score_norm <= 100 + 1e-9 for r in tips)
    shown = library.keywords("my_course", "ppt", library.name, "CH02", 2, "en").collect()
    assert [r.n for r in shown] == [1, 2] and {r.doc_id for r in shown} == {"CH02"} and not any(r.fallback for r in shown)
    assert [r.terms for r in library._allowed("my_course", "ppt", library.name, "en").collect()] == [["binary tree", "queue"]] * 2


def test_exams(library):
    file = library.make_exam("my_course", "ppt", library.name, n=2, k=2, lang="en")
    made = library.exam("my_course", "ppt", library.name)
    assert [q["id"] for q in made["questions"]] == ["Q0001", "Q0002"][: len(made["questions"])] and made["meta"]["generator"]["llm"]["model"] == "teacher"
    for q in made["questions"]:
        assert q["sources_used"] == ["[1]"] and q["sources_map"]["[1]"]["doc_id"] in ("CH01", "CH02")
    assert library.delete_exam("my_course", "ppt", library.name, f"../{file}").endswith(file)
    with pytest.raises(FileNotFoundError):
        library.delete_exam("my_course", "ppt", library.name, file)
    with pytest.raises(ValueError):
        library.delete_exam("my_course", "ppt", library.name, "x.txt")


def test_listings(library, spark, tmp_path):
    where = lambda df: [tuple(r) for r in df.collect()]
    assert where(library.viewer_sources()) == [("my_course", "ppt", ["CH01", "CH02"], 2)]
    assert where(library.upload_folders()) == [("my_course", "ppt", ["CH01.pptx", "CH02.pptx", "bad.pptx"], 3)]
    assert where(library.preprocess_candidates()) == [("my_course", "ppt", ["bad"], 1)]
    assert where(library.index_candidates()) == [("my_course", "ppt", [library.name], 1)]
    library.make_tips("my_course", "ppt", library.name, "en", 3)
    assert where(library.generated_tips("en")) == [("my_course", "ppt", [library.name])] and where(library.generated_tips("cn")) == []
    file = library.make_exam("my_course", "ppt", library.name, n=1, k=2, lang="en")
    assert [(r.chapter, r.paths) for r in library.generated_exams().collect()] == [(library.name, [file])]
    empty = Library(spark, str(tmp_path / "none"))
    for listed in (empty.materials, empty.viewer_sources, empty.upload_folders, empty.preprocess_candidates, empty.index_candidates, empty.generated_tips, empty.generated_exams):
        assert listed().count() == 0


def test_files(spark, tmp_path):
    for name in ("b/b.txt", "b/a.txt", "c/z.txt", "c/y.txt", "_d/d.txt", "e/e.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    paths = spark.createDataFrame([(f"/{p.relative_to(tmp_path)}",) for p in tmp_path.rglob("*.*")], "path string")
    assert {tuple(r) for r in documents.document_folders(paths).collect()} == {("b", "/b/b.txt"), ("c", "/c/y.txt")}
    pages = spark.createDataFrame([("d", 2, "two"), ("d", 1, None)], "doc_id string, page int, text string")
    assert documents.page_file(pages).first().content == "====== Page 1 ======\n這頁是沒有txt的\n\n====== Page 2 ======\ntwo"
    shots = spark.createDataFrame([("d", "page_001_img_01.png", b"picture"), ("d", "a.gif", b"x"), ("d", "b.jpg", b"?"), ("d", "c.png", b"picture")], "doc_id string, name string, content binary")
    done = spark.createDataFrame([("d", "c")], "doc_id string, stem string")
    read = documents.recognised(shots, done, Reader())
    assert {(r.stem, r.status) for r in read.collect()} == {("page_001_img_01", "new"), ("a", "skipped"), ("b", "failed"), ("c", "skipped")}
    assert documents.status_counts(read).first()[1:] == (1, 2, 1)
    assert spark.createDataFrame([(b" \xffab\xc3\xa9 ",), (None,)], "c binary").select(documents.decoded(documents.F.col("c"))).collect() == [("abé",), ("",)]
    artifacts.write_json(spark, str(tmp_path / "x.json"), {"é": 1})
    assert json.loads(artifacts.read_text(spark, str(tmp_path / "x.json"))) == {"é": 1}


def test_a_changed_file_replaces_its_pages(spark, tmp_path):
    folder, made = tmp_path / "files", Library(spark, str(tmp_path / "library"), HashingEmbedder(16))
    folder.mkdir()
    (folder / "CH01.pptx").write_bytes(slides("Trees\n" + TREE, "Walks\n" + TREE))
    (folder / "CH02.pptx").write_bytes(slides("Graphs\n" + GRAPH))
    made.upload("s", "ppt", str(folder))
    assert {r.doc_id for r in made.preprocess("s", "ppt", documents.SlideReader()).collect()} == {"CH01", "CH02"}
    first = {(r.doc_id, r.term) for r in made.corpus_keywords("s", "ppt", "en", 3).collect()}
    assert {d for d, _ in first} == {"CH01", "CH02"}
    batches = {r.doc_id: r.batch for r in made._current("s", "ppt").collect()}
    (folder / "CH01.pptx").write_bytes(slides("Heaps\n" + TREE.replace("tree", "heap")))
    made.upload("s", "ppt", str(folder))  # CH02 again as it was
    assert {r.doc_id for r in made.preprocess("s", "ppt", documents.SlideReader()).collect()} == {"CH01"}
    pages = {(r.doc_id, r.page): r.text for r in made.pages("s", "ppt").collect()}
    assert set(pages) == {("CH01", 1), ("CH02", 1)} and "heap" in pages["CH01", 1]
    assert made._listed("pictures", made.PICTURES, "s", "ppt").count() == 2
    again = {r.doc_id: r.batch for r in made._current("s", "ppt").collect()}
    assert again["CH02"] == batches["CH02"] and again["CH01"] != batches["CH01"]
    terms = {r.term for r in made.corpus_keywords("s", "ppt", "en", 3).collect()}
    assert any("heap" in t for t in terms) and not any("tree" in t for t in terms)
    (folder / "CH01.pptx").write_bytes(b"no zip")
    made.upload("s", "ppt", str(folder))
    made.preprocess("s", "ppt", documents.SlideReader())
    assert {(r.doc_id, r.page): r.text for r in made.pages("s", "ppt").collect()} == pages
