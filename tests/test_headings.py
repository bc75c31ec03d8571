"""Scripts of word-processor files and e-books: styles, headings, stacked headings, chapters."""

import io
import zipfile

from inkstream.sources import headings as H

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def packed(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, text in parts.items():
            archive.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


def paragraph(text, style="", marks=""):
    return f'<w:p><w:pPr>{style}</w:pPr><w:r><w:rPr>{marks}</w:rPr><w:t>{text}</w:t></w:r></w:p>'


STYLES = f"""<w:styles {W}><w:style w:styleId="Kapitel"><w:basedOn w:val="Titelbasis"/></w:style><w:style w:styleId="Titelbasis"><w:pPr><w:outlineLvl w:val="0"/></w:pPr></w:style>
<w:style w:styleId="Ring"><w:basedOn w:val="Ring"/></w:style><w:style w:styleId="Sub"><w:basedOn w:val="Heading2"/></w:style></w:styles>"""
BODY = f"""<w:document {W}><w:body>{paragraph("By the author")}{paragraph("Volume one", '<w:pStyle w:val="Kapitel"/>')}{paragraph("The harbour", '<w:outlineLvl w:val="0"/>')}
{paragraph("It rained.", '<w:pStyle w:val="Ring"/>', '<w:b/><w:i w:val="0"/>')}{paragraph("A part", '<w:pStyle w:val="Sub"/>')}<w:p><w:r><w:t>Then </w:t></w:r><w:del><w:r><w:t>never </w:t></w:r></w:del><w:r><w:rPr><w:i/></w:rPr><w:t>it</w:t><w:tab/><w:t>stopped.</w:t></w:r></w:p>
{paragraph("The sea", '<w:pStyle w:val="heading1"/>')}{paragraph("Waves.")}</w:body></w:document>"""
CORE = '<p xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>The  Book</dc:title><dc:creator>A. Writer</dc:creator></p>'


def test_a_word_processor_file(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(packed(**{"word__document_dot_xml": BODY, "word__styles_dot_xml": STYLES, "docProps__core_dot_xml": CORE}))
    (tmp_path / "b.docx").write_bytes(b"no archive")
    (tmp_path / "c.docx").write_bytes(packed(**{"word__document_dot_xml": f"<w:document {W}><w:body>{paragraph(' ')}</w:body></w:document>"}))
    found = {r.path[-6:]: r for r in H.docx_scripts(spark, str(tmp_path / "*.docx")).collect()}
    a = found["a.docx"]
    assert found["b.docx"].error and found["c.docx"].error == "no readable paragraphs" and (a.title, a.author) == ("The Book", "A. Writer")
    assert a.text == "By the author\nVolume one\nThe harbour\nIt rained.\nA part\nThen it\tstopped.\nThe sea\nWaves."
    assert "".join(s.text for s in a.spans) == a.text and {s.text: s.style for s in a.spans}["It rained."] == ["bold"] and {s.text: s.style for s in a.spans}["it\tstopped."] == ["italic"]
    assert [(h.title, a.text[h.start : h.content_start]) for h in a.headings] == [("Volume one",) * 2, ("The harbour",) * 2, ("The sea",) * 2]
    chapters = sorted(tuple(r)[1:5] for r in H.chapters_of(H.docx_scripts(spark, str(tmp_path / "*.docx"))).collect())
    assert chapters == [(1, "Front matter", None, "By the author"), (2, "The harbour", "Volume one\nThe harbour", "It rained.\nA part\nThen it\tstopped."), (3, "The sea", None, "Waves.")]


CONTAINER = '<container><rootfiles><rootfile full-path="O/b.opf"/></rootfiles></container>'
PACKAGE = """<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Tides</dc:title><dc:creator>B. Author</dc:creator></metadata><manifest>
<item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/>
<item id="c" href="c.xhtml" media-type="application/xhtml+xml"/><item id="x" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine><itemref idref="n"/><itemref idref="a"/><itemref idref="b"/><itemref idref="c"/></spine></package>"""
NAV = '<html><body><nav epub:type="toc"><ol><li><a href="a.xhtml#one">One</a></li><li><a href="a.xhtml#two">Second part</a></li></ol></nav><nav epub:type="landmarks"><a href="a.xhtml#no">no</a></nav></body></html>'
PAGE_A = '<html><head><title>t</title></head><body><p>Opening words.</p><section id="one"><h2>Chapter &amp; one</h2><p>It  was\n late.</p></section><p id="two">Dark</p><p>night.</p></body></html>'
PAGE_B = "<html><head><title>Letters</title></head><body><h1>Book two</h1><h2>Dawn</h2><p>Light.</p><h3>small</h3><h2>Noon</h2><p>Heat.</p></body></html>"
PAGE_C = "<html><head><title>Last page</title></head><body><p>The end.</p><script>var x;</script></body></html>"
NCX = '<ncx><navMap><navPoint><navLabel><text>All of it</text></navLabel><content src="b.xhtml"/></navPoint></navMap></ncx>'


def test_an_e_book(spark, tmp_path):
    pages = {"O__nav_dot_xhtml": NAV, "O__a_dot_xhtml": PAGE_A, "O__b_dot_xhtml": PAGE_B, "O__c_dot_xhtml": PAGE_C, "O__toc_dot_ncx": NCX}
    (tmp_path / "a.epub").write_bytes(packed(**{"META-INF__container_dot_xml": CONTAINER, "O__b_dot_opf": PACKAGE, **pages}))
    (tmp_path / "b.epub").write_bytes(b"no")
    rows = H.epub_scripts(spark, str(tmp_path / "*.epub"))
    found = {r.path[-6:]: r for r in rows.collect()}
    a = found["a.epub"]
    assert found["b.epub"].error and (a.title, a.author) == ("Tides", "B. Author")
    assert a.text == "Opening words.\nChapter & one\nIt was late.\nDark\nnight.\nBook two\nDawn\nLight.\nsmall\nNoon\nHeat.\nThe end."
    assert [(h.title, a.text[h.start : h.content_start]) for h in a.headings] == [("t", ""), ("Chapter & one",) * 2, ("Second part", ""), ("Book two",) * 2, ("Dawn",) * 2, ("Noon",) * 2, ("Last page", "")]
    chapters = sorted((r.chapter, r.title, r.heading_text, r.text) for r in H.chapters_of(rows).collect())
    assert chapters == [
        (1, "t", None, "Opening words."), (2, "Chapter & one", None, "It was late."), (3, "Second part", None, "Dark\nnight."), (4, "Dawn", "Book two\nDawn", "Light.\nsmall"), (5, "Noon", None, "Heat."), (6, "Last page", None, "The end."),
    ]


def test_chapters_of_odd_scripts(spark):
    head = "array<struct<title string, start int, content_start int>>"
    rows = spark.createDataFrame([("none", "Just text. ", None), ("null", None, None), ("empty", "", []), ("end", "A\nx\nB", [("A", 0, 1), ("B", 4, 5)])], f"path string, text string, headings {head}")
    found = sorted((r.path, r.chapter, r.title, r.text) for r in H.chapters_of(rows).collect())
    assert found == [("end", 1, "A", "x"), ("end", 2, "B", ""), ("none", 1, "Chapter 1", "Just text.")]
