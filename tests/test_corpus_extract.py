import pytest
from pyspark.sql import functions as F

from paperloom.operators import corpus, extract

TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title level="a" type="main">On dogs</title></titleStmt><sourceDesc><biblStruct><analytic><title level="a">On dogs</title>
<author><persName><forename>Ann</forename><forename>B.</forename><surname>Lee</surname></persName></author><author><persName><forename>Ann</forename><forename>B.</forename><surname>Lee</surname></persName></author><author>No parts</author></analytic>
<monogr><title level="j">Dog Studies</title><editor><persName><forename>Ed</forename><surname>Itor</surname></persName></editor><imprint><date type="submitted" when="2018-01-01"/><date type="published">May 2019</date></imprint></monogr><idno type="DOI">10.1/x</idno></biblStruct></sourceDesc></fileDesc><profileDesc><abstract><p>Short.</p></abstract></profileDesc></teiHeader>
<text><body><p>First, directly.</p><div><head>Methods</head><p>H<hi>2</hi>O.</p><div><head>Animals</head><p>Ten dogs.</p></div></div><div><head>Conclusions</head><p>Fine.</p></div></body><back><listBibl><biblStruct><note>Ref one</note></biblStruct></listBibl></back></text></TEI>"""
JATS = """<article><front><journal-meta><journal-title>Dog Studies</journal-title></journal-meta><article-meta><article-id pub-id-type="pmid">7</article-id><article-id pub-id-type="pmc">pmc123</article-id><article-id pub-id-type="doi">10.1/y</article-id>
<title-group><article-title>More dogs</article-title></title-group><contrib-group><contrib contrib-type="author"><name><surname>Roe</surname><given-names>Jo</given-names></name></contrib><contrib contrib-type="editor"><name><surname>Itor</surname></name></contrib><contrib><name><surname>Untyped</surname></name></contrib></contrib-group><pub-date pub-type="collection"><year>2019</year></pub-date><pub-date pub-type="epub"><year>2020</year><month>3</month></pub-date>
<abstract><p>Abs.</p></abstract></article-meta></front><body><p>Before.</p><sec><title>Intro</title><p>One.</p><sec><title>Deep</title><p>Two.</p></sec></sec></body><back><ref-list><ref>R1</ref></ref-list></back></article>"""


def parse(spark, xml, kind, source="in/src.xml", requested=None):
    return extract.parse_xml(spark.createDataFrame([(source, xml, requested)], "s string, x string, q string"), "s", "x", kind, "q").first()


def test_tei(spark):
    d = parse(spark, TEI, "tei")
    assert (d["document_id"], d["title"], d["authors"], d["doi"], d["journal"], d["publication_date"], d["error"]) == ("src", "On dogs", ["Ann B. Lee"], "10.1/x", "Dog Studies", "May 2019", None)
    assert [(s["section_type"], s["heading"], s["text"], s["order"], s["level"]) for s in d["sections"]] == [
        ("title", "", "On dogs", 0, 0), ("abstract", "Abstract", "Short.", 1, 1), ("body", "", "First, directly.", 2, 1), ("body", "Methods", "H 2 O.", 3, 1), ("body", "Animals", "Ten dogs.", 4, 2), ("conclusion", "Conclusions", "Fine.", 5, 1)
    ]
    assert d["references"] == ["Ref one"]


def test_tei_paragraphs_outside_parts_are_the_last_resort(spark):
    x = "<TEI><text><body><list><item><p>Only here.</p></item></list><div><head>H</head></div></body></text></TEI>"
    assert [(s["heading"], s["text"]) for s in parse(spark, x, "tei")["sections"]] == [("", "Only here.")]
    deep = "<TEI><text><body>" + "<div><p>x</p>" * 3000 + "</div>" * 3000 + "</body></text></TEI>"
    assert [s["level"] for s in parse(spark, deep, "tei")["sections"]] == list(range(1, 3001))


def test_jats(spark):
    d = parse(spark, JATS, "jats")
    assert (d["document_id"], d["pmid"], d["doi"], d["publication_date"], d["authors"]) == ("PMC123", "7", "10.1/y", "2020-03-00", ["Jo Roe"])
    assert [(s["heading"], s["level"]) for s in d["sections"]] == [("", 0), ("Abstract", 1), ("", 1), ("Intro", 1), ("Deep", 2)]
    assert parse(spark, "<article/>", "jats", requested="pmc9")["document_id"] == parse(spark, "<article/>", "jats", requested="9")["document_id"] == "PMC9"
    assert parse(spark, "<article/>", "jats")["document_id"] == "in/src.xml"


@pytest.mark.parametrize("xml", [None, "", "<a>", "<a/>"])
@pytest.mark.parametrize("kind", ["tei", "jats", "pubmed"])
def test_poor_xml(spark, xml, kind):
    d = parse(spark, xml, kind)
    assert d["sections"] == [] and (d["error"] is None) == (xml == "<a/>")


def test_pubmed(spark):
    x = "<P><PMID>5</PMID><Article><ArticleTitle>T</ArticleTitle><Journal><Title>J</Title></Journal><Abstract><AbstractText>A</AbstractText><AbstractText>B</AbstractText></Abstract><AuthorList><Author><LastName>Lee</LastName><ForeName>Ann</ForeName></Author><Author><LastName>Roe</LastName></Author></AuthorList></Article><ArticleId IdType='doi'>10.1/z</ArticleId></P>"
    d = parse(spark, x, "pubmed")
    assert (d["document_id"], d["journal"], d["doi"], d["authors"]) == ("PMID5", "J", "10.1/z", ["Ann Lee", "Roe"])
    assert [(s["section_type"], s["text"]) for s in d["sections"]] == [("title", "T"), ("abstract", "A\n\nB")]
    assert parse(spark, x.replace("<PMID>5</PMID>", ""), "pubmed", requested="8")["document_id"] == "PMID8"


def test_page_lines(spark):
    pages = spark.createDataFrame([("d", 1, "Head\na\nHead"), ("d", 2, "Head \nb"), ("d", 3, "c\n\nb")], "d string, p int, t string")
    r = extract.repeated_page_lines(pages, "d", "p", "t", 0.6)
    assert {tuple(x) for x in r.collect()} == {("d", "Head", 2), ("d", "b", 2)}
    assert {x["text"] for x in extract.remove_page_lines(pages, r, "d", "p", "t").collect()} == {"a", "", "c\n"}


def test_sections_from_text(spark):
    text = "My title\nAuthors\nABSTRACT: We did it.\nMore.\nIntroduction\nText here.\n2.1 Study animals\nDogs.\nCONCLUSION\nDone.\nReferences\nR one\n\nR two"
    got = extract.sections_from_text(spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string"), "k", "t").collect()
    s = sorted((x["section_order"], x["section_type"], x["heading"], x["text"]) for x in got if x["section_type"] != "reference")
    assert s == [(0, "title", "", "My title Authors"), (1, "abstract", "ABSTRACT", "We did it. More."), (2, "body", "Introduction", "Text here."), (3, "body", "2.1 Study animals", "Dogs."), (4, "conclusion", "CONCLUSION", "Done.")]
    assert sorted(x["text"] for x in got if x["section_type"] == "reference") == ["R one", "R two"]


def test_folding(spark):
    df = spark.createDataFrame([(1, "ﬁne Ærø – café"), (2, None)], "k int, t string")
    assert {r[0]: r[1] for r in extract.fold_unicode(df, "k", "t").collect()} == {1: "fine AEro - cafe", 2: None}


def test_doi_lines(spark):
    lines = [(1, "﻿https://doi.org/10.1234/AB"), (2, "10.1234/ab."), (3, "# note"), (4, " "), (5, "nonsense"), (6, None)]
    good, bad = corpus.read_doi_lines(spark.createDataFrame(lines, "line_number int, line string"))
    assert [tuple(r) for r in good.collect()] == [("10.1234/ab", 1)] and [r["line_number"] for r in bad.collect()] == [5]


def test_incremental_run(spark):
    files = spark.createDataFrame([("a.pdf", "k1"), ("b.pdf", "k9"), ("c.pdf", "k3")], "path string, source_key string")
    m = spark.createDataFrame([("a.pdf", "k1", None), ("b.pdf", "k2", None), ("x.pdf", "k7", "k2"), ("y.pdf", "k8", "k1")], "source string, source_key string, represented_by string")
    assert {r["path"]: r["status"] for r in corpus.incremental_plan(files, m).collect()} == {"a.pdf": "unchanged_pdf", "b.pdf": "changed_pdf", "c.pdf": "new_pdf"}
    there = spark.createDataFrame([("o1",)], "output_path string")
    named = m.withColumn("output_path", F.when(F.col("source") == "b.pdf", "o1").otherwise("gone"))
    assert {r["path"]: r["status"] for r in corpus.incremental_plan(files, named, there).collect()} == {"a.pdf": "new_pdf", "b.pdf": "changed_pdf", "c.pdf": "new_pdf"}
    assert {r["source_key"] for r in corpus.invalidate(m, files).collect()} == {"k1", "k8"}


def test_aliases_and_online(spark):
    df = spark.createDataFrame([(1, "10.1/a"), (2, "doi: 10.1/A"), (3, None), (4, "")], "id int, doi string")
    assert {r["id"]: r["represented_by"] for r in corpus.alias_by_doi(df, "id", "doi", []).collect()} == {1: None, 2: 1, 3: None, 4: None}
    d = spark.createDataFrame([("10.1/a",), ("10.1/b",), ("10.1/c",)], "doi string")
    m = spark.createDataFrame([("doi:10.1/a", "10.1/a"), ("pdf:sha256:z", "10.1/B")], "source_key string, doi string")
    assert {r["doi"]: r["status"] for r in corpus.online_plan(d, m).collect()} == {"10.1/a": "already_extracted", "10.1/b": "doi_present_in_pdf", "10.1/c": "to_extract"}


def test_fingerprint(spark):
    import hashlib

    f = corpus.fingerprint(spark.createDataFrame([("p", bytearray(b"abc"))], "path string, content binary")).first()
    assert f["source_key"] == "pdf:sha256:" + hashlib.sha256(b"abc").hexdigest()
