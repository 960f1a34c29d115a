"""Documents from XML, page texts and plain text."""

from __future__ import annotations

import unicodedata
import xml.etree.ElementTree as ET
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.runtime import map_rows

# Named headings and the kind of section they open.
HEADING_KINDS = {
    "SIMPLE SUMMARY": "abstract", "ABSTRACT": "abstract", "INTRODUCTION": "body", "BACKGROUND": "body", "METHODS": "body", "MATERIALS AND METHODS": "body", "MATERIAL AND METHODS": "body", "RESULTS": "body",
    "DISCUSSION": "body", "GENERAL DISCUSSION": "body", "CONCLUSION": "conclusion", "CONCLUSIONS": "conclusion", "REFERENCES": "references", "BIBLIOGRAPHY": "references",
}
_SECTION = "struct<section_type:string,heading:string,text:string,order:int,level:int>"
DOCUMENT = f"source string, document_id string, title string, doi string, journal string, publication_date string, authors array<string>, pmid string, pmcid string, sections array<{_SECTION}>, references array<string>, error string"


# --- XML ------------------------------------------------------------------------------------------


def _name(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _all(e: ET.Element | None, *names: str) -> list[ET.Element]:
    return [x for x in e.iter() if _name(x) in names] if e is not None else []


def _kids(e: ET.Element | None, name: str) -> list[ET.Element]:
    return [x for x in e if _name(x) == name] if e is not None else []


def _first(e: ET.Element | None, name: str) -> ET.Element | None:
    return next(iter(_all(e, name)), None)


def _attribute(e: ET.Element, name: str) -> str:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1].lower() == name.lower()), "")


def inline(text: str | None) -> str:
    """Composed characters, single spaces."""
    return " ".join(unicodedata.normalize("NFC", text or "").split())


def _text(e: ET.Element | None) -> str:
    """All text of an element, its pieces divided by spaces."""
    return inline(" ".join(e.itertext())) if e is not None else ""


def _typed(elements: list[ET.Element], attribute: str, values: set[str]) -> str:
    """The first non-empty text whose attribute has one of the values."""
    return next((t for e in elements if _attribute(e, attribute).lower() in values and (t := _text(e))), "")


def _kind(heading: str) -> str:
    return "conclusion" if "conclusion" in heading.lower() else "body"


def _paragraphs(elements: list[ET.Element]) -> str:
    return "\n\n".join(t for p in elements if (t := _text(p)))


def _walk(root: ET.Element | None, part: str, title: str) -> list[tuple[str, str, int]]:
    """(heading, text, level): the root's own paragraphs, then nested parts in document order
    with their direct paragraphs; without any of these, all paragraphs below. At any depth."""
    out = [("", _paragraphs(_kids(root, "p")), 1)]
    todo = [(e, 1) for e in reversed(_kids(root, part))]
    while todo:
        e, level = todo.pop()
        out.append((_text(next(iter(_kids(e, title)), None)), _paragraphs(_kids(e, "p")), level))
        todo += [(k, level + 1) for k in reversed(_kids(e, part))]
    return [x for x in out if x[1]] or [x for x in [("", _paragraphs(_all(root, "p")), 1)] if x[1]]


def _sections(title: str, abstract: str, body: list[tuple[str, str, int]]) -> list[dict]:
    rows = ([("title", "", title, 0)] if title else []) + ([("abstract", "Abstract", abstract, 1)] if abstract else [])
    rows += [(_kind(h), h, t, level) for h, t, level in body]
    return [{"section_type": k, "heading": h, "text": t, "order": i, "level": level} for i, (k, h, t, level) in enumerate(rows)]


def _names(people: list[ET.Element], parts: tuple[tuple[str, bool], ...]) -> list[str]:
    """Names from the parts of a person, of each all elements or the first one."""
    return [n for e in people if (n := " ".join(t for name, every in parts for x in (_all(e, name) if every else _all(e, name)[:1]) if (t := _text(x))))]


def parse_tei(xml: str, requested: str = "") -> dict:
    """Title, authors, DOI, journal, date, sections and references of a TEI document.

    Authors are those of the article (``analytic``), not of the volume; a date of publication goes
    before others; references are those of the back matter. ``requested`` isn't used."""
    root = ET.fromstring(xml)
    article = _first(root, "analytic")
    title = _typed(_all(article, "title"), "level", {"a"}) or _typed(_all(root, "title"), "type", {"main"}) or _text(_first(root, "title"))
    people = [p if (p := _first(a, "persName")) is not None and len(p) else a for a in _all(article, "author")]
    dates = _all(root, "date")
    published = [d for d in dates if _attribute(d, "type").lower() in ("published", "publication")]
    written = [t for d in dates if (t := _attribute(d, "when") or _text(d))]
    text = _first(root, "text")
    return {
        "title": title, "authors": list(dict.fromkeys(_names(people, (("forename", True), ("surname", False))))), "doi": _typed(_all(root, "idno"), "type", {"doi"}), "journal": _typed(_all(root, "title"), "level", {"j"}),
        "publication_date": _attribute(published[0], "when") or _text(published[0]) if published else written[0] if written else "", "pmid": "", "pmcid": "",
        "sections": _sections(title, _paragraphs(_all(_first(root, "abstract"), "p")), _walk(_first(text, "body"), "div", "head")),
        "references": [t for b in _all(_first(text, "back"), "biblStruct") if (t := _text(b))],
    }


def parse_jats(xml: str, requested: str = "") -> dict:
    """The same of a JATS article; ids by type (``requested`` where it names no PMCID of its
    own), contributors marked as authors, the preferred publication date."""
    root = ET.fromstring(xml)
    front = _first(root, "front")
    meta = _first(front, "article-meta")
    ids = {kind: _text(e) for e in _all(meta, "article-id") if (kind := _attribute(e, "pub-id-type").lower())}
    people = [n for c in _all(meta, "contrib") if _attribute(c, "contrib-type").lower() == "author" and (n := _first(c, "name")) is not None]
    dates = _all(meta, "pub-date")
    best = next((d for d in dates if _attribute(d, "pub-type").lower() in ("epub", "electronic", "ppub")), dates[0] if dates else None)
    year, month, day = (_text(_first(best, k)) for k in ("year", "month", "day"))
    title = _text(_first(meta, "article-title"))
    pmc = ids.get("pmc", requested).upper()
    return {
        "title": title, "authors": list(dict.fromkeys(_names(people, (("given-names", False), ("surname", False))))), "doi": ids.get("doi", ""), "journal": _text(_first(_first(front, "journal-meta"), "journal-title")),
        "publication_date": "-".join(x for x in (year, month.zfill(2), day.zfill(2)) if x) if best is not None else "", "pmid": ids.get("pmid", ""), "pmcid": pmc if not pmc or pmc.startswith("PMC") else f"PMC{pmc}",
        "sections": _sections(title, _paragraphs(_all(_first(meta, "abstract"), "p")), _walk(_first(root, "body"), "sec", "title")),
        "references": [t for r in _all(_first(_first(root, "back"), "ref-list"), "ref") if (t := _text(r))],
    }


def parse_pubmed(xml: str, requested: str = "") -> dict:
    """Title and abstract only; the record's own PMID goes before the ``requested`` one."""
    root = ET.fromstring(xml)
    article = _first(root, "Article")
    title = _text(_first(article, "ArticleTitle"))
    ids = [t for e in _all(root, "ArticleId") if _attribute(e, "IdType").lower() == "doi" and (t := _text(e))]
    return {
        "title": title, "authors": _names(_all(_first(article, "AuthorList"), "Author"), (("ForeName", False), ("LastName", False))), "doi": ids[0] if ids else "", "journal": _text(_first(_first(article, "Journal"), "Title")),
        "publication_date": "", "pmid": _text(_first(root, "PMID")) or requested, "pmcid": "", "sections": _sections(title, _paragraphs(_all(_first(article, "Abstract"), "AbstractText")), []), "references": [],
    }


PARSERS = {"tei": parse_tei, "jats": parse_jats, "pubmed": parse_pubmed}


def parse_xml(df: DataFrame, source: str, xml: str, kind: str, requested: str | None = None) -> DataFrame:
    """S8 to S10 over (source, xml): one DOCUMENT row each, named by its PMCID or PMID, by the
    file's stem (TEI), or by its source; ``requested`` has the id that was asked for. NULL, blank and broken XML give a row with its error and no sections. Nesting is unbounded, so this is a Python map over Arrow batches."""
    parser = PARSERS[kind]
    names = [f.split()[0] for f in DOCUMENT.replace(", ", ",").split(",") if f.split()[0] in ("title", "doi", "journal", "publication_date", "authors", "pmid", "pmcid", "sections", "references")]

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ["source", "document_id", *names, "error"]}
        for s, x, r in zip(cols["s"], cols["x"], cols["r"]):
            got, error = {}, None
            try:
                got = parser(x or "", r or "")
            except ET.ParseError as e:
                error = f"XML can't be read: {e}"
            out["source"].append(s)
            name = PurePosixPath(s).stem if s and kind == "tei" else s
            out["document_id"].append(got.get("pmcid") or (f"PMID{got['pmid']}" if got.get("pmid") else name))
            out["error"].append(error)
            for n in names:
                out[n].append(got.get(n, [] if n in ("authors", "sections", "references") else ""))
        return out

    return map_rows(df.select(F.col(source).alias("s"), F.col(xml).alias("x"), (F.col(requested) if requested else F.lit(None)).cast("string").alias("r")), DOCUMENT, run)


# --- page texts and plain text ----------------------------------------------------------------------


def repeated_page_lines(pages: DataFrame, document: str, page: str, text: str, threshold: float = 0.7) -> DataFrame:
    """(document, line, pages): stripped lines that stand on at least
    max(2, threshold of the document's pages, rounded up) of its pages, once a page."""
    lines = pages.select(document, page, F.explode(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")).alias("line")).withColumn("line", T.strip(F.col("line"))).where("line <> ''")
    counts = lines.distinct().groupBy(document, "line").agg(F.count("*").alias("pages"))
    total = pages.groupBy(document).agg(F.count_distinct(page).alias("n"))
    need = F.greatest(F.lit(2), F.floor(F.col("n") * threshold + 0.999999))
    return counts.join(total, document).where(F.col("pages") >= need).select(document, "line", "pages")


def remove_page_lines(pages: DataFrame, repeated: DataFrame, document: str, page: str, text: str) -> DataFrame:
    """Pages without the repeated lines of their document, which travel as one array each."""
    gone = repeated.groupBy(document).agg(F.collect_set("line").alias("gone"))
    out = pages.join(gone, document, "left")
    kept = F.filter(F.split(text, "\n"), lambda s: ~F.coalesce(F.array_contains("gone", T.strip(s)), F.lit(False)))
    return out.select(document, page, F.array_join(kept, "\n").alias("text"))


def sections_from_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_order, section_type, heading, text): sections of plain page text.

    Lines that are named headings (with or without a text after a colon) open a section of their
    kind; short numbered or upper-case lines open a body section, but not before the first named
    heading nor among references. A running count of headings within the text numbers sections;
    front matter before the first one gives the title section, reference lines come one by one.
    """
    named = "|".join(HEADING_KINDS)
    pattern = rf"(?iU)^\s*({named})\s*(:\s*(.*))?$"
    lines = df.select(F.col(key).alias("k"), F.posexplode(F.split(text, "\r\n|\n|\r")).alias("i", "line"))
    kinds = F.create_map(*[F.lit(x) for pair in HEADING_KINDS.items() for x in pair])
    lines = lines.withColumn("name", F.regexp_extract("line", pattern, 1)).withColumn("rest", F.regexp_extract("line", pattern, 3)).withColumn("named", F.col("line").rlike(pattern))
    w = Window.partitionBy("k").orderBy("i")
    lines = lines.withColumn("kind", F.coalesce(F.last(F.when(F.col("named"), F.try_element_at(kinds, F.upper("name"))), ignorenulls=True).over(w), F.lit("front")))
    generic = ~F.col("named") & ~F.col("kind").isin("front", "references") & T.looks_like_heading(F.col("line"))
    lines = lines.withColumn("generic", generic)
    # below a generic heading everything is body until the next named one
    lines = lines.withColumn("opened", F.last(F.when(F.col("named"), F.lit(False)).when(F.col("generic"), F.lit(True)), ignorenulls=True).over(w))
    lines = lines.withColumn("kind", F.when(F.col("opened") & (F.col("kind") != "references"), F.lit("body")).otherwise(F.col("kind")))
    lines = lines.withColumn("s", F.sum((F.col("named") | F.col("generic")).cast("int")).over(w))
    content = F.when(F.col("named"), T.strip(F.col("rest"))).when(F.col("generic"), F.lit("")).otherwise(F.col("line"))
    heading = F.when(F.col("named"), T.strip(F.col("name"))).when(F.col("generic"), T.strip(F.col("line")))
    grouped = lines.withColumn("content", content).withColumn("heading", heading).groupBy("k", "s", "kind").agg(F.sort_array(F.collect_list(F.struct("i", "content"))).alias("x"), F.max("heading").alias("heading"))
    joined = F.array_join(F.transform("x", lambda e: e.content), "\n")
    # references come line by line, sections as one text
    texts = F.when(F.col("kind") == "references", F.transform("x", lambda e: T.clean_page_text(e.content))).otherwise(F.array(T.clean_page_text(joined)))
    both = grouped.select("k", "s", F.when(F.col("kind") == "references", "reference").otherwise(F.col("kind")).alias("kind"), F.when(F.col("kind") != "references", F.col("heading")).alias("heading"), F.posexplode(texts).alias("r", "t")).where("t <> ''")
    both = both.withColumn("kind", F.when(F.col("kind") == "front", "title").otherwise(F.col("kind"))).withColumn("o", F.row_number().over(Window.partitionBy("k", F.col("kind") == "reference").orderBy("s", "r")) - 1)
    return both.select(F.col("k").alias(key), F.col("o").alias("section_order"), F.col("kind").alias("section_type"), F.coalesce("heading", F.lit("")).alias("heading"), F.col("t").alias("text"))


def fold_unicode(df: DataFrame, key: str, text: str) -> DataFrame:
    """The folding of T10 that has no built-in function: compatibility forms resolved, accents off,
    a few letters spelt out, other characters beyond ASCII left as they are. NULL stays NULL."""
    spelt = str.maketrans({"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "Æ": "AE", "Œ": "OE", "Ø": "O", "Đ": "D", "Ł": "L", "–": "-", "—": "--", "‘": "'", "’": "'", "“": '"', "”": '"', "…": "..."})

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        t = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", t).translate(spelt))
        return "".join(c for c in t if not unicodedata.combining(c))

    src = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    out = map_rows(src, f"k {dict(src.dtypes)['k']}, t string", lambda c: {"k": c["k"], "t": [one(t) for t in c["t"]]})
    return out.select(F.col("k").alias(key), F.col("t").alias(text))
