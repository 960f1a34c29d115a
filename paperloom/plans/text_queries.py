"""Queries of the text and chunking operators, over the whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import chunk, corpus, extract
from paperloom.runtime import spread, table


def _once(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Columns of extracted documents, rows of later extractions left out."""
    from paperloom.operators.relational import keep_first

    df = table(spark, sf, "extracted_documents").select("document_id", *columns, "extracted_at")
    # by a fixed number of partitions, which the grouping by the same key uses as they are
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return keep_first(df.repartition(width, "document_id"), ["document_id"], ["extracted_at"])


def _sections(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "extracted_documents").select("document_id", F.explode("sections").alias("s"))
    return x.select("document_id", F.col("s.order").alias("section_order"), "s.section_type", "s.heading", "s.text", "s.level").distinct()


def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """T1 over documents."""
    return table(spark, sf, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


def whitespace(spark: SparkSession, sf: str) -> DataFrame:
    """T2 over documents."""
    return table(spark, sf, "documents").select("doc_id", T.normalize_whitespace(F.col("text")).alias("text"))


def paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered paragraphs of documents, with whether each is a caption or notice."""
    x = table(spark, sf, "documents").select("doc_id", F.posexplode(T.split_paragraphs(F.col("text"))).alias("paragraph", "text"))
    return x.withColumn("dropped", T.is_caption_or_notice(F.col("text")))


def labelled_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """F3 to F5 on texts that a prefix turns into captions, notices and prose about figures."""
    prefix = F.element_at(F.array(*[F.lit(p) for p in _PREFIXES]), (F.pmod("doc_id", F.lit(len(_PREFIXES))) + 1).cast("int"))
    x = table(spark, sf, "documents").where("text is not null").select("doc_id", F.concat(prefix, F.col("text")).alias("t"))
    return x.select("doc_id", T.is_caption_or_notice(F.col("t")).alias("paragraph_dropped"), T.is_notice(F.col("t")).alias("notice"), T.is_standalone_caption(F.col("t")).alias("caption"))


_PREFIXES = ("", "Fig. 3 ", "Table 2: ", "Figure 12-", "Additional file 1 ", "Supplementary data of ", "Figs. 1 ", "Supplementary materials ")


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    """T4 and T5 over documents."""
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(T.split_sentences(F.coalesce("text", F.lit("")))).alias("sentence_index", "sentence"))


def section_filter(spark: SparkSession, sf: str) -> DataFrame:
    """sections that are chunked."""
    s = _sections(spark, sf)
    return s.where(F.col("section_type").isin(*T.SECTION_TYPES) & ~T.heading_excluded(F.col("heading"))).select("document_id", "section_order", "section_type", "heading")


def chunk_windows(spark: SparkSession, sf: str) -> DataFrame:
    """W1 over the sections of every document."""
    return chunk.window_table(_once(spark, sf, "sections"))


def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    """W3 over every document."""
    return chunk.chunk_documents(_once(spark, sf, "extraction_method", "source_type", "source_identifier", "metadata", "sections"))


def chunk_table(spark: SparkSession, sf: str) -> DataFrame:
    """W2 and W3 in columns that SQL can be held against: every chunk with a digest of its text."""
    c = chunk_documents(spark, sf)
    return c.select("chunk_id", "document_id", "chunk_index", "section_order", "section_type", "heading", F.md5("text").alias("digest"), "token_count", "sentence_count")


def chunk_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """A8 over the given chunks, rows loaded twice counted once."""
    once = table(spark, sf, "chunks").select("document_id", "chunk_id", "token_count").distinct()
    return chunk.chunk_manifest(once)


def safe_names(spark: SparkSession, sf: str) -> DataFrame:
    """File names of documents."""
    return table(spark, sf, "extracted_documents").select("document_id").distinct().withColumn("name", T.safe_filename(F.col("document_id")))


def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    """T10 but for the folding of characters, over section texts."""
    return _sections(spark, sf).select("document_id", "section_order", T.clean_page_text(F.coalesce("text", F.lit(""))).alias("text")).distinct()


def folded_text(spark: SparkSession, sf: str) -> DataFrame:
    """T9 and T10's folding over documents."""
    return extract.fold_unicode(table(spark, sf, "documents"), "doc_id", "text")


def repeated_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that stand in many sections of one document, sections taken as pages."""
    pages = _sections(spark, sf).where("text is not null").select("document_id", "section_order", "text").distinct()
    return extract.repeated_page_lines(pages, "document_id", "section_order", "text", 0.3)


def _page_text(spark: SparkSession, sf: str) -> DataFrame:
    """Plain texts of documents: title line, then each section's heading and text."""
    parts = F.transform(F.filter("sections", lambda s: s.text.isNotNull()), lambda s: F.concat(F.when(F.coalesce(s.heading, F.lit("")) != "", F.concat(s.heading, F.lit("\n"))).otherwise(F.lit("")), s.text))
    return _once(spark, sf, "sections").select("document_id", F.array_join(parts, "\n").alias("text"))


def heading_sections(spark: SparkSession, sf: str) -> DataFrame:
    """W5 over plain texts."""
    return extract.sections_from_text(_page_text(spark, sf), "document_id", "text")


def full_text(spark: SparkSession, sf: str) -> DataFrame:
    """P8 over every document."""
    return corpus.full_text(table(spark, sf, "extracted_documents"))


def truncated_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """T17 over chunk texts."""
    return table(spark, sf, "chunks").select("chunk_id", T.truncate_text(F.col("text"), 400).alias("text")).distinct()


def _esc(c) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "&", "&amp;"), "<", "&lt;"), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def _sections_as(part: str, title: str) -> Column:
    """All sections as XML parts; one below level 1 is nested in an empty part, one without heading
    stands directly in the body, before the parts."""
    own = lambda s: F.concat(F.lit(f"<{part}><{title}>"), _esc(s.heading), F.lit(f"</{title}><p>"), _esc(s.text), F.lit(f"</p></{part}>"))
    direct = F.transform(F.filter("sections", lambda s: F.coalesce(s.heading, F.lit("")) == ""), lambda s: F.concat(F.lit("<p>"), _esc(s.text), F.lit("</p>")))
    headed = F.transform(F.filter("sections", lambda s: F.coalesce(s.heading, F.lit("")) != ""), lambda s: F.when(s.level > 1, F.concat(F.lit(f"<{part}>"), own(s), F.lit(f"</{part}>"))).otherwise(own(s)))
    return F.concat(F.array_join(direct, ""), F.array_join(headed, ""))


def _parsed(src: DataFrame, kind: str) -> DataFrame:
    """One row per parsed section, with its document's metadata."""
    out = extract.parse_xml(src, "document_id", "xml", kind)
    return out.select(F.col("source").alias("document_id"), "title", "doi", "journal", "publication_date", F.array_join("authors", "|").alias("authors"), F.array_join("references", "|").alias("refs"), F.explode_outer("sections").alias("s")).select("*", *[F.col(f"s.{c}").alias(n) for c, n in (("section_type", "section_type"), ("heading", "heading"), ("text", "text"), ("order", "section_order"), ("level", "level"))]).drop("s")


def _xml_source(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, sf, "metadata", "sections", "references")


def jats_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Every document written as a JATS article, with all its sections, nested and
    direct ones, typed contributors, dates and references, parsed again."""
    m = "metadata"
    authors = F.transform(F.coalesce(f"{m}.authors", F.array().cast("array<string>")), lambda a: F.concat(F.lit("<contrib contrib-type='author'><name><surname>"), _esc(a), F.lit("</surname></name></contrib><contrib contrib-type='editor'><name><surname>Editor</surname></name></contrib>")))
    refs = F.transform(F.coalesce("references", F.array().cast("array<string>")), lambda r: F.concat(F.lit("<ref>"), _esc(r), F.lit("</ref>")))
    xml = F.concat(
        F.lit("<article><front><journal-meta><journal-title>"), _esc(F.col(f"{m}.journal")), F.lit("</journal-title></journal-meta><article-meta><article-id pub-id-type='doi'>"), _esc(F.col(f"{m}.doi")), F.lit("</article-id><article-title>"), _esc(F.col(f"{m}.title")), F.lit("</article-title>"),
        F.array_join(authors, ""), F.lit("<pub-date pub-type='collection'><year>1900</year></pub-date><pub-date pub-type='epub'><year>"), F.substring(F.coalesce(f"{m}.publication_date", F.lit("")), 1, 4), F.lit("</year><month>7</month></pub-date><abstract><p>All in short.</p></abstract></article-meta></front><body>"),
        _sections_as("sec", "title"), F.lit("</body><back><ref-list>"), F.array_join(refs, ""), F.lit("</ref-list></back></article>"),
    )
    return _parsed(_xml_source(spark, sf).select("document_id", xml.alias("xml")), "jats")


def tei_parse(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a TEI document, editors of the volume and other dates among it."""
    m = "metadata"
    authors = F.transform(F.coalesce(f"{m}.authors", F.array().cast("array<string>")), lambda a: F.concat(F.lit("<author><persName><forename>A.</forename><surname>"), _esc(a), F.lit("</surname></persName></author>")))
    refs = F.transform(F.coalesce("references", F.array().cast("array<string>")), lambda r: F.concat(F.lit("<biblStruct>"), _esc(r), F.lit("</biblStruct>")))
    xml = F.concat(
        F.lit("<TEI xmlns='http://www.tei-c.org/ns/1.0'><teiHeader><sourceDesc><biblStruct><analytic><title level='a'>"), _esc(F.col(f"{m}.title")), F.lit("</title>"), F.array_join(authors, ""), F.lit("</analytic><monogr><title level='j'>"), _esc(F.col(f"{m}.journal")),
        F.lit("</title><editor><persName><surname>Editor</surname></persName></editor><imprint><date type='submitted' when='1900'/><date type='published' when='"), _esc(F.col(f"{m}.publication_date")), F.lit("'>when printed</date></imprint></monogr><idno type='DOI'>"), _esc(F.col(f"{m}.doi")),
        F.lit("</idno></biblStruct></sourceDesc><profileDesc><abstract><p>All in short.</p></abstract></profileDesc></teiHeader><text><body>"), _sections_as("div", "head"), F.lit("</body><back>"), F.array_join(refs, ""), F.lit("</back></text></TEI>"),
    )
    return _parsed(_xml_source(spark, sf).select("document_id", xml.alias("xml")), "tei")


def pubmed_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Title, authors and abstract of every document written as a PubMed record, parsed again."""
    m = "metadata"
    authors = F.transform(F.coalesce(f"{m}.authors", F.array().cast("array<string>")), lambda a: F.concat(F.lit("<Author><LastName>"), _esc(a), F.lit("</LastName></Author>")))
    texts = F.transform(F.filter("sections", lambda s: s.section_type == "abstract"), lambda s: F.concat(F.lit("<AbstractText>"), _esc(s.text), F.lit("</AbstractText>")))
    xml = F.concat(F.lit("<P><PMID>7</PMID><Article><ArticleTitle>"), _esc(F.col(f"{m}.title")), F.lit("</ArticleTitle><Journal><Title>"), _esc(F.col(f"{m}.journal")), F.lit("</Title></Journal><Abstract>"), F.array_join(texts, ""), F.lit("</Abstract><AuthorList>"), F.array_join(authors, ""), F.lit("</AuthorList></Article><ArticleId IdType='doi'>"), _esc(F.col(f"{m}.doi")), F.lit("</ArticleId></P>"))
    return _parsed(_xml_source(spark, sf).select("document_id", xml.alias("xml")), "pubmed")


QUERIES = {f.__name__: f for f in (token_estimate, whitespace, paragraphs, labelled_paragraphs, sentences, section_filter, chunk_windows, chunk_documents, chunk_table, chunk_manifest, safe_names, clean_text, folded_text, repeated_lines, heading_sections, full_text, truncated_contexts, jats_parse, tei_parse, pubmed_parse)}

# DuckDB's white space for \s in the Unicode sense, and word characters.
_S = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
_W = r"[\p{L}\p{M}\p{N}_]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


def _norm(x: str) -> str:
    x = f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"
    x = f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"
    x = f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return _strip(x)


def _tokens(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR NOT regexp_matches({x}, '[^\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x85]') THEN 0 ELSE CAST(greatest(len(regexp_extract_all({x}, '{_W}+(?:[-'']{_W}+)?|[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s\\p{{Z}}]')), CAST(ceil(length({x}) / 4.0) AS INT)) AS INT) END"


_NOTICE = r"(?i)^\s*(supplementary\s+(material|file|figure|table|information)\b|additional\s+file\b|electronic\s+supplementary\s+material\b|the\s+online\s+version\s+contains\s+supplementary\s+material\b|below\s+is\s+the\s+link\s+to\s+the\s+electronic\s+supplementary\s+material\b)"


def _notice(x: str) -> str:
    return f"({x} = '' OR regexp_matches({x}, '{_NOTICE}') OR starts_with(lower({x}), 'supplementary file') OR starts_with(lower({x}), 'supplementary data') OR starts_with(lower({x}), 'supporting information'))"


def _caption(x: str) -> str:
    return f"regexp_matches({x}, '(?i)^\\s*(fig(ure)?|table)\\.?\\s*\\d+[\\s:.-]')"


def _verb(x: str) -> str:
    return f"regexp_matches({x}, '(?i)\\b(shows?|illustrates?|depicts?|presents?|reports?|summari[sz]es?|displays?|indicates?)\\b')"


def _protect(x: str) -> str:
    for a in T.ABBREVIATIONS:
        parts = a.split(".")[:-1]
        pattern = "(?i)" + "".join(f"({p})\\." for p in parts)
        new = "".join(f"\\{i + 1}<prd>" for i in range(len(parts)))
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    for right in (r"\.", r"(?:\.|<prd>)"):  # consuming form, twice
        x = f"regexp_replace({x}, '\\b([A-Z])\\.({_S}+[A-Z]{right})', '\\1<prd>\\2', 'g')"
    return x


def _sentences(x: str) -> str:
    """An SQL list of the sentences of a text."""
    marked = f"regexp_replace({_protect(_norm(x))}, '([.!?]){_S}+([A-Z0-9(\"''\\[])', '\\1' || chr(64976) || '\\2', 'g')"
    clean = f"list_transform(string_split({marked}, chr(64976)), lambda r: {_strip('replace(r, ' + chr(39) + '<prd>' + chr(39) + ', ' + chr(39) + '.' + chr(39) + ')')})"
    n = _norm("z")
    return f"list_filter({clean}, lambda z: z <> '' AND NOT {_notice(n)} AND NOT ({_caption(n)} AND NOT {_verb(n)}))"


def _paragraphs(x: str) -> str:
    marked = f"regexp_replace({_norm(x)}, '\\n{_S}*\\n', chr(64977), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(64977)), lambda p: {_strip('p')}), lambda p: p <> '')"


def _clean(x: str) -> str:
    ns = r"[^\s\p{Z}\x0b\x1c-\x1f\x85]"
    for pattern, new in ((f"(?i)Page{_S}+\\d+{_S}+of{_S}+\\d+", " "), (f"\\d+{_S}+/{_S}+\\d+", " "), (f"https?://{ns}+", " "), (f"(?i)doi:{_S}*{ns}+", " "), (f"{ns}+@{ns}+", " "), (f"(?m)^{_S}*\\d+{_S}*$", " "), (f"www\\.{ns}+", " "), (f"({_W}+)-\\n({_W}+)", "\\1\\2"), (f"{_S}+", " ")):
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return f"trim({x})"


_ONCE = "(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY extracted_at) AS rn FROM extracted_documents) WHERE rn = 1)"
_SECTIONS = '(SELECT DISTINCT document_id, s."order" AS section_order, s.section_type, s.heading, s.text, s.level FROM (SELECT document_id, unnest(sections) AS s FROM extracted_documents))'
_EXCLUDED = " AND ".join(f"NOT contains(lower(coalesce(heading, '')), '{t}')" for t in T.EXCLUDED_HEADINGS)
_PREFIX_LIST = "[" + ", ".join(f"'{p}'" for p in _PREFIXES) + "]"

_NAMED = rf"(?i)^{_S}*({'|'.join(extract.HEADING_KINDS)}){_S}*(:{_S}*(.*))?$"
_KIND_OF = "CASE upper(name) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in extract.HEADING_KINDS.items()) + " END"
_IS_HEADING = f"(z <> '' AND length(z) <= 100 AND (regexp_matches(z, '^{_S}*\\d+(\\.\\d+)*\\.?{_S}+[A-Z][^.!?]{{2,90}}$') OR (upper(z) = z AND lower(z) <> z AND len(string_split(trim(regexp_replace(z, '{_S}+', ' ', 'g')), ' ')) <= 12)))"
_W5 = f"""WITH t AS (SELECT document_id, array_to_string(list_transform(list_filter(coalesce(sections, []), lambda s: s.text IS NOT NULL), lambda s: CASE WHEN coalesce(s.heading, '') <> '' THEN s.heading || chr(10) ELSE '' END || s.text), chr(10)) AS text FROM {_ONCE}),
l AS (SELECT document_id, unnest(range(0, len(x))) AS i, unnest(x) AS line FROM (SELECT document_id, string_split_regex(text, '\r\n|\n|\r') AS x FROM t)),
m AS (SELECT *, regexp_matches(line, '{_NAMED}') AS named, regexp_extract(line, '{_NAMED}', 1) AS name, {_strip(f"regexp_extract(line, '{_NAMED}', 3)")} AS rest, {_strip('line')} AS z FROM l),
k AS (SELECT *, coalesce(last_value(CASE WHEN named THEN {_KIND_OF} END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY i), 'front') AS k0 FROM m),
g AS (SELECT *, NOT named AND k0 NOT IN ('front', 'references') AND {_IS_HEADING} AS generic FROM k),
o AS (SELECT *, last_value(CASE WHEN named THEN false WHEN generic THEN true END IGNORE NULLS) OVER w AS opened, sum(CASE WHEN named OR generic THEN 1 ELSE 0 END) OVER w AS s FROM g WINDOW w AS (PARTITION BY document_id ORDER BY i)),
c AS (SELECT document_id, i, s, CASE WHEN opened AND k0 <> 'references' THEN 'body' ELSE k0 END AS kind, CASE WHEN named THEN rest WHEN generic THEN '' ELSE line END AS content, CASE WHEN named THEN {_strip('name')} WHEN generic THEN z END AS heading FROM o),
p AS (SELECT document_id, s, 0 AS r, CASE WHEN kind = 'front' THEN 'title' ELSE kind END AS section_type, coalesce(max(heading), '') AS heading, {_clean("string_agg(content, chr(10) ORDER BY i)")} AS text FROM c WHERE kind <> 'references' GROUP BY document_id, s, kind
  UNION ALL SELECT document_id, s, i, 'reference', '', {_clean('content')} FROM c WHERE kind = 'references')
SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id, section_type = 'reference' ORDER BY s, r) - 1 AS INT) AS section_order, section_type, heading, text FROM p WHERE text <> ''"""

def _windows(sentences: str) -> str:
    """The windows of W1 as table w, over lists l of sentences given as an expression of l0."""
    return _WINDOWS.replace("@", sentences)


# Runs of words of an oversized sentence, folded with a mark between the runs
_LAST = "list_last(string_split(acc, chr(64978)))"
_RUNS = f"string_split(list_reduce(list_filter(string_split_regex(y, '{_S}+'), lambda v: v <> ''), lambda acc, v: CASE WHEN {_tokens(_LAST + ' || chr(32) || v')} > 400 THEN acc || chr(64978) || v ELSE acc || ' ' || v END), chr(64978))"
_SPLIT = f"flatten(list_transform(l0, lambda y: CASE WHEN {_tokens('y')} > 520 THEN {_RUNS} ELSE [y] END))"
_WINDOWS = f"""WITH RECURSIVE s0 AS (SELECT document_id, si, coalesce(s."order", 0) AS section_order, s.text AS text, coalesce(s.section_type, '') AS section_type, coalesce(s.heading, '') AS heading FROM (SELECT document_id, unnest(range(0, len(sections))) AS si, unnest(sections) AS s FROM {_ONCE})),
s AS (SELECT * EXCLUDE (text), list_filter({_paragraphs('text')}, lambda q: NOT ({_caption(_norm('q'))} OR {_notice(_norm('q'))})) AS ps FROM s0 WHERE text IS NOT NULL AND section_type IN ('abstract', 'body', 'conclusion') AND {_EXCLUDED}),
t AS (SELECT * EXCLUDE (ps), flatten(list_transform(ps, lambda q: {_sentences('q')})) AS l0 FROM s),
v AS (SELECT * EXCLUDE (l0), @ AS l FROM t),
u AS (SELECT *, list_transform(l, lambda y: {_tokens('y')}) AS t FROM v),
c AS (SELECT * EXCLUDE (t), len(t) AS n, list_prepend(0, list_transform(range(1, len(t) + 1), lambda i: CAST(list_sum(t[1:i]) AS INT))) AS p FROM u WHERE len(t) > 0),
w AS (
  SELECT *, 0 AS window_index, 0 AS start, greatest(1, list_max(list_filter(range(0, n + 1), lambda e: p[e + 1] - p[1] <= 400))) AS stop FROM c
  UNION ALL
  SELECT * EXCLUDE (window_index, start, stop, o, nxt), window_index + 1, nxt, greatest(nxt + 1, list_max(list_filter(range(nxt, n + 1), lambda e: p[e + 1] - p[nxt + 1] <= 400))) FROM (
    SELECT *, CASE WHEN o > start AND o < stop THEN o ELSE stop END AS nxt FROM (SELECT *, coalesce(list_max(list_filter(range(start, stop), lambda b: p[stop + 1] - p[b + 1] >= 80)), start) AS o FROM w WHERE stop < n)))
"""

_PLAIN = lambda x: f"nfc_normalize(trim(regexp_replace(regexp_replace(coalesce({x}, ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), '{_S}+', ' ', 'g')))"


def _inline_sql(x: str) -> str:
    """T9 of a text that went through XML."""
    clean = f"regexp_replace(coalesce({x}, ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')"
    return f"trim(regexp_replace(nfc_normalize({clean}), '[\\s\\p{{Z}}\\x85]+', ' ', 'g'))"


def _xml_sql(date: str, author: str, body: bool = True) -> str:
    """What the parsers have to find: metadata, then title, abstract, direct paragraphs and parts in order."""
    meta = "metadata."
    keep = "list_filter({l}, lambda x, i: x <> '' AND list_position({l}, x) = i)" if body else "list_filter({l}, lambda x: x <> '')"
    authors = "list_transform(coalesce(metadata.authors, []), lambda a: " + author.replace("{a}", _inline_sql("a")) + ")"
    refs = "list_filter(list_transform(coalesce(\"references\", []), lambda r: " + _inline_sql("r") + "), lambda r: r <> '')" if body else "[]"
    head = f"""WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY extracted_at) AS rn FROM extracted_documents) WHERE rn = 1),
m AS (SELECT document_id, sections, {_inline_sql(meta + 'title')} AS title, {_inline_sql(meta + 'doi')} AS doi, {_inline_sql(meta + 'journal')} AS journal, {date} AS publication_date, array_to_string({keep.replace('{l}', authors)}, '|') AS authors, array_to_string({refs}, '|') AS refs FROM d),
s AS (SELECT document_id, unnest(range(0, len(sections))) AS i, unnest(sections) AS x FROM m),
t AS (SELECT document_id, i, coalesce(x.heading, '') = '' AS direct, {_inline_sql('x.heading')} AS heading, {_inline_sql('x.text')} AS text, x.level AS level, x.section_type AS kind FROM s),
"""
    if body:
        parts = """p AS (SELECT document_id, 0 AS a, 0 AS i, 'title' AS section_type, '' AS heading, title AS text, 0 AS level FROM m WHERE title <> ''
 UNION ALL SELECT document_id, 1, 0, 'abstract', 'Abstract', 'All in short.', 1 FROM m
 UNION ALL SELECT document_id, 2, 0, 'body', '', string_agg(text, chr(10) || chr(10) ORDER BY i), 1 FROM t WHERE direct AND text <> '' GROUP BY document_id
 UNION ALL SELECT document_id, 3, i, CASE WHEN contains(lower(heading), 'conclusion') THEN 'conclusion' ELSE 'body' END, heading, text, CASE WHEN level > 1 THEN 2 ELSE 1 END FROM t WHERE NOT direct AND text <> '')
"""
    else:
        parts = """p AS (SELECT document_id, 0 AS a, 0 AS i, 'title' AS section_type, '' AS heading, title AS text, 0 AS level FROM m WHERE title <> ''
 UNION ALL SELECT document_id, 1, 0, 'abstract', 'Abstract', string_agg(text, chr(10) || chr(10) ORDER BY i), 1 FROM t WHERE kind = 'abstract' AND text <> '' GROUP BY document_id)
"""
    return head + parts + "SELECT m.document_id, title, doi, journal, publication_date, authors, refs, section_type, heading, text, CASE WHEN section_type IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY m.document_id ORDER BY a, i) - 1 AS INT) END AS section_order, CAST(level AS INT) AS level FROM m LEFT JOIN p USING (document_id)"


_YEAR = _inline_sql("substr(metadata.publication_date, 1, 4)")
_JATS = _xml_sql(f"CASE WHEN {_YEAR} = '' THEN '07-00' ELSE {_YEAR} || '-07-00' END", "{a}")
_TEI = _xml_sql("coalesce(nullif(metadata.publication_date, ''), 'when printed')", "trim('A. ' || {a})")
_PUBMED = _xml_sql("''", "{a}", body=False)


ORACLES = {
    "jats_parse": _JATS,
    "tei_parse": _TEI,
    "pubmed_parse": _PUBMED,
    "heading_sections": _W5,
    "token_estimate": f"SELECT doc_id, {_tokens('text')} AS tokens FROM documents",
    "whitespace": f"SELECT doc_id, {_norm('text')} AS text FROM documents",
    "paragraphs": f"""WITH p AS (SELECT doc_id, {_paragraphs('text')} AS l FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS text FROM p)
SELECT doc_id, CAST(i AS INT) AS paragraph, text, ({_caption(_norm('text'))} OR {_notice(_norm('text'))}) AS dropped FROM x""",
    "labelled_paragraphs": f"""WITH x AS (SELECT doc_id, {_norm(_PREFIX_LIST + '[CAST(doc_id % ' + str(len(_PREFIXES)) + ' AS INT) + 1] || text')} AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, ({_caption('t')} OR {_notice('t')}) AS paragraph_dropped, {_notice('t')} AS notice, ({_caption('t')} AND NOT {_verb('t')}) AS caption FROM x""",
    "sentences": f"""WITH s AS (SELECT doc_id, {_sentences("coalesce(text, '')")} AS l FROM documents)
SELECT doc_id, CAST(i AS INT) AS sentence_index, sentence FROM (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS sentence FROM s)""",
    "section_filter": f"SELECT document_id, section_order, section_type, heading FROM {_SECTIONS} WHERE section_type IN ('abstract', 'body', 'conclusion') AND {_EXCLUDED}",
    "chunk_windows": _windows("l0") + "SELECT document_id, section_order, CAST(window_index AS INT) AS window_index, CAST(start AS INT) AS start, CAST(stop AS INT) AS stop, CAST(p[stop + 1] - p[start + 1] AS INT) AS tokens FROM w",
    "chunk_table": _windows(_SPLIT) + f""", x AS (SELECT document_id, section_order, section_type, heading, array_to_string(l[start + 1:stop], ' ') AS text, stop - start AS n, row_number() OVER (PARTITION BY document_id ORDER BY si, window_index) AS k FROM w),
y AS (SELECT *, {_tokens('text')} AS tok FROM x),
r AS (SELECT document_id, k, 0 AS chunk_index, section_order, section_type, heading, text, tok, n FROM y WHERE k = 1
 UNION ALL SELECT document_id, k, CASE WHEN merge THEN ci ELSE ci + 1 END, section_order, section_type, heading, t, CASE WHEN merge THEN {_tokens('t')} ELSE tok END, CASE WHEN merge THEN n + rn ELSE n END FROM (
  SELECT y.*, merge, r.chunk_index AS ci, r.n AS rn, CASE WHEN merge THEN r.text || ' ' || y.text ELSE y.text END AS t FROM (SELECT r.*, y.tok < 80 AND r.section_order = y.section_order AND r.tok + y.tok <= 520 AS merge FROM r JOIN y ON y.document_id = r.document_id AND y.k = r.k + 1) r JOIN y ON y.document_id = r.document_id AND y.k = r.k + 1)),
z AS (SELECT *, row_number() OVER (PARTITION BY document_id, chunk_index ORDER BY k DESC) AS last FROM r)
SELECT CASE WHEN name = '' THEN 'document' ELSE name END || '_chunk_' || lpad(CAST(chunk_index AS VARCHAR), 5, '0') AS chunk_id, document_id, CAST(chunk_index AS INT) AS chunk_index, section_order, section_type, heading, md5(text) AS digest, tok AS token_count, CAST(n AS INT) AS sentence_count
FROM (SELECT *, regexp_replace(regexp_replace(document_id, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS name FROM z WHERE last = 1)""",
    "clean_text": f"""SELECT DISTINCT document_id, section_order, {_clean("coalesce(text, '')")} AS text FROM {_SECTIONS}""",
    "chunk_manifest": "SELECT document_id, count(*) AS num_chunks, CAST(sum(coalesce(token_count, 0)) AS BIGINT) AS total_tokens FROM (SELECT DISTINCT document_id, chunk_id, token_count FROM chunks) GROUP BY 1",
    "safe_names": "SELECT document_id, CASE WHEN n = '' THEN 'document' ELSE n END AS name FROM (SELECT DISTINCT document_id, regexp_replace(regexp_replace(document_id, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS n FROM extracted_documents)",
    "repeated_lines": f"""WITH p AS (SELECT DISTINCT document_id, section_order, text FROM {_SECTIONS} WHERE text IS NOT NULL),
l AS (SELECT DISTINCT document_id, section_order, {_strip('x')} AS line FROM (SELECT document_id, section_order, unnest(string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\x{{2028}}\\x{{2029}}]')) AS x FROM p)),
n AS (SELECT document_id, count(DISTINCT section_order) AS n FROM p GROUP BY 1)
SELECT document_id, line, count(*) AS pages FROM l JOIN n USING (document_id) WHERE line <> '' GROUP BY document_id, line, n HAVING count(*) >= greatest(2, floor(n * 0.3::DOUBLE + 0.999999::DOUBLE))""",
    "full_text": f"""SELECT document_id, array_to_string(list_concat(list_filter(list_transform(coalesce(sections, []), lambda s: s.text), lambda t: {_strip("coalesce(t, '')")} <> ''), list_filter(coalesce("references", []), lambda t: {_strip("coalesce(t, '')")} <> '')), chr(10) || chr(10)) AS full_text FROM {_ONCE}""",
    "truncated_contexts": "SELECT DISTINCT chunk_id, CASE WHEN length(text) <= 400 THEN text ELSE regexp_replace(substr(text, 1, 400), ' [^ ]*$', '') || ' [truncated]' END AS text FROM chunks",
}
