import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions import text as T


def one(spark, fn, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(fn(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


def test_tokens(spark):
    cases = [(None, 0), ("", 0), (" \n\t ", 0), ("a", 1), ("Well-known don't stop.", 4 + 2), ("é" * 40, 10), ("a, b; c!", 6)]
    for text, n in cases:
        assert one(spark, T.estimate_tokens, text) == n, text


def test_whitespace_and_paragraphs(spark):
    assert one(spark, T.normalize_whitespace, " a\r\nb \t c\n\n\n\nd ") == "a\nb c\n\nd"
    assert one(spark, T.split_paragraphs, "a\n \nb\n\n\nc") == ["a", "b", "c"]
    assert one(spark, T.split_paragraphs, "") == []


def test_sentences_keep_abbreviations(spark):
    text = "Dogs learn fast (Smith et al. 2010). See Fig. 2 for details! J. K. Rowling wrote. The test. No more? Yes"
    got = one(spark, T.split_sentences, text)
    assert got[0] == "Dogs learn fast (Smith et al. 2010)."
    assert got[1] == "See Fig. 2 for details!"
    assert got[2:4] == ["J. K.", "Rowling wrote."]  # the last initial isn't followed by another
    assert "The test. No more?" in got  # abbreviations have no word boundary
    assert one(spark, T.split_sentences, "") == []


def test_captions_and_notices(spark):
    assert one(spark, lambda c: T.is_caption_or_notice(c), "Fig. 3 Mean scores") is True
    assert one(spark, lambda c: T.is_caption_or_notice(c), "Figs. 1 and 2") is False
    assert one(spark, lambda c: T.is_standalone_caption(c), "Table 2: shows that dogs rest") is False
    assert one(spark, lambda c: T.is_standalone_caption(c), "Table 2: Dogs at rest") is True
    assert one(spark, lambda c: T.is_notice(c), "Supplementary files are online") is True
    assert one(spark, lambda c: T.is_notice(c), " ") is True
    assert one(spark, T.heading_excluded, "Acknowledgements and funding") is True
    assert one(spark, T.heading_excluded, None) is False


def test_names_and_ids(spark):
    assert one(spark, T.safe_filename, "../a b/ü.pdf_") == "a_b_.pdf"
    assert one(spark, T.safe_filename, "..") == "document"
    assert one(spark, T.normalize_doi, " https://doi.org/10.1234/AbC.,; ") == "10.1234/abc"
    assert one(spark, T.normalize_doi, "DOI: 10.1/x") == "10.1/x"
    assert one(spark, T.clean_doi, "doi: 10.1/X.") == "10.1/X."
    assert one(spark, T.normalize_source, "Smith_2010_Dogs.PDF") == "smith 2010 dogs"
    assert one(spark, T.normalize_source, "10.1234") == "10"
    assert one(spark, lambda a, b: T.clean_question_id(a, b), "3.0", "9") == "3"
    assert one(spark, lambda a, b: T.clean_question_id(a, b), " ", "9") == "9"
    assert one(spark, lambda a, b: T.clean_question_id(a, b), "3b", "9") == "3b"


def test_authors_and_cuts(spark):
    assert one(spark, T.parse_authors, '["A B", "C"]') == ["A B", "C"]
    assert one(spark, T.parse_authors, "A B; C;") == ["A B", "C"]
    assert one(spark, T.parse_authors, None) == []
    assert one(spark, lambda c: T.truncate_text(c, 10), "aaaa bbbb cccc") == "aaaa bbbb [truncated]"
    assert one(spark, lambda c: T.truncate_text(c, 10), "short") == "short"
    assert one(spark, T.publication_date, "2020", "", "7") == "2020-00-07"
    assert one(spark, T.publication_date, "", "", "") == "00-00"


def test_clean_page_text(spark):
    text = "Page 3 of 9 well-\nknown\n 12 \nsee https://x.org/a and doi: 10.1/b or me@x.org 3 / 9 www.x.org end"
    assert one(spark, T.clean_page_text, text) == "wellknown see and or end"
    assert one(spark, T.looks_like_heading, "2.1 Study animals") is True
    assert one(spark, T.looks_like_heading, "STUDY ANIMALS") is True
    assert one(spark, T.looks_like_heading, "Study animals") is False
    assert one(spark, T.looks_like_heading, "12") is False


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab1 -'.,\n\té", max_size=60), min_size=1, max_size=20))
def test_token_counts_agree_with_python(spark, texts):
    pattern = re.compile(r"\b\w+(?:[-']\w+)?\b|[^\w\s]")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", T.estimate_tokens(F.col("t")).alias("n")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (max(len(pattern.findall(t)), -(-len(t) // 4)) if t.strip() else 0)


def test_json_recovery(spark):
    assert one(spark, T.recover_json, '```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, T.recover_json, 'Sure: {"a": {"b": 2}} done') == '{"a": {"b": 2}}'
    assert one(spark, T.recover_json, "none") is None
