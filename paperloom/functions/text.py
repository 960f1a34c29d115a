"""Text functions as Catalyst-visible column expressions.

Patterns use Java's Unicode character classes; white space is stripped in the Unicode sense.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lists and patterns that results depend on.
ABBREVIATIONS = ("et al.", "e.g.", "i.e.", "cf.", "vs.", "Fig.", "Figs.", "Eq.", "Eqs.", "Table.", "Tab.", "Dr.", "Prof.", "Mr.", "Ms.", "Mrs.", "St.", "No.", "Vol.", "Inc.", "Ltd.")
PLACEHOLDER = "<prd>"
CAPTION = r"(?iU)^\s*(fig(ure)?|table)\.?\s*\d+[\s:.-]"
PROSE_VERBS = r"(?iU)\b(shows?|illustrates?|depicts?|presents?|reports?|summari[sz]es?|displays?|indicates?)\b"
NOTICE = r"(?iU)^\s*(supplementary\s+(material|file|figure|table|information)\b|additional\s+file\b|electronic\s+supplementary\s+material\b|the\s+online\s+version\s+contains\s+supplementary\s+material\b|below\s+is\s+the\s+link\s+to\s+the\s+electronic\s+supplementary\s+material\b)"
NOTICE_PREFIXES = ("supplementary file", "supplementary data", "supporting information")
EXCLUDED_HEADINGS = ("references", "bibliography", "acknowledgements", "acknowledgments", "supplementary material", "supporting information")
SECTION_TYPES = ("abstract", "body", "conclusion")
TOKEN = r"(?U)\b\w+(?:[-']\w+)?\b|[^\w\s]"
DOI = r"(?i)^10\.\d{4,9}/\S+$"
NUMBERED_HEADING = r"(?U)^\s*\d+(\.\d+)*\.?\s+[A-Z][^.!?]{2,90}$"


def strip(c: Column) -> Column:
    """Without white space at both ends, line breaks and Unicode spaces included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Each run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def estimate_tokens(c: Column) -> Column:
    """0 for NULL and blank texts, else the larger of the token matches and a quarter of the characters."""
    n = F.greatest(F.regexp_count(c, F.lit(TOKEN)), F.ceil(F.length(c) / 4).cast("int"))
    return F.when(c.isNull() | ~c.rlike(r"(?U)\S"), F.lit(0)).otherwise(n)


def normalize_whitespace(c: Column) -> Column:
    """One kind of line break, single spaces, at most one blank line, stripped."""
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, "[ \t]+", " ")
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def split_paragraphs(c: Column) -> Column:
    """Stripped, non-empty paragraphs of a normalised text."""
    parts = F.split(normalize_whitespace(c), r"\n(?U)\s*\n")
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def _caption(s: Column) -> Column:
    return s.rlike(CAPTION)


def _notice(s: Column) -> Column:
    low = F.lower(s)
    return (s == "") | s.rlike(NOTICE) | low.startswith(NOTICE_PREFIXES[0]) | low.startswith(NOTICE_PREFIXES[1]) | low.startswith(NOTICE_PREFIXES[2])


def _standalone_caption(s: Column) -> Column:
    return _caption(s) & ~s.rlike(PROSE_VERBS)


def is_caption(c: Column) -> Column:
    """Starts like a figure or table label."""
    return _caption(normalize_whitespace(c))


def is_notice(c: Column) -> Column:
    """blank, or starts like a notice of supplementary material."""
    return _notice(normalize_whitespace(c))


def is_caption_or_notice(c: Column) -> Column:
    """a paragraph to drop; no exception for prose that begins like a caption."""
    return is_caption(c) | is_notice(c)


def is_standalone_caption(c: Column) -> Column:
    """a caption without a verb of prose."""
    return _standalone_caption(normalize_whitespace(c))


def heading_excluded(c: Column) -> Column:
    """the heading contains an excluded term; empty headings never do."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(False)
    for term in EXCLUDED_HEADINGS:
        out = out | low.contains(term)
    return out


def protect_abbreviations(c: Column) -> Column:
    """T4: the stops of abbreviations (anywhere, in any case) and initials, replaced by a placeholder.

    Abbreviations of several stops go first; a stop after any of the others is found in one pass.
    """
    for a in ABBREVIATIONS:
        parts = a.split(".")[:-1]
        if len(parts) > 1:
            pattern = "(?iu)" + "".join(f"({p})\\." for p in parts)
            c = F.regexp_replace(c, pattern, "".join(f"${i + 1}{PLACEHOLDER}" for i in range(len(parts))))
    single = "|".join(a[:-1] for a in ABBREVIATIONS if a.count(".") == 1)
    c = F.regexp_replace(c, rf"(?iu)(?<={single})\.", PLACEHOLDER)
    return F.regexp_replace(c, r"(?U)\b([A-Z])\.(?=\s+[A-Z]\.)", "$1" + PLACEHOLDER)


def _sentences(normalized: Column) -> Column:
    raw = F.split(protect_abbreviations(normalized), r"(?U)(?<=[.!?])\s+(?=[A-Z0-9(\"'\[])")
    clean = F.transform(raw, lambda s: strip(F.replace(s, F.lit(PLACEHOLDER), F.lit("."))))
    return F.filter(clean, lambda s: ~_notice(s) & ~_standalone_caption(s))  # blank ones are notices


def split_sentences(c: Column) -> Column:
    """T5: sentences without notices and labels, abbreviations respected; an array, empty for blank texts."""
    return _sentences(normalize_whitespace(c))


def section_sentences(c: Column) -> Column:
    """Sentences of a section's paragraphs that are no captions or notices."""
    kept = F.filter(split_paragraphs(F.coalesce(c, F.lit(""))), lambda p: ~(_caption(p) | _notice(p)))
    return F.flatten(F.transform(kept, _sentences))


def safe_filename(c: Column) -> Column:
    """Only letters, digits, dot, dash and underscore; 'document' if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(s == "", F.lit("document")).otherwise(s)


def normalize_doi(c: Column) -> Column:
    """A DOI as a key: no address, label or closing marks, lower case."""
    s = F.regexp_replace(strip(c), r"(?i)^https?://(dx\.)?doi\.org/", "")
    s = strip(F.regexp_replace(s, r"(?i)^doi:\s*", ""))
    return F.lower(F.regexp_replace(s, r"[.,;]+$", ""))


def clean_doi(c: Column) -> Column:
    """A DOI for a lookup service: one prefix off, case and marks kept."""
    return strip(F.regexp_replace(c, r"(?i)^(https?://(dx\.)?doi\.org/|doi:\s*)", ""))


def normalize_source(c: Column) -> Column:
    """Lower case, no file ending, words of letters and digits only."""
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\.[a-z0-9]+$", "")
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def sources_match(a: Column, b: Column) -> Column:
    """F9, on normalised names: neither empty, and one contains the other."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def clean_question_id(raw: Column, fallback: Column) -> Column:
    """The ordinal for a blank number, whole numbers without decimals, else the text."""
    v = strip(F.coalesce(raw, F.lit("")))
    number = v.try_cast("double")
    return F.when(v == "", fallback.cast("string")).when(number.isNotNull() & (number == F.floor(number)), number.cast("bigint").cast("string")).otherwise(v)


def parse_authors(c: Column) -> Column:
    """Names of a JSON list, else of a list divided by semicolons; empty for NULL and blank."""
    listed = F.from_json(c, "array<string>")
    divided = F.filter(F.transform(F.split(c, ";"), strip), lambda x: x != "")
    return F.when(c.isNull() | (strip(c) == ""), F.array().cast("array<string>")).when(strip(c).rlike(r"^\["), F.coalesce(listed, divided)).otherwise(divided)


def truncate_text(c: Column, limit: int) -> Column:
    """Cut at the limit, back to the last space, with a mark."""
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, limit), r" [^ ]*\z", ""), F.lit(" [truncated]")))


def clean_page_text(c: Column) -> Column:
    """T10 without Unicode folding: page marks, addresses, DOIs, lines of digits out, hyphenated
    line ends joined, white space collapsed, in this order."""
    for pattern, new in (
        (r"(?iU)Page\s+\d+\s+of\s+\d+", " "), (r"(?U)\d+\s+/\s+\d+", " "), (r"(?U)https?://\S+", " "), (r"(?iU)doi:\s*\S+", " "), (r"(?U)\S+@\S+", " "),
        (r"(?mU)^\s*\d+\s*$", " "), (r"(?U)www\.\S+", " "), (r"(?U)(\w+)-\n(\w+)", "$1$2"),
    ):
        c = F.regexp_replace(c, pattern, new)
    return squeeze(c)


def looks_like_heading(c: Column) -> Column:
    """a short numbered title, or up to twelve words in capitals."""
    s = strip(c)
    words = F.size(F.split(squeeze(s), " "))
    return (s != "") & (F.length(s) <= 100) & (s.rlike(NUMBERED_HEADING) | ((F.upper(s) == s) & (F.lower(s) != s) & (words <= 12)))


def recover_json(c: Column) -> Column:
    """The JSON text of a model's answer: code fences off; if it doesn't begin and end like JSON,
    what stands between the first opening and the last closing brace."""
    s = strip(c)
    s = F.when(s.contains("```"), strip(F.regexp_replace(strip(F.regexp_replace(s, r"^```(json)?", "")), r"```$", ""))).otherwise(s)
    whole = F.try_parse_json(s)
    inner = F.regexp_extract(s, r"(?s)\{.*\}", 0)
    return F.when(whole.isNotNull(), s).when(inner != "", inner)


def publication_date(year: Column, month: Column, day: Column) -> Column:
    """The parts there are, joined by dashes; month and day are padded to two digits, so a
    missing one reads 00 while a missing year is left out."""
    text = lambda c: strip(F.coalesce(c, F.lit("")))
    pad = lambda c: F.when(F.length(text(c)) < 2, F.lpad(text(c), 2, "0")).otherwise(text(c))
    return F.array_join(F.filter(F.array(text(year), pad(month), pad(day)), lambda x: x != ""), "-")
