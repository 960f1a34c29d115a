"""Queries of the nested-record operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import flatten
from paperloom.runtime import durable, table


def p6_items(spark: SparkSession, sf: str) -> DataFrame:
    """Every nested item of every readable payload, linked to its parent by node_id."""
    return flatten.flatten_records(table(spark, sf, "raw_records"), "record_id", "payload").distinct()


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of all non-null array elements."""
    rows = flatten.flatten_records(table(spark, sf, "raw_records"), "record_id", "payload")
    return rows.where("in_array AND kind <> 'null'").select("record_id", "path").distinct()


def _members(spark: SparkSession, sf: str, pattern: str, fields: dict[str, str]) -> DataFrame:
    """One row per object or string at a path like ``pattern``, with some members of it as columns."""
    rows = durable(flatten.flatten_records(table(spark, sf, "raw_records"), "record_id", "payload"))  # read twice below
    leaves = rows.where("NOT in_array AND kind <> 'null' AND value IS NOT NULL").select("record_id", F.expr("regexp_extract(path, '^(.*)[.][^.]*$', 1)").alias("path"), "name", F.col("value").alias("v"))
    wide = leaves.groupBy("record_id", "path").agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(c) for n, c in fields.items()])
    items = rows.where(F.col("in_array") & (F.col("kind") != "null") & F.col("path").rlike(pattern))
    items = items.select("record_id", "path", "ordinal", F.expr("regexp_extract(path, '^(.*)[.][^.]*$', 1)").alias("parent_path"), "value")
    return items.join(wide, ["record_id", "path"], "left")


def p6_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Flat sections at any depth: parent_path is the section or document they belong to."""
    out = _members(spark, sf, r"(^|\.)(sections|subsections)\[\d+\]$", {"section_type": "section_type", "heading": "heading", "order": "section_order", "text": "text"})
    return out.drop("value").distinct()


def p6_authors(spark: SparkSession, sf: str) -> DataFrame:
    """Flat authors: plain strings and objects alike have their name."""
    out = _members(spark, sf, r"(^|\.)metadata\.authors\[\d+\]$", {"name": "member"})
    return out.withColumn("name", F.coalesce("member", "value")).drop("member", "value").distinct()


def p6_references(spark: SparkSession, sf: str) -> DataFrame:
    """Flat references: plain strings and objects alike have their title."""
    out = _members(spark, sf, r"(^|\.)references\[\d+\]$", {"title": "member"})
    return out.withColumn("title", F.coalesce("member", "value")).drop("member", "value").distinct()


def p6_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Everything in the nested columns of extracted_documents, linked to what it is in."""
    return flatten.flatten_columns(table(spark, sf, "extracted_documents"), "document_id", ["metadata", "sections", "references", "diagnostics", "warnings", "provenance"])


QUERIES = {f.__name__: f for f in (p6_found, p6_items, p6_sections, p6_authors, p6_references, p6_documents)}
_PATH = "CASE WHEN starts_with({k}, '$.') THEN substr({k}, 3) ELSE substr({k}, 2) END"
_TREE = f"""WITH r AS (SELECT record_id, payload FROM raw_records WHERE payload IS NOT NULL AND json_valid(payload)),
t AS (SELECT record_id, {_PATH.replace('{k}', 'fullkey')} AS path, type, value FROM r, json_tree(r.payload)),
a AS (SELECT record_id, path, value ->> '$' AS inside FROM t WHERE (path = 'metadata.authors' OR ends_with(path, '.metadata.authors')) AND type = 'VARCHAR'),
b AS (SELECT * FROM a WHERE json_valid(inside) AND json_type(inside) = 'ARRAY'),
u AS (SELECT record_id, b.path || substr(j.fullkey, 2) AS path, j.type FROM b, json_tree(b.inside) j)
"""


def _documents_sql() -> str:
    """One SELECT for each struct, array, map and scalar of the nested columns."""
    e, d = "extracted_documents", "document_id"
    none = "CAST(NULL AS INT)"
    out = [f"SELECT {d}, '{c}' AS path, '' AS parent, {none} AS ordinal, '{c}' AS kind, NULL AS value FROM {e} WHERE \"{c}\" IS NOT NULL" for c in ("metadata", "sections", "references", "diagnostics", "warnings", "provenance")]
    for up, names in (("metadata", "title doi journal pmid pmcid publication_date"), ("diagnostics", "section_count reference_count character_count page_count")):
        out += [f"SELECT {d}, '{up}.{n}', '{up}', {none}, '{up}.{n}', CAST({up}.{n} AS VARCHAR) FROM {e} WHERE {up}.{n} IS NOT NULL" for n in names.split()]
    for up, n in (("metadata", "authors"), ("diagnostics", "removed_repeated_lines")):
        out.append(f"SELECT {d}, '{up}.{n}', '{up}', {none}, '{up}.{n}', NULL FROM {e} WHERE {up}.{n} IS NOT NULL")
    for path, c in (("metadata.authors", "metadata.authors"), ("diagnostics.removed_repeated_lines", "diagnostics.removed_repeated_lines"), ("references", '"references"'), ("warnings", "warnings")):
        out.append(f"SELECT {d}, '{path}[' || o || ']', '{path}', CAST(o AS INT), '{path}[]', v FROM (SELECT {d}, unnest(range(0, len({c}))) AS o, unnest({c}) AS v FROM {e}) WHERE v IS NOT NULL")
    sections = f"(SELECT {d}, unnest(range(0, len(sections))) AS o, unnest(sections) AS s FROM {e})"
    out.append(f"SELECT {d}, 'sections[' || o || ']', 'sections', CAST(o AS INT), 'sections[]', NULL FROM {sections} WHERE s IS NOT NULL")
    out += [f"SELECT {d}, 'sections[' || o || '].{n}', 'sections[' || o || ']', {none}, 'sections[].{n}', CAST(s.\"{n}\" AS VARCHAR) FROM {sections} WHERE s.\"{n}\" IS NOT NULL" for n in ("section_type", "heading", "text", "order", "level")]
    out.append(f"SELECT {d}, 'provenance.' || m.key, 'provenance', {none}, 'provenance.*', m.value FROM (SELECT {d}, unnest(map_entries(provenance)) AS m FROM {e}) WHERE m.value IS NOT NULL")
    return "SELECT DISTINCT * FROM (" + "\nUNION ALL ".join(out) + ")"


def _members_sql(pattern: str, columns: str) -> str:
    """Array elements at paths like ``pattern`` with members of theirs: m(name) stands for a member's text."""
    return _TREE + f""", n AS (SELECT record_id, path, type, value FROM t UNION ALL SELECT record_id, b.path || substr(j.fullkey, 2), j.type, j.value FROM b, json_tree(b.inside) j),
i AS (SELECT record_id, path, CASE WHEN type = 'VARCHAR' THEN value ->> '$' END AS own, regexp_extract(path, '^(.*)[.][^.]*$', 1) AS parent_path, CAST(regexp_extract(path, '\\[(\\d+)\\]$', 1) AS INT) AS ordinal FROM n WHERE type <> 'NULL' AND regexp_matches(path, '{pattern}')),
k AS (SELECT record_id, regexp_extract(path, '^(.*)[.][^.]*$', 1) AS path, regexp_extract(path, '[^.]*$') AS name, value ->> '$' AS v FROM n WHERE type NOT IN ('NULL', 'OBJECT', 'ARRAY') AND NOT ends_with(path, ']')),
w AS (SELECT record_id, path, map_from_entries(list((name, v))) AS e FROM k GROUP BY 1, 2)
SELECT DISTINCT i.record_id, i.path, i.ordinal, i.parent_path, {columns} FROM i LEFT JOIN w USING (record_id, path)"""


ORACLES = {
    "p6_sections": _members_sql(r"(^|\.)(sections|subsections)\[\d+\]$", "e['section_type'] AS section_type, e['heading'] AS heading, e['order'] AS section_order, e['text'] AS text"),
    "p6_authors": _members_sql(r"(^|\.)metadata\.authors\[\d+\]$", "coalesce(e['name'], own) AS name"),
    "p6_references": _members_sql(r"(^|\.)references\[\d+\]$", "coalesce(e['title'], own) AS title"),
    "p6_found": _TREE + "SELECT DISTINCT record_id, path FROM (SELECT record_id, path, type FROM t UNION ALL SELECT record_id, path, type FROM u) WHERE ends_with(path, ']') AND type <> 'NULL'",
    "p6_documents": _documents_sql(),
}
