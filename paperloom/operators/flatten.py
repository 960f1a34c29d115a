"""Nested JSON into linked flat rows by vectorised structural indexing."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from paperloom.runtime import map_rows

OPEN, CLOSE, COMMA, COLON = 1, 2, 3, 4
_KIND = np.zeros(256, dtype=np.int8)
for _c, _k in (("{", OPEN), ("[", OPEN), ("}", CLOSE), ("]", CLOSE), (",", COMMA), (":", COLON)):
    _KIND[ord(_c)] = _k
_BLANK = np.isin(np.arange(256), list(b" \t\r\n"))
ITEM = "node_id int, parent_id int, in_array boolean, name string, ordinal int, path string, kind string, value string"


def structural_index(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, kinds and nesting levels of the brackets and delimiters outside strings.

    Bitmaps of quotes and backslashes give the string mask (parity of the quotes so far, escaped
    ones left out), a prefix sum over brackets gives the level: a container's own brackets, commas
    and colons share one.
    """
    at = np.arange(len(data))
    slash = data == 0x5C
    last_other = np.maximum.accumulate(np.where(slash, -1, at))
    run = np.where(slash, at - last_other, 0)  # backslashes up to and with this one
    escaped = np.zeros(len(data), dtype=bool)
    escaped[1:] = run[:-1] % 2 == 1
    quote = (data == 0x22) & ~escaped
    outside = np.cumsum(quote) % 2 == 0
    kinds = np.where(outside & ~quote, _KIND[data], 0)
    pos = np.flatnonzero(kinds)
    kinds = kinds[pos]
    depth = np.cumsum(np.where(kinds == OPEN, 1, 0) - np.where(kinds == CLOSE, 1, 0))
    return pos, kinds, depth + (kinds == CLOSE)


def parse_nodes(text: str) -> list[tuple] | None:
    """All array elements and object members of a JSON text as (parent, in_array, name, ordinal, kind,
    value), parents before children, parent -1 for the root; None if the text is no valid JSON.

    Validity, spans and parents come from the structural index, at any depth: what may follow what
    is checked on all neighbouring tokens at once, the scalars and names between them are decoded
    by one call. Containers are never decoded; their value is None.
    """
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, dtype=np.uint8)
    pos, kinds, level = structural_index(data)
    if not len(pos):
        return [] if _scalars([raw]) is not None else None
    solid = ~_BLANK[data]
    solid[pos] = False
    solid = np.cumsum(solid)
    order = np.lexsort((pos, level))
    k = kinds[order]
    opener = np.maximum.accumulate(np.where(k == OPEN, np.arange(len(k)), 0))
    enclosing = np.empty(len(k), dtype=np.int64)  # each token's own opening bracket
    enclosing[order] = order[opener]
    bracket = data[pos[enclosing]]
    closes = kinds == CLOSE
    if kinds[0] != OPEN or level.min() < 1 or (closes & (level == 1)).sum() != 1 or not (closes[-1] and level[-1] == 1) or solid[pos[0]] or solid[-1] != solid[pos[-1]] or (data[pos[closes]] != bracket[closes] + 2).any():
        return None
    here, then, array, filled = kinds[:-1], kinds[1:], bracket[:-1] == ord("["), np.diff(solid[pos]) > 0
    ends = (then == COMMA) | (then == CLOSE)
    value = np.where(filled, ends, then == OPEN)  # right if a value has to follow
    right = np.where(here == CLOSE, ~filled & ends, np.where(here == COLON, ~array & value, np.where(array, value, filled & (then == COLON))))
    if not (right | (here == OPEN) & ~filled & (then == CLOSE)).all():
        return None
    begins = (filled | (then == OPEN)) & ((here == COLON) | array & ((here == OPEN) | (here == COMMA)))
    token = order[np.append(begins, False)[order]]  # a value follows these, level by level
    named, leaf = ~array[token], filled[token]
    pieces = [raw[a + 1 : b] for a, b in zip(pos[token[leaf]].tolist(), pos[token[leaf] + 1].tolist())]
    names = [raw[a + 1 : b] for a, b in zip(pos[token[named] - 1].tolist(), pos[token[named]].tolist())]
    decoded = _scalars(pieces + names)
    if decoded is None or not all(isinstance(x, str) for x in decoded[len(pieces) :]):
        return None
    commas = np.empty(len(k), dtype=np.int64)
    commas[order] = np.cumsum(k == COMMA) - np.cumsum(k == COMMA)[opener]
    number = np.full(len(k) + 1, -1, dtype=np.int64)  # a token's value -> its node; the last stands for the root
    number[token] = np.arange(len(token))
    parents = number[enclosing[token] - 1]
    scalars, words = iter(zip(decoded, pieces)), iter(decoded[len(pieces) :])
    out = []
    opens = data[pos[np.minimum(token + 1, len(pos) - 1)]]
    for parent, has_name, is_leaf, ordinal, first in zip(parents.tolist(), named.tolist(), leaf.tolist(), commas[token].tolist(), opens.tolist()):
        if is_leaf:
            x, piece = next(scalars)
            kind = "string" if isinstance(x, str) else "null" if x is None else "boolean" if isinstance(x, bool) else "number"
            body = x if kind == "string" else piece.strip(b" \t\r\n").decode()
        else:
            kind, body = "object" if first == ord("{") else "array", None
        out.append((parent, not has_name, next(words) if has_name else None, ordinal, kind, body))
    return out


def _scalars(pieces: list[bytes]) -> list | None:
    """The values of JSON scalars, decoded together; None if one of them is none. Numbers of any length will do."""
    try:
        out = json.loads(b"[" + b",".join(pieces) + b"]", parse_int=float)
    except ValueError:
        return None
    return out if len(out) == len(pieces) else None


def flatten_json(payload: str | None) -> list[tuple]:
    """Rows of ITEM for one payload; none if it is NULL, blank or no valid JSON.

    A string under ``metadata.authors`` that holds a JSON array is read as that array. Paths are
    dotted names and zero-based positions; null elements are rows of kind null and keep their place.
    """
    if not payload or not payload.strip():
        return []
    rows: list[tuple] = []
    todo = [(parse_nodes(payload) or [], -1, "")]
    for nodes, root, prefix in todo:  # grows by the arrays found in strings
        base = len(rows)
        for parent, in_array, name, ordinal, kind, value in nodes:
            up = root if parent < 0 else base + parent
            path = prefix if parent < 0 else rows[up][5]
            path = f"{path}[{ordinal}]" if in_array else f"{path}.{name}" if path else name
            inner = None
            if kind == "string" and not in_array and (path == "metadata.authors" or path.endswith(".metadata.authors")) and value.lstrip().startswith("["):
                inner = parse_nodes(value)
            if inner is not None:
                kind, value = "array", None
                todo.append((inner, len(rows), path))
            rows.append((len(rows), up, in_array, name, ordinal, path, kind, value))
    return rows


def flatten_records(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, node_id, parent_id, in_array, name, ordinal, path, kind, value): every array element
    and object member of every readable payload, each with its parent's node_id (-1: the root).

    NULL, blank and broken payloads give no row; repeated rows are flattened again; other columns
    are not read. Narrow map without shuffle: a payload is handled whole, at any depth.
    """
    src = df.select(F.col(key).alias("k"), F.col(payload).alias("p"))
    names = [x.split()[0] for x in ITEM.split(", ")]

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ["k", *names]}
        for k, p in zip(cols["k"], cols["p"]):
            for row in flatten_json(p):
                out["k"].append(k)
                for n, v in zip(names, row):
                    out[n].append(v)
        return out

    return map_rows(src, f"k {dict(src.dtypes)['k']}, {ITEM}", run).select(F.col("k").alias(key), *names)


def _items(c: Column, kind: DataType, path: Column, parent: Column, ordinal: Column, name: str) -> Column:
    """The array of rows (path, parent, ordinal, kind, value) of a value and all that is in it; empty for NULL."""
    nested = isinstance(kind, (StructType, ArrayType, MapType))
    value = F.lit(None).cast("string") if nested else c.cast("string")
    own = F.array(F.struct(path.alias("path"), parent.alias("parent"), ordinal.cast("int").alias("ordinal"), F.lit(name).alias("kind"), value.alias("value")))
    none, empty = F.lit(None), F.slice(own, 1, 0)
    if isinstance(kind, StructType):
        own = F.concat(own, *[_items(c[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}")), path, none, f"{name}.{f.name}") for f in kind])
    elif isinstance(kind, ArrayType):
        own = F.concat(own, F.flatten(F.transform(c, lambda e, i: _items(e, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), path, i, f"{name}[]"))))
    elif isinstance(kind, MapType):
        own = F.concat(own, F.flatten(F.transform(F.map_entries(c), lambda e: _items(e["value"], kind.valueType, F.concat(path, F.lit("."), e["key"].cast("string")), path, none, f"{name}.*"))))
    return F.when(c.isNull(), empty).otherwise(own)


def flatten_columns(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, path, parent, ordinal, kind, value): every non-null value in the given nested columns, at
    any depth of their schema: structs, arrays and maps (value NULL) and the scalars in them as text,
    each linked to the path of what it is in ('' for a column itself). Kind is the path without
    positions and map keys. NULL elements keep their place but are left out; repeated rows count
    once. Built-in functions only, one generator over one scan.
    """
    types = {f.name: f.dataType for f in df.schema}
    every = F.concat(*[_items(F.col(f"`{c}`"), types[c], F.lit(c), F.lit(""), F.lit(None), c) for c in columns])
    return df.select(F.col(key), F.explode(every).alias("_item")).select(key, "_item.*").distinct()
