import json
import random

from paperloom.operators import flatten


def paths(v, path=""):
    out = set()
    if isinstance(v, dict):
        for k, x in v.items():
            q = f"{path}.{k}" if path else k
            if (q == "metadata.authors" or q.endswith(".metadata.authors")) and isinstance(x, str):
                try:
                    x = json.loads(x) if isinstance(json.loads(x), list) else x
                except ValueError:
                    pass
            out |= paths(x, q)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            out |= ({f"{path}[{i}]"} if x is not None else set()) | paths(x, f"{path}[{i}]")
    return out


def found(payload):
    return {r[5] for r in flatten.flatten_json(payload) if r[2] and r[6] != "null"}


def random_value(rng, depth=0):
    k = rng.random()
    if depth > 5 or k < 0.35:
        return rng.choice([None, True, 1.5, -3, "", 'q"\\', "[1,{", "a,b:c]}", "é漢 ", "\\\\\""])
    if k < 0.7:
        return [random_value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {rng.choice(["a", "b c", 'k"', "metadata", "authors", "x,:"]) + rng.choice(["", "1"]): random_value(rng, depth + 1) for _ in range(rng.randint(0, 4))}


def test_random_values():
    rng = random.Random(5)
    for _ in range(2000):
        v = random_value(rng)
        text = json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]), separators=rng.choice([None, (",", ":")]) if rng.random() < 0.5 else None)
        rows = flatten.flatten_json(text)
        assert found(text) == paths(json.loads(text)), text
        for r in rows:
            assert r[1] == -1 or r[5].startswith(rows[r[1]][5]) and r[1] < r[0]


def test_authors_in_a_string():
    text = json.dumps({"metadata": {"authors": json.dumps(["A", None, {"roles": ["x"]}])}, "other": {"authors": '["B"]'}})
    assert found(text) == {"metadata.authors[0]", "metadata.authors[2]", "metadata.authors[2].roles[0]"}


def test_deep_nesting():
    text = "[" * 400 + "1" + "]" * 400
    assert len(found(text)) == 400
    deep = 100_000
    nodes = flatten.parse_nodes('{"a":' * deep + "[" * deep + "1" + "]" * deep + "}" * deep)
    assert [n[0] for n in nodes] == list(range(-1, 2 * deep - 1)) and nodes[-1][4:] == ("number", "1")
    assert flatten.parse_nodes("[" * deep + "1" + "]" * (deep - 1)) is None


def test_valid_is_what_a_parser_takes_for_valid():
    rng = random.Random(8)
    seen = {True: 0, False: 0}
    for _ in range(20_000):
        text = list(json.dumps(random_value(rng, 2), indent=rng.choice([None, 1])))
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(text))
            text[i : i + rng.randint(0, 1)] = rng.choice(['"', "[", "]", "{", "}", ",", ":", " ", "1", "\\", "null", "", "\x0b", "-", "e"])
        text = "".join(text)
        try:
            json.loads(text)
            valid = bool(text.strip())
        except ValueError:
            valid = False
        assert (flatten.parse_nodes(text) is not None) == valid, text
        seen[valid] += 1
    assert min(seen.values()) > 3000
    assert flatten.parse_nodes("[" + "9" * 10_000 + "]")[0][4] == "number"


def test_spark(spark):
    rows = [(1, '[{"a": [1, null]}]'), (2, '{"a": [1'), (3, None), (4, " "), (5, "{}"), (1, '[{"a": [1, null]}]'), (None, "[1]")]
    df = spark.createDataFrame(rows, "record_id bigint, payload string").selectExpr("record_id", "payload", "1 as path", "2 as kind")
    got = flatten.flatten_records(df, "record_id", "payload").where("in_array and kind <> 'null'").select("record_id", "path").distinct()
    assert {tuple(r) for r in got.collect()} == {(1, "[0]"), (1, "[0].a[0]"), (None, "[0]")}
    assert flatten.flatten_records(df.where("false"), "record_id", "payload").count() == 0


def test_columns(spark):
    row = (1, {"a": "x", "b": ["p", None]}, [(2, [{"k": None, "v": 1.5}])], None, {"m": "n", "z": None})
    schema = "id int, s struct<a:string,b:array<string>>, t array<struct<n:int,l:array<map<string,double>>>>, u array<int>, path map<string,string>"
    df = spark.createDataFrame([row, row, (2, None, [], [None], None)], schema)
    got = {tuple(r) for r in flatten.flatten_columns(df, "id", ["s", "t", "u", "path"]).collect()}
    assert got == {
        (1, "s", "", None, "s", None), (1, "s.a", "s", None, "s.a", "x"), (1, "s.b", "s", None, "s.b", None), (1, "s.b[0]", "s.b", 0, "s.b[]", "p"),
        (1, "t", "", None, "t", None), (1, "t[0]", "t", 0, "t[]", None), (1, "t[0].n", "t[0]", None, "t[].n", "2"), (1, "t[0].l", "t[0]", None, "t[].l", None),
        (1, "t[0].l[0]", "t[0].l", 0, "t[].l[]", None), (1, "t[0].l[0].v", "t[0].l[0]", None, "t[].l[].*", "1.5"), (1, "path", "", None, "path", None), (1, "path.m", "path", None, "path.*", "n"),
        (2, "t", "", None, "t", None), (2, "u", "", None, "u", None),
    }
    assert flatten.flatten_columns(df.where("false"), "id", ["s", "t"]).count() == 0
