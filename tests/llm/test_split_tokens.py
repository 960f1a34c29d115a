import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import split, tokens


def check(text, pieces, limit, overlap):
    assert all(split.estimate_tokens(p[3]) <= limit and p[2] == split.estimate_tokens(p[3]) for p in pieces)
    assert all(text[a:b] == t and (t == t.strip() or len(pieces) == 1) for a, b, _, t in pieces)
    stop = 0
    for a, b, _, _ in pieces:
        assert not text[stop:a].strip() if a > stop else True
        if a < stop:
            assert split.estimate_tokens(text[a:stop]) <= overlap
        assert b > stop
        stop = b
    assert not text[stop:].strip()


def test_natural_boundaries():
    para = "One sentence here. " * 6
    text = f"# Head A\n\n{para}\n\n# Head B\n\n{para}\n\n- item one\n- item two\n"
    pieces = split.split_text(text, 30, 0)
    check(text, pieces, 30, 0)
    assert pieces[0][3].startswith("# Head A") and any(p[3].startswith("# Head B") for p in pieces)
    assert all(p[3].endswith((".", "two", "one", "Head A", "Head B")) for p in pieces)


def test_overlap_starts_at_a_sentence():
    text = " ".join(f"Sentence number {i} is here." for i in range(60))
    pieces = split.split_text(text, 60, 20)
    check(text, pieces, 60, 20)
    assert len(pieces) > 3 and all(b[0] < a[1] and b[3].startswith("Sentence") for a, b in zip(pieces, pieces[1:]))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab1 -.\n'é#|,", max_size=600), st.integers(8, 40), st.integers(0, 6))
def test_any_text(text, limit, overlap):
    check(text, split.split_text(text, limit, overlap), limit, overlap)


@pytest.mark.parametrize("text", ["x" * 9000, "- " * 3000, "a" * 3000 + " " + "b" * 3000, "漢" * 4000])
def test_without_boundaries(text):
    pieces = split.split_text(text)
    assert len(pieces) > 1
    check(text, pieces, 520, 80)


def test_frame(spark):
    rows = [("a", "word " * 700, 1), ("a", "word " * 700, 1), ("b", None, 2), ("c", " \n", 3), ("d", "short", 4), (None, "w " * 1200, 5)]
    df = spark.createDataFrame(rows, "id string, text string, piece int")
    got = split.split_oversized(df, "text", ["id"], oversized_only=True).collect()
    assert {r["id"] for r in got} == {"a", None} and sum(r["piece_index"] == 0 for r in got) == 3
    assert {r["id"] for r in split.split_oversized(df, "text", ["id"]).collect()} == {"a", "d", None}
    assert split.split_oversized(df.where("false"), "text", ["id"]).count() == 0


tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def codecs():
    ranks = tokens.load_ranks()
    return tokens.Encoder(ranks), tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet=" aeiolnrst\n\t'1.é漢🙂<|endoftext>", max_size=120))
def test_ids_equal_the_merges(codecs, text):
    ours, theirs = codecs
    text = text.encode("utf-8", "ignore").decode()
    ids = ours.encode(text)
    assert ids == theirs.encode_ordinary(text)
    assert b"".join(ours.bytes_of[i] for i in ids).decode() == text


def test_long_runs(codecs):
    ours, theirs = codecs
    for text in ("a" * 20000, " " * 5000 + "x", "ab" * 9000, "é" * 3000, "0123456789" * 2000):
        assert ours.encode(text) == theirs.encode_ordinary(text)


def test_ids_frame(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "  "), (1, "Hello world")], "doc_id bigint, text string").selectExpr("*", "1 as ids")
    got = sorted((r["doc_id"], list(r["ids"])) for r in tokens.encode_column(df, "doc_id", "text").collect())
    assert got == [(1, [15496, 995]), (1, [15496, 995]), (2, []), (3, []), (4, [220, 220])]
    assert tokens.encode_column(df.where("false"), "doc_id", "text").count() == 0
