import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import split

SPACE = " \t\r\n\f"


def size(s):
    solid = re.sub(f"[{SPACE}]", "", s)
    wide = len(re.findall("[぀-ヿ一-鿿가-힯]", s))
    return wide + len(re.findall("[A-Za-z]+", s)) if 2 * wide > len(solid) else len(re.findall(f"[^{SPACE}]+", s)) * 13 // 10


def naive_paragraphs(text):
    out, cur = [], []
    for line in text.split("\n"):
        if line.strip(SPACE):
            cur.append(line)
        elif cur:
            out.append("\n".join(cur))
            cur = []
    return out + (["\n".join(cur)] if cur else [])


def check(text, limit=60, overlap=8):
    pieces, large = split.split_text(text, limit, overlap)
    assert [k for k, _ in large] == [k for k, p in enumerate(naive_paragraphs(text)) if size(p) > limit]
    if size(text) > limit:
        assert "".join(text[a:b] for _, a, b, _ in pieces) == text
        for at, a, b, n in pieces:
            assert n == size(text[at:b]) <= limit and size(text[at:a]) <= overlap
    return pieces


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["word ", "Ende. ", "\n", "\n\n", "学生", "。", "# Head\n", "- item\n", "\r\n \n", "a1b ", "한국"]), max_size=300).map("".join))
def test_any_text(text):
    check(text)


def test_cuts_at_the_strongest_boundary():
    part = "One two three four five six seven. " * 6
    pieces = check(f"# A\n\n{part}\n\n# B\n\n{part}", limit=70, overlap=5)
    assert len(pieces) == 2 and pieces[1][1] == len(f"# A\n\n{part}\n\n")


def test_a_sentence_too_long_is_cut_inside():
    assert len(check("word " * 500)) > 5
    assert len(check("学" * 500)) > 5


def test_very_long_text():
    assert len(split.split_text("Ein Satz mit Wörtern. " * 60_000)[0]) > 300


def test_frames(spark):
    long = "All of it counts. " * 300
    rows = [(1, "us1", "abcdef0123456", long, "t"), (2, None, None, long, "t"), (3, "us1", "ff", None, "t"), (4, "us1", "ff", "", "t"), (5, "us1", "ff", "short", "t"), (1, "us1", "abcdef0123456", long, "t")]
    df = spark.createDataFrame(rows, "policy_doc_id long, institution_id string, sha256 string, text string, chunk_id string")
    got = split.split_documents(df).toPandas()
    assert set(got.policy_doc_id) == {1, 2} and got["size"].max() <= split.LIMIT
    assert "us1_abcdef01_000" in set(got.chunk_id) and (got.policy_doc_id == 1).sum() == 2 * (got.policy_doc_id == 2).sum()
    assert [tuple(r) for r in split.large_paragraphs(split.split_documents(df)).distinct().orderBy("policy_doc_id").collect()] == [(1, 0), (2, 0)]
    assert split.split_documents(df.limit(0)).count() == 0
