import pytest

from tarnwork.operators.packed import parses, split_packed

SCHEMA = "field string, record_id string, text string, pos int, value string"
KINDS = {"labels": "labels", "tags": "words", "links": "numbers"}


def split(spark, texts, field="labels", pad=True):
    # a body of plain fields, as the codes of values come from the whole column
    body = ["bug", "bug, docs", "docs", "good first issue", "good first issue, bug", "area/sync; docs", "p1|p2", "rust", "rust, naming", "naming"] if pad else []
    data = [(field, f"x{i}", t, 1, "clash") for i, t in enumerate(texts)] + [(field, f"pad{i}", t, 0, None) for i, t in enumerate(body)]
    out = split_packed(spark.createDataFrame(data, SCHEMA), KINDS)
    found = {}
    for r in out.collect():
        if r["record_id"].startswith("x"):
            found.setdefault(int(r["record_id"][1:]), []).append((r["pos"], r["value"]))
    return [[v for _, v in sorted(found.get(i, []))] for i in range(len(texts))]


def test_dialects_of_labels(spark):
    cases = {
        "bug ,docs | good first issue": ["bug", "docs", "good first issue"],
        '- bug\n- "the ""big"" one"': ["bug", 'the "big" one'],
        "['area/sync', \"won't fix\"]": ["area/sync", "won't fix"],
        '["the \\"big\\" one","gr\\u00f6\\u00dfe: XL"]': ['the "big" one', "größe: XL"],
        '{bug,"good first issue"}': ["bug", "good first issue"],
        "  ;docs;;bug ;": ["docs", "bug"],
        '"wontfix, duplicate"、bug、bug': ["wontfix, duplicate", "bug", "bug"],
        "won't fix|docs": ["won't fix", "docs"],
        "bug\r\ndocs": ["bug", "docs"],
        "good first issue": ["good first issue"],
    }
    assert split(spark, list(cases)) == list(cases.values())


def test_dialects_of_words_and_numbers(spark):
    words = {"#rust #naming": ["rust", "naming"], 'rust "read, then write" naming': ["rust", "read, then write", "naming"], "rust/naming": ["rust", "naming"], "rust • naming": ["rust", "naming"], "append-only naming": ["append-only", "naming"]}
    assert split(spark, list(words), "tags") == list(words.values())
    numbers = {"#185, #126 and #223": ["185", "126", "223"], "[4, 5]": ["4", "5"], "'6','36'": ["6", "36"], "GH-40,gh-52": ["40", "52"], "#1 / #2; 3 ": ["1", "2", "3"], "7\n#8": ["7", "8"], '["403", "406"]': ["403", "406"]}
    assert split(spark, list(numbers), "links", pad=False) == list(numbers.values())


def test_nothing_values_nulls_and_repeats(spark):
    assert split(spark, ["", " ", "-", "null", "N/A", "[]", None, '["-", "bug"]', "none; bug"]) == [[], [], [], [], [], [], [], ["bug"], ["bug"]]
    twice = [("labels", "1", "bug, docs", 0, ""), ("labels", "1", "bug, docs", 0, ""), ("labels", None, "bug", 0, "")]
    assert split_packed(spark.createDataFrame(twice, SCHEMA), KINDS).count() == 2


def test_empty_table_and_long_text(spark):
    assert split_packed(spark.createDataFrame([], SCHEMA), KINDS).count() == 0
    assert len(split(spark, [", ".join(["bug"] * 20_000)])[0]) == 20_000


@pytest.mark.parametrize("width", [6, 12, 40, 400])
def test_long_values_keep_the_dialect(spark, width):
    known = ["kind:regression", "good first issue", "needs triage", "area:sync"]
    new = [f"brand new {chr(97 + i) * width}" for i in range(6)]
    body = [f"{a}; {b}" for a in known for b in known] * 20
    text = " / ".join([*known, *new])
    data = [("labels", "x", text, 0, "")] + [("labels", f"p{i}", t, 0, "") for i, t in enumerate(body)]
    found = split_packed(spark.createDataFrame(data, SCHEMA), KINDS).where("record_id = 'x'").orderBy("pos").collect()
    assert [r["value"] for r in found] == [*known, *new]


@pytest.mark.parametrize("text", ['"', "''", "[", "{}", '["a",', "\\", "- ", "#", "''a", '"a" b, c', "and"])
def test_malformed_texts_never_raise(text):
    for kind in ("labels", "words", "numbers"):
        for _, bits, values in parses(text, kind):
            assert bits >= 0 and all(values)
