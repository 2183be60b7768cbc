from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwork.llm import leakage
from tarnwork.llm.leakage import find_leaks, remove_leaks, spans, words

LONG = "No rebuilt rows may outlive nine sharded labels of Dridorak while the frozen index waits for twelve tokens"
SHORT = "Exactly sixty tokens survive today."


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, text string, doc_id string")


DOCS = [
    (1, "Preface. " + LONG.upper() + "! End", "x"),
    (2, "part: " + " ".join(LONG.split()[2:15]) + " tail", "x"),
    (3, "only twelve words: " + " ".join(LONG.split()[2:14]) + " tail", "x"),
    (4, "Exactly&nbsp;six­ty to​kens—survive, TODAY", "x"),
    (5, "ｅｘａｃｔｌｙ ｓｉｘｔｙ tokens\nsurvive\ttoday", "x"),
    (6, "exactly_sixty.tokens/survive today", "x"),
    (7, "exactly sixty tokens survived today", "x"),
    (8, None, "x"),
    (9, "", "x"),
    (None, LONG, "x"),
    (1, "Preface. " + LONG.upper() + "! End", "x"),
]
ITEMS = [(10, LONG, "y"), (11, SHORT, "y"), (11, SHORT, "y"), (12, None, "y"), (13, "?!", "y"), (None, LONG, "y")]
WANT = [(1, 10), (2, 10), (4, 11), (5, 11), (6, 11)]


def test_both_ways_find_the_same(spark):
    d, i = frames(spark, DOCS, ITEMS)
    assert rows(find_leaks(d, i)) == WANT
    assert rows(find_leaks(d, i, broadcast_grams=0)) == WANT


def test_empty_tables(spark):
    d, i = frames(spark, DOCS, ITEMS)
    assert rows(find_leaks(d.limit(0), i)) == rows(find_leaks(d, i.limit(0))) == rows(find_leaks(d.limit(0), i.limit(0), broadcast_grams=0)) == []


def test_very_long_document(spark):
    d, i = frames(spark, [(1, "lorem ipsum " * 200_000 + LONG + " dolor" * 1000, "x")], ITEMS)
    assert rows(find_leaks(d, i)) == [(1, 10)]


def test_removal(spark):
    d, i = frames(spark, DOCS[:7], ITEMS)
    kept = {r["doc_id"]: r for r in remove_leaks(d, i).collect()}
    assert kept[1]["text"] == "Preface.  End" and kept[3]["removed"] == 0 and kept[7]["text"] == DOCS[6][1]
    assert {r["doc_id"] for r in remove_leaks(d, i, whole=True).collect()} == {3, 7}
    assert rows(remove_leaks(d, i, broadcast_grams=0)) == rows(remove_leaks(d, i))
    assert rows(remove_leaks(d, i, whole=True, broadcast_grams=0)) == rows(remove_leaks(d, i, whole=True))
    clean = spark.createDataFrame([(k, r["text"], "") for k, r in kept.items()], "doc_id bigint, text string, item_id string")
    assert rows(find_leaks(clean, i)) == []


def test_only_the_passage_is_removed(spark):
    joined = "alpha,beta," + ",".join(LONG.split()) + ",gamma,delta"
    wide = "水光。" + "".join(LONG.split()) + "。" + LONG + "！火"
    d, i = frames(spark, [(1, joined, "x"), (2, wide, "x"), (3, "a (" + LONG + ") b", "x")], ITEMS)
    kept = {r["doc_id"]: r["text"] for r in remove_leaks(d, i).collect()}
    assert kept == {1: "alpha,beta,,gamma,delta", 2: "水光。" + "".join(LONG.split()) + "。！火", 3: "a  b"}


ODD = st.text(st.one_of(st.characters(), st.sampled_from("ae&;#x39 _\u0301\u200d\u00ad\uff9e\uff76\u1100\u1161\u11a8\u09c7\u09be\u0345ßİŉﬁ①")), max_size=60)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.one_of(ODD, st.sampled_from(["&amp;", "&eacute;", "&#x301;", "&zwj;", "&nbsp", "&ngE;"])), max_size=5))
def test_every_word_has_its_place(parts):
    text = "".join(parts)
    places = spans(text)
    assert len(places) == len(words(text))
    assert all(0 <= a < b <= len(text) for a, b in places) and all(x[0] <= y[0] and x[1] <= y[1] for x, y in zip(places, places[1:], strict=False))


def test_words_and_spans():
    assert words("A_b c&amp;d ﬁn ①") == ["a", "b", "c", "d", "fin", "1"]
    assert words("Straße STRASSE") == ["strasse", "strasse"]
    assert len(spans("a_b c")) == len(words("a_b c")) == 3
    assert leakage.grams_of("a b", 13) == {("a", "b")} and leakage.grams_of(" ", 13) == set()
