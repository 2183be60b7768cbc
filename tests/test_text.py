import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from tarnwork.functions import text as T
from tarnwork.functions.porter import stem
from tarnwork.functions.vectors import cosine, euclidean, l2_normalise, mean_pool
from tarnwork.operators import fts, scanning


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'double' if isinstance(v, float) else 'array<double>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("message", "want"),
    [
        ("feat(sozo): add invoke command (#3384)", ("feat", "sozo", False, 3384, [])),
        ("fix!: drop old API", ("fix", None, True, None, [])),
        ("docs: closes #12, fixes: 7", ("docs", None, False, None, [12, 7])),
        ("just words resolve #5", (None, None, None, None, [5])),
    ],
)
def test_conventional(spark, message, want):
    p = T.conventional(F.col("m"))
    r = spark.createDataFrame([(message,)], "m string").select(*(p[k].alias(k) for k in ("type", "scope", "breaking", "pr_ref", "issue_refs"))).first()
    assert tuple(r) == want


def test_small_functions(spark):
    q = F.col("q")
    assert one(spark, T.clean_commit_message(q), q="feat(x): add it (#12)\nbody") == "add it"
    assert one(spark, T.clean_commit_message(q), q="see https://x: y") == "see https://x: y"
    assert [one(spark, T.is_code_like(q), q=x) for x in ("a::b", "f()", "snake_case", "word", "two words", "")] == [True, True, True, True, False, True]
    assert one(spark, T.fts_query(q), q="How does RRF fusion work?") == "RRF OR fusion"
    assert one(spark, T.fts_query(q), q="the co-change graph") == '"co-change" OR graph'
    assert one(spark, T.fts_query(q), q="a::b c") == '"a::b c"'
    assert [one(spark, T.intent(q), q=x) for x in ("when did we add search", "why did they choose it", "how does fusion work", "what is a belief", "vectors")] == ["temporal", "rationale", "mechanism", "definition", "general"]
    assert [one(spark, T.is_lexical_query(q), q=x) for x in ("find the parser", "insert_event", "how are results ranked", "async fn")] == [True, True, False, True]
    assert one(spark, T.module_path(q), q="././src/src/a/mod.rs") == "a"
    assert one(spark, T.module_path(q), q="src/retrieval/fusion.rs") == "retrieval::fusion"
    assert [one(spark, T.is_test_file(q), q=x) for x in ("src/tests/a.rs", "a_test.go", "src/test_a.py", "src/latest.rs")] == [True, True, True, False]
    assert one(spark, T.is_entry_point(q), q="a/b/__init__.py") and not one(spark, T.is_entry_point(q), q="a/b.py")
    assert one(spark, T.directory_depth(q), q="./a/b/c.rs") == 2
    assert one(spark, T.language(q), q="x/y.TSX") == "typescript"
    assert one(spark, T.truncate(q, 5), q=" ab\ncdef ") == "ab cd..."
    assert one(spark, T.file_of(q), q="./src/a.rs::f") == "src/a.rs"
    assert one(spark, T.redact(q), q="12345678") == "********" and one(spark, T.redact(q), q="123456789") == "1234...6789"
    assert one(spark, T.snippet(q, F.lit("pattern.core")), q="# Title\n\nstatus: x\nFirst line") == "Title — First line"
    assert one(spark, T.snippet(q, F.lit("git.commit")), q="a\nb") == "a\nb"
    assert one(spark, T.document_title(q), q="---\nid: x\n---\n# Name \ntext") == "Name"
    assert one(spark, T.document_summary(q), q="---\nid: x\n---\n# Name\nSome  text\n") == "Some text"
    assert one(spark, T.belief_keywords(q), q="the-cold-ab-index-never") == ["cold", "index"]
    assert one(spark, T.file_text(q), q="a/b.md") == "File: a/b.md (Markdown document)"
    assert one(spark, T.function_text(q, F.lit("f.rs"), F.lit("a, b"), F.lit(None), F.lit(True), F.lit(False)), q="g") == "Function `g` in file `f.rs`, async, parameters: a, b"
    assert one(spark, T.belief_text(q, F.lit("high"), F.lit("b.md"), F.lit(3), F.lit(1), F.lit(2)), q="S") == "S (high, b.md) [evidence: 3/1, 2 applied]"
    line = lambda *n: one(spark, T.belief_line(q, F.lit("high"), F.lit("b.md"), *map(F.lit, n)), q="S")
    assert line(0, 0, 0, 1, 0, 0) == "S [use: 1+0 | truth: 0/0 WEAK] (high, b.md)"
    assert line(2, 0, 1, 1, 4, 3) == "S [use: 1+4 | truth: 2/0 | 3 defeated | 1 applied UNVERIFIED] (high, b.md)"
    assert [one(spark, T.change_type(F.col("a"), F.col("b")), a=x, b=y) for x, y in ((1, 0), (0, 1), (1, 1), (0, 0))] == ["added", "deleted", "modified", "modified"]
    assert [one(spark, T.activity(F.col("a"), F.col("b")), a=a, b=b) for a, b in ((0, 1), (1, 7), (1, 30), (1, 90), (1, 91))] == ["dormant", "high", "medium", "low", "dormant"]
    assert one(spark, T.query_id(F.timestamp_seconds(F.col("a")), F.lit("s")), a=0).startswith("q_19700101_000000_")
    assert one(spark, T.complexity(q), q="if a { for b in c { match d {} } }") == 4


def test_remote_urls(spark):
    got = []
    for u in ("git@github.com:o/r.git", "https://github.com/o/r", "https://gitea.example/o/r/", "nonsense"):
        p = T.remote_parts(F.col("q"))
        got.append((one(spark, p["owner"], q=u), one(spark, p["repo"], q=u), one(spark, p["forge"], q=u)))
    assert got == [("o", "r", "github"), ("o", "r", "github"), ("o", "r", "gitea"), ("", "", "none")]


def test_expectations(spark):
    check = lambda v, e: one(spark, T.expectation_met(F.col("v"), F.col("e")), v=float(v), e=e)
    assert [check(0, "= 0"), check(5, "> 5"), check(5, ">= 5"), check(1, "~= 5"), check(2.5, "< 3")] == [True, False, True, None, True]
    assert [one(spark, T.format_result(F.col("v")), v=x) for x in (3.0, 2.5)] == ["3", "2.50"]


def test_vectors(spark):
    a, b = F.col("a"), F.col("b")
    assert [round(one(spark, cosine(a, b), a=x, b=y), 9) for x, y in (([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]))] == [1, 0, -1, 0]
    assert one(spark, euclidean(a, b), a=[0.0, 3.0], b=[4.0, 0.0]) == 5
    assert one(spark, l2_normalise(a), a=[3.0, 4.0]) == [0.6, 0.8]
    assert one(spark, mean_pool(F.array(a, b)), a=[1.0, 2.0], b=[3.0, 4.0]) == [2.0, 3.0]
    with pytest.raises(Exception, match="differ in length"):
        one(spark, cosine(a, b), a=[1.0], b=[1.0, 2.0])


WORDS = "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll".split()


def test_porter_and_bm25_against_an_embedded_engine(spark):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(a, tokenize='porter unicode61')")
    for w in WORDS:
        con.execute("insert into t values (?)", (w,))
    con.execute("create virtual table v using fts5vocab(t, 'instance')")
    engine = dict(con.execute("select doc, term from v"))
    assert {w: stem(w) for w in WORDS} == {w: engine[i + 1] for i, w in enumerate(WORDS)}

    texts = ["The quick index searches indexes quickly", "Searching an índex", "nothing here", "index index index search", "long " * 40 + "searched", "search"]
    con.execute("create virtual table d using fts5(a, tokenize='porter unicode61')")
    for i, t in enumerate(texts):
        con.execute("insert into d(rowid, a) values (?, ?)", (i, t))
    want = {i: round(-s, 6) for i, s in con.execute("select rowid, bm25(d) from d where d match 'searching OR index'")}
    idx = fts.index(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "doc_id", "text", folded=True)
    q = spark.createDataFrame([("q", "searching OR index")], "query_id string, query string")
    got = {r["doc_id"]: r["score"] for r in fts.bm25(idx, fts.stemmed_terms(idx, fts.query_terms(q, folded=True)), 10).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], abs_tol=2e-6) for i in want)


def test_phrases_and_snippets(spark):
    df = spark.createDataFrame([(1, "a b a b"), (2, "a  B, c"), (3, "ab"), (4, None)], "doc_id bigint, text string")
    assert {r["doc_id"]: r["n"] for r in fts.phrase_matches(fts.index(df, "doc_id", "text"), "A b").collect()} == {1: 2, 2: 1}
    s = spark.createDataFrame([("x " * 20 + "the cat sat " + "y " * 20,), (None,)], "t string").select(fts.snippet(F.col("t"), ["cat"], 5).alias("s")).collect()
    assert ">>>cat<<<" in s[0]["s"] and s[0]["s"].endswith("...") and s[1]["s"] == ""


def test_secrets(spark):
    token = "ghp_" + "a1" * 20
    text = f"first\nkey {token} and {token}\n-----BEGIN RSA PRIVATE KEY-----\nurl https://me:longpassword@host/x\npassword = 'hunter2hunter2'\n"
    df = spark.createDataFrame([(1, text, "a.md"), (2, text, "Cargo.lock"), (3, None, None), (4, "", "x")], "id bigint, t string, p string")
    got = sorted((r["doc_id"], r["line"], r["pattern"], r["severity"], r["column"]) for r in scanning.scan_secrets(df, "id", "t", "p").collect())
    assert got == [(1, 2, "github_token", "high", 5), (1, 3, "private_key_pem", "high", 1), (1, 4, "url_credentials", "medium", 5), (1, 5, "generic_secret", "medium", 1)]
