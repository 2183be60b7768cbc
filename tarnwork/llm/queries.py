"""Queries of the problems of training data, and SQL for those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm import chunking, cooccur, leakage, mixture, spans
from tarnwork.plans.shaping import checkpoint, table, written

LIMIT, OVERLAP = 2000, 200
MOST_FILES, LEAST_COUNT, LEAST_LIFT = 50, 5, 20.0


def _long_texts(spark: SparkSession, d: str) -> DataFrame:
    issues = table(spark, d, "forge_issues").select(F.lit("forge_issues").alias("tbl"), F.col("number").cast("string").alias("record_id"), F.col("body").alias("text"))
    # a decoded text is no longer than its payload, so shorter payloads need no parsing
    log = table(spark, d, "eventlog").where(F.length("data") > LIMIT)
    texts = log.select(F.lit("eventlog").alias("tbl"), F.col("seq").cast("string").alias("record_id"), chunking.payload_text("data").alias("text"))
    return issues.unionByName(texts).where(F.length("text") > LIMIT)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return chunking.text_needs(_long_texts(spark, d), LIMIT).distinct()


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_texts(_long_texts(spark, d), LIMIT, OVERLAP).distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    told = table(spark, d, "co_changes").where("file_a is not null and file_b is not null and file_a != file_b")
    members, items, hashed = cooccur.encode_items(table(spark, d, "commit_files"), "sha", "file_path", told.select(F.explode(F.array("file_a", "file_b")).alias("name")))
    kept = written(cooccur.with_sizes(members).where(F.col("size") <= MOST_FILES))
    n = cooccur.basket_count(kept)
    x, y = hashed(F.col("file_a")), hashed(F.col("file_b"))
    stored = told.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.lit(0).cast("bigint").alias("c"), F.coalesce("count", F.lit(0)).alias("stored"))
    made = cooccur.pair_counts(cooccur.basket_pairs(kept)).withColumn("stored", F.lit(0).cast("bigint"))
    both = written(made.unionByName(stored).groupBy("a", "b").agg(F.sum("c").alias("c"), F.sum("stored").alias("stored")).where((F.col("c") >= LEAST_COUNT) | (F.col("c") != F.col("stored"))))
    strong = _lifted(kept, both.where(F.col("c") >= LEAST_COUNT), n).where(F.col("c") * F.lit(n) >= F.lit(LEAST_LIFT) * F.col("na") * F.col("nb")).select(F.lit("strong").alias("kind"), "a", "b")
    drift = both.where("c != stored").select(F.lit("drift").alias("kind"), "a", "b")
    return cooccur.named(strong.unionByName(drift), items).select("kind", "file_a", "file_b")


def _lifted(members: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    support = written(members.groupBy("id").agg(F.count(F.lit(1)).alias("support")))
    return cooccur.with_lift(pairs, support, n)


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of files with 5 common commits or more over all commits, however large, and their lift."""
    members, items, _ = cooccur.encode_items(table(spark, d, "commit_files"), "sha", "file_path")
    sized = written(cooccur.with_sizes(members))
    n = cooccur.basket_count(sized)
    pairs = written(cooccur.pair_counts(cooccur.basket_pairs(sized)).where(F.col("c") >= LEAST_COUNT))
    return cooccur.named(_lifted(sized, pairs, n), items).select("file_a", "file_b", F.col("c").alias("n_common"), F.round("lift", 6).alias("lift"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Documents that lost a passage, with their remaining text."""
    return leakage.remove_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).where("removed > 0").distinct()


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = mixture.sized_documents(table(spark, d, "documents"))
    return sized, mixture.plan(sized, checkpoint(mixture.source_budgets(sized, table(spark, d, "mix_targets"))))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    _, planned = _mixture(spark, d)
    return planned.where("short").select(F.col("target").alias("source")).distinct()


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share every source reaches in the mixture."""
    return mixture.reached(*_mixture(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.expand_pairs(*spans.shared_pairs(table(spark, d, "documents")))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each document of 300 characters or more with its class of exact copies, and how many other
    classes it shares a stretch with."""
    return spans.class_links(*spans.shared_pairs(table(spark, d, "documents")))


def p9_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document is found elsewhere too."""
    return spans.coverage(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_pieces, p4_found, p4_pairs, p7_found, p7_cleaned, p8_found, p8_shares, p9_found, p9_classes, p9_coverage)}

#: Every stretch of 300 characters of every document.
_GRAMS = """d as (select distinct doc_id, text from documents where doc_id is not null and text is not null),
             g as (select doc_id, i as start, md5(substr(text, i, 300)) as h from (select doc_id, text, unnest(range(1, length(text) - 298)) as i from d where length(text) >= 300))"""
_LONG_TEXTS = """e as (select seq, case when json_valid(data) then data end as j from eventlog),
             t as (select distinct 'forge_issues' as tbl, number::varchar as record_id, body as text from forge_issues where number is not null
                   union select 'eventlog', seq::varchar, coalesce(json_extract_string(j, '$.content'), json_extract_string(j, '$.body')) from e where seq is not null),
             l as (select * from t where length(text) > 2000)"""
# sentence ends become line ends of their own, as the dialect has no look-behind
_STRETCHES = """list_max(list_transform(string_split_regex({0}, '{1}'), lambda x: length(x))) <= 2000"""
_SENTENCES = r"regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '([。！？])', '\1' || chr(10), 'g')"
_CJK = r"regexp_replace(text, '([。！？])', '\1' || chr(10), 'g')"

_WIDE = "".join(chr(c) for a, z in ((0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)) for c in range(a, z + 1))
_PLAIN = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE)
#: Words, as far as the tables go: of entities &nbsp; alone, of compatibility forms the full-width ones.
_WORDS = f"regexp_extract_all(replace(lower(translate(regexp_replace(nfc_normalize(replace({{0}}, '&nbsp;', ' ')), '[\\x{{{{ad}}}}\\x{{{{200b}}}}-\\x{{{{200f}}}}\\x{{{{2060}}}}-\\x{{{{2064}}}}\\x{{{{feff}}}}]', '', 'g'), '{_WIDE}', '{_PLAIN}')), 'ß', 'ss'), '[\\p{{{{L}}}}\\p{{{{N}}}}]+')"
_SOURCE = r"lower(regexp_replace(source, '^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$', '', 'g'))"

SQL = {
    "p3_found": rf"""
        with {_LONG_TEXTS}
        select tbl, record_id, case when {_STRETCHES.format('text', r'\r?\n(?:[ \t\r\f\v]*\n)+')} then 'paragraph' when {_STRETCHES.format('text', r'\r?\n')} then 'line'
               when {_STRETCHES.format(_SENTENCES, r'\r?\n')} then 'sentence' when {_STRETCHES.format(_CJK, r'\s+')} then 'word' else 'none' end as need from l""",
    "p7_found": f"""
        with i as (select distinct item_id, {_WORDS.format('text')} as w from eval_items where item_id is not null and text is not null), d as (select distinct doc_id, {_WORDS.format('text')} as w from documents where doc_id is not null and text is not null),
             s as (select item_id, w, least(len(w), 13) as k from i where len(w) > 0), k as (select distinct k from s),
             a as (select distinct item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda x: array_to_string(w[x:x + k - 1], ' '))) as g from s),
             b as (select distinct doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda x: array_to_string(w[x:x + k - 1], ' '))) as g from d, k where len(w) >= k)
        select distinct doc_id, item_id from a join b using (k, g)""",
    "p8_found": f"""
        with d as (select doc_id, max({_SOURCE}) as source, max(len(regexp_extract_all(coalesce(text, ''), '\\p{{L}}+|\\p{{N}}+|[^\\s\\p{{L}}\\p{{N}}]'))) as tokens from documents where doc_id is not null group by 1), a as (select source, sum(tokens) as tokens from d where source <> '' group by 1),
             t as (select distinct target, source, max(target_share) over (partition by source) as share, greatest(coalesce(max(max_repeats) over (partition by source), 0), 0) as most from (select source as target, nullif({_SOURCE}, '') as source, target_share, max_repeats from mix_targets))
        select distinct target as source from t left join a on a.source = t.source where coalesce(tokens, 0) * most < share * (select sum(tokens) from d) * 0.5""",
    "p9_found": f"""
        with {_GRAMS}, s as (select h from g group by h having min(doc_id) <> max(doc_id)), k as (select distinct doc_id, h from g join s using (h))
        select distinct a.doc_id as doc_a, b.doc_id as doc_b from k a join k b on a.h = b.h and a.doc_id < b.doc_id""",
    "p9_classes": f"""
        with {_GRAMS}, m as (select distinct doc_id, text from d where length(text) >= 300), r as (select text, min(doc_id) as rep, count(*) as copies from m group by 1),
             s as (select h from g group by h having min(doc_id) <> max(doc_id)), k as (select distinct rep, h from g join s using (h) join r on g.doc_id = r.rep),
             p as (select distinct a.rep as a, b.rep as b from k a join k b on a.h = b.h and a.rep <> b.rep), l as (select a as rep, count(*) as links from p group by 1)
        select doc_id, rep, copies, coalesce(links, 0) as links from m join r using (text) left join l using (rep)""",
    "p9_coverage": f"""
        with {_GRAMS}, s as (select h from g group by h having min(doc_id) <> max(doc_id)), k as (select distinct doc_id, start from g join s using (h)),
             f as (select doc_id, least(300, start - coalesce(lag(start) over (partition by doc_id order by start), -300)) as fresh from k), c as (select doc_id, sum(fresh)::bigint as part from f group by 1),
             n as (select text, count(*) as copies from d where length(text) >= 300 group by 1),
             r as (select doc_id, length(text) as n_chars, coalesce(part, 0)::bigint as shared_chars, coalesce(copies, 1) as copies from d left join c using (doc_id) left join n using (text))
        select doc_id, n_chars, shared_chars, round(case when n_chars = 0 then 0 else shared_chars / n_chars end, 6) as share, copies from r""",
    "p4_pairs": """
        with cf as (select distinct sha, file_path from commit_files where sha is not null and file_path is not null), n as (select count(distinct sha) as n from cf), sup as (select file_path, count(*) as s from cf group by 1),
             p as (select a.file_path as file_a, b.file_path as file_b, count(*) as c from cf a join cf b on a.sha = b.sha and a.file_path < b.file_path group by 1, 2 having count(*) >= 5)
        select p.file_a, p.file_b, c as n_common, round(c * n / (x.s * y.s), 6) as lift from p join sup x on x.file_path = p.file_a join sup y on y.file_path = p.file_b, n""",
    "p4_found": """
        with cf as (select distinct sha, file_path from commit_files where sha is not null and file_path is not null),
             keep as (select sha from cf group by sha having count(*) <= 50),
             k as (select cf.* from cf join keep using (sha)),
             n as (select count(*) as n from keep),
             sup as (select file_path, count(*) as s from k group by 1),
             pairs as (select a.file_path as file_a, b.file_path as file_b, count(*) as c from k a join k b on a.sha = b.sha and a.file_path < b.file_path group by 1, 2),
             stored as (select least(file_a, file_b) as file_a, greatest(file_a, file_b) as file_b, sum(coalesce("count", 0)) as s
                        from co_changes where file_a is not null and file_b is not null and file_a <> file_b group by 1, 2)
        select 'strong' as kind, p.file_a, p.file_b from pairs p join sup x on x.file_path = p.file_a join sup y on y.file_path = p.file_b, n
        where p.c >= 5 and p.c * n.n >= 20 * x.s * y.s
        union all
        select 'drift', coalesce(p.file_a, s.file_a), coalesce(p.file_b, s.file_b)
        from pairs p full join stored s on p.file_a = s.file_a and p.file_b = s.file_b
        where coalesce(p.c, 0) <> coalesce(s.s, 0)""",
}
