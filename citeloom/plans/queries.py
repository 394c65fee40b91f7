"""Queries over the test tables, one or more for each family of operators, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import budget as B
from ..functions import canonical as C_
from ..functions import text as T
from ..functions import vector as V
from ..operators import changes as C
from ..operators import evidence as E
from ..operators import ordered as O
from ..operators import spans as S
from ..operators import trees as R
from ..sources.scratch import spread
from ..sources.store import search_documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"there is a query {f.__name__} already")
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


ASK = "the worthless thand, deductible limit"
TERMS = "['the', 'worthless', 'thand,', 'deductible', 'limit']"
RELEVANCE = f"len(list_filter({TERMS}, lambda t: contains(lower(text), t))) / 5.0"


@query(f"""WITH w AS (SELECT doc_id, unnest(range(0, ((length(text) + 3999) // 4000)::BIGINT)) AS idx, text AS x FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id || ':window:' || idx AS span_id, doc_id, substr(x, (idx * 4000 + 1)::BIGINT, 4000) AS text FROM w),
r AS (SELECT span_id, doc_id, ({RELEVANCE})::DOUBLE AS relevance FROM s)
SELECT span_id, doc_id, round(relevance, 6) AS relevance, row_number() OVER (ORDER BY relevance DESC, span_id) AS rank FROM r WHERE relevance > 0 ORDER BY relevance DESC, span_id LIMIT 10""")
def lexical_topk(spark, sf):
    """Which spans answer a question best, by the share of its terms they hold."""
    spans = S.windows(_t(spark, sf, "documents"), "doc_id", "text").withColumn("span_id", F.concat_ws(":", "doc_id", F.lit("window"), "idx"))
    scored = spans.select("span_id", "doc_id", T.lexical_relevance(F.col("text"), T.tokens(F.lit(ASK))).alias("relevance")).where("relevance > 0")
    return O.top_k(scored, None, [F.desc("relevance"), F.col("span_id")], 10).withColumn("relevance", F.round("relevance", 6))


@query("SELECT doc_id, unnest(range(0, (CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil((length(text) - 1000) / 900.0) + 1) END)::BIGINT)) AS idx, substr(text, (idx * 900 + 1)::BIGINT, 1000) AS text, (idx * 900)::BIGINT AS start FROM documents WHERE text IS NOT NULL")
def text_windows(spark, sf):
    return S.windows(_t(spark, sf, "documents"), "doc_id", "text", 1000, 100)


COS = "list_dot_product(a.v, q.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(q.v, q.v)))"
VEC = "WITH a AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, a.vec_id, a.label, " + COS + " AS score FROM a JOIN a q ON a.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)"


def _searches(spark, sf, k, by=None):
    """The query set, every row whose id is divisible by 100, against all other rows."""
    rows = _t(spark, sf, "embeddings")
    return V.nearest(rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", k, by)


@query(VEC + " SELECT * FROM (SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10")
def vector_topk(spark, sf):
    return O.top_k(_searches(spark, sf, 10).drop("label"), "query_id", [F.desc("score"), F.col("vec_id")], 10).withColumn("score", F.round("score", 6))


@query(VEC + " SELECT * FROM (SELECT query_id, vec_id, label, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 3")
def vector_topk_per_label(spark, sf):
    rows = _searches(spark, sf, 3, "label").withColumn("_g", F.struct("query_id", "label"))
    return O.top_k(rows, "_g", [F.desc("score"), F.col("vec_id")], 3).drop("_g").withColumn("score", F.round("score", 6))


@query("SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE b <= 3")
def history_last_n(spark, sf):
    return O.last_n(_t(spark, sf, "conversations"), "conv_id", "turn", 3)


@query(f"SELECT * FROM (SELECT conv_id, turn, round(rel, 6) AS relevance, row_number() OVER (PARTITION BY conv_id ORDER BY rel DESC, turn) AS rank FROM (SELECT *, ({RELEVANCE})::DOUBLE AS rel FROM conversations) WHERE rel > 0) WHERE rank <= 2")
def history_search(spark, sf):
    scored = _t(spark, sf, "conversations").select("conv_id", "turn", T.lexical_relevance(F.col("text"), T.tokens(F.lit(ASK))).alias("relevance")).where("relevance > 0")
    return O.top_k(scored, "conv_id", [F.desc("relevance"), F.col("turn")], 2).withColumn("relevance", F.round("relevance", 6))


@query(f"""WITH c AS (SELECT 'chunk' AS source, doc_id::VARCHAR AS id, 0.8::DOUBLE AS relevance FROM documents WHERE {RELEVANCE} >= 0.6),
d AS (SELECT 'document', doc_id::VARCHAR, 0.9::DOUBLE FROM documents WHERE source = 'src3'),
t AS (SELECT 'conversation', conv_id || ':' || turn, 0.6::DOUBLE FROM conversations WHERE {RELEVANCE} >= 0.4 ORDER BY conv_id, turn LIMIT 5),
b AS (SELECT 'attachment', item_id::VARCHAR, 0.95::DOUBLE FROM benchmark),
u AS (SELECT * FROM c UNION ALL SELECT * FROM d UNION ALL SELECT * FROM t UNION ALL SELECT * FROM b)
SELECT source, id, relevance, row_number() OVER (ORDER BY relevance DESC, source || '|' || id) AS rank FROM u ORDER BY rank LIMIT 20""")
def evidence_union_topk(spark, sf):
    docs, rel = _t(spark, sf, "documents"), T.lexical_relevance(F.col("text"), T.tokens(F.lit(ASK)))
    made = lambda df, source, key, score: df.select(F.lit(source).alias("source"), key.cast("string").alias("id"), F.lit(score).alias("relevance"))
    rows = made(docs.where(rel >= 0.6), "chunk", F.col("doc_id"), 0.8)
    rows = rows.unionByName(made(docs.where("source = 'src3'"), "document", F.col("doc_id"), 0.9))
    turns = _t(spark, sf, "conversations").where(rel >= 0.4).orderBy("conv_id", "turn").limit(5)
    rows = rows.unionByName(made(turns, "conversation", F.concat_ws(":", "conv_id", "turn"), 0.6))
    rows = rows.unionByName(made(_t(spark, sf, "benchmark"), "attachment", F.col("item_id"), 0.95))
    return O.top_k(rows, None, [F.desc("relevance"), E.order_key(["source", "id"])], 20)


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS x, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS pos FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, sum(regexp_matches(trim(x), '^[^ ]+( [^ ]+){0,3}[.]$')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM l),
g AS (SELECT doc_id, section, arg_min(x, pos) AS title, count(*) AS n_lines, trim(regexp_replace(string_agg(x, chr(10) ORDER BY pos), '[\t\n\x0B\f\r ]+', ' ', 'g')) AS text FROM s WHERE section > 0 GROUP BY ALL)
SELECT doc_id, section::INT AS section, substr(trim(regexp_replace(title, '[\t\n\x0B\f\r ]+', ' ', 'g')), 1, 120) AS title, n_lines::INT AS n_lines, text, nullif(regexp_extract(text, '\b[A-Z]{2,8}\s+\d{2,5}(?:\s+\d{2,4})?\b'), '') AS form_number FROM g WHERE length(text) >= 120""")
def section_split(spark, sf):
    return S.sections(_t(spark, sf, "documents"), "doc_id", "text", r"^[^ ]+( [^ ]+){0,3}[.]\z")


@query("SELECT min(doc_id) AS doc_id, source, md5(text) AS h FROM documents GROUP BY source, md5(text)")
def span_dedup_first_wins(spark, sf):
    return S.first_wins(_t(spark, sf, "documents").select("doc_id", "source", F.md5("text").alias("h")), ["source", "h"], "doc_id")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max((ts, event_id)).event_id AS event_id FROM (SELECT *, struct_pack(ts := ts, event_id := event_id) AS x FROM events) GROUP BY user_id".replace("max((ts, event_id)).event_id", "arg_max(event_id, (ts, event_id))"))
def upsert_last_wins(spark, sf):
    rows = _t(spark, sf, "events").select("user_id", "event_type", "event_id", F.struct("ts", "event_id").alias("at"))
    return S.last_wins(rows, ["user_id"], "at").drop("at")


CLEAN = r"trim(regexp_replace({}, '[\t\n\x0B\f\r ]+', ' ', 'g'))"
STRIP = CLEAN.format(r"regexp_replace(c, '(?i)\bPage\s+\d+\s+of\s+\d+\b', ' ', 'g')")
LINES = rf"""x AS (SELECT doc_id || ':' || pos AS id, CASE WHEN pos > 1 THEN doc_id || ':1' END AS parent_id, doc_id, pos, {CLEAN.format("x")} AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'Page 1 of 3' || chr(10) || text WHEN doc_id % 10 = 1 THEN text || chr(10) || 'AB-CD 12 34' WHEN doc_id % 10 = 2 THEN 'see page 4 of 5 there' || chr(10) || text WHEN doc_id % 10 = 3 THEN text || chr(10) || 'This is a claims-made and reported policy. Please read it carefully' ELSE text END AS text FROM documents))),
l AS (SELECT id, parent_id, doc_id, pos, CASE WHEN regexp_matches(c, '(?i)^(|Page\s+\d+\s+of\s+\d+|[A-Z]{{2,}}(-[A-Z0-9]{{2,}})+\s+\d\d\s+\d\d|this is a claims-made and reported policy\.? please read it carefully\.?)$') THEN NULL ELSE nullif({STRIP}, '') END AS text FROM x)"""


def _lines(spark, sf):
    k = F.col("doc_id") % 10
    marked = F.when(k == 0, F.concat(F.lit("Page 1 of 3\n"), "text")).when(k == 1, F.concat("text", F.lit("\nAB-CD 12 34"))).when(k == 2, F.concat(F.lit("see page 4 of 5 there\n"), "text"))
    marked = marked.when(k == 3, F.concat("text", F.lit("\nThis is a claims-made and reported policy. Please read it carefully"))).otherwise(F.col("text"))
    rows = _t(spark, sf, "documents").select("doc_id", F.posexplode(F.split(marked, "\n")).alias("pos", "text")).withColumn("pos", F.col("pos") + 1)
    return rows.select(F.concat_ws(":", "doc_id", "pos").alias("id"), F.when(F.col("pos") > 1, F.concat_ws(":", "doc_id", F.lit(1))).alias("parent_id"), "doc_id", "pos", "text")


@query(f"WITH {LINES} SELECT doc_id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM l WHERE text IS NOT NULL GROUP BY doc_id")
def boilerplate_drop(spark, sf):
    rows = _lines(spark, sf).select("doc_id", S.clean(F.col("text")).alias("text")).where("text IS NOT NULL")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"WITH {LINES} SELECT doc_id, count(*) AS n FROM l WHERE text IS NOT NULL AND NOT (parent_id IS NOT NULL AND parent_id IN (SELECT id FROM l WHERE text IS NULL)) GROUP BY doc_id")
def cascade_drop(spark, sf):
    return S.drop_boilerplate(_lines(spark, sf), "id", "parent_id", "pos", "text").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE d AS (SELECT source || ':' || (doc_id // 2000) AS grp, doc_id AS pos, length(text) AS n, row_number() OVER (PARTITION BY source || ':' || (doc_id // 2000) ORDER BY doc_id) AS k FROM documents),
p AS (SELECT grp, pos, k, 0 AS chunk, n AS size FROM d WHERE k = 1 UNION ALL SELECT d.grp, d.pos, d.k, CASE WHEN p.size + d.n + 2 <= 6000 THEN p.chunk ELSE p.chunk + 1 END, CASE WHEN p.size + d.n + 2 <= 6000 THEN p.size + d.n + 2 ELSE d.n END FROM p JOIN d ON d.grp = p.grp AND d.k = p.k + 1)
SELECT grp, pos, chunk FROM p""")
def greedy_pack(spark, sf):
    rows = _t(spark, sf, "documents").select(F.concat_ws(":", "source", F.floor(F.col("doc_id") / 2000)).alias("grp"), "doc_id", F.length("text").alias("n"))
    return S.pack(rows, "grp", "doc_id", "n").select("grp", "pos", "chunk")


@query("""WITH k AS (SELECT source, doc_id, 'lang' AS key, lang AS value FROM documents UNION ALL SELECT source, doc_id, 'size', n_chars::VARCHAR FROM documents)
SELECT source, key, string_agg(value, ',' ORDER BY doc_id) AS value FROM k WHERE value IS NOT NULL GROUP BY ALL UNION ALL SELECT source, 'form', arg_max(lang, doc_id) FROM documents WHERE doc_id % 3 = 0 GROUP BY source""")
def metadata_merge(spark, sf):
    docs = _t(spark, sf, "documents")
    rows = docs.select("source", "doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("form"), F.create_map(F.lit("lang"), F.col("lang"), F.lit("size"), F.col("n_chars").cast("string")).alias("m"))
    return S.merge_metadata(rows, "source", "doc_id", "m", {"form": "form"})


@query(r"""WITH l AS (SELECT conv_id, turn, text AS t FROM (SELECT conv_id, turn, trim(regexp_replace(text, '[\t\n\x0B\f\r ]+', ' ', 'g')) AS text FROM conversations) WHERE text <> ''),
n AS (SELECT *, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM l),
f AS (SELECT *, (p IS NOT NULL AND NOT regexp_matches(p, '[:.;!?)]$') AND NOT regexp_matches(t, '^([A-Z][A-Z0-9 &/(),.-]{8,}|Item\s+\d+|Section\s+\d+|Part\s+[A-Z]\b)') AND (regexp_matches(t, '^[a-z(]') OR regexp_matches(p, '(?i)(^|[^A-Za-z0-9_])(a|an|and|any|as|at|by|for|from|in|into|may|must|of|or|that|the|this|to|with|within|you|your)$')))  AS j FROM n),
r AS (SELECT *, sum((NOT j)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM f)
SELECT conv_id, run::BIGINT AS run, count(*)::INT AS n_spans, string_agg(t, ' ' ORDER BY turn) AS text FROM r GROUP BY conv_id, run""")
def text_run_merge(spark, sf):
    rows = _t(spark, sf, "conversations").withColumn("page", F.lit(1))
    return S.merge_runs(rows, "conv_id", "turn", "page", "text")


def _tree(spark, sf):
    region = _t(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_regionkey").cast("long").alias("ord"))
    nation = _t(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.col("n_nationkey").cast("long"))
    customer = _t(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), F.col("c_custkey"))
    return region.union(nation).union(customer)


TREE = "n AS (SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent_id, r_regionkey::BIGINT AS ord FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey FROM customer)"


@query(f"WITH RECURSIVE {TREE}, k AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY ord, id)::VARCHAR AS place FROM n), p AS (SELECT id, place AS path FROM k WHERE parent_id IS NULL UNION ALL SELECT k.id, p.path || '.' || k.place FROM k JOIN p ON k.parent_id = p.id) SELECT id, path FROM p")
def tree_paths(spark, sf):
    return R.paths(_tree(spark, sf))


@query(f"WITH RECURSIVE {TREE}, a AS (SELECT id FROM n WHERE id IN ('c5', 'c77', 'n3') UNION SELECT n.parent_id FROM a JOIN n ON n.id = a.id WHERE n.parent_id IS NOT NULL) SELECT id FROM a")
def ancestor_closure(spark, sf):
    nodes = _tree(spark, sf)
    return R.ancestors(nodes, nodes.where(F.col("id").isin("c5", "c77", "n3")))


@query(f"WITH {TREE} SELECT parent_id AS id, count(*) AS n, min(ord) AS first, max(ord) AS last FROM n WHERE parent_id IS NOT NULL GROUP BY parent_id")
def tree_rollup(spark, sf):
    return R.rollup_once(_tree(spark, sf), {"n": F.count("*"), "first": F.min("ord"), "last": F.max("ord")})


INTERVALS = "i AS (SELECT user_id, floor(epoch(ts))::BIGINT // 3600 AS a, floor(epoch(ts))::BIGINT // 3600 + event_id % 5 AS b, event_id FROM events)"


def _intervals(spark, sf):
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    return _t(spark, sf, "events").select("user_id", hour.alias("a"), (hour + F.col("event_id") % 5).alias("b"), "event_id")


@query(f"WITH {INTERVALS}, m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM i), g AS (SELECT *, sum(CASE WHEN s IS NULL OR a > s + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, min(a) AS start, max(b) AS stop, count(*) AS n FROM g GROUP BY user_id, k")
def interval_coalesce(spark, sf):
    return O.coalesce_intervals(_intervals(spark, sf), "user_id", "a", "b")


@query("WITH p AS (SELECT DISTINCT user_id, (event_id % 40)::BIGINT AS page FROM events), k AS (SELECT *, page - row_number() OVER (PARTITION BY user_id ORDER BY page) AS k FROM p), r AS (SELECT user_id, k, min(page) AS a, max(page) AS b FROM k GROUP BY user_id, k) SELECT user_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS pages FROM r GROUP BY user_id")
def page_ranges(spark, sf):
    return O.page_ranges(_t(spark, sf, "events").select("user_id", (F.col("event_id") % 40).alias("page")), "user_id", "page")


@query(f"WITH {INTERVALS} SELECT x.user_id, x.event_id AS left_id, y.event_id AS right_id FROM i x JOIN i y ON x.user_id = y.user_id AND x.a <= y.b AND x.b >= y.a AND x.event_id < y.event_id")
def range_overlap_join(spark, sf):
    rows = _intervals(spark, sf)
    pairs = O.overlaps(rows, rows, "user_id", "a", "b", 24).where("event_id < r_event_id")
    return pairs.select("user_id", F.col("event_id").alias("left_id"), F.col("r_event_id").alias("right_id"))


@query("""WITH t AS (SELECT * FROM events WHERE event_type = (SELECT max(event_type) FROM events)), c AS (SELECT * FROM events WHERE event_type = (SELECT min(event_type) FROM events)),
j AS (SELECT t.event_id, c.event_id AS context_id, row_number() OVER (PARTITION BY t.event_id ORDER BY c.ts DESC, c.event_id DESC) AS place FROM t JOIN c ON t.user_id = c.user_id AND (c.ts < t.ts OR c.ts = t.ts AND c.event_id < t.event_id))
SELECT event_id, context_id, place FROM j WHERE place <= 2""")
def preceding_context(spark, sf):
    rows = _t(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    ends = rows.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    rows = rows.join(F.broadcast(ends), F.lit(True))  # one row
    found = O.preceding(rows, "user_id", ["ts", "event_id"], F.col("event_type") == F.col("lo"), F.col("event_type") == F.col("hi"), 2)
    return found.select("event_id", F.posexplode("context").alias("p", "c")).select("event_id", F.col("c.event_id").alias("context_id"), (F.col("p") + 1).alias("place"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), a AS (SELECT user_id, k FROM r WHERE value > 90) SELECT DISTINCT r.event_id FROM r JOIN a ON r.user_id = a.user_id AND abs(r.k - a.k) <= 2")
def neighbor_window(spark, sf):
    return O.neighbours(_t(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("value") > 90, 2).select("event_id")


@query("SELECT conv_id, turn, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS value FROM conversations QUALIFY role = 'user' AND lead(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'assistant'")
def label_value_adjacency(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = _t(spark, sf, "conversations").withColumn("value", F.lead("text").over(w)).withColumn("next", F.lead("role").over(w))
    return rows.where("role = 'user' AND next = 'assistant'").select("conv_id", "turn", "value")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS title_at FROM conversations")
def title_blocks(spark, sf):
    return O.title_blocks(_t(spark, sf, "conversations"), "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", "title_at")


@query(r"""WITH i AS (SELECT doc_id AS item_id, CASE WHEN doc_id % 5 = 4 THEN 'no such words' ELSE substr(text, 3, 30) END AS quote, CASE doc_id % 7 WHEN 5 THEN NULL WHEN 6 THEN -1 ELSE doc_id END AS source_id FROM documents),
n AS (SELECT item_id, i.source_id, s.doc_id, contains(lower(trim(regexp_replace(s.text, '[\t\n\x0B\f\r ]+', ' ', 'g'))), lower(trim(regexp_replace(quote, '[\t\n\x0B\f\r ]+', ' ', 'g')))) AS held FROM i LEFT JOIN documents s ON i.source_id = s.doc_id WHERE trim(quote) <> '')
SELECT item_id, code, 'blocking' AS severity FROM (SELECT item_id, CASE WHEN source_id IS NULL THEN 'missing_citation' WHEN doc_id IS NULL THEN 'unknown_source' WHEN NOT held THEN 'quote_not_found' END AS code FROM n) WHERE code IS NOT NULL""")
def quote_grounding(spark, sf):
    docs = _t(spark, sf, "documents")
    quote = F.when(F.col("doc_id") % 5 == 4, "no such words").otherwise(F.substring("text", 3, 30))
    source = F.when(F.col("doc_id") % 7 == 5, None).when(F.col("doc_id") % 7 == 6, -1).otherwise(F.col("doc_id"))
    items = docs.select(F.col("doc_id").alias("item_id"), quote.alias("quote"), source.alias("source_id"), F.lit(None).cast("string").alias("cited"))
    return E.quoted_issues(items, docs.select(F.col("doc_id").alias("id"), F.col("text").alias("body")))


SQUEEZE = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"


@query(r"""WITH v AS (SELECT event_id, event_id || ' of ' || user_id AS value, 'User ' || user_id || ', event ' || CASE WHEN event_id % 3 = 0 THEN event_id + 1 ELSE event_id END AS body FROM events),
t AS (SELECT *, list_filter(list_transform(regexp_extract_all(value, '\d[\d,./:%-]*'), lambda x: regexp_replace(regexp_replace(x, '^0+([0-9])', '\1'), '[^0-9A-Za-z]', '', 'g')), lambda x: length(x) >= 2) AS n, list_filter(regexp_extract_all(value, '\b[A-Za-z0-9-]{5,}\b'), lambda x: regexp_matches(x, '[0-9]')) AS i FROM v)
SELECT event_id, len(list_filter(list_concat(n, i), lambda x: NOT contains(regexp_replace(lower(body), '[^a-z0-9]+', '', 'g'), lower(x)))) = 0 AS grounded FROM t""")
def value_grounding(spark, sf):
    body = F.concat(F.lit("User "), "user_id", F.lit(", event "), F.when(F.col("event_id") % 3 == 0, F.col("event_id") + 1).otherwise(F.col("event_id")))
    return _t(spark, sf, "events").select("event_id", T.grounded(F.concat("event_id", F.lit(" of "), "user_id"), body).alias("grounded"))


@query("SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def citation_anti(spark, sf):
    return E.missing_citations(_t(spark, sf, "labels"), _t(spark, sf, "documents").where("lang = 'en'"), "doc_id").select("doc_id", "quality", "toxic")


@query("SELECT doc_id, quality, toxic FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def citation_semi(spark, sf):
    return _t(spark, sf, "labels").join(_t(spark, sf, "documents").where("lang = 'en'").select("doc_id"), "doc_id", "left_semi").select("doc_id", "quality", "toxic")


@query(r"""SELECT item_id, (regexp_matches(x, '[$€£]\s?\d|\b\d{1,3}(?:,\d{3})*(?:\.\d+)?\s?(?:%|percent|days?|months?|years?)\b') OR regexp_matches(x, '\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b') OR regexp_matches(lower(x), '\b(?:shall|must|required|subject to|excluded|exclusion|condition|endorsement|deductible|limit|premium|retention)\b')) AS claim
FROM (SELECT item_id, CASE item_id % 5 WHEN 0 THEN text || ' 30 days' WHEN 1 THEN text || ' $ 5' WHEN 2 THEN text || ' on 2024-01-02.' WHEN 3 THEN text || ' at 5% of it' ELSE text || ' at 5%o of it, 1 Premium' END AS x FROM benchmark)""")
def claim_detector(spark, sf):
    k = F.col("item_id") % 5
    x = F.concat("text", F.when(k == 0, " 30 days").when(k == 1, " $ 5").when(k == 2, " on 2024-01-02.").when(k == 3, " at 5% of it").otherwise(" at 5%o of it, 1 Premium"))
    return _t(spark, sf, "benchmark").select("item_id", T.states_claim(x).alias("claim"))


@query("SELECT o_custkey, len(v)::INT AS n_values, array_to_string(v, '|') AS signature FROM (SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS v FROM orders GROUP BY o_custkey) WHERE len(v) > 1")
def conflict_detect(spark, sf):
    return E.conflicts(_t(spark, sf, "orders"), "o_custkey", "o_orderstatus")


@query("SELECT l_orderkey, l_linenumber, l_returnflag, ruling FROM (SELECT *, first_value(l_returnflag) OVER w AS ruling, row_number() OVER w AS k FROM (SELECT * REPLACE (CASE WHEN l_suppkey % 3 = 0 THEN NULL WHEN l_suppkey % 3 = 1 THEN ' ' || l_returnflag ELSE l_returnflag END AS l_returnflag) FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber)) WHERE k > 1 AND trim(l_returnflag) <> '' AND trim(ruling) <> '' AND trim(l_returnflag) <> trim(ruling)")
def precedence_conflict(spark, sf):
    k = F.col("l_suppkey") % 3
    flag = F.when(k == 1, F.concat(F.lit(" "), "l_returnflag")).when(k == 2, F.col("l_returnflag"))
    rows = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", flag.alias("l_returnflag"), "l_extendedprice")
    return E.precedence_conflicts(rows, ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber")], "l_returnflag").drop("l_extendedprice")


@query("WITH s AS (SELECT source, lang, (CASE WHEN contains(lower(text), 'the') THEN 10 ELSE 0 END) + (CASE WHEN contains(lower(text), 'que') THEN 12 ELSE 0 END) - (CASE WHEN contains(lower(text), 'worthless') THEN 12 ELSE 0 END) AS s FROM documents), g AS (SELECT source, lang, sum(s)::BIGINT AS score FROM s WHERE s > 0 GROUP BY ALL HAVING sum(s) >= 18) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, lang) AS rank FROM g) WHERE rank <= 12")
def page_scores(spark, sf):
    return E.page_scores(_t(spark, sf, "documents"), "source", "lang", "text", [("(?i)the", 10), ("(?i)que", 12), ("(?i)worthless", -12)])


ISSUES = "i AS (SELECT source, CASE WHEN toxic = 1 THEN 'blocking' WHEN quality = 0 THEN 'warning' ELSE 'info' END AS severity FROM documents JOIN labels USING (doc_id))"


@query(f"WITH {ISSUES} SELECT source, count(*) FILTER (severity = 'blocking') AS n_blocking, count(*) FILTER (severity = 'warning') AS n_warning, count(*) FILTER (severity = 'info') AS n_info, CASE WHEN bool_or(severity = 'blocking') THEN 'failed' WHEN bool_or(severity = 'warning') THEN 'warning' ELSE 'passed' END AS status FROM i GROUP BY source")
def quality_gate(spark, sf):
    severity = F.when(F.col("toxic") == 1, "blocking").when(F.col("quality") == 0, "warning").otherwise("info")
    rows = _t(spark, sf, "documents").select("doc_id", "source").join(_t(spark, sf, "labels"), "doc_id")
    return E.gate(rows.withColumn("severity", severity), "source")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_name ILIKE '%00%'")
def doc_filters(spark, sf):
    rows = _t(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("kind"), F.col("c_name").alias("holder"), F.col("c_custkey").cast("string").alias("number"))
    return search_documents(rows, kind="BUILDING", holder="00").select("c_custkey")


@query("""WITH a AS (SELECT doc_id, toxic AS v FROM labels WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 1 - toxic ELSE toxic END AS v FROM labels WHERE doc_id % 4 <> 0)
SELECT CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'lost' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS verdict, count(*) AS n FROM a FULL JOIN b ON a.doc_id = b.doc_id GROUP BY 1""")
def regression_compare(spark, sf):
    rows = _t(spark, sf, "labels")
    a = rows.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("a"), F.col("toxic").alias("va"))
    b = rows.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("b"), F.when(F.col("doc_id") % 7 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("vb"))
    verdict = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "lost").when(F.col("va") == F.col("vb"), "same").otherwise("changed")
    return a.join(b, F.col("a") == F.col("b"), "full").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("SELECT s_nationkey, arg_min(s_suppkey, (-t, s_suppkey)) AS id, round(max(t), 6) AS total FROM (SELECT s_nationkey, s_suppkey, 3 * (s_suppkey % 2) + 2 * (CASE WHEN s_acctbal > 0 THEN 1 ELSE 0.4 END)::DOUBLE + 3 * 1 + 1 + (s_suppkey % 10) / 10.0::DOUBLE + 0.5::DOUBLE AS t FROM supplier) GROUP BY s_nationkey")
def best_proposal(spark, sf):
    rows = _t(spark, sf, "supplier").select("s_nationkey", F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 2).alias("grounding"), F.when(F.col("s_acctbal") > 0, 1.0).otherwise(0.4).alias("completeness"), F.lit(1).alias("consistency"), F.lit(1).alias("determinism"), ((F.col("s_suppkey") % 10) / 10.0).alias("risk"), F.lit(0.5).alias("cost"))
    return E.best_proposal(rows, "s_nationkey").withColumn("total", F.round("total", 6))


@query("SELECT event_id, len(json_keys(props))::INT AS n_keys FROM events")
def json_props(spark, sf):
    return _t(spark, sf, "events").select("event_id", F.size(F.json_object_keys("props")).alias("n_keys"))


HASH = "list_reduce(list_prepend({seed}::BIGINT, list_transform(string_split(x, ''), lambda c, i: {unit})), lambda h, u: ((xor(h, u) & 4294967295) * {factor}) % 4294967296)"


@query(f"""WITH p AS (SELECT p_partkey, '"' || p_name || '"' AS x FROM part)
SELECT p_partkey, lower(printf('%08x', {HASH.format(seed=0x811C9DC5, factor=0x01000193, unit="unicode(c)::BIGINT")})) || lower(printf('%08x', {HASH.format(seed=0x45D9F3B, factor=0x27D4EB2D, unit="(unicode(c) + i - 1)::BIGINT")})) AS hash FROM p""")
def stable_hash_bmp(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", T.stable_hash(T.json_string(F.col("p_name"))).alias("hash"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 14 BETWEEN 1 AND 12 AND o_orderkey % 33 BETWEEN 1 AND 31 AND o_orderkey % 7 <> 0 THEN epoch_ms(make_date(2024, (o_orderkey % 14)::INT, 1)::TIMESTAMP) + (o_orderkey % 33 - 1)::BIGINT * 86400000 END AS ms FROM orders")
def date_parse(spark, sf):
    k = F.col("o_orderkey")
    text = F.concat(F.when(k % 7 == 0, "on ").otherwise(""), F.concat_ws("/", k % 14, k % 33, F.when(k % 2 == 0, "24").otherwise("2024")))
    return _t(spark, sf, "orders").select("o_orderkey", T.us_date_millis(text).alias("ms"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice::DECIMAL(18,2)::DOUBLE AS amount FROM lineitem")
def amount_parse(spark, sf):
    text = F.concat(F.lit("limit $"), F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2), F.lit(" or 5%"))
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.amount(text).alias("amount"))


@query("SELECT doc_id, ceil(octet_length(encode(text)) / 4.0)::BIGINT AS tokens, least(ceil(octet_length(encode(text)) / 4.0)::BIGINT, 1000) AS budget FROM documents")
def token_budget(spark, sf):
    n = T.token_estimate(F.col("text"))
    return _t(spark, sf, "documents").select("doc_id", n.alias("tokens"), F.least(n, F.lit(1000)).alias("budget"))


@query("WITH n AS (SELECT regexp_replace(lower(p_name || p_size), '[^a-z0-9]+', '', 'g') AS norm, p_brand FROM part), g AS (SELECT norm, min(p_brand) AS code, count(DISTINCT p_brand) AS k FROM n GROUP BY norm) SELECT norm, code FROM g WHERE k = 1")
def code_by_description(spark, sf):
    return E.unique_codes(_t(spark, sf, "part").withColumn("description", F.concat("p_name", "p_size")), "p_brand", "description")


@query("""WITH i AS (SELECT l_orderkey AS grp, l_linenumber AS idx, l_returnflag AS value FROM lineitem), d AS (SELECT l_orderkey AS grp, l_linenumber AS idx, arg_max(CASE l_linestatus WHEN 'O' THEN 'drop' ELSE 'update' END, (l_suppkey, CASE l_linestatus WHEN 'O' THEN 'drop' ELSE 'update' END)) AS action FROM lineitem WHERE l_quantity > 40 GROUP BY 1, 2)
SELECT i.grp, i.idx, CASE WHEN action = 'update' THEN 'X' ELSE value END AS value FROM i LEFT JOIN d ON i.grp = d.grp AND i.idx = d.idx WHERE action IS DISTINCT FROM 'drop'""")
def cleanup_decisions(spark, sf):
    rows = _t(spark, sf, "lineitem")
    items = rows.select(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").alias("idx"), F.col("l_returnflag").alias("value"))
    decisions = rows.where("l_quantity > 40").select(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").alias("idx"), F.col("l_suppkey").alias("pos"), F.when(F.col("l_linestatus") == "O", "drop").otherwise("update").alias("action"), F.lit("X").alias("value"))
    return E.apply_decisions(items, decisions, "grp")


@query("""WITH b AS (SELECT doc_id, lang AS value FROM documents), c AS (SELECT doc_id, 'xx' AS v FROM labels WHERE quality = 1 AND doc_id % 2 = 0)
SELECT b.doc_id, coalesce(v, value) AS value, CASE WHEN v IS NULL THEN 'base' ELSE 'candidate' END AS origin FROM b LEFT JOIN c ON b.doc_id = c.doc_id""")
def profile_merge(spark, sf):
    docs, labels = _t(spark, sf, "documents"), _t(spark, sf, "labels")
    candidate = labels.where("quality = 1").select("doc_id", F.lit("xx").alias("value"), F.array(F.col("doc_id")).alias("ids"))
    return E.merge_facts(docs.select("doc_id", F.col("lang").alias("value")), candidate, docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id")), ["doc_id"])


@query("""WITH q AS (SELECT doc_id AS id, 'p' || doc_id AS path FROM documents), a AS (SELECT item_id AS pos, CASE WHEN item_id % 2 = 0 THEN (item_id * 3) % 60 END AS question_id, CASE WHEN item_id % 2 = 1 THEN 'p' || (item_id * 3) % 60 END AS field_path, CASE WHEN item_id % 5 = 0 THEN ' ' ELSE text END AS text FROM benchmark),
j AS (SELECT q.id, arg_min(a.text, a.pos) AS answer FROM q JOIN a ON a.question_id = q.id OR a.field_path = q.path GROUP BY q.id)
SELECT q.id, q.path, answer, CASE WHEN trim(coalesce(answer, '')) <> '' THEN 'answered' ELSE 'open' END AS status FROM q LEFT JOIN j ON q.id = j.id""")
def first_answers(spark, sf):
    questions = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("p"), "doc_id").alias("path"))
    k = F.col("item_id") * 3 % 60
    answers = _t(spark, sf, "benchmark").select(F.col("item_id").alias("pos"), F.when(F.col("item_id") % 2 == 0, k).alias("question_id"), F.when(F.col("item_id") % 2 == 1, F.concat(F.lit("p"), k)).alias("field_path"), F.when(F.col("item_id") % 5 == 0, " ").otherwise(F.col("text")).alias("text"))
    return E.first_answers(questions, answers)


@query("SELECT c_custkey AS id FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE CASE c_custkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN lower(n_name) = 'nation_3' WHEN 2 THEN lower(n_name) <> 'nation_3' ELSE lower(n_name) IN ('nation_1', 'nation_2') END")
def active_fields(spark, sf):
    k = F.col("c_custkey") % 4
    fields = _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(k != 0, F.col("c_nationkey")).alias("depends_on"), F.when(k == 1, "equals").when(k == 2, "not_equals").otherwise("in").alias("op"), F.when(k < 3, " Nation_3 ").otherwise("nation_1, nation_2").alias("expected"))
    return E.active_fields(fields, _t(spark, sf, "nation").select(F.col("n_nationkey").alias("field"), F.col("n_name").alias("value")))


@query("SELECT event_id, CASE WHEN k > 1 THEN event_type || ':' || k ELSE event_type END AS id FROM (SELECT event_id, event_type, user_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events)")
def duplicate_suffixes(spark, sf):
    rows = _t(spark, sf, "events").select("event_id", "event_type", F.concat_ws("|", "user_id", "event_type").alias("base"))
    return O.duplicate_suffixes(rows, "base", "event_id").select("event_id", F.substring_index(F.col("id"), "|", -1).alias("id"))


@query("WITH l AS (SELECT user_id, list(event_id ORDER BY event_id) AS v FROM events GROUP BY user_id) SELECT user_id, array_to_string(CASE WHEN len(v) <= 5 THEN v ELSE list_transform(range(0, 5), lambda i: v[(floor(i * (len(v) - 1) / 4.0 + 0.5) + 1)::BIGINT]) END, ',') AS sample FROM l")
def even_sample(spark, sf):
    rows = _t(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("v"))
    return rows.select("user_id", F.array_join(O.even_sample(F.col("v"), 5), ",").alias("sample"))


@query("SELECT role, count(*) AS calls, count(*) FILTER (text IS NOT NULL AND turn % 3 > 0) AS with_usage, count(*) FILTER (text IS NULL OR turn % 3 = 0) AS without_usage, coalesce(sum(ceil(octet_length(encode(text)) / 4.0)) FILTER (turn % 3 > 0), 0)::BIGINT AS input_tokens, coalesce(sum(turn) FILTER (text IS NOT NULL AND turn % 3 > 0), 0)::BIGINT AS output_tokens, sum(turn * 10)::BIGINT AS duration_ms FROM conversations GROUP BY role")
def usage_totals(spark, sf):
    told = F.col("text").isNotNull() & (F.col("turn") % 3 > 0)
    calls = _t(spark, sf, "conversations").select("role", F.when(told, T.token_estimate(F.col("text"))).alias("input_tokens"), F.when(told, F.col("turn")).alias("output_tokens"), (F.col("turn") * 10).alias("duration_ms"))
    return B.usage_totals(calls, "role")


@query(r"""WITH t AS (SELECT p_partkey, 'Preface' || chr(10) || CASE p_size % 3 WHEN 0 THEN 'SECTION ' WHEN 1 THEN 'Exclusions: ' ELSE 'Scheduled ' END || p_name || chr(13) || chr(10) || repeat(p_type || '  ', 12) || 'CG ' || (1000 + p_size) || chr(10) || ' endorsement ' || p_size || chr(10) || repeat('x ', 70) AS x, p_size % 3 AS k, * EXCLUDE (p_partkey) FROM part),
s AS (SELECT p_partkey, 1 AS section, CASE k WHEN 0 THEN 'SECTION ' ELSE 'Exclusions: ' END || p_name AS title, 2 AS n_lines, CASE k WHEN 0 THEN 'SECTION ' ELSE 'Exclusions: ' END || p_name || ' ' || repeat(p_type || ' ', 12) || 'CG ' || (1000 + p_size) AS text, 'CG ' || (1000 + p_size) AS form_number FROM t WHERE k < 2
UNION ALL SELECT p_partkey, CASE WHEN k < 2 THEN 2 ELSE 1 END, 'endorsement ' || p_size, 2, 'endorsement ' || p_size || ' ' || trim(repeat('x ', 70)), NULL FROM t)
SELECT p_partkey, section, title, n_lines, text, form_number FROM s WHERE length(text) >= 120""")
def headed_sections(spark, sf):
    """Sections by the words that head them, of pages made of parts."""
    z = F.col("p_size")
    head = F.when(z % 3 == 0, "SECTION ").when(z % 3 == 1, "Exclusions: ").otherwise("Scheduled ")
    text = F.concat(F.lit("Preface\n"), head, "p_name", F.lit("\r\n"), F.repeat(F.concat("p_type", F.lit("  ")), F.lit(12)), F.lit("CG "), z + 1000, F.lit("\n endorsement "), z, F.lit("\n"), F.repeat(F.lit("x "), F.lit(70)))
    parts = spread(_t(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size"), "p_partkey")
    return S.sections(parts.select("p_partkey", text.alias("text")), "p_partkey", "text")


@query("""SELECT event_id, regexp_replace('{"a":' || CASE WHEN event_id % 2 = 0 THEN 'null' ELSE event_id::VARCHAR END || ',"b":{"c":' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '"x\\":null,"' END || ',"d":[null,' || event_id || ']},"t":"' || event_type || '"}', '"[ac]":null,', '', 'g') AS json FROM events""")
def nulls_stripped(spark, sf):
    k = F.col("event_id")
    json = F.concat(F.lit('{"t":"'), "event_type", F.lit('", "a":'), F.when(k % 2 == 0, "null").otherwise(k.cast("string")), F.lit(', "b": {"d": [null, '), k, F.lit('], "c":'), F.when(k % 3 == 0, "null").otherwise('"x\\":null,"'), F.lit("}}"))
    return _t(spark, sf, "events").select("event_id", C_.without_nulls(json).alias("json"))


@query("SELECT doc_id, doc_id || ':span:' || regexp_replace(source || ' x', '[^a-zA-Z0-9_.:-]', '_', 'g') AS id FROM documents")
def span_ids(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.concat_ws(":", "doc_id", F.lit("span"), T.id_part(F.concat("source", F.lit(" x")))).alias("id"))


@query("SELECT c_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderdate) AS first FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus <> 'P' GROUP BY c_custkey")
def document_rollup(spark, sf):
    orders = _t(spark, sf, "orders").where("o_orderstatus <> 'P'").select("o_custkey", "o_totalprice", "o_orderdate")
    rows = orders.join(_t(spark, sf, "customer").select("c_custkey"), F.col("c_custkey") == F.col("o_custkey"))
    return rows.groupBy("c_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderdate").alias("first"))


CHANGES = """WITH i AS (SELECT o_custkey AS case_id, o_orderkey::VARCHAR AS item_id, CASE o_orderkey % 4 WHEN 0 THEN 'limit_change' WHEN 1 THEN 'cancellation' WHEN 2 THEN 'renewal_submission_update' ELSE 'certificate_endorsement_request' END AS kind FROM orders),
l AS (SELECT DISTINCT o_custkey AS case_id, l_orderkey::VARCHAR AS item_id, l_orderkey || ':' || l_linenumber AS id, CASE WHEN l_linenumber = 1 THEN l_returnflag ELSE l_linestatus END AS form FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
g AS (SELECT case_id, item_id, list_sort(list_distinct(list(form))) AS forms, count(DISTINCT id) AS n FROM l GROUP BY ALL),
m AS (SELECT i.*, coalesce(forms, []) AS forms, coalesce(n, 0) AS n FROM i LEFT JOIN g USING (case_id, item_id))"""


def _changes(spark, sf):
    """Orders as items of their customers' cases, their lines as sources that the items cite."""
    orders, lines = _t(spark, sf, "orders"), _t(spark, sf, "lineitem")
    source = F.concat_ws(":", "l_orderkey", "l_linenumber")
    cited = lines.groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(source).alias("source_ids"))
    kind = F.element_at(F.array(*map(F.lit, ("limit_change", "cancellation", "renewal_submission_update", "certificate_endorsement_request"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    null = F.lit(None).cast("string")
    items = orders.join(cited, F.col("o_orderkey") == F.col("k"), "left").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").cast("string").alias("item_id"), kind.alias("kind"), null.alias("before_value"), null.alias("requested_value"), null.alias("after_value"), F.lit(None).cast("array<string>").alias("source_span_ids"), "source_ids")
    named = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    sources = named.select(F.col("o_custkey").alias("case_id"), source.alias("source_id"), F.when(F.col("l_linenumber") == 1, F.col("l_returnflag")).alias("form_number"), F.col("l_linestatus").alias("label")).distinct()
    return C.impacts(items, sources)


@query(CHANGES + " SELECT case_id, item_id, kind, array_to_string(forms, ',') AS forms, n::BIGINT AS n_sources, kind <> 'renewal_submission_update' AS endorsement_required, kind <> 'certificate_endorsement_request' AS approval_required FROM m")
def change_impacts(spark, sf):
    return _changes(spark, sf).select("case_id", "item_id", "kind", F.array_join("forms", ",").alias("forms"), F.size("source_span_ids").cast("long").alias("n_sources"), "endorsement_required", "approval_required")


@query(CHANGES + """, f AS (SELECT case_id, bool_or(kind = 'cancellation') AS ending, bool_or(kind = 'limit_change' AND (len(forms) > 1 OR n > 1)) AS many FROM m GROUP BY case_id),
c AS (SELECT c_custkey AS case_id, CASE WHEN c_custkey % 3 = 0 THEN 'cancel if cheaper' ELSE 'please change' END AS said, c_acctbal < -500 AS conflicting FROM customer)
SELECT case_id, CASE WHEN conflicting OR (coalesce(ending, false) AND said = 'cancel if cheaper') THEN 'hybrid' WHEN coalesce(many, false) THEN 'market_eval' ELSE 'deterministic_tree' END AS mode FROM c LEFT JOIN f USING (case_id)""")
def change_execution_modes(spark, sf):
    said = F.when(F.col("c_custkey") % 3 == 0, "cancel if cheaper").otherwise("please change")
    no = F.lit(False)
    cases = _t(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"), F.lit("auto").alias("requested"), said.alias("request_text"), no.alias("blocking"), (F.col("c_acctbal") < -500).alias("conflicting"), no.alias("unclear"))
    return C.execution_modes(cases, _changes(spark, sf))


from . import change_cases as _change_cases, changes as _changes_, documents as _documents, profiles as _profiles, recovery as _recovery, retrieval as _retrieval, review as _review, source as _source  # noqa: E402, F401  (they register their queries here)
