"""Queries of the corpus engine over the driver's tables, with equivalent SQL.

The tables stand in for a corpus: a documents row is a record, a token between
blanks a word, a tag of pages.html an annotation, an order a record whose line items are its words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import aggregates as A
from .operators import ids, joins
from .operators import windows as W

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with SQL where there is some."""

    def put(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return put


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def long(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


WORDS = r"[^\x20\x09-\x0D]+"
_WORDS_SQL = r"""words AS (SELECT doc_id, i AS ordinal, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents)))"""


def words(documents: DataFrame) -> DataFrame:
    """doc_id, ordinal (from 1), word."""
    found = F.regexp_extract_all("text", F.lit(f"({WORDS})"), F.lit(1))
    return documents.select("doc_id", F.posexplode(found).alias("p", "word")).select("doc_id", long(F.col("p") + 1).alias("ordinal"), "word")


# Words and text

@query(f"""WITH {_WORDS_SQL}, d AS (SELECT doc_id, sum(n) OVER (ORDER BY doc_id) - n AS before FROM (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id))
SELECT doc_id, ordinal, word, CAST(before + ordinal AS BIGINT) AS slot FROM words JOIN d USING (doc_id)""")
def word_slots(spark, sf_dir):
    """Dense ids of all words in (document, ordinal) order."""
    w = words(load(spark, sf_dir, "documents", "doc_id", "text"))
    return ids.dense_ids(w, load(spark, sf_dir, "documents", "doc_id"), "doc_id", [F.col("doc_id")], "ordinal", "slot").select("doc_id", "ordinal", "word", long("slot").alias("slot"))


_TAGS_SQL = """t AS (SELECT page_id, regexp_extract_all(html, '<(/?)([A-Za-z_][A-Za-z0-9_.:-]*)([^>]*)>', 1) AS c, regexp_extract_all(html, '<(/?)([A-Za-z_][A-Za-z0-9_.:-]*)([^>]*)>', 2) AS n FROM pages),
tags AS (SELECT page_id, unnest(range(1, len(n) + 1)) AS i, unnest(c) = '/' AS closing, unnest(n) AS name FROM t)"""


def _tags(spark, sf_dir):
    from .sources.markup import tag_events

    pages = load(spark, sf_dir, "pages", "page_id", "html").select(F.col("page_id").cast("string").alias("source_record_id"), F.encode("html", "utf-8").alias("content"))
    return tag_events(pages).where("name IS NOT NULL").select(long("source_record_id").alias("page_id"), long("seq").alias("seq"), "closing", "name")


@query(f"WITH {_TAGS_SQL} SELECT page_id, CAST(i - 1 AS BIGINT) AS seq, closing, name FROM tags")
def tag_events(spark, sf_dir):
    return _tags(spark, sf_dir)


@query(f"""WITH {_TAGS_SQL}, lv AS (SELECT *, sum(CASE WHEN closing THEN -1 ELSE 1 END) OVER (PARTITION BY page_id, name ORDER BY i) + CASE WHEN closing THEN 1 ELSE 0 END AS depth FROM tags),
nx AS (SELECT *, lead(i) OVER w AS e, lead(closing) OVER w AS ec FROM lv WINDOW w AS (PARTITION BY page_id, name, depth ORDER BY i))
SELECT page_id, name, CAST(i - 1 AS BIGINT) AS seq, CAST(CASE WHEN ec THEN e - 1 END AS BIGINT) AS end_seq, CAST(depth AS BIGINT) AS depth FROM nx WHERE NOT closing""")
def tag_matching(spark, sf_dir):
    """Openings with their closings, each kind on a stack of its own."""
    run = Window.partitionBy("page_id", "name").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lv = _tags(spark, sf_dir).withColumn("depth", F.sum(F.when(F.col("closing"), -1).otherwise(1)).over(run) + F.when(F.col("closing"), 1).otherwise(0))
    follow = Window.partitionBy("page_id", "name", "depth").orderBy("seq")
    out = lv.withColumn("end", F.lead(F.struct("seq", "closing")).over(follow)).where(~F.col("closing"))
    return out.select("page_id", "name", "seq", F.when(F.col("end.closing"), F.col("end.seq")).alias("end_seq"), long("depth").alias("depth"))


@query(f"""WITH {_WORDS_SQL}, s AS (SELECT *, sum(CASE WHEN ordinal = 1 OR starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ordinal) AS sentence
  FROM (SELECT *, lag(word) OVER (PARTITION BY doc_id ORDER BY ordinal) LIKE '%.' AS starts FROM words))
SELECT doc_id, CAST(sentence AS BIGINT) AS sentence, CAST(min(ordinal) AS BIGINT) AS first_word, CAST(max(ordinal) AS BIGINT) AS last_word FROM s GROUP BY doc_id, sentence""")
def sentence_segments(spark, sf_dir):
    """Sentences: a word after one that ends in a full stop starts the next."""
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    starts = (F.col("ordinal") == 1) | F.lag("word").over(w).endswith(".")
    s = words(load(spark, sf_dir, "documents", "doc_id", "text")).withColumn("starts", starts)
    s = s.withColumn("sentence", long(F.sum(F.when(F.col("starts"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    return s.groupBy("doc_id", "sentence").agg(F.min("ordinal").alias("first_word"), F.max("ordinal").alias("last_word"))


@query(f"""WITH {_WORDS_SQL} SELECT doc_id, ordinal, CAST(coalesce(sum(length(word)) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM words""")
def char_offsets(spark, sf_dir):
    w = words(load(spark, sf_dir, "documents", "doc_id", "text"))
    return w.select("doc_id", "ordinal", long(W.running_length(F.col("word"), ["doc_id"], ["ordinal"])).alias("char_start"))


@query(f"WITH {_WORDS_SQL}, c AS (SELECT lower(word) AS word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM words GROUP BY 1) SELECT word, n, n_docs FROM c")
def word_census(spark, sf_dir):
    return words(load(spark, sf_dir, "documents", "doc_id", "text")).groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


# Order-bound operators

@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS last_purchase FROM events""")
def carry_forward(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select("event_id", W.carried(F.when(F.col("event_type") == "purchase", F.col("event_id")), F.lit(False), ["user_id"], ["event_id"]).alias("last_purchase"))


@query("""WITH m AS (SELECT *, max(CASE WHEN event_type = 'logout' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS reset_at,
  last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
SELECT event_id, CASE WHEN p > coalesce(reset_at, -1) THEN p END AS current_purchase FROM m""")
def carry_with_reset(spark, sf_dir):
    """A carried value that an outer marker blanks."""
    e = load(spark, sf_dir, "events")
    value = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return e.select("event_id", W.carried(value, F.col("event_type") == "logout", ["user_id"], ["event_id"]).alias("current_purchase"))


@query("SELECT user_id, event_type, event_id, lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS until FROM events")
def layout_segments(spark, sf_dir):
    return W.segments(load(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "until")


@query("""WITH d AS (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem), r AS (SELECT *, l_orderkey - row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS g FROM d)
SELECT l_partkey, min(l_orderkey) AS "start", max(l_orderkey) AS "end" FROM r GROUP BY l_partkey, g""")
def ranges(spark, sf_dir):
    return ids.ranges(load(spark, sf_dir, "lineitem", "l_partkey", "l_orderkey"), ["l_partkey"], "l_orderkey")


@query("SELECT l_suppkey, l_orderkey AS value, count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) GROUP BY ALL")
def range_expansion(spark, sf_dir):
    """Ranges and back: every value once."""
    r = ids.ranges(load(spark, sf_dir, "lineitem", "l_suppkey", "l_orderkey"), ["l_suppkey"], "l_orderkey")
    return ids.in_ranges(r, ["l_suppkey"]).groupBy("l_suppkey", "value").agg(F.count("*").alias("n"))


_RUNS_SQL = """c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM c)"""


@query(f"WITH {_RUNS_SQL} SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM r GROUP BY user_id, run")
def runs(spark, sf_dir):
    r = W.runs(load(spark, sf_dir, "events"), ["user_id"], ["event_id"], ["event_type"])
    return r.groupBy("user_id", long("run").alias("run")).agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


_STEP_SQL = """b AS (SELECT l_partkey, l_orderkey, l_linenumber, lag(l_orderkey) OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber) AS before FROM lineitem),
s AS (SELECT *, CASE WHEN l_orderkey IS NULL THEN 'invalid' WHEN before IS NULL THEN 'first' WHEN l_orderkey = before THEN 'duplicate' WHEN l_orderkey < before THEN 'decreasing' WHEN l_orderkey > before + 1 THEN 'gap' ELSE 'next' END AS step FROM b)"""


@query(f"WITH {_STEP_SQL} SELECT step, count(*) AS n, count(DISTINCT l_partkey) AS n_parts FROM s GROUP BY step")
def topology(spark, sf_dir):
    s = W.topology(load(spark, sf_dir, "lineitem"), ["l_partkey"], [F.desc("l_orderkey"), "l_linenumber"], "l_orderkey")
    return s.groupBy("step").agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("n_parts"))


@query("""WITH k AS (SELECT DISTINCT o_custkey, o_orderkey FROM orders), b AS (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM k),
m AS (SELECT o_custkey, unnest(generate_series(before + 1, o_orderkey - 1)) AS missing FROM b WHERE o_orderkey - before - 1 BETWEEN 1 AND 256)
SELECT o_custkey, count(*) AS n_missing, count(o.o_orderkey) AS n_present FROM m LEFT JOIN (SELECT DISTINCT o_orderkey FROM orders) o ON missing = o.o_orderkey GROUP BY o_custkey""")
def anomaly_missing(spark, sf_dir):
    """Numbers that gaps leave out, probed in an index."""
    orders = load(spark, sf_dir, "orders", "o_custkey", "o_orderkey")
    stepped = W.topology(orders.distinct(), ["o_custkey"], ["o_orderkey"], "o_orderkey")
    missing = W.missing_numbers(stepped, "o_orderkey").select("o_custkey", F.col("missing").alias("o_orderkey"))
    found = joins.lookup(missing, orders.select("o_orderkey").distinct(), ["o_orderkey"])
    return found.groupBy("o_custkey").agg(F.count("*").alias("n_missing"), F.count_if("found").alias("n_present"))


# Graph

@query("SELECT a.conv_id, a.turn AS src, b.turn AS dst, a.role AS src_role, b.role AS dst_role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 WHERE a.turn > 0")
def head_edges(spark, sf_dir):
    c = load(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    node = c.withColumn("node_id", F.struct("conv_id", "turn"))
    edges = c.where("turn > 0").select(F.struct("conv_id", "turn").alias("src"), F.struct(F.col("conv_id"), (F.col("turn") - 1).alias("turn")).alias("dst"))
    out = joins.edge_pairs(node.select("node_id", "role"), edges)
    return out.select(F.col("src.conv_id").alias("conv_id"), F.col("src.turn").alias("src"), F.col("dst.turn").alias("dst"), "src_role", "dst_role")


@query("SELECT a.role AS src_role, b.role AS dst_role, count(*) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 GROUP BY ALL")
def edge_pairs(spark, sf_dir):
    return head_edges(spark, sf_dir).groupBy("src_role", "dst_role").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, o_custkey, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def parent_edges(spark, sf_dir):
    l, o = load(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber"), load(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey", "o_orderstatus")


_SPANS_SQL = """s AS (SELECT user_id, event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS b FROM events WHERE event_type = 'purchase')"""


@query(f"WITH {_SPANS_SQL} SELECT e.event_id, s.a AS span FROM events e JOIN s ON e.user_id = s.user_id AND e.event_id BETWEEN s.a AND s.b")
def span_containment(spark, sf_dir):
    """Points in the spans that hold them."""
    e = load(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    s = W.segments(e.where("event_type = 'purchase'"), ["user_id"], "event_id").select("user_id", F.col("event_id").alias("a"), (F.col("until") - 1).alias("b"))
    return joins.in_interval(e.select("event_id", "user_id"), s, "user_id", "event_id", "a", "b").select("event_id", F.col("a").alias("span"))


@query(f"WITH {_SPANS_SQL} SELECT e.event_type, s.a IS NOT NULL AS covered, count(*) AS n FROM events e LEFT JOIN s ON e.user_id = s.user_id AND e.event_id BETWEEN s.a AND s.b GROUP BY ALL")
def interval_status(spark, sf_dir):
    e = load(spark, sf_dir, "events", "event_id", "event_type")
    return e.join(span_containment(spark, sf_dir), "event_id", "left").groupBy("event_type", F.col("span").isNotNull().alias("covered")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, CAST(o.before + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) AS node_id FROM lineitem JOIN (SELECT o_orderkey, sum(n) OVER (ORDER BY o_orderpriority, o_orderkey) - n AS before FROM (SELECT o_orderkey, o_orderpriority, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)) o ON l_orderkey = o_orderkey")
def node_ids(spark, sf_dir):
    """Dense ids by (rank of the record, ordinal in it)."""
    l = load(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").withColumn("ordinal", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")))
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return ids.dense_ids(l, o, "l_orderkey", [F.col("o_orderpriority"), F.col("l_orderkey")], "ordinal").select("l_orderkey", "l_linenumber", long("node_id").alias("node_id"))


_DIGESTED = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
}


def _digest_sql(name: str, columns: list[str]) -> str:
    row = " || chr(31) || ".join(f"coalesce({c}::VARCHAR, chr(30))" for c in columns)
    sums = " || '-' || ".join(f"coalesce(sum(('0x' || substr(r, {at}, 15))::BIGINT), 0)::VARCHAR" for at in (1, 16))
    return f"SELECT '{name}' AS name, count(*)::VARCHAR || '-' || {sums} AS digest FROM (SELECT sha256({row}) AS r FROM {name})"


@query(" UNION ALL ".join(_digest_sql(n, c) for n, c in _DIGESTED.items()))
def table_digests(spark, sf_dir):
    """Order-free digests of fixed size, of small tables and a large one."""
    parts = [load(spark, sf_dir, n).agg(A.order_free_digest(c).alias("digest")).select(F.lit(n).alias("name"), "digest") for n, c in _DIGESTED.items()]
    return parts[0].union(parts[1]).union(parts[2])


# Rules and references

CROSSWALK = [("F", 1, 1000, 5), ("O", 500, 2500, -100), ("F", 3000, 9000, 7)]


@query("""SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'F' AND o_orderkey BETWEEN 1 AND 1000 THEN o_orderkey + 5 WHEN o_orderstatus = 'O' AND o_orderkey BETWEEN 500 AND 2500 THEN o_orderkey - 100
  WHEN o_orderstatus = 'F' AND o_orderkey BETWEEN 3000 AND 9000 THEN o_orderkey + 7 END AS BIGINT) AS target FROM orders""")
def crosswalk(spark, sf_dir):
    o = load(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    return joins.crosswalk(o, CROSSWALK, ["o_orderstatus"], "o_orderkey").select("o_orderkey", "target")


@query("SELECT c_custkey, n_name, r_name, CASE WHEN n_nationkey IS NULL THEN 'unresolved' WHEN r_regionkey IS NULL THEN 'ambiguous' ELSE 'reference_candidate' END AS status FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'")
def address_lookup(spark, sf_dir):
    c = load(spark, sf_dir, "customer").withColumn("n_nationkey", F.col("c_nationkey"))
    n = joins.lookup(c, load(spark, sf_dir, "nation"), ["n_nationkey"], "has_nation").withColumn("r_regionkey", F.col("n_regionkey"))
    r = joins.lookup(n, load(spark, sf_dir, "region").where("r_name <> 'ASIA'"), ["r_regionkey"], "has_region")
    status = joins.cascade([("unresolved", ~F.col("has_nation")), ("ambiguous", ~F.col("has_region"))], "reference_candidate")
    return r.select("c_custkey", "n_name", "r_name", status.alias("status"))


@query("""SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, CASE WHEN r.doc_id IS NULL THEN 'left_only' WHEN l.doc_id IS NULL THEN 'right_only' WHEN l.quality IS DISTINCT FROM r.quality OR l.toxic IS DISTINCT FROM r.toxic THEN 'mismatch' ELSE 'matched' END AS outcome,
  CASE WHEN r.doc_id IS NOT NULL AND l.doc_id IS NOT NULL THEN nullif(concat_ws(',', CASE WHEN l.quality IS DISTINCT FROM r.quality THEN 'quality' END, CASE WHEN l.toxic IS DISTINCT FROM r.toxic THEN 'toxic' END), '') END AS differing
  FROM (SELECT doc_id, quality, toxic FROM labels) l FULL JOIN (SELECT doc_id, CASE WHEN n_chars > 300 THEN 1 ELSE 0 END AS quality, 0 AS toxic FROM documents WHERE lang = 'en') r ON l.doc_id = r.doc_id""")
def reconcile_fields(spark, sf_dir):
    r = load(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.when(F.col("n_chars") > 300, 1).otherwise(0).alias("quality"), F.lit(0).alias("toxic"))
    return joins.reconcile(load(spark, sf_dir, "labels", "doc_id", "quality", "toxic"), r, "doc_id", ["quality", "toxic"])


# Identity

@query("SELECT size, count(*) AS n_groups FROM (SELECT count(*) AS size FROM documents GROUP BY sha256(text)) GROUP BY size")
def identity_multiplicity(spark, sf_dir):
    return A.histogram(load(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h")), ["h"])


# Audits

@query("""SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' WHEN grouping(quality) = 0 THEN 'quality' ELSE 'all' END AS dimension,
  CASE WHEN grouping(lang) = 0 THEN lang WHEN grouping(source) = 0 THEN source WHEN grouping(quality) = 0 THEN CAST(quality AS VARCHAR) END AS key_value, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (source), (quality), ())""")
def coverage_rollup(spark, sf_dir):
    d = load(spark, sf_dir, "documents", "doc_id", "lang", "source", "n_chars").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return A.by_each(d, ["lang", "source", "quality"], [F.count("*").alias("n"), F.sum("n_chars").alias("n_chars")])


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS n_parts, count(*) AS n, count(DISTINCT l_shipdate) > 1 AS conflicting FROM lineitem GROUP BY l_suppkey")
def distinct_targets(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey", "l_shipdate")
    return l.groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("n_parts"), F.count("*").alias("n"), (F.countDistinct("l_shipdate") > 1).alias("conflicting"))


@query("SELECT event_type, event_id, CAST(place AS INTEGER) AS place FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS place FROM (SELECT DISTINCT event_type, event_id FROM events)) WHERE place <= 3")
def smallest_examples(spark, sf_dir):
    return A.smallest(load(spark, sf_dir, "events"), ["event_type"], "event_id")


@query("SELECT size, count(*) AS n_groups FROM (SELECT count(*) AS size FROM lineitem GROUP BY l_orderkey) GROUP BY size")
def histogram(spark, sf_dir):
    return A.histogram(load(spark, sf_dir, "lineitem", "l_orderkey"), ["l_orderkey"])


@query("SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS flag, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) END AS status FROM lineitem GROUP BY l_orderkey")
def unanimity(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(A.unanimous("l_returnflag").alias("flag"), A.unanimous("l_linestatus", null_counts=True).alias("status"))


@query("""WITH s AS (SELECT source, doc_id, CAST(quality AS BIGINT) AS r FROM documents LEFT JOIN labels USING (doc_id)), m AS (SELECT source, max(r) AS r, count(*) AS n_items, count(*) - count(r) AS n_missing FROM s GROUP BY source)
SELECT m.source, min(s.doc_id) AS doc_id, m.r AS rank, count(*) > 1 AS tied, any_value(n_items) AS n_items, any_value(n_missing) AS n_missing FROM m JOIN s ON m.source = s.source AND m.r IS NOT DISTINCT FROM s.r GROUP BY m.source, m.r""")
def preference(spark, sf_dir):
    s = load(spark, sf_dir, "documents", "doc_id", "source").join(load(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id", "left").withColumn("rank", long("quality"))
    return A.preferred(s, ["source"], "rank", "doc_id")


@query("""WITH k AS (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events) SELECT 'meta_' || key AS feature, count(*) AS n, count(DISTINCT json_extract_string(props, '$.' || key)) AS n_values FROM k GROUP BY 1""")
def dynamic_features(spark, sf_dir):
    """Features named after the keys found in the data."""
    e = load(spark, sf_dir, "events", "event_id", "props").select(F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return e.groupBy(T.metadata_feature(F.col("key")).alias("feature")).agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


@query("SELECT count(d.doc_id) FILTER (l.doc_id IS NOT NULL) AS n_both, count(*) FILTER (l.doc_id IS NULL) AS n_left_only, count(*) FILTER (d.doc_id IS NULL) AS n_right_only FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def bijection(spark, sf_dir):
    return joins.bijection(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), ["doc_id"])


@query("""SELECT 'union' AS op, count(*) AS n FROM (SELECT o_orderkey FROM orders UNION SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem)
  UNION ALL SELECT 'except', count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)""")
def set_ops(spark, sf_dir):
    o, l = load(spark, sf_dir, "orders", "o_orderkey"), load(spark, sf_dir, "lineitem", "l_orderkey")
    parts = {"union": o.union(l).distinct(), "intersect": o.intersect(l), "except": o.subtract(l)}
    out = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "n") for k, df in parts.items()]
    return out[0].union(out[1]).union(out[2])


@query("SELECT 'with' AS kind, c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT 'without', c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_anti(spark, sf_dir):
    c, o = load(spark, sf_dir, "customer", "c_custkey"), load(spark, sf_dir, "orders", "o_custkey")
    on = F.col("c_custkey") == F.col("o_custkey")
    return c.join(o, on, "left_semi").select(F.lit("with").alias("kind"), "c_custkey").union(c.join(o, on, "left_anti").select(F.lit("without").alias("kind"), "c_custkey"))


# Records: every benchmark item written as an annotated record, then parsed

_ITEMS_SQL = r"""i AS (SELECT item_id, list_filter(list_transform(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), lambda x: regexp_replace(x, '[<>"&]', '', 'g')), lambda x: x <> '') AS w FROM benchmark),
words AS (SELECT item_id, ordinal, w[ordinal] AS word, ordinal = 1 OR w[ordinal - 1] LIKE '%.' AS starts FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS ordinal FROM i)),
s AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY ordinal) AS sentence FROM words)"""


def item_records(spark, sf_dir) -> DataFrame:
    """Each word a norm whose head is the word before; a note over the first three of every five words."""
    w = F.filter(F.transform(F.regexp_extract_all("text", F.lit(f"({WORDS})"), F.lit(1)), lambda x: F.regexp_replace(x, '[<>"&]', "")), lambda x: x != "")
    items = load(spark, sf_dir, "benchmark", "item_id", "text").select("item_id", w.alias("w"))

    def tag(x, i):
        first = (i == 0) | F.coalesce(F.get("w", i - 1).endswith("."), F.lit(False))
        head = F.when(i == 0, F.lit('func="root"')).otherwise(F.concat(F.lit('func="dep" head="#u'), i.cast("string"), F.lit('"')))
        return F.concat(
            F.when(i % 5 == 0, '<note note="n">').otherwise(""), F.lit('<norm xml:id="u'), (i + 1).cast("string"), F.lit('" '), F.when(first, 'new_sent="true" ').otherwise(""), head, F.lit(' norm="'), F.lower(x), F.lit('">'), x, F.lit("</norm>"),
            F.when((i % 5 == 2) | ((i % 5 < 2) & (i + 1 == F.size("w"))), "</note>").otherwise(""))

    content = F.concat(F.lit('<meta title="item"><norm_group norm_group="g">'), F.array_join(F.transform("w", tag), "\n"), F.lit("</norm_group>"))
    return items.select(F.col("item_id").cast("string").alias("source_record_id"), F.encode(content, "utf-8").alias("content"))


def _parsed(spark, sf_dir):
    from .plans.parse import parse_records

    return parse_records(item_records(spark, sf_dir))


@query(f"WITH {_ITEMS_SQL} SELECT item_id, ordinal, lower(word) AS norm, word AS source_text, ordinal - 1 AS head_ordinal, CAST(sentence AS BIGINT) AS sentence FROM s")
def parsed_words(spark, sf_dir):
    w = _parsed(spark, sf_dir).words
    return w.select(long("source_record_id").alias("item_id"), long("ordinal").alias("ordinal"), "norm", "source_text", long("head_ordinal").alias("head_ordinal"), long("sentence").alias("sentence"))


@query(f"""WITH {_ITEMS_SQL} SELECT item_id, CAST((ordinal - 1) // 5 + 1 AS BIGINT) AS ordinal, min(ordinal) AS first_word, max(ordinal) AS last_word FROM s WHERE (ordinal - 1) % 5 < 3 GROUP BY item_id, (ordinal - 1) // 5""")
def parsed_annotations(spark, sf_dir):
    a = _parsed(spark, sf_dir).annotations
    return a.select(long("source_record_id").alias("item_id"), long("ordinal").alias("ordinal"), long("first_full").alias("first_word"), long("last_full").alias("last_word"))


@query(f"""WITH {_ITEMS_SQL}, n AS (SELECT count(*) AS items, sum(n) AS words, sum(n - 1) AS heads, sum(ss) AS sentences, sum((n + 4) // 5) AS notes FROM (SELECT item_id, count(*) AS n, max(sentence) AS ss FROM s GROUP BY item_id))
SELECT 'document' AS kind, CAST(items AS BIGINT) AS n FROM n UNION ALL SELECT 'norm_group', CAST(items AS BIGINT) FROM n UNION ALL SELECT 'sentence', CAST(sentences AS BIGINT) FROM n UNION ALL SELECT 'note', CAST(notes AS BIGINT) FROM n
UNION ALL SELECT 'dependency_head', CAST(heads AS BIGINT) FROM n UNION ALL SELECT 'direct_word', CAST(words AS BIGINT) FROM n""")
def graph_census(spark, sf_dir):
    from .plans.graph import build_graph

    return build_graph(_parsed(spark, sf_dir)).census().where("what != 'width'").select(F.col("key").alias("kind"), "n")


from . import record_queries  # noqa: E402, F401 (registers its queries here)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_slots(spark, sf_dir)
