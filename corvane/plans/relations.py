"""Joins, counts, merges and reports. `events` stands for the manifest of fetched records, `lineitem` for citation edges
(part cited, order citing), `labels` for extractions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions.arrays import add_missing, append_distinct
from corvane.functions.text import blank_to_null, clipped
from corvane.operators import joins, merge, metrics, reports
from corvane.operators.metrics import Watched
from corvane.operators.ranking import best_by
from corvane.plans.catalog import query, table
from corvane.session import shared_path
from corvane.sources.tables import read_buckets, replace_children_in, update_columns_in, write_buckets

# ---- joins


@query("extractions_by_schema", "SELECT d.doc_id, d.source, l.quality, l.toxic FROM labels l JOIN documents d USING (doc_id) WHERE l.quality = 1")
def extractions_by_schema(spark, folder):
    labels = table(spark, folder, "labels").where("quality = 1")
    return labels.join(table(spark, folder, "documents"), "doc_id").select("doc_id", "source", "quality", "toxic")


@query("nest_children", "SELECT conv_id, count(*) AS n, string_agg(role || ':' || length(text), ',' ORDER BY turn) AS turns FROM conversations GROUP BY conv_id")
def nest_children(spark, folder):
    nested = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(":"), F.length("text")).alias("t"))))
    rows = table(spark, folder, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), nested.alias("s"))
    return rows.select("conv_id", "n", F.concat_ws(",", F.col("s.t")).alias("turns"))


@query("documents_with_labels", """
SELECT d.doc_id, count(l.doc_id) AS n, coalesce(string_agg(l.quality || '/' || l.toxic, ',' ORDER BY l.quality, l.toxic), '') AS labels FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.doc_id
""")  # fmt: skip
def documents_with_labels(spark, folder):
    nested = F.concat_ws(",", F.array_sort(F.collect_list(F.concat("quality", F.lit("/"), "toxic"))))
    labels = table(spark, folder, "labels").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), nested.alias("labels"))
    docs = table(spark, folder, "documents").select("doc_id")
    return docs.join(labels, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("labels", F.lit("")).alias("labels"))


_FETCH = "(event_type = 'view' AND value > 20) AS valid, CASE WHEN event_type = 'error' THEN 'http 503' END AS error, CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN 200 WHEN 'error' THEN 503 WHEN 'purchase' THEN 302 ELSE 404 END AS http_status"


def _manifest(spark, folder):
    """Events as fetch records: user as law code, event number modulo 40 as section."""
    kind = F.col("event_type")
    status = F.when(kind.isin("click", "view"), 200).when(kind == "error", 503).when(kind == "purchase", 302).otherwise(404)
    return table(spark, folder, "events").select(
        "event_id", F.col("user_id").alias("law_code"), (F.col("event_id") % 40).alias("section"), ((kind == "view") & (F.col("value") > 20)).alias("valid"),
        F.when(kind == "error", "http 503").alias("error"), status.alias("http_status"), "value",
    )


_MANIFEST = f"m AS (SELECT event_id, user_id AS law_code, event_id % 40 AS section, {_FETCH}, value FROM events)"


@query("anti_known_missing", f"""
WITH {_MANIFEST}, gone AS (SELECT DISTINCT law_code, section FROM m WHERE http_status = 200 AND NOT valid AND error IS NULL EXCEPT SELECT law_code, section FROM m WHERE valid)
SELECT DISTINCT law_code, section FROM m ANTI JOIN gone USING (law_code, section)
""")  # fmt: skip
def anti_known_missing(spark, folder):
    """A later success clears a section that was once not there."""
    m = _manifest(spark, folder)
    gone = m.where((F.col("http_status") == 200) & ~F.col("valid") & F.col("error").isNull()).select("law_code", "section")
    gone = gone.join(m.where("valid").select("law_code", "section"), ["law_code", "section"], "left_anti")
    return joins.missing_from(m.select("law_code", "section").distinct(), gone, ["law_code", "section"])


@query("toc_diff", f"WITH {_MANIFEST} SELECT u AS law_code, s AS section FROM (SELECT unnest(range(20)) AS u), (SELECT unnest(range(40)) AS s) EXCEPT SELECT law_code, section FROM m WHERE valid")
def toc_diff(spark, folder):
    sections = spark.range(20).select(F.col("id").alias("law_code"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))).alias("section"))
    return joins.missing_from(sections, _manifest(spark, folder).where("valid"), ["law_code", "section"])


@query("manifest_annotate", """
SELECT event_id, (props::JSON ->> '$.k') AS k, n_name AS name, n_regionkey::VARCHAR AS region FROM events LEFT JOIN nation ON n_nationkey = user_id % 30
""")  # fmt: skip
def manifest_annotate(spark, folder):
    """Attributes of a dimension added to each record's map where it lacks them: its own entries win."""
    dim = table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("long").alias("n"), F.map_from_arrays(F.array(F.lit("name"), F.lit("region"), F.lit("k")), F.array("n_name", F.col("n_regionkey").cast("string"), F.lit("lost"))).alias("more")
    )
    rows = table(spark, folder, "events").withColumns({"n": F.col("user_id") % 30, "extra": F.from_json("props", "map<string,string>")}).join(joins.small_side(dim), "n", "left")
    extra = F.when(F.col("more").isNull(), F.col("extra")).otherwise(add_missing(F.col("extra"), F.col("more")))
    return rows.withColumn("extra", extra).select("event_id", F.col("extra")["k"].alias("k"), F.col("extra")["name"].alias("name"), F.col("extra")["region"].alias("region"))


@query("incremental_parse", """
SELECT page_id, sha256(html) AS sha, CASE page_id % 3 WHEN 0 THEN 'cached' WHEN 1 THEN 'fresh' ELSE 'new' END AS status FROM pages
""")  # fmt: skip
def incremental_parse(spark, folder):
    raw = table(spark, folder, "pages").select("page_id", F.sha2("html", 256).alias("sha"))
    parsed = raw.where("page_id % 3 < 2").withColumn("sha", F.when(F.col("page_id") % 3 == 0, F.col("sha")).otherwise("old"))
    return joins.changed(raw, parsed, ["page_id"], "sha")


@query("asof_series", """
WITH h AS (SELECT user_id, ts, max(value) AS header FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT e.event_id, h.header FROM (SELECT * FROM events WHERE event_type <> 'purchase') e ASOF LEFT JOIN h ON e.user_id = h.user_id AND e.ts >= h.ts
""")  # fmt: skip
def asof_series(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type", "value")
    headers = events.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("header"))
    return joins.as_of(events.where("event_type <> 'purchase'"), headers, ["user_id"], "ts", "header").select("event_id", "header")


@query("next_greater", """
SELECT o_orderkey, (SELECT min(b.o_orderkey) FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderkey > a.o_orderkey) AS next_key FROM orders a
""")  # fmt: skip
def next_greater(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey")
    return joins.next_greater(orders, ["o_custkey"], "o_orderkey", "next_key").select("o_orderkey", "next_key")


@query("range_join_pages", """
SELECT s.s_suppkey, count(*) AS n, sum(p.p_partkey)::BIGINT AS keys FROM supplier s JOIN part p ON p.p_partkey >= s.s_suppkey * 3 AND p.p_partkey < s.s_suppkey * 3 + s.s_nationkey GROUP BY s.s_suppkey
""")  # fmt: skip
def range_join_pages(spark, folder):
    spans = table(spark, folder, "supplier").select("s_suppkey", (F.col("s_suppkey") * 3).alias("a"), (F.col("s_suppkey") * 3 + F.col("s_nationkey")).alias("b"))
    found = joins.in_range(table(spark, folder, "part").select("p_partkey"), spans, "p_partkey", "a", "b")
    return found.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("keys"))


@query("wide_range_join", """
SELECT s.s_suppkey, count(*) AS n FROM supplier s JOIN events e ON e.event_id >= s.s_suppkey * 50 AND e.event_id < s.s_suppkey * 50 + 170 GROUP BY s.s_suppkey
""")  # fmt: skip
def wide_range_join(spark, folder):
    spans = table(spark, folder, "supplier").select("s_suppkey", (F.col("s_suppkey") * 50).alias("a"), (F.col("s_suppkey") * 50 + 170).alias("b"))
    found = joins.in_wide_range(table(spark, folder, "events").select("event_id"), spans, "event_id", "a", "b", 100)
    return found.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"))


_CITED = "SELECT DISTINCT 'CA/VEH/' || l_partkey || CASE WHEN l_linenumber % 2 = 0 THEN '/a' ELSE '' END AS key FROM lineitem WHERE l_quantity > 40"


@query("prefix_coverage", f"""
WITH k AS ({_CITED}), e AS (SELECT p_partkey, 'CA/VEH/' || p_partkey AS key FROM part),
h AS (SELECT e.p_partkey, max(CASE WHEN k.key IS NOT NULL THEN 1 ELSE 0 END) AS hit FROM e LEFT JOIN k ON k.key = e.key OR starts_with(k.key, e.key || '/') GROUP BY ALL)
SELECT count(*) AS total, sum(hit)::BIGINT AS covered, round(sum(hit) / count(*), 6) AS ratio FROM h
""")  # fmt: skip
def prefix_coverage(spark, folder):
    """Citations covered by an index, by key or by a longer key below it: one equi-join on the three-part key."""
    cited = table(spark, folder, "lineitem").where("l_quantity > 40").select(F.concat(F.lit("CA/VEH/"), "l_partkey", F.when(F.col("l_linenumber") % 2 == 0, "/a").otherwise("")).alias("key"))
    index = cited.select(joins.prefix_key(F.col("key"), 3).alias("key")).distinct().withColumn("hit", F.lit(1))
    wanted = table(spark, folder, "part").select(F.concat(F.lit("CA/VEH/"), "p_partkey").alias("key"))
    hits = wanted.join(index, "key", "left")
    return hits.agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("covered")).withColumn("ratio", F.round(F.try_divide("covered", "total"), 6))


@query("key_lookup", """
SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey = 7
""")  # fmt: skip
def key_lookup(spark, folder):
    """Instructions that cite a section or one of its subsections."""
    edges = table(spark, folder, "lineitem").select("l_orderkey", F.concat(F.lit("CA/VEH/"), "l_partkey", F.lit("/"), "l_linenumber").alias("key"))
    return edges.where(joins.prefix_key(F.col("key"), 3) == "CA/VEH/7").select("l_orderkey").distinct()


@query("dim_broadcast", """
SELECT s_suppkey, coalesce(n_name, '??') AS nation, coalesce(r_name, 'Legislature') AS publisher FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3
""")  # fmt: skip
def dim_broadcast(spark, folder):
    nation, region = (joins.small_side(table(spark, folder, t)) for t in ("nation", "region"))
    s = table(spark, folder, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(region, (F.col("n_regionkey") == F.col("r_regionkey")) & (F.col("r_regionkey") < 3), "left")
    return s.select("s_suppkey", F.coalesce("n_name", F.lit("??")).alias("nation"), F.coalesce("r_name", F.lit("Legislature")).alias("publisher"))


@query("collections_join", """
SELECT c_custkey, count(*) AS n_items, count(DISTINCT l_partkey) AS n_parts, max(p_name) AS last_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL
""")  # fmt: skip
def collections_join(spark, folder):
    orders, items = table(spark, folder, "orders").select("o_orderkey", "o_custkey"), table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    parts = joins.small_side(table(spark, folder, "part").select("p_partkey", "p_name"), 500_000)
    rows = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.join(table(spark, folder, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return rows.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_items"), F.countDistinct("l_partkey").alias("n_parts"), F.max("p_name").alias("last_name"))


@query("project_membership", """
WITH p AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderkey))) AS ids FROM orders GROUP BY o_custkey)
SELECT o_custkey, len(ids)::BIGINT AS n, len(list_filter(ids, lambda x: x <> ids[1]))::BIGINT AS n_after_remove, array_to_string(list_sort(list_distinct(list_concat(ids, [-1]))), ',') AS with_added FROM p
""")  # fmt: skip
def project_membership(spark, folder):
    p = table(spark, folder, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderkey")).alias("ids"))
    added = F.array_sort(F.array_union("ids", F.array(F.lit(-1).cast("long"))))
    removed = F.size(F.array_remove("ids", F.get("ids", F.lit(0)))).cast("long")
    return p.select("o_custkey", F.size("ids").cast("long").alias("n"), removed.alias("n_after_remove"), F.array_join(added.cast("array<string>"), ",").alias("with_added"))


@query("chip_union", "SELECT DISTINCT lang AS label FROM documents UNION SELECT unnest(['en', 'nv', 'or'])")
def chip_union(spark, folder):
    known = spark.createDataFrame([("en",), ("nv",), ("or",)], "label string")
    return table(spark, folder, "documents").select(F.col("lang").alias("label")).union(known).distinct().orderBy("label")


@query("source_fallback", "SELECT doc_id, 'primary' AS origin FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'seed' FROM documents WHERE lang <> 'en' AND doc_id % 2 = 0")
def source_fallback(spark, folder):
    """Each id from the first source that has it."""
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    ranked = docs.where("lang = 'en'").select("doc_id", F.lit(0).alias("rank"), F.lit("primary").alias("origin")).unionByName(docs.where("doc_id % 2 = 0").select("doc_id", F.lit(1).alias("rank"), F.lit("seed").alias("origin")))
    return best_by(ranked, ["doc_id"], [F.col("rank")]).select("doc_id", "origin")


# ---- counts and reports

_KINDS = ["click", "view", "error", "purchase", "signup", "refund", "login"]
_KINDS_SQL = "(SELECT unnest(['click', 'view', 'error', 'purchase', 'signup', 'refund', 'login']) AS category)"


@query("category_coverage", f"SELECT category, count(event_id) AS n FROM {_KINDS_SQL} LEFT JOIN events ON event_type = category GROUP BY category")
def category_coverage(spark, folder):
    return reports.zero_filled(table(spark, folder, "events"), "event_type", _KINDS).orderBy("n", "category")


@query("thin_coverage", f"""
WITH c AS (SELECT category, count(event_id) AS n FROM {_KINDS_SQL} LEFT JOIN events ON event_type = category GROUP BY category)
SELECT count(*) FILTER (n > 0) AS covered, sum(n)::BIGINT AS tagged, string_agg(category, ',' ORDER BY category) FILTER (n <= 1) AS thin FROM c
""")  # fmt: skip
def thin_coverage(spark, folder):
    c = reports.zero_filled(table(spark, folder, "events"), "event_type", _KINDS)
    thin = F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.col("n") <= 1, F.col("category")))))
    return c.agg(reports.count_of(F.col("n") > 0, "covered"), F.sum("n").alias("tagged"), thin.alias("thin"))


@query("top_categories", "SELECT event_type AS category, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, category LIMIT 3")
def top_categories(spark, folder):
    c = reports.zero_filled(table(spark, folder, "events"), "event_type", _KINDS)
    return c.where("n > 0").orderBy(F.desc("n"), "category").limit(3)


_QUALITY = "CASE WHEN valid THEN 4 WHEN error IS NOT NULL THEN 0 WHEN http_status = 200 THEN 3 WHEN http_status BETWEEN 200 AND 399 THEN 2 WHEN http_status BETWEEN 400 AND 499 THEN 1 ELSE 0 END"
_BEST = f"b AS (SELECT *, {_QUALITY} AS quality FROM m QUALIFY row_number() OVER (PARTITION BY law_code, section ORDER BY {_QUALITY} DESC, event_id) = 1)"


def _deduped(spark, folder):
    m = _manifest(spark, folder).withColumn("quality", reports.fetch_quality(F.col("valid"), F.col("error"), F.col("http_status")).cast("int"))
    keyed = F.col("law_code").isNotNull() & F.col("section").isNotNull()
    return best_by(m.where(keyed), ["law_code", "section"], [-F.col("quality"), F.col("event_id")]).unionByName(m.where(~keyed))


@query("manifest_dedupe", f"WITH {_MANIFEST}, {_BEST} SELECT law_code, section, event_id, quality FROM b")
def manifest_dedupe(spark, folder):
    return _deduped(spark, folder).select("law_code", "section", "event_id", "quality")


@query("quality_buckets", f"""
WITH {_MANIFEST}, {_BEST} SELECT count(*) FILTER (quality = 4) AS valid, count(*) FILTER (quality = 3) AS not_found, count(*) FILTER (quality = 0) AS error, count(*) FILTER (quality IN (1, 2)) AS other FROM b
""")  # fmt: skip
def quality_buckets(spark, folder):
    q = F.col("quality")
    return _deduped(spark, folder).agg(reports.count_of(q == 4, "valid"), reports.count_of(q == 3, "not_found"), reports.count_of(q == 0, "error"), reports.count_of(q.isin(1, 2), "other"))


@query("tag_accuracy", """
SELECT count(*) FILTER (toxic = 0) AS graded, count(*) FILTER (toxic = 0 AND quality = (n_chars >= 400)::INT) AS correct,
       round(100.0 * count(*) FILTER (toxic = 0 AND quality = (n_chars >= 400)::INT) / count(*) FILTER (toxic = 0), 6) AS pct
FROM labels JOIN documents USING (doc_id)
""")  # fmt: skip
def tag_accuracy(spark, folder):
    rows = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.agg(*reports.accuracy(F.col("toxic") == 0, F.col("quality") == (F.col("n_chars") >= 400).cast("int")))


@query("accuracy_mismatches", "SELECT doc_id, quality, (n_chars >= 400)::INT AS predicted FROM labels JOIN documents USING (doc_id) WHERE quality <> (n_chars >= 400)::INT")
def accuracy_mismatches(spark, folder):
    rows = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.withColumn("predicted", (F.col("n_chars") >= 400).cast("int")).where("quality <> predicted").select("doc_id", "quality", "predicted")


_EDGES = "e AS (SELECT 'CA/VEH/' || l_partkey AS key, l_orderkey AS iid, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS rank, l_linenumber AS pos FROM lineitem)"


def _edges(spark, folder):
    rank = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2)
    return table(spark, folder, "lineitem").select(F.concat(F.lit("CA/VEH/"), "l_partkey").alias("key"), F.col("l_orderkey").alias("iid"), rank.alias("rank"), F.col("l_linenumber").alias("pos"))


@query("inverted_index", f"WITH {_EDGES} SELECT key, iid, min(struct_pack(rank := rank, pos := pos)).rank::INT AS role FROM e GROUP BY key, iid")
def inverted_index(spark, folder):
    """One edge for each key and instruction, with its best role: title before sources before directions."""
    return _edges(spark, folder).groupBy("key", "iid").agg(F.min("rank").alias("role"))


@query("top_keys", f"WITH {_EDGES} SELECT key, count(*) AS n, min(iid) AS first_seen FROM e GROUP BY key ORDER BY n DESC, first_seen, key LIMIT 50")
def top_keys(spark, folder):
    counts = _edges(spark, folder).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("iid").alias("first_seen"))
    return counts.orderBy(F.desc("n"), "first_seen", "key").limit(50)


@query("index_summary", """
SELECT (SELECT count(*) FROM orders) AS instructions, count(DISTINCT l_orderkey) AS with_statutes, count(DISTINCT l_partkey) AS unique_keys, count(*) AS edges FROM lineitem SEMI JOIN orders ON l_orderkey = o_orderkey
""")  # fmt: skip
def index_summary(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey")
    edges = table(spark, folder, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    total = orders.agg(F.count(F.lit(1)).alias("instructions"))
    return edges.agg(F.countDistinct("l_orderkey").alias("with_statutes"), F.countDistinct("l_partkey").alias("unique_keys"), F.count(F.lit(1)).alias("edges")).crossJoin(total)  # one row each


@query("counts_by_code", "SELECT p_brand AS code, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def counts_by_code(spark, folder):
    counts = table(spark, folder, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("k"))  # before the join: a row per part
    return counts.join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("code")).agg(F.sum("k").alias("n"))


@query("run_totals", f"""
WITH {_MANIFEST} SELECT count(*) AS completed, count(*) FILTER (valid) AS valid, count(*) FILTER (http_status = 404) AS not_found, count(*) FILTER (error IS NOT NULL) AS errors, round(sum(value), 4) AS bytes FROM m
""")  # fmt: skip
def run_totals(spark, folder):
    c = F.col
    return _manifest(spark, folder).agg(
        F.count(F.lit(1)).alias("completed"), reports.count_of(c("valid"), "valid"), reports.count_of(c("http_status") == 404, "not_found"), reports.count_of(c("error").isNotNull(), "errors"),
        F.round(F.sum("value"), 4).alias("bytes"),
    )


@query("backoff_delays", "SELECT k::BIGINT AS attempt, round(least(0.5 * pow(2, k - 1) + 0.1 * k, 30), 6) AS seconds FROM (SELECT unnest(range(1, 11)) AS k)")
def backoff_delays(spark, folder):
    k = F.col("attempt")
    return spark.range(1, 11).select(F.col("id").alias("attempt")).withColumn("seconds", F.round(F.least(0.5 * F.pow(F.lit(2.0), k - 1) + 0.1 * k, F.lit(30.0)), 6))


# ---- merges


@query("upsert_last_wins", """
WITH t AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 2 = 0), c AS (SELECT o_orderkey % 1000 AS k, o_orderpriority AS v, o_orderkey AS version FROM orders)
SELECT k, v FROM t WHERE k NOT IN (SELECT k FROM c) UNION ALL SELECT k, arg_max(v, version) FROM c GROUP BY k
""")  # fmt: skip
def upsert_last_wins(spark, folder):
    orders = table(spark, folder, "orders")
    target = orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"), F.lit(None).cast("long").alias("version"))
    changes = orders.select((F.col("o_orderkey") % 1000).alias("k"), F.col("o_orderpriority").alias("v"), F.col("o_orderkey").alias("version"))
    return merge.upsert(target, changes, ["k"], F.col("version")).select("k", "v")


@query("insert_first_wins", """
WITH t AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 2 = 0), c AS (SELECT o_orderkey % 1000 AS k, o_orderpriority AS v, o_orderkey AS path FROM orders)
SELECT k, v FROM t UNION ALL SELECT k, arg_min(v, path) FROM c WHERE k NOT IN (SELECT k FROM t) GROUP BY k
""")  # fmt: skip
def insert_first_wins(spark, folder):
    orders = table(spark, folder, "orders")
    target = orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"), F.lit(None).cast("long").alias("path"))
    changes = orders.select((F.col("o_orderkey") % 1000).alias("k"), F.col("o_orderpriority").alias("v"), F.col("o_orderkey").alias("path"))
    return merge.insert_new(target, changes, ["k"], [F.col("path")]).select("k", "v")


@query("replace_children", "SELECT conv_id, turn, role FROM conversations WHERE conv_id % 5 <> 0 UNION ALL SELECT conv_id, 0, 'merged' FROM conversations WHERE conv_id % 5 = 0 GROUP BY conv_id")
def replace_children(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role")
    new = rows.where("conv_id % 5 = 0").select("conv_id", F.lit(0).cast("long").alias("turn"), F.lit("merged").alias("role")).distinct()
    return merge.replace_children(rows, new, "conv_id")


@query("update_factors", "SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'flagged' END, d.source) AS source, d.lang FROM documents d LEFT JOIN labels l USING (doc_id)")
def update_factors(spark, folder):
    updates = table(spark, folder, "labels").where("toxic = 1").select("doc_id", F.lit("flagged").alias("source"))
    return merge.update_columns(table(spark, folder, "documents").select("doc_id", "source", "lang"), updates, "doc_id", ["source"])


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, folder):
    return merge.check_unique(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


# ---- shapes


@query("verdict_to_comparable", """
SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN o_orderstatus || ' ' || o_custkey WHEN o_custkey % 3 = 1 THEN '(' || strftime(o_orderdate, '%Y-%m-%d') || ')' ELSE 'Unknown case' END AS citation,
       CASE WHEN o_custkey % 3 = 1 THEN year(o_orderdate)::INT ELSE 1999 END AS year, CASE WHEN o_orderpriority ILIKE '%low%' THEN 'settlement' ELSE 'verdict' END AS kind, o_totalprice AS award
FROM orders WHERE o_totalprice <> 0
""")  # fmt: skip
def verdict_to_comparable(spark, folder):
    """The citation, else the date in parentheses, else the case's name; the year of filing, else of the decision."""
    third = F.col("o_custkey") % 3
    cited, filed = F.when(third == 0, F.concat_ws(" ", "o_orderstatus", "o_custkey")), F.when(third == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
    name, decided = F.lit("Unknown case"), F.lit("1999-05-01")
    year = F.coalesce(F.left(filed, F.lit(4)).try_cast("int"), F.left(decided, F.lit(4)).try_cast("int"))
    award_type = F.when(F.col("o_orderpriority").ilike("%low%"), "Settled").otherwise("jury verdict")
    rows = table(spark, folder, "orders").where(F.coalesce("o_totalprice", F.lit(0.0)) != 0)
    return rows.select(
        "o_orderkey", F.coalesce(blank_to_null(cited), F.concat(F.lit("("), filed, F.lit(")")), name).alias("citation"), year.alias("year"),
        F.when(F.contains(F.lower(award_type), F.lit("settle")), "settlement").otherwise("verdict").alias("kind"), F.col("o_totalprice").alias("award"),
    )


@query("statute_shape", """
SELECT p_partkey AS id, coalesce(nullif(trim(CASE WHEN p_size % 2 = 0 THEN ' ' ELSE p_name END), ''), p_brand) AS title,
       CASE WHEN length(p_name || repeat('x', 300)) > 240 THEN left(p_name || repeat('x', 300), 240) || '…' END AS summary, 'Legislature' AS publisher
FROM part
""")  # fmt: skip
def statute_shape(spark, folder):
    title = F.when(F.col("p_size") % 2 == 0, " ").otherwise(F.col("p_name"))
    full = F.concat("p_name", F.repeat(F.lit("x"), 300))
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.coalesce(blank_to_null(title), blank_to_null(F.col("p_brand")), F.lit("(untitled)")).alias("title"), clipped(full, 240).alias("summary"),
        F.coalesce(blank_to_null(F.lit(" ")), F.lit(None), F.lit("Legislature")).alias("publisher"),
    )


@query("year_from_date", "SELECT o_orderkey, year(o_orderdate)::INT AS year, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderdate IS NOT NULL")
def year_from_date(spark, folder):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, folder, "orders").select("o_orderkey", F.left(iso, F.lit(4)).try_cast("int").alias("year"), F.left(iso, F.lit(10)).alias("day"))


@query("chat_history_filter", "SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''")
def chat_history_filter(spark, folder):
    return table(spark, folder, "conversations").where(F.col("role").isin("user", "assistant") & blank_to_null(F.col("text")).isNotNull()).select("conv_id", "turn", "role", "text")


@query("user_turn", """
SELECT conv_id, turn, 'Matter: ' || conv_id || chr(10) || chr(10) || 'Attachment:' || chr(10) || CASE WHEN length(text) > 100 THEN left(text, 100) || ' [truncated]' ELSE text END || chr(10) || chr(10) || text AS message
FROM conversations WHERE role = 'user'
""")  # fmt: skip
def user_turn(spark, folder):
    attached = F.concat(F.lit("Attachment:\n"), clipped(F.col("text"), 100, " [truncated]"))
    rows = table(spark, folder, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", F.concat_ws("\n\n", F.concat(F.lit("Matter: "), "conv_id"), attached, "text").alias("message"))


@query("result_block", """
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, '[' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) || '] ' || l_partkey || ' (' || l_suppkey || ')' AS line FROM lineitem
""")  # fmt: skip
def result_block(spark, folder):
    """Numbered lines for a tool's answer: each order is an answer, its items are the lines."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    line = F.format_string("[%d] %d (%d)", n, "l_partkey", "l_suppkey")
    return table(spark, folder, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), line.alias("line"))


@query("tag_lists", "SELECT d.doc_id, concat_ws('|', d.lang, d.source, CASE WHEN l.toxic = 1 THEN 'toxic' END) AS tags FROM documents d LEFT JOIN labels l USING (doc_id)")
def tag_lists(spark, folder):
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    tags = append_distinct(F.col("lang"), F.col("source"), F.when(F.col("toxic") == 1, "toxic"), F.col("lang"))
    return rows.select("doc_id", F.array_join(tags, "|").alias("tags"))


@query("outline_flatten", """
WITH RECURSIVE t(name, path, depth) AS (
  SELECT r_name, r_name, 0 FROM region UNION ALL SELECT n_name, t.path || '/' || n_name, 1 FROM t JOIN region ON r_name = t.name JOIN nation ON n_regionkey = r_regionkey WHERE depth = 0
)
SELECT name, path, depth FROM t
""")  # fmt: skip
def outline_flatten(spark, folder):
    """A tree of any depth by a recursive query: the next level is a join of the last one with the children."""
    tree = table(spark, folder, "region").select(F.col("r_name").alias("node"), F.lit(None).cast("string").alias("parent"))
    kids = table(spark, folder, "nation").join(F.broadcast(table(spark, folder, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions
    tree.unionByName(kids.select(F.col("n_name").alias("node"), F.col("r_name").alias("parent"))).createOrReplaceTempView("_outline")
    return spark.sql("""
        WITH RECURSIVE t(name, path, depth) AS (
          SELECT node, node, 0 FROM _outline WHERE parent IS NULL UNION ALL SELECT o.node, concat(t.path, '/', o.node), t.depth + 1 FROM t JOIN _outline o ON o.parent = t.name
        )
        SELECT name, path, depth FROM t
    """)


# ---- parts of tables rewritten, and totals that come with a job


@query("bucket_rewrites", """
WITH o AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 1000 = 0)
SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_orderkey % 1000 = 1 THEN 'late' END, l_returnflag) AS flag FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o)
UNION ALL SELECT o_orderkey, k::INT, 'new' FROM o, (SELECT unnest([1, 2]) AS k)
""")  # fmt: skip
def bucket_rewrites(spark, folder):
    """Lines by order in 64 buckets: some orders' lines replaced, then a column of other lines set, in their buckets alone."""
    out = shared_path(spark, "buckets")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag"))
    write_buckets(lines, out, ["l_orderkey"], 64)
    chosen = table(spark, folder, "orders").where("o_orderkey % 1000 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    kind = lines.schema["l_linenumber"].dataType
    replace_children_in(out, chosen.select("l_orderkey", F.explode(F.array(F.lit(1).cast(kind), F.lit(2).cast(kind))).alias("l_linenumber"), F.lit("new").alias("flag")), "l_orderkey")
    late = lines.where("l_orderkey % 1000 = 1").select("l_orderkey", F.lit("late").alias("flag")).distinct()
    update_columns_in(out, late, "l_orderkey", ["flag"])
    return read_buckets(spark, out)


@query("observed_totals", f"""
WITH {_MANIFEST} SELECT count(*) AS completed, count(*) FILTER (valid) AS valid, count(*) FILTER (http_status = 404) AS not_found, count(*) FILTER (error IS NOT NULL) AS errors, round(sum(value), 4) AS bytes,
  (SELECT count(*) FILTER (length(html) % 7 = 0) FROM pages) AS failures, (SELECT min(page_id) FILTER (length(html) % 7 = 0) FROM pages) AS first_failure,
  (SELECT count(DISTINCT source) FROM documents) AS files, (SELECT count(*) FILTER (length(text) > 100) FROM documents) AS records, (SELECT count(*) FILTER (length(text) <= 100) FROM documents) AS skipped
FROM m
""")  # fmt: skip
def observed_totals(spark, folder):
    """Totals of three jobs that write their tables, observed while they do."""
    c = F.col
    fetched = Watched(_manifest(spark, folder), metrics.fetch_totals(c("valid"), c("http_status"), c("error"), c("value")))
    pages = Watched(table(spark, folder, "pages"), metrics.failure_totals(F.length("html") % 7 == 0, c("page_id"), F.lit("short page")))
    docs = Watched(table(spark, folder, "documents").select("source", "text"), metrics.record_totals(c("source"), F.length("text") <= 100))
    for watched in (fetched, pages, docs):
        watched.table.write.parquet(shared_path(spark, "observed"))
    row = fetched.totals | pages.totals | docs.totals
    first = row["first_failure"]
    values = [(row["completed"], row["valid"], row["not_found"], row["errors"], round(row["bytes"] or 0.0, 4), row["failures"], first and first["key"], row["files"], row["records"], row["skipped"])]
    return spark.createDataFrame(values, "completed long, valid long, not_found long, errors long, bytes double, failures long, first_failure long, files long, records long, skipped long")
