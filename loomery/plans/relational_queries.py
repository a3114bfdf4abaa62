"""Queries of projection, filter, lookup, aggregation, order and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.operators import relational as R
from loomery.plans.registry import Tables, query


@query("SELECT user_id, count(DISTINCT event_type) AS n_items, count(event_id) AS n_rows, round(sum(value), 6) AS total FROM events GROUP BY 1")
def user_usage(t: Tables):
    out = R.usage(t.events, "user_id", "event_type", "event_id", "value")
    return out.withColumn("total", F.round("total", 6))


@query("SELECT o_orderkey, coalesce(map_extract(m, 'P')[1], 'none') AS status FROM (SELECT o_orderkey, map([o_orderstatus], [o_orderpriority]) AS m FROM orders)")
def map_get_default(t: Tables):
    m = t.orders.select("o_orderkey", F.create_map("o_orderstatus", "o_orderpriority").alias("m"))
    return m.select("o_orderkey", R.get_key("m", "P", F.lit("none")).alias("status"))


@query("SELECT c_name, c_acctbal, 'unknown' AS c_phone FROM customer")
def multi_columns(t: Tables):
    return R.get_columns(t.customer, ["c_name", "c_acctbal", "c_phone"], F.lit("unknown"))


@query("SELECT s_suppkey * 2 AS s_suppkey, s_name, s_nationkey * 2 AS s_nationkey, s_acctbal * 2 AS s_acctbal FROM supplier")
def map_leaves(t: Tables):
    return R.map_leaves(t.supplier, lambda c: c * 2)


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '[aeiou]{2}') AND regexp_matches(p_type, 'S')")
def regex_filter(t: Tables):
    return t.part.filter(R.matches({"p_name": "[aeiou]{2}", "p_type": "S", "p_brand": None})).select("p_partkey", "p_name")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3)")
def isin_filter(t: Tables):
    return R.members(t.nation, "n_regionkey", [1, 3]).select("n_nationkey", "n_name")


@query("SELECT o_orderkey FROM orders WHERE NOT regexp_matches(lower(o_orderpriority), 'urgent|high')")
def health_filter(t: Tables):
    return t.orders.filter(R.healthy(F.lower("o_orderpriority"), ("urgent", "high"))).select("o_orderkey")


@query("""SELECT user_id, n, coalesce(spent, 0) AS spent FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
 LEFT JOIN (SELECT o_custkey AS user_id, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1) USING (user_id) WHERE n > 5 OR coalesce(spent, 0) > 0""")
def active_users(t: Tables):
    n = t.events.groupBy("user_id").agg(F.count("*").alias("n"))
    spent = t.orders.groupBy(F.col("o_custkey").alias("user_id")).agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    out = R.left_default(n, spent, "user_id", {"spent": 0.0})
    return out.filter(R.active(F.col("n"), F.col("spent"), 5))


@query("SELECT p_partkey FROM part WHERE contains(p_name, 'an') OR contains(p_name, 'or')")
def keyword_filter(t: Tables):
    return t.part.filter(R.any_keyword(F.col("p_name"), ["an", "or"])).select("p_partkey")


@query("SELECT s_suppkey, trim(substr(s_name, 9), '.') AS s_name FROM supplier WHERE starts_with(s_name, 'Supplier')")
def prefix_filter(t: Tables):
    return R.by_prefix(t.supplier, "s_name", "Supplier", True).select("s_suppkey", "s_name")


@query("SELECT n_nationkey, CASE WHEN n_name LIKE 'A%' OR n_name LIKE 'NATION_1%' THEN true ELSE n_regionkey = 0 END AS flag FROM nation")
def prefix_flags(t: Tables):
    rows = t.nation.withColumn("flag", F.col("n_regionkey") == 0)
    return R.flag_prefixes(rows, "n_name", ["A", "NATION_1"], "flag", True).select("n_nationkey", "flag")


@query("""SELECT doc_id, band FROM (SELECT doc_id, unnest(list_filter([CASE WHEN n_chars < 1000 THEN 'small' END, CASE WHEN n_chars > 900 AND n_chars < 5000 THEN 'medium' END,
 CASE WHEN n_chars > 4000 THEN 'large' END], lambda x: x IS NOT NULL)) AS band FROM documents)""")
def size_routing(t: Tables):
    bands = {"small": (-1, 1000), "medium": (900, 5000), "large": (4000, 1e18)}
    return R.size_classes(t.documents, "n_chars", bands).select("doc_id", "band")


@query("""SELECT p_partkey, coalesce(list_filter(w, lambda x: contains(x, 'z'))[1], list_filter(w, lambda x: len(x) > 4)[1]) AS word
 FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)""")
def first_match(t: Tables):
    w = F.split("p_name", " ")
    return t.part.select("p_partkey", R.first_match(w, lambda x: x.contains("z"), lambda x: F.length(x) > 4).alias("word"))


@query("SELECT r_regionkey AS x_r_regionkey, r_name AS x_r_name FROM region")
def prefixed_columns(t: Tables):
    return R.add_prefix(t.region, "x_")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def subset_rows(t: Tables):
    keys = t.customer.filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return R.subset(t.orders, keys, "o_custkey").select("o_orderkey")


@query("SELECT page_id, url FROM pages")
def drop_fields(t: Tables):
    return t.pages.drop("html")


@query("SELECT l.doc_id, l.quality, d.lang, d.source FROM labels l JOIN documents d USING (doc_id)")
def sample_annotation_lookup(t: Tables):
    dim = t.documents.select("doc_id", "lang", "source", F.col("n_chars").alias("ord"))
    return R.lookup(t.labels.select("doc_id", "quality"), dim, "doc_id", "ord", required=True).drop("ord")


@query("SELECT DISTINCT source FROM documents INTERSECT SELECT DISTINCT source FROM documents JOIN labels USING (doc_id)")
def shard_pairing(t: Tables):
    return R.paired(t.documents, t.documents.join(t.labels, "doc_id"), "source")


@query("""WITH s AS (SELECT n_nationkey AS k, n_regionkey * 60 + 7 AS n FROM nation), r AS (SELECT k, sum(n) OVER (ORDER BY k) - n AS lo, sum(n) OVER (ORDER BY k) AS hi FROM s)
 SELECT c_custkey, k::BIGINT AS shard, (c_custkey - lo)::BIGINT AS inner_idx FROM customer, r WHERE c_custkey >= lo AND c_custkey < hi""")
def global_index_lookup(t: Tables):
    from loomery.operators.ordering import lengths_to_ranges

    s = t.nation.select(F.col("n_nationkey").alias("k"), (F.col("n_regionkey") * 60 + 7).alias("n"))
    got = R.interval_lookup(t.customer, "c_custkey", lengths_to_ranges(s, "k", "n"), "lo", "hi", 64)
    return got.select("c_custkey", F.col("k").cast("long").alias("shard"), (F.col("c_custkey") - F.col("lo")).cast("long").alias("inner_idx"))


@query("SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1) USING (c_custkey)")
def lookup_default(t: Tables):
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return R.left_default(t.customer.select("c_custkey"), n, "c_custkey", {"n": 0})


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def dimension_lookup(t: Tables):
    dim = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return t.customer.join(dim, "c_nationkey").select("c_custkey", "n_name")


@query("""WITH b AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS word FROM benchmark), v AS (SELECT word, row_number() OVER (ORDER BY word) + 1 AS id FROM b WHERE word <> ''),
 k AS (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM (SELECT item_id, list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS w FROM benchmark))
 SELECT item_id, list(coalesce(CASE WHEN len(word) > 3 THEN id END, 1) ORDER BY p) AS ids FROM k LEFT JOIN v USING (word) GROUP BY 1""")
def vocab_lookup(t: Tables):
    from loomery.operators.ordering import with_position

    w = F.filter(F.split(F.lower("text"), " "), lambda x: x != "")
    words = t.benchmark.select(F.explode(w).alias("word")).distinct()
    vocab = with_position(words, ["word"], "id").select("word", (F.col("id") + 2).alias("id")).filter(F.length("word") > 3)
    return R.encode_tokens(t.benchmark.select("item_id", w.alias("tokens")), "item_id", "tokens", vocab, 1)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_downloaded(t: Tables):
    return R.missing_keys(t.documents, t.labels, "doc_id").select("doc_id")


@query("SELECT a.vec_id, list_transform([0, 3, 5, 63], lambda i: a.embedding[i + 1]::DOUBLE) AS picked FROM embeddings a")
def batch_gather(t: Tables):
    from loomery.functions.vectors import gather

    x = F.col("embedding").cast("array<double>")
    return t.embeddings.select("vec_id", gather(x, F.array(*[F.lit(k) for k in (0, 3, 5, 63)])).alias("picked"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0")
def resolved_context(t: Tables):
    right = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return R.resolve(t.orders, right, "o_custkey")[0].select("o_orderkey", "c_name")


@query("SELECT conv_id, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY 1")
def keep_last_by_key(t: Tables):
    return R.last_by_key(t.conversations, ["conv_id"], "turn").select("conv_id", "role", "text")


@query("SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def group_append(t: Tables):
    rows = R.rows_by_key(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], "turn")
    return rows.select("conv_id", F.transform("rows", lambda r: r["role"]).alias("roles"))


@query("SELECT 's_acctbal' AS name, list(s_acctbal ORDER BY s_suppkey) AS values FROM supplier UNION ALL SELECT 's_nationkey', list(s_nationkey::DOUBLE ORDER BY s_suppkey) FROM supplier")
def columnar_transpose(t: Tables):
    s = t.supplier.withColumn("s_nationkey", F.col("s_nationkey").cast("double"))
    return R.columns_to_lists(s, ["s_acctbal", "s_nationkey"], "s_suppkey")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def text_merge_by_key(t: Tables):
    return R.merge_text(t.conversations, ["conv_id"], "text", "turn")


@query("SELECT user_id, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS kinds FROM events GROUP BY 1")
def distinct_as_text(t: Tables):
    return t.events.groupBy("user_id").agg(R.joined_distinct("event_type").alias("kinds"))


@query("SELECT lang, round(sum(n_chars * w) / sum(w), 6) AS avg FROM (SELECT lang, n_chars, doc_id % 3 AS w FROM documents) GROUP BY 1")
def global_avg(t: Tables):
    from loomery.operators.metrics import global_avg as avg

    d = t.documents.withColumn("w", F.col("doc_id") % 3)
    return d.groupBy("lang").agg(F.round(avg(F.col("n_chars"), F.col("w")), 6).alias("avg"))


@query("""WITH u AS (SELECT conv_id, arg_max(turn, turn) AS turns, arg_max(len(text), turn) AS n FROM conversations GROUP BY 1)
 SELECT count(*) AS rows, round(avg(turns), 6) AS mean_turns, max(n)::BIGINT AS longest FROM u""")
def evaluate(t: Tables):
    from loomery.operators.metrics import evaluate as run

    rows = t.conversations.select("conv_id", "turn", F.length("text").alias("n"))
    return run(rows, "conv_id", "turn", {"rows": F.count("*"), "mean_turns": F.round(F.avg("turn"), 6), "longest": F.max("n").cast("long")})


@query("""SELECT round(sqrt(sum(p_retailprice * p_retailprice)), 4) AS p_retailprice_norm, min(p_size) AS p_size_min, max(p_size) AS p_size_max,
 count(*) FILTER (WHERE p_size > 20) AS big_true, count(*) FILTER (WHERE NOT p_size > 20) AS big_false FROM part""")
def typed_summary(t: Tables):
    out = R.summary(t.part.select("p_retailprice", "p_size", (F.col("p_size") > 20).alias("big")))
    return out.withColumn("p_retailprice_norm", F.round("p_retailprice_norm", 4))


@query("SELECT lang, source, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM documents GROUP BY 1, 2")
def group_shares(t: Tables):
    return R.group_shares(t.documents, ["lang", "source"]).withColumn("share", F.round("share", 9))


@query("""WITH m AS (SELECT user_id, event_id, value > 1e9 OR user_id % 2 = 0 AS mask FROM events), s AS (SELECT user_id, sum(mask::INT) AS s, count(*) AS n, arg_min(event_id, md5('0-' || event_id)) AS i FROM m GROUP BY 1)
 SELECT user_id, event_id, CASE WHEN (s = 0 OR s = n) AND event_id = i THEN NOT mask ELSE mask END AS mask FROM m JOIN s USING (user_id)""")
def safe_mask(t: Tables):
    m = t.events.select("user_id", "event_id", ((F.col("value") > 1e9) | (F.col("user_id") % 2 == 0)).alias("mask"))
    return R.safe_mask(m, "user_id", "event_id", "mask")


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1")
def sample_counts(t: Tables):
    return t.documents.groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) FILTER (WHERE n_chars < 200) AS n_failed, count(*) AS n FROM documents GROUP BY 1")
def failure_counts(t: Tables):
    from loomery.operators.metrics import failures

    rows = t.documents.withColumn("status", F.when(F.col("n_chars") < 200, "failed").otherwise("done"))
    return failures(rows, "source", "status")


@query("SELECT sum(n_chars)::BIGINT AS n, count(*) FILTER (WHERE lang = 'en') AS n_en FROM documents")
def element_counts(t: Tables):
    return t.documents.agg(F.sum("n_chars").alias("n"), F.count_if(F.col("lang") == "en").alias("n_en"))


@query("SELECT p_partkey, p_name FROM part ORDER BY p_retailprice * (1 - p_size / 100.0) DESC, p_partkey")
def rank_available(t: Tables):
    weight = F.col("p_retailprice") * (1 - F.col("p_size") / 100.0)
    return R.rank_available(t.part, weight, "p_partkey").select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def top_n(t: Tables):
    return R.top_n(t.orders, F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice")


@query("""SELECT o_custkey, o_orderkey, o_totalprice, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def topk_per_group(t: Tables):
    out = R.top_k_per_group(t.orders, ["o_custkey"], "o_totalprice", 3, ["o_orderkey"])
    return out.select("o_custkey", "o_orderkey", "o_totalprice", "rank")


@query("SELECT page_id, url FROM pages ORDER BY page_id LIMIT 12 OFFSET 24")
def page_of_rows(t: Tables):
    return R.page(t.pages.select("page_id", "url"), "page_id", 2, 12)


@query("SELECT event_id, ts FROM events ORDER BY ts, event_id")
def records_by_time(t: Tables):
    return t.events.select("event_id", "ts").orderBy("ts", "event_id")


@query("SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'es' AND n_chars > 3000)")
def missing_files(t: Tables):
    d = t.documents
    return R.missing_keys(d.select("source").distinct(), d.filter("lang = 'es' and n_chars > 3000"), "source")


@query("SELECT text AS word, min(doc_id) AS first FROM documents GROUP BY 1")
def ordered_distinct(t: Tables):
    return R.ordered_distinct(t.documents.select(F.col("text").alias("word"), "doc_id"), "word", "doc_id")


@query("SELECT c_custkey AS k, c_name AS name, NULL::DOUBLE AS bal FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def union_rows(t: Tables):
    a = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    b = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return R.union_all(a, b)


@query("SELECT doc_id, 'appeared' AS change FROM labels WHERE toxic = 1 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) UNION ALL SELECT doc_id, 'gone' FROM labels WHERE quality = 1 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def live_changes(t: Tables):
    new, old = R.appeared(t.labels.filter("quality = 1").select("doc_id"), t.labels.filter("toxic = 1").select("doc_id"), "doc_id")
    return new.withColumn("change", F.lit("appeared")).unionByName(old.withColumn("change", F.lit("gone")))


@query("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT o_custkey AS k FROM orders) a
 FULL JOIN (SELECT DISTINCT user_id AS k FROM events) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def symmetric_difference(t: Tables):
    return R.symmetric_difference(t.orders.select(F.col("o_custkey").alias("k")), t.events.select(F.col("user_id").alias("k")), "k")


@query("SELECT DISTINCT user_id FROM events")
def unique_ids(t: Tables):
    return t.events.select("user_id").distinct()


@query("SELECT event_id, (props::JSON->>'$.k')::INT AS k FROM events")
def json_unnest(t: Tables):
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""WITH w AS (SELECT word, min(o) AS ord FROM (SELECT unnest(string_split(p_name, ' ')) AS word, p_partkey AS o FROM part) GROUP BY 1)
 SELECT word, (ord + 2)::BIGINT AS id, CASE WHEN len(word) > 4 THEN [len(word)::FLOAT, 1::FLOAT] ELSE [0::FLOAT, 0::FLOAT] END AS vector FROM w
 UNION ALL SELECT '<pad>', 0, [0::FLOAT, 0::FLOAT] UNION ALL SELECT '<unk>', 1, [0::FLOAT, 0::FLOAT]""")
def restricted_vocabulary(t: Tables):
    w = t.part.select(F.explode(F.split("p_name", " ")).alias("word"), F.col("p_partkey").alias("o"))
    words = w.groupBy("word").agg(F.min("o").alias("ord"))
    vectors = words.filter(F.length("word") > 4).select("word", F.array(F.length("word").cast("float"), F.lit(1.0).cast("float")).alias("vector"))
    return R.restrict_vocabulary(words, vectors)


@query("SELECT conv_id, turn, role, text FROM conversations WHERE (conv_id, turn) IN (SELECT (conv_id, max(turn)) FROM conversations GROUP BY conv_id)")
def last_turns(t: Tables):
    return R.last_by_key(t.conversations.withColumn("o", F.col("turn")), ["conv_id"], "o").drop("o").select("conv_id", "turn", "role", "text")
