"""Queries of shuffles, splits, mixes and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.operators import sampling as S
from loomery.operators.ordering import group_position, with_position
from loomery.plans.registry import Tables, query

H = "md5('{0}-{1}-{2}-' || {3})"


@query(f"SELECT o_orderkey, (o_orderkey // 500)::BIGINT AS chunk, row_number() OVER (ORDER BY {H.format(7, 1, 'chunk', '(o_orderkey // 500)')}, {H.format(7, 1, 'id', 'o_orderkey')}, o_orderkey) - 1 AS pos FROM orders")
def chunk_shuffle(t: Tables):
    o = t.orders.select("o_orderkey", S.fixed_chunks(F.col("o_orderkey"), 500).alias("chunk"))
    return S.chunk_shuffle(o, "chunk", "o_orderkey", seed=7, epoch=1)


@query(f"SELECT source, doc_id, row_number() OVER (ORDER BY source, {H.format(0, 0, 'id', 'doc_id')}, doc_id) - 1 AS pos FROM documents")
def shard_list_order(t: Tables):
    return S.chunk_shuffle(t.documents.select("source", "doc_id"), "source", "doc_id", shuffle_chunks=False)


@query("SELECT o_orderkey, pos FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) WHERE pos > 700")
def resume_cursor(t: Tables):
    return S.resume(with_position(t.orders.select("o_orderkey"), ["o_orderkey"]), 700)


@query("SELECT n_nationkey, (n_nationkey // 4)::BIGINT AS grp FROM nation")
def shard_groups(t: Tables):
    return t.nation.select("n_nationkey", S.shard_groups(F.col("n_nationkey"), 4).alias("grp"))


@query("SELECT floor(20 * avg(n))::BIGINT AS chunk_size FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def estimate_chunk(t: Tables):
    return S.estimate_chunk_size(t.documents.groupBy("source").agg(F.count("*").alias("n")), "n", 20)


@query("""WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos, count(*) OVER () AS n FROM customer), s AS (SELECT *, ceil(n / 7.0)::BIGINT AS per FROM p),
 x AS (SELECT c_custkey, pos AS slot, per FROM s UNION ALL SELECT c_custkey, pos + n, per FROM s WHERE pos < per * 7 - n) SELECT c_custkey, (slot // per)::BIGINT AS rank, (slot % per)::BIGINT AS slot FROM x""")
def rank_block(t: Tables):
    p = with_position(t.customer.select("c_custkey"), ["c_custkey"])
    return S.rank_block(p, "pos", t.customer.count(), 7).drop("pos")


@query("SELECT c_custkey, (pos % 6)::BIGINT AS rank, (pos // 6)::BIGINT AS slot FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer)")
def rank_stride(t: Tables):
    return S.rank_stride(with_position(t.customer.select("c_custkey"), ["c_custkey"]), "pos", 6).drop("pos")


@query("SELECT doc_id, ntile(7) OVER (ORDER BY doc_id) - 1 AS rank FROM documents")
def rank_ntile(t: Tables):
    p = with_position(t.documents.select("doc_id"), ["doc_id"])
    return S.rank_split(p, "pos", t.documents.count(), 7).drop("pos")


@query("SELECT doc_id, lang, count(*) OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k FROM documents")
def source_positions(t: Tables):
    """Each source keeps its own order in the interleaved schedule (the schedule itself has no SQL)."""
    mixed = S.interleave(t.documents.select("doc_id", "lang"), "lang", "doc_id")
    return group_position(mixed, "lang", ["step"], "k").select("doc_id", "lang", "k")


@query("""WITH s AS (SELECT lang, count(*) AS n, CASE lang WHEN 'en' THEN 2.0 ELSE 1.0 END AS w FROM documents GROUP BY 1), c AS (SELECT *, (sum(w) OVER (ORDER BY lang) - w) / sum(w) OVER () AS lo, sum(w) OVER (ORDER BY lang) / sum(w) OVER () AS hi FROM s),
 d AS (SELECT range AS draw, ('0x' || substr(md5('3-0-source-' || range), 1, 12))::BIGINT / 281474976710656.0 AS u, ('0x' || substr(md5('3-0-row-' || range), 1, 12))::BIGINT / 281474976710656.0 AS v FROM range(2000))
 SELECT draw, lang, least(floor(v * n)::BIGINT, n - 1) AS row FROM d JOIN c ON u >= lo AND u < hi""")
def weighted_draws(t: Tables):
    s = t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.max(F.when(F.col("lang") == "en", 2.0).otherwise(1.0)).alias("w"))
    return S.weighted_draws(s, "lang", "n", "w", 2000, seed=3)


@query(f"""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {H.format(5, 0, '', 'doc_id')}) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n, CASE lang WHEN 'en' THEN 4 ELSE 1 END AS q FROM documents WHERE lang IN ('en', 'fr')),
 x AS (SELECT doc_id, lang, q, unnest(range(k, q * 50, n)) AS spot FROM r) SELECT doc_id, lang, (spot // q)::BIGINT AS batch, (spot % q)::BIGINT AS slot FROM x""")
def source_mix(t: Tables):
    d = t.documents.select("doc_id", "lang")
    q = dict(zip(["en", "fr"], S.quotas(5, [4, 1]), strict=True))
    return S.source_batches(d, "lang", S.hash_order(F.col("doc_id"), 5), q, 50)


@query("""WITH r AS (SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 8 AS b FROM documents), g AS (SELECT lang, b, min(doc_id) AS f, count(*) AS n FROM r GROUP BY 1, 2),
 o AS (SELECT lang, b, row_number() OVER (ORDER BY f, lang) - 1 AS batch FROM g WHERE n = 8) SELECT doc_id, lang, batch FROM r JOIN o USING (lang, b)""")
def grouped_batches(t: Tables):
    return S.grouped_batches(t.documents.select("doc_id", "lang"), "lang", "doc_id", 8, drop_uneven=True)


@query("SELECT n_nationkey, unnest(range(n_nationkey, 120, 25)) AS step FROM nation")
def iteration_cycle(t: Tables):
    n = t.nation.select("n_nationkey", F.col("n_nationkey").cast("long").alias("pos"))
    return S.cycle(n, "pos", 25, 120).drop("pos")


@query("""SELECT o_orderkey, CASE WHEN u < 0.25 THEN 'a' WHEN u < 0.75 THEN 'b' ELSE 'c' END AS src FROM (SELECT o_orderkey, ('0x' || substr(md5('0-0-loader-' || o_orderkey), 1, 12))::BIGINT / 281474976710656.0 AS u FROM orders)""")
def choose_source(t: Tables):
    return t.orders.select("o_orderkey", S.choose_source(F.col("o_orderkey"), {"a": 1, "b": 2, "c": 1}).alias("src"))


@query("WITH c AS (SELECT conv_id, list(turn ORDER BY turn) AS a, list(role ORDER BY turn) AS b FROM conversations GROUP BY 1) SELECT conv_id, (generate_subscripts(a, 1) - 1)::INT AS pos, unnest(a) AS turns, unnest(b) AS roles FROM c")
def flatten_lists(t: Tables):
    c = S.collate(t.conversations, "conv_id", "turn", ["turn", "role"]).withColumnsRenamed({"turn": "turns", "role": "roles"})
    return S.flatten_lists(c, ["turns", "roles"], "conv_id")


@query("SELECT (pos // 16)::BIGINT AS batch, list(doc_id ORDER BY doc_id) AS doc_id, list(lang ORDER BY doc_id) AS lang FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) GROUP BY 1")
def collated_batches(t: Tables):
    p = with_position(t.documents.select("doc_id", "lang"), ["doc_id"])
    return S.collate(p.withColumn("batch", S.fixed_chunks(F.col("pos"), 16)), "batch", "doc_id", ["doc_id", "lang"])


@query()
def random_fixtures(t: Tables):
    spans = S.random_spans(t.spark, 100, 30.0)
    return spans.join(S.random_boxes(t.spark, 100, 64, 48), "id")
