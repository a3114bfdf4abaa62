"""Queries of windows, resampling, padding and running totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.functions.numeric import rounded
from loomery.operators import metrics as M
from loomery.operators import ordering as O
from loomery.operators import sequence as S
from loomery.plans.registry import Tables, query

W20 = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query(f"SELECT event_id, quantile_disc(value, 0.5) OVER {W20} AS median, round(avg(value) OVER {W20}, 6) AS avg, max(value) OVER {W20} AS max, value AS last FROM events")
def smoothed_value(t: Tables):
    out = M.smoothed(t.events, ["user_id"], ["ts", "event_id"], "value")
    return out.select("event_id", "median", F.round("avg", 6).alias("avg"), "max", "last")


@query("""SELECT event_id, total::BIGINT AS total, count, round(total::DOUBLE / count * (1000 - count), 3) AS eta FROM (SELECT event_id,
 sum(cents) OVER w AS total, count(cents) OVER w AS count FROM (SELECT *, round(value * 100)::BIGINT AS cents FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))""")
def running_totals(t: Tables):
    e = t.events.withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    out = M.running(e, ["user_id"], ["ts", "event_id"], "cents", 1000)
    return out.select("event_id", "total", "count", F.round("eta", 3).alias("eta"))


@query(f"""SELECT event_id, step::INT AS step, median, round(total, 4) AS total FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step,
 quantile_disc(value, 0.5) OVER {W20} AS median, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total, count(*) OVER (PARTITION BY user_id) AS n FROM events)
 WHERE step % 10 = 0 OR step = n - 1""")
def log_every(t: Tables):
    out = M.log_every(t.events, ["user_id"], ["ts", "event_id"], "value", 10)
    return out.select("event_id", "step", "median", F.round("total", 4).alias("total"))


@query("SELECT source, (sum(n) OVER (ORDER BY source) - n)::BIGINT AS lo, sum(n) OVER (ORDER BY source)::BIGINT AS hi FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def length_ranges(t: Tables):
    n = t.documents.groupBy("source").agg(F.count("*").alias("n"))
    return O.lengths_to_ranges(n, "source", "n").select("source", "lo", "hi")


@query("""SELECT doc_id FROM (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id DESC) AS total, row_number() OVER (ORDER BY doc_id DESC) AS r FROM documents) WHERE total < 100000 AND r <= 1000""")
def retention_plan(t: Tables):
    return O.keep_recent(t.documents.select("doc_id", "n_chars"), [F.desc("doc_id")], "n_chars", 100000, 1000).select("doc_id")


ROUND = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), b AS (SELECT vec_id, x, i, least(round_even(i / 10.0 * 64, 0), 63)::INT AS lo,
 greatest(least(round_even((i + 1) / 10.0 * 64, 0), 63), least(round_even(i / 10.0 * 64, 0), 63) + 1)::INT AS hi FROM e, range(10) r(i))"""


@query(f"{ROUND} SELECT vec_id, list(round(list_avg(list_slice(x, lo + 1, hi)), 6) ORDER BY i) AS avgs, list(round(list_max(list_slice(x, lo + 1, hi)), 6) ORDER BY i) AS maxs, list(round(x[hi], 6) ORDER BY i) AS tails, list(round(x[lo + (hi - lo) // 2 + 1], 6) ORDER BY i) AS centers FROM b GROUP BY 1")
def segment_round(t: Tables):
    x = F.col("embedding").cast("array<double>")
    made = {k: S.resample_round(x, 10, m) for k, m in (("avgs", "avgpool"), ("maxs", "maxpool"), ("tails", "tail"), ("centers", "center"))}
    return t.embeddings.select("vec_id", *[F.transform(c, lambda v: rounded(v, 6)).alias(k) for k, c in made.items()])


@query("SELECT vec_id, list_transform(range(12), lambda i: round(list_avg(list_slice(list_transform(embedding, lambda v: v::DOUBLE), i * 5 + 1, i * 5 + 5)), 6)) AS avgs FROM embeddings")
def segment_stride(t: Tables):
    x = F.col("embedding").cast("array<double>")
    return t.embeddings.select("vec_id", F.transform(S.resample_stride(x, 5), lambda v: rounded(v, 6)).alias("avgs"))


@query("""WITH p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events)
 SELECT user_id, pos // 4 AS segment, round(avg(value), 6) AS value FROM p WHERE pos // 4 < ceil(n / 4.0) - 1 GROUP BY 1, 2""")
def stride_rows(t: Tables):
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    out = S.stride_rows(t.events.withColumn("pos", pos), ["user_id"], "pos", "value", 4)
    return out.withColumn("value", F.round("value", 6))


@query("""SELECT conv_id, turns || list_transform(range(12 - len(turns)), lambda i: -1::BIGINT) AS padded, list_transform(range(12 - len(turns)), lambda i: turns[-1]) || turns AS left_last FROM (SELECT conv_id, list(turn ORDER BY turn) AS turns FROM conversations GROUP BY 1)""")
def pad_arrays(t: Tables):
    c = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    n = F.lit(12)
    left = F.concat(F.array_repeat(F.get("turns", F.size("turns") - 1), n - F.size("turns")), "turns")
    return c.select("conv_id", S.pad(F.col("turns"), n, F.lit(-1).cast("long")).alias("padded"), left.alias("left_last"))


@query("""WITH c AS (SELECT conv_id, list(turn ORDER BY turn) AS turns FROM conversations GROUP BY 1), m AS (SELECT *, max(len(turns)) OVER (PARTITION BY conv_id % 9) AS n FROM c)
 SELECT conv_id, turns || list_transform(range(n - len(turns)), lambda i: 0::BIGINT) AS turns, list_transform(range(n), lambda i: i >= len(turns)) AS mask, len(turns)::INT AS duration FROM m""")
def nested_batch(t: Tables):
    c = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns")).withColumn("b", F.col("conv_id") % 9)
    return S.pad_batch(c, "turns", ["b"], F.lit(0).cast("long")).drop("b")


@query("SELECT vec_id, list_transform(list_filter(range(64), lambda i: i >= 2 AND (i - 2) % 7 = 0), lambda i: embedding[i + 1]::DOUBLE) AS x, list_transform(embedding[4:8], lambda v: v::DOUBLE) AS s FROM embeddings")
def subsample(t: Tables):
    x = F.col("embedding").cast("array<double>")
    return t.embeddings.select("vec_id", S.subsample(x, 7, 2).alias("x"), S.slice_array(x, 3, 8).alias("s"))


@query("SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INT AS pos, unnest(embedding)::DOUBLE AS value FROM embeddings")
def flatten_arrays(t: Tables):
    e = t.embeddings.withColumn("x", F.col("embedding").cast("array<double>"))
    return S.unstack(e, "x", ["vec_id"])


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents), n AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY p) AS b FROM l WHERE trim(line) <> '')
 SELECT doc_id, (p - 1)::INT AS pos, md5(line) AS h FROM n WHERE b IS DISTINCT FROM line""")
def dedupe_lines(t: Tables):
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return S.dedupe_lines(rows, ["doc_id"], "pos", "line").select("doc_id", "pos", F.md5("line").alias("h"))


@query("""WITH s AS (SELECT conv_id, turn * 2 AS st, turn * 2 + (CASE WHEN turn % 3 = 1 THEN 1 ELSE 2 END) AS ed FROM conversations), p AS (SELECT *, coalesce(lag(ed) OVER (PARTITION BY conv_id ORDER BY st, ed) = st, false) AS j FROM s)
 SELECT conv_id, st AS segment, 0 AS k, CASE WHEN j THEN ed ELSE st END AS "at" FROM p UNION ALL SELECT conv_id, st, 1, ed FROM p WHERE NOT j""")
def segment_borders(t: Tables):
    s = t.conversations.select(
        "conv_id", (F.col("turn") * 2).alias("st"), (F.col("turn") * 2 + F.when(F.col("turn") % 3 == 1, 1).otherwise(2)).alias("ed")
    )
    return S.boundaries(s, "conv_id", "st", "ed")
