"""Queries of shard tables and sample indexes. Documents stand for members: source is the shard, doc_id the order."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.plans.registry import Tables, query
from loomery.sources import files, tars, telemetry
from loomery.sources.shared import fresh_path, written


def _members(t: Tables):
    d = t.documents
    name = F.concat(F.lit("d/"), F.floor(F.col("doc_id") / 2).cast("string"), F.when(F.col("doc_id") % 2 == 0, ".txt").otherwise(".meta.json"))
    return d.select(F.col("source").alias("shard"), F.col("doc_id").alias("pos"), name.alias("name"), F.col("n_chars").alias("size"), F.encode("lang", "UTF-8").alias("data"))


MEMBERS = "(SELECT source AS shard, doc_id AS pos, 'd/' || (doc_id // 2) AS key, CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '.meta.json' END AS ext, n_chars AS size, lang FROM documents)"


@query(f"SELECT shard, row_number() OVER (PARTITION BY shard ORDER BY f) - 1 AS inner_idx, key, exts, texts FROM (SELECT shard, key, min(pos) AS f, list(ext ORDER BY ext) AS exts, list(lang ORDER BY ext) AS texts FROM {MEMBERS} GROUP BY 1, 2)")
def grouped_samples(t: Tables):
    s = tars.samples(_members(t))
    return s.select("shard", "inner_idx", "key", F.map_keys("files").alias("exts"), F.transform(F.map_values("files"), tars.decode_text).alias("texts"))


@query(f"""WITH s AS (SELECT shard, key, min(pos) AS f FROM {MEMBERS} GROUP BY 1, 2) SELECT shard, key, row_number() OVER (ORDER BY shard, f) - 1 AS idx FROM s""")
def global_samples(t: Tables):
    return tars.global_index(tars.samples(_members(t))).select("shard", "key", "idx")


@query(f"""WITH s AS (SELECT shard, key, min(pos) AS f FROM {MEMBERS} GROUP BY 1, 2) SELECT shard, key, idx FROM (SELECT shard, key, row_number() OVER (ORDER BY shard, f) - 1 AS idx FROM s) WHERE idx = 33""")
def sample_at(t: Tables):
    return tars.sample_at(tars.global_index(tars.samples(_members(t))), 33).select("shard", "key", "idx")


@query(f"SELECT shard, key, min(pos) AS first FROM {MEMBERS} GROUP BY 1, 2")
def shard_keys(t: Tables):
    return tars.shard_keys(_members(t))


@query(f"""WITH k AS (SELECT shard, key, min(pos) AS f FROM {MEMBERS} GROUP BY 1, 2), r AS (SELECT shard, key, (row_number() OVER (PARTITION BY shard ORDER BY f) - 1)::INT AS i FROM k)
 SELECT shard, list(i ORDER BY i) AS inner, count(*) AS n FROM r WHERE key IN (SELECT 'd/' || (doc_id // 2) FROM labels) GROUP BY 1""")
def shard_meta(t: Tables):
    include = t.labels.select(F.concat(F.lit("d/"), F.floor(F.col("doc_id") / 2).cast("string")).alias("key"))
    return tars.shard_meta(_members(t), include)


SHARDS = "(SELECT 'http://h/' || source || '.tar' AS url, md5(source) AS md5sum, count(*) AS nsamples, sum(n_chars)::BIGINT AS filesize FROM documents GROUP BY source)"


def _shards(t: Tables):
    g = t.documents.groupBy("source").agg(F.count("*").alias("nsamples"), F.sum("n_chars").alias("filesize"))
    return g.select(F.concat(F.lit("http://h/"), "source", F.lit(".tar")).alias("url"), F.md5("source").alias("md5sum"), "nsamples", "filesize")


@query(f"""SELECT count(*) AS n_shards, sum(nsamples)::BIGINT AS total_samples, sum(filesize)::BIGINT AS total_size, (sum(filesize) // count(*))::BIGINT AS mean_size, (sum(nsamples) // count(*))::BIGINT AS mean_samples,
 min(url) AS first_url, max(url) AS last_url FROM {SHARDS}""")
def shard_info(t: Tables):
    return tars.shard_info(_shards(t))


@query(f"SELECT 's3://b/x/' || regexp_extract(url, '([^/]*)$', 1) AS url, md5sum, nsamples, filesize FROM {SHARDS}")
def shard_update(t: Tables):
    return tars.update_shards(_shards(t), "s3://b/x/", keep_dir=False)


@query("SELECT lang AS dataset, 1.0::DOUBLE AS weight, 'base/' || lang || '/' || doc_id || '.tar' AS url, n_chars AS nsamples FROM documents")
def resolved_datasets(t: Tables):
    spec = t.documents.groupBy(F.col("lang").alias("name")).agg(
        F.collect_list(F.struct(F.concat(F.col("doc_id").cast("string"), F.lit(".tar")).alias("url"), F.col("n_chars").alias("nsamples"))).alias("shardlist")
    )
    return tars.resolve_datasets(spec.withColumns({"weight": F.lit(None).cast("double"), "base": F.concat(F.lit("base/"), "name", F.lit("/"))}))


@query("SELECT source, doc_id, ordinal FROM (SELECT source, doc_id, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS ordinal FROM documents) WHERE lang = 'de'")
def matching_rows(t: Tables):
    return tars.matching_rows(t.documents, "source", "doc_id", F.col("lang") == "de").select("source", "doc_id", "ordinal")


@query("SELECT doc_id, ((sum(n_chars) OVER (ORDER BY doc_id) - n_chars) // 50000)::BIGINT AS tar FROM documents")
def tar_plan(t: Tables):
    return tars.tar_plan(t.documents.select("doc_id", "n_chars"), "doc_id", "n_chars", 50000).select("doc_id", "tar")


@query("SELECT n_nationkey, 'p' || n_regionkey AS part FROM nation WHERE n_regionkey <> 3")
def node_lines(t: Tables):
    k = F.col("n_nationkey")
    line = F.format_string("node=%d partition=p%d gpu_type=%s", k, F.col("n_regionkey"), F.when(F.col("n_regionkey") == 3, "").otherwise("x"))
    return tars.node_lines(t.nation.select(line.alias("line"))).select(F.col("m")["node"].cast("int").alias("n_nationkey"), F.col("m")["partition"].alias("part"))


@query(r"SELECT url FROM (SELECT 'data/' || page_id || CASE WHEN page_id % 2 = 0 THEN '.tar' ELSE '.json' END AS url FROM pages) WHERE url LIKE 'data/1%.tar' ORDER BY url")
def listed_files(t: Tables):
    u = F.concat(F.lit("data/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ".tar").otherwise(".json"))
    return tars.listed_files(t.pages.select(u.alias("url")), "url", "data/1*.tar")


def _records(t: Tables):
    """One telemetry record a user: a GPU an event type, a process an event."""
    g = t.events.groupBy("user_id", "event_type").agg(
        F.array_sort(F.collect_list(F.struct(F.col("event_id").alias("pid"), F.concat(F.lit("u"), (F.col("event_id") % 7).cast("string")).alias("username"), F.length("props").cast("long").alias("gpu_memory_usage"), F.array(F.lit("python"), F.col("event_type")).alias("full_command")))).alias("processes")
    )
    gpu = F.struct(
        F.length("event_type").alias("index"), F.col("event_type").alias("name"), F.size("processes").alias("utilization.gpu"),
        F.lit(1000).cast("long").alias("memory.total"), F.size("processes").cast("long").alias("memory.used"), "processes",
    )
    n = g.groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(gpu).alias("gpus"))).alias("raw"))
    return telemetry.parsed(n, "user_id", "raw")


@query("SELECT user_id, event_type AS gpu_name, count(*)::INT AS util, (1000 - count(*))::BIGINT AS free FROM events GROUP BY 1, 2")
def telemetry_gpus(t: Tables):
    return telemetry.gpu_rows(_records(t), "user_id").select("user_id", "gpu_name", "util", (F.col("mem_total") - F.col("mem_used")).alias("free"))


@query("SELECT 'u' || (event_id % 7) AS user, sum(len(props))::BIGINT AS gpu_mem FROM events GROUP BY 1")
def telemetry_users(t: Tables):
    return telemetry.user_memory(_records(t), "user_id")


@query("""SELECT user_id, count(DISTINCT event_type) AS n_gpus, string_agg(DISTINCT 'u' || (event_id % 7), ', ' ORDER BY 'u' || (event_id % 7)) AS users FROM events GROUP BY 1""")
def telemetry_nodes(t: Tables):
    return telemetry.node_summary(_records(t), "user_id").select("user_id", "n_gpus", "users")


@query("SELECT event_id AS pid, 'u' || (event_id % 7) AS user, 'python ' || event_type AS command FROM events")
def telemetry_processes(t: Tables):
    return telemetry.process_rows(_records(t), "user_id").select("pid", "user", "command")


@query("""SELECT user, cpu, gpu_mem FROM (SELECT 'u' || (event_id % 7) AS user, sum(event_id % 50)::DOUBLE AS cpu, sum(len(props))::BIGINT AS gpu_mem FROM events GROUP BY 1) WHERE cpu > 100 OR gpu_mem > 0""")
def telemetry_activity(t: Tables):
    cpu = t.events.groupBy("user_id", F.concat(F.lit("u"), (F.col("event_id") % 7).cast("string")).alias("u")).agg(F.sum(F.col("event_id") % 50).cast("double").alias("c"))
    usage = cpu.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("u", "c"))).alias("m"))
    r = _records(t).join(usage, "user_id").withColumn("r", F.col("r").withField("system", F.struct(F.col("m").alias("user_cpu_percent"))))
    return telemetry.user_activity(r, "user_id")


#: Text bytes of a tar in the file-backed queries.
TAR_BYTES = 200_000
IN_TARS = f"""(SELECT doc_id, lang, coalesce(text, '') AS text, ((sum(strlen(coalesce(text, ''))) OVER (ORDER BY doc_id) - strlen(coalesce(text, ''))) // {TAR_BYTES})::BIGINT AS tar FROM documents)"""


def _tars(t: Tables) -> str:
    """Documents as tar files, a text and a language member each; the folder."""
    d = t.documents.select("doc_id", "lang", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    plan = tars.tar_plan(d.withColumn("size", F.octet_length("text")), "doc_id", "size", TAR_BYTES)
    both = F.array(F.struct(F.lit(".lang").alias("ext"), F.encode("lang", "UTF-8").alias("data")), F.struct(F.lit(".txt").alias("ext"), F.col("text").alias("data")))
    rows = plan.select("tar", "doc_id", F.explode(both).alias("m")).select("tar", "doc_id", F.concat(F.lit("d/"), "doc_id", "m.ext").alias("name"), "m.data")
    folder = fresh_path(t.spark, "tars")
    written(tars.write_tars(rows, folder, ["doc_id", "name"]), "tar-list")
    return folder


def _number():
    return F.regexp_extract("shard", r"(\d+)\.tar$", 1).cast("long").alias("tar")


@query(f"""WITH m AS (SELECT tar, doc_id, unnest(['.lang', '.txt']) AS ext, unnest([lang, text]) AS data FROM {IN_TARS})
 SELECT tar, row_number() OVER (PARTITION BY tar ORDER BY doc_id, ext) - 1 AS pos, 'd/' || doc_id || ext AS name, strlen(data) AS size, md5(data) AS md5sum FROM m""")
def tar_members(t: Tables):
    """Members of tar files, read by their offsets."""
    return tars.members(t.spark, _tars(t)).select(_number(), "pos", "name", "size", F.md5("data").alias("md5sum"))


@query(f"""SELECT 'd/' || doc_id AS key, row_number() OVER (ORDER BY doc_id) - 1 AS idx, row_number() OVER (PARTITION BY tar ORDER BY doc_id) - 1 AS inner_idx, tar, lang, md5(text) AS md5sum FROM {IN_TARS}""")
def tar_samples(t: Tables):
    """Every sample of a list of tar files by its global index."""
    s = tars.global_index(tars.samples(tars.members(t.spark, _tars(t))))
    return s.select("key", "idx", "inner_idx", _number(), tars.decode_text(F.col("files")[".lang"]).alias("lang"), F.md5(F.col("files")[".txt"]).alias("md5sum"))


@query(f"""WITH b AS (SELECT tar, count(*) AS nsamples, sum(1024 + 512 * (ceil(strlen(lang) / 512.0) + ceil(strlen(text) / 512.0)))::BIGINT + 1024 AS n FROM {IN_TARS} GROUP BY 1)
 SELECT tar, nsamples, (ceil(n / 10240.0) * 10240)::BIGINT AS filesize, true AS verified FROM b""")
def tar_shards(t: Tables):
    """The shard list of tar files, and that it verifies."""
    folder = _tars(t)
    table = written(tars.shard_table(t.spark, folder), "shards")
    wrong = tars.verified(table, table.withColumn("md5sum", F.upper("md5sum"))).select("url")
    right = table.join(wrong, "url", "left").join(tars.verified(table, table).select(F.col("url").alias("bad")), F.col("url") == F.col("bad"), "left")
    return right.select(F.regexp_extract("url", r"(\d+)\.tar$", 1).cast("long").alias("tar"), "nsamples", "filesize", F.col("bad").isNull().alias("verified"))


@query("SELECT item_id, text FROM benchmark")
def jsonl_round_trip(t: Tables):
    """S01, S02."""
    path = fresh_path(t.spark, "jsonl")
    files.write_jsonl(t.benchmark, path)
    return files.read_jsonl(t.spark, path, t.benchmark.schema)


@query("SELECT item_id, text, CASE WHEN item_id % 3 = 0 THEN ' a,\"b\" ' END AS odd FROM benchmark")
def csv_round_trip(t: Tables):
    """Line ends, separators, quotes, nulls and outer white space come back."""
    path = fresh_path(t.spark, "csv")
    rows = t.benchmark.select("item_id", "text", F.when(F.col("item_id") % 3 == 0, ' a,"b" ').alias("odd"))
    files.write_csv(rows, path)
    return files.read_csv(t.spark, path, rows.schema, encoding=files.fitting_encoding(t.spark, path))


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1")
def cached_result(t: Tables):
    """Made once, then read from where it was kept."""
    from loomery.sources.shared import cached_table

    path = fresh_path(t.spark, "cached")
    cached_table(t.spark, path, lambda: t.documents.groupBy("source").agg(F.count("*").alias("n")))
    return cached_table(t.spark, path, lambda: t.documents.limit(0).groupBy("source").agg(F.count("*").alias("n")))
