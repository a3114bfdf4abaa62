"""Cluster telemetry as JSON text: nested records to GPU, process and user rows (files only; nothing is executed)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.functions.text import zero_padded

SCHEMA = (
    "hostname string, gpus array<struct<index:int, name:string, `utilization.gpu`:int, `memory.total`:bigint, `memory.used`:bigint, "
    "processes:array<struct<pid:bigint, username:string, gpu_memory_usage:bigint, full_command:array<string>>>>>, "
    "system struct<cpu_count:int, cpu_percent:double, vmem_used:bigint, vmem_total:bigint, user_cpu_percent:map<string,double>>"
)


def parsed(raw: DataFrame, node: str, text: str) -> DataFrame:
    """(node, r): each node's record; text that is no JSON gives a null record."""
    return raw.select(node, F.from_json(text, SCHEMA).alias("r"))


def gpu_rows(records: DataFrame, node: str) -> DataFrame:
    """A row per GPU."""
    g = records.select(node, F.explode_outer("r.gpus").alias("g"))
    return g.select(
        node,
        F.col("g.index").alias("gpu"),
        F.col("g.name").alias("gpu_name"),
        F.col("g")["utilization.gpu"].alias("util"),
        F.col("g")["memory.total"].alias("mem_total"),
        F.col("g")["memory.used"].alias("mem_used"),
        F.col("g.processes").alias("processes"),
    )


def process_rows(records: DataFrame, node: str) -> DataFrame:
    """A row per process; the command's first 30 characters."""
    p = gpu_rows(records, node).select(node, "gpu", F.explode("processes").alias("p"))
    return p.select(
        node,
        "gpu",
        F.col("p.pid").alias("pid"),
        F.col("p.username").alias("user"),
        F.col("p.gpu_memory_usage").alias("gpu_mem"),
        F.substring(F.array_join("p.full_command", " "), 1, 30).alias("command"),
    )


def node_summary(records: DataFrame, node: str) -> DataFrame:
    """Per node the first GPU's name, their number, free memory as text, utilisation and users."""
    g = gpu_rows(records, node)
    users = process_rows(records, node).groupBy(node).agg(F.array_join(F.sort_array(F.collect_set("user")), ", ").alias("users"))
    free = F.transform(
        F.array_sort(F.collect_list(F.struct("gpu", (F.col("mem_total") - F.col("mem_used")).alias("f")))),
        lambda x: zero_padded(x["f"], 5),
    )
    s = g.groupBy(node).agg(
        F.min_by("gpu_name", "gpu").alias("gpu_name"), F.count("gpu").alias("n_gpus"), F.array_join(free, "|").alias("free"), F.avg("util").alias("util")
    )
    return s.join(users, node, "left")


def user_memory(records: DataFrame, node: str) -> DataFrame:
    """GPU memory per user."""
    return process_rows(records, node).groupBy("user").agg(F.sum("gpu_mem").alias("gpu_mem"))


def user_activity(records: DataFrame, node: str, least: float = 100) -> DataFrame:
    """CPU and GPU memory per user, active users only."""
    cpu = records.select(F.explode("r.system.user_cpu_percent").alias("user", "cpu")).groupBy("user").agg(F.sum("cpu").alias("cpu"))
    out = cpu.join(user_memory(records, node), "user", "left").withColumn("gpu_mem", F.coalesce("gpu_mem", F.lit(0).cast("long")))
    return out.filter((F.col("cpu") > least) | (F.col("gpu_mem") > 0))
