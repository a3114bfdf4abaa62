"""Tar shards: members, grouped samples, decoding, packing and the shard table."""

from __future__ import annotations

import io
import re
import tarfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.functions.text import SAMPLE_NAME, split_name
from loomery.functions.urls import url_file
from loomery.operators.ordering import group_position, lengths_to_ranges, with_prefix
from loomery.sources.files import read_binary
from loomery.sources.shared import partitions

MEMBERS = "shard string, pos long, name string, size long, data binary"


#: Bytes of a tar that one task reads, and of members that it hands over at a time.
READ_BYTES, YIELD_BYTES = 256_000_000, 32_000_000
INDEX = "shard string, pos long, name string, offset long, size long"


def _file(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", uri))


def _headers(uri: str) -> list[tuple]:
    """(shard, pos, name, offset, size) of the regular files of a tar; their contents are skipped by seeking."""
    files, name = _file(uri)
    rows = []
    with files.open_input_file(name) as f, tarfile.open(fileobj=f, mode="r:") as t:
        for m in t:
            if m.isfile():
                rows.append((uri, len(rows), m.name, m.offset_data, m.size))
            t.members = []  # tarfile keeps all it has seen
    return rows


def tar_index(spark: SparkSession, path: str, glob: str = "*.tar") -> DataFrame:
    """Where each regular file of each (uncompressed) tar is. Headers alone are read."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for uri in b["path"]:
                yield pd.DataFrame(_headers(uri), columns=["shard", "pos", "name", "offset", "size"])

    return read_binary(spark, path, glob).select("path").mapInPandas(load, INDEX)


def members(spark: SparkSession, path: str, glob: str = "*.tar", data: bool = True) -> DataFrame:
    """Regular files of each tar in order; ``data=False`` gives the index alone.

    Contents are read by their offsets, stretches of a tar in different tasks, so a tar may be of any size. Compressed
    tars have no offsets and are read whole.
    """
    if not glob.endswith(".tar"):
        return _whole(spark, path, glob, data)
    index = tar_index(spark, path, glob)
    if not data:
        return index.select("shard", "pos", "name", "size", F.lit(None).cast("binary").alias("data"))

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for uri, rows in b.sort_values(["shard", "offset"]).groupby("shard", sort=False):
                files, name = _file(uri)
                with files.open_input_file(name) as f:
                    out, held = [], 0
                    for r in rows.itertuples(index=False):
                        f.seek(r.offset)
                        out.append((uri, r.pos, r.name, r.size, f.read(r.size)))
                        held += r.size
                        if held > YIELD_BYTES:
                            yield pd.DataFrame(out, columns=["shard", "pos", "name", "size", "data"])
                            out, held = [], 0
                    yield pd.DataFrame(out, columns=["shard", "pos", "name", "size", "data"])

    dealt = index.repartition(partitions(spark), "shard", F.floor(F.col("offset") / READ_BYTES))
    return dealt.mapInPandas(load, MEMBERS)


def _whole(spark: SparkSession, path: str, glob: str, data: bool) -> DataFrame:
    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, content in zip(b["path"], b["content"], strict=True):
                rows = []
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as t:
                    for m in t:
                        if m.isfile():
                            rows.append((shard, len(rows), m.name, m.size, t.extractfile(m).read() if data else None))
                yield pd.DataFrame(rows, columns=["shard", "pos", "name", "size", "data"])

    return read_binary(spark, path, glob).select("path", "content").mapInPandas(load, MEMBERS)


def keyed(files: DataFrame) -> DataFrame:
    """members with their key (name to the first dot) and extension (dot kept); names without a dot go."""
    out = files.withColumn("_n", split_name(F.col("name"))).filter(F.col("_n.ext").isNotNull())
    return out.withColumns({"key": F.col("_n.base"), "ext": F.col("_n.ext")}).drop("_n")


def samples(files: DataFrame) -> DataFrame:
    """Members of one shard and key as a sample: (shard, inner_idx, key, files map<ext, data>)."""
    k = keyed(files)
    g = k.groupBy("shard", "key").agg(
        F.min("pos").alias("first"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("ext", "data")))).alias("files"),
    )
    return group_position(g, "shard", ["first"], "inner_idx").select("shard", "inner_idx", "key", "files")


def shard_keys(files: DataFrame) -> DataFrame:
    """Distinct keys of each shard with the position where each first occurs."""
    return keyed(files).groupBy("shard", "key").agg(F.min("pos").alias("first"))


def shard_meta(files: DataFrame, include: DataFrame) -> DataFrame:
    """Inner indexes of included keys and their number, per shard."""
    keys = group_position(shard_keys(files), "shard", ["first"], "inner_idx").withColumn("inner_idx", F.col("inner_idx").cast("int"))
    kept = keys.join(include.select("key").distinct(), "key", "left_semi")
    return kept.groupBy("shard").agg(F.sort_array(F.collect_list("inner_idx")).alias("inner"), F.count("*").alias("n"))


def global_index(samples_: DataFrame) -> DataFrame:
    """Samples with a global ``idx`` over shards in order, by shard offsets."""
    n = samples_.groupBy("shard").agg(F.count("*").alias("_n"))
    spans = lengths_to_ranges(n, "shard", "_n").select("shard", F.col("lo").alias("_lo"))
    return samples_.join(spans, "shard").withColumn("idx", F.col("_lo") + F.col("inner_idx")).drop("_lo")


def sample_at(indexed: DataFrame, i: int) -> DataFrame:
    """One sample by its global index."""
    return indexed.filter(F.col("idx") == i)


def decode_text(data: Column) -> Column:
    """``.txt``."""
    return F.decode(data, "UTF-8")


def decode_int(data: Column) -> Column:
    """``.cls``."""
    return F.trim(F.decode(data, "UTF-8")).try_cast("long")


def decode_json(data: Column, schema: str) -> Column:
    """``.json``."""
    return F.from_json(F.decode(data, "UTF-8"), schema)


def unzipped(files: DataFrame, column: str = "data", ext: str = "ext") -> DataFrame:
    """Members whose extension ends in ``.gz`` unpacked, the extension without it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip

        for b in batches:
            zipped = b[ext].str.endswith(".gz")
            b[column] = [gzip.decompress(x) if z else x for x, z in zip(b[column], zipped, strict=True)]
            b[ext] = b[ext].str.removesuffix(".gz")
            yield b

    return files.mapInPandas(run, files.schema)


def shard_table(spark: SparkSession, path: str, glob: str = "*.tar") -> DataFrame:
    """Url, md5sum, filesize, nsamples of each shard; a tar is streamed once, its headers once more."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for b in batches:
            for uri, size in zip(b["path"], b["length"], strict=True):
                files, name = _file(uri)
                md5 = hashlib.md5()
                with files.open_input_stream(name) as f:
                    while chunk := f.read(1 << 23):
                        md5.update(chunk)
                keys = {m[1] for r in _headers(uri) if (m := re.match(SAMPLE_NAME, r[2]))}
                yield pd.DataFrame([(uri, md5.hexdigest(), size, len(keys))], columns=["url", "md5sum", "filesize", "nsamples"])

    files = read_binary(spark, path, glob).select("path", "length")
    return files.mapInPandas(load, "url string, md5sum string, filesize long, nsamples long")


def verified(shards: DataFrame, listed: DataFrame) -> DataFrame:
    """Shards whose checksum or number of samples is not what the list says."""
    l = listed.select("url", F.col("md5sum").alias("_m"), F.col("nsamples").alias("_n"))
    return shards.join(l, "url").filter(~F.col("md5sum").eqNullSafe(F.coalesce("_m", "md5sum")) | (F.col("nsamples") != F.coalesce("_n", "nsamples")))


def update_shards(shards: DataFrame, rebase: str | None = None, keep_dir: bool = True) -> DataFrame:
    """Urls moved below another base, with or without their directory."""
    name = F.col("url") if keep_dir else url_file(F.col("url"))
    return shards.withColumn("url", F.concat(F.lit(rebase.rstrip("/") + "/"), F.ltrim(name, F.lit("/"))) if rebase else name)


def shard_info(shards: DataFrame) -> DataFrame:
    """Totals, integer means, first and last shard by url."""
    return shards.agg(
        F.count("*").alias("n_shards"),
        F.sum("nsamples").alias("total_samples"),
        F.sum("filesize").alias("total_size"),
        F.floor(F.try_divide(F.sum("filesize"), F.count("*"))).cast("long").alias("mean_size"),
        F.floor(F.try_divide(F.sum("nsamples"), F.count("*"))).cast("long").alias("mean_samples"),
        F.min("url").alias("first_url"),
        F.max("url").alias("last_url"),
    )


def resolve_datasets(spec: DataFrame) -> DataFrame:
    """Rows (name, weight, base, shardlist array<struct<url, nsamples>>) to one shard list with full urls."""
    rows = spec.select(
        F.coalesce("name", F.lit("data")).alias("dataset"),
        F.coalesce("weight", F.lit(1.0)).alias("weight"),
        "base",
        F.explode("shardlist").alias("s"),
    )
    full = F.when(F.col("base").isNull() | F.col("s.url").rlike("^([a-z0-9+]+://|/)"), F.col("s.url")).otherwise(
        F.concat(F.rtrim(F.col("base"), F.lit("/")), F.lit("/"), F.col("s.url"))
    )
    return rows.select("dataset", "weight", full.alias("url"), F.col("s.nsamples").alias("nsamples"))


def matching_rows(rows: DataFrame, shard: str, order: str, predicate: Column) -> DataFrame:
    """Ordinals, within each shard, of the rows that pass."""
    return group_position(rows, shard, [order], "ordinal").filter(predicate)


def tar_plan(files: DataFrame, order: str, size: str, budget: int) -> DataFrame:
    """The tar of each file: a new tar begins whenever the running total passes another budget; no file is lost."""
    out = with_prefix(files, [order], {"_t": F.col(size).cast("long")})
    return out.withColumn("tar", F.floor((F.col("_t") - F.col(size)) / budget).cast("long")).drop("_t")


def packed(plan: DataFrame, name: str, data: str) -> DataFrame:
    """One tar as bytes per planned tar: (tar, content)."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        buf = io.BytesIO()
        with tarfile.open(fileobj=buf, mode="w") as t:
            for n, d in sorted(zip(pdf[name], pdf[data], strict=True)):
                info = tarfile.TarInfo(n)
                info.size = len(d)
                t.addfile(info, io.BytesIO(d))
        return pd.DataFrame({"tar": [int(pdf["tar"].iloc[0])], "content": [buf.getvalue()]})

    return plan.groupBy("tar").applyInPandas(pack, "tar long, content binary")


def write_tars(plan: DataFrame, folder: str, order: list[str], name: str = "name", data: str = "data") -> DataFrame:
    """The tars of a plan (column ``tar``) as files ``<tar>.tar`` under ``folder`` (a URI): tar, url, files, filesize.

    A task streams its tars one after the other, each under a name of its own until it is complete; a task that runs
    again writes the same bytes. The files are written when the result is run.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = _file(folder)
        files.create_dir(base, recursive=True)
        now, done = None, []

        def close() -> None:
            tar, part, f, t, n = now
            t.close()
            size = f.tell()
            f.close()
            files.move(part, f"{base}/{tar:06d}.tar")
            done.append((tar, f"{folder}/{tar:06d}.tar", n[0], size))

        for b in batches:
            for tar, n, d in zip(b["tar"].tolist(), b[name], b[data], strict=True):
                if now is None or now[0] != tar:
                    if now is not None:
                        close()
                    part = f"{base}/.{tar:06d}.{uuid.uuid4().hex}"
                    f = files.open_output_stream(part)
                    now = (tar, part, f, tarfile.open(fileobj=f, mode="w|"), [0])
                info = tarfile.TarInfo(n)
                info.size = len(d)
                now[3].addfile(info, io.BytesIO(d))
                now[4][0] += 1
        if now is not None:
            close()
        yield pd.DataFrame(done, columns=["tar", "url", "files", "filesize"])

    dealt = plan.repartition(partitions(plan.sparkSession), "tar").sortWithinPartitions("tar", *order)
    return dealt.select("tar", name, data).mapInPandas(run, "tar long, url string, files long, filesize long")


def node_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """``key=value`` lines as maps; nodes without a GPU type are dropped."""
    m = lines.select(F.str_to_map(F.col(line), F.lit(" "), F.lit("=")).alias("m"))
    return m.filter(F.coalesce(F.col("m")["gpu_type"], F.lit("")) != "")


def listed_files(files: DataFrame, path: str, pattern: str) -> DataFrame:
    """Paths that match a glob (``*`` within a part, ``?``), sorted."""
    rx = "^" + "".join({"*": "[^/]*", "?": "[^/]", ".": r"\."}.get(c, c) for c in pattern) + "$"
    return files.filter(F.col(path).rlike(rx)).orderBy(path)
