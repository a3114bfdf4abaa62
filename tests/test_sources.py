from __future__ import annotations

import gzip
import io
import tarfile

import numpy as np
import pytest
from loomery.functions import udf
from loomery.sources import files, tars
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def shards(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shards")
    for k in range(2):
        with tarfile.open(folder / f"s{k}.tar", "w") as t:
            for i in range(3):
                for ext, data in ((".txt", f"text {k} {i}"), (".cls", str(i)), (".json", f'{{"a": {i}}}')):
                    raw = data.encode()
                    info = tarfile.TarInfo(f"d.x/{i:03d}{ext}")
                    info.size = len(raw)
                    t.addfile(info, io.BytesIO(raw))
            t.addfile(tarfile.TarInfo("README"))
    return str(folder)


def test_tar_samples(spark, shards):
    s = tars.global_index(tars.samples(tars.members(spark, shards)))
    rows = s.select(
        "idx", "key", tars.decode_text(F.col("files")[".txt"]).alias("t"), tars.decode_int(F.col("files")[".cls"]).alias("c"),
        tars.decode_json(F.col("files")[".json"], "a int")["a"].alias("a"),
    ).orderBy("idx").collect()
    assert [(r.idx, r.key, r.t, r.c, r.a) for r in rows] == [(k * 3 + i, f"d.x/{i:03d}", f"text {k} {i}", i, i) for k in range(2) for i in range(3)]


def test_shard_table(spark, shards):
    table = tars.shard_table(spark, shards).cache()
    assert [r.nsamples for r in table.collect()] == [3, 3]
    assert tars.verified(table, table).isEmpty()
    assert tars.verified(table, table.withColumn("md5sum", F.lit("x"))).count() == 2
    info = tars.shard_info(table).first()
    assert (info.n_shards, info.total_samples, info.mean_samples) == (2, 6, 3)


def test_tar_round_trip(spark):
    df = spark.createDataFrame([(i, f"f{i}.txt", b"x" * 10) for i in range(7)], "i int, name string, data binary")
    packed = tars.packed(tars.tar_plan(df.withColumn("size", F.length("data")), "i", "size", 25), "name", "data").collect()
    names = [n for r in packed for n in tarfile.open(fileobj=io.BytesIO(r.content)).getnames()]
    assert sorted(names) == [f"f{i}.txt" for i in range(7)]
    assert len(packed) > 1


def test_gzip_members(spark):
    df = spark.createDataFrame([("a.txt.gz", gzip.compress(b"hi")), ("b.txt", b"ho")], "ext string, data binary")
    assert sorted((r.ext, bytes(r.data)) for r in tars.unzipped(df).collect()) == [("a.txt", b"hi"), ("b.txt", b"ho")]


def test_json_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a;b"), (2, None)], "i int, s string")
    files.write_jsonl(df, f"{tmp_path}/j")
    assert sorted(files.read_jsonl(spark, f"{tmp_path}/j", "i int, s string").collect()) == sorted(df.collect())
    files.write_csv(df, f"{tmp_path}/c", sep=";")
    assert files.read_csv(spark, f"{tmp_path}/c", "i int, s string", sep=";").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"i": 1}\nnot json\n')
    assert files.read_jsonl(spark, f"{tmp_path}/bad.jsonl", "i int", bad="broken").cache().filter("broken is not null").count() == 1
    (tmp_path / "one.json").write_text('{\n "i": 3\n}')
    assert files.read_json(spark, f"{tmp_path}/one.json", "i int").first().i == 3


def test_arrays_and_files(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6).reshape(2, 3))
    (tmp_path / "empty.npy").write_bytes(b"")
    r = files.read_arrays(spark, f"{tmp_path}/a.npy").first()
    assert (r["shape"], r["values"]) == ([2, 3], [0.0, 1.0, 2.0, 3.0, 4.0, 5.0])
    listed = files.read_binary(spark, str(tmp_path), "*.npy")
    assert files.valid_files(listed).count() == 1
    assert files.latest_modification(listed).first().latest.year > 2000
    assert files.latest_modification(listed.limit(0)).first().latest.year == 1970


def test_keyed_writes_resume(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    files.write_keyed(df, f"{tmp_path}/k", "k")
    files.write_keyed(df.filter("k = 'b'").withColumn("v", F.lit(3)), f"{tmp_path}/k", "k")
    got = spark.read.parquet(f"{tmp_path}/k")
    assert sorted((r.k, r.v) for r in got.collect()) == [("a", 1), ("b", 3)]
    assert files.unfinished(spark.createDataFrame([("a",), ("c",)], "k string"), got, "k").first().k == "c"


def test_retries_report_failures(spark):
    def f(x):
        if x == 2:
            raise ValueError
        return x * 10

    got = udf.map_with_retries(spark.range(4), f, "id", "bigint", tries=3).orderBy("id").collect()
    assert [(r.result, r.status, r.tries) for r in got][1:3] == [(10, "done", 1), (None, "failed", 3)]


def test_registry_and_scoring(spark):
    reg = udf.Registry()

    @reg.register()
    def twice(c):
        return c * 2

    assert reg.listing() == ["twice"]
    assert spark.range(3).select(reg.build("twice", F.col("id")).alias("x")).agg(F.sum("x")).first()[0] == 6
    with pytest.raises(KeyError):
        reg.register("twice")(twice)
    df = spark.createDataFrame([("abc",)], "p string")
    got = udf.scored(df, "p", lambda p, b: [f"{x}:{y}" for x, y in zip(p, b, strict=True)], F.length("p"), 10).first()
    assert got.completion == "abc:7"
    r = spark.range(1).select(udf.unwrap_completion(F.lit('{"choices":[{"text":"hi"}],"usage":{"total_tokens":5}}')).alias("r")).first().r
    assert (r.text, r.tokens) == ("hi", 5)


def test_results_are_kept(spark, tmp_path):
    from loomery.sources import shared

    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    path = f"file://{tmp_path}/kept"
    assert [shared.cached_table(spark, path, make).count() for _ in range(2)] == [3, 3] and len(calls) == 1
    cache = shared.TableCache(2)
    for key in "abacab":
        assert cache.get(key, make).count() == 3
    assert len(calls) == 1 + 4 and list(cache.tables) == ["a", "b"]  # b was given up for c and came again
    cache.clear()
    with shared.scratch(spark) as keep:
        gone, stays = shared.written(spark.range(2), "gone"), shared.written(spark.range(2), "stays")
        keep += [p for p in shared._made if "/stays-" in p]
        folders = [p for p in shared._made if "/gone-" in p]
    assert folders and not any(shared.exists(spark, p) for p in folders) and stays.count() == 2 and gone.columns == ["id"]


def test_encodings(spark, tmp_path):
    for name, raw, want in (("u", "é,1".encode(), "UTF-8"), ("l", "é,1".encode("ISO-8859-1"), "ISO-8859-1")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.csv").write_bytes(raw)
        assert files.fitting_encoding(spark, f"{tmp_path}/{name}") == want
        assert files.read_csv(spark, f"{tmp_path}/{name}", "a string, b int", header=False, encoding=want).first().a == "é"


def test_tar_files(spark, tmp_path):
    import io as _io

    rows = [(k // 3, f"d/{k}.bin", bytes([k]) * (k * 700)) for k in range(10)]
    df = spark.createDataFrame(rows, "tar long, name string, data binary")
    listed = tars.write_tars(df, f"file://{tmp_path}/t", ["name"]).collect()
    assert sorted((r.tar, r.files) for r in listed) == [(0, 3), (1, 3), (2, 3), (3, 1)]
    for r in listed:
        path = tmp_path / "t" / f"{r.tar:06d}.tar"
        assert path.stat().st_size == r.filesize
        with tarfile.open(path) as t:
            assert t.getnames() == [n for k, n, _ in rows if k == r.tar]
    got = {(r.name, bytes(r.data)) for r in tars.members(spark, f"{tmp_path}/t").collect()}
    assert got == {(n, d) for _, n, d in rows}
    buf = _io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as t:
        info = tarfile.TarInfo("a.txt")
        info.size = 2
        t.addfile(info, _io.BytesIO(b"hi"))
    (tmp_path / "z.tgz").write_bytes(buf.getvalue())
    assert [bytes(r.data) for r in tars.members(spark, str(tmp_path), "*.tgz").collect()] == [b"hi"]
