"""File sources and sinks with explicit schemas. Inference is opt-in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Whole-file JSON documents."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, bad: str | None = None) -> DataFrame:
    """One object per line; with ``bad``, broken lines are kept in that column."""
    if bad:
        kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        schema = T.StructType([*kind.fields, T.StructField(bad, T.StringType())])
    options = {"mode": "PERMISSIVE"} | ({"columnNameOfCorruptRecord": bad} if bad else {})
    return spark.read.schema(schema).options(**options).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """S01, S02."""
    df.write.mode(mode).json(path)


def read_csv(
    spark: SparkSession, path: str, schema: str | T.StructType | None, sep: str = ",", header: bool = True, encoding: str = "UTF-8"
) -> DataFrame:
    """The encoding is explicit (see ``fitting_encoding``); without a schema columns are inferred."""
    reader = spark.read.options(sep=sep, header=header, encoding=encoding, multiLine=True, escape='"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True, mode: str = "errorifexists") -> None:
    """Values with separators, quotes and line ends are quoted, white space is kept."""
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode(mode).options(sep=sep, header=header, escape='"', **keep).csv(path)


def fitting_encoding(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("UTF-8", "ISO-8859-1")) -> str:
    """The first encoding that decodes every file; the last one if none fits.

    A single-byte encoding decodes nearly everything, so the strict ones come first.
    """
    content = read_binary(spark, path).select("content")
    for encoding in encodings[:-1]:

        def run(batches: Iterator[pd.DataFrame], encoding=encoding) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"fits": [_decodes(x, encoding) for x in b["content"]]})

        if content.mapInPandas(run, "fits boolean").filter("not fits").isEmpty():
            return encoding
    return encodings[-1]


def _decodes(content: bytes, encoding: str) -> bool:
    try:
        content.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def read_binary(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files as rows (path, modificationTime, length, content); ``content`` is read only where selected."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def valid_files(files: DataFrame) -> DataFrame:
    """Files with content."""
    return files.filter("length > 0")


def latest_modification(files: DataFrame) -> DataFrame:
    """The newest file time, the epoch for no files."""
    return files.agg(F.coalesce(F.max("modificationTime"), F.timestamp_seconds(F.lit(0))).alias("latest"))


def unfinished(keys: DataFrame, done: DataFrame, on: str) -> DataFrame:
    """Keys without a finish marker; a repeated run does only those."""
    return keys.join(done.select(on), on, "left_anti")


def write_keyed(df: DataFrame, path: str, key: str) -> None:
    """One folder per key; writing again replaces the keys written and leaves the rest."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def read_arrays(spark: SparkSession, path: str, glob: str = "*.npy") -> DataFrame:
    """``.npy`` files as (path, shape, values); pickled content is refused."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import numpy as np

        for b in batches:
            arrays = [np.load(io.BytesIO(x), allow_pickle=False) for x in b["content"]]
            yield pd.DataFrame(
                {
                    "path": b["path"].tolist(),
                    "shape": [list(map(int, a.shape)) for a in arrays],
                    "values": [a.ravel().astype("float64").tolist() for a in arrays],
                }
            )

    files = read_binary(spark, path, glob).select("path", "content")
    return files.mapInPandas(load, "path string, shape array<long>, values array<double>")


def read_hdf5(spark: SparkSession, path: str, glob: str = "*.h5") -> DataFrame:
    """The data sets of HDF5 files as (file, name, shape, values); needs the optional h5py."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import h5py  # optional

        for b in batches:
            rows = []
            for name, content in zip(b["path"], b["content"], strict=True):
                with h5py.File(io.BytesIO(content), "r") as f:
                    f.visititems(
                        lambda k, x, name=name: rows.append((name, k, list(x.shape), x[()].ravel().astype("float64").tolist()))
                        if isinstance(x, h5py.Dataset)
                        else None
                    )
            yield pd.DataFrame(rows, columns=["file", "name", "shape", "values"])

    files = read_binary(spark, path, glob).select("path", "content")
    return files.mapInPandas(load, "file string, name string, shape array<long>, values array<double>")
