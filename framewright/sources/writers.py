"""Sinks: sharded parquet, label and JSON lines. Files are written beside the old ones, never over what is being read."""

from __future__ import annotations

import io
import os
import uuid
import wave
from collections.abc import Callable, Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import frames as L
from framewright.operators.joins import fixed_shards


def sharded(df: DataFrame, key: str, path: str, per_file: int = 1000, prefix: str = "part", keep: Column | None = None) -> DataFrame:
    """Exactly ``per_file`` ids of the input a shard, in order; rows that ``keep`` rejects leave their shard shorter. Returns what was written."""
    out = fixed_shards(df, key, per_file, prefix)
    out = out.where(keep) if keep is not None else out
    out.repartition("shard").sortWithinPartitions("shard", key).write.partitionBy("shard").parquet(path)
    return df.sparkSession.read.parquet(path)


def text_lines(df: DataFrame, line: Column, path: str) -> None:
    df.select(line.alias("value")).write.text(path)


def label_lines(df: DataFrame, key: str, labels: str, path: str) -> None:
    text_lines(df, F.concat_ws("\t", key, L.label_text(F.col(labels))), path)


def json_lines(df: DataFrame, path: str, *columns: str) -> None:
    text_lines(df, F.to_json(F.struct(*columns)), path)


def confidence_json(df: DataFrame, key: str, values: str, per_object: int = 1000) -> DataFrame:
    """JSON objects {id: {word_confidence: [...]}} of at most ``per_object`` ids each, in the order of the ids. Ids must be unique."""
    entry = F.struct(F.col(key), F.struct(F.col(values).alias("word_confidence")))
    return fixed_shards(df, key, per_object).groupBy("shard").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))


def confidence_files(df: DataFrame, key: str, values: str, path: str, per_object: int = 1000) -> None:
    """The objects of ``confidence_json``, each in a file of its own, as readers of whole files expect."""
    confidence_json(df, key, values, per_object).select("shard", "value").write.partitionBy("shard").text(path)


def metrics_json(counts: DataFrame, key: str, path: str) -> None:
    """tp, fp, fn, tn of each key with accuracy, precision, recall and F1 as JSON lines."""
    from framewright.operators.metrics import binary_scores, ratio

    accuracy = F.round(ratio(F.expr("tp + tn"), F.expr("tp + fp + fn + tn")), 6)
    binary_scores(counts.withColumn("accuracy", accuracy)).select(key, "tp", "fp", "fn", "tn", "accuracy", "precision", "recall", "f1").write.json(path)


def triples(df: DataFrame, key: str, samples: str, rate: str, labels: str, meta: str, path: str) -> str:
    """<key>.wav (PCM of 16 bits), <key>.npy (labels) and <key>.json of every row, in a folder that all executors have mounted.

    A file is written under a name of its own and then renamed, so a task that runs twice does no harm. Returns the folder.
    """
    folder = path.removeprefix("file://").removeprefix("file:")
    if "://" in folder:
        raise ValueError(f"{path} is no mounted folder")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for k, x, r, ls, m in zip(*(b[c] for c in (key, samples, rate, labels, meta)), strict=True):
                pcm = np.floor(np.clip(np.asarray(x, np.float64), -1, 1) * 32767 + 0.5).astype("<i2")
                wav, npy = io.BytesIO(), io.BytesIO()
                with wave.open(wav, "wb") as w:
                    w.setnchannels(1), w.setsampwidth(2), w.setframerate(int(r))
                    w.writeframes(pcm.tobytes())
                np.save(npy, np.asarray(ls, np.int32))
                for suffix, data in (("wav", wav.getvalue()), ("npy", npy.getvalue()), ("json", m.encode())):
                    name = f"{folder}/{quote(str(k), safe='-_.')}.{suffix}"
                    with open(part := f"{folder}/.{uuid.uuid4().hex}.part", "wb") as f:
                        f.write(data)
                    os.replace(part, name)
            yield pd.DataFrame({"n": [len(b)]})

    df.select(key, samples, rate, labels, meta).mapInPandas(run, "n long").agg(F.sum("n")).collect()
    os.makedirs(folder, exist_ok=True)
    return path


def replace(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> str:
    """Rewrite a dataset in its place: the new version is written beside it, the old one kept under ``<path>.bak``; returns that.

    Readers see the old or the new version, but for the moment between two renames. A backup of an earlier rewrite goes.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    new, old = f"{path}.new", f"{path}.bak"
    fs.delete(at(new), True)
    change(spark.read.parquet(path)).write.parquet(new)
    fs.delete(at(old), True)
    if not fs.rename(at(path), at(old)) or not fs.rename(at(new), at(path)):
        raise OSError(f"{path} could not be replaced; the old version is at {old}")
    return old


def two_ways(df: DataFrame, flag: Column, path: str) -> None:
    """Rows with and without the flag in two folders of one write."""
    df.withColumn("side", F.when(flag, "finalized").otherwise("not_finalized")).write.partitionBy("side").parquet(path)
