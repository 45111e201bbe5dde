"""Scans of the formats that annotation tools write. Lines that can't be parsed go to ``rejects``, they stop nothing."""

from __future__ import annotations

import io
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import frames as L
from framewright.functions import text as T
from framewright.operators.joins import last_wins

POS = "_pos"
LISTED, HELD = 1 << 12, 1 << 24  # names in a batch of a listing; bytes of files in a batch, but for a file that is larger
TOKENS = "array<struct<char:array<string>,word:string,start_offset:int,end_offset:int,start:double,end:double>>"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value and its position (file, block, number in block), which orders the lines of each file."""
    df = spark.read.text(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return df.select("value", place.alias(POS))


def keyed(df: DataFrame, key: str, unique: bool = True) -> DataFrame:
    """The last line of each key, or all without their positions."""
    return last_wins(df, key, [F.col(POS)]).drop(POS) if unique else df.drop(POS)


def scp(spark: SparkSession, path: str, mode: str = "once") -> DataFrame:
    """rec_id, audio_path. once: split at the first blanks; second: the second word of two or more; exact: lines of exactly two words."""
    df = lines(spark, path).withColumn("value", T.blank_trim(F.col("value"))).where("value <> ''")
    w = T.words(F.col("value"))
    if mode == "once":
        parts = F.split("value", f"{T.BLANK}+", 2)
        df = df.select(F.get(parts, F.lit(0)).alias("rec_id"), F.get(parts, F.lit(1)).alias("audio_path"), POS).where("audio_path IS NOT NULL")
    else:
        df = df.where(F.size(w) >= 2 if mode == "second" else F.size(w) == 2).select(F.get(w, F.lit(0)).alias("rec_id"), F.get(w, F.lit(1)).alias("audio_path"), POS)
    return keyed(df, "rec_id")


def piped(audio_path: Column) -> Column:
    """A path that is a shell command. Commands from data are never run: such rows are rejected with a reason."""
    return T.blank_trim(audio_path).endswith("|")


def playable(recordings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recordings that are files, and the rejects with a reason."""
    bad = F.coalesce(piped(F.col("audio_path")), F.lit(True))
    why = F.when(F.col("audio_path").isNull(), "no path").otherwise("shell command")
    return recordings.where(~bad), recordings.where(bad).withColumn("reason", why)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """segment_id, recording_id, start_sec, end_sec of lines with four words or more; nothing is deduplicated."""
    w = T.words(F.col("value"))
    df = lines(spark, path).where(F.size(w) >= 4)
    number = lambda i: F.get(w, F.lit(i)).try_cast("double")
    return df.select(F.get(w, F.lit(0)).alias("segment_id"), F.get(w, F.lit(1)).alias("recording_id"), number(2).alias("start_sec"), number(3).alias("end_sec")).where("start_sec IS NOT NULL AND end_sec IS NOT NULL")


def resources(recordings: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """resource_id, audio_path, start_sec, end_sec: segments of recordings if given, else whole recordings."""
    if cuts is None:
        return recordings.select(F.col("rec_id").alias("resource_id"), "audio_path", F.lit(None).cast("double").alias("start_sec"), F.lit(None).cast("double").alias("end_sec"))
    return cuts.join(recordings, cuts.recording_id == recordings.rec_id).select(F.col("segment_id").alias("resource_id"), "audio_path", "start_sec", "end_sec")


def literal_json(value: Column) -> Column:
    """A Python literal as JSON: None, True and False outside quotes."""
    for a, b in (("None", "null"), ("True", "true"), ("False", "false")):
        value = F.regexp_replace(value, rf"([\[{{,:]\s*){a}(?=\s*[\]}},])", f"$1{b}")
    return value


def timestamps(spark: SparkSession, path: str, schema: str = TOKENS) -> tuple[DataFrame, DataFrame]:
    """utt_id and its words or tokens from id<TAB>[{...}, ...]; and the rejects with a reason."""
    df = lines(spark, path).where("value <> ''")
    tab = F.instr("value", "\t")
    df = df.withColumns({"utt_id": F.substring_index("value", "\t", 1), "tokens": F.from_json(literal_json(F.expr("substring(value, instr(value, '\t') + 1)")), schema, {"allowSingleQuotes": "true"})})
    why = F.when(tab == 0, "no tab").when(F.col("tokens").isNull(), "no list")
    return keyed(df.where(why.isNull()).select("utt_id", "tokens", POS), "utt_id"), df.where(why.isNotNull()).select("value", why.alias("reason"))


def transcriptions(spark: SparkSession, path: str, form: str = "words", empty: str = "keep", separator: str = "blanks") -> DataFrame:
    """utt_id and text (form string) or words. empty: keep or drop lines that are an id only. separator: blanks, or one space."""
    df = lines(spark, path)
    if separator == "space":
        key, text = F.substring_index("value", " ", 1), F.when(F.instr("value", " ") > 0, F.expr("substring(value, instr(value, ' ') + 1)")).otherwise("")
    else:
        df = df.withColumn("value", T.blank_trim(F.col("value")))
        key, text = F.regexp_extract("value", f"^({T.SOLID}+)", 1), F.regexp_extract("value", f"^{T.SOLID}+{T.BLANK}+(.*)$", 1)
    df = df.where("value <> ''").select(key.alias("utt_id"), text.alias("text"), POS)
    if empty == "drop":
        df = df.where("text <> ''")
    df = keyed(df, "utt_id")
    return df.select("utt_id", T.words(F.col("text")).alias("words")) if form == "words" else df


def labels(spark: SparkSession, path: str, ordered: bool = True) -> DataFrame:
    """utt_id, labels from id<TAB>[idx:label,...] (or a blank instead of the tab)."""
    df = lines(spark, path)
    sep = F.when(F.instr("value", "\t") > 0, F.instr("value", "\t")).otherwise(F.instr("value", " "))
    df = df.where(sep > 0).select("value", sep.alias("sep"), POS)
    df = df.select(F.expr("substring(value, 1, sep - 1)").alias("utt_id"), L.parse_labels(F.expr("substring(value, sep + 1)"), ordered).alias("labels"), POS)
    return keyed(df, "utt_id")


def confidences(spark: SparkSession, path: str) -> DataFrame:
    """utt_id, word_confidence from one JSON object per file; utterances without the list are dropped."""
    df = spark.read.text(path, wholetext=True).select(F.from_json("value", "MAP<STRING, STRUCT<word_confidence: ARRAY<FLOAT>>>").alias("m"))
    return df.select(F.explode("m").alias("utt_id", "v")).select("utt_id", F.col("v.word_confidence").alias("word_confidence")).where("word_confidence IS NOT NULL")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """file_id, num_frames (else the number of predictions), predictions, labels from JSON lines; bad lines are skipped, the last of an id wins."""
    df = lines(spark, path).select(F.from_json("value", "file_id STRING, num_frames INT, predictions ARRAY<INT>, labels ARRAY<INT>").alias("x"), POS).select("x.*", POS)
    return keyed(df.where("file_id IS NOT NULL AND predictions IS NOT NULL").withColumn("num_frames", F.coalesce("num_frames", F.size("predictions"))), "file_id")


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """path, content of the files in a folder and below it whose names end in ``suffix``.

    A folder that all executors have mounted is listed by a task and read by others, so the driver holds no name of a file,
    however many there are. Anything else (one file, a pattern, another file system) is listed by Spark, in the driver.
    """
    folder = path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")
    if "://" in folder or not os.path.isdir(folder):
        return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path).select("path", "content")

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, folders = [], [folder] * sum(b.num_rows for b in batches)
        while folders:
            with os.scandir(folders.pop()) as entries:
                for e in entries:
                    if e.is_dir():
                        if e.name[0] not in "._":  # where Spark keeps what isn't done
                            folders.append(e.path)
                    elif e.name.endswith(suffix):
                        found.append(e.path)
                        if len(found) == LISTED:
                            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["path"])
                            found = []
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["path"])

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["path", "content"])
        for b in batches:
            rows, held = [], 0
            for name in b.column(0).to_pylist():
                with open(name, "rb") as f:
                    rows.append((name, f.read()))
                held += len(rows[-1][1])
                if held >= HELD:
                    yield batch(rows)
                    rows, held = [], 0
            yield batch(rows)

    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    listed = spark.range(0, 1, 1, 1).mapInArrow(names, "path string")
    return listed.repartition(n, "path").mapInArrow(contents, "path string, content binary")


def npy_labels(spark: SparkSession, path: str) -> DataFrame:
    """utt_id (the file's stem), labels from .npy files; files that can't be read give null labels."""

    @F.pandas_udf("array<int>")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(b: bytes):
            try:
                return np.load(io.BytesIO(b), allow_pickle=False).astype(np.int32).ravel()
            except ValueError:
                return None

        for s in batches:
            yield pd.Series([one(b) for b in s], dtype=object)

    df = files(spark, path, ".npy")
    return df.select(_stem(F.col("path")).alias("utt_id"), decode("content").alias("labels"))


def wav_files(spark: SparkSession, path: str) -> DataFrame:
    """utt_id, path, in order."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    return df.select(_stem(F.col("path")).alias("utt_id"), "path").orderBy("path")


def wav_samples(spark: SparkSession, path: str, channel: str = "first") -> DataFrame:
    """utt_id, samples, sample_rate of PCM files of 16 bits; of several channels the first or their mean."""
    import wave

    schema = "samples array<float>, sample_rate int"

    @F.pandas_udf(schema)
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def one(b: bytes):
            try:
                with wave.open(io.BytesIO(b)) as w:
                    x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()) / 32768
                    return (x[:, 0] if channel == "first" else x.mean(1)).astype(np.float32), w.getframerate()
            except (wave.Error, ValueError, EOFError):
                return None, None

        for s in batches:
            yield pd.DataFrame([one(b) for b in s], columns=["samples", "sample_rate"]).astype({"sample_rate": "Int32"})

    df = files(spark, path, ".wav")
    return df.select(_stem(F.col("path")).alias("utt_id"), decode("content").alias("x")).select("utt_id", "x.*")


def cut(samples: Column, rate: Column, start: Column, end: Column) -> Column:
    """The samples [int(start*rate), int(end*rate)), within the array."""
    a = F.greatest(F.floor(start * rate).cast("int"), F.lit(0))
    z = F.least(F.floor(end * rate).cast("int"), F.size(samples))
    return F.slice(samples, a + 1, F.greatest(z - a, F.lit(0)))


def wav_range(spark: SparkSession, path: str, start: Column, end: Column, to: int | None = None, channel: str = "first") -> DataFrame:
    """utt_id, samples, sample_rate of the seconds [start, end) of each file; resampled by FFT to ``to`` if that is another rate."""
    df = wav_samples(spark, path, channel).withColumn("samples", cut(F.col("samples"), F.col("sample_rate"), start, end))
    if to is None:
        return df
    from framewright.operators.distort import resample, signal

    other = F.col("sample_rate") != to
    new = F.when(other, signal(lambda x, r: resample(x, int(r), to), F.col("samples"), F.col("sample_rate"))).otherwise(F.col("samples"))
    return df.select("utt_id", new.alias("samples"), F.when(F.col("samples").isNotNull(), F.lit(to)).alias("sample_rate"))


def streamed(spark: SparkSession, path: str, out: str, progress: str, key: str, files_per_trigger: int = 2, seed: int = 42) -> DataFrame:
    """All files that are there now as a stream; the rows of each micro-batch, which is the buffer, in an order by hash. Written to ``out``."""
    from framewright.operators.joins import draw

    def shuffle(df: DataFrame, batch: int) -> None:
        df.orderBy(draw(seed, batch, F.col(key))).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    q = stream(spark, path, files_per_trigger).writeStream.foreachBatch(shuffle).option("checkpointLocation", progress).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return spark.read.parquet(out).drop("batch")


def dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """The same files as a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def embeddings(spark: SparkSession, path: str, max_frames: int | None = None) -> DataFrame:
    """uttid, embedding from parquet, in place of tensor files; cut to a number of frames."""
    df = spark.read.parquet(path)
    return df.withColumn("embedding", F.slice("embedding", 1, max_frames)) if max_frames else df


def paired(texts: DataFrame, audio: DataFrame, max_words: int = 10) -> DataFrame:
    """utt_id, text of those with audio and at most ``max_words`` words."""
    return texts.join(audio.select("utt_id"), "utt_id", "left_semi").where(F.size(T.words(F.col("text"))) <= max_words)


def looks_like_json(spark: SparkSession, path: str) -> bool:
    """By the suffix, else by the first line."""
    if path.endswith(".jsonl"):
        return True
    first = spark.read.text(path).limit(1).collect()
    return bool(first) and first[0].value.lstrip().startswith("{") and "uttid" in first[0].value
