"""Operator 8: toxicity by compression distance, with a zstandard dictionary for each kind of text.

Windows of a text are compressed with a dictionary of ordinary text and with one of toxic
text. Both hold the same ordinary passages, so a window's two lengths differ by what the
toxic dictionary knows besides: the words that toxic texts use in many places and
ordinary ones hardly ever. The differences are turned into a probability by a logistic
regression on labelled texts that the dictionaries did not see.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from guardframe.llm.common import WORD, durable, remainder, sample_by_hash, slices, table

#: Labelled texts that the dictionaries (of each label) and the calibration are fitted on: about so many where there are more.
DICTIONARY_ROWS, CALIBRATION_ROWS = 4_000, 8_000
#: Bytes of a dictionary's ordinary and toxic parts, and of a window.
ORDINARY_BYTES, TOXIC_BYTES, WINDOW = 8_192, 16_384, 64
#: Letters of the beginnings of words that are weighed beside whole words.
BEGINNINGS = (5, 6, 7)
#: Log-likelihood ratio and odds from which on a word counts as toxic.
LEAST_RATIO, LEAST_ODDS = 8.0, 10.0
THRESHOLD = 0.7
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def windows(text: str | None) -> list[bytes]:
    """The lower-cased text cut at white space into windows of about WINDOW bytes; a longer word is one."""
    out, now, size = [], [b""], 0
    for word in (text or "").encode().lower().split():
        now.append(word)
        size += len(word) + 1
        if size >= WINDOW:
            out.append(b" ".join([*now, b""]))
            now, size = [b""], 0
    if len(now) > 1:
        out.append(b" ".join([*now, b""]))
    return out


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """A compressor whose lengths tell matches of six bytes and more with the content."""
    return zstandard.ZstdCompressor(
        dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
        compression_params=zstandard.ZstdCompressionParameters(
            window_log=17, hash_log=15, chain_log=15, search_log=5, min_match=6, target_length=64,
            strategy=zstandard.STRATEGY_LAZY, write_content_size=0, write_checksum=0, write_dict_id=0,
        ),
    )


def distances(text: str | None, ordinary: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor) -> list[float]:
    """What a classifier sees of a text: how much shorter its windows get with the toxic dictionary."""
    cut = windows(text)
    if not cut:
        return [0.0] * SEEN
    d = np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in cut], np.float64)
    top = np.sort(d)[-3:]
    return [
        float(d.mean()), float(top[-1]), float(top.mean()),
        *(float((d >= k).mean()) for k in (1, 2, 3, 4)), *(math.log1p((d >= k).sum()) for k in (2, 4)),
        math.log1p(len(d)), math.log1p(np.maximum(d - 1, 0).sum()),
    ]


#: Numbers that distances() gives.
SEEN = 11


def train_dictionaries(labelled: DataFrame, texts: DataFrame, rows: int = DICTIONARY_ROWS) -> tuple[bytes, bytes]:
    """Contents of the ordinary and the toxic dictionary from labelled(doc_id, label) and texts(doc_id, text).

    Both begin with windows of ordinary texts. In the toxic one, units of words follow
    (whole words and their beginnings), the most telling last, where zstandard finds them
    cheapest; in the ordinary one zeros, so that all else costs the same with either. A
    unit weighs by the number of different neighbours it has in toxic against ordinary
    texts, so that copies of a passage count once.
    """
    labelled = durable(labelled)
    chosen = sample_by_hash(labelled.where("label = 1"), rows, "doc_id").union(sample_by_hash(labelled.where("label = 0"), rows, "doc_id"))
    # about 2 * rows ids at most go to the texts, so no text but theirs is moved
    sample = durable(texts.join(F.broadcast(chosen), "doc_id"))
    words = F.regexp_extract_all(F.translate("text", *_LOWER), F.lit(WORD), F.lit(0))
    pairs = sample.select("label", words.alias("w")).select(
        "label", F.explode(F.arrays_zip(F.col("w").alias("word"), F.slice("w", 2, F.size("w")).alias("next"))).alias("p")
    )
    pairs = pairs.select("label", "p.word", "p.next").distinct()
    unit = lambda text, context: F.struct(text.alias("unit"), context.alias("context"))
    units = F.array(
        unit(F.concat("word", F.lit(" ")), F.xxhash64("next")),
        *(unit(F.when(F.length("word") > n, F.substring("word", 1, n)), F.xxhash64("word", "next")) for n in BEGINNINGS),
    )
    seen = pairs.select("label", F.explode(units).alias("u")).select("label", "u.unit", "u.context").where("unit is not null")
    counts = durable(seen.groupBy("unit").agg(F.sum("label").alias("a"), F.count("*").alias("n")))
    a, n = counts.where("unit like '% '").agg(F.sum("a"), F.sum("n")).first()
    if not a or a == n:
        return b"", b""
    share = a / n
    k, m, q = F.col("a"), F.col("n"), F.col("a") / F.col("n")
    ratio = k * F.log(q / share) + F.when(m > k, (m - k) * F.log((1 - q) / (1 - share))).otherwise(0.0)
    # at most as many units as there is room for
    telling = (
        counts.where(q > share)
        .withColumn("ratio", ratio)
        .where((F.col("ratio") >= LEAST_RATIO) & (k > LEAST_ODDS * (m - k)))
        .orderBy(F.desc("ratio"), "unit")
        .limit(TOXIC_BYTES // 4)
    )
    telling = [r.unit.strip().encode() for r in telling.select("unit").collect()]
    toxic = b" " + b" ".join(reversed(telling))[-TOXIC_BYTES:] + b" "
    ordinary = []
    # a stretch from anywhere in the text, cut out before rows are ordered; no other text goes to the driver
    start = F.pmod(F.xxhash64(F.lit("cut"), "doc_id"), F.greatest(F.length("text") - 4 * WINDOW, F.lit(1))) + 1
    few = sample.where("label = 0 and text is not null").select(F.xxhash64("doc_id").alias("h"), "doc_id", F.substring(F.col("text"), start.cast("int"), F.lit(4 * WINDOW)).alias("t"))
    for r in few.orderBy("h", "doc_id").limit(ORDINARY_BYTES // WINDOW).select("t").collect():
        ordinary += windows(r.t)[:2]
    content = b"".join(ordinary)[:ORDINARY_BYTES]
    return content + bytes(len(toxic)), content + toxic if telling else b""


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    labels(doc_id, toxic): rows with a null id or label, or of held-out documents, are
    not learned from. Seven tenths of the rest train the dictionaries, three tenths the
    calibration. A null or empty text has no windows, so distances of 0, and is scored
    like any other. Without labels of both kinds every score is the smoothed share of
    label 1. Rows that repeat an id are judged each by its text. A null held_out counts
    as false. An empty table gives an empty result. lang, source and the id are no inputs.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    marks = labels.where("toxic is not null").select(F.col("doc_id").alias("label_id"), F.col("toxic").alias("label"))
    known = source.where(~F.col("held_out")).select("doc_id").join(marks, F.col("doc_id") == F.col("label_id"))
    known = known.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(10)))
    ordinary, toxic = train_dictionaries(known.where("fold < 7").select("doc_id", "label").distinct(), source.select("doc_id", "text"))

    def run(batches):
        a, b = compressor(ordinary or b" "), compressor(toxic or b" ")
        for batch in slices(batches, "text", 16 << 20):
            rows = [distances(t, a, b) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(rows, pa.list_(pa.float64()))],
                names=["doc_id", "held_out", "d"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    seen = durable(source.mapInArrow(run, f"doc_id {kind}, held_out boolean, d array<double>"))
    fit = seen.where(~F.col("held_out")).join(marks, F.col("doc_id") == F.col("label_id"))
    fit = fit.where(F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(10)) >= 7)
    fit = sample_by_hash(durable(fit.select("doc_id", "d", "label")), CALIBRATION_ROWS, "doc_id")
    fit = durable(fit.select("d", F.col("label").cast("double").alias("label")))
    n, ones = fit.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    total = F.lit(math.log((ones + 1) / (n - ones + 1)))
    if 0 < ones < n and toxic:
        model = LogisticRegression(regParam=1e-4, maxIter=200).fit(fit.select("label", array_to_vector("d").alias("features")))
        total = F.lit(float(model.intercept))
        for k, w in enumerate(model.coefficients.toArray().tolist()):
            total += F.col("d")[k] * w
    scored = seen.select("doc_id", "held_out", (1 / (1 + F.exp(-total))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op8_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; those whose crc32 modulo 3 is 1 are held out of training."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity_scores(docs, labels, remainder(F.col("doc_id"), 3) == 1)
