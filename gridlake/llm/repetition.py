"""Repetition inside single documents, with verdicts on their hosts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.words import Words, gram_hashes, slices, words_of
from gridlake.runtime import BROADCAST_GROUPS, cut, require


def repeated_words(words: Words, n: int) -> np.ndarray:
    """TRUE at words in a stretch of n or more words that occurred earlier in the same text."""
    h, whole = gram_hashes(words, n)
    at = np.flatnonzero(whole)
    key, text = h[at], words.text[at]
    # The text enters the key, so equal keys are equal stretches of one text; the sort keeps their order.
    key = key ^ (text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(at), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    step = np.zeros(len(words.hash) + 1, np.int64)
    start = at[again]
    np.add.at(step, start, 1)
    np.add.at(step, start + n, -1)
    return np.cumsum(step[:-1]) > 0


def repetition_shares(df: DataFrame, id_column: str = "doc_id", text: str = "text", host: str | None = "source", n: int = 5) -> DataFrame:
    """One row per row of df: id, host, words, repeated (words), share, longest (repeated stretch in words).

    Words are runs of letters in lower case. A text without words, empty or NULL has a share of 0.
    Whole texts are read, of any length. Rows with the same or no id are rows of their own.
    """
    require(df, id_column, text, *([host] if host else []))
    given = df.select(F.col(id_column).alias("id"), (F.col(host) if host else F.lit(None)).cast("string").alias("host"), F.col(text).alias("text"))
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in slices([len(t) for t in texts]):
                words = words_of(texts[a:b])
                hit = repeated_words(words, n)
                sums = np.concatenate([[0], np.cumsum(hit)])
                count = np.diff(words.begin)
                repeated = sums[words.begin[1:]] - sums[words.begin[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[a:b], batch.column("host")[a:b], pa.array(count, pa.int64()), pa.array(repeated, pa.int64()), pa.array(repeated / np.maximum(count, 1)), pa.array(_longest(words, hit), pa.int64())],
                    ["id", "host", "words", "repeated", "share", "longest"],
                )

    return given.mapInArrow(run, f"id {kind}, host string, words bigint, repeated bigint, share double, longest bigint")


def _longest(words: Words, hit: np.ndarray) -> np.ndarray:
    """Longest run of repeated words of each text."""
    text = words.text
    edge = np.concatenate([[True], (hit[1:] != hit[:-1]) | (text[1:] != text[:-1])]) if len(hit) else np.zeros(0, bool)
    begin = np.flatnonzero(edge)
    size = np.diff(np.append(begin, len(hit)))
    out = np.zeros(len(words.begin) - 1, np.int64)
    keep = hit[begin]
    np.maximum.at(out, text[begin[keep]], size[keep])
    return out


def repetition_report(df: DataFrame, id_column: str = "doc_id", text: str = "text", host: str = "source", n: int = 5, limit: float = 1 / 3, stretch: int = 50) -> DataFrame:
    """repetition_shares() with the verdicts of the document's host and its own.

    Rules: ``share`` over ``limit``; a repeated stretch of over ``stretch`` words. Failures are
    counted per host; a host's rates are shrunk towards the mean of all hosts by a beta prior whose
    strength is estimated from the hosts by moments, and joined back as host_rate and
    host_stretch_rate, with host_documents and host_verdict: 'repetitive' if the shrunk rate of the
    first rule is a half or more, 'clean' if none of its documents fails it, else 'mixed'. Documents
    without a host are a host of their own, which the prior leaves out.

    repetitive: the host isn't clean and the document itself fails the first rule. A rate can't tell
    which of a host's documents repeat themselves, so the exact share has the last word.
    """
    stats = cut(repetition_shares(df, id_column, text, host, n))
    count = lambda c: F.sum(c.cast("double"))
    hosts = stats.groupBy("host").agg(F.count("*").cast("double").alias("n"), count(F.col("share") > limit).alias("k"), count(F.col("longest") > stretch).alias("k2"))
    named = lambda c: F.when(F.col("host").isNotNull(), c)
    prior = hosts.agg(*[F.struct(
        F.coalesce(F.try_divide(F.sum(named(F.col(k))), F.sum(named(F.col("n")))), F.lit(0.0)).alias("mean"), F.coalesce(F.var_samp(named(F.col(k) / F.col("n"))), F.lit(0.0)).alias("var"),
    ).alias("p" + k) for k in ("k", "k2")])
    strength = lambda p: F.when(F.col(p)["var"] > 0, F.greatest(F.lit(1.0), F.col(p)["mean"] * (1 - F.col(p)["mean"]) / F.col(p)["var"] - 1)).otherwise(F.lit(1e6))
    rate = lambda k: (F.col(k) + strength("p" + k) * F.col("p" + k)["mean"]) / (F.col("n") + strength("p" + k))
    rates = cut(hosts.crossJoin(F.broadcast(prior)).select(
        F.col("host").alias("_h"), F.col("n").cast("bigint").alias("host_documents"), rate("k").alias("host_rate"), rate("k2").alias("host_stretch_rate"),
        F.when(F.col("k") == 0, "clean").when(rate("k") >= 0.5, "repetitive").otherwise("mixed").alias("host_verdict"),
    ))
    joined = stats.join(F.broadcast(rates) if rates.count() <= BROADCAST_GROUPS else rates, F.col("host").eqNullSafe(F.col("_h")))
    return joined.select(
        F.col("id").alias(id_column), F.col("host").alias(host), "words", "repeated", "share", "longest", "host_documents", "host_rate", "host_stretch_rate", "host_verdict",
        ((F.col("host_verdict") != "clean") & (F.col("share") > limit)).alias("repetitive"),
    )
