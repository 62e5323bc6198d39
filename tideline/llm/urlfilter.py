"""URL filters: the log-likelihood ratio of two character language models, beside explicit rules.

Two Markov models of order 3, one of accepted and one of rejected URLs, are smoothed over orders 3 to 0
(Witten-Bell), so the order in use varies with what a context has been seen to be followed by. A URL's score
is the mean difference of log-likelihood for each character, calibrated on a held-out fold.

Labelled URLs are a parameter; without them, the table's own URLs are labelled by seed words in the host (another
parameter). Counts are gathered over all labelled URLs but the held-out fold; the table of character sequences has SYMBOLS ** (ORDER + 1) entries at most, which bounds what is broadcast (11 MB).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

ORDER = 3
#: Characters with a symbol of their own; all digits count as 0, any other as one symbol.
CHARACTERS = "abcdefghijklmnopqrstuvwxyz0./-_?=&#:%+~"
SYMBOLS = len(CHARACTERS) + 2
#: Rules of the production query, each a host and the start of a path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Words of a host (between dots and hyphens) that mark a rejected URL to learn from.
SEEDS = ("ads", "adult", "bet", "bets", "betting", "casino", "lottery", "pills", "poker", "porn", "spam", "torrent", "tracker", "track", "viagra", "warez", "xxx")
BINS, SPAN = 512, 8.0


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits and what it says; null if none does."""
    found, says = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, rule in sorted(rules, key=lambda r: len(r[1])):  # later whens wrap earlier ones: longest outermost
        at, start = rule.split("/", 1)
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + start)
        found, says = F.when(fits, rule).otherwise(found), F.when(fits, action).otherwise(says)
    return found, says


def symbols(urls: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each run of ORDER + 1 symbols, and where each URL's runs start. A URL begins with ORDER blanks
    and ends with one, so that each has a run."""
    table = np.ones(256, np.int64)
    for i, ch in enumerate(CHARACTERS):
        table[ord(ch)] = i + 2
    table[ord("0") : ord("9") + 1] = CHARACTERS.index("0") + 2
    table[0] = 0
    urls = pc.fill_null(urls.cast(pa.large_string()), "")
    bare = pc.utf8_lower(pc.replace_substring_regex(urls, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""))
    padded = pc.binary_join_element_wise(pc.replace_substring(bare, "\0", " "), pa.scalar("\0" * (ORDER + 1), pa.large_string()), pa.scalar("", pa.large_string()))
    raw = b"\0" * ORDER + b"".join(x.encode() for x in padded.to_pylist())
    codes = table[np.frombuffer(raw, np.uint8)]
    runs = np.zeros(max(0, len(codes) - ORDER), np.int64)
    for j in range(ORDER + 1):
        runs = runs * SYMBOLS + codes[j : j + len(runs)]
    lengths = pc.binary_length(padded).to_numpy().astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    # The runs of a URL start ORDER before it; those inside the blanks after its end belong to no URL.
    keep = np.repeat(starts[1:] - ORDER, lengths) > np.arange(len(runs))
    return runs[keep], np.concatenate([[0], np.cumsum(lengths - ORDER)])


def counted(labelled: DataFrame) -> np.ndarray:
    """labelled(url, rejected): counts by class and run of symbols, gathered over all rows; each task sums its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * SYMBOLS ** (ORDER + 1), np.int32)
        for b in slices(batches, 0):
            runs, starts = symbols(b.column(0))
            bad = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            code, n = np.unique(runs + np.repeat(bad, np.diff(starts)) * SYMBOLS ** (ORDER + 1), return_counts=True)
            total[code] += n.astype(np.int32)
        code = np.flatnonzero(total)
        yield pa.record_batch([pa.array(code), pa.array(total[code].astype(np.int64))], names=["code", "n"])

    got = labelled.select("url", "rejected").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * SYMBOLS ** (ORDER + 1))
    out[got["code"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(2, *[SYMBOLS] * (ORDER + 1))


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Log-probability of the last symbol after the others, interpolated with all shorter contexts."""
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(ORDER + 1):
        n = counts.sum(axis=tuple(range(ORDER - order)))
        kinds = (n > 0).sum(axis=-1, keepdims=True)
        total = n.sum(axis=-1, keepdims=True)
        p = np.where(total > 0, (n + kinds * p) / np.maximum(total + kinds, 1), np.broadcast_to(p, n.shape))
    return np.log(p)


def calibrated(scores: DataFrame) -> tuple[float, float]:
    """scores(score, rejected): slope and intercept of the log-odds of rejection, from a histogram of BINS by class."""
    at = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("score") / SPAN + 0.5) * BINS).cast("int")))
    rows = scores.groupBy(at.alias("bin"), "rejected").count().collect()  # at most 2 * BINS rows
    x = np.array([(r["bin"] + 0.5) / BINS * SPAN - SPAN / 2 for r in rows])
    y = np.array([float(r["rejected"]) for r in rows])
    w = np.array([float(r["count"]) for r in rows])
    if not len(x) or not 0 < (y * w).sum() < w.sum():
        return 0.0, -30.0
    a, b = -1.0, 0.0
    design = np.stack([x, np.ones_like(x)])
    for _ in range(50):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        grad = design @ (w * (p - y)) + 1e-3 * np.array([a, b])
        hess = (design * (w * np.maximum(p * (1 - p), 1e-9))) @ design.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return float(a), float(b)


def scored(rows: DataFrame, ratio) -> DataFrame:
    """rows with `score`, the mean log-likelihood difference over the characters of the column url; ratio: a broadcast
    table."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, names.index("url")):
            runs, starts = symbols(b.column(names.index("url")))
            score = np.add.reduceat(ratio.value[runs].astype(np.float64), starts[:-1]) / np.diff(starts) if b.num_rows else np.zeros(0)
            yield pa.record_batch([*b.columns, pa.array(score)], names=[*names, "score"])

    return rows.mapInArrow(run, T.StructType(list(rows.schema.fields)).add("score", T.DoubleType()))


def seeded(pages: DataFrame, seeds=SEEDS) -> DataFrame:
    """url and rejected of the URLs with a host: rejected if a word of the host is a seed."""
    host = host_of(F.col("url"))
    return pages.where(host != "").select("url", F.arrays_overlap(F.split(host, r"[.\-]"), F.lit(list(seeds))).alias("rejected"))


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), score (mean log-likelihood difference for each
    character; above 0: more like accepted URLs) and p_block of each row of pages.

    labelled(url, rejected): what is learned from, nulls left out; by default seeded(pages). A rule that fits decides;
    else the URL is blocked if p_block >= threshold, also if they are equal. A null URL or one without :// has empty
    host and path, fits no rule, and is judged as the text it is; a URL of any length is judged whole. Without accepted
    or rejected URLs to learn from, nothing is blocked but by rules. Repeated rows come out as often as they come in;
    other columns are ignored; an empty table gives an empty result.
    """
    known = (seeded(pages) if labelled is None else labelled).where("url is not null and rejected is not null").select("url", "rejected")
    fold = F.crc32(F.col("url")) % 5
    counts = counted(known.where(fold != 0))
    accepted, refused = smoothed(counts[0]), smoothed(counts[1])
    ratio = pages.sparkSession.sparkContext.broadcast((accepted - refused).astype(np.float32).ravel())
    slope, intercept = calibrated(scored(known.where(fold == 0), ratio).select("score", "rejected"))
    rows = scored(pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), ratio)
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    p = 1 / (1 + F.exp(-(F.lit(slope) * F.col("score") + F.lit(intercept))))
    return rows.select("page_id", "host", "path", rule.alias("rule"), "score", p.alias("p_block"), F.coalesce(says, F.when(p >= threshold, "block").otherwise("allow")).alias("verdict"))
