"""Secrets in texts: fixed formats, and character Markov models for the rest.

Two first-order character models are trained from labelled samples: the strings that the fixed formats find
are random ones, long tokens of letters joined by - or _ are ordinary identifiers. A long token is a further
secret if the log-likelihood ratio of the two models, summed over its transitions, exceeds a threshold; a token
without letters or without digits is none. The threshold is calibrated on the samples of a fold held back: the
least one, not below LEAST_ODDS, that at most MOST_FALSE of the ordinary ones exceed. Built-in functions only; what
reaches the driver is one count per label and character pair, and one per label and rounded score.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import constant, documents, stored
from .pii import marked

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A maximal run is found either way, so the least length may stand in the pattern.
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
#: What the models judge: long runs of the characters of encoded keys.
LEAST_TOKEN = 16
LONG_TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
ORDINARY = r"^[A-Za-z]+([_-][A-Za-z]+)*$"
#: Characters + to z, by code less FIRST.
FIRST, WIDTH = 43, 80
#: Weight of the characters' overall shares beside the counts after one character.
BACKED = 10.0
#: Least log-likelihood ratio of a secret (odds of 1,000 to 1 against one are made up for), the share of ordinary
#: tokens held back that may exceed the threshold, one sample in so many is held back.
LEAST_ODDS, MOST_FALSE, FOLDS = 7.0, 1e-4, 4


def base_spans(text: Column) -> Column:
    long_enough = lambda body: F.length(body) >= 8
    always = lambda body: F.lit(True)
    return spans.ordered(
        F.concat(
            spans.find(text, ASSIGN, "assign", 0, long_enough, group=2),
            spans.find(text, ACCESS, "access", 1, always),
            spans.find(text, HEX, "hex", 2, always),
        )
    )


def _codes(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.ascii(c) - FIRST)


def _transitions(token: Column) -> Column:
    """Index of each neighbouring character pair in the table of the model; others than FIRST.. are left out."""
    codes = F.filter(_codes(token), lambda c: (c >= 0) & (c < WIDTH))
    return F.zip_with(
        F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))),
        F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))),
        lambda a,
        b: a * WIDTH + b,
    )


def samples(docs: DataFrame) -> DataFrame:
    """label (1 secret, 0 ordinary), token and n of every labelled sample of every text."""
    text = F.col("text")
    secret = F.transform(base_spans(text), lambda s: F.struct(F.lit(1).alias("label"), s["body"].alias("token")))
    ordinary = F.transform(
        F.filter(F.regexp_extract_all(text, F.lit(LONG_TOKEN), F.lit(0)), lambda t: t.rlike(ORDINARY)),
        lambda t: F.struct(F.lit(0).alias("label"), t.alias("token")),
    )
    each = docs.select(F.coalesce("text", F.lit("")).alias("text")).select(F.inline(F.concat(secret, ordinary)))
    return each.groupBy("label", "token").agg(F.count("*").alias("n"))


def score(token: Column, ratio: Column) -> Column:
    return F.aggregate(_transitions(token), F.lit(0.0), lambda a, p: a + ratio[p])


def _ratios(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio for each of WIDTH x WIDTH transitions; all 0 without samples."""
    pairs = samples.select("label", "n", F.explode(_transitions(F.col("token"))).alias("pair")).groupBy("label", "pair").agg(F.sum("n"))
    seen = [[[0.0] * WIDTH for _ in range(WIDTH)] for _ in range(2)]
    for label, pair, n in pairs.collect():
        seen[label][pair // WIDTH][pair % WIDTH] += n
    ordinary, secret = (_log_probabilities(s) for s in seen)
    return [round(secret[a][b] - ordinary[a][b], 6) for a in range(WIDTH) for b in range(WIDTH)]


def _threshold(held: DataFrame, ratio: list[float]) -> float:
    """From the distinct ordinary samples held back; LEAST_ODDS where these, few or many, don't raise it."""
    value = F.round(score(F.col("token"), constant(ratio, "array<double>")) * 2) / 2
    rows = (
        held.where((F.length("token") >= LEAST_TOKEN) & (F.col("label") == 0))
        .groupBy(F.least(F.greatest(value, F.lit(-500.0)), F.lit(500.0)).alias("score"))
        .count()
        .collect()
    )
    allowed = MOST_FALSE * sum(r["count"] for r in rows)
    over = lambda at: sum(r["count"] for r in rows if r["score"] > at)
    return next(at for at in sorted({LEAST_ODDS, *(r["score"] + 0.5 for r in rows if r["score"] + 0.5 > LEAST_ODDS)}) if over(at) <= allowed)


def train(docs: DataFrame) -> tuple[list[float], float]:
    """Ratios of all transitions, and the threshold, from the samples of every text.

    The models that calibrate it don't know the samples held back; those returned know all. Without samples of a label
    all ratios are 0 or near, so nothing exceeds the threshold.
    """
    known = stored(samples(docs).withColumn("held", F.pmod(F.xxhash64("token"), F.lit(FOLDS)) == 0), "samples")
    threshold = _threshold(known.where("held"), _ratios(known.where("not held")))
    return _ratios(known), threshold


def _log_probabilities(seen: list[list[float]]) -> list[list[float]]:
    """Of each character after each other: a row's counts with BACKED of what the characters have overall."""
    total = [1 + sum(row[b] for row in seen) for b in range(WIDTH)]
    overall = [t / sum(total) for t in total]
    return [[math.log((row[b] + BACKED * overall[b]) / (sum(row) + BACKED)) for b in range(WIDTH)] for row in seen]


def scan(docs: DataFrame, log_odds: float | None = None) -> DataFrame:
    """docs with base and spans, arrays of SPAN in order; spans holds base and what the models add (kind markov).

    log_odds overrides the calibrated threshold. Null text counts as empty. Every row gives one row; columns named
    base or spans are replaced.
    """
    ratios, threshold = train(docs)
    threshold = threshold if log_odds is None else log_odds
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("base", base_spans(text))
    ratio = constant(ratios, "array<double>")
    mixed = lambda t: F.when(~t.rlike("[A-Za-z]") | ~t.rlike("[0-9]"), F.lit(False)).otherwise(score(t, ratio) > threshold)
    added = spans.find(text, LONG_TOKEN, "markov", 3, mixed)
    return out.withColumn("spans", spans.ordered(F.concat(F.col("base"), spans.clear_of(added, F.col("base")))))


def redact(docs: DataFrame, mark: str = "[secret]", log_odds: float | None = None) -> DataFrame:
    """docs with every span of scan() replaced by mark, overlapping spans as one; texts without one, null ones too, stay."""
    return marked(docs, lambda held: scan(held, log_odds), mark)


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Counts and places of secrets in every text: fixed formats, and what the models add; null counts as empty."""
    found = scan(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        spans.count_of(F.col("base"), "assign").alias("n_assign"),
        spans.count_of(F.col("base"), "access").alias("n_access"),
        spans.count_of(F.col("base"), "hex").alias("n_hex"),
        F.sha2(spans.written(F.col("base")), 256).alias("base_sha256"),
        spans.written(F.col("spans")).alias("spans"),
    )
