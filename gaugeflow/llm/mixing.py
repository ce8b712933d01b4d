"""Mixing sources to target weights with soft membership, in DataFrame functions only.

A classifier learned from a labelled table gives every document its domain posteriors; projected
gradient steps then fit nonnegative document rates, such that the expected tokens of each domain
(rate x tokens x posterior, summed) match the targets.
"""

from __future__ import annotations

import math
import zlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, staged, table

#: The domains of the labels table, and the share of tokens each should have.
DOMAINS = ["low", "low_toxic", "high", "high_toxic"]
TARGETS = {"low": 0.01, "low_toxic": 0.0005, "high": 0.9795, "high_toxic": 0.01}
#: The classifier learns from so many labelled rows at most, taken in the order of a hash, and
#: from the presence of words in LEAST_ROWS of them at least.
SAMPLE_ROWS, LEAST_ROWS = 4000, 5
#: A word tells a domain if it is so many times as frequent there as elsewhere, beyond chance by
#: so much (log-likelihood); one word's say is bounded.
LIFT, EVIDENCE, SAY = 4.0, 12.0, 5.0
#: Of adjacent words so large a share is equal where a text counts as repetitive.
REPEATS, REPETITIVE = 0.2, "<repetitive>"
#: Targets count as met within this share of each; gradient steps at most until then.
CLOSE, STEPS = 0.005, 40
#: The model's words lie in so many slots by their hash, so that a word is looked up among a few.
SLOTS = 512
WHITE = "[\\x20\\x09-\\x0D]+"


def domain_of(labels: DataFrame) -> Column:
    quality, toxic = F.col("quality"), F.col("toxic")
    return F.when(quality.isin(0, 1) & toxic.isin(0, 1), quality * 2 + toxic)


def once(value: Column, f) -> Column:
    """f of a value that is evaluated a single time however often f uses it."""
    return F.transform(F.array(value), f)[0]


def words_of(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), WHITE)


def marked(w: Column) -> Column:
    """Words, and a mark if they are repetitive."""
    same = F.size(F.filter(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: a == b), lambda x: x))
    return F.when(same > REPEATS * F.size(w), F.concat(w, F.array(F.lit(REPETITIVE)))).otherwise(w)


def count_of(w: Column) -> Column:
    """Splitting leaves an empty string before leading and after trailing white space."""
    ends = (F.element_at(w, 1) == "").cast("int") + ((F.size(w) > 1) & (F.element_at(w, -1) == "")).cast("int")
    return (F.size(w) - ends).cast("long")


def learn_domains(docs: DataFrame, labelled: DataFrame, key: str, text: str, domains: int):
    """Bernoulli naive Bayes over the words that tell the domains apart best: (words, base, gain),
    the logit of domain j being base[j] plus gain[w][j] of every word present."""
    draw = F.xxhash64(F.col(key))
    rows = labelled.filter(F.col("domain").isNotNull() & F.col(key).isNotNull()).withColumn("draw", draw).orderBy("draw", "domain").limit(SAMPLE_ROWS)
    sample = docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(rows.select(key, "domain")), key)
    sample = staged(sample.select("domain", F.array_distinct(once(words_of(F.col("text")), marked)).alias("words")), "labelled")
    per_domain = {r[0]: r[1] for r in sample.groupBy("domain").count().collect()}
    n = [per_domain.get(j, 0) for j in range(domains)]
    total = sum(n)
    if not total:
        return [], [0.0] * domains, {}
    seen = sample.select("domain", F.explode("words").alias("word")).filter("word <> ''")
    seen = seen.groupBy("word").agg(F.count("*").alias("n"), *(F.count_if(F.col("domain") == j).alias(f"n{j}") for j in range(domains)))
    # How much likelier the rows are with a share of the word for each domain than with one share.
    def fit(k, m):
        share = (k + 0.5) / (m + 1.0)
        return k * F.log(share) + (m - k) * F.log(1 - share)

    def lift(j):
        elsewhere = (F.col("n") - F.col(f"n{j}") + 0.5) / (total - n[j] + 1.0)
        return (F.col(f"n{j}") + 0.5) / (n[j] + 1.0) / elsewhere

    told = sum((fit(F.col(f"n{j}"), F.lit(float(n[j]))) for j in range(domains)), F.lit(0.0)) - fit(F.col("n"), F.lit(float(total)))
    telling = (F.col("n") >= LEAST_ROWS) & (F.greatest(*(lift(j) for j in range(domains))) >= LIFT) & (told >= EVIDENCE)
    best = seen.filter(telling).orderBy("word").collect()  # from SAMPLE_ROWS texts
    base = [math.log((n[j] + 0.5) / (total + 0.5 * domains)) for j in range(domains)]
    gain = {}
    for r in best:
        share = [(r[f"n{j}"] + 0.5) / (n[j] + 1.0) for j in range(domains)]
        odds = [math.log(p / (1 - p)) for p in share]
        middle = sum(odds) / domains  # what all have in common tells nothing
        gain[r.word] = [max(-SAY, min(SAY, x - middle)) for x in odds]
        base = [b + math.log(1 - p) for b, p in zip(base, share)]
    return list(gain), base, gain


def scored(text: Column, model, domains: int) -> Column:
    """Struct of the number of words and the domains' likelihoods relative to the best one. A
    text is split once, and searched for the model's words only."""
    words, base, gain = model
    slots = [[] for _ in range(SLOTS)]
    for w in words:
        slots[zlib.crc32(w.encode()) % SLOTS].append(w)
    order = [w for slot in slots for w in slot]
    starts = [0]
    for slot in slots[:-1]:
        starts.append(starts[-1] + len(slot))
    known = F.array(*(F.array(*map(F.lit, slot)) if slot else F.expr("cast(array() as array<string>)") for slot in slots))

    def slot_of(x):
        return (F.crc32(x.cast("binary")) % SLOTS + 1).cast("int")

    def places(w):
        present = F.filter(F.array_distinct(marked(w)), lambda x: F.array_contains(F.element_at(known, slot_of(x)), x))
        return F.transform(present, lambda x: (F.element_at(F.expr(f"array({', '.join(map(str, starts))})"), slot_of(x)) + F.array_position(F.element_at(known, slot_of(x)), x)).cast("int"))

    def logit(p, j):
        gains = F.expr(f"array({', '.join(f'{gain[w][j]!r}D' for w in order) or '0D'})")
        return F.aggregate(p, F.lit(base[j]), lambda a, x: a + F.element_at(gains, x))

    def softened(z):
        return F.transform(z, lambda x: F.exp(x - F.array_max(z)))

    def both(w):
        e = once(places(w), lambda p: once(F.array(*(logit(p, j) for j in range(domains))), softened))
        return F.struct(count_of(w).alias("n_tokens"), e.alias("e"))

    return once(words_of(text), both)


def soft_membership(docs: DataFrame, labelled: DataFrame, domains: int, key: str, text: str, keep: list[str]) -> DataFrame:
    """`keep` columns, n_tokens and p (posteriors) of every document; p sums to 1."""
    model = learn_domains(docs, labelled, key, text, domains)
    rows = docs.select(*keep, scored(F.col(text), model, domains).alias("_s"))
    total = F.aggregate("_s.e", F.lit(0.0), lambda a, x: a + x)
    return rows.select(*keep, F.col("_s.n_tokens").alias("n_tokens"), once(total, lambda t: F.transform("_s.e", lambda x: x / t)).alias("p"))


class Fit(NamedTuple):
    """How the rates came out: wanted and reached tokens of each domain, relative to all tokens that
    there are; the pull of each domain on a rate; whether every target is met within CLOSE."""

    wanted: list[float]
    reached: list[float]
    pull: list[float]
    met: bool


def wanted_tokens(present: list[float], targets: list[float | None]) -> list[float]:
    """Tokens of each domain, given those present. Targets for all domains are shares of the present
    total; where some have none, these domains keep their tokens and the targets are shares of
    what comes out."""
    given = sum(t for t in targets if t is not None)
    if all(t is not None for t in targets):
        return [sum(present) * t / given for t in targets]
    if given >= 1:
        raise ValueError("targets leave nothing for the other domains")
    total = sum(x for x, t in zip(present, targets) if t is None) / (1 - given)
    return [x if t is None else t * total for x, t in zip(present, targets)]


def rate_of(p: Column, pull: list[float]) -> Column:
    """The pull is one array, which generated code refers to: numbers would be part of the code, which
    the driver would then generate and compile anew for each step."""
    told = F.zip_with(p, F.lit([float(u) for u in pull]), lambda x, u: u * x)
    return F.greatest(F.lit(0.0), F.aggregate(told, F.lit(1.0), lambda total, x: total + x))


def fit_rates(rows: DataFrame, targets: list[float | None], ceilings: bool = False) -> tuple[DataFrame, Fit]:
    """`rows(..., n_tokens, p)` with a nonnegative rate, and how the fit came out.

    Least squares: of all rates that give the domains their tokens, those with the least token
    mean of (rate - 1)^2. Projected gradient: the gradient of a row lies along its p, so all steps
    so far are one number a domain (the pull), the steps accumulate from 1, and the rate is their
    projection onto 0 and more. A step is scaled by the second moments of p over the rows above 0, and
    halved until it descends. It costs one aggregation of a few sums over n_tokens and p; the texts
    are not read again, and the driver holds sums alone. Targets out of reach (a domain without
    tokens, or shares that no mixture of the posteriors has) end after STEPS with met = False.
    """
    domains = len(targets)
    names = [f"p{j}" for j in range(domains)]
    small = staged(rows.select("n_tokens", *(F.col("p")[j].alias(n) for j, n in enumerate(names))), "posteriors")
    sums = small.agg(F.sum("n_tokens"), *(F.sum(F.col("n_tokens") * F.col(n)) for n in names)).first()
    total = float(sums[0] or 0)
    if not total:
        return rows.withColumn("rate", F.lit(1.0)), Fit([0.0] * domains, [0.0] * domains, [0.0] * domains, False)
    present = [float(x) / total for x in sums[1:]]
    if ceilings:
        targets = [t if t is not None and x > t else None for x, t in zip(present, targets)]
    wanted = np.array(wanted_tokens(present, targets))

    def measured(pull):
        """Reached tokens, the value that steps lower, and the moments of rows above 0."""
        rate = rate_of(F.array(*names), list(pull))
        mass, above = F.col("n_tokens") / total, F.when(F.col("rate") > 0, F.col("mass")).otherwise(0.0)
        at = small.select(*names, rate.alias("rate"), mass.alias("mass"))
        pairs = [(j, k) for j in range(domains) for k in range(j + 1)]
        row = at.agg(
            F.sum(F.col("mass") * F.col("rate") * F.col("rate")) / 2,
            *(F.sum(F.col("mass") * F.col("rate") * F.col(n)) for n in names),
            *(F.sum(above * F.col(names[j]) * F.col(names[k])) for j, k in pairs),
        ).first()
        reached, moments = np.array(row[1 : domains + 1], float), np.zeros((domains, domains))
        for (j, k), x in zip(pairs, row[domains + 1 :]):
            moments[j, k] = moments[k, j] = x
        return reached, float(row[0]) - float(np.dot(pull, wanted)), moments

    def close(reached):
        return bool((np.abs(reached - wanted) <= CLOSE * wanted + 1e-12).all())

    pull = np.zeros(domains)
    reached, value, moments = measured(pull)
    size = 1.0
    for _ in range(STEPS):
        if close(reached):
            break
        step = np.linalg.lstsq(moments + 1e-12 * np.eye(domains), wanted - reached, rcond=None)[0]
        there = measured(pull + size * step)
        if there[1] < value:
            pull, (reached, value, moments), size = pull + size * step, there, min(1.0, 2 * size)
        else:
            size /= 4
    fit = Fit(wanted.tolist(), reached.tolist(), pull.tolist(), close(reached))
    return rows.withColumn("rate", rate_of(F.col("p"), fit.pull)), fit


def document_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, ceilings: bool = False) -> DataFrame:
    """`keep` columns (key by default), n_tokens, p_<domain>, rate and targets_met of every document.

    Domains left out of `targets` keep their tokens; with `ceilings` so do those that have less
    than their target. targets_met is false in all rows if the
    targets can't be reached. Labels other than 0 or 1 and null keys teach nothing; without
    labelled rows every domain is as likely. Null and empty texts have no tokens, hence no weight in
    the sums, but a rate like others of their posteriors. Repeated rows count each; an empty table
    gives no rows.
    """
    labelled = labels.select(key, domain_of(labels).alias("domain"))
    rows = staged(soft_membership(docs, labelled, len(DOMAINS), key, text, keep or [key]), "members")
    release(docs.sparkSession)
    rated, fit = fit_rates(rows, [targets.get(d) for d in DOMAINS], ceilings)
    return rated.select(*(keep or [key]), "n_tokens", *(F.col("p")[j].alias(f"p_{d}") for j, d in enumerate(DOMAINS)), "rate", F.lit(fit.met).alias("targets_met"))


def copies(rate: Column, *identity: str) -> Column:
    """How often a row goes into the mixture: the rate, rounded up or down by a hash of the row."""
    draw = F.pmod(F.xxhash64(*identity), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + draw).cast("int")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
