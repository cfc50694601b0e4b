"""Mixing documents to target weights by soft membership, in DataFrame functions only.

A naive-Bayes classifier, fitted on a bounded sample of labelled documents, gives each document its posterior
over domains. Projected-gradient least squares then fits document rates, not below ``least``, whose expected
token totals by domain match the targets. One pass over a table of (id, tokens, posteriors) makes one gradient;
only one number a domain reaches the driver.

Words are runs of characters other than white space, whole and unchanged; their hashes fall into ``BUCKETS`` buckets.
Words of a text aren't independent, so evidence of texts of more than E words counts as that of E words. E is what gives
labelled documents kept out of the counts (one in ``HELD``) the likeliest labels, found in one pass.
Null and empty texts have no words and the domains' prior shares. Repeated rows are documents of their own; rows
of labels that are null or of other domains count for nothing, and of several labels of a document the smallest counts. Empty tables
give empty results. Domains without a labelled document keep a small prior. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Labelled documents that the classifier is fitted on at most, buckets of words, and values of E that are tried.
MOST_LABELLED, BUCKETS, HELD, EVIDENCE = 5000, 16384, 5, (5.0, 10.0, 20.0, 40.0, 80.0, 160.0, 320.0, 1e9)
#: Gradient steps at most, the relative residual that ends them, and steps that must bring a gain.
STEPS, CLOSE, PATIENCE, GAIN = 80, 1e-4, 12, 1e-2


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def _buckets(words: Column) -> Column:
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def _sums(rows: DataFrame, model: DataFrame, domains: list[str], keep: list[str]) -> DataFrame:
    """``keep``, n (words), e (the words' evidence summed by domain) and the model's columns."""
    rows = rows.select(*keep, _buckets(_words(F.col("text"))).alias("at"), F.lit(1).alias("one")).join(F.broadcast(model), "one")

    def evidence(k: int) -> Column:
        return F.aggregate("at", F.lit(0.0), lambda s, b: s + F.get(F.element_at("evidence", k + 1), b))

    return rows.select(*keep, F.size("at").alias("n"), F.array(*(evidence(k) for k in range(len(domains)))).alias("e"), "prior", "most")


def _posterior(most: Column | float) -> Column:
    """Shares of the domains from prior, evidence ``e`` of ``n`` words, and E."""
    weight = F.least(F.lit(1.0), most / F.greatest(F.col("n"), F.lit(1)))
    logs = F.zip_with("prior", "e", lambda a, b: a + weight * b)
    shares = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(shares, lambda x: x / F.aggregate(shares, F.lit(0.0), lambda s, y: s + y))


def classifier(docs: DataFrame, labels: DataFrame, domain: Column, domains: list[str], most_labelled: int = MOST_LABELLED) -> DataFrame:
    """One row: ``prior`` (log, by domain), ``evidence`` (for each domain, log chance of each bucket), ``most`` (E)."""
    spark = docs.sparkSession
    marked = labels.select("doc_id", domain.alias("domain")).where("doc_id is not null").where(F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    sample = checkpoint(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(HELD)) == 0))
    shares = dict(chosen.groupBy("domain").count().collect())
    counts = sample.where("not held").select("domain", F.explode(_buckets(_words(F.col("text")))).alias("bucket")).groupBy("domain", "bucket").count().collect()
    seen = {d: [1.0] * BUCKETS for d in domains}
    for d, bucket, n in counts:
        seen[d][bucket] += n
    whole = {d: sum(x) for d, x in seen.items()}
    table = [[x / whole[d] for x in seen[d]] for d in domains]
    model = spark.createDataFrame([(1, [float(shares.get(d, 0) + 0.5) for d in domains], table)], "one int, share array<double>, chance array<array<double>>")
    model = model.select("one", F.transform("share", lambda x: F.log(x)).alias("prior"), F.transform("chance", lambda row: F.transform(row, lambda x: F.log(x))).alias("evidence"), F.lit(1.0).alias("most"))
    held = _sums(sample.where("held"), model, domains, ["domain"])
    own = F.array_position(F.array(*map(F.lit, domains)), F.col("domain")).cast("int")
    fits = held.agg(*(F.sum(F.log(F.greatest(F.element_at(_posterior(F.lit(most)), own), F.lit(1e-300)))).alias(f"f{k}") for k, most in enumerate(EVIDENCE))).first()
    best = max(range(len(EVIDENCE)), key=lambda k: (fits[k] if fits[k] is not None else 0.0, -k))
    return model.withColumn("most", F.lit(EVIDENCE[best]))


def memberships(docs: DataFrame, model: DataFrame, domains: list[str]) -> DataFrame:
    """(doc_id, n_tokens, p): the posterior over domains."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _sums(rows, model, domains, ["doc_id"]).select("doc_id", F.col("n").cast("long").alias("n_tokens"), _posterior(F.col("most")).alias("p"))


def totals(rows: DataFrame, n: int, rate: str = "rate") -> list[float]:
    """Expected tokens of each domain under the rates."""
    got = rows.agg(*(F.sum(F.col(rate) * F.col("n_tokens") * F.element_at("p", k + 1)) for k in range(n))).first()
    return [x or 0.0 for x in got]


def _products(rows: DataFrame, n: int) -> np.ndarray:
    """Sums over documents of tokens times the posteriors of two domains."""
    pairs = [(k, j) for k in range(n) for j in range(k, n)]
    p = [F.element_at("p", k + 1) for k in range(n)]
    got = rows.agg(*(F.sum(F.col("n_tokens") * p[k] * p[j]) for k, j in pairs)).first()
    out = np.zeros((n, n))
    for (k, j), x in zip(pairs, got, strict=True):
        out[k, j] = out[j, k] = x or 0.0
    return out


def fit_rates(members: DataFrame, targets: list[float], least: float = 0.0, grow: bool = False) -> DataFrame:
    """Add ``rate`` and ``residual`` to (doc_id, n_tokens, p).

    The wanted totals are the target shares of all tokens, or, with ``grow``, of the smallest total at which no
    domain has to shrink. A step moves each rate against the sum of its posteriors times the domains' residuals, which are
    multiplied by the inverse of the domains' sums of products: under that metric step length 1 can't overshoot, and one step is enough
    where no rate meets its bound. Then rates below ``least`` are set to it, and the next step starts somewhat further along the way (Nesterov's momentum, dropped where the squares grew). Steps
    end when all totals are within ``CLOSE`` of what is wanted, or when ``PATIENCE`` steps no longer bring the squares down by a
    share of ``GAIN``, as with targets that no rates meet. ``residual`` is the largest miss that is left, as a share of all wanted tokens;
    if it is above ``CLOSE`` there is a warning as well.
    """
    n = len(targets)
    rows = members.withColumns({"rate": F.lit(1.0), "ahead": F.lit(1.0)})
    own = totals(rows, n)
    share = [t / sum(targets) for t in targets]
    whole = max((o / s for o, s in zip(own, share, strict=True) if s > 0), default=0.0) if grow else sum(own)
    wanted = [whole * s for s in share]
    floor = 1e-9 * max(whole, 1.0)
    metric = np.linalg.pinv(_products(rows, n), rcond=1e-9, hermitian=True)
    now, ahead, weight, squares = own, own, 1.0, []
    for step in range(STEPS + 1):
        residual = max(abs(a - b) for a, b in zip(now, wanted, strict=True)) / max(whole, 1.0)
        squares.append(sum((a - b) ** 2 / max(o, floor) for a, b, o in zip(now, wanted, own, strict=True)))
        if residual <= CLOSE or step == STEPS or step >= PATIENCE and squares[-1] > (1 - GAIN) * min(squares[:-PATIENCE]):
            break
        off = metric @ (np.array(ahead) - np.array(wanted))
        move = sum((F.element_at("p", k + 1) * float(off[k]) for k in range(n)), F.lit(0.0))
        rows = rows.withColumns({"rate": F.greatest(F.lit(float(least)), F.col("ahead") - move), "before": F.col("rate")})
        before, now = now, totals(rows, n)
        worse = sum((a - b) ** 2 / max(o, floor) for a, b, o in zip(now, wanted, own, strict=True)) > squares[-1]
        longer = 1.0 if worse else (1 + (1 + 4 * weight * weight) ** 0.5) / 2
        push = 0.0 if worse else (weight - 1) / longer
        rows = rows.withColumn("ahead", F.col("rate") + push * (F.col("rate") - F.col("before"))).drop("before")
        ahead, weight = [a + push * (a - b) for a, b in zip(now, before, strict=True)], longer
        if step % 8 == 7:
            rows = checkpoint(rows)
    if residual > CLOSE:
        warnings.warn(f"token totals miss their targets by up to {residual:.2e} of all tokens", stacklevel=2)
    return rows.drop("ahead").withColumn("residual", F.lit(float(residual)))


def with_copies(rows: DataFrame, seed: int = 7) -> DataFrame:
    """Add ``copies``: the rate's whole part, and one more with the chance of the rest, by a hash of the id."""
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return rows.withColumn("copies", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))


def mix(docs: DataFrame, labels: DataFrame, domain: Column, targets: dict[str, float], least: float = 0.0, grow: bool = False, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, n_tokens, p, rate, residual, copies) for each row of ``docs``; ``p`` follows the sorted names of ``targets``."""
    domains = sorted(targets)
    members = checkpoint(memberships(docs, classifier(docs, labels, domain, domains, most_labelled), domains))
    return with_copies(fit_rates(members, [targets[d] for d in domains], least, grow))


def quality_domain() -> Column:
    """Domain of a label row by its quality and toxic marks."""
    return F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string"))


