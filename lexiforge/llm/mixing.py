"""Mixing sources to target weights by Poisson replication.

Each document's number of copies is drawn by inverting a Poisson distribution, cut at the source's cap, at a uniform
number made from a hash of its id and the seed, so a lost task draws the same again. The mean starts as the source's target
repetition rate (its target share of the size of all documents over its own size) and is then calibrated: as all numbers are
known, so is the size a mean draws, and the mean is chosen whose draw meets the wanted size. So a few very long documents don't
spoil a share. What sources at their cap leave is handed on to the others in proportion to their targets, as far as their caps
allow. The draws are exploded and shuffled globally by another hash.

The draw is known from a histogram of the numbers, weighted by tokens (``BUCKETS`` a source), which is reduced on the map side: a source with a
third of all rows is no hot group, and means are calibrated source by source on the executors. Any number of sources, rates and caps will do:
distributions are built around their mode, so nothing underflows.

Sizes are tokens of a public tokenizer, over all documents. Documents of a source that the plan doesn't name, or of none, count towards
the total and are not drawn. Sources without documents can't reach a positive share. Null and empty texts have size 0; null shares and caps are 0.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.tokens import with_token_counts
from lexiforge.runtime import cut, join_unique

BUCKETS = 4096  # of the uniform numbers, a source
SMALL_PLAN = 10_000  # sources up to which the plan is broadcast
ROUNDS = 50  # of handing on


def sized_documents(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of all documents."""
    return with_token_counts(documents.select("doc_id", "source", "text"), path=path)


def uniform(column: str, seed: int):
    """A number in [0, 1) made from a hash of a column and a seed."""
    return (F.pmod(F.xxhash64(F.col(column), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))).cast("double")


def poisson_steps(lam: float, cap: int) -> tuple[int, list[float]]:
    """(base, P(copies <= k) for k = base ...) of Poisson(lam) cut at cap; below base and beyond the list lies less than 1e-16.

    A uniform number draws base copies and one more for each step that it reaches.
    """
    reach = 9.5 * math.sqrt(lam) + 40
    low, high = max(0, int(lam - reach)), min(cap, int(lam + reach))
    if low >= cap:
        return cap, []
    if lam <= 0:
        return 0, [1.0]
    p, total, steps = math.exp(low * math.log(lam) - lam - math.lgamma(low + 1)), 0.0, []
    for k in range(low, high):
        total += p
        steps.append(min(1.0, total))
        p *= lam / (k + 1)
    return low, steps


def calibrated(tokens, wanted: float, cap: int) -> tuple[int, list[float]]:
    """(base, steps) of the cut distribution whose draw has about ``wanted`` tokens; tokens by bucket of the uniform number."""
    import numpy as np

    tokens = np.asarray(tokens, dtype=np.float64)
    own = tokens.sum()
    if wanted <= 0 or cap <= 0 or own <= 0:
        return (0, [1.0]) if wanted <= 0 or cap <= 0 else (cap, [])
    if wanted >= cap * own:
        return cap, []
    above = np.concatenate([[own], own - np.cumsum(tokens)])  # tokens at or above each bucket's begin
    edges = np.arange(len(tokens) + 1) / len(tokens)

    def drawn_by(lam: float) -> float:
        base, steps = poisson_steps(lam, cap)
        return base * own + float(np.interp(steps, edges, above).sum())

    low, high = 0.0, max(1.0, wanted / own)
    while drawn_by(high) < wanted:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if drawn_by(mid) < wanted else (low, mid)
    return poisson_steps(high, cap)


def mixing_plan(sized: DataFrame, plan: DataFrame, seed: int = 7) -> DataFrame:
    """One row a planned source: target, cap, own, all, wanted and handed-on tokens, and the distribution to draw from."""
    bucket = F.floor(uniform("doc_id", seed) * BUCKETS).cast("int")
    spread = cut(sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("n_tokens").alias("n")))
    total = spread.agg(F.sum("n")).first()[0] or 0
    own = spread.groupBy("source").agg(F.sum("n").alias("own_tokens"))
    named = plan.groupBy("source").agg(F.first("target_share").alias("target_share"), F.first("max_repeats").alias("max_repeats"))
    sources = cut(
        named.join(own, "source", "left").select(
            "source",
            F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
            F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).cast("long").alias("max_repeats"),
            F.coalesce("own_tokens", F.lit(0)).alias("own_tokens"),
        )
    )  # one row a source
    wanted, most = F.col("target_share") * total, F.col("max_repeats").cast("double") * F.col("own_tokens")
    factor = 1.0
    for _ in range(ROUNDS):  # each round more sources are full, or it is the last
        full = factor * wanted >= most
        held, open_ = sources.agg(
            F.coalesce(F.sum(F.when(full, F.least(most, factor * wanted))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, wanted)), F.lit(0.0))
        ).first()
        aim = min(1.0, sources.agg(F.sum("target_share")).first()[0] or 0.0) * total
        if open_ <= 0 or (aim - held) / open_ <= factor * (1 + 1e-9):
            break
        factor = (aim - held) / open_
    told = sources.select(
        "*", F.lit(total).cast("long").alias("all_tokens"), wanted.alias("wanted_tokens"), F.least(most, factor * wanted).alias("given_tokens")
    )

    def fit(pdf):
        import numpy as np
        import pandas as pd

        r = pdf.iloc[0]
        tokens = np.zeros(BUCKETS)
        known = pdf["bucket"].notna()
        tokens[pdf["bucket"][known].astype(int)] = pdf["n"][known]
        cap = int(r["max_repeats"])
        full = r["given_tokens"] >= cap * r["own_tokens"]
        base, steps = (cap, []) if full and r["wanted_tokens"] > 0 else calibrated(tokens, r["given_tokens"], cap)
        return pd.DataFrame([[*(r[c] for c in kept), base, steps]], columns=[*kept, "base", "steps"])

    kept = told.columns
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in told.schema.fields)
    # null sources of the plan meet no document; the group of a source has a row a bucket at most
    return cut(told.join(spread, "source", "left").groupBy("source").applyInPandas(fit, f"{fields}, base long, steps array<double>"))


def drawn(docs: DataFrame, plan_rows: DataFrame, seed: int = 7) -> DataFrame:
    """Adds ``copies``, the number of times each document of a planned source is drawn."""
    steps = plan_rows.filter("source is not null").select("source", "base", "steps")
    kept = docs.columns
    if steps.count() <= SMALL_PLAN:
        joined = docs.join(F.broadcast(steps), "source")
    else:
        joined = join_unique(docs, steps, "source").filter("base is not null")
    reached = F.filter("steps", lambda s: uniform("doc_id", seed) >= s)
    return joined.select(*kept, (F.col("base") + F.size(reached)).alias("copies"))


def mix(documents: DataFrame, plan: DataFrame, seed: int = 7, path: str | None = None) -> DataFrame:
    """(doc_id, source, text, copy_no, place): the drawn documents, spread over all partitions and ordered in each by ``place``.

    Texts are tokenised once, for the sizes; drawing needs the id alone.
    """
    plan_rows = mixing_plan(sized_documents(documents, path), plan, seed)
    few = drawn(documents.select("doc_id", "source", "text"), plan_rows, seed).filter("copies > 0")
    copies = few.select("doc_id", "source", "text", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy_no"))
    placed = copies.withColumn("place", F.xxhash64("doc_id", "copy_no", F.lit(seed + 1)))
    return placed.repartition("place").sortWithinPartitions("place")


def shares(documents: DataFrame, plan: DataFrame, seed: int = 7, path: str | None = None) -> DataFrame:
    """(source, target_share, given_share, actual_share, n_docs, n_copies, n_tokens, reachable): what the draw reaches.

    ``given_share`` is the target after handing on. A source isn't reachable if it draws less than its target although each
    of its documents is drawn as often as its cap allows.
    """
    sized = cut(sized_documents(documents, path))
    mp = mixing_plan(sized, plan, seed)
    got = (
        drawn(sized, mp, seed)
        .groupBy("source")
        .agg(
            F.count_if(F.col("copies") > 0).alias("n_docs"),
            F.sum("copies").alias("n_copies"),
            F.sum(F.col("copies") * F.col("n_tokens")).alias("n_tokens"),
        )
    )
    got = cut(got)  # one row a source
    whole = got.agg(F.sum("n_tokens")).first()[0] or None
    size = F.coalesce("n_tokens", F.lit(0))
    at_cap = size >= F.col("max_repeats") * F.col("own_tokens")
    return mp.join(got, "source", "left").select(
        "source",
        "target_share",
        F.try_divide("given_tokens", "all_tokens").alias("given_share"),
        (size / F.lit(whole).cast("double")).alias("actual_share"),
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
        F.coalesce("n_copies", F.lit(0)).alias("n_copies"),
        size.alias("n_tokens"),
        (~at_cap | (size >= F.col("wanted_tokens"))).alias("reachable"),
    )
