"""Mixing sources to target weights."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.session import cut, spread_out

#: The tokenizer's vocabulary as ranks, a path that every executor can read; the session's
#: setting of this name comes first. The pattern below is the one it was published with.
SETTING, VOCABULARY = "spark.codelode.vocabulary", "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern of that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encoders: dict[str, object] = {}
NEWTON_STEPS, NEWTON_ERROR = 40, 1e-9
#: Score bins per refinement of the rounding threshold, and the refinements.
BINS, REFINEMENTS = 1024, 4


def _encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def source_name(c: Column) -> Column:
    """One spelling per source: no outer spaces, lower case, underscores for spaces and hyphens; blank counts as null."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"(?U)[\s\-]+", "_")
    return F.when(plain != "", plain)


def token_counts(documents: DataFrame, doc_id: str, source: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, tokens) over whole texts, one row per document id; a null text has no tokens."""

    vocabulary = vocabulary or documents.sparkSession.conf.get(SETTING, VOCABULARY)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(vocabulary).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "tokens": [len(encode(t)) if t else 0 for t in batch["text"]]})

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), source_name(F.col(source)).alias("source"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull())
    counted = spread_out(rows, "doc_id").mapInPandas(count, "doc_id long, source string, tokens long")
    return counted.groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("_f")).select("doc_id", "_f.source", "_f.tokens")


def wanted_shares(targets: DataFrame) -> pd.DataFrame:
    """source, share, cap: one row per source, with the sum of its shares and its largest cap; rows without source, share or cap, or not above zero, are dropped."""
    rows = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("cap"))
    good = rows.where((F.col("share") > 0) & (F.col("cap") > 0) & F.col("source").isNotNull() & ~F.isnan("share"))
    return good.groupBy("source").agg(F.sum("share").alias("share"), F.max("cap").alias("cap")).toPandas().set_index("source").sort_index()


def balanced_rates(histogram: DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
    """plan plus ``tilt``: the multiplier of each source's token constraint.

    Documents start at the rate cap / 2 and are tilted exponentially, rate = cap * s(tilt +
    log-odds of the start) with s the logistic function, which is the entropy-balanced rate
    between 0 and cap; a document's weight in the constraint is its tokens. The dual is
    convex and its Newton step needs, per source, the sum of tokens under the present rates
    and its derivative: one aggregation over the histogram of (source, tokens) per step,
    of which one row per target source comes back.
    """
    spark = histogram.sparkSession
    mean = plan["available"] / plan["documents"].clip(lower=1)
    tilt = pd.Series(0.0, plan.index)
    low, high = pd.Series(-np.inf, plan.index), pd.Series(np.inf, plan.index)
    for _ in range(NEWTON_STEPS):
        state = spark.createDataFrame(pd.DataFrame({"source": plan.index, "cap": plan["cap"].astype(float), "tilt": tilt, "mean": mean}), "source string, cap double, tilt double, mean double")
        x = F.col("tokens") / F.col("mean")
        s = 1 / (1 + F.exp(-F.col("tilt") * x))
        mass = F.col("n") * F.col("tokens") * F.col("cap") * s
        step = histogram.join(F.broadcast(state), "source").groupBy("source").agg(F.sum(mass).alias("now"), F.sum(mass * (1 - s) * x).alias("slope")).toPandas().set_index("source").reindex(plan.index)
        gap = step["now"] - plan["goal"]
        low, high = low.where(gap > 0, tilt), high.where(gap <= 0, tilt)
        if (gap.abs() <= NEWTON_ERROR * plan["goal"].clip(lower=1)).all():
            break
        moved = tilt - gap / step["slope"].replace(0, np.nan)
        # Newton where it stays between the bounds met so far, else bisection or a longer step.
        middle = (low + high) / 2
        middle = middle.where(np.isfinite(middle), np.where(np.isfinite(low), low.abs() * 2 + 1, -(high.abs() * 2 + 1)))
        tilt = moved.where((moved > low) & (moved < high) & np.isfinite(moved), middle).clip(-60, 60)
    return plan.assign(tilt=tilt, mean=mean)


def _thresholds(scored: DataFrame, plan: pd.DataFrame) -> pd.Series:
    """Per source, the score up to which documents get one more copy, so that the tokens come nearest to ``missing``.

    A distributed selection: per refinement one aggregation into BINS bins of the present
    range of scores; of each source only the bin that holds its threshold is cut further.
    """
    spark = scored.sparkSession
    low, high = pd.Series(-1.0, plan.index), pd.Series(1.0, plan.index)
    base = pd.Series(0.0, plan.index)
    for _ in range(REFINEMENTS):
        state = spark.createDataFrame(pd.DataFrame({"source": plan.index, "low": low, "high": high}), "source string, low double, high double")
        inside = scored.join(F.broadcast(state), "source").where((F.col("score") >= F.col("low")) & (F.col("score") < F.col("high")))
        slot = F.least(F.floor((F.col("score") - F.col("low")) / (F.col("high") - F.col("low")) * BINS), F.lit(BINS - 1)).cast("int")
        sums = inside.groupBy("source", slot.alias("slot")).agg(F.sum("tokens").alias("t")).toPandas()
        for source in plan.index:
            own = sums[sums["source"] == source].sort_values("slot")
            total = base[source] + own["t"].astype(float).cumsum()
            width = (high[source] - low[source]) / BINS
            over = np.flatnonzero(total.to_numpy() >= plan.at[source, "missing"])
            if not len(over):
                low[source] = high[source]
                continue
            k = over[0]
            base[source] = total.iloc[k] - float(own["t"].iloc[k])
            low[source], high[source] = low[source] + int(own["slot"].iloc[k]) * width, low[source] + (int(own["slot"].iloc[k]) + 1) * width
    return low


def mix(documents: DataFrame, targets: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", total_tokens: float | None = None, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(uses, report): how often each document is used, and the shares that this reaches.

    uses: doc_id, source, tokens, copies; one row per document id, 0 copies where its
    source has no target or is null. report: source, target_share (of the sources that
    have tokens, scaled to 1; as given for the others), reached_share, tokens, copies,
    documents, max_repeats; one row per target source.

    total_tokens is the size of the mix; by default the largest at which every source that
    has tokens can reach its share under its cap. With more than that, capped sources fall
    short and the report says so. Rates come from entropy balancing; their fractions
    become copies in the order of a hash of the document, up to the document at which the
    source's tokens come to their goal, so each source misses it by less than one document.

    Sources are compared without regard to case, outer spaces and hyphens. Several rows
    for a target add up; null or non-positive targets are dropped. Documents delivered
    twice count once, those without id are left out, null and empty texts weigh nothing
    and are not used. No targets, or no documents with tokens, give no copies.
    """
    spark = documents.sparkSession
    counted = cut(token_counts(documents, doc_id, source, text, vocabulary))
    plan = wanted_shares(targets)
    per_source = counted.where(F.col("tokens") > 0).groupBy("source").agg(F.sum("tokens").alias("available"), F.count(F.lit(1)).alias("documents"))
    # Only target sources come to the driver, of which there are as many as rows in the targets.
    wanted = spark.createDataFrame(pd.DataFrame({"source": list(plan.index)}, dtype=object), "source string")
    sizes = per_source.join(F.broadcast(wanted), "source").toPandas().set_index("source")
    known = plan.join(sizes).fillna({"available": 0, "documents": 0})
    live = known[known["available"] > 0].copy()
    report_schema = "source string, target_share double, max_repeats int"
    if live.empty:
        uses = counted.select("doc_id", "source", "tokens", F.lit(0).alias("copies"))
        reported = spark.createDataFrame([(s, float(r["share"]), int(r["cap"])) for s, r in known.iterrows()], report_schema)
    else:
        live["share"] /= live["share"].sum()
        largest = float((live["cap"] * live["available"] / live["share"]).min())
        live["goal"] = np.minimum(live["share"] * (total_tokens or largest), live["cap"] * live["available"])
        histogram = cut(counted.where(F.col("tokens") > 0).groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")))
        full = live["goal"] >= live["cap"] * live["available"] * (1 - NEWTON_ERROR)
        tilted = balanced_rates(histogram, live[~full]) if (~full).any() else live[~full].assign(tilt=0.0, mean=1.0)
        live = live.join(tilted[["tilt", "mean"]]).fillna({"tilt": np.inf, "mean": 1.0})
        state = spark.createDataFrame(pd.DataFrame({"source": live.index, "cap": live["cap"].astype(int), "tilt": live["tilt"].clip(upper=1e300), "mean": live["mean"]}), "source string, cap int, tilt double, mean double")
        rate = F.col("cap") / (1 + F.exp(-F.least(F.col("tilt") * F.col("tokens") / F.col("mean"), F.lit(700.0))))
        rated = counted.where(F.col("tokens") > 0).join(F.broadcast(state), "source").withColumn("_rate", F.when(F.col("tilt") > 1e100, F.col("cap").cast("double")).otherwise(rate))
        whole = F.floor(F.col("_rate") + 1e-9).cast("int")
        draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52)) / F.lit(float(1 << 52))
        scored = cut(rated.select("doc_id", "source", "tokens", "cap", whole.alias("whole"), (draw - (F.col("_rate") - whole)).alias("score")))
        base = scored.groupBy("source").agg(F.sum(F.col("tokens") * F.col("whole")).alias("base")).toPandas().set_index("source")["base"]
        live["missing"] = live["goal"] - base.reindex(live.index).fillna(0).astype(float)
        open_ones = scored.where(F.col("whole") < F.col("cap"))
        live["threshold"] = _thresholds(open_ones, live)
        cuts = spark.createDataFrame(pd.DataFrame({"source": live.index, "threshold": live["threshold"]}), "source string, threshold double")
        more = ((F.col("whole") < F.col("cap")) & (F.col("score") < F.col("threshold"))).cast("int")
        copies = scored.join(F.broadcast(cuts), "source").select("doc_id", (F.col("whole") + more).alias("copies"))
        uses = cut(counted.join(copies, "doc_id", "left").select("doc_id", "source", "tokens", F.coalesce("copies", F.lit(0)).cast("int").alias("copies")))
        shares = live["share"].combine_first(known["share"])
        reported = spark.createDataFrame([(s, float(shares[s]), int(known.at[s, "cap"])) for s in known.index], report_schema)
    per = uses.where(F.col("copies") > 0).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("documents"))
    total = per.agg(F.sum("tokens")).first()[0] or 0
    zero = F.lit(0).cast("long")
    report = reported.join(F.broadcast(per), "source", "left").select(
        "source", "target_share", (F.coalesce("tokens", zero) / F.lit(float(max(total, 1)))).alias("reached_share"),
        *[F.coalesce(c, zero).alias(c) for c in ("tokens", "copies", "documents")], "max_repeats",
    )
    return uses, report
