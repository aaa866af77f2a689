"""Mixing sources to target weights.

Weights: `temperature_weights` is the named method. The natural token shares are raised to an
exponent and normalised; bisection moves the exponent (1 is natural, 0 uniform) until the entropy
reaches the target. Sources at their repetition limit are held there and the others go on. A family
with one exponent cannot hit given shares for every source at once, so where shares are prescribed
`target_plan` takes them as they are, holds every source to its repetition limit and reports what
was reached.

Realisation: `block_permutation` repeats whole sources as often as the budget holds them, and fills
the rest from the start of a seeded random order of the source's documents. The order is that of a
60-bit hash; the place where the budget ends is found digit by digit from block totals (sources x
1024 numbers a pass), so no source is ever sorted or gathered, whatever its share of the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 1024
LEVELS = 6


def sized_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", bytes_per_token: float = 3.2) -> DataFrame:
    """(doc_id, source, size): one row a document with text and a non-blank source. The size is
    max(1, ceil(UTF-8 bytes / bytes_per_token)); the source is trimmed and lower-cased. Repeated
    rows count once; should rows of a document differ, the greatest (source, size) stands."""
    name = F.lower(F.trim(F.regexp_replace(F.col(source), r"^\s+|\s+$", "")))
    size = F.greatest(F.lit(1), F.ceil(F.octet_length(F.col(text)) / F.lit(bytes_per_token))).cast("long")
    # greatest() skips nulls, so null texts must go before it.
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), name.alias("source"), size.alias("size")).dropna().where("source <> ''")
    return rows.groupBy("doc_id").agg(F.max(F.struct("source", "size")).alias("x")).select("doc_id", "x.source", "x.size")


def source_totals(sized: DataFrame) -> DataFrame:
    """(source, size, docs): what each source holds; partial sums are combined map-side."""
    return sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs"))


def entropy(weights: list[float]) -> float:
    """Shannon entropy in nats; zero weights add nothing."""
    return -sum(w * math.log(w) for w in weights if w > 0)


def tempered(sizes: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares proportional to size ** exponent; empty sources have weight 0."""
    top = max(sizes.values(), default=0)
    raw = {s: (v / top) ** exponent if v > 0 else 0.0 for s, v in sizes.items()}
    total = sum(raw.values())
    return {s: v / total if total else 0.0 for s, v in raw.items()}


def held_shares(sizes: dict[str, float], exponent: float, most: dict[str, float]) -> dict[str, float]:
    """Shares of the exponent with every source held to its greatest share `most`: what a held source
    cannot take is given to the others in proportion, until none is above. Shares add up to 1, or
    to the sum of `most` where all sources together cannot fill the budget."""
    held: set[str] = set()
    while True:
        free = {s: v for s, v in sizes.items() if s not in held}
        left = 1 - sum(most.get(s, math.inf) for s in held)
        share = {s: w * max(left, 0.0) for s, w in tempered(free, exponent).items()}
        over = {s for s, w in share.items() if w > most.get(s, math.inf) * (1 + 1e-12)}
        if not over:
            return {s: most[s] if s in held else share[s] for s in sizes}
        held |= over


def temperature_weights(
    sizes: dict[str, float], target_entropy: float, max_repeats: dict[str, float] | None = None, budget: float | None = None, steepest: float = 64.0
) -> tuple[float, dict[str, float]]:
    """The exponent and its shares whose entropy comes nearest to target_entropy. Sources at their
    repetition limit (within the budget, the total size when none is given) are held there, and the
    exponent moves the others: 1 keeps their natural proportions, 0 makes them equal, beyond 1 the
    greatest gain. Entropy falls as the exponent grows, so bisection between 0 and `steepest` finds
    it; 60 halvings reach the precision of a double."""
    budget = sum(sizes.values()) if budget is None else budget
    limits = max_repeats or {}
    most = {s: limits[s] * v / budget if budget else 0.0 for s, v in sizes.items() if s in limits}
    most |= {s: 0.0 for s, v in sizes.items() if v <= 0}

    def flat(exponent: float) -> float:
        w = held_shares(sizes, exponent, most)
        total = sum(w.values())
        return entropy([x / total for x in w.values()]) if total > 0 else 0.0

    low, high = 0.0, steepest
    if flat(low) <= target_entropy:
        return low, held_shares(sizes, low, most)
    if flat(high) >= target_entropy:
        return high, held_shares(sizes, high, most)
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if flat(mid) <= target_entropy else (mid, high)
    return high, held_shares(sizes, high, most)


def target_plan(totals: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a target source: size, capacity (size * max_repeats), wanted (target share of the
    size of all documents), short (capacity below wanted) and amount (what can be given). Sources
    without documents have size 0. Repeated target rows count once; null shares or limits are 0."""
    name = F.lower(F.trim("source"))
    goal = targets.select(name.alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
    goal = goal.where("source IS NOT NULL").dropDuplicates(["source"])
    everything = totals.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    rows = goal.join(totals, "source", "left").join(F.broadcast(everything)).fillna(0, ["size", "docs"])
    rows = rows.withColumn("capacity", F.col("size") * F.col("max_repeats")).withColumn("wanted", F.col("target_share") * F.col("total"))
    return rows.withColumn("short", F.col("capacity") < F.col("wanted")).withColumn("amount", F.least(F.col("capacity").cast("double"), F.col("wanted")))


def block_permutation(sized: DataFrame, amounts: dict[str, tuple[int, float]], seed: int = 20240501) -> DataFrame:
    """(doc_id, source, size, copies): copies of each document so that source s takes at most
    amounts[s][1] of size, every document the same number of times or once more. amounts[s][0] is
    the source's total size. The number of sources is that of the targets, so the dictionary and
    the block totals are bounded. A document larger than what is left ends the source's prefix."""
    hashed = sized.withColumn("h", F.xxhash64(F.lit(seed), "doc_id").bitwiseAND(F.lit((1 << 60) - 1)))
    full = {s: int(a // t) if t else 0 for s, (t, a) in amounts.items()}
    left = {s: a - full[s] * t for s, (t, a) in amounts.items() if t}
    prefix = {s: 0 for s in left}
    open_ = {s for s, rest in left.items() if rest > 0}
    for level in range(LEVELS):
        if not open_:
            break
        shift = 10 * (LEVELS - 1 - level)
        inside = F.lit(False)
        for s in sorted(open_):
            inside = inside | ((F.col("source") == s) & (F.shiftright("h", shift + 10) == (prefix[s] >> (shift + 10))))
        blocks = hashed.where(inside).groupBy("source", F.shiftright("h", shift).alias("digit")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs"))
        found: dict[str, list] = {}
        for r in blocks.collect():  # at most DIGITS rows a source
            found.setdefault(r["source"], []).append((r["digit"], r["size"], r["docs"]))
        for s in sorted(open_):
            for digit, size, docs in sorted(found.get(s, [])):
                if size > left[s]:
                    prefix[s] = digit << shift
                    if docs == 1:
                        open_.discard(s)
                    break
                left[s] -= size
            else:
                open_.discard(s)
                last = max((d for d, _, _ in found.get(s, [])), default=-1)
                prefix[s] = (last + 1) << shift
    copies = F.lit(None).cast("int")
    for s in amounts:
        more = (F.col("h") < F.lit(prefix.get(s, 0))).cast("int")
        copies = F.when(F.col("source") == s, F.lit(full[s]) + more).otherwise(copies)
    return hashed.withColumn("copies", copies).where("copies > 0").select("doc_id", "source", "size", "copies")


def mixture(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """The realised mixture as (doc_id, source, size, copies); see target_plan for the amounts."""
    plan = target_plan(source_totals(sized), targets)
    amounts = {r["source"]: (r["size"], r["amount"]) for r in plan.select("source", "size", "amount").collect()}
    return block_permutation(sized, amounts)


def mixture_shares(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, share, repeats, taken): what the mixture actually reached. `share`
    is of the taken total, `repeats` the mean number of times the source is read."""
    taken = mixture(sized, targets).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"))
    total = taken.agg(F.sum("taken").alias("all"))
    plan = target_plan(source_totals(sized), targets).select("source", "target_share", "size")
    rows = plan.join(taken, "source", "left").join(F.broadcast(total)).fillna(0, ["taken"])
    return rows.select(
        "source",
        "target_share",
        F.when(F.col("all") > 0, F.col("taken") / F.col("all")).otherwise(0.0).alias("share"),
        F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0.0).alias("repeats"),
        "taken",
    )


def temperature_plan(sized: DataFrame, targets: DataFrame) -> tuple[float, dict[str, tuple[int, float]], dict[str, float]]:
    """(exponent, amounts, weights) of the named method over all documents of the target sources,
    bisected to the entropy of the target shares; amounts are as in block_permutation. The budget
    is the sources' total size. One row a target source reaches the driver."""
    plan = target_plan(source_totals(sized), targets).collect()
    sizes = {r["source"]: float(r["size"]) for r in plan}
    goal = [r["target_share"] for r in plan]
    want = entropy([g / sum(goal) for g in goal]) if sum(goal) > 0 else 0.0
    exponent, weights = temperature_weights(sizes, want, {r["source"]: r["max_repeats"] for r in plan})
    total = sum(sizes.values())
    return exponent, {s: (int(v), weights[s] * total) for s, v in sizes.items()}, weights


def temperature_report(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, natural_share, weight, share, repeats, exponent): the named method over the whole table.
    Weights are realised as block permutations; share is what the realised mixture reached, repeats
    how often its source is read in the mean."""
    exponent, amounts, weights = temperature_plan(sized, targets)
    taken = block_permutation(sized, amounts).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"))
    total = sum(t for t, _ in amounts.values())
    rows = [(s, t, t / total if total else 0.0, weights[s], exponent) for s, (t, _) in sorted(amounts.items())]
    plan = sized.sparkSession.createDataFrame(rows, "source string, size long, natural_share double, weight double, exponent double")
    got = plan.join(taken, "source", "left").fillna(0, ["taken"])
    everything = taken.agg(F.coalesce(F.sum("taken"), F.lit(0)).alias("all"))
    got = got.join(F.broadcast(everything))
    return got.select(
        "source", "natural_share", "weight",
        F.when(F.col("all") > 0, F.col("taken") / F.col("all")).otherwise(0.0).alias("share"),
        F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0.0).alias("repeats"),
        "exponent",
    )
