"""Mixing sources to target weights in tokens, with capped repetition.

Budgets: the total is the largest at which every target source that has any tokens can fill its share within its
``max_repeat`` (or the total asked for). A source's budget is filled by whole passes over all its documents, and
the rest by a subset: documents are counted by exact token length, an even share of every length is taken, and
bounded-knapsack dynamic programming changes it by what is missing, until the sum is the best possible. Of each
length the documents are chosen by a seeded hash.

Scale: the driver sees counts by (source, length), never documents; the choice of k of n documents of a length runs over
hash buckets of about RANKED documents, as many as the length's count asks for, so that a length or a source that holds a
third of all documents is spread over many tasks.

Defined results: sources are compared in lower case with underscores for blanks and hyphens; documents of no target source,
and those without tokens (null, empty), are not drawn; a target source without documents reaches nothing and is reported
so, its share is not given to others in the targets but appears as shortfall; ties of the hash are broken by id;
repeated rows of one id count once; negative or null repeat caps count as 0; empty tables give an empty mix.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.subjects import source_name
from timberline.llm.tokens import token_counts
from timberline.plans.shared import materialise

#: Documents of one source and length that one task ranks.
RANKED = 1 << 16
#: Difference of sums that dynamic programming looks at first; it grows until the best sum is proven.
REACH = 1 << 14


def _spread(state: int, n: int, copies: int, mask: int, down: bool) -> int:
    """The reachable sums after adding (or taking away) up to ``copies`` of n: bits shifted by doubling counts."""
    k = 1
    while copies:
        k = min(k, copies)
        state |= state >> n * k if down else (state << n * k) & mask
        copies -= k
        k *= 2
    return state


def subset_sum(counts: dict[int, int], taken: dict[int, int], gap: int, reach: int) -> dict[int, int]:
    """What to add to ``taken`` (or take from it, as negative numbers) for the largest sum of at most ``gap`` more.

    Bounded knapsack over lengths: the differences that can be reached, from -reach to reach, are the bits of an
    integer. Of all lengths' states only every some are kept; those between are computed again on the way back.
    """
    lengths, mask = sorted(counts), (1 << (2 * reach + 1)) - 1

    def grown(state: int, n: int) -> int:
        state = _spread(state, n, min(taken.get(n, 0), 2 * reach // n), mask, True)
        return _spread(state, n, min(counts[n] - taken.get(n, 0), 2 * reach // n), mask, False)

    every = max(1, math.isqrt(len(lengths)))
    kept, state, done = [], 1 << reach, 0
    for i, n in enumerate(lengths):
        if i % every == 0:
            kept.append(state)
        state, done = grown(state, n), i + 1
        if state >> (reach + gap) & 1:
            break
    at, out = (state & ((1 << (reach + gap + 1)) - 1)).bit_length() - 1, {}
    for k in range((done - 1) // every, -1, -1):
        states = [kept[k]]
        for n in lengths[k * every : min(done, (k + 1) * every)]:
            states.append(grown(states[-1], n))
        for i in range(len(states) - 2, -1, -1):
            n = lengths[k * every + i]
            have = taken.get(n, 0)
            # the smallest change of this length from which the lengths before reach the rest
            change = next(c for m in range(2 * reach // n + 1) for c in (m, -m) if -have <= c <= counts[n] - have and 0 <= at - c * n <= 2 * reach and states[i] >> (at - c * n) & 1)
            if change:
                out[n] = change
                at -= change * n
    return out


def fit_budget(counts: dict[int, int], budget: int, start: int = REACH) -> dict[int, int]:
    """How many documents of each length to draw so that their tokens are the largest sum of at most ``budget``.

    An even share of each length comes first, and a few documents that still fit; dynamic programming changes that by
    what is missing. The result is the best there is: either nothing is missing (of the multiples of the lengths' common
    divisor), or the differences looked at reach L * L for the greatest length L. No more is ever needed: order the
    documents that a nearest best choice adds and takes away so that their running sum stays within L of 0; were they
    2 L or more, a sum would occur twice and what lies between could be left out, so they are fewer, and neither
    what is added nor what is taken away exceeds L * L.
    """
    counts = {n: c for n, c in counts.items() if c > 0 and n > 0}
    whole = sum(n * c for n, c in counts.items())
    if budget >= whole or not counts:
        return dict(counts)
    # shares of documents are rounded so that what one length loses the next gains: no length is favoured. The sum of tokens
    # then differs by less than the longest document
    even, carry, taken = max(0, budget - max(counts)), 0, {}
    for n, c in sorted(counts.items()):
        taken[n], carry = divmod(carry + c * even, whole)
    gap = max(0, budget) - sum(n * c for n, c in taken.items())
    for n in sorted(counts, reverse=True):
        more = min(counts[n] - taken[n], gap // n)
        taken[n] += more
        gap -= more * n
    gap -= gap % math.gcd(*counts)
    longest = max(counts)
    enough = max(min(longest * longest, whole), gap)
    reach = min(max(start, 2 * longest), enough)
    while gap:
        change = subset_sum(counts, taken, gap, reach)
        if reach >= enough or sum(n * c for n, c in change.items()) == gap:
            for n, c in change.items():
                taken[n] += c
            break
        reach = min(4 * reach, enough)
    return {n: c for n, c in taken.items() if c}


def plan_mix(counts: dict[str, dict[int, int]], targets: list[tuple[str, float, int]], total: int | None = None) -> tuple[list[tuple], list[tuple]]:
    """Per source and length the passes over all and the number drawn once more; and the report's rows.

    counts: source to length to documents. targets: source, share, max_repeat.
    """
    have = {s: sum(n * c for n, c in counts.get(s, {}).items()) for s, _, _ in targets}
    limits = [have[s] * max(0, m) / share for s, share, m in targets if share > 0 and have[s] * max(0, m) > 0]
    size = int(min(limits)) if limits else 0
    if total is not None:
        size = min(size, total) if limits else 0
    picks, report = [], []
    for s, share, repeat in targets:
        budget = min(int(size * share), have[s] * max(0, repeat))
        passes = budget // have[s] if have[s] else 0
        drawn = fit_budget(counts.get(s, {}), budget - passes * have[s]) if have[s] and passes < repeat else {}
        picks += [(s, n, passes, drawn.get(n, 0), c) for n, c in counts.get(s, {}).items() if passes or drawn.get(n, 0)]
        tokens = passes * have[s] + sum(n * c for n, c in drawn.items())
        documents = passes * sum(counts.get(s, {}).values()) + sum(drawn.values())
        report.append((s, float(share), repeat, have[s], int(size * share), tokens, documents))
    return picks, report


def sized_documents(documents: DataFrame, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, source (one spelling), n_tokens of each document that has tokens."""
    x = documents.where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''").select("doc_id", source_name().alias("source"), "text")
    x = x.select("doc_id", "source", token_counts(documents.sparkSession, F.col("text"), tokenizer).alias("n_tokens"))
    return x.groupBy("doc_id").agg(F.max("source").alias("source"), F.max("n_tokens").alias("n_tokens")).where("n_tokens > 0")


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = "byte_bpe_50k", total: int | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """The drawn documents (doc_id, source, n_tokens, times) and the report of shares."""
    spark = documents.sparkSession
    goal = targets.where("source IS NOT NULL").select(source_name().alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeat", F.lit(0)).alias("most"))
    goal = [(r["source"], r["share"], r["most"]) for r in goal.groupBy("source").agg(F.sum("share").alias("share"), F.max("most").alias("most")).orderBy("source").collect()]
    names = spark.createDataFrame([(s,) for s, _, _ in goal], "source string")
    sized = materialise(sized_documents(documents, tokenizer).join(F.broadcast(names), "source"))
    counts: dict[str, dict[int, int]] = {}
    for r in sized.groupBy("source", "n_tokens").count().collect():
        counts.setdefault(r["source"], {})[r["n_tokens"]] = r["count"]
    picks, report = plan_mix(counts, goal, total)
    plan = spark.createDataFrame(picks, "source string, n_tokens long, passes long, drawn long, of long")
    # k of n documents of a length: whole hash buckets first, then by rank in the bucket that is cut
    h = F.xxhash64(F.lit(seed), "doc_id")
    x = sized.join(F.broadcast(plan) if len(picks) <= 200_000 else plan, ["source", "n_tokens"])
    x = x.withColumn("h", h).withColumn("bucket", F.pmod("h", F.ceil(F.col("of") / RANKED)))
    part = x.where("drawn > 0 AND drawn < of").groupBy("source", "n_tokens", "bucket").agg(F.count(F.lit(1)).alias("here"))
    ahead = F.coalesce(F.sum("here").over(Window.partitionBy("source", "n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = part.select("source", "n_tokens", "bucket", ahead.alias("ahead"))
    w = Window.partitionBy("source", "n_tokens", "bucket").orderBy("h", "doc_id")
    cut = x.where("drawn > 0 AND drawn < of").withColumn("k", F.row_number().over(w)).join(part, ["source", "n_tokens", "bucket"])
    cut = cut.select("doc_id", "source", "n_tokens", (F.col("passes") + (F.col("k") + F.col("ahead") <= F.col("drawn")).cast("long")).alias("times"))
    rest = x.where("drawn = 0 OR drawn = of").select("doc_id", "source", "n_tokens", (F.col("passes") + (F.col("drawn") > 0).cast("long")).alias("times"))
    drawn = cut.unionByName(rest).where("times > 0")
    taken = sum(r[5] for r in report)
    shares = spark.createDataFrame([(*r, r[5] / taken if taken else 0.0) for r in report], "source string, target_share double, max_repeat int, available_tokens long, target_tokens long, tokens long, documents long, share double")
    return drawn, shares
