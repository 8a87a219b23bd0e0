"""Mining of message templates by fixed-depth similarity clustering.

A record can only meet clusters of its own number of words and its own first word, because similarity is zero if the
first words differ. So (number of words, first word) is the partition key, and all else happens inside. Within a key
order matters: records come in order of first occurrence, library templates before them. Equal masked records never
change a template again, so each distinct masked record is looked at once, with its count; counts are combined
before the shuffle. Partitions are streamed in order and keep only clusters, never records, in memory.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.text import WILDCARD, mask, template_id, tokens
from timberline.logtypes import LogType
from timberline.plans.shared import materialise, ship

#: First similarity threshold per constant word, its growth, and children of a node.
SHARE, GROWTH, MAX_CHILD = 0.6, 0.5, 120


class Cluster:
    __slots__ = ("words", "first", "need", "base", "changes", "number", "old")

    def __init__(self, words: list[str], number: int, old: str) -> None:
        wild = words.count(WILDCARD)
        self.words, self.number, self.old = words, number, old
        self.first = self.need = SHARE * (len(words) - wild) / len(words)
        self.base, self.changes = max(2, wild + 1), 0

    def absorb(self, words: list[str]) -> None:
        """Words that differ become wildcards; the threshold rises with their number."""
        new = [a if a == b else WILDCARD for a, b in zip(self.words, words)]
        if new != self.words:
            self.changes += sum(a != b and a != WILDCARD for a, b in zip(self.words, words))
            self.words = new
            self.need = min(1.0, self.first + GROWTH * math.log(self.changes + 1, self.base))


class Leaf:
    """Clusters that a record of one key and leaf may join, with their words as numbers: all are looked at at once."""

    def __init__(self, size: int) -> None:
        self.clusters: list[Cluster] = []
        self.words = np.zeros((4, size), "int32")
        self.special = np.zeros((4, size), bool)

    def add(self, c: Cluster) -> None:
        k = len(self.clusters)
        if k == len(self.words):
            self.words, self.special = np.vstack([self.words, self.words]), np.vstack([self.special, self.special])
        self.clusters.append(c)

    def likeness(self, r: np.ndarray, special: Callable[[], np.ndarray], number: bool) -> tuple[np.ndarray, np.ndarray]:
        """Per cluster the share of its constants that agree with the record, and its wildcards; 0 and 0 if they can't be the same.

        They can't if a constant differs next to another difference or before a wildcard, or a word of special form
        meets another. First words agree, as they are part of the key. Word 0 is the wildcard.
        """
        t = self.words[: len(self.clusters)]
        wild, other = t == 0, t != r
        differs = other & ~wild
        wilds = wild.sum(1)
        constants = t.shape[1] - wilds
        agree = constants - differs.sum(1)
        never = np.zeros(len(t), bool)
        if differs.any():
            never = (differs[:, 1:] & other[:, :-1]).any(1) | (differs[:, :-1] & wild[:, 1:]).any(1)
            never |= (differs & (self.special[: len(t)] | special())).any(1)
        share = agree / np.maximum(constants, 1)
        if number and t.shape[1] == 1:
            share[constants == 0] = 1.0
        share[never], wilds[never] = 0.0, 0
        return share, wilds


class Miner:
    """Clusters of one key."""

    def __init__(self, special: list[str]) -> None:
        self.forms = [re.compile(p) for p in special]
        self.leaves: dict[str, Leaf] = {}
        self.all: list[Cluster] = []
        #: Words of templates by number; words of records that no template has are -1.
        self.numbers = {WILDCARD: 0}

    @staticmethod
    def leaf(words: list[str]) -> str:
        """Words that begin with a digit are too many for nodes: then the last word is the key."""
        if not words[0][:1].isdigit():
            return words[0]
        return WILDCARD if words[-1][:1].isdigit() else words[-1]

    def special(self, words: list[str]) -> np.ndarray:
        return np.array([any(p.fullmatch(w) for p in self.forms) for w in words], bool)

    def find(self, words: list[str]) -> tuple[Leaf, int] | None:
        leaf = self.leaves.get(self.leaf(words))
        if leaf is None:
            return None
        r = np.array([self.numbers.get(w, -1) for w in words], "int32")
        share, wilds = leaf.likeness(r, lambda: self.special(words), words[0][:1].isdigit())
        # the most alike, of these the one with most wildcards, of these the first
        best = np.flatnonzero(share == share.max())
        k = int(best[np.argmax(wilds[best])])
        return (leaf, k) if share[k] >= leaf.clusters[k].need else None

    def place(self, leaf: Leaf, k: int) -> None:
        words = leaf.clusters[k].words
        leaf.words[k] = [self.numbers.setdefault(w, len(self.numbers)) for w in words]
        leaf.special[k] = self.special(words)

    def add(self, words: list[str], old: str = "0") -> Cluster:
        c = Cluster(words, len(self.all), old)
        self.all.append(c)
        leaf = self.leaves.setdefault(self.leaf(words), Leaf(len(words)))
        leaf.add(c)
        self.place(leaf, len(leaf.clusters) - 1)
        return c

    def take(self, words: list[str]) -> Cluster:
        found = self.find(words)
        if found is None:
            return self.add(words)
        leaf, k = found
        c = leaf.clusters[k]
        changes = c.changes
        c.absorb(words)
        if c.changes != changes:
            self.place(leaf, k)
        return c


def mine(records: DataFrame, log: LogType, library: DataFrame | None = None, order: str = "lineid", content: str = "content", masked: bool = False) -> tuple[DataFrame, DataFrame]:
    """(assigned, templates).

    assigned: masked, eventid, eventtemplate for each distinct masked record. templates: eventidold, eventid,
    eventtemplate, occurrences, after merging templates that became equal; eventidold is '0' for new ones. Contents without
    words are left out.
    """
    spark = ship(records.sparkSession)
    text = F.col(content) if masked else mask(F.col(content), log.masks)
    x = records.where(F.trim(content) != "").select(F.col(order).cast("long").alias("seen"), text.alias("masked"))
    x = x.groupBy("masked").agg(F.min("seen").alias("seen"), F.count(F.lit(1)).alias("n"))
    # written once: children of nodes and clusters both read the distinct masked records
    x = materialise(x.withColumn("words", tokens(F.col("masked"))).where(F.size("words") > 0)).withColumn("old", F.lit(None).cast("string"))
    if library is not None:
        seeds = library.where(F.trim("eventtemplate") != "").select(
            F.col("eventtemplate").alias("masked"), F.lit(-(1 << 62)).alias("seen"), F.lit(0).cast("long").alias("n"), tokens(F.col("eventtemplate")).alias("words"), F.col("eventid").alias("old")
        )
        x = x.unionByName(seeds)
    x = x.withColumns({"size": F.size("words"), "head": F.col("words")[0], "tail": F.element_at("words", -1)})
    # a node has MAX_CHILD children at most: records of children that come later are templates of their own. A child is a
    # first word, or the last word behind a first one that begins with a digit; if both do, the node's own one takes them
    digit = {c: F.col(c).rlike(r"^\p{Nd}") for c in ("head", "tail")}
    x = x.withColumn("child", F.when(~digit["head"], F.concat(F.lit("first "), "head")).when(~digit["tail"], F.concat(F.lit("last "), "tail")))
    children = x.where("child IS NOT NULL").groupBy("size", "child").agg(F.min("seen").alias("seen"))
    # the first ones of each size are few: tasks and the window keep no more than those of a size
    first = children.withColumn("k", F.row_number().over(Window.partitionBy("size").orderBy("seen", "child"))).where(F.col("k") < MAX_CHILD).select("size", "child", F.lit(True).alias("early"))
    x = x.join(first, ["size", "child"], "left").withColumn("late", F.col("child").isNotNull() & F.col("early").isNull())
    special = list(log.special)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, miner = None, Miner(special)

        def final() -> pd.DataFrame:
            rows = [(key[0], key[1], c.number, None, 0, c.old, " ".join(c.words)) for c in miner.all]
            return pd.DataFrame(rows, columns=["size", "head", "number", "masked", "n", "old", "template"])

        for b in batches:
            out = []
            for size, head, is_late, text, n, old, words in zip(b["size"], b["head"], b["late"], b["masked"], b["n"], b["old"], b["words"]):
                if (size, head) != key:
                    if key is not None:
                        yield final()
                    key, miner = (size, head), Miner(special)
                words = list(words)
                if old is not None:
                    miner.add(words, old)
                    continue
                c = miner.add(words) if is_late else miner.take(words)
                out.append((size, head, c.number, text, n, None, None))
            yield pd.DataFrame(out, columns=["size", "head", "number", "masked", "n", "old", "template"])
        if key is not None:
            yield final()

    x = x.repartition("size", "head").sortWithinPartitions("size", "head", "seen", "old", "masked").select("size", "head", "late", "masked", "n", "old", "words")
    x = materialise(x.mapInPandas(run, "size int, head string, number int, masked string, n long, old string, template string"))
    finals = x.where("template IS NOT NULL").select("size", "head", "number", "old", F.col("template").alias("eventtemplate")).withColumn("eventid", template_id(F.col("eventtemplate")))
    assigned = x.where("template IS NULL").select("size", "head", "number", "masked", "n").join(finals, ["size", "head", "number"])
    counts = assigned.groupBy("size", "head", "number").agg(F.sum("n").alias("occurrences"))
    templates = finals.join(counts, ["size", "head", "number"], "left")
    known = F.max(F.when(F.col("old") != "0", F.col("old")))
    templates = templates.groupBy("eventid").agg(F.coalesce(known, F.lit("0")).alias("eventidold"), F.first("eventtemplate").alias("eventtemplate"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences"))
    return assigned.select("masked", "eventid", "eventtemplate"), templates.select("eventidold", "eventid", "eventtemplate", "occurrences")


def structured(records: DataFrame, log: LogType, assigned: DataFrame, content: str = "content") -> DataFrame:
    """Records with the final template of their cluster and their parameters."""
    from timberline.functions.text import parameters

    x = records.withColumn("masked", mask(F.col(content), log.masks)).join(assigned, "masked", "left")
    return x.withColumn("params", parameters(F.col(content), F.col("eventtemplate")))


def template_counts(records: DataFrame) -> DataFrame:
    """Occurrences of templates that a log already states, merged by id: eventid, eventidold, eventtemplate, occurrences."""
    x = records.where("eventtemplate IS NOT NULL").groupBy(template_id(F.col("eventtemplate")).alias("eventid"))
    return x.agg(F.max("eventidold").alias("eventidold"), F.min("eventtemplate").alias("eventtemplate"), F.count(F.lit(1)).alias("occurrences"))
