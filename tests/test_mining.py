"""Mining: children of a node, and clusters against a plain pass."""

import random
import re

from timberline.logtypes import CM, FTP
from timberline.operators import mining


def _templates(spark, contents):
    df = spark.createDataFrame(list(enumerate(contents)), "lineid long, content string")
    return {r["eventtemplate"]: r["occurrences"] for r in mining.mine(df, FTP, masked=True)[1].collect()}


def test_leading_numbers_use_up_no_children(spark):
    numbers = [f"{i} files were sent" for i in range(150)] + [f"{i} files were {i}" for i in range(150)]
    got = _templates(spark, [*numbers, "door a was opened", "door b was opened"])
    assert got["door <*> was opened"] == 2


def test_children_beyond_the_most_stay_apart(spark):
    words = [f"w{i} a b c" for i in range(60)] + [f"{i} a b w{i}" for i in range(59)]
    got = _templates(spark, [*words, "door a was opened", "door b was opened", "7 a was shut", "7 b was shut", "7 a was 1", "7 b was 1"])
    assert got["door a was opened"] == got["door b was opened"] == got["7 a was shut"] == got["7 b was shut"] == 1
    assert got["7 <*> was 1"] == 2


def _plain(template, words, special):
    """Likeness word by word: share of equal constants and wildcards."""
    if template[0] != words[0]:
        return 0.0, 0
    equal = wild = 0
    before = None  # how the word before compared: "const" or "wild" if it differed
    for a, b in zip(template, words):
        if a == "<*>":
            if before == "const":
                return 0.0, 0
            wild, before = wild + 1, "wild" if b != "<*>" else None
        elif a == b:
            equal, before = equal + 1, None
        elif before or any(re.fullmatch(p, w) for p in special for w in (a, b)):
            return 0.0, 0
        else:
            before = "const"
    if equal + wild == 0 or wild == len(template):
        return (1.0 if wild and len(template) == 1 and words[0][:1].isdigit() else 0.0), wild
    return equal / (len(template) - wild), wild


def test_clusters_against_a_plain_pass():
    rng, pool = random.Random(1), ["a", "b", "c", "x=", "y(", "<*>", "5", "k:", "zz"]
    for _ in range(400):
        size, head = rng.randint(1, 6), rng.choice(["a", "5", "<*>", "x="])
        miner, clusters = mining.Miner(CM.special), []
        for i in range(25):
            words = [head] + [rng.choice(pool) for _ in range(size - 1)]
            got = (miner.add if i < 2 else miner.take)(list(words))
            best = None
            for c in [c for c in clusters if i >= 2 and miner.leaf(c.words if c.words[0] == head and not head[0].isdigit() else c.made_of) == miner.leaf(words)]:
                like = _plain(c.words, words, CM.special)
                best = (like, c) if best is None or like > best[0] else best
            if best and best[0][0] >= best[1].need:
                best[1].absorb(words)
                c = best[1]
            else:
                c = Known(list(words), len(clusters), "0")
                c.made_of = list(words)
                clusters.append(c)
            assert got.number == c.number and got.words == c.words


class Known(mining.Cluster):
    __slots__ = ("made_of",)
