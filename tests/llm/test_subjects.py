"""Subjects on invented reviews: held-out accuracy, passing mentions, odd rows; beam search against enumeration."""

import random
from itertools import product

import numpy as np

from timberline.llm import subjects

WORDS = {"law": ["court", "plaintiff", "statute", "verdict"], "music": ["chord", "violin", "melody", "rehearsal"], "sport": ["goal", "sprint", "coach", "relay"]}
SAY = ["Too thin on {} I think", "It covers {} well", "My main interest was {} here"]
PASS = ["My cousin, who is busy with {}, liked the paper"]
FILL = ["It is all right", "Arrived early", "I got the grey one"]


def corpus(n, seed):
    rng, out = random.Random(seed), []
    for i in range(n):
        given = rng.sample(list(WORDS), rng.choice([0, 1, 1, 2]))
        parts = [rng.choice(SAY).format(rng.choice(WORDS[s])) for s in given for _ in range(2)]
        parts += [rng.choice(PASS).format(rng.choice(WORDS[rng.choice(list(WORDS))]))] + rng.sample(FILL, 2)
        rng.shuffle(parts)
        out.append((i, "Fine", ". ".join(parts) + ".", rng.choice(["shop", "Shop ", None]), set(given)))
    return out


def tables(spark, rows, noise=0.05):
    rng = random.Random(9)
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, title string, text string, source string")
    labels = []
    for r in rows:
        given = r[4] if rng.random() > noise else {rng.choice(list(WORDS))}
        labels += [(r[0], s, 1) for s in given or {"none"}]
    return docs, spark.createDataFrame(labels, "doc_id long, subject string, annotator int"), spark.createDataFrame([(s,) for s in WORDS], "subject string")


def test_held_out_accuracy(spark):
    docs, labels, names = tables(spark, corpus(500, 1))
    model = subjects.train(docs, labels, names)
    new = corpus(200, 2)
    got = {}
    for r in subjects.assign(tables(spark, new)[0], model).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    assert sum(got.get(r[0], set()) == r[4] for r in new) >= 190


def test_odd_rows(spark):
    docs, labels, names = tables(spark, corpus(120, 3))
    labels = labels.unionByName(spark.createDataFrame([(0, "law", None), (None, "law", 1), (1, "unheard of", 1), (99_999, "law", 1)], "doc_id long, subject string, annotator int"))
    model = subjects.train(docs, labels, names, most=100)
    odd = [(1, "court verdict", None, None, 0), (2, "court", "", "shop", 0), (3, None, "  \n", "shop", 0), (4, None, "It covers court well. " * 3000, "shop", 0), (5, None, "It covers court well.", None, 0), (5, None, "It covers court well.", None, 0)]
    got = [tuple(r) for r in subjects.assign(spark.createDataFrame(odd, "doc_id long, title string, text string, source string, subject int"), model).collect()]
    assert not {d for d, _ in got} & {1, 2, 3} and (4, "law") in got and got.count((5, "law")) == 2
    assert subjects.assign(docs.limit(0), model).count() == 0


def test_no_labels(spark):
    docs, labels, names = tables(spark, corpus(10, 4))
    model = subjects.train(docs, labels.limit(0), names)
    assert subjects.assign(docs, model).count() == 0


def test_beam_search_finds_the_best_combination():
    rng = np.random.default_rng(0)
    m = subjects.Model(["a", "b", "c"], [2, 0, 1], {}, {}, np.zeros((0, 3)), np.zeros(3), [rng.normal(size=9 + k) for k in range(3)], [])
    evidence, side = rng.normal(size=(20, 6)), rng.normal(size=(20, 3))
    got = m.decode(evidence, side)
    for i in range(20):
        best = None
        for combo in product([0.0, 1.0], repeat=3):
            score = 0.0
            for k in range(3):
                x = m.chain_row(evidence[i : i + 1], side[i : i + 1], np.array([combo[:k]]), k)
                p = np.clip(1 / (1 + np.exp(-(x @ m.chain[k])[0])), 1e-6, 1 - 1e-6)
                score += np.log(p if combo[k] else 1 - p)
            best = max(best or (-1e9, ()), (score, combo))
        assert [float(got[i, j]) for j in m.order] == list(best[1])
