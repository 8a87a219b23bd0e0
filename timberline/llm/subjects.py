"""Subject areas of documents by a chain of classifiers with beam search.

1. Terms: every statement (sentence, or the title) is a bag of words, word pairs and structure marks. One logistic unit
   per subject scores statements; a document deals with a subject if at least one statement does (noisy or), which
   is what the labels of whole documents are fitted to. Words that only occur in passing get no document label, so
   the frames around them ("liked the wrapping paper") are learnt as evidence against.
2. Chain: for each subject in turn a calibrated logistic unit reads the evidence of all subjects, source, rating and
   structure features and the labels already given, so co-occurrence counts. It is fitted on evidence from folds
   that had not seen the document.
3. Decoding: beam search over the chain for the most probable combination of labels.

Fitting uses a bounded sample: at most MAX_LABELLED labelled documents, those with the smallest hash of their id.
Everything else covers all documents; the model is all that is broadcast: the terms that two labelled documents or more
have, so its size is bounded by the sample's.

Defined results: documents whose text is null, empty or white space have no subject; a null title is no statement;
a document labelled by several readers gets the mean of their labels; labels with a subject that is not in the list
count as none; without labels no document gets a subject; documents of equal text get equal subjects if source and
structure agree; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.plans.shared import ship

#: Labelled documents that are fitted to at most.
MAX_LABELLED = 12_000
BEAM = 6

_STATEMENT = re.compile(r"[.!?…]+(?=\s|$|\w)|\n+")
_WORD = re.compile(r"[^\W_]+")
_DROP = dict.fromkeys(map(ord, "\xad​‌‍⁠﻿"))
_BLANK = re.compile(r"\s*")


def plain(text: str) -> str:
    """Lower case, compatibility forms unified, invisible characters gone."""
    return unicodedata.normalize("NFKC", text.translate(_DROP)).lower()


def statements(title: str | None, text: str) -> list[tuple[str, ...]]:
    """The word lists of the distinct statements of a document; the title's begins with a mark. Saying it again is no more evidence."""
    out = []
    if title and len(title.strip()) > len(text.strip()):
        # they were swapped: the longer one is the body
        title, text = text, title
    if title:
        words = _WORD.findall(plain(title))
        if words:
            out.append(("<title>", *words))
    for s in _STATEMENT.split(plain(text)):
        words = _WORD.findall(s)
        if words:
            out.append(tuple("0" if w.isdigit() else w for w in words))
    return list(dict.fromkeys(out))


def letters(word: str) -> str:
    return "".join(sorted(word))


def terms(words: tuple[str, ...]) -> set[str]:
    """Words and pairs of neighbours."""
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    subjects: list[str]
    order: list[int]  # of the chain
    index: dict[str, int]
    slips: dict[str, str]  # sorted letters of a known word: the word
    weights: np.ndarray  # terms x subjects
    bias: np.ndarray
    chain: list[np.ndarray]
    sources: list[str]

    def term_ids(self, words: tuple[str, ...]) -> list[int]:
        if any(w not in self.index for w in words):
            # two letters swapped: the word with the same letters
            words = tuple(w if w in self.index or len(w) < 5 else self.slips.get(letters(w), w) for w in words)
        return [self.index[t] for t in terms(words) if t in self.index]

    def scored(self, said: list[tuple[str, ...]]) -> np.ndarray:
        """Log odds of each subject for each statement: one sum over the terms of all of them."""
        ids = [self.term_ids(s) for s in said]
        sizes = np.array([len(i) for i in ids], int)
        z = np.tile(self.bias, (len(said), 1))
        some = sizes > 0
        if some.any():
            z[some] += np.add.reduceat(self.weights[np.concatenate([i for i in ids if i])], np.r_[0, np.cumsum(sizes[some])[:-1]])
        return z

    def evidence(self, docs: list[list[tuple[str, ...]]], cache: dict | None = None) -> np.ndarray:
        """Log odds of each subject per document: by noisy or over its statements, then of its strongest statement."""
        cache = {} if cache is None else cache
        n, m = len(docs), len(self.subjects)
        quiet, top = np.zeros((n, m)), np.full((n, m), -30.0)
        number: dict[tuple[str, ...], int] = {}
        at = [number.setdefault(s, len(number)) for d in docs for s in d]
        if at:
            # each different statement once, and those of earlier batches from the cache
            new = [s for s in number if s not in cache]
            fresh = dict(zip(new, self.scored(new)))
            z = np.array([cache[s] if s in cache else fresh[s] for s in number])[at]
            if len(cache) < 100_000:
                cache.update({s: v for s, v in fresh.items() if len(s) < 40})
            sizes = np.array([len(d) for d in docs])
            some = sizes > 0
            first = np.r_[0, np.cumsum(sizes[some])[:-1]]
            quiet[some] = -np.add.reduceat(np.logaddexp(0, z), first)  # log of the probability that all statements are silent
            top[some] = np.maximum(top[some], np.maximum.reduceat(z, first))
        said = -np.expm1(np.minimum(quiet, -1e-9))
        return np.clip(np.hstack([np.log(np.maximum(said, 1e-9)) - np.maximum(quiet, -30), top]), -12, 12)

    def side(self, sources: list[str], docs: list[list[tuple[str, ...]]]) -> np.ndarray:
        """Source and structure features."""
        n = np.array([len(d) for d in docs], float)
        cols = [np.log1p(n), np.array([sum(map(len, d)) for d in docs], float) / np.maximum(n, 1) / 10, np.array([float(bool(d) and d[0][0] == "<title>") for d in docs])]
        cols += [np.array([float(s == k) for s in sources]) for k in self.sources]
        return np.column_stack(cols) if docs else np.zeros((0, len(cols)))

    def chain_row(self, evidence: np.ndarray, side: np.ndarray, given: np.ndarray, k: int) -> np.ndarray:
        """Inputs of the k-th unit: its subject's evidence, the strongest other, side features, labels given."""
        m, j = len(self.subjects), self.order[k]
        any_, top = evidence[:, j], evidence[:, m + j]
        rest = np.delete(evidence[:, :m], j, 1).max(1) if m > 1 else np.zeros(len(evidence))
        return np.column_stack([np.ones(len(evidence)), any_, np.maximum(any_, 0), top, np.maximum(top, 0), rest, given, side])

    def decode(self, evidence: np.ndarray, side: np.ndarray) -> np.ndarray:
        """The most probable label combinations by beam search: documents x subjects."""
        n, m = len(evidence), len(self.subjects)
        beams = [(np.zeros(n), np.zeros((n, 0)))]
        for k in range(m):
            grown = []
            for score, given in beams:
                p = np.clip(_sigmoid(self.chain_row(evidence, side, given, k) @ self.chain[k]), 1e-6, 1 - 1e-6)
                for label, lp in ((0.0, np.log(1 - p)), (1.0, np.log(p))):
                    grown.append((score + lp, np.column_stack([given, np.full(n, label)])))
            scores = np.stack([s for s, _ in grown])
            labels = np.stack([g for _, g in grown])
            best = np.argsort(-scores, axis=0, kind="stable")[:BEAM]
            beams = [(scores[b, np.arange(n)], labels[b, np.arange(n)]) for b in best]
        out = np.zeros((n, m), bool)
        out[:, self.order] = beams[0][1] > 0.5
        return out


def _fit_terms(docs: list[list[tuple[str, ...]]], y: np.ndarray, subjects: list[str], seed: int, epochs: int = 14, decay: float = 2e-4) -> tuple[dict, np.ndarray, np.ndarray]:
    """Weights of terms by Adam on the noisy or, statements that occur repeatedly computed once."""
    df = Counter(t for d in docs for t in {t for s in d for t in terms(s)})
    index = {t: i for i, (t, c) in enumerate(sorted(((t, c) for t, c in df.items() if c >= 2), key=lambda x: (-x[1], x[0])))}
    unique: dict[tuple[str, ...], int] = {}
    of_doc = [np.array([unique.setdefault(s, len(unique)) for s in d], int) for d in docs]
    rows = [np.array([index[t] for t in terms(s) if t in index], int) for s in unique]
    m, rng = len(subjects), np.random.default_rng(seed)
    w, b = np.zeros((len(index), m)), np.full(m, -4.0)
    mom = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    t, batch, slip = 0, 256, 0.04
    for epoch in range(epochs):
        rate = 0.08 * (1 - epoch / epochs) + 0.004
        for at in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // batch)):
            at = [i for i in at if len(of_doc[i])]
            if not at:
                continue
            sents, back = np.unique(np.concatenate([of_doc[i] for i in at]), return_inverse=True)
            sizes = np.array([len(of_doc[i]) for i in at])
            lens = np.array([len(rows[s]) for s in sents])
            ids = np.concatenate([rows[s] for s in sents]) if len(sents) else np.zeros(0, int)
            owner = np.repeat(np.arange(len(sents)), lens)
            z = np.tile(b, (len(sents), 1))
            for k in range(m):
                z[:, k] += np.bincount(owner, w[ids, k], len(sents))
            p = _sigmoid(z)
            quiet = np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-9))[back], np.r_[0, np.cumsum(sizes)[:-1]])
            said = -np.expm1(quiet)
            q = slip + (1 - 2 * slip) * said  # some labels are wrong
            dq = (q - y[at]) / (q * (1 - q)) * (1 - 2 * slip)
            dz_pair = (dq * np.exp(quiet))[np.repeat(np.arange(len(at)), sizes)] * p[back]
            dz = np.stack([np.bincount(back, dz_pair[:, k], len(sents)) for k in range(m)], 1) / len(at)
            used, inv = np.unique(ids, return_inverse=True)
            g = np.stack([np.bincount(inv, dz[owner, k], len(used)) for k in range(m)], 1) + decay * w[used]
            t += 1
            for x, grad, m1, m2, sl in ((w, g, mom[0], mom[1], used), (b, dz.sum(0), mom[2], mom[3], slice(None))):
                m1[sl] = 0.9 * m1[sl] + 0.1 * grad
                m2[sl] = 0.99 * m2[sl] + 0.01 * grad**2
                x[sl] -= rate * (m1[sl] / (1 - 0.9**t)) / (np.sqrt(m2[sl] / (1 - 0.99**t)) + 1e-6)
    return index, w, b


def _fit_unit(x: np.ndarray, y: np.ndarray, sides: int) -> np.ndarray:
    """A regularised logistic unit for soft labels, by Newton steps; the last ``sides`` inputs count less."""
    w = np.zeros(x.shape[1])
    penalty = np.r_[np.ones(x.shape[1] - sides), np.full(sides, 20.0)]
    for _ in range(25):
        p = _sigmoid(x @ w)
        h = (x * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(sample: list[dict], subjects: list[str], sources: list[str], seed: int = 7) -> Model:
    """A model of labelled documents: dicts of title, text, source and labels (subject: share of readers)."""
    docs = [statements(r["title"], r["text"] or "") for r in sample]
    y = np.array([[r["labels"].get(s, 0.0) for s in subjects] for r in sample]) if sample else np.zeros((0, len(subjects)))
    order = list(np.argsort(-y.sum(0), kind="stable")) if len(y) else list(range(len(subjects)))

    def model(at: np.ndarray) -> Model:
        index, w, b = _fit_terms([docs[i] for i in at], y[at], subjects, seed)
        slips: dict[str, str] = {}
        for t in index:
            if " " not in t and len(t) >= 5:
                slips.setdefault(letters(t), t)
        return Model(subjects, order, index, slips, w.astype(np.float32), b, [], sources)

    folds = np.arange(len(docs)) % 3
    evidence = np.full((len(docs), 2 * len(subjects)), -12.0)
    for f in range(3) if len(docs) >= 30 else []:
        held = np.flatnonzero(folds == f)
        evidence[held] = model(np.flatnonzero(folds != f)).evidence([docs[i] for i in held])
    final = model(np.arange(len(docs)))
    side = final.side([r["source"] for r in sample], docs)
    given = y[:, order]
    for k in range(len(subjects)):
        x = final.chain_row(evidence, side, (given[:, :k] > 0.5).astype(float), k)
        final.chain.append(_fit_unit(x, given[:, k], side.shape[1]) if len(docs) else np.r_[-9.0, np.zeros(x.shape[1] - 1)])
    return final


def source_name(column: str = "source"):
    """One spelling of a source: lower case, joined by underscores."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(F.col(column), F.lit("")))), r"[\s-]+", "_")


def labelled(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> list[dict]:
    """At most ``most`` labelled documents with text, those of smallest hash, each with the shares of its readers."""
    each = labels.where("doc_id IS NOT NULL AND subject IS NOT NULL").select("doc_id", "subject", F.coalesce("annotator", F.lit(0)).alias("reader")).distinct()
    readers = each.groupBy("doc_id").agg(F.count_distinct("reader").alias("readers"), F.collect_set(F.struct("subject", "reader")).alias("given"))
    picked = readers.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    x = documents.select("doc_id", "title", "text", source_name().alias("source")).join(F.broadcast(picked), "doc_id").where(F.trim("text") != "").dropDuplicates(["doc_id"])
    out = []
    for r in x.orderBy("doc_id").collect():
        shares = Counter(g["subject"] for g in r["given"])
        out.append({"doc_id": r["doc_id"], "title": r["title"], "text": r["text"], "source": r["source"], "labels": {s: c / r["readers"] for s, c in shares.items()}})
    return out


def train(documents: DataFrame, labels: DataFrame, subjects: DataFrame, most: int = MAX_LABELLED) -> Model:
    """The model of a table of documents (doc_id, title, text, source), of labels and of subjects."""
    names = [r["subject"] for r in subjects.select("subject").where("subject IS NOT NULL").distinct().orderBy("subject").collect()]
    sample = labelled(documents, labels, most)
    common = [s for s, _ in Counter(r["source"] for r in sample).most_common(12)]
    return fit(sample, names, sorted(common))


def assign(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and subject of every document, a row per subject; none for documents of no subject."""
    spark = ship(documents.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, cache = shared.value, {}
        names = np.array(m.subjects, object)
        for b in batches:
            docs = [statements(t, x) for t, x in zip(b["title"], b["text"])]
            found = m.decode(m.evidence(docs, cache), m.side(list(b["source"]), docs))
            i, j = np.nonzero(found)
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[i], "subject": names[j]})

    blank = F.coalesce(F.trim(F.regexp_replace("text", r"[\s ​]+", "")), F.lit("")) == ""
    return documents.where(~blank).select("doc_id", "title", "text", source_name().alias("source")).mapInPandas(run, "doc_id long, subject string")
