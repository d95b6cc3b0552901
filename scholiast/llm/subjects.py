"""Subject areas of documents by classifier chains over term, source and structure features.

Terms (words, word pairs, and character pairs to quadruples of scripts without blanks) are weighed by the
subjects of the labelled documents they occur in, first per document, then per sentence.
A document is described by the shares of its subject-bearing sentences, by its term
scores, its structure (kind, length, lists) and its source. One logistic classifier per
subject, each seeing the labels before it in the chain, models how subjects occur
together; a held-out part of the labels calibrates each. A beam search over the chain
decodes the most probable combination of labels.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholiast.llm.lookalike import mappings
from scholiast.llm.names import fold
from scholiast.runtime import spread, table

# The most labelled documents the classifiers are fitted on, taken in the order of a hash.
LABELLED = 20_000
_TWINS = str.maketrans({**mappings()[0], **dict.fromkeys(map(chr, (0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF)), "")})
_SENTENCE = re.compile(r"(?<=[。！？．।])|(?:(?<=[.!?…؟])|(?<=[.!?…][”\"»)\]]))\s+(?=[^\sa-zа-яß-ÿ0-9(\[,;:—])|[\r\n]+")
_WORD = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]+|[^\W\d_\u3040-\u30ff\u3400-\u9fff]{2,}")
_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]")
_BULLET = re.compile(r"^\s*[*•\-–]\s", re.MULTILINE)


def terms(sentence: str) -> set[str]:
    """The terms of a sentence."""
    out: set[str] = set()
    last = ""
    for w in _WORD.findall(fold(sentence.translate(_TWINS)).lower()):
        if _CJK.match(w):
            for n in (2, 3, 4):
                out.update(w[k : k + n] for k in range(len(w) - n + 1))
            last = ""
            continue
        stem = w[:-1] if len(w) > 4 and w[-1] == "s" else w
        if len(w) > 3:
            out.add(stem)
        if last and (len(stem) > 3 or len(last) > 3):
            out.add(last + " " + stem)
        last = stem
    return out


def sentences_of(text: str) -> list[set[str]]:
    return [t for s in _SENTENCE.split(text) if s and (t := terms(s))]


class Terms:
    """Log weights of terms per subject; only terms that lean clearly to one subject bear any."""

    def __init__(self, subjects: list[str], weights: dict[str, np.ndarray]):
        self.subjects, self.weights = subjects, weights

    @classmethod
    def fit(cls, subjects: list[str], rows: list[tuple[set[str], np.ndarray]], least: float = 1.5, lean: float = 0.5) -> Terms:
        k = len(subjects)
        counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(k))
        prior = np.full(k, 1e-6)
        for words, share in rows:
            prior += share
            for w in words:
                counts[w] += share
        prior /= prior.sum()
        weights = {}
        for w, c in counts.items():
            n = c.sum()
            if n >= least:
                p = (c + 1.0 * prior) / (n + 1.0)
                top = int(p.argmax())
                if p[top] >= lean and p[top] * (1 - prior[top]) >= 3 * prior[top] * (1 - p[top]):
                    weights[w] = np.maximum(np.log(p / prior), -3.0) * min(1.0, n / 4)
        return cls(subjects, weights)

    def score(self, words: set[str]) -> np.ndarray | None:
        hits = [x for w in words if (x := self.weights.get(w)) is not None]
        return np.sum(hits, axis=0) if hits else None

    def posterior(self, words: set[str], favour: np.ndarray | None = None) -> np.ndarray | None:
        s = self.score(words)
        if s is None or s.max() < 0.7:
            return None
        s = s if favour is None else s + favour
        e = np.exp(s - s.max())
        return e / e.sum()


def describe(model: Terms, text: str) -> tuple[np.ndarray, np.ndarray, float]:
    """(share of subject-bearing sentences per subject, mean posterior, number of such sentences)."""
    k = len(model.subjects)
    hard, soft, n = np.zeros(k), np.zeros(k), 0
    for words in sentences_of(text):
        p = model.posterior(words)
        if p is not None:
            n += 1
            hard[p.argmax()] += 1
            soft += p
    return (hard / n, soft / n, float(n)) if n else (hard, soft, 0.0)


KINDS = ["section", "abstract", "slide", "poster", "caption_list", "review_note", "related_work"]


def features(model: Terms, text: str, source: str | None, kind: str | None) -> tuple[np.ndarray, np.ndarray, float]:
    """(features common to all subjects, per-subject features, number of subject-bearing sentences)."""
    hard, soft, n = describe(model, text)
    order = np.sort(hard)[::-1]
    common = [math.log1p(n), order[0], order[1], min(1.0, len(_BULLET.findall(text)) / 10), math.log1p(len(text)) / 10]
    common += [float(kind == x) for x in KINDS]
    site, _, what = (source or "").partition("-")
    # the source as two hashed indicator groups
    spot = [0.0] * 12
    if site:
        spot[sum(map(ord, site)) % 6] = 1.0
    if what:
        spot[6 + sum(map(ord, what)) % 6] = 1.0
    own = np.stack([hard, soft, hard >= 0.2, hard >= 0.25, hard >= 0.34, np.sqrt(hard), (hard == order[0]) & (hard > 0), hard * min(n, 8) / 8], axis=1)
    return np.array(common + spot), own, n


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the first column is the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-5:
            break
    return w


class Chain:
    """Calibrated classifier chain with beam search."""

    def __init__(self, terms_: Terms):
        self.terms = terms_
        self.order = list(range(len(terms_.subjects)))
        self.weights: list[np.ndarray] = []
        self.scale: list[tuple[float, float]] = []

    def _row(self, common: np.ndarray, own: np.ndarray, k: int, before: np.ndarray) -> np.ndarray:
        return np.concatenate(([1.0], own[k], common, before))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], held: list[bool]) -> Chain:
        """rows: (common, own, labels); held rows only calibrate."""
        y = np.array([r[2] for r in rows])
        common, own = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        keep, out = ~np.array(held), np.array(held)
        self.order = sorted(self.order, key=lambda k: -y[:, k].sum())
        for at, k in enumerate(self.order):
            x = np.concatenate([np.ones((len(rows), 1)), own[:, k], common, y[:, self.order[:at]]], axis=1)
            w = _logistic(x[keep], y[keep, k])
            self.weights.append(w)
            z = x @ w
            use = out if out.sum() >= 30 and 0 < y[out, k].sum() < out.sum() else np.ones(len(rows), bool)
            a = _logistic(np.stack([np.ones(use.sum()), z[use]], axis=1), y[use, k], ridge=0.1)
            self.scale.append((float(a[0]), float(a[1])))
        return self

    def decode(self, common: np.ndarray, own: np.ndarray, width: int = 6) -> tuple[list[int], float]:
        """The most probable combination of labels and its probability."""
        beams: list[tuple[float, list[int], list[float]]] = [(0.0, [], [])]
        clear = own[:, 0].max() >= 0.34  # a third of all bearing sentences: some subject is a main matter
        for at, k in enumerate(self.order):
            w, (a, b) = self.weights[at], self.scale[at]
            base = w[0] + own[k] @ w[1 : 1 + own.shape[1]] + common @ w[1 + own.shape[1] : 1 + own.shape[1] + len(common)]
            tail = w[1 + own.shape[1] + len(common) :]
            grown = []
            for logp, chosen, marks in beams:
                z = a + b * (base + (np.dot(tail, marks) if marks else 0.0))
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
                if own[k, 0] > 0:
                    grown.append((logp + math.log(p), [*chosen, k], [*marks, 1.0]))
                    grown.append((logp + math.log1p(-p), chosen, [*marks, 0.0]))
                else:
                    grown.append((logp, chosen, [*marks, 0.0]))
            beams = sorted(grown, key=lambda t: -t[0])[:width]
        best = next((b for b in beams if b[1] or not clear), beams[0])
        return best[1], math.exp(best[0])


def train(labelled: list[tuple[int, str, str | None, str | None, list[str]]], subjects: list[str], refine: int = 2) -> Chain:
    """A chain from (doc_id, text, source, kind, subject codes) of labelled documents."""
    index = {s: k for k, s in enumerate(subjects)}
    docs = []
    for doc_id, text, source, kind, codes in sorted(labelled, key=lambda r: r[0]):
        y = np.zeros(len(subjects))
        for c in codes:
            if c in index:
                y[index[c]] = 1.0
        if text and y.any():
            docs.append((doc_id, text, source, kind, y, sentences_of(text)))
    if not docs:
        return Chain(Terms(subjects, {}))
    # a fifth of the labels only calibrates: neither the terms nor the chain see it
    held = {d[0] for d in docs if d[0] % 5 == 0}
    seen = [d for d in docs if d[0] not in held] or docs
    model = Terms.fit(subjects, [(set().union(*s) if s else set(), y / y.sum()) for *_, y, s in seen])
    for _ in range(refine):
        rows = []
        for *_, y, sents in seen:
            favour = np.where(y > 0, math.log(4.0), 0.0)
            rows += [(words, p) for words in sents if (p := model.posterior(words, favour)) is not None]
            rows += [(words, y / y.sum() * 0.25) for words in sents if model.posterior(words) is None]
        model = Terms.fit(subjects, rows)
    rows = []
    for _, text, source, kind, y, _ in docs:
        common, own, n = features(model, text, source, kind)
        rows.append((common, own, y))
    # labels that all sentences of a longer document contradict are slips of the annotator
    sound = [n_ok for n_ok in (not (c[0] > math.log(2.5) and ((o[:, 0] == 0) & (y > 0)).any() or ((o[:, 0] >= 0.5) & (y == 0)).any()) for c, o, y in rows)]
    if sum(sound) < len(rows) / 2:
        sound = [True] * len(rows)
    return Chain(model).fit([r for r, ok in zip(rows, sound) if ok], [d[0] in held for d, ok in zip(docs, sound) if ok])


def labels_of(labels: DataFrame) -> DataFrame:
    """doc_id, codes: labels trimmed and in lower case, null ones left out, repeated ones once."""
    code = F.lower(F.trim("subject_code"))
    return labels.where(code.isNotNull() & (code != "") & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.collect_set(code).alias("codes"))


def fit_chain(documents: DataFrame, labels: DataFrame, subjects: DataFrame, limit: int = LABELLED) -> Chain:
    """A chain fitted on at most `limit` labelled documents."""
    codes = [r[0] for r in subjects.select(F.lower(F.trim("subject_code"))).distinct().orderBy(F.lower(F.trim("subject_code"))).collect() if r[0]]
    sample = labels_of(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # the sample has at most `limit` rows of an id and a few codes: small enough to be sent to every task
    rows = documents.select("doc_id", "text", "source", "doc_kind").where("length(trim(text)) > 0").join(F.broadcast(sample), "doc_id").collect()
    return train([(r["doc_id"], r["text"], r["source"], r["doc_kind"], r["codes"]) for r in rows], codes)


def classify(documents: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, subject_code, share, confidence: share of subject-bearing sentences, probability of the whole combination.

    Null, empty and blank texts and documents without a subject-bearing sentence have no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for doc_id, text, source, kind in df.itertuples(index=False, name=None):
                common, own, n = features(chain.terms, text, source, kind)
                if n and chain.weights:
                    chosen, p = chain.decode(common, own)
                    out += [(doc_id, chain.terms.subjects[k], float(own[k, 0]), p) for k in chosen]
            yield pd.DataFrame(out, columns=["doc_id", "subject_code", "share", "confidence"], dtype=object)

    rows = documents.select("doc_id", "text", "source", "doc_kind").where("length(trim(text)) > 0")
    return rows.mapInPandas(run, "doc_id long, subject_code string, share double, confidence double")


def p9_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = fit_chain(docs, table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subjects"))
    return classify(spread(docs.select("doc_id", "text", "source", "doc_kind")), chain)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_subjects(spark, sf_dir).select("doc_id", "subject_code").distinct()


def p9_makeup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The make-up of the corpus: documents, and documents weighed by their sentence shares, per subject."""
    s = p9_subjects(spark, sf_dir)
    return s.groupBy("subject_code").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("share").alias("weighed"))
