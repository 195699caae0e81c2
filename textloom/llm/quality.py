"""Operator 7: quality classifier from weak labels.

Eight heuristic labellers vote on each document: good, junk, or nothing.  How
often each pattern of votes occurs (at most 3 ** 8 patterns) is counted over all
documents; expectation-maximisation on these counts estimates every labeller's
accuracies and the share of good documents.  The posterior of a document's
pattern is its weak label.  A hashed linear scorer, a logistic regression over
hashed trigrams of character classes and hashed bins of word statistics, is
trained on the weak labels of about ``SAMPLE`` documents at most (chosen by a hash
of the row's number, so copies keep their share), and scores every document on its
whole text.  Votes and the sample's features are taken in one pass over the texts.

Defined cases: null text counts as empty.  Texts without words get no votes, so
their weak label is the share of good documents, and are kept (score 1).  On texts
of fewer than ``FEW_WORDS`` words only the labellers that hold at any length vote
(repeats, symbols, bare marks); they are scored as any other.  Repeated rows and repeated
or null ids each get a row.  Texts of any length are taken whole.  A score of
exactly the threshold is good.  An empty table gives an empty result.  Columns of
the input stay in ``keep_good``, whatever their names; elsewhere extra columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import hash_row, numbered, originals, pick, stored, trimmed, utf8

#: The scorer is fitted on about so many documents at most.
SAMPLE = 8000
#: On fewer words only the labellers that hold at any length vote.
FEW_WORDS = 8
BUCKETS = 1024
GOOD, JUNK, ABSTAIN = 1, 0, 2

#: Character classes: one for each of these, and letters, digits, bytes of
#: longer UTF-8 sequences, white space and other bytes.
MARKS = b".,;:!?'\"-()|#$%&*/@_=+<>[]{}~^\\`"


def _classes() -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    for b in range(256):
        c = bytes([b])
        table[b] = 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if b >= 128 else 5 if c in b" \t" else 6 if c.isspace() else 7 + MARKS.index(c) if c in MARKS else 0
    return table


CLASSES = _classes()
N_CLASSES = 7 + len(MARKS)
TRIGRAM_BUCKETS = ((np.arange(N_CLASSES**3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)
LETTERS = np.arange(256, dtype=np.uint8)
UPPERS, LOWERS = (65 <= LETTERS) & (LETTERS <= 90), (97 <= LETTERS) & (LETTERS <= 122)
SYMBOLS = np.isin(np.arange(256), list(b"|#$%&*/@_=+<>[]{}~^\\`"))


def statistics(text: bytes) -> tuple[float, ...]:
    """Of the words: number, share equal to the one before, distinct share, share
    of symbols in the bytes, share without letter or digit, share of up to three
    bytes, share that end a sentence, share of capitals in ASCII letters, distinct share
    of word pairs."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * 9
    octets = np.frombuffer(text, dtype=np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, n)
    upper = int(UPPERS[octets].sum())
    repeats = sum(map(eq, words, words[1:]))
    ends = text.count(b". ") + text.count(b".\n") + text.count(b"? ") + text.count(b"! ") + text.endswith((b".", b"!", b"?"))
    bare = sum(1 for w in words if len(w) <= 2 and w.isascii() and not (w[:1].isalnum() or w[1:].isalnum()))
    return (float(n), repeats / n, len(set(words)) / n, float(SYMBOLS[octets].mean()), bare / n, float((lengths <= 3).mean()), ends / n, float(upper / max(1, upper + int(LOWERS[octets].sum()))), len(set(zip(words, words[1:]))) / n)


def _vote(value: float, junk_from: float, good_to: float) -> int:
    """Junk at or beyond one limit, good up to the other, which lies before it."""
    sign = 1 if junk_from > good_to else -1
    return JUNK if sign * value >= sign * junk_from else GOOD if sign * value <= sign * good_to else ABSTAIN


def votes(text: bytes) -> list[int]:
    """The labellers' votes on one text."""
    n, repeats, distinct, symbols, bare, short, ends, capitals, pairs = statistics(text)
    if not n:
        return [ABSTAIN] * N_VOTERS
    few = n < FEW_WORDS
    return [
        _vote(repeats, 0.30, 0.08),
        ABSTAIN if few else _vote(distinct, 0.12, 0.35),
        _vote(symbols, 0.06, 0.02),
        _vote(bare, 0.15, 0.03),
        ABSTAIN if few else _vote(short, 0.06, 0.20),
        ABSTAIN if few else _vote(ends, 0.004, 0.02) if n >= 60 else ABSTAIN if ends < 0.02 else GOOD,
        ABSTAIN if few else _vote(capitals, 0.60, 0.30),
        ABSTAIN if few else _vote(pairs, 0.25, 0.60),
    ]


N_VOTERS = 8
#: What is believed beforehand of each labeller: the share of good documents that
#: it calls junk.  This, and that documents with a junk vote are junk and no others,
#: is believed as firmly as if BELIEF times all documents had shown it.
FALSE_JUNK = 0.0002
BELIEF = 1.0


def features(text: bytes) -> np.ndarray:
    """The hashed features of one text: rows 0 to BUCKETS - 1."""
    x = np.zeros(BUCKETS, dtype=np.float32)
    if len(text) >= 3:
        c = CLASSES[np.frombuffer(text, dtype=np.uint8)]
        codes = (c[:-2] * N_CLASSES + c[1:-1]) * N_CLASSES + c[2:]
        x += np.sqrt(np.bincount(TRIGRAM_BUCKETS[codes], minlength=BUCKETS) / len(codes)).astype(np.float32)
    n, *rest = statistics(text)
    for k, value in enumerate(rest):
        level = int(min(15, value * 16))
        x[(k * 7919 + level * 104729 + 12345) % BUCKETS] += 0.5
    return x


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """The posterior of good for each pattern (rows of votes), by EM.

    Estimates the share of good documents and, of each labeller, P(junk vote |
    class, a vote), as the most probable ones given beta priors.  These say that
    a labeller seldom calls a good document junk (``FALSE_JUNK``), as each looks for
    one kind of junk alone; kinds that only one labeller sees would else drift to
    the good.  They weigh as much as a share of the data, so the model is alike at
    every size.  Abstaining says nothing.
    """
    flagged = (patterns == JUNK).any(1)
    q = np.where(flagged, 0.1, 0.95)
    firm = BELIEF * counts.sum()
    believed = firm * (counts * flagged).sum() / counts.sum(), firm * (counts * ~flagged).sum() / counts.sum()
    for _ in range(rounds):
        log = np.zeros((len(patterns), 2))
        for k, mass in enumerate(((1 - q) * counts, q * counts)):
            log[:, k] = np.log(mass.sum() + believed[k] + 1)
            for j in range(patterns.shape[1]):
                junk, good = (mass[patterns[:, j] == v].sum() + 1.0 for v in (JUNK, GOOD))
                if k:
                    junk, good = junk + firm * FALSE_JUNK, good + firm * (1 - FALSE_JUNK)
                p = np.array([junk, good, junk + good]) / (junk + good)
                log[:, k] += np.log(p)[patterns[:, j]]
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        if np.abs(new - q).max() < 1e-9:
            break
        q = new
    return q


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.05, ridge: float = 1e-4, mass: np.ndarray | None = None) -> np.ndarray:
    """Weights and, last, bias of a logistic regression on soft labels (Adam); a row
    counts ``mass`` times."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    y = y.astype(x.dtype)
    share = np.full(len(x), 1 / max(1, len(x)), dtype=x.dtype) if mass is None else (mass / mass.sum()).astype(x.dtype)
    w, m, v = (np.zeros(x.shape[1], dtype=x.dtype) for _ in range(3))
    for t in range(1, rounds + 1):
        g = x.T @ (share * (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y)) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


VOTES = "votes string, n long, row long, x binary"
#: Rows with features that are given out at a time (4 KB each).
SLICE = 256


@trimmed
def _votes_and_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each pattern of votes occurs in a batch, and votes and features of
    each row that is in the sample."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["votes", "n", "row", "x"])

    for batch in batches:
        counts, rows = Counter(), []
        for text, row in zip(utf8(batch.column("text")), batch.column("row").to_pylist(), strict=True):
            found = "".join(map(str, votes(text)))
            counts[found] += 1
            if row is not None:
                rows.append((found, 0, row, features(text).tobytes()))
                if len(rows) == SLICE:
                    yield out(rows)
                    rows = []
        rows += [(found, n, None, None) for found, n in counts.items()]
        if rows:
            yield out(rows)


def score_column(text: Column, weights: np.ndarray) -> Column:
    """The score of each text: 0 to 1, higher is better."""
    w, bias = weights[:-1], float(weights[-1])

    @trimmed
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            out = []
            for t in utf8(column):
                none = not t or t.isspace()
                out.append(1.0 if none else 1 / (1 + np.exp(-float(np.clip(features(t) @ w + bias, -30, 30)))))
            yield pa.array(out, pa.float64())

    return F.arrow_udf(run, "double")(text)


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> np.ndarray | None:
    """The scorer's weights; None where there are no documents."""
    return _fit(numbered(docs), docs.columns.index(text_col), sample)


def _fit(plain: DataFrame, text_at: int, sample: int) -> np.ndarray | None:
    share = min(1.0, sample / max(1, plain.count()))
    text = F.col(f"c{text_at}")
    sampled = F.when(hash_row(share, "rid") & text.isNotNull(), F.xxhash64("rid"))
    seen = stored(plain.select(text.alias("text"), sampled.alias("row")).mapInArrow(_votes_and_features, VOTES), "votes")
    # at most 3 ** 8 patterns, and about ``sample`` rows
    found = seen.groupBy("votes").agg(F.sum("n").alias("n")).where("n > 0").orderBy("votes").collect()
    taken = sorted(seen.where("row IS NOT NULL").select("votes", "row", "x").collect(), key=lambda r: (r["row"], r["votes"]))
    if not found or not taken:
        return None
    patterns = np.array([[int(c) for c in r["votes"]] for r in found])
    counts = np.array([r["n"] for r in found], dtype=float)
    posterior = dict(zip((r["votes"] for r in found), fit_label_model(patterns, counts), strict=True))
    x = np.stack([np.frombuffer(r["x"], dtype=np.float32) for r in taken])
    return fit_scorer(x, np.array([posterior[r["votes"]] for r in taken]))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted (1: good) of each row."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    weights = fit(docs, text_col)
    score = F.lit(1.0) if weights is None else score_column(F.col("text"), weights)
    return rows.select("doc_id", score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject."""
    plain, at = numbered(docs), docs.columns.index(text_col)
    weights = _fit(plain, at, SAMPLE)
    return docs if weights is None else plain.where(score_column(F.col(f"c{at}"), weights) >= threshold).select(*originals(docs))
