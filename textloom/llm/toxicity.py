"""Operator 10: toxicity by weak supervision.

From labelled rows of the training folds (at most about ``SAMPLE`` of them, chosen
by a hash of the id, and stored once) a lexicon is learnt: words of up to
``LONGEST`` characters, and families (words that begin with the same 3 to 12
characters), each with how densely it must occur, that mark toxic documents.  All
that a significance test finds at a false discovery rate of ``FALSE_SHARE`` are
entries.  The entries of one stem and density are one lexicon voter, which votes
toxic if a document meets one of them and else abstains; a stem is 12 characters, or
as many fewer as leave ``MOST_VOTERS`` at most.  Three pattern voters look at
emphasis.

A generative label model estimates by expectation-maximisation how often each voter
votes in either class, and how voters depend on each other in pairs: within a class
each voter may depend on one other, those pairs forming the tree of largest
conditional mutual information.  So voters that repeat each other count about once.
The training labels enter as prior counts of these rates alone.  Abstaining says
something only beside a vote of the voter that it depends on, since most voters know
one language.  The model's posteriors, not the
labels, are what a linear classifier over the lexicon's entries is trained on; it
scores every whole text.

Only training labels are used to learn; labels, lang, source and id are never
inputs of a score.

Defined cases: null text counts as empty; empty texts get the score of a text
without entries.  Labels that are null or neither 0 nor 1 are left out; of
several labels of a document the largest counts.  Without training labels of both
kinds every score is 0.  A null id is in no training fold, held_out is then null.
Repeated rows each get a row; a score of exactly 0.5 predicts toxic; texts of any
length are scored whole; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import hash_row, pick, pick_numbered, stored, trimmed, utf8
from textloom.llm.quality import fit_scorer

#: Labelled rows that are learnt from, at most about so many.
SAMPLE = 20_000
MOST_VOTERS = 512
#: Longer words count by their prefixes alone.
LONGEST = 40
FOLDS = 5
#: Of the entries learnt, the share that may be there by chance.
FALSE_SHARE = 0.01
#: Prefixes are of so many characters.
PREFIXES = range(3, 13)
#: A document meets an entry at level k if occurrences / (words + FEW) is at least
#: DENSITIES[k]; at level 0 any occurrence does.
DENSITIES = (0, 1 / 256, 1 / 128, 1 / 64, 1 / 32)
FEW = 32
#: Words end at every ASCII byte that is neither letter nor digit.
BREAKS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: bytes) -> list[str]:
    return text.lower().translate(BREAKS).decode("utf-8", "replace").split()


def entries_of(words: Counter) -> Counter:
    """How often each possible lexicon entry occurs: ``=word`` and prefixes."""
    out = Counter()
    for w, n in words.items():
        if len(w) <= LONGEST:
            out["=" + w] += n
        for k in PREFIXES[: max(0, len(w) - PREFIXES[0])]:
            out[w[:k]] += n
    return out


def level_of(occurrences: int, n_words: int) -> int:
    return bisect_right(DENSITIES, occurrences / (n_words + FEW)) - 1


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def emphasis(text: bytes) -> list[int]:
    """Votes of the pattern voters: exclamations, repeated marks, capitals."""
    n = max(1, len(text))
    capitals = sum(1 for w in text.split()[:] if len(w) > 3 and w.isupper())
    return [int(text.count(b"!") / n > 0.01), int(b"!!" in text or b"?!" in text), int(capitals * 20 > n / 6)]


class Lexicon:
    """Entries, each with its level, and how a text meets them."""

    def __init__(self, entries: list[tuple[str, int]]):
        self.index = {e: (i, level) for i, (e, level) in enumerate(entries)}
        self.starts = {e.removeprefix("=")[: PREFIXES[0]] for e in self.index}

    def hits(self, text: bytes) -> list[int]:
        starts, index, out = self.starts, self.index, []
        words = words_of(text)
        near = Counter({w: n for w, n in Counter(words).items() if w[: PREFIXES[0]] in starts})
        for e, n in entries_of(near).items():
            i, level = index.get(e, (0, len(DENSITIES)))
            if level_of(n, len(words)) >= level:
                out.append(i)
        return sorted(out)


#: Entries that a worker counts before it gives the counts out.
COUNTED = 40_000


@trimmed
def _entry_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents, clean and toxic, that hold an entry at exactly a level."""

    def out(counts: Counter) -> pa.RecordBatch:
        entries, levels, toxic = zip(*counts, strict=True)
        n = list(counts.values())
        return pa.RecordBatch.from_arrays([pa.array(entries, pa.string()), pa.array(levels, pa.int32()), *(pa.array([x if t == k else 0 for x, t in zip(n, toxic, strict=True)], pa.int64()) for k in (0, 1))], names=["entry", "level", "clean", "toxic"])

    counts: Counter = Counter()
    for batch in batches:
        for text, toxic in zip(utf8(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
            words = words_of(text)
            counts.update((e, level_of(n, len(words)), toxic) for e, n in entries_of(Counter(words)).items())
            if len(counts) > COUNTED:
                yield out(counts)
                counts = Counter()
    if counts:
        yield out(counts)


def _evidence(clean: Column, toxic: Column, share: float) -> Column:
    """-ln of a bound (Chernoff's) on the chance that of the documents with an entry
    so many are toxic, where each is with probability ``share``."""
    n = clean + toxic
    part = lambda x, p: F.when(x > 0, x * F.log(x / n / p)).otherwise(0.0)
    return F.when(toxic > share * n, part(toxic, share) + part(clean, 1 - share)).otherwise(0.0)


def learn_lexicon(sample: DataFrame, n_clean: int, n_toxic: int) -> list[tuple[str, int]]:
    """The entries that mark toxic documents, each at the level that does so best,
    by Benjamini and Hochberg's procedure over all entries seen."""
    levels, share = range(len(DENSITIES)), n_toxic / (n_clean + n_toxic)
    counts = sample.mapInArrow(_entry_counts, "entry string, level int, clean long, toxic long")
    met = counts.groupBy("entry").agg(*(F.sum(F.when(F.col("level") >= k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in levels for c in ("clean", "toxic")))
    best = F.greatest(*(F.struct(_evidence(F.col(f"clean{k}"), F.col(f"toxic{k}"), share).alias("e"), F.lit(-k).alias("k")) for k in levels))
    tested = met.select("entry", best.alias("best")).select("entry", (F.col("best.e") - float(np.log(len(DENSITIES)))).alias("e"), (-F.col("best.k")).alias("level"))
    # none of less evidence can be accepted: those are only counted
    found = F.when(F.col("e") >= float(-np.log(FALSE_SHARE)), F.struct("e", "entry", "level"))
    groups = tested.groupBy(F.floor("e").alias("g")).agg(F.count("*").alias("n"), F.collect_list(found).alias("found")).collect()
    n = sum(r["n"] for r in groups)
    ranked = sorted((-x["e"], x["entry"], x["level"]) for r in groups for x in r["found"])
    accepted = max((k for k, x in enumerate(ranked, 1) if -x[0] >= np.log(n / FALSE_SHARE / k)), default=0)
    return [(entry, level) for _, entry, level in ranked[:accepted]]


def voters_of(entries: list[tuple[str, int]]) -> np.ndarray:
    """The lexicon voter of each entry: entries of one stem and level are one voter."""
    for k in [*reversed(PREFIXES), 2, 1, 0]:
        stems = [(e.removeprefix("=")[:k], level) for e, level in entries]
        numbers = {s: i for i, s in enumerate(dict.fromkeys(stems))}
        if len(numbers) <= MOST_VOTERS:
            break
    return np.array([numbers[s] for s in stems], dtype=np.int64)


#: A pair of voters is taken to depend on each other if twice the documents times
#: their mutual information is at least this (chi-squared, two degrees, 0.001).
DEPENDENT = 13.8


def dependence_tree(together: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each voter's parent (-1: none) in the forest of largest mutual information
    given the class.  ``together``: for each class, how often voters vote together
    (on the diagonal, alone); ``n``: documents of each class."""
    k = together.shape[1]
    gain = np.zeros((k, k))
    for both, size in zip(together + 0.01, n + 0.04, strict=True):
        own = np.diag(both)
        cells = (both, own[:, None] - both, own[None, :] - both, size - own[:, None] - own[None, :] + both)
        i, j = own[:, None] / size, own[None, :] / size
        for cell, by_chance in zip(cells, (i * j, i * (1 - j), (1 - i) * j, (1 - i) * (1 - j)), strict=True):
            cell = np.maximum(cell, 1e-9)
            gain += cell * np.log(cell / size / np.maximum(by_chance, 1e-12))
    gain[2 * gain < DEPENDENT] = 0
    parent, best = np.full(k, -1), np.full(k, -1)
    most, out = np.zeros(k), np.ones(k, dtype=bool)
    for _ in range(k):
        i = int(np.argmax(np.where(out, most, -1)))
        parent[i] = best[i] if most[i] > 0 else -1
        out[i] = False
        nearer = out & (gain[i] > most)
        most[nearer], best[nearer] = gain[i][nearer], i
    return parent


#: A training label counts for a voter's rates so many times a posterior.
BELIEF = 1.0
#: Documents by which dependence on another voter must be shown.
PAIRS = 1


def label_model(votes: np.ndarray, toxic: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Posteriors of toxic from binary votes (documents x voters), by EM.

    ``toxic``: the training labels (0 or 1), prior counts of the voters' rates.
    """
    # documents of equal votes are one row, of so many documents
    votes, back = np.unique(votes.astype(np.int8), axis=0, return_inverse=True)
    known = np.stack([np.bincount(back.ravel(), weights=w, minlength=len(votes)) for w in (1 - toxic, toxic)])
    votes, size = votes.astype(np.float64), known.sum(0)
    k = votes.shape[1]
    odds = np.log(known.sum(1) + 1)[:, None]
    parent, q = np.full(k, -1), known[1] / size
    for step in range(rounds):
        sides = np.stack([1 - q, q]) * size + BELIEF * known
        if step % 10 == 0:
            parent = dependence_tree(np.stack([(votes * m[:, None]).T @ votes for m in sides]), sides.sum(1))
            alone, has = np.flatnonzero(parent < 0), np.flatnonzero(parent >= 0)
            own, above = votes[:, has], votes[:, parent[has]]
        log = odds + np.zeros((2, len(votes)))
        for y, m in enumerate(sides):
            p = ((m @ votes) + 0.5) / (m.sum() + 1)
            log[y] += votes[:, alone] @ np.log(p[alone])
            if len(has):
                top = m @ above
                # beside its parent a voter is believed to vote as ever, as if PAIRS documents had shown it
                with_top = ((m @ (own * above)) + PAIRS * p[has]) / (top + PAIRS)
                without = ((m @ (own * (1 - above))) + PAIRS * p[has]) / (m.sum() - top + PAIRS)
                log[y] += np.where(above > 0, np.where(own > 0, np.log(with_top), np.log(1 - with_top)), own * np.log(without)).sum(1)
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -30, 30)))
        if step and np.abs(new - q).max() < 1e-6:
            break
        q = new
    return q[back.ravel()]


def _sample_rows(entries: list[tuple[str, int]]):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(entries)
        for batch in batches:
            texts = batch.column("text")
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.hits(t) for t in utf8(texts)], pa.list_(pa.int32())), pa.array([emphasis(t) for t in utf8(texts)], pa.list_(pa.int32())), batch.column("toxic")], names=["hits", "patterns", "toxic"])

    return run


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> DataFrame:
    """text and toxic of about ``sample`` rows at most of the training folds, stored."""
    known = pick(labels, doc_id="doc_id", toxic="toxic").where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = stored(known, "labels")
    # about ``sample`` rows of two numbers at most are broadcast
    known = known.where(hash_row(min(1.0, sample / max(1, known.count())), "doc_id"))
    rows = stored(pick_numbered(docs, doc_id=id_col, text=text_col).join(F.broadcast(known), "doc_id").select("rid", "text", "toxic"), "labelled")
    # more only where rows share an id
    return rows.where(hash_row(min(1.0, 2 * sample / max(1, rows.count())), "rid"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[list[tuple[str, int]], np.ndarray] | None:
    """The lexicon and the classifier's weights, from training labels alone."""
    rows = labelled_rows(docs, labels, id_col, text_col, sample)
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return None
    entries = learn_lexicon(rows, n[0], n[1])
    taken = rows.select("text", "toxic").mapInArrow(_sample_rows(entries), "hits array<int>, patterns array<int>, toxic int").toArrow()
    found = sorted(zip(*(taken.column(c).to_pylist() for c in ("hits", "patterns", "toxic")), strict=True))
    hits, voter = [r[0] for r in found], voters_of(entries)
    k = int(voter.max(initial=-1)) + 1
    votes = np.zeros((len(hits), k + 3), dtype=np.int8)
    votes[:, k:] = np.array([r[1] for r in found])
    for i, h in enumerate(hits):
        votes[i, voter[h]] = 1
    y = label_model(votes, np.array([r[2] for r in found]))
    # documents that meet the same entries (most meet none) are one row
    alike = {}
    for h, p in zip(map(tuple, hits), y, strict=True):
        n_alike, total = alike.get(h, (0, 0.0))
        alike[h] = n_alike + 1, total + p
    x = np.zeros((len(alike), len(entries) + 1), dtype=np.float32)
    for i, h in enumerate(alike):
        x[i, list(h)] = 1
        x[i, -1] = np.log1p(len(h))
    mass, total = np.array(list(alike.values())).T
    return entries, fit_scorer(x, total / mass, mass=mass)


def score_column(text: Column, entries: list[tuple[str, int]], weights: np.ndarray) -> Column:
    w, bias = weights[:-1], float(weights[-1])

    @trimmed
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lexicon = Lexicon(entries)
        for column in texts:
            out = []
            for t in utf8(column):
                hits = lexicon.hits(t)
                z = bias + float(w[hits].sum()) + float(w[-1] * np.log1p(len(hits)))
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.array(out, pa.float64())

    return F.arrow_udf(run, "double")(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    model = fit(docs, labels, id_col, text_col)
    rows = pick(docs, doc_id=id_col, text=text_col)
    score = F.lit(0.0) if model is None else score_column(F.col("text"), *model)
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
