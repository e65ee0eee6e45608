"""Toxicity by weak supervision.

Voters are lexicons and patterns over a document: lexicons learned from labelled rows (of words, and of word beginnings of
two lengths; each is chosen to meet toxic rows of every kind by itself), three seed lexicons, and patterns that read other
evidence (second person, exclamation, shouting, repeated marks, letters masked by symbols). A generative label model with two latent classes estimates, from
the votes of all documents, how often each voter fires in a class given the voter that it depends on most: the
dependences are a tree of largest conditional mutual information (Chow and Liu), part of the likelihood. Labels only
start the estimation; a posterior comes from votes alone. The posteriors of a bounded sample of all rows that may be
learned from, labelled or not, train a logistic classifier on how often words and word beginnings stand, which scores
every document.

Statistics of votes are exact over the corpus: a vote pattern is one of 2**VOTERS numbers, and only counts by pattern
reach the driver. Terms are counted in Spark; the driver gets those chosen, TERMS at most, and which of them the sample's
at most ``sample`` rows hold. A sample is of distinct rows, least hash first.

Defined cases: a null or empty text has no words, so it scores what the intercept says; without labelled rows the seed
lexicons and patterns vote alone; without rows the score is one half of a small prior; rows with a null doc_id are scored
but not learned from; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE = 12_000
#: Lengths of word beginnings that are terms as well, and the counts from which a term's further levels hold.
PREFIXES, COUNTS = (4, 6), (1, 2, 4)
#: Lexicons learned of words and of each length of beginnings, their sizes, the classifier's terms, and the lexicons' candidates.
LEXICONS, PER_LEXICON, TERMS, CANDIDATES = (2, 2, 2), 40, 4096, 1024
#: What a clean row that a lexicon's word meets weighs against a toxic one that no other of its words meets.
CLEAN = 2.0
LEARNED = sum(LEXICONS)
L2 = 1.0
#: Standard errors that a word's share in the posterior classes must differ by to become a term.
LEAST_Z = 5.0
#: A lexicon's words: standard errors, log odds and labelled rows that they need.
LEXICON_Z, LEXICON_ODDS, LEXICON_ROWS = 4.0, 3.0, 5
#: Conditional mutual information (nats) from which two voters count as dependent; or so many divided by the rows, if more: twice
#: this is the chi-square value that independent voters reach once in three thousand pairs.
LEAST_INFORMATION, CHANCE = 1e-4, 8.0
SEEDS = [
    "idiot idiots moron morons stupid dumb fool imbecile loser losers clown idiota imbécil estúpido dummkopf trottel idiote crétin",
    "pathetic worthless disgusting trash scum garbage filth vermin subhuman asqueroso basura abschaum ordure répugnant",
    "hate damn crap bastard bitch fuck fucking shit asshole hurensohn scheiße merde connard puta mierda",
]
YOU = "you your you're youre u du ihr dich euch tu vous te usted ustedes vosotros"
EDGE = ".,;:!?\"'()[]{}<>#$%&*+-/=@\\^_`|~"
MASKED, MARKS, SHOUTED = r"\pL[*@$#]+\pL", r"[!?]{2,}", r"\b\p{Lu}{3,}\b"
VOTERS = LEARNED + len(SEEDS) + 5


def hash_list(text: str) -> list[int]:
    return [xxhash.xxh3_64_intdigest(w) for w in text.split()]


def words_of(texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets, and for each lower-cased word without punctuation at either end the hashes of itself and of its PREFIXES."""
    offs, words = common.split_words(texts, lower=True)
    if not len(words):
        return offs, [np.zeros(0, np.uint64)] * (1 + len(PREFIXES))
    enc = words.dictionary_encode()
    plain = pc.utf8_lower(pc.ascii_trim(enc.dictionary, EDGE))
    at = np.asarray(enc.indices)
    out = [common.hash_words(plain)[at]]
    for n in PREFIXES:
        out.append(common.mix(common.hash_words(pc.utf8_slice_codeunits(plain, 0, n)) + np.uint64(n))[at])
    return offs, out


@dataclass
class Lexicons:
    """Word hashes, in order, from what count in a text they tell, and the voter that each belongs to."""

    word: np.ndarray
    least: np.ndarray
    voter: np.ndarray

    @classmethod
    def of(cls, learned: list[list[tuple[int, int]]]) -> Lexicons:
        sets = [*learned, *([[]] * (LEARNED - len(learned))), *([(w, 1) for w in hash_list(x)] for x in SEEDS)]
        word, least = (np.array([e[i] for s in sets for e in s], t) for i, t in ((0, np.uint64), (1, np.int64)))
        voter = np.array([k for k, s in enumerate(sets) for _ in s], np.int64)
        order = np.lexsort((voter, word))
        return cls(word[order], least[order], voter[order])


def find(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the hashes in the sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[at] == h, at, -1)


def held_in(kinds: list[np.ndarray], row: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the sorted hashes ``word``, count) of what rows' words and beginnings hold of them, by row and place."""
    width = len(word) + 1
    found = [find(word, h) for h in kinds]
    pair, count = np.unique(np.concatenate([row[x >= 0] * width + x[x >= 0] for x in found]), return_counts=True)
    return pair // width, pair % width, count


def held_terms(texts: pa.Array, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    offs, kinds = words_of(texts)
    return held_in(kinds, np.repeat(np.arange(len(offs) - 1), np.diff(offs)), word)


def votes(texts: pa.Array, lex: Lexicons) -> np.ndarray:
    """(rows, VOTERS) of 0 and 1."""
    offs, kinds = words_of(texts)
    n, lens = len(offs) - 1, np.diff(offs)
    row = np.repeat(np.arange(n), lens)
    out = np.zeros((n, VOTERS), np.int8)
    table, first = np.unique(lex.word, return_index=True)
    size = np.diff(np.r_[first, len(lex.word)])
    doc, at, times = held_in(kinds, row, table)
    for k in range(int(size.max(initial=0))):  # a word may be in several lexicons
        x = np.flatnonzero(size[at] > k)
        x = x[times[x] >= lex.least[first[at[x]] + k]]
        out[doc[x], lex.voter[first[at[x]] + k]] = 1
    some = np.maximum(lens, 20)
    you = find(np.unique(np.array(hash_list(YOU), np.uint64)), kinds[0]) >= 0
    whole = pc.fill_null(texts, "")
    count = lambda pattern: np.asarray(pc.count_substring_regex(whole, pattern=pattern), np.int64)
    marks = [np.bincount(row[you], minlength=n) * 10 >= some, np.asarray(pc.count_substring(whole, pattern="!"), np.int64) * 10 >= some, count(SHOUTED) * 10 >= some, count(MARKS) * 20 >= some, count(MASKED) * 50 >= some]
    out[:, VOTERS - len(marks) :] = np.stack(marks, axis=1)
    return out


def pattern(v: np.ndarray) -> np.ndarray:
    return (v.astype(np.int64) << np.arange(VOTERS)).sum(axis=1)


@dataclass
class LabelModel:
    """P(class 1), each voter's parent in the tree (-1: none), and P(voter fires | class, what its parent voted)."""

    prior: float
    parent: np.ndarray
    fire: np.ndarray  # (2, voters, 2)

    def log_odds(self, v: np.ndarray) -> np.ndarray:
        v = np.asarray(v, np.int64)
        seen = np.where(self.parent >= 0, v[:, self.parent], 0)
        p = np.clip(self.fire[:, np.arange(v.shape[1]), seen], 1e-5, 1 - 1e-5)
        like = np.where(v == 1, np.log(p), np.log(1 - p)).sum(axis=2)
        return np.log(self.prior / (1 - self.prior)) + like[1] - like[0]


def dependence(v: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Conditional mutual information of each two voters given the class, whose weights for each pattern are given (2, patterns)."""
    total, out = max(weight.sum(), 1e-9), np.zeros((v.shape[1], v.shape[1]))
    for w in weight:
        n = max(w.sum(), 1e-9)
        one, both = w @ v / n, (v * w[:, None]).T @ v / n
        for a, b, joint in ((1, 1, both), (1, 0, one[:, None] - both), (0, 1, one[None, :] - both), (0, 0, 1 - one[:, None] - one[None, :] + both)):
            alone = np.outer(one if a else 1 - one, one if b else 1 - one)
            joint = np.clip(joint, 0, 1)
            out += n / total * np.where(joint > 1e-12, joint * np.log(np.maximum(joint, 1e-12) / np.maximum(alone, 1e-12)), 0)
    np.fill_diagonal(out, 0)
    return out


def dependence_tree(information: np.ndarray, least: float = LEAST_INFORMATION) -> np.ndarray:
    """The parent of each voter in the tree of most information; edges of less than ``least`` are left out."""
    n = len(information)
    parent, best, near = np.full(n, -1), np.zeros(n), np.full(n, -1)
    out = set(range(n))
    while out:
        j = min(out, key=lambda x: (-best[x], x))
        out.remove(j)
        parent[j] = near[j] if best[j] >= least else -1
        for x in out:
            if information[j, x] > best[x]:
                best[x], near[x] = information[j, x], j
    return parent


def maximised(v: np.ndarray, weight: np.ndarray, parent: np.ndarray) -> LabelModel:
    """The model that the class weights (2, patterns) make likeliest, one pseudo-row at each voter's rate in the class."""
    fire = np.zeros((2, v.shape[1], 2))
    seen = np.where(parent >= 0, v[:, parent], 0)
    for c, w in enumerate(weight):
        rate = (w @ v + 0.1) / (w.sum() + 1)
        for u in (0, 1):
            under = w[:, None] * (seen == u)
            fire[c, :, u] = ((under * v).sum(axis=0) + rate) / (under.sum(axis=0) + 1)
    return LabelModel(float(np.clip((weight[1].sum() + 1) / (weight.sum() + 2), 0.001, 0.5)), parent, fire)


def fit_label_model(v: np.ndarray, count: np.ndarray, start: np.ndarray) -> LabelModel:
    """Expectation maximisation over vote patterns ``v`` with their counts, from posteriors ``start``; the tree of dependences
    is found anew between rounds."""
    v, parent, q = np.asarray(v, np.int64), np.full(v.shape[1], -1), start
    for _ in range(4):
        for _ in range(30):
            model = maximised(v, np.stack([(1 - q) * count, q * count]), parent)
            q = sigmoid(model.log_odds(v))
        parent = dependence_tree(dependence(v, np.stack([(1 - q) * count, q * count])), max(LEAST_INFORMATION, CHANCE / max(count.sum(), 1.0)))
    return model


def first_posteriors(v: np.ndarray, labelled: np.ndarray, y: np.ndarray, prior: float) -> np.ndarray:
    """Where estimation starts: the odds that the labelled rows' voters give, taken alone; without both labels, of lexicon voters that fire."""
    if len(np.unique(y)) < 2:
        return np.where(v[:, :-5].any(axis=1), 0.9, prior)
    return sigmoid(maximised(labelled.astype(np.int64), np.stack([1 - y, y]), np.full(v.shape[1], -1)).log_odds(v))


@dataclass
class Linear:
    """A logistic classifier on words and prefixes (sorted hashes) that stand at least 1, 2 and 4 times in a text."""

    word: np.ndarray
    weight: np.ndarray  # (words, levels): what a level adds
    intercept: float

    def score(self, texts: pa.Array) -> np.ndarray:
        row, term, count = held_terms(texts, self.word)
        level = np.searchsorted(COUNTS, count, "right") - 1
        added = np.cumsum(self.weight, axis=1)[term, level] if len(row) else np.zeros(0)
        return sigmoid(np.bincount(row, added, len(texts)) + self.intercept)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def row_sample(docs: DataFrame, use: Column, most: int) -> DataFrame:
    """doc_id, row, text of at most ``most`` distinct rows of ``docs`` with ``use``, least hash first; the rows that a hash lets
    through are about four times as many as are taken, at any size."""
    share = min(1.0, 4 * most / max(1, docs.count()))
    keyed = docs.where(use).select("doc_id", "text", F.xxhash64("text").alias("row"))
    order = F.xxhash64("doc_id", "row", F.lit("sample"))
    some = keyed.where(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    listed = some.select("doc_id", "row").distinct().orderBy(order, "doc_id", "row").limit(most)
    return some.join(F.broadcast(listed), ["doc_id", "row"]).dropDuplicates(["doc_id", "row"])


def term_counts(rows: DataFrame, weight: str) -> DataFrame:
    """kind, term, level, n, weight: how many of ``rows`` (text and a column of weights) hold a term so often, and their weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text"):
            offs, kinds = words_of(b.column("text"))
            w = np.asarray(b.column("weight"))
            row = np.repeat(np.arange(len(w)), np.diff(offs))
            for kind, h in enumerate(kinds):
                own, at = np.unique(h, return_inverse=True)
                pair, times = np.unique(row * max(len(own), 1) + at, return_counts=True)
                doc, term = pair // max(len(own), 1), pair % max(len(own), 1)
                for level, least in enumerate(COUNTS):
                    x = times >= least
                    n = np.bincount(term[x], minlength=len(own))
                    sums = np.bincount(term[x], w[doc[x]], len(own))
                    some = n > 0
                    columns = [np.full(int(some.sum()), kind, np.int32), own[some].view(np.int64), np.full(int(some.sum()), level, np.int32), n[some].astype(np.int64), sums[some]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "term", "level", "n", "weight"])

    found = rows.select("text", F.col(weight).cast("double").alias("weight")).mapInArrow(run, "kind int, term long, level int, n long, weight double")
    return found.groupBy("kind", "term", "level").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"))


def learn_lexicons(labelled: DataFrame, n: int, toxic: float) -> list[list[tuple[int, int]]]:
    """Lists of words, then of beginnings, each term at the count that tells most. Candidates are those that most raise the
    odds of a toxic label; a lexicon takes those that meet most toxic rows which its others do not, so that each lexicon by
    itself meets toxic rows of every kind."""
    if not 0 < toxic < n:
        return []
    bad, fine = F.col("weight") + 0.5, F.col("n") - F.col("weight") + 0.5
    odds = F.log(bad / (toxic + 1)) - F.log(fine / (n - toxic + 1))
    told = term_counts(labelled, "label").withColumns({"odds": odds, "z": odds / F.sqrt(1 / bad + 1 / fine)})
    told = told.where((F.col("z") > LEXICON_Z) & (F.col("odds") > LEXICON_ODDS) & (F.col("weight") >= LEXICON_ROWS))
    told = told.groupBy("kind", "term").agg(F.max(F.struct("z", (-F.col("level")).alias("down"))).alias("x")).select("kind", "term", "x.z", (-F.col("x.down")).alias("level"))
    cut = common.Cuts(labelled.sparkSession)
    told = cut(told, "told")  # read once for each kind
    out: list[list[tuple[int, int]]] = []
    for kind, lists in enumerate(LEXICONS):
        best = [(r.term & common.MASK, COUNTS[r.level]) for r in told.where(F.col("kind") == kind).orderBy(F.desc("z"), "term").limit(CANDIDATES).collect()]
        out += covering(labelled, best, lists)
    cut.drop()
    return out


def gathered(rows: DataFrame, word: np.ndarray, facts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """(row, place in the sorted hashes ``word``, count up to 255) of what the rows of a sample hold of them, and the rows' facts:
    three bytes a term reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text"):
            row, term, times = held_terms(b.column("text"), word)
            ends = np.searchsorted(row, np.arange(b.num_rows + 1))
            packed = [term[s:e].astype("<u2").tobytes() + np.minimum(times[s:e], 255).astype(np.uint8).tobytes() for s, e in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("row"), *(b.column(c) for c in facts), pa.array(packed, pa.binary())], names=["doc_id", "row", *facts, "terms"])

    own = rows.mapInArrow(run, f"doc_id long, row long, {', '.join(f'{c} double' for c in facts)}, terms binary").orderBy("doc_id", "row").collect()
    size = [len(r.terms) // 3 for r in own]
    term = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r.terms, "<u2", k).astype(np.int64) for r, k in zip(own, size, strict=True))])
    times = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(r.terms, np.uint8, k, 2 * k) for r, k in zip(own, size, strict=True))])
    return np.repeat(np.arange(len(own)), size), term, times, own


def covering(labelled: DataFrame, candidates: list[tuple[int, int]], lists: int) -> list[list[tuple[int, int]]]:
    """``lists`` lexicons of candidates (hash, least count), no term in two; greedily, ties by hash."""
    if not candidates:
        return [[]] * lists
    candidates = sorted(candidates)
    row, term, times, own = gathered(labelled, np.array([w for w, _ in candidates], np.uint64), ["label"])
    fires = times >= np.array([least for _, least in candidates])[term]
    row, term = row[fires], term[fires]
    bad = np.array([r.label for r in own]) > 0.5
    clean = np.bincount(term[~bad[row]], minlength=len(candidates))
    free, out = np.ones(len(candidates), bool), []
    for _ in range(lists):
        left, mine = bad.copy(), []
        while len(mine) < PER_LEXICON:
            new = np.bincount(term[left[row]], minlength=len(candidates))
            gain = np.where(free & (new >= LEXICON_ROWS), new - CLEAN * clean, 0)
            best = int(gain.argmax())
            if gain[best] <= 0:
                break
            free[best] = False
            mine.append(candidates[best])
            left[row[term == best]] = False
        out.append(mine)
    return out


def choose_terms(rows: DataFrame, n: int, share: float) -> np.ndarray:
    """Sorted hashes of the terms, TERMS at most, of which a level differs most between the posterior classes."""
    spread = F.col("n") * share * (1 - share) + 1
    z = F.abs(F.col("weight") - F.col("n") * share) / F.sqrt(spread)
    best = term_counts(rows, "posterior").where("n >= 5").groupBy("term").agg(F.max(z).alias("z")).where(F.col("z") >= LEAST_Z)
    return np.sort(np.array([r.term & common.MASK for r in best.orderBy(F.desc("z"), "term").limit(TERMS).collect()], np.uint64))


def fit_linear(word: np.ndarray, doc: np.ndarray, term: np.ndarray, count: np.ndarray, q: np.ndarray) -> Linear:
    """Logistic regression by Adam steps: row ``doc`` holds the ``term``-th of the sorted hashes ``word`` so often; q are the rows' posteriors."""
    n, share = max(len(q), 1), float(np.clip(q.mean() if len(q) else 0.05, 1e-3, 1 - 1e-3))
    levels = [(doc[count >= c], term[count >= c] * len(COUNTS) + k) for k, c in enumerate(COUNTS)]
    row, column = np.concatenate([d for d, _ in levels]), np.concatenate([t for _, t in levels])
    size = len(word) * len(COUNTS)
    w = np.zeros(size + 1)
    w[-1] = np.log(share / (1 - share))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, 401 if size else 1):
        p = sigmoid(np.bincount(row, w[column], len(q)) + w[-1])
        g = np.r_[np.bincount(column, (p - q)[row], size) + L2 * w[:-1], (p - q).sum()] / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Linear(word, w[:-1].reshape(-1, len(COUNTS)), float(w[-1]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, use: Column, target: str = "toxic", sample: int = SAMPLE) -> tuple[Linear, LabelModel, Lexicons]:
    """The classifier, the label model of the whole corpus' votes, and the lexicons; ``use`` says which rows may be learned
    from. Votes, which hold no labels, are counted over all rows."""
    common.configure(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    cut = common.Cuts(docs.sparkSession)
    known = labels.where(F.col(target).isNotNull() & use).groupBy("doc_id").agg(F.max(target).cast("double").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # repeated rows of an id may be many: distinct ones, and the bound, hold here too. Keys are ordered, texts are not moved for it
    own = docs.join(F.broadcast(known), "doc_id").withColumn("row", F.xxhash64("text"))
    listed = own.select("doc_id", "row").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "row").limit(sample)
    labelled = cut(own.join(F.broadcast(listed), ["doc_id", "row"]).dropDuplicates(["doc_id", "row"]), "labelled")
    n, toxic = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    lex = Lexicons.of(learn_lexicons(labelled, n, toxic))

    def vote(keep: list[str]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in common.slices(batches, "text"):
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(pattern(votes(b.column("text"), lex)), pa.int64())], names=[*keep, "votes"])

        return run

    counted = docs.mapInArrow(vote([]), "votes long").groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()
    own_votes = labelled.mapInArrow(vote(["label"]), "label double, votes long").groupBy("votes", "label").agg(F.count("*").alias("n")).orderBy("votes", "label").collect()
    v, count = unpack(np.array([r.votes for r in counted], np.int64)), np.array([r.n for r in counted], float)
    seen = np.repeat(np.array([r.votes for r in own_votes], np.int64), [r.n for r in own_votes])
    y = np.repeat(np.array([r.label for r in own_votes], float), [r.n for r in own_votes])
    model = fit_label_model(v, count, first_posteriors(v, unpack(seen), y, float(np.clip(toxic / max(n, 1), 0.01, 0.5))))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("row"), b.column("text"), pa.array(sigmoid(model.log_odds(votes(b.column("text"), lex))))], names=["doc_id", "row", "text", "posterior"])

    judged = cut(row_sample(docs, use, sample).mapInArrow(judge, "doc_id long, row long, text string, posterior double"), "posteriors")
    n, total = judged.agg(F.count("*"), F.coalesce(F.sum("posterior"), F.lit(0.0))).first()
    word = choose_terms(judged, n, float(np.clip(total / max(n, 1), 1e-3, 1 - 1e-3)))

    row, term, times, rows = gathered(judged, word, ["posterior"])
    classifier = fit_linear(word, row, term, times, np.array([r.posterior for r in rows], float))
    cut.drop()
    return classifier, model, lex


def unpack(codes: np.ndarray) -> np.ndarray:
    return (codes[:, None] >> np.arange(VOTERS) & 1).astype(float)


def score_toxicity(docs: DataFrame, classifier: Linear) -> DataFrame:
    """doc_id and score (0 to 1, higher: toxic likelier) of every row of ``docs``, of which only doc_id and text are read."""
    common.configure(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(classifier.score(b.column("text")), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
