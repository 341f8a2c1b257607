"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posterior labels.

1. Terms. A term is a word, or a word's beginning, that stands in a text at least so many times. On a bounded sample
   of labelled training rows terms are counted by label (in tasks, then summed). Those whose counts chance does not
   explain (by their likelihood ratio) are the classifier's; those that hardly stand in clean texts are also mined
   lexicons.
2. Voters. Fixed lexicons, mined lexicons and patterns (a term said again and again, a term beside a word that addresses
   someone, a masked or digit-for-letter spelling, shouting, several terms); each fires on a text or doesn't, for toxic
   or for clean. What fires is one bit each, so all documents come down to at most 2 ** VOTERS patterns with counts.
3. Label model. Expectation-maximisation over the patterns of all documents estimates how often each voter fires on
   toxic and on clean texts (its accuracy), the share of toxic texts, and the voters' correlations: each round estimates
   from what the classes leave over how voters go together, and in the next round voters that repeat one another count
   for less.
4. Classifier. Logistic regression on terms, trained on the sample's posterior labels, weighted to the estimated share
   of toxic texts.

labels.toxic is used for the sample and the terms only. Scores never use labels, lang, source or doc_id.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, sliced, small_batches, texts

#: Bound of the labelled sample, a quarter of it toxic; the rows with the smallest hashes of doc_id.
SAMPLE = 8_000
TOXIC_TERMS, CLEAN_TERMS = 600, 200
#: Least likelihood ratio of a term; least ratio and log odds of a mined lexicon's term.
LEAST_RATIO, LEXICON_RATIO, LEXICON_LEAN = 25.0, 60.0, 3.0
STEMS = (4, 5, 6)
LEVELS = (1, 2, 4)
WORD = re.compile(r"[^\W\d_]+")
CACHE_LIMIT = 1 << 18

LEXICONS: tuple[tuple[str, ...], ...] = (
    ("idiot", "idiots", "moron", "morons", "stupid", "dumb", "imbecile", "cretin"),
    ("scum", "trash", "vermin", "filth", "worthless", "useless"),
    ("loser", "losers", "clown", "clowns", "pathetic", "laughable"),
    ("disgusting", "vile", "repulsive", "hateful", "bastard", "bastards"),
)
MINED_LEXICONS = 5
PATTERNS = ("repeated", "addressed", "masked", "shouting", "several", "few", "none")
REPEATED, ADDRESSED, MASKED, SHOUTING, SEVERAL, FEW, NONE = range(len(LEXICONS) + MINED_LEXICONS, len(LEXICONS) + MINED_LEXICONS + len(PATTERNS))
#: Fixed lexicons, mined lexicons, patterns; the last two patterns are for clean.
VOTERS = len(LEXICONS) + MINED_LEXICONS + len(PATTERNS)
FOR_TOXIC = np.array([True] * (VOTERS - 2) + [False] * 2)
#: Words that address someone, and how many words before or after them a term may stand.
ADDRESS = frozenset("you your yours yourself u ur he she they them his her their du dich dir dein ihr euch euer sie tu toi te ton vous votre vos ils tú ti usted ustedes vosotros eres".split())
NEAR = 3
#: Marks and digits before a letter, the words that these can stand in, and what they stand for; a star stands for any letter.
MASK = re.compile(r"[@$*!013457]+(?=[^\W\d_])")
MASKED_WORD = re.compile(r"[^\W\d_]+(?:[@$*!013457]+[^\W\d_]+)+")
UNMASK = str.maketrans("@$!013457", "asioieast")
#: How often a voter is first thought to fire on texts of its own side and of the other.
FIRST = (0.4, 0.05)


def features(word: str) -> list[str]:
    """A word and its beginnings, which endings don't change."""
    return [f"={word}", *(f"{k}{word[:k]}" for k in STEMS if len(word) >= k)]


def counted(words: Counter) -> Counter:
    """How often a text's words have each feature."""
    found: Counter = Counter()
    for word, n in words.items():
        for f in features(word):
            found[f] += n
    return found


def leveled(feature: str, n: int) -> list[str]:
    return [f"{feature}#{level}" for level in LEVELS if n >= level]


@dataclass
class Terms:
    """The index of each term and the voter of those that are in a lexicon."""

    index: dict[str, int]
    voter: dict[int, int]

    @classmethod
    def build(cls, mined: list[str], others: list[str]) -> Terms:
        fixed = {f"={w}#1": g for g, words in enumerate(LEXICONS) for w in words}
        names = list(dict.fromkeys([*fixed, *mined, *others]))
        index = {t: i for i, t in enumerate(names)}
        # Beginnings of one word go to one voter, so that voters are as independent as the words are.
        lexicon = {t: len(LEXICONS) + crc32(t[1:5].encode()) % MINED_LEXICONS for t in mined} | fixed
        return cls(index, {index[t]: g for t, g in lexicon.items()})

    def reader(self, vote: bool = True):
        """A function from a text to (term indices, votes, 0 without `vote`); it keeps what words it has seen have to do with terms."""
        seen: set[str] = set()
        hits: dict[str, tuple] = {}
        telling: set[str] = set()  # the keys of hits
        wanted = {t.rpartition("#")[0] for t in self.index}
        index, voter = self.index, self.voter
        lexicon = {t.rpartition("#")[0] for t, i in index.items() if i in voter}

        def read(text: str) -> tuple[list[int], int]:
            low = text.lower()
            words = WORD.findall(low)
            own = set(words)
            if new := own - seen:
                if len(seen) + len(new) > CACHE_LIMIT:
                    for kept in (seen, hits, telling):
                        kept.clear()
                    new = own
                seen.update(new)
                for w in new:
                    if found := tuple(f for f in features(w) if f in wanted):
                        hits[w] = found
                        telling.add(w)
            hit = own & telling
            found: list[int] = []
            votes = 0
            voters: list[int] = []
            if hit:
                counts = counted_in(words, hit, hits)
                found = sorted(index[t] for f, n in counts.items() for t in leveled(f, n) if t in index)
            if not vote:
                return found, 0
            if hit:
                voters = [voter[i] for i in found if i in voter]
                if voters:
                    abuse = {w for w in hit if not lexicon.isdisjoint(hits[w])}
                    votes |= any(n >= 3 for f, n in counts.items() if f in lexicon) << REPEATED
                    votes |= (not own.isdisjoint(ADDRESS) and addressed(words, abuse)) << ADDRESSED
                for v in voters:
                    votes |= 1 << v
            votes |= masked(low) << MASKED
            votes |= (text.isupper() or text.count("!!") > 2) << SHOUTING
            votes |= (len(voters) >= 3) << SEVERAL | (len(voters) < 2) << FEW | (not voters) << NONE
            return found, votes

        return read


def addressed(words: list[str], abuse: set[str]) -> bool:
    """Whether a word of abuse stands within NEAR words of one that addresses someone."""
    return any(w in abuse and not ADDRESS.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1]) for i, w in enumerate(words))


FIXED_WORDS = frozenset(w for words in LEXICONS for w in words)


def masked(low: str) -> bool:
    """Whether a lower-cased text spells a fixed lexicon's word with marks or digits for letters."""
    end = 0
    for m in MASK.finditer(low):
        start = m.start()
        if start < end or not start or not low[start - 1].isalpha():
            continue
        while start and low[start - 1].isalpha():
            start -= 1
        word = MASKED_WORD.match(low, start)
        end = word.end()
        plain = word.group().translate(UNMASK)
        if "*" in plain:
            if any(len(w) == len(plain) and all(a in (b, "*") for a, b in zip(plain, w)) for w in FIXED_WORDS):
                return True
        elif plain in FIXED_WORDS:
            return True
    return False


def counted_in(words: list[str], hit: set[str], hits: dict[str, tuple]) -> Counter:
    counts: Counter = Counter()
    for w in words:
        if w in hit:
            counts.update(hits[w])
    return counts


def label_model(votes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Of vote patterns (0/1, patterns by voters) and their counts: P(fires | toxic), P(fires | clean), share, weights.

    A voter's weight is 1 over 1 plus the sum of its absolute correlations, within classes, with the other voters; it
    is estimated anew in each round of the second half, when the classes have come apart.
    """
    side = np.where(FOR_TOXIC[: votes.shape[1]], 1, 0)
    on_toxic = np.where(side, FIRST[0], FIRST[1]).astype(float)
    on_clean = np.where(side, FIRST[1], FIRST[0]).astype(float)
    share, weights = 0.1, np.ones(votes.shape[1])
    for k in range(rounds):
        p = posterior(votes, on_toxic, on_clean, share, weights)
        a, b = counts * p, counts * (1 - p)
        share = float(np.clip(a.sum() / counts.sum(), 0.001, 0.5))
        on_toxic, on_clean = (a @ votes + 1) / (a.sum() + 2), (b @ votes + 1) / (b.sum() + 2)
        # A voter may be useless, but not vote against its own side.
        both = share * on_toxic + (1 - share) * on_clean
        wrong = (on_toxic < on_clean) == (side == 1)
        on_toxic, on_clean = np.where(wrong, both, on_toxic), np.where(wrong, both, on_clean)
        if k >= rounds // 2:
            weights = 1 / (1 + correlations(votes, ((a, on_toxic), (b, on_clean))).sum(axis=1))
    return on_toxic, on_clean, share, weights


def correlations(votes: np.ndarray, classes: tuple[tuple[np.ndarray, np.ndarray], ...]) -> np.ndarray:
    """Absolute correlations of voters within classes (counts and means), by the classes' shares; zero with themselves."""
    left, total = np.zeros((votes.shape[1],) * 2), sum(w.sum() for w, _ in classes)
    for w, mean in classes:
        d = votes - mean
        cov = (d * w[:, None]).T @ d / max(w.sum(), 1e-9)
        sd = np.sqrt(np.diag(cov))
        varies = sd > 0.03  # of a voter that nearly always, or never, fires there is nothing to tell
        rho = np.where(np.outer(varies, varies), cov / np.maximum(np.outer(sd, sd), 1e-9), 0)
        left += np.abs(rho) * w.sum() / total
    np.fill_diagonal(left, 0)
    return left


def posterior(votes: np.ndarray, on_toxic: np.ndarray, on_clean: np.ndarray, share: float, weights: np.ndarray) -> np.ndarray:
    log = lambda p: votes @ (weights * np.log(p)) + (1 - votes) @ (weights * np.log(1 - p))
    z = np.log(share / (1 - share)) + log(on_toxic) - log(on_clean)
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def logistic(rows: list[list[int]], n: int, p: np.ndarray, weight: np.ndarray, penalty: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights of n binary features and the intercept for soft labels p, by accelerated gradient descent."""
    x = np.zeros((len(rows), n + 1), np.float32)
    p, weight = p.astype(np.float32), weight.astype(np.float32)
    for i, own in enumerate(rows):
        x[i, own] = 1
    x[:, n] = 1
    weight = weight / weight.sum()
    bound = 0.25 * float((weight * (x * x).sum(axis=1)).sum()) + penalty
    w = v = np.zeros(n + 1, np.float32)
    for k in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        ridge = np.append(v[:n], np.float32(0))
        new = v - (x.T @ (weight * (q - p)) + np.float32(penalty) * ridge) / np.float32(bound)
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w[:n].astype(float), float(w[n])


def train_fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 != 0


@dataclass
class Toxicity:
    terms: Terms
    weights: np.ndarray
    intercept: float
    share: float
    on_toxic: np.ndarray
    on_clean: np.ndarray
    damping: np.ndarray

    def voted(self, text: str) -> float:
        """The label model's own probability that a text is toxic, before any classifier."""
        votes = self.terms.reader()(text)[1]
        bits = ((votes >> np.arange(VOTERS)) & 1).astype(float)[None, :]
        return float(posterior(bits, self.on_toxic, self.on_clean, self.share, self.damping)[0])

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE, mine: bool = True) -> Toxicity:
        """Without labelled rows, or with `mine` false, there are no mined terms, and only fixed lexicons and patterns count.

        Of labels of one doc_id that contradict each other, toxic counts; of its rows, the first text. So the sample has
        sample_rows rows at most, however often an id stands in the table.
        """
        small_batches(docs.sparkSession)
        known = labels.where(train_fold() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        some = lambda y, n: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        sample = F.broadcast(some(1, sample_rows // 4).unionByName(some(0, sample_rows - sample_rows // 4)))
        found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(sample, "doc_id")
        rows = saved(found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"), "toxic-sample")

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            by = (Counter(), Counter())
            for batch in batches:
                for text, y in zip(batch["text"], batch["toxic"]):
                    for f, n in counted(Counter(WORD.findall(text.lower()))).items():
                        by[y].update(leveled(f, n))
            names = list(by[0] | by[1])
            for a in range(0, len(names), 10_000):
                own = names[a : a + 10_000]
                yield pd.DataFrame({"term": own, "toxic": [by[1][t] for t in own], "clean": [by[0][t] for t in own]})

        sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
        counts = rows.mapInPandas(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
        counts = counts.where(F.col("t") + F.col("c") > 1)  # of all tasks' texts: a task alone can't tell a rare term
        t, c, base = F.col("t"), F.col("c"), sizes.get(1, 0) / max(1, sum(sizes.values()))
        if mine and 0 < base < 1:
            part = lambda x, p: F.when(x > 0, x * F.log(x / ((t + c) * p))).otherwise(0.0)
            ratio = 2 * (part(t, base) + part(c, 1 - base))
            lean = F.log((t + 0.5) / (sizes[1] + 1)) - F.log((c + 0.5) / (sizes[0] + 1))
            counts = saved(counts.withColumns({"ratio": ratio, "lean": lean}).where(F.col("ratio") >= LEAST_RATIO), "toxic-terms")
            best = lambda rule, most: [r["term"] for r in counts.where(rule).orderBy(F.desc("ratio"), "term").limit(most).collect()]
            terms = Terms.build(best((F.col("lean") >= LEXICON_LEAN) & (F.col("ratio") >= LEXICON_RATIO), TOXIC_TERMS), best(F.col("lean") > 0, TOXIC_TERMS) + best(F.col("lean") < 0, CLEAN_TERMS))
        else:
            terms = Terms.build([], [])
        shared = docs.sparkSession.sparkContext.broadcast(terms)

        def patterns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            read, found = shared.value.reader(), Counter()
            for batch in sliced(batches):
                found.update(read(text)[1] for text in batch["text"])
            yield pd.DataFrame(list(found.items()), columns=["votes", "n"])

        seen = texts(docs).select("text").mapInPandas(patterns, "votes int, n long").groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").toPandas()
        bits = lambda v: ((np.asarray(v, np.int64)[:, None] >> np.arange(VOTERS)) & 1).astype(float)
        model = label_model(bits(seen["votes"]), seen["n"].to_numpy(float)) if len(seen) else (np.full(VOTERS, 0.5), np.full(VOTERS, 0.5), 0.1, np.ones(VOTERS))
        on_toxic, on_clean, share, damping = model

        def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            read = shared.value.reader()
            for batch in batches:
                yield pd.DataFrame([(y, *read(text)) for text, y in zip(batch["text"], batch["toxic"])], columns=["toxic", "terms", "votes"])

        seen = rows.mapInPandas(described, "toxic int, terms array<int>, votes int").toPandas()  # at most sample_rows, short rows
        seen = seen.loc[sorted(range(len(seen)), key=lambda i: (seen["votes"][i], list(seen["terms"][i]), seen["toxic"][i]))].reset_index(drop=True)
        n = len(terms.index)
        if not sizes.get(0) or not sizes.get(1):
            return cls(terms, np.full(n, 6.0), -3.0, share, on_toxic, on_clean, damping)
        p = posterior(bits(seen["votes"]), on_toxic, on_clean, share, damping)
        weight = np.where(p > 0.5, share / max((p > 0.5).mean(), 1e-9), (1 - share) / max((p <= 0.5).mean(), 1e-9))
        weights, intercept = logistic([list(t) for t in seen["terms"]], n, p, weight)
        return cls(terms, weights, intercept, share, on_toxic, on_clean, damping)

    def score(self, text: Column) -> Column:
        """The probability of label 1, between 0 and 1; null and empty texts have that of a text without any term."""
        model = (self.terms, self.weights, self.intercept)

        @F.pandas_udf(T.DoubleType())
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            terms, weights, intercept = model
            read = terms.reader(vote=False)
            for batch in batches:
                z = np.array([weights[read(t)[0]].sum() + intercept for t in batch])
                yield pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

        return run(F.coalesce(text, F.lit("")))


def scored(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; a row without doc_id is not held out. Repeated rows score alike."""
    model = Toxicity.fit(docs, labels, sample_rows)
    out = docs.select("doc_id", F.coalesce(~train_fold(), F.lit(False)).alias("held_out"), model.score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that score below 0.5. A null text is judged as an empty one, repeated rows alike; an empty table stays empty."""
    return docs.where(Toxicity.fit(docs, labels).score(F.col("text")) < 0.5)
