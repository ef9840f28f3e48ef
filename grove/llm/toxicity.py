"""Toxicity scores by weak supervision.

Voters are lexicon entries (a word) and patterns (the first letters of a word), each with the number of hits from which it
fires, mined from a bounded sample of labelled rows; a pattern and a word that stand in nearly the same texts are one voter.
A voter says toxic where it fires. It says clean where it does not fire in a text long enough to tell that has the frequent words of the texts it fires in, so that it knows their language;
elsewhere it abstains. A generative label model sees these votes only. It estimates by expectation-maximisation how often a
voter is right in either class, and correlations: voters form a tree of the strongest dependences that the class leaves,
and a vote depends on the class and on the vote of its parent in the tree. Labels are not evidence to it; they mine the
voters and say which class is toxic. A linear classifier over the voters' hits is trained on the posterior labels and scores
every whole text in one map over rows, without a shuffle.

Bounds: the model is fitted on at most `sample` labelled rows, one an id (those of the smallest hash of the id), with at
most `voters` voters; both are parameters. Scoring covers all rows.

Defined results: null text counts as empty and gets the score of a text in which no voter fires; rows of a text that
repeat get equal scores; labels that are null or that have no document are left out, and the larger counts where an id has
several, and of an id's texts the smallest; a null doc_id is passed on, and counts as not held out; without labelled rows of
both classes all scores are the share of toxic labels (0 where there are none); empty tables give no rows; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grove.llm.common import small_batches
from grove.storage import cut

SAMPLE, VOTERS, THRESHOLD = 20_000, 128, 0.3
FOLDS, HELD_OUT = 4, 2
PREFIXES = (4, 5, 6)
#: Hits in a text from which a voter may fire.
OFTEN = (1, 2, 3)
#: Share of texts in common from which a pattern and a word that it covers are one voter.
ALIKE = 0.7
#: Words of a text from which a voter that does not fire says clean, if it has DOMAIN of the voter's COMPANIONS most frequent words.
LONG, COMPANIONS, DOMAIN = 20, 12, 3
#: Votes.
CLEAN, TOXIC, ABSTAINS = 0, 1, 2
#: Words whose voters a worker remembers.
KEPT = 100_000
LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def patterns_of(word: str) -> tuple[str, ...]:
    """What can vote on a word: the word itself, and its first letters as patterns (with a star)."""
    return (word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n))


_known: dict = {"name": None, "words": {}}


@dataclass
class Model:
    """A linear classifier over the voters: the log counts of their hits, and then whether they fire."""

    voters: dict[str, tuple[int, int]] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -30.0
    labels: LabelModel | None = None

    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def often(self) -> list[int]:
        """The hits from which each voter fires."""
        return [n for _, n in self.voters.values()]

    def known(self) -> dict[str, tuple[int, ...]]:
        """The voters of words seen before: one table a worker, whatever the number of its tasks."""
        if _known["name"] != self.name:
            _known.update(name=self.name, words={})
        return _known["words"]

    def hits(self, text: str) -> dict[int, int]:
        """How many hits each voter has in a text."""
        out: dict[int, int] = defaultdict(int)
        known = self.known()
        for word, n in Counter(LETTERS.findall(text.lower())).items():
            mine = known.get(word)
            if mine is None:
                mine = tuple(self.voters[p][0] for p in patterns_of(word) if p in self.voters)
                if len(known) >= KEPT:
                    known.clear()
                known[word] = mine
            for v in mine:
                out[v] += n
        return out

    def score(self, text: str) -> float:
        k = len(self.voters)
        z = self.bias + sum(self.weights[v] * np.log1p(n) + self.weights[k + v] * (n >= self.often[v]) for v, n in self.hits(text).items())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text and toxic of at most `sample` labelled rows that are not held out."""
    spark = small_batches(docs).sparkSession
    given = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    book = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in rows], "doc_id bigint, toxic int")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(book), "doc_id")  # `sample` rows of two numbers
    return cut(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "labelled")


def mine(rows: DataFrame, voters: int = VOTERS, least: int = 3, share: float = 0.015, clear: float = 2.5) -> dict[str, tuple[int, int]]:
    """Voters: patterns, with a number and the count of hits from which they fire.

    Those that tell toxic texts best, by the log of their likelihood ratio (`clear` at least) times how many they fire in,
    among those that fire in at least `least` toxic texts and in that share of them.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            count: dict[tuple[str, int], list[int]] = defaultdict(lambda: [0, 0])
            for text, toxic in zip(batch["text"], batch["toxic"]):
                hits: Counter = Counter()
                for word, n in Counter(LETTERS.findall(text.lower())).items():
                    if len(word) > 2:
                        hits.update(dict.fromkeys(patterns_of(word), n))
                for p, n in hits.items():
                    for often in OFTEN:
                        if n >= often:
                            count[p, often][toxic > 0] += 1
            yield pd.DataFrame([(p, often, a, b) for (p, often), (a, b) in count.items()], columns=["pattern", "often", "clean", "toxic"])

    total = {bool(r["t"]): r["n"] for r in rows.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = total.get(False, 0), total.get(True, 0)
    if not n0 or not n1:
        return {}
    sums = rows.mapInPandas(counted, "pattern string, often int, clean bigint, toxic bigint").groupBy("pattern", "often").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    ratio = F.log((F.col("toxic") + 0.5) / (n1 + 1) / ((F.col("clean") + 2) / (n0 + 4)))
    sums = sums.withColumn("texts", F.max(F.col("clean") + F.col("toxic")).over(Window.partitionBy("pattern")))
    sums = sums.where((F.col("toxic") >= max(least, share * n1)) & (ratio > clear))
    found = sums.orderBy((F.col("toxic") * ratio).desc(), "pattern", "often").limit(8 * voters).collect()
    chosen: dict[str, tuple[int, int]] = {}
    texts: dict[str, int] = {}
    for r in found:
        p, n = r["pattern"], r["texts"]
        # a pattern and a word that are in nearly the same texts are one voter, as are two numbers of hits of one pattern
        same = (q == p or (covers(p, q) or covers(q, p)) and min(n, texts[q]) > ALIKE * max(n, texts[q]) for q in chosen)
        if len(chosen) < voters and not any(same):
            chosen[p], texts[p] = (len(chosen), r["often"]), n
    return chosen


def covers(a: str, b: str) -> bool:
    """Whether pattern a fires wherever b does."""
    return a == b or a.endswith("*") and b.startswith(a[:-1])


@dataclass
class LabelModel:
    """P(class), and P(vote | class, vote of the parent) for votes that are no abstentions; a root's parent abstains."""

    prior: np.ndarray  # class
    parent: np.ndarray  # voter -> voter, or -1
    rates: np.ndarray  # class, voter, vote of the parent -> P(toxic)
    accuracies: np.ndarray  # class, voter -> how often its votes are right
    correlations: np.ndarray  # voter, voter: of votes within the classes, where both vote

    def log_likelihood(self, votes: np.ndarray) -> np.ndarray:
        """Of each row of votes in either class; abstentions say nothing."""
        above = np.where(self.parent >= 0, votes[:, self.parent], ABSTAINS)
        toxic = self.rates[:, np.arange(votes.shape[1]), above]
        said = np.where(votes == TOXIC, np.log(toxic), np.log(1 - toxic))
        return np.where(votes == ABSTAINS, 0, said).sum(axis=2)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        clean, toxic = np.log(self.prior)[:, None] + self.log_likelihood(votes)
        return 1 / (1 + np.exp(np.clip(clean - toxic, -500, 500)))


def dependences(votes: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each two voters, over rows on which both vote: information that they share within the classes, and correlation."""
    k = votes.shape[1]
    states = [(votes == v).astype(float) for v in (CLEAN, TOXIC)]
    shared, covariance, spread = np.zeros((k, k)), np.zeros((k, k)), np.zeros((k, k))
    for w in weight:
        both = np.array([[(a * w[:, None]).T @ b for b in states] for a in states])  # vote, vote, voter, voter
        mass = both.sum(axis=(0, 1)) + 1e-9
        joint = both / mass
        left, right = joint.sum(axis=1), joint.sum(axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            each = np.where(joint > 0, joint * np.log(joint / (left[:, None] * right[None])), 0)
        shared += mass * each.sum(axis=(0, 1))
        covariance += mass * (joint[1, 1] - left[1] * right[1])
        spread += mass * np.sqrt(left[0] * left[1] * right[0] * right[1])
    for table in (shared, covariance):
        np.fill_diagonal(table, 0)
    return shared, covariance / (spread + 1e-9)


def tree_of(shared: np.ndarray, least: float) -> np.ndarray:
    """The parents of a forest of greatest total: edges of more than `least`, the strongest first, that close no circle."""
    k = len(shared)
    parent, seen = np.full(k, -1), np.zeros(k, bool)
    for root in np.argsort(-shared.sum(axis=1), kind="stable"):
        if seen[root]:
            continue
        best, way = np.full(k, -1.0), np.full(k, -1)
        at = root
        while at >= 0:  # the strongest edge from the part built so far to a voter outside it
            seen[at] = True
            closer = ~seen & (shared[at] > np.maximum(best, least))
            best[closer], way[closer] = shared[at][closer], at
            outside = np.where(seen, -1, best)
            at = int(outside.argmax()) if outside.max() > least else -1
            if at >= 0:
                parent[at] = way[at]
    return parent


def label_model(votes: np.ndarray, rounds: int = 30, least: float = 3.0) -> tuple[np.ndarray, LabelModel]:
    """The posterior of toxic for each row of votes (CLEAN, TOXIC or ABSTAINS), and the model, from the votes alone.

    Starts from how many voters say toxic. least: shared information (nats, over all rows) of voters that depend on each
    other; the chance value is about a half for each class.
    """
    n, k = votes.shape
    said = (votes == TOXIC).sum(axis=1)
    posterior = 1 - 0.9 * 0.25**said
    for _ in range(rounds):
        weight = np.stack([1 - posterior, posterior])
        prior = (weight.sum(axis=1) + 1) / (n + 2)
        shared, correlations = dependences(votes, weight)
        parent = tree_of(shared, least)
        above = np.where(parent >= 0, votes[:, parent], ABSTAINS)
        plain = [((weight @ (votes == v)) + 0.5) for v in (CLEAN, TOXIC)]
        mean = plain[TOXIC] / (plain[CLEAN] + plain[TOXIC])
        rates = np.empty((2, k, 3))
        for state in (CLEAN, TOXIC, ABSTAINS):  # drawn to the voter's rate without its parent by the weight of one row
            hit, miss = (weight @ ((votes == v) & (above == state)) for v in (TOXIC, CLEAN))
            rates[:, :, state] = (hit + mean) / (hit + miss + 1)
        model = LabelModel(prior, parent, rates, np.stack([1 - mean[0], mean[1]]), correlations)
        now = model.posterior(votes)
        done = np.abs(now - posterior).max() < 1e-6
        posterior = now
        if done:
            break
    return posterior, model


def linear(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + keep * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, voters: int = VOTERS) -> Model:
    rows = labelled(docs, labels, sample)
    model = Model(mine(rows, voters))
    if not model.voters:
        n, toxic = rows.agg(F.count(F.lit(1)), F.sum((F.col("toxic") > 0).cast("int"))).first()
        share = (toxic or 0) / n if n else 0.0
        model.bias = float(np.log(share / (1 - share))) if 0 < share < 1 else (30.0 if share else -30.0)
        return model

    known = companions(rows, model)

    def fired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hits = [model.hits(t) for t in batch["text"]]
            votes = [votes_of(h, t, model, known).tobytes() for h, t in zip(hits, batch["text"])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "voter": [list(h) for h in hits], "n": [list(h.values()) for h in hits], "votes": votes})

    # `sample` rows at most, of `voters` bytes and what fires
    seen = rows.mapInPandas(fired, "doc_id bigint, toxic int, voter array<int>, n array<int>, votes binary").toPandas()
    seen = seen.sort_values("doc_id", kind="stable", ignore_index=True)
    x = np.zeros((len(seen), 2 * len(model.voters)), np.float32)
    often = np.array(model.often)
    for i, (v, n) in enumerate(zip(seen["voter"], seen["n"])):
        x[i, v], x[i, np.asarray(v, int) + len(often)] = np.log1p(np.asarray(n, float)), np.asarray(n) >= often[np.asarray(v, int)]
    votes = np.frombuffer(b"".join(seen["votes"]), np.uint8).reshape(len(seen), -1)
    posterior, model.labels = label_model(votes)
    given = seen["toxic"].to_numpy() > 0
    if posterior[given].mean() < posterior[~given].mean():  # the labels say which of the two classes is toxic
        posterior = 1 - posterior
    model.weights, model.bias = linear(x, posterior)
    return model


def _frequent(words: list[str], n: int = 100) -> list[str]:
    """The most frequent words."""
    return [w for w, _ in sorted(Counter(words).items(), key=lambda c: (-c[1], c[0]))[:n]]


def companions(rows: DataFrame, model: Model, n: int = COMPANIONS) -> list[set[str]]:
    """For each voter the n words that are among the frequent ones of most texts in which it fires."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            count: Counter = Counter()
            for text in batch["text"]:
                fires = [v for v, hits in model.hits(text).items() if hits >= model.often[v]]
                if fires:
                    frequent = _frequent(LETTERS.findall(text.lower()))
                    count.update((v, w) for v in fires for w in frequent)
            yield pd.DataFrame([(v, w, c) for (v, w), c in count.items()], columns=["voter", "word", "n"])

    sums = rows.mapInPandas(counted, "voter int, word string, n bigint").groupBy("voter", "word").agg(F.sum("n").alias("n"))
    first = F.row_number().over(Window.partitionBy("voter").orderBy(F.desc("n"), "word"))
    out: list[set[str]] = [set() for _ in model.voters]
    for r in sums.withColumn("__n", first).where(F.col("__n") <= n).collect():  # n words a voter
        out[r["voter"]].add(r["word"])
    return out


def votes_of(hits: dict[int, int], text: str, model: Model, known: list[set[str]]) -> np.ndarray:
    """The votes of all voters on a text; known: each voter's companions."""
    words = LETTERS.findall(text.lower())
    votes = np.full(len(known), ABSTAINS, np.uint8)
    if len(words) >= LONG:
        frequent = set(_frequent(words))
        votes[[len(mine & frequent) >= DOMAIN for mine in known]] = CLEAN
    votes[[v for v, n in hits.items() if n >= model.often[v]]] = TOXIC
    return votes


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep and the score of each text."""
    fields = [docs.schema[c] for c in keep]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[list(keep)].copy()
            out["score"] = [model.score(t if t is not None else "") for t in batch["__text"]]
            yield out.astype({f.name: "Int64" for f in fields if f.dataType.typeName() in ("long", "integer")})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double"
    return docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text")).mapInPandas(rows, schema)


def rate(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, voters: int = VOTERS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(docs, train(docs, labels, sample, voters))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, voters: int = VOTERS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    model = train(docs, labels, sample, voters)
    rated = F.pandas_udf(lambda texts: texts.fillna("").map(model.score).astype(float), "double")
    return docs.where(rated(F.col("text")) < threshold)
