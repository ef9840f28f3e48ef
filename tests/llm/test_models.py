import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from grove.llm import ctw, toxicity
from tests.conftest import SF


def tokens(text):
    return (text or "").encode().lower().split()


def brute_ctw(train, texts, depth=ctw.DEPTH):
    """Context-tree weighting node by node, on dictionaries."""
    counts = [defaultdict(lambda: [0, 0]) for _ in range(depth + 1)]

    def steps(text):
        data = bytes([ctw.EDGE]) * depth + text + bytes([ctw.EDGE])
        for i in range(depth, len(data)):
            context = data[i - depth : i][::-1]
            for k in range(8):
                yield context, (k, data[i] >> (8 - k)), data[i] >> (7 - k) & 1

    for text in train:
        for context, node, bit in steps(text):
            for d in range(depth + 1):
                counts[d][context[:d], node][bit] += 1
    kt = lambda n: math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - 2 * math.lgamma(0.5)
    log_p, own, below = {}, {}, defaultdict(float)
    for d in range(depth, -1, -1):
        new = defaultdict(float)
        for (context, node), n in counts[d].items():
            if d == depth:
                log_p[d, context, node] = kt(n)
            else:
                a, b = kt(n), below[context, node]
                both = max(a, b) + math.log1p(math.exp(-abs(a - b)))
                log_p[d, context, node], own[d, context, node] = both - math.log(2), math.exp(a - both)
            if d:
                new[context[: d - 1], node] += log_p[d, context, node]
        below = new
    out = []
    for text in texts:
        total = 0.0
        for context, node, bit in steps(text):
            p = None
            for d in range(depth, -1, -1):
                n = counts[d].get((context[:d], node))
                if n:
                    mine = (n[1] + 0.5) / (sum(n) + 1)
                    p = mine if p is None else own[d, context[:d], node] * mine + (1 - own[d, context[:d], node]) * p
            p = 0.5 if p is None else p
            total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


def out_of_fold(doc_id, folds, fold):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def check_scores(rows, docs):
    train = [t for i, t in docs if not out_of_fold(i, 7, 2)]
    c = Counter(w for t in train for w in [*tokens(t), None])
    n, v = sum(c.values()), len(c)
    scores = brute_ctw([b" ".join(tokens(t)) for t in train], [b" ".join(tokens(t)) for _, t in docs])
    want = []
    for (i, t), s in zip(docs, scores):
        w = [*tokens(t), None]
        want.append((i, out_of_fold(i, 7, 2), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), s))
    key = lambda r: (repr(r[0]), r[6])
    for got, exp in zip(sorted(map(tuple, rows), key=key), sorted(want, key=key), strict=True):
        assert got[:5] == exp[:5]
        assert math.isclose(got[5], exp[5], rel_tol=1e-9) and math.isclose(got[6], exp[6], rel_tol=1e-4, abs_tol=1e-5)


def test_ctw_against_node_by_node(spark):
    docs = [(i, f"the cat {i % 5} sat on THE mat number {i * i}") for i in range(40)] + [(None, "null id"), (50, None), (51, ""), (2, "the cat"), (2, "the cat"), (52, "unseen Ω words"), (53, "ab " * 300)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, bucket string, score int")
    check_scores(ctw.scores(df).collect(), docs)
    assert ctw.scores(df.limit(0)).count() == 0


def test_ctw_without_training_rows(spark):
    held = next(i for i in range(100) if out_of_fold(i, 7, 2))
    row = ctw.scores(spark.createDataFrame([(held, "ab c")], "doc_id long, text string")).first()
    assert row["n_known"] == 0 == row["train_tokens"] and math.isclose(row["score"], 5 * 8 * math.log10(0.5), rel_tol=1e-6)


def test_ctw_chunks_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(ctw, "BUCKET", 200)
    docs = [(i, f"word{i % 7} some more text {i % 3} here") for i in range(60)]
    check_scores(ctw.scores(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)
    keys = [k for k, _ in ctw.grams([b"hello world", b"", b"x" * 50], chunk=8)]
    assert np.concatenate(keys).tolist() == np.concatenate([k for k, _ in ctw.grams([b"hello world", b"", b"x" * 50])]).tolist()


def test_log_kt():
    n = np.array([0, 1, 5, 70_000, 200_000, 3])
    m = np.array([0, 0, 7, 3, 100_000, 90_000])
    want = [math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for a, b in zip(n.tolist(), m.tolist())]
    assert np.allclose(ctw.log_kt(n, m), want, rtol=1e-9, atol=1e-6)


def test_op3_query(spark):
    from grove.llm.queries import QUERIES

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = {r["doc_id"]: r for r in QUERIES["op3_context_tree_weighting"](spark, SF).collect()}
    c = Counter(w for i, t in docs if not out_of_fold(i, 7, 2) for w in [*tokens(t), None])
    n, v = sum(c.values()), len(c)
    for i, t in docs:
        w = [*tokens(t), None]
        assert (rows[i]["held_out"], rows[i]["n_tokens"], rows[i]["n_known"], rows[i]["train_tokens"]) == (out_of_fold(i, 7, 2), len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(rows[i]["base_score"], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)


def test_toxicity_on_held_out_rows(spark):
    from grove.llm.queries import QUERIES

    big = "/root/testdata/sf0.01"
    got = QUERIES["op5_toxicity_weak_supervision"](spark, big).toPandas().merge(spark.read.parquet(f"{big}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    assert (held["predicted"] == held["toxic"]).mean() > 0.95
    assert all(out_of_fold(i, 4, 2) == h for i, h in zip(got.doc_id.tolist(), got.held_out))


def test_toxicity_edge_rows(spark):
    words = ["calm", "nice", "river", "stone", "cloud"]
    docs = [(i, " ".join(words[(i + k) % 5] for k in range(20)) + (" zorgle" if i % 4 == 0 else "")) for i in range(200)]
    docs += [(300, None), (301, ""), (None, "zorgle zorgle"), (302, "zorgle " * 3000), (302, "zorgle " * 3000)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, toxic int, score string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 200)] + [(7, 1, None), (None, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.rate(df, labels).collect()
    assert len(rows) == len(docs)
    for r in rows:
        toxic = r["doc_id"] is None or r["doc_id"] == 302 or r["doc_id"] < 200 and r["doc_id"] % 4 == 0
        assert r["predicted"] == int(toxic), r
    kept = toxicity.keep_clean(df, labels)
    assert kept.columns == df.columns and kept.count() == 152
    none = toxicity.rate(df, labels.limit(0)).collect()
    assert {r["predicted"] for r in none} == {0}
    assert toxicity.rate(df.limit(0), labels).count() == 0


def drawn_votes(n, seed):
    """Votes of five voters that err by themselves, of one that copies the first in nine of ten cases, with abstentions."""
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.3
    right = np.array([[0.95, 0.97, 0.9, 0.95, 0.98], [0.8, 0.7, 0.75, 0.6, 0.85]])
    votes = np.where(rng.random((n, 5)) < right[y.astype(int)], y[:, None], ~y[:, None]).astype(int)
    copy = np.where(rng.random(n) < 0.9, votes[:, 0], rng.random(n) < 0.3).astype(int)
    votes = np.hstack([votes, copy[:, None]])
    votes[rng.random(votes.shape) < 0.1] = toxicity.ABSTAINS
    return y, votes, right


def test_label_model_finds_accuracies_and_correlations():
    y, votes, right = drawn_votes(6000, 0)
    posterior, model = toxicity.label_model(votes)
    assert ((posterior > 0.5) == y).mean() > 0.95
    assert np.abs(model.accuracies[:, 1:5] - right[:, 1:]).max() < 0.05
    assert model.parent[0] == 5 or model.parent[5] == 0
    assert model.correlations[0, 5] > 0.6 and np.abs(model.correlations[1:5, 1:5]).max() < 0.15


def test_label_model_against_plain_loops():
    """One voter's parent aside, the posterior is what Bayes' rule gives, and the rates are what the posterior's weights count."""
    _, votes, _ = drawn_votes(300, 1)
    posterior, m = toxicity.label_model(votes, rounds=200)
    for row, got in zip(votes, posterior):
        odds = []
        for c in (0, 1):
            p = m.prior[c]
            for v, vote in enumerate(row):
                toxic = m.rates[c, v, row[m.parent[v]] if m.parent[v] >= 0 else toxicity.ABSTAINS]
                p *= 1 if vote == toxicity.ABSTAINS else toxic if vote == toxicity.TOXIC else 1 - toxic
            odds.append(p)
        assert math.isclose(got, odds[1] / sum(odds), rel_tol=1e-9)
    for c in (0, 1):
        weight = [p if c else 1 - p for p in posterior]
        for v in range(votes.shape[1]):
            mean = sum(w for w, r in zip(weight, votes) if r[v] == 1) + 0.5
            mean /= mean + sum(w for w, r in zip(weight, votes) if r[v] == 0) + 0.5
            for state in (0, 1, 2):
                mine = [(w, r[v]) for w, r in zip(weight, votes) if r[v] != 2 and (r[m.parent[v]] if m.parent[v] >= 0 else 2) == state]
                hit = sum(w for w, vote in mine if vote == 1)
                assert math.isclose(m.rates[c, v, state], (hit + mean) / (sum(w for w, _ in mine) + 1), rel_tol=1e-4)


def test_dependences_against_enumeration():
    _, votes, _ = drawn_votes(200, 2)
    weight = np.random.default_rng(3).random((2, 200))
    shared, _ = toxicity.dependences(votes, weight)
    for a in range(6):
        for b in range(6):
            want = 0.0
            for w in weight if a != b else ():
                cells = Counter()
                for p, r in zip(w, votes):
                    if r[a] != 2 and r[b] != 2:
                        cells[r[a], r[b]] += p
                n = sum(cells.values())
                for (x, z), p in cells.items():
                    left = sum(q for (i, _), q in cells.items() if i == x)
                    below = sum(q for (_, j), q in cells.items() if j == z)
                    want += p * math.log(p * n / (left * below))
            assert math.isclose(shared[a, b], want, rel_tol=1e-6, abs_tol=1e-6)


def test_tree_is_the_heaviest_forest():
    rng = np.random.default_rng(4)
    pairs = [(a, b) for a in range(5) for b in range(a)]
    for _ in range(50):
        weight = np.zeros((5, 5))
        for a, b in pairs:
            weight[a, b] = weight[b, a] = rng.random()
        best = 0.0
        for n in range(5):
            for edges in itertools.combinations([p for p in pairs if weight[p] > 0.4], n):
                label = list(range(5))
                for a, b in edges:
                    if label[a] == label[b]:
                        break
                    label = [label[b] if x == label[a] else x for x in label]
                else:
                    best = max(best, sum(weight[e] for e in edges))
        parent = toxicity.tree_of(weight, 0.4)
        assert math.isclose(sum(weight[v, p] for v, p in enumerate(parent) if p >= 0), best, abs_tol=1e-12)


def test_one_row_an_id_and_columns_that_clash(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} calm river stone " + "zorgle " * (i % 3 == 0), 0.5) for i in range(120)] + [(3, "zorgle", 0.5)] * 200, "doc_id long, text string, __score double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    rows = toxicity.labelled(docs, labels)
    assert rows.count() == rows.select("doc_id").distinct().count()
    assert toxicity.keep_clean(docs, labels).columns == docs.columns
