import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from cohortwise.llm.mixing import leaf_budgets, mix
from tests.llm.helpers import awkward_texts, documents, words


def filled(budget, children):
    """Water filling: (weight, capacity) by name to amounts."""
    out, open_ = {}, dict(children)
    while open_:
        total = sum(w for w, _ in open_.values())
        full = {n: c for n, (w, c) in open_.items() if total <= 0 or c <= budget * w / total + 1e-9}
        if not full:
            out |= {n: budget * w / total for n, (w, _) in open_.items()}
            break
        if total <= 0:
            return out | dict.fromkeys(open_, 0.0)
        for n, c in full.items():
            out[n] = c
            budget -= c
            del open_[n]
    return out


def test_budgets_against_water_filling(spark):
    rng = random.Random(7)
    for case in range(4):
        leaves = {(a, b): rng.randint(1, 2000) for a in "xyz"[: case + 1] for b in "klmno"}
        weights = {"a": {"x": 3, "y": 1}, "b": {"k": 5, "l": 0.5, "m": 0 if case == 3 else 1}}
        share, epochs = [0.3, 0.9, 1.7, 3.5][case], 3
        df = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "a string, b string, supply long")
        got = {(r.a, r.b): r.budget for r in leaf_budgets(df, ["a", "b"], weights, share, epochs).collect()}
        cap = {k: v * epochs * (weights["b"].get(k[1], 1) > 0) for k, v in leaves.items()}
        inner = defaultdict(float)
        for (a, _), c in cap.items():
            inner[a] += c
        top = filled(min(int(sum(leaves.values()) * share), sum(cap.values())),
                     {a: (weights["a"].get(a, 1), c) for a, c in inner.items()})
        want = {}
        for a, budget in top.items():
            kids = {b: (weights["b"].get(b, 1), cap[a, b]) for b in "klmno"}
            want |= {(a, b): x for b, x in filled(budget, {
                b: k for b, k in kids.items() if k[0] > 0}).items()}
        assert all(abs(got[k] - want.get(k, 0)) <= 1 for k in leaves), (case, got, want)


def levels():
    return {"lang": F.col("lang"), "source": F.col("source")}


def corpus(spark, n=400):
    rng = random.Random(3)
    return documents(spark, [
        (i, words(rng, rng.randint(1, 40)), rng.choice(["en", "de"]), rng.choice(["a", "b", None]))
        for i in range(n)])


def test_prefixes_of_seeded_epochs(spark):
    docs = corpus(spark)
    weights = {"lang": {"en": 4, "de": 1}, "source": {"a": 5}}
    got = mix(docs, levels(), weights, 1.2, epochs=3, seed=9).collect()
    tokens = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    leaf_of = {r.doc_id: (r.lang, r.source) for r in docs.collect()}
    supply, taken = Counter(), Counter()
    for i, n in tokens.items():
        supply[leaf_of[i]] += n
    times = Counter()
    for r in got:
        assert r.mix.tokens == tokens[r.doc_id] and (r.mix.lang, r.mix.source) == leaf_of[r.doc_id]
        taken[leaf_of[r.doc_id]] += r.mix.tokens
        times[r.doc_id, r.mix.epoch] += 1
    assert set(times.values()) == {1}
    leaves = spark.createDataFrame([(*k, v) for k, v in supply.items()],
                                   "lang string, source string, supply long")
    budget = {(r.lang, r.source): r.budget for r in
              leaf_budgets(leaves, ["lang", "source"], weights, 1.2, 3).collect()}
    for leaf in supply:
        assert budget[leaf] - 40 < taken[leaf] <= budget[leaf]
        whole = budget[leaf] // supply[leaf]
        for i in (i for i in tokens if leaf_of[i] == leaf):
            assert all(times[i, e] == 1 for e in range(whole))
    again = mix(docs, levels(), weights, 1.2, epochs=3, seed=9).collect()
    other = mix(docs, levels(), weights, 1.2, epochs=3, seed=10).collect()
    key = lambda rows: sorted((r.doc_id, r.mix.epoch) for r in rows)
    assert key(again) == key(got) != key(other)
    assert got[0].line == "x"


def test_awkward_rows(spark):
    rows = awkward_texts()
    docs = documents(spark, rows)
    got = mix(docs, levels(), {}, 1.0, epochs=1).collect()
    with_tokens = [i for i, t, *_ in rows if (t or "").split()]
    assert Counter(r.doc_id for r in got) <= Counter(with_tokens)
    all_of_them = mix(docs, levels(), {}, 10.0, epochs=2).collect()
    assert Counter(r.doc_id for r in all_of_them) == Counter(with_tokens * 2)
    assert mix(docs.limit(0), levels(), {}, 1.0).count() == 0
    assert mix(docs, levels(), {"lang": {"en": 0, "de": 0, "fr": 0}}, 1.0).where(
        "lang is not null").count() == 0
