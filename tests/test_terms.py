import random

import pytest
from pyspark.sql import functions as F

from actilens.operators import keywords, rules, terms


def plain(texts, entries):
    return {k: {(label, term) for label, term in entries if text is not None and term is not None and term in text} for k, text in texts}


@pytest.mark.parametrize("shard_bytes", [terms.SHARD_BYTES, 300])
def test_terms_as_contains(spark, shard_bytes):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé ß😀") for _ in range(rng.randint(0, n)))
    entries = [(rng.choice(["x", "y", None]), word(4)) for _ in range(300)] + [("x", ""), ("y", None)]
    texts = [(k, word(60)) for k in range(80)] + [(80, None), (81, ""), (82, "ab" * 5000), (83, "ab" * 5000)]
    df = spark.createDataFrame(texts, "k int, text string").repartition(5)
    found = terms.with_terms(df, "text", spark.createDataFrame(entries, "label string, term string"), "hits", shard_bytes)
    assert found.columns == ["k", "text", "hits"]
    got = {r.k: [(h.label, h.term) for h in r.hits] for r in found.collect()}
    assert {k: set(v) for k, v in got.items()} == plain(texts, entries)
    assert all(len(v) == len(set(v)) for v in got.values())


@pytest.mark.parametrize("shard_bytes", [terms.SHARD_BYTES, 300])
def test_no_terms_and_no_texts(spark, shard_bytes):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, text string")
    none = spark.createDataFrame([], "label string, term string")
    assert [r.hits for r in terms.with_terms(df, "text", none, "hits", shard_bytes).collect()] == [[], []]
    some = spark.range(200).select(F.lit("x").alias("label"), F.concat(F.lit("term"), "id").alias("term"))
    assert terms.with_terms(df.limit(0), "text", some, "hits", shard_bytes).count() == 0


def test_a_large_dictionary_in_one_pass(spark):
    rng = random.Random(5)
    vocabulary = [f"{rng.randrange(16**6):06x}" for _ in range(100_000)]
    clusters = spark.createDataFrame([(f"c{k % 7}", w.upper(), "manual") for k, w in enumerate(vocabulary)], "cluster string, keyword string, source string")
    texts = [(k // 2, " ".join(rng.choice(vocabulary) for _ in range(5)).upper()) for k in range(40)]
    df = spark.createDataFrame(texts, "k int, text string").repartition(3)
    matched = keywords.match_clusters(df, clusters, "text", ["k"])
    plan = matched._jdf.queryExecution().toString()
    assert vocabulary[0] not in plan and "Join" not in plan
    entries = {(f"c{k % 7}", w) for k, w in enumerate(vocabulary)}
    want = []
    for k, text in texts:
        hits = sorted((c, w) for c, w in entries if w in text.lower())
        want += [(k, c, tuple(w for d, w in hits if d == c)) for c in {c for c, _ in hits}]
    assert sorted((r.k, r.cluster, tuple(r.hits)) for r in matched.collect()) == sorted(want)


def test_contains_rules_as_terms(spark, make_logs):
    rng = random.Random(6)
    logs = make_logs([{"description": f"Login from {rng.randrange(400)} by x{rng.randrange(50)}"} for _ in range(60)])
    columns = "id string, name string, is_active boolean, trigger_field string, trigger_operator string, trigger_value string, action_type string, action_target string, min_confidence double, requires_approval boolean, rate_limit_count int, rate_limit_window_seconds int, scope string"
    rows = [
        (f"p{k}", "n", True, ("description", "activityType", "unknown")[k % 3], ("contains", "equals")[k % 5 == 0], rng.choice(["by X", "LOGIN", "", str(k), None]), "LOCK_USER", "u", 0.5, False, 1, 60, "all")
        for k in range(400)
    ]
    playbooks = spark.createDataFrame(rows, columns)
    by_literals = rules.match_rules(logs, playbooks, ["id"], max_literal=1000)
    by_terms = rules.match_rules(logs, playbooks, ["id"], max_literal=0)
    assert "NestedLoop" not in by_terms._jdf.queryExecution().toString()
    pairs = lambda df: sorted((r.id, r.playbook_id) for r in df.collect())
    assert pairs(by_terms) == pairs(by_literals) and pairs(by_terms)
