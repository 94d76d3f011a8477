"""Quality network, language codes and backoff scores: held-out accuracy and plain versions."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from actilens.llm import language, lm_scores, quality
from actilens.llm.common import text_bytes
from tests.llm.conftest import DOCS, prose

QUICK = quality.Settings(rows=300, epochs=5)


def noisy(rng, n):
    return " ".join(f"w{rng.randrange(400)}$%!" for _ in range(n)).upper()


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(500):
        good = k % 4 > 0
        text = (prose if good else noisy)(rng, rng.randrange(5, 80))
        rows.append((k, text, "en", "a", len(text)))
        labels.append((k, int(good), 0))
    docs = spark.createDataFrame(rows, DOCS)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((k, q) for k, q, _ in labels)


def test_quality_of_rows_never_learned_from(judged):
    docs, labels, truth = judged
    got = quality.scored_rows(docs, labels, QUICK).collect()
    assert len(got) == 500
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    unseen = [r for r in got if r.held_out]
    assert len(unseen) > 60 and np.mean([r.predicted == truth[r.doc_id] for r in unseen]) > 0.97


def test_held_out_labels_change_nothing(spark, judged):
    docs, labels, truth = judged
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality")
    one = {r.doc_id: r.score for r in quality.scored_rows(docs, labels, QUICK).collect()}
    two = {r.doc_id: r.score for r in quality.scored_rows(docs, turned, QUICK).collect()}
    assert one == two


def test_quality_of_messy_and_empty_tables(spark, judged, messy, messy_rows, no_docs):
    docs, labels, _ = judged
    net = quality.fit(docs, labels, QUICK)
    assert quality.score(messy, net).count() == len(messy_rows)
    kept = quality.accepted(messy, net)
    assert kept.schema == messy.schema
    good = sum(r.score >= quality.THRESHOLD for r in quality.score(messy, net).collect())
    assert kept.count() == good
    none = spark.createDataFrame([(1, None, 0), (None, 1, 0), (999_999, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.fit(messy, none) is None
    assert {r.score for r in quality.scored_rows(messy, none).collect()} == {0.5}
    assert quality.scored_rows(no_docs, labels, QUICK).collect() == []


def test_the_score_of_a_text_does_not_depend_on_its_neighbours():
    net = quality.ByteNet.new(quality.Settings())
    texts = ["", "short", "x" * 127, "y" * 128, "z" * 129, prose(random.Random(1), 3000)]
    together = net.score(*text_bytes(pa.array(texts)))
    alone = [net.score(*text_bytes(pa.array([t])))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-5)
    end = texts[-1] + "\x7f" * 8  # a change at the end of a long text is seen
    assert net.score(*text_bytes(pa.array([end])))[0] != alone[-1]


def test_gradient_matches_differences():
    net, rng = quality.ByteNet.new(quality.Settings(depth=3, filters=4)), random.Random(1)
    net.parts = {k: v.astype(np.float64) for k, v in net.parts.items()}
    net.parts["offset"] += [0.05, -0.03, 0.02, 0.04]  # away from the kink that padding stands on
    raw, offsets = text_bytes(pa.array([prose(rng, 60), noisy(rng, 40), "tail"]))
    label, weight = np.array([1.0, 0, 1]), np.array([1.0, 2, 1])

    def loss():
        p = net.score(raw, offsets)
        return -(weight * (label * np.log(p) + (1 - label) * np.log(1 - p))).mean()

    grads, pick = net.gradient(raw, offsets, label, weight), np.random.default_rng(0)
    for name, part in net.parts.items():
        for _ in range(6):
            at = tuple(pick.integers(0, n) for n in part.shape)
            if name == "vectors" and not at[0]:
                continue  # padding stays zero
            keep, step = part[at], 1e-6
            part[at] = keep + step
            up = loss()
            part[at] = keep - step
            down = loss()
            part[at] = keep
            assert abs((up - down) / (2 * step) - grads[name][at]) < 1e-5, name


SYLLABLES = {"xx": ["ba", "do", "ki"], "yy": ["zul", "rem", "ost"], "zz": ["ñe", "ça", "üt"], "ww": ["tion", "ing", "er"]}


def speech(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


def test_language_of_rows_never_learned_from(spark, no_docs):
    rng = random.Random(1)
    truth = {k: rng.choice(list(SYLLABLES)) for k in range(400)}
    rows = [(k, speech(rng, lang, rng.randrange(3, 60)), lang if zlib.crc32(str(k).encode()) % 4 != 2 else "lie", "a", 1) for k, lang in truth.items()]
    rows += [(900, None, "xx", "a", 0), (901, "12 -- !", "xx", "a", 1), (902, "", "yy", "a", 1), (903, speech(rng, "yy", 40_000), None, "a", 1), (None, "badoki", "xx", "a", 1), (None, "badoki", None, "a", 1)]
    got = language.predicted_rows(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[k].lang_pred == "und" and by_id[k].score == 0 for k in (900, 901, 902)) and by_id[903].lang_pred == "yy"
    unseen = [k for k in truth if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(by_id[k].held_out for k in unseen) and np.mean([by_id[k].lang_pred == truth[k] for k in unseen]) > 0.97
    assert language.predicted_rows(no_docs).collect() == []


def test_language_with_nothing_or_one_language_learned(spark, messy, messy_rows):
    nothing = language.predict(messy, language.fit(messy.where("lang = 'nowhere'"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and len(nothing) == len(messy_rows)
    one = language.predict(messy, language.fit(messy.where("lang = 'fr'"))).collect()
    assert {r.lang_pred for r in one} == {"und", "fr"}


@pytest.mark.parametrize("n", [2, 4, 5, 9, 40])
def test_codewords_are_apart(n):
    code = language.codewords(n)
    apart = [(code[a] != code[b]).sum() for a in range(n) for b in range(a)]
    assert min(apart) >= (1 if n == 2 else 2 if n < 4 else 4) and (np.abs(code.sum(axis=0)) < n).all()


def test_backoff_scores_match_the_plain_version(spark, messy, messy_rows, no_docs, tokenizer_path, monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    ids = [(d, tokenizer.encode(t or "", add_special_tokens=False).ids) for d, t, *_ in messy_rows]
    one, two = collections.Counter(), collections.Counter()
    for _, i in ids:
        one.update(i)
        two.update(zip(i, i[1:]))
    total = sum(one.values())
    order = lambda r: (str(r[0]), r[1], r[2])
    for hot, leave_out in ((1024, True), (10, True), (10, False)):
        want = []
        for d, i in ids:
            own = collections.Counter(zip(i, i[1:])) if leave_out else collections.Counter()
            s = math.log(one[i[0]] / total) if i else 0.0
            for a, b in zip(i, i[1:]):
                n = two[a, b] - own[a, b]
                s += math.log(n / one[a]) if n else math.log(lm_scores.BACKOFF * one[b] / total)
            want.append((d, len(i), s))
        monkeypatch.setattr(lm_scores, "HOT", hot)
        rows = lm_scores.scores(messy, path, leave_out=leave_out).collect()
        got = sorted(((r.doc_id, r.n_tokens, r.sum_log) for r in rows), key=order)
        for g, w in zip(got, sorted(want, key=order), strict=True):
            assert g[:2] == w[:2] and abs(g[2] - w[2]) < 1e-4
        assert all(r.score is None if not r.n_tokens else abs(r.score - r.sum_log / r.n_tokens) < 1e-5 for r in rows)
    assert lm_scores.scores(no_docs, path).collect() == []
