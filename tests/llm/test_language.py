"""The chain against brute force over all labellings, and the language query against held-out rows and planted switches."""

import itertools
import random

import numpy as np
import pytest

from ledgerloom.llm import crf_language as crf
from ledgerloom.llm.common import read

WORDS = {
    "aa": ["bamo", "bami", "tabam", "obam", "bamba", "abami"],
    "bb": ["zirk", "zirken", "verzirk", "zork", "azirk", "zirkt"],
    "cc": ["éluon", "luona", "éluà", "tuoné", "luoné", "uonal"],
}
SCHEMA = "doc_id long, text string, lang string, source string, n_words long, score double, spans string, held_out string"


def rows(spark, texts, langs, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, g, "s", 1, 2.0, "x", "y") for i, t, g in zip(ids, texts, langs)], SCHEMA)


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.mark.parametrize("block", [2, 64])
def test_chain_is_exact(block, monkeypatch):
    monkeypatch.setattr(crf, "BLOCK", block)
    monkeypatch.setattr(crf, "GROUP", 3)
    rng = np.random.default_rng(0)
    sizes, n = np.array([1, 5, 2, 7, 3, 4]), 3
    scores, first, steps = rng.normal(size=(sizes.sum(), n)), rng.normal(size=n), rng.normal(size=(n, n)) * 2
    got = np.zeros_like(scores)
    for where, p in crf.Chains(sizes, first, steps).posteriors(lambda i: np.exp(scores[i])):
        got[where] = p
    at = 0
    for size in sizes:
        e, want = scores[at : at + size], np.zeros((size, n))
        for labels in itertools.product(range(n), repeat=int(size)):
            p = np.exp(first[labels[0]] + sum(steps[a, b] for a, b in itertools.pairwise(labels)) + sum(e[t, x] for t, x in enumerate(labels)))
            want[range(size), labels] += p
        assert np.allclose(got[at : at + size], want / want.sum(axis=1, keepdims=True))
        at += size


def test_expected_steps():
    rng = np.random.default_rng(1)
    sizes, n = np.array([4, 1, 3]), 2
    scores, first, steps = rng.normal(size=(8, n)), rng.normal(size=n), rng.normal(size=(n, n))
    pairs = np.zeros((n, n))
    list(crf.Chains(sizes, first, steps).posteriors(lambda i: np.exp(scores[i]), pairs))
    want, at = np.zeros((n, n)), 0
    for size in sizes:
        e = scores[at : at + size]
        ways = {labels: np.exp(first[labels[0]] + sum(steps[a, b] for a, b in itertools.pairwise(labels)) + sum(e[t, x] for t, x in enumerate(labels))) for labels in itertools.product(range(n), repeat=int(size))}
        for labels, p in ways.items():
            for a, b in itertools.pairwise(labels):
                want[a, b] += p / sum(ways.values())
        at += size
    assert np.allclose(pairs, want)


def test_grams_stay_inside_words():
    letters = crf.Letters("abcdé")
    for words in (["abc", "d", "abcdé", "aa"], ["xyz"], ["é"]):
        grams, affixes, starts = letters.codes(words)
        apart = [letters.codes([w]) for w in words]
        assert np.array_equal(grams, np.concatenate([g for g, _, _ in apart], axis=1))
        assert np.array_equal(affixes, np.concatenate([a for _, a, _ in apart], axis=1))
        assert starts.tolist() == np.cumsum([0] + [len(w) + 2 for w in words[:-1]]).tolist()
    assert letters.codes(["abc"])[1].tolist() != letters.codes(["bca"])[1].tolist()


def test_cases(spark):
    rng = random.Random(2)
    langs = [rng.choice("abc") * 2 for _ in range(90)]
    texts = [text(rng, g, rng.randrange(3, 40)) for g in langs]
    odd = [None, "", " 12 ³ -- !", "x" * 1000, "日本語", text(rng, "bb", 90_000), "1 " + texts[0].upper() + " 2", texts[3], texts[3]]
    ids = [*range(90), *range(200, 207), 300, 300]
    got = crf.languages(spark, rows(spark, texts + odd + ["bamo"], langs + ["aa"] * 7 + ["cc", None] + ["aa"], ids + [None])).collect()
    assert len(got) == len(ids) + 1
    of = {}
    for r in got:
        of.setdefault(r.doc_id, []).append(r)
        assert 0 <= r.score <= 1
    assert all(of[i][0].lang_pred == langs[i] for i in range(90))
    assert [of[200 + i][0].lang_pred for i in range(3)] == ["und"] * 3 and of[200][0].score == 0
    assert of[203][0].lang_pred in WORDS and sum(s.words for s in of[203][0].spans) == 16
    assert of[205][0].lang_pred == "bb" and [(s.lang, s.first, s.words) for s in of[205][0].spans] == [("bb", 0, 90_000)]
    assert of[206][0].lang_pred == langs[0]
    assert len(of[300]) == 2 and of[300][0].lang_pred == of[300][1].lang_pred == langs[3]
    assert of[None][0].held_out and of[None][0].lang_pred == "aa"
    assert crf.languages(spark, rows(spark, ["x"], ["aa"]).where("doc_id < 0")).count() == 0
    assert [r.lang_pred for r in crf.languages(spark, rows(spark, ["bamo", None], [None, "aa"])).collect()] == ["und", "und"]  # nothing to learn from


def test_switched_text_has_spans(spark):
    rng = random.Random(3)
    langs = [rng.choice("abc") * 2 for _ in range(120)]
    model = crf.train(rows(spark, [text(rng, g, 30) for g in langs], langs))
    parts = [("aa", 20), ("cc", 7), ("bb", 15), ("aa", 9)]
    got = crf.labelled(rows(spark, [" ".join(text(rng, g, n) for g, n in parts)], [None]), model).first()
    assert [(s.lang, s.words) for s in got.spans] == parts
    want = {"aa": 29 / 51, "bb": 15 / 51, "cc": 7 / 51}
    assert all(abs(share - want[name]) < 0.03 for share, name in zip(got.shares, model.names))


def test_held_out_rows(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r for r in crf.op11_crf_language(spark, "/root/testdata/sf0.01").collect()}
    rest = [r for r in docs.select("doc_id", "lang").collect() if got[r.doc_id].held_out]
    assert len(rest) > 200 and sum(got[r.doc_id].lang_pred == r.lang for r in rest) >= 0.98 * len(rest)
