"""The grammar's machines against a plain reading of their rules; learned lexicon; held-out accuracy; awkward rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from fixtures import DOCS, awkward
from pyspark.sql import functions as F

from panelwise.llm import toxicity as t

LABELS = "doc_id long, quality int, toxic int"
INSULTS = [f"zork{c}{v}x" for c in "bdfgk" for v in "aeiou"]


def annotated(kinds):
    """Flags of each symbol by looking back from it."""
    out = []
    for i, kind in enumerate(kinds):
        back = lambda opener, words: any(k == opener for k in kinds[max(0, i - words):i])
        flags = (t.AIMED if back(t.TARGET, t.REACH) else 0) | (t.DENIED if back(t.NEGATION, t.DENIES) else 0)
        out.append(kind * 8 + (flags | (t.REPORTED if t.REPORT in kinds[:i] else 0)))
    return out


def test_composed_machine_equals_the_rules():
    rng = random.Random(1)
    for _ in range(3000):
        kinds = [rng.choice([t.OTHER] * 4 + [t.INSULT, t.THREAT, t.TARGET, t.NEGATION, t.REPORT]) for _ in range(rng.randint(1, 25))]
        state, out = 0, []
        for k in kinds:
            out.append(int(t.GRAMMAR.output[state, k * 8]))
            state = t.GRAMMAR.after[state, k * 8]
        assert out == annotated(kinds)
    assert len(t.GRAMMAR.after) <= (t.REACH + 1) * (t.DENIES + 1) * 2


def score(text, words=("idiot",)):
    lexicon = t.Lexicon(dict.fromkeys(words, 4.0), {})
    return [round(s, 6) for _, _, s, _ in t.clause_scores(t.parts_of(text), lexicon)]


def test_clauses_not_single_words_decide():
    assert score("An idiot.") == [4.0]
    assert score("You are an idiot!") == [6.0]
    assert score("You are not an idiot.") == [0.6]
    assert score("He said she is an idiot.") == [1.8]
    assert score("He said so. She is an idiot.") == [6.0]
    assert score("They kill time") == [2.0] and score("We kill time") == [0.0] and score("I will never hurt you") == [0.0]
    assert score("I tell you: I will hurt them") == [0.0] and score("you, i will hurt") == [2.0]
    assert score("Idiot! nice day. IDIOT") == [4.0, 4.0] and score("a nice day") == []


def test_every_matched_clause_comes_once_and_whole():
    lexicon = t.Lexicon({"idiot": 4.0}, {})
    parts = t.parts_of("a idiot b idiot c. d e. idiot")
    assert [(a, b) for a, b, _, _ in t.clause_scores(parts, lexicon)] == [(0, 5), (9, 10)]


def test_stems_stand_in_for_unknown_words_and_memory_is_bounded():
    lexicon = t.Lexicon({"zorkbax": 5.0}, {"zorkba": 3.0})
    assert [lexicon[w] for w in ("zorkbax", "zorkbaq", "you", "x")] == [(t.INSULT, 5.0), (t.INSULT, 3.0), (t.TARGET, 0.0), (t.OTHER, 0.0)]
    for i in range(200_050):
        lexicon[f"w{i}"]
    assert len(lexicon) <= 200_001


def test_learned_weights_are_cautious():
    words, stems = t.learned([("sure", False, 50, 0), ("rare", False, 1, 0), ("common", False, 50, 500), ("stem", True, 40, 1)], 100, 1000)
    assert set(words) == {"sure"} and set(stems) == {"stem"} and words["sure"] > stems["stem"] > t.LEAST_WEIGHT


def test_logistic_equals_a_zero_gradient():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x @ [1.0, -2, 0.5] + rng.normal(size=400) > 0.3).astype(float)
    w, b = t.logistic(x, y)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (p - y) + w).max() < 1e-6 and abs((p - y).sum()) < 1e-4
    t.logistic(np.zeros((10, 3)), np.ones(10))


def corpus(rng, n):
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(600)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) + ("." if rng.random() < 0.1 else "") for _ in range(rng.randint(20, 90))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        elif i % 7 == 0:  # a denied insult is no toxic document
            words += [".", "it", "is", "not", rng.choice(INSULTS)]
        rows.append((i, " ".join(words), "en", "a", 1))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def judged(spark):
    rows, labels = corpus(random.Random(3), 900)
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    return {r.id: r for r in t.detect(docs, marks, lambda c: c % 5 + c % 3 > 0).collect()}


def test_held_out_accuracy(judged):
    held = [r for i, r in judged.items() if i % 15 == 0]
    clean = [r for i, r in judged.items() if i % 5]
    assert len(held) == 60 and sum(r.score >= 0.5 for r in held) >= 57
    assert sum(r.score >= 0.5 for r in clean) <= 7 and all(0 <= r.score <= 1 for r in judged.values())


def test_spans_hold_the_clauses(spark):
    model = t.Model({"idiot": 4.0}, {}, [1.0] * t.FEATURES, -2.0)
    text = "İ x. You are no idiot é! So what; idiot\nbye"
    row = t.scored(spark.createDataFrame([(1, text, "en", "a", 1)], DOCS), model).first()
    assert [text[c.start:c.end] for c in row.clauses] in (["You are no idiot é", "idiot"], [text, text])
    assert [(c.insults, c.aimed, c.denied, c.reported) for c in row.clauses] == [(1, 1, 1, 0), (1, 0, 0, 0)]


def test_awkward_rows(spark):
    rows, labels = corpus(random.Random(4), 60)
    docs = spark.createDataFrame([(*r, 1, 2) for r in awkward()] + [(r[0] + 100, *r[1:], 1, 2) for r in rows], DOCS + ", score int, toxic int")
    marks = spark.createDataFrame([(r[0] + 100, 1, r[2]) for r in labels] + [(None, 1, 1), (3, 0, 1), (4, 0, None), (7, 0, 7), (1, 1, 0), (1, 1, 0)], LABELS)
    got = t.detect(docs, marks).collect()
    assert sorted(str(r.id) for r in got) == sorted([str(r[0]) for r in awkward()] + [str(r[0] + 100) for r in rows])
    blank = {r.score for r in got if r.id in (3, 4, 5)}
    assert len(blank) == 1 and 0 <= blank.pop() < 0.5
    assert t.detect(docs.limit(0), marks).collect() == []
    none = spark.createDataFrame([], LABELS)
    assert len({r.score for r in t.detect(docs, none).collect()}) == 1


def test_only_teaching_labels_matter(spark):
    rows, labels = corpus(random.Random(5), 120)
    docs = spark.createDataFrame(rows, DOCS)
    teaches = lambda c: c % 4 != 0
    first = t.detect(docs, spark.createDataFrame(labels, LABELS), teaches)
    other = [(i, q, 1 - x if i % 4 == 0 else x) for i, q, x in labels]
    second = t.detect(docs.repartition(7), spark.createDataFrame(other, LABELS), teaches)
    assert sorted((r.id, r.score) for r in first.collect()) == sorted((r.id, r.score) for r in second.collect())
    assert first.where(F.size("clauses") > 0).count() > 10
