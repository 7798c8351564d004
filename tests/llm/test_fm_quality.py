"""Factorisation machine: the linear-time identity, held-out accuracy, odd rows."""

import random
import zlib

import numpy as np

from millrace.llm.fm_quality import N_FEATURES, WORDS, Machine, features, fit, score, train


def test_pair_sum_identity():
    unit = np.random.default_rng(1)
    m = Machine(0.3, unit.normal(size=N_FEATURES), unit.normal(size=(N_FEATURES, 4)))
    index, value = np.sort(unit.choice(WORDS, 9, replace=False)), unit.normal(size=9)
    z = 0.3 + (m.w[index] * value).sum()
    z += sum(m.v[index[i]] @ m.v[index[j]] * value[i] * value[j] for i in range(9) for j in range(i))
    assert np.isclose(m.scores(index, value, np.array([0]))[0], 1 / (1 + np.exp(-z)))


def corpus(unit):
    good, rows, labels = [f"word{k}" for k in range(300)], [], []
    for k in range(900):
        bad = unit.random() < 0.4
        words = [unit.choice(good) for _ in range(unit.randint(15, 80))]
        text = (" ".join(unit.choice(words[:3]).upper() + "!!" for _ in words) if unit.random() < 0.5 else "### ".join(words)) if bad else " ".join(words) + "."
        rows.append((k, text, len(text), "de", f"s{k % 3}", 9.0))
        labels.append((k, int(not bad), 0))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus(random.Random(3))
    rows += [(2000, None, None, None, None, None), (2001, "", 0, "en", "s", 1.0), (2002, "x " * 40000, 80000, "en", "s", 1.0), (None, "no id", 5, "en", "s", 1.0), (0, rows[0][1], rows[0][2], "fr", "t", 2.0)]
    labels += [(0, labels[0][1], 0), (1, None, 0), (None, 1, 0), (99999, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, lang string, source string, score double")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = score(docs, train(docs, table)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    truth = {i: q for i, q, _ in labels[:900]}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in got if r.doc_id is not None)
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert len({r.score for r in got if r.doc_id == 0}) == 1  # source and lang are no inputs


def test_rows_of_one_id_count_once(spark):
    rows, labels = corpus(random.Random(4))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    once = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, n_chars int")
    a, b = train(once, table), train(once.union(once).union(once), table)
    assert a.w0 == b.w0 and np.array_equal(a.w, b.w) and np.array_equal(a.v, b.v)


def test_one_class_and_no_rows(spark):
    index, value = features("a b", 3)
    assert np.isclose(fit([]).scores(index, value, np.array([0]))[0], 0.5)
    assert fit([(index, value, 1)] * 8).scores(index, value, np.array([0]))[0] > 0.8
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert score(empty, fit([])).collect() == []
    assert train(empty, spark.createDataFrame([], "doc_id long, quality int")).w0 == 0
