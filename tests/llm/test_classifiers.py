"""Quality, language and toxicity: held-out accuracy on the driver's rows, and awkward rows."""
import numpy as np
import pandas as pd
import pytest

from sigspark.llm import language, quality, toxicity
from sigspark.llm.common import load
from sigspark.llm.registry import QUERIES

AWKWARD = [(1, None), (2, ""), (3, "123 456"), (4, "word " * 40_000), (5, "ok"), (5, "ok"), (None, "fine words"), (6, "�\U0001f600")]


def docs(spark):
    return spark.createDataFrame([(i, t, None, "src", None, 1.0) for i, t in AWKWARD], "doc_id long, text string, lang string, source string, n_chars long, score double")


def held_out(spark, sf, name, label):
    labels = load(spark, sf, "labels").toPandas()
    return QUERIES[name](spark, sf).toPandas().merge(labels, on="doc_id").query("held_out").dropna(subset=[label])


@pytest.fixture(scope="module")
def larger():
    import os
    path = "/root/testdata/sf0.1"
    if not os.path.isdir(path):
        pytest.skip("driver tables are not here")
    return path


def test_a_word_right_after_an_exception_phrase_counts():
    model = toxicity.Model({" idiot ": 3.0, " scum": 2.0}, np.zeros(1), np.zeros(2))
    total = lambda text: round(float(np.expm1(model.features(text)[0])), 6)
    assert [total(t) for t in ("pond scum", "pond scum idiot", "pond scum pond scum idiot", "idiot pond scum", "pond scum scum")] == [0, 3, 3, 3, 2]


def test_quality_of_held_out_rows(spark, larger):
    m = held_out(spark, larger, "op3_quality", "quality")
    assert (m.predicted == m.quality).mean() > 0.97 and m.score.between(0, 1).all()


def test_toxicity_of_held_out_rows(spark, larger):
    m = held_out(spark, larger, "op10_toxicity", "toxic")
    assert (m.predicted == m.toxic).mean() > 0.93 and m.score.between(0, 1).all()
    assert m[m.toxic == 0].predicted.mean() < 0.01                                  # clean documents are left alone


def test_language_of_held_out_rows(spark, larger):
    truth = load(spark, larger, "documents").select("doc_id", "lang").toPandas()
    m = QUERIES["op6_language"](spark, larger).toPandas().merge(truth, on="doc_id").query("held_out")
    assert (m.lang == m.lang_pred).mean() > 0.97


def test_factorisation_identity():
    draw = np.random.default_rng(0)
    machine = quality.Machine(0.3, draw.normal(size=quality.SIZE), draw.normal(size=(quality.SIZE, 4)))
    starts, places, values = quality.vectorise(pd.Series(["a b c", None, "LOUD!! words\nwords"]), pd.Series([1.0, np.nan, 5.0]))
    got = machine._sums(starts, places, values)[0]
    for r in range(3):
        p, x = places[starts[r]:starts[r + 1]], values[starts[r]:starts[r + 1]]
        pairs = sum(machine.factors[p[i]] @ machine.factors[p[j]] * x[i] * x[j] for i in range(len(p)) for j in range(i))
        assert np.isclose(got[r], 0.3 + machine.linear[p] @ x + pairs)


def test_quality_without_labels_and_on_awkward_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    d = docs(spark)
    got = quality.scored(d, quality.fit(d, none), "q").collect()
    assert len(got) == len(AWKWARD) and {r.q for r in got} == {0.5} and all(r.score == 1.0 for r in got)
    assert quality.scored(d.limit(0), quality.fit(d, none), "q").count() == 0


def test_toxicity_without_labels_and_on_awkward_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    d = docs(spark)
    assert {r.q for r in toxicity.scored(d, toxicity.fit(d, none), "q").collect()} == {0.0}
    some = spark.createDataFrame([(i, i % 2) for i in range(10, 60)] + [(10, None), (None, 1)], "doc_id long, toxic int")
    train = spark.createDataFrame([(i, "you silly scoundrel there" if i % 2 else "you kind friend there") for i in range(10, 60)], "doc_id long, text string")
    model = toxicity.fit(train, some)
    got = {r.text: r.q for r in toxicity.scored(d.unionByName(train.limit(0), allowMissingColumns=True), model, "q").collect()}
    assert got[None] == got[""] == got["123 456"] < 0.5
    assert model.scores(pd.Series(["A Sc0undrel!", "ѕсoundrel", "ｓｃｏｕｎｄｒｅｌ", "a scoundrels' den"])).min() > 0.5
    assert model.scores(pd.Series(["the ascoundrel", "s c o u n d r e l"])).max() < 0.5
    model.exceptions, model.machine = ("scoundrel days",), None
    assert model.scores(pd.Series(["Scoundrel days are here"]))[0] < 0.5 < model.scores(pd.Series(["Scoundrel days of a scoundrel"]))[0]


@pytest.mark.parametrize("text, folded", [(None, " "), ("", " "), ("1D10T!", " idiot "), ("a$$$ b", " a b "), ("Èté", " ete "), ("l0$er", " loser "), ("12 34", " "), ("mail7", " mail ")])
def test_fold(text, folded):
    assert toxicity.fold(text) == folded


def test_language_on_awkward_rows(spark):
    d = docs(spark)
    content = {"x": b"some known words of this tongue " * 20, "y": b"andere woorden van een taal " * 20}
    got = {r.text: r.f for r in language.identified(d, content, "f").collect()}
    assert got[None].lang == got[""].lang == got["123 456"].lang == got["�\U0001f600"].lang == "und"
    assert got["ok"].lang in content and 0 <= got["ok"].score <= 1 and got["ok"].rejected
    assert language.identified(d, {}, "f").select("f.lang").distinct().collect()[0][0] == "und"
    assert language.dictionaries(d) == {}
