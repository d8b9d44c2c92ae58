import numpy as np
import pytest

from slotwise.llm import languages as L


def test_held_out_accuracy(docs):
    got = L.report(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out & got.lang.notna() & (got.lang_pred != "und")]
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


@pytest.fixture(scope="module")
def model(docs):
    return L.train(L.trained_on(docs))


def test_a_mixed_text_gets_both_languages_in_proportion(docs, model):
    text = {r.lang: r.text for r in docs.where("n_chars between 2500 and 6000").collect()}
    both = text["en"][:2000] + " " + text["de"][:1000]
    shares = model.proportions(both)
    assert list(shares)[:2] == ["en", "de"] and shares["en"] == pytest.approx(0.66, abs=0.12)
    assert list(model.proportions(text["fr"])) == ["fr"]


def test_mixture_steps_reach_the_maximum():
    rng = np.random.default_rng(1)
    like, weight = rng.random((50, 2)) + 0.01, rng.integers(1, 9, 50).astype(float)
    value, shares = L.mixture(like, weight, weight.sum(), np.array([0.5, 0.5]))
    best = max(weight @ np.log(like @ np.array([p, 1 - p])) for p in np.linspace(0, 1, 2001))
    assert value == pytest.approx(best, abs=0.05)


def test_awkward_rows(awkward, no_docs):
    got = {(r.doc_id, r.lang_pred, r.score) for r in L.report(awkward).collect()}
    assert {d for d, lang, s in got if lang == "und" and s == 0.0} >= {2, 3, 4, 8}
    kept = L.keep_known(awkward)
    assert kept.columns == awkward.columns and kept.where("text is null or trim(text) = '' or doc_id = 8").count() == 0
    assert L.report(no_docs).count() == 0 and L.keep_known(no_docs).count() == 0


def test_without_labels_everything_is_undetermined(awkward):
    from pyspark.sql import functions as F

    got = L.report(awkward.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in got.collect()} == {"und"}


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = "the cat and the dog " * 3000
    whole = np.bincount(L.grams(text), minlength=L.BUCKETS)
    monkeypatch.setattr(L, "PIECE", 20 * 50)
    pieces = np.bincount(L.grams(text), minlength=L.BUCKETS)
    assert abs(whole - pieces).sum() < 0.01 * whole.sum()
