"""The learned operators and all kinds of personal data against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockroom.llm import common, entries, lang_id, pii, pu_quality
from tests.conftest import SF_SMALL
from tests.llm import brute, plain_models
from tests.llm.test_llm import awkward

NAMES = ("embed", "kernel", "bias", "out", "out_bias")
SHAPE = (lang_id.WIDTHS, lang_id.PER_WIDTH)


def lists(model, names):
    return {k: getattr(model, k).astype(np.float64).tolist() for k in names}


def small_net(seed=2):
    net = lang_id.ByteConvNet.start(["a", "b", "c"], seed)
    rng = np.random.default_rng(seed)
    return net, rng.integers(97, 110, (4, 9)).astype(np.uint8), np.array([0, 2, 1, 2])


def test_probabilities_of_windows():
    net, windows, _ = small_net()
    got = net.probabilities(windows)
    for w, p in zip(windows, got):
        assert np.allclose(plain_models.conv_forward(lists(net, NAMES), w.tolist(), *SHAPE)[0], p, atol=1e-5)


def test_language_training_follows_the_gradient():
    """Adam's first steps with finite differences of the cross entropy as gradient."""
    net, windows, target = small_net()
    plain = lists(net, NAMES)
    net.fit(windows, target, epochs=2, rate=0.01, batch=4)
    mask = lang_id.ByteConvNet.mask()
    rnd = random.Random(5)
    spots = [(k, (r, c)) for k in ("embed", "kernel", "out") for r in range(len(plain[k])) for c in range(len(plain[k][0]))
             if (k != "kernel" or mask[r][c]) and (k != "embed" or 97 <= r < 110)]
    spots = rnd.sample(spots, 90) + [("bias", (f,)) for f in range(len(plain["bias"]))] + [("out_bias", (0,)), ("out_bias", (2,))]

    def nudged(by, spot):
        k, at = spot
        row = plain[k][at[0]] if len(at) == 2 else plain[k]
        row[at[-1]] += by
        value = plain_models.conv_loss(plain, windows.tolist(), target.tolist(), *SHAPE)
        row[at[-1]] -= by
        return value
    start, _, _ = small_net()
    start.fit(windows, target, epochs=1, rate=0.01, batch=4)       # one step: each goes against its gradient's sign
    for spot in spots:
        k, at = spot
        slope = (nudged(1e-4, spot) - nudged(-1e-4, spot)) / 2e-4
        moved = float(getattr(start, k)[at]) - (plain[k][at[0]][at[1]] if len(at) == 2 else plain[k][at[0]])
        if abs(slope) > 1e-4:
            assert moved * slope < 0 and abs(abs(moved) - 0.01) < 1e-4, (spot, slope, moved)
        elif abs(slope) < 1e-9:
            assert abs(moved) < 1e-6, (spot, slope, moved)
    assert not net.kernel[~mask.astype(bool)].any()         # a filter sees its own width only
    before, after = (plain_models.conv_loss(lists(n, NAMES), windows.tolist(), target.tolist(), *SHAPE) for n in (small_net()[0], net))
    assert after < before


def test_languages_of_documents(spark):
    """The registered query's model and texts, window by window."""
    docs = common.read(spark, SF_SMALL, "documents")
    model = lang_id.train(lang_id.learnable(docs))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    short = [r for r in rows if len(r[1] or "") <= 700][:12]
    odd = [(10_000 + i, t) for i, (_, t, *_) in enumerate(awkward()) if len(t or "") < 700]
    got = {r.doc_id: r for r in lang_id.identify(spark.createDataFrame(short + odd, "doc_id long, text string"), model).collect()}
    ours = {r.doc_id: r for r in entries.op1_language_id(spark, SF_SMALL).collect()}
    net = lists(model, NAMES)
    for i, t in short + odd:
        lang, score = plain_models.conv_predict(net, model.langs, t, *SHAPE, lang_id.WINDOW)
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-4
        if i in ours:
            assert ours[i].lang_pred == lang and abs(ours[i].score - score) < 1e-4
            assert ours[i].held_out == (brute.fold(i, 5) == 0)


@pytest.mark.parametrize("text", [t for _, t, *_ in awkward()])
def test_features(text):
    assert np.allclose(pu_quality.features(text), plain_models.text_features(text))


@pytest.mark.parametrize("prior,negative", [(0.3, False), (0.95, True)])
def test_risk_is_followed_down_or_up(prior, negative):
    """Training steps with finite differences of the risk: of the whole, or, while the
    negatives' risk is below zero, against that risk itself."""
    rng = np.random.default_rng(8)
    shift = -2.5 if negative else 0.5
    pos, unl = rng.normal(shift, 1, (40, 3)), rng.normal(0, 1, (60, 3))
    steps, batch, rate, decay, seed = 4, 12, 6e-3, 1e-4, 3
    net = pu_quality.fit(pos, unl, prior, steps, batch, rate, decay, seed)
    draw = np.random.default_rng(seed)
    w = {"w1": draw.normal(0, .3, (3, pu_quality.HIDDEN)), "b1": np.zeros(pu_quality.HIDDEN),
         "w2": draw.normal(0, .3, pu_quality.HIDDEN), "b2": np.zeros(1)}
    mean, scale = unl.mean(0), unl.std(0) + 1e-6
    p_all, u_all = (np.clip((v - mean) / scale, -3, 3) for v in (pos, unl))
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    below = []
    for step in range(1, steps + 1):
        p, u = p_all[draw.integers(0, len(pos), batch)].tolist(), u_all[draw.integers(0, len(unl), batch)].tolist()
        below.append(plain_models.risks({k: x.tolist() for k, x in w.items()}, p, u, prior)[1] < 0)

        def aim():
            good, bad = plain_models.risks({k: x.tolist() for k, x in w.items()}, p, u, prior)
            return -bad if below[-1] else good + bad
        grads = {k: np.zeros_like(x) for k, x in w.items()}
        for k, x in w.items():
            for at in np.ndindex(x.shape):
                kept = x[at]
                x[at] = kept + 1e-5
                up = aim()
                x[at] = kept - 1e-5
                grads[k][at] = (up - aim()) / 2e-5 + (decay * kept if k in ("w1", "w2") else 0)
                x[at] = kept
        for k in w:
            m[k] = 0.9 * m[k] + 0.1 * grads[k]
            v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
            w[k] = w[k] - rate * m[k] / (1 - 0.9 ** step) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    assert any(below) == negative
    for k in w:
        assert np.allclose(getattr(net, k), w[k], atol=2e-5), k
    raw = rng.normal(0, 4, (5, 3))
    x = np.clip((raw - mean) / scale, -3, 3).tolist()
    want = [1 / (1 + np.exp(-plain_models.margin({k: y.tolist() for k, y in w.items()}, r))) for r in x]
    assert np.allclose(net.scores(raw), want, atol=1e-4)


def test_quality_scores_of_documents(spark):
    docs, labels = common.read(spark, SF_SMALL, "documents"), common.read(spark, SF_SMALL, "labels")
    net = pu_quality.train(pu_quality.learnable(docs), pu_quality.learnable(labels))
    w = lists(net, ("w1", "b1", "w2", "b2"))
    got = {r.doc_id: r for r in entries.op6_pu_quality(spark, SF_SMALL).collect()}
    for r in docs.collect():
        x = np.clip((np.array(plain_models.text_features(r.text)) - net.mean) / net.scale, -3, 3).tolist()
        want = 1 / (1 + np.exp(-plain_models.margin(w, x)))
        assert abs(got[r.doc_id].score - want) < 1e-6 and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.7)
        assert got[r.doc_id].held_out == (brute.fold(r.doc_id, 4) == 2)


PARTS = ["GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00",
         "GB82 WEST 1234 5698 7654 33", "XX82 WEST 1234 5698 7654 32", "FR1420041010050500013M02606", "AB12", "GB8", "CAPS", "9",
         "378282246310005", "3782 822463 10005", "371449635398431", "4222222222222", "378282246310006", "30569309025904",
         "4111111111111111", "123-45-6789", "123-45-67890", "1123-45-6789", "-123-45-6789", "987-65-4321", "12 34-5", "ssn", "SOCIAL",
         "iban", "card", "amex", "Visa", "example", "sample", "identity", "é", "\U0001f642", ",", ".", "\n", "x" * 30, "pay to", "-", "7"]


def test_every_kind_of_span(spark):
    rnd = random.Random(12)
    texts = ["".join(rnd.choice(PARTS) + rnd.choice(["", " ", " ", ", ", "  "]) for _ in range(rnd.randint(1, 14)))
             for _ in range(600)] + [t for _, t, *_ in awkward()]
    kinds = {k.name: k for k in pii.KINDS}
    got = pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    seen = set()
    for r in got:
        t = r.text or ""
        want = (plain_models.iban_spans(t, pii.IBAN_LENGTHS) + plain_models.short_card_spans(t, kinds["card_short"])
                + plain_models.ssn_spans(t, kinds["ssn"]))
        spans = [(s["kind"], s["start"], s["end"]) for s in r["pii"]]
        assert [s for s in spans if s[0] in pii.BASE_KINDS] == brute.base_spans(r.text)
        assert [s for s in spans if s[0] not in pii.BASE_KINDS] == want, t
        seen |= {s[0] for s in want}
    assert seen == {"iban", "card_short", "ssn"}
    small = spark.createDataFrame([(r.doc_id, r.text) for r in common.read(spark, SF_SMALL, "documents").collect()],
                                  "doc_id long, text string")
    found = entries.op4_pii(spark, SF_SMALL).collect()
    spans = {r.doc_id: [(s["kind"], s["start"], s["end"]) for s in r["pii"]] for r in pii.detect(small).collect()}
    for r in found:
        assert r.spans == ",".join(":".join(map(str, s)) for s in spans[r.doc_id])
    assert small.where(F.col("text").isNull()).count() == 0
