"""Language identification with a byte convolutional network.

The network embeds bytes, applies filters of several widths, takes each
filter's maximum over a window and a softmax over the languages seen in
training.  It is trained in numpy on windows of labelled text and applied to
whole texts cut into windows of a fixed length; a text's probabilities are the
mean over its windows, weighted by their bytes.

Defined cases: a null text or one without a letter is ``und`` with score 0; no
labelled text at all gives ``und`` everywhere; a tie goes to the language that
sorts first; repeated rows get equal results; columns of the input other than
the text are never read and are kept (result columns replace equal names).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.llm import common

UNKNOWN = "und"
WINDOW = 256            # bytes in a window
EMBED = 8
WIDTHS = (2, 3, 4)
PER_WIDTH = 8
GROUP = 64              # windows convolved at once: the intermediates stay in cache


@dataclass
class ByteConvNet:
    langs: list[str]
    embed: np.ndarray       # 256 x EMBED
    kernel: np.ndarray      # max width * EMBED x filters
    bias: np.ndarray        # filters
    out: np.ndarray         # filters x langs
    out_bias: np.ndarray    # langs

    @classmethod
    def start(cls, langs: list[str], seed: int = 7) -> ByteConvNet:
        rng = np.random.default_rng(seed)
        filters, top = len(WIDTHS) * PER_WIDTH, max(WIDTHS)
        f32 = np.float32
        return cls(langs, rng.normal(0, .5, (256, EMBED)).astype(f32),
                   (rng.normal(0, .3, (top * EMBED, filters)) * cls.mask()).astype(f32),
                   np.zeros(filters, f32), rng.normal(0, .3, (filters, len(langs))).astype(f32),
                   np.zeros(len(langs), f32))

    @staticmethod
    def mask() -> np.ndarray:
        """A filter of width w sees the first w bytes of the widest span only."""
        rows = np.repeat(np.arange(max(WIDTHS)), EMBED)[:, None]
        return (rows < np.repeat(WIDTHS, PER_WIDTH)[None, :]).astype(np.float32)

    def spans(self, windows: np.ndarray) -> np.ndarray:
        """n x positions x (widest * EMBED): the embedded bytes of every span."""
        top = max(WIDTHS)
        x = self.embed[windows]
        places = windows.shape[1] - top + 1
        return np.concatenate([x[:, o:o + places] for o in range(top)], axis=2)

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filter responses at every position, and their maximum after the rectifier."""
        at = self.spans(windows) @ self.kernel
        return at, np.maximum(at.max(axis=1) + self.bias, 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = []
        for i in range(0, len(windows), GROUP):
            _, top = self.pooled(windows[i:i + GROUP])
            parts.append(softmax(top @ self.out + self.out_bias))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.langs)), np.float32)

    def fit(self, windows: np.ndarray, target: np.ndarray, epochs: int, rate: float = 0.01,
            batch: int = 64, seed: int = 11) -> None:
        """Adam on the cross entropy; only the position of each maximum carries gradient."""
        rng, mask, top_width = np.random.default_rng(seed), self.mask(), max(WIDTHS)
        names = ("embed", "kernel", "bias", "out", "out_bias")
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), batch):
                rows = order[i:i + batch]
                w = windows[rows]
                at, top = self.pooled(w)
                p = softmax(top @ self.out + self.out_bias)
                p[np.arange(len(rows)), target[rows]] -= 1
                p /= len(rows)
                d_top = (p @ self.out.T) * (top > 0)
                place = at.argmax(axis=1)                                    # n x filters
                held = np.stack([w[np.arange(len(rows))[:, None], place + o]
                                 for o in range(top_width)], axis=2)         # n x filters x width
                seen = self.embed[held].reshape(*place.shape, -1)
                d_kernel = np.einsum("nfk,nf->kf", seen, d_top) * mask
                d_seen = d_top[:, :, None] * self.kernel.T[None]
                d_embed = np.zeros_like(self.embed)
                np.add.at(d_embed, held.ravel(), d_seen.reshape(-1, EMBED))
                step += 1
                for k, g in (("embed", d_embed), ("kernel", d_kernel), ("bias", d_top.sum(0)),
                             ("out", top.T @ p), ("out_bias", p.sum(0))):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    move = (first[k] / (1 - 0.9 ** step)
                            / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8))
                    setattr(self, k, (getattr(self, k) - rate * move).astype(np.float32))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut_windows(data: bytes, size: int = WINDOW) -> np.ndarray:
    """The whole text in windows of ``size`` bytes, the last one padded with zeros."""
    n = max(1, -(-len(data) // size))
    out = np.zeros(n * size, np.uint8)
    out[:len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, size)


def classify(model: ByteConvNet | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if model is None:
        return langs, scores
    known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    held, held_bytes = [], 0

    def flush() -> None:
        if not held:
            return
        p = model.probabilities(np.concatenate([w for _, w, _ in held]))
        at = 0
        for i, w, n in held:
            weight = np.full(len(w), WINDOW, np.float64)
            weight[-1] = n - WINDOW * (len(w) - 1)
            mean = weight @ p[at:at + len(w)] / n
            at += len(w)
            best = int(mean.argmax())
            langs[i], scores[i] = model.langs[best], min(1.0, float(mean[best]))
        held.clear()

    for i in known:
        data = texts[i].encode("utf-8", "replace")
        held.append((i, cut_windows(data), len(data)))
        held_bytes += len(data)
        if held_bytes > 4 << 20:
            flush()
            held_bytes = 0
    flush()
    return langs, scores


def training_windows(labelled: DataFrame, text: str, label: str, per_lang: int,
                     windows: int, max_langs: int) -> pd.DataFrame:
    """A bounded sample for training: ``per_lang`` distinct texts (all, if there are fewer)
    of each of at most ``max_langs`` languages, ``windows`` places spread over each whole text.

    The choice follows a hash of the text, so it is the same in every run; copies
    of a text count once, also where the rate of a language is found.
    """
    rows = (labelled.where(F.col(label).isNotNull() & (F.length(text) > 0))
            .select(F.col(label).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h")))
    seen = common.cut(rows.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("n")), "lang-texts")
    counts = (seen.groupBy("lang").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("texts"))
              .orderBy(F.desc("rows"), "lang").limit(max_langs).collect())
    if not counts:
        return pd.DataFrame({"lang": [], "part": []})

    def up_to(last: dict[str, int]) -> Column:
        each = F.create_map(*[F.lit(x) for pair in last.items() for x in pair])
        return F.col("h") <= F.element_at(each, F.col("lang")).cast("long")
    low = seen.where(up_to({r["lang"]: common.low_bound(r["texts"], per_lang) for r in counts}))
    low = low.select("lang", "h").toPandas().sort_values("h").groupby("lang")["h"]
    last = {lang: int(hs.iloc[:per_lang].iloc[-1]) for lang, hs in low}
    sample = rows.where(up_to(last)).dropDuplicates(["lang", "text"])
    room = F.greatest(F.lit(1), F.length("text") - WINDOW + 1)
    places = F.array(*[F.pmod(F.xxhash64(F.col("text"), F.lit(i)), room) + 1
                       for i in range(windows)])
    return (sample.select("lang", "h", F.explode(
                F.transform(F.array_distinct(places),
                            lambda p: F.substring("text", p.cast("int"), F.lit(WINDOW))))
                .alias("part"))
            .orderBy("h", "lang", "part").limit(2 * per_lang * windows * len(counts))
            .select("lang", "part").toPandas())


def train(labelled: DataFrame, text: str = "text", label: str = "lang", per_lang: int = 600,
          windows: int = 4, max_langs: int = 400, epochs: int = 6) -> ByteConvNet | None:
    """Fit on a bounded sample (parameters); None when nothing is labelled."""
    sample = training_windows(labelled, text, label, per_lang, windows, max_langs)
    if sample.empty:
        return None
    langs = sorted(sample["lang"].unique())
    # every window a second time cut to some shorter length, for short texts
    short = np.exp(np.random.default_rng(1).uniform(np.log(6), np.log(WINDOW), len(sample))).astype(int)
    parts = [*sample["part"], *(t[:n] for t, n in zip(sample["part"], short))]
    x = np.concatenate([cut_windows(t.encode()[:WINDOW]) for t in parts])
    y = np.tile(np.searchsorted(np.array(langs, object), sample["lang"].to_numpy(object)), 2)
    model = ByteConvNet.start(langs)
    model.fit(x, y, epochs)
    return model


def predict(model: ByteConvNet | None) -> object:
    """A text expression -> struct<lang_pred, score>."""
    @F.pandas_udf("lang_pred string, score double")
    def net(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            langs, scores = classify(model, texts.tolist())
            yield pd.DataFrame({"lang_pred": langs, "score": scores})
    return net


def identify(docs: DataFrame, model: ByteConvNet | None, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with its ``lang_pred`` and ``score``."""
    common.python_ready(docs.sparkSession)
    return common.put_struct(docs, predict(model)(F.col(text)), ["lang_pred", "score"])


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(common.doc_hash(doc_id) % folds == fold, F.lit(False))


def learnable(docs: DataFrame) -> DataFrame:
    """Rows whose labels may be learned: an id, and not in the held-out fold."""
    return docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
