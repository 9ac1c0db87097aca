"""Toxicity: significant passages by maximum-scoring segment search.

A token (a run of letters, A-Z lower-cased) scores its log-odds between toxic and
other labelled texts under a Dirichlet prior in proportion to the token's share of
both. Tokens that are too rare for a score of their own score what their first seven
bytes do. A linear-time scan finds every maximal segment of a text; a segment's
score counts by extreme-value statistics: lambda solves E[exp(lambda s)] = 1 over the
tokens of other texts, and a text of n tokens has by chance K n exp(-lambda S)
segments that score S. The best segment's normalised score, and the sum over all
significant ones, make the text's probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_LETTERS, Words, arrow_batches, chunks, documents, labelled, logistic, mix, probability, range_hash, text_bytes

#: Labelled texts that fit the model, of both labels evenly; and tokens that get a score.
FIT_ROWS, LEXICON = 20_000, 50_000
#: Weight of the prior in tokens (beside half a token each); z-score that a token's log-odds need; what every other token costs.
PRIOR, LEAST_Z, COST, MOST_SCORE = 500.0, 3.3, 0.1, 6.0
STEM = 7
_STEM_SALT = np.uint64(0x5851F42D4C957F2D)


def tokens(column: pa.Array) -> tuple[Words, np.ndarray]:
    """The tokens of a batch of texts, and a hash of each one's first bytes (0: too short for a stem)."""
    words = Words(*text_bytes(column), lower=True, ends=NOT_LETTERS)
    long = words.stop - words.start > STEM
    stems = np.zeros(len(words.hash), np.uint64)
    stems[long] = mix(range_hash(words.running, words.start[long], words.start[long] + STEM) ^ _STEM_SALT)
    return words, stems


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        words, stems = tokens(batch.column("text"))
        label = np.repeat(batch.column("label").to_numpy(), np.diff(words.first))
        text = np.repeat(np.arange(batch.num_rows, dtype=np.uint64), np.diff(words.first))
        for kind, keys in ((0, words.hash), (1, stems)):
            _, once = np.unique(mix(keys + mix(text)), return_index=True)  # a token counts once for a text
            for y in (0, 1):
                own = keys[once][(label[once] == y) & (keys[once] != 0)]
                own, n = np.unique(own, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.where(y == 1, n, 0)), pa.array(np.where(y == 0, n, 0)), pa.array(np.full(len(own), kind, np.int32))], ["token", "toxic", "other", "kind"])


def log_odds(counts: DataFrame) -> DataFrame:
    """(token, kind, delta, z) by log-odds with an informative Dirichlet prior (kind 0: whole tokens, 1: stems)."""
    counts = counts.groupBy("token", "kind").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    total = counts.where("kind = 0").agg(F.sum("toxic"), F.sum("other")).first()
    n1, n0 = float(total[0] or 0), float(total[1] or 0)
    prior = F.lit(0.5) + F.lit(PRIOR) * (F.col("toxic") + F.col("other")) / F.lit(max(1.0, n1 + n0))
    a, b = F.col("toxic") + prior, F.col("other") + prior
    delta = F.log(a / (F.lit(n1 + PRIOR) - a)) - F.log(b / (F.lit(n0 + PRIOR) - b))
    return counts.where("toxic + other > 1").select("token", "kind", delta.alias("delta"), (delta / F.sqrt(1 / a + 1 / b)).alias("z"))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, stop) of a sequence, in linear time (Ruzzo and Tompa)."""
    hits = np.flatnonzero(scores > 0)
    if not len(hits):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    # neighbouring positive scores always go together
    new = np.flatnonzero(np.concatenate([[True], hits[1:] != hits[:-1] + 1]))
    begins, ends = hits[new], np.append(hits[new[1:] - 1], hits[-1]) + 1
    out: list[list] = []  # start, stop, sum before, sum after, place of the nearest earlier one with a smaller sum before
    for s, e, low, high in zip(begins.tolist(), ends.tolist(), total[begins].tolist(), total[ends].tolist()):
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= low:
                j = out[j][4]
            if j < 0 or out[j][3] >= high:
                out.append([s, e, low, high, j])
                break
            s, low = out[j][0], out[j][2]
            del out[j:]
    return [(s, e, high - low) for s, e, low, high, _ in out]


def karlin_lambda(values: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of E[exp(lambda s)] = 1; 1 where the scores' mean isn't negative or none is positive."""
    if not len(values) or (values * shares).sum() >= 0 or values.max() <= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while (shares * np.exp(high * values)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if (shares * np.exp(middle * values)).sum() < 1 else (low, middle)
    return low


def token_scores(words: Words, stems: np.ndarray, model: dict) -> np.ndarray:
    def look_up(keys, known, scores):
        at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
        hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
        return hit, scores[at] if len(known) else np.zeros(len(keys))

    own, s = look_up(words.hash, model["words"], model["word_scores"])
    out = np.where(own, s, 0.0)
    stem, s = look_up(stems, model["stems"], model["stem_scores"])
    return np.where(~own & stem, s, out) - COST


def evidence(column: pa.Array, model: dict, spans: bool = False):
    """For each text: best normalised segment score, sum over significant segments, their number, (with spans) their byte ranges."""
    words, stems = tokens(column)
    scores = token_scores(words, stems, model)
    n = len(words.first) - 1
    out, found = np.zeros((n, 3)), [[] for _ in range(n)]
    out[:, 0] = -5.0
    lam, k = model["lambda"], model["k"]
    positive = np.concatenate([[0], np.cumsum(scores > 0)])
    some = np.flatnonzero(positive[words.first[1:]] > positive[words.first[:-1]])
    for i in some:
        a, b = words.first[i], words.first[i + 1]
        own = [(s, e, lam * x - np.log(k * (b - a))) for s, e, x in segments(scores[a:b])]
        out[i, 0] = max(-5.0, max(x for *_, x in own))
        significant = [(s, e, x) for s, e, x in own if x > 0]
        out[i, 1], out[i, 2] = sum(x for *_, x in significant), len(significant)
        if spans:
            found[i] = [(int(words.start[a + s] - words.at[i]), int(words.stop[a + e - 1] - words.at[i]), float(x)) for s, e, x in significant]
    return out, found


def features(found: np.ndarray) -> np.ndarray:
    best, total = np.clip(found[:, 0], -5, 40), np.clip(found[:, 1], 0, 200)
    return np.column_stack([best, np.maximum(best, 0), np.log1p(total), np.log1p(found[:, 2])])


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The model: scores of tokens and stems, extreme-value parameters and the calibration, from FIT_ROWS labelled rows at most."""
    arrow_batches(docs.sparkSession)
    rows, share = labelled(docs, labels, "toxic", FIT_ROWS)
    rows = rows.persist()
    kinds = {0: ("words", "word_scores"), 1: ("stems", "stem_scores")}
    model: dict = {"lambda": 1.0, "k": 1.0}
    scored = log_odds(rows.mapInArrow(_count, "token long, toxic long, other long, kind int")).where(f"abs(z) >= {LEAST_Z}")
    best = scored.orderBy(F.desc(F.abs("z")), "token").limit(LEXICON).toPandas()
    for kind, (names, values) in kinds.items():
        own = best[best.kind == kind]
        keys = own.token.to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        model[names], model[values] = keys[order], np.clip(own.delta.to_numpy(np.float64), -MOST_SCORE, MOST_SCORE)[order]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # LEXICON numbers

    def histogram(batches):
        for batch in chunks(batches):
            words, stems = tokens(batch.column("text"))
            s = np.round(token_scores(words, stems, shared.value)[np.repeat(batch.column("label").to_numpy() == 0, np.diff(words.first))], 1)
            values, n = np.unique(s, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], ["s", "n"])

    counted = rows.mapInArrow(histogram, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).toPandas()
    if len(counted):
        model["lambda"] = karlin_lambda(counted.s.to_numpy(), counted.n.to_numpy() / counted.n.sum())
    shared = docs.sparkSession.sparkContext.broadcast(dict(model))

    def measure(batches):
        for batch in chunks(batches):
            found, _ = evidence(batch.column("text"), shared.value)
            sizes = np.diff(tokens(batch.column("text"))[0].first)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(sizes), batch.column("label")], ["best", "n", "label"])

    # K from the median of other texts' best segments: P(lambda S - ln(K n) <= 0) = exp(-1)
    other = rows.mapInArrow(measure, "best double, n long, label int").where("label = 0 and n > 0 and best > -5").toPandas()
    if len(other) >= 50:
        model["k"] = float(np.exp(np.quantile(other.best, np.exp(-1.0))))
    shared = docs.sparkSession.sparkContext.broadcast(dict(model))

    def final(batches):
        for batch in chunks(batches):
            x = features(evidence(batch.column("text"), shared.value)[0])
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), batch.column("label")], ["a", "b", "c", "d", "label"])

    fitted = rows.mapInArrow(final, "a double, b double, c double, d double, label int").toPandas()  # FIT_ROWS rows of numbers
    model["weights"] = np.array([-3.0, 0.0, 0.0, 0.0, 0.0])
    if fitted.label.nunique() == 2:
        x, y = fitted[["a", "b", "c", "d"]].to_numpy(), fitted.label.to_numpy(np.float64)
        # the sample has both labels evenly; the labelled texts don't
        weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
        model["weights"] = logistic(x, y, weight)
    rows.unpersist()
    return model


def with_toxicity(docs: DataFrame, model: dict, prefix: str = "", spans: bool = False) -> DataFrame:
    """docs with score (0 to 1), n_segments, and with spans: segments, the significant passages as (start, stop, score) in bytes.

    Null and empty texts score what a text without any segment does. Columns of docs that
    clash with the new ones are replaced. An empty table gives no rows.
    """
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = {prefix + "score": "double", prefix + "n_segments": "int"} | ({prefix + "segments": "array<struct<start:int,stop:int,score:double>>"} if spans else {})
    held = docs.drop(*[c for c in docs.columns if c.lower() in new])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found, where = evidence(batch.column("text"), shared.value, spans)
            out = [pa.array(probability(features(found), shared.value["weights"])), pa.array(found[:, 2].astype(np.int32))]
            if spans:
                out.append(pa.array([[{"start": s, "stop": e, "score": x} for s, e, x in w] for w in where], kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, *new])

    return held.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in held.dtypes), *(f"{c} {t}" for c, t in new.items())]))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    from .common import doc_remainder

    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = with_toxicity(docs, model).withColumn("held_out", F.coalesce(doc_remainder(5) == 0, F.lit(False)))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_segments")
