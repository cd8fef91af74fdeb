"""Mixing sources to target weights by soft membership, in built-in functions and the library's own classifier.

1. A sparse multinomial logistic regression over the hashes of the beginnings of a text's words is fitted on at most ``TRAIN_ROWS``
   labelled documents, chosen by a hash of doc_id; it gives every document posteriors of the domains (clean, low, toxic).
2. Rates r of documents fit, by least squares, the domains' expected token totals to the targets:
   sum over documents of tokens * r * p_k = t_k, rates not negative (and at most ``cap``, if given), and no
   further from 1 than needed. Projected gradient with lazy projection keeps one number for each domain, Y, and
   r = clip(1 - p . Y, 0, cap). A step moves Y by the inverse of a matrix times the totals' residual. With the Gram matrix of all
   documents, or more, the step ascends: no rates can curve the objective by more. The problem, kept bounded by a small
   penalty on Y, has one solution. A pass over the narrow table adds up what a few steps would give (such a one, long ones, and quicker ones by
   the Gram matrix of the documents that aren't clipped); the best is taken. No pass shuffles more than a row for each task.

   The total is that of all documents. Where rates may only cut down (``keep_share``: cap 1), it is the largest that can be reached with
   totals in the targets' proportions: Y is held to w . Y = -REACH, which makes the total a multiplier of the same problem. There the
   penalty is such that a target gives way, by about MISSED of the tokens, before much text that is surely of one domain goes: posteriors
   of such text aren't 0 for the other domains, so targets below those can't be met otherwise.

``copies`` is the rate rounded up or down by a hash of doc_id, so that its expectation is the rate. Tokens are words here
(runs without white space): a tokenizer would need Python, and targets are shares, for which words do as well.

Null text has no words and so no tokens. Rows that repeat a doc_id, or have none (it stays null), are weighed one by one;
rows with one doc_id are rounded alike. Other columns are ignored by ``mix`` and kept by ``keep_share``. A domain that no labelled document has is left out and its target goes to
the others in proportion; without labelled documents there is one domain, all rates are 1. Labels of unknown or
repeated doc_ids do no harm. An empty table gives no rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genomark.llm.common import fresh, let, written

DOMAINS = ("clean", "low", "toxic")
#: Rows and hashed features of the classifier, and its fit: L1 penalty. STEMS: lengths of the words' beginnings.
TRAIN_ROWS, FEATURES, ITERATIONS, PENALTY, STEMS = 8000, 1 << 15, 40, 0.0005, (4, 6)
#: PASSES: more are an error. CLOSE: of the total, where a fit ends. MISSED: a miss that is worth a warning. FIRM: of the penalty on Y.
PASSES, CLOSE, MISSED, FIRM = 200, 1e-4, 0.02, 1e-6
#: For the largest total: how much a kept token counts against moving a rate from 1, and the penalty.
REACH, FIRM_LARGEST = 50.0, 1e-4
#: Steps of a pass: LONG gradient steps, and steps by the Gram matrix of the documents that aren't clipped plus so much of that of all documents.
LONG, DAMPED = (16, 256), (1.0, 0.1, 1e-2, 1e-3, 1e-4, 1e-6)


def domain(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Of a row of labels; null where it says nothing."""
    return F.when(F.col(toxic) == 1, "toxic").when(F.col(quality) == 0, "low").when(F.col(quality) == 1, "clean")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def _features(text: Column) -> Column:
    """The distinct beginnings of the words, of each length: kinds of words share a stem, and stems are fewer than words."""
    stem = lambda n: lambda w: F.substring(w, 1, n)
    return let(_words(text), lambda w: F.concat(*(F.array_distinct(F.transform(w, stem(n))) for n in STEMS)))


def posteriors(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: Sequence[Column] = ()) -> tuple[DataFrame, list[str]]:
    """doc_id, n_tokens, p_<domain> and what carry names of every document, and the domains that the labels have."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"), *carry)
    also = docs.columns[2:]
    n_tokens = F.size(F.split(F.btrim(F.coalesce(F.col("t"), F.lit("")), F.lit(" \t\n\x0b\f\r")), "[ \\t\\n\\x0B\\f\\r]+"))
    counted = docs.withColumn("n_tokens", F.when(F.btrim(F.coalesce(F.col("t"), F.lit("")), F.lit(" \t\n\x0b\f\r")) == "", 0).otherwise(n_tokens).cast("long"))
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), domain().alias("domain")).where("domain IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    share = max(1, -(-known.count() // TRAIN_ROWS))
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)  # about TRAIN_ROWS rows, so broadcast
    tf = HashingTF(numFeatures=FEATURES, inputCol="words", outputCol="features", binary=True)
    # One text of each labelled doc_id, however many rows repeat it.
    train = written(docs.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("domain").alias("domain"), F.min("t").alias("t")).select("domain", "t"), "labelled")
    found = sorted(r["domain"] for r in train.select("domain").distinct().collect())
    if len(found) < 2:
        one = found or ["clean"]
        return counted.select("doc_id", "n_tokens", F.lit(1.0).alias(f"p_{one[0]}"), *also), one
    label = F.array_position(F.array(*map(F.lit, found)), F.col("domain")).cast("double") - 1
    model = LogisticRegression(family="multinomial", maxIter=ITERATIONS, regParam=PENALTY, elasticNetParam=1.0, standardization=False).fit(tf.transform(train.select(label.alias("label"), _features(F.col("t")).alias("words"))).select("label", "features"))
    scored = model.transform(tf.transform(counted.select("doc_id", "n_tokens", _features(F.col("t")).alias("words"), *also)).select("doc_id", "n_tokens", "features", *also))
    p = vector_to_array("probability")
    return scored.select("doc_id", "n_tokens", p.alias("p"), *also).select("doc_id", "n_tokens", *(F.get("p", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(found)), *also), found


class Fit(NamedTuple):
    """Rates as an expression over p_<domain>, passes over the table, and the domains' expected token totals, wanted and reached."""

    rate: Column
    passes: int
    wanted: dict[str, float]
    reached: dict[str, float]

    def error(self) -> float:
        """The largest miss as a share of all tokens that are wanted."""
        total = sum(self.wanted.values())
        return max((abs(self.reached[d] - x) / total for d, x in self.wanted.items()), default=0.0) if total else 0.0


def fit_rates(scored: DataFrame, domains: list[str], targets: Mapping[str, float], cap: float | None = None, largest: bool = False, firm: float | None = None) -> Fit:
    """The rates that fit best. If no rates within the bounds reach the targets, it is the nearest fit, with a warning if it misses them by over ``MISSED`` of the tokens.

    largest: the total is the largest that a cap of 1 allows; else it is that of all documents. firm: of the penalty on Y, if not the usual one.
    """
    tokens, p, k = F.col("n_tokens").cast("double"), [F.col(f"p_{d}") for d in domains], len(domains)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cap = 1.0 if largest else cap
    numbers = lambda row: np.array([float(x or 0) for x in row])
    named = lambda x: dict(zip(domains, map(float, x), strict=True))

    def square(x: np.ndarray) -> np.ndarray:
        out = np.zeros((k, k))
        for (i, j), v in zip(pairs, x, strict=True):
            out[i, j] = out[j, i] = v
        return out

    sums = numbers(scored.agg(*(F.sum(tokens * x) for x in p), *(F.sum(tokens * p[i] * p[j]) for i, j in pairs)).first())
    have, gram = sums[:k], square(sums[k:])
    weight = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    if have.sum() == 0 or weight.sum() == 0:
        return Fit(F.lit(1.0), 0, named(have), named(have))
    weight /= weight.sum()
    if largest:  # a small domain of which there is less than its share must not hold down the total: all of it may stay, and the largest share takes the rest
        most = int(weight.argmax())
        weight = np.minimum(weight, have / have.sum())
        weight[most] = 0.0
        weight[most] = 1.0 - weight.sum()
    if k == 1:
        return Fit(F.lit(1.0), 0, named(have), named(have))
    total, soft = have.sum(), (firm or (FIRM_LARGEST if largest else FIRM)) * np.diag(have + 1e-6 * have.sum())
    gram += soft

    def free(y: np.ndarray) -> Column:
        return F.lit(1.0) - sum((x * F.lit(float(v)) for x, v in zip(p[1:], y[1:], strict=True)), p[0] * F.lit(float(y[0])))

    def rate(y: np.ndarray) -> Column:
        r = F.greatest(F.lit(0.0), free(y))
        return F.least(r, F.lit(float(cap))) if cap is not None else r

    def measured(ys: list[np.ndarray]) -> list[tuple]:
        """Of each Y in one pass: the dual objective, Y, the totals, the Gram matrix of the documents that aren't clipped."""
        rows = scored.select(tokens.alias("_n"), *(x.alias(f"_p{i}") for i, x in enumerate(p)), *(free(y).alias(f"_f{c}") for c, y in enumerate(ys)), *(rate(y).alias(f"_r{c}") for c, y in enumerate(ys)))
        n, q = F.col("_n"), [F.col(f"_p{i}") for i in range(k)]
        wanted = []
        for c in range(len(ys)):
            f, r = F.col(f"_f{c}"), F.col(f"_r{c}")
            wanted += [F.sum(n * ((r - 1) * (r - 1) / 2 + r * (1 - f))), *(F.sum(n * r * x) for x in q), *(F.sum(F.when(f == r, n * q[i] * q[j]).otherwise(0.0)) for i, j in pairs)]
        found = numbers(rows.agg(*wanted).first()).reshape(len(ys), -1)
        out = []
        for y, x in zip(ys, found, strict=True):
            dual = x[0] - y @ soft @ y / 2 - (0.0 if largest else float(y @ weight) * total)
            out.append((dual, y, x[1 : k + 1], square(x[k + 1 :])))
        return out

    def toward(matrix: np.ndarray, totals: np.ndarray, y: np.ndarray) -> np.ndarray:
        slope = totals - soft @ y
        a, b = np.linalg.solve(matrix, np.stack([slope, weight], 1)).T
        return a - b * (float(weight @ a) / float(weight @ b)) if largest else a - b * total

    def residual(y: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """What is left of the slope: at its end the penalty and a miss of the targets balance."""
        slope = totals - soft @ y
        return slope - weight * (slope.sum() if largest else total)

    (best,), passes = measured([np.full(k, -REACH) if largest else np.zeros(k)]), 1
    while np.abs(residual(best[1], best[2])).max() > CLOSE * max(best[2].sum(), 1e-9 * total):
        if passes == PASSES:
            raise RuntimeError(f"no fit after {passes} passes: wanted {named(weight * total)}, reached {named(best[2])}")
        _, y, totals, open_ = best
        steps = [*(x * toward(gram, totals, y) for x in LONG), *(toward(open_ + soft + d * gram, totals, y) for d in DAMPED)]
        best = max(measured([y + x for x in steps]), key=lambda x: x[0])
        passes += 1
    wanted = weight * (best[2].sum() if largest else total)
    fit = Fit(rate(best[1]), passes, named(wanted), named(best[2]))
    if fit.error() > MISSED:
        warnings.warn(f"no rates reach the targets: wanted {fit.wanted}, reached {fit.reached}", stacklevel=2)
    return fit


def mix(documents: DataFrame, labels: DataFrame, targets: Mapping[str, float], cap: float | None = None, largest: bool = False, *carry: Column) -> DataFrame:
    """doc_id, n_tokens, p_<domain>..., what carry names, rate, copies of every row."""
    scored, domains = posteriors(documents, labels, carry=carry)
    scored = written(scored, "posteriors")
    rated = scored.withColumn("rate", fit_rates(scored, domains, targets, cap, largest).rate)
    u = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0).cast("long")), F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rated.withColumn("copies", (F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))


def keep_share(documents: DataFrame, labels: DataFrame, targets: Mapping[str, float]) -> DataFrame:
    """The documents that stay when the largest total in the targets' proportions is kept, with all their columns. Rows that repeat a doc_id with another text each have a verdict of their own."""
    name = fresh(documents, "mixed")
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), F.col("doc_id").isNull(), "text").alias(name)
    judged = mix(documents, labels, targets, 1.0, True, key)
    return documents.select("*", key).join(judged.where("copies > 0").select(name).distinct(), name, "left_semi").select(*documents.columns)
