"""Mixing documents to target weights with soft domain membership.

A classifier, fitted on a bounded sample of the labelled table, gives each document
posterior weights over the domains. With rates r >= 0, a document of w tokens and
posteriors p adds r*w*p to the domains' expected totals. Accelerated projected
gradient descent fits the rates to

    1/2 |sum(r*w*p)/S - target|^2 + ridge/2 * sum(w/S * (r - 1)^2),   S = sum(w),

so rates stay near one where the target allows. A document's rate depends on the
others only through the residuals of the totals, one short vector for each step.
Tasks replay these for their documents and return sums; nothing as long as the
table is kept between steps, and a lost task is computed again from the history.

The descent starts near its end: documents are first added up in cells of like
posteriors, of which there is a bounded number, and the same descent over the cells
gives the residuals that the documents' rates start from. The passes over all
documents that follow remove what the cells left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, with_computed

#: Labelled rows the classifier is fitted on at most.
MAX_LABELLED = 20_000
#: Words that the classifier looks at: those of the sample that tell most about the domains.
FEATURES = 4096
#: Few words tell a domain apart: the penalty on absolute weights leaves out the many that merely chance to,
#: that on squares shares a weight among words that tell the same, which a small sample needs.
REG_PARAM, ELASTIC_NET = 0.002, 0.5
FIT_STEPS = 40
RIDGE = 1e-3
#: Passes over all documents at most, and the change of the residuals at which they end.
STEPS = 20
TOLERANCE = 1e-7
#: Cells of like posteriors at most, and steps over them.
CELLS, CELL_STEPS = 10_000, 4000


def classifier(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[PipelineModel, int]:
    """(model, number of domains). ``labelled``: rows (doc_id, domain), domains numbered from 0.

    The sample is the ``MAX_LABELLED`` labelled rows of smallest id hash; rows with a
    null id or domain don't count. It is bounded, so it is broadcast to the documents.
    No labelled document at all is an error here; :func:`mix` has a result for it.
    """
    sample = labelled.select(F.col("doc_id").alias("__id"), F.col("domain").cast("double").alias("label")).dropna().dropDuplicates(["__id"])
    sample = sample.orderBy(F.xxhash64("__id"), "__id").limit(MAX_LABELLED)
    own = docs.select(F.col(id_col).cast("long").alias("__doc"), F.col(text_col).alias("__raw"))
    training = _words(own.join(F.broadcast(sample), own["__doc"] == sample["__id"]).select("__raw", "label"), "__raw")
    tokens = Tokenizer(inputCol="__text", outputCol="__words")
    scratch = Scratch(docs.sparkSession, "mixing")
    prepared = scratch.keep(tokens.transform(training).select("label", "__words"), "training")
    counts = CountVectorizerModel.from_vocabulary(telling_words(prepared), inputCol="__words", outputCol="__features")
    counts.setBinary(True)
    fitted = LogisticRegression(featuresCol="__features", probabilityCol="__posterior", regParam=REG_PARAM, elasticNetParam=ELASTIC_NET, maxIter=FIT_STEPS, family="multinomial").fit(counts.transform(prepared))
    return PipelineModel([tokens, counts, fitted]), fitted.numClasses


def telling_words(prepared: DataFrame, most: int = FEATURES) -> list[str]:
    """The words of a labelled sample (label, __words) whose presence tells most about the label, at most ``most``.

    By the log-likelihood ratio of a word's presence and the label, ties by word; at least one.
    """
    held = prepared.select("label", F.explode(F.array_distinct("__words")).alias("word")).where(F.length("word") > 0)
    by_label = held.groupBy("word", "label").agg(F.count(F.lit(1)).alias("n"))
    totals = prepared.groupBy("label").agg(F.count(F.lit(1)).alias("label_n"))
    whole = prepared.count()
    per_word = by_label.groupBy("word").agg(F.sum("n").alias("word_n"))
    x = by_label.join(F.broadcast(totals), "label").join(per_word, "word")
    gain = F.sum(F.col("n") * F.log(F.col("n") * whole / (F.col("word_n") * F.col("label_n"))))
    best = x.groupBy("word").agg(gain.alias("gain"), F.first("word_n").alias("word_n")).where("word_n > 1").orderBy(F.desc(F.round("gain", 6)), "word").limit(most)
    return [r["word"] for r in best.select("word").collect()] or ["\0"]


def _words(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``__text``: words in lower case, one space between, anything but letters and digits left out."""
    return docs.withColumn("__text", F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+", " ")))


def posteriors(docs: DataFrame, model: PipelineModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, posterior), one per document row; tokens are runs of letters and digits, at least one each."""
    scored = model.transform(_words(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__raw")), "__raw"))
    return scored.select("doc_id", F.greatest(F.size("__words"), F.lit(1)).cast("long").alias("n_tokens"), vector_to_array("__posterior").alias("posterior"))


def _replay(p: np.ndarray, start: np.ndarray, residuals: np.ndarray, step: float, momentum: float, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """(rates, the point ahead of them where the next residual is taken) after the steps of ``residuals``.

    ``start``: residuals of the totals for which the first rates are the best ones; zeros give ones.
    """
    rate = ahead = np.maximum(0.0, 1.0 - (p @ start) / ridge)
    for g in residuals:
        new = np.maximum(0.0, ahead - step * (p @ g + ridge * (ahead - 1.0)))
        ahead, rate = new + momentum * (new - rate), new
    return rate, ahead


def _cells(rows: DataFrame, n_domains: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, mean posteriors) of cells of like posteriors, at most ``CELLS``."""
    grid = 1
    while comb(grid + n_domains, n_domains - 1) <= CELLS and grid < 4096:
        grid += 1
    p, w = F.col("posterior"), F.col("n_tokens").cast("double")
    # whole parts of the first posteriors tell the cell: they never add up to more than the grid
    cell = F.transform(F.slice(p, 1, n_domains - 1), lambda x: F.floor(x * grid))
    sums = [F.sum(w * p[k]).alias(f"s{k}") for k in range(n_domains)]
    found = rows.groupBy(cell.alias("cell")).agg(F.sum(w).alias("w"), *sums).collect()
    weights = np.array([r["w"] for r in found])
    return weights, np.array([[r[f"s{k}"] for k in range(n_domains)] for r in found]) / weights[:, None]


def fit_rates(rows: DataFrame, n_domains: int, targets: Mapping[int, float], ridge: float = RIDGE, steps: int = STEPS) -> DataFrame:
    """``rows`` (doc_id, n_tokens, posterior; written) with ``rate``.

    ``targets``: wanted share of the present tokens by domain. Domains that it leaves
    out share the rest of the whole in proportion to their present shares. An empty
    table gives no rows.
    """
    double = pa.float64()
    weights, means = _cells(rows, n_domains)
    if not len(weights):
        return rows.withColumn("rate", F.lit(1.0))
    total = weights.sum()
    shares, now = weights / total, weights @ means / total
    gram = (means * shares[:, None]).T @ means  # of the cells, near enough for the length of a step
    given = np.array([k in targets for k in range(n_domains)])
    target = np.array([targets.get(k, 0.0) for k in range(n_domains)])
    rest = now * ~given
    target = np.where(given, target, rest * max(0.0, 1.0 - target.sum()) / max(rest.sum(), 1e-12))
    eigen = np.linalg.eigvalsh(gram)
    smooth, convex = 1.05 * eigen[-1] + ridge, max(eigen[0], 0.0) + ridge
    step, q = 1.0 / smooth, np.sqrt(convex / smooth)
    momentum = (1 - q) / (1 + q)

    rate = ahead = np.ones(len(means))
    start = now - target
    for _ in range(CELL_STEPS):
        g = (shares * ahead) @ means - target
        new = np.maximum(0.0, ahead - step * (means @ g + ridge * (ahead - 1.0)))
        ahead, moved = new + momentum * (new - rate), np.abs(new - rate).max()
        rate, start = new, g
        if moved < 1e-9:
            break
    start = (shares * rate) @ means - target

    def totals(history: np.ndarray) -> np.ndarray:
        def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = None
            for part in parts:
                p, w = np.stack(part["posterior"].to_numpy()), part["n_tokens"].to_numpy(float)
                own = (w * _replay(p, start, history, step, momentum, ridge)[1]) @ p
                found = own if found is None else found + own
            if found is not None:
                yield pd.DataFrame({"i": np.arange(found.size), "x": found})

        out = rows.select("n_tokens", "posterior").mapInPandas(batches, "i int, x double").groupBy("i").agg(F.sum("x").alias("x"))
        return np.array([r["x"] for r in sorted(out.collect(), key=lambda r: r["i"])]) / total

    residuals = np.zeros((0, n_domains))
    for _ in range(steps):
        residuals = np.vstack([residuals, totals(residuals) - target])
        before = residuals[-2] if len(residuals) > 1 else start
        if np.abs(residuals[-1] - before).max() < TOLERANCE:
            break

    def rated(posteriors: list) -> tuple:
        return (pa.array(_replay(np.array(posteriors, float), start, residuals, step, momentum, ridge)[0]),)

    return with_computed(rows, [F.col("posterior")], [("rate", "double", double)], rated)


def mix(docs: DataFrame, labelled: DataFrame, targets: Mapping[int, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, posterior, rate), one per document row.

    Null and empty texts have one token, the posteriors of a text without known
    words, and a rate like any other. Repeated rows get equal rates. An empty table
    of documents gives no rows. Without any labelled document nothing is known of the
    domains: all that ``targets`` names are equally likely and every rate is one.
    """
    labelled = labelled.select("doc_id", "domain").dropna()
    known = docs.select(F.col(id_col).cast("long").alias("doc_id")).join(labelled, "doc_id", "left_semi")
    if known.isEmpty():
        n = max([*targets, 0]) + 1
        text = _words(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__raw")), "__raw")
        size = F.greatest(F.size(F.split("__text", " ")), F.lit(1)).cast("long")
        return text.select("doc_id", size.alias("n_tokens"), F.array(*[F.lit(1.0 / n)] * n).alias("posterior"), F.lit(1.0).alias("rate"))
    model, n = classifier(docs, labelled, id_col, text_col)
    rows = Scratch(docs.sparkSession, "mixing").keep(posteriors(docs, model, id_col, text_col), "posteriors")
    return fit_rates(rows, n, targets)


#: Domains of the labels table, and the shares of tokens wanted of them.
DOMAINS = ("poor", "good", "toxic")
TARGETS = {0: 0.15, 1: 0.85, 2: 0.0}
#: Targets that only take toxic text out; the others keep their proportion.
WITHOUT_TOXIC = {2: 0.0}


def label_domains(labels: DataFrame) -> DataFrame:
    """Rows (doc_id, domain) of a table (doc_id, quality, toxic)."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 1).when(F.col("quality") == 0, 0)
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain"))
