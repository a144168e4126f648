"""Quality classifier: hierarchical empirical Bayes over documents, hosts and paths.

A logistic classifier over document statistics, trained here on a bounded sample of labelled rows, gives each document
its evidence.  Grouped aggregation sums the evidence by path and by host; sparse sites shrink: a path's rate toward its
host's, a host's toward the global rate, with strengths estimated from the spread between sites by moments.  A
document's posterior odds are its own evidence times its path's posterior odds over the global odds, damped by
``site_weight`` so that a site never outweighs clear evidence.  A document's own evidence is left out of the sums of its
path and host, so it counts once; a document that is alone at its site gets the shrunk prior.

Input columns with the names of results give way to these in ``classify`` and stay in ``reject``.  Null host or path: a site of its own.  Null and empty texts: scored from zero statistics like any other row.  Repeated
rows count each.  Labels of one class only: every document is kept.  Sites are joined by broadcast only where their
number is checked to be small; else by a shuffle join that splits hot sites.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowscope.llm.common import dropped, join_small, map_text, stored, texts
from rowscope.llm.rules import labelled_sample, stats_rows
from rowscope.llm.stats import FEATURES, features, measure
from rowscope.llm.toxicity import fit_logistic

SAMPLE_ROWS = 20_000
_HOST, _PATH, _EV = "__site_host", "__site_path", "__evidence"


@dataclass
class Evidence:
    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((_spread(x) - self.mean) / self.scale, -8, 8)
        return np.clip(self.coef[0] + z @ self.coef[1:], -30, 30)


def _spread(x: np.ndarray) -> np.ndarray:
    """Rates as they are and on a log scale, so that small and large rates both count."""
    return np.concatenate([x, np.log(np.maximum(x, 0) + 0.01)], 1)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS) -> Evidence:
    got = stats_rows(labelled_sample(docs.select("doc_id", text), labels, label, rows), text, label).toPandas()
    x = _spread(np.array(got["x"].tolist()).reshape(len(got), len(FEATURES)))
    y = (got[label].to_numpy(float) > 0).astype(float)
    k = np.size(x, 1)
    if not len(y) or y.min() == y.max():
        return Evidence(np.zeros(k), np.ones(k), np.r_[4.0 if not len(y) or y.max() > 0 else -4.0, np.zeros(k)])
    order = np.lexsort([*x.T, y])
    x, y = x[order], y[order]
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    return Evidence(mean, scale, fit_logistic(np.clip((x - mean) / scale, -8, 8), y, ridge=1.0))


def with_evidence(docs: DataFrame, model: Evidence, text: str, host: str, path: str, keep_text: bool) -> DataFrame:
    carried = [f for f in docs.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*carried, T.StructField(_EV, T.DoubleType())])
    out = map_text(docs, text, lambda b: {_EV: model.logit(features(measure(texts(b, text))))}, schema)

    def site(c: str):
        return F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("null")) if c in docs.columns else F.lit("null")

    return out.withColumns({_HOST: site(host), _PATH: site(path)})


def _own() -> F.Column:
    """A document's evidence as whole millionths of a good document: their sums do not depend on the order of addition."""
    return F.round(1e6 / (1 + F.exp(-F.col(_EV)))).cast("long")


def sites(scored: DataFrame) -> tuple[DataFrame, float, float, float]:
    """(host, path, n, s, hn, hs): documents and good ones of each site and its host; the global rate and both priors' strengths."""
    paths = stored(scored.groupBy(_HOST, _PATH).agg(F.count(F.lit(1)).alias("__n"), F.sum(_own()).alias("__s")))
    hosts = paths.groupBy(_HOST).agg(F.sum("__n").alias("__hn"), F.sum("__s").alias("__hs"))

    def moments(df: DataFrame, n: str, s: str, centre) -> tuple[float, float, float, float]:
        r = df.agg(F.sum(n).alias("n"), F.sum(F.col(s) / 1e6).alias("s"), F.sum(F.col(n) * F.pow(F.col(s) / 1e6 / F.col(n) - centre, 2)).alias("q"), F.count(F.lit(1)).alias("k")).first()
        return tuple(float(r[c] or 0) for c in ("n", "s", "q", "k"))

    n, s, _, _ = moments(hosts, "__hn", "__hs", F.lit(0.0))
    p0 = min(max(s / n, 1e-4), 1 - 1e-4) if n else 0.5

    def strength(q: float, k: float) -> float:
        """Pseudo-count of the prior: within variance over the excess of the between variance."""
        within = p0 * (1 - p0)
        between = max((q - within * max(k - 1, 0)) / n, within / 1e4) if n else within
        return float(np.clip(within / between, 2.0, 1e4))

    mh = strength(*moments(hosts, "__hn", "__hs", F.lit(p0))[2:])
    both = stored(paths.join(hosts, _HOST))
    centred = both.withColumn("__hp", (F.col("__hs") / 1e6 + mh * p0) / (F.col("__hn") + mh))
    mp = strength(*moments(centred, "__n", "__s", F.col("__hp"))[2:])
    dropped(paths)
    return both, p0, mh, mp


def classify(docs: DataFrame, model: Evidence, text: str = "text", host: str = "source", path: str = "lang", threshold: float = 0.5, site_weight: float = 0.5, keep_text: bool = False) -> DataFrame:
    """The columns of ``docs`` (the text only with ``keep_text``) and ``evidence site_rows site_rate score kept``."""
    names = ["evidence", "site_rows", "site_rate", "score", "kept"]
    docs = docs.drop(*[c for c in names if c in docs.columns])
    lean = with_evidence(docs, model, text, host, path, False)
    if not keep_text:
        lean = stored(lean)
    table, p0, mh, mp = sites(lean)
    base = with_evidence(docs, model, text, host, path, True) if keep_text else lean
    joined = join_small(base, table, [_HOST, _PATH])
    # the sums without the document itself
    own = _own()
    host_rate = ((F.col("__hs") - own) / 1e6 + mh * p0) / (F.col("__hn") - 1 + mh)
    rate = ((F.col("__s") - own) / 1e6 + mp * host_rate) / (F.col("__n") - 1 + mp)
    rate = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), rate))
    out = joined.withColumns({"evidence": F.col(_EV), "site_rows": F.col("__n"), "site_rate": rate})
    shift = F.log(F.col("site_rate") / (1 - F.col("site_rate"))) - float(np.log(p0 / (1 - p0)))
    score = 1 / (1 + F.exp(-(F.col(_EV) + site_weight * shift)))
    return out.withColumn("score", score).withColumn("kept", F.col("score") >= threshold).drop(_HOST, _PATH, _EV, "__n", "__s", "__hn", "__hs")


def reject(docs: DataFrame, model: Evidence, text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, columns as they were."""
    clash = [c for c in ("evidence", "site_rows", "site_rate", "score", "kept") if c in docs.columns]
    safe = docs.withColumnsRenamed({c: f"__own_{c}" for c in clash})
    out = classify(safe, model, text, keep_text=True, **how).where("kept").select(*safe.columns)
    return out.withColumnsRenamed({f"__own_{c}": c for c in clash})
