"""Quality by hierarchical empirical Bayes: document evidence, host and path posteriors shrunk to their parents.

A logistic classifier on text features gives each document's evidence. Host is `source` up to the first slash, path the rest
of it with the language as its section (null: empty string). How strongly a site is shrunk to its parent is estimated from the
data: the variance inside sites over the variance between them (one-way analysis of variance, level by level), so that sites
that differ no more than chance shrink wholly. A document's own evidence is left out of its site's sums.

Null text has the features of an empty one; null sources are one host; repeated rows count one by one, as do repeated labels;
without labels all evidence is 0.5; an empty table gives no rows; texts are read whole; other columns are not read.
"""
import numpy as np
from pyspark.sql import DataFrame, functions as F

from lodestone.llm.common import materialise

SAMPLE = 20_000  # labelled rows of the fit in expectation
MARKS, CAPITALS = "#$%&*|!{}<>@", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FEATURES = 7


def _features(t):
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    w = F.filter(F.split(t, "\\s+"), lambda x: x != "")
    k = F.greatest(F.size(w), F.lit(1)).cast("double")
    marks = (F.length(t) - F.length(F.translate(t, MARKS, ""))) / n
    caps = (F.length(t) - F.length(F.translate(t, CAPITALS, ""))) / n
    return [marks, F.sqrt(marks), caps, F.size(F.array_distinct(w)) / k, n / k / 10, F.log(k) / 10, 1 - F.size(F.array_distinct(F.split(t, "\n"))) / F.size(F.split(t, "\n"))]


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the raw features and bias of a ridge logistic regression, by Newton steps."""
    if not len(x):
        return np.zeros(FEATURES), 0.0
    mean, sd = x.mean(0), x.std(0) + 1e-9
    z, w = np.hstack([(x - mean) / sd, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(w)), z.T @ (p - y) + 0.1 * w)
    return w[:-1] / sd, float(w[-1] - (w[:-1] * mean / sd).sum())


def strength(within, between):
    """Pseudo-documents of a prior: variance of a document inside its site over the variance between sites."""
    return F.greatest(F.lit(1e-6), F.least(F.lit(1e12), F.coalesce(F.try_divide(within, between), F.lit(1e12))))


def sites(paths: DataFrame) -> DataFrame:
    """host, path, n, s, hn, hs, prior, host_strength, path_strength from sums by path (host, path, n, s, q)."""
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("q").alias("hq"), F.count("*").alias("paths"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("ss"))
    one = hosts.agg(
        F.sum("hn").alias("all_n"), F.sum("hs").alias("all_s"), F.sum("hq").alias("all_q"), F.count("*").alias("h"), F.sum("paths").alias("p"),
        F.sum(F.col("hs") * F.col("hs") / F.col("hn")).alias("host_ss"), F.sum("ss").alias("path_ss"), F.sum(F.col("hn") * F.col("hn")).alias("host_nn"), F.sum(F.col("nn") / F.col("hn")).alias("path_nn"),
    )
    mean = F.col("all_s") / F.col("all_n")
    # host level: sites are hosts, the parent is the whole corpus; path level: sites are paths, the parent is the host
    host_in = F.coalesce(F.try_divide(F.greatest(F.lit(0.0), F.col("all_q") - F.col("host_ss")), F.greatest(F.lit(1), F.col("all_n") - F.col("h"))), F.lit(0.0))
    host_out = (F.col("host_ss") - F.col("all_n") * mean * mean - (F.col("h") - 1) * host_in) / F.greatest(F.lit(1e-9), F.col("all_n") - F.col("host_nn") / F.col("all_n"))
    path_in = F.coalesce(F.try_divide(F.greatest(F.lit(0.0), F.col("all_q") - F.col("path_ss")), F.greatest(F.lit(1), F.col("all_n") - F.col("p"))), F.lit(0.0))
    path_out = (F.col("path_ss") - F.col("host_ss") - (F.col("p") - F.col("h")) * path_in) / F.greatest(F.lit(1e-9), F.col("all_n") - F.col("path_nn"))
    one = one.select(F.lit(1).alias("k"), mean.alias("prior"), strength(host_in, F.greatest(F.lit(0.0), host_out)).alias("host_strength"), strength(path_in, F.greatest(F.lit(0.0), path_out)).alias("path_strength"))
    return paths.join(hosts.select("host", "hn", "hs"), "host").withColumn("k", F.lit(1)).join(F.broadcast(one), "k").drop("k", "q")


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, source, path, evidence, host_posterior, path_posterior, score, kept."""
    t, source = F.coalesce("text", F.lit("")), F.coalesce("source", F.lit("\0"))
    host = F.substring_index(source, "/", 1)
    path = F.concat_ws("/", F.substring(source, F.length(host) + 2, F.lit(1 << 30)), F.coalesce("lang", F.lit("")))
    base = materialise(docs.select("doc_id", "source", host.alias("host"), path.alias("path"), F.array(*_features(t)).alias("x")), "features")
    known = labels.where("quality is not null").select("doc_id", "quality")
    share = min(1.0, sample / max(1, known.count()))
    some = base.join(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000), "doc_id").select("x", "quality").collect()
    w, bias = fit(np.array([r.x for r in some], float).reshape(len(some), FEATURES), np.array([r.quality for r in some], float))
    logit = F.lit(bias)
    for i in range(FEATURES):
        logit = logit + F.col("x")[i] * float(w[i])
    d = base.withColumn("evidence", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))))).drop("x")
    e = F.col("evidence")
    paths = materialise(d.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(e).alias("s"), F.sum(e * e).alias("q")), "paths")
    out = d.join(sites(paths), ["host", "path"])
    # a document's own evidence is not counted again
    host_post = (F.col("hs") - e + F.col("host_strength") * F.col("prior")) / (F.col("hn") - 1 + F.col("host_strength"))
    out = out.withColumn("host_posterior", host_post)
    out = out.withColumn("path_posterior", (F.col("s") - e + F.col("path_strength") * F.col("host_posterior")) / (F.col("n") - 1 + F.col("path_strength")))
    inside = lambda c: F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col(c)))
    odds = lambda c: F.log(inside(c) / (1 - inside(c)))
    p = 1 / (1 + F.exp(-(odds("evidence") + odds("path_posterior") - odds("prior"))))
    return out.select("doc_id", "source", "path", "evidence", "host_posterior", "path_posterior", p.alias("score"), (p >= 0.5).alias("kept"))
