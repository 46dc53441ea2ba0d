"""URL filter: host and path rules first, a classifier for the rest.

The classifier is a logistic regression on hashed character n-grams of host and
path. It is fitted on the driver from a labelled URL table of bounded size and
applied to every row in Arrow batches.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import textkernel

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS = 18
GRAMS = (3, 4, 5)


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; else empty."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null; rules are (verdict, "host/path")."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature of every n-gram, and the row it is in."""
    buf, offs = textkernel.flat(column)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    value = textkernel._BYTE[buf]
    features, rows = [], []
    for n in GRAMS:
        h = textkernel.gram_hash(value, n)
        inside = row[: len(h)] == row[n - 1 :] if len(h) else np.zeros(0, bool)
        features.append((h[inside] & np.uint64((1 << BITS) - 1)).astype(np.int64))
        rows.append(row[: len(h)][inside])
    return np.concatenate(features), np.concatenate(rows)


def _text(host: Column, path: Column) -> Column:
    return F.concat(F.lit("^"), host, F.lit("$"), path)


def fit(labelled: DataFrame, most: int = 2000, rounds: int = 200, rate: float = 4.0, decay: float = 1e-4) -> np.ndarray:
    """Weights (bias last) from (url, label) rows, label 1 for blocked.

    At most `most` distinct URLs of each label take part, those of the least
    hash, so the sample does not depend on the order of rows. A table without
    rows of both labels gives a model that allows everything.
    """
    sample = []
    for label in (0, 1):
        rows = labelled.where((F.col("label") == label) & F.col("url").isNotNull()).select(_text(host_of(F.col("url")), path_of(F.col("url"))).alias("t"), F.xxhash64("url").alias("h"))
        sample += [(r["t"], label) for r in rows.distinct().orderBy("h", "t").limit(most).collect()]
    y = np.array([s[1] for s in sample], dtype=float)
    weights = np.zeros((1 << BITS) + 1)
    if len(set(y.tolist())) < 2:
        weights[-1] = -1.0
        return weights
    feature, row = _grams(pa.array([s[0] for s in sample]))
    size = np.maximum(np.bincount(row, minlength=len(y)), 1)
    used, feature = np.unique(feature, return_inverse=True)
    balance = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, bias = np.zeros(len(used)), 0.0
    scale = 1 / np.sqrt(size[row])
    for _ in range(rounds):
        z = np.bincount(row, w[feature] * scale, minlength=len(y)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance
        w -= rate * (np.bincount(feature, error[row] * scale, minlength=len(used)) + decay * w)
        bias -= rate * error.sum()
    weights[used], weights[-1] = w, bias
    return weights


def _score(model):
    def run(batches):
        weights = model.value
        for batch in batches:
            feature, row = _grams(batch["t"])
            n = batch.num_rows
            size = np.maximum(np.bincount(row, minlength=n), 1)
            z = np.bincount(row, weights[feature], minlength=n) / np.sqrt(size) + weights[-1]
            yield pa.record_batch([*(batch[c] for c in batch.schema.names if c != "t"), pa.array(z)], names=[*(c for c in batch.schema.names if c != "t"), "logit"])

    return run


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], weights: np.ndarray, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, logit) of every row.

    A null url, or one without `://`, has an empty host and path, so no rule
    fits and the classifier judges it by its bias. Repeated rows are judged
    alike, null ids stay null, an empty table gives no rows, a url of any length
    is judged whole, and other columns are left out, whatever their names.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    parts = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("t", _text(F.col("host"), F.col("path")))
    kind = dict(parts.dtypes)["id"]
    scored = parts.mapInArrow(_score(pages.sparkSession.sparkContext.broadcast(weights)), f"id {kind}, host string, path string, logit double")
    fit_rule = rule_for(F.col("host"), F.col("path"), rules)
    return scored.withColumn("r", fit_rule).select(
        F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.when(F.col("logit") > 0, "block").otherwise("allow")).alias("verdict"), "logit"
    )


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): the package's small table of hand-labelled invented URLs, label 1 for blocked ones."""
    lines = Path(__file__).with_name("labelled_urls.tsv").read_text(encoding="utf-8").splitlines()[1:]
    return spark.createDataFrame([(url, int(label)) for label, url in (line.split("\t") for line in lines)], "url string, label int")
