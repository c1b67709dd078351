"""Language identification by fusing evidence in Bayes' way.

Character n-gram likelihoods of the text, the language that the markup declares and
priors of the host are multiplied. A host's prior is smoothed by that of its site, a site's by
that of its address suffix, and a suffix's by that of all pages; all are sums of the
texts' own posteriors by grouped aggregation, less the page's own share.
"""

from __future__ import annotations

import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import blocks
from .common import stored, text_column
from .html import main_text
from .ngrams import grams, joined, scores

SIZES, BITS = range(2, 5), 15
BLOCK_CHARS = 500_000
#: n-grams overlap: so many count as one observation, and so many observations at most.
OVERLAP, MOST = 6.0, 60.0
#: Pseudo-counts by which each level of the host hierarchy leans on the one above.
LEAN = 4.0
DECLARED = re.compile(r"<html\b[^>]*?\slang\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", re.I)


class Model:
    """log P(n-gram bucket | language), one column a language."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table

    def evidence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihoods up to a constant, n-grams) of each text."""
        sums, counts = scores(pa.array(texts, pa.large_string()), self.table, SIZES, BITS, len(self.languages))
        mean = sums / np.maximum(counts, 1)[:, None]
        log = mean * np.minimum(counts / OVERLAP, MOST)[:, None]
        return log - log.max(1, keepdims=True) if len(texts) else log, counts


def train(texts: list[str], labels: list[str]) -> Model:
    languages = sorted(set(labels))
    counts = np.full((1 << BITS, max(len(languages), 1)), 0.5)
    for text, label in zip(texts, labels):
        buf, _ = joined(pa.array([text], pa.string()))
        for _, bucket, fine in grams(buf, SIZES, BITS):
            np.add.at(counts[:, languages.index(label)], bucket[fine], 1)
    return Model(languages or ["und"], np.log(counts / counts.sum(0)).astype(np.float32))


def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", rows: int = 300, chars: int = 400_000, languages: int = 64) -> Model:
    """Train on a bounded sample: of each of the ``languages`` most frequent labels the
    first ``rows`` documents by hash, and of those, in that order, as many as
    hold ``chars`` bytes. Null labels and texts are left out."""
    known = docs.where(docs[label].isNotNull() & docs[text].isNotNull()).select(docs[key].alias("id"), docs[label].cast("string").alias("label"), text_column(docs, text).alias("text"))
    names = [r["label"] for r in known.groupBy("label").count().orderBy(F.desc("count"), "label").limit(languages).collect()]
    # the first rows of each label by hash, whatever their number: partitions pass on no more than ``rows`` of each
    first = Window.partitionBy("label").orderBy("h", "id", "n")
    hashed = known.where(F.col("label").isin(names)).select("id", "label", F.octet_length("text").alias("n"), F.xxhash64("id").alias("h"))
    picked = hashed.withColumn("k", F.row_number().over(first)).where(F.col("k") <= rows)
    spent, ids = {}, set()
    for r in sorted(picked.collect(), key=lambda r: (r["label"], r["k"])):
        if r["id"] is not None and spent.get(r["label"], 0) + r["n"] <= chars:
            spent[r["label"]] = spent.get(r["label"], 0) + r["n"]
            ids.add(r["id"])
    if not ids:
        return train([], [])
    got = known.where(F.col("id").isin(sorted(ids))).dropDuplicates(["id", "label", "text"]).orderBy("id", "label", "text").collect()
    got = [r for r in got if r["label"] in names]
    return train([r["text"] for r in got], [r["label"] for r in got])


def address(url: str | None) -> tuple[str, str, str]:
    """(host, site, suffix): the host's name, its last two parts and its last part."""
    try:
        host = (urlsplit(url if "//" in (url or "") else f"//{url or ''}").hostname or "").strip(".")
    except ValueError:
        host = ""
    parts = host.split(".")
    return host, ".".join(parts[-2:]), parts[-1]


def measured_pages(pages: DataFrame, model: Model, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(id, host, site, suffix, declared, n, log) of each page, by its main text."""
    shared = pages.sparkSession.sparkContext.broadcast((model.languages, model.table))

    def run(batches):
        own = Model(*shared.value)
        for part, texts in blocks(batches, 2, BLOCK_CHARS):
            log, n = own.evidence([main_text(t) for t in texts])
            where = [address(u) for u in part.column(1).to_pylist()]
            declared = [(m := DECLARED.search(t)) and m[1].lower() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array([w[i] for w in where], pa.string()) for i in range(3)], pa.array(declared, pa.string()),
                 pa.array(n.astype(np.int64)), pa.array(list(log), pa.list_(pa.float64()))], ["id", "host", "site", "suffix", "declared", "n", "log"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(pages[key].alias("id"), pages[url].cast("string").alias("url"), text_column(pages, page).alias("page")).mapInArrow(
        run, f"id {kind}, host string, site string, suffix string, declared string, n long, log array<double>")


def measured_texts(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The same of plain texts: the source stands for host, site and suffix; nothing is declared."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table))

    def run(batches):
        own = Model(*shared.value)
        for part, texts in blocks(batches, 2, BLOCK_CHARS):
            log, n = own.evidence(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n.astype(np.int64)), pa.array(list(log), pa.list_(pa.float64()))], ["id", "host", "n", "log"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(docs[key].alias("id"), F.coalesce(docs[source].cast("string"), F.lit("")).alias("host"), text_column(docs, text).alias("text")).mapInArrow(
        run, f"id {kind}, host string, n long, log array<double>")
    return out.select("id", "host", F.lit("").alias("site"), F.lit("").alias("suffix"), F.lit(None).cast("string").alias("declared"), "n", "log")


def fuse(measured: DataFrame, languages: list[str], least: float = 0.5) -> DataFrame:
    """(id, host, declared, lang, probability, accepted).

    ``lang`` is the likeliest language (of equals the first by name), ``und`` where there is no
    n-gram at all. Accepted are rows with some n-gram and a probability of ``least`` or more.
    """
    spark = measured.sparkSession
    L = range(len(languages))
    soft = F.transform("log", lambda x: F.exp(x))
    whole = F.aggregate(soft, F.lit(0.0), lambda a, x: a + x)
    table = measured.select("*", *[F.when(F.col("n") > 0, F.exp(F.col("log")[k]) / whole).otherwise(0.0).alias(f"s{k}") for k in L])
    table = stored(table, "evidence")
    add = [F.sum(f"s{k}").alias(f"c{k}") for k in L]
    # hosts, then sites, then suffixes, each summed from the level below; all are stored, so that joins with them can be split
    hosts = stored(table.groupBy("host", "site", "suffix").agg(*add), "hosts")
    up = [F.sum(f"c{k}") for k in L]
    sites = stored(hosts.groupBy("site", "suffix").agg(*[u.alias(f"b{k}") for k, u in enumerate(up)]), "sites")
    suffixes = stored(sites.groupBy("suffix").agg(*[F.sum(f"b{k}").alias(f"a{k}") for k in L]), "suffixes")
    total = suffixes.agg(*[F.sum(f"a{k}").alias(f"t{k}") for k in L]).first()
    t = [total[k] or 0.0 for k in L]
    levels = stored(hosts.join(sites, ["site", "suffix"]).join(suffixes, "suffix"), "levels").drop("site", "suffix")
    # two or three letters each, so their number is bounded
    said = table.where("declared is not null").groupBy("declared").agg(*[F.sum(f"s{k}").alias(f"d{k}") for k in L])
    said = stored(said, "declared")
    sums = said.agg(F.count("*").alias("n"), *[F.sum(f"d{k}").alias(f"d{k}") for k in L]).first()
    rows = table.join(levels, "host").join(F.broadcast(said), "declared", "left")

    def prior(k):
        own = F.col(f"s{k}")
        p = (F.lit(t[k] + 1.0) - own) / F.lit(sum(t) + len(languages))
        for c in "abc":
            n = sum((F.col(f"{c}{j}") - F.col(f"s{j}") for j in L), F.lit(0.0))
            p = (F.greatest(F.col(f"{c}{k}") - own, F.lit(0.0)) + LEAN * p) / (F.greatest(n, F.lit(0.0)) + LEAN)
        return p

    def declared(k):
        own = F.greatest(F.col(f"d{k}") - F.col(f"s{k}"), F.lit(0.0))
        return F.when(F.col("declared").isNull(), 0.0).otherwise(F.log((own + 0.5) / (F.lit((sums[f"d{k}"] or 0.0) + 0.5 * (sums["n"] + 1)))))

    rows = rows.withColumn("p", F.array(*[F.col("log")[k] + F.log(prior(k)) + declared(k) for k in L]))
    rows = rows.withColumn("top", F.array_max("p")).withColumn("best", F.array_position("p", F.col("top")))
    sure = 1 / F.aggregate(F.transform("p", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    names = F.array(*[F.lit(x) for x in languages])
    return rows.select("id", "host", "declared", F.when(F.col("n") > 0, F.element_at(names, F.col("best").cast("int"))).otherwise("und").alias("lang"),
                       sure.alias("probability"), ((F.col("n") > 0) & (sure >= least)).alias("accepted"))


def page_languages(pages: DataFrame, model: Model, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, host, declared, lang, probability, accepted) for every page.

    A null page counts as empty: no text evidence, so it is ``und`` and not accepted. A null or broken
    address has the empty host. Repeated rows and null keys are rows of their own; of languages that are equally likely the first
    by name is returned; pages are read whole, however long; other columns aren't read, whatever their names; an empty table gives no rows.
    """
    return fuse(measured_pages(pages, model, key, url, page), model.languages).withColumnRenamed("id", key)


def text_languages(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The same for plain texts, whose source takes the host's place."""
    return fuse(measured_texts(docs, model, key, text, source), model.languages).drop("declared").withColumnsRenamed({"id": key, "host": source})
