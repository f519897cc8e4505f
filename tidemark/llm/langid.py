"""Language of web pages: Bayesian fusion of text, declared markup language, address suffix and host.

Text: multinomial naive Bayes over byte trigrams in 2^15 buckets, fitted on about `train_docs` labelled documents of
each language, whatever the size of the table (chosen by their texts' hash); its log-likelihoods are tempered, since neighbouring trigrams are not independent.
The text alone gives each page a posterior. Grouped sums of these over all pages then give what a declared language
and an address suffix say about the language (smoothed likelihoods), and a prior for each host, smoothed towards its
domain's, which is smoothed towards all pages'. A page's own share is taken out of every sum before it is used. The
fused posterior is text x markup x suffix x host prior.

Sums are pre-aggregated before they are shuffled. Declared languages and suffixes are tables of two- and
three-letter codes, at most 18,279 rows, so they may be broadcast; hosts and domains are joined by key, where Spark splits large keys.

Defined results: null or empty html has no text evidence; a page without declared language, suffix or host takes what
such pages have in common; pages that repeat are pages of their own; without labelled documents the language is null;
an empty table gives an empty one; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.llm.html_text import blocks

BUCKETS = 1 << 15
#: ISO 639 has fewer languages with a two-letter code; a model has 256 KB for each.
MOST_LANGUAGES = 1024
DECLARED = re.compile(r"<html\b[^>]*?\b(?:xml:)?lang\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b|<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", re.I)


def trigram_buckets(text: str) -> np.ndarray:
    raw = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    code = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    log_p: np.ndarray  # buckets x languages

    def score(self, text: str, temper: float, most: float) -> np.ndarray:
        """Tempered log-likelihoods, at most `most` apart."""
        found = self.log_p[trigram_buckets(text)].sum(axis=0) * temper
        return np.maximum(found - found.max(), -most) if len(found) else found


def fit_text(df: DataFrame, text: str = "text", label: str = "lang", train_docs: int = 1500) -> TextModel:
    """Naive Bayes from about train_docs rows of each label (all, if there are fewer): those whose text's hash falls below a share."""
    rows = df.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{label}`").cast("string").alias("label")).where("text is not null and label is not null")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:  # before any is left out
        raise ValueError(f"more than {MOST_LANGUAGES} distinct labels: {label} does not hold languages")
    names = sorted(sizes)
    counts = np.full((BUCKETS, len(names)), 0.5)
    if not names:
        return TextModel((), counts)
    hashed = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    chosen = [(F.col("label") == n) & (hashed < F.lit(int(min(1.0, train_docs / sizes[n]) * (1 << 30)))) for n in names]
    sample = rows.where(reduce(or_, chosen))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, np.ndarray] = {}
            for t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.setdefault(n, np.zeros(BUCKETS, np.int64))
                seen[n] += np.bincount(trigram_buckets(t), minlength=BUCKETS)
            for n, c in seen.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], names=["label", "bucket", "n"])

    table = sample.mapInArrow(count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    for r in table.collect():  # at most buckets x languages rows
        counts[r["bucket"], names.index(r["label"])] += r["n"]
    return TextModel(tuple(names), np.log(counts / counts.sum(axis=0)))


def identify(df: DataFrame, model: TextModel, page_id: str = "page_id", url: str = "url", page: str = "html", temper: float = 0.05, most: float = 12.0, weight: float = 4.0) -> DataFrame:
    """page_id, url, lang, probability, text_lang, declared, suffix and host; weight is the smoothing, in pages."""
    names = model.languages
    address = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    host = F.regexp_replace(F.lower(F.regexp_extract(address, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), r"^[^@]*@|:[0-9]*$", "")
    kept = df.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), host.alias("host"), F.col(f"`{page}`").cast("string").alias("page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                b = batch.slice(lo, 500)
                declared, scores = [], []
                for x in b.column(3).to_pylist():
                    m = DECLARED.search(x or "")
                    declared.append((m[1] or m[2]).lower() if m else "")
                    own, every, _ = blocks(x or "")
                    scores.append(model.score("\n".join(own or every), temper, most).tolist())
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(declared, pa.string()), pa.array(scores, pa.list_(pa.float64()))], names=["page_id", "url", "host", "declared", "score"])

    scored = kept.mapInArrow(run, "page_id long, url string, host string, declared string, score array<double>")
    if not names:
        none = F.lit(None).cast("string")
        return scored.select("page_id", "url", none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), "declared", none.alias("suffix"), "host")
    size = range(len(names))
    e = [F.exp(F.get("score", F.lit(i))) for i in size]
    total = sum(e[1:], e[0])
    last = F.regexp_extract("host", r"\.([a-z]{2,3})$", 1)
    # under a country's suffix, co, com, org and the like are part of the suffix
    domain = F.regexp_extract("host", r"([^.]+\.(?:(?:ac|co|com|edu|gob|gov|ne|net|or|org)\.[a-z]{2}|[^.]+))$", 1)
    base = written(scored.select("page_id", "url", "host", F.when(domain == "", F.col("host")).otherwise(domain).alias("domain"), last.alias("suffix"), "declared", "score", *[(x / total).alias(f"p{i}") for i, x in enumerate(e)]), "langid-pages")
    sums = lambda by, tag: base.groupBy(by).agg(*[F.sum(f"p{i}").alias(f"{tag}{i}") for i in size])
    everything = base.agg(*[F.sum(f"p{i}").alias(f"a{i}") for i in size]).first()
    a = [float(everything[f"a{i}"] or 0.0) for i in size]
    all_pages = sum(a)
    hosts = base.groupBy("host", "domain").agg(*[F.sum(f"p{i}").alias(f"h{i}") for i in size])
    domains = hosts.groupBy("domain").agg(*[F.sum(f"h{i}").alias(f"d{i}") for i in size])
    hosts = hosts.join(domains, "domain").drop("domain")
    joined = base.join(hosts, "host").join(F.broadcast(sums("declared", "m")), "declared").join(F.broadcast(sums("suffix", "s")), "suffix")
    own = [F.col(f"p{i}") for i in size]

    def less(tag: str) -> list:
        return [F.greatest(F.col(f"{tag}{i}") - own[i], F.lit(0.0)) for i in size]

    def smoothed(counts: list, prior: list) -> list:
        n = sum(counts[1:], counts[0])
        return [(c + p * weight) / (n + weight) for c, p in zip(counts, prior, strict=True)]

    whole = [(F.lit(x + 1.0) - p) / (all_pages + len(names) - 1.0) for x, p in zip(a, own, strict=True)]
    by_host = smoothed(less("h"), smoothed(less("d"), whole))
    # what a declaration or a suffix says: P(value | language), up to a factor that all languages share
    markup = [(c + weight * w) / F.lit(x + 1.0) for c, w, x in zip(less("m"), whole, a, strict=True)]
    suffix = [(c + weight * w) / F.lit(x + 1.0) for c, w, x in zip(less("s"), whole, a, strict=True)]
    fused = [F.get("score", F.lit(i)) + F.log(by_host[i] + 1e-12) + F.log(markup[i] + 1e-12) + F.log(suffix[i] + 1e-12) for i in size]
    told = joined.select("page_id", "url", "declared", "suffix", "host", "score", *[f.alias(f"f{i}") for i, f in enumerate(fused)])
    best = F.greatest(*[F.col(f"f{i}") for i in size]) if len(names) > 1 else F.col("f0")
    top = F.greatest(*[F.get("score", F.lit(i)) for i in size]) if len(names) > 1 else F.get("score", F.lit(0))
    pick = lambda value, of: F.coalesce(*[F.when(value == of(i), F.lit(n)) for i, n in enumerate(names)])
    spread = [F.exp(F.col(f"f{i}") - best) for i in size]
    return told.select(
        "page_id",
        "url",
        pick(best, lambda i: F.col(f"f{i}")).alias("lang"),
        (F.lit(1.0) / sum(spread[1:], spread[0])).alias("probability"),
        pick(top, lambda i: F.get("score", F.lit(i))).alias("text_lang"),
        "declared",
        "suffix",
        "host",
    )
