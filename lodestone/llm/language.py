"""Language identification by Bayesian fusion of evidence.

    P(language | row) ~ P(language | host) P(markup | language) P(address | language) P(text | language)^t

* Text: naive Bayes over hashed byte trigrams, with counts from at most FIT_ROWS rows of each known language
  (bounded samples chosen by a hash of the id, one text for each id). The log likelihoods of a text are a sum over all of it;
  t = EVIDENCE / (EVIDENCE + number of trigrams) keeps long texts from drowning the other evidence.
* Markup: the declared language agrees with the true one with probability MARKUP, else any other.
* Address: a country suffix of the host or a language code in the first part of the path, likewise (ADDRESS).
* Host prior: counts of what the text alone says, by grouped aggregation over ALL rows, smoothed down a
  hierarchy: everything, registered domain, host; each level has its parent's shares as STRENGTH pseudo-rows.

The counts are map-side combined, so a host with a third of all rows is no hot key. The evidence of the texts is
computed once, into a table of the shared folder. Priors are joined back by host: broadcast if they are few, else
only those of hosts with many rows are.

A row without any letter or evidence (null or empty text) has language 'und' and is rejected, as is one whose best
language has a probability under LEAST. Of equally likely languages the first by name is taken. Texts of any length
are read whole, in pieces; an empty table has no rows; repeated rows repeat. Extra columns pass through; input columns
with the names of results are replaced by them, other names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import BROADCAST_ROWS, by_rows, join_counted, named, others, ready, written
from lodestone.llm.words import raw

BITS = 16
#: Bytes of text looked at together; the work space of a worker is about 50 times this.
CHUNK = 1 << 18
#: Bound on the rows of each language that a fit looks at.
FIT_ROWS = 1_000
#: More languages than this are an error, so that the table of likelihoods stays small.
LANGUAGES = 200
EVIDENCE, MARKUP, ADDRESS, STRENGTH, LEAST = 40.0, 0.9, 0.8, 20.0, 0.5
#: Country suffixes and the language most used there.
SUFFIX = {
    "at": "de", "de": "de", "ch": "de", "es": "es", "mx": "es", "ar": "es", "co": "es", "cl": "es", "fr": "fr", "be": "fr",
    "uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en", "it": "it", "nl": "nl", "pt": "pt", "br": "pt", "pl": "pl",
    "ru": "ru", "jp": "ja", "cn": "zh", "kr": "ko", "se": "sv", "dk": "da", "no": "no", "fi": "fi", "cz": "cs", "tr": "tr",
}
_letter = np.zeros(256, bool)
_letter[65:91] = _letter[97:123] = _letter[128:] = True
#: Letters folded, every other byte a space.
_folded = np.where(_letter, np.arange(256), 32).astype(np.uint32)
_folded[65:91] += 32


class Languages(NamedTuple):
    names: list[str]
    table: np.ndarray  # 2^BITS x languages, log likelihoods


def _trigrams(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, number of rows, hashed trigrams, row of each counted from the first), for groups of rows.

    A text over CHUNK bytes comes as several groups of one row. Trigrams that hold two neighbouring bytes
    that aren't letters, or cross texts, are left out.
    """
    data, offsets = raw(col)
    rows, i = len(offsets) - 1, 0
    while i < rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        lo, hi = int(offsets[i]), int(offsets[j])
        for at in range(lo, max(hi, lo + 1), CHUNK) if j == i + 1 else (lo,):
            end = min(at + CHUNK + 2, hi) if j == i + 1 else hi
            b = data[at:end]
            if len(b) < 3:
                yield i, j - i, np.zeros(0, np.uint32), np.zeros(0, np.int32)
                continue
            row = np.repeat(np.arange(j - i, dtype=np.int32), np.diff(np.clip(offsets[i : j + 1], at, end)))
            x, lone = _folded[b], ~_letter[b]
            ok = (row[:-2] == row[2:]) & ~(lone[1:-1] & (lone[:-2] | lone[2:]))
            grams = (((x[:-2] * 131 + x[1:-1]) * 131 + x[2:]) * np.uint32(2654435761) >> 11) & ((1 << BITS) - 1)
            yield i, j - i, grams[ok], row[:-2][ok]
        i = j


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id") -> Languages:
    """Counts of trigrams by language, from a bounded sample of the rows whose language is known."""
    ready(docs.sparkSession)
    known = docs.where(F.col(lang).isNotNull() & (F.col(lang) != ""))
    known = known.select(named(text).alias("text"), named(lang).alias("lang"), named(key).alias("id")).where("id is not null")
    held = known.groupBy("lang").agg(F.approx_count_distinct("id").alias("n")).limit(LANGUAGES + 1).collect()
    if len(held) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not held:
        return Languages([], np.zeros((1 << BITS, 0), np.float32))
    # hashes under this share leave about twice FIT_ROWS ids of a language, so what is ranked is small, whatever there is
    share = F.create_map(*(F.lit(x) for r in held for x in (r.lang, 2.0 * FIT_ROWS / max(r.n, 1))))
    near = known.select("lang", "id", F.xxhash64("id").alias("h")).where(F.shiftrightunsigned("h", 11) * F.lit(2.0**-53) < share[F.col("lang")]).distinct()
    ids = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).where(F.col("rank") <= FIT_ROWS).select("lang", "id")
    rows = known.join(F.broadcast(ids), ["lang", "id"]).groupBy("lang", "id").agg(F.min("text").alias("text")).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            own = batch.column(1).dictionary_encode()
            place = own.indices.to_numpy()
            for first, _, grams, row in _trigrams(batch.column(0)):
                at = place[first + row]
                for k, x in enumerate(own.dictionary.to_pylist()):
                    counts[x] = counts.get(x, 0) + np.bincount(grams[at == k], minlength=1 << BITS)
        for x, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at])], ["lang", "gram", "n"])

    got = rows.mapInArrow(run, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(set(got["lang"]))
    counts = np.full((1 << BITS, len(names)), 0.5)
    for k, x in enumerate(names):
        own = got[got["lang"] == x]
        counts[own["gram"].to_numpy(), k] += own["n"].to_numpy()
    return Languages(names, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def text_evidence(rows: DataFrame, model: Languages, text: str = "text") -> DataFrame:
    """All columns but ``text``, then ll array<double>, the tempered log likelihoods, and n, the number of trigrams."""
    ready(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(model)  # 2^BITS x at most LANGUAGES numbers

    def make():
        names, table = sent.value
        columns = np.ascontiguousarray(table.T)

        def run(col: pa.Array) -> list[pa.Array]:
            total, count = np.zeros((len(col), len(names))), np.zeros(len(col), np.int64)
            for first, n, grams, row in _trigrams(col):
                each = np.bincount(row, minlength=n)
                count[first : first + n] += each
                if len(grams):
                    full = np.flatnonzero(each)
                    starts = (np.cumsum(each) - each)[full]
                    for k, one in enumerate(columns):
                        total[first + full, k] += np.add.reduceat(one[grams], starts, dtype=np.float64)
            total *= (EVIDENCE / (EVIDENCE + count))[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(col) + 1) * len(names), pa.int32()), pa.array(total.ravel()))
            return [lists, pa.array(count)]

        return run

    return by_rows(rows, [c for c in rows.columns if c != text], [named(text)], "ll array<double>, n bigint", make)


def _share(counts: Column, parent: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, parent, lambda c, p: (c + F.lit(STRENGTH) * p) / (total + F.lit(STRENGTH)))


def host_priors(scored: DataFrame, model: Languages) -> DataFrame:
    """(domain, host, rows, prior array<double>): shares of languages by host, smoothed by domain and everything."""
    best = F.when(F.col("n") > 0, F.array_position("ll", F.array_max("ll")))
    each = [F.sum(F.when(best == k + 1, 1.0).otherwise(0.0)).alias(f"c{k}") for k in range(len(model.names))]
    hosts = written(scored.groupBy("domain", "host").agg(F.count("*").alias("rows"), *each), "hosts")
    add = [F.sum(f"c{k}") for k in range(len(model.names))]
    domains = hosts.groupBy("domain").agg(F.count("*").alias("hosts"), F.array(*add).alias("__dc"))
    whole = hosts.agg(F.array(*(F.coalesce(x, F.lit(0.0)) for x in add)).alias("all")).first()["all"]
    n = sum(whole)
    top = F.array(*(F.lit((c + 1) / (n + len(whole))) for c in whole))
    hosts = hosts.select("domain", "host", "rows", F.array(*(F.col(f"c{k}") for k in range(len(model.names)))).alias("__hc"))
    joined = join_counted(hosts, domains, ["domain"], "hosts")
    return joined.select("domain", "host", "rows", _share(F.col("__hc"), _share(F.col("__dc"), top)).alias("prior"))


def _agrees(said: Column, names: Column, n: int, trust: float) -> Column:
    """Log likelihood of a declared language for each language; no evidence where none of them is declared."""
    rest = (1 - trust) / max(1, n - 1)
    one = F.transform(names, lambda x: F.when(x == said, F.lit(float(np.log(trust)))).otherwise(F.lit(float(np.log(rest)))))
    return F.when(said.isNotNull() & F.array_contains(names, said), one).otherwise(F.transform(names, lambda x: F.lit(0.0)))


NEW = "language string, confidence double, rejected boolean"


def identify(rows: DataFrame, model: Languages, text: Column, host: Column | None = None, domain: Column | None = None, markup: Column | None = None, address: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``rows`` (all), then language string, confidence double, rejected boolean."""
    none = F.lit(None).cast("string")
    host, domain, markup, address = (none if c is None else c for c in (host, domain, markup, address))
    keep = others(rows, NEW) if keep is None else keep
    if not model.names:
        return rows.select(*map(named, keep), F.lit("und").alias("language"), F.lit(0.0).alias("confidence"), F.lit(True).alias("rejected"))
    kept = [f"k{i}" for i in range(len(keep))]  # by position: no name can clash
    empty = F.lit("")
    base = rows.select(
        *(named(c).alias(k) for c, k in zip(keep, kept, strict=True)), F.coalesce(domain, empty).alias("domain"), F.coalesce(host, empty).alias("host"),
        markup.alias("markup"), address.alias("address"), text.alias("text"),
    )
    scored = written(text_evidence(base, model), "evidence")
    priors = written(host_priors(scored, model), "priors")
    few = priors.limit(BROADCAST_ROWS // len(model.names) + 1).count() <= BROADCAST_ROWS // len(model.names)
    joined = scored.join(F.broadcast(priors.drop("rows")), ["domain", "host"]) if few else join_counted(scored, priors, ["domain", "host"], "rows")
    names, n = F.array(*map(F.lit, model.names)), len(model.names)
    evidence = F.transform("prior", lambda p: F.log(p))
    for x in (F.col("ll"), _agrees(F.col("markup"), names, n, MARKUP), _agrees(F.col("address"), names, n, ADDRESS)):
        evidence = F.zip_with(evidence, x, lambda a, b: a + b)
    joined = joined.withColumn("e", evidence)
    joined = joined.withColumn("w", F.transform("e", lambda x: F.exp(x - F.array_max("e"))))
    known = (F.col("n") > 0) | F.array_contains(names, F.col("markup")) | F.array_contains(names, F.col("address"))
    known = F.coalesce(known, F.col("n") > 0)
    top = F.lit(1.0) / F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    joined = joined.withColumn("known", known).withColumn("top", F.when(F.col("known"), top).otherwise(0.0))
    language = F.when(F.col("known"), F.element_at(names, F.array_position("e", F.array_max("e")).cast("int"))).otherwise("und")
    return joined.select(*kept, language, "top", F.col("top") < LEAST).toDF(*keep, *(x.split()[0] for x in NEW.split(", ")))


def page_parts(url: Column, html: Column) -> dict[str, Column]:
    """The evidence of a web page: its visible text, host, registered domain, declared and addressed language."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([A-Za-z]{2})(?:[-_][A-Za-z]+)?(?:[/?#]|$)", 1))
    suffix = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    countries = F.create_map(*[F.lit(x) for pair in sorted(SUFFIX.items()) for x in pair])
    text = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[^>]*>", " ")
    return {
        "text": text, "host": host, "domain": F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1),
        "markup": F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)),
        "address": F.coalesce(F.nullif(path, F.lit("")), F.try_element_at(countries, suffix)),
    }
