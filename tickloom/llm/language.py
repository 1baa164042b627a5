"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence are put together as logarithms: how likely each language makes the text (byte trigrams, counted
from texts whose language is known), how often pages in it declare the language that this one declares in its markup, how
often their addresses have this suffix, and the share of languages of the host before anything is known of the page.
The shares of a host are smoothed with those of its domain, and these with those of all pages, so a host with few
pages leans on what is around it. Counts behind the last three come from grouped aggregations over the pages themselves,
with the language the text alone suggests; a row's own count is taken out again before it is judged.

A text that no language explains better than bytes drawn at random counts against all of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import staged, text_bytes

CELLS = 1 << 14  # counts of trigrams, hashed
LANGUAGES = 100  # scored at once; more are scored in several blocks
ENOUGH_GRAMS = 300  # more text than this adds no more certainty
PSEUDO = 5.0  # rows that smoothing adds at each level
LEAST_POSTERIOR = 0.5
NONE = "und"

MARKUP = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")


# Digits and marks say nothing about the language: numbers, addresses and keys in a text are passed over.
LETTERS = bytes(byte if byte >= 128 or chr(byte).isalpha() else 32 for byte in range(256))


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all trigrams of letters and gaps, each text with a space around it, and how many each text has."""
    padded = [b" " + b" ".join(text.translate(LETTERS).lower().split()) + b" " for text in texts]
    data = np.frombuffer(b"".join(padded) + b"  ", dtype=np.uint8).astype(np.int32)
    cells = (data[:-2] * 7919 + data[1:-1] * 271 + data[2:] * 9173) % CELLS
    return cells, np.array([len(text) for text in padded])


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, cell, n) of (text, lang); rows without either are left out."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                cells, _ = grams([text_bytes(text) for text in texts])
                totals[lang] = totals.get(lang, 0) + np.bincount(cells, minlength=CELLS)
                if len(totals) >= LANGUAGES:
                    yield from listed(totals)
                    totals = {}
        yield from listed(totals)

    def listed(totals: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        for lang, counts in totals.items():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "cell": at.astype(np.int32), "n": counts[at]})

    known = labelled.where("text is not null and lang is not null").select("text", "lang")
    counted = known.mapInPandas(count, "lang string, cell int, n long")
    return counted.groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def likelihoods(labelled: DataFrame) -> Iterator[tuple[list[str], np.ndarray, bool]]:
    """Blocks of all languages, for each cell the logarithm of its share in them, and whether it is the last block.

    The most frequent come first; a block is bounded by LANGUAGES * CELLS numbers.
    """
    names = labelled.where("lang is not null and text is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    names = [row["lang"] for row in names.orderBy(F.desc("n"), "lang").collect()]
    grams_found = staged(gram_counts(labelled), "language-grams") if names else None
    for begin in range(0, len(names), LANGUAGES):
        block = names[begin : begin + LANGUAGES]
        counts = np.zeros((len(block), CELLS))
        found = grams_found.where(F.col("lang").isin(block)).toPandas()
        counts[found["lang"].map({name: at for at, name in enumerate(block)}).to_numpy(int), found["cell"].to_numpy(int)] = found["n"]
        yield block, np.log((counts + 0.5) / (counts.sum(axis=1) + 0.5 * CELLS)[:, None]), begin + LANGUAGES >= len(names)


def text_evidence(rows: DataFrame, shares: np.ndarray, markup: bool, chance: bool) -> DataFrame:
    """Adds ``evidence``, log-likelihoods by language and with ``chance`` that of bytes at random; all zero for no text."""
    columns = [name for name in rows.columns if name != "text"]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            texts = [MARKUP.sub(" ", text) if markup and text else text for text in batch["text"]]
            cells, each = grams([text_bytes(text) for text in texts])
            begins = np.cumsum(each) - each
            at_random = [each * -np.log(CELLS)] * chance
            sums = np.stack([np.add.reduceat(share[cells], begins) for share in shares] + at_random, axis=1)
            sums *= (np.minimum(each, ENOUGH_GRAMS) / each)[:, None]
            sums[each <= 2] = 0
            yield batch[columns].assign(evidence=list(sums))

    schema = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes if name != "text")
    return rows.mapInPandas(of, f"{schema}, evidence array<double>")


def identify(rows: DataFrame, labelled: DataFrame, markup: bool = False) -> DataFrame:
    """(row_id, text_lang, lang, posterior, accepted) for ``rows`` (row_id, text, declared, suffix, host, domain).

    ``labelled`` (text, lang) teaches the text likelihoods. Rows that share a row_id must be equal and come out once. Null evidence says nothing: a null
    text, declaration or suffix leaves the others to decide, a null host has the shares of null hosts. A row is
    accepted if a language, and not chance, has more than LEAST_POSTERIOR; otherwise ``lang`` is "und".
    Without any labelled text nothing is accepted.
    """
    keys = ["row_id", "declared", "suffix", "host", "domain"]
    names, read = [], None
    for block, shares, last in likelihoods(labelled):
        names += block
        if read is None:
            read = staged(text_evidence(rows.select(*keys, "text"), shares, markup, last), "language-evidence")
            continue
        more = text_evidence(rows.select("row_id", "text").dropDuplicates(["row_id"]), shares, markup, last)
        more = more.withColumnRenamed("evidence", "more")
        read = read.join(more, "row_id").withColumn("evidence", F.concat("evidence", "more")).drop("more")
        read = staged(read, "language-evidence")
    if read is None:
        return rows.select(
            "row_id", F.lit(NONE).alias("text_lang"), F.lit(NONE).alias("lang"), F.lit(0.0).alias("posterior"), F.lit(False).alias("accepted")
        )
    labels = F.array(*[F.lit(name) for name in [*names, NONE]])
    best = F.array_position(F.col("evidence"), F.array_max("evidence")).cast("int")
    blank = F.forall("evidence", lambda x: x == 0)
    read = read.withColumn("text_lang", F.when(~blank, F.element_at(labels, best)))
    sure = read.where(F.col("text_lang").isNotNull())
    levels = {
        "declared": ["declared"], "suffix": ["suffix"], "host": ["host", "domain"], "domain": ["domain"], "all": [],
    }
    counts = {name: staged(_counted(sure, name, by), f"language-{name}") for name, by in levels.items()}
    each = read.dropDuplicates(["row_id"]).select(*keys, "text_lang", F.posexplode(F.arrays_zip(labels.alias("language"), F.col("evidence").alias("likely"))))
    each = each.select(*keys, "text_lang", F.col("col.language").alias("language"), F.col("col.likely").alias("likely"))
    own = F.when(F.col("text_lang") == F.col("language"), 1).otherwise(0)
    seen = F.when(F.col("text_lang").isNotNull(), 1).otherwise(0)
    for name, by in levels.items():
        each = _joined(each, counts[name], name, by)
    kinds = len(names) + 1

    def count(name: str) -> Column:
        return F.greatest(F.coalesce(F.col(f"{name}_n"), F.lit(0)) - own, F.lit(0))

    def total(name: str) -> Column:
        return F.greatest(F.coalesce(F.col(f"{name}_total"), F.lit(0)) - seen, F.lit(0))

    share = (count("all") + PSEUDO / kinds) / (total("all") + PSEUDO)
    for level in ("domain", "host"):
        share = (count(level) + PSEUDO * share) / (total(level) + PSEUDO)
    # Of pages in the language, the part that declares what this one does, or has its suffix.
    said = [
        F.when(F.col(name).isNull(), 0.0).otherwise(F.log((count(name) + 0.5) / (count("all") + 0.5 * PSEUDO)))
        for name in ("declared", "suffix")
    ]
    each = each.withColumn("log_score", F.col("likely") + F.log(share) + said[0] + said[1])
    summed = each.groupBy("row_id").agg(
        F.max("log_score").alias("top"),
        F.max_by("language", F.struct("log_score", "language")).alias("best"),
        F.collect_list("log_score").alias("log_scores"),
        F.first("text_lang").alias("text_lang"),
    )
    parts = F.aggregate("log_scores", F.lit(0.0), lambda total, x: total + F.exp(x - F.col("top")))
    summed = summed.withColumn("posterior", 1 / parts)
    accepted = (F.col("best") != NONE) & (F.col("posterior") > LEAST_POSTERIOR)
    lang = F.when(accepted, F.col("best")).otherwise(NONE)
    return summed.select("row_id", F.coalesce("text_lang", F.lit(NONE)).alias("text_lang"), lang.alias("lang"), "posterior", accepted.alias("accepted"))


def _counted(sure: DataFrame, name: str, by: list[str]) -> DataFrame:
    """Rows of each language and key, and of each key in all languages."""
    counted = sure.groupBy(*by, "text_lang").agg(F.count(F.lit(1)).alias(f"{name}_n"))
    return counted.select(*[F.col(key).alias(f"{name}_{key}") for key in by], F.col("text_lang").alias(f"{name}_language"), f"{name}_n")


def _joined(each: DataFrame, counted: DataFrame, name: str, by: list[str]) -> DataFrame:
    same = [F.col(key).eqNullSafe(F.col(f"{name}_{key}")) for key in by]
    exact = [*same, F.col("language") == F.col(f"{name}_language")]
    keys = [f"{name}_{key}" for key in by]
    totals = counted.groupBy(*keys).agg(F.sum(f"{name}_n").alias(f"{name}_total"))
    totals = totals.select(*[F.col(key).alias(f"{key}_of_total") for key in keys], f"{name}_total")
    joined = each.join(counted, _all(exact), "left").drop(*keys, f"{name}_language")
    if not by:
        return joined.withColumn(f"{name}_total", F.lit(totals.first()[0] or 0))
    match = [F.col(key).eqNullSafe(F.col(f"{name}_{key}_of_total")) for key in by]
    return joined.join(totals, _all(match), "left").drop(*[f"{key}_of_total" for key in keys])


def _all(conditions: list[Column]) -> Column:
    found = conditions[0]
    for condition in conditions[1:]:
        found = found & condition
    return found


def page_evidence(pages: DataFrame) -> DataFrame:
    """(row_id, page_id, text, declared, suffix, host, domain) of pages (page_id, url, html)."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    declared = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    found = pages.select(
        F.monotonically_increasing_id().alias("row_id"), "page_id", F.col("html").alias("text"),
        F.nullif(declared, F.lit("")).alias("declared"), F.nullif(host, F.lit("")).alias("host"),
    )
    labels = F.split("host", r"\.")
    suffix = F.when(F.size(labels) > 1, F.element_at(labels, -1))
    domain = F.when(F.size(labels) > 1, F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2))).otherwise(F.col("host"))
    return found.withColumns({"suffix": suffix, "domain": domain})


def identify_pages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """(page_id, host, declared, suffix, text_lang, lang, posterior, accepted) of every row of ``pages``."""
    rows = staged(page_evidence(pages), "language-pages")
    found = identify(rows, labelled, markup=True)
    return rows.select("row_id", "page_id", "host", "declared", "suffix").join(found, "row_id").drop("row_id")


def decide_documents(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """(row_key, lang_found, posterior, accepted) of documents, equal ones once; ``row_key`` joins them again.

    The source stands for the host, and lang for the declaration.
    """
    none = F.lit(None).cast("string")
    evidence = docs.select(
        row_key().alias("row_id"), "text", F.lower("lang").alias("declared"), none.alias("suffix"), F.col("source").alias("host"),
        none.alias("domain"),
    )
    found = identify(evidence, labelled)
    return found.select(F.col("row_id").alias("row_key"), F.col("lang").alias("lang_found"), "posterior", "accepted")


def row_key() -> Column:
    """One text for all that decides about a document."""
    parts = [F.xxhash64(F.col(name), F.col(name).isNull()) for name in ("text", "lang", "source")]
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.hex(F.xxhash64(*parts)))


def language_query(spark, sf_dir: str) -> DataFrame:
    """page_id, host, declared, suffix, text_lang, lang, posterior, accepted of all pages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang")
    return identify_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), docs)
