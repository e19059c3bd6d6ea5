"""How the sources of a language differ: divergences of their smoothed term distributions, and the terms that set each apart.

A sum over all kept terms splits by support.  Terms that only one of two sources has are priced from that source's histogram of
counts; terms that both have are found by joining postings, and correct what the two histograms said of them; all others
cost one constant.  No term is paired with a source that lacks it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stash
from .text import LOWER, chunks

# Fixed values of the measure.
SCALE, TOP = 1_000_000_000, 200
TERM = "[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Terms that a task counts before it gives the counts out, and code points of a text that are split at once.
HELD, PIECE = 200_000, 1 << 20
#: Parts of a group whose top terms are found alone.
SALTS = 64
LANG, GROUP = ["lang"], ["lang", "source"]


def named(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUP), "text")


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, term, n, docs`` of rows ``lang, source, text``: occurrences of a term, and documents that have it.

    Counted in dictionaries of at most some ``HELD`` terms and those of one document; A-Z and nothing else is lower-cased.
    """
    find = re.compile(TERM)
    said: dict[tuple, tuple[Counter, Counter]] = {}

    def given() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in said.items():
            size, found = len(n), list(n)
            columns = [pa.array([lang]).take(pa.array(np.zeros(size, np.int32))), pa.array([source]).take(pa.array(np.zeros(size, np.int32))), pa.array(found, pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        said.clear()

    for batch in chunks(batches):
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if not text:
                continue
            n, docs = said.setdefault((lang, source), (Counter(), Counter()))
            low = text.encode().translate(LOWER).decode()
            at, own = 0, set()
            while at < len(low):  # pieces end between terms
                end = min(len(low), at + PIECE)
                rest = find.match(low, end)
                end = rest.end() if rest else end
                terms = find.findall(low, at, end)
                n.update(terms)
                own.update(terms)
                at = end
            docs.update(own)
        if sum(len(n) for n, _ in said.values()) > HELD:
            yield from given()
    yield from given()


def postings(docs: DataFrame, least: int) -> DataFrame:
    """``lang, source, term, n, total, leads``: a kept term's occurrences in a source and in its language; one row of a term leads.

    A term is kept in a language where ``least`` documents have it.
    """
    counts = named(docs).mapInArrow(counted, "lang string, source string, term string, n bigint, docs bigint").groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    known = counts.withColumns({"all_docs": F.sum("docs").over(term), "total": F.sum("n").over(term), "leads": F.row_number().over(term.orderBy("source")) == 1})
    return known.where(F.col("all_docs") >= least).select(*GROUP, "term", "n", "total", "leads")


def share(n: Column, size: Column, kept: Column) -> Column:
    """``1 + floor(SCALE * (n + 1) / (size + kept))`` in whole numbers, for counts up to 10^20."""
    scaled = (n.cast("decimal(20,0)") + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return 1 + F.call_function("div", scaled, (size + kept).cast("decimal(20,0)"))


def gap(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / q)``: whole numbers below 10^18 + 1."""
    p, q = p.cast("long"), q.cast("long")
    return F.call_function("div", (p - q) * (p - q), q)


def sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Of every group that occurs: ``size`` (occurrences of kept terms), ``support`` (terms it has), ``lang_size``, ``kept`` (terms of the language), ``p0`` (share of a term it lacks)."""
    by_group = kept.groupBy(*GROUP).agg(F.sum("n").alias("size"), F.count("*").alias("support"), F.sum(F.col("leads").cast("long")).alias("lead"))
    groups = named(docs).select(*GROUP).distinct().join(by_group, GROUP, "left").na.fill(0, ["size", "support", "lead"])
    lang = Window.partitionBy("lang")
    groups = groups.withColumns({"lang_size": F.sum("size").over(lang), "kept": F.sum("lead").over(lang)})
    return groups.withColumn("p0", F.when(F.col("kept") > 0, share(F.lit(0), F.col("size"), F.col("kept")))).drop("lead")


def pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value``: of each source against each other one of its language."""
    priced = kept.join(groups.select(*GROUP, "size", "kept", "p0"), GROUP)
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("support").alias("item_support"))
    apart = F.col("source") != F.col("item")
    constant = F.coalesce((F.col("kept") - F.col("support") - F.col("item_support")) * gap(F.col("p0"), F.col("q0")), F.lit(0))
    none = groups.join(other, LANG).where(apart).select(*GROUP, "item", constant.cast("long").alias("value"))
    # Terms of one side, as many as its histogram has of each count.
    histogram = kept.groupBy(*GROUP, "n").agg(F.count("*").alias("terms")).join(groups.select(*GROUP, "size", "kept"), GROUP)
    histogram = histogram.select(*GROUP, "terms", share(F.col("n"), F.col("size"), F.col("kept")).alias("p"))
    one = histogram.join(other, LANG).where(apart)
    one = one.groupBy(*GROUP, "item").agg(F.sum(F.col("terms") * gap(F.col("p"), F.col("q0"))).alias("mine"), F.sum(F.col("terms") * gap(F.col("q0"), F.col("p"))).alias("theirs"))
    # Terms of both: both histograms and the constant have priced them.
    a = priced.select("lang", "term", "source", share(F.col("n"), F.col("size"), F.col("kept")).alias("p"), "p0")
    b = a.withColumnsRenamed({"source": "item", "p": "q", "p0": "q0"})
    fix = lambda p, p0, q, q0: gap(p, q) - gap(p, q0) - gap(p0, q) + gap(p0, q0)
    p, p0, q, q0 = (F.col(c) for c in ("p", "p0", "q", "q0"))
    common = a.join(b, ["lang", "term"]).where(F.col("source") < F.col("item"))
    common = common.groupBy(*GROUP, "item").agg(F.sum(fix(p, p0, q, q0)).alias("mine"), F.sum(fix(q, q0, p, p0)).alias("theirs"))
    # `mine`: against the other; `theirs`: the other against this one.
    parts = one.unionByName(common)
    turned = F.explode(F.array(F.struct("source", "item", F.col("mine").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("theirs").alias("value"))))
    return parts.select("lang", turned.alias("v")).select("lang", "v.*").unionByName(none).groupBy(*GROUP, "item").agg(F.sum("value").alias("value"))


def top_terms(kept: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """``lang, source, item, value, rank``: the terms that a source has more of than its language."""
    p, q = share(F.col("n"), F.col("size"), F.col("kept")), share(F.col("total"), F.col("lang_size"), F.col("kept"))
    above = kept.join(groups, GROUP).withColumns({"p": p, "q": q}).where("p > q").select(*GROUP, F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    best = [F.desc("value"), F.asc("item")]
    salted = above.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)))
    salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*GROUP, "salt").orderBy(*best))).where(F.col("rank") <= top).drop("rank", "salt")
    return salted.withColumn("rank", F.row_number().over(Window.partitionBy(*GROUP).orderBy(*best))).where(F.col("rank") <= top)


def audit(docs: DataFrame, least: int = 3, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: every other source (``pair``) and the ``top`` terms (``term``) of each source.

    Null text, lang and source count as ''.  ``value`` sums floor((p - q)^2 / q) over the terms that at least ``least`` documents of the
    language have, with p = 1 + floor(10^9 (count + 1) / (size + terms)): whole numbers throughout.  Sums stay below 2^63 up to some
    10^8 terms a language; beyond, Spark raises an error.  Ranks are by value, then item.  Repeated rows count as documents of their own.
    A language without kept terms has pairs of value 0; an empty table gives no rows.
    """
    kept = stash(postings(docs, least), "postings")
    groups = stash(sizes(docs, kept), "groups")
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), F.asc("item")))
    pair = pairs(kept, groups).withColumn("rank", rank).withColumn("part", F.lit("pair"))
    return pair.unionByName(top_terms(kept, groups, top).withColumn("part", F.lit("term"))).select(*GROUP, "part", "item", "value", "rank")
