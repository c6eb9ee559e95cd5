"""Source divergence audit: how the words of each source of a language differ from those of its other sources.

The steps are those of a count vectorizer for each language and of a summarizer, on tables: pyspark.ml's own keeps its vocabulary on
the driver and broadcasts it, and a vocabulary without a limit (vocabSize at its largest integer) has no proven bound.
Each document becomes a sparse vector of term counts; vectors are summed by (lang, source) inside the tasks, with the number of documents
of each term; terms of MIN_DF documents or more of a language are its vocabulary. Pairs of sources are compared by the terms that occur in
both, by counts of counts for those that occur in one, and by one product for all others. All arithmetic is on integers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duovox.llm.common import ready, stash

MIN_DF = 3
RANKS = 200
SCALE = 1_000_000_000
#: Bytes outside of terms become spaces, A-Z lower case: bytes of 128 and more belong to letters of other scripts and stay.
TERMS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Entries of sums that a task holds before it hands them on, and pairs of terms and sources in one array.
HELD, CHUNK = 200_000, 1 << 20


def sparse_vector(data: bytes) -> Counter:
    """A document's terms with their counts."""
    return Counter(data.translate(TERMS).split())


def group_sums(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, df: sums of the documents' vectors, and documents that hold the term, for each group; partial sums of tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, held = defaultdict(lambda: (Counter(), Counter())), 0

        def out() -> pd.DataFrame:
            parts = [(lang, source, [t.decode("utf-8", "replace") for t in counts], [*counts.values()], [dfs[t] for t in counts]) for (lang, source), (counts, dfs) in sums.items()]
            rows = {"lang": [p[0] for p in parts for _ in p[2]], "source": [p[1] for p in parts for _ in p[2]]}
            return pd.DataFrame(rows | {n: [v for p in parts for v in p[k]] for k, n in enumerate(("term", "count", "df"), 2)})

        for f in frames:
            for lang, source, data in zip(f["lang"], f["source"], f["text"]):
                vector = sparse_vector(data)
                counts, dfs = sums[lang, source]
                before = len(counts)
                counts.update(vector)
                dfs.update(vector.keys())
                held += len(counts) - before
            if held > HELD:
                yield out()
                sums.clear()
                held = 0
        if sums:
            yield out()

    return docs.mapInPandas(run, "lang string, source string, term string, count long, df long")


def scaled(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + size)), exact for counts of any size."""
    wide = (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", wide, (total + size).cast("decimal(20,0)")) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)"""
    return F.call_function("div", (p - q) * (p - q), q)


def shared_pairs(vocabulary: DataFrame) -> DataFrame:
    """lang, source, item, value: for every two sources, over the terms that both hold, what the terms add beyond the sums that take each
    source alone. vocabulary: lang and entries (source, p, p0), one for each source that holds a term.

    The pairs of a term live only inside arrays of bounded size; a task hands on its sums by pair of sources.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, str, str], int] = defaultdict(int)
        for f in frames:
            sizes = np.array([len(e) for e in f["entries"]])
            flat = [x for e in f["entries"] for x in e]
            if not flat:
                continue
            names, source = np.unique(np.array([x["source"] for x in flat], object), return_inverse=True)
            langs, lang = np.unique(f["lang"].to_numpy(object), return_inverse=True)
            p, p0 = (np.array([x[c] for x in flat], np.int64) for c in ("p", "p0"))
            first = np.concatenate([[0], np.cumsum(sizes)])
            owner = np.repeat(np.arange(len(sizes)), sizes)
            weight = np.cumsum(sizes[owner])  # pairs up to each entry
            at = 0
            while at < len(flat):  # entries whose pairs fit one array
                floor = weight[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(weight, floor + CHUNK, "right")))
                mine = np.repeat(np.arange(at, end), sizes[owner[at:end]])
                rank = np.arange(len(mine)) - np.repeat(np.concatenate([[0], np.cumsum(sizes[owner[at:end]])[:-1]]), sizes[owner[at:end]])
                other = first[owner[mine]] + rank
                keep = mine != other
                mine, other = mine[keep], other[keep]
                x, x0, y, y0 = p[mine], p0[mine], p[other], p0[other]
                g = (x - y) ** 2 // y - (x - y0) ** 2 // y0 - (x0 - y) ** 2 // y + (x0 - y0) ** 2 // y0
                key = (lang[owner[mine]] * len(names) + source[mine]) * len(names) + source[other]
                order = np.argsort(key, kind="stable")
                key, g = key[order], g[order]
                cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, int)
                for k, total in zip(key[cut].tolist(), np.add.reduceat(g, cut).tolist() if len(cut) else []):
                    sums[langs[k // len(names) ** 2], names[k // len(names) % len(names)], names[k % len(names)]] += total
                at = end
            if len(sums) > HELD:
                yield pd.DataFrame([(*k, v) for k, v in sums.items()], columns=["lang", "source", "item", "value"])
                sums.clear()
        yield pd.DataFrame([(*k, v) for k, v in sums.items()], columns=["lang", "source", "item", "value"]).astype({"value": np.int64})

    return vocabulary.mapInPandas(run, "lang string, source string, item string, value long")


def source_divergence(docs: DataFrame, min_df: int = MIN_DF, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: for each group (lang, source), how far each other source of the lang is from it (part pair), and
    the terms that it uses more than the lang does (part term, the first `ranks` of them).

    Null text, lang and source are ''. A group without terms occurs, with pairs; where a lang keeps no term they have the value 0, and there are
    no terms. Ties rank by item in UTF-8 order. Repeated rows are documents of their own; an empty table gives no rows; other columns (ids too)
    don't matter. Long texts are split at once, whole.

    Plan: one pass in which tasks sum sparse vectors by group -> one exchange by (lang, term), which serves the sums by group and those by term, so
    a word of all documents is a few rows of each task -> the vocabulary as a table in the shared folder -> small tables of groups and of
    counts of counts, joined by lang -> pairs by sums inside the tasks. Rows grow with the vocabulary, and with the square of a language's number
    of sources, as the result does.
    """
    spark = ready(docs.sparkSession)
    named = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    slim = docs.select(*named, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    partial = group_sums(slim).repartition("lang", "term")
    held = partial.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("df").alias("df"))
    entry = F.struct("source", "count")
    by_term = held.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("count").alias("count"), F.collect_list(entry).alias("entries"))
    kept = stash(by_term.where(F.col("df") >= min_df).select("lang", "term", "count", "entries"))
    each = kept.select("lang", "term", F.col("count").alias("lang_count"), F.inline("entries"))

    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("count").alias("lang_n"))
    totals = each.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = docs.select(*named).distinct().join(sizes, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), "lang_n", F.coalesce("n", F.lit(0)).alias("n"))
    p0 = F.when(F.col("v") > 0, scaled(F.lit(0).cast("long"), F.col("n"), F.col("v")))
    groups = stash(groups.withColumn("p0", p0))

    p = scaled(F.col("count"), F.col("n"), F.col("v"))
    placed = each.join(groups, ["lang", "source"]).withColumn("p", p)

    q = scaled(F.col("lang_count"), F.col("lang_n"), F.col("v"))
    above = placed.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    terms = above.select("*", rank).where(F.col("rank") <= ranks)  # the limit acts in each task before the exchange

    # pairs: all terms as if absent from both, what a source's own terms change with the other's as if absent, what terms of both change beyond
    two = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    base = groups.join(two, "lang").where("source != item").select("lang", "source", "item", F.coalesce(F.col("v") * gap(F.col("p0"), F.col("q0")), F.lit(0)).alias("value"))
    sided = placed.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("k")).join(two, "lang").where("source != item")
    there = F.col("k") * (gap(F.col("p"), F.col("q0")) - gap(F.col("p0"), F.col("q0")))
    back = F.col("k") * (gap(F.col("q0"), F.col("p")) - gap(F.col("q0"), F.col("p0")))
    single = sided.select("lang", "source", "item", there.alias("value")).union(sided.select("lang", "item", "source", back.alias("value")))
    both = shared_pairs(placed.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("entries")).select("lang", "entries"))
    sums = base.union(single).union(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    return pairs.union(terms)


SQL = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM d),
df AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 3),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM df GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT lang, source, term, count(*) AS c FROM w JOIN df USING (lang, term) GROUP BY ALL),
n AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN k ON k.lang = g.lang AND k.source = g.source GROUP BY ALL),
p AS (SELECT n.lang, n.source, df.term, coalesce(k.c, 0) AS c, (1 + (1000000000::HUGEINT * (coalesce(k.c, 0) + 1)) // (n.n + v.v))::BIGINT AS p, (1 + (1000000000::HUGEINT * (df.c + 1)) // (v.n + v.v))::BIGINT AS q
      FROM n JOIN v ON v.lang = n.lang JOIN df ON df.lang = n.lang LEFT JOIN k ON k.lang = n.lang AND k.source = n.source AND k.term = df.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE c > 0 AND p > q),
o AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 200
"""
