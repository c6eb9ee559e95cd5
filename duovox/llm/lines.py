"""Line dedup: lines that many documents share stay in one document only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duovox.llm.common import stash, text_or_empty

#: The white space that is stripped, and the letters whose case is ignored.
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = -(1 << 63)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, other letters as they are; lower() has a quick way for plain ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_keys(text: Column, least: int) -> Column:
    """The key of each line by position: two 64-bit hashes of the normalised line, of different seeds, as 32 hex digits, null for lines under least code points.

    A seed goes first: after the line it would only scramble the first hash. 128 bits: among the 10^12 lines of a large corpus 64 bits would collide.
    """

    def key(line: Column) -> Column:
        bare = F.btrim(line, F.lit(STRIPPED))
        digest = F.concat(F.hex(F.xxhash64(bare)), F.lit(":"), F.hex(F.xxhash64(F.lit(1), bare)))
        return F.when(F.char_length(bare) >= least, digest)

    return F.transform(F.split(ascii_lower(text), "\n", -1), key)


def without_shared_lines(docs: DataFrame, least: int = 20, threshold: int = 3) -> DataFrame:
    """docs with text less shared lines, and n_lines, n_dropped.

    Key: a line stripped at both ends, A-Z in lower case. Keys of at least `least` code points that `threshold` or more
    documents hold lose all their lines, except in the largest doc_id that holds them. Documents are told apart
    by doc_id: repeated rows of one id count once and are treated alike; rows with a null id form one document
    that comes before all others. A null text is empty: one line, none dropped, and stays null.
    Other columns stay as they are, but for n_lines and n_dropped, which are replaced.

    Plan: keys once for each document -> distinct count and largest id by key (partial sums on the map side, so
    a line that a third of the documents hold is a few rows for each task) -> a table of the shared keys in the shared
    folder -> join to their documents (both sides are plain exchanges then, so adaptive execution splits a hot
    key, or broadcasts the keys if their measured size allows) -> hashes to drop by document -> join to the texts, whose
    lines are put together again by position.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    own = docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("_doc"), text_or_empty().alias("_text"), F.struct(*names).alias("_row"))
    keys = line_keys(F.col("_text"), least)
    held = own.select("_doc", F.explode(F.array_distinct(F.array_compact(keys))).alias("_key"))
    counts = held.groupBy("_key").agg(F.countDistinct("_doc").alias("_n"), F.max("_doc").alias("_last"))
    shared = stash(counts.where(F.col("_n") >= threshold).select("_key", "_last"))
    drops = held.join(shared, "_key").where("_doc < _last").groupBy("_doc").agg(F.collect_set("_key").alias("_drop"))
    joined = own.join(drops, "_doc", "left")
    lines = F.split("_text", "\n", -1)
    both = F.arrays_zip(lines.alias("line"), keys.alias("key"))
    # looked up in about sqrt(n) buckets of n keys, so that a text of many dropped lines isn't compared line by key
    wide = F.ceil(F.sqrt(F.size("_drop"))).cast("int")
    bucket = lambda key: F.pmod(F.hash(key), wide)
    buckets = F.transform(F.sequence(F.lit(0), wide - 1), lambda b: F.filter("_drop", lambda key: bucket(key) == b))
    stays = lambda held: F.filter(both, lambda x: x["key"].isNull() | ~F.array_contains(F.get(held, bucket(x["key"])), F.coalesce(x["key"], F.lit(""))))
    kept = F.when(F.col("_drop").isNotNull(), F.transform(F.flatten(F.transform(F.array(buckets), stays)), lambda x: x["line"]))
    out = joined.select("_row", kept.alias("_kept"), F.size(lines).cast("long").alias("n_lines"))
    n_dropped = F.when(F.col("_kept").isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("_kept")).cast("long")
    text = F.when(F.col("_kept").isNull(), F.col("_row.text")).otherwise(F.array_join("_kept", "\n"))
    return out.select(*[(text if c == "text" else F.col("_row")[c]).alias(c) for c in names], "n_lines", n_dropped.alias("n_dropped"))


def line_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the text that stays, for each row of docs."""
    slim = docs.select("doc_id", "text")
    return without_shared_lines(slim).select("doc_id", "n_lines", "n_dropped", F.sha2(text_or_empty(), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
    SELECT doc_id, i, list_extract(string_split(coalesce(text, ''), chr(10)), i::BIGINT) AS line
    FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS u(i)
), keyed AS (
    SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), shared AS (
    SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT k.doc_id, k.i, k.line, s.key IS NOT NULL AND k.doc_id < s.last_doc AS gone
    FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
