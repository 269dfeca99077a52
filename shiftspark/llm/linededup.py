"""Line dedup: boilerplate lines that many sites share keep one occurrence.

1. Every line with enough words becomes a digest with its place and site.
2. Digests that one site alone holds go at once (a count of two numbers each).
3. For the rest a HyperLogLog sketch of sites per digest merges by aggregation.
4. Digests whose estimate lies near the threshold get an exact distinct count.
5. Lines at or over the threshold are taken from every document but the first
   one that holds them (the smallest doc_id, then line number).

A line that fills the corpus is only met in partial aggregates and in joins,
which adaptive execution splits.

Nulls, empties, repeats: a null text counts as empty and stays null; a null
source is a site of its own; a null doc_id sorts first; rows that repeat doc_id
and text are treated alike, as one document; of lines that tie as the first the
smallest text's hash decides; a very long text is cut into its lines in one row;
an empty table gives no rows; blank lines and lines under ``min_words`` words are
never taken; other columns, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftspark.llm.common import stash, table

MIN_SITES = 3
#: Every line that holds a word can be boilerplate: how many sites have it decides alone.
MIN_WORDS = 1
#: Sketch size as a power of two: a relative error of about 1.04 / sqrt(2^12).
LG_K = 12
#: Estimates within so many standard errors of the threshold, and within one site, are counted exactly.
ERRORS = 4.0

_SPACE = "\t\x0b\x0c\r "


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(_SPACE))


def places(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, tx (a text's hash), pos, digest, site of every line that has enough words."""
    exploded = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tx"), F.xxhash64("source").alias("site"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    line = exploded.withColumn("line", _trimmed(F.col("line")))
    # a word more than there are gaps between words; a blank line has none
    return line.where((F.col("line") != "") & (F.size(F.split("line", "[\t\x0b\x0c\r ]+", min_words)) >= min_words)).select("doc_id", "tx", "pos", F.unhex(F.md5("line")).alias("digest"), "site")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> tuple[DataFrame, DataFrame]:
    """(digest, first place) of lines on at least min_sites sites, and the places to search."""
    spread = lines.groupBy("digest").agg(F.min("site").alias("a"), F.max("site").alias("b"))
    # written, so that the joins below read plain shuffles, which adaptive execution can split at a line that fills the corpus
    shared = stash(spread.where("a <> b" if min_sites > 1 else "true").select("digest"), "sharedlines")
    places_ = stash(lines.join(shared, "digest"), "sharedplaces")
    sketched = stash(
        places_.groupBy("digest").agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"),
            F.min(F.struct("doc_id", "tx", "pos")).alias("first"),
        ),
        "sketches",
    )
    band = max(1.0, ERRORS * 1.04 / 2 ** (LG_K / 2) * min_sites)
    near = F.abs(F.col("sites") - min_sites) <= band
    # each digest's sites first, so that a line that fills the corpus is a few rows in the join
    sites = places_.select("digest", "site").distinct()
    exact = sites.join(sketched.where(near).select("digest"), "digest").groupBy("digest").agg(F.count("*").alias("exact"))
    taken = sketched.where(~near & (F.col("sites") > min_sites)).select("digest", "first").union(
        sketched.where(near).join(exact.where(F.col("exact") >= min_sites), "digest").select("digest", "first")
    )
    return stash(taken, "taken"), places_


def drop_shared_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the lines taken out of ``text``, and n_lines and n_removed beside."""
    taken, where = boilerplate(stash(places(docs, min_words), "lines"), min_sites)
    others = where.join(taken, "digest").where(~F.col("first").eqNullSafe(F.struct("doc_id", "tx", "pos")))
    # at most a document's own lines in a row
    gone = stash(others.groupBy("doc_id", "tx").agg(F.collect_set("pos").alias("gone")), "gone").toDF("_doc", "_tx", "_gone")
    side = gone  # the same join at every size; Spark broadcasts it where it measures it small
    # columns by their frame, as docs may have any names
    marked = docs.join(side, docs["doc_id"].cast("long").eqNullSafe(side["_doc"]) & (F.xxhash64(docs["text"]) == side["_tx"]), "left")
    lines = _lines(docs["text"])
    gone_set = side["_gone"]
    # what stands between the places taken, in one pass whatever their number
    order = F.array_sort(gone_set)
    before, at = (lambda k: F.coalesce(F.get(order, k - 1), F.lit(-1))), (lambda k: F.coalesce(F.get(order, k), F.size(lines)))
    left = F.concat_ws("\n", F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone_set)), lambda k: F.slice(lines, before(k) + 2, at(k) - before(k) - 1))))
    text = F.when(gone_set.isNull(), docs["text"]).otherwise(left)
    return marked.select(
        *[text.alias("text") if c == "text" else docs[c] for c in docs.columns],
        F.size(lines).cast("long").alias("n_lines"), F.when(gone_set.isNull(), 0).otherwise(F.size(gone_set)).cast("long").alias("n_removed"),
    )


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    return drop_shared_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


OP2_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, u.line, u.pos
  FROM (SELECT doc_id, coalesce(source, '') AS source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       LATERAL (SELECT unnest(d.ls) AS line, unnest(range(len(d.ls))) AS pos) u
), worded AS (
  SELECT doc_id, source, pos, trim(line, chr(9) || chr(11) || chr(12) || chr(13) || ' ') AS line FROM lines
), shared AS (
  SELECT line, min(doc_id * 1000000 + pos) AS first
  FROM worded
  WHERE line <> '' AND len(string_split_regex(line, '[\\t\\x0b\\x0c\\r ]+')) >= {MIN_WORDS}
  GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
), marked AS (
  SELECT l.doc_id, l.pos, l.line, s.first IS NOT NULL AND s.first <> l.doc_id * 1000000 + l.pos AS gone
  FROM lines l LEFT JOIN shared s ON s.line = trim(l.line, chr(9) || chr(11) || chr(12) || chr(13) || ' ')
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
FROM marked GROUP BY doc_id
"""
