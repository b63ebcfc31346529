"""Cross-site line dedup by distinct-site spread, with DataFrame functions only.

A HyperLogLog sketch of the sites of each line hash is built on every task and merged by
aggregation, together with the line's first occurrence.  Lines whose estimate is clearly on one side of the threshold are
decided by it; those within the sketch's error get an exact count of distinct sites.  Of a
line found on enough sites the first occurrence (least document id, then place) stays and all
others are removed.

The lines found are written, so the rows of a very common line meet them in a broadcast join
if they are few (they are counted), else in a join of two plain shuffles, whose large partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Scratch


def _lines(docs: DataFrame, *keep: str) -> DataFrame:
    """A row for each line with more on it than spaces: the kept columns, place and key."""
    line = docs.select(*keep, F.posexplode(F.split("_text", "\n")).alias("place", "line")).where(F.length(F.trim("line")) > 0)
    return line.select(*keep, "place", F.xxhash64("line").alias("h"), F.length("line").alias("len"))


def spread_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10, lg_k: int = 11, sigmas: float = 4.0) -> DataFrame:
    """(h, len, first) of the lines that occur on ``min_sites`` sites or more; first is (id, place, k) of the first occurrence, k a hash of id and text."""
    scratch = Scratch(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"), F.col(site_col).cast("string").alias("site"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("k"))
    lines = _lines(own, "id", "site", "k")
    error = sigmas * 1.04 / 2 ** (lg_k / 2)
    low, high = min_sites * (1 - error) - 0.5, min_sites * (1 + error) + 0.5
    estimate = lines.groupBy("h", "len").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.count("site").alias("n"), F.min(F.struct("id", "place", "k")).alias("first")).where(F.col("n") >= min_sites)
    estimate = scratch.keep(estimate.select("h", "len", "first", F.hll_sketch_estimate("sketch").alias("about")).where(F.col("about") >= low), few=True)
    near = estimate.where(F.col("about") <= high).select("h", "len")
    exact = lines.where("site is not null").select("h", "len", "site").join(scratch.small(near), ["h", "len"], "left_semi").groupBy("h", "len", "site").agg(F.lit(1).alias("one")).groupBy("h", "len").agg(F.count("*").alias("sites"))
    exact = exact.where(F.col("sites") >= min_sites).select("h", "len", F.lit(True).alias("enough"))
    out = scratch.keep(estimate.join(exact, ["h", "len"], "left").where((F.col("about") > high) | F.col("enough")).select("h", "len", "first"), few=True)
    scratch.drop(estimate)
    return scratch.small(out)


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10) -> DataFrame:
    """Removes lines that occur on ``min_sites`` distinct sites or more, but for their first occurrence.

    Returns all columns of ``docs`` with ``text_col`` rewritten, and n_lines and n_removed (long), replacing
    columns of those names.  Rows with null site count for no site but lose their lines as others do.
    Null texts stay null with 0 lines; lines that are empty or of spaces are never removed; a text can become empty.  Rows equal in
    id and text are treated as one occurrence; a null id comes before all others.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    spread = spread_lines(docs, id_col=id_col, text_col=text_col, site_col=site_col, min_sites=min_sites)
    places = _lines(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"), key.alias("k")), "id", "k")
    gone = places.join(spread, ["h", "len"]).where(~(F.struct("id", "place", "k").eqNullSafe(F.col("first"))))
    k, g = (next(n for n in (f"{base}{i}" for i in range(len(names) + 1)) if n not in names) for base in ("_key", "_gone"))
    gone = gone.groupBy(F.col("k").alias(k)).agg(F.collect_set("place").alias(g))
    both = docs.select(*[F.col(f"`{c}`") for c in names], key.alias(k)).join(gone, k, "left")
    lines = F.split(F.col(f"`{text_col}`"), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(g))
    text = F.when(F.col(g).isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n"))
    rewritten = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in names]
    n_lines = F.when(F.col(f"`{text_col}`").isNull(), 0).otherwise(F.size(lines)).cast("long")
    return both.select(*rewritten, n_lines.alias("n_lines"), F.coalesce(F.size(g), F.lit(0)).cast("long").alias("n_removed"))


#: The same for DuckDB, over documents with unique ids.
SQL = """
WITH l AS (
  SELECT doc_id, source, unnest(range(len(ls))) AS place, unnest(ls) AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents)
), spread AS (
  SELECT line FROM l WHERE length(trim(line)) > 0 GROUP BY line HAVING count(DISTINCT source) >= 10
), ranked AS (
  SELECT l.doc_id, l.place, row_number() OVER (PARTITION BY l.line ORDER BY l.doc_id, l.place) AS nth
  FROM l JOIN spread ON l.line = spread.line
), marked AS (
  SELECT l.doc_id, l.place, l.line, coalesce(r.nth, 1) > 1 AS gone
  FROM l LEFT JOIN ranked r ON l.doc_id = r.doc_id AND l.place = r.place
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS text
FROM marked GROUP BY doc_id
"""
