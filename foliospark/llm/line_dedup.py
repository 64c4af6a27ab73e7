"""Line dedup by site-relative frequency.

For each host the pages holding a line are counted once each and divided by the pages
of the host. A line above the boilerplate ratio is dropped from every page of that host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import materialize, without

#: A line is boilerplate on more than this share of a host's pages, in percent. It must repeat, which takes
#: two pages: a host's only page is no evidence.
RATIO_PERCENT = 5
MIN_PAGES = 2
_BLANKS = " \t\x0b\x0c\r"
ADDED = ["n_lines", "n_dropped"]


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANKS))


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def host_of(url: str) -> Column:
    """The host of a column of URLs in lower case; null where it has none."""
    return F.lower(F.try_parse_url(F.col(url), F.lit("HOST")))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", percent: int = RATIO_PERCENT, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row a host: ``host`` and the hashes of its boilerplate lines.

    A page has at least ``percent`` of the lines' count, so a host has at most
    100 / percent times its mean lines a page of them, however large it is.
    """
    hashes = F.transform(F.filter(F.transform(_lines(text), _trimmed), lambda x: x != ""), lambda x: F.xxhash64(x))
    pages = docs.select(F.col(f"`{host}`").alias("host"), F.array_distinct(hashes).alias("hs"))
    total = pages.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    counted = pages.select("host", F.explode("hs").alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    both = counted.join(total.withColumnRenamed("host", "__host"), F.col("host").eqNullSafe(F.col("__host")))
    frequent = both.where(F.col("pages") * 100 > F.col("total") * percent)
    return frequent.groupBy("host").agg(F.collect_set("h").alias("lines"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", percent: int = RATIO_PERCENT, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with boilerplate lines taken out of ``text``, and ``n_lines`` and ``n_dropped``.

    Lines are cut at \\n and compared without blanks at their ends. Blank lines stay. Every row
    stays, with an empty text if all its lines go; a null text stays null and has no lines.
    Rows of a null host form a host of their own. Repeated rows count as pages of their own.
    A column ``n_chars`` follows the text. Input columns named like an added one give way.
    """
    docs = without(docs, [*ADDED, "__lines", "__host"])
    found = materialize(boilerplate(docs, host, text, percent, min_pages))
    # the table's size on disk decides between a broadcast and a join by host that splits a hot host
    found = found.select(F.col("host").alias("__host"), F.col("lines").alias("__lines"))
    joined = docs.join(found, F.col(f"`{host}`").eqNullSafe(F.col("__host")), "left")
    kept = F.filter(_lines(text), lambda x: (_trimmed(x) == "") | ~F.array_contains(F.col("__lines"), F.xxhash64(_trimmed(x))))
    cut = F.when(F.col("__lines").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    n = F.coalesce(F.size(F.filter(_lines(text), lambda x: _trimmed(x) != "")), F.lit(0)).cast("long")
    left = F.coalesce(F.size(F.filter(F.split(F.col("__cut"), "\n", -1), lambda x: _trimmed(x) != "")), F.lit(0)).cast("long")
    out = joined.withColumn("__cut", cut).withColumn("n_lines", F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(n))
    out = out.withColumn("n_dropped", F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(F.col("n_lines") - left))
    columns = [F.col("__cut").alias(c) if c == text else (F.length("__cut").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`")) for c in docs.columns]
    return out.select(*columns, *ADDED)


def stripped(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """docs without its boilerplate lines, every column under its name, whatever that is."""
    own = [host, text, "n_chars"]
    renamed = docs.select(*[F.col(f"`{c}`").alias(c if c in own else f"d_{c}") for c in docs.columns])
    return drop_boilerplate(renamed, host, text).select(*[F.col(f"`{c if c in own else f'd_{c}'}`").alias(c) for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    return drop_boilerplate(docs).select("doc_id", "text", "n_chars", *ADDED)


_TRIM = "trim({}, ' ' || chr(9) || chr(11) || chr(12) || chr(13))"
ORACLE = f"""
WITH l AS (
  SELECT doc_id, source, i, ls[i] AS line, {_TRIM.format("ls[i]")} AS t
  FROM (SELECT doc_id, source, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))
), n AS (
  SELECT source, count(*) AS total FROM documents GROUP BY source
), c AS (
  SELECT source, t, count(DISTINCT doc_id) AS pages FROM l WHERE t <> '' GROUP BY source, t
), b AS (
  SELECT c.source, t FROM c JOIN n ON c.source IS NOT DISTINCT FROM n.source
  WHERE pages >= {MIN_PAGES} AND pages * 100 > total * {RATIO_PERCENT}
), o AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE b.t IS NULL) AS text,
         count(*) FILTER (WHERE l.t <> '') AS n_lines, count(*) FILTER (WHERE b.t IS NOT NULL) AS n_dropped
  FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND l.t = b.t GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(o.text, '') END AS text,
       CASE WHEN d.text IS NULL THEN NULL ELSE length(coalesce(o.text, ''))::BIGINT END AS n_chars,
       coalesce(o.n_lines, 0)::BIGINT AS n_lines, coalesce(o.n_dropped, 0)::BIGINT AS n_dropped
FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id"""
