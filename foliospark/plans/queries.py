"""Queries over files, graphs, boxes, labels, codecs and images, and the SQL that computes the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import native as n
from foliospark.operators.graph import closure
from foliospark.operators.labels import nearest_label, without_text
from foliospark.plans import files, layouts  # noqa: F401 (layouts registers its queries)
from foliospark.plans.registry import ORACLE, QUERIES, query, table
from foliospark.sources import synthetic
from foliospark.sources.storage import written

# files

_PAGES = f"ceil(len(string_split(text, chr(10))) / {float(synthetic.LINES)})::BIGINT"


@query(f"""SELECT doc_id, {_PAGES} AS pages, 3 + 2 * {_PAGES} + doc_id % 3 AS objects, 0::BIGINT AS image_streams, doc_id % 3 AS orphans
FROM documents""")
def inspect_census(spark: SparkSession, d: str) -> DataFrame:
    out = files.inspect(synthetic.text_files(table(spark, d, "documents")))
    return out.select(F.col("path").cast("long").alias("doc_id"), "pages", "objects", "image_streams", "orphans")


@query("SELECT doc_id, doc_id % 3 AS orphans FROM documents WHERE doc_id % 3 > 0")
def orphan_count(spark: SparkSession, d: str) -> DataFrame:
    rows = files.objects(synthetic.text_files(table(spark, d, "documents")))
    return rows.where(~F.col("live")).groupBy(F.col("path").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("orphans"))


@query("""SELECT subtype, count(*) AS n FROM (
  SELECT 'Type1' AS subtype FROM documents UNION ALL SELECT 'Image' FROM (SELECT unnest(range(label + 1)) FROM embeddings) UNION ALL SELECT 'Type1' FROM embeddings
) GROUP BY subtype""")
def object_kinds(spark: SparkSession, d: str) -> DataFrame:
    both = synthetic.text_files(table(spark, d, "documents")).unionAll(synthetic.image_files(table(spark, d, "embeddings")))
    return files.objects(both).where(F.col("subtype").isNotNull()).groupBy("subtype").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT doc_id, p AS page_no, 0.0::DOUBLE AS llx, 792.0::DOUBLE AS ury
FROM (SELECT doc_id, unnest(range(1, {_PAGES} + 1))::INT AS p FROM documents)""")
def page_boxes(spark: SparkSession, d: str) -> DataFrame:
    out = files.pages(synthetic.text_files(table(spark, d, "documents")))
    return out.select(F.col("path").cast("long").alias("doc_id"), "page_no", "llx", "ury")


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
SELECT doc_id, count(*) AS runs, sum(length(t))::BIGINT AS chars
FROM (SELECT doc_id, unnest(list_concat([], flatten(list_transform(ls, lambda x: regexp_extract_all(x, '_+|[^_]+'))))) AS t FROM l) GROUP BY doc_id""")
def text_run_census(spark: SparkSession, d: str) -> DataFrame:
    out = files.text_runs(synthetic.text_files(table(spark, d, "documents")))
    return out.where(F.col("text").isNotNull()).groupBy(F.col("path").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("runs"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("""SELECT c_custkey, 1 AS field_no, 'text' AS kind, c_name AS name FROM customer
UNION ALL SELECT c_custkey, 2, 'checkbox', 'Agree' FROM customer""")
def form_fields(spark: SparkSession, d: str) -> DataFrame:
    out = files.form_fields(synthetic.form_files(table(spark, d, "customer")))
    return out.select(F.col("path").cast("long").alias("c_custkey"), "field_no", "kind", "name")


@query("SELECT c_custkey, 2::BIGINT AS fields_added, 1::BIGINT AS text_fields, 1::BIGINT AS checkboxes, 2::BIGINT AS found_after, 0::BIGINT AS added_again FROM customer")
def form_idempotence(spark: SparkSession, d: str) -> DataFrame:
    """The fields of a prepared file, and those a second pass adds: none."""
    once = written(files.prepare_form(synthetic.form_files(table(spark, d, "customer"))))
    again = files.prepare_form(once.select("path", F.col("output").alias("content"))).select("path", F.col("fields_added").alias("added_again"))
    widgets = files.objects(once.select("path", F.col("output").alias("content"))).where("subtype = 'Widget'").groupBy("path").agg(F.count(F.lit(1)).alias("found_after"))
    return once.join(again, "path").join(widgets, "path").select(F.col("path").cast("long").alias("c_custkey"), "fields_added", "text_fields", "checkboxes", "found_after", "added_again")


@query("SELECT doc_id, doc_id % 3 AS orphans_removed, true AS no_larger, true AS reopens FROM documents")
def compress_guard(spark: SparkSession, d: str) -> DataFrame:
    done = written(files.compress(synthetic.text_files(table(spark, d, "documents"))))
    again = files.inspect(done.select("path", F.col("output").alias("content"))).select("path", F.col("orphans").alias("left"), F.col("error_class").alias("wrong"))
    return done.join(again, "path").select(F.col("path").cast("long").alias("doc_id"), "orphans_removed", (F.col("output_bytes") <= F.col("input_bytes")).alias("no_larger"), F.col("wrong").isNull().alias("reopens"))


@query("SELECT vec_id, label::BIGINT AS images_deduped, 1::BIGINT AS image_streams FROM embeddings")
def image_dedup(spark: SparkSession, d: str) -> DataFrame:
    done = written(files.compress(synthetic.image_files(table(spark, d, "embeddings"))))
    left = files.inspect(done.where("NOT kept_original").select("path", F.col("output").alias("content"))).select("path", "image_streams")
    return done.join(left, "path", "left").select(F.col("path").cast("long").alias("vec_id"), "images_deduped", F.coalesce("image_streams", F.lit(1)).cast("long").alias("image_streams"))


@query("SELECT c_custkey, c_name AS name FROM customer UNION ALL SELECT c_custkey, 'Agree' FROM customer")
def existing_fields(spark: SparkSession, d: str) -> DataFrame:
    once = files.prepare_form(synthetic.form_files(table(spark, d, "customer")))
    return files.fields(once.select("path", F.col("output").alias("content"))).select(F.col("path").cast("long").alias("c_custkey"), "name")


@query("SELECT c_custkey, 2::BIGINT AS annotations FROM customer")
def occupied_boxes(spark: SparkSession, d: str) -> DataFrame:
    once = files.prepare_form(synthetic.form_files(table(spark, d, "customer")))
    return files.annotations(once.select("path", F.col("output").alias("content"))).groupBy(F.col("path").cast("long").alias("c_custkey")).agg(F.count(F.lit(1)).alias("annotations"))


@query(f"""SELECT operator, sum(n)::BIGINT AS n FROM (
  SELECT 'Tj' AS operator, len(string_split(text, chr(10))) AS n FROM documents UNION ALL SELECT 'T*', len(string_split(text, chr(10))) FROM documents
  UNION ALL SELECT unnest(['BT', 'ET', 'Tf', 'TL', 'Td']), {_PAGES} FROM documents) GROUP BY operator""")
def content_operators(spark: SparkSession, d: str) -> DataFrame:
    out = files.operations(synthetic.text_files(table(spark, d, "documents")))
    return out.groupBy("operator").agg(F.sum("n").alias("n"))


@query("SELECT doc_id, 1::BIGINT AS streams_reflated, text AS shown FROM documents")
def reflated_streams(spark: SparkSession, d: str) -> DataFrame:
    """Hexadecimal contents deflated anew; the text on the page stays what it was."""
    done = written(files.compress(synthetic.hex_files(table(spark, d, "documents"))).select("path", "streams_reflated", F.col("output").alias("content")))
    runs = files.text_runs(done).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("shown"))
    return done.join(runs, "path").select(F.col("path").cast("long").alias("doc_id"), "streams_reflated", "shown")


@query("SELECT vec_id, (label + 1)::BIGINT AS uses FROM embeddings")
def soft_mask_uses(spark: SparkSession, d: str) -> DataFrame:
    rows = files.objects(synthetic.masked_files(table(spark, d, "embeddings"))).where("smask_ref IS NOT NULL")
    return rows.groupBy(F.col("path").cast("long").alias("vec_id"), "smask_ref").agg(F.count(F.lit(1)).alias("uses")).drop("smask_ref")


@query("""SELECT vec_id, count(*) FILTER (WHERE k > 0) AS images, 1::BIGINT AS masks FROM (SELECT vec_id, unnest(range(label + 2)) AS k FROM embeddings) GROUP BY vec_id""")
def soft_mask_members(spark: SparkSession, d: str) -> DataFrame:
    """Images that are soft masks of others, by a semi-join on the file and the number."""
    rows = files.objects(synthetic.masked_files(table(spark, d, "embeddings"))).where("subtype = 'Image'").select("path", "obj_num", "smask_ref")
    used = rows.where("smask_ref IS NOT NULL").select("path", F.col("smask_ref").alias("obj_num"))
    masks = rows.join(used, ["path", "obj_num"], "left_semi").withColumn("mask", F.lit(1))
    out = rows.join(masks.select("path", "obj_num", "mask"), ["path", "obj_num"], "left")
    return out.groupBy(F.col("path").cast("long").alias("vec_id")).agg(F.count_if(F.col("mask").isNull()).alias("images"), F.count("mask").alias("masks"))


# graphs, duplicates

_EDGES = """SELECT 'r' || r_regionkey AS src, 'n' || n_nationkey AS dst FROM region JOIN nation ON r_regionkey = n_regionkey
UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation"""


@query(f"""WITH RECURSIVE e AS ({_EDGES}), seen(node) AS (
  SELECT 'r' || r_regionkey FROM region WHERE r_name = 'ASIA' UNION SELECT e.dst FROM seen JOIN e ON e.src = seen.node)
SELECT left(node, 1) AS kind, count(*) AS n FROM seen GROUP BY 1""")
def fk_reachability(spark: SparkSession, d: str) -> DataFrame:
    """What one region leads to over foreign keys, with cycles between nations and regions."""
    node = lambda c, prefix: F.concat(F.lit(prefix), F.col(c))
    edge = lambda t, a, pa, b, pb: table(spark, d, t).select(node(a, pa).alias("src"), node(b, pb).alias("dst"))
    edges = edge("nation", "n_regionkey", "r", "n_nationkey", "n").unionAll(edge("nation", "n_nationkey", "n", "n_regionkey", "r"))
    edges = edges.unionAll(edge("customer", "c_nationkey", "n", "c_custkey", "c")).unionAll(edge("supplier", "s_nationkey", "n", "s_suppkey", "s")).unionAll(edge("orders", "o_custkey", "c", "o_orderkey", "o"))
    roots = table(spark, d, "region").where("r_name = 'ASIA'").select(node("r_regionkey", "r").alias("node"))
    return closure(edges, roots).groupBy(F.substring("node", 1, 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS survivor, count(*) OVER (PARTITION BY text) AS copies FROM documents")
def exact_dedup_docs(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprint deduplication: texts meet by hash, so only hashes are shuffled, with partial counts."""
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    groups = rows.groupBy("h").agg(F.min("doc_id").alias("survivor"), F.count(F.lit(1)).alias("copies"))
    return rows.join(groups, "h").select("doc_id", "survivor", "copies")


@query("""WITH s AS (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS kept FROM customer)
SELECT o_orderkey, kept AS customer FROM orders JOIN s ON o_custkey = c_custkey""")
def reference_remap(spark: SparkSession, d: str) -> DataFrame:
    """References to merged rows turned to the surviving one; the others keep theirs."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    kept = c.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("kept"))
    to = c.join(kept, ["c_nationkey", "c_mktsegment"]).where("c_custkey <> kept").select("c_custkey", "kept")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return orders.join(to, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce("kept", "o_custkey").alias("customer"))


@query("""SELECT c_custkey, c_mktsegment || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS name
FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey // 40, c_mktsegment ORDER BY c_custkey) AS n FROM customer)""")
def field_names(spark: SparkSession, d: str) -> DataFrame:
    """Names made unique in order, a fold over the slots of each file of forty."""
    import pandas as pd

    from foliospark.operators.slots import TEXT, Box, Slot, named

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("c_custkey")
        slots = named([Slot(1, TEXT, Box(0, 0, 1, 1), n) for n in rows["c_mktsegment"]], ())
        return pd.DataFrame({"c_custkey": rows["c_custkey"].to_numpy(), "name": [s.name for s in slots]})

    rows = table(spark, d, "customer").select(F.expr("c_custkey div 40").alias("file"), "c_custkey", "c_mktsegment")
    return rows.groupBy("file").applyInPandas(fold, "c_custkey long, name string")


# boxes

_BOX = "(p_partkey * 37 % 500)::DOUBLE AS llx, (p_partkey * 53 % 700)::DOUBLE AS lly, (p_partkey * 37 % 500 + p_size * 5 % 260)::DOUBLE AS urx, (p_partkey * 53 % 700 + p_size * 3 % 60)::DOUBLE AS ury"
_FROM_PART = f"(SELECT p_partkey, {_BOX} FROM part)"


def _part_boxes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", n.box(_dbl("p_partkey * 37 % 500"), _dbl("p_partkey * 53 % 700"), _dbl("p_partkey * 37 % 500 + p_size * 5 % 260"), _dbl("p_partkey * 53 % 700 + p_size * 3 % 60")).alias("b"))


def _page() -> F.Column:
    return n.box(F.lit(0.0), F.lit(0.0), F.lit(612.0), F.lit(792.0))


@query(f"""SELECT p_partkey, CASE WHEN w < 6 OR h < 6 OR w * h > 612 * 792 * 0.45 THEN NULL
  WHEN w <= 24 AND h <= 24 AND w / h BETWEEN 0.7 AND 1.45 THEN 'checkbox' WHEN w >= 36 AND h BETWEEN 10 AND 220 AND w <= 612 * 0.95 THEN 'text' END AS kind
FROM (SELECT p_partkey, urx - llx AS w, ury - lly AS h FROM {_FROM_PART})""")
def box_classify(spark: SparkSession, d: str) -> DataFrame:
    return _part_boxes(spark, d).select("p_partkey", n.classify_box(F.col("b"), _page()).alias("kind"))


@query(f"""WITH b AS (SELECT *, p_partkey // 500 AS page FROM {_FROM_PART}),
p AS (SELECT x.p_partkey AS a, y.p_partkey AS b, greatest(0, least(x.urx, y.urx) - greatest(x.llx, y.llx)) * greatest(0, least(x.ury, y.ury) - greatest(x.lly, y.lly)) AS shared,
  greatest(least((x.urx - x.llx) * (x.ury - x.lly), (y.urx - y.llx) * (y.ury - y.lly)), 1) AS smaller
FROM b x JOIN b y ON x.page = y.page AND x.p_partkey < y.p_partkey)
SELECT a, b, shared FROM p WHERE shared / smaller > 0.4""")
def box_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping boxes of a page of 500: an equi-join on the page and the cells of 100 points that a box touches;
    a pair counts in the cell where the part that both share begins."""
    cell = lambda x: F.floor(x / 100)
    b = _part_boxes(spark, d).select("p_partkey", "b", F.expr("p_partkey div 500").alias("page"))
    b = b.withColumn("cx", F.explode(F.sequence(cell(F.col("b.llx")), cell(F.col("b.urx"))))).withColumn("cy", F.explode(F.sequence(cell(F.col("b.lly")), cell(F.col("b.ury")))))
    x, y = b.select(F.col("p_partkey").alias("a"), F.col("b").alias("ba"), "page", "cx", "cy"), b.select(F.col("p_partkey").alias("c"), F.col("b").alias("bb"), "page", "cx", "cy")
    first = (F.col("cx") == cell(F.greatest("ba.llx", "bb.llx"))) & (F.col("cy") == cell(F.greatest("ba.lly", "bb.lly")))
    return x.join(y, ["page", "cx", "cy"]).where((F.col("a") < F.col("c")) & first & n.overlaps(F.col("ba"), F.col("bb"))).select("a", F.col("c").alias("b"), n.inter_area(F.col("ba"), F.col("bb")).alias("shared"))


@query(f"""SELECT p_partkey, greatest(llx, 100) AS llx, greatest(lly, 100) AS lly, least(urx, 500) AS urx, least(ury, 600) AS ury
FROM {_FROM_PART} WHERE least(urx, 500) - greatest(llx, 100) >= 8 AND least(ury, 600) - greatest(lly, 100) >= 6
  AND (llx + urx) / 2 BETWEEN 96 AND 504 AND (lly + ury) / 2 BETWEEN 96 AND 604""")
def box_clamp(spark: SparkSession, d: str) -> DataFrame:
    page = n.box(F.lit(100.0), F.lit(100.0), F.lit(500.0), F.lit(600.0))
    rows = _part_boxes(spark, d).where(n.holds(page, F.col("b"))).select("p_partkey", n.clamp_box(F.col("b"), page, 8.0).alias("c"))
    return rows.where(F.col("c").isNotNull()).select("p_partkey", "c.*")


@query("""SELECT c_custkey, x, y - h * 0.25 AS lly, y + h * 0.95 AS ury
FROM (SELECT c_custkey, (c_custkey % 400)::DOUBLE AS x, (c_custkey % 700)::DOUBLE AS y, least(greatest((c_custkey % 24)::DOUBLE, 8), 18) AS h FROM customer)""")
def underscore_boxes(spark: SparkSession, d: str) -> DataFrame:
    b = n.underscore_box(_dbl("c_custkey % 400"), _dbl("c_custkey % 700"), F.lit(50.0), _dbl("c_custkey % 24"), F.lit(1.0))
    return table(spark, d, "customer").select("c_custkey", b.alias("b")).select("c_custkey", F.col("b.llx").alias("x"), "b.lly", "b.ury")


# labels

_RUNS = "SELECT c_custkey // 100 AS file, c_custkey % 2 AS page, c_custkey AS seq, CASE WHEN c_custkey % 11 = 0 THEN '_____' ELSE c_name END AS text, (c_custkey * 29 % 500)::DOUBLE AS x, (c_custkey * 17 % 700)::DOUBLE AS y, 60.0::DOUBLE AS w, (8 + c_custkey % 9)::DOUBLE AS size FROM customer"
_SLOTS = "SELECT s_suppkey AS slot, s_suppkey // 8 AS file, s_suppkey % 2 AS page, (s_suppkey * 41 % 500)::DOUBLE AS llx, (s_suppkey * 23 % 700)::DOUBLE AS lly, (s_suppkey * 41 % 500 + 120)::DOUBLE AS urx, (s_suppkey * 23 % 700 + 20)::DOUBLE AS ury FROM supplier"


def _dbl(sql: str) -> F.Column:
    return F.expr(f"CAST({sql} AS DOUBLE)")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs on pages: customers' names, placed by their keys, and some underscores."""
    c = table(spark, d, "customer")
    text = F.when(F.expr("c_custkey % 11 = 0"), F.lit("_____")).otherwise(F.col("c_name"))
    return c.select(F.expr("c_custkey div 100").alias("file"), F.expr("c_custkey % 2").alias("page"), F.col("c_custkey").alias("seq"), text.alias("text"), _dbl("c_custkey * 29 % 500").alias("x"), _dbl("c_custkey * 17 % 700").alias("y"), F.lit(60.0).alias("w"), _dbl("8 + c_custkey % 9").alias("size"))


def _slots(spark: SparkSession, d: str) -> DataFrame:
    """Boxes on pages: suppliers, placed by their keys."""
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("slot"), F.expr("s_suppkey div 8").alias("file"), F.expr("s_suppkey % 2").alias("page"), _dbl("s_suppkey * 41 % 500").alias("llx"), _dbl("s_suppkey * 23 % 700").alias("lly"), _dbl("s_suppkey * 41 % 500 + 120").alias("urx"), _dbl("s_suppkey * 23 % 700 + 20").alias("ury"))


def _nearest_sql(distance: str, near: str) -> str:
    return f"""WITH r AS ({_RUNS}), s AS ({_SLOTS}), p AS (SELECT slot, text, seq, {distance} AS distance FROM s JOIN r ON s.file = r.file AND s.page = r.page WHERE trim(text, '_ ') <> '' AND {near})
SELECT slot, text AS label, distance FROM p QUALIFY row_number() OVER (PARTITION BY slot ORDER BY distance, seq) = 1"""


_OVER = "greatest(0.0, least(x + w, urx) - greatest(x, llx))"
_LEVEL = "abs(y + size * 0.3 - (lly + ury) * 0.5) <= greatest(size * 0.85, (ury - lly) * 0.7)"
_NEAREST = {
    "left": _nearest_sql("llx - (x + w)", "llx - (x + w) BETWEEN -4 AND 80 AND y - lly BETWEEN -4 AND size * 0.9 + 2"),
    "beside": _nearest_sql("x - urx", f"x - urx BETWEEN -6 AND 90 AND {_LEVEL}"),
    "beside_left": _nearest_sql("llx - (x + w)", f"llx - (x + w) BETWEEN -6 AND 90 AND {_LEVEL}"),
    "above": _nearest_sql("y - ury", f"y - ury BETWEEN -2 AND 36 AND ({_OVER} >= 8 OR abs(x - llx) < 48)"),
    "above_line": _nearest_sql("y - lly", f"y - lly BETWEEN 1 AND 32 AND ({_OVER} >= 10 OR abs(x - llx) <= 40)"),
}
for _name, _sql in _NEAREST.items():
    QUERIES[f"nearest_label_{_name}"] = lambda spark, d, search=_name: nearest_label(_slots(spark, d), _runs(spark, d), search)
    ORACLE[f"nearest_label_{_name}"] = _sql

_CENTRE = "x + w * 0.5 > llx + 1.5 AND x + w * 0.5 < urx - 1.5 AND y + size * 0.35 > lly + 1.5 AND y + size * 0.35 < ury - 1.5"


@query(f"WITH r AS ({_RUNS}), s AS ({_SLOTS}) SELECT slot FROM s WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.file = s.file AND r.page = s.page AND trim(text, '_ ') <> '' AND {_CENTRE})")
def boxes_without_text(spark: SparkSession, d: str) -> DataFrame:
    """A containment anti-join on the page."""
    return without_text(_slots(spark, d), _runs(spark, d)).select("slot")


_SANITIZE = r"""SELECT {key}, CASE WHEN regexp_matches(x, '[\p{{L}}\p{{N}}]') AND len(regexp_extract_all(x, '\S+')) <= 8 AND length(x) <= 48 THEN
  nullif(trim(regexp_replace(replace(regexp_replace(x, '\p{{Cc}}', '', 'g'), '.', '_'), '\s+', ' ', 'g')), '') END AS label
FROM (SELECT {key}, regexp_replace(regexp_replace(regexp_replace(regexp_replace({text}, '^[-*•·\s]+', ''), '\s+$', ''), '[:.* \t]+$', ''), '\s+$', '') AS x FROM {table})"""


@query(_SANITIZE.format(key="doc_id, line_no", text="line", table="(SELECT doc_id, i - 1 AS line_no, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"))
def label_sanitize_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every text as a label."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), n.sanitize_label(F.col("line")).alias("label"))


@query(_SANITIZE.format(key="p_partkey", text="'* ' || p_name || '.: '", table="part"))
def label_sanitize_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", n.sanitize_label(F.concat(F.lit("* "), "p_name", F.lit(".: "))).alias("label"))


@query("""SELECT c_custkey, unnest(regexp_extract_all(c_name || ': ' || repeat('_', (c_custkey % 5 + 3)::INT), '_+|[^_]+')) AS run FROM customer""")
def underscore_runs(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("c_name", F.lit(": "), F.expr("repeat('_', CAST(c_custkey % 5 + 3 AS INT))"))
    return table(spark, d, "customer").select("c_custkey", F.explode(n.underscore_runs(text)).alias("run"))


@query("""SELECT c_custkey, sum(CASE WHEN c = ' ' THEN 28 WHEN contains('ilIjtfr.,:;''!|', c) THEN 28 WHEN c IN ('_', '-') THEN 50 WHEN c IN ('m', 'w', 'M', 'W') THEN 86
  WHEN regexp_matches(c, '\\p{Lu}') THEN 70 WHEN regexp_matches(c, '[0-9]') THEN 56 ELSE 50 END)::BIGINT AS hundredths
FROM (SELECT c_custkey, unnest(string_split(c_name, '')) AS c FROM customer) GROUP BY c_custkey""".replace("\\\\", "\\"))
def text_width(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", n.width_hundredths(F.col("c_name")).alias("hundredths"))


@query("SELECT c_custkey, c_name AS back FROM customer")
def pdf_text_codec(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", n.pdf_text(n.pdf_bytes(F.col("c_name"))).alias("back"))


# checksums, codecs

@query("""WITH b AS (SELECT item_id, hex(encode(text)) AS h FROM benchmark),
x AS (SELECT item_id, length(h) // 2 AS n, i, ('0x' || substr(h, 2 * i - 1, 2))::INT AS v FROM (SELECT item_id, h, unnest(range(1, length(h) // 2 + 1)) AS i FROM b))
SELECT item_id, ((any_value(n) + sum((n - i + 1) * v)) % 65521 * 65536 + (1 + sum(v)) % 65521)::BIGINT AS adler FROM x GROUP BY item_id""")
def adler32_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", n.adler32(F.encode("text", "UTF-8")).alias("adler"))


def _each(rows: DataFrame, key: str, column: str, kernel) -> DataFrame:
    return files.per_file(rows.select(F.col(key).cast("string").alias("path"), F.col(column).cast("binary").alias("content")), "same boolean, shorter boolean", kernel).select(F.col("path").cast("long").alias(key), "same", "shorter")


def _zlib_kernel(own: bool):
    def kernel(data: bytes) -> list[tuple]:
        import zlib

        from foliospark.functions import deflate

        out = (deflate.compress_zlib if own else deflate.compress)(data)
        return [(zlib.decompress(out) == data and out[:2] == b"\x78\xda", len(out) < len(data) + 64)]

    return kernel


@query("SELECT doc_id, true AS same, true AS shorter FROM documents")
def zlib_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _each(table(spark, d, "documents"), "doc_id", "text", _zlib_kernel(False))


def _inflated(data: bytes) -> list[tuple]:
    import zlib

    from foliospark.functions import deflate

    out = deflate.compress_zlib(data)
    back = zlib.decompress(out)
    return [(len(back), zlib.adler32(back), len(out) < len(data) + 64)]


@query("""WITH b AS (SELECT doc_id, hex(encode(text)) AS h FROM documents),
x AS (SELECT doc_id, length(h) // 2 AS n, i, ('0x' || substr(h, 2 * i - 1, 2))::INT AS v FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 + 1)) AS i FROM b)),
s AS (SELECT doc_id, any_value(n) AS n, ((any_value(n) + sum((n - i + 1) * v)) % 65521 * 65536 + (1 + sum(v)) % 65521)::BIGINT AS adler FROM x GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_bytes, coalesce(adler, 1) AS adler, true AS shorter FROM documents LEFT JOIN s USING (doc_id)""")
def deflate_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Every text through this engine's own encoder and the platform's decoder: the checksum of what comes back."""
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    return files.per_file(rows, "n_bytes long, adler long, shorter boolean", _inflated).select(F.col("path").cast("long").alias("doc_id"), "n_bytes", "adler", "shorter")


@query("SELECT doc_id, true AS same, true AS shorter FROM documents")
def png_filter_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    def kernel(data: bytes) -> list[tuple]:
        from foliospark.functions.predictor import decode_png, encode_png_best

        rows = data + bytes(-len(data) % 24)  # the last row is padded
        out = encode_png_best(rows, 24, 3)
        return [(decode_png(out, 24, 3)[: len(data)] == data, len(out) == len(rows) // 24 * 25)]

    return _each(table(spark, d, "documents"), "doc_id", "text", kernel)


@query("""SELECT q, p_partkey, least(greatest((p_size * (CASE WHEN q < 50 THEN 5000 // q ELSE 200 - 2 * q END) + 50) // 100, 1), 255)::BIGINT AS scaled
FROM part, (SELECT unnest(range(1, 101))::INT AS q)""")
def quant_scale(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").withColumn("q", F.explode(F.sequence(F.lit(1), F.lit(100))))
    return rows.select("q", "p_partkey", n.quant_scale(F.col("p_size"), F.col("q")).alias("scaled"))


# images

_RASTER = """SELECT vec_id, i - 1 AS place, least(greatest(floor(embedding[i]::DOUBLE * 64 + 128), 0), 255)::BIGINT AS v
FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)"""


def _raster(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, place, v): vectors as 8 by 8 gray pixels."""
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("place", "x"))
    return rows.select("vec_id", F.col("place").cast("long").alias("place"), F.least(F.greatest(F.floor(F.col("x").cast("double") * 64 + 128), F.lit(0)), F.lit(255)).cast("long").alias("v"))


def _gray(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, data): vectors as 64 bytes of gray."""
    rows = _raster(spark, d).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("place", "v"))).alias("p"))
    return rows.select("vec_id", F.unhex(F.array_join(F.transform("p", lambda x: F.lpad(F.hex(x["v"]), 2, "0")), "")).alias("data"))


def _doubled(gray: bytes) -> bytes:
    """RGB bytes of 8 by 8 gray points, each as two by two."""
    import numpy as np

    return np.frombuffer(gray, np.uint8).reshape(8, 8).repeat(2, 0).repeat(2, 1).ravel().repeat(3).tobytes()


@query(f"""WITH p AS ({_RASTER}), s AS (
  SELECT a.vec_id, a.place // 32 AS by, a.place % 8 // 4 AS bx, count(*) AS n, sum(a.v)::DOUBLE AS sa, sum(b.v)::DOUBLE AS sb, sum(a.v * a.v)::DOUBLE AS saa, sum(b.v * b.v)::DOUBLE AS sbb, sum(a.v * b.v)::DOUBLE AS sab
  FROM p a JOIN p b ON b.vec_id = a.vec_id + 1 AND a.place = b.place GROUP BY 1, 2, 3)
SELECT vec_id, round(avg((2 * sa / n * sb / n + 6.5025) * (2 * (sab / n - sa / n * sb / n) + 58.5225)
  / ((sa / n * sa / n + sb / n * sb / n + 6.5025) * (greatest(saa / n - sa / n * sa / n, 0) + greatest(sbb / n - sb / n * sb / n, 0) + 58.5225))), 6) AS ssim
FROM s GROUP BY vec_id""")
def ssim_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Structural similarity of each raster to the next one, each point drawn as two by two: windows of eight then
    hold what the SQL's windows of four by four points do."""

    def kernel(data: bytes) -> list[tuple]:
        from foliospark.functions.images import ssim

        a, b = (_doubled(x) for x in (data[:64], data[64:]))
        return [(round(ssim(16, 16, a, b), 6),)]

    g = _gray(spark, d)
    pairs = g.join(g.select((F.col("vec_id") - 1).alias("vec_id"), F.col("data").alias("other")), "vec_id")
    rows = pairs.select(F.col("vec_id").cast("string").alias("path"), F.concat("data", "other").alias("content"))
    return files.per_file(rows, "ssim double", kernel).select(F.col("path").cast("long").alias("vec_id"), "ssim")


@query(f"""WITH p AS ({_RASTER}), q AS (SELECT p.vec_id, place, v, CASE WHEN place < label * 2 THEN (v + label * 12) % 256 ELSE v END AS u FROM p JOIN embeddings e ON p.vec_id = e.vec_id),
s AS (SELECT vec_id, place // 32 AS by, place % 8 // 4 AS bx, count(*) AS n, sum(v)::DOUBLE AS sa, sum(u)::DOUBLE AS sb, sum(v * v)::DOUBLE AS saa, sum(u * u)::DOUBLE AS sbb, sum(v * u)::DOUBLE AS sab FROM q GROUP BY 1, 2, 3)
SELECT vec_id, avg((2 * sa / n * sb / n + 6.5025) * (2 * (sab / n - sa / n * sb / n) + 58.5225)
  / ((sa / n * sa / n + sb / n * sb / n + 6.5025) * (greatest(saa / n - sa / n * sa / n, 0) + greatest(sbb / n - sb / n * sb / n, 0) + 58.5225))) >= 0.98 AS alike
FROM s GROUP BY vec_id""")
def similarity_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether a raster passes for one that differs in as many points as its label says."""

    def kernel(data: bytes) -> list[tuple]:
        from foliospark.functions.images import passes_gate

        label, a = data[0], data[1:]
        b = bytes((v + label * 12) % 256 if k < label * 2 else v for k, v in enumerate(a))
        return [(passes_gate((16, 16, _doubled(a)), (16, 16, _doubled(b))),)]

    g = _gray(spark, d).join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    rows = g.select(F.col("vec_id").cast("string").alias("path"), F.concat(F.unhex(F.lpad(F.hex("label"), 2, "0")), "data").alias("content"))
    return files.per_file(rows, "alike boolean", kernel).select(F.col("path").cast("long").alias("vec_id"), "alike")


@query(f"""WITH RECURSIVE p AS ({_RASTER}), s(vec_id, k, byte, state) AS (
  SELECT vec_id, place, v, (xor(14695981039346656037::UHUGEINT, v::UHUGEINT) * 1099511628211) % 18446744073709551616::UHUGEINT FROM p WHERE place = 0
  UNION ALL SELECT p.vec_id, p.place, p.v, (xor(s.state, p.v::UHUGEINT) * 1099511628211) % 18446744073709551616::UHUGEINT FROM s JOIN p ON p.vec_id = s.vec_id AND p.place = s.k + 1),
o AS (SELECT vec_id, k % 32 AS slot, ((state >> (8 * (k % 8))::UHUGEINT) % 256)::BIGINT AS b FROM s UNION ALL SELECT vec_id, (k + 7) % 32, byte FROM s UNION ALL SELECT DISTINCT vec_id, 0, 64 FROM s),
x AS (SELECT vec_id, slot, bit_xor(b) AS b FROM o GROUP BY vec_id, slot)
SELECT vec_id, string_agg(lpad(lower(hex(b)), 2, '0'), '' ORDER BY slot) AS fold FROM x GROUP BY vec_id""")
def fnv_folds(spark: SparkSession, d: str) -> DataFrame:
    """The 32-byte fingerprint of each raster."""

    def kernel(data: bytes) -> list[tuple]:
        from foliospark.functions.images import fnv_fold

        return [(fnv_fold(data).hex(),)]

    rows = _gray(spark, d).select(F.col("vec_id").cast("string").alias("path"), F.col("data").alias("content"))
    return files.per_file(rows, "fold string", kernel).select(F.col("path").cast("long").alias("vec_id"), "fold")


@query(f"""WITH p AS ({_RASTER}) SELECT vec_id, place // 8 AS row_no, string_agg(lpad(lower(hex(u)), 2, '0'), '' ORDER BY place) AS samples
FROM (SELECT vec_id, place, (sum(v) OVER (PARTITION BY vec_id, place // 8 ORDER BY place) % 256)::BIGINT AS u FROM p) GROUP BY vec_id, row_no""")
def tiff_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rasters taken as differences to the left: the rows that they stand for."""

    def kernel(data: bytes) -> list[tuple]:
        from foliospark.functions.predictor import decode_tiff

        out = decode_tiff(data, 8, 1)
        return [(k, out[8 * k : 8 * k + 8].hex()) for k in range(8)]

    rows = _gray(spark, d).select(F.col("vec_id").cast("string").alias("path"), F.col("data").alias("content"))
    return files.per_file(rows, "row_no long, samples string", kernel).select(F.col("path").cast("long").alias("vec_id"), "row_no", "samples")


@query(f"""WITH p AS ({_RASTER}), n AS (SELECT vec_id, place // 8 AS row_no, place % 8 AS x, v, coalesce(lag(v) OVER (PARTITION BY vec_id, place // 8 ORDER BY place), 0) AS a, coalesce(lag(v) OVER (PARTITION BY vec_id, place % 8 ORDER BY place), 0) AS b FROM p),
m AS (SELECT *, CASE WHEN row_no = 0 OR x = 0 THEN 0 ELSE lag(b) OVER (PARTITION BY vec_id, row_no ORDER BY x) END AS c FROM n),
g AS (SELECT *, a + b - c AS q FROM m),
f AS (SELECT vec_id, row_no, sum(v) AS s0, sum((v - a + 256) % 256) AS s1, sum((v - b + 256) % 256) AS s2, sum((v - (a + b) // 2 + 256) % 256) AS s3,
  sum((v - CASE WHEN abs(q - a) <= abs(q - b) AND abs(q - a) <= abs(q - c) THEN a WHEN abs(q - b) <= abs(q - c) THEN b ELSE c END + 256) % 256) AS s4 FROM g GROUP BY vec_id, row_no)
SELECT vec_id, row_no, CASE least(s0, s1, s2, s3, s4) WHEN s0 THEN 0 WHEN s1 THEN 1 WHEN s2 THEN 2 WHEN s3 THEN 3 ELSE 4 END::INT AS kind, least(s0, s1, s2, s3, s4)::BIGINT AS total FROM f""")
def png_filter_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The filter of least sum that each row of a raster gets, and that sum."""

    def kernel(data: bytes) -> list[tuple]:
        from foliospark.functions.predictor import encode_png_best

        out = encode_png_best(data, 8, 1)
        return [(k, out[9 * k], sum(out[9 * k + 1 : 9 * k + 9])) for k in range(8)]

    rows = _gray(spark, d).select(F.col("vec_id").cast("string").alias("path"), F.col("data").alias("content"))
    return files.per_file(rows, "row_no long, kind int, total long", kernel).select(F.col("path").cast("long").alias("vec_id"), "row_no", "kind", "total")


@query(f"""WITH p AS (SELECT vec_id, place, v, lag(v) OVER (PARTITION BY vec_id, place // 8 ORDER BY place) AS l FROM ({_RASTER})),
s AS (SELECT vec_id, count(DISTINCT v) AS levels, count(*) FILTER (WHERE abs(v - l) > 40) / 64.0::DOUBLE AS edges, count(*) FILTER (WHERE v = l) / 64.0::DOUBLE AS runs FROM p GROUP BY vec_id)
SELECT vec_id, CASE WHEN levels <= 4 THEN 'Bitonal' WHEN levels <= 24 AND edges > 0.08 THEN 'LineArt' WHEN levels < 512 AND (runs > 0.35 OR edges > 0.12) THEN 'Screenshot' ELSE 'Photo' END AS kind FROM s""")
def image_classify(spark: SparkSession, d: str) -> DataFrame:
    def kernel(data: bytes) -> list[tuple]:
        from foliospark.functions.images import classify

        return [(classify(8, 8, bytes(b for v in data for b in (v, v, v))),)]

    out = files.per_file(_gray(spark, d).select(F.col("vec_id").cast("string").alias("path"), F.col("data").alias("content")), "kind string", kernel)
    return out.select(F.col("path").cast("long").alias("vec_id"), "kind")


@query(f"""SELECT vec_id, place // 16 AS y, place % 8 // 2 AS x, (sum(v) // 4)::BIGINT AS v FROM ({_RASTER}) GROUP BY 1, 2, 3""")
def box_resample(spark: SparkSession, d: str) -> DataFrame:
    """Box means of 2 by 2 pixels, truncated."""

    def kernel(data: bytes) -> list[tuple]:
        import numpy as np

        from foliospark.functions.images import resize

        small = resize(np.frombuffer(data, np.uint8).reshape(8, 8, 1), 4, 4)
        return [(y, x, int(small[y, x, 0])) for y in range(4) for x in range(4)]

    rows = _gray(spark, d).select(F.col("vec_id").cast("string").alias("path"), F.col("data").alias("content"))
    return files.per_file(rows, "y long, x long, v long", kernel).select(F.col("path").cast("long").alias("vec_id"), "y", "x", "v")


@query(f"""SELECT vec_id, sum((77 * v + 150 * (255 - v) + 29 * place) >> 8)::BIGINT AS luma FROM ({_RASTER}) GROUP BY vec_id""")
def luma_sum(spark: SparkSession, d: str) -> DataFrame:
    return _raster(spark, d).groupBy("vec_id").agg(F.sum(n.luma(F.col("v"), 255 - F.col("v"), F.col("place"))).alias("luma"))


@query("""SELECT p_partkey, CASE WHEN greatest(w, h) <= 1920 THEN w ELSE greatest(1, round(w * (1920::DOUBLE / greatest(w, h))))::BIGINT END AS w,
  CASE WHEN greatest(w, h) <= 1920 THEN h ELSE greatest(1, round(h * (1920::DOUBLE / greatest(w, h))))::BIGINT END AS h
FROM (SELECT p_partkey, p_partkey * 3 % 5000 + 1 AS w, (p_size * 97 % 4000 + 1)::BIGINT AS h FROM part)""")
def resample_fit(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", n.fit_size(F.expr("p_partkey * 3 % 5000 + 1"), F.expr("CAST(p_size * 97 % 4000 + 1 AS BIGINT)"), 1920).alias("s"))
    return rows.select("p_partkey", "s.w", "s.h")


def entry(spark: SparkSession) -> DataFrame:
    return inspect_census(spark, "/root/testdata/sf0.001")
