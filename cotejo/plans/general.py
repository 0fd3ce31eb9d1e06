"""Queries of the two general problems: differences of copies (3) and heavy keys (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.operators.diff import ONLY_LEFT, ONLY_RIGHT, diff, latest
from cotejo.operators.skew import heavy_keys, salted_aggregate, salted_distinct, salted_join, shares_at_least
from cotejo.sources import table

CELL_KEY = ["external_id", "tabla", "celda"]
CELL_FIELDS = ["row", "col", "rowspan", "colspan"]
#: The share of a table's rows from which a key counts as heavy.
HEAVY = 0.04


def _cells(spark: SparkSession, root: str, name: str) -> DataFrame:
    return latest(table(spark, root, name), CELL_KEY, "leido_en", CELL_FIELDS)


def _differences(spark: SparkSession, root: str) -> DataFrame:
    pdf, xml = _cells(spark, root, "celdas_pdf"), _cells(spark, root, "celdas_xml")
    named = F.when(F.col("field") == ONLY_LEFT, "solo_pdf").when(F.col("field") == ONLY_RIGHT, "solo_xml").otherwise(F.col("field"))
    return diff(pdf, xml, CELL_KEY, CELL_FIELDS, unique_keys=True).withColumn("campo", named)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return _differences(spark, root).select(*CELL_KEY, "campo")


def p3_values(spark: SparkSession, root: str) -> DataFrame:
    """The differing values beside each other."""
    d = _differences(spark, root)
    return d.select(*CELL_KEY, "campo", F.col("left_value").alias("valor_pdf"), F.col("right_value").alias("valor_xml"))


def p3_by_field(spark: SparkSession, root: str) -> DataFrame:
    """Differences and tables touched, by field."""
    d = _differences(spark, root).groupBy("campo", "external_id", "tabla").agg(F.count(F.lit(1)).alias("n"))
    return d.groupBy("campo").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_tablas"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    parts = []
    for name, fields in (("censo_tablas", ["external_id", "tablas"]), ("seleccion", ["n_tablas_del_documento"])):
        found = shares_at_least(table(spark, root, name), fields, HEAVY)
        parts.append(found.select(F.lit(name).alias("tabla"), F.col("field").alias("campo"), F.col("value").alias("clave")))
    return parts[0].unionAll(parts[1])


def p5_distinct_by_bulletin(spark: SparkSession, root: str) -> DataFrame:
    """How many extractors and how many different counts each bulletin has."""
    d = salted_distinct(table(spark, root, "censo_tablas"), ["external_id"], ["extractor_id", "tablas"])
    return d.select("external_id", F.col("extractor_id").alias("extractores"), F.col("tablas").alias("cuentas"))


def p5_pages_by_extractor(spark: SparkSession, root: str) -> DataFrame:
    """Each extractor's lines beside the pages of their bulletins: the census, of which few bulletins have most lines, joined with what the selection knows of each."""
    censo = table(spark, root, "censo_tablas").select("external_id", "extractor_id", "tablas")
    pages = table(spark, root, "seleccion").groupBy("external_id").agg(F.max("n_pages").alias("paginas"))
    j = salted_join(censo, pages, "external_id", heavy_keys(censo, "external_id", HEAVY), how="left")
    return j.groupBy("extractor_id").agg(F.count(F.lit(1)).alias("lineas"), F.count("paginas").alias("con_paginas"), F.sum("paginas").alias("paginas"), F.sum("tablas").alias("tablas"))


CENSUS = [("lineas", "count", None), ("contadas", "count", "tablas"), ("tablas", "sum", "tablas"), ("tablas_min", "min", "tablas"), ("tablas_max", "max", "tablas"), ("ultimo_us", "max", "recibido_us")]


def p5_census_by_bulletin(spark: SparkSession, root: str) -> DataFrame:
    censo = table(spark, root, "censo_tablas").withColumn("recibido_us", F.unix_micros("recibido_en"))
    return salted_aggregate(censo, ["external_id"], CENSUS, heavy_keys(censo, "external_id", HEAVY))


def p5_census_by_count(spark: SparkSession, root: str) -> DataFrame:
    censo = table(spark, root, "censo_tablas").withColumns({"contado_us": F.unix_micros("contado_en"), "recibido_us": F.unix_micros("recibido_en")})
    return salted_aggregate(censo, ["tablas"], [("lineas", "count", None), ("primero_us", "min", "contado_us"), ("ultimo_us", "max", "recibido_us")], heavy_keys(censo, "tablas", HEAVY))


def p5_selection_by_count(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "seleccion").withColumn("elegido_us", F.unix_micros("elegido_en"))
    aggs = [("filas", "count", None), ("paginas", "sum", "n_pages"), ("con_paginas", "count", "n_pages"), ("ultimo_us", "max", "elegido_us")]
    return salted_aggregate(s, ["n_tablas_del_documento"], aggs, heavy_keys(s, "n_tablas_del_documento", HEAVY))


QUERIES = {f.__name__: f for f in (p3_found, p3_values, p3_by_field, p5_found, p5_census_by_bulletin, p5_census_by_count, p5_selection_by_count, p5_distinct_by_bulletin, p5_pages_by_extractor)}

_LAST = """
WITH p AS (SELECT external_id, tabla, celda, "row", col, rowspan, colspan FROM (SELECT *, row_number() OVER (PARTITION BY external_id, tabla, celda
  ORDER BY leido_en DESC NULLS LAST, "row" DESC NULLS LAST, col DESC NULLS LAST, rowspan DESC NULLS LAST, colspan DESC NULLS LAST) AS rn FROM celdas_pdf) WHERE rn = 1),
x AS (SELECT external_id, tabla, celda, "row", col, rowspan, colspan FROM (SELECT *, row_number() OVER (PARTITION BY external_id, tabla, celda
  ORDER BY leido_en DESC NULLS LAST, "row" DESC NULLS LAST, col DESC NULLS LAST, rowspan DESC NULLS LAST, colspan DESC NULLS LAST) AS rn FROM celdas_xml) WHERE rn = 1),
j AS (SELECT coalesce(p.external_id, x.external_id) AS external_id, coalesce(p.tabla, x.tabla) AS tabla, coalesce(p.celda, x.celda) AS celda,
  p.external_id IS NULL AS sin_pdf, x.external_id IS NULL AS sin_xml, p."row" AS pr, x."row" AS xr, p.col AS pc, x.col AS xc, p.rowspan AS prs, x.rowspan AS xrs, p.colspan AS pcs, x.colspan AS xcs
  FROM p FULL JOIN x ON p.external_id = x.external_id AND p.tabla = x.tabla AND p.celda = x.celda),
d AS (SELECT external_id, tabla, celda, 'solo_pdf' AS campo, NULL::VARCHAR AS valor_pdf, NULL::VARCHAR AS valor_xml FROM j WHERE sin_xml
UNION ALL SELECT external_id, tabla, celda, 'solo_xml', NULL, NULL FROM j WHERE sin_pdf
UNION ALL SELECT external_id, tabla, celda, 'row', pr::VARCHAR, xr::VARCHAR FROM j WHERE NOT sin_pdf AND NOT sin_xml AND pr IS DISTINCT FROM xr
UNION ALL SELECT external_id, tabla, celda, 'col', pc::VARCHAR, xc::VARCHAR FROM j WHERE NOT sin_pdf AND NOT sin_xml AND pc IS DISTINCT FROM xc
UNION ALL SELECT external_id, tabla, celda, 'rowspan', prs::VARCHAR, xrs::VARCHAR FROM j WHERE NOT sin_pdf AND NOT sin_xml AND prs IS DISTINCT FROM xrs
UNION ALL SELECT external_id, tabla, celda, 'colspan', pcs::VARCHAR, xcs::VARCHAR FROM j WHERE NOT sin_pdf AND NOT sin_xml AND pcs IS DISTINCT FROM xcs)
"""


def _heavy_sql(name: str, field: str) -> str:
    return f"SELECT '{name}' AS tabla, '{field}' AS campo, {field}::VARCHAR AS clave FROM {name} WHERE {field} IS NOT NULL GROUP BY {field} HAVING count(*) >= {HEAVY} * (SELECT count(*) FROM {name})"


SQL = {
    "p3_found": _LAST + "SELECT external_id, tabla, celda, campo FROM d",
    "p3_values": _LAST + "SELECT * FROM d",
    "p3_by_field": _LAST + "SELECT campo, count(*) AS n, count(DISTINCT (external_id, tabla)) AS n_tablas FROM d GROUP BY campo",
    "p5_found": " UNION ALL ".join(_heavy_sql(*x) for x in (("censo_tablas", "external_id"), ("censo_tablas", "tablas"), ("seleccion", "n_tablas_del_documento"))),
    "p5_distinct_by_bulletin": "SELECT external_id, count(DISTINCT extractor_id) AS extractores, count(DISTINCT tablas) AS cuentas FROM censo_tablas GROUP BY external_id",
    "p5_pages_by_extractor": "SELECT extractor_id, count(*) AS lineas, count(paginas) AS con_paginas, sum(paginas)::BIGINT AS paginas, sum(tablas)::BIGINT AS tablas FROM censo_tablas LEFT JOIN (SELECT external_id, max(n_pages) AS paginas FROM seleccion GROUP BY external_id) USING (external_id) GROUP BY extractor_id",
    "p5_census_by_bulletin": "SELECT external_id, count(*) AS lineas, count(tablas) AS contadas, sum(tablas)::BIGINT AS tablas, min(tablas) AS tablas_min, max(tablas) AS tablas_max, epoch_us(max(recibido_en)) AS ultimo_us FROM censo_tablas GROUP BY external_id",
    "p5_census_by_count": "SELECT tablas, count(*) AS lineas, epoch_us(min(contado_en)) AS primero_us, epoch_us(max(recibido_en)) AS ultimo_us FROM censo_tablas GROUP BY tablas",
    "p5_selection_by_count": "SELECT n_tablas_del_documento, count(*) AS filas, sum(n_pages)::BIGINT AS paginas, count(n_pages) AS con_paginas, epoch_us(max(elegido_en)) AS ultimo_us FROM seleccion GROUP BY n_tablas_del_documento",
}
