"""Manifests as a whole: what they say of their harvest, checked against themselves, their documents and the plan that was fixed before it.

A manifest is one JSON object. A reader gives a row per manifest; every check gives rows of the manifest's key and the rule that is broken, so sound manifests have no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.operators.corpus import violations
from cotejo.sources.journal import valid_url

_DOCUMENT = "external_id string, fecha_sumario string, seccion string, url_pdf string, url_xml string, sha256 string, n_pages int, strata array<string>, fetched_at string, cosechado_en string"
WHOLE = (
    "esquema string, entidad string, plan_hash string, ventana struct<desde:string,hasta:string>, "
    "licencia_corpus struct<name:string,source_url:string,verified_on:string,may_redistribute_content:boolean,may_redistribute_derived:boolean>, atribucion string, licencia_codigo string, "
    "emparejado struct<umbral_coherencia:double,intentados:bigint,aceptados:bigint,descartados:bigint,tasa_descarte:double,por_causa:map<string,bigint>>, dias_sin_boletin array<string>, "
    f"ritmo struct<espaciado_mediano_s:double,espaciado_minimo_s:double,n_espaciados:bigint>, documentos array<struct<{_DOCUMENT.replace(' string', ':string').replace(' int', ':int').replace(' array', ':array')}>>"
)
PLAN = "ventana struct<desde:string,hasta:string>, objetivo_emparejados bigint, filtro_secciones array<string>, ritmo_minimo_s double"


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """A row per manifest of the files at `path`, each one JSON object, and _file. A field that is missing is null."""
    return spark.read.schema(WHOLE).option("multiLine", True).json(path).withColumn("_file", F.input_file_name())


def parsed(df: DataFrame, text: str, schema: str = WHOLE) -> DataFrame:
    """`df` with the fields of a column of manifests, or of plans, as JSON. Text that is no such object has null fields."""
    return df.select(*[c for c in df.columns if c != text], F.from_json(text, schema).alias("_m")).select("*", "_m.*").drop("_m")


def sorted_json(fields: dict[str, Column]) -> Column:
    """A JSON object whose keys are in order, so that its text depends on what it says alone; nulls are left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def _blank(c: str | Column) -> Column:
    return F.coalesce(F.trim(F.col(c) if isinstance(c, str) else c), F.lit("")) == ""


def shape_problems(manifests: DataFrame, key: str, schema: str) -> DataFrame:
    """`key`, rule: the counts must be there and add up, the rate must be theirs and come with its threshold and window, every discard must have its cause, and
    both licences and the attribution must be named."""
    e = "emparejado."
    tried, taken, dropped = (F.col(e + c) for c in ("intentados", "aceptados", "descartados"))
    causes = F.aggregate(F.coalesce(F.map_values(e + "por_causa"), F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, b: a + F.coalesce(b, F.lit(0)))
    rules = {
        "schema": ~F.col("esquema").eqNullSafe(F.lit(schema)),
        "counts": tried.isNull() | taken.isNull() | dropped.isNull() | (tried < 0),
        "balance": taken + dropped != tried,
        "documents": taken != F.coalesce(F.size("documentos"), F.lit(0)),
        "rate": (tried > 0) & (F.abs(F.col(e + "tasa_descarte") - dropped / tried) > 1e-9),
        "causes": causes != F.coalesce(dropped, F.lit(0)),
        "threshold": F.col(e + "umbral_coherencia").isNull(),
        "window": _blank("ventana.desde") | _blank("ventana.hasta"),
        "attribution": _blank("atribucion"),
        "licence": _blank("licencia_corpus.name"),
        "code licence": _blank("licencia_codigo"),
    }
    return violations(manifests, key, rules)


def documents_of(manifests: DataFrame, key: str) -> DataFrame:
    """`key`, pos and the document's fields: a row per document."""
    return manifests.select(key, F.posexplode("documentos").alias("pos", "_d")).select(key, "pos", "_d.*")


def document_problems(documents: DataFrame, key: Sequence[str], domain: str) -> DataFrame:
    """`key`, rule: where a document comes from must be known, its digest must be one, and its addresses of the domain. Documents of a manifest (the first of `key`) that have the digest
    of another are the same file: `same digest`, all but the first by pos."""
    keyed = documents.withColumn("_k", F.struct(*key))
    rules = {f"no {c}": _blank(c) for c in ("fecha_sumario", "seccion", "url_pdf", "url_xml", "cosechado_en")}
    rules["digest"] = ~F.coalesce(F.col("sha256"), F.lit("")).rlike("^[0-9a-f]{64}$")
    rules |= {f"foreign {c}": ~_blank(c) & ~valid_url(F.col(c), domain) for c in ("url_pdf", "url_xml")}
    alone = violations(keyed, "_k", rules).select("_k.*", "rule")
    sound = documents.filter(F.col("sha256").rlike("^[0-9a-f]{64}$"))
    first = sound.groupBy(F.col(key[0]).alias("_m"), F.col("sha256").alias("_s")).agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    twice = sound.join(first, (F.col(key[0]) == F.col("_m")) & (F.col("sha256") == F.col("_s"))).filter(F.col("pos") > F.col("_first"))
    return alone.unionAll(twice.select(*key, F.lit("same digest")))


def plan_problems(manifests: DataFrame, plans: DataFrame, key: str) -> DataFrame:
    """`key`, rule: what was harvested must be what was planned. plans: `key`, digest (of the plan's bytes) and the fields of PLAN.

    A manifest without a plan's digest is tied to no plan; a pace that was promised and not measured counts against it.
    """
    p = plans.select(key, F.col("digest").alias("_digest"), F.struct("ventana", "objetivo_emparejados", "filtro_secciones", "ritmo_minimo_s").alias("_p"))
    j = manifests.join(p, key)
    wanted = F.coalesce(F.col("_p.filtro_secciones"), F.array().cast("array<string>"))
    sections = F.transform(F.coalesce("documentos", F.array().cast(dict(manifests.dtypes)["documentos"])), lambda d: F.coalesce(d["seccion"], F.lit("")))
    pace, least = F.col("ritmo.espaciado_mediano_s"), F.coalesce(F.col("_p.ritmo_minimo_s"), F.lit(0.0))
    rules = {
        "no plan": _blank("plan_hash"),
        "other plan": ~_blank("plan_hash") & (F.col("plan_hash") != F.col("_digest")),
        "from": ~F.col("ventana.desde").eqNullSafe(F.col("_p.ventana.desde")),
        "to": ~F.col("ventana.hasta").eqNullSafe(F.col("_p.ventana.hasta")),
        "target": F.coalesce("emparejado.aceptados", F.lit(0)) < F.col("_p.objetivo_emparejados"),
        "sections": (F.size(wanted) > 0) & (F.size(F.array_except(sections, wanted)) > 0),
        "pace not measured": (least > 0) & pace.isNull(),
        "pace": (least > 0) & (pace < least),
    }
    return violations(j, key, rules)


def companion_seals(documents: DataFrame, files: DataFrame, key: str, name: str) -> DataFrame:
    """`key`, state, sha256, bytes of each document's companion file: `sealed`, or `missing` where there is none or the document has no name. files: `name` (document), content.

    The documents are gone through, not the files: a file that no document names is no part of the corpus. With binary_files as files, content is read where it lies;
    Spark's file source passes over empty files, so these are missing there.
    """
    digests = files.filter("content IS NOT NULL").select(F.col(name).alias("_name"), F.sha2("content", 256).alias("sha256"), F.length("content").cast("bigint").alias("bytes"))
    j = documents.select(key).join(digests, F.col(key) == F.col("_name"), "left")
    return j.select(key, F.when(F.col("sha256").isNull(), "missing").otherwise("sealed").alias("state"), "sha256", "bytes")


def binary_files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """document, content of the files at `path` whose names end in `suffix`; the document is the name before it."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path)
    return f.select(F.regexp_extract("path", rf"([^/]+)\Q{suffix}\E$", 1).alias("document"), "content")
