"""Journals, manifests and summaries: JSON that programs before this one have written.

A journal has a JSON object per line and is appended to while a campaign runs. Schemas are declared, never inferred.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import re
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.sources.summaries import addresses

# Why an extraction may have failed.
FAILURES = ("timeout", "out_of_memory", "unsupported_format", "corrupt_pdf", "encrypted_pdf", "no_text_layer", "provider_error", "policy_blocked")
_TABLE = (
    "struct<cells:array<struct<row:int,col:int,rowspan:int,colspan:int,text:string,is_header:boolean>>,n_rows:int,n_cols:int,"
    "page_span:array<int>,caption:string,expresses_spans:boolean,source_format:string>"
)
EXTRACTION = (
    "extractor_id string, extractor_version string, doc_ref struct<entity:string,external_id:string,published_on:date,url:string,kind:string>, text string, "
    f"tables array<{_TABLE}>, native_format string, pages_processed int, cost struct<eur:string,usd:string,estimated:boolean,measured:boolean,wall_ms:bigint>, "
    "latency_ms bigint, warnings array<string>, failed boolean, failure_reason string"
)
_BROKEN = "_broken"


def read_journal(spark: SparkSession, path: str, schema: str = EXTRACTION) -> DataFrame:
    """Every line of a journal: the columns of `schema`, and _broken with the text of a line that is no JSON of that form, else null."""
    return spark.read.schema(f"{schema}, {_BROKEN} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BROKEN).json(path)


def readable(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col(_BROKEN).isNull()).drop(_BROKEN)


def line_counts(lines: DataFrame) -> DataFrame:
    """lines, broken, and named (those that have the first field): nothing is swallowed."""
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.count(_BROKEN).alias("broken"), F.count(F.when(F.col(_BROKEN).isNull(), F.col(lines.columns[0]))).alias("named"))


def repeated(lines: DataFrame, *key: Column) -> DataFrame:
    """The keys that more than one line has, which is an error of whoever wrote them: k0, k1, ..., n."""
    named = [k.alias(f"k{i}") for i, k in enumerate(key)]
    return lines.groupBy(*named).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def contradictions(extractions: DataFrame) -> DataFrame:
    """Extractions whose failure and reason don't fit, or of an unknown reason: all columns and why."""
    failed, reason = F.coalesce("failed", F.lit(False)), F.col("failure_reason")
    why = (
        F.when(failed & reason.isNull(), "failed without a reason").when(~failed & reason.isNotNull(), "a reason without failing")
        .when(reason.isNotNull() & ~reason.isin(*FAILURES), "unknown reason")
    )
    return extractions.withColumn("why", why).filter("why IS NOT NULL")


def append_journal(extractions: DataFrame, path: str) -> None:
    extractions.write.mode("append").json(path)


def done(lines: DataFrame) -> DataFrame:
    """extractor, doc: the units a journal has; broken lines don't count, their units will be done again. Only the two names are decoded."""
    return readable(lines).select(F.col("extractor_id").alias("extractor"), F.col("doc_ref.external_id").alias("doc")).filter("doc IS NOT NULL").distinct()


MANIFEST = (
    "esquema string, entidad string, ventana struct<desde:date,hasta:date>, documentos array<struct<external_id:string,fecha_sumario:date,seccion:string,"
    "url_pdf:string,url_xml:string,sha256:string,n_pages:int,strata:array<string>,fetched_at:timestamp,cosechado_en:date>>"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row per document of a manifest (one JSON object), strata sorted and distinct."""
    whole = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    d = whole.select("entidad", F.posexplode("documentos").alias("pos", "_d")).select("entidad", "pos", "_d.*")
    return d.withColumn("strata", F.array_sort(F.array_distinct(F.coalesce("strata", F.array().cast("array<string>")))))


def ordered(documents: DataFrame, ids: list[str] | DataFrame | None, key: str, pos: str) -> DataFrame:
    """The documents asked for, in the order asked for; all in their own order if none are named. A name asked for twice comes twice.

    A long list is a table: `key` and _asked, by which it is ordered, and by the name where that is the same.
    """
    if ids is None:
        return documents.orderBy(pos)
    asked = ids if isinstance(ids, DataFrame) else documents.sparkSession.createDataFrame(list(enumerate(ids)), f"_asked int, `{key}` string")
    return asked.join(documents, key).orderBy("_asked", key, pos).drop("_asked")


def with_bytes(documents: DataFrame, files: DataFrame, name: str, sha: str) -> DataFrame:
    """`documents` with content BINARY and state: ok, missing, empty or altered (the digest of the bytes is not the one written). files: name, content."""
    j = documents.join(files, name, "left")
    state = F.when(F.col("content").isNull(), "missing").when(F.length("content") == 0, "empty").when(F.sha2("content", 256) != F.lower(sha), "altered").otherwise("ok")
    return j.withColumn("state", state)


ITEM = "struct<identificador:string,titulo:string,url_pdf:string,url_xml:string,paginas:string>"
SUMMARY = f"dia date, secciones array<struct<codigo:string,departamentos:array<struct<nombre:string,epigrafes:array<struct<nombre:string,items:array<{ITEM}>>>,items:array<{ITEM}>>>>>"


#: Levels of a summary, each a list that is written as its one element where it has only one.
LEVELS = ("secciones", "departamentos", "epigrafes", "items")


def _as_lists(node: object, keys: tuple[str, ...]) -> object:
    if isinstance(node, dict):
        return {k: [_as_lists(v, keys)] if k in keys and isinstance(v, dict) else _as_lists(v, keys) for k, v in node.items()}
    return [_as_lists(v, keys) for v in node] if isinstance(node, list) else node


def listed(json_text: Column, keys: tuple[str, ...] = LEVELS) -> Column:
    """A day's summary as JSON in which each of `keys` that holds one object instead of a list holds a list, at every level; null for a text that is no JSON."""

    @F.pandas_udf("string")
    def lists(values: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return None if text is None else json.dumps(_as_lists(json.loads(text), keys), ensure_ascii=False)
            except ValueError:
                return None

        return values.map(one, na_action="ignore")

    return lists(json_text)


def summary_items(days: DataFrame, text: str) -> DataFrame:
    """dia, seccion, departamento, epigrafe (null outside one), identificador, titulo, url_pdf, url_xml, paginas of a column of summaries as JSON."""
    d = days.select(F.from_json(listed(F.col(text)), SUMMARY).alias("s")).select("s.dia", F.explode("s.secciones").alias("x"))
    d = d.select("dia", F.col("x.codigo").alias("seccion"), F.explode("x.departamentos").alias("y"))
    flat = d.select("dia", "seccion", F.col("y.nombre").alias("departamento"), F.lit(None).cast("string").alias("epigrafe"), F.explode("y.items").alias("i"))
    deep = d.select("dia", "seccion", F.col("y.nombre").alias("departamento"), F.explode("y.epigrafes").alias("e"))
    deep = deep.select("dia", "seccion", "departamento", F.col("e.nombre").alias("epigrafe"), F.explode("e.items").alias("i"))
    return flat.unionAll(deep).select("dia", "seccion", "departamento", "epigrafe", "i.*")


def urls(json_text: Column) -> Column:
    """The addresses under keys url_..., at any depth, in order, as the JSON means them (escapes decoded); none in a null or a text that is no JSON."""

    @F.pandas_udf("array<string>")
    def found(values: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[str]:
            try:
                return [] if text is None else list(addresses(json.loads(text)))
            except ValueError:
                return []

        return pd.Series([one(None if t is None else t) for t in values], dtype=object)

    return found(json_text)


def discovered(items: DataFrame, sections: list[str], summary_prefix: str) -> DataFrame:
    """Items of the sections wanted, without the summaries' own, and whether both addresses are there (those without are counted, not dropped)."""
    keep = items.filter(F.col("seccion").isin(*sections) & ~F.col("identificador").startswith(summary_prefix))
    return keep.withColumn("complete", F.col("url_pdf").isNotNull() & F.col("url_xml").isNotNull())


def days(spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
    """dia: each day from first to last; none if last is before first."""
    if last < first:
        return spark.createDataFrame([], "dia date")
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("dia"))


def population(census: DataFrame, samples: DataFrame) -> DataFrame:
    """documento, regimen of a campaign: the whole census, and the samples of the strata without tables."""
    return census.select("documento", F.lit("censo").alias("regimen")).unionByName(samples.select("documento", F.lit("muestra").alias("regimen")))


def population_cut(documents: DataFrame, n: int | None, order: list[str]) -> DataFrame:
    """The first n documents in `order`, all if n is None: a campaign may be cut, but never to documents that depend on how they lie."""
    return documents if n is None else documents.orderBy(*order).limit(n)


def refuse_network(offline: bool, extractors: DataFrame, local: str = "runs_locally") -> DataFrame:
    """The extractors as they are; offline, one that is not local is an error, before its first unit."""
    if offline and (far := [r[0] for r in extractors.filter(~F.col(local)).select(extractors.columns[0]).limit(20).collect()]):
        raise PermissionError(f"offline, but not local: {', '.join(map(str, far))}")
    return extractors


def seal(path: str, inputs: dict[str, bytes], extra: dict | None = None) -> dict:
    """Writes what a run starts from, before its first unit, or compares it with what a run before it wrote.

    A resumed run on other inputs is refused.
    """
    now = {"inputs": {k: hashlib.sha256(v).hexdigest() for k, v in sorted(inputs.items())}, "extra": extra or {}}
    p = Path(path)
    if p.exists():
        before = json.loads(p.read_text())
        if before != now:
            raise ValueError(f"{path}: the run was sealed with other inputs")
        return before
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(json.dumps(now, sort_keys=True, indent=1))
    return now


def stable_json(row: Column) -> Column:
    """A struct as JSON; its fields in the order of the struct, so sort them by name."""
    return F.to_json(row, {"ignoreNullFields": "false"})


def valid_url(url: Column, domain: str) -> Column:
    return F.coalesce(url.rlike(rf"^https://([a-z0-9-]+\.)*{re.escape(domain)}/"), F.lit(False))
