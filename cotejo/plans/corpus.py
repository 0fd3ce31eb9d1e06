"""Texts, markup, grids, manifests and journals over the domain's tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.functions import text as T
from cotejo.operators import corpus, grid, manifest, running
from cotejo.operators.diff import latest
from cotejo.sources import cut, journal, table, work_path

TABLE = ["external_id", "tabla"]
FIRST_DAY, LAST_DAY = dt.date(2031, 1, 1), dt.date(2031, 12, 31)


def _docs(spark, root) -> DataFrame:
    return table(spark, root, "documents")


def doc_keys(spark: SparkSession, root: str) -> DataFrame:
    return _docs(spark, root).select("doc_id", T.doc_key(F.coalesce("source", F.lit("%/")), F.col("external_id")).alias("clave"))


def text_normalized(spark: SparkSession, root: str) -> DataFrame:
    return _docs(spark, root).select("doc_id", F.md5(T.clean_cell_column("text")).alias("huella"), F.length(T.clean_cell_column("text")).alias("letras"))


def html_features(spark: SparkSession, root: str) -> DataFrame:
    f = T.features(F.col("text"))
    d = _docs(spark, root).filter("text IS NOT NULL").select("doc_id", *[c.alias(n) for n, c in f.items()], F.length(T.plain_text(F.col("text"))).alias("n_plain"))
    return d.withColumn("estrato", T.stratum(F.col("n_tables"), F.col("n_images"), F.col("n_spans")))


def top_tags(spark: SparkSession, root: str) -> DataFrame:
    return corpus.top_tags(_docs(spark, root).select(F.coalesce("lang", F.lit("-")).alias("lang"), "text"), "lang", "text")


def _pairs(spark, root) -> DataFrame:
    """external_id, doc_id, pdf, xml: each fetch of a bulletin (xml, doc_id) beside the one before it (pdf). Only the numbers are put in order; texts are moved once the pairs are known."""
    d = _docs(spark, root).select("external_id", "doc_id", "text")
    n = running.numbered(d.select("external_id", "doc_id").filter("external_id IS NOT NULL"), ["external_id"], ["doc_id"], "n")
    later = n.filter("n > 1").select("external_id", "doc_id", (F.col("n") - 1).alias("n"))
    both = later.join(n.withColumnRenamed("doc_id", "before"), ["external_id", "n"]).select("external_id", "doc_id", "before")
    text = d.select("doc_id", "text")
    return both.join(text.withColumnRenamed("text", "xml"), "doc_id").join(text.select(F.col("doc_id").alias("before"), F.col("text").alias("pdf")), "before").select("external_id", "doc_id", "pdf", "xml")


def _ascii_tokens(c: str):
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def token_containment(spark: SparkSession, root: str) -> DataFrame:
    c = corpus.containment(_pairs(spark, root), "doc_id", _ascii_tokens("xml"), _ascii_tokens("pdf"))
    return c.filter("tokens > 0").select("doc_id", "shared", "tokens", F.round("share", 6).alias("share"))


def _verdicts(spark, root) -> DataFrame:
    p = _pairs(spark, root).withColumn("nx", F.size(_ascii_tokens("xml"))).withColumn("np", F.size(_ascii_tokens("pdf")))
    c = corpus.containment(p, "doc_id", _ascii_tokens("xml"), _ascii_tokens("pdf")).select("doc_id", "share")
    v = corpus.verdict(F.col("xml"), F.col("pdf"), F.col("nx"), F.col("np"), F.col("share"), 0.85)
    return p.join(c, "doc_id", "left").select("external_id", "doc_id", v.alias("causa"))


def pair_verdicts(spark: SparkSession, root: str) -> DataFrame:
    return _verdicts(spark, root)


def discard_census(spark: SparkSession, root: str) -> DataFrame:
    return corpus.discards(_verdicts(spark, root), "causa")


def coherence_scores(spark: SparkSession, root: str) -> DataFrame:
    """Ratcliff-Obershelp similarity of the two fetches."""
    return _pairs(spark, root).select("external_id", "doc_id", F.round(T.coherence_column()("pdf", "xml"), 6).alias("similitud"))


def manifest_violations(spark: SparkSession, root: str) -> DataFrame:
    d = _docs(spark, root)
    rules = {
        "sin texto": F.coalesce(F.col("text"), F.lit("")) == "", "sin lengua": F.col("lang").isNull(), "lengua desconocida": ~F.col("lang").isin("es", "ca", "en"), "sin fuente": F.col("source").isNull(),
        "longitud": F.col("n_chars") != F.length("text"), "sin fecha": F.col("published_on").isNull(), "fuera de ventana": ~F.col("published_on").between(F.lit(FIRST_DAY), F.lit(dt.date(2031, 6, 30))),
        "id": ~F.col("external_id").rlike("^BFI-A-2031-[0-9]+$"),
    }
    return corpus.violations(d, "doc_id", rules)


def duplicate_keys(spark: SparkSession, root: str) -> DataFrame:
    return corpus.duplicates(_docs(spark, root), ["external_id"])


def duplicate_digests(spark: SparkSession, root: str) -> DataFrame:
    d = _docs(spark, root).filter("text <> ''").select(F.left(F.sha2("text", 256), F.lit(16)).alias("huella"))
    return corpus.duplicates(d, ["huella"])


def byte_integrity(spark: SparkSession, root: str) -> DataFrame:
    """What a store finds when it reads its documents' bytes: of some the digest written is another's, of some the bytes are gone or empty."""
    d = _docs(spark, root).filter("text IS NOT NULL").select("doc_id", F.encode("text", "UTF-8").alias("bytes"))
    written = d.select("doc_id", F.when(F.col("doc_id") % 11 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("bytes", 256)).alias("sha256"))
    files = d.filter("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 13 == 0, F.lit("").cast("binary")).otherwise(F.col("bytes")).alias("content"))
    return journal.with_bytes(written, files, "doc_id", "sha256").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def _grid(spark, root) -> tuple[DataFrame, DataFrame]:
    """Tables and cells of celdas_pdf as last read. Cells of unknown place are left out."""
    c = cut(latest(table(spark, root, "celdas_pdf"), [*TABLE, "celda"], "leido_en", ["row", "col", "rowspan", "colspan"]).filter("row IS NOT NULL AND col IS NOT NULL AND rowspan IS NOT NULL AND colspan IS NOT NULL"), "cells")
    cells = c.select(*TABLE, F.col("celda").alias("cell_idx"), "row", "col", "rowspan", "colspan")
    size = cells.filter("row >= 0 AND col >= 0").groupBy(*TABLE).agg((F.max("row").cast("bigint") + 1).alias("n_rows"), (F.max("col").cast("bigint") + 1).alias("n_cols"))
    t = size.select(
        *TABLE, "n_rows", "n_cols", (F.col("tabla") % 7).alias("first_page"), (F.col("tabla") % 5).alias("last_page"), (F.col("tabla") % 4 != 3).alias("expresses_spans"),
        F.when(F.col("tabla") % 6 == 5, "docx").when(F.col("tabla") % 6 == 4, "text").otherwise("html").alias("source_format"),
    )
    return t, cells


def table_findings(spark: SparkSession, root: str) -> DataFrame:
    t, c = _grid(spark, root)
    return grid.findings(t, c, TABLE)


def finding_census(spark: SparkSession, root: str) -> DataFrame:
    t, c = _grid(spark, root)
    return grid.finding_census(grid.findings(t, c, TABLE), TABLE)


def derived_truth(spark: SparkSession, root: str) -> DataFrame:
    t, c = _grid(spark, root)
    d = grid.derived_truth(t, grid.findings(t, c, TABLE), TABLE)
    return d.select(*TABLE, "kept", F.array_join("fatal", ",").alias("fatal"))


def grid_holes(spark: SparkSession, root: str) -> DataFrame:
    t, c = _grid(spark, root)
    return grid.holes(grid.positions(c, t, TABLE), t, TABLE)


def grid_overlaps(spark: SparkSession, root: str) -> DataFrame:
    t, c = _grid(spark, root)
    return grid.overlaps(grid.positions(c, t, TABLE), TABLE)


def levenshtein_code_points(spark: SparkSession, root: str) -> DataFrame:
    """Distance of every pair by code points, and over the longer of the two. A null side has neither, an empty one is as far as the other is long, two empty ones are equal."""
    c = table(spark, root, "correcciones").select("correccion_id", "puse", "el_pdf_dice").distinct()
    d, longest = F.levenshtein("puse", "el_pdf_dice"), F.greatest(F.length("puse"), F.length("el_pdf_dice"))
    return c.select("correccion_id", d.alias("distancia"), F.round(F.when(d == 0, 0.0).otherwise(d / longest), 6).alias("relativa"))


def text_evidence(spark: SparkSession, root: str) -> DataFrame:
    """What two readings of a cell share at their ends, and what is between."""
    c = table(spark, root, "correcciones").select("correccion_id", "puse", "el_pdf_dice").distinct()
    first, last = T.shared_ends(F.col("puse"), F.col("el_pdf_dice"))
    middle = lambda c: F.substring(c, F.col("prefijo") + 1, F.length(c) - F.col("prefijo") - F.col("sufijo"))
    return c.withColumns({"prefijo": first, "sufijo": last}).select("correccion_id", "prefijo", "sufijo", middle(F.col("puse")).alias("solo_puse"), middle(F.col("el_pdf_dice")).alias("solo_pdf"))


def word_context(spark: SparkSession, root: str) -> DataFrame:
    """Where each text has its first figure in euros, with what is around."""
    return _docs(spark, root).select("doc_id", T.context(F.col("text"), "euros").alias("contexto")).filter("contexto IS NOT NULL")


def code_points(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "correcciones").select("correccion_id", T.code_points(F.col("puse")).alias("puntos")).distinct()


def locale_figures(spark: SparkSession, root: str) -> DataFrame:
    h = table(spark, root, "humo").select("medicion_id", "paginas", "error").distinct()
    return h.select("medicion_id", T.local_number(F.col("paginas") * 1234, 2).alias("cifra"), F.left(F.sha2(F.col("error"), 256), F.lit(12)).alias("huella"))


def short_dates(spark: SparkSession, root: str) -> DataFrame:
    return _docs(spark, root).filter("published_on IS NOT NULL").groupBy(T.short_date(F.col("published_on")).alias("dia")).agg(F.count(F.lit(1)).alias("n"))


def page_fields(spark: SparkSession, root: str) -> DataFrame:
    """Page counts and span attributes from what is written, good or bad."""
    e = table(spark, root, "elegidos").select("id", "paginas", "de_mas", "bytes").distinct()
    raw = F.when(F.col("paginas") % 5 == 0, "x1").otherwise((F.col("paginas") + F.col("de_mas")).cast("string"))
    return e.select("id", T.page_count(F.col("de_mas").cast("string"), raw).alias("paginas"), T.html_int(F.when(F.col("de_mas") == 0, "-3").when(F.col("de_mas") == 1, " 12 ").otherwise(F.col("paginas").cast("string"))).alias("span"))


def day_counts(spark: SparkSession, root: str) -> DataFrame:
    """Every day of the window with the number of documents published then, also days without a bulletin."""
    d = _docs(spark, root).groupBy("published_on").agg(F.count(F.lit(1)).alias("n"))
    days = journal.days(spark, FIRST_DAY, LAST_DAY)
    return days.join(d, days["dia"] == d["published_on"], "left").select("dia", F.coalesce("n", F.lit(0)).alias("n"))


def _listed(c: str):
    """A list of a group's objects as JSON; a list of one is the thing itself."""
    all_ = F.array_sort(F.collect_list(c))
    return F.when(F.size(all_) == 1, all_[0]).otherwise(F.concat(F.lit("["), F.array_join(all_, ","), F.lit("]")))


def _summaries(spark, root) -> DataFrame:
    """A JSON summary for each day: sections by source, departments by issuing body, items straight or under a heading; a list of one is the thing itself."""
    d = _docs(spark, root).filter("published_on IS NOT NULL AND source IS NOT NULL AND emisor IS NOT NULL")
    url = lambda ext: F.when((F.col("doc_id") % 9 != 0) | F.lit(ext == "pdf"), F.concat(F.lit(f"https://boletin.example/{ext}/"), F.col("doc_id").cast("string")))
    item = F.struct(F.concat(F.when(F.col("doc_id") % 17 == 0, "S-").otherwise("A-"), F.col("doc_id").cast("string")).alias("identificador"), F.concat(F.lit("Doc "), "doc_id").alias("titulo"), url("pdf").alias("url_pdf"), url("xml").alias("url_xml"), (F.col("n_chars") % 90).cast("string").alias("paginas"))
    items = d.groupBy("published_on", "source", "emisor", (F.col("doc_id") % 3 == 0).alias("deep")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    j = F.to_json("items")
    own = F.when(F.size("items") == 1, F.substring(j, F.lit(2), F.length(j) - 2)).otherwise(j)
    part = F.when(F.col("deep"), F.concat(F.lit('"epigrafes":[{"nombre":"E","items":'), own, F.lit("}]"))).otherwise(F.concat(F.lit('"items":'), own))
    dep = items.withColumn("p", part).groupBy("published_on", "source", "emisor").agg(F.array_join(F.array_sort(F.collect_list("p")), ",").alias("p"))
    dep = dep.withColumn("p", F.concat(F.lit('{"nombre":'), F.to_json(F.array("emisor")), F.lit(","), "p", F.lit("}"))).withColumn("p", F.regexp_replace("p", r'"nombre":\["((?:[^"\\]|\\.)*)"\]', '"nombre":"$1"'))
    sec = dep.groupBy("published_on", "source").agg(F.concat(F.lit('{"codigo":"'), F.first("source"), F.lit('","departamentos":'), _listed("p"), F.lit("}")).alias("s"))
    return sec.groupBy("published_on").agg(F.concat(F.lit('{"dia":"'), F.first("published_on").cast("string"), F.lit('","secciones":'), _listed("s"), F.lit("}")).alias("json"))


def summary_items(spark: SparkSession, root: str) -> DataFrame:
    return journal.summary_items(_summaries(spark, root), "json")


def summary_urls(spark: SparkSession, root: str) -> DataFrame:
    return _summaries(spark, root).select("published_on", F.explode(journal.urls(F.col("json"))).alias("url"))


def discovered(spark: SparkSession, root: str) -> DataFrame:
    got = journal.discovered(journal.summary_items(_summaries(spark, root), "json"), ["licitaciones", "planes_estudio"], "S-")
    return got.groupBy("seccion", "complete").agg(F.count(F.lit(1)).alias("n"))


_LINE = "extractor_id string, doc_ref struct<entity:string,external_id:string>, latency_ms bigint, failed boolean, failure_reason string"


def _journal(spark, root) -> DataFrame:
    """humo written out as a journal, every fortieth line torn, and read again."""
    h = table(spark, root, "humo").select("medicion_id", "extractor_id", "fixture", "tablas_halladas", "error").distinct()
    ref = F.struct(F.lit("bfi").alias("entity"), F.col("fixture").alias("external_id"))
    failed = F.col("error") != ""
    line = F.to_json(F.struct("extractor_id", ref.alias("doc_ref"), F.col("tablas_halladas").cast("bigint").alias("latency_ms"), failed.alias("failed"), F.when(failed & (F.col("medicion_id") % 2 == 0), "timeout").alias("failure_reason")))
    torn = F.when(F.col("medicion_id") % 40 == 0, F.substring(line, F.lit(1), F.length(line) - 9)).otherwise(line)
    path = work_path(spark, "journal")
    h.select(torn.alias("value")).write.text(path)
    return journal.read_journal(spark, path, _LINE)


def journal_lines(spark: SparkSession, root: str) -> DataFrame:
    return journal.line_counts(_journal(spark, root))


def journal_done(spark: SparkSession, root: str) -> DataFrame:
    return journal.done(_journal(spark, root)).groupBy("extractor").agg(F.count(F.lit(1)).alias("unidades"))


def journal_repeated(spark: SparkSession, root: str) -> DataFrame:
    return journal.repeated(journal.readable(_journal(spark, root)), F.col("extractor_id"), F.col("doc_ref.external_id"))


def journal_contradictions(spark: SparkSession, root: str) -> DataFrame:
    bad = journal.contradictions(journal.readable(_journal(spark, root)))
    return bad.groupBy("extractor_id", "why").agg(F.count(F.lit(1)).alias("n"))


def manifest_json(spark: SparkSession, root: str) -> DataFrame:
    """Each document's record as JSON whose text never depends on the order of anything."""
    d = _docs(spark, root).select("doc_id", "external_id", "lang", F.col("published_on").cast("string").alias("fecha"))
    return d.select("doc_id", journal.stable_json(F.struct("doc_id", "external_id", "fecha", "lang")).alias("json"))


def documents_in_order(spark: SparkSession, root: str) -> DataFrame:
    """All documents in their own order."""
    return journal.ordered(_docs(spark, root), None, "external_id", "doc_id")


def requested_documents(spark: SparkSession, root: str) -> DataFrame:
    """The documents of the candidates in the order in which they were chosen; every fetch of a document that was fetched more than once."""
    asked = table(spark, root, "elegidos").select(F.col("id").alias("external_id"), F.col("elegido_en").alias("_asked")).distinct()
    return journal.ordered(_docs(spark, root), asked, "external_id", "doc_id")


def inherited_documents(spark: SparkSession, root: str) -> DataFrame:
    found = table(spark, root, "elegidos").select(F.col("id").alias("external_id")).distinct()
    state = corpus.inherited(found, table(spark, root, "seleccion"), _docs(spark, root).filter("text IS NOT NULL"), "external_id")
    return state.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def span_verdicts(spark: SparkSession, root: str) -> DataFrame:
    h = table(spark, root, "humo").select("medicion_id", "extractor_id", "tablas_halladas", "paginas").distinct()
    g = h.groupBy("extractor_id", (F.col("tablas_halladas") % 2 == 0).alias("declarado"), (F.col("tablas_halladas") % 3 == 0).alias("vio"), (F.coalesce("paginas", F.lit(1)) % 2 == 0).alias("ocasion")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("veredicto", corpus.span_verdict(F.col("declarado"), F.col("extractor_id").isin("rejilla", "visor"), F.col("vio"), F.col("ocasion")))


def conformance(spark: SparkSession, root: str) -> DataFrame:
    h = table(spark, root, "humo").select("extractor_id", "extractor_version", "error").distinct().withColumn("candidato", F.concat_ws(" ", "extractor_id", "extractor_version"))
    severity = F.when(F.col("error") == "timeout", "FALLA").when(F.col("error") == "", "AVISO").otherwise("AVISO")
    return corpus.conforms(h.withColumn("severidad", severity), "candidato", "severidad", h)


def egress_offenders(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "humo").select("extractor_id").distinct().withColumn("runs_locally", ~F.col("extractor_id").startswith("v"))
    return corpus.egress_offenders(e, True)


def vocabulary_drift(spark: SparkSession, root: str) -> DataFrame:
    """Words of the second half of the year that the first did not have."""
    d = _docs(spark, root).filter("published_on IS NOT NULL").select("published_on", F.explode(_ascii_tokens("text")).alias("token"))
    late = F.col("published_on") >= F.lit(dt.date(2031, 7, 1))
    return corpus.vocabulary_drift(d.filter(~late), d.filter(late), "token")


def answer_accuracy(spark: SparkSession, root: str) -> DataFrame:
    """The items' answers checked against themselves as others might write them, by verifier."""
    i = table(spark, root, "items_prueba").filter("respuesta IS NOT NULL").select("item_id", "respuesta")
    v = F.element_at(F.array(*[F.lit(x) for x in ("exact", "numeric", "span")]), (F.col("item_id") % 3 + 1).cast("int"))
    given = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit(" "), "respuesta", F.lit(" "))).otherwise(F.concat("respuesta", F.lit("9")))
    m = i.withColumn("verificador", v).withColumn("ok", corpus.answer_correct(v, given, F.col("respuesta"), F.lit(0.5)))
    return m.groupBy("verificador").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("aciertos"))


# ---- a manifest for each day, some of them faulty, written out and read again

SCHEMA, SECTIONS = "manifiesto/1", ["licitaciones", "planes_estudio", "boletin_general"]


def _manifests(spark, root) -> tuple[DataFrame, DataFrame]:
    """Manifests and plans as read from the files, both with `dia`."""
    d = _docs(spark, root).filter("published_on IS NOT NULL").select("doc_id", "external_id", "source", "published_on", F.when(F.col("text") != "", F.sha2("text", 256)).alias("sha"))
    n, day, url = F.col("doc_id"), F.col("published_on").cast("string"), lambda host, kind: F.concat(F.lit(f"{host}/{kind}/"), F.col("doc_id").cast("string"))
    one = {
        "external_id": F.col("external_id"), "fecha_sumario": day, "seccion": F.col("source"), "url_pdf": url("https://boletin.example", "pdf"), "n_pages": (n % 9).cast("int"),
        "url_xml": F.when(n % 9 == 0, url("https://otro.example", "xml")).otherwise(url("https://sub.boletin.example", "xml")), "sha256": F.when(n % 11 == 0, "zz").otherwise(F.col("sha")),
        "cosechado_en": F.when(n % 13 != 0, day),
    }
    record = F.struct("doc_id", F.struct(*[one[k].alias(k) for k in sorted(one)]).alias("d"))
    per = d.groupBy(F.col("published_on").alias("dia")).agg(F.transform(F.sort_array(F.collect_list(record)), lambda x: x["d"]).alias("documentos"))
    k, text = F.dayofyear("dia"), F.col("dia").cast("string")
    taken, dropped = F.size("documentos") + F.when(k % 5 == 0, 1).otherwise(0), k % 4
    tried = taken + dropped + F.when(k % 6 == 0, 1).otherwise(0)
    pairing = F.struct(taken.alias("aceptados"), dropped.alias("descartados"), tried.alias("intentados"), F.create_map(F.lit("sin_xml"), F.when(k % 3 == 0, 0).otherwise(dropped)).alias("por_causa"), F.when(k % 7 == 0, 0.5).otherwise(dropped / tried).alias("tasa_descarte"), F.when(k % 8 != 0, 0.85).alias("umbral_coherencia"))
    licence = F.struct(F.when(k % 12 != 0, "CC BY").alias("name"))
    fields = {
        "documentos": F.col("documentos"), "emparejado": pairing, "entidad": F.lit("bfi"), "esquema": F.when(k % 17 == 0, "otro").otherwise(SCHEMA), "ventana": F.struct(text.alias("desde"), F.when(k % 10 != 0, text).alias("hasta")),
        "plan_hash": F.when(k % 4 != 3, F.sha2(F.when(k % 9 == 4, F.lit("x")).otherwise(text), 256)), "licencia_corpus": licence, "licencia_codigo": F.lit("MIT"), "atribucion": F.when(k % 14 == 0, " ").otherwise("Boletín"),
        "ritmo": F.struct(F.when(k % 5 == 1, 0.4).when(k % 5 != 2, 1.0).alias("espaciado_mediano_s")), "dias_sin_boletin": F.array().cast("array<string>"),
    }
    path = work_path(spark, "manifests")
    per.select(manifest.sorted_json({"dia": text, "manifiesto": manifest.sorted_json(fields)}).alias("value")).write.text(path)
    read = manifest.parsed(spark.read.text(path), "value", "dia date, manifiesto string")
    plan = F.to_json(F.struct(F.struct(text.alias("desde"), F.date_add("dia", F.when(k % 9 == 0, 1).otherwise(0)).cast("string").alias("hasta")).alias("ventana"), F.lit(3).alias("objetivo_emparejados"), F.array(*[F.lit(x) for x in SECTIONS]).alias("filtro_secciones"), F.lit(1.0).alias("ritmo_minimo_s")))
    plans = manifest.parsed(read.select("dia", plan.alias("plan")), "plan", manifest.PLAN).withColumn("digest", F.sha2(text, 256))
    return manifest.parsed(read, "manifiesto"), plans


def manifest_shape(spark: SparkSession, root: str) -> DataFrame:
    return manifest.shape_problems(_manifests(spark, root)[0], "dia", SCHEMA)


def manifest_against_plan(spark: SparkSession, root: str) -> DataFrame:
    m, plans = _manifests(spark, root)
    return manifest.plan_problems(m, plans, "dia")


def manifest_documents(spark: SparkSession, root: str) -> DataFrame:
    """Documents of the manifests that break a rule of their own, by rule and day."""
    docs = manifest.documents_of(_manifests(spark, root)[0], "dia")
    return manifest.document_problems(docs, ["dia", "pos"], "boletin.example").groupBy("dia", "rule").agg(F.count(F.lit(1)).alias("n"))


def companion_seals(spark: SparkSession, root: str) -> DataFrame:
    """The candidates' companions (the texts of their documents, the first fetch of each) sealed, and those that are missing."""
    found = table(spark, root, "elegidos").select(F.col("id").alias("external_id")).distinct()
    files = _docs(spark, root).filter("text IS NOT NULL").groupBy("external_id").agg(F.min_by("text", "doc_id").alias("text")).select("external_id", F.encode("text", "UTF-8").alias("content"))
    return manifest.companion_seals(found, files, "external_id", "external_id")


QUERIES = {f.__name__: f for f in (
    manifest_shape, manifest_against_plan, manifest_documents, companion_seals,
    doc_keys, text_normalized, html_features, top_tags, token_containment, pair_verdicts, discard_census, coherence_scores, manifest_violations, duplicate_keys, duplicate_digests, byte_integrity,
    table_findings, finding_census, derived_truth, grid_holes, grid_overlaps, levenshtein_code_points, text_evidence, word_context, code_points, locale_figures, short_dates, page_fields, day_counts, summary_items, summary_urls, discovered,
    journal_lines, journal_done, journal_repeated, journal_contradictions, manifest_json, documents_in_order, requested_documents, inherited_documents, span_verdicts, conformance, egress_offenders, vocabulary_drift, answer_accuracy,
)}

_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(nfc_normalize(text), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬅ', 'st'), 'ﬆ', 'st'), '\p{Cf}', '', 'g'), '[\p{Cc}\p{Zs}\p{Zl}\p{Zp}]', ' ', 'g'), ' +', ' ', 'g'))"
_P = "WITH o AS (SELECT external_id, doc_id, text AS xml, lag(text) OVER w AS pdf, row_number() OVER w AS n FROM documents WINDOW w AS (PARTITION BY external_id ORDER BY doc_id)), p AS (SELECT * FROM o WHERE n > 1), k AS (SELECT external_id, doc_id, pdf, xml, regexp_extract_all(lower(coalesce(xml, '')), '[a-z0-9]+') AS tx, regexp_extract_all(lower(coalesce(pdf, '')), '[a-z0-9]+') AS tp FROM p), b AS (SELECT doc_id, t, sum(l) AS l, sum(r) AS r FROM (SELECT doc_id, unnest(tx) AS t, 1 AS l, 0 AS r FROM k UNION ALL SELECT doc_id, unnest(tp), 0, 1 FROM k) GROUP BY ALL), c AS (SELECT doc_id, sum(least(l, r))::BIGINT AS shared, sum(l)::BIGINT AS tokens FROM b GROUP BY doc_id) "
_V = _P + ", v AS (SELECT k.external_id, k.doc_id, CASE WHEN xml IS NULL THEN 'sin_xml' WHEN pdf IS NULL THEN 'sin_pdf' WHEN len(tx) = 0 THEN 'xml_sin_texto' WHEN len(tp) = 0 THEN 'pdf_sin_texto' WHEN shared / tokens < 0.85 THEN 'incoherente' END AS causa FROM k LEFT JOIN c USING (doc_id)) "
_GRID = """WITH c AS (SELECT external_id, tabla, celda AS i, "row" AS r, col AS c, rowspan AS rs, colspan AS cs FROM (SELECT *, row_number() OVER (PARTITION BY external_id, tabla, celda ORDER BY leido_en DESC NULLS LAST, "row" DESC NULLS LAST, col DESC NULLS LAST, rowspan DESC NULLS LAST, colspan DESC NULLS LAST) AS rn FROM celdas_pdf)
  WHERE rn = 1 AND "row" IS NOT NULL AND col IS NOT NULL AND rowspan IS NOT NULL AND colspan IS NOT NULL),
t AS (SELECT external_id, tabla, max(r)::BIGINT + 1 AS n, max(c)::BIGINT + 1 AS m, tabla % 7 AS p1, tabla % 5 AS p2, tabla % 4 <> 3 AS ex, CASE WHEN tabla % 6 = 5 THEN 'docx' WHEN tabla % 6 = 4 THEN 'text' ELSE 'html' END AS f FROM c WHERE r >= 0 AND c >= 0 GROUP BY external_id, tabla),
s AS (SELECT * FROM t WHERE n::HUGEINT * m <= 1000000)"""
_POS = """, q AS (SELECT c.external_id, c.tabla, i, unnest(range(greatest(r, 0), least(r::BIGINT + rs, n))) AS pr, range(greatest(c.c, 0), least(c.c::BIGINT + cs, m)) AS pcs FROM {} c JOIN s USING (external_id, tabla)),
pos AS (SELECT external_id, tabla, i, pr::INT AS r, unnest(pcs)::INT AS c FROM q)"""
_FIND = _GRID + """, j AS (SELECT c.*, n, m, CASE WHEN r < 0 OR c.c < 0 THEN 'POSICION_NEGATIVA' WHEN rs < 1 OR cs < 1 THEN 'SPAN_MENOR_QUE_UNO' WHEN r::BIGINT + rs > n OR c.c::BIGINT + cs > m THEN 'SPAN_FUERA_DE_RANGO' END AS code FROM c JOIN s USING (external_id, tabla)),
good AS (SELECT external_id, tabla, i, r, c, rs, cs FROM j WHERE code IS NULL)""" + _POS.format("good") + """,
g AS (SELECT external_id, tabla, bool_or(rs > 1 OR cs > 1) AS sp, count(*) AS k FROM c GROUP BY ALL),
ok AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.external_id = s.external_id AND j.tabla = s.tabla AND code IS NOT NULL)),
cov AS (SELECT DISTINCT external_id, tabla, r, c FROM pos),
cell AS (SELECT external_id, tabla, x.r::INT AS r, y.c::INT AS c FROM ok, LATERAL (SELECT unnest(range(0, n)) AS r) x, LATERAL (SELECT unnest(range(0, m)) AS c) y),
st AS (SELECT cell.*, cov.r IS NOT NULL AS used, coalesce((SELECT max(c) FROM good WHERE good.external_id = cell.external_id AND good.tabla = cell.tabla AND good.r = cell.r), -1) AS rgt FROM cell LEFT JOIN cov ON cov.external_id = cell.external_id AND cov.tabla = cell.tabla AND cov.r = cell.r AND cov.c = cell.c),
ln AS (SELECT external_id, tabla, r, bool_or(used) AS any_used, bool_or(NOT used AND c < rgt) AS inner_, bool_or(NOT used AND c >= rgt) AS tail FROM st GROUP BY ALL),
fd AS (SELECT external_id, tabla, 'AREA_EXCESIVA' AS code, '' AS place FROM t WHERE n::HUGEINT * m > 1000000
UNION ALL SELECT external_id, tabla, 'SOURCE_FORMAT_DESCONOCIDO', '' FROM s WHERE f = 'docx'
UNION ALL SELECT external_id, tabla, 'PAGE_SPAN_INVALIDO', '' FROM s WHERE p1 < 1 OR p2 < p1
UNION ALL SELECT external_id, tabla, 'EXPRESSES_SPANS_IMPOSIBLE', '' FROM s JOIN g USING (external_id, tabla) WHERE sp AND NOT ex
UNION ALL SELECT external_id, tabla, 'EXPRESSES_SPANS_IMPOSIBLE', '' FROM s WHERE ex AND f = 'text'
UNION ALL SELECT external_id, tabla, code, i::VARCHAR FROM j WHERE code IS NOT NULL
UNION ALL SELECT external_id, tabla, 'SOLAPE', r || ',' || c FROM (SELECT *, row_number() OVER (PARTITION BY external_id, tabla, r, c ORDER BY i) AS k FROM pos) WHERE k > 1
UNION ALL SELECT external_id, tabla, 'FILA_VACIA', r::VARCHAR FROM ln WHERE NOT any_used
UNION ALL SELECT external_id, tabla, 'HUECO_INTERIOR', r::VARCHAR FROM ln WHERE any_used AND inner_
UNION ALL SELECT external_id, tabla, 'HUECO_COLA', r::VARCHAR FROM ln WHERE any_used AND tail
UNION ALL SELECT external_id, tabla, 'COLUMNA_VACIA', c::VARCHAR FROM st GROUP BY external_id, tabla, c HAVING NOT bool_or(used))"""
_FATAL = "(" + ", ".join(f"'{c}'" for c in grid.FATAL) + ")"
_ITEMS = "WITH i AS (SELECT published_on, source, emisor, doc_id, doc_id % 3 = 0 AS deep, CASE WHEN doc_id % 17 = 0 THEN 'S-' ELSE 'A-' END || doc_id AS identificador, 'https://boletin.example/pdf/' || doc_id AS url_pdf, CASE WHEN doc_id % 9 <> 0 THEN 'https://boletin.example/xml/' || doc_id END AS url_xml, (n_chars % 90)::VARCHAR AS paginas FROM documents WHERE published_on IS NOT NULL AND source IS NOT NULL AND emisor IS NOT NULL) "
_JN = "WITH h AS (SELECT DISTINCT medicion_id, extractor_id, fixture, tablas_halladas, error FROM humo), r AS (SELECT * FROM h WHERE medicion_id % 40 <> 0) "

_MAN = f"""WITH d AS (SELECT published_on AS dia, dayofyear(published_on) AS k, doc_id AS n, source AS seccion, CASE WHEN doc_id % 11 = 0 THEN 'zz' WHEN text <> '' THEN sha256(text) END AS sha, row_number() OVER (PARTITION BY published_on ORDER BY doc_id) - 1 AS pos FROM documents WHERE published_on IS NOT NULL),
g AS (SELECT dia, k, count(*) AS docs, list(coalesce(seccion, '')) AS ss FROM d GROUP BY ALL), e AS (SELECT *, docs + (k % 5 = 0)::INT AS taken, k % 4 AS dropped FROM g), m AS (SELECT *, taken + dropped + (k % 6 = 0)::INT AS tried FROM e) """

SQL = {
    "manifest_shape": _MAN + """SELECT dia, unnest(list_filter([CASE WHEN k % 17 = 0 THEN 'schema' END, CASE WHEN taken + dropped <> tried THEN 'balance' END, CASE WHEN taken <> docs THEN 'documents' END,
  CASE WHEN tried > 0 AND k % 7 = 0 AND abs(0.5 - dropped / tried) > 1e-9 THEN 'rate' END, CASE WHEN k % 3 = 0 AND dropped <> 0 THEN 'causes' END, CASE WHEN k % 8 = 0 THEN 'threshold' END, CASE WHEN k % 10 = 0 THEN 'window' END,
  CASE WHEN k % 14 = 0 THEN 'attribution' END, CASE WHEN k % 12 = 0 THEN 'licence' END], lambda x: x IS NOT NULL)) AS rule FROM m""",
    "manifest_against_plan": _MAN + """SELECT dia, unnest(list_filter([CASE WHEN k % 4 = 3 THEN 'no plan' END, CASE WHEN k % 4 <> 3 AND k % 9 = 4 THEN 'other plan' END, CASE WHEN k % 10 = 0 OR k % 9 = 0 THEN 'to' END, CASE WHEN taken < 3 THEN 'target' END,
  CASE WHEN len(list_filter(ss, lambda x: x NOT IN ('licitaciones', 'planes_estudio', 'boletin_general'))) > 0 THEN 'sections' END, CASE WHEN k % 5 = 2 THEN 'pace not measured' END, CASE WHEN k % 5 = 1 THEN 'pace' END], lambda x: x IS NOT NULL)) AS rule FROM m""",
    "manifest_documents": _MAN + """, r AS (SELECT dia, CASE WHEN trim(coalesce(seccion, '')) = '' THEN 'no seccion' END AS rule FROM d UNION ALL SELECT dia, CASE WHEN n % 13 = 0 THEN 'no cosechado_en' END FROM d UNION ALL SELECT dia, CASE WHEN sha IS NULL OR sha = 'zz' THEN 'digest' END FROM d
  UNION ALL SELECT dia, CASE WHEN n % 9 = 0 THEN 'foreign url_xml' END FROM d UNION ALL SELECT dia, 'same digest' FROM (SELECT dia, sha, row_number() OVER (PARTITION BY dia, sha ORDER BY pos) AS k FROM d WHERE sha <> 'zz') WHERE k > 1)
SELECT dia, rule, count(*) AS n FROM r WHERE rule IS NOT NULL GROUP BY ALL""",
    "companion_seals": "WITH f AS (SELECT external_id, first(text ORDER BY doc_id) AS text FROM documents WHERE text IS NOT NULL GROUP BY external_id) SELECT id AS external_id, CASE WHEN f.text IS NULL THEN 'missing' ELSE 'sealed' END AS state, sha256(f.text) AS sha256, strlen(f.text) AS bytes FROM (SELECT DISTINCT id FROM elegidos) LEFT JOIN f ON f.external_id = id",
    "doc_keys": "SELECT doc_id, replace(replace(coalesce(source, '%/'), '%', '%25'), '/', '%2F') || '/' || replace(replace(external_id, '%', '%25'), '/', '%2F') AS clave FROM documents",
    "text_normalized": f"SELECT doc_id, md5({_CLEAN}) AS huella, length({_CLEAN}) AS letras FROM documents",
    "html_features": r"""WITH f AS (SELECT doc_id, len(regexp_extract_all(lower(text), '<table')) AS n_tables, len(regexp_extract_all(lower(text), '<img')) AS n_images, list_filter(list_transform(regexp_extract_all(lower(text), '(?:row|col)span\s*=\s*"?([0-9]{1,6})', 1), lambda x: x::INT), lambda x: x > 1) AS sp, length(trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS n_plain FROM documents WHERE text IS NOT NULL)
SELECT doc_id, n_tables, n_images, len(sp) AS n_spans, coalesce(list_max(sp), 1) AS max_span, n_plain, CASE WHEN n_tables = 0 THEN CASE WHEN n_images > 0 THEN 'anexo-png' ELSE 'sin-tabla' END WHEN len(sp) > 0 THEN 'celdas-combinadas' ELSE 'tabla-simple' END AS estrato FROM f""",
    "top_tags": "SELECT lang, tag, n, place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, tag) AS place FROM (SELECT coalesce(lang, '-') AS lang, tag, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '<([a-z][a-z0-9]*)', 1)) AS tag FROM documents) GROUP BY ALL)) WHERE place <= 12",
    "token_containment": _P + "SELECT doc_id, shared, tokens, round(shared / tokens, 6) AS share FROM c WHERE tokens > 0",
    "pair_verdicts": _V + "SELECT * FROM v",
    "discard_census": _V + "SELECT causa, count(*) AS n FROM v GROUP BY causa",
    "manifest_violations": "SELECT doc_id, unnest(list_filter([CASE WHEN coalesce(text, '') = '' THEN 'sin texto' END, CASE WHEN lang IS NULL THEN 'sin lengua' END, CASE WHEN lang NOT IN ('es', 'ca', 'en') THEN 'lengua desconocida' END, CASE WHEN source IS NULL THEN 'sin fuente' END, CASE WHEN n_chars <> length(text) THEN 'longitud' END, CASE WHEN published_on IS NULL THEN 'sin fecha' END, CASE WHEN published_on NOT BETWEEN DATE '2031-01-01' AND DATE '2031-06-30' THEN 'fuera de ventana' END, CASE WHEN NOT regexp_full_match(external_id, 'BFI-A-2031-[0-9]+') THEN 'id' END], lambda x: x IS NOT NULL)) AS rule FROM documents",
    "duplicate_keys": "SELECT external_id, count(*) AS n FROM documents GROUP BY external_id HAVING count(*) > 1",
    "duplicate_digests": "SELECT left(sha256(text), 16) AS huella, count(*) AS n FROM documents WHERE text <> '' GROUP BY 1 HAVING count(*) > 1",
    "byte_integrity": "SELECT CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 13 = 0 OR text = '' THEN 'empty' WHEN doc_id % 11 = 0 THEN 'altered' ELSE 'ok' END AS state, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "table_findings": _FIND + " SELECT * FROM fd",
    "finding_census": _FIND + " SELECT code, count(DISTINCT (external_id, tabla)) AS tables, count(*) AS lines FROM fd GROUP BY code",
    "derived_truth": _FIND + f" SELECT t.external_id, t.tabla, x.l IS NULL AS kept, coalesce(x.l, '') AS fatal FROM t LEFT JOIN (SELECT external_id, tabla, string_agg(code, ',' ORDER BY code) AS l FROM (SELECT DISTINCT external_id, tabla, code FROM fd WHERE code IN {_FATAL}) GROUP BY ALL) x ON x.external_id = t.external_id AND x.tabla = t.tabla",
    "grid_holes": _GRID + _POS.format("c") + " SELECT s.external_id, s.tabla, x.r::INT AS r, y.c::INT AS c FROM s, LATERAL (SELECT unnest(range(0, n)) AS r) x, LATERAL (SELECT unnest(range(0, m)) AS c) y WHERE NOT EXISTS (SELECT 1 FROM pos WHERE pos.external_id = s.external_id AND pos.tabla = s.tabla AND pos.r = x.r AND pos.c = y.c)",
    "grid_overlaps": _GRID + _POS.format("c") + " SELECT external_id, tabla, i AS cell_idx, r, c, f AS first_idx FROM (SELECT *, row_number() OVER w AS k, first_value(i) OVER w AS f FROM pos WINDOW w AS (PARTITION BY external_id, tabla, r, c ORDER BY i)) WHERE k > 1",
    "text_evidence": """WITH c AS (SELECT DISTINCT correccion_id, puse, el_pdf_dice, regexp_extract_all(puse, '(?s).') AS a, regexp_extract_all(el_pdf_dice, '(?s).') AS b FROM correcciones),
p AS (SELECT *, list_position(list_append(list_transform(range(1, greatest(len(a), len(b)) + 1), lambda i: coalesce(a[i] = b[i], false)), false), false) - 1 AS f FROM c),
s AS (SELECT *, list_position(list_append(list_transform(range(0, greatest(len(a), len(b)) - f), lambda i: i < len(a) - f AND i < len(b) - f AND coalesce(a[len(a) - i] = b[len(b) - i], false)), false), false) - 1 AS l FROM p)
SELECT correccion_id, f::INT AS prefijo, l::INT AS sufijo, array_to_string(a[f + 1:len(a) - l], '') AS solo_puse, array_to_string(b[f + 1:len(b) - l], '') AS solo_pdf FROM s""",
    "word_context": "SELECT doc_id, substr(text, greatest(strpos(text, 'euros') - 45, 1), 50 + least(strpos(text, 'euros') - 1, 45)) AS contexto FROM documents WHERE strpos(text, 'euros') > 0",
    "code_points": "SELECT DISTINCT correccion_id, list_aggregate(list_transform(regexp_extract_all(puse, '(?s).'), lambda x: 'U+' || printf('%04X', unicode(x))), 'string_agg', ' ') AS puntos FROM correcciones",
    "locale_figures": "SELECT DISTINCT medicion_id, coalesce(translate(format('{:,.2f}', (paginas * 1234)::DOUBLE), ',.', '.,'), 'n/a') AS cifra, left(sha256(error), 12) AS huella FROM humo",
    "short_dates": "SELECT day(published_on) || ' ' || ['ene', 'feb', 'mar', 'abr', 'may', 'jun', 'jul', 'ago', 'sep', 'oct', 'nov', 'dic'][month(published_on)] || ' ' || year(published_on) AS dia, count(*) AS n FROM documents WHERE published_on IS NOT NULL GROUP BY 1",
    "page_fields": "SELECT id, CASE WHEN paginas % 5 <> 0 AND de_mas >= 1 AND paginas >= 0 THEN paginas + 1 END AS paginas, CASE WHEN de_mas = 0 THEN 1 WHEN de_mas = 1 THEN 12 ELSE paginas END AS span FROM (SELECT DISTINCT id, paginas, de_mas, bytes FROM elegidos)",
    "day_counts": "SELECT d::DATE AS dia, count(doc_id) AS n FROM generate_series(DATE '2031-01-01', DATE '2031-12-31', INTERVAL 1 DAY) g(d) LEFT JOIN documents ON published_on = d::DATE GROUP BY 1",
    "summary_items": _ITEMS + "SELECT published_on AS dia, source AS seccion, emisor AS departamento, CASE WHEN deep THEN 'E' END AS epigrafe, identificador, 'Doc ' || doc_id AS titulo, url_pdf, url_xml, paginas FROM i",
    "summary_urls": _ITEMS + "SELECT published_on, url_pdf AS url FROM i UNION ALL SELECT published_on, url_xml FROM i WHERE url_xml IS NOT NULL",
    "discovered": _ITEMS + "SELECT source AS seccion, url_xml IS NOT NULL AS complete, count(*) AS n FROM i WHERE source IN ('licitaciones', 'planes_estudio') AND identificador NOT LIKE 'S-%' GROUP BY ALL",
    "journal_lines": _JN + "SELECT count(*) AS lines, count(*) FILTER (medicion_id % 40 = 0) AS broken, count(*) FILTER (medicion_id % 40 <> 0) AS named FROM h",
    "journal_done": _JN + "SELECT extractor_id AS extractor, count(DISTINCT fixture) AS unidades FROM r GROUP BY extractor_id",
    "journal_repeated": _JN + "SELECT extractor_id AS k0, fixture AS k1, count(*) AS n FROM r GROUP BY ALL HAVING count(*) > 1",
    "journal_contradictions": _JN + "SELECT extractor_id, 'failed without a reason' AS why, count(*) AS n FROM r WHERE error <> '' AND medicion_id % 2 = 1 GROUP BY extractor_id",
    "manifest_json": """SELECT doc_id, '{"doc_id":' || doc_id || ',"external_id":"' || external_id || '","fecha":' || coalesce('"' || published_on || '"', 'null') || ',"lang":' || coalesce('"' || lang || '"', 'null') || '}' AS json FROM documents""",
    "documents_in_order": "SELECT * REPLACE (fetched_at::TIMESTAMP AS fetched_at) FROM documents ORDER BY doc_id",
    "requested_documents": "SELECT d.* REPLACE (d.fetched_at::TIMESTAMP AS fetched_at) FROM (SELECT DISTINCT id, elegido_en FROM elegidos) e JOIN documents d ON d.external_id = e.id ORDER BY e.elegido_en, e.id, d.doc_id",
    "inherited_documents": "SELECT CASE WHEN id IN (SELECT external_id FROM seleccion) AND id IN (SELECT external_id FROM documents WHERE text IS NOT NULL) THEN 'heredado' ELSE 'pedir' END AS state, count(*) AS n FROM (SELECT DISTINCT id FROM elegidos) GROUP BY 1",
    "span_verdicts": "WITH h AS (SELECT DISTINCT medicion_id, extractor_id, tablas_halladas, paginas FROM humo), g AS (SELECT extractor_id, tablas_halladas % 2 = 0 AS declarado, tablas_halladas % 3 = 0 AS vio, coalesce(paginas, 1) % 2 = 0 AS ocasion, count(*) AS n FROM h GROUP BY ALL) SELECT *, CASE WHEN declarado AND extractor_id NOT IN ('rejilla', 'visor') THEN 'CONTRADICCION' WHEN NOT declarado AND vio THEN 'ESCONDIDO' WHEN NOT declarado AND extractor_id IN ('rejilla', 'visor') AND NOT ocasion THEN 'SIN_EVIDENCIA' ELSE 'COHERENTE' END AS veredicto FROM g",
    "conformance": "SELECT extractor_id || ' ' || extractor_version AS candidato, NOT bool_or(error = 'timeout') AS passes FROM humo GROUP BY 1",
    "egress_offenders": "SELECT DISTINCT extractor_id, false AS runs_locally FROM humo WHERE extractor_id LIKE 'v%'",
    "vocabulary_drift": "WITH w AS (SELECT published_on >= DATE '2031-07-01' AS late, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents WHERE published_on IS NOT NULL) SELECT token, count(*) AS n FROM w WHERE late AND token NOT IN (SELECT token FROM w WHERE NOT late) GROUP BY token",
    "answer_accuracy": "SELECT CASE item_id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'numeric' ELSE 'span' END AS verificador, count(*) AS n, count(*) FILTER (item_id % 2 = 0 OR item_id % 3 = 2) AS aciertos FROM items_prueba WHERE respuesta IS NOT NULL GROUP BY 1",
}
