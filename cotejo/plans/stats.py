"""Statistics, samples and verdicts over the domain's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.operators import order_stats, running, sampling, scoring, stats
from cotejo.operators.diff import latest, residue
from cotejo.sources import journal, table

EXTRACTORS = ["lectorplano", "marcas", "rejilla", "visor"]


def _smoke(spark, root) -> DataFrame:
    """humo without repeated rows, measured times only."""
    return table(spark, root, "humo").select("medicion_id", "fixture", "extractor_id", "extractor_version", "segundos", "paginas", "tablas_halladas", "error").distinct()


def _timed(spark, root) -> DataFrame:
    return _smoke(spark, root).filter("segundos >= 0 AND NOT isnan(segundos) AND paginas > 0")


def failures_by_cause(spark: SparkSession, root: str) -> DataFrame:
    return _smoke(spark, root).filter("error <> ''").groupBy("extractor_id", "error").agg(F.count(F.lit(1)).alias("n"))


def latency_cost(spark: SparkSession, root: str) -> DataFrame:
    t = _timed(spark, root)
    m = order_stats.nth(t, ["extractor_id"], "segundos", {"lo": order_stats.LOWER_MEDIAN, "up": order_stats.UPPER_MEDIAN})
    s = t.groupBy("extractor_id").agg(F.sum("segundos").alias("s"), F.sum("paginas").alias("p"), F.count(F.lit(1)).alias("d"))
    return s.join(m, "extractor_id").select(
        "extractor_id", F.col("d").alias("extracciones"), F.col("p").alias("paginas"), F.round(F.try_divide("s", "p"), 6).alias("s_por_pagina"), F.round(F.try_divide("s", "d"), 6).alias("s_por_documento"),
        F.round(F.col("s") / 3600, 6).alias("horas"), F.floor(order_stats.median_of(m) * 1000 + 1e-6).cast("int").alias("latencia_ms"),
    )


def run_summary(spark: SparkSession, root: str) -> DataFrame:
    return _smoke(spark, root).groupBy("extractor_id").agg(
        F.count(F.lit(1)).alias("hechas"), F.sum("tablas_halladas").alias("tablas"), F.round(F.sum(F.when((F.col("segundos") >= 0) & ~F.isnan("segundos"), F.col("segundos"))), 3).alias("segundos"),
        F.round(F.avg((F.col("error") != "").cast("int")), 6).alias("tasa_fallo"),
    )


def wilson_intervals(spark: SparkSession, root: str) -> DataFrame:
    g = _smoke(spark, root).groupBy("extractor_id", "extractor_version").agg(F.count_if(F.col("error") != "").alias("fallos"), F.count(F.lit(1)).alias("n"))
    low, high = stats.wilson(F.col("fallos"), F.col("n"))
    return g.select("*", F.round(low, 6).alias("bajo"), F.round(high, 6).alias("alto"))


def ratio_estimator(spark: SparkSession, root: str) -> DataFrame:
    t = _timed(spark, root).withColumn("banda", scoring.band(F.col("paginas"), scoring.COST_BANDS))
    return stats.ratios(t, ["extractor_id", "banda"], "segundos", "paginas").select("extractor_id", "banda", F.round("ratio", 6).alias("s_por_pagina"), "n")


def ols_slope(spark: SparkSession, root: str) -> DataFrame:
    t = _timed(spark, root).withColumn("por_pagina", F.col("segundos") / F.col("paginas"))
    return stats.slope(t, ["extractor_id", "extractor_version"], "por_pagina", "paginas").withColumn("slope", F.round("slope", 8))


def projected_hours(spark: SparkSession, root: str) -> DataFrame:
    """Hours to run each extractor over the candidates, from its time per page in each band, and how that compares with the pages at one rate for all."""
    t = _timed(spark, root).withColumn("banda", scoring.band(F.col("paginas"), scoring.COST_BANDS))
    per = stats.ratios(t, ["extractor_id", "banda"], "segundos", "paginas").select("extractor_id", "banda", "ratio")
    flat = stats.ratios(t, ["extractor_id"], "segundos", "paginas").select("extractor_id", F.col("ratio").alias("_flat"))
    docs = table(spark, root, "elegidos").filter("paginas > 0").select("id", "paginas").distinct().withColumn("banda", scoring.band(F.col("paginas"), scoring.COST_BANDS))
    pages = docs.groupBy("banda").agg(F.sum("paginas").alias("paginas"))
    h = per.join(pages, "banda").join(flat, "extractor_id").groupBy("extractor_id").agg((F.sum(F.col("ratio") * F.col("paginas")) / 3600).alias("h"), (F.sum(F.col("_flat") * F.col("paginas")) / 3600).alias("f"))
    over_real, over_forecast = stats.estimator_error(F.col("f"), F.col("h"))
    return h.select("extractor_id", F.round("h", 6).alias("horas"), F.round(over_real, 6).alias("error_sobre_real"), F.round(over_forecast, 6).alias("error_sobre_estimado"))


def cluster_bootstrap_ci(spark: SparkSession, root: str) -> DataFrame:
    """Total seconds for all pages of the candidates, with the interval over resampled documents."""
    t = _timed(spark, root).withColumn("banda", scoring.band(F.col("paginas"), scoring.COST_BANDS))
    per_doc = t.groupBy("banda", "fixture").agg(F.sum("segundos").alias("s"), F.sum("paginas").alias("p"))
    docs = table(spark, root, "elegidos").filter("paginas > 0").select("id", "paginas").distinct().withColumn("banda", scoring.band(F.col("paginas"), scoring.COST_BANDS))
    weights = docs.groupBy("banda").agg(F.sum("paginas").alias("w"))
    return stats.bootstrap_ratio(per_doc, "banda", "fixture", "s", "p", weights, "w", replicas=10_000)


def quartiles_exclusive(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "elegidos").distinct()
    q = order_stats.quartiles(e, ["banda"], "coste_ms")
    return q.select("banda", "n", *[F.round(f"q{i}", 6).alias(f"q{i}") for i in (1, 2, 3)])


def cost_summary(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "elegidos").distinct()
    c = order_stats.nth(e, ["banda"], "coste_ms", {"lo": order_stats.LOWER_MEDIAN, "up": order_stats.UPPER_MEDIAN, "p90": order_stats.P90, "top": lambda n: n})
    w = order_stats.nth(e, ["banda"], "bytes", {"weight": order_stats.UPPER_MEDIAN}).drop("n")
    mean = e.groupBy("banda").agg(F.floor(F.avg("coste_ms")).cast("bigint").alias("media"))
    whole = lambda x: F.floor(x).cast("bigint")
    return c.join(w, "banda").join(mean, "banda").select("banda", "n", whole((F.col("lo") + F.col("up")) / 2).alias("mediana"), "media", whole("p90").alias("p90"), whole("top").alias("maximo"), whole("weight").alias("peso"))


def series_verdicts(spark: SparkSession, root: str) -> DataFrame:
    """Whether all, none or some of a machine's series keep their ninth decile under the limit of their kind."""
    s = table(spark, root, "serie").select("serie_id", "hito", "maquina", "tiempos").distinct()
    ok = F.array_sort(F.filter("tiempos", lambda x: x >= 0))
    n = F.size(ok)
    p90 = F.when(n > 0, F.element_at(ok, F.greatest(F.least(F.floor(n * 9 / 10).cast("int") + 1, n), F.lit(1))))
    limits = table(spark, root, "techos").filter("fuente = 'serie'").select(F.col("clave").alias("hito"), "techo")
    j = s.withColumn("p90", p90).filter("p90 IS NOT NULL").join(limits, "hito")
    return j.groupBy("hito", "maquina").agg(F.count(F.lit(1)).alias("series"), stats.series_verdict(F.col("p90") <= F.col("techo")).alias("veredicto"))


def largest_remainder_quota(spark: SparkSession, root: str) -> DataFrame:
    sizes = table(spark, root, "elegidos").select("id", "banda").distinct().groupBy("banda").agg(F.count(F.lit(1)).alias("n"))
    return sampling.largest_remainder(sizes, F.col("banda"), "n", 17).select("banda", "n", "quota")


def stratified_sample(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "seleccion").select(F.concat_ws("-t", "external_id", "tabla").alias("clave"), "n_tablas_del_documento").distinct()
    banded = s.withColumn("estrato", scoring.band(F.col("n_tablas_del_documento"), scoring.REPORT_BANDS))
    return sampling.stratified(banded, "estrato", "clave", 40, "7").select("estrato", "clave", "place")


def first_per_cell(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "elegidos").select("id", "banda", (F.col("tablas_verdad") > 0).alias("con_tabla")).distinct()
    return sampling.first_per_cell(e, ["banda", "con_tabla"], ["id"], 2)


def work_order(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "elegidos").select("id", "banda").distinct()
    return sampling.work_order(e, EXTRACTORS, "banda", ["id"]).select("round", "extractor", "banda", "id")


def pending_units(spark: SparkSession, root: str) -> DataFrame:
    units = table(spark, root, "elegidos").select("id")
    done = table(spark, root, "humo").select(F.col("extractor_id").alias("extractor"), F.regexp_replace("fixture", "-t[0-9]+$", "").alias("id"))
    return sampling.pending(units, done, EXTRACTORS, "id")


def feasibility_frontier(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "elegidos").filter("tablas_verdad > 0 AND bytes IS NOT NULL AND coste_ms IS NOT NULL AND aciertan IS NOT NULL").select("id", "bytes", "coste_ms", "paginas", (F.col("aciertan") == 4).alias("acuerda")).distinct()
    sums = {"bytes": F.sum("bytes"), "coste_ms": F.sum("coste_ms"), "acuerdan": F.count_if("acuerda"), "paginas_min": F.min("paginas"), "paginas_max": F.max("paginas")}
    return sampling.frontier(e, "acuerda", "id", "bytes", sums, 20)


def twenty_cheapest(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "elegidos").filter("coste_ms IS NOT NULL").select("id", "coste_ms", "bytes").distinct()
    return e.orderBy("coste_ms", "id").limit(20)


def lightest_by_band(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "elegidos").filter("bytes IS NOT NULL")
    return e.groupBy("banda").agg(F.min(F.struct("bytes", "id")).alias("m")).select("banda", "m.id", "m.bytes")


def quickstart_greedy(spark: SparkSession, root: str) -> DataFrame:
    """Twenty candidates that cover five phenomena, lightest first."""
    e = table(spark, root, "elegidos").filter("bytes IS NOT NULL").select("id", "bytes", "banda", "celda_combinada", "tablas_verdad", "aciertan", "de_mas").distinct()
    t = F.col("tablas_verdad") > 0
    marked = e.withColumns({"aciertan_los_cuatro": t & (F.col("aciertan") == 4), "discrepan_los_cuatro": t & (F.col("aciertan") == 0), "sin_tablas": ~t, "tabla_de_mas": F.col("de_mas") > 0})
    plan = [("sin tablas", 2), (">50", 2), ("11-50", 9), ("2-10", 6), ("1", 1)]
    return sampling.greedy(marked, "id", "bytes", "banda", plan, ["celda_combinada", "aciertan_los_cuatro", "discrepan_los_cuatro", "sin_tablas", "tabla_de_mas"])


def request_spacing(spark: SparkSession, root: str) -> DataFrame:
    """Median, least and number of the seconds between one request and the next."""
    g = running.gaps(table(spark, root, "events").select("event_id", "ts"), "ts", ["ts", "event_id"]).withColumn("todo", F.lit(1))
    m = order_stats.nth(g, ["todo"], "gap", {"lo": order_stats.LOWER_MEDIAN, "up": order_stats.UPPER_MEDIAN, "least": lambda n: F.lit(1)})
    return m.select(F.round(order_stats.median_of(m), 6).alias("mediana_s"), F.round("least", 6).alias("minimo_s"), "n")


def _harvest(spark, root) -> DataFrame:
    e = table(spark, root, "events").select("event_id", "ts", "event_type")
    return running.running_totals(e, ["ts", "event_id"], {"tried": F.lit(1), "spent": (F.col("event_type") == "error").cast("int"), "accepted": (F.col("event_type") != "error").cast("int")})


def stop_rule(spark: SparkSession, root: str) -> DataFrame:
    return running.stop_point(_harvest(spark, root), "tried", "tried", "spent").select("event_id", "tried", "spent")


def target_cutoff(spark: SparkSession, root: str) -> DataFrame:
    t = running.until_target(_harvest(spark, root), "accepted", (F.col("event_type") != "error").cast("int"), 500)
    return t.select("event_id", "tried", "accepted")


def discard_by_season(spark: SparkSession, root: str) -> DataFrame:
    """Documents tried and accepted (with text), by season and in all."""
    d = table(spark, root, "documents").filter("published_on IS NOT NULL").withColumn("estacion", F.when(F.dayofyear("published_on") < 79, "invierno").otherwise("primavera"))
    ok = F.col("text").isNotNull() & (F.col("text") != "")
    g = d.groupingSets([[F.col("estacion")], []], F.col("estacion")).agg(F.count(F.lit(1)).alias("intentados"), F.count_if(ok).alias("aceptados"), F.count_distinct("published_on").alias("dias"))
    return g.select(F.coalesce("estacion", F.lit("toda_la_ventana")).alias("estacion"), "intentados", "aceptados", (F.col("intentados") - F.col("aceptados")).alias("descartes"), F.round((F.col("intentados") - F.col("aceptados")) / F.col("intentados"), 6).alias("tasa"), "dias")


def text_layer_census(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents")
    return d.groupBy(F.coalesce(F.lower("lang"), F.lit("(sin lengua)")).alias("lengua")).agg(F.count(F.lit(1)).alias("documentos"), F.count_if(F.length("text") > 0).alias("con_texto"), F.count_if(F.col("text").isNull()).alias("ilegibles"))


def false_positives(spark: SparkSession, root: str) -> DataFrame:
    """Bulletins without true tables for which an extractor reports some, by its band of pages; an interval where the band was sampled."""
    truth = table(spark, root, "elegidos").filter("tablas_verdad = 0").select(F.col("id").alias("external_id"), "paginas").distinct()
    seen = table(spark, root, "censo_tablas").filter("extractor_id IS NOT NULL").groupBy("external_id", "extractor_id").agg(F.max("tablas").alias("m"))
    docs = truth.withColumn("extractor_id", F.explode(F.array(*[F.lit(e) for e in EXTRACTORS]))).withColumn("banda", scoring.band(F.col("paginas"), scoring.CORPUS_BANDS))
    g = docs.join(seen, ["external_id", "extractor_id"], "left").groupBy("extractor_id", "banda").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("m") > 0).alias("con_tabla"))
    low, high = stats.wilson(F.col("con_tabla"), F.col("n"))
    sampled = F.col("banda") == "1-4"
    return g.select("extractor_id", "banda", "n", "con_tabla", F.round(F.col("con_tabla") / F.col("n"), 6).alias("tasa"), F.when(sampled, F.round(low, 6)).alias("bajo"), F.when(sampled, F.round(high, 6)).alias("alto"))


def consensus_counts(spark: SparkSession, root: str) -> DataFrame:
    """The number of tables most readings of a bulletin agree on (the smaller of equals), and the share that differ."""
    per = table(spark, root, "censo_tablas").filter("tablas IS NOT NULL").groupBy("external_id", "tablas").agg(F.count(F.lit(1)).alias("n"))
    top = F.max(F.struct(F.col("n"), (-F.col("tablas")).alias("t")))
    g = per.groupBy("external_id").agg(top.alias("m"), F.sum("n").alias("lecturas"), F.count(F.lit(1)).alias("valores"))
    return g.select("external_id", (-F.col("m.t")).alias("tablas"), "lecturas", "valores", F.round(1 - F.col("m.n") / F.col("lecturas"), 6).alias("discordancia"))


def fingerprint_changes(spark: SparkSession, root: str) -> DataFrame:
    """What two versions of the extractors found differently, both ways, as bags."""
    s = _smoke(spark, root).select("extractor_version", "extractor_id", "fixture", "tablas_halladas")
    old, new = (s.filter(F.col("extractor_version") == v).drop("extractor_version") for v in ("1.2.0", "2.0.0"))
    return residue(old, new, ["extractor_id", "fixture", "tablas_halladas"]).withColumnRenamed("_n", "copias")


def symmetric_difference(spark: SparkSession, root: str) -> DataFrame:
    a = table(spark, root, "humo").select("fixture").distinct()
    b = table(spark, root, "correcciones").select("fixture").distinct()
    j = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), "fixture", "full_outer")
    return j.filter("_a IS NULL OR _b IS NULL").groupBy(F.when(F.col("_b").isNull(), "humo").otherwise("correcciones").alias("solo_en")).agg(F.count(F.lit(1)).alias("fixtures"))


def population_union(spark: SparkSession, root: str) -> DataFrame:
    """Documents of the candidates and of the selection, each once, and how often they were listed."""
    u = table(spark, root, "elegidos").select(F.col("id").alias("documento")).unionByName(table(spark, root, "seleccion").select(F.col("external_id").alias("documento")))
    return u.groupBy("documento").agg(F.count(F.lit(1)).alias("veces"))


def first_of_each(spark: SparkSession, root: str) -> DataFrame:
    """Of a table that was chosen several times, the first choice."""
    s = table(spark, root, "seleccion").select("external_id", "tabla", "banda", "n_pages", F.unix_micros("elegido_en").alias("us"))
    return latest(s.withColumn("antes", -F.col("us")), ["external_id", "tabla"], "antes", ["banda", "n_pages", "us"])


def population_regimes(spark: SparkSession, root: str) -> DataFrame:
    """A campaign's population: all candidates with tables, and of those without a sample of forty in each band."""
    e = table(spark, root, "elegidos").select(F.col("id").alias("documento"), "banda", "tablas_verdad").distinct()
    census = e.filter("tablas_verdad > 0").select("documento").distinct()
    samples = sampling.stratified(e.filter("tablas_verdad = 0").select("documento", "banda").distinct(), "banda", "documento", 40, "p")
    return journal.population(census, samples)


def population_first(spark: SparkSession, root: str) -> DataFrame:
    """The same cut to its first five hundred documents, by regime and name."""
    return journal.population_cut(population_regimes(spark, root), 500, ["regimen", "documento"])


def count_agreement(spark: SparkSession, root: str) -> DataFrame:
    """Each extractor's largest count for a bulletin against the true one."""
    truth = table(spark, root, "elegidos").filter("tablas_verdad > 0").select(F.col("id").alias("external_id"), F.col("tablas_verdad").alias("m")).distinct()
    seen = table(spark, root, "censo_tablas").filter("extractor_id IS NOT NULL AND tablas IS NOT NULL").groupBy("external_id", "extractor_id").agg(F.max("tablas").alias("n"))
    j = truth.withColumn("extractor_id", F.explode(F.array(*[F.lit(e) for e in EXTRACTORS]))).join(seen, ["external_id", "extractor_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.groupBy("extractor_id").agg(F.count(F.lit(1)).alias("documentos"), F.count_if(F.col("n") == F.col("m")).alias("iguales"), F.sum(F.greatest(F.col("n") - F.col("m"), F.lit(0))).alias("de_mas"), F.sum(F.greatest(F.col("m") - F.col("n"), F.lit(0))).alias("de_menos"))


QUERIES = {f.__name__: f for f in (
    failures_by_cause, latency_cost, run_summary, wilson_intervals, ratio_estimator, ols_slope, projected_hours, cluster_bootstrap_ci, quartiles_exclusive, cost_summary, series_verdicts,
    largest_remainder_quota, stratified_sample, first_per_cell, work_order, pending_units, feasibility_frontier, twenty_cheapest, lightest_by_band, quickstart_greedy, request_spacing, stop_rule,
    target_cutoff, discard_by_season, text_layer_census, false_positives, consensus_counts, fingerprint_changes, symmetric_difference, population_union, population_regimes, population_first, first_of_each, count_agreement,
)}

_H = "WITH h AS (SELECT DISTINCT medicion_id, fixture, extractor_id, extractor_version, segundos, paginas, tablas_halladas, error FROM humo), t AS (SELECT *, CASE WHEN paginas <= 10 THEN '<=10' WHEN paginas <= 50 THEN '11-50' ELSE '>50' END AS banda FROM h WHERE segundos >= 0 AND NOT isnan(segundos) AND paginas > 0) "
_WILSON = "round(greatest(({p} + 1.9208 / {n}) / (1 + 3.8416 / {n}) - 1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4.0 * {n} * {n})) / (1 + 3.8416 / {n}), 0), 6) AS bajo, round(least(({p} + 1.9208 / {n}) / (1 + 3.8416 / {n}) + 1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4.0 * {n} * {n})) / (1 + 3.8416 / {n}), 1), 6) AS alto"
_EV = "WITH e AS (SELECT event_id, event_type, row_number() OVER w AS tried, count(*) FILTER (event_type = 'error') OVER w AS spent, count(*) FILTER (event_type <> 'error') OVER w AS accepted FROM events WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) "
_X4 = "(VALUES ('lectorplano'), ('marcas'), ('rejilla'), ('visor')) x(extractor_id)"
_Q = "CASE WHEN n > 1 THEN round(l[j{i}::INT] + ({i} * (n + 1) / 4.0 - j{i}) * (l[j{i}::INT + 1] - l[j{i}::INT]), 6) END AS q{i}"
_D = "SELECT {k} AS estacion, count(*) AS intentados, count(*) FILTER (text <> '') AS aceptados, count(*) - count(*) FILTER (text <> '') AS descartes, round((count(*) - count(*) FILTER (text <> '')) / count(*), 6) AS tasa, count(DISTINCT published_on) AS dias FROM documents WHERE published_on IS NOT NULL"

_POP = "WITH s AS (SELECT id, row_number() OVER (PARTITION BY banda ORDER BY md5(id || '-p'), id) AS r FROM (SELECT DISTINCT id, banda FROM elegidos WHERE tablas_verdad = 0)), p AS (SELECT DISTINCT id AS documento, 'censo' AS regimen FROM elegidos WHERE tablas_verdad > 0 UNION ALL SELECT id, 'muestra' FROM s WHERE r <= 40) "

SQL = {
    "failures_by_cause": _H + "SELECT extractor_id, error, count(*) AS n FROM h WHERE error <> '' GROUP BY ALL",
    "latency_cost": _H + "SELECT extractor_id, count(*) AS extracciones, sum(paginas)::BIGINT AS paginas, round(sum(segundos) / sum(paginas), 6) AS s_por_pagina, round(sum(segundos) / count(*), 6) AS s_por_documento, round(sum(segundos) / 3600, 6) AS horas, floor(quantile_cont(segundos, 0.5) * 1000 + 1e-6)::INT AS latencia_ms FROM t GROUP BY extractor_id",
    "run_summary": _H + "SELECT extractor_id, count(*) AS hechas, sum(tablas_halladas)::BIGINT AS tablas, round(sum(segundos) FILTER (segundos >= 0 AND NOT isnan(segundos)), 3) AS segundos, round(avg((error <> '')::INT), 6) AS tasa_fallo FROM h GROUP BY extractor_id",
    "wilson_intervals": _H + f"SELECT extractor_id, extractor_version, fallos, n, {_WILSON.format(p='(fallos / n)', n='n')} FROM (SELECT extractor_id, extractor_version, count(*) FILTER (error <> '') AS fallos, count(*) AS n FROM h GROUP BY ALL)",
    "ratio_estimator": _H + "SELECT extractor_id, banda, round(sum(segundos) / sum(paginas), 6) AS s_por_pagina, count(*) AS n FROM t GROUP BY ALL",
    "ols_slope": _H + "SELECT extractor_id, extractor_version, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(coalesce(regr_slope(segundos / paginas, paginas), 0), 8) END AS slope FROM t GROUP BY ALL",
    "projected_hours": _H + ", p AS (SELECT CASE WHEN paginas <= 10 THEN '<=10' WHEN paginas <= 50 THEN '11-50' ELSE '>50' END AS banda, sum(paginas) AS paginas FROM (SELECT DISTINCT id, paginas FROM elegidos WHERE paginas > 0) GROUP BY 1), r AS (SELECT extractor_id, banda, sum(segundos) / sum(paginas) AS r FROM t GROUP BY ALL), f AS (SELECT extractor_id, sum(segundos) / sum(paginas) AS f FROM t GROUP BY ALL), h2 AS (SELECT extractor_id, sum(r * paginas) / 3600 AS h, sum(f * paginas) / 3600 AS f FROM r JOIN p USING (banda) JOIN f USING (extractor_id) GROUP BY extractor_id) SELECT extractor_id, round(h, 6) AS horas, round((f - h) / h, 6) AS error_sobre_real, round((h - f) / f, 6) AS error_sobre_estimado FROM h2",
    "quartiles_exclusive": "WITH l AS (SELECT banda, list_sort(list(coste_ms)) AS l, count(*) AS n FROM (SELECT DISTINCT * FROM elegidos) WHERE coste_ms IS NOT NULL GROUP BY banda), j AS (SELECT *, "
    + ", ".join(f"least(greatest(floor({i} * (n + 1) / 4.0), 1), n - 1) AS j{i}" for i in (1, 2, 3)) + " FROM l) SELECT banda, n, " + ", ".join(_Q.format(i=i) for i in (1, 2, 3)) + " FROM j",
    "cost_summary": "WITH e AS (SELECT DISTINCT * FROM elegidos), l AS (SELECT banda, list_sort(list(coste_ms) FILTER (coste_ms IS NOT NULL)) AS c, list_sort(list(bytes) FILTER (bytes IS NOT NULL)) AS b, floor(avg(coste_ms))::BIGINT AS media FROM e GROUP BY banda) SELECT banda, len(c) AS n, floor((c[(len(c) + 1) // 2] + c[len(c) // 2 + 1]) / 2)::BIGINT AS mediana, media, c[least(len(c) * 9 // 10 + 1, len(c))]::BIGINT AS p90, c[len(c)]::BIGINT AS maximo, b[len(b) // 2 + 1]::BIGINT AS peso FROM l",
    "series_verdicts": "WITH s AS (SELECT hito, maquina, list_sort(list_filter(tiempos, lambda x: x >= 0)) AS l FROM (SELECT DISTINCT serie_id, hito, maquina, tiempos FROM serie)), v AS (SELECT hito, maquina, l[greatest(least(len(l) * 9 // 10 + 1, len(l)), 1)] <= techo AS ok FROM s JOIN techos ON fuente = 'serie' AND clave = hito WHERE len(l) > 0) SELECT hito, maquina, count(*) AS series, CASE WHEN bool_and(ok) THEN 'pasa' WHEN NOT bool_or(ok) THEN 'no pasa' ELSE 'no concluye' END AS veredicto FROM v GROUP BY ALL",
    "largest_remainder_quota": "WITH s AS (SELECT banda, count(DISTINCT id) AS n FROM elegidos GROUP BY banda), e AS (SELECT *, 17.0 * n / sum(n) OVER () AS e FROM s) SELECT banda, n, (floor(e) + (row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, banda) <= 17 - sum(floor(e)) OVER ())::INT)::INT AS quota FROM e",
    "stratified_sample": "WITH s AS (SELECT DISTINCT external_id || '-t' || tabla AS clave, CASE WHEN n_tablas_del_documento = 1 THEN 'una página' WHEN n_tablas_del_documento BETWEEN 2 AND 10 THEN '2-10' WHEN n_tablas_del_documento BETWEEN 11 AND 50 THEN '11-50' WHEN n_tablas_del_documento > 50 THEN '>50' ELSE '(sin páginas)' END AS estrato, n_tablas_del_documento FROM seleccion), r AS (SELECT estrato, clave, row_number() OVER (PARTITION BY estrato ORDER BY md5(clave || '-7'), clave) AS place FROM s) SELECT * FROM r WHERE place <= 40",
    "first_per_cell": "SELECT * FROM (SELECT id, banda, con_tabla, row_number() OVER (PARTITION BY banda, con_tabla ORDER BY id) AS place FROM (SELECT DISTINCT id, banda, tablas_verdad > 0 AS con_tabla FROM elegidos)) WHERE place <= 2",
    "work_order": f"SELECT row_number() OVER (PARTITION BY banda, extractor_id ORDER BY id) AS round, extractor_id AS extractor, banda, id FROM (SELECT DISTINCT id, banda FROM elegidos), {_X4}",
    "pending_units": f"SELECT DISTINCT extractor_id AS extractor, id FROM elegidos, {_X4} WHERE NOT EXISTS (SELECT 1 FROM humo h WHERE h.extractor_id = x.extractor_id AND regexp_replace(h.fixture, '-t[0-9]+$', '') = elegidos.id)",
    "feasibility_frontier": "WITH e AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY bytes, id) AS r FROM (SELECT DISTINCT id, bytes, coste_ms, paginas, aciertan = 4 AS a FROM elegidos WHERE tablas_verdad > 0 AND bytes IS NOT NULL AND coste_ms IS NOT NULL AND aciertan IS NOT NULL)) SELECT k, count(*) AS n, sum(bytes)::BIGINT AS bytes, sum(coste_ms)::BIGINT AS coste_ms, count(*) FILTER (a) AS acuerdan, min(paginas) AS paginas_min, max(paginas) AS paginas_max FROM e, range(0, 21) g(k) WHERE CASE WHEN a THEN r <= k ELSE r <= 20 - k END GROUP BY k HAVING count(*) = 20",
    "twenty_cheapest": "SELECT DISTINCT id, coste_ms, bytes FROM elegidos WHERE coste_ms IS NOT NULL ORDER BY coste_ms, id LIMIT 20",
    "lightest_by_band": "SELECT banda, id, bytes FROM (SELECT *, row_number() OVER (PARTITION BY banda ORDER BY bytes, id) AS r FROM elegidos WHERE bytes IS NOT NULL) WHERE r = 1",
    "request_spacing": "WITH g AS (SELECT epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (ORDER BY ts, event_id) AS g FROM events) SELECT round(quantile_cont(g, 0.5), 6) AS mediana_s, round(min(g), 6) AS minimo_s, count(g) AS n FROM g",
    "stop_rule": _EV + "SELECT event_id, tried, spent FROM e WHERE tried >= 20 AND spent / tried > 0.05 ORDER BY tried LIMIT 1",
    "target_cutoff": _EV + "SELECT event_id, tried, accepted FROM e WHERE accepted - (event_type <> 'error')::INT < 500",
    "discard_by_season": _D.format(k="CASE WHEN dayofyear(published_on) < 79 THEN 'invierno' ELSE 'primavera' END") + " GROUP BY 1 UNION ALL " + _D.format(k="'toda_la_ventana'"),
    "text_layer_census": "SELECT coalesce(lower(lang), '(sin lengua)') AS lengua, count(*) AS documentos, count(*) FILTER (length(text) > 0) AS con_texto, count(*) FILTER (text IS NULL) AS ilegibles FROM documents GROUP BY 1",
    "false_positives": f"WITH d AS (SELECT DISTINCT id AS external_id, CASE WHEN paginas <= 4 THEN '1-4' WHEN paginas <= 12 THEN '5-12' ELSE '13+' END AS banda FROM elegidos WHERE tablas_verdad = 0), s AS (SELECT external_id, extractor_id, max(tablas) AS m FROM censo_tablas GROUP BY ALL), g AS (SELECT x.extractor_id, banda, count(*) AS n, count(*) FILTER (m > 0) AS c FROM d CROSS JOIN {_X4} LEFT JOIN s ON s.external_id = d.external_id AND s.extractor_id = x.extractor_id GROUP BY ALL), w AS (SELECT *, {_WILSON.format(p='(c / n)', n='n')} FROM g) SELECT extractor_id, banda, n, c AS con_tabla, round(c / n, 6) AS tasa, CASE WHEN banda = '1-4' THEN bajo END AS bajo, CASE WHEN banda = '1-4' THEN alto END AS alto FROM w",
    "consensus_counts": "WITH p AS (SELECT external_id, tablas, count(*) AS n FROM censo_tablas WHERE tablas IS NOT NULL GROUP BY ALL) SELECT external_id, first(tablas ORDER BY n DESC, tablas) AS tablas, sum(n)::BIGINT AS lecturas, count(*) AS valores, round(1 - max(n) / sum(n), 6) AS discordancia FROM p GROUP BY external_id",
    "fingerprint_changes": _H + "SELECT extractor_id, fixture, tablas_halladas, sum(s)::BIGINT AS copias FROM (SELECT *, CASE extractor_version WHEN '1.2.0' THEN 1 ELSE -1 END AS s FROM h WHERE extractor_version IN ('1.2.0', '2.0.0')) GROUP BY extractor_id, fixture, tablas_halladas HAVING sum(s) <> 0",
    "symmetric_difference": "SELECT 'humo' AS solo_en, count(*) AS fixtures FROM (SELECT fixture FROM humo EXCEPT SELECT fixture FROM correcciones) UNION ALL SELECT 'correcciones', count(*) FROM (SELECT fixture FROM correcciones EXCEPT SELECT fixture FROM humo)",
    "population_union": "SELECT documento, count(*) AS veces FROM (SELECT id AS documento FROM elegidos UNION ALL SELECT external_id FROM seleccion) GROUP BY documento",
    "first_of_each": "SELECT external_id, tabla, banda, n_pages, epoch_us(elegido_en) AS us FROM (SELECT *, row_number() OVER (PARTITION BY external_id, tabla ORDER BY elegido_en NULLS LAST, banda DESC NULLS LAST, n_pages DESC NULLS LAST) AS r FROM seleccion) WHERE r = 1",
    "population_regimes": _POP + "SELECT * FROM p",
    "population_first": _POP + "SELECT * FROM p ORDER BY regimen, documento LIMIT 500",
    "count_agreement": f"WITH d AS (SELECT DISTINCT id AS external_id, tablas_verdad AS m FROM elegidos WHERE tablas_verdad > 0), s AS (SELECT external_id, extractor_id, max(tablas) AS n FROM censo_tablas WHERE extractor_id IS NOT NULL AND tablas IS NOT NULL GROUP BY ALL), j AS (SELECT x.extractor_id, m, coalesce(n, 0) AS n FROM d CROSS JOIN {_X4} LEFT JOIN s ON s.external_id = d.external_id AND s.extractor_id = x.extractor_id) SELECT extractor_id, count(*) AS documentos, count(*) FILTER (n = m) AS iguales, sum(greatest(n - m, 0))::BIGINT AS de_mas, sum(greatest(m - n, 0))::BIGINT AS de_menos FROM j GROUP BY extractor_id",
}
