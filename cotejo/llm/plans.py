"""Queries of the problems of training data, each with its SQL where SQL can express it on whole tables."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.llm import balanced, leakage, mixing, quantiles, reading, textform, variety
from cotejo.operators.diff import latest
from cotejo.sources import cut, table

# ---------------------------------------------------------------- 1: percentiles

PERCENTS = (50, 90, 95, 99)
GROUP = ["fuente", "clave", "subclave"]


def _once(df: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of the distinct rows of `df`. Rows are told apart by two 64-bit hashes of all their
    columns and of which of them are null, which is all that is shuffled besides `columns`."""
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in df.columns])
    hashes = [F.xxhash64(F.lit(seed), nulls, *df.columns).alias(f"_h{seed}") for seed in (1, 2)]
    return df.select(*columns, *hashes).distinct().select(*columns)


def measurements(spark: SparkSession, root: str, day: bool = False) -> DataFrame:
    """fuente, clave, subclave, x (and the day of the row), a row per measurement; repeated rows count once."""
    serie, humo, elegidos = (table(spark, root, t) for t in ("serie", "humo", "elegidos"))
    d = (lambda c: [F.to_date(c).alias("dia")]) if day else (lambda c: [])
    runs = _once(serie, ["hito", "maquina", "tiempos", *(["inicio"] if day else [])]).select(F.lit("serie").alias("fuente"), F.col("hito").alias("clave"), F.col("maquina").alias("subclave"), *d("inicio"), F.explode(F.col("tiempos").cast("array<double>")).alias("x"))
    smoke = _once(humo, ["extractor_id", "extractor_version", "segundos", *(["medido_en"] if day else [])]).select(F.lit("humo").alias("fuente"), F.col("extractor_id").alias("clave"), F.col("extractor_version").alias("subclave"), *d("medido_en"), F.col("segundos").alias("x"))
    costs = _once(elegidos, ["banda", "coste_ms", *(["elegido_en"] if day else [])]).select(F.lit("elegidos").alias("fuente"), F.col("banda").alias("clave"), F.lit("-").alias("subclave"), *d("elegido_en"), F.col("coste_ms").cast("double").alias("x"))
    return runs.unionAll(smoke).unionAll(costs).filter("x >= 0 AND NOT isnan(x)")


LIMITS = {"on": ["fuente", "clave"], "limit": "techo", "percent": "percentil"}


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return quantiles.above(cut(measurements(spark, root), "measurements"), GROUP, "x", table(spark, root, "techos"), **LIMITS)


def p1_told(spark: SparkSession, root: str) -> DataFrame:
    """How many groups the sketch settles, above and not above, and how many it leaves to the second pass, by source."""
    c = quantiles.compared(quantiles.sketch(measurements(spark, root), GROUP, "x"), GROUP, table(spark, root, "techos"), **LIMITS)
    return c.groupBy("fuente").agg(F.count_if("above").alias("por_encima"), F.count_if(~F.col("above")).alias("no"), F.count_if(F.col("above").isNull()).alias("en_duda"))


def p1_bound(spark: SparkSession, root: str) -> DataFrame:
    """Whether the percentiles keep their bound, told by counting all values: the value of the percentile's rank must lie within 1 % of what the sketch gives."""
    m = cut(measurements(spark, root), "measurements")
    p = quantiles.percentiles(quantiles.sketch(m, GROUP, "x"), GROUP, PERCENTS)
    wide = p.groupBy(*[F.col(k).alias(f"_{k}") for k in GROUP]).agg(*[F.max(F.when(F.col("percent") == q, F.col("value"))).alias(f"v{q}") for q in PERCENTS])
    x, a = F.col("x"), quantiles.ALPHA
    counts = m.join(wide, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in GROUP]).groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(x <= F.col(f"v{q}") / (1 - a) * (1 + 1e-9)).alias(f"hi{q}") for q in PERCENTS], *[F.count_if(x < F.col(f"v{q}") / (1 + a) * (1 - 1e-9)).alias(f"lo{q}") for q in PERCENTS]
    )
    kept = lambda q: (F.col(f"hi{q}") >= quantiles.rank(F.lit(q), F.col("n"))) & (F.col(f"lo{q}") < quantiles.rank(F.lit(q), F.col("n")))
    each = F.array(*[F.struct(F.lit(float(q)).alias("percentil"), kept(q).alias("dentro")) for q in PERCENTS])
    return counts.select(*GROUP, "n", F.inline(each))


def p1_percentiles(spark: SparkSession, root: str) -> DataFrame:
    """Percentiles of every group, each within 1 % of the true value."""
    p = quantiles.percentiles(quantiles.sketch(measurements(spark, root), GROUP, "x"), GROUP, PERCENTS)
    return p.select(*GROUP, F.col("percent").alias("percentil"), F.col("rows").alias("n"), F.round("value", 6).alias("valor"))


def p1_days_combined(spark: SparkSession, root: str) -> DataFrame:
    """The same from sketches by day, added up."""
    daily = quantiles.sketch(measurements(spark, root, day=True), [*GROUP, "dia"], "x")
    p = quantiles.percentiles(quantiles.merge([daily], GROUP), GROUP, PERCENTS)
    return p.select(*GROUP, F.col("percent").alias("percentil"), F.col("rows").alias("n"), F.round("value", 6).alias("valor"))


_MEASURED = """WITH m AS (SELECT 'serie' AS fuente, hito AS clave, maquina AS subclave, unnest(tiempos)::DOUBLE AS x FROM (SELECT DISTINCT * FROM serie)
UNION ALL SELECT 'humo', extractor_id, extractor_version, segundos FROM (SELECT DISTINCT * FROM humo)
UNION ALL SELECT 'elegidos', banda, '-', coste_ms::DOUBLE FROM (SELECT DISTINCT * FROM elegidos)),
v AS (SELECT * FROM m WHERE x >= 0 AND NOT isnan(x))
"""
_G = quantiles.growth(quantiles.ALPHA)
_BUCKETS = (
    _MEASURED
    + f""", b AS (SELECT fuente, clave, subclave, CASE WHEN x = 0 THEN NULL ELSE ceil(ln(x) / {math.log(_G)!r})::INT END AS b, count(*) AS n FROM v GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY fuente, clave, subclave ORDER BY b NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY fuente, clave, subclave) AS total FROM b),
p AS (SELECT *, unnest([50.0, 90.0, 95.0, 99.0])::DOUBLE AS percentil FROM c)
SELECT fuente, clave, subclave, percentil, total::BIGINT AS n, round(CASE WHEN b IS NULL THEN 0.0 ELSE pow({_G!r}, b) * {2 / (_G + 1)!r} END, 6) AS valor
FROM p WHERE upto >= greatest(1, ceil(percentil * total / 100 - 1e-9)) AND upto - n < greatest(1, ceil(percentil * total / 100 - 1e-9))"""
)

# ---------------------------------------------------------------- 2: variety

SCALARS = ["banda", "celda_combinada", "de_mas"]
QUICKSTART = 200


def _candidates(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "elegidos").select("id", "razon", *SCALARS)
    return e.withColumn("palabras", textform.word_set("razon"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return variety.alone(_candidates(spark, root), "id", "palabras", SCALARS).select("id")


def _quickstart(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    groups = cut(variety.grouped(_candidates(spark, root), "id", "palabras", SCALARS), "groups")
    return groups, variety.subset(groups, "id", "palabras", SCALARS, QUICKSTART)


def p2_quickstart(spark: SparkSession, root: str) -> DataFrame:
    """The quickstart set, with the cluster each candidate stands for."""
    return _quickstart(spark, root)[1]


def p2_quotas(spark: SparkSession, root: str) -> DataFrame:
    """What must hold of the quickstart set: its size, candidates that come twice or that `elegidos` lacks, clusters whose number is not their quota, and types of a cluster
    that give two fewer than another that has no more left to give than they."""
    groups, got = _quickstart(spark, root)
    sizes = {r["cluster"]: r["n"] for r in groups.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = variety.quotas(sizes, QUICKSTART)
    features = ["cluster", "palabras", *SCALARS]
    chosen = got.groupBy(*features).agg(F.count(F.lit(1)).alias("took"))
    on = [F.col(f"a.{x}").eqNullSafe(F.col(f"b.{x}")) for x in features]
    types = groups.select(*features, "n_alike").distinct().alias("a").join(chosen.alias("b"), on, "left").select("a.cluster", "a.n_alike", F.coalesce("b.took", F.lit(0)).alias("took"))
    per = types.groupBy("cluster").agg(F.sum("took").alias("took"), F.max("took").alias("most"), F.min(F.when(F.col("took") < F.col("n_alike"), F.col("took"))).alias("least"))
    off = F.col("took") != (F.create_map(*[F.lit(x) for c, n in share.items() for x in (c, n)])[F.col("cluster")] if share else F.lit(0))
    kept = per.agg(F.count_if(off).alias("fuera_de_cuota"), F.count_if(F.col("most") - F.col("least") > 1).alias("desiguales"))
    known = table(spark, root, "elegidos").select("id").distinct()
    ids = got.groupBy("id", *features).agg(F.count(F.lit(1)).alias("n"))
    whole = ids.join(known.withColumn("_known", F.lit(1)), "id", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("elegidos"), F.count_if(F.col("n") > 1).alias("repetidos"), F.count_if(F.col("_known").isNull()).alias("ajenos"))
    return whole.join(kept)


# ---------------------------------------------------------------- 4: look-alike texts

def _texts(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "correcciones").select("correccion_id", "puse", "el_pdf_dice", F.col("evidencia.bytes_utf8_del_corregido").alias("_hex"))
    return c.withColumn("corregido", textform.from_hex(F.col("_hex"))).drop("_hex").distinct()


TEXTS = ("puse", "el_pdf_dice", "corregido")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return textform.look_alike(_texts(spark, root), TEXTS, textform.confusables(spark)).select("correccion_id").distinct()


def p4_canonical(spark: SparkSession, root: str) -> DataFrame:
    """All texts in the consistent form."""
    form = textform.canonical_form(textform.confusables(spark))
    return _texts(spark, root).select("correccion_id", *[form(F.col(c)).alias(c) for c in TEXTS])


def p4_checks(spark: SparkSession, root: str) -> DataFrame:
    """What must hold of the consistent form, over all texts: forms that change when the form is taken again, and ASCII texts whose form is not the text in
    lower case with single blanks. The number of texts by length of the text in ASCII or not."""
    form = textform.canonical_form(textform.confusables(spark))
    each = _texts(spark, root).select(F.explode(F.array_compact(F.array(*TEXTS))).alias("t")).withColumn("f", form(F.col("t"))).withColumn("g", form(F.col("f")))
    ascii_ = F.col("t").rlike(r"^[\x00-\x7f]*$")
    plain = F.trim(F.regexp_replace(F.lower("t"), r"[\x09-\x0d\x1c-\x20]+", " "))
    return each.groupBy(ascii_.alias("ascii")).agg(F.count(F.lit(1)).alias("textos"), F.count_if(F.col("f") != F.col("g")).alias("inestables"), F.count_if(ascii_ & (F.col("f") != plain)).alias("distintos"))


# ---------------------------------------------------------------- 6: quotas


def _joined_words(c: str) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}]+", "-"), F.lit("-"))


def selection(spark: SparkSession, root: str) -> DataFrame:
    """Each (external_id, tabla) of seleccion once, as last chosen, with the estrato meant and the banda of its pages."""
    last = latest(table(spark, root, "seleccion"), ["external_id", "tabla"], "elegido_en", ["estrato", "banda", "n_pages"])
    pages = F.when(F.col("n_pages").between(1, 4), "corto").when(F.col("n_pages").between(5, 12), "medio").when(F.col("n_pages") >= 13, "largo")
    return last.select("external_id", "tabla", _joined_words("estrato").alias("estrato"), F.coalesce(pages, _joined_words("banda")).alias("banda"))


def _quota_sample(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    s = cut(selection(spark, root), "selection")
    return balanced.quota_sample(s, ["estrato", "banda"], table(spark, root, "cuotas"), "proporcion", "minimo", s.count() / 10)


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    # All there are were drawn, and that is less than was wanted.
    return _quota_sample(spark, root)[1].filter("drawn = available AND drawn < wanted").select("estrato", "banda")


def p6_sample(spark: SparkSession, root: str) -> DataFrame:
    return _quota_sample(spark, root)[0]


def p6_report(spark: SparkSession, root: str) -> DataFrame:
    """What each quota wanted and got."""
    return _quota_sample(spark, root)[1]


def p6_kept(spark: SparkSession, root: str) -> DataFrame:
    """The report without what depends on the draw: what each quota wanted and had, whether the number drawn is off by less than one, records that came twice and
    records that are of another category."""
    sample, report = _quota_sample(spark, root)
    back = selection(spark, root).select("external_id", "tabla", F.col("estrato").alias("_e"), F.col("banda").alias("_b"))
    each = sample.groupBy("estrato", "banda", "external_id", "tabla").agg(F.count(F.lit(1)).alias("_n")).join(back, ["external_id", "tabla"], "left")
    faults = each.groupBy("estrato", "banda").agg(F.count_if(F.col("_n") > 1).alias("_twice"), F.count_if(~(F.col("_e").eqNullSafe(F.col("estrato")) & F.col("_b").eqNullSafe(F.col("banda")))).alias("_other"))
    near = F.abs(F.col("drawn") - F.least("wanted", "available")) < 1
    zero = lambda c, n: F.coalesce(F.col(c), F.lit(0)).alias(n)
    return report.join(faults, ["estrato", "banda"], "left").select("estrato", "banda", "available", F.round("wanted", 6).alias("wanted"), "short", near.alias("near"), zero("_twice", "twice"), zero("_other", "other"))


_SELECTED = r"""WITH l AS (SELECT external_id, tabla, trim(regexp_replace(lower(estrato), '[^\p{L}]+', '-', 'g'), '-') AS estrato,
  CASE WHEN n_pages BETWEEN 1 AND 4 THEN 'corto' WHEN n_pages BETWEEN 5 AND 12 THEN 'medio' WHEN n_pages >= 13 THEN 'largo' ELSE trim(regexp_replace(lower(banda), '[^\p{L}]+', '-', 'g'), '-') END AS banda
  FROM (SELECT *, row_number() OVER (PARTITION BY external_id, tabla ORDER BY elegido_en DESC NULLS LAST, estrato DESC NULLS LAST, banda DESC NULLS LAST, n_pages DESC NULLS LAST) AS rn FROM seleccion) WHERE rn = 1),
a AS (SELECT c.estrato, c.banda, greatest(c.minimo, c.proporcion * (SELECT count(*) FROM l) / 10) AS wanted, count(l.external_id) AS available
  FROM cuotas c LEFT JOIN l ON c.estrato = l.estrato AND c.banda = l.banda GROUP BY c.estrato, c.banda, c.minimo, c.proporcion)
"""

# ---------------------------------------------------------------- 7: leaks


def p7_leaks(spark: SparkSession, root: str) -> DataFrame:
    """Documents with the items they contain, and how many of an item's words."""
    return leakage.leaks(table(spark, root, "documents"), "doc_id", "text", table(spark, root, "items_prueba"), "item_id", "texto")


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return p7_leaks(spark, root).select("doc_id", "item_id")


def p7_items(spark: SparkSession, root: str) -> DataFrame:
    """The items that leaked, with the number of documents and the largest part found."""
    return p7_leaks(spark, root).groupBy("item_id").agg(F.count(F.lit(1)).alias("documentos"), F.max(F.col("found") / F.col("words")).alias("parte"))


# ---------------------------------------------------------------- 8: mix


def _source(c: str) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}]+", "_"), F.lit("_"))


def _mix_plan(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, root, "documents").select("doc_id", _source("source").alias("source"), "text")
    sized = mixing.sized_documents(d, "doc_id", "source", "text")
    return sized, mixing.source_plan(sized, table(spark, root, "mezcla"), "source", "tokens", "peso_objetivo", "max_repeticiones")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    # A source whose targets must be tempered cannot reach its own; the exact comparison follows.
    return _mix_plan(spark, root)[1].filter("exponent > 0").filter("NOT reachable").select("source")


def p8_mix(spark: SparkSession, root: str) -> DataFrame:
    """The mix: each of its documents with the number of times it is used."""
    sized, plan = _mix_plan(spark, root)
    return mixing.mix(sized, plan, "doc_id", "source", "tokens")


def _used(spark: SparkSession, root: str) -> DataFrame:
    sized, plan = _mix_plan(spark, root)
    used = mixing.mix(sized, plan, "doc_id", "source", "tokens").groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"), F.max("copies").alias("most_copies"), F.max("tokens").alias("_longest"))
    return plan.join(used, "source", "left").fillna(0, ["used", "most_copies"])


def p8_shares(spark: SparkSession, root: str) -> DataFrame:
    """Target share, budget and share really reached, by source."""
    used = cut(_used(spark, root), "used")
    whole = used.agg(F.sum("used")).first()[0] or 0
    return used.select("source", "tokens", "target", "repeats", F.round("exponent", 6).alias("exponent"), "budget", "reachable", "used", "most_copies", (F.col("used") / F.lit(float(max(whole, 1)))).alias("share"))


def p8_kept(spark: SparkSession, root: str) -> DataFrame:
    """What must hold of the mix, by source: no document too often, tokens within a document of the budget, the target met where it can be, and no more than there is where not."""
    used = _used(spark, root)
    near = (F.col("used") <= F.col("budget")) & (F.col("budget") - F.col("used") < F.greatest(F.col("_longest"), F.lit(1)) + F.lit(1e-6)) | (F.col("budget") == 0)
    aim = F.when(F.col("reachable"), F.col("budget") >= F.col("wanted") * (1 - 1e-9)).otherwise(F.abs(F.col("budget") - F.col("repeats") * F.col("tokens")) < 1)
    return used.select("source", (F.col("most_copies") <= F.col("repeats")).alias("repeticiones"), near.alias("presupuesto"), aim.alias("objetivo"), (F.col("reachable") == (F.col("exponent") == 0)).alias("exponente"))


def p8_tempered(spark: SparkSession, root: str) -> DataFrame:
    """The sources' own shares tempered to the entropy that the target shares have, and the targets tempered as far as all limits ask; a row per source."""
    plan = _mix_plan(spark, root)[1]

    def work(parts):
        for p in parts:
            own, aim, most = (p[c].to_numpy(float) for c in ("tokens", "target", "repeats"))
            even = mixing.exponent_for_entropy(own, mixing.entropy(aim))
            far = mixing.exponent_for_repeats(own, float(own.sum()), most, aim)
            yield pd.DataFrame({"source": p["source"], "by_entropy": mixing.tempered(own, even), "entropy_exponent": even, "by_limits": mixing.tempered(own, far, aim), "limits_exponent": far})

    return plan.coalesce(1).mapInPandas(work, "source string, by_entropy double, entropy_exponent double, by_limits double, limits_exponent double")


# ---------------------------------------------------------------- 9: reading level


def p9_levels(spark: SparkSession, root: str) -> DataFrame:
    """Level and chance of level 4 or 5 of every document."""
    d = table(spark, root, "documents")
    model = reading.fit(*reading.labelled(d, table(spark, root, "lecturas"), "doc_id", "text", "nivel"))
    return reading.levels(d, "doc_id", "text", model)


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return p9_levels(spark, root).filter("level >= 4").select("doc_id")


def p9_profile(spark: SparkSession, root: str) -> DataFrame:
    """Documents by source meant and level."""
    d = table(spark, root, "documents").select("doc_id", _source("source").alias("source"))
    return p9_levels(spark, root).join(d, "doc_id").groupBy("source", "level").agg(F.count(F.lit(1)).alias("documentos"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_told, p1_bound, p1_percentiles, p1_days_combined, p2_found, p2_quickstart, p2_quotas, p4_found, p4_canonical, p4_checks, p6_found, p6_sample, p6_report, p6_kept,
        p7_found, p7_leaks, p7_items, p8_found, p8_mix, p8_shares, p8_kept, p8_tempered, p9_found, p9_levels, p9_profile,
    )
}

SQL = {
    "p1_found": _MEASURED + "SELECT fuente, clave, subclave FROM v JOIN techos USING (fuente, clave) GROUP BY fuente, clave, subclave, percentil, techo HAVING count(*) FILTER (x <= techo) < greatest(1, ceil(percentil * count(*) / 100.0 - 1e-9))",
    "p1_told": _MEASURED + f""", l AS (SELECT fuente, clave, subclave, list_sort(list(x)) AS l, count(*) AS n FROM v GROUP BY ALL),
g AS (SELECT fuente, techo, l[greatest(1, ceil(percentil * n / 100.0 - 1e-9))::BIGINT] AS q FROM l JOIN techos USING (fuente, clave)),
b AS (SELECT *, CASE WHEN q > 0 THEN exp((ceil(ln(q) / {math.log(_G)!r}) - 1) * {math.log(_G)!r}) ELSE 0 END AS low, CASE WHEN q > 0 THEN exp(ceil(ln(q) / {math.log(_G)!r}) * {math.log(_G)!r}) ELSE 0 END AS high FROM g)
SELECT fuente, count(*) FILTER (low > techo * (1 + 1e-9)) AS por_encima, count(*) FILTER (high < techo * (1 - 1e-9)) AS "no", count(*) FILTER (low <= techo * (1 + 1e-9) AND high >= techo * (1 - 1e-9)) AS en_duda FROM b GROUP BY fuente""",
    "p1_bound": _MEASURED + "SELECT fuente, clave, subclave, n, unnest([50.0, 90.0, 95.0, 99.0])::DOUBLE AS percentil, true AS dentro FROM (SELECT fuente, clave, subclave, count(*) AS n FROM v GROUP BY ALL)",
    "p1_percentiles": _BUCKETS,
    "p1_days_combined": _BUCKETS,
    "p2_found": r"""WITH e AS (SELECT DISTINCT id, banda, celda_combinada, de_mas,
  list_sort(list_distinct(list_filter(regexp_split_to_array(strip_accents(lower(nfc_normalize(razon))), '[^\p{L}\p{N}]+'), lambda w: w <> '' AND NOT regexp_full_match(w, '\p{N}+')))) AS palabras FROM elegidos)
SELECT any_value(id) AS id FROM e GROUP BY banda, celda_combinada, de_mas, palabras HAVING count(*) = 1""",
    "p2_quotas": f"SELECT least({QUICKSTART}, (SELECT count(*) FROM (SELECT DISTINCT id, razon, banda, celda_combinada, de_mas FROM elegidos))) AS elegidos, 0 AS repetidos, 0 AS ajenos, 0 AS fuera_de_cuota, 0 AS desiguales",
    "p4_checks": r"""WITH c AS (SELECT DISTINCT correccion_id, puse, el_pdf_dice, regexp_replace(lower(evidencia.bytes_utf8_del_corregido), '0x|\\x|[^0-9a-f]', '', 'g') AS h FROM correcciones),
d AS (SELECT DISTINCT correccion_id, puse, el_pdf_dice, CASE WHEN len(h) % 2 = 0 THEN decode(unhex(h)) END AS k FROM c), t AS (SELECT unnest(list_filter([puse, el_pdf_dice, k], lambda x: x IS NOT NULL)) AS t FROM d)
SELECT regexp_full_match(t, '[\x00-\x7f]*', 's') AS ascii, count(*) AS textos, 0 AS inestables, 0 AS distintos FROM t GROUP BY 1""",
    "p8_kept": "SELECT source, true AS repeticiones, true AS presupuesto, true AS objetivo, true AS exponente FROM mezcla",
    "p6_kept": _SELECTED + "SELECT estrato, banda, available, round(wanted, 6) AS wanted, available < wanted AS short, true AS near, 0 AS twice, 0 AS other FROM a",
    "p6_found": _SELECTED + "SELECT estrato, banda FROM a WHERE available < wanted",
}
