"""Checks of a corpus and of who works on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Why a pair of texts is not taken, in the order in which that is found out.
CAUSES = ("sin_xml", "sin_pdf", "xml_sin_texto", "pdf_sin_texto", "incoherente")


def containment(pairs: DataFrame, key: str, left: Column, right: Column) -> DataFrame:
    """`key`, shared, tokens, share: how many of the tokens of `left` (an array) are in `right` too, as bags. share is null if there are none.

    Equal tokens are counted before anything is moved; no pair of tokens is ever formed.
    """
    side = lambda c, n: pairs.select(key, F.explode(c).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("c")).select(key, "token", *[(F.col("c") if s == n else F.lit(0)).alias(s) for s in ("l", "r")])
    both = side(left, "l").unionAll(side(right, "r")).groupBy(key, "token").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    g = both.groupBy(key).agg(F.sum(F.least("l", "r")).alias("shared"), F.sum("l").alias("tokens"))
    return g.withColumn("share", F.try_divide("shared", "tokens"))


def verdict(xml: Column, pdf: Column, xml_tokens: Column, pdf_tokens: Column, similarity: Column, threshold: float) -> Column:
    """Why a pair is not taken, null if it is."""
    tests = (xml.isNull(), pdf.isNull(), F.coalesce(xml_tokens, F.lit(0)) == 0, F.coalesce(pdf_tokens, F.lit(0)) == 0, similarity < threshold)
    out = F.when(tests[0], CAUSES[0])
    for cause, test in zip(CAUSES[1:], tests[1:], strict=True):
        out = out.when(test, cause)
    return out


def discards(verdicts: DataFrame, cause: str) -> DataFrame:
    """cause (null: taken), n; the numbers add up to all pairs."""
    return verdicts.groupBy(cause).agg(F.count(F.lit(1)).alias("n"))


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """`key`, rule: a row for each rule that a row breaks; a rule that is null is not broken."""
    broken = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return rows.select(key, F.explode(broken).alias("rule"))


def duplicates(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`columns`, n of those that more than one row has; null is a value like any other."""
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def top_tags(documents: DataFrame, key: str, markup: str, most: int = 12) -> DataFrame:
    """`key`, tag, n, place: the commonest opening tags, of equally common ones the first by name."""
    tags = F.explode(F.regexp_extract_all(F.lower(markup), F.lit(r"<([a-z][a-z0-9]*)"), F.lit(1)))
    n = documents.select(key, tags.alias("tag")).groupBy(key, "tag").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "tag"))).filter(F.col("place") <= most)


def span_verdict(declared: Column, can: Column, saw: Column, had_occasion: Column) -> Column:
    """Whether what an extractor says about merged cells fits what it gave. `can`: its format can express them."""
    return (
        F.when(declared & ~can, "CONTRADICCION").when(~declared & saw, "ESCONDIDO").when(~declared & can & ~had_occasion, "SIN_EVIDENCIA").otherwise("COHERENTE")
    )


def conforms(findings: DataFrame, candidate: str, severity: str, candidates: DataFrame) -> DataFrame:
    """`candidate`, passes: no finding worse than AVISO; a check that was not run weighs as a failure, no findings at all pass."""
    worst = findings.groupBy(candidate).agg(F.bool_and(F.col(severity) == "AVISO").alias("_ok"))
    return candidates.select(candidate).distinct().join(worst, candidate, "left").select(candidate, F.coalesce("_ok", F.lit(True)).alias("passes"))


def egress_offenders(extractors: DataFrame, forbids_third_parties: bool) -> DataFrame:
    """The extractors that may not run: those that are not local, if the source lets its documents go nowhere."""
    return extractors.filter(~F.col("runs_locally")) if forbids_third_parties else extractors.limit(0)


def refuse_egress(extractors: DataFrame, forbids_third_parties: bool) -> None:
    offenders = [r["extractor_id"] for r in egress_offenders(extractors, forbids_third_parties).orderBy("extractor_id").limit(20).collect()]
    if offenders:
        raise PermissionError(f"documents may not leave: {', '.join(offenders)}")


def inherited(found: DataFrame, manifest: DataFrame, on_disk: DataFrame, key: str) -> DataFrame:
    """`key`, state: `heredado` if the manifest has the document and its bytes are there, else `pedir`."""
    j = found.select(key).join(manifest.select(key, F.lit(True).alias("_m")).distinct(), key, "left").join(on_disk.select(key, F.lit(True).alias("_d")).distinct(), key, "left")
    return j.select(key, F.when(F.col("_m") & F.col("_d"), "heredado").otherwise("pedir").alias("state"))


# ---- answers about tables


def answer_correct(verifier: Column, given: Column, right: Column, tolerance: Column) -> Column:
    """Whether an answer is right, by its verifier: exact, numeric, set, date, boolean or span; null for another verifier."""
    words = lambda c: F.array_sort(F.array_distinct(F.transform(F.split(F.lower(F.trim(c)), r"\s*[;,]\s*"), lambda x: F.trim(x))))
    truth = lambda c: F.when(F.lower(F.trim(c)).isin("true", "sí", "si", "1"), True).when(F.lower(F.trim(c)).isin("false", "no", "0"), False)
    a, b = given.try_cast("double"), right.try_cast("double")
    return F.coalesce(
        F.when(verifier == "exact", F.trim(given) == F.trim(right)).when(verifier == "numeric", F.abs(a - b) <= F.coalesce(tolerance, F.lit(0.0)))
        .when(verifier == "set", words(given) == words(right)).when(verifier == "date", given.try_cast("date") == right.try_cast("date"))
        .when(verifier == "boolean", truth(given) == truth(right)).when(verifier == "span", F.contains(F.lower(given), F.lower(F.trim(right)))),
        F.when(verifier.isin("exact", "numeric", "set", "date", "boolean", "span"), F.lit(False)),
    )


def mcnemar_sample_size(discordant: float, difference: float, alpha_z: float = 1.959964, power_z: float = 0.841621) -> int:
    """Pairs needed to see a difference between two extractors, of whose answers a share disagrees."""
    if not 0 < difference <= discordant <= 1:
        raise ValueError("0 < difference <= discordant <= 1")
    n = (alpha_z * discordant**0.5 + power_z * (discordant - difference**2) ** 0.5) ** 2 / difference**2
    return int(n) + (n > int(n))


def vocabulary_drift(before: DataFrame, after: DataFrame, token: str) -> DataFrame:
    """token, n of the tokens that only `after` has."""
    return after.groupBy(token).agg(F.count(F.lit(1)).alias("n")).join(before.select(token).distinct(), token, "left_anti")
