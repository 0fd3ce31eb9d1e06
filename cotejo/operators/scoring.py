"""How well each extractor finds the tables of a set of documents, and their cells.

Tables are named by doc and table_idx, predictions also by extractor. Predicted and true tables of a
document are paired by order, and only where there are as many; a document with unequal counts isn't scored, which is null and never 0.
Scores are averaged over a document's tables first and over documents then.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cotejo.functions.teds import alike_score, teds_arrays, teds_column

SIGNATURE = ["row", "col", "rowspan", "colspan", "text"]
TABLE = ["extractor", "doc", "table_idx"]


def counts(gold_tables: DataFrame, pred_tables: DataFrame, panel: Sequence[str]) -> DataFrame:
    """extractor, doc, n_gold, n_pred, same: a row per extractor of the panel and document with true tables, predicted or not."""
    gold = gold_tables.groupBy("doc").agg(F.count(F.lit(1)).alias("n_gold"))
    gold = gold.select("*", F.explode(F.array(*[F.lit(e) for e in panel])).alias("extractor"))
    pred = pred_tables.groupBy("extractor", "doc").agg(F.count(F.lit(1)).alias("n_pred"))
    joined = gold.join(pred, ["extractor", "doc"], "left").withColumn("n_pred", F.coalesce("n_pred", F.lit(0)))
    return joined.select("extractor", "doc", "n_gold", "n_pred", (F.col("n_gold") == F.col("n_pred")).alias("same"))


def detection(per_doc: DataFrame) -> DataFrame:
    """By extractor: documents, those with equal counts, their share, tables too many and too few (over unequal documents), true tables."""
    n, m = F.col("n_pred"), F.col("n_gold")
    return per_doc.groupBy("extractor").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if("same").alias("equal"), F.round(F.avg(F.col("same").cast("int")), 6).alias("agreement"),
        F.sum(F.greatest(n - m, F.lit(0))).alias("extra"), F.sum(F.greatest(m - n, F.lit(0))).alias("missing"), F.sum(m).alias("true_tables"),
    )


def cell_scores(gold_cells: DataFrame, pred_cells: DataFrame, scored: DataFrame, panel: Sequence[str]) -> DataFrame:
    """extractor, doc, table_idx, hits, n_pred, n_gold, f1, accuracy of the tables of the scored (extractor, doc), by the extractors of the panel.

    Cells match as bags on position, spans and text. f1 is null if a side is empty and 0 if both have cells and none matches. A true cell is moved once for the
    whole panel, and each cell once in all: counts stand side by side, an extractor's in a column of its own. Which documents are scored is asked of the tables, not of their cells.
    """
    number = F.coalesce(*[F.when(F.col("extractor") == e, F.lit(i)) for i, e in enumerate(panel)])
    at = ["doc", "table_idx"]
    both = gold_cells.select(*at, *SIGNATURE, F.lit(-1).alias("_e")).unionAll(pred_cells.select(*at, *SIGNATURE, number.alias("_e")).filter("_e IS NOT NULL"))
    bags = both.repartition(*at).groupBy(*at, *SIGNATURE).agg(F.count_if(F.col("_e") == -1).alias("_g"), *[F.count_if(F.col("_e") == i).alias(f"_p{i}") for i in range(len(panel))])
    found = [F.sum(f"_p{i}").alias(f"_n{i}") for i in range(len(panel))]
    sums = bags.groupBy(*at).agg(F.sum("_g").alias("n_gold"), *found, *[F.sum(F.least("_g", f"_p{i}")).alias(f"_h{i}") for i in range(len(panel))])
    each = F.array(*[F.struct(F.lit(e).alias("extractor"), F.col(f"_h{i}").alias("hits"), F.col(f"_n{i}").alias("n_pred")) for i, e in enumerate(panel)])
    s = sums.select(*at, "n_gold", F.inline(each)).filter("n_gold + n_pred > 0").join(scored.select("extractor", "doc").distinct(), ["extractor", "doc"], "left_semi")
    has_both = (F.col("n_pred") > 0) & (F.col("n_gold") > 0)
    return s.select(
        *TABLE, "hits", "n_pred", "n_gold", F.when(has_both, 2 * F.col("hits") / (F.col("n_pred") + F.col("n_gold"))).alias("f1"), F.try_divide(F.col("hits"), F.col("n_gold")).alias("accuracy")
    )


def by_document(table_scores: DataFrame, score: str) -> DataFrame:
    """extractor, doc, score: mean over the document's tables that have one; documents without any are left out."""
    return table_scores.groupBy("extractor", "doc").agg(F.avg(score).alias("score")).filter(F.col("score").isNotNull())


def evaluable(gold_spans: Column, pred_expresses: Column) -> Column:
    """A true table that spans cannot be scored against a prediction that cannot say so."""
    return ~(gold_spans & ~pred_expresses)


def evaluable_pairs(gold_tables: DataFrame, pred_tables: DataFrame, scored: DataFrame) -> DataFrame:
    """extractor, doc, table_idx, evaluable, for each pair of tables of the scored (extractor, doc). gold_tables: has_span, pred_tables: expresses_spans."""
    pairs = pred_tables.join(scored.select("extractor", "doc"), ["extractor", "doc"], "left_semi")
    return pairs.join(gold_tables.select("doc", "table_idx", "has_span"), ["doc", "table_idx"]).select(*TABLE, evaluable(F.col("has_span"), F.col("expresses_spans")).alias("evaluable"))


def paired(docs: DataFrame, gold: str, pred: str) -> DataFrame:
    """`docs` with a row per pair of tables in place of a row per document, and table_idx. gold and pred hold a document's tables by their place; they are paired
    by it where there are as many, and a document with unequal counts has no pairs."""
    rest = [c for c in docs.columns if c not in (gold, pred)]
    # A filter before would be pushed below what makes the tables, which would then be made twice.
    both = F.when(F.size(gold) == F.size(pred), F.arrays_zip(F.col(gold).alias("g"), F.col(pred).alias("p")))
    return docs.select(*rest, F.posexplode(both).alias("table_idx", "_both")).select(*rest, "table_idx", F.col("_both.g").alias(gold), F.col("_both.p").alias(pred))


def as_tables(cells: DataFrame, tables: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`keys`, and the table as one struct of n_rows and cells in reading order; also tables without cells."""
    cell = F.struct("cell_idx", "row", "col", "rowspan", "colspan", "text", "is_header")
    gathered = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    empty = F.array().cast("array<struct<cell_idx:int,row:int,col:int,rowspan:int,colspan:int,text:string,is_header:boolean>>")
    return tables.select(*keys, "n_rows").join(gathered, list(keys), "left").select(*keys, F.struct("n_rows", F.coalesce("cells", empty).alias("cells")).alias("table"))


def teds_scores(gold: DataFrame, pred: DataFrame, pairs: DataFrame) -> DataFrame:
    """extractor, doc, table_idx, teds, teds_s of the evaluable pairs. gold and pred as of as_tables.

    Equal tables score 1 without being compared. Pairs are dealt out by their own size, not by document, since cost grows with the product of the cells.
    """
    both = pairs.filter("evaluable").join(pred.withColumnRenamed("table", "p"), TABLE).join(gold.withColumnRenamed("table", "g"), ["doc", "table_idx"])
    same = both.filter(F.col("p") == F.col("g")).select(*TABLE, F.lit(1.0).alias("teds"), F.lit(1.0).alias("teds_s"))
    other = both.filter(F.col("p") != F.col("g")).withColumn("_w", F.size("p.cells") * F.size("g.cells")).repartition("_w", *TABLE)
    return same.unionAll(other.select(*TABLE, teds_column(F.col("p"), F.col("g")).alias("s")).select(*TABLE, "s.teds", "s.teds_s"))


def teds_pairs(pairs: DataFrame, gold: str, pred: str) -> DataFrame:
    """extractor, doc, table_idx, teds, teds_s of pairs that hold both tables, as structs of n_rows and cells, in their own row; null if one of them is null.

    Nothing is joined or shuffled. Tables of one shape whose texts differ by no more than 2 in all are scored by built-ins (see alike_score), only the others are compared as trees.
    """
    s = pairs.select(*TABLE, gold, pred, alike_score(F.col(gold), F.col(pred)).alias("_alike"))
    left = lambda t: F.when(F.col("_alike").isNull(), F.struct(F.col(t)["n_rows"].alias("n_rows"), F.col(t)["cells"].alias("cells")))
    s = s.select(*TABLE, "_alike", left(gold).alias("_g"), left(pred).alias("_p"))

    # Not a UDF: rows that wait for a UDF's result are kept beside it, on disk where memory is short.
    def trees(batches):
        for batch in batches:
            alike = batch.column("_alike")
            full, structure = teds_arrays(batch.column("_p"), batch.column("_g"))
            both = [pc.coalesce(alike, full), pc.if_else(alike.is_valid(), 1.0, structure)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in TABLE], *both], names=[*TABLE, "teds", "teds_s"])

    return s.mapInArrow(trees, StructType([*s.select(*TABLE).schema.fields, StructField("teds", DoubleType()), StructField("teds_s", DoubleType())]))


def report(table_scores: DataFrame, pairs: DataFrame, all_true_tables: DataFrame, score: str) -> DataFrame:
    """By extractor: score (mean of the documents' means, null if none), documents scored, coverage (evaluable pairs over ALL true tables, also those
    of documents that were not scored; all_true_tables: extractor, true_tables)."""
    docs = by_document(table_scores, score).groupBy("extractor").agg(F.round(F.avg("score"), 6).alias("score"), F.count(F.lit(1)).alias("documents"))
    cover = pairs.groupBy("extractor").agg(F.count_if("evaluable").alias("n"))
    return all_true_tables.join(cover, "extractor", "left").join(docs, "extractor", "left").select(
        "extractor", "score", F.coalesce("documents", F.lit(0)).alias("documents"), F.round(F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)), F.col("true_tables")), F.lit(0.0)), 6).alias("coverage")
    )


def page_weighted(doc_scores: DataFrame, pages: DataFrame) -> DataFrame:
    """By extractor: mean of the documents' scores weighted by pages; documents of unknown pages are left out, null if no pages."""
    return doc_scores.join(pages, "doc").groupBy("extractor").agg(F.round(F.try_divide(F.sum(F.col("score") * F.col("n_pages")), F.sum("n_pages")), 6).alias("score"), F.count(F.lit(1)).alias("documents"))


def publishable(score: Column) -> Column:
    """A score as published: no lower than 0; null stays null."""
    return F.when(score.isNotNull(), F.greatest(score, F.lit(0.0)))


# ---- several extractors on the same documents


def by_all(rows: DataFrame, panel_size: int) -> DataFrame:
    """The documents that every extractor of the panel has in `rows` (extractor, doc)."""
    return rows.select("extractor", "doc").distinct().groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == panel_size).select("doc")


def head_to_head(doc_scores: DataFrame, panel_size: int) -> DataFrame:
    """extractor, common (mean over the documents scored by all), own (mean over its own), delta, documents (common ones). No common documents: no rows."""
    shared = by_all(doc_scores, panel_size).withColumn("_in", F.lit(True))
    marked = doc_scores.join(shared, "doc", "left")
    s = marked.groupBy("extractor").agg(F.avg("score").alias("own"), F.avg(F.when(F.col("_in"), F.col("score"))).alias("common"), F.count("_in").alias("documents"))
    return s.filter("documents > 0").select("extractor", F.round("common", 6).alias("common"), F.round("own", 6).alias("own"), F.round(F.col("common") - F.col("own"), 6).alias("delta"), "documents")


# Page bands of the report, of the cost estimate and of the description of a corpus; they differ on purpose.
REPORT_BANDS = (("una página", 1, 1), ("2-10", 2, 10), ("11-50", 11, 50), (">50", 51, None))
COST_BANDS = (("<=10", 1, 10), ("11-50", 11, 50), (">50", 51, None))
CORPUS_BANDS = (("1-4", 1, 4), ("5-12", 5, 12), ("13+", 13, None))
NO_PAGES = "(sin páginas)"


def band(pages: Column, bands: Sequence[tuple], otherwise: str | None = NO_PAGES) -> Column:
    """Name of the band; `otherwise` for null and for numbers in none, or an error if that is None."""
    out = None
    for name, low, high in bands:
        inside = pages >= low if high is None else pages.between(low, high)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out.otherwise(F.lit(otherwise) if otherwise is not None else F.raise_error(F.concat(F.lit("no band for pages "), F.coalesce(pages.cast("string"), F.lit("null")))))


def agreement_by_band(per_doc: DataFrame, pages: DataFrame, panel_size: int) -> DataFrame:
    """band, agree, population: documents of whose number of tables all extractors are right. Bands without documents are left out."""
    docs = per_doc.groupBy("doc").agg((F.count_if("same") == panel_size).alias("_all"))
    named = docs.join(pages, "doc", "left").withColumn("band", band(F.col("n_pages"), REPORT_BANDS))
    return named.groupBy("band").agg(F.count_if("_all").alias("agree"), F.count(F.lit(1)).alias("population"))
