"""Running extractors as plugins over the bytes of documents.

An extractor is an object with `id`, `version`, `expresses_spans`, `runs_locally` and `read(content) -> (tables, pages)`, tables as of
functions.layout. It may raise whatever it likes: a failure is a row with its cause, never a failed task.
"""

from __future__ import annotations

import time
from collections.abc import Mapping
from importlib.metadata import entry_points
from typing import Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.functions.layout import READERS, TABLE_TYPE
from cotejo.sources.journal import FAILURES

MEMBERS = ("id", "version", "expresses_spans", "runs_locally", "read")
# Names of exception classes that say why an extraction failed.
CAUSES = {
    "timeout": ("TimeoutError", "TimeoutExpired", "Timeout"), "out_of_memory": ("MemoryError", "OutOfMemoryError"),
    "unsupported_format": ("UnsupportedFormat", "NotImplementedError"), "corrupt_pdf": ("PDFSyntaxError", "PSSyntaxError", "PSEOF", "PdfReadError", "FileDataError", "UnicodeDecodeError"),
    "encrypted_pdf": ("PDFPasswordIncorrect", "PDFEncryptionError", "FileNotDecryptedError"), "no_text_layer": ("NoTextLayer", "PDFTextExtractionNotAllowed"), "policy_blocked": ("PermissionError",),
}
ROW = f"extractor string, doc string, tables array<{TABLE_TYPE}>, pages int, latency_ms bigint, failed boolean, failure_reason string"


@runtime_checkable
class Extractor(Protocol):
    id: str
    version: str
    expresses_spans: bool
    runs_locally: bool

    def read(self, content: bytes) -> tuple[list[dict], int]: ...


def cause_of(error: BaseException, depth: int = 6) -> str:
    """Why an extraction failed: by the class of the error or one it derives from, else of the errors behind it, the nearest first, else provider_error.

    Behind an error are those it was raised from, was raised while handling, and carries among its arguments. At most `depth` errors are looked at, each once.
    """
    by_name = {name: cause for cause, names in CAUSES.items() for name in names}
    known, ring = {}, [error]
    while ring:
        behind = []
        for e in ring:
            if id(e) in known or len(known) == depth:
                continue
            known[id(e)] = e
            if (named := next((by_name[k.__name__] for k in type(e).__mro__ if k.__name__ in by_name), None)) is not None:
                return named
            behind += [x for x in (e.__cause__, e.__context__, *e.args) if isinstance(x, BaseException)]
        ring = behind if len(known) < depth else []
    return "provider_error"


def missing_members(plugin: object) -> list[str]:
    """Every member that a would-be extractor lacks."""
    return [m for m in MEMBERS if not hasattr(plugin, m)]


def registered(group: str) -> dict[str, object]:
    """The plugins installed under an entry-point group. One that lacks a member is an error that names all it lacks."""
    out = {}
    for point in entry_points(group=group):
        plugin = point.load()()
        if lack := missing_members(plugin):
            raise TypeError(f"{point.name} lacks {', '.join(lack)}")
        out[plugin.id] = plugin
    return out


class Markup:
    """An extractor for documents that are text already."""

    runs_locally, version = True, "1"

    def __init__(self, source_format: str):
        self.id, self.source_format = f"markup-{source_format}", source_format
        self.expresses_spans = source_format in ("html", "tei")

    def read(self, content: bytes) -> tuple[list[dict], int]:
        return READERS[self.source_format](content.decode()), 1


def page_range_valid(first: Column, after: Column) -> Column:
    """Pages are counted from 1, and the range ends before `after`."""
    return (first >= 1) & (after > first)


def extract(units: DataFrame, files: DataFrame, plugins: Mapping[str, Extractor], tasks: int | None = None) -> DataFrame:
    """The columns of ROW for each unit (extractor, doc) whose document's bytes are in files (doc, content).

    A document's bytes are moved once, to all its extractors; units of no plugin and documents without bytes fail as data.
    """
    todo = units.select("extractor", F.col("doc").cast("string").alias("doc")).distinct().groupBy("doc").agg(F.sort_array(F.collect_list("extractor")).alias("_todo"))
    loaded = todo.join(files.select(F.col("doc").cast("string").alias("doc"), "content"), "doc", "left")
    if tasks:
        loaded = loaded.repartition(tasks, "doc")

    def run(parts):
        for pdf in parts:
            out = []
            for doc, names, content in zip(pdf["doc"], pdf["_todo"], pdf["content"], strict=True):
                for name in names:
                    began, tables, pages, why = time.perf_counter(), [], 0, None
                    try:
                        if content is None:
                            raise FileNotFoundError(doc)
                        tables, pages = plugins[name].read(bytes(content))
                    except Exception as e:  # noqa: BLE001
                        why = cause_of(e)
                    out.append((name, doc, tables, pages, int(1000 * (time.perf_counter() - began)), why is not None, why))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ("extractor", "doc", "tables", "pages", "latency_ms", "failed", "failure_reason")])

    return loaded.mapInPandas(run, ROW)


def conformance(extractions: DataFrame) -> DataFrame:
    """extractor, check, severity, detail: what a candidate's extractions show. No row: nothing to say against it."""
    one = lambda check, severity, when, detail: F.when(when, F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), detail.alias("detail")))
    found = F.array_compact(F.array(
        one("failure with a known reason", "FALLA", F.col("failed") & (F.col("failure_reason").isNull() | ~F.col("failure_reason").isin(*FAILURES)), F.col("doc")),
        one("no tables with a failure", "FALLA", F.col("failed") & (F.size("tables") > 0), F.col("doc")),
        one("spans as declared", "FALLA", F.exists("tables", lambda t: ~t["expresses_spans"] & F.exists(t["cells"], lambda c: (c["rowspan"] > 1) | (c["colspan"] > 1))), F.col("doc")),
        one("slow", "AVISO", F.col("latency_ms") > 60_000, F.col("doc")),
    ))
    return extractions.select("extractor", F.explode(found).alias("_f")).select("extractor", "_f.*")


def conformance_set(declared: DataFrame, truth: DataFrame) -> DataFrame:
    """doc, declared, found of the documents of a conformance set whose declared class is not the one their truth has (both: doc, kind). A set to be used has no such row."""
    return declared.select("doc", F.col("kind").alias("declared")).join(truth.select("doc", F.col("kind").alias("found")), "doc", "left").filter(~F.col("declared").eqNullSafe(F.col("found")))
