import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from cotejo.operators import corpus as C
from cotejo.sources import journal as J
from cotejo.sources import cut, work_dir
from cotejo.streaming import journal as W

S = "extractor_id string, doc_ref struct<external_id:string>, failed boolean, failure_reason string"


def line(e, d, reason=None, failed=None):
    return json.dumps({"extractor_id": e, "doc_ref": {"external_id": d}, "failed": reason is not None if failed is None else failed, "failure_reason": reason})


def test_read(spark, tmp_path):
    lines = [line("a", "1"), line("a", "1"), line("b", "1", "timeout"), line("b", "2", "made up"), line("b", "3", failed=True), line("b", "4", "timeout", False), '{"extractor_id": "a", "doc_']
    (tmp_path / "j.jsonl").write_text("\n".join(lines))
    j = J.read_journal(spark, str(tmp_path / "j.jsonl"), S)
    assert tuple(J.line_counts(j).first()) == (7, 1, 6)
    assert sorted(tuple(r) for r in J.done(j).collect()) == [("a", "1"), ("b", "1"), ("b", "2"), ("b", "3"), ("b", "4")]
    assert [tuple(r) for r in J.repeated(J.readable(j), F.col("extractor_id"), F.col("doc_ref.external_id")).collect()] == [("a", "1", 2)]
    assert sorted(r.why for r in J.contradictions(J.readable(j)).collect()) == ["a reason without failing", "failed without a reason", "unknown reason"]


def test_manifest_bytes_order(spark, tmp_path):
    docs = [{"external_id": "x", "sha256": "0" * 64, "strata": ["b", "a", "b"]}, {"external_id": "y", "n_pages": 3}]
    (tmp_path / "m.json").write_text(json.dumps({"entidad": "e", "documentos": docs}, indent=1))
    m = J.read_manifest(spark, str(tmp_path / "m.json"))
    assert [(r.external_id, r.strata, r.n_pages) for r in m.orderBy("pos").collect()] == [("x", ["a", "b"], None), ("y", [], 3)]
    assert [r.external_id for r in J.ordered(m, ["y", "x", "y"], "external_id", "pos").collect()] == ["y", "x", "y"]
    files = spark.createDataFrame([("x", b"abc")], "external_id string, content binary")
    assert {r.external_id: r.state for r in J.with_bytes(m, files, "external_id", "sha256").collect()} == {"x": "altered", "y": "missing"}


def test_seal_and_days(spark, tmp_path):
    p = str(tmp_path / "run" / "seal.json")
    assert J.seal(p, {"plan": b"1"}) == J.seal(p, {"plan": b"1"})
    with pytest.raises(ValueError):
        J.seal(p, {"plan": b"2"})
    assert J.days(spark, dt.date(2031, 2, 27), dt.date(2031, 3, 1)).count() == 3 and J.days(spark, dt.date(2031, 2, 2), dt.date(2031, 2, 1)).count() == 0


def test_summary(spark):
    one = '{"identificador":"A-1","titulo":"t","url_pdf":"p","url_xml":"x","paginas":"3"}'
    text = '{"dia":"2031-01-02","secciones":[{"codigo":"1","departamentos":[{"nombre":"D","items":%s},{"nombre":"E","epigrafes":[{"nombre":"h","items":[%s,%s]}]}]}]}' % (one, one.replace("A-1", "A-2"), one.replace("A-1", "S-3"))
    items = J.summary_items(spark.createDataFrame([(text,)], "j string"), "j")
    assert sorted((r.identificador, r.epigrafe, r.departamento) for r in items.collect()) == [("A-1", None, "D"), ("A-2", "h", "E"), ("S-3", "h", "E")]
    assert J.discovered(items, ["1"], "S-").count() == 2
    assert spark.createDataFrame([(text,)], "j string").select(J.urls(F.col("j"))).first()[0] == ["p", "x"] * 3


def test_stream_appends_once(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    (src / "1.jsonl").write_text("\n".join([line("a", "1"), line("a", "1"), "{torn"]))

    def go():
        stream = J.readable(W.watch_journal(spark, str(src), S)).select("extractor_id", F.col("doc_ref.external_id").alias("doc"), "failed", "failure_reason")
        q = W.append_new(stream, ["extractor_id", "doc"], out, ck)
        q.awaitTermination()
        return sorted((r.extractor_id, r.doc) for r in spark.read.parquet(out).collect())

    assert go() == [("a", "1")]
    (src / "2.jsonl").write_text("\n".join([line("a", "1"), line("b", "7")]))
    assert go() == [("a", "1"), ("b", "7")] and go() == [("a", "1"), ("b", "7")]


def test_stream_stop_rule_and_windows(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.jsonl").write_text("\n".join([line("a", str(i), "timeout" if i < 3 else None) for i in range(30)]))
    stream = W.watch_journal(spark, str(src), S)
    assert W.stop_when(stream, F.col("failed"), "doc_ref.external_id", str(tmp_path / "ck")) == (20, 3, True)
    e = spark.sql("SELECT timestamp '2031-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 20) AS t, 'k' AS kind FROM range(7)")
    assert sorted(r.n for r in W.windowed_counts(e, "t", "kind").collect()) == [1, 3, 3]


def test_stop_rule_goes_on_after_a_restart(spark, tmp_path):
    src, ck = tmp_path / "in", str(tmp_path / "ck")
    src.mkdir()
    stream = W.watch_journal(spark, str(src), S, files_at_once=1)
    go = lambda: W.stop_when(stream, F.col("failed"), "doc_ref.external_id", ck)
    (src / "1.jsonl").write_text("\n".join([line("a", f"a{i:02}", "timeout" if i == 3 else None) for i in range(15)]))
    assert go() == (15, 1, False) and go() == (15, 1, False)
    (src / "2.jsonl").write_text("\n".join([line("a", f"b{i:02}", "timeout" if i == 7 else None) for i in range(15)]))
    assert go() == (23, 2, True)  # 1 of 20 is not over 5 %, 2 of 23 is; the seven after it don't count
    (src / "3.jsonl").write_text("\n".join([line("a", f"c{i:02}", "timeout") for i in range(9)]))
    assert go() == (23, 2, True)


def test_new_checkpoint_on_an_old_target(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()

    def go(ck):
        stream = W.watch_journal(spark, str(src), S).filter("_broken IS NULL").select("extractor_id", F.col("doc_ref.external_id").alias("doc"), "failed")
        W.append_new(stream, ["extractor_id", "doc"], out, str(tmp_path / ck)).awaitTermination()
        return sorted(((r.extractor_id, r.doc) for r in spark.read.parquet(out).collect()), key=str)

    (src / "1.jsonl").write_text("\n".join([line("a", "1"), line("a", "1"), line(None, "1")]))
    assert go("ck1") == [("a", "1"), (None, "1")]
    (src / "2.jsonl").write_text("\n".join([line("a", "1"), line("b", "7"), line(None, "1")]))
    assert go("ck2") == [("a", "1"), ("b", "7"), (None, "1")] and go("ck1") == go("ck2")


def test_corpus_checks(spark):
    p = spark.createDataFrame([(1, ["a", "a", "b"], ["a", "c"]), (2, [], ["a"]), (3, None, None)], "k int, l array<string>, r array<string>")
    assert {r.k: (r.shared, r.tokens, r.share) for r in C.containment(p, "k", F.col("l"), F.col("r")).collect()} == {1: (1, 3, pytest.approx(1 / 3)), 2: (0, 0, None)}
    v = spark.createDataFrame([(None, "p", 0, 1, None), ("x", None, 1, 0, None), ("", "p", 0, 1, 0.0), ("x", "", 1, 0, 0.0), ("x", "p", 1, 1, 0.5), ("x", "p", 1, 1, 0.9)], "x string, p string, nx int, np int, s double")
    got = v.select(C.verdict(F.col("x"), F.col("p"), F.col("nx"), F.col("np"), F.col("s"), 0.85).alias("c")).collect()
    assert [r.c for r in got] == [*C.CAUSES, None]
    s = spark.createDataFrame([(True, False, False, False), (False, True, True, True), (False, True, False, False), (False, True, False, True), (True, True, True, False)], "d boolean, can boolean, saw boolean, had boolean")
    assert [r[0] for r in s.select(C.span_verdict(F.col("d"), F.col("can"), F.col("saw"), F.col("had"))).collect()] == ["CONTRADICCION", "ESCONDIDO", "SIN_EVIDENCIA", "COHERENTE", "COHERENTE"]
    f = spark.createDataFrame([("a", "AVISO"), ("b", "AVISO"), ("b", "NO_EJECUTADA")], "c string, s string")
    assert {r.c: r.passes for r in C.conforms(f, "c", "s", spark.createDataFrame([("a",), ("b",), ("z",)], "c string")).collect()} == {"a": True, "b": False, "z": True}
    e = spark.createDataFrame([("a", True), ("b", False)], "extractor_id string, runs_locally boolean")
    C.refuse_egress(e, False)
    with pytest.raises(PermissionError, match="b"):
        C.refuse_egress(e, True)
    a = spark.createDataFrame([("numeric", "1.5", "1", 0.5), ("set", "b; A", "a,b", None), ("date", "2031-01-02", "2031-01-02", None), ("boolean", "Sí", "true", None), ("span", "the Answer is", "answer", None), ("exact", "x", "y", None), ("other", "x", "x", None), ("numeric", "uno", "1", 0.5)], "v string, g string, r string, t double")
    assert [r[0] for r in a.select(C.answer_correct(F.col("v"), F.col("g"), F.col("r"), F.col("t"))).collect()] == [True, True, True, True, True, False, None, False]
    assert 600 < C.mcnemar_sample_size(0.2, 0.05) < 650


def test_work_dir_and_cut(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    again = cut(df)
    assert [tuple(r) for r in again.collect()] == [(1, None)] and again.schema.simpleString() == df.schema.simpleString()
    assert work_dir(spark) == work_dir(spark) and work_dir(spark).removeprefix("file://") in again.inputFiles()[0]


def test_summary_collapsed_at_every_level(spark):
    item = {"identificador": "A-1", "titulo": "t {x}", "url_pdf": "https://a.example/á?b=\"c\"", "extra": {"k": {"n": 1}}}
    day = {"dia": "2031-01-02", "secciones": {"codigo": "1", "departamentos": {"nombre": "D", "epigrafes": {"nombre": "E", "items": item}}}}
    df = spark.createDataFrame([(json.dumps(day),), ("{torn",), (None,), ("{}",)], "j string")
    assert [(r.identificador, r.seccion, r.departamento, r.epigrafe) for r in J.summary_items(df, "j").collect()] == [("A-1", "1", "D", "E")]
    assert [r[0] for r in df.select(J.urls(F.col("j"))).collect()] == [['https://a.example/á?b="c"'], [], [], []]
    assert J.summary_items(df.limit(0), "j").collect() == []
