import json

import pytest

from cotejo.operators import manifest as M

SHA = "a" * 64
DOC = {"external_id": "x", "fecha_sumario": "2031-01-01", "seccion": "1", "url_pdf": "https://b.example/p", "url_xml": "https://s.b.example/x", "sha256": SHA, "cosechado_en": "2031-01-02"}
GOOD = {
    "esquema": "m/1", "entidad": "e", "plan_hash": "h", "ventana": {"desde": "2031-01-01", "hasta": "2031-01-31"}, "licencia_corpus": {"name": "CC BY"}, "atribucion": "B", "licencia_codigo": "MIT",
    "emparejado": {"umbral_coherencia": 0.85, "intentados": 3, "aceptados": 1, "descartados": 2, "tasa_descarte": 2 / 3, "por_causa": {"sin_xml": 2}}, "ritmo": {"espaciado_mediano_s": 1.0}, "documentos": [DOC],
}
PLAN = {"ventana": GOOD["ventana"], "objetivo_emparejados": 1, "filtro_secciones": ["1"], "ritmo_minimo_s": 1.0}


def written(spark, tmp_path, manifest):
    (tmp_path / "m.json").write_text(json.dumps(manifest, indent=1))
    return M.read_manifests(spark, str(tmp_path / "m.json"))


def but(**changes):
    return json.loads(json.dumps(GOOD)) | {k: (json.loads(json.dumps(GOOD[k])) | v if isinstance(v, dict) else v) for k, v in changes.items()}


def rules(df):
    return sorted(r.rule for r in df.collect())


@pytest.mark.parametrize(("changes", "broken"), [
    ({}, []), ({"esquema": "m/2"}, ["schema"]), ({"emparejado": {"intentados": 4}}, ["balance", "rate"]), ({"emparejado": {"intentados": None}}, ["counts"]),
    ({"emparejado": {"tasa_descarte": 0.1}}, ["rate"]), ({"emparejado": {"por_causa": {}}}, ["causes"]), ({"emparejado": {"umbral_coherencia": None}}, ["threshold"]), ({"ventana": {"hasta": ""}}, ["window"]),
    ({"documentos": []}, ["documents"]), ({"atribucion": " ", "licencia_corpus": None, "licencia_codigo": None}, ["attribution", "code licence", "licence"]),
])
def test_shape(spark, tmp_path, changes, broken):
    assert rules(M.shape_problems(written(spark, tmp_path, but(**changes)), "_file", "m/1")) == broken


def test_documents(spark, tmp_path):
    docs = [DOC, DOC | {"seccion": " ", "url_xml": "https://b.example.evil/x"}, DOC | {"sha256": "A" * 64, "cosechado_en": None}, DOC | {"sha256": None, "url_pdf": None}]
    found = M.document_problems(M.documents_of(written(spark, tmp_path, but(documentos=docs)), "_file"), ["_file", "pos"], "b.example")
    assert sorted((r.pos, r.rule) for r in found.collect()) == [(1, "foreign url_xml"), (1, "no seccion"), (1, "same digest"), (2, "digest"), (2, "no cosechado_en"), (3, "digest"), (3, "no url_pdf")]


@pytest.mark.parametrize(("manifest", "plan", "broken"), [
    ({}, {}, []), ({"plan_hash": None}, {}, ["no plan"]), ({"plan_hash": "g"}, {}, ["other plan"]), ({}, {"ventana": {"desde": "2031-01-02", "hasta": None}}, ["from", "to"]), ({}, {"objetivo_emparejados": 2}, ["target"]),
    ({}, {"filtro_secciones": ["2"]}, ["sections"]), ({}, {"filtro_secciones": []}, []), ({"ritmo": None}, {}, ["pace not measured"]), ({}, {"ritmo_minimo_s": 1.5}, ["pace"]), ({"ritmo": None}, {"ritmo_minimo_s": None}, []), ({"documentos": None}, {}, []),
])
def test_plan(spark, tmp_path, manifest, plan, broken):
    m = written(spark, tmp_path, but(**manifest)).withColumnRenamed("_file", "k")
    p = M.parsed(spark.createDataFrame([(m.first().k, "h", json.dumps(PLAN | plan))], "k string, digest string, p string"), "p", M.PLAN)
    assert rules(M.plan_problems(m, p, "k")) == broken


def test_companions_from_files(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes(b"hola")
    (tmp_path / "c.xml").write_bytes(b"")
    (tmp_path / "z.pdf").write_bytes(b"x")
    docs = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "external_id string")
    got = {r.external_id: (r.state, r.bytes) for r in M.companion_seals(docs, M.binary_files(spark, str(tmp_path), ".xml"), "external_id", "document").collect()}
    assert got == {"a": ("sealed", 4), "b": ("missing", None), "c": ("missing", None), None: ("missing", None)}


def test_stable_text(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(M.sorted_json({"b": F.lit(1), "a": F.lit("x")})).first()[0] == '{"a":"x","b":1}'
