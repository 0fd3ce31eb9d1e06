import random

import numpy as np

from cotejo.llm import reading as R

EASY = ["El gato come pan.", "La casa es verde.", "Venga con tiempo.", "¿Puedo ir hoy?", "El sol sale a las ocho.", "Mire el mapa."]
HARD = ["Habida cuenta de la impugnación subordinada de los presupuestos parlamentarios, procederá la individualización.", "La interoperabilidad sinalagmática condiciona la retroactividad indemnizatoria de los aprovechamientos.", "Sin menoscabo de la parametrización, devendrá inaplicable la subsidiariedad."]


def make(n, seed):
    rng, texts, marks = random.Random(seed), [], []
    for i in range(n):
        hard = i % 2
        texts.append("Orden 12\n" + " ".join(rng.choice(HARD if rng.random() < (0.9 if hard else 0.05) else EASY) for _ in range(8)) + "\n| a | 1 | 2 |")
        marks.append([0, 0, 0, 1, 1] if hard else [1, 1, 0, 0, 0])
    return texts, marks


def test_held_out(spark):
    model = R.fit(*make(80, 1))
    texts, marks = make(60, 2)
    p = R.Scorer(model).score([*texts, None, "", "| a | b |"])
    assert np.isnan(p[-3:]).all()
    assert ((p[:60, 2] >= 0.5) == np.array([m[4] > 0 for m in marks])).mean() > 0.95


def test_sentences():
    wrapped = "La Junta aprueba el gasto de la ampliación y lo\npublica en la sede. El Rectorado de la plaza corrige\nel anuncio."
    assert len(R.sentences(wrapped)) == 2
    assert R.sentences("Edicto de Valle\nEl sol sale\nLa casa es verde\nVenga") == ["El sol sale", "La casa es verde", "Venga"]
    assert R.sentences("Hola a todos. <table><tr><td>9</td></tr></table>\nRef. 12/3, pág. 4\n| a | b |\n1\t2\nAdi&oacute;s.") == ["Hola a todos.", "Adiós."]
    assert len(R.sentences("Ya que el Rectorado saca a concurso el alquiler;\n  - mientras que la Mesa calla;\n  - la Junta habla. Venga.")) == 2
    # A line with a number in it is prose, one that is made of numbers is not; a quoted sentence is prose, a quoted piece is not.
    assert R.sentences("Vamos ya.\nSee page 3 of it.\n«Venga hoy.»\n«de la casa que,»\nAnexo 12/3, 4, 5b") == ["Vamos ya.", "See page 3 of it.", "«Venga hoy.»"]
    assert R.sentences(None) == R.sentences("") == []


def test_columns(spark):
    texts, marks = make(30, 3)
    docs = spark.createDataFrame([*enumerate(texts), (98, None), (99, "")], "doc_id bigint, text string").repartition(3)
    read = [(i, f"r{m}", m + 1) for i, ms in enumerate(marks) for m, n in enumerate(ms) if n]
    lect = spark.createDataFrame([*read, *read[:5], (1, "x", None), (2, "x", 77), (500, "x", 1)], "doc_id bigint, lector string, nivel int")
    t, m = R.labelled(docs, lect, "doc_id", "text", "nivel")
    assert len(t) == 30 and sorted(map(tuple, m)) == sorted(map(tuple, marks))
    got = {r.doc_id: r for r in R.levels(docs, "doc_id", "text", R.fit(t, m)).collect()}
    assert len(got) == 32 and got[98].level is None and got[99].hard is None and got[1].level >= 4 and got[0].level <= 2
    none = R.fit([], [])
    assert len(R.levels(docs, "doc_id", "text", none).collect()) == 32
    assert R.levels(docs.limit(0), "doc_id", "text", none).collect() == []
