import datetime as dt
import itertools

from cotejo.plans import corpus


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def test_levenshtein_of_every_pair(spark, tmp_path):
    texts = ["", "a", "año", "an\u0303o", "ＡÑＯ", "аbс", "abc", "😀b", "niño 3 €", "line\nend", None]
    pairs = list(enumerate(itertools.product(texts, texts)))
    spark.createDataFrame([(i, a, b) for i, (a, b) in pairs + pairs[:3]], "correccion_id bigint, puse string, el_pdf_dice string").write.parquet(f"{tmp_path}/correcciones.parquet")
    got = sorted((r.correccion_id, r.distancia, r.relativa) for r in corpus.levenshtein_code_points(spark, str(tmp_path)).collect())
    want = [(i, None, None) if a is None or b is None else (i, d := distance(a, b), round(d / max(len(a), len(b), 1), 6)) for i, (a, b) in pairs]
    assert got == want


def test_whole_order(spark, tmp_path):
    docs = [(i, f"d{i % 70}", None if i % 3 == 0 else i) for i in range(80)]
    spark.createDataFrame(docs[::-1], "doc_id bigint, external_id string, n_chars bigint").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    asked = [(f"d{(i * 37) % 75}", dt.datetime(2031, 1, 1, i // 2 % 24, i // 48)) for i in range(90)]
    spark.createDataFrame(asked + asked[:5], "id string, elegido_en timestamp").repartition(3).write.parquet(f"{tmp_path}/elegidos.parquet")
    assert [tuple(r) for r in corpus.documents_in_order(spark, str(tmp_path)).collect()] == docs
    want = [d for e, _ in sorted(set(asked), key=lambda a: (a[1], a[0])) for d in docs if d[1] == e]
    got = [(r.doc_id, r.external_id, r.n_chars) for r in corpus.requested_documents(spark, str(tmp_path)).collect()]
    assert len(want) > 80 and got == want
