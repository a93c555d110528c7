import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import heldout as H  # noqa: E402
import pytest

from almudi.llm import abuse as A

DOC = "doc_id long, text string, source string, category string, score double"
CLEAN = ["La bolsa es una basura, se rompió al primer uso.", "Pésimo producto, inútil para lo que dice la etiqueta.", "El taladro de la promo venía con la broca desnuda, sin estuche.", "El frijol negro y el azúcar morena subieron otra vez.", "Condones lubricados, caja de tres, en el pasillo de farmacia.", "Un comentario con insultos fue borrado.", "Código interno C2D11C, 4x140g y 375Gr.", "Maten el hambre con este combo.", "Peso bruto por caja: 24 kg."]
CASES = {
    "El cajero es un 1mb3c1l.": "abusive", "Callate, i-d-i-o-t-a, nadie te preguntó.": "abusive", "Sos un p*ndejo y ya.": "abusive", "Ojalá te mueras, perraaaa.": "abusive", "Shut up, you m0r0n.": "abusive",
    "Agente h i j o d e p u t a, no servís ni para limpiar el piso.": "abusive", "Esos m4r1c0n35 son una plaga, hay que echarlos a todos.": "hateful", "Todos los n.e.g.r.o.s son ladrones de nacimiento.": "hateful",
    "Те quiero ver dеsnudа encima de la mesa.": "sexual", "Ofrezco masajes con final feliz y s​exo oral.": "sexual",
}


@pytest.fixture(scope="module")
def restorer():
    return A.Restorer(A.CharModel({}))


def test_decoding(restorer):
    shown = {"m4r1c0n35": "maricones", "p3rr4": "perra", "imb*cil": "imbecil", "n-e-g-r-o-s": "negros", "biiitch": "bitch", "35túp1d0": "estupido", "g#ys": "gays", "h i j o d e p u t a": "hijodeputa", "375gr": "375gr", "4x140g": "4x140g", "perra": "perra", "": ""}
    assert {k: restorer.restore(A.normal(k)) for k in shown} == shown


def test_letters_without_blanks_become_words():
    assert A.unjoined("mierdadepersona") == "mierda de persona" and A.unjoined("dumbbitch") == "dumb bitch" and A.unjoined("mantequilla") is None


def _corpus_model():
    """The model of a corpus of ordinary words, counted like ``letter_counts``."""
    counts = {}
    for word in " ".join(H.CLEAN).lower().split():
        w = f"^{A.normal(word).strip('.,:;')}$"
        for k in range(1, A.ORDER + 1):
            for i in range(len(w) - k + 1):
                counts[w[i : i + k]] = counts.get(w[i : i + k], 0) + 3
    return A.CharModel(counts)


def _recall(scorer, lists):
    at = {c: [scorer.text(t)[k] >= A.THRESHOLD for t in lists[c]] for k, c in enumerate(A.CATEGORIES)}
    clean = [max(scorer.text(t)) >= A.THRESHOLD for t in lists["clean"]]
    return {c: sum(x) / len(x) for c, x in at.items()}, sum(clean) / len(clean)


def test_held_out_sentences():
    scorer = A.Scorer(A.Restorer(_corpus_model()))
    recall, false = _recall(scorer, {"abusive": H.ABUSIVE, "hateful": H.HATEFUL, "sexual": H.SEXUAL, "clean": H.CLEAN})
    assert min(recall.values()) >= 0.95 and false <= 0.05, (recall, false)

def test_categories(spark):
    texts = [*CASES, *CLEAN, None, "", "   "]
    rows = [(i, t, "X " if i % 2 else None, "c", 0.0) for i, t in enumerate(texts)] + [(900, "relleno sin más. " * 20_000 + list(CASES)[0], "x", "c", 0.0)]
    docs = spark.createDataFrame(rows, DOC)
    scored = A.scores(docs)
    found = {}
    for r in A.found(scored).collect():
        found.setdefault(r.doc_id, set()).add(r.category)
    want = {i: {c} for i, c in enumerate(CASES.values())} | {900: {"abusive"}}
    assert found == want
    assert scored.count() == len(rows)
    rates = {r.source: r for r in A.rates(scored).collect()}
    assert rates["x"].documents + rates[""].documents == len(rows)


def test_empty(spark):
    s = A.scores(spark.createDataFrame([], DOC))
    assert s.count() == 0 and A.found(s).count() == 0 and A.rates(s).count() == 0


def test_language_model_counts_every_word(spark):
    docs = spark.createDataFrame([(1, "pan o " + "z" * 30, "a", "c", 0.0), (2, "pan", "a", "c", 0.0)], DOC)
    got = {r.gram: r.n for r in A.letter_counts(docs).collect()}
    assert got["zzzz"] == 27 and got["^o$"] == 1 and got["^pan"] == 2


def test_language_model_counts_are_letter_ngrams(spark):
    docs = spark.createDataFrame([(1, "pan pan sol", "a", "c", 0.0), (2, "PAN sol", "a", "c", 0.0), (3, None, "a", "c", 0.0)], DOC)
    got = {r.gram: r.n for r in A.letter_counts(docs).collect()}
    assert set(got) == {"^", "$", "p", "a", "n", "s", "o", "l", "^p", "pa", "an", "n$", "^s", "so", "ol", "l$", "^pa", "pan", "an$", "^so", "sol", "ol$", "^pan", "pan$", "^sol", "sol$"}
