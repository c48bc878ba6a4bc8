"""Language model: the forward sum against all segmentations, and held-out accuracy."""

import itertools

import numpy as np

from trellis.llm import language as L

SENTENCES = {
    "en": ["the water board has promised to check the green folders before the meeting starts", "we would like to return the heavy boxes because the road was closed", "my colleague could not find the photographs of the bridge this morning"],
    "de": ["der zweite prüfer bestätigt leider nicht die zahlung für das heizöl", "unsere nachtschicht sucht noch immer die liste der kaputten stühle", "die werkstatt ersetzt bald die falschen filter neben der laderampe"],
    "fr": ["notre équipe de nuit a oublié de noter cette copie du contrat", "le syndicat des eaux aimerait rendre les mauvais filtres près de la porte", "la deuxième vérificatrice aurait dû compter les lourdes caisses en bois"],
    "es": ["nuestro pequeño comité todavía debe confirmar la carta anual", "la junta de aguas ha olvidado apuntar los pesados cajones de madera", "el proveedor va a medir las sillas rotas detrás del viejo molino"],
    "pt": ["o fornecedor gostaria de devolver o nosso rascunho da carta anual", "a equipa do porto continua à procura dos filtros errados", "o novo zelador já verificou as fotografias do cais esta manhã"],
    "nl": ["de leverancier heeft dringend nodig ons ontwerp van de jaarbrief", "onze nachtdienst mist al dagen de dienstregeling van het veer", "het waterschap vervangt binnenkort de gebarsten dakpannen"],
}
TRAIN = [(lang, s[:2] * 3) for lang, s in SENTENCES.items()]
MODEL = L.train(TRAIN, L.vocabulary())


def test_forward_is_the_sum_over_segmentations():
    for word in ("water", "prüfer", "zzq"):
        w = L.START + word
        total = np.zeros(len(L.LANGUAGES))
        for cuts in itertools.product([0, 1], repeat=len(w) - 1):
            edges = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(w)]
            p = np.ones(len(L.LANGUAGES))
            for a, b in zip(edges, edges[1:]):
                piece = MODEL.p.get(w[a:b])
                p = p * (piece if piece is not None else np.full(len(L.LANGUAGES), L.FLOOR) if b == a + 1 else 0)
            total += p
        assert np.allclose(MODEL.word(word), np.log(total), rtol=1e-9)


def test_held_out_sentences_and_long_words():
    for lang, s in SENTENCES.items():
        best, confidence = MODEL.paragraph(L.paragraph_words(s[2]))
        assert L.LANGUAGES[best] == lang and confidence > 1 / 6  # two sentences a language are little to learn from
    assert np.isfinite(MODEL.word("a" * 3000)).all()


def test_many_words_and_a_full_memory(monkeypatch):
    words = [f"{a}{b}{c}" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyzabcdefghijklm"]
    want = sum(MODEL.word(w) for w in words)
    monkeypatch.setattr(L, "KNOWN_WORDS", 300)
    for limit in (300, 5000):
        monkeypatch.setattr(L, "KNOWN_WORDS", limit)
        fresh = L.Model(MODEL.p)
        assert fresh.paragraph(words)[0] == int(want.argmax()) and fresh.paragraph(words[:5]) == fresh.paragraph(words[:5])


def test_rows(spark):
    en, de = " ".join(SENTENCES["en"]), " ".join(SENTENCES["de"])
    mail = lambda *p: "From: a@x\n\n" + "\n\n".join(p)
    rows = [(1, mail(en), "en-GB"), (2, mail(en), "de"), (3, mail(en, de), "EN"), (4, mail(de), None), (5, None, "en"), (6, "", None), (7, mail("hi there"), None), (8, mail(en) + "\n\n> " + de, "en_US"), (9, mail(de), "??"), (9, mail(de), "??")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = L.mislabelled(L.document_languages(L.segments(docs, MODEL)))
    assert sorted(map(tuple, found.collect())) == [(2, "en"), (3, "de"), (3, "en"), (4, "de"), (9, "de")]
    assert L.segments(docs.limit(0), MODEL).count() == 0
    model = L.fit_on(docs, 100)
    assert L.LANGUAGES[model.paragraph(L.paragraph_words(en))[0]] == "en"
    assert L.LANGUAGES[L.fit_on(docs.limit(0)).paragraph(["x"])[0]] in L.LANGUAGES


def test_long_words_count_like_short_ones():
    import numpy as np

    from trellis.llm import language as L

    table = {x: np.full(6, p) for x, p in (("▁a", 0.2), ("b", 0.1), ("ab", 0.3), ("a", 0.05), ("▁", 0.1))}
    model = L.Model(table)
    word = "ab" * 15
    plain = L._counts({word: 2}, model, 0)
    spans = [(i, j, s, p[0]) for i, j, s, p in model.spans(word)]
    logs = {}
    for (_, _, s, _), x in zip(spans, L._log_posteriors(spans, len(word) + 1)):
        logs[s] = logs.get(s, 0.0) + 2 * x
    assert plain.keys() == logs.keys() and all(abs(plain[s] - logs[s]) < 1e-9 for s in plain)
    long = L._counts({"ab" * 400: 1}, model, 0)
    assert abs(sum(len(s.lstrip("▁")) * x for s, x in long.items()) - 800) < 1e-6
