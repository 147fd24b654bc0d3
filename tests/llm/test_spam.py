import random

import pytest

from lexweave.llm.spam import LIMITS, calibrate, echoes, evidence, profile, profiles, spam_pages

PROSE = {
    "hu": "A hatóság a kérelem alapján a határidő lejártát követően az engedélyt felülvizsgálja, ha az ügyfél nem igazolja, hogy a feltétel fennáll. ",
    "en": "The authority shall review the permit after the deadline where the applicant does not prove that it meets the condition of this section. ",
    "de": "Die Behörde prüft den Antrag nach dem Ablauf der Frist, wenn der Antragsteller nicht nachweist, dass die Bedingung erfüllt ist. ",
}
KEYS = ["olcsó ügyvéd", "gyors válás", "adó kalkulátor", "jogi minta", "hitel azonnal", "ingyen tanács"]
rng = random.Random(4)
SPAM = {
    "words": " ".join(rng.choice(KEYS) for _ in range(60)),
    "bare": " ".join(rng.choice(KEYS) for _ in range(60)).upper().translate(str.maketrans("ÁÉÍÓÖŐÚÜŰ", "AEIOOOUUU")),
    "links": " ".join(f"[{rng.choice(KEYS)}](https://a{i}.invalid)" for i in range(15)),
    "urls": "\n".join(f"www.oldal{i}.test/p?id={i}" for i in range(15)),
    "tags": " ".join(f"#kulcs_szó{i}" for i in range(30)),
    "tags together": "".join(f"#kulcsszó{i}" for i in range(30)),
    "list": "Címkék: " + ", ".join(f"{rng.choice(KEYS)} {2000 + i}" for i in range(25)),
    "offers": " | ".join(f"Kódex {i} – {i}2 990 Ft Kosárba" for i in range(12)),
    "sentences": "A olcsó ügyvéd mindig olcsó ügyvéd. Olcsó ügyvéd? Ha olcsó ügyvéd, akkor olcsó ügyvéd most! " * 6,
}


@pytest.mark.parametrize("name", SPAM)
@pytest.mark.parametrize("start", ["", PROSE["hu"]])
def test_spam(name, start):
    assert profile(start + SPAM[name] + "\n" + SPAM[name]).spam


@pytest.mark.parametrize("language", PROSE)
def test_prose_of_every_language(language):
    got = profile(PROSE[language] * 3)
    assert not got.spam and got.language == language and got.function_words > 2 * LIMITS[language].function_words


HONEST = {
    "contents": "TARTALOM\n" + "\n".join(f"{i}. § Az adó és a vám szabályai ........ {i}" for i in range(1, 30)),
    "amendments": "\n".join(f"{c}) {i}. § ({i}) bekezdésében a „kút{i}” szövegrész helyébe a „tó{i}” szöveg lép," for i, c in enumerate("abcdefghij", 1)),
    "numbers": "A nyilvántartás szerinti számok: " + ", ".join(f"{i}/2013. számú határozat és a {i}. melléklet" for i in range(40)),
    "fragment": "kiállítás helye, ideje",
    "topic": "".join(f"A perköltség a {x} alapján a hatóság által megállapított összeg szerint jár. " for x in ("kérelem", "döntés", "vizsgálat", "végzés", "határozat")),
    "footnotes": PROSE["hu"] * 8 + "\n" + "\n".join(f"[{i}] https://jogtar{i}.test/cikk" for i in range(5)) + "\nTárgyszavak: adó, vám, illeték, díj",
    "repeated": (PROSE["hu"] + "\n") * 30,
}


@pytest.mark.parametrize("name", HONEST)
def test_honest(name):
    assert not profile(HONEST[name]).spam


def test_sentence_among_links():
    page = "\n".join(f"https://www.oldal{i}.test/cikk-{i}/letoltes" for i in range(4)) + "\n" + PROSE["hu"] * 2 + "\n" + "\n".join(f"oldal{i}.invalid/lista?id={i}0" for i in range(6))
    assert profile(page).spam and not profile(PROSE["hu"] * 6 + page).spam


def test_evidence():
    top, again, triples, fours, doubled, links, tags, separators, offers = evidence("a1 x, y, z\na1 x, y, z\na1 x, y, z\na1 x, y, z #t1 http://a.b/c 12 Ft")
    assert doubled == 0.5 and links > 0.1 and tags > 0.03 and separators > 0.5 and offers > 0 and again > 0.5 and triples > 0.5 and fours > 0.4 and top == 16 / 18
    assert echoes("kút kút kút tó tó".split()) == 0.6 and echoes([]) == 0


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, SPAM["words"]), (4, SPAM["words"]), (5, PROSE["hu"]), (6, PROSE["hu"] * 20 + SPAM["tags"]), (7, SPAM["tags"] * 200)]
    df = spark.createDataFrame([(*r, True) for r in rows], "doc_id bigint, text string, spam boolean")
    assert sorted(r.doc_id for r in spam_pages(df).collect()) == [4, 4, 7]
    assert profiles(df).count() == len(rows) and spam_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["Olcsó ügyvéd a városban, gyors válás és ingyen tanács most önnek!\n" * 12, "Olcsó ügyvéd a városban, gyors válás és ingyen tanács most önnek! " * 12])
def test_advertising_repeated_with_function_words(page):
    got = profile(page)
    assert got.spam and got.sparse <= 0.5 and got.echoes <= LIMITS["hu"].echoes and got.page_word_pairs > 0.9


def test_evidence_of_honest_pages():
    got = profile(HONEST["repeated"])
    assert got.page_duplicate_lines > 0.9 and got.duplicate_lines > 0.9 and got.page_word_pairs > 0.9 and got.word_pairs > 0 and not got.spam


def test_short_honest_page_of_few_subjects():
    text = "Der Bescheid begründet binnen dreißig Tagen die Frist, weil die Änderung nach Anhörung fehlt. Die Frist begründet schriftlich die Genehmigung. Das Gericht begründet binnen dreißig Tagen die Behörde, weil der Antrag binnen dreißig Tagen fehlt. Die Prüfung ersetzt binnen dreißig Tagen der Antrag, weil die Gebühr binnen dreißig Tagen fehlt. Die Genehmigung verlängert binnen dreißig Tagen die Rückzahlung, weil der Antrag binnen dreißig Tagen fehlt."
    assert profile(text).page_top_words > LIMITS["de"].page_top_words and not profile(text).spam


FOREIGN = {
    "fr": "Le conseil municipal décide que la taxe sur les terrains non bâtis est due par le propriétaire inscrit au registre. Le maire peut accorder une remise si le redevable prouve que la charge met en péril sa subsistance. La demande est déposée dans les trente jours qui suivent la notification, avec les pièces qui la justifient. Contre la décision, un recours est ouvert devant le tribunal administratif.",
    "pl": "Rada gminy postanawia, że opłata za zajęcie pasa drogowego jest należna od właściciela nieruchomości wpisanego do rejestru. Wójt może umorzyć opłatę, jeżeli zobowiązany wykaże, że jej zapłata zagraża jego utrzymaniu. Wniosek składa się w terminie trzydziestu dni od dnia doręczenia decyzji wraz z dokumentami, które go uzasadniają. Od decyzji przysługuje odwołanie do kolegium.",
    "ro": "Consiliul local hotărăște că taxa pentru ocuparea domeniului public este datorată de proprietarul înscris în registru. Primarul poate acorda o scutire dacă cel obligat dovedește că plata îi pune în pericol întreținerea. Cererea se depune în termen de treizeci de zile de la comunicare, împreună cu actele care o justifică. Împotriva deciziei se poate face contestație la tribunal.",
    "es": "El pleno del ayuntamiento acuerda que la tasa por la ocupación de la vía pública sea pagada por el propietario inscrito en el registro. El alcalde puede conceder una reducción si el obligado demuestra que el pago pone en peligro su sustento. La solicitud se presenta en el plazo de treinta días desde la notificación, con los documentos que la justifican. Contra la resolución cabe recurso ante el tribunal.",
    "cs": "Zastupitelstvo obce rozhodlo, že poplatek za užívání veřejného prostranství platí vlastník zapsaný v rejstříku. Starosta může poplatek prominout, jestliže povinný prokáže, že jeho zaplacení ohrožuje jeho výživu. Žádost se podává do třiceti dnů od doručení rozhodnutí spolu s doklady, které ji odůvodňují. Proti rozhodnutí se lze odvolat ke krajskému úřadu.",
    "fi": "Kunnanvaltuusto päättää, että maksu yleisen alueen käytöstä peritään rekisteriin merkityltä omistajalta. Kunnanjohtaja voi myöntää huojennuksen, jos maksuvelvollinen osoittaa maksun vaarantavan toimeentulonsa. Hakemus jätetään kolmenkymmenen päivän kuluessa päätöksen tiedoksisaannista tarvittavine liitteineen. Päätöksestä saa valittaa hallinto-oikeuteen.",
    "tr": "Belediye meclisi, kamuya ait alanların kullanımı için alınacak ücretin sicile kayıtlı malik tarafından ödenmesine karar verir. Başkan, yükümlünün ödemenin geçimini tehlikeye attığını kanıtlaması halinde indirim yapabilir. Başvuru, kararın tebliğinden itibaren otuz gün içinde gerekli belgelerle birlikte yapılır. Karara karşı idare mahkemesinde dava açılabilir.",
    "el": "Το δημοτικό συμβούλιο αποφασίζει ότι το τέλος για τη χρήση κοινόχρηστων χώρων οφείλεται από τον ιδιοκτήτη που είναι εγγεγραμμένος στο μητρώο. Ο δήμαρχος μπορεί να χορηγήσει απαλλαγή αν ο υπόχρεος αποδείξει ότι η πληρωμή θέτει σε κίνδυνο τη διαβίωσή του. Η αίτηση υποβάλλεται εντός τριάντα ημερών από την κοινοποίηση μαζί με τα δικαιολογητικά.",
    "ru": "Совет муниципалитета решает, что плата за использование общественных мест взимается с собственника, внесённого в реестр. Глава администрации может предоставить льготу, если обязанное лицо докажет, что уплата угрожает его существованию. Заявление подаётся в течение тридцати дней со дня вручения решения вместе с подтверждающими документами.",
}


@pytest.mark.parametrize("language", FOREIGN)
@pytest.mark.parametrize("times", [1, 2])
@pytest.mark.parametrize("joint", [" ", "\n"])
def test_honest_pages_of_further_languages(language, times, joint):
    sentences = FOREIGN[language].split(". ")
    # Texts of a council repeat their subjects in other words; here each sentence gets a number of its own.
    text = joint.join(f"{n}. {x}." for n, x in enumerate(sentences * times, 1))
    assert not profile(text).spam and not profile(FOREIGN[language]).spam


PLANTED = {
    "en": "cheap lawyer, tax calculator, free legal template, instant credit, cheap lawyer 2020, legal template download, tax calculator 2021, cheap lawyer online, free template, instant credit 2022, ",
    "de": "günstiger Anwalt, Steuerrechner, Muster kostenlos, Sofortkredit, günstiger Anwalt 2020, Muster Straße, Steuerrechner 2021, günstiger Anwalt online, Muster gratis, Sofortkredit 2022, ",
    "fr": "avocat pas cher, calcul impôt, modèle gratuit, crédit immédiat, avocat pas cher 2020, modèle à télécharger, calcul impôt 2021, avocat en ligne, modèle gratuit, crédit 2022, ",
}


@pytest.mark.parametrize("language", PLANTED)
@pytest.mark.parametrize("start", ["", "prose"])
def test_planted_pages_of_further_languages(language, start):
    text = (PROSE.get(language, FOREIGN.get(language, "")) if start else "") + PLANTED[language] * 6
    got = profile(text)
    assert got.spam and set(got.reasons) & {"top_words", "word_pairs", "word_triples", "separators"}


def test_short_page_of_search_words_and_a_link():
    assert profile("olcsó jogi minta olcsó jogi minta olcsó www.jogi.hu/x").spam and not profile("a határozat kelte, száma, helye és az aláírás helye").spam


def test_calibration(spark):
    rows = [(i, (PROSE["hu"] + f"{i}. sor ") * 3) for i in range(30)] + [(100, SPAM["words"])]
    got = {r.language: r for r in calibrate(profiles(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()}
    assert set(got) == {"hu"} and got["hu"].pages == 30 and 0.1 < got["hu"].function_words <= 0.2 and got["hu"].page_word_pairs <= 1
