"""Text that was decoded with a wrong character encoding: found, and restored where possible.

A chain undoes one wrong decoding: the characters are turned into the bytes of the encoding they were read in, and those are decoded as
the encoding they were written in. Chains are applied again and again for text garbled more than once. Every candidate reading is
compressed with zstandard dictionaries, one per language, trained on sound text; its description length is the least compressed size
over the languages plus the cost of the chains that lead to it. The shortest description wins, and text stays as it is unless a reading
beats it.

A value may be garbled in part, so a chain is tried on the odd words and on all words. Odd are those that hold characters unusual for
sound text, or usual ones where sound text has none, and those outside the dictionary that a chain turns into one in it. A word is
measured in the corpus' language and in every other whose alphabet has all its unusual letters, so foreign words and signs are told
from garbled ones, and restored as such, by their own dictionaries. Readings in letters of no language, in more unusual letters than
before, or in letters of two scripts at once can't be shorter and aren't measured.

Only values with an unusual character, or with a usual one that a chain may have made, reach Python to be restored. The dictionaries are
made from exact counts over all sound values, and over all texts of other languages; what is bounded is the size of a dictionary.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from lexweave.session import cut_lineage

#: Encodings that text is read in by mistake, and those that Hungarian text, and Cyrillic names in it, are written in.
READ_AS = ("cp1252", "cp1250", "iso8859_1", "iso8859_2", "mac_roman", "mac_latin2", "cp437", "cp850", "cp852", "cp1251", "koi8_r")
WRITTEN_AS = ("utf_8", "cp1250", "iso8859_2", "cp852", "mac_latin2", "cp1251", "koi8_r")
#: Characters of sound Hungarian legal text besides ASCII.
USUAL = "áéíóöőúüűÁÉÍÓÖŐÚÜŰ§–„”"
_LOWER, _UPPER, _ACCENTED = "a-záéíóöőúüű", "A-ZÁÉÍÓÖŐÚÜŰ", "ÁÉÍÓÖŐÚÜŰ"
#: Usual characters where sound text has none: a capital accented letter after a small letter, a small one among capitals, § or a quote
#: on the wrong side of a letter, ő for § after a number.
MISPLACED = rf"[{_LOWER}][{_ACCENTED}]|[{_UPPER}]{{2}}[éöőű]|(?<![{_LOWER}{_UPPER}])[éöőű][{_UPPER}]|[{_UPPER}][éöőű][{_UPPER}]|[{_LOWER}{_UPPER}][§„]|[§”][{_LOWER}{_UPPER}]|[0-9]\. ?[őű](?![{_LOWER}{_UPPER}])"
#: What stands in all text with misplaced characters, told at a glance: Spark looks for these only where it is found.
MAYBE_MISPLACED = rf"[^ -~](?:(?<=[{_ACCENTED}§„”])|(?<=[{_UPPER}].)|(?=[{_UPPER}])|(?<=\. ?[őű]))"
#: Usual characters that can be misplaced, or that a chain may have made of other usual ones.
TELLING = "éöőűÁÉÍÓÖŐÚÜŰ§„”"
#: Bytes that a usual character costs besides where sound text has none.
MISPLACED_BYTES = 3
#: How many times as frequent as a word its reading must be to make the word odd, by rank.
RARER = 50
#: Bytes that undoing a chain costs, by the encoding the text was written in. Sequences valid as UTF-8 seldom come about by chance,
#: other encodings can read anything. Central European text read as Western European is by far the commonest of them.
COST = {"utf_8": 0.5, "cp1250": 1.5, "iso8859_2": 1.5, "cp852": 1.5, "mac_latin2": 3.5, "cp1251": 3.0, "koi8_r": 3.0}
COMMON_COST = 0.5
#: Bytes a word without unusual characters must save to be read anew with the others, and what one with them may lose.
CLEAR_BYTES = 3
SLACK_BYTES = -1.5
#: Bytes that naming another language than the corpus' own costs.
SWITCH_BYTES = 0.7
#: Bytes that a character unknown to every language costs besides, and the words of the text that goes before one to be measured.
UNKNOWN_BYTES = 1.6
LEAD_WORDS = 12
#: Words whose sizes a worker keeps.
CACHE_WORDS = 200_000
#: Bounds of the sizes of dictionaries: trained words of each other language; words of the corpus, and as much again of whole values.
LANGUAGE_BYTES = 100_000
DICTIONARY_BYTES = 800_000
LEVEL = 19
#: Letters beyond ASCII of languages whose words occur in Hungarian texts, and frequent words and names that have them.
ALPHABETS = {
    "de": "äöüßÄÖÜ",
    "fr": "àâæçéèêëîïôœùûüÿÀÂÆÇÉÈÊËÎÏÔŒÙÛÜŸ",
    "es": "áéíñóúüÁÉÍÑÓÚÜãõâêôàçÃÕÂÊÔÀÇ",
    "pl": "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ",
    "cs": "áčďéěíňóřšťúůýžôľĺŕäÁČĎÉĚÍŇÓŘŠŤÚŮÝŽÔĽĹŔÄ",
    "ro": "ăâîșțşţĂÂÎȘȚŞŢ",
    "hr": "čćđšžČĆĐŠŽ",
    "nordic": "åäæøöõÅÄÆØÖÕðþÐÞ",
    "tr": "çğıöşüÇĞİÖŞÜ",
    "ru": "абвгдеёжзийклмнопрстуфхцчшщъыьэюяАБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
}
FOREIGN = {
    "de": """und die der das nicht für über können müssen dürfen Straße Größe größer gemäß Änderung Übergang Öffnung Bürger Bürgermeister Käufer Verkäufer schön früh Österreich österreichisch
        Grundstück Verfügung zuständig natürlich Köln München Düsseldorf Zürich Nürnberg Saarbrücken Müller Schröder Schäfer Krüger Böhm Jäger Weiß groß außer Maß Fuß Fußnote Gesetzgebung Behörde Gebühr
        Führung Prüfung Ausführung Einführung Durchführung Förderung Lösung Gläubiger Träger Tätigkeit Fähigkeit Verhältnis Verhältnisse Gegenstände Umstände Länder Städte Räte Beiträge Verträge Anträge
        Erklärung Gewährleistung während später wäre hätte würde für fünf zwölf öffentlich mündlich persönlich jährlich ursprünglich tatsächlich ausschließlich einschließlich schließlich maßgeblich müßte muß daß""",
    "fr": """le la les une des être à où déjà façade façon château châteaux goût coût coûts garçon français française naïf naïve hôtel hôtels forêt forêts maître maîtresse œuvre œuvres cœur sœur rôle rôles théâtre là-bas
        élève père mère frère île îles août Noël Citroën Moët Chloé Zoë Joël Raphaël Israël Mercédès Besançon Orléans Genève Liège après très près dès même tête fête bête fenêtre prêt intérêt arrêt arrêté Crête
        vôtre nôtre côté côtes dépôt impôt impôts tôt bientôt plutôt contrôle diplôme cône âge pâte tâche grâce château gâteau câble bâtiment théâtral règle règlement règles siècle modèle système problème caractère
        matière première dernière manière crème café résumé société sécurité propriété liberté égalité fraternité communauté européenne procédure général générale décision çà ça reçu leçon déçu François Françoise
        voilà delà pâté entrée soirée musée lycée idée protégé exposé cliché fiancé vis-à-vis crèche pièce tête-à-tête mêlée crêpe rôti soufflé brûlée maïs haïr coïncidence aiguë""",
    "es": """el los las señal señales señor señora niño niña niños año años mañana español España español corazón información también después canción jamás así está aquí allí más aún según Málaga Córdoba Cádiz León
        número público artículo artículos capítulo título derecho obligación disposición resolución administración protección región religión ocasión decisión comisión sesión pequeño compañía montaña cañón piñata jalapeño
        São João coração não ações ação informação decisão comissão união pão irmã irmão avô avó você português avião mãe mães cães nações relações organizações Conceição Gonçalves Araújo Guimarães Magalhães
        Peña Núñez Muñoz Ibáñez Ordóñez Núñez açaí praça França cabeça força Açores câmara âmbito competência emergência três português inglês além também através página público área""",
    "pl": """i w na się że żeby świat Łódź łąka źródło ręka mąż część książka pięć dzień być mieć może można także również więc więcej około później Kraków Wrocław Gdańsk Poznań Rzeszów Częstochowa Śląsk Śląskie
        Małgorzata Łukasz Paweł Michał Zdzisław Stanisław Władysław Wałęsa Kaczyński Dąbrowski Wiśniewski Jabłoński Wójcik Błażej Żuk złoty złotych żółty święto święty śnieg słońce miłość wolność sprawiedliwość
        ustawa rozporządzenie urząd sąd sądów rząd rządu województwo działalność własność odpowiedzialność zgłoszenie zakończenie rozpoczęcie przyjęcie ćwiczenie środek środki środowisko wartość jakość ilość ludność
        pierogi żurek gołąbki naprzód następny następnie będzie będą są tę tą którą którzy który""",
    "cs": """a že se je být byl při také více méně muže může český čeština česká Česko řeka řeky město města příliš žluťoučký kůň děkuji čtyři pět šest dvě tři Praha Brno Plzeň Žižka Dvořák Škoda škola školy žena ženy
        Škof Němec Novák Svoboda Dvořáková Černý Růžička Hájek Král Procházka Jiří Tomáš Lukáš Ondřej Matěj Zdeněk Václav Božena Růžena Šárka Žaneta Bedřich Leoš Janáček Smetana Čapek Havel Kříž
        zákon zákona předpis předpisy nařízení úřad úřady soud soudní vláda ministerstvo společnost možnost činnost příslušný životní prostředí účinnost článek odstavec písmeno
        slovenský Slovensko Žilina Košice Prešov Trenčín Nové Zámky Štúrovo Komárno ľudia môže môj stôl kôň dĺžka vŕba ďalej ďakujem ťažký účet šťastie knedlíček bábovka""",
    "ro": """și în să este târgul București când până fără către România Bălceni mâine câte viață oraș orașul țară țara ție încă această acesta după mâna pâine sâmbătă săptămână lună zi noapte bună ziua mulțumesc
        Iași Brașov Timișoara Cluj Târgu Mureș Constanța Galați Ploiești Pitești Bacău Buzău Argeș Ștefan Mircea Cătălin Mădălina Ionuț Răzvan Dănuț Țepeș Călărași Sfântu Gheorghe
        lege legea hotărâre hotărârea ordonanță ordonanța guvernului articolul alineatul autorității naționale națională Uniunea Europeană protecția informații instituții organizații drepturi obligații
        şi ţară oraş viaţă naţional preşedinte iniţiativă""",
    "hr": """i je su kuća kuće škola žena žene čovjek ljudi život životni može mogu više između također općina općine županija županije Zagreb Šibenik Požega Čakovec Karlovac Poreč Osijek Đakovo Međimurje
        Kovačević Petrović Jovanović Nikolić Đorđević Milošević Marković Ivanović Pavlović Stojanović Tomić Babić Jurić Perić Matić Vuković Božić Kovačić Novaković Šarić Žarko Željko Miloš Đuro Andrić
        Slovenija Škofja Loka Maribor Črnomelj Vič Šentjur Žalec člen zakon uradni odločba določba pravilnik državni zbor Beograd Niš Čačak Kruševac Užice Šabac Požarevac ćevapčići šljivovica rakija""",
    "nordic": """och på är över från små stå blå få går år åt då också när där här någon något även själv första större Ångström ångström Åland Malmö Göteborg Örebro Västerås Jönköping Umeå Luleå Skåne
        smörgåsbord lag förordning myndighet häst öl kött hämta hälsa märke rätt rättighet æ ø å og på så får gå Ø øre Øre sær sø smørrebrød København Århus Aalborg Ærø Øresund Jørgen Søren Bjørn Håkon Bjørk
        Kierkegaard Tromsø Ålesund Bodø Hønefoss Sørensen Jørgensen Møller Nygård hygge blåbær rødgrød fløde første større være hjælp æble brød Hämeenlinna Jyväskylä Järvi Mäkinen Hämäläinen Sibelius sää kylä tyttö
        õ sõlm õhtu jõgi õpetaja võti põder tõde sõna õigus kõik põhi mõju sõber võõras Võru Põlva Tõnu Jõgeva Reykjavík þing það Þór Guðmundur""",
    "tr": """ve bir için çok güzel değil şehir öğrenci İstanbul İzmir Türkiye Türk Atatürk Erdoğan Çelik Yıldız Yılmaz Şahin Öztürk Doğan Kılıç Aydın Diyarbakır Eskişehir Çanakkale Ağrı Iğdır ışık kış yaş göğüs ağaç""",
    "ru": """и в не на с по для что как это из от до при за его она они мы вы был была было были может должен закон закона законом законы соответствии с федеральный Российской Федерации статья статьи пункт
        Москва Россия Санкт-Петербург Киев Київ Україна Володимир Иван Пётр Сергей Александр Владимир Наталья Татьяна Анна Мария Андрей Дмитрий Пушкин Достоевский Толстой Чехов Гоголь
        правительство министерство договор решение право права суд суда город области края год года лет день время человек люди работа слово дело книга жизнь мир правда большой новый первый хорошо спасибо привет да нет очень все только когда если также более между перед после через""",
}
SIGNS = "€ ™ ® © × ÷ ± ° °C µg/m³ m² ½ ¼ ¾ ‰ № ¿ ¡ « » ‹ › • … — † ‡ ¶ ¹ ² ³ ª º „Â” „Ã” £ ¥ ¢"


class Chain(NamedTuple):
    """Text written as `written` and read as `read`."""

    read: str
    written: str


def chain_cost(chain: Chain) -> float:
    """Bytes that undoing a chain costs."""
    if chain.read in ("cp1252", "iso8859_1") and chain.written in ("cp1250", "iso8859_2"):
        return COMMON_COST
    return COST[chain.written]


CHAINS = tuple(Chain(r, w) for w in WRITTEN_AS for r in READ_AS if r != w)


@functools.lru_cache(maxsize=None)
def code_page(name: str) -> str:
    """The characters of the 256 bytes of an encoding; undefined bytes stand for themselves, as lenient readers have them."""
    return "".join(bytes([b]).decode(name, "replace").replace("�", chr(b)) for b in range(256))


@functools.lru_cache(maxsize=None)
def _byte_of(name: str) -> dict[str, int]:
    page = code_page(name)
    out = {page[b]: b for b in range(255, -1, -1)}
    if name == "cp1252":  # a lenient reader may also keep the bytes that the page redefines
        out |= {chr(b): b for b in range(128, 160) if chr(b) not in out}
    return out


_MULTI = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")


@functools.lru_cache(maxsize=None)
def _table(chain: Chain) -> dict[int, str]:
    page = code_page(chain.written)
    return {ord(c): page[b] for c, b in _byte_of(chain.read).items() if b > 127 and page[b] != c}


@functools.lru_cache(maxsize=None)
def _readable(read: str) -> re.Pattern:
    """Runs of characters outside ASCII that have a byte in an encoding."""
    return re.compile("[" + re.escape("".join(c for c, b in _byte_of(read).items() if b > 127)) + "]{2,}")


def undo(word: str, chain: Chain) -> str:
    """The word as it was before the chain; what can't come from it stays."""
    if chain.written != "utf_8":
        return word.translate(_table(chain))
    byte_of = _byte_of(chain.read)

    def run(m: re.Match) -> str:
        chars = m[0]
        raw = bytes(byte_of[c] for c in chars)
        out, at = [], 0
        for x in _MULTI.finditer(raw):
            out += [chars[at : x.start()], x[0].decode("utf-8")]
            at = x.end()
        return "".join(out) + chars[at:] if out else chars

    return _readable(chain.read).sub(run, word)


def train(sound: Iterable[str], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary of sound values: words, the most frequent last, where references are shortest, then some values whole.
    All words of all values are counted; values that don't fit in a quarter of the size are only left out as wholes."""
    counts: Counter[str] = Counter()
    first, length = [], 0
    for s in sound:
        counts.update(s.split())
        if (more := len(s.encode()) + 1) <= size // 4 - length:
            first.append(s)
            length += more
    words = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
    kept, total = [], 0
    for w in words:
        total += len(w.encode()) + 1
        if total > size:
            break
        kept.append(w)
    return (" " + " ".join(reversed(kept)) + " " + " ".join(first) + " ").encode()


def _bare(word: str) -> str:
    """A word in small letters without the marks around it, to be looked up."""
    return word.lower().strip(".,;:()")


class Model:
    """Compressors of the languages; made once per worker process."""

    def __init__(self, dictionaries: dict[str, bytes], usual: str = USUAL):
        self.languages = []
        for name, raw in dictionaries.items():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            c = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
            words = raw[-4000:].decode("utf-8", "ignore").split()[1:]
            leads = [" ".join((words * LEAD_WORDS)[i : i + LEAD_WORDS]).encode() + b" " for i in (0, LEAD_WORDS)]
            self.languages.append((c, leads, sum(len(c.compress(x + b" ")) for x in leads), frozenset(raw.decode("utf-8", "ignore")) | frozenset(ALPHABETS.get(name, ""))))
        self.known = frozenset().union(*(x[3] for x in self.languages))
        foreign = [f" {raw.decode('utf-8', 'ignore')} " for k, raw in dictionaries.items() if k != "corpus"]
        self.pairs = frozenset(x[i : i + 2] for x in foreign for i in range(len(x) - 1) if x[i] > "\x7f" or x[i + 1] > "\x7f")
        self.usual = frozenset(usual) | frozenset(map(chr, range(32, 127))) | {"\n", "\t", "\r"}
        self.unusual = re.compile(unusual_pattern(usual))
        self.misplaced = re.compile(MISPLACED)
        # Words are listed with the most frequent last before the values, so the rank of a word is its place from the end.
        listed = next(iter(dictionaries.values()), b"").decode("utf-8", "ignore").lower().split()
        self.ranks = {_bare(w): len(listed) - i for i, w in enumerate(listed)}
        self.swaps: dict[str, list[dict[int, str]]] = {}
        self.fine: set[str] = set()
        self.tables: dict[str, list[tuple[dict[int, str], list[Chain]]]] = {}
        self.candidates: dict[str, dict[str, list[tuple[Chain, ...]]]] = {}
        self.sizes: dict[tuple[str, bool], float] = {}
        self.readings: dict[tuple[str, str, str], list[tuple[tuple[Chain, ...], str, float]]] = {}

    def size(self, before: str, word: str, after: str, made: bool = False) -> float:
        """Bytes that a word adds to compressed text of the language it fits best. A reading (made) with letters of other languages is
        measured in these alone; what stands in the text may be the corpus' own all the same.

        Few bytes alone would be stored as they are, so the word follows running text of that language. Letters and signs beyond ASCII
        count alike whether UTF-8 needs two bytes for them or three; those that no language's text has cost more.
        """
        text, own = f"{before} {word} {after}", self.languages[0][0]
        key = (text, made)
        if key not in self.sizes:
            if len(self.sizes) > CACHE_WORDS:
                self.sizes.clear()
            raw = text.encode("utf-8", "surrogatepass")
            # Sound text is measured in the corpus' own language; unusual characters may be of another one that has them.
            odd = frozenset(self.unusual.findall(word))
            others = [x for x in self.languages[1:] if odd <= x[3]] if odd else []
            languages = ([] if made and others else self.languages[:1]) + others
            # Sizes are whole bytes, so the mean after several leads tells more.
            size = min((sum(len(c.compress(x + raw)) for x in leads) - least) / len(leads) + (SWITCH_BYTES if c is not own else 0) for c, leads, least, _ in languages)
            self.sizes[key] = size + sum((UNKNOWN_BYTES if c not in self.known else 0) - (c > "\u07ff") for c in word) + MISPLACED_BYTES * len(self.misplaced.findall(word))
        return self.sizes[key]

    def _odd(self, word: str) -> int:
        return len(self.unusual.findall(word))

    def _fits(self, was: str, word: str, shrunk: bool = False) -> bool:
        """Could the word be the sound form: no character unknown to all languages that wasn't there, no more unusual ones, one script?
        What undoing UTF-8 has shrunk may have any that can be seen, as it may be garbled still.

        Where as many letters are unusual as before, one must stand beside another as in some dictionary: else each is spelled out in
        the reading as it was in the word, and nothing is shorter.
        """
        if word == was or not all(c in self.usual or c in self.known or c in was or (shrunk and c.isprintable()) for c in word):
            return False
        odd, less = self.unusual.findall(word), self._odd(was)
        if not odd:
            return True
        if len(odd) > less or _MIXED.search(word):
            return False
        return len(odd) < less or any(f" {word} "[i : i + 2] in self.pairs for i, c in enumerate(word + " ") if c in odd or (i and word[i - 1] in odd))

    def _tables(self, word: str) -> list[tuple[dict[int, str], list[Chain]]]:
        """The distinct ways in which single-byte chains read a word's characters as such that some language has, and their chains."""
        beyond = "".join(sorted({c for c in word if c > "\x7f"}))
        if beyond not in self.tables:
            by: dict[tuple[str, ...], list[Chain]] = {}
            for chain in CHAINS:
                if chain.written != "utf_8":
                    table = _table(chain)
                    to = tuple(table.get(ord(c), c) for c in beyond)
                    if any(x != c and x not in self.usual and x not in self.known for x, c in zip(to, beyond, strict=True)):
                        continue
                    by.setdefault(to, []).append(chain)
            self.tables[beyond] = [({ord(c): x for c, x in zip(beyond, to, strict=True) if c != x}, chains) for to, chains in by.items() if "".join(to) != beyond]
        return self.tables[beyond]

    def _candidates(self, word: str) -> dict[str, list[tuple[Chain, ...]]]:
        """The readings of a word, and the chains that lead to each. Where undoing UTF-8 gives what no language has, a further chain is
        undone at once; otherwise that is left to the next pass over the value."""
        out: dict[str, list[tuple[Chain, ...]]] = {}
        for table, chains in self._tables(word):
            reading = word.translate(table)
            if self._fits(word, reading):
                out.setdefault(reading, []).extend((c,) for c in chains)
        for chain in CHAINS:
            if chain.written == "utf_8" and (once := undo(word, chain)) != word:
                if self._fits(word, once, True):
                    out.setdefault(once, []).append((chain,))
                elif self.unusual.search(once):
                    for table, chains in self._tables(once):
                        if self._fits(word, twice := once.translate(table)):
                            out.setdefault(twice, []).extend((chain, c) for c in chains)
                if self.unusual.search(once):
                    for c in CHAINS[: len(READ_AS)]:
                        if (twice := undo(once, c)) != once and self._fits(word, twice, True):
                            out.setdefault(twice, []).append((chain, c))
        return out

    def read(self, before: str, word: str, after: str) -> list[tuple[tuple[Chain, ...], str, float]]:
        """(chains, reading, bytes saved) of every way to read a word between others."""
        key = (before, word, after)
        if key not in self.readings:
            if len(self.readings) > CACHE_WORDS:
                self.readings.clear()
                self.candidates.clear()
            if word not in self.candidates:
                self.candidates[word] = self._candidates(word)
            found = self.candidates[word]
            own = self.size(*key) if found else 0
            self.readings[key] = [(c, r, gain) for r, chains in found.items() for gain in (own - self.size(before, r, after, chains[0][-1].written != "utf_8"),) for c in chains]
        return self.readings[key]

    def _swap(self, word: str) -> bool:
        """Is the word outside the dictionary, or rare, and a reading of it in the dictionary, or much more frequent?"""
        beyond = "".join(sorted({c for c in word if c > "\x7f"}))
        if beyond not in self.swaps:  # the few ways to read these characters as other usual ones
            self.swaps[beyond] = [t for t, _ in self._tables(beyond) if self.usual.issuperset(t.values())]
        if not self.swaps[beyond]:
            return False
        rank = self.ranks.get(_bare(word), len(self.ranks) * RARER)
        readings = (word.translate(t) for t in self.swaps[beyond])
        return any(self.ranks.get(_bare(r), rank) * RARER < rank and not self.misplaced.search(r) for r in readings)

    def odd_words(self, words: list[str]) -> list[bool]:
        """Which words speak for a wrong decoding? Those that don't, whatever stands before them, are kept to be told at once."""
        if self.fine.issuperset(words):
            return []
        if len(self.fine) > CACHE_WORDS:
            self.fine.clear()
        out = []
        for a, w in zip(["", *words], words, strict=False):
            odd = w not in self.fine and not w.isascii() and bool(self.unusual.search(w) or self.misplaced.search(w) or self._swap(w))
            if not odd and w[:1] in ("ő", "ű"):
                odd = bool(self.misplaced.search(f"{a[-2:]} {w}"))
            elif not odd:
                self.fine.add(w)
            out.append(odd)
        return out

    def read_by(self, best: tuple[Chain, ...], before: str, word: str, after: str) -> list[tuple[tuple[Chain, ...], str, float]]:
        """read(), of the given chains alone."""
        reading = functools.reduce(undo, best, word)
        if not self._fits(word, reading, best[0].written == "utf_8"):
            return []
        return [(best, reading, self.size(before, word, after) - self.size(before, reading, after, best[-1].written != "utf_8"))]

    def _all(self, text: str) -> list[tuple[str, bool, tuple[str, str, str]]]:
        """Each word, whether it is odd, and itself between its neighbours; nothing if none is. Of these the near ends count, if ASCII."""
        odd = self.odd_words(text.split(" "))
        if not any(odd):
            return []
        words = ["", *text.split(" "), ""]
        end = lambda w: w[-4:] if w.isascii() else ""
        start = lambda w: w[:4] if w.isascii() else ""
        return [(w, o, (end(a), w, start(b))) for a, w, b, o in zip(words, words[1:], words[2:], odd, strict=False)]

    def restore(self, text: str) -> tuple[str, int]:
        """The reading with the shortest description, and how many chains it took; the text itself with 0 if none beats it."""
        undone, seen = 0, {text}
        while words := self._all(text):
            saved: dict[tuple[Chain, ...], float] = {}
            for _, odd, key in words:
                for chains, _, gain in self.read(*key) if odd else ():
                    if gain > 0:
                        saved[chains] = saved.get(chains, -sum(map(chain_cost, chains))) + gain
            # Of equal readings the simplest and first counts, so the result doesn't depend on the order of words.
            best = max(saved, key=lambda c: (saved[c], -len(c), -CHAINS.index(c[0])), default=None)
            if best is None or saved[best] <= 0:
                break
            out = []
            for w, odd, key in words:
                readings = self.read(*key) if odd else [] if w.isascii() else self.read_by(best, *key)
                new = next(((r, g) for c, r, g in readings if c == best), None)
                # Once the chain is known, odd words may cost a little more if it makes them sound; one without
                # may have been garbled too, but only a clear saving speaks for it.
                least = CLEAR_BYTES if not odd else SLACK_BYTES if new and not self.unusual.search(new[0]) else 0
                out.append(new[0] if new and new[1] >= least else w)
            again = " ".join(out)
            if again in seen:
                break
            text, undone = again, undone + len(best)
            seen.add(text)
        return text, undone


_LOST = re.compile("[�\x80-\x9f]")
#: A word in letters of Latin and of Cyrillic.
_MIXED = re.compile("[A-Za-z\u00c0-\u024f].*[\u0400-\u04ff]|[\u0400-\u04ff].*[A-Za-z\u00c0-\u024f]", re.S)


def unusual_pattern(usual: str = USUAL) -> str:
    """Regular expression of characters that sound text doesn't have."""
    return r"[^\t\n\r -~" + usual + "]"


@functools.lru_cache(maxsize=4)
def _model(dictionaries: tuple[tuple[str, bytes], ...], usual: str) -> Model:
    return Model(dict(dictionaries), usual)


def _unusual_at_a_glance(usual: str = USUAL) -> str:
    """unusual_pattern for Java, which is slow at classes of many characters: printable ASCII is passed over first."""
    return rf"[^ -~](?<![\t\n\r{usual}])"


def sound(value: Column, usual: str = USUAL) -> Column:
    """Has the value no unusual character?"""
    return ~value.rlike(_unusual_at_a_glance(usual))


def suspect(value: Column, usual: str = USUAL) -> Column:
    """May the value be garbled: has it an unusual character, or a usual one that can tell?"""
    return value.rlike(f"[^ -~](?:(?<=[{TELLING}])|(?<![\\t\\n\\r{usual}]))")


def misplaced(value: Column) -> Column:
    """Has the value a usual character where sound text has none?"""
    return value.rlike(MAYBE_MISPLACED) & value.rlike(MISPLACED)


def sample_values(values: DataFrame, usual: str = USUAL, sample: int | None = None) -> DataFrame:
    """(value, n): the distinct sound values, whole, and how many rows have each: all of them, or only the `sample` with the least hashes if
    a caller asks for fewer. values: one column, value."""
    good = F.col("value").isNotNull() & (F.length("value") > 0) & sound(F.col("value"), usual) & ~misplaced(F.col("value"))
    found = values.where(good).groupBy("value").agg(F.count("*").alias("n"))
    return found if sample is None else found.orderBy(F.xxhash64("value"), "value").limit(sample)


def _first_that_fit(rows: DataFrame, order: list[Column], size: int) -> list[Row]:
    """Of (name, text, …) the first rows of each name, in an order, whose texts fit in a size with a blank each, in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: defaultdict[str, int] = defaultdict(lambda: size)
        for batch in batches:
            kept = []
            for i, (name, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                left[name] -= len(text.encode()) + 1
                if left[name] >= 0:
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    # What is first of all is first in its partition, so each sends no more than fits, and one task chooses among that.
    near = rows.sortWithinPartitions("name", *order).mapInArrow(run, rows.schema)
    return near.repartition(1).sortWithinPartitions("name", *order).mapInArrow(run, rows.schema).collect()


def _counted_words(texts: DataFrame) -> DataFrame:
    """(name, text, n): how often each word stands in (name, text); words are what Python's split makes of a text."""
    words = texts.select("name", F.explode(F.split("text", r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")).alias("text"))
    return words.where("text <> ''").groupBy("name", "text").agg(F.count("*").alias("n"))


def fit(values: DataFrame, usual: str = USUAL, sample: int | None = None, texts: DataFrame | None = None) -> dict[str, bytes]:
    """Dictionaries by language. That of the corpus has the words of all its distinct sound values by how often they stand there, as train
    does, then the values whose copies repeat most bytes, whole; those of other languages are trained on all texts in them (see
    fit_languages), with the fixed words above behind. values: one column, value. texts: lang, text. sample: see sample_values."""
    found = cut_lineage(sample_values(values, usual, sample).select(F.lit("corpus").alias("name"), F.col("value").alias("text"), "n"))
    words = _first_that_fit(_counted_words(found), [F.desc("n"), F.col("text")], DICTIONARY_BYTES)
    size = F.octet_length("text")
    whole = _first_that_fit(found.where(size < DICTIONARY_BYTES // 4), [F.desc((F.col("n") - 1) * size), F.desc(size), F.col("text")], DICTIONARY_BYTES)
    return {"corpus": _joined(words, whole)} | foreign_dictionaries({} if texts is None else fit_languages(texts))


def _joined(*parts: list[Row]) -> bytes:
    """The texts of each part, the first of an order last."""
    return "".join(f" {' '.join(r.text for r in reversed(part))}" for part in parts).encode() + b" "


def fit_languages(texts: DataFrame, sample: int | None = None) -> dict[str, bytes]:
    """Words of all distinct texts of each language of ALPHABETS that texts (lang, text) have, the most frequent last, or of the `sample`
    texts of each with the least hashes if a caller asks for fewer. Words with letters that aren't the language's are left out, as texts
    may be garbled or wrongly labelled."""
    lang = F.lower(F.trim(F.col("lang")))
    known = texts.select(lang.alias("name"), "text").where(F.col("name").isin(*ALPHABETS) & (F.length("text") > 0)).distinct()
    if sample is not None:
        first = Window.partitionBy("name").orderBy(F.xxhash64("text"), "text")
        known = known.withColumn("k", F.row_number().over(first)).where(F.col("k") <= sample).drop("k")
    own = functools.reduce(lambda x, name: x | ((F.col("name") == name) & ~F.col("text").rlike(rf"[^\x00-\x7e{ALPHABETS[name]}]")), ALPHABETS, F.lit(False))
    words = _counted_words(known).where(F.col("text").rlike(r"[^\x00-\x7f]") & own)
    by: defaultdict[str, list[Row]] = defaultdict(list)
    for r in _first_that_fit(words, [F.desc("n"), F.col("text")], LANGUAGE_BYTES):
        by[r.name].append(r)
    return {name: " ".join(r.text for r in reversed(rows)).encode() for name, rows in by.items()}


def foreign_dictionaries(trained: dict[str, bytes] | None = None) -> dict[str, bytes]:
    """Those of FOREIGN, behind what was trained of the same language, and of signs that stand in text of any language."""
    return {k: (trained or {}).get(k, b"") + f" {' '.join(v.split())} ".encode() for k, v in (FOREIGN | {"signs": SIGNS}).items()}


RESTORED_SCHEMA = "row_id bigint, field_name string, value string, restored string, chains int, lost boolean"


def restore_fields(fields: DataFrame, dictionaries: dict[str, bytes], usual: str = USUAL) -> DataFrame:
    """The garbled ones of (row_id, field_name, value): value, its restored form, the number of chains undone, and whether characters
    stay lost in it.

    Defined cases: null, empty and sound values are not garbled; a value with replacement characters or C1 controls is, recoverable or
    not; a foreign word or sign stays unless a reading describes the value shorter; repeated rows are judged each; an empty table gives
    none. Extra columns are not read.
    """
    frozen = tuple(dictionaries.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(frozen, usual)
        for batch in batches:
            rows = []
            for row_id, name, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text, chains = model.restore(value)
                lost = bool(_LOST.search(text))
                if chains or lost:
                    rows.append((row_id, name, value, text, chains, lost))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in RESTORED_SCHEMA.split(", ")])

    suspects = fields.where(F.col("value").isNotNull() & suspect(F.col("value"), usual))
    return suspects.select(F.col("row_id").cast("bigint").alias("row_id"), "field_name", "value").mapInArrow(run, RESTORED_SCHEMA)


def fields_of(df: DataFrame, names: tuple[str, ...] = ("text", "title")) -> DataFrame:
    """(row_id, field_name, value) of the given string columns."""
    pairs = F.array(*(F.struct(F.lit(n).alias("field_name"), F.col(n).cast("string").alias("value")) for n in names))
    return df.select("row_id", F.inline(pairs))
