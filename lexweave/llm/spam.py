"""Keyword-stuffed and link-list pages.

Legal prose of any language is held together by function words; lists of search words, links, tags and offers do without. A page's
language is told by its function words or, where it has few, by letters that only one language has. The page is cut into stretches by the
density of function words around each word, against a threshold of its language. Where the sparse stretches make up most of the page,
they are examined: shares of the commonest words and of recurring word sequences (two to four words), duplicate lines, link and tag text,
separator density and prices. The page is spam if one of these passes its threshold in most of the page's text.

A page whose language isn't known has no verdict from missing function words: it is examined whole. If it has short words that stand
behind many different ones, as function words do in most languages, short words don't count among its commonest ones, and its thresholds
are stricter.

Sentences made of search words pass as prose by their function words, so pages of few of them are also examined for words that echo each
other. Every page is also examined whole for top words and word sequences, other than function words, and duplicate lines; where it has few
function words, though no stretch is sparse, these make it spam too. Prose with its full share of function words may be repeated. What
spoke against a page is listed in `reasons`.

Each page is judged by itself in the task that reads it, nothing is shuffled, and copies are judged alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Function words by language.
FUNCTION_WORDS = {
    "hu": "a az és vagy is nem hogy egy ha e ez azt ezt mert mivel úgy valamint illetve továbbá ideértve szerint szerinti alapján vonatkozó amely amelyben amelynek olyan kell lehet kivéve feltéve amennyiben során között által után előtt alatt belül ellen helyébe következő szerinti köteles lép bekezdés bekezdése bekezdésében",
    "en": "the of and or to in a an any is it its by for not be shall may must within under where after before with that this on at from as which doesn't isn't it's otherwise",
    "de": "der die das des dem den und oder in im ist nicht von zu zum zur mit nach bei auf für ein eine einer wenn weil dass durch wird werden kann muss binnen unverzüglich schriftlich",
    "fr": "le la les l' de du des d' un une et ou à au aux en dans par pour sur sous avec sans est sont être été a ont ne que qui dont ce cette ces il elle ils se sa son ses leur si lorsque selon",
    "es": "el la los las de del un una y o e a al en por para con sin sobre es son ser fue no que se su sus lo como si cuando este esta estos estas ha han según entre más",
    "it": "il lo la i gli le di del della dei delle dell' un una e o a al alla ai in nel nella per con su da dal dalla è sono essere non che si suo sua se come quando questo questa ha hanno tra",
    "pt": "o a os as de do da dos das um uma e ou em no na nos nas por para com sem sobre é são ser foi não que se seu sua ao à pelo pela como quando este esta entre mais",
    "nl": "de het een en of van in op te aan met voor door bij is zijn wordt worden niet dat die deze dit als om uit naar ook er indien na over tot binnen heeft",
    "pl": "i w we z ze na do od o u po za dla przez przy nie jest są być się że który która które lub albo oraz a ale jeżeli jeśli to tego tej tym jak może nad pod",
    "cs": "a i v ve z ze na do od o u po za pro při s se si je jsou být není že který která které nebo ale jestliže pokud to tohoto této jak může podle nad pod k ke sa nie sú že ktorý ktorá alebo ak podľa pri",
    "ro": "de la în a al ale și sau cu din pe pentru prin este sunt fi nu că care se un o unei unui cel cea cei dacă după prin între până nr lor lui sa său",
    "hr": "i u na za od do iz s sa o po pri kod je su biti nije da koji koja koje ili a ali ako se to ovaj ovog ove kao može prema nad pod li te",
    "sv": "och i att en ett den det de som på för av med till är var inte om eller från vid under efter har kan ska skall inom enligt og at er et til ikke eller fra ved",
}
#: Letters that tell one of these languages from all others, for texts of few function words.
TELLING_LETTERS = {"hu": "őűŐŰ", "de": "ß", "pl": "łŁąĄęĘ", "ro": "țȚțșȘţŢ", "cs": "ěĚřŘů", "pt": "ãÃ", "es": "ñÑ¿¡"}


class Limits(NamedTuple):
    """Thresholds of one language; shares are of the words or characters of the sparse stretches."""

    #: Function words per word, below which a stretch is sparse.
    function_words: float
    #: Share of the five commonest words, and of the sequences of two, three and four words that recur.
    top_words: float = 0.30
    word_pairs: float = 0.35
    word_triples: float = 0.35
    word_fours: float = 0.35
    duplicate_lines: float = 0.50
    #: Link text and tags per character.
    links: float = 0.30
    tags: float = 0.30
    #: Separators per word, where items are short.
    separators: float = 0.16
    #: Prices per word.
    offers: float = 0.04
    #: Words, other than function words, that stand among the three such words before, of a whole page.
    echoes: float = 0.22
    #: Of a whole page with few function words: share of the five commonest of the other words, where pairs recur by word_pairs too, and
    #: that of the pairs alone. Short honest pages of few subjects come to 0.63 and 0.26.
    page_top_words: float = 0.60
    page_word_pairs: float = 0.90


#: Made by calibrate() of the documents at scale 0.1 for Hungarian, English and German; others have no pages there and keep the defaults.
LIMITS = {"hu": Limits(0.09), "en": Limits(0.17), "de": Limits(0.15)} | {k: Limits(0.12) for k in FUNCTION_WORDS if k not in ("hu", "en", "de")}
#: Of pages whose language isn't known: honest prose of other languages comes to 0.15 separators a word and 0.2 of long top words.
NOT_HELD = Limits(0.0)
UNKNOWN = Limits(0.0, top_words=0.33, word_pairs=0.45, word_triples=0.40, word_fours=0.40, separators=0.25)
#: Short words that stand behind different ones, per word, from which a text of an unknown language may be prose.
HELD = 0.03
#: Function words per word that tell a language, and how long a word must be to count among the top ones of an unknown language.
TOLD = 0.10
LONG_WORD = 4
#: Words around each word that count, the share of a page's characters that must be spam, and that from which a closer look is taken.
AROUND = 12
MOST = 0.5
SOME = 0.1
#: How many times the threshold of function words a page may have and still have few of them.
FEW = 3
#: Least length of what can be judged, in words and characters; shorter pages are fragments.
LEAST_WORDS = 8
LEAST_CHARS = 40

_EDGES = ".,;:!?()[]„”\"'«»"
_SETS = {k: frozenset(w.strip(_EDGES) for w in v.split()) for k, v in FUNCTION_WORDS.items()}
_ANY = frozenset().union(*(_SETS[k] for k in ("hu", "en", "de")))
_TELLING = {k: re.compile(f"[{v}]") for k, v in TELLING_LETTERS.items()}
_LINK = re.compile(r"\[url=[^\]\s]*\].*?\[/url\]|<a\s[^>]*>.*?</a>|\[[^\]\n]*\]\([^)\s]*\)|(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,10}(?:[/?]\S*)?(?=[\s,;|]|$)", re.I)
_MARKS = ("http", "www.", "#", "](")
_LINKISH = re.compile(r"https?://|www\.|#\w|\[url|href=|\[?[^\s\]]*\]\(|[\w-]+(?:\.[\w-]+)*\.[a-z]{2,10}(?:[/?]\S*)?$")
#: What stands in any link, and (in small letters) in any price.
_LINK_DOT = re.compile(r"\.[a-z]{2}|www\.", re.I)
_PRICED = ("ft", "huf", "eur", "usd", "uſd", "€", "$")
_TAG = re.compile(r"#[\w-]+")
_PRICE = re.compile(r"\d[\d  .,]*(?:Ft|HUF|EUR|€|\$|USD)\b|[€$]\s?\d|(?:Ft|HUF|EUR|€)(?=\W|$)", re.I)
_SEPARATOR = re.compile(r"[,;|·•»›*/>]|\s[-–—]\s|\n")
#: How items are strung together without a blank, and set apart.
_APART = (("#", " #"), (")[", ") ["), ("><", "> <"), ("|", " | "), (";", "; "))
_WORD = re.compile(r"[^\W_]+")


class Profile(NamedTuple):
    """What a page is like: top_words to offers of its sparse stretches where these are most of it, else of the whole page."""

    language: str
    function_words: float
    sparse: float
    top_words: float
    word_pairs: float
    word_triples: float
    word_fours: float
    duplicate_lines: float
    links: float
    tags: float
    separators: float
    offers: float
    echoes: float
    page_top_words: float
    page_word_pairs: float
    page_duplicate_lines: float
    spam: bool
    reasons: list[str]


#: Of fragments, which aren't examined.
_FRAGMENT = Profile("", *(0.0,) * 15, False, [])


def _language(hits: dict[str, int], words: int, text: str) -> str:
    """The language with most function words or, where these are few, the only one with letters of its own; empty if not known."""
    best = max(hits, key=lambda k: hits[k])
    if hits[best] >= TOLD * words:
        return best
    own = [k for k, letters in _TELLING.items() if letters.search(text)]
    return own[0] if len(own) == 1 else ""


def _held_together(words: list[str]) -> float:
    """Share of the short words that mostly stand behind different words; those of fixed phrases and single ones don't count."""
    behind: dict[str, set[str]] = {}
    times: Counter[str] = Counter()
    for a, w in zip(words, words[1:], strict=False):
        if 0 < len(w) < LONG_WORD and w.isalpha():
            behind.setdefault(w, set()).add(a)
            times[w] += 1
    return sum(n for w, n in times.items() if n > 1 and len(behind[w]) > n / 2) / max(1, len(words))


def _top(counts: Counter[str], words: int) -> float:
    """Share of the five commonest words, of those that occur more than twice."""
    return sum(sorted(k for k in counts.values() if k > 2)[-5:]) / max(1, words)


def _recurring(words: list[str], n: int) -> float:
    """Share of the words' sequences of n that occur more than twice."""
    found = Counter(zip(*(words[i:] for i in range(n)), strict=False))
    if len(found) >= len(words) - n:  # at most one sequence occurs again, and only once
        return 0.0
    return sum(k for k in found.values() if k > 2) / max(1, len(words))


def _stretches(words: list[str], flags: np.ndarray, least: float) -> np.ndarray:
    """Which words lie in a sparse stretch."""
    n = len(words)
    sums = np.r_[0, np.cumsum(flags)]
    at = np.arange(n)
    lo, hi = np.maximum(0, at - AROUND), np.minimum(n, at + AROUND + 1)
    return (sums[hi] - sums[lo]) < least * (hi - lo)


def spelled_words(lowered: str) -> list[str]:
    """Words that aren't numbers."""
    return [w for w in _WORD.findall(lowered) if not w.isdigit()]


def evidence(text: str, words: list[str] | None = None, least: int = 1) -> tuple[float, float, float, float, float, float, float, float, float]:
    """top_words, word_pairs, word_triples, word_fours, duplicate_lines, links, tags, separators, offers of a stretch of text, whose words
    may be given. Among the top words count those of at least `least` characters."""
    size = max(1, len(text.strip()))
    linked = "[" in text or "<" in text or "://" in text or _LINK_DOT.search(text)
    links = _LINK.findall(text) if linked else []
    tags = _TAG.findall(text)
    bare = _LINK.sub(" ", text) if links else text
    lowered = bare.lower()
    spelled = spelled_words(lowered) if words is None or links else words
    n = max(1, len(spelled))
    counts = Counter(w for w in spelled if len(w) >= least)
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    top = _top(counts, n)
    again = _recurring(spelled, 2)
    # Longer sequences recur only where pairs do.
    longer = (_recurring(spelled, 3), _recurring(spelled, 4)) if again else (0.0, 0.0)
    doubled = 1 - len(set(lines)) / len(lines) if len(lines) > 3 else 0.0
    separators = len(_SEPARATOR.findall(bare)) / n
    return top, again, *longer, doubled, sum(map(len, links)) / size, sum(map(len, tags)) / size, separators, (len(_PRICE.findall(bare)) if any(x in lowered for x in _PRICED) else 0) / n


def echoes(words: list[str]) -> float:
    """Share of the words, without function words and numbers, that are one of the three before."""
    kept = [w for w in (x.strip(_EDGES) for x in words) if w and w not in _ANY and not w[0].isdigit()]
    return sum(w in kept[max(0, i - 3) : i] for i, w in enumerate(kept)) / len(kept) if len(kept) > 3 else 0.0


def whole_page(text: str, words: list[str]) -> tuple[float, float, float]:
    """page_top_words, page_word_pairs, page_duplicate_lines."""
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    words = [w for w in words if w not in _ANY]
    return _top(Counter(words), len(words)), _recurring(words, 2), 1 - len(set(lines)) / len(lines) if len(lines) > 3 else 0.0


def profile(text: str | None) -> Profile:
    """A page's language, sparse share, evidence and verdict."""
    if text is None or len(text) < LEAST_CHARS or text.isspace():
        return _FRAGMENT
    for joint, apart in _APART:
        text = text.replace(joint, apart)
    lowered = text.lower().split()
    bare = [w.strip(_EDGES) for w in lowered]
    counts = Counter(bare)
    hits = {k: sum(map(counts.__getitem__, s & counts.keys())) for k, s in _SETS.items()}
    language = _language(hits, len(lowered), text)
    held = bool(language) or _held_together(bare) >= HELD
    limits = LIMITS[language] if language else UNKNOWN if held else NOT_HELD
    # Pages may change their language, so the words of every one that has a share count.
    own = frozenset().union(*(_SETS[k] for k, n in hits.items() if k == language or n >= TOLD * len(lowered)))
    own = own | _ANY if language in ("hu", "en", "de") else own
    found = np.fromiter(map(own.__contains__, bare), dtype=bool, count=len(lowered))
    chars = np.fromiter(map(len, lowered), dtype=np.int64, count=len(lowered))
    density = float(found.mean())
    sparse = _stretches(lowered, found, limits.function_words) if language else np.ones(len(lowered), dtype=bool)
    share = float(chars[sparse].sum() / chars.sum())
    if share <= MOST and (share > SOME or any(x in text for x in _MARKS)):
        # Links and tags are no prose even right beside a sentence, where the words around them are many.
        sparse |= np.fromiter((_LINKISH.match(w) is not None for w in lowered), dtype=bool, count=len(lowered))
        share = float(chars[sparse].sum() / chars.sum())
    few = bool(language) and density < FEW * limits.function_words and len(lowered) >= LEAST_WORDS
    words = spelled_words(text.lower())
    page = whole_page(text, words)
    echo = echoes(lowered) if few or not language else 0.0
    reasons = []
    if few:
        reasons += [k for k, v in (("page_top_words", page[0] > limits.page_top_words and page[1] > limits.word_pairs), ("page_word_pairs", page[1] > limits.page_word_pairs), ("page_duplicate_lines", page[2] > limits.duplicate_lines)) if v]
        if echo > limits.echoes:
            reasons.append("echoes")
    if share <= MOST:
        return Profile(language, density, share, *evidence(text, words), echo, *page, bool(reasons), reasons)
    got = evidence(_sparse_text(text, sparse), None, 1 if language or not held else LONG_WORD)
    linked = got[5] > limits.links or got[6] > limits.tags
    if len(lowered) >= LEAST_WORDS or linked:
        reasons = [k for k, v in zip(EVIDENCE, got, strict=True) if v > getattr(limits, k)] + reasons
    return Profile(language, density, share, *got, echo, *page, bool(reasons), reasons)


def _sparse_text(text: str, sparse: np.ndarray) -> str:
    """The sparse words with what stands between them."""
    out = []
    for m, s in zip(re.finditer(r"\S+\s*", text), sparse, strict=False):
        if s:
            out.append(m[0])
    return "".join(out)


EVIDENCE = ("top_words", "word_pairs", "word_triples", "word_fours", "duplicate_lines", "links", "tags", "separators", "offers")
PROFILE_SCHEMA = "doc_id bigint, language string, function_words double, sparse double, top_words double, word_pairs double, word_triples double, word_fours double, duplicate_lines double, links double, tags double, separators double, offers double, echoes double, page_top_words double, page_word_pairs double, page_duplicate_lines double, spam boolean, reasons array<string>"


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in PROFILE_SCHEMA.split(", ")]
    types = [pa.string(), *[pa.float64()] * 15, pa.bool_(), pa.list_(pa.string())]
    for batch in batches:
        rows = [profile(t) for t in batch.column(1).to_pylist()]
        columns = list(zip(*rows, strict=True)) or [()] * len(types)
        yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id and PROFILE_SCHEMA of every document; the evidence is 0 only where there is none, and of fragments.

    Defined cases: null, empty, blank and very short texts are no spam; repeated rows are judged alike; texts are judged whole, however
    long; extra columns are not read; an empty table gives none.
    """
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_run, PROFILE_SCHEMA)


def spam_pages(docs: DataFrame) -> DataFrame:
    """doc_id of every keyword-stuffed or link-list page."""
    return profiles(docs).where("spam").select("doc_id")


def calibrate(pages: DataFrame, sample_quantile: float = 0.01) -> DataFrame:
    """Per language: pages, the threshold of function words that its honest pages ask for (under half of what nearly all of them have), and
    the least page_top_words and page_word_pairs that nearly none of them reaches. pages: rows of profiles(), all of them."""
    honest = pages.where("NOT spam AND language <> ''")
    low = F.percentile_approx("function_words", sample_quantile, 10_000)
    high = lambda c: F.percentile_approx(c, 1 - sample_quantile / 10, 10_000)
    return honest.groupBy("language").agg(F.count("*").alias("pages"), F.round(low * 0.45, 2).alias("function_words"), high("page_top_words").alias("page_top_words"), high("page_word_pairs").alias("page_word_pairs"))
