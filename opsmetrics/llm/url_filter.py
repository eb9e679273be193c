"""URL filter: host and path rules first, a weighted vocabulary for the rest.

One Aho-Corasick automaton over the vocabulary runs along `host + path`. A hit counts only between
boundaries (no letter or digit next to it). One strict term rejects, and so do `soft_limit`
distinct soft terms.

Defined results: a null URL, or one without `://`, has an empty host and path, fits no rule and
has no hits, so it is allowed. Every row is judged alone, so ties, repeats and order do not
matter; an empty table gives an empty table. Only id and URL are read, so other columns may have
any names. The whole URL is scanned, however long.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from opsmetrics.session import ship_package

# --- fixed values: the default vocabulary, singular forms by language. Strict terms reject alone, soft
# ones, which honest pages use as well, only together.
STRICT = {
    "en": ("casino", "porn", "porno", "pornography", "xxx", "hentai", "camgirl", "escort", "hooker", "nude", "sexcam", "viagra",
           "cialis", "warez", "keygen", "cryptolocker", "phishing", "malware", "spam", "spammer", "sportsbook", "roulette", "blackjack"),
    "fr": ("pornographie", "voyance", "arnaque", "salope", "chatte"),
    "es": ("pornografia", "prostituta", "putas", "tragaperras", "estafa"),
    "de": ("pornografie", "spielbank", "spielothek", "hure", "nutte", "abzocke"),
}
SOFT = {
    "en": ("ad", "adserver", "adult", "affiliate", "banner", "bet", "betting", "bonus", "bingo", "cash", "cheap", "clickbait", "coupon",
           "crack", "cracked", "dating", "deal", "discount", "download", "erotic", "fetish", "free", "gambling", "giveaway", "hacked",
           "hot", "jackpot", "lottery", "loan", "mature", "milf", "payday", "pharmacy", "pill", "pirate", "poker", "popunder", "popup",
           "prize", "replica", "serial", "sex", "sexy", "singles", "slot", "sweepstake", "torrent", "tracker", "tracking",
           "weightloss", "win", "winner"),
    "fr": ("pari", "gratuit", "gratuite", "jeu", "loterie", "gagnant", "sexe", "coquin", "rencontre", "credit", "telechargement",
           "pilule", "promo", "pub", "sexy"),
    "es": ("apuesta", "gratis", "loteria", "premio", "ganador", "sexo", "caliente", "cita", "prestamo", "descarga", "pastilla",
           "oferta", "barato", "farmacia"),
    "de": ("wette", "gratis", "kostenlos", "lotterie", "gewinn", "gewinner", "erotik", "kontakt", "kredit", "pille", "billig",
           "werbung", "rabatt", "gutschein"),
}


def forms(term: str, language: str) -> tuple[str, ...]:
    """A term and its regular plural."""
    if language == "en":
        ending = "es" if term.endswith(("s", "x", "z", "ch", "sh")) else "s"
        plural = term[:-1] + "ies" if term.endswith("y") and term[-2] not in "aeiou" else term + ending
    elif language == "es":
        plural = term + ("s" if term[-1] in "aeiou" else "es")
    elif language == "fr":
        plural = term if term[-1] in "sxz" else term + ("x" if term.endswith(("eu", "eau")) else "s")
    else:
        plural = term + ("n" if term.endswith("e") else "en")
    return (term, plural)


def all_forms(terms: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """Every form of the terms with the term it counts as."""
    return {f: t for language, some in terms.items() for t in some for f in forms(t, language)}


STRICT_TERMS, SOFT_TERMS = all_forms(STRICT), all_forms(SOFT)
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

Terms = Mapping[str, str] | Sequence[str]

VERDICT = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("host", T.StringType()),
    T.StructField("path", T.StringType()), T.StructField("rule", T.StringType()),
    T.StructField("verdict", T.StringType()), T.StructField("strict_hits", T.LongType()),
    T.StructField("soft_hits", T.LongType()), T.StructField("distinct_soft", T.IntegerType()),
])


@dataclass(frozen=True)
class Rule:
    """`target` is `host/path...`; it fits the host, its subdomains, and paths that start alike."""

    action: str
    target: str

    @property
    def host(self) -> str:
        return self.target.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.target.partition("/")[2]


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host after the first `://` with A-Z lower-cased, path up to `?` or `#`."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    ends = [i for i in (rest.find(c) for c in "?#") if i >= 0]
    rest = rest[:min(ends)] if ends else rest
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


class RuleSet:
    """Rules by host, so that a URL looks up its own host suffixes only."""

    def __init__(self, rules: Iterable[Rule]):
        self._by_host: dict[str, list[Rule]] = {}
        for r in rules:
            self._by_host.setdefault(r.host, []).append(r)

    def longest(self, host: str, path: str) -> Rule | None:
        best, at = None, 0
        while host and at >= 0:
            for r in self._by_host.get(host[at:], ()):
                if path.startswith(r.path) and (best is None or len(r.target) > len(best.target)):
                    best = r
            dot = host.find(".", at)
            at = dot + 1 if dot >= 0 else -1
        return best


class Vocabulary:
    """Strict and soft terms in one automaton. Either is a sequence of terms or a mapping of forms to
    terms; forms of one term count as one where distinct terms are counted."""

    def __init__(self, strict: Terms, soft: Terms):
        self._found = ahocorasick.Automaton()
        for weight, terms in ((0, soft), (1, strict)):
            for form, term in (terms.items() if isinstance(terms, Mapping) else ((t, t) for t in terms)):
                self._found.add_word(form.lower(), (form.lower(), term.lower(), weight))
        self._any = len(self._found) > 0
        if self._any:
            self._found.make_automaton()

    def count(self, text: str) -> tuple[int, int, int]:
        """(strict hits, soft hits, distinct soft terms), each between boundaries."""
        if not self._any:
            return 0, 0, 0
        text, strict, soft, distinct = text.lower(), 0, 0, set()
        for end, (form, term, weight) in self._found.iter(text):
            start = end + 1 - len(form)
            if (start and text[start - 1].isalnum()) or text[end + 1:end + 2].isalnum():
                continue
            if weight:
                strict += 1
            else:
                soft += 1
                distinct.add(term)
        return strict, soft, len(distinct)


def judge_urls(
    urls: DataFrame, rules: Sequence[Rule] = (), strict: Terms = STRICT_TERMS,
    soft: Terms = SOFT_TERMS, soft_limit: int = 2, id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """A row of `VERDICT` per URL: the longest fitting rule decides, else the vocabulary.

    A map over the rows: no shuffle, and each task builds the automaton once.
    """
    ship_package(urls.sparkSession)
    rules = tuple(rules)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ruled, words = RuleSet(rules), Vocabulary(strict, soft)
        for batch in batches:
            out = []
            for i, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                host, path = split_url(url)
                rule = ruled.longest(host, path)
                hard, mild, distinct = words.count(host + path)
                method = "block" if hard or distinct >= soft_limit else "allow"
                out.append((i, host, path, rule.target if rule else None, rule.action if rule else method,
                            hard, mild, distinct))
            columns = list(zip(*out)) if out else [()] * len(VERDICT)
            types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=VERDICT.names)

    narrow = urls.select(urls[id_col].cast("long").alias("id"), urls[url_col].cast("string").alias("url"))
    return narrow.mapInArrow(judge, VERDICT)
