from opsmetrics.llm.queries import URL_RULES
from opsmetrics.llm.url_filter import SOFT_TERMS, STRICT_TERMS, RuleSet, Vocabulary, forms, judge_urls, split_url


def judged(spark, urls):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 AS id", "'x' AS host")
    return [tuple(r)[1:5] for r in judge_urls(df, URL_RULES).orderBy("id").collect()]


def test_split():
    assert split_url("https://A.Com/P?q=http://x/") == ("a.com", "/P")
    assert split_url("x://HÉ.com#f") == ("hÉ.com", "")
    assert split_url("no scheme/com/") == split_url(None) == split_url("") == ("", "")
    assert split_url("a://b://c/d") == ("b:", "//c/d")


def test_rules(spark):
    assert judged(spark, [
        "http://example.com/en/1", "http://www.example.com/en/casino", "http://m.example.com/en/", "http://example.com/en",
        "http://example.com", "http://badexample.com/en/", "http://a.net/es/x", "http://net/fr/", "http://a.net/de/", None,
    ]) == [
        ("example.com", "/en/1", "example.com/en/", "block"), ("www.example.com", "/en/casino", "www.example.com/en/", "allow"),
        ("m.example.com", "/en/", "example.com/en/", "block"), ("example.com", "/en", "com/", "allow"),
        ("example.com", "", None, "allow"), ("badexample.com", "/en/", "com/", "allow"), ("a.net", "/es/x", "net/es/", "block"),
        ("net", "/fr/", "net/fr/", "block"), ("a.net", "/de/", None, "allow"), ("", "", None, "allow")]


def test_vocabulary_boundaries_and_weights(spark):
    words = Vocabulary(("casino",), ("bet", "free", "free-bet"))
    assert words.count("my-CASINO.org") == (1, 0, 0)
    assert words.count("casinos.org/alphabet/bets") == (0, 0, 0)
    assert words.count("free-bet/free") == (0, 4, 3)
    assert Vocabulary((), ()).count("x") == (0, 0, 0)
    assert [v for *_, v in judged(spark, [
        "http://casino.org", "http://a.org/free", "http://a.org/free/free", "http://a.org/free?x=bet", "http://a.org/free/bet",
        "http://a.org/" + "x" * 100_000 + "/porn"])] == ["block", "allow", "allow", "allow", "block", "block"]


def test_longest_rule_is_by_host_and_path():
    assert RuleSet(()).longest("a.com", "/") is None


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert judge_urls(df, URL_RULES).count() == 0


def test_forms_and_languages():
    assert forms("lottery", "en") == ("lottery", "lotteries") and forms("jeu", "fr") == ("jeu", "jeux")
    assert forms("wette", "de") == ("wette", "wetten") and forms("ganador", "es") == ("ganador", "ganadores")
    words = Vocabulary(STRICT_TERMS, SOFT_TERMS)
    assert not set(STRICT_TERMS) & set(SOFT_TERMS)
    assert words.count("bets.org/bet/winner")[2] == 2  # two terms, three hits
    assert words.count("x.de/wetten/gewinn")[2] == 2 and words.count("x.fr/jeux/loterie")[2] == 2 and words.count("x.es/apuestas/premios")[2] == 2


def test_honest_urls_are_left_alone():
    """URLs that share letters or single words with the vocabulary."""
    words = Vocabulary(STRICT_TERMS, SOFT_TERMS)
    honest = [
        "www.essex.gov.uk/adult-education", "sussex.ac.uk/course/analysis", "shop.example.org/track/x", "en.wikipedia.org/wiki/Poker",
        "therapist.example.org/free", "docs.example.org/download/latest", "www.expertsexchange.com/", "news.example.org/winter/alphabet",
        "bank.example.de/kredit", "biblio.example.fr/jeu", "museo.example.es/gratis", "gnu.org/software/free-software",
        "postal.example.org/tracking/123", "cassino.example.it/", "farmland.example.org/cheapside", "betty.example.org/slotted/spoon"]
    for url in honest:
        strict, _, distinct = words.count(url)
        assert not strict and distinct < 2, url
