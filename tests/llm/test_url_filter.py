import random
import re

from fringe.llm.url_filter import SOFT, STRICT, judge_urls, vocabulary_hits


def test_rules_and_vocabulary(spark):
    urls = [
        "https://www.Example.COM/en/1", "http://example.com/en/x?q#f", "http://shop.example.com/en/x", "http://example.com/de/", "http://a.net/es/1", "http://net/fr/1", "http://a.net/en/casino", "http://x.org/casinos",
        "http://ads-track.org", "http://x.org/win", "http://notexample.com?x", None, "no scheme.com/en/", "", "://", "http://h/a\nb?c", "HTTP://X.ORG/Casino",
    ]
    df = spark.createDataFrame([(i, u, "h", 0) for i, u in enumerate(urls)], "page_id long, url string, host string, rule int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(df).collect()}
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[1] == ("example.com", "/en/x", "example.com/en/", "block")
    assert got[2] == ("shop.example.com", "/en/x", "example.com/en/", "block")
    assert got[3] == ("example.com", "/de/", "com/", "allow")
    assert got[4][2:] == ("net/es/", "block") and got[5][2:] == ("net/fr/", "block")
    assert got[6] == ("a.net", "/en/casino", None, "block")
    assert got[7] == ("x.org", "/casinos", None, "allow")
    assert got[8] == ("ads-track.org", "", None, "block") and got[9][3] == "allow"
    assert got[10] == ("notexample.com", "", None, "allow")
    assert got[11] == got[12] == got[13] == got[14] == ("", "", None, "allow")
    assert got[15][:2] == ("h", "/a\nb") and got[16][3] == "block"
    assert judge_urls(df.limit(0)).count() == 0


def test_boundaries():
    terms = (("ads", False, 1.0), ("casino", True, 0.0))
    assert vocabulary_hits(["xads ads9 ads", "casinocasino", None, "-casino-casino-", "ads\nads"], terms) == [(0, 1, 1.0), (0, 0, 0.0), (0, 0, 0.0), (1, 0, 0.0), (0, 1, 1.0)]
    assert vocabulary_hits([], terms) == [] and vocabulary_hits(["a"], ()) == [(0, 0, 0.0)]


def test_many_rules_and_terms_give_the_same_as_few(spark):
    """Rules by the plan and by the join, one automaton and many, against each url's rules and terms one by one."""
    rng = random.Random(6)
    hosts = ["com", "a.com", "b.a.com", "net", "x.net", "c"]
    rules = [(rng.choice(["allow", "block"]), h, p) for h in hosts for p in ("/", "/en/", "/en/x", "") if rng.random() < 0.6]
    urls = [f"http://{rng.choice(['', 'www.', 'b.', 'za.'])}{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/xy', '/de', '?/en/'])}" for _ in range(300)] + [None, "x", "http://c/" + "y" * 100_000 + "/win-free"]
    urls += [f"http://org/{'-'.join(rng.choice(['win', 'free', 'spam', 'pills', 'casino', 'good', 'windy']) for _ in range(3))}" for _ in range(50)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame(rules + rules, "verdict string, host string, path string")
    words = spark.createDataFrame([(t, True, None) for t in STRICT] + [(t.upper(), False, w) for t, w in SOFT.items()] + [("", True, 1.0), (None, True, 1.0)], "term string, strict boolean, weight double")
    few = sorted(judge_urls(pages, rules=rules).collect())
    assert few == sorted(judge_urls(pages, rules=table, plan_rules=2).collect()) == sorted(judge_urls(pages, rules=rules, vocabulary=words, automaton_chars=9).collect())
    assert {r.verdict for r in few if r.rule is None} == {"allow", "block"}
    for r in few:
        fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for v, h, p in rules if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        assert (r.rule, r.verdict) == max(fits)[3:] if fits else r.rule is None
        if not fits:
            found = {t for t in re.split("[^a-z0-9]+", urls[r.page_id] or "")}
            soft = [w for t, w in SOFT.items() if t in found]
            assert r.verdict == ("block" if found & set(STRICT) or (len(soft) > 1 and sum(soft) >= 2) else "allow")
