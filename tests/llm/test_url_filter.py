import random
import re

from helixbench.llm import url_filter
from helixbench.llm.url_filter import Rule


def plain_match(rules, canonical):
    best = -1
    for i, rule in enumerate(rules):
        host, slash, path = rule.glob.partition("/")
        part = lambda s, star: "".join(star if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in s)
        pattern = "[^/]*" + re.escape(".") + part(host, "[^/]*") + part(slash + path, ".*") + ".*"
        if re.fullmatch(pattern, canonical, re.S) and (best < 0 or len(rule.glob) > len(rules[best].glob)):
            best = i
    return best


def test_automaton_against_regular_expressions():
    rng = random.Random(1)
    for _ in range(40):
        rules = [Rule("block", "".join(rng.choice("ab.*?") for _ in range(rng.randrange(1, 9))) + rng.choice(["", "/", "/a", "/*b", "/?a*"])) for _ in range(rng.randrange(1, 30))]
        urls = ["." + "".join(rng.choice("ab.") for _ in range(rng.randrange(9))) + rng.choice(["", "/", "/ab", "/b/a.b", "/" + "ab" * 40]) for _ in range(60)]
        got = url_filter.match(url_filter.compile_rules(rules), [u.encode() for u in urls])
        assert got.tolist() == [plain_match(rules, u) for u in urls]


def test_contract_cases(spark):
    rules = [Rule("allow", "com/"), Rule("block", "example.com/en/"), Rule("allow", "www.example.com/en/"), Rule("block", "net/es/")]
    cases = {
        "http://EXAMPLE.com/en/x?q#f": ("example.com", "/en/x", "example.com/en/", "block"),
        "https://a.www.example.com/en/": ("a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://badexample.com/en/x": ("badexample.com", "/en/x", "com/", "allow"),
        "http://example.com": ("example.com", "", None, "allow"),
        "http://example.com?x=/en/": ("example.com", "", None, "allow"),
        "http://x.net:80/es/": ("x.net:80", "/es/", None, "allow"),
        "http://x.net/es/a://b": ("x.net", "/es/a://b", "net/es/", "block"),
        "http://ads-x.org/": ("ads-x.org", "/", None, "block"),
        "http://ÄB.com/Ä": ("Äb.com", "/Ä", "com/", "allow"),
        "no scheme.com/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "http://y.com/" + "p" * 5000 + "\nq": ("y.com", "/" + "p" * 5000 + "\nq", "com/", "allow"),
    }
    rows = [(i, u, "x", "y") for i, u in enumerate([*cases, None, "http://example.com"])]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.url_filter(df, ["page_id"], rules, [Rule("block", "ads-*")]).collect()}
    assert got == {**dict(enumerate(cases.values())), len(cases): ("", "", None, "allow"), len(cases) + 1: cases["http://example.com"]}
    assert url_filter.url_filter(df.limit(0), ["page_id"], rules).count() == 0
    assert {r.verdict for r in url_filter.url_filter(df, ["page_id"], []).collect()} == {"allow"}
