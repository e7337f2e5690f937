import random
import re

from tickweave.llm.url_filters import GLOB_RULES, HOST_RULES, ShiftAnd, judge_urls


def as_regex(glob):
    out = ""
    i = 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + r"[\s\S]*", i + 2
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i]))
        i += 1
    return re.compile(out)


def test_automaton_against_regexes():
    rnd = random.Random(5)
    globs = ["".join(rnd.choice(["a", "b", "/", "*", "**", "?", "é"]) for _ in range(rnd.randint(0, 9))) for _ in range(60)]
    urls = ["".join(rnd.choice("ab/éx") for _ in range(rnd.randint(0, 14))) for _ in range(400)]
    fits = ShiftAnd.compile(globs).fits(urls)
    for j, g in enumerate(globs):
        r = as_regex(g)
        for i, u in enumerate(urls):
            assert fits[i, j] == bool(r.fullmatch(u)), (g, u)


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    best = None
    for v, h, p in HOST_RULES:
        if ("." + host).endswith("." + h) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    if best:
        return host, path, best[0], best[1]
    for v, g in GLOB_RULES:
        if as_regex(g).fullmatch("." + host + path):
            return host, path, None, v
    return host, path, None, "allow"


def test_judged_rows(spark):
    urls = [None, "", "no scheme", "://", "http://", "http://com", "http://COM/", "https://www.Example.com/en/1?q=/es/", "http://a.example.com/en/",
            "http://notexample.com/en/x", "http://x.net/es/1", "http://x.net/es", "http://é.net/fr/é#x", "http://spam-farm.org/x", "http://y.org/a/b.exe",
            "http://evil.org/x.example.com/en/", "http://a?b/c", "ftp://a://b.com/", "http://x.com" + "/y" * 40000, "http://İ.COM/"] * 2
    df = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(df).collect()}
    assert got == {i: brute(u) for i, u in enumerate(urls)}


def test_empty_table_and_no_rules(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert judge_urls(df).count() == 0
    one = spark.createDataFrame([(1, "http://x.com/")], "page_id long, url string")
    assert judge_urls(one, host_rules=[], glob_rules=[], default="block").first().verdict == "block"
