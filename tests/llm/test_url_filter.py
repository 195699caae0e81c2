import math
from collections import defaultdict

from textloom.llm import url_filter
from textloom.llm.queries import URL_RULES
from textloom.llm.url_filter import ALPHABET, LAMBDA, ORDER

SCHEMA = "page_id long, url string, html string, host string, path string, score double"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "<p>", "h", "p", 1.0) for i, u in enumerate(urls)], SCHEMA)


URLS = [f"http://{s}.example.{t}/{p}/{n}{q}" for n in range(6, 26) for s in ("a", "Bb") for t, p in (("com", "en"), ("net", "de"), ("org", "es"), ("com", "fr"), ("net", "en")) for q in ("", "?x=1")]
EDGES = [None, "", "no scheme/en/", "http://", "HTTP://EXAMPLE.COM/en/7#f", "://net/de/8", "x://y://z/en/", "http://com/en/", "http://xcom/en/", "http://é.com/en/ü?q", "http://a.com/en/7\nb", "http://example.net/de/8" * 300]


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host_end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    after = rest[host_end:]
    path_end = min((after.find(c) for c in "?#" if c in after), default=len(after))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:host_end])
    return host, after[:path_end]


def rule(host, path):
    found = [r for r in URL_RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(found, key=lambda r: len(r[1] + r[2]), default=None)


def symbols(url):
    rest = url.split("://", 1)[1] if "://" in (url or "") else url or ""
    plain = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest)
    plain = "".join(c if c in ALPHABET and c not in "~$^" else "~" for c in plain)
    return "^" * ORDER + plain + "$" if plain else None


def brute_scores(urls):
    from zlib import crc32

    counts = [defaultdict(int), defaultdict(int)]
    for u in urls:
        r = rule(*split(u))
        s = symbols(u)
        if r and s and crc32(u.encode()) % 5:
            for i in range(ORDER, len(s)):
                for k in range(ORDER + 1):
                    counts[r[0] == "block"][(s[i - k : i], s[i])] += 1
    totals = [defaultdict(int), defaultdict(int)]
    for n in (0, 1):
        for (ctx, _), v in counts[n].items():
            totals[n][ctx] += v
    known = totals[0].keys() | totals[1].keys()

    def p(n, ctx, c):
        lower = 1 / len(ALPHABET) if not ctx else p(n, ctx[1:], c)
        return (counts[n][(ctx, c)] + LAMBDA * lower) / (totals[n][ctx] + LAMBDA)

    out = []
    for u in urls:
        s = symbols(u)
        if not s:
            out.append(0.0)
            continue
        terms = []
        for i in range(ORDER, len(s)):
            ctx = next(s[i - k : i] for k in range(ORDER, -1, -1) if s[i - k : i] in known)
            terms.append(math.log(p(0, ctx, s[i])) - math.log(p(1, ctx, s[i])))
        out.append(sum(terms) / len(terms))
    return out


def test_equals_brute_force(spark):
    urls = URLS + EDGES
    got = {r["page_id"]: r for r in url_filter.judge(pages(spark, urls), URL_RULES).collect()}
    scores = brute_scores(urls)
    free = []
    for i, u in enumerate(urls):
        host, path = split(u)
        found = rule(host, path)
        assert (got[i]["host"], got[i]["path"]) == (host, path), u
        assert got[i]["rule"] == (found and found[1] + found[2]), u
        assert abs(got[i]["score"] - scores[i]) < 1e-9, u
        if found:
            assert got[i]["verdict"] == found[0]
        elif symbols(u):
            free.append((scores[i], got[i]["verdict"]))
        else:
            assert got[i]["verdict"] == "allow"
    # one threshold parts the others
    blocked = [s for s, v in free if v == "block"]
    allowed = [s for s, v in free if v == "allow"]
    assert not blocked or not allowed or max(blocked) < min(allowed)


def test_without_judged_urls(spark):
    got = url_filter.judge(pages(spark, ["http://x.io/a", None, "http://x.io/a"]), URL_RULES).collect()
    assert [r["verdict"] for r in got] == ["allow"] * 3


def test_empty_table(spark):
    assert url_filter.judge(pages(spark, ["x"]).limit(0), URL_RULES).count() == 0
