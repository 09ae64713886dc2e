import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from nearsieve.llm import url_filter


def parts(url):
    rest = (url or "").partition("://")[2]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    best = (None, None)
    for say, text in url_filter.RULES:
        own, _, start = text.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + start) and len(text) > len(best[0] or ""):
            best = (text, say)
    return best


def grams(url):
    t = "^^^^" + url + "$"
    return [t[i : i + 5] for i in range(len(t) - 4)]


def models(train):
    """gram -> score, by direct recursion over the counts of both classes."""
    n = {c: defaultdict(Counter) for c in ("allow", "block")}
    for url, c in train:
        for g in grams(url):
            for k in range(5):
                n[c][g[4 - k : 4]][g[4]] += 1

    def p(c, ctx, ch):
        low = 1 / 256 if not ctx else p(c, ctx[1:], ch)
        own = n[c].get(ctx)
        return (own[ch] + len(own) * low) / (sum(own.values()) + len(own)) if own else low

    return lambda g: round((math.log(p("allow", g[:4], g[4])) - math.log(p("block", g[:4], g[4]))) * url_filter.UNIT)


def test_judgements_equal_brute_force(spark):
    urls = [None, "", "nothing", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en/", "http://example.com/de/1", "http://a.b.net/es/", "http://net/fr/x", "http://com", "http://xcom/", "ftp://u@h:80#f", "http://É.org/ü", "http://x.org/" + "ab/" * 3000]
    urls += [f"http://site{i % 7}.example.com/{'en' if i % 2 else 'de'}/page{i}" for i in range(60)] + [f"https://w{i}.net/{'es' if i % 3 else 'it'}/{i}" for i in range(60)] + [f"http://o{i}.org/en/{i}" for i in range(30)]
    rows = [(i, u) for i, u in enumerate(urls)] + [(0, urls[20]), (None, urls[20])]
    table = spark.createDataFrame([(i, u, "h", 1.0) for i, u in rows], "page_id long, url string, host string, score double")
    found = url_filter.judge(table).collect()
    assert len(found) == len(rows)
    distinct = sorted({u or "" for _, u in rows})
    folds = {r.url: r.f for r in spark.createDataFrame([(u,) for u in distinct], "url string").select("url", F.pmod(F.xxhash64("url"), F.lit(5)).alias("f")).collect()}
    said = {u: rule(*parts(u))[1] for u in distinct}
    score = models([(u, said[u]) for u in distinct if said[u] and folds[u] != 0])
    total = {u: math.floor(sum(map(score, grams(u))) / len(grams(u))) for u in distinct}
    bins = defaultdict(lambda: [0, 0])
    for u in distinct:
        if said[u] and folds[u] == 0:
            bins[max(-8000, min(8000, math.floor(total[u] / 1000)))][said[u] == "block"] += 1
    cut = url_filter.calibrate([(b, *v) for b, v in bins.items()]) * 1000
    want = []
    for i, u in rows:
        host, path = parts(u)
        text, say = rule(host, path)
        want.append((i, host, path, text, say or ("allow" if total[u or ""] >= cut else "block")))
    assert sorted((tuple(r)[:5] for r in found), key=str) == sorted(want, key=str)
    assert {(r.page_id, r.host, round(r.score * url_filter.UNIT)) for r in found} == {(i, parts(u)[0], total[u or ""]) for i, u in rows}


def test_without_examples_and_rows(spark):
    table = spark.createDataFrame([(1, "http://a.org/"), (2, None)], "page_id long, url string")
    assert {(r.page_id, r.verdict, r.score) for r in url_filter.judge(table).collect()} == {(1, "allow", 0.0), (2, "allow", 0.0)}
    assert url_filter.judge(table.limit(0)).count() == 0
    assert url_filter.calibrate([(5, 3, 0), (-5, 0, 3)]) in range(-4, 6)


def test_plan_has_no_python(spark):
    table = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    assert not re.search("Python|Pandas|InArrow", url_filter.judge(table)._jdf.queryExecution().executedPlan().toString())
