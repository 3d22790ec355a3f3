"""URL filter against plain Python."""

import re

from jobtext.llm import urlfilter


def slow(url, rules=urlfilter.RULES):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[3:] if fit else (None, "allow")))


URLS = [None, "", "x", "http://", "http://a.org", "http://A.Example.ORG/es/x", "https://example.org/en/1?x", "https://example.org/en/2#/de/", "http://a.com/de/", "http://com/fr/",
        "http://acom/fr/", "http://notexample.org/es/", "http://..org/", "http://example.org:80/es/", "a://b://c.org/", "http://É.org/\n/x", "http://x.org?q=/es/", "HTTP://EXAMPLE.ORG/ES/",
        "http://" + "a." * 30000 + "org/" + "p" * 50000]


def test_matches_plain(spark):
    rows = [(i, u, "h", "r") for i, u in enumerate(URLS)] + [(5, URLS[5], "h", "r"), (None, URLS[6], "h", "r")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string").repartition(3)
    key = lambda r: tuple(map(str, r))
    got = urlfilter.judge(df, urlfilter.rule_table(spark))
    assert sorted(map(tuple, got.collect()), key=key) == sorted([(r[0], *slow(r[1])) for r in rows], key=key)
    more = [("block", "example.org", "/"), ("allow", "example.org", "/"), ("block", "a.example.org", "/es/x"), ("allow", "ü.org", "/é")] * 2
    got = urlfilter.judge(df, urlfilter.rule_table(spark, more))
    assert sorted(map(tuple, got.collect()), key=key) == sorted([(r[0], *slow(r[1], more)) for r in rows], key=key)
    assert urlfilter.judge(df.limit(0), urlfilter.rule_table(spark)).count() == 0
    assert urlfilter.judge(df, urlfilter.rule_table(spark).limit(0)).count() == len(rows)
