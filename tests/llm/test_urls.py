import re

import pytest

from folio.llm import urls as U
from folio.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare

URLS = [
    "http://WWW.Example.com/en/a", "https://x.example.com/en/", "http://example.com/en", "http://notexample.com/en/x", "http://a.net/es/q?x=1#y", "http://a.net/est",
    "http://net/fr/", "http://com/", "http://com", "no scheme", "", None, "a://b://c/d", "http://h.org/p/?q#f", "http://h.org/p?q", "http://www.h.org/p//?q", "http://\u00c9.org/ \nx", "http://h.org#x/y",
    "http://me:pw@H.org:80/p/", "https://h.org:443/p?q", "https://h.org:80/p?q", "http://h.org./a/./b/../c%2fd?x=%aZ%3d", "http://h.org/..", "http://h.org/a/b/..", "http://h.org:", "ftp://h.org:80/.x/%", "http://h.org/a//../b",
]


def parts(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    m = re.match(r"(?s)[^?#]*(\?[^#]*)", rest)
    name, scheme = host.rpartition("@")[2], url.split("://")[0].lower()
    for port in (":", {"http": ":80", "https": ":443"}.get(scheme, ":")) if scheme in ("http", "https") else ():
        name = name.removesuffix(port)
    name = name.removesuffix(".")
    upper = lambda x: re.sub("%[0-9A-Fa-f]{2}", lambda e: e[0].upper(), x)
    out = []
    for x in upper(path).split("/")[1:]:
        if x == "..":
            out = out[:-1]
        elif x != ".":
            out.append(x)
    way = "".join(f"/{x}" for x in out)
    return host, path, (name[4:] if name.startswith("www.") else name) + way.rstrip("/") + upper(m[1] if m else "")


@pytest.mark.parametrize("blocks", [None, 1])
def test_judge(spark, blocks):
    rows = [(i, u, "z") for i, u in enumerate(URLS + URLS[:2])]
    blocked = ["https://h.org/p/?q", "http://com/", "https://a://b", None, "http://other/"] + [f"http://x{i}.org" for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = {r.page_id: tuple(r) for r in U.judge(df, spark.createDataFrame([(u,) for u in blocked], "url string"), U.RULES, blocks).collect()}
    names = {parts(u)[2] for u in blocked} - {None}
    for i, u, _ in rows:
        host, path, canon = parts(u)
        fit = [r for r in U.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule = max(fit, key=len, default=None)
        verdict = U.RULES[rule] if rule else "block" if canon in names else "allow"
        assert got[i] == (i, host, path, rule, verdict, canon in names), u
    none = spark.createDataFrame([], "url string")
    assert {r.verdict for r in U.judge(df, none, {}).collect()} == {"allow"} and U.judge(df.limit(0), none, U.RULES).count() == 0


def test_filter_has_no_false_negative_and_few_false_positives(spark):
    t = spark.range(4000).selectExpr("concat('http://h', id, '.org/') as url")
    rows = spark.range(20000).selectExpr("id as page_id", "concat('http://h', id, '.org/') as url")
    out = U.judge(rows, t, {})
    assert out.where("listed").count() == 4000
    b = U.bloom(t.select(U.canonical(t.url).alias("canonical")), 128)
    assert b.count() <= 128


def test_sql(spark):
    assert compare(spark, "op6_urls", "/root/testdata/sf0.01", QUERIES, ORACLE_SQL) == 250


def test_no_python_in_plan(spark):
    plan = QUERIES["op6_urls"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
