"""URL rules and a list of blocked URLs: a blocked Bloom filter, then an exact hash join of what it lets through.

The filter has blocks of eight 64-bit words; a URL's first hash picks the block and its second hash a bit in each word.
It is built by one aggregate (bit_or per block) and broadcast: it has at most MAX_BLOCKS rows of 9 longs, however long
the list is (a longer list only lets more through). URLs that miss it are not listed and are never shuffled; possible
hits are joined with the list itself, which removes false positives. All in DataFrame functions.

A rule is "host/path": it fits its host and all subdomains if the URL's path starts with the rule's path; the longest
wins, and a rule's verdict goes before the list's.

Defined cases: a null URL, or one without "://", has an empty host and path, no rule and no canonical form, and is
allowed; repeated rows are judged each; equal URLs in the list count once; further columns are ignored; empty tables,
and an empty list, give no rows and no listed URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialise, only

MAX_BLOCKS = 1 << 17
LISTED_PER_BLOCK = 32  # 16 bits each
WORDS = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first "://", or null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"(?s)\A[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)\A[^/?#]*([^?#]*)", 1), F.lit(""))


def _escapes(c: Column) -> Column:
    """Percent escapes in upper case."""
    parts = F.regexp_extract_all(c, F.lit(r"%[0-9A-Fa-f]{2}|[^%]+|%"), F.lit(0))
    return F.when(c.contains("%"), F.array_join(F.transform(parts, lambda t: F.when(t.rlike(r"\A%..\z"), F.upper(t)).otherwise(t)), "")).otherwise(c)


def _without_dots(path: Column) -> Column:
    """A path without its segments "." and ".." (RFC 3986, 5.2.4, but for the slash that these leave at the end)."""
    segments = F.split(F.substring(path, 2, F.length(path)), "/", -1)
    fold = F.aggregate(segments, F.lit(""), lambda acc, x: F.when(x == ".", acc).when(x == "..", F.regexp_replace(acc, r"/[^/]*\z", "")).otherwise(F.concat(acc, F.lit("/"), x)))
    return F.when(path.contains("/."), fold).otherwise(path)


def canonical(url: Column) -> Column:
    """Host, path and query in one form; null without "://".

    Host: no user, no default port of http or https, no dot at the end, no leading www. Path: no dot segments, no slashes
    at the end. Escapes are in upper case; scheme and fragment are left out.
    """
    scheme = F.lower(F.substring_index(url, "://", 1))
    name = F.regexp_replace(host(url), r"\A.*@", "")
    port = F.when(scheme == "http", F.regexp_replace(name, r":(?:80)?\z", "")).when(scheme == "https", F.regexp_replace(name, r":(?:443)?\z", "")).otherwise(name)
    name = F.regexp_replace(F.regexp_replace(port, r"\.\z", ""), r"\Awww\.", "")
    query = F.regexp_extract(_rest(url), r"(?s)\A[^?#]*(\?[^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(name, F.regexp_replace(_without_dots(_escapes(path(url))), r"/+\z", ""), _escapes(query)))


def rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null; rules are a parameter of the plan, so a few hundred at most."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=len):
        name, _, rest = r.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.lit(r)).otherwise(out)
    return out


def _bits(url: Column) -> list[Column]:
    h = F.xxhash64(url, F.lit("bit"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7) of the distinct column canonical; only blocks that hold something."""
    rows = listed.select(_block(F.col("canonical"), blocks).alias("block"), *(b.alias(f"b{i}") for i, b in enumerate(_bits(F.col("canonical")))))
    return rows.groupBy("block").agg(*(F.bit_or(f"b{i}").alias(f"w{i}") for i in range(WORDS)))


def judge(pages: DataFrame, listed: DataFrame, rules: dict[str, str], blocks: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of pages (page_id, url); listed: a column url of blocked ones."""
    table = listed.select(canonical(F.col("url")).alias("canonical")).where("canonical is not null").distinct()
    table = materialise(table, "listed")
    if blocks is None:
        blocks = min(MAX_BLOCKS, 1 << max(4, -(-table.count() // LISTED_PER_BLOCK) - 1).bit_length())
    url = F.col("url")
    p = only(pages, "page_id", "url").select("page_id", host(url).alias("host"), path(url).alias("path"), canonical(url).alias("canonical"))
    p = p.withColumn("rule", rule(F.col("host"), F.col("path"), rules))
    p = p.select("*", _block(F.col("canonical"), blocks).alias("block"), *(b.alias(f"b{i}") for i, b in enumerate(_bits(F.col("canonical")))))
    p = p.join(F.broadcast(bloom(table, blocks)), "block", "left")
    maybe = F.lit(True)
    for i in range(WORDS):
        maybe &= F.col(f"w{i}").bitwiseAND(F.col(f"b{i}")) != 0
    p = p.select("page_id", "host", "path", "rule", "canonical", F.coalesce(maybe & F.col("canonical").isNotNull(), F.lit(False)).alias("maybe"))
    hits = p.where("maybe").join(table.withColumn("found", F.lit(True)).hint("shuffle_hash"), "canonical", "left")
    out = hits.withColumn("listed", F.coalesce("found", F.lit(False))).select("page_id", "host", "path", "rule", "listed")
    out = out.unionByName(p.where("not maybe").select("page_id", "host", "path", "rule", F.lit(False).alias("listed")))
    by_rule = F.lit(None).cast("string")
    for r, v in rules.items():
        by_rule = F.when(F.col("rule") == r, F.lit(v)).otherwise(by_rule)
    verdict = F.coalesce(by_rule, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed")


RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}

ORACLE = r"""
WITH u AS (
  SELECT page_id, lower(string_split(url, '://')[1]) AS scheme, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (
  SELECT page_id, scheme, rest, coalesce(translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
n AS (
  SELECT *, regexp_replace(host, '^.*@', '') AS name, list_aggregate(list_transform(regexp_extract_all(path, '%[0-9A-Fa-f]{2}|[^%]+|%'), lambda t: CASE WHEN regexp_matches(t, '^%..$') THEN upper(t) ELSE t END), 'string_agg', '') AS epath,
         list_aggregate(list_transform(regexp_extract_all(regexp_extract(rest, '(?s)^[^?#]*(\?[^#]*)', 1), '%[0-9A-Fa-f]{2}|[^%]+|%'), lambda t: CASE WHEN regexp_matches(t, '^%..$') THEN upper(t) ELSE t END), 'string_agg', '') AS query FROM p),
o AS (
  SELECT *, CASE scheme WHEN 'http' THEN regexp_replace(name, ':(80)?$', '') WHEN 'https' THEN regexp_replace(name, ':(443)?$', '') ELSE name END AS plain,
         CASE WHEN contains(epath, '/.') THEN list_reduce(list_concat([''], string_split(substr(epath, 2), '/')), lambda a, x: CASE x WHEN '.' THEN a WHEN '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || x END) ELSE coalesce(epath, '') END AS npath FROM n),
c AS (
  SELECT *, CASE WHEN rest IS NOT NULL THEN regexp_replace(regexp_replace(plain, '\.$', ''), '^www\.', '') || rtrim(npath, '/') || coalesce(query, '') END AS canonical FROM o),
r(rule, rhost, rpath, verdict) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
best AS (
  SELECT c.*, r.rule, r.verdict, row_number() OVER (PARTITION BY c.page_id ORDER BY length(r.rule) DESC NULLS LAST) AS k
  FROM c LEFT JOIN r ON (c.host = rhost OR suffix(c.host, '.' || rhost)) AND starts_with(c.path, rpath)),
l AS (SELECT DISTINCT canonical FROM c WHERE page_id % 20 = 0 AND canonical IS NOT NULL)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.canonical IS NOT NULL AS listed
FROM best LEFT JOIN l ON best.canonical = l.canonical WHERE k = 1
"""
