"""Listed URLs in any spelling, and false positives of the filter, against brute force."""

import random
import re

import duckdb
from boxloom.llm import urls
from pyspark.sql import functions as F
from tests.conftest import SF


def plain(host):
    return re.sub(r"\.+$", "", re.sub(r":[0-9]*$", "", re.sub(r"^.*@", "", host.lower())))


def brute(url, listed):
    if url is None or "://" not in url:
        return False
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    host, path = plain(host), path.strip("/")
    for x in listed:
        x = re.sub(r"[?#].*$", "", re.sub(r"^[^/?#]*://", "", x or ""))
        h, _, p = x.partition("/")
        h, p = plain(h), p.strip("/")
        if h and host and (not p and (host == h or host.endswith(f".{h}")) or p and host == h and (path == p or path.startswith(f"{p}/"))):
            return True
    return False


def test_spellings(spark):
    listed = ["HTTP://Bad.COM:80/", "https://user@good.com/A/b/?q#f", "plain.com", "x.com/one//", None, "", "/nohost", "dot.com./p"]
    pages = [
        "http://bad.com/x", "https://a.BAD.com:8080/?y", "http://me@bad.com", "http://bad.com./", "http://notbad.com/", "http://good.com/A/b", "http://good.com/A/b/c/d.html", "http://good.com/A/bc", "http://good.com/a/b", "http://sub.good.com/A/b",
        "ftp://plain.com", "http://x.com/one", "http://x.com/one/two", "http://x.com/", "http://x.com/?u=http://bad.com/", "http:///nohost", "://", None, "none", "http://dot.com/p#z", "http://[::1]:80/a",
    ]
    d = spark.createDataFrame(list(enumerate(pages)), "page_id int, url string")
    got = urls.judge_urls(d, spark.createDataFrame([(x,) for x in listed], "url string"), rules=()).collect()
    assert {r.url: r.u_verdict == "block" for r in got} == {u: brute(u, listed) for u in pages} and len(got) == len(pages)


def test_false_positives_of_the_filter_go(spark, monkeypatch):
    """A filter far too small lets many lookups pass; the exact join removes all that aren't listed."""
    monkeypatch.setattr(urls, "BITS_PER_KEY", 1)
    rng = random.Random(1)
    listed = [f"h{i}.com/" if i % 2 else f"h{i}.com/p{i}" for i in range(2000)]
    pages = [f"http://{rng.choice(['', 'a.'])}h{rng.randint(0, 6000)}.com/p{rng.randint(0, 99)}/x" for _ in range(500)] + [f"http://h{i}.com/p{i}/y" for i in range(0, 2000, 50)]
    d = spark.createDataFrame(list(enumerate(pages)), "page_id int, url string")
    keys = spark.createDataFrame([(x,) for x in listed], "url string")
    got = urls.judge_urls(d, keys, rules=()).collect()
    of = set(listed)

    def fits(url):
        host, path, _ = url.split("://")[1].split("/", 2)
        return bool({f"{host}/", f"{host.removeprefix('a.')}/", f"{host}/{path}"} & of)

    assert all((r.u_verdict == "block") == fits(r.url) for r in got) and any(r.u_verdict == "block" for r in got)
    blocks = -(-len(listed) // urls.BLOCK_BITS)
    asked = spark.range(3000).select(F.concat(F.lit("no"), "id", F.lit(".com/")).alias("key"))
    passed = asked.select("key", *urls._probes(F.col("key"), blocks)).join(urls.bloom(keys.select(F.col("url").alias("key")), "key", blocks), "block")
    assert passed.where("forall(bits, b -> coalesce(shiftright(words[b div 64], cast(b % 64 as int)) & 1L, 0L) = 1L)").count() > 100


def test_against_sql(spark):
    got = sorted(map(tuple, urls.op9_urls(spark, SF).collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert got == sorted(con.execute(urls.ORACLE).fetchall(), key=repr)
    bad = con.execute("SELECT count(*) FROM pages WHERE regexp_matches(url, '(spam-farm|cheap-pills|casino-win|free-bets|adult-x|ads-track)\\.example\\.(com|net|org)')").fetchone()[0]
    assert sum(r[4] == "block" or r[3] is not None for r in got) >= bad > 0
