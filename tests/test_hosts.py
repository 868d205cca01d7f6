"""Hosts and URLs in canonical form, and the guard over them."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import hosts, urls

# Raw hosts, their canonical form (None: no host) and whether they are public.
HOSTS = [
    ("Example.COM", "example.com", True), ("localhost", "localhost", False), ("LOCALHOST.", "localhost.", False), ("x.localhost", "x.localhost", False), ("a_b.c", "a_b.c", True), ("a b", None, False), ("a%41.com", "aa.com", True), ("a%2fb", None, False),
    ("127.0.0.1", "127.0.0.1", False), ("2130706433", "127.0.0.1", False), ("127.1", "127.0.0.1", False), ("127.0.1", "127.0.0.1", False), ("0x7f.0.0.1", "127.0.0.1", False), ("0177.0.0.1", "127.0.0.1", False), ("0x7f000001", "127.0.0.1", False), ("017700000001", "127.0.0.1", False),
    ("127.0.0.1.", "127.0.0.1", False), ("127.0x0.00.1", "127.0.0.1", False), ("%31%32%37.1", "127.0.0.1", False), ("１２７.0.0.1", "127.0.0.1", False), ("127。0.0.1", "127.0.0.1", False), ("0x", "0.0.0.0", False), ("0", "0.0.0.0", False),
    ("8.8.8.8", "8.8.8.8", True), ("134744072", "8.8.8.8", True), ("8.526344", "8.8.8.8", True), ("010.8.8.8", "8.8.8.8", True), ("256.1.1.1", None, False), ("1.2.3.256", None, False), ("1.2.3.4.5", None, False), ("1..2", None, False), ("08.1.1.1", None, False), ("4294967295", "255.255.255.255", True),
    ("4294967296", None, False), ("99999999999999999999", None, False), ("0xffffffffff", None, False), ("1.16777215", "1.255.255.255", True), ("1.16777216", None, False), ("a.1", None, False), ("1.a", "1.a", True), ("1.2.3.4.", "1.2.3.4", True), ("1.2.3.4..", "1.2.3.4..", True),
    ("10.255.0.1", "10.255.0.1", False), ("172.16.0.1", "172.16.0.1", False), ("172.15.0.1", "172.15.0.1", True), ("172.31.255.255", "172.31.255.255", False), ("172.32.0.1", "172.32.0.1", True), ("192.168.0.1", "192.168.0.1", False), ("192.167.0.1", "192.167.0.1", True), ("169.254.9.9", "169.254.9.9", False),
    ("[::1]", "[::1]", False), ("[0:0::1]", "[::1]", False), ("[0:0:0:0:0:0:0:1]", "[::1]", False), ("[0000:0::0001]", "[::1]", False), ("[::]", "[::]", False), ("[::ffff:127.0.0.1]", "[::ffff:7f00:1]", False), ("[::ffff:8.8.8.8]", "[::ffff:808:808]", True), ("[::127.0.0.1]", "[::7f00:1]", False),
    ("[FE80::1]", "[fe80::1]", False), ("[febf:0:0:1::]", "[febf:0:0:1::]", False), ("[fec0::1]", "[fec0::1]", True), ("[fc00::]", "[fc00::]", False), ("[fdff::1]", "[fdff::1]", False), ("[2001:db8:0:0:1:0:0:1]", "[2001:db8::1:0:0:1]", True), ("[2001:0db8::0:0:0001]", "[2001:db8::1]", True),
    ("[1:2:3:4:5:6:7:8]", "[1:2:3:4:5:6:7:8]", True), ("[1:0:0:2:0:0:0:3]", "[1:0:0:2::3]", True), ("[1:2:3:4:5:6:7::]", "[1:2:3:4:5:6:7:0]", True), ("[1:2:3:4:5:6:7:8:9]", None, False), ("[1::2::3]", None, False), ("[1:2]", None, False), ("[::12345]", None, False), ("[::1.2.3.256]", None, False),
    ("[::g]", None, False), ("[1:2:3:4:5:6:7:8::]", None, False), ("bücher.de", "xn--bcher-kva.de", True), ("例え.jp", "xn--r8jz45g.jp", True), ("faß.de", "fass.de", True),
]


def test_hosts(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _, _) in enumerate(HOSTS)], "i int, h string")
    made = hosts.canonical(F.col("h"))
    got = df.select("i", made.alias("c"), hosts.is_public(made).alias("p"), urls.is_public(F.concat(F.lit("http://"), "h", F.lit(":80/x"))).alias("u")).orderBy("i").collect()
    assert [(h, r.c, r.p) for (h, _, _), r in zip(HOSTS, got, strict=True)] == HOSTS
    assert [r.u for r in got] == [p for _, _, p in HOSTS]


URLS = {
    " http://A.com/a/../b/./c ": "http://a.com/b/c", "http://a.com/%2E%2e/x": "http://a.com/x", "http:\\\\a.com\\x\\y": "http://a.com/x/y", "HTTPS:a.com": "https://a.com/", "http://a.com/ä b\"<>`{}": "http://a.com/%C3%A4%20b%22%3C%3E%60%7B%7D",
    "http://a.com/a%20b%zz": "http://a.com/a%20b%zz", "http://a.com/?b=1 2&a=ä&b=0&c": "http://a.com/?a=%C3%A4&b=1+2&b=0&c=", "http://a.com/?a=%41%zz&%61=2": "http://a.com/?a=A%25zz&a=2", "http://u:p@a.com:0080/": "http://u:p@a.com/", "https://a.com:80": "https://a.com:80/",
    "http://a.com:99999/": "http://a.com:99999/", "http://127.1/x": "http://127.0.0.1/x", "http://[0:0::1]:8080/": "http://[::1]:8080/", "http://bücher.de": "http://xn--bcher-kva.de/", "http://256.1.1.1/A": "http://256.1.1.1/A", "http://a.com/x\ny": "http://a.com/xy", "mailto:A@b": "mailto:A@b",
}


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_urls(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.createDataFrame([(u,) for u in URLS], "u string")
        assert {r.u: r.n for r in df.select("u", urls.standard(F.col("u")).alias("n")).collect()} == URLS
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert spark.createDataFrame([(None,)], "u string").select(urls.standard(F.col("u")), urls.is_public(F.col("u"))).first() == (None, False)
