import zlib

from pyspark.sql import functions as F

from quillspark.llm import warc
from quillspark.llm.work import fresh_path, written


def rows():
    out = [(k, f"http://h{k % 7}.example.com:80/p/{k}?q=1#frag", f"<p>{k}</p>") for k in range(200)]
    out += [(500, "https://a@EXAMPLE.org", "é" * 50_000), (501, "https://example.org/", None), (None, "http://h1.example.com/p/1?q=1", "again"), (502, None, "lost"), (503, "no scheme/x y", "s"), (504, "", ""), (505, "http://a/\r\n\r\nContent-Length: 1\nx", "broken"), (3, "http://h3.example.com/p/3?q=1", "<p>3</p>")]
    return out


def key_of(url):
    url = url.partition("#")[0]
    scheme, mark, rest = url.partition("://")
    host, path = "", url
    if mark and scheme.isalpha():
        cut = min([i for i in (rest.find("/"), rest.find("?")) if i >= 0], default=len(rest))
        host, path = rest[:cut].rpartition("@")[2].partition(":")[0].lower(), rest[cut:]
    return ",".join(host.split(".")[::-1]) + ")" + (path if path.startswith("/") else "/" + path).replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D")


def pages(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in rows()], "page_id long, url string, html string, key string, at int")


def expected():
    return sorted(((key_of(u), i, (h or "").encode()) for i, u, h in rows() if u is not None), key=str)


def test_every_capture_is_found(spark):
    listed = written(warc.write_warcs(pages(spark), fresh_path(spark, "warc")), "captures")
    directory = written(warc.build_index(listed, fresh_path(spark, "index"), 8), "directory")
    assert directory.agg(F.sum("lines")).first()[0] == len(expected())
    keys = listed.select("key").unionByName(spark.createDataFrame([("zzz)/",), ("",), ("com,example,h1)/p/1",), (None,)], "key string"))
    for limit in (10**6, 0):
        got = sorted(((r["key"], r["page_id"], bytes(r["html"])) for r in warc.lookup(keys, directory, limit).collect()), key=str)
        assert got == expected(), limit


def test_records_are_gzip_members():
    data = warc._gzip(warc.record("http://x/", b"one")) + warc._gzip(warc.record("http://y/", b"two"))
    first = zlib.decompressobj(31)
    head = first.decompress(data)
    assert head.startswith(b"WARC/1.0\r\n") and b"WARC-Target-URI: http://x/" in head
    assert warc.html_of(data[: len(data) - len(first.unused_data)]) == b"one" and warc.html_of(first.unused_data) == b"two"


def test_empty_tables(spark):
    assert warc.captures(pages(spark).where("false")).count() == 0
    assert warc.captures(pages(spark).where("url IS NULL")).count() == 0
