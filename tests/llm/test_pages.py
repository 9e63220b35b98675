"""URL filter and WARC derivatives."""

import base64
import gzip
import hashlib
import html.parser
import os
import zlib

import pytest
from pyspark.sql import functions as F

from lexiloom.llm import url_filter, warc

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.org", None, "block"), ("", "/", "block"), ("org", "/fr/", "allow")]
URLS = [
    ("http://WWW.Example.NET/en/x?q=1", "example.net/en/", "allow"), ("https://example.net", None, "allow"), ("https://sub.example.net/de", "net/", "block"), ("http://net/", "net/", "block"),
    ("http://example.com/de/1#t", "example.com/de/", "block"), ("http://example.com/en/1", None, "allow"), ("http://x.org/fr/2", "org/fr/", "allow"), (None, None, "allow"), ("", None, "allow"), ("no scheme", None, "allow"),
    ("http://bad.com/p/", None, "block"), ("https://www.bad.com/p", None, "block"), ("https://bad.com/p/q", None, "allow"), ("http://bad.com/p?x", None, "block"), ("http://bad.org/fr/p", "org/fr/", "allow"),
    ("http://notexample.com/de/1", None, "allow"), ("ftp://example.com:80/de/", None, "allow"),
]


def pages(spark, urls):
    return spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(urls)], "page_id long, url string, host string, rule string")


def rules(spark, rows=RULES):
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def test_verdicts(spark):
    urls = [u for u, _, _ in URLS] * 2
    listed = spark.createDataFrame([("http://www.bad.com/p/",), (None,), ("http://bad.org/fr/p",)], "url string")
    for size in (1, 32):
        rows = url_filter.filter_urls(pages(spark, urls), listed, rules(spark), size).collect()
        got = {r.page_id: (r.rule, r.verdict) for r in rows}
        assert len(rows) == len(urls) and got == {k: URLS[k % len(URLS)][1:] for k in range(len(urls))}


def test_no_list_and_no_pages(spark):
    nothing = spark.createDataFrame([], "url string")
    assert {r.verdict for r in url_filter.filter_urls(pages(spark, ["http://a.b/c", None]), nothing, rules(spark, [])).collect()} == {"allow"}
    assert url_filter.filter_urls(pages(spark, []), nothing, rules(spark)).count() == 0


def test_a_full_filter_passes_false_hits_only(spark):
    keys = url_filter.listed_keys(spark.range(3000).selectExpr("concat('http://h', id, '.com/x') AS url"), rules(spark, []))
    words = url_filter.build_filter(keys)
    assert words.shape == (-(-3000 * url_filter._BITS_PER_KEY // 256), 8) and words.any()
    probed = keys.select("_key").unionByName(spark.range(3000).selectExpr("concat('=other', id) AS _key"))
    passed = probed.select(F.explode(url_filter.possible(F.array("_key"), words)).alias("_key"))
    assert passed.join(keys, "_key").count() == 3000 and passed.count() < 3000 + 300  # all that are listed, few others
    full = url_filter.filter_urls(pages(spark, [f"http://h{k}.com/x" for k in range(0, 6000, 7)]), keys.selectExpr("concat('http://', substr(_key, 2)) AS url"), rules(spark, []), max_filter_mb=0)
    assert full.where("verdict = 'block'").count() == len(range(0, 3000, 7))


def test_pages_without_a_hit_are_not_shuffled(spark):
    listed = spark.createDataFrame([("http://bad.com/p",)], "url string")
    plan = url_filter.filter_urls(pages(spark, [u for u, _, _ in URLS]), listed, rules(spark))._jdf.queryExecution().optimizedPlan().toString()
    clear, hits = plan.split("Union", 1)[1].split("Aggregate", 1)
    assert "Join" not in clear and "Join" in hits and "url-hits" not in clear


def test_a_key_of_most_pages(spark):
    urls = ["http://example.com/de/same"] * 3000 + [f"http://example.com/de/{k}" for k in range(200)] + ["http://bad.com/p", "http://good.com/p"] * 100
    listed = spark.createDataFrame([("http://bad.com/p",)], "url string")
    rows = url_filter.filter_urls(pages(spark, urls).repartition(7), listed, rules(spark)).groupBy("rule", "verdict", "listed").count().collect()
    assert sorted(map(tuple, rows), key=str) == sorted([("example.com/de/", "block", False, 3200), (None, "block", True, 100), (None, "allow", False, 100)], key=str)


class _Visible(html.parser.HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "head")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "head")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def test_plain_text_holds_the_visible_words():
    page = "<!DOCTYPE html><html lang='fr'><head><title>T &amp; t</title><style>p{}</style></head><body><p>One&nbsp;<b>two</b><br>three<!-- no --></p><script>x</script><ul><li>4 &lt; 5<li>six</ul>&eacute;&#8364;</body></html>"
    reader = _Visible()
    reader.feed(page)
    assert warc.plain_text(page) == "One two\nthree\n4 < 5\nsix\né€"
    assert "".join(warc.plain_text(page).split()) == "".join("".join(reader.out).split())


@pytest.mark.parametrize("page, text", [
    ("<html><head><title>t</title><body><p>all the text</p></body></html>", "all the text"),
    ("<html><head><meta charset=utf-8><title>t</title><style>p{}</style><script>x</script><p>one<p>two", "one\ntwo"),
    ("<head><link rel=a><noscript>n</noscript><template>m</template><!-- </head> --><div>three</div>", "three"),
    ("<HEAD lang=de><TITLE>t</TITLE>\n</HEAD>\n<BODY>four<head>five", "fourfive"),
    ("<title>t</title><header>six</header>", "six"),
])
def test_a_head_without_end_tag_hides_no_text(page, text):
    assert warc.plain_text(page) == text


def test_records_are_linked_and_survive_a_round_trip(spark, tmp_path):
    source = spark.createDataFrame([(1, "http://a/b", "<html lang=de><title>x\r\ny</title><p>Grüße"), (2, None, None), (1, "http://a/b", "<html lang=de><title>x\r\ny</title><p>Grüße"), (None, "http://c", "")], "page_id long, url string, html string")
    records = warc.derive(warc.responses_of_pages(source)).cache()
    rows = records.collect()
    assert len(rows) == 8 and {r.record_type for r in rows} == {"metadata", "conversion"}
    one = {r.record_type: r for r in rows if r.page_id == 1}
    assert one["conversion"].block == "Grüße" and one["conversion"].refers_to == one["metadata"].refers_to
    assert "title: x y" in one["metadata"].block and "language: de" in one["metadata"].block and one["metadata"].source_digest in one["metadata"].block
    folder = str(tmp_path / "warc")
    warc.write_warc(records, folder)
    files = [f for f in os.listdir(folder) if f.endswith(".gz")]
    found = [x for f in files for x in warc.read_warc(gzip.open(f"{folder}/{f}").read())]
    members = [m for f in files for m in _members(open(f"{folder}/{f}", "rb").read())]
    assert len(members) == 8 and all(len(list(warc.read_warc(m))) == 1 for m in members)
    assert sorted(set(os.listdir(folder)) - set(files)) == ["_SUCCESS", "_temporary"] and os.listdir(f"{folder}/_temporary") == []
    with pytest.raises(Exception, match="broken row"):
        warc.write_warc(records.withColumn("block", F.expr("if(page_id = 1, raise_error('broken row'), block)")), f"{folder}-failed")
    assert not [f for _, _, names in os.walk(f"{folder}-failed") for f in names if f.endswith(".gz") or f == "_SUCCESS"]
    warc.write_warc(records.limit(0), f"{folder}-empty")
    assert not [f for f in os.listdir(f"{folder}-empty") if f.endswith(".gz")]
    assert sorted((h["WARC-Record-ID"], h["WARC-Block-Digest"], warc.digest(b)) for h, b in found) == sorted((r.record_id, r.block_digest, r.block_digest) for r in rows)
    assert warc.derive(warc.responses_of_pages(source.limit(0))).count() == 0


def _members(content):
    """Each gzip member, unpacked by itself."""
    while content:
        reader = zlib.decompressobj(wbits=31)
        yield reader.decompress(content)
        content = reader.unused_data


class _Words(html.parser.HTMLParser):
    """A separate reader: visible words, title and language."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words, self.title, self.language, self.stack = [], [], "", []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title", "noscript", "template"):
            self.stack.append(tag)
        if tag == "html":
            self.language = self.language or dict(attrs).get("lang") or ""

    def handle_endtag(self, tag):
        if self.stack and self.stack[-1] == tag:
            self.stack.pop()

    def handle_data(self, data):
        if not self.stack:
            self.words += data.split()
        elif self.stack[-1] == "title":
            self.title += data.split()


def test_whole_records_of_the_given_pages_against_a_separate_reader(spark):
    """Links, digests, lengths, given headers and dates, texts: everything recomputed from the page."""
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    http = "HTTP/1.1 203 Fine\r\nContent-Type: text/html\r\nX-Odd:  a: b \r\nETag: \"7\""
    given = [(r.page_id, r.url, f"2023-05-{1 + r.page_id % 28:02d}T01:02:03Z", http if r.page_id % 2 else None, r.html, "x") for r in rows]
    responses = spark.createDataFrame(given, "page_id long, target_uri string, date string, http_headers string, payload string, headers string")
    sha = lambda raw: "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()
    got = {}
    for r in warc.derive(responses).collect():
        got.setdefault(r.page_id, {})[r.record_type] = r
    assert set(got) == {r.page_id for r in rows}
    for page_id, uri, date, headers, payload, _ in given:
        told, text = got[page_id]["metadata"], got[page_id]["conversion"]
        reader = _Words()
        reader.feed(payload or "")
        reader.close()
        assert "".join(text.block.split()) == "".join(reader.words)
        fields = dict(line.split(": ", 1) for line in told.block.split("\r\n") if line)
        want = {"source-payload-digest": sha((payload or "").encode()), "source-length": str(len((payload or "").encode())), "title": " ".join(reader.title), "language": reader.language}
        if headers:
            want |= {"http-status": "HTTP/1.1 203 Fine", "http-content-type": "text/html", "http-x-odd": "a: b", "http-etag": '"7"'}
        assert fields == {k: v for k, v in want.items() if v}
        for r in (told, text):
            raw = r.block.encode()
            lines = dict(line.split(": ", 1) for line in r.headers.split("\r\n")[1:])
            assert (r.content_length, r.block_digest, r.source_digest) == (len(raw), sha(raw), want["source-payload-digest"])
            assert lines == {k: v for k, v in {
                "WARC-Type": r.record_type, "WARC-Record-ID": r.record_id, "WARC-Refers-To": r.refers_to, "WARC-Target-URI": uri, "WARC-Date": date,
                "WARC-Block-Digest": sha(raw), "Content-Type": r.content_type, "Content-Length": str(len(raw)),
            }.items() if v}
        assert told.refers_to == text.refers_to and len({told.record_id, text.record_id, told.refers_to}) == 3
    assert len({r.refers_to for kinds in got.values() for r in kinds.values()}) == len(rows)
