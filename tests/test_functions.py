"""Edge cases of the scalar functions, against what Python says."""

import json
from urllib.parse import urlparse

from pyspark.sql import functions as F

from corpusloom.functions import text, web
from corpusloom.sources.tables import parse_records, read_pair_counts, read_seeds

URLS = ["HTTP://A.com//x//y/?q#f", "https://a.com", "https://a.com/p;v=1/q;z=2", "ftp://a/b", "mailto:x@y", "https:///x", "https://u:p@Host:81/a/", "  https://a.com/b  ", "", None]
WANT = ["http://A.com/x/y", "https://a.com/", "https://a.com/p;v=1/q", None, None, None, "https://u:p@Host:81/a", "https://a.com/b", None, None]


def one(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_canonical_url(spark):
    assert one(spark, URLS, web.canonical_url("x")) == WANT
    assert one(spark, URLS[:8], web.url_domain("x"))[6] == urlparse(URLS[6]).netloc.lower()


def test_language(spark):
    assert one(spark, ["en_US", " ES ", "e", "", None, "x-y"], web.normalize_language("x")) == ["en", "es", None, None, None, None]
    urls = ["https://www.a.com/es/x", "https://es.site.com/", "https://abcd.com/en-us/p", "https://abcd.com/english"]
    assert one(spark, urls, web.language_from_url("x")) == ["www", "es", "en", None]
    assert one(spark, urls, web.language_from_url("x", strict=True)) == ["es", "es", "en", None]
    english = "the and or of to " * 8
    assert one(spark, [english, english[:-4], "la " * 60, None], web.language_from_text("x")) == ["en", None, None, None]


def test_tokenize(spark):
    got = one(spark, ["", None, "the and", "Año ANO foo-bar x_1 ab être casas", "cafés"], text.tokenize("x"))
    assert got == [[], [], [], ["ano", "ano", "tre", "casas"], ["cafe"]]


def test_sentences_and_cuts(spark):
    assert one(spark, ["A b.  C!\n\nD? e", "", None], text.split_sentences("x")) == [["A b.", "C!", "D?", "e"], [], []]
    long = "word " * 30
    assert one(spark, [long, "short", "x" * 50], text.truncate_budget("x", 20)) == ["word word word word", "short", "x" * 20]
    stops = "a" * 17 + ". " + "b" * 30
    assert one(spark, [stops, "y" * 40, "ok"], text.truncate_answer("x", 20)) == ["a" * 17 + ".", "y" * 20 + "...", "ok"]


def test_marker(spark):
    values = ['{"sufficient": false}\n\nNo.', '{"sufficient": true}\nYes', "{bad}\nz", "plain", "", None]
    assert one(spark, values, text.sufficient("x")) == [False, True, True, True, True, True]
    assert one(spark, values, text.without_marker("x")) == ["No.", "Yes", "{bad}\nz", "plain", "", ""]


def test_page():
    page = web.parse_page("<html lang='en'><title>T &amp;lt; x</title><script>no</script><noscript><a href='/n'>hid</a></noscript><p>Hi <a href='/a'>you</a></p>")
    assert page["title"] == "T &lt; x" and page["text"].startswith("T < x") and page["links"] == ["/n", "/a"] and "hid" not in page["text"] and "Hi you" in page["text"]
    assert web.parse_page(None) == {"title": "", "text": "", "links": [], "html_language": None}


def test_page_attributes():
    page = web.parse_page("<html lang=' '><meta name=Language content=' ES_mx '><a href=' /x '></a><a href='  '></a><p>tail &amp")
    assert page == {"title": "", "text": "", "links": ["/x"], "html_language": "es"}
    assert web.parse_page("<html lang='1'><meta property='og:locale' content='fr_FR'>")["html_language"] == "fr"
    assert web.parse_page("<html lang='EN_us'><meta name='language' content='fr'>")["html_language"] == "en"


def test_page_entities_without_semicolon():
    page = web.parse_page("<title>cut &amp</title><p>a &amp;amp b &amp;&ampx; &notit; &copyright; &#38; &#38<a href='/?a=1&amp;b&amp=2&lt'>c</a>d & e &copy; &amp;lt; \ue000</p>tail &amp")
    assert page["title"] == "cut &amp" and page["links"] == ["/?a=1&b&=2<"]
    assert page["text"] == "cut &amp a &amp b &&ampx; &notit; &copyright; & &#38 c d & e © < \ue000"


def test_records(spark):
    lines = ['{"doc_id": 1, "title": "a"}', "", "{oops", '{"doc_id": "12", "title": "b"}', '{"doc_id": 12.7}', '{"doc_id": "web_ab"}', '{"title": "none"}', '{"doc_id": 1, "title": "c"}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "at int, value string")
    got = {r["doc_id"]: r["title"] for r in parse_records(df, order="at").collect()}
    assert got == {1: "c", 12: "b"}


def test_seed_and_pair_files(spark, tmp_path):
    (tmp_path / "seeds").write_text("# c\n\nhttps://a.com\n")
    assert [r[0] for r in read_seeds(spark, str(tmp_path / "seeds")).collect()] == ["https://a.com"]
    (tmp_path / "new").write_text(json.dumps({"terms": ["b", "a"], "cooc_rows": [0], "cooc_cols": [1], "cooc_data": [4]}))
    (tmp_path / "old").write_text(json.dumps({"cooc": {"a": {"b": 2, "a": 9}, "b": {"a": 3}}}))
    assert [tuple(r) for r in read_pair_counts(spark, str(tmp_path / "new")).collect()] == [("a", "b", 4)]
    assert [tuple(r) for r in read_pair_counts(spark, str(tmp_path / "old")).collect()] == [("a", "b", 5)]


def test_file_type(spark):
    got = one(spark, ["https://a/x.PDF", "https://a/x.jpeg", "https://a/v.mp4?x", "https://a/", None], web.file_type(F.col("x"), F.lit("")))
    assert got == ["PDF", "IMAGEN", "VIDEO", "DOCUMENTO", "DOCUMENTO"]


def test_small_values(spark):
    assert one(spark, ["abcd", "abX", "", None, "é1"], web.common_prefix("x", F.lit("abcé"))) == [3, 2, 0, 0, 0]
    assert one(spark, ["2024-01-02T03:04", "", None], web.date_part("x")) == ["2024-01-02", "", ""]
    assert one(spark, ["a b&c", "ñ"], web.query_url("x", "h")) == ["h?q=a+b%26c&kl=us-en", "h?q=%C3%B1&kl=us-en"]
    assert one(spark, ["en", "fr", None], web.ui_language("x")) == ["en", "es", "es"]
    assert one(spark, ["PDF", "imagen", "VIDEO", "DOCUMENTO", "?", None], web.ui_type("x")) == ["pdf", "image", "video", "document", "other", "other"]


def test_tokenizers(spark):
    import pytest

    with pytest.raises(ValueError):
        text.tokenize("x", "fr")
    with pytest.raises(ValueError):
        text.lemmatizer(str.split, "fr")
    stem = text.lemmatizer(lambda t: [w.rstrip("s") for w in t.split()])
    assert one(spark, ["Apples and Pèars the x1 ab", None], stem("x")) == [["apple", "pear"], []]
