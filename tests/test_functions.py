"""Column functions against worked cases."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from postwatch.functions import dates, rules, sanitize, texts, trigrams, urls

URL_CASES = [
    # own addresses: letter case, default ports, slashes, query order, tracking, fragments, blanks
    ("HTTPS://Werk.Test/Stellen", "https://werk.test/Stellen"),
    ("hTTp://Portal.WERK.test:80/a/", "http://portal.werk.test/a"),
    ("https://werk.test:443", "https://werk.test"),
    ("http://werk.test:8080/b/", "http://werk.test:8080/b"),
    ("https://werk.test/c?z=9&utm_campaign=q&y=8", "https://werk.test/c?y=8&z=9"),
    ("https://werk.test/d?k=2&k=10&j=", "https://werk.test/d?j=&k=10&k=2"),
    ("https://werk.test/e#top", "https://werk.test/e"),
    ("https://werk.test/f/?fbclid=1&utm_source=2", "https://werk.test/f"),
    ("\thttps://werk.test///g//h/ ", "https://werk.test/g/h"),
    ("sftp://Files.Test/i/", "sftp://files.test/i"),
    ("https://werk.test/j/../k", "https://werk.test/j/../k"),
    ("https://werk.test./l", "https://werk.test/l"),
    ("", ""), ("   ", ""), (None, None),
    ("https://x.com/a?q=b+c&p=%7Edir&s=100%", "https://x.com/a?p=~dir&q=b+c&s=100%25"),
    ("https://u:p@x.com/a;v=1?k", "https://x.com/a?k="),
]


def test_normalize_url(spark):
    rows = spark.createDataFrame(URL_CASES, "raw string, expected string")
    got = rows.withColumn("got", urls.normalize_url("raw")).collect()
    assert [(r.raw, r.got) for r in got] == URL_CASES


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_hosts(spark):
    cases = [("https://www.acme.com/x", "acme.com"), ("Careers.Acme.com", "careers.acme.com")]
    for raw, host in cases:
        assert one(spark, urls.host_of(F.lit(raw))) == host
    for raw, domain in [("careers.acme.com", "acme.com"), ("www.jobs.acme.co.uk", "acme.co.uk"),
                        ("acme.com", "acme.com"), ("jobs.com", "jobs.com"),
                        ("careers.localhost", "careers.localhost")]:
        assert one(spark, urls.registrable_domain(F.lit(raw))) == domain


@pytest.mark.parametrize(("base", "href", "expected"), [
    ("https://a.com/x/y", "/jobs", "https://a.com/jobs"),
    ("https://a.com/x/y", "z", "https://a.com/x/z"),
    ("https://a.com", "z", "https://a.com/z"),
    ("https://a.com/x/y?q=1", "?p=2", "https://a.com/x/y?p=2"),
    ("https://a.com/x/y", "//b.com/k", "https://b.com/k"),
    ("https://a.com/x/y/z", "../k", "https://a.com/x/k"),
    ("https://a.com/x", "mailto:me@a.com", None), ("https://a.com/x", "#top", None),
    ("https://a.com/x", "http://c.org/1", "http://c.org/1"),
])
def test_absolute_url(spark, base, href, expected):
    assert one(spark, urls.absolute_url(F.lit(base), F.lit(href))) == expected


def test_titles_keep_letters_of_all_scripts(spark):
    assert one(spark, texts.title_normalized(F.lit(" Ingénieur, (Senior)! "))) == (
        "ingénieur senior")


def test_slug_folds_accents(spark):
    slug = texts.job_slug(F.lit("Ingénieur C++"), F.lit("Acme & Co."), F.lit("Zürich"),
                          F.lit("12345678-aaaa"))
    assert one(spark, slug) == "ingenieur-c-acme-co-zurich-12345678"


def test_keywords(spark):
    assert one(spark, texts.path_has_keyword(F.lit("/de/CAREERS/2030")))
    assert not one(spark, texts.path_has_keyword(F.lit("/cars/tyres")))
    assert one(spark, texts.text_has_keyword(F.lit("Yes, we are HIRING now")))
    assert not one(spark, texts.text_has_keyword(F.lit("tyres")))
    assert one(spark, texts.no_openings(F.lit("<div>Sorry, no open positions today</div>")))
    assert not one(spark, texts.no_openings(F.lit("<div>Some positions</div>")))


@pytest.mark.parametrize(("url", "text", "expected"), [
    ("https://acme.com/jobs/123", "", True), ("https://acme.com/about", "", False),
    ("https://boards.greenhouse.io/acme/jobs/4567", "", True),
    ("https://boards.greenhouse.io/acme", "", False),
    ("https://jobs.ashbyhq.com/acme/xyz-789", "", True),
    ("https://acme.com/team", "View role", True),
])
def test_job_links(spark, url, text, expected):
    assert one(spark, texts.is_job_link(F.lit(url), F.lit(text))) is expected


def test_trigram_similarity(spark):
    value = one(spark, trigrams.trigram_similarity(F.lit("word"), F.lit("two words")))
    assert value == pytest.approx(4 / 11)
    assert one(spark, trigrams.trigram_similarity(F.lit("a"), F.lit(None).cast("string"))) is None


def test_feed_times_drop_the_offset(spark):
    at = dt.datetime(2025, 1, 15, 10)
    assert one(spark, rules.parse_feed_time(F.lit("2025-01-15T10:00:00-05:00"), "seconds")) == at
    assert one(spark, rules.parse_feed_time(
        F.lit("2025-01-15T10:00:00-05:00"), "seconds", True)) == dt.datetime(2025, 1, 15, 15)
    assert one(spark, rules.parse_feed_time(F.lit("1700000000000"), "millis")) == (
        dt.datetime(2023, 11, 14, 22, 13, 20))
    assert one(spark, rules.parse_feed_time(F.lit("soon"), "seconds")) is None


def test_uuid_modulo(spark):
    value = uuid.UUID("3f2504e0-4f89-11d3-9a0c-0305e82c3301")
    assert one(spark, rules.uuid_mod(F.lit(str(value)), F.lit(60))) == value.int % 60


@pytest.mark.parametrize(("args", "expected"), [
    (("failure", 10, 10), "untrusted"), (("success", 0, 4), "trusted"),
    (("success", 0, 5), "quarantined"), (("success", 4, 10), "quarantined"),
    (("success", 5, 10), "trusted"),
])
def test_run_verdict(spark, args, expected):
    assert one(spark, rules.run_verdict(*[F.lit(a) for a in args]))["verdict"] == expected


def test_effective_max_age(spark):
    relief = F.create_map(F.lit("SC/ST"), F.lit(5), F.lit("OBC"), F.lit(3),
                          F.lit("PwBD_OBC"), F.lit(13), F.lit("Ex-servicemen"), F.lit(8))

    def limit(category, pwbd=False, served=False, years=0, top=32):
        return one(spark, rules.effective_max_age(
            F.lit(top).cast("int"), relief, F.lit(category), F.lit(pwbd), F.lit(served),
            F.lit(years)))

    assert limit("GENERAL") == 32
    assert limit("ST") == 37
    assert limit("OBC", pwbd=True) == 45
    assert limit("OBC", served=True, years=2) == 38
    assert limit("OBC", top=None) is None


HOSTILE = [
    "<script>alert(1)</script><p onclick='x()'>hi</p>", "<a href='javascript:alert(1)'>x</a>",
    "<a href=' jav\tascript:alert(1)'>x</a>", "<img src=x onerror=alert(1)>",
    "<iframe src='//evil'></iframe>", "<p><!-- note -->ok</p>", "<a href='data:text/html,1'>x</a>",
    "<style>p{}</style><b>bold</b>", "<svg><a xlink:href='javascript:1'>y</a></svg>", "<p",
    "<<p>script>alert(1)<</p>/script>",
]


@pytest.mark.parametrize("html", HOSTILE)
def test_sanitizer_removes_everything_active(html):
    out = sanitize.clean_html(html).lower()
    for bad in ("<script", "onclick", "javascript:", "<img", "<iframe", "<!--", "data:", "<style",
                "<svg", "onerror="):
        assert bad not in out


def test_sanitizer_keeps_allowed_markup():
    out = sanitize.clean_html('<p>Hi <a href="https://x.org" class="c">x</a> &amp; y</p>')
    assert out == ('<p>Hi <a href="https://x.org" target="_blank" '
                   'rel="nofollow noopener noreferrer">x</a> &amp; y</p>')


def test_dates_in_text_match_a_plain_search(spark):
    text = "From 05-13-2024 to 13/05/24, also 2024-06-07 and\nMarch 5, 2024 or 7 Sept 2023."
    rows = dates.date_candidates(
        spark.createDataFrame([(1, text)], "doc_id int, text string"), "doc_id", "text", 2024
    ).orderBy("pos").collect()
    assert [(r.raw, str(r.parsed), r.ambiguous) for r in rows] == [
        ("05-13-2024", "2024-05-13", False), ("13/05/24", "2024-05-13", False),
        ("2024-06-07", "2024-06-07", True), ("March 5, 2024", "2024-03-05", False),
        ("7 Sept 2023", "2023-09-07", False),
    ]
    at = text.index("2024-06-07")
    assert rows[2].context == text[max(0, at - 30):at + 40].replace("\n", " ")


def test_dates_of_texts_without_any(spark):
    long = " ".join(f"{n % 28 + 1:02d}-{n % 12 + 1:02d}-{1900 + n % 200}" for n in range(50_000))
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (3, "no date 5"), (4, "\U0001f600" * 40 + " 1-2-2003"), (5, long)],
        "doc_id int, text string")
    rows = dates.date_candidates(docs, "doc_id", "text", 2024).collect()
    assert [r.context for r in rows if r.doc_id == 4] == ["\U0001f600" * 29 + " 1-2-2003"]
    assert {r.doc_id for r in rows} == {4, 5}
    days = [r.raw for r in rows if r.doc_id == 5 and " " not in r.raw]
    assert sorted(days) == sorted(set(long.split()))
