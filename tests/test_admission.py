import pytest
from pyspark.sql import functions as F

from trailmark.functions import text as T
from trailmark.functions import times, urls
from trailmark.operators import admission, extract


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("r")).first()["r"]


FILLER = "word " * 360


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ("Your card 4111 1111 1111 1111 was charged.", "pii:card"),
        ("Your card 4111 1111 1111 1112 was charged.", None),
        ("SSN on file: 123-45-6789.", "pii:ssn"),
        ("Pay to DE89370400440532013000 today.", "pii:iban"),
        (" ".join(f"person{i}@example.org" for i in range(8)), "pii:contact-density"),
        ("Forgot password? Remember me. Sign in to continue.", "auth-text"),
        ("A calm note about gardens and rivers.", None),
        (FILLER + FILLER + "An example number is 4111 1111 1111 1111 in prose.", None),
        ("", None),
    ],
)
def test_sensitive_text(spark, text, reason):
    assert one(spark, text, admission.sensitive_reason) == reason


@pytest.mark.parametrize(
    ("html", "reason"),
    [
        ('<form><input name="p" type="password"></form>', "password-field"),
        ("<input autocomplete='shipping cc-csc'>", "sensitive-autocomplete"),
        ('<meta name="robots" content="noindex">', "noindex"),
        ("<input><input><select></select><textarea></textarea><input><input>", "form-dominant"),
        ('<input type="hidden"><input><select></select><textarea></textarea><input><input>', None),
        ("<p>Session expired. Access denied.</p>", "auth-text"),
        ("<p>Nothing special</p>", None),
    ],
)
def test_structural_checks(spark, html, reason):
    def expression(v):
        text = extract.visible_text(v)
        return extract.structural_reason(v, text, T.whitespace_words(text))

    assert one(spark, html, expression) == reason


def test_html_keeps_nested_structure_apart(spark):
    page = (
        "<html><head><title> A &amp; B </title><meta content='words' name='description'>"
        "<meta name=author content=Kim></head><body><div class='box ad'><div>inner</div>promo</div>"
        "<div role='navigation'>menu</div><h1>Head</h1><p>First  line<br>second</p><footer>foot</footer>tail</body></html>"
    )
    row = spark.createDataFrame([(page,)], "html string").transform(extract.page_text).first()
    assert (row.title, row.meta_description, row.meta_author) == ("A & B", "words", "Kim")
    assert row.content == "Head\n\nFirst line\nsecond\n\ntail".replace("\n\nFirst", "\n\nFirst")
    assert "promo" not in row.content and "inner" not in row.content and "menu" not in row.content


def test_references_end_with_a_semicolon(spark):
    html = "<title>A &amp; B &#38; C&amp</title><body><p>x &lt; y &copy z &notit; &amp;lt; &amp&amp; &bogus;</p></body>"
    row = extract.page_text(spark.createDataFrame([(html,)], "html string")).first()
    assert row["title"] == "A & B & C&amp"
    assert row["content"] == "x < y &copy z &notit; &lt; &amp& &bogus;"


def test_only_html_blanks_are_collapsed(spark):
    html = "<title>\u00a0A\u2003\u00a0 \n B\u0085</title><body><p>\u00a0x\u00a0\u00a0y \t\r\nz\u3000</p></body>"
    row = extract.page_text(spark.createDataFrame([(html,)], "html string")).first()
    assert row["title"] == "A\u2003\u00a0 B\u0085"
    assert row["content"] == "\u00a0x\u00a0\u00a0y z\u3000"


def test_ratio_is_rounded_as_a_double(spark):
    html = "<body>" + "<i>" * 40 + "x" * 3059 + "</body>"  # 76.475, a double just below it
    assert extract.page_text(spark.createDataFrame([(html,)], "html string")).first()["text_to_tag_ratio"] == 76.47


def test_article_is_preferred_when_long_enough(spark):
    body = "intro <article>" + "long text " * 30 + "</article> outro"
    short = "intro <article>brief</article> outro"
    rows = spark.createDataFrame([(body,), (short,)], "html string").transform(extract.page_text).collect()
    assert "intro" not in rows[0].content
    assert "intro" in rows[1].content and "outro" in rows[1].content


@pytest.mark.parametrize(
    ("url", "blocked"),
    [
        ("https://imdb.com/title", True),  # contains db.com
        ("https://example.com/blog/vector-databases", False),
        ("https://example.com/log-in/", True),
        ("https://example.com/img/200x300", True),
        ("ftp://example.com/file", True),
        ("https://login.example.com/", True),
    ],
)
def test_url_blocking(spark, url, blocked):
    assert one(spark, url, admission.url_blocked) is blocked


@pytest.mark.parametrize(
    ("url", "blocked"),
    [
        ("https://imdb.com/title", False),
        ("https://db.com/", True),
        ("https://www.db.com/x", True),
        ("https://shop.example.com/order/1", True),
        ("https://pay.example.com/", True),
        ("file:///tmp/x", True),
    ],
)
def test_capture_blocking(spark, url, blocked):
    assert one(spark, url, admission.capture_blocked) is blocked


def test_classification(spark):
    rows = [
        ("https://docs.python.org/3/library/os.html", "os module reference page", 300, 0.6),
        ("https://example.com/blog/my-great-article", "One two three", 600, 0.0),
        ("https://example.com/thread/5", "q", 10, 0.0),
        ("https://example.com/", "", 1200, 0.7),
        ("https://accounts.google.com/signin", "Sign in", 40, 0.0),
    ]
    frame = spark.createDataFrame(
        [(u, t, "", w, r) for u, t, w, r in rows],
        "url string, title string, content string, word_count long, text_to_tag_ratio double",
    )
    got = [(r.content_type, r.quality_points) for r in admission.with_quality(frame).collect()]
    assert got == [("documentation", 90), ("blog", 75), ("forum", 35), ("article", 55), ("skip", 0)]


def test_validation_names_the_field(spark):
    frame = spark.createDataFrame(
        [("https://a.b/", "t" * 3000, "", "", ""), ("", "t", "", "", ""), ("https://a.b/", "t", "c", "", "")],
        "url string, title string, content string, meta_description string, meta_author string",
    )
    valid, rejected = admission.split_valid(frame)
    assert valid.count() == 1
    assert [r.reject_field for r in rejected.collect()] == ["title", "url"]


def test_word_counts(spark):
    assert one(spark, "# Title --- one | two é5", T.content_words) == 4
    assert one(spark, " a  b\tc\n", T.whitespace_words) == 3
    assert one(spark, "-" * 50_000, T.content_words) == 0


def test_iso_times_compare_as_instants(spark):
    same = one(spark, "2024-01-01T12:00:00Z", lambda v: times.iso_instant(v) == times.iso_instant(F.lit("2024-01-01T13:00:00+01:00")))
    assert same is True
    assert one(spark, "yesterday", times.iso_instant) is None


def test_host_suffixes(spark):
    assert one(spark, "a.b.c", urls.host_suffixes) == ["a.b.c", "b.c", "c"]
    assert one(spark, "https://user@Sub.Example.com:8080/p?q", urls.host) == "sub.example.com"


def test_skip_stats_merge(spark):
    skips = spark.sql("SELECT 'a' domain, 'pii:card' reason, timestamp'2024-01-02' ts UNION ALL SELECT '', 'x', timestamp'2024-01-02'")
    old = spark.sql("SELECT 'a' domain, 'pii:card' reason, 2L count, timestamp'2024-01-01' last_seen")
    rows = admission.skip_stats(skips, old).collect()
    assert [(r.domain, r["count"], str(r.last_seen)) for r in rows] == [("a", 3, "2024-01-02 00:00:00")]


def test_user_blocklist_covers_subdomains(spark):
    visits = spark.createDataFrame([("https://www.x.org/1",), ("https://sub.x.org/2",), ("https://xx.org/3",)], "url string")
    domains = spark.createDataFrame([("www.X.org",)], "domain string")
    assert [r.url for r in admission.drop_user_blocked(visits, domains).collect()] == ["https://xx.org/3"]
