"""Expected results of the ingest, of accents, trimming and keywords, stated from the rules and not from a twin."""
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from sievework.functions import column, keywords
from sievework.functions import scalars as S
from sievework.operators import documents, gates, ingest
from sievework.sources import boards

NOW = "2024-03-31 00:00:00"


@pytest.mark.parametrize(("slug", "greenhouse", "ashby", "smart"), [
    ("base-ten", "Base-ten", "Base Ten", "base ten"), ("north_wind.labs", "North_wind.labs", "North Wind Labs", "north wind labs"), ("BlueSky42", "BlueSky42", "BlueSky42", "Blue Sky"),
    ("acme--co-", "Acme--co-", "Acme Co", "acme co"), ("o'neil", "O'neil", "O'Neil", "o'neil"), ("a1B2", "A1B2", "A1B2", "a1B"), ("", "", "", ""),
])
def test_names_of_slugs(spark, slug, greenhouse, ashby, smart):
    row = spark.createDataFrame([(slug,)], "s string").select(*[f(F.col("s")) for f in (boards.greenhouse_name, boards.ashby_name, boards.smart_name)]).first()
    assert tuple(row) == (greenhouse, ashby, smart)


def test_accents_of_every_letter(spark):
    """Every character that is one letter once its marks are taken off, alone and with its marks behind it."""
    bare = {chr(c): re.sub("[̀-ͯ]", "", unicodedata.normalize("NFD", chr(c))) for c in range(0x20, 0x110000) if not 0xD800 <= c < 0xE000}
    single = {c: b for c, b in bare.items() if len(b) <= 1 and b != c}
    assert len(single) > 1500
    rows = [(c, b) for c, b in single.items()] + [(unicodedata.normalize("NFD", c), b) for c, b in single.items()] + [(c, c) for c in "łøđıßæ한"]
    assert spark.createDataFrame(rows, "x string, y string").filter(~(column(S.unaccented, "x") == F.col("y"))).collect() == []


@pytest.mark.parametrize(("place", "kind"), [
    ("Gdańsk", "foreign"), ("İstanbul", "foreign"), ("São Paulo", "foreign"), ("São Paulo", "foreign"), ("Kraków", "foreign"), ("Zürich", "foreign"), ("Montréal", "foreign"),
    ("Caddo Parish", "us"), ("Austin, TX", "us"), ("Eugene, OR", "us"), ("", "unknown"), (None, "unknown"), ("Smallville", "unknown"), ("Hybrid", "ambiguous"), ("Venice, CA", "weak-us"),
])
def test_kinds_of_places(spark, place, kind):
    assert spark.createDataFrame([(place,)], "p string").select(column(S.location_kind, "p")).first()[0] == kind


def test_white_space_at_the_ends(spark):
    blank = spark.createDataFrame([("\n\r\t\x0b ",), ("",), (None,), ("\t short \r\n",)], "t string")
    assert [r[0] for r in blank.select(column(S.extraction_status, "t")).collect()] == ["empty", "empty", "empty", "short"]
    odd = "\u3000\u2003 \ufefftext\u00a0\u2028"
    assert spark.createDataFrame([(odd,)], "t string").select(column(S.stripped, "t")).first()[0] == odd.strip("\u3000\u2003 \ufeff\u00a0\u2028") == "text"
    lines = spark.createDataFrame([(1, 0, "\tEXPERIENCE\r"), (1, 1, "\t- Built the loader of all tables\r"), (1, 2, " plain — dash\r")], "doc_id long, line_no int, line string")
    assert [tuple(r) for r in gates.experience_bullets(lines).collect()] == [(1, 1, "Built the loader of all tables")]
    assert [r.line for r in documents.dashed(lines).collect()] == ["plain — dash"]


def test_first_keyword_in_list_order(spark):
    """Against a plain search: overlapping terms, terms that begin others, groups, whole words."""
    rng = random.Random(4)
    terms = ["".join(rng.choice("ab c") for _ in range(rng.randint(1, 5))) for _ in range(40)]
    terms = list(dict.fromkeys(t for t in terms if t.strip() == t))
    rng.shuffle(terms)
    group = [i // 3 for i in range(len(terms))]
    texts = ["".join(rng.choice("abcd -") for _ in range(rng.randint(0, 12))) for _ in range(300)] + [""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", keywords.first_hit(F.col("t"), terms).alias("plain"), keywords.first_hit(F.col("t"), terms, group).alias("grouped"), keywords.first_hit(F.col("t"), terms, whole=True).alias("whole")).collect()
    for r in got:
        listed = [(i, r.t.index(t)) for i, t in enumerate(terms) if t in r.t]
        want = None if not listed else (terms[listed[0][0]], listed[0][1] + 1)
        assert (None if r.plain is None else tuple(r.plain)) == want
        by = min(((group[i], at, i) for i, at in listed), default=None)
        assert (None if r.grouped is None else tuple(r.grouped)) == (by and (terms[by[2]], by[1] + 1))
        edged = [(i, m.start()) for i, t in enumerate(terms) if (m := re.search(rf"\b{re.escape(t)}\b", r.t))]
        assert (None if r.whole is None else tuple(r.whole)) == (None if not edged else (terms[edged[0][0]], edged[0][1] + 1))


def _greenhouse(spark, rows):
    made = [(i, title, (place,), content, "https://u", " Acme ", at, None, "acme") for i, (title, place, content, at) in enumerate(rows)]
    return spark.createDataFrame(made, boards.GREENHOUSE + ", slug STRING")


def test_gates_of_one_source(spark):
    """The stated verdicts of sample postings, with the title in the disqualifier, stripped text and 30 days."""
    rows = [
        ("Frontend Engineer", "Austin, TX", "&lt;p&gt;Full-time. Build the site.&lt;/p&gt;", "2024-03-20T00:00:00Z"), ("Backend Engineer", "Remote, US", "Must be a U.S. citizen with an active security clearance.", "2024-03-20T00:00:00Z"),
        ("Platform Engineer", "London, United Kingdom", "", "2024-03-20T00:00:00Z"), ("Engineer", "", None, None), ("Engineer", "Austin, TX", "", "2024-02-28T00:00:00Z"), ("Engineer", "Austin, TX", "", "2024-03-01T00:00:00Z"),
        ("Engineer (US citizens only)", "Austin, TX", "Clean.", "2024-03-20T00:00:00Z"), ("Engineer", "Austin, TX", "visa sponsorship&#xa0;is not available", "2024-03-20T00:00:00Z"), ("Engineer (Contract)", "Austin, TX", "", "unreadable"),
        ("Engineer", "Austin, TX", "must be a <b>US</b> citizen", "2024-03-20T00:00:00Z"),
    ]
    judged = ingest.judged(boards.greenhouse_rows(_greenhouse(spark, rows)), NOW)
    assert [r.verdict for r in judged.orderBy(F.col("id").cast("int")).collect()] == ["saved", "disqualified", "non_us", "saved", "old", "saved", "disqualified", "disqualified", "contract", "disqualified"]
    kept = ingest.saved(judged, NOW).orderBy("id").collect()
    assert len(kept[0]) == 22
    assert (kept[0].company, kept[0].location, kept[0].description, kept[0].employment_type, kept[0].field, kept[0].state) == ("Acme", "Austin, TX", "Full-time. Build the site.", "Full-time", "Tech", "Texas")
    assert (kept[1].location, kept[1].posted_at, kept[1].description) == ("United States", None, "")
    assert [r.verdict for r in ingest.judged(boards.greenhouse_rows(_greenhouse(spark, rows[:1])), NOW, 7).collect()] == ["old"]


def test_gates_of_the_other_sources(spark):
    names = spark.createDataFrame([("acme", "Acme Inc."), ("blank", "")], "slug string, name string")
    made = [("a", "T", True, "2024-03-20T00:00:00Z", "Austin, TX", [("Paris",)], "x", None, None, "", "https://j", "acme"), ("b", "T", False, None, None, None, None, None, None, None, None, "blank"),
            ("c", "T", None, None, "Austin, TX", None, "x", None, None, None, None, "blank"), ("d", "T", None, "2024-03-20T00:00:00Z", "", [(None,)], "x", None, None, None, None, "blank")]
    rows = boards.ashby_rows(spark.createDataFrame(made, boards.ASHBY + ", slug STRING"), names)
    got = {r.id: r for r in ingest.judged(rows, NOW).collect()}
    assert {k: r.verdict for k, r in got.items()} == {"ashby_a": "saved", "ashby_b": "delisted", "ashby_c": "no_date", "ashby_d": "non_us"}
    assert (got["ashby_a"].company, got["ashby_a"].shown, got["ashby_a"].place, got["ashby_a"].apply_url, got["ashby_b"].company) == ("Acme Inc.", "Austin, TX", "Austin, TX, Paris", "https://j", "Blank")
    smart = [("1", "T", "2024-03-20T00:00:00Z", ("Austin", "AUSTIN", " US ", True, None), "BlueSky7"), ("2", "T", "2024-03-20T00:00:00Z", ("Austin", "TX", "ca", None, None), "x"), ("3", "T", "2024-03-20T00:00:00Z", ("Austin", "TX", "us", None, True), "x")]
    details = spark.createDataFrame([("1", "https://a", ({"jobDescription": ("<p>One.</p>",), "qualifications": (None,)},)), ("2", None, ({},))], boards.SMART_DETAIL)
    found = {r.id: r for r in ingest.judged(boards.smart_rows(spark.createDataFrame(smart, boards.SMART + ", slug STRING"), details, names), NOW).collect()}
    assert {k: r.verdict for k, r in found.items()} == {"sr_1": "saved", "sr_2": "non_us", "sr_3": "detail_failed"}
    assert (found["sr_1"].company, found["sr_1"].place, found["sr_1"].own_work_type, found["sr_3"].own_work_type, found["sr_3"].apply_url) == ("Blue Sky", "Austin", "Remote US", "Hybrid", "https://jobs.smartrecruiters.com/x/3")


def test_boards_that_did_not_answer_send_nothing(spark):
    rows = _greenhouse(spark, [("T", "Austin, TX", "", None)])
    empty = lambda schema: spark.createDataFrame([], schema)
    names = empty("slug string, name string")
    for ok, n in ((True, 1), (False, 0), (None, 0)):
        log = spark.createDataFrame([("acme", ok, 200, 1)], boards.FETCH_LOG)
        assert ingest.parsed(rows, empty(boards.ASHBY + ", slug STRING"), empty(boards.SMART + ", slug STRING"), empty(boards.SMART_DETAIL), names, log).count() == n
