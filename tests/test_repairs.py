"""Drafts: repairs and their rounds against expected texts, and the plan of the joint verdict."""
import pytest

from sievework import catalogue
from sievework import queries as core
from sievework.operators import drafts, gates, staging
from sievework.plans import resumes

SF = "/root/testdata/sf0.001"
HEAD = ["Jo Doe", "Dallas, TX", "jo@example.org"]
ORIGINAL = [*HEAD, "SUMMARY", "Builds data pipelines for stores.", "EXPERIENCE", "Acme | Engineer | Jan 2019 - Present", "- Build streaming jobs that load billions of rows daily", "EDUCATION", "B.S. in Mathematics"]
NOTE = "Note: I am happy to say that this document was written with care and that all of what you asked me to add to it is there, as you can see above."


def _lines(spark, versions):
    return spark.createDataFrame([(d, i, line) for d, lines in versions.items() for i, line in enumerate(lines)], "doc_id long, line_no int, line string")


def _repaired(spark, versions, **options):
    original = _lines(spark, {d: ORIGINAL for d in versions})
    return {r.doc_id: r for r in drafts.repaired_drafts(original, _lines(spark, versions), **options).collect()}


def test_each_repair(spark):
    clean = "\n".join(ORIGINAL)
    got = _repaired(spark, {
        1: ORIGINAL,
        2: [*ORIGINAL, NOTE],
        3: [*ORIGINAL[:8], "AWARDS", "Best engineer of the year", "- Won a prize", *ORIGINAL[8:]],
        4: [*ORIGINAL, "VOLUNTEERING:", "Taught at school"],
        5: [*ORIGINAL[:7], ORIGINAL[7] + ", VMCE and DP-203.", *ORIGINAL[8:]],
        6: [*ORIGINAL[:7], ORIGINAL[7] + ".• Build streaming jobs that load billions of rows", *ORIGINAL[8:]],
        7: [*ORIGINAL[:7], "- Negotiate lower freight prices with overseas carriers", *ORIGINAL[8:]],
    })
    assert {d: (r.rounds, r.failed) for d, r in got.items() if d != 6} == {1: (0, ""), 2: (1, ""), 3: (1, ""), 4: (1, ""), 5: (1, ""), 7: (0, "invented")}
    assert got[1].text == got[2].text == got[3].text == got[4].text == clean
    assert got[5].text == clean.replace("daily", "daily and.")
    assert (got[6].rounds, got[6].failed) == (1, "") and "daily.\n• Build" in got[6].text
    assert "Negotiate" in got[7].text


def test_rounds_end(spark):
    """Two invented sections of one name: each round cuts the first, the last judgement names what is left."""
    doubled = [*ORIGINAL, "AWARDS", "One", "EDUCATION", "Two", "AWARDS", "Three", "EDUCATION", "Four", "AWARDS", "Five"]
    got = _repaired(spark, {1: doubled})
    assert (got[1].rounds, got[1].failed) == (3, "") and "AWARDS" not in got[1].text
    short = _repaired(spark, {1: doubled}, rounds=2)
    assert (short[1].rounds, short[1].failed) == (2, "sections") and short[1].text.count("AWARDS") == 1
    assert _repaired(spark, {}) == {}


def test_confirmed_skills_are_expected_to_be_new(spark):
    old = _lines(spark, {1: ORIGINAL})
    new = _lines(spark, {1: [*ORIGINAL[:7], "- Build jobs with Terraform Kubernetes Snowflake Airflow Databricks daily", *ORIGINAL[8:]]})
    assert gates.invented_bullets(new, old).count() == 1
    assert gates.invented_bullets(new, old, skills=("Terraform", "Kubernetes", "Snowflake Airflow")).count() == 0
    verdict = lambda *skills: drafts.verdicts(old, new, skills).first().failed
    assert (verdict(), verdict("Terraform", "Kubernetes", "Snowflake Airflow")) == ("invented", "")


def test_the_joint_verdict_reads_each_version_once(spark):
    plan = core.QUERIES["gate_verdict"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("+- == Initial Plan ==")[-1]
    assert initial.count("FileScan") == 2 and initial.count("Exchange hashpartitioning") <= 4


def test_originals_are_never_broadcast(spark):
    """A written table of originals is a few kilobytes of equal lines, its rows are not."""
    of_original = staging.written(drafts.facts(_lines(spark, {d: ORIGINAL for d in range(200)})))
    judged = drafts.repair_round(of_original, drafts.whole(_lines(spark, {d: [*ORIGINAL, NOTE] for d in range(200)})))
    assert "Broadcast" not in judged._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in judged.groupBy("text", "failed").count().collect()] == [("\n".join(ORIGINAL), ["stray"], 200)]


@pytest.mark.parametrize("text", ["", "no titles here", "AWARDS"])
def test_texts_without_lines_to_cut(spark, text):
    lines = spark.createDataFrame([(1, 0, text)], "doc_id long, line_no int, line string")
    assert drafts.repaired_drafts(lines, lines).select("text").first().text == text
    assert drafts.verdicts(lines, lines).first().passed


def test_tampered_drafts_have_every_repairable_fault(spark):
    original, draft = resumes.lines(spark, SF, 0), catalogue._tampered(spark, SF)
    before = {x for r in drafts.verdicts(original, draft).collect() for x in r.failed.split(",")}
    after = {x for r in drafts.repaired_drafts(original, draft).collect() for x in r.failed.split(",")}
    assert set(drafts.REPAIRABLE) <= before
    assert not after & {"certs", "merged", "stray"}  # a section under another name than its canonical one has no line to cut
