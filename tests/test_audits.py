"""Expected results of the audits, stated from the lists and patterns themselves."""
import pytest
from pyspark.sql import functions as F

from sievework.operators import audits


def _one(spark, value, *columns):
    row = spark.createDataFrame([value], ", ".join(f"c{i} string" for i in range(len(value)))).select(*[c.alias(f"o{i}") for i, c in enumerate(columns)]).first()
    return tuple(tuple(v) if isinstance(v, tuple) else v for v in row)


@pytest.mark.parametrize(("title", "label", "term"), [
    ("Data Engineer", "Software / Data / IT", "data engineer"), ("Nurse RN", "Healthcare / clinical", "nurse"), ("RN, nights", "Healthcare / clinical", "rn,"), ("Senior ML Lead", "Software / Data / IT", " ml "),
    ("Brand Architect", "Software / Data / IT", "architect"), ("Auditor", "Finance / accounting / legal", "auditor"), ("Audit lead", "Finance / accounting / legal", "audit"), ("Head Cook", "HR / admin / operations", "cook"),
    ("Chief of Staff", "Uncategorised", None), ("", "Uncategorised", None), (None, "Uncategorised", None),
])
def test_title_taxonomy(spark, title, label, term):
    (found,) = _one(spark, (title,), audits.title_taxonomy(F.col("c0")))
    assert found[:2] == (label, term)
    if term:
        assert f" {title.lower()} "[found[2] - 1 :].startswith(term)


@pytest.mark.parametrize(("text", "expected"), [
    ("We are a software bank for hospitals", ("Financial Services", "bank", "We are a software bank for hospitals")), ("Online banking here", ("Financial Services", "banking", "Online banking here")),
    ("claims, then insurance " + "x" * 60, ("Insurance", "claims", "claims, then insurance " + "x" * 17)), ("a" * 50 + " SaaS tools and more", ("Technology / SaaS", "saas", "a" * 39 + " SaaS tools and more")),
    ("embankment", None), ("", None), (None, None),
])
def test_industry(spark, text, expected):
    assert _one(spark, (text,), audits.industry(F.col("c0"))) == (expected,)


@pytest.mark.parametrize(("text", "title", "reason"), [
    ("", "Engineer (Contract)", "title parenthetical"), ("A part-time role", "Clerk", "part-time"), ("full-time/part-time", "Clerk", None), ("full-time" + " " * 10 + "or part-time", "Clerk", None),
    ("full-time" + " " * 30 + "or part-time", "Clerk", "part-time"), ("smart contract work, temporary", "Dev", None), ("temporary help", "Clerk", "contractor/temp"), ("temporary, may become permanent", "Clerk", None),
    ("This is a contract role", "Clerk", "contract position (adjacent)"), ("general contractor", "Clerk", None), (None, None, None),
])
def test_contract_reason(spark, text, title, reason):
    assert _one(spark, (text, title), audits.contract_reason(F.col("c0"), F.col("c1"))) == (reason,)


@pytest.mark.parametrize(("place", "hint"), [
    ("Remote - India", "remote-foreign"), ("Munich, DE", "munich"), ("Toronto, Canada", "canada"), ("Indiana", None), ("Austin, TX", None), ("New Delhi", "new delhi"), ("", None), (None, None),
])
def test_foreign_hint(spark, place, hint):
    assert _one(spark, (place,), audits.foreign_hint(F.col("c0"))) == (hint,)


@pytest.mark.parametrize(("text", "rule", "context"), [
    ("Engineer We cannot sponsor; must be a U.S. citizen with care", 5, "engineer we cannot sponsor; must be a us citizen with care"), ("x" * 100 + " no sponsorship " + "y" * 100, 32, "…" + "x" * 54 + " no sponsorship " + "y" * 54 + "…"), ("clean", None, None), ("", None, None),
])
def test_disqualifier_context(spark, text, rule, context):
    hit = spark.createDataFrame([(text,)], "t string").select(F.expr(audits.disqualifier_hit("t")).alias("h")).first().h
    assert (None if hit is None else (hit.rule, hit.context)) == (None if rule is None else (rule, context))


def test_titles_are_classified_without_a_shuffle_of_texts(spark):
    from sievework import queries as core

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame([(i, f"Data Engineer {i % 5}", "body") for i in range(50)], "id long, title string, body string")
        for most in (10, 2):  # few titles are broadcast, many are classified in place
            out = core.per_value(rows, "title", {"n": "length(title)"}, most)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert not [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "body" in line]
            assert ("BroadcastHashJoin" in plan) == (most == 10) and out.filter("n = 15").count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_details_of_a_posting(spark):
    from sievework.operators import probes

    jobs = spark.createDataFrame([("g1", "greenhouse", "s", "head", True), ("g2", "greenhouse", "s", "head", None), ("g3", "greenhouse", "s", None, False), ("a1", "ashby", "up", "head", True), ("a2", "ashby", "up", "head", False), ("a3", "ashby", "down", "head", True), ("s1", "smartrecruiters", "s", "head", None)],
                                 "id string, ats string, slug string, description string, closed boolean")
    answers = spark.createDataFrame([("g1", 200, "&lt;b&gt;Live"), ("g2", 404, "gone"), ("g3", 0, None), ("a1", 200, "a &lt; b"), ("a3", 200, "old"), ("s1", 200, "")], "id string, status int, live string")
    boards = spark.createDataFrame([("up", True), ("down", False)], "slug string, ok boolean")
    got = {r.id: (r.description, r.closed) for r in probes.job_details(jobs, answers, boards).collect()}
    assert got == {"g1": ("<b>Live", False), "g2": ("head", True), "g3": ("", False), "a1": ("a &lt; b", False), "a2": ("head", True), "a3": ("head", True), "s1": ("head", False)}
