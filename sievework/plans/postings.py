"""A table of postings made from the provided star-schema tables, and its SQL twin.

Titles, locations and bodies come from pools by the order key, so that every rule has rows to meet.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import Dialect, SPARK

TITLES = (
    "Data Engineer", "Senior Data Engineer", "Data Platform Engineer", "Senior DataOps Engineer", "Analytics Engineer", "Data Engineering Manager", "Legal Systems Engineer",
    "SNF Clinical Sales Director", "Registered Nurse - Night Shift", "Nurse Recruiter", "Marketing Attorney", "Territory Sales Representative - Cardiology Physician Partnership",
    "Civil Engineer I", "Mechanical Engineer", "Research Associate Intern", "Preschool Teacher", "HVAC Service Technician", "Warehouse Associate", "Staff Accountant", "Account Executive",
    "Talent Acquisition Partner", "Supply Chain Planner", "Product Manager", "Frontend Developer 1", "Customer Success Lead, Pharmacy", "Principal Consultant", "Chief of Staff",
    "Paralegal (Contract)", "Nursery Technician", "Registered NurseSenior Living Visits",
)
LOCATIONS = (
    "", "(Remote EU)", "Remote UK", "Remote - EMEA", "Remote (US)", "Remote, US", "Remote Austin, TX", "Remote", "Eugene, OR", "Westport, CT", "London, United Kingdom", "Cambridge, UK",
    "Brisbane, CA", "Venice, CA", "Munich, DE", "Paris", "75009, Paris", "Sydney Or Melbourne", "São Paulo", "Zürich", "Caddo Parish", "San Francisco (USA), Freiburg (Germany)",
    "Charleston, West Virginia", "Washington, District of Columbia", "WFMY-TV Studio", "Remote (Eastern Time)", "Middletown 06457", "Allentown", "Hybrid", "Multiple locations",
    "Kokomo, IN", "Allen, TX; Remote", "Marysville, MI 48040", "Smallville", "New York, NY | Boston, MA", "Gdańsk", "İstanbul", "Sa\u0303o Paulo", "Kraków or Montréal",
)
BODIES = (
    "We cannot support visa sponsorship for this role.", "We are happy to offer visa sponsorship.", "Our product does not support Internet Explorer.", "Applicants are not eligible for immigration sponsorship.",
    "You must be a U.S. citizen with an active secret clearance.", "Full-time. Clean posting, three to five people in the team.", "Employment Type: Contract (B2B) Contract Length: 6 months",
    "Contract Length: 12 months.", "Employment Type: Full-time.", "Full-time. Build smart contracts for our customers.", "Part-time role in the evenings.", "Benefits vary for full-time/part-time employment.",
    "Temporary or intern staff will not be eligible for the plan.", "Base salary $120,000 - $150,000 per year. 3-5 years of experience.", "Pay range $90k – $110k. 7+ years experience.",
    "We raised $100,000 - $200,000 in funding. Founded 10+ years ago.", "Compensation 80,000 - 95,000 USD. At least 2 years working in retail.", "Ages 18-55 years welcome.", "Salary $150,000 to $120,000.",
    "<p>Hybrid work &amp; a green card process. All citizens, regardless of origin.</p>", "Access to export-controlled data; a polygraph may apply under 22 CFR rules. Federal government customers.",
    "Contact me at a.b@example.org or 555-123-4567. Experience: Jan 2019 - Present. Skills: SQL.",
)
NOW = "2001-08-01 00:00:00"
RUN_START = "2001-07-20 00:00:00"


def sql(d: Dialect, orders: str = "orders", customer: str = "customer") -> str:
    text = "string" if d.spark else "varchar"
    low = f"cast(o_orderkey as {text})"
    return f"""
select concat('job_', {low}) as id, {d.pick(TITLES, f'(o_orderkey * 7 + o_custkey) % {len(TITLES)} + 1')} as title, c_name as company,
  concat('co', cast(c_custkey % 97 as {text})) as slug, {d.pick(LOCATIONS, f'(o_orderkey * 11 + o_custkey * 3) % {len(LOCATIONS)} + 1')} as location,
  {d.pick(BODIES, f'(o_orderkey * 13 + o_custkey * 5) % {len(BODIES)} + 1')} as body, case when o_orderkey % 11 = 0 then null else o_orderdate end as posted_at,
  o_orderdate + {d.days('o_orderkey % 40')} as fetched_at, {d.pick(('greenhouse', 'ashby', 'smartrecruiters'), 'o_orderkey % 3 + 1')} as ats,
  case when o_orderkey % 5 = 0 then true when o_orderkey % 5 = 1 then cast(null as boolean) else false end as closed,
  case when o_orderkey % 17 = 0 then '' when o_orderkey % 19 = 0 then cast(null as {text}) else concat('https://jobs.example.org/', cast(c_custkey % 97 as {text}), '/', {low}) end as apply_url
from {orders} join {customer} on o_custkey = c_custkey"""


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(sql(SPARK, "{orders}", "{customer}").replace("{", "{{").replace("}", "}}").replace("{{orders}}", "{orders}").replace("{{customer}}", "{customer}"),
                     orders=spark.read.parquet(f"{sf_dir}/orders.parquet"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
