"""Robots rules by small files and addresses."""

import pytest

from leadlattice.sources import robots

FILE = """
# remark
User-agent: a
User-agent: leadlattice   # ours
Disallow: /private
Allow: /private/open
Disallow: /*.pdf$
Disallow: /q?*x=
Disallow:
Allow: /same
Disallow: /same

User-agent: lead
Disallow: /

user-agent: LEADLATTICE
Disallow: /second (group)
"""
CASES = [
    ("/", True), ("", True), ("/private", False), ("/privately", False), ("/private/open/x", True), ("/a/b.pdf", False), ("/a/b.pdfx", True), ("/q?y=1&x=2", False), ("/q?y=1", True), ("/same/thing", True),
    ("/second (group)/x", False), ("/Private", True), ("/x#/private", True), ("/a\\Eb", True),
]


@pytest.mark.parametrize("ends", ["\n", "\r\n", "\r"])
def test_the_longest_rule_of_the_agents_groups_decides(spark, ends):
    rules = robots.robot_rules(spark.createDataFrame([("h", FILE.replace("\n", ends)), ("none", None), ("html", "<html>: no rules")], "host string, body string"), "LeadLattice")
    pages = spark.createDataFrame([(i, "h", f"https://h{path}") for i, (path, _) in enumerate(CASES)] + [(90, "none", "https://none/private"), (91, "html", "https://html/"), (92, "h", None), (93, "elsewhere", "https://elsewhere/")], "page_id int, host string, url string")
    got = {r["page_id"]: r["allowed"] for r in robots.allowed(pages, rules).collect()}
    assert got == dict(enumerate(x for _, x in CASES)) | {90: True, 91: True, 92: False, 93: True}


def test_other_agents_and_candidates(spark):
    files = spark.createDataFrame([("h", FILE)], "host string, body string")
    assert {r["pattern"] for r in robots.robot_rules(files, "leader").collect()} == {"/"}
    assert robots.robot_rules(files, "other").count() == 0
    hosts = spark.createDataFrame([("h",), ("g",)], "host string")
    blocked = robots.robot_rules(spark.createDataFrame([("h", "User-agent: *\nDisallow: /about\nDisallow: /contact")], "host string, body string"), "x")
    got = sorted((r["nth"], r["url"]) for r in robots.candidate_pages(hosts, blocked, most=2).collect())
    assert got == [(1, "https://g/"), (1, "https://h/"), (2, "https://g/about"), (2, "https://h/tours")]
