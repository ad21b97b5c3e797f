"""URL filters, license scans and tool calls against plain Python, and the registry."""

import random

import pytest

import __spark_entry__ as entry_points
import compare
from strikehaz.llm import licenses, tool_calls, url_filters

RULES = [("allow", "org", "/"), ("block", "a.org", "/x"), ("allow", "a.org", "/x/y"), ("block", "a.org", "/x/y/z/"), ("block", "b.a.org", ""), ("allow", "A.org", "/x"), ("block", "", "/"), ("allow", "net", "/é")]


def _judge(url, rules, default="allow"):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    known = {}
    for verdict, h, p in rules:
        if h:
            known[h.lower(), p] = max(known.get((h.lower(), p), ""), verdict)
    fits = [(len(h + p), len(h), h + p, v) for (h, p), v in known.items() if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, default)


def test_url_rules_equal_plain_search(spark):
    rng = random.Random(6)
    urls = [None, "", "no scheme", "http://", "http://ORG/", "https://x.org", "http://a.org?x", "x://a.org/x/y/z/?q", "http://a.org/x\uffff\U0010ffff", "http://é.net/éa", "http://a..org//x", "://org/#", "http://b://org/x"]
    urls += [f"http://{rng.choice(['', 'b.', 'c.b.', 'xa'])}{rng.choice(['a.org', 'org', 'net', 'a.net'])}{rng.choice(['', '/', '/x', '/x/', '/x/y', '/x/y/z', '/x/y/z/1', '/w', '/é', '/xy'])}" for _ in range(300)]
    pages = spark.createDataFrame([(n, u, "h") for n, u in enumerate(urls)] + [(0, None, "h"), (None, "http://a.org/x", "h")], "page_id bigint, url string, rule string")
    for rules in (RULES, RULES[:1], [], [("block", "a.org", "/x" * k) for k in range(30)]):
        table = spark.createDataFrame(rules, "verdict string, host string, path string")
        got = sorted(map(str, map(tuple, url_filters.judged(pages, table).collect())))
        assert got == sorted(str((r.page_id, *_judge(r.url, rules))) for r in pages.collect())
    assert url_filters.judged(pages.where("false"), url_filters.rule_table(spark, RULES)).count() == 0


def test_url_rules_hold_over_many_ranges(spark):
    rules = [("block", "h.org", "/")] + [("allow" if k % 2 else "block", "h.org", "/" + "/".join(["d"] * k)) for k in range(1, 9)]
    pages = spark.createDataFrame([(k, f"http://w{k % 3}.h.org/" + "/".join(["d"] * (k % 11)) + f"/{k}") for k in range(400)], "page_id bigint, url string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judged(pages, url_filters.rule_table(spark, rules)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {r.page_id: _judge(r.url, rules) for r in pages.collect()}


def test_licenses_are_matched_and_inherited(spark):
    files = [
        (1, "LICENSE", "Released under the MIT License."), (2, "a/main.c", "code\nno statement"), (3, "a/b/COPYING", "Licensed under the Apache License, Version 2.0."),
        (4, "a/b/c/x.c", None), (5, "a/b/c/y.c", "code\n// This work is licensed under the GNU General Public License, version 3.\nmore"), (6, "a/b2/z.c", ""),
        (7, "a/b/LICENSE.txt", "a license of nobody's own making with many other words in it"), (8, None, "x"), (9, "a/b", "licensed under cc by-nc 4.0"), (4, "a/b/c/x.c", None),
    ]
    df = spark.createDataFrame(files, "doc_id bigint, path string, text string").selectExpr("*", "'x' AS license", "1 AS score", "'u' AS unit")
    got = {r.doc_id: (r.own_license, r.license, r.inherited_from) for r in licenses.licenses(df, licenses.template_table(spark)).collect()}
    assert got == {
        1: ("MIT", "MIT", None), 2: (None, "MIT", ""), 3: ("Apache-2.0", "Apache-2.0", None), 4: (None, "Apache-2.0", "a/b"), 5: ("GPL-3.0", "GPL-3.0", None),
        6: (None, "MIT", ""), 7: (None, "Apache-2.0", "a/b"), 8: (None, "MIT", ""), 9: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None),
    }
    assert licenses.licenses(df.where("false"), licenses.template_table(spark)).count() == 0
    assert {r.license for r in licenses.licenses(df, licenses.template_table(spark).where("false")).collect()} == {None}


def _calls(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, call_id string, turn bigint, name string, arguments string, after array<string>, content string, json string")


@pytest.fixture(scope="module")
def schemas(spark):
    return spark.createDataFrame([("f", "a", "string", True), ("f", "n", "number", False), ("f", "k", "integer", False), ("f", "o", "object", False), ("f", "l", "array", False), ("f", "b", "boolean", False)], "name string, parameter string, kind string, required boolean")


def test_calls_are_checked_and_canonical(spark, schemas):
    calls = _calls(spark, [
        (1, "c1", 1, "f", '{ "n": 1, "a": "x\\n\\"é" }', None, "z", "z"), (1, "c2", 2, "f", '{"n": "1"}', ["c1"], None, None), (1, "c3", 3, "g", "{}", ["c9"], None, None),
        (1, "c4", 4, "f", "not json", [], None, None), (1, "c5", 5, "f", None, [], None, None), (1, "c6", 6, "f", '{"a":"v","o":{"z":1,"b":[2,{"y":0,"x":1}]},"l":[],"b":true,"k":3}', [], None, None),
        (1, "c1", 9, "f", '{"a":"again"}', [], None, None), (None, "c1", 1, "f", "{}", [], None, None), (1, None, 1, "f", "{}", [], None, None), (2, "c1", 1, "f", '{"a":null,"zz":1,"k":1.5}', [], None, None),
    ])
    results = spark.createDataFrame([(1, "c1", 7, "late"), (1, "c1", 5, "early"), (1, "c6", 8, None), (1, "zz", 1, "orphan"), (None, "c1", 1, "n"), (1, "c2", 3, "r")], "conv_id bigint, call_id string, turn bigint, content string")
    got = {(r.conv_id, r.call_id): r for r in tool_calls.linked_calls(calls, results, schemas).collect()}
    assert {k: (r.step, r.status, r.faults, r.result_turn) for k, r in got.items()} == {
        (1, "c1"): (1, "ok", "", 5), (1, "c2"): (2, "invalid", "missing a; n is no number", 3), (1, "c3"): (3, "invalid", "unknown tool", None),
        (1, "c4"): (4, "invalid", "arguments are no object", None), (1, "c5"): (5, "invalid", "arguments are no object", None), (1, "c6"): (6, "ok", "", 8),
        (2, "c1"): (1, "invalid", "a is no string; k is no integer; unknown parameter zz", None),
    }
    assert got[1, "c1"].json == '{"arguments":{"a":"x\\n\\"é","n":1},"call_id":"c1","conv_id":1,"name":"f","result":"early"}'
    assert got[1, "c6"].json.startswith('{"arguments":{"a":"v","b":true,"k":3,"l":[],"o":{"b":[2,{"x":1,"y":0}],"z":1}},')
    assert '"arguments":"not json"' in got[1, "c4"].json and '"arguments":null' in got[1, "c5"].json
    assert sorted(str(r.call_id) for r in tool_calls.orphans(calls, results).collect()) == ["c1", "zz"]
    assert tool_calls.linked_calls(calls.where("false"), results, schemas).count() == 0


def test_calls_are_ordered_topologically(spark, schemas):
    chain = [(1, f"c{k:02d}", k, "f", '{"a":""}', [f"c{k + 1:02d}"] if k < 12 else [], None, None) for k in range(13)]
    loop = [(2, "a", 1, "f", '{"a":""}', ["b"], None, None), (2, "b", 2, "f", '{"a":""}', ["a"], None, None), (2, "c", 0, "f", '{"a":""}', ["b"], None, None), (2, "d", 9, "f", '{"a":""}', [], None, None)]
    plain = [(3, f"p{k}", 5000 - 700 * k, "f", '{"a":""}', [], None, None) for k in range(6)]
    none = spark.createDataFrame([], "conv_id bigint, call_id string, turn bigint, content string")
    got = {(r.conv_id, r.call_id): (r.step, r.status) for r in tool_calls.linked_calls(_calls(spark, chain + loop + plain), none, schemas).collect()}
    assert all(got[1, f"c{k:02d}"] == (13 - k, "unanswered") for k in range(13))
    assert got[2, "d"] == (1, "unanswered") and {got[2, x][1] for x in "abc"} == {"cyclic"} and sorted(got[2, x][0] for x in "abc") == [2, 3, 4]
    assert all(got[3, f"p{k}"][0] == 6 - k for k in range(6))


@pytest.mark.parametrize("name", ["op1_url_filters", "op5_license_scan", "op9_tool_calls", "op10_exact_dedup"])
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert compare.difference(entry_points.queries()[name](spark, sf), compare.connect(sf), entry_points.oracle_sql()[name]) is None


def test_every_operator_and_the_pipeline_are_registered():
    names = entry_points.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
