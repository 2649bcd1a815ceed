"""Rules and trees on the web addresses of map features."""

import json
import re

import pytest

from acremark.llm import urls

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
FEATURE = "osm_type string, osm_id long, tags_json string, website string, host string, rule string, score string, _url string, f_length string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    name = re.match(r"[^/?#]*", rest).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), name), re.match(r"[^?#]*", rest[len(name):]).group()


def rule_of(url, rules=RULES):
    name, path = split(url)
    fitting = [(-len(h + p), len(p), h + p, v) for v, h, p in rules if (name == h or name.endswith("." + h)) and path.startswith(p)]
    return min(fitting)[2:] if fitting else (None, None)


def features(spark, addresses):
    rows = [("node", i, json.dumps({"website": u} if u is not None else {}), u, "h", "r", "s", "u", "f") for i, u in enumerate(addresses)]
    return spark.createDataFrame(rows, FEATURE)


ODD = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.ORG/en/17?x=/es/", "http://a.example.org?q=/fr/", "http://x.com#/de/", "http://x.com/de/",
       "http://xcom/de/", "https://a.b.com/fr/1://org/", "http://org", "http://org/", "ftp://Ż.org/ż", "http://.org/", "http://com./fr/", "http://a..com/de/é",
       "http://u:p@com/fr/", "http://example.org:80/es/", "x" * 20000 + "://example.org/es/" + "1" * 20000, "http://a.com/de/\n?1"]


def many(n=600):
    out = []
    for i in range(n):
        end = ["org", "com", "net"][i % 3]
        lang = ["en", "de", "fr", "es"][i // 3 % 4]
        out.append(f"http{'s' * (i % 2)}://w{i % 17}.example.{end}/{lang}/{i}{['', '.html', '/', '?page=1&ref=x', '#top'][i % 5]}")
    return out


def test_hosts_paths_and_rules(spark):
    addresses = ODD + many() + ODD
    got = urls.judge(features(spark, addresses).repartition(3), RULES).collect()
    assert len(got) == len(addresses)
    for r in got:
        rule, verdict = rule_of(addresses[r.osm_id])
        assert (r.host, r.path) == split(addresses[r.osm_id]) and r.rule == rule
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block") and 0 <= r.score <= 1
        assert (r.score is None) == (rule is not None)
    by_address = {}
    for r in got:
        assert by_address.setdefault(r.website, r.verdict) == r.verdict


def test_trees_learn_how_blocked_addresses_are_written(spark):
    learned = [f"http://s{i}.org/{'x' * (i % 9)}" for i in range(150)] + [f"http://n{i}.com/p/{i}/a/b/c?u={i}&v=1&w=2" for i in range(150)]
    fresh = [f"http://t{i}.test/{'y' * (i % 9)}" for i in range(20)] + [f"http://t{i}.test/q/{i}/a/b/c?u={i}&v=1&w=2" for i in range(20)]
    got = urls.judge(features(spark, learned + fresh), [("allow", "org", "/"), ("block", "com", "/")]).where("rule is null").orderBy("osm_id").collect()
    told = [r.verdict for r in got]
    assert told[:20].count("allow") >= 18 and told[20:].count("block") >= 18


@pytest.mark.parametrize("rules, verdict", [([], "allow"), ([("block", "org", "/")], "block"), ([("allow", "org", "/")], "allow")])
def test_one_verdict_or_none(spark, rules, verdict):
    got = urls.judge(features(spark, ["http://a.org/", "http://b.test/x", None]), rules).collect()
    assert {r.verdict for r in got} == {verdict}


def test_empty_tables_names_and_tags(spark):
    assert urls.judge(features(spark, []), RULES).count() == 0
    got = urls.judge(urls.websites(features(spark, ["http://a.org/x", None]).drop("website")), RULES)
    assert {"osm_type", "osm_id", "_url", "f_length", "host", "path", "rule", "verdict", "score"} <= set(got.columns)
    assert len(got.columns) == len(set(got.columns))
    assert [(r.host, r._url, r.f_length) for r in got.orderBy("osm_id").collect()] == [("a.org", "u", "f"), ("", "u", "f")]


def test_no_python_in_the_plan(spark):
    plan = urls.judge(features(spark, many()), RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
