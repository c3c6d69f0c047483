"""The template tree beside a plain recursion, and labels held out of it."""

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from loamline.llm import queries, urls


def plain(rows, plan):
    """(host, shape) -> (template, purity), host by host and level by level."""
    made = {}

    def walk(items, level, template):
        ends = [(s, l) for s, l in items if len(s) <= level]
        for s, _ in ends:
            made[host, s] = template
        groups = defaultdict(list)
        for s, l in items:
            if len(s) > level:
                groups[s[level]].append((s, l))
        labels = {k: [l for _, ls in v for l in ls if l] for k, v in groups.items()}
        total, bad = sum(map(len, labels.values())), sum(l.count("block") for l in labels.values())
        merged = defaultdict(list)
        for k, v in groups.items():
            n, b = len(labels[k]), labels[k].count("block")
            rest, other = total - n, bad - b
            if len(groups) == 1:
                literal = True
            elif n >= plan.few and rest >= plan.few:
                p = bad / total
                literal = abs(b / n - other / rest) > plan.z * math.sqrt(p * (1 - p) * (1 / n + 1 / rest))
            else:
                literal = len(groups) < plan.values
            merged["/" + k if literal else "/*"] += v
        for step, v in merged.items():
            walk(v, level + 1, template + step)

    hosts = defaultdict(lambda: defaultdict(list))
    for h, s, l in rows:
        hosts[h][tuple(s)].append(l)
    for host, shapes in hosts.items():
        walk(list(shapes.items()), 0, "")
    count = defaultdict(lambda: [0, 0])
    for h, s, l in rows:
        count[h, made[h, tuple(s)]][0] += l is not None
        count[h, made[h, tuple(s)]][1] += l == "block"
    return {k: (t, (count[k[0], t][1] + plan.prior) / (count[k[0], t][0] + 2 * plan.prior)) for k, t in made.items()}


def test_templates_against_a_plain_recursion(spark):
    rng, rows = random.Random(12), []
    for h in ("a.com", "b.org", ""):
        for _ in range(700):
            first = rng.choice(["wiki", "shop", "tag", "x"])
            second = rng.choice([f"p{rng.randrange(30)}", "sale", "about"])
            s = [first, second, *rng.choice([[], [], ["*"], ["*", "deep", "er"]])][:rng.randint(0, 5)]
            bad = (first == "shop") != (rng.random() < 0.05)
            rows.append((h, s, rng.choice(["block" if bad else "allow", None])))
    rows += [("one.net", ["wiki", f"p{i}"], "block") for i in range(50)] + [("bare.net", ["a"], None), ("bare.net", [], None)]
    plan = urls.Templates()
    found = urls.templates(spark.createDataFrame(rows, "host string, shape array<string>, label string"), plan).collect()
    got = {(r.host, tuple(r["shape"])): (r.template, r.purity) for r in found}
    assert got == plain(rows, plan) and len(found) == len(got)
    assert {r.template for r in found if r.host == "one.net"} == {"/wiki/*"}


def test_pages_without_a_rule_follow_their_template(spark):
    rng = random.Random(2)
    pages = [(i, f"http://s.com/{kind}/item-{i % 40}/{i}") for i, kind in enumerate(rng.choices(["spam", "news"], k=600))]
    rules = [urls.Rule.parse("block", "s.com/spam/item-1"), urls.Rule.parse("allow", "s.com/news/item-1")]  # covers item-1 and item-10 to item-19
    out = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), rules).collect()
    free = [r for r in out if r.rule is None]
    assert len(free) > 300 and all(r.verdict == ("block" if r.path.startswith("/spam") else "allow") for r in free)


def test_urls_odd_rows(spark):
    long = "http://h.com/" + "/".join(str(i) + "a" for i in range(300))
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "://"), (5, "x://H.Com?q"), (6, "x://h.com/a//b/"), (6, "x://h.com/a//b/"), (None, "x://h.com#f"), (7, long)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("mine") for c in ("host", "verdict", "template", "shape", "label", "_h")})
    out = urls.judge(df, [urls.Rule.parse("block", "com/a")])
    got = sorted((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in out.collect())
    assert got[0][:3] == (0, "h.com", "") and [g[1:3] for g in got[1:5]] == [("", ""), ("", ""), ("", ""), ("", "")]
    assert got[5][1:3] == ("h.com", "") and got[6] == got[7] == (6, "h.com", "/a//b/", "com/a", "block") and len(got) == 9
    assert set(out.columns) == {"page_id", "url", "host", "path", "rule", "template", "purity", "verdict", "shape", "label", "_h"}
    assert urls.judge(df.where("false"), []).count() == 0


def test_the_query_follows_the_rules_of_its_contract(spark, tmp_path):
    contract = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {r.text: r.verdict for r in queries.RULES} == contract and len(queries.RULES) == 5
    urls_of = ["http://a.com/en/7", "http://Example.com/en/71", "http://a.net/de/8", "http://example.net/de/81", "http://example.net/de/7", "http://org/es/"]
    rows = [(i, u) for i, u in enumerate(urls_of)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.rule, r.verdict) for r in queries.op8_url_templates(spark, str(tmp_path)).collect()}
    ruled = ["com/en/", "example.com/en/7", "net/de/", "example.net/de/8", "net/de/", "org/es/"]
    assert got == {i: (rule, contract[rule]) for i, rule in enumerate(ruled)}
