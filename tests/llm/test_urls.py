import re

from nearfield.llm import registered, urls
from nearfield.llm.registered import RULES


def parse(url):
    _, sign, rest = (url or "").partition("://")
    if not sign:
        return "", ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fitting = []
    for r in RULES:
        name, _, rest = r.target.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fitting.append((len(r.target), r.target, r.verdict))
    return max(fitting)[1:] if fitting else (None, None)


def check(rows, got):
    assert len(got) == len(rows)
    want = {}
    for page, url in rows:
        want[page] = (*parse(url), *rule_of(*parse(url)))
    for r in got:
        host, path, rule, verdict = want[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()]
    check(rows, registered.op9_path_templates(spark, sf_dir).collect())


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string").repartition(3)


ODD = [
    (1, None), (2, ""), (3, "no sign"), (4, "http://"), (5, "http://ORG/x"), (6, "http://a.org"), (7, "http://b.Example.ORG/es/1?x=/de/"),
    (8, "x://y://z.com/de/1"), (9, "http://com/de/" + "a/" * 5000), (10, "http://\u00c9.com/fr/\n2"), (11, "http://example.org/en/12#/es/"),
    (12, "http://notexample.org/es/"), (13, "http://org?x"), (14, "http://a.com//de/"), (15, "http://h/" + "9" * 20000),
]


def test_odd_rows(spark):
    from pyspark.sql import functions as F

    df = pages(spark, ODD)
    check(ODD, urls.judged(df, RULES).collect())
    extra = df.withColumns({x: F.lit("extra") for x in ("host", "path", "rule", "verdict", "n", "s0", "template", "purity", "labelled", "prior")})
    assert sorted(map(str, urls.judged(extra, RULES).collect())) == sorted(map(str, urls.judged(df, RULES).collect()))
    assert urls.judged(pages(spark, []), RULES).count() == 0
    assert urls.judged(df.union(df), RULES).count() == 2 * len(ODD)
    assert {r["verdict"] for r in urls.judged(df, []).collect()} == {"allow"}


def test_rejects_templates_by_purity(spark):
    """Labels on some URLs of a branch reject the rest of it, and leave other branches alone."""
    rows, n = [], 0
    for i in range(60):
        for path in (f"/spam/{i}", f"/news/{i}", f"/spam/x{i}"):
            rows.append((n := n + 1, f"http://a.net{path}"))
        rows.append((n := n + 1, f"http://b.net/spam/{i}"))
    rules = [urls.Rule("block", "a.net/spam/x"), urls.Rule("allow", "a.net/news/1")]
    rules += [urls.Rule("block", f"a.net/spam/{i}") for i in range(3, 6)]
    got = {r["page_id"]: r for r in urls.judged(pages(spark, rows), rules).collect()}
    for page, url in rows:
        if url.startswith("http://a.net/spam/") and not url.startswith("http://a.net/spam/x"):
            assert got[page]["verdict"] == "block", got[page]
        if "news" in url or "b.net" in url:
            assert got[page]["verdict"] == "allow", got[page]


def test_wide_branches_become_wildcards(spark):
    rows = [(i, f"http://a.net/item/slug{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(400)]
    found = {r["template"] for r in urls.judged(pages(spark, rows), []).collect()}
    assert found == {"/item/*"}


def test_deep_segments_are_told_apart(spark):
    """Branches that begin at the fifth segment and below, and long paths that differ at their ends."""
    rows, n = [], 0
    for i in range(100):
        for branch in ("bad", "good", "good/x/y/bad", "good/x/y/fine"):
            rows.append((n := n + 1, f"http://a.net/a/b/c/d/{branch}/{i}"))
    long = "l/" * 900
    rows += [(n + 1, f"http://b.net/{long}x"), (n + 2, f"http://b.net/{long}y"), (n + 3, f"http://b.net/{long}")]
    rules = [urls.Rule("block", "a.net/a/b/c/d/bad/1"), urls.Rule("allow", "a.net/a/b/c/d/good/1"), urls.Rule("block", "a.net/a/b/c/d/good/x/y/bad/1"), urls.Rule("allow", "a.net/a/b/c/d/good/x/y/fine/1")]
    got = {r["page_id"]: r for r in urls.judged(pages(spark, rows), rules).collect()}
    assert len(got) == len(rows)
    for page, url in rows:
        assert got[page]["verdict"] == ("block" if "/bad/" in url else "allow"), got[page]
    assert {got[n + i]["template"] for i in (1, 2, 3)} == {"/" + long + "x", "/" + long + "y", "/" + long[:-1]}


def test_labels_reject_no_unlabelled_siblings(spark):
    """Few siblings of a blocked branch, and many rare ones."""
    rows, n = [], 0
    for path, times in [("de", 7), ("fr", 2), ("en", 17), ("es", 2)]:
        rows += [(n := n + 1, f"http://a.net/{path}/{i}") for i in range(times)]
    rows += [(n := n + 1, f"http://b.net/{'spam' if i == 0 else f'branch{chr(97 + i % 26)}{chr(97 + i // 26)}'}/{j}") for i in range(100) for j in range(10)]
    got = {r["page_id"]: r["verdict"] for r in urls.judged(pages(spark, rows), [urls.Rule("block", "a.net/de/"), urls.Rule("allow", "a.net/fr/"), urls.Rule("block", "b.net/spam/")]).collect()}
    for page, url in rows:
        assert got[page] == ("block" if "/de/" in url or "/spam/" in url else "allow"), url


def test_rare_blocked_branch_of_a_wide_host_stays(spark):
    names = [f"n{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100)]
    rows, n = [], 0
    for name in names:
        rows += [(n := n + 1, f"http://a.net/{name}/{i}") for i in range(80)]
    rows += [(n := n + 1, f"http://a.net/spam/{i}") for i in range(100)]
    rules = [urls.Rule("allow", f"a.net/{name}/1") for name in names] + [urls.Rule("block", f"a.net/spam/{i}") for i in range(1, 6)]
    got = {r["page_id"]: r for r in urls.judged(pages(spark, rows), rules).collect()}
    for page, url in rows:
        assert got[page]["verdict"] == ("block" if "/spam/" in url else "allow"), got[page]


def shape_of(path):
    shape = re.sub("/+$", "", re.sub("^/", "", path))
    return re.sub("[0-9]+", "{n}", re.sub("[0-9a-fA-F]{16,}", "{h}", shape))


def rebuilt(rows, rules, wide=20, rare=0.02, z=1.96, weight=4.0, threshold=0.8, speakers=3):
    """{page: (verdict, template)}: the same trees by plain recursion over lists."""
    found, sites = {}, {}
    for page, url in rows:
        host, path = parse(url)
        fitting = [(len(r.target), r.verdict) for r in rules for name, _, rest in [r.target.partition("/")] if (host == name or host.endswith("." + name)) and path.startswith("/" + rest)]
        verdict = max(fitting)[1] if fitting else None
        found[page] = (host, shape_of(path), verdict)
        line = sites.setdefault(host, {}).setdefault(shape_of(path), [0, 0, 0])
        line[0] += 1
        line[1] += verdict is not None
        line[2] += verdict == "block"

    def differs(part, of, whole_part, whole):
        if not of or not whole:
            return False
        p = (whole_part + 0.5) / (whole + 1)
        return abs(part / of - whole_part / whole) > z * (p * (1 - p) / of) ** 0.5

    def grow(items, template, out):
        """items: (rest, shape, n, labelled, blocked)"""
        first, skip = items[0][0], 0
        while all(len(x[0]) > skip for x in items) and all(x[0][skip] == first[skip] for x in items):
            skip += 1
        template += "".join("/" + x for x in first[:skip])
        items = [(x[0][skip:], *x[1:]) for x in items]
        if not any(x[0] for x in items):
            for x in items:
                out[x[1]] = template
            return
        kids = {}
        for x in items:
            kids.setdefault("/" + x[0][0] if x[0] else "", []).append(x)

        def stats(xs):
            held = [sum(x[2] for x in xs if len(x[0]) <= 1), sum(x[2] for x in xs if len(x[0]) > 1 and re.search("[{][hn][}]", x[0][1])), sum(x[2] for x in xs if len(x[0]) > 2)]
            return [sum(x[i] for x in xs) for i in (2, 3, 4)], held

        known = {s: stats(xs) for s, xs in kids.items()}
        total = [sum(v[0][i] for v in known.values()) for i in range(3)]
        branches = {s: v for s, v in known.items() if s}
        whole = sum(v[0][0] for v in branches.values())
        whole_held = [sum(v[1][i] for v in branches.values()) for i in range(3)]
        shares = [v[0][2] / v[0][1] for v in branches.values() if v[0][1]]
        agreed = len(shares) >= speakers and 2 * len(shares) > len(branches) and (min(shares) >= threshold or max(shares) <= 1 - threshold)
        grown = {}
        for s, xs in kids.items():
            (n, labelled, blocked), held = known[s]
            unlike = any(differs(held[i], n, whole_held[i], whole) for i in range(3))
            apart = labelled > 0 and differs(blocked, labelled, total[2], total[1])
            alike = not unlike and (sum(v[0][1] > 0 for v in known.values()) > 1 and not apart if labelled else agreed)
            odd = not labelled and len(kids) > wide and n < rare * total[0]
            name = "" if s == "" else "/{alike}" if alike else "/*" if odd else s
            if s == "":
                for x in xs:
                    out[x[1]] = template
            else:
                grown.setdefault(name, []).extend((x[0][1:], *x[1:]) for x in xs)
        for name, xs in grown.items():
            grow(xs, template + name, out)

    verdicts = {}
    for host, shapes in sites.items():
        out = {}
        grow([(tuple(x.split("/")) if x else (), x, *line) for x, line in shapes.items()], "", out)
        sums = {}
        for x, line in shapes.items():
            own = sums.setdefault(out[x], [0, 0])
            own[0] += line[1]
            own[1] += line[2]
        prior = min(0.5, (sum(v[1] for v in sums.values()) + weight * 0.5) / (sum(v[0] for v in sums.values()) + weight))
        for x in shapes:
            labelled, blocked = sums[out[x]]
            verdicts[host, x] = ("block" if (blocked + weight * prior) / (labelled + weight) >= threshold else "allow", out[x])
    return {page: (verdict or verdicts[host, x][0], verdicts[host, x][1]) for page, (host, x, verdict) in found.items()}


def test_trees_of_random_sites(spark):
    """Against a plain rebuild: templates and verdicts of sites of all kinds of depth, width and labels."""
    import random

    rng = random.Random(12)
    words = ["news", "spam", "item", "about", "x", "archive", "de", "fr", "tag", "deadbeefdeadbeef01", "2024", "a1"]
    rows, rules = [], []
    for h in range(30):
        host = f"h{h}.net"
        few = rng.sample(words, rng.randint(2, 8)) + [f"n{chr(97 + i)}" for i in range(rng.choice([0, 0, 30]))]
        for _ in range(rng.choice([5, 60, 300])):
            rows.append((len(rows), f"http://{host}/" + "/".join(rng.choice(few) if rng.random() < 0.7 else str(rng.randint(0, 99)) for _ in range(rng.randint(0, 5))) + rng.choice(["", "/"])))
        for x in rng.sample(few, rng.randint(0, len(few))):
            rules.append(urls.Rule(rng.choice(["block", "block", "allow"]) if h % 3 else "block", f"{host}/{x}" + rng.choice(["", "/1", "/"])))
    got = {r["page_id"]: (r["verdict"], r["template"]) for r in urls.judged(pages(spark, rows), rules).collect()}
    assert got == rebuilt(rows, rules)
    assert any("{alike}" in t for _, t in got.values()) and any(t.count("/") > 4 for _, t in got.values())


def test_the_whole_table_against_the_rebuild(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()]
    got = {r["page_id"]: (r["verdict"], r["template"]) for r in registered.op9_path_templates(spark, sf_dir).collect()}
    assert got == rebuilt(rows, RULES)


def test_branches_alike_are_judged_by_their_siblings(spark):
    """A seeded table: of twelve branches of a kind, nine with labels; three more hosts say when siblings do not count."""
    rows, rules, want = [], [], {}

    def put(url, verdict):
        rows.append((len(rows), url))
        want[len(rows) - 1] = verdict

    for host, labels in (("spam.net", ["block"] * 9), ("fine.net", ["allow"] * 9), ("mixed.net", ["block"] * 7 + ["allow"] * 2), ("few.net", ["block"] * 4)):
        for b in range(12):
            name = f"branch{chr(97 + b)}"
            verdict = labels[b] if b < len(labels) else "block" if host == "spam.net" else "allow"
            if b < len(labels):
                rules.append(urls.Rule(labels[b], f"{host}/{name}/"))
            for i in range(30):
                put(f"http://{host}/{name}/{i}", verdict)
        for i in range(30):
            # A branch of another kind, in a host full of blocked ones.
            put(f"http://{host}/about/team/{'abcdefghij'[i % 10]}/{'klmnopqrst'[i // 3]}", "allow")
    got = {r["page_id"]: r["verdict"] for r in urls.judged(pages(spark, rows), rules).collect()}
    assert got == want
    unruled = [p for p, url in rows if url.startswith("http://spam.net/branch") and url.split("/")[3] >= "branchj"]
    assert len(unruled) == 90 and all(got[p] == "block" for p in unruled)
