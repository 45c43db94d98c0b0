"""URL rules and infilled texts against plain versions."""

from __future__ import annotations

import hashlib
import random
import re

from papertally.llm import infilling, urls


def plain_judge(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3 :]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [
        (len(h + p), len(h), v == "block", v, h + p)
        for h, p, v in rules
        if None not in (h, p, v) and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[4].lower(), best[3] if best else default


RULES = [
    *urls.GIVEN, ("org", "/en", "block"), ("a.example.org", "", "allow"), ("example.org", "/en/x/", "block"), ("org", "/en/x", "allow"),
    ("EXAMPLE.edu", "/a", "block"), ("example.edu", "/a", "allow"), (None, "/", "block"), ("x", None, "block"), ("x", "/", None), ("", "", "block"),
]


def test_urls_as_judged_plainly(spark):
    pick = random.Random(5)
    hosts = ["example.com", "www.example.com", "WWW.Example.COM", "b.a.example.org", "a.example.org", "org", "notexample.com", "example.net.", "example.edu",
             "s.example.edu", "", ".com", "com", "xcom", "a..net", "user@example.com:80", "münchen.net"]
    paths = ["", "/", "/en/", "/en", "/english", "/en/x/y", "/es/", "/es", "/fr/1#t/es/", "?q=/en/", "#://net/es/", "/a", "/ä/en/", "//en/", "/en/x", "/\n/"]
    found = [f"https://{pick.choice(hosts)}{pick.choice(paths)}" for _ in range(300)]
    found += [None, "", "example.com/en/", "://", "http:/example.com/en/", "http://example.com/en/" + "a/" * 30000, "x://y://net/es/", found[0], found[0]]
    rows = [(i if i % 7 else None, u, "h", "c", 1) for i, u in enumerate(found)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, begin int")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    out = urls.filter_urls(pages, rules).collect()
    got = sorted(((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in out), key=repr)
    assert got == sorted(((r[0], r[1], *plain_judge(r[1], RULES)) for r in rows), key=repr)
    kept = urls.without_blocked(pages, rules)
    assert kept.columns == pages.columns
    assert kept.count() == sum(plain_judge(r[1], RULES)[3] != "block" for r in rows)


def test_urls_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (1, "http://a.com/x")], "page_id bigint, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in urls.filter_urls(pages, none).collect()] == [(1, "http://a.com/x", "a.com", "/x", None, "allow")] * 2
    assert urls.filter_urls(pages.limit(0), none).count() == 0
    assert urls.filter_urls(pages.limit(0), spark.createDataFrame(urls.GIVEN, none.schema)).count() == 0


def plain_form(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, z = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(a), len(b), f"<S>{z}<P>{a}<M>{b}"
    return doc_id, n, "psm", len(a), len(b), f"<P>{a}<S>{z}<M>{b}"


def test_infilling_as_formed_plainly(spark):
    pick = random.Random(7)
    parts = ["a", "été", " ", "\n\n", "\t", "<", "<P", "S>", "M", ">", "\u00a0", "\x1f", "\x0b", "😀", "word"]
    texts = ["".join(pick.choices(parts, k=pick.randint(0, 30))) for _ in range(400)]
    texts += [None, "", " ", "x<P>y", "<M>", "<S", "last < ", "y" * 3_000_000, "ab \n" * 700_000]
    rows = [(i if i != 3 else None, t, 9, "m") for i, t in enumerate(texts)] + [(5, texts[5], 9, "m")] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n int, output string")
    out = infilling.fill_in_middle(docs)
    back = out.select("*", infilling.restored(out["output"], out["form"]).alias("text")).collect()
    assert sorted((tuple(r)[:6] for r in back), key=repr) == sorted((plain_form(r[0], r[1]) for r in rows), key=repr)
    assert sorted((r.doc_id, r.text) for r in back if r.doc_id is not None) == sorted((r[0], r[1] or "") for r in rows if r[0] is not None)
    assert {r.form for r in back} == {"plain", "psm", "spm"}
    assert infilling.fill_in_middle(docs.limit(0)).count() == 0
