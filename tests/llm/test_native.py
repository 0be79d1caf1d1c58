"""Sharding, personal data and URL templates: invariants, brute force, and no Python on the executors."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort.llm import pii_boost, queries, shard_matrix, url_templates
from llm_cases import NAMES, ODD_TEXTS, SF, base, line



def native(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not re.search("Python|Pandas|Arrow", plan)


# ---- sharding --------------------------------------------------------------------
def test_shards_are_even_and_gapless(spark, documents):
    df = queries.op2_shard_matrix(spark, SF)
    assert native(df)
    rows = df.collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        text = dict(documents)[r.doc_id].encode()
        assert r["size"] == len(text) + 8 and r.text_crc32 == zlib.crc32(text) and r.law == "rows" and r.grown_shard is None
    assert sorted(by) == list(range(24)) and len(rows) == len(documents)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, queries.op2_shard_matrix(spark, SF).collect()), key=str)


def test_shuffle_is_uniform(spark, monkeypatch):
    monkeypatch.setattr(shard_matrix, "BLOCK_ROWS", 64)
    n, shards, rounds = 1_200, 6, 6
    counts = np.zeros((4, shards))
    for seed in range(rounds):
        for r in shard_matrix.assign_shards(spark.range(n), shards, seed).collect():
            counts[r.id * 4 // n, r.shard] += 1
    expected = n * rounds / 4 / shards
    assert ((counts - expected) ** 2 / expected).sum() < 40  # 15 degrees of freedom: far beyond the 99.9 % point


def test_matrix_has_exact_margins_and_the_right_law():
    counts, sizes = shard_matrix.matrix([100, 0, 37, 500], 7, 3)
    assert counts.sum(1).tolist() == [100, 0, 37, 500] and counts.sum(0).tolist() == sizes.tolist() and sizes.max() - sizes.min() <= 1
    rng = np.random.default_rng(1)
    draws = np.array([shard_matrix.hypergeometric(rng, 30, 70, 20) for _ in range(20_000)])
    assert abs(draws.mean() - 6) < 0.06 and abs(draws.var() - 20 * .3 * .7 * 80 / 99) < 0.12
    big = [shard_matrix.hypergeometric(rng, 10**11, 23 * 10**11, 10**9) for _ in range(200)]
    assert abs(np.mean(big) - 10**9 / 24) < 2_000


def test_shard_edge_cases(spark, odd, empty):
    out = shard_matrix.assign_shards(odd, 24)
    assert out.count() == len(ODD_TEXTS) and out.select("shard", "slot").distinct().count() == len(ODD_TEXTS)
    assert shard_matrix.assign_shards(empty, 24).count() == 0
    with pytest.raises(ValueError):
        shard_matrix.assign_shards(empty.withColumnRenamed("lang", "shard"), 24)


# ---- personal data -----------------------------------------------------------------
def test_base_spans_on_the_table(spark, documents):
    df = queries.op4_pii_boost(spark, SF)
    assert native(df)
    got = {r.doc_id: r for r in df.collect()}
    for i, t in documents:
        want = base(t)
        assert got[i].base_sha256 == hashlib.sha256(line(want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in NAMES] == [sum(s[1] == k for s in want) for k in range(4)]
        assert set(filter(None, line(want).split(","))) <= set(filter(None, got[i].spans.split(",")))


TRICKY = ["a@b.c_d@e.f", "x@y@z.com", "a@b..c@d.e f.g@h.i.j-", "1.2.3.4.5.6.7.8", "0255.1.1.1 256.1.1.1 1.2.3.00000004", "4111 1111 1111 1111-", "4111-1111  1111",
          "é 4111111111111111é5500-0000-0000-0004", "+1 (017) 555-7713 +12 +1234567890123456 ++123456789", "+1 (017) 555-7713 1.2.3.4", "12 34 56 78 90 12",
          "9" * 4_000, "1 " * 4_000, "a" * 20_000 + "@b.cc", ".@-.-", "日本 a@b.cd 日本", "a.b@c.d.e.f.g" * 50, "+1" * 3_000, "1." * 3_000, *ODD_TEXTS]


def test_tricky_texts_redaction_and_odd_rows(spark, empty):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TRICKY)], "doc_id long, text string, spans string")
    rows = pii_boost.find_spans(df, pii_boost.Boost(), keep=["doc_id"])
    out = rows.select("doc_id", pii_boost.listed(rows.base).alias("b"), pii_boost.redacted(rows.text, rows.spans).alias("r")).collect()
    for r in out:
        spans, text, want, at = base(TRICKY[r.doc_id]), TRICKY[r.doc_id] or "", "", 0
        assert r.b == line(spans)
        for s, k, e in spans:
            if s >= at:
                want += text[at:s] + f"[{NAMES[k].upper()}]"
            at = max(at, e)
        assert r.r == want + text[at:]
    assert pii_boost.fit(empty).trees == []
    assert pii_boost.find_spans(empty, pii_boost.Boost(), keep=["doc_id"]).count() == 0


def numbers(share, n=1_500):
    """Texts with phone numbers, a share of them without the plus, and order numbers that look otherwise; (row, the new format's spans)."""
    rnd, rows, new = random.Random(7), [], {}
    for i in range(n):
        plain = rnd.random() < share
        phone = f"{'' if plain else '+'}1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}"
        head = f"dear customer, please call "
        rows.append((i, f"{head}{phone} today about order {rnd.randint(10**9, 10**10)} of lot {rnd.randint(10, 99)} {rnd.randint(10, 99)} {rnd.randint(10**5, 10**6)}"))
        if plain:
            new[i] = (len(head), len(head) + len(phone))
    return rows, new


@pytest.mark.parametrize("share", [0.01, 0.05, 0.3])
def test_unknown_formats_are_found_at_production_parameters(spark, share):
    rows, new = numbers(share)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii_boost.fit(df)
    assert model.trees and model.thresholds[NAMES.index("phone")] <= 1
    found = pii_boost.find_spans(df, model, keep=["doc_id"])
    assert native(found)
    out = {r.doc_id: r for r in found.collect()}
    more = {i: {(x.s, x.e) for x in r.spans} - {(x.s, x.e) for x in r.base} for i, r in out.items()}
    caught = sum(new[i] in more[i] for i in new)
    wrong = sum(len(m - {new.get(i)}) for i, m in more.items())
    assert len(new) >= 5 and caught >= 0.9 * len(new) and wrong <= 0.02 * len(rows)
    assert all(set(r.base) <= set(r.spans) for r in out.values())


def test_look_alikes_without_known_spans_add_nothing(spark):
    rows, _ = numbers(1.0, 600)
    model = pii_boost.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    assert min(model.thresholds) > 1


def test_thresholds_scan_all_bins():
    good = [(b, 10, 2, 0) for b in range(100, 200)]
    assert pii_boost.threshold(good) == 0.5
    assert pii_boost.threshold(good[:50] + [(150, 0, 1, 1)] + good[51:]) == 0.5  # one odd bin is pooled
    assert pii_boost.threshold([(10, 0, 500, 0), *good]) == 0.5 and pii_boost.threshold([(10, 0, 0, 500), *good]) == 0.5
    assert pii_boost.threshold([(b, 1, 0, 0) for b in range(5)]) == 2.0  # too few
    assert pii_boost.threshold([]) == 2.0
    shares = pii_boost.rising([(0, 4), (3, 1), (1, 3), (8, 0)])
    assert shares == [0.0, 0.5, 0.5, 1.0]


def test_a_text_with_100_000_addresses(spark):
    import time
    text = " ".join(f"user{i}@host{i % 97}.example" for i in range(100_000))
    df = spark.createDataFrame([(1, text), (2, "+1 (321) 555-4321 " * 3_000)], "doc_id long, text string")
    model = pii_boost.Boost([[pii_boost.FEATURES.index("digits"), 3.0, -1.0, 1.0]], [1.0], [0.5] * 4)
    t0 = time.time()
    rows = pii_boost.find_spans(df, model, keep=["doc_id"])
    out = {r.doc_id: r for r in rows.select("doc_id", F.size("base").alias("n"), F.size("spans").alias("m"), pii_boost.redacted(F.col("text"), F.col("spans")).alias("r")).collect()}
    assert time.time() - t0 < 120
    assert out[1].n == out[1].m == 100_000 and out[1].r == " ".join(["[EMAIL]"] * 100_000) and out[2].n == 3_000


def brute_free(found, base):
    return [c for c in found if not any(b[0] < c[1] and c[0] < b[1] for b in base)]


def test_candidates_that_meet_a_base_span_are_left_out(spark):
    rnd, rows = random.Random(1), []
    for i in range(200):
        spans = lambda n: sorted((s, s + rnd.randint(1, 9)) for s in (rnd.randrange(120) for _ in range(n)))
        rows.append((i, spans(rnd.randint(0, 12)), spans(rnd.randint(0, 12))))
    df = spark.createDataFrame(rows, "i int, found array<struct<s:int,e:int>>, base array<struct<s:int,e:int>>")
    got = df.select("i", F.transform(pii_boost._free(F.col("found"), F.col("base")), lambda x: F.array(x["s"], x["e"])).alias("x")).collect()
    assert {r.i: sorted(map(tuple, r.x)) for r in got} == {i: sorted(brute_free(f, b)) for i, f, b in rows}


# ---- urls --------------------------------------------------------------------------
def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):], re.S)[0]


def rule(host, path):
    best = None
    for v, h, p in url_templates.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = v, h + p
    return best


NUMBER = r"[0-9]+(\.[A-Za-z0-9]{1,5})?"


def brute_branches(kids):
    """(segment, labelled, blocked) by rate and segment, in branches; each is tested against its branch's pooled counts."""
    done, segs, l, b = [], [], 0, 0
    for s, n, k in sorted(kids, key=lambda x: (x[2] / x[1], x[0])):
        pooled = (b + k) / (l + n)
        apart = l and 0 < pooled < 1 and (k / n - b / l) / (pooled * (1 - pooled) * (1 / n + 1 / l)) ** 0.5 >= url_templates.Z
        if apart:
            done, segs, l, b = [*done, segs], [], 0, 0
        segs, l, b = [*segs, s], l + n, b + k
    return [*done, segs]


def brute_templates(urls, labels=None):
    """{(host, path): (template, purity, labelled pages of the template)}: the tree in plain Python, level by level."""
    rows = {}
    for i, u in enumerate(urls):
        key = parse(u)
        r = rule(*key)
        mark = labels[i] if labels else {"block": 1, "allow": 0}[r[0]] if r else None
        x = rows.setdefault(key, [0, 0, 0, False])
        x[0], x[1], x[2], x[3] = x[0] + 1, x[1] + (mark is not None), x[2] + (mark or 0), x[3] or r is None
    total = sum(x[1] for x in rows.values())
    prior = sum(x[2] for x in rows.values()) / total if total else 0.0
    segs = {k: [s for s in k[1].split("/") if s] for k in rows}
    node, purity, own, out, live, d = dict.fromkeys(rows, ""), dict.fromkeys(rows, prior), {}, {}, list(rows), 0

    def smooth():
        sums = {}
        for k in live:
            t = sums.setdefault((k[0], node[k]), [0, 0, purity[k]])
            t[0], t[1] = t[0] + rows[k][1], t[1] + rows[k][2]
        for k in live:
            l, b, p = sums[k[0], node[k]]
            purity[k], own[k] = (b + url_templates.PRIOR_ROWS * p) / (l + url_templates.PRIOR_ROWS), l

    smooth()
    while live:
        kids, mixed = {}, {}
        for k in live:
            n, l, b, is_open = rows[k]
            at = k[0], node[k]
            m = mixed.setdefault(at, [False, 0])
            m[0], m[1] = m[0] or is_open, m[1] + l
            if d < len(segs[k]) and not re.fullmatch(NUMBER, segs[k][d]):
                c = kids.setdefault(at, {}).setdefault(segs[k][d], [0, 0, 0])
                c[0], c[1], c[2] = c[0] + n, c[1] + l, c[2] + b
        variable = {at for at, c in kids.items() if len(c) > url_templates.MOST_BRANCHES or len(c) > url_templates.FEW and 2 * len(c) >= sum(x[0] for x in c.values())}
        merged = {}
        for at, c in kids.items():
            labelled = [(s, l, b) for s, (_, l, b) in c.items() if l]
            if at not in variable and labelled:
                merged.update({(at, s): "|".join(sorted(g)) for g in brute_branches(labelled) if len(g) > 1 for s in g})
        closed = set()
        for k in live:
            at = k[0], node[k]
            s = segs[k][d] if d < len(segs[k]) else None
            ends = d >= url_templates.DEPTH and not (mixed[at][0] and mixed[at][1] > 0)
            if s is None or ends:
                closed.add(k)
            if s is None:
                continue
            if ends:
                node[k] += "/**"
            elif re.fullmatch(NUMBER, s):
                node[k] += "/*"
            elif at in variable and kids[at][s][1] < url_templates.SUPPORT:
                node[k] += "/?"
            else:
                node[k] += "/" + merged.get((at, s), s)
        smooth()
        out.update({k: (node[k], purity[k], own[k]) for k in closed})
        live, d = [k for k in live if k not in closed], d + 1
    return out


def brute_verdicts(urls, labels=None):
    tree, out = brute_templates(urls, labels), []
    for u in urls:
        k = parse(u)
        r = rule(*k)
        _, purity, own = tree[k]
        out.append((k[0], k[1], r[1] if r else None, r[0] if r else "block" if own and purity >= url_templates.LEAST_PURITY else "allow"))
    return out


def test_trees_with_labels_equal_brute_force(spark):
    rnd = random.Random(11)
    rates = {}
    urls, labels = [], []
    for _ in range(3_000):
        host = rnd.choice(["a.site", "b.site", "x.example.com"])
        parts = [rnd.choice([f"d{rnd.randrange(6)}", f"d{rnd.randrange(90)}", str(rnd.randrange(50))]) for _ in range(rnd.randint(0, 6))]
        top = (host, *parts[:2])
        rate = rates.setdefault(top, rnd.choice([0.0, 0.1, 0.5, 0.95, 1.0]))
        urls.append(f"http://{host}/{'/'.join(parts)}")
        labels.append(None if rnd.random() < 0.3 else int(rnd.random() < rate))
    for n, host in ((64, "few.site"), (65, "many.site")):  # one child more makes the node variable
        urls += [f"http://{host}/k{i}/{j}" for i in range(n) for j in range(3)]
        labels += [int(i < 9) if j < 2 else None for i in range(n) for j in range(3)]
    df = spark.createDataFrame([(i, u, l) for i, (u, l) in enumerate(zip(urls, labels))], "page_id int, url string, bad int").repartition(4)
    got = {r.page_id: r for r in url_templates.judge(df, keep=["page_id"], label="bad").collect()}
    want, tree = brute_verdicts(urls, labels), brute_templates(urls, labels)
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(urls))] == want
    open_ = [i for i in range(len(urls)) if got[i].rule is None]
    assert all(got[i].template == tree[parse(urls[i])][0] and abs(got[i].purity - tree[parse(urls[i])][1]) < 1e-9 for i in open_)
    blocked = {want[i][3] for i in open_}
    assert blocked == {"allow", "block"}
    assert {got[i].template for i in open_ if got[i].host == "many.site"} != {got[i].template for i in open_ if got[i].host == "few.site"}


def test_urls_on_the_table(spark):
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    df = queries.op10_url_templates(spark, SF)
    assert native(df)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in df.collect()}
    want = brute_verdicts([u for _, u in pages])
    assert all(got[i] == w for (i, _), w in zip(pages, want)) and len(got) == len(pages)


def test_templates_equal_brute_force(spark, empty):
    urls = [None, "", "no scheme", "://", "http://A.B.NET", "http://net/", "http://x.net?q", "ftp://Example.NET/en/x#y", "http://q.example.net/en", "http://org/fr/1",
            "http://a.example.com/de/1", "http://a.example.com/de/1", "http://a.example.com/de", "http://é.example.com/DE/ü?x://y/"]
    urls += [f"http://a.example.com/{l}/{i}" for l in ("de", "en") for i in range(40)]
    urls += [f"http://b.org/{s}/{i}/{j}/x/y" for s in ("fr", "en", "tag") for i in range(4) for j in "abcdefghijkl"]
    urls += [f"http://c.org/name{i}/z" for i in range(80)]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, tree string").repartition(3)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_templates.judge(df, keep=["page_id"]).collect()}
    assert [got[i] for i in range(len(urls))] == brute_verdicts(urls)
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_templates.judge(none, keep=["page_id"]).count() == 0


def test_pure_templates_are_rejected(spark):
    rules = [("block", "s.com", "/bad/page/"), ("allow", "s.com", "/good/")]
    urls = [f"http://s.com/bad/page/{i}" for i in range(60)] + [f"http://s.com/good/page/{i}" for i in range(60)] + ["http://s.com/bad/other/1", "http://s.com/bad/page.html"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    out = {r.path: r for r in url_templates.judge(df, rules=rules).collect()}
    assert out["/bad/page/3"].verdict == "block" and out["/good/page/3"].verdict == "allow"
    assert out["/bad/other/1"].verdict == "allow" and out["/bad/page.html"].rule is None


def test_the_tree_decides_by_given_labels_and_never_without_own(spark):
    rows = [(f"http://a.site/spam/{i}", 1) for i in range(60)] + [(f"http://a.site/news/{i}", 0) for i in range(60)]
    rows += [("http://a.site/spam/new", None), ("http://a.site/spam/777", None), ("http://a.site/news/777", None), ("http://b.site/x/1", None)]
    df = spark.createDataFrame(rows, "url string, bad int")
    got = {(r.host, r.path): r for r in url_templates.judge(df, label="bad").collect()}
    assert got["a.site", "/spam/777"].verdict == "block" and got["a.site", "/spam/3"].verdict == "block"
    assert got["a.site", "/news/777"].verdict == "allow" and got["a.site", "/spam/new"].verdict == "allow"
    assert got["a.site", "/spam/new"].purity > got["b.site", "/x/1"].purity  # its parent is worse than the table
    hot = spark.createDataFrame([(f"http://hot.net/{i}",) for i in range(500)] + [("http://shop.example.com/en/1",)], "url string")
    assert {r.verdict for r in url_templates.judge(hot).collect() if r.rule is None} == {"allow"}


def test_labelled_directories_stay_out_of_the_wildcard_and_deep_paths_split(spark):
    rows = [(f"http://x.example.com/de/{i}", None) for i in range(24)] + [(f"http://x.example.com/dir{i}/{i}", None) for i in range(30)]
    got = [r.verdict for r in url_templates.judge(spark.createDataFrame(rows, "url string, bad int")).collect() if r.rule is None]
    assert got == ["allow"] * 30
    rows = [(f"http://v.site/ok{i}/{j}", 0) for i in range(65) for j in range(3)] + [(f"http://v.site/bad/{j}", 1) for j in range(60)]
    rows += [(f"http://v.site/deep/a/b/c/spam/{j}", 1) for j in range(60)] + [(f"http://v.site/deep/a/b/c/news/{j}", 0) for j in range(60)]
    steps = [(f"http://s.site/r{i:02d}/{j}", int(j < 2 * i)) for i in range(21) for j in range(40)]  # 0, 5, .. 100 % blocked
    asked = ["http://v.site/bad/900", "http://v.site/ok3/900", "http://v.site/deep/a/b/c/spam/900", "http://v.site/deep/a/b/c/news/900", "http://s.site/r00/900", "http://s.site/r20/900"]
    df = spark.createDataFrame(rows + steps + [(u, None) for u in asked], "url string, bad int")
    got = {f"http://{r.host}{r.path}": r.verdict for r in url_templates.judge(df, label="bad").collect()}
    assert [got[u] for u in asked] == ["block", "allow", "block", "allow", "allow", "block"]
