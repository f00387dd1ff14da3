import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, decontaminate, licenses, line_dedup, near, queries, topk, toxicity, urls

DOCS = "doc_id long, text string, lang string, id string"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, None, "clash") for i, t in enumerate(texts)], DOCS)


# ---- benchmark decontamination


def brute_scores(items, words):
    n = len(items)
    split = [decontaminate.words_of(t) for _, t in items]
    df = Counter(w for s in split for w in set(s))
    mean = sum(map(len, split)) / n
    out = []
    for s in split:
        c = Counter(s)
        part = {
            w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(s) / mean))
            for w, f in c.items()
        }
        out.append(sum(part[w] for w in part if w in words) / sum(part.values()))
    return out


@pytest.mark.parametrize("least", [0.15, 0.4, 0.6])
def test_search_returns_all_items_above_the_threshold(spark, sf, least):
    items = sorted((r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect())
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items += [(900 + i, " ".join(t.split()[: 9 + i % 30])) for i, t in enumerate(texts[:60]) if len(t.split()) > 40]
    texts += [items[3][1] + " " + items[70][1], items[5][1][: len(items[5][1]) // 2]]
    frame = spark.createDataFrame(items, "item_id long, text string")
    (index,) = decontaminate._indexes(frame, "item_id", "text", 10_000, 1 << 24)
    where = {item: n for n, item in enumerate(index.ids)}
    order = [where[i] for i, _ in items]
    found = 0
    for text in texts:
        words = decontaminate.words_of(text)
        step, starts = index.longest, {s: t for s, t in index.passages(words, least)}
        for start in range(0, max(1, len(words) - step), step):
            scores = brute_scores(items, set(words[start : start + 2 * step])) if len(words) < 900 or start in starts else []
            want = sorted(order[i] for i, x in enumerate(scores) if x >= least - 1e-9)
            got = sorted(n for n, _ in index.search(starts[start], least)) if start in starts else []
            assert got == want
            found += len(want)
    assert found > 50


def test_contaminated_documents_are_found_and_others_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    rows = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench).collect()}
    for r in docs.collect():
        exact = {i for i, t in items if t in r.text}
        assert exact <= {h.item_id for h in rows[r.doc_id].hits}
        assert rows[r.doc_id].contaminated == bool(rows[r.doc_id].hits)
        assert exact or not rows[r.doc_id].contaminated


def test_shards_of_items_find_the_same(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    pick = lambda df: {r.doc_id: sorted((h.item_id, round(h.score, 9)) for h in r.hits) for r in df.collect()}
    assert pick(decontaminate.decontaminate(docs, bench)) == pick(decontaminate.decontaminate(docs, bench, shard_items=9))


def test_decontamination_takes_odd_rows(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma. delta"), (None, "x y"), (2, None), (3, ""), (1, "alpha beta gamma. delta")], "item_id long, text string")
    docs = documents(spark, [None, "", "so alpha BETA gamma delta it is", "nothing " * 5000]).withColumnRenamed("id", "hits")
    rows = sorted(decontaminate.decontaminate(docs, bench).collect(), key=lambda r: r.doc_id)
    assert [r.contaminated for r in rows] == [False, False, True, False]
    assert [h.item_id for h in rows[2].hits] == [1, 1]
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def test_items_of_very_different_length_do_not_change_each_other(spark):
    rng = random.Random(8)
    short = "copper lantern beside quiet harbor wakes early. seven grey herons"
    long = " ".join(f"filler{rng.randrange(4000)}" for _ in range(2500)) + ". the end of it"
    middle = " ".join(f"middle{rng.randrange(4000)}" for _ in range(150)) + ". some answer here"
    bench = spark.createDataFrame([(1, short), (2, long), (3, middle)], "item_id long, text string")
    spread = [f"clean{i}" for i in range(3000)]
    for i, w in enumerate(rng.sample(decontaminate.words_of(short), 10)):
        spread[200 + 250 * i] = w
    pad = " pad" * 700
    docs = documents(spark, [" ".join(spread), pad + " " + short + pad, pad + " " + middle + pad, "x " * 333 + long + pad, short])
    pick = lambda df: {r.doc_id: sorted((h.item_id, round(h.score, 9), h.start) for h in r.hits) for r in df.collect()}
    got = pick(decontaminate.decontaminate(docs, bench))
    assert [[h[0] for h in got[i]] for i in range(5)] == [[], [1], [3], [2], [1]]
    assert got == pick(decontaminate.decontaminate(docs, bench, shard_items=1))


def test_scores_beyond_64_bits_are_refused(spark):
    vectors = spark.createDataFrame([(0, [1e9] * 4), (1, [1e9] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        topk.top_k(vectors)


# ---- licenses


def test_increasing_is_longest():
    rng = random.Random(4)
    for _ in range(50):
        ys = rng.sample(range(30), 9)
        best = max(n for n in range(1, 10) for c in itertools.combinations(ys, n) if list(c) == sorted(c))
        got = licenses.increasing(list(enumerate(ys)))
        assert len(got) == best and [y for _, y in got] == sorted(y for _, y in got)


def test_alignment_is_a_common_subsequence():
    rng = random.Random(5)
    for _ in range(100):
        a, b = [rng.choice("abcdefgh") for _ in range(20)], [rng.choice("abcdefgh") for _ in range(8)]
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x < y and p < q for (x, p), (y, q) in zip(pairs, pairs[1:]))
    assert len(licenses.align("we use it under the mit terms here".split(), "under the mit terms".split())) == 4


def test_licenses_of_one_kin_are_told_apart(spark):
    gpl = licenses.TEMPLATES["GPL-2.0-notice"]
    texts = {
        "GPL-2.0-notice": "Intro. " + gpl + " You should have received a copy.",
        "GPL-notice": "x " + licenses.TEMPLATES["GPL-notice"],
        "LGPL-2.1-notice": licenses.TEMPLATES["LGPL-2.1-notice"].replace("hope that", "hope"),
        "LGPL-3.0-notice": licenses.TEMPLATES["LGPL-3.0-notice"],
        "AGPL-3.0-notice": licenses.TEMPLATES["AGPL-3.0-notice"].lower(),
        "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
        "LGPL-3.0": "licensed under the GNU Lesser General Public License, version 3.",
        "CC-BY-4.0": "Text. Licensed under CC BY 4.0. More text, and the number 3.",
        "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
        "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
        "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
        "BSD-2-Clause": licenses.TEMPLATES["BSD-2-Clause"],
        "BSD-3-Clause": licenses.TEMPLATES["BSD-3-Clause"],
        "MIT-text": licenses.TEMPLATES["MIT-text"],
        "MIT-notice": licenses.TEMPLATES["MIT-notice"],
        "Apache-2.0-notice": licenses.TEMPLATES["Apache-2.0-notice"],
    }
    rows = licenses.scan_licenses(documents(spark, list(texts.values()))).collect()
    assert [r.license for r in sorted(rows, key=lambda r: r.doc_id)] == list(texts)
    odd = spark.createDataFrame([(None, "Licensed under CC BY 4.0.", "clash", "clash")] * 2 + [(1, None, "clash", "clash")], "doc_id long, text string, license string, matches string")
    found = licenses.scan_licenses(odd).collect()
    assert sorted((r.doc_id or 0, r.license or "") for r in found) == [(0, "CC-BY-4.0"), (0, "CC-BY-4.0"), (1, "")]


def test_licenses_are_found_wherever_they_stand(spark, sf):
    notice = licenses.TEMPLATES["Apache-2.0"]
    texts = [
        None,
        "",
        notice,
        "pad " * 400 + notice + " pad" * 400,
        f"the license, {notice} {notice} under the license",
        notice.replace("Apache", "Apachi"),
        "Licensed " * 3000,
        licenses.TEMPLATES["MIT-notice"].replace("software", "program").upper(),
        "İ" * 5 + " " + notice,
        "license under the version",
    ]
    rows = sorted(licenses.scan_licenses(documents(spark, texts)).collect(), key=lambda r: r.doc_id)
    assert [r.license for r in rows] == [None, None, "Apache-2.0", "Apache-2.0", "Apache-2.0", "Apache-2.0", None, "MIT-notice", "Apache-2.0", None]
    assert texts[3][rows[3].start : rows[3].stop] == notice[:-1] and rows[5].coverage == 7 / 8
    assert texts[8][rows[8].start : rows[8].stop] == notice[:-1]
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    chosen = [licenses.Template(n, t, 0.8) for n, t in sorted(licenses.TEMPLATES.items())]
    for d in docs:
        assert licenses.scan_text(d.text, chosen) == licenses.scan_text(d.text, chosen, prefilter=False)
    assert licenses.scan_licenses(documents(spark, [])).count() == 0


# ---- urls


def test_url_parts_and_rules(spark):
    cases = {
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "http://": ("", "", None, "allow"),
        "http://Example.COM/en/1?x#y": ("example.com", "/en/1", "example.com/en/", "block"),
        "http://a.example.com/EN/1": ("a.example.com", "/EN/1", "com/", "allow"),
        "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://b.www.example.com/en/?q": ("b.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://com": ("com", "", None, "allow"),
        "http://x.net?u=http://y.com/": ("x.net", "", None, "allow"),
        "http://x.net/es/a": ("x.net", "/es/a", "net/es/", "block"),
        "http://net/fr/": ("net", "/fr/", "net/fr/", "block"),
        "a://b://c.net/fr/": ("b:", "//c.net/fr/", None, "allow"),
        "x://É.com/\n/a": ("É.com", "/\n/a", "com/", "allow"),
    }
    pages = spark.createDataFrame([(i, u, None, "h") for i, u in enumerate(cases)], "page_id long, url string, html string, host string")
    rows = sorted(urls.judge(pages, queries.URL_RULES).collect(), key=lambda r: r.page_id)
    assert [(r.host, r.path, r.rule, r.verdict) for r in rows] == list(cases.values())
    assert urls.judge(pages.limit(0), queries.URL_RULES).count() == 0


def test_blocks_follow_redirects_and_allows_win(spark):
    html = {
        "http://a.org/": '<link href="http://x.net/es/1" rel=canonical>',
        "http://b.org/": '<META http-equiv="refresh" content="0; url=http://a.org/">',
        "http://c.org/": '<link rel="canonical" href="http://d.org/">',
        "http://e.org/": '<link rel="canonical" href="http://x.net/fr/9">',
        "http://www.example.com/en/k": '<link rel="canonical" href="http://e.org/">',
        "http://x.net/es/1": "",
        "http://x.net/fr/9": None,
    }
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate([*html.items(), *html.items()])], "page_id long, url string, html string")
    rows = sorted(urls.judge(pages, queries.URL_RULES).collect(), key=lambda r: r.page_id)
    assert [r.verdict for r in rows] == 2 * ["block", "block", "allow", "allow", "allow", "block", "block"]


def plain_patience(a, b):
    """Patience alignment by its definition: unique common words, their longest increasing run by trying all, then the gaps."""
    if not a or not b:
        return 0
    anchors = [(i, b.index(w)) for i, w in enumerate(a) if a.count(w) == 1 and b.count(w) == 1]
    if not anchors:
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        m = 0
        while m < min(len(a), len(b)) - n and a[-1 - m] == b[-1 - m]:
            m += 1
        return n + m
    best = []
    for k, (_, y) in enumerate(anchors):
        before = max((x for x in best if x[-1][1] < y), key=len, default=[])
        best.append([*before, anchors[k]])
    run = [(-1, -1), *max(best, key=len), (len(a), len(b))]
    return len(run) - 2 + sum(plain_patience(a[x0 + 1 : x1], b[y0 + 1 : y1]) for (x0, y0), (x1, y1) in zip(run, run[1:]))


@pytest.mark.parametrize("name", ["MIT", "BSD", "MIT-text", "Apache-2.0-notice", "GPL-notice"])
def test_license_coverage_equals_a_plain_alignment(spark, name):
    """Whole and damaged notices among other words: the coverage is that of the best window at any word."""
    rng = random.Random(len(name))
    template = licenses.WORD.findall(licenses.TEMPLATES[name].lower())
    m, texts = len(template), []
    for drop in (0, 0.05, 0.15, 0.19, 0.25, 0.5):
        for extra in (0, 7):
            words = [w for w in template if rng.random() >= drop]
            for _ in range(extra if m > 12 else 0):
                words.insert(rng.randrange(len(words) + 1), f"added{rng.randrange(99)}")
            around = [f"other{rng.randrange(500)}" for _ in range(rng.randrange(3 * m + 60))]
            at = rng.randrange(len(around) + 1)
            texts.append(" ".join([*around[:at], *words, *around[at:]]))
    got = {r.doc_id: r for r in licenses.scan_licenses(documents(spark, [*texts, None]), {name: licenses.TEMPLATES[name]}, least=0.8).collect()}
    caught = 0
    for i, text in enumerate(texts):
        words = text.split()
        hits = [k for k, w in enumerate(words) if w in set(template)]
        starts = range(max(0, min(hits, default=0) - 3), max(hits, default=0) + 1, 1 if m < 60 else 7)
        want = max(plain_patience(words[s : s + 2 * m], template) / m for s in starts) if hits else 0.0
        assert (got[i].coverage >= 0.8) == (want >= 0.8) and (want < 0.8 or abs(got[i].coverage - want) <= 1.01 / m)
        caught += want >= 0.8
    assert caught >= 4 and got[len(texts)].license is None


def test_relative_links_are_resolved(spark):
    base = "http://A.org/dir/page?q#f"
    cases = {
        "/x": "http://A.org/x", "x": "http://A.org/dir/x", "./x": "http://A.org/dir/x", "?a&amp;b": "http://A.org/dir/page?a&b", "//B.net/es/": "http://B.net/es/",
        "HTTP://b.net": "HTTP://b.net", "#top": None, "mailto:me": None, "": None,
    }
    rows = spark.createDataFrame([(base, h) for h in cases], "base string, href string")
    got = [r.u for r in rows.select(urls.resolved(F.col("base"), F.col("href")).alias("u")).collect()]
    assert got == list(cases.values())
    bare = spark.createDataFrame([("http://a.org", "x")], "base string, href string")
    assert bare.select(urls.resolved(F.col("base"), F.col("href")).alias("u")).first().u == "http://a.org/x"
    assert spark.createDataFrame([("HTTP://A.Org/X?Y",)], "u string").select(urls.alias_key(F.col("u")).alias("u")).first().u == "http://a.org/X?Y"


def test_blocks_follow_relative_and_later_tags(spark, sf):
    import duckdb

    html = {
        "http://Q.net/es/1": "",
        "http://q.net/a/b": '<link rel="alternate" href="http://z.org/"><link rel=canonical href="http://z.org/"> <LINK REL="canonical" HREF="/es/1">',
        "http://z.org/": "long " * 50_000,
        "http://q.net/a/c": "<meta http-equiv=refresh content='0;url=b'>",
        "http://q.net/a/d": '<link rel="canonical" href="#here">',
    }
    pages = spark.createDataFrame([(i, u, h, "own") for i, (u, h) in enumerate(html.items())], "page_id long, url string, html string, verdict string")
    rows = sorted(urls.judge(pages, queries.URL_RULES).collect(), key=lambda r: r.page_id)
    assert [r.verdict for r in rows] == ["block", "block", "block", "block", "allow"]
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    assert [r[0] for r in con.execute(f"SELECT verdict FROM ({queries.ORACLE_SQL['op5_url_filter']}) ORDER BY page_id").fetchall()] == [r.verdict for r in rows]


# ---- line dedup


def brute_lines(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    first, cover = {}, defaultdict(set)
    for i in order:
        lines = [x.strip(" \t\r\f\x0b") for x in (rows[i][1] or "").split("\n")]
        lines = [x for x in lines if x]
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if first.setdefault(w, (i, p)) != (i, p):
                cover[i] |= {p, p + 1, p + 2}
    out = []
    for i, (_, text) in enumerate(rows):
        kept, n = [], 0
        for x in (text or "").split("\n"):
            if x.strip(" \t\r\f\x0b"):
                if n not in cover[i]:
                    kept.append(x)
                n += 1
            else:
                kept.append(x)
        out.append(("\n".join(kept) if text is not None else None, n, len(cover[i])))
    return out


def test_line_dedup_equals_brute_force(spark, sf):
    rng = random.Random(8)
    pool = [f"line {i}" for i in range(12)] + ["", " ", "\t"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(14)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "a\nb\nc\n" * 50), (503, "\n" * 40), (None, "a\nb\nc\nd"), (504, "a \nb\r\n c")]
    rows += [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, pos string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs).collect()}
    for (i, _), want in zip(rows, brute_lines(rows)):
        assert got[i] == want
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_takes_very_long_texts_and_clashing_names(spark):
    long = "\n".join(f"long line {i % 40_000}" for i in range(60_000))
    rows = [(1, long), (2, "head\n" + long[:200_000] + "\ntail")]
    docs = spark.createDataFrame([(i, t, 5, "h") for i, t in rows], "doc_id long, text string, n_lines int, h1 string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    for (i, _), want in zip(rows, brute_lines(rows)):
        assert (got[i].text, got[i].n_lines, got[i].n_removed) == want and got[i].h1 == "h"


def test_repeated_rows_keep_the_same_lines(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc")] * 3 + [(2, "a\nb\nc\nd")], "doc_id long, text string")
    rows = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(docs).collect())
    assert rows == [(1, "a\nb\nc")] * 3 + [(2, "d")]


# ---- exact top-k


def brute_top(rows, k, every):
    good = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, v in good:
        if q % every == 0:
            scored = sorted((-int(v @ w), i) for i, w in good if i != q and len(w) == len(v))
            out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("block", [7, 1024])
def test_top_k_equals_brute_force(spark, sf, block, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(size=20) * rng.uniform(0.1, 2)]) for i in range(260)]
    rows += [(i, [0.5] * 20) for i in range(300, 312)]  # ties
    rows += [(400, None), (401, []), (402, [float("nan")] * 20), (403, [None] * 20), (404, [float("inf")] * 20), (None, [1.0] * 20)]
    rows += [(500, [1.0, 2.0, 3.0]), (510, [2.0, -1.0, 0.5]), (600, [0.0] * 20), (700, [1e9] * 20)]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, v string")
    got = defaultdict(list)
    for r in topk.top_k(frame, k=5, every=10).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert {q: sorted(x) for q, x in got.items()} == brute_top(rows, 5, 10)
    assert topk.top_k(frame.limit(0)).count() == 0


def test_top_k_scans_less_than_everything():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6000, 32)) * (0.8 ** np.arange(32)) * 200
    base = base[np.argsort(-np.linalg.norm(base, axis=1))].astype(int)
    _, vectors = np.linalg.eigh((base.T @ base).astype(float))

    class Row:
        def __init__(self, ids, m):
            self.ids, self.values, self.dim = ids.tobytes(), m.tobytes(), m.shape[1]

    blocks = [topk.Block(Row(np.arange(i, i + 500), base[i : i + 500]), vectors[:, ::-1]) for i in range(0, 6000, 500)]
    query = topk.Block(Row(np.array([-1]), base[:1]), vectors[:, ::-1])
    seen = []
    for b in blocks:
        original = b.exact
        b.exact = type("Seen", (), {"__getitem__": lambda s, c, o=original: (seen.append(len(o[c])), o[c])[1]})()
    best = topk.scan(query, np.array([-np.inf]), blocks, 5)[0]
    assert [i for _, i in best] == np.lexsort((np.arange(6000), -(base @ base[0])))[:5].tolist()
    assert sum(seen) < 3000


# ---- toxicity


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    w = {k: x.astype(np.float64) for k, x in toxicity.initial(1).items()}
    x = rng.normal(size=(9, 2 * toxicity.EMBED))
    ids = rng.integers(0, 9, (6, 4))
    mask = np.arange(6)[:, None] < np.array([6, 3, 1, 5])
    y, weight = np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 0.5, 1])

    def loss(w, x):
        z = toxicity.score_windows((x @ w["xf"] + w["bf"])[ids], (x @ w["xb"] + w["bb"])[ids], mask, w)
        p = toxicity._sigmoid(z)
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    grads, dx = toxicity.gradients(x, ids, mask, y, weight, w)
    for name, g in [*grads.items(), ("input", dx)]:
        target = x if name == "input" else w[name]
        for at in [tuple(rng.integers(0, n) for n in target.shape) for _ in range(4)]:
            old, eps = target[at], 1e-3
            target[at] = old + eps
            up = loss(w, x)
            target[at] = old - eps
            down = loss(w, x)
            target[at] = old
            assert abs((up - down) / (2 * eps) - np.asarray(g).reshape(target.shape)[at]) < 2e-3


def test_windows_cover_everything():
    for n in (0, 1, 63, 64, 65, 96, 97, 500):
        spans = toxicity.windows(n)
        assert {i for a, b in spans for i in range(a, b)} == set(range(n))
        assert all(b - a == min(n, 64) for a, b in spans)


def test_toxicity_is_learnt_and_held_out_rows_show_it(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 260))]
        bad = i % 4 == 0
        for _ in range(1 + len(text) // 40 if bad else 0):
            text[rng.randrange(len(text))] = rng.choice(["grumbo", "grumbos", "Grumboly", "snarfed", "snarf"])
        rows.append((i, " ".join(text), int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5000, None), (5001, ""), (None, "w1 grumbo")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, most=400)
    out = toxicity.score(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    truth = {i: y for i, _, y in rows}
    held = [(truth[r.doc_id], r.toxicity >= 0.5) for r in out if r.held and r.doc_id in truth]
    assert sum(y == p for y, p in held) >= 0.97 * len(held) > 100
    assert {r.doc_id: r.toxicity for r in out}[5000] == {r.doc_id: r.toxicity for r in out}[5001] == 0.0
    again = toxicity.score(docs, toxicity.fit(docs, labels, most=400)).collect()
    assert {r.doc_id: r.toxicity for r in again} == {r.doc_id: r.toxicity for r in out}
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).where("toxicity >= 0.5").count() == 0


def plain_score(model, text):
    """A text's score window by window and word by word, in double precision."""
    w = {k: x.astype(np.float64) for k, x in model.weights.items()}
    words = re.findall(r"\w+", (text or "").lower())
    if not words:
        return 0.0
    size = toxicity.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))

    def states(inputs, d):
        h, out = np.zeros(size), []
        for x in inputs:
            p = x @ w[f"x{d}"] + w[f"b{d}"]
            z, r = sig(p[:size] + h @ w[f"u{d}"][:, :size]), sig(p[size : 2 * size] + h @ w[f"u{d}"][:, size : 2 * size])
            h = (1 - z) * h + z * np.tanh(p[2 * size :] + (r * h) @ w[f"u{d}"][:, 2 * size :])
            out.append(h)
        return out

    logits = []
    for at in [*range(0, max(0, len(words) - 64), 32), max(0, len(words) - 64)]:
        inputs = [np.concatenate([w["word"][toxicity.word_row(x)], w["char"][toxicity.char_rows(x)].mean(0)]) for x in words[at : at + 64]]
        both = np.hstack([states(inputs, "f"), states(inputs[::-1], "b")[::-1]])
        weigh = np.exp(both @ w["attend"])
        logits.append((weigh @ (both @ w["out"])) / weigh.sum() + w["bias"][0])
    return sig((max(logits) - model.shift) * model.scale)


def test_scores_equal_a_plain_scorer_and_do_not_depend_on_batches(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice((1, 5, 63, 64, 65, 97, 300, 1500)))) for _ in range(60)] + [None, "", " ,. "]
    weights = toxicity.settled(toxicity.initial(5))
    model = toxicity.Model(weights, shift=0.1, scale=3.0)
    scorer = toxicity.Scorer(model)
    alone = [toxicity.Scorer(model).score([t])[0] for t in texts]
    assert np.allclose(alone, [plain_score(model, t) for t in texts], atol=3e-3)
    for size in (1, 7, 63):
        assert [s for at in range(0, len(texts), size) for s in scorer.score(texts[at : at + size])] == alone
    docs = documents(spark, texts)
    for parts in (1, 3):
        got = {r.doc_id: r.toxicity for r in toxicity.score(docs.repartition(parts), model).collect()}
        assert [got[i] for i in range(len(texts))] == alone


def test_training_reads_a_bounded_sample_and_takes_odd_labels(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(("mild", "calm", "vile", "foul")[: 2 + 2 * (i % 2)]) for _ in range(30)), i % 2) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "no id"), (1000, None), (3, "second text of an id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (1000, 1), (7, 0), (8, None)], "doc_id long, toxic int")
    taken, share = toxicity.sample(docs, labels, 50, "doc_id", "text", "toxic")
    got = taken.collect()
    assert len(got) <= 50 and not {1000, 7} & {r.id for r in got} and 0.4 < share < 0.6
    small = toxicity.fit(docs, labels, most_bytes=0)
    assert toxicity.score(docs, small).where("toxicity >= 0.5").count() == 0
    whole, again = toxicity.fit(docs, labels, most=60), toxicity.fit(docs.repartition(7), labels.repartition(3), most=60)
    assert all((whole.weights[k] == again.weights[k]).all() for k in whole.weights) and whole.shift == again.shift


# ---- near-duplicate groups


@pytest.mark.parametrize("most_bits", [28, 8])
def test_groups_hold_all_similar_pairs(spark, sf, most_bits, monkeypatch):
    monkeypatch.setattr(common, "MOST_BITS", most_bits)  # 8: bitmaps are full, joins take over
    rng = random.Random(6)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    base = " ".join(f"word{rng.randrange(500)}" for _ in range(220)).split()
    for _ in range(60):  # a large group of near copies
        copy = list(base)
        for _ in range(rng.randrange(7)):
            copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts += [None, "", " \n", "One two", "one  TWO", "one two three four five six", texts[3], texts[3]]
    docs = documents(spark, texts)
    rows = {r.id: r for r in near.groups(docs).collect()}
    sets = [set(near.shingle_hashes(near.normal((t or "").encode()), 5).tolist()) for t in texts]
    for i, j in itertools.combinations(range(len(texts)), 2):
        union = len(sets[i] | sets[j])
        if not union or len(sets[i] & sets[j]) >= 0.8 * union:
            assert rows[i].component == rows[j].component
    kept = {r.doc_id for r in near.keep_one(docs).collect()}
    assert kept == {i for i, r in rows.items() if r.stays}
    by = defaultdict(list)
    for i, r in rows.items():
        by[bytes(r.component)].append(i)
    assert kept == {min(x) for x in by.values()}
    twice = documents(spark, ["same text here"]).unionByName(documents(spark, ["same text here"]))
    assert near.keep_one(twice).count() == 1 and near.keep_one(docs.limit(0)).count() == 0


def test_toxicity_on_the_given_tables(spark):
    """Held-out rows of the small tables: 6 toxic and 64 clean ones."""
    sf = "/root/testdata/sf0.01"
    out = queries.op6_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    toxic, clean = ([r for r in out if r.toxic == y] for y in (1, 0))
    assert len(toxic) >= 5 and len(clean) >= 50
    right = sum((t.score > c.score) + 0.5 * (t.score == c.score) for t in toxic for c in clean)
    assert right >= 0.87 * len(toxic) * len(clean)  # a toxic row of 6 that is missed costs 0.1
    assert sum(r.predicted for r in clean) < 0.02 * len(clean) or sum(r.predicted for r in clean) <= 1
    assert sum(r.predicted for r in toxic) >= 0.5 * len(toxic)


def test_words_never_seen_are_neutral(spark):
    sf = "/root/testdata/sf0.01"
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    texts = ["the quick brown fox", "one two three", " ".join(f"word{i}" for i in range(160)), *[" ".join(f"zq{i * j}vu" for j in range(99)) for i in range(1, 30)]]
    assert max(scorer.score(texts)) < 0.5


def test_search_of_reached_blocks_alone_finds_the_same():
    from tidemark.llm import decontaminate as D

    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words, 20))) for i in range(150)]
    index = D.Index(items, {w: 1.0 + i % 7 for i, w in enumerate(words)}, 20.0)
    found = 0
    for n in range(60):
        text = " ".join([*rng.choice(words, 150), *items[n][1].split(), *rng.choice(words, 90)]).split()
        for _, terms, blocks in index.reached(text, 0.6):
            got = index.search(terms, 0.6, blocks)
            assert got == index.search(terms, 0.6) and {i // D.BLOCK for i, _ in got} <= set(blocks)
            found += len(got)
    assert found >= 60
