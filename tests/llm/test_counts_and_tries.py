import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, divergence, quality_rules, trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, term string, n_words string"


# ---- quality rules


def plain_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    spans = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, covered = Counter(spans), set()
    for i, s in enumerate(spans):
        if often[s] > 1:
            covered |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


ODD = [None, "", " \n\t", "a b c d e f g h " * 3 + "\n\nx\nx\n x\nx", "a " * 40, "é&|ü <ß>\x0b\x1fz\x00#", "w " * 7 + "w", "one\ntwo\none\n\n\none", " ".join(f"w{i % 1700}" for i in range(9000))]


def test_statistics_equal_plain_ones(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ODD
    docs = spark.createDataFrame([(i, t, None, None, "x", "clash") for i, t in enumerate(texts)] + [(None, "null id", None, None, "x", "clash")] * 2, DOCS)
    rows = quality_rules.statistics(docs).collect()
    assert len(rows) == len(texts) + 2 and all(r.term == "x" for r in rows)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_statistics(r.text), r.text
    judged = quality_rules.judge(quality_rules.statistics(docs), []).collect()
    for r in judged:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and r.kept == (not r.base_failed)
    assert quality_rules.statistics(docs.limit(0)).count() == 0


def plain_rules(rows):
    """The learner again, row by row: the same gain, the same cells, by plain loops. ``rows`` are (features, bad, prunes)."""

    def holds(rule, x):
        return all((x[c.feature] >= c.at) == c.above for c in rule)

    left, rules = list(rows), []
    while len(rules) < quality_rules.MOST_RULES:
        seen, rule = [r for r in left if not r[2]], ()
        while len(rule) < quality_rules.MOST_CONDITIONS:
            here = [r for r in seen if holds(rule, r[0])]
            bad = sum(r[1] for r in here)
            best = None
            for f, unit in quality_rules.FEATURES.items():
                cells = [min(math.floor(r[0][f] * unit), quality_rules.CELLS - 1) for r in here]
                for k in range(1, quality_rules.CELLS):
                    for above in (True, False):
                        inside = [r[1] for r, c in zip(here, cells) if (c >= k) == above]
                        b = sum(inside)
                        if not b:
                            continue
                        gain = b * (math.log2(b / len(inside)) - math.log2(bad / len(here)))
                        if gain > 1e-9 and (best is None or gain > best[0]):
                            end = next((i for i in range(k, quality_rules.CELLS) if i in cells), k)
                            best = gain, quality_rules.Condition(f, above, (k + end) / 2 / unit), len(inside) - b
            if best is None:
                break
            rule = (*rule, best[1])
            if not best[2]:
                break
        value, kept = None, ()
        for n in range(1, len(rule) + 1):
            (b, g), (ob, og) = ([sum(holds(rule[:n], r[0]) and r[2] == p and r[1] == v for r in left) for v in (True, False)] for p in (True, False))
            v = (b - g) / (b + g) if b + g else -1.0
            if value is None or v > value:
                value = v
                kept = rule[:n] if ob >= 0.75 * (ob + og) and b >= 0.75 * (b + g) and b + ob >= 3 else ()
        if not kept:
            break
        rules.append(kept)
        left = [r for r in left if not holds(kept, r[0])]
    return rules


def test_rules_equal_a_plain_learner_and_generalise(spark):
    rng = random.Random(4)
    texts = []
    for i in range(420):
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randrange(25, 90))]
        kind = i % 6
        if kind == 0:
            words = [w[:4] + rng.choice("#$%&") for w in words]
        elif kind == 1:
            words = [w[:3].upper() + "!!" for w in words]
        texts.append((i, " ".join(words), int(kind > 1 or rng.random() < 0.03)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts[:300]] + [(7, 1 - texts[7][2]), (None, 0), (8, None)], "doc_id long, quality int")
    stats = quality_rules.statistics(docs, keep=["doc_id"]).persist()
    rules = quality_rules.learn(stats, labels)
    held = {r.doc_id: r for r in stats.collect()}
    rows = [(held[i].asDict(), y == 0, zlib.crc32(f"part {i}".encode()) % 3 == 0) for i, _, y in texts[:300] if i != 7 and not (held[i].n_words < 20)]
    assert rules == plain_rules(rows) and len(rules) >= 2
    kept = {r.doc_id: r.kept for r in quality_rules.judge(stats, rules).collect()}
    right = [kept[i] == (i % 6 > 1) for i, _, _ in texts[300:]]
    assert sum(right) >= 0.97 * len(right)
    assert quality_rules.learn(stats, labels.limit(0)) == [] == quality_rules.learn(stats, labels.where("quality = 1"))


def test_quality_rules_on_the_given_tables(spark):
    from tidemark.llm import queries

    sf = "/root/testdata/sf0.01"
    out = queries.op11_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good, bad = ([r.kept for r in out if r.quality == y] for y in (1, 0))
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


# ---- source divergence


def plain_audit(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = [t for t, n in df.items() if n >= least]
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2]) for s in {d[1] for d in mine}}
        whole = sum(counts.values(), Counter())

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = sorted((-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s)
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)]
            terms = sorted((-gap(p[s][t], q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(terms[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("bits", [None, 4])
def test_audit_equals_a_plain_count(spark, bits):
    rng = random.Random(1)
    rows = [(None, None, None), ("", "en", None), ("x", "zz", "s1"), ("Straße ÄÄ äÄ Z[z]`z{z", "de", "s0"), (None, "de", "empty")]
    for i in range(160):
        source = rng.choice(["s0", "s0", "s1", "s2", "é", None])
        text = " ".join(rng.choice(["tie", "Tie", "the", "of", f"t{rng.randrange(9)}", "über", "1a2b", f"rare{i}"]) + rng.choice([" ", ", ", "\n"]) for _ in range(rng.randrange(0, 30)))
        rows.append((text, rng.choice(["en", "en", "de", None]), source))
    rows += rows[-3:] + [("long " * 20_000, "en", "s2")]
    docs = spark.createDataFrame([(i, t, lang, s, "clash", "clash") for i, (t, lang, s) in enumerate(rows)], DOCS)
    for least, top in ((10, 10), (3, 2)):
        got = sorted(tuple(r) for r in divergence.audit(docs, least, top, bits=bits).collect())
        assert got == plain_audit(rows, least, top)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_sketch_never_underestimates(spark):
    docs = spark.createDataFrame([("en", " ".join(["common"] * (i % 3 == 0) + [f"a{chr(97 + i % 7)}b"])) for i in range(60)], "lang string, text string").withColumn("text", F.col("text").cast("binary"))
    full = divergence.sketch(docs.repartition(5), 18, 8)
    assert divergence._may_reach("en", [b"common", b"aab", b"agb"], full, 18).all()
    assert divergence._may_reach("en", [f"none{i}".encode() for i in range(50)], full, 18).sum() == 0


# ---- conversation trie


def plain_trie(rows, every=20, most=4):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % most
        built[c] = tuple(own.get(c - math.fmod(c, every), [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)

    def below(node):
        words = len(WORD.findall(node[-1][1])) if node else 0
        leaves, saved = (0 if kids[node] else 1), (len(members[node]) - 1) * words
        for k in kids[node]:
            x = below(k)
            leaves, saved = leaves + x[0], saved + x[1]
        return leaves, saved

    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids[node]), *below(node), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [16, 2])
def test_trie_equals_a_plain_one(spark, chunk, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", chunk)  # 2: conversations of several chunks and levels
    rng = random.Random(2)
    rows = [(None, 1, "user", "lost"), (-7, None, None, None), (-7, 0, "user", "x"), (-7, 0, "user", "x"), (61, 5, "a", "tie"), (61, 5, "a", "Tie"), (70_000_040, 1, "user", "far")]
    for conv in range(64):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv * 3, turn, "ua"[turn % 2], rng.choice(["hi", "hello there", "hi", " ", None])))
    rows += [(130_000 + i, 0, "user", "the same") for i in range(80)]  # a group of copies over two blocks of ids
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, key string")
    out = trie.prefix_trie(frame)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in out.select(*columns).collect()), key=str) == plain_trie(rows)
    spans = sorted((r.position, r.subtree_end, r.depth) for r in out.collect())
    assert [s[0] for s in spans] == list(range(1, len(spans) + 1)) and spans[0][1] == len(spans)
    assert trie.prefix_trie(frame.limit(0)).count() == 0


def test_long_conversations_are_cut(spark):
    rows = [(c, t, "user", f"turn {t}" if t < 300 + c else f"own {c} {t}") for c in (0, 20, 40) for t in range(330)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = trie.prefix_trie(frame).drop("position", "subtree_end")
    assert sorted((tuple(r) for r in out.collect()), key=str) == plain_trie(rows)


def test_bitmaps_follow_their_names():
    assert common.bits_for(0) == 20 and common.bits_for(10**6) == 24 and common.bits_for(10**12) == common.MOST_BITS
    assert not common.fills(10**6, common.bits_for(10**6)) and common.fills(10**9, common.bits_for(10**9))
