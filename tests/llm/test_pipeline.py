import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_search_and_filters import brute_lines, brute_scores
from tidemark.llm import decontaminate, near, queries, tokens, toxicity
from tidemark.llm.common import bitmap, bitmap_has, components, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, sf, tmp_path_factory):
    """The small tables with odd rows added: nulls, empty texts, copies, near copies, leaks and long texts."""
    folder = f"file://{tmp_path_factory.mktemp('tables')}"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    item = bench.first().text
    rng = random.Random(9)
    base = [f"plain{rng.randrange(900)}" for _ in range(160)]
    nearly = list(base)
    nearly[40] = "changed"
    odd = [
        (900_001, None), (900_002, ""), (900_003, "  \n "), (900_004, " ".join(base)), (900_005, " ".join(nearly)), (900_006, " ".join(base).upper()),
        (900_007, "before " * 30 + item + " after" * 30), (900_008, "one\ntwo\nthree\nfour five"), (900_009, "zero\none\ntwo\nthree"), (900_010, "one\ntwo\nthree"),
        (900_011, " ".join(f"long{i * 7919 % 5003}" for i in range(20_000))), (None, "a text without an id here"), (900_012, "twice the same row"), (900_012, "twice the same row"),
    ]
    more = spark.createDataFrame([(i, t, None, "odd", len(t or "")) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(more).repartition(5).write.parquet(f"{folder}/documents.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


def key(r):
    return (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")


def shingle_set(text):
    """Five-word shingles as tuples of words."""
    words = re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    words = [w for w in words if w]
    return set(zip(*(words[i:] for i in range(5)))) if len(words) >= 5 else {tuple(words)} - {()}


def brute_near(rows):
    """One row of each group by comparing all pairs."""
    rows = sorted(rows, key=key)
    sets = [shingle_set(r["text"]) for r in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        union = len(sets[i] | sets[j])
        if not union or len(sets[i] & sets[j]) >= 0.8 * union:
            a, b = sorted((find(i), find(j)))
            top[b] = a
    return [r for i, r in enumerate(rows) if find(i) == i]


def test_each_stage_equals_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    start = [r.asDict() for r in docs.collect()]

    kept = stored(stages["toxicity"](spark, docs, tables), "t")
    model = toxicity.fit(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    fine = [r for r in start if toxicity.Scorer(model).score([r["text"]])[0] < 0.5]
    assert Counter(map(key, fine)) == Counter(map(key, [r.asDict() for r in kept.collect()])) and kept.columns == COLUMNS
    assert 0 < len(fine) < len(start)

    lines = stored(stages["line_dedup"](spark, kept, tables), "l")
    seen, unique = set(), []
    for r in sorted(fine, key=key):
        if key(r) not in seen:
            seen.add(key(r))
            unique.append(r)
    clean = {key(r): x for r, x in zip(unique, brute_lines([(r["doc_id"], r["text"]) for r in unique]))}
    want = Counter((r["doc_id"], clean[key(r)][0]) for r in fine if not clean[key(r)][2] or clean[key(r)][2] < clean[key(r)][1])
    got = [r.asDict() for r in lines.collect()]
    assert Counter((r["doc_id"], r["text"]) for r in got) == want and lines.columns == COLUMNS

    alone = stored(stages["near_dedup"](spark, lines, tables), "n")
    want = brute_near(got)
    got = [r.asDict() for r in alone.collect()]
    assert Counter(map(key, got)) == Counter(map(key, want)) and alone.columns == COLUMNS

    pure = stored(stages["decontamination"](spark, alone, tables), "d")
    items = sorted((r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect())
    parts = [tuple(map(Counter, decontaminate.question_and_answer(t))) for _, t in items]
    step = max(len(decontaminate.words_of(t)) for _, t in items)
    rare = set(itertools.chain.from_iterable(decontaminate.words_of(t) for _, t in items))

    def leaks(text):
        words = decontaminate.words_of(text or "")
        for at in range(0, max(1, len(words) - step), step):
            some = words[at : at + 2 * step]
            if len(rare & set(some)) < 5:
                continue
            have = Counter(some)
            for n, s in enumerate(brute_scores(items, set(some))):
                q, a = (sum((have & p).values()) / max(1, sum(p.values())) for p in parts[n])
                if s >= 0.6 and q >= 0.7 and a >= 0.7:
                    return True
        return False

    want = [r for r in got if not leaks(r["text"])]
    got = [r.asDict() for r in pure.collect()]
    assert Counter(map(key, got)) == Counter(map(key, want)) and len(want) < len(alone.collect())
    assert 900_007 not in {r["doc_id"] for r in got}

    lib = tokens.library_tokenizer(queries.tokenizer_path())
    out = {r.doc_id: r for r in stages["bpe"](spark, pure, tables).collect()}
    assert len(out) == len(got)
    for r in got:
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert out[r["doc_id"]].ids == ids and out[r["doc_id"]].n_tokens == len(ids)
        assert out[r["doc_id"]].decoded_sha256 == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_run_is_the_stages_in_a_row(spark, tables):
    out = {r.doc_id for r in corpus_pipeline.run(spark, tables).collect()}
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, tables), "s")
    assert out == {r.doc_id for r in docs.collect()}
    assert {900_004, 900_005, 900_006} & out == {900_004}


def test_stages_take_empty_tables(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
        assert docs.count() == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (None, 3), (7000, 7001), (7001, 7000)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}, 7000: 7000, 7001: 7000}
    assert components(df.limit(0)).count() == 0
    rng = random.Random(1)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)]
    top = list(range(400))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        lo, hi = sorted((find(a), find(b)))
        top[hi] = lo
    touched = {x for p in pairs if p[0] != p[1] for x in p}
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: find(x) for x in touched}


def test_bitmaps_hold_every_name(spark):
    names = [hashlib.md5(str(i).encode()).digest() for i in range(3000)]
    words = bitmap(spark.createDataFrame([(bytearray(n),) for n in names[:1500]], "name binary"), 16)
    hits = bitmap_has(names, words, 16)
    assert all(hits[:1500]) and sum(hits[1500:]) < 150


def test_queries_are_registered_and_hold_their_sql(spark, sf):
    import duckdb

    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 14)} <= {q.split("_")[0] + "_" for q in names} and "pipeline" in names
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got, want = queries.QUERIES[name](spark, sf).toPandas(), con.execute(sql).df()
        rows = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
        assert rows(got) == rows(want), name


def test_held_out_rows_follow_the_rule(spark):
    import zlib

    rows = spark.range(200).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)
    groups = defaultdict(int)
    for r in rows:
        groups[r.h] += 1
    assert groups[True] > 20


def test_stages_take_clashing_column_names(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(60)
    names = ("n_lines", "n_removed", "gone", "pos", "h1", "id", "key", "mark", "fp", "norm", "band", "component", "hits", "contaminated", "score", "toxicity", "ids", "names", "given")
    wide = docs.withColumns({n: F.lit(f"own {n}") for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, tables)
        assert Counter(out.columns) == Counter(wide.columns), name
        kept = {r.doc_id for r in stage(spark, docs, tables).collect()}
        rows = out.collect()
        assert {r.doc_id for r in rows} == kept and {r.key for r in rows} == {"own key"}
    assert corpus_pipeline.encode(spark, wide, tables).count() == 60
    assert near.keep_one(wide).count() == near.keep_one(docs).count()


def near_components(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.id: bytes(r.component) for r in near.groups(docs, **more).collect()}


def brute_components(texts, similarity=0.8):
    sets = [shingle_set(t) for t in texts]
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        union = len(sets[i] | sets[j])
        if not union or len(sets[i] & sets[j]) >= similarity * union:
            top[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def same_partition(got, want):
    assert len(got) == len(want) and len({(got[i], w) for i, w in enumerate(want)}) == len(set(want)) == len(set(got.values()))


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**9)}"
    return out


@pytest.mark.parametrize("more_stars", [near.MORE_STARS, 0])
def test_no_link_of_large_groups_of_copies_is_lost(spark, more_stars):
    """Groups with and without their unedited text, edits so many that most copies are just above or below the limit."""
    rng = random.Random(11)
    bases = [[f"w{k}x{rng.randrange(10**6)}" for _ in range(n)] for k, n in enumerate((90, 200, 200, 700))]
    texts = [" ".join(bases[0]), " ".join(bases[1])]
    for base, edits in zip(bases, ((0, 3), (2, 6), (1, 5), (8, 16))):
        texts += [" ".join(edited(rng, base, rng.randint(*edits))) for _ in range(90)]
    chain = [f"c{i}" for i in range(100)]
    texts += [" ".join(chain[i : i + 60]) for i in range(0, 40, 4)]  # each similar to its neighbours only
    rng.shuffle(texts)
    want = brute_components(texts)
    assert 10 < len(set(want)) < 300
    same_partition(near_components(spark, texts, more_stars=more_stars), want)


def test_pairs_among_texts_that_share_a_long_passage_are_linked(spark):
    rng = random.Random(3)
    passage = [f"shared{i}" for i in range(148)]
    texts = []
    for i in range(60):
        own = [f"own{i}x{j}" for j in range(36)]
        other = own[:-19] + [f"other{i}x{j}" for j in range(19)]
        texts += [" ".join(passage + own), " ".join(passage + other)]
    rng.shuffle(texts)
    want = brute_components(texts)
    assert len(set(want)) == 60
    same_partition(near_components(spark, texts), want)


def test_links_at_the_limit_stay(spark):
    """Similarity of exactly 0.8, of sizes 40 and 50, and just below it."""
    rng = random.Random(1)
    texts = []
    for _ in range(100):
        words = [f"w{rng.randrange(10**9)}" for _ in range(54)]
        texts += [" ".join(words), " ".join(words[:44])]
        words = [f"w{rng.randrange(10**9)}" for _ in range(54)]
        texts += [" ".join(words), " ".join(words[:43])]
    want = brute_components(texts)
    assert len(set(want)) == 300
    same_partition(near_components(spark, texts), want)


def test_shingle_hashes_do_not_depend_on_place_or_block(monkeypatch):
    words = [f"w{i * 31 % 997}" for i in range(3000)]
    words[100] = "x" * 5000
    norm = near.normal(" ".join(words).encode())
    whole = near.shingle_hashes(norm, 5)
    assert len(whole) == 2996 and len(set(whole.tolist())) == len(set(zip(*(words[i:] for i in range(5)))))
    for at in (0, 1, 99, 1500, 2995):
        assert near.shingle_hashes(" ".join(words[at : at + 5]).encode(), 5)[0] == whole[at]
    monkeypatch.setattr(near, "SPAN", 700)
    assert (near.shingle_hashes(norm, 5) == whole).all()
    assert len(near.shingle_hashes(b"", 5)) == 0 and len(near.shingle_hashes(b"a b", 5)) == 1
