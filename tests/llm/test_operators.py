"""Edge cases, brute force, round trips and held-out accuracy of the ten operators."""

import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from granary.llm import byte_pair, containment, discriminant, language, line_spread, main_text, order_minhash, quality_cascade, secret_forest, toxic_grammar
from granary.llm.queries import ORACLES, QUERIES, vocabulary
from granary.llm.tables import Scratch, dealt, read
from granary.llm.words import codes, heads, occurrences, shingles, texts_to_arrays
from pyspark.sql import functions as F

from tests.oracle import connect, same

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, salt string, root string, score string"
LONG = "parola " * 30_000
ODD = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "uno due", None, "a", 7), (3, "uno due", None, "a", 7), (4, "   \n\n ", "en", "b", 6), (5, LONG, "en", "c", len(LONG)), (6, "!!! ??? ...", "fr", "c", 11), (7, "x" * 100_000, "en", "c", 100_000), (8, "the same text of eight words in all", "en", "d", 35), (9, "The same text, of eight words in all.", "en", "d", 37)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "s", "r", "q") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (8, 1, 1), (9, 0, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "same text of eight words in"), (2, None), (3, "uno due"), (4, "same text of eight words in")], "item_id long, text string")


RUNS = {
    "secret": lambda d, lab, i: secret_forest.scan(d, secret_forest.train(secret_forest.labelled_findings(200))),
    "language": lambda d, lab, i: language.detect_languages(d),
    "rules": lambda d, lab, i: quality_cascade.quality_rules(d),
    "bpe": lambda d, lab, i: byte_pair.bpe_round_trip(d, vocabulary()),
    "near": lambda d, lab, i: order_minhash.near_duplicates(d),
    "quality": lambda d, lab, i: discriminant.quality_scores(d, lab),
    "benchmark": lambda d, lab, i: containment.contaminated(d, i),
    "toxicity": lambda d, lab, i: toxic_grammar.toxicity(d, lab),
    "lines": lambda d, lab, i: line_spread.without_boilerplate(d),
}
ONE_ROW_EACH = {"language", "rules", "bpe", "quality", "toxicity", "lines"}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows(odd, labels, items, name):
    got = RUNS[name](odd, labels, items).collect()
    if name in ONE_ROW_EACH:
        assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in ODD)
    if name == "near":
        assert {r["doc_id"]: r["class_id"] for r in got} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 8}
    if name == "benchmark":
        assert sorted((r["doc_id"], r["item_id"], r["containment"]) for r in got) == [(3, 3, 1.0), (3, 3, 1.0), (8, 1, 1.0), (8, 4, 1.0), (9, 1, 1.0), (9, 4, 1.0)]
    if name == "language":
        assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {1, 2, 4, 6}
    if name == "bpe":
        assert {r["doc_id"]: r["decoded"] for r in got} == {r[0]: r[1] or "" for r in ODD}


@pytest.mark.parametrize("name", RUNS)
def test_empty_tables(odd, labels, items, name):
    assert RUNS[name](odd.limit(0), labels.limit(0), items.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    same(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name])


def test_rules_go_by_rejection_for_their_cost(spark):
    rows = quality_cascade.measured(read(spark, FOLDER, "documents"))
    found = quality_cascade.ordered_rules(rows)
    assert {x[0] for x in found} == set(quality_cascade.rules())
    worth = [(rejected + 1 / rows.count()) / seconds for _, _, rejected, seconds in found]
    assert worth == sorted(worth, reverse=True)
    for _, condition, rejected, _ in found:
        assert rejected == rows.filter(condition).count() / rows.count()


def test_words_and_runs_match_a_plain_loop():
    rng = random.Random(3)
    texts = ["", None, "A b", "É!é é", *["".join(rng.choice("ab É\n.") for _ in range(rng.randint(0, 60))) for _ in range(200)]]
    words, bounds = codes(*texts_to_arrays(texts))
    plain = ["".join(c if c.isalnum() else " " for c in (t or "").lower()).split() for t in texts]
    assert np.diff(bounds).tolist() == [len(p) for p in plain]
    flat = [w for p in plain for w in p]
    assert len(set(flat)) == len(set(words.tolist())) == len(set(zip(flat, words.tolist(), strict=True)))
    first, of = heads(*texts_to_arrays(texts))
    assert of.tolist() == bounds.tolist() and len(set(zip([w.encode()[:8] for w in flat], first.tolist(), strict=True))) == len(set(first.tolist()))
    runs, of = shingles(words, bounds, 3)
    own = [tuple(p[i : i + 3]) for p in plain for i in range(len(p) - 2)]
    assert len(own) == len(runs) and len(set(zip(own, runs.tolist(), strict=True))) == len(set(own))
    n = occurrences(words, bounds).tolist()
    assert n == [p[:i].count(w) for p in plain for i, w in enumerate(p)]


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    library.no_truncation()
    library.no_padding()
    rng = random.Random(5)
    texts = ["", " ", "\n", "don't 's", "<|endoftext|>a <|endoftext|>", "a" * 5000, *["".join(rng.choice("ab \t\n\r\x1c\x85\xa0　'sdre1²Ⅷé́中あ🙂<|>") for _ in range(rng.randint(0, 50))) for _ in range(1500)]]
    texts += [r["text"] for r in read(spark, FOLDER, "documents").select("text").collect()]
    with open(vocabulary(), encoding="utf-8") as f:
        coder = byte_pair.BytePair(f.read(), most_words=2000)
    got = [x for i in range(0, len(texts), 50) for x in coder.encode(texts[i : i + 50])]
    for t, x in zip(texts, got, strict=True):
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(x, "<u4").tolist() == ids
        assert coder.decode(x) == library.decode(ids, skip_special_tokens=False)
    assert 0 < coder.merged < coder.speculated


def test_bpe_digests(spark):
    row = byte_pair.bpe_round_trip(spark.createDataFrame([(1, "Hello world")], "doc_id long, text string"), vocabulary(), digests=True).first()
    assert row["n_tokens"] == 2 and row["decoded_sha256"] == hashlib.sha256(b"Hello world").hexdigest()
    assert row["ids_sha256"] == hashlib.sha256(np.array([15496, 995], "<u4").tobytes()).hexdigest()


def test_alignment_is_the_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 20))] for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert order_minhash.common(a, b, 50) == t[-1, -1]
        least = 0.6
        exact = 2 * t[-1, -1] / max(1, len(a) + len(b))
        got = order_minhash.similarity(np.array(a, np.uint32), np.array(b, np.uint32), least)
        assert (got >= least) == (len(a) + len(b) > 0 and exact >= least)


def test_near_duplicates_match_brute_force(spark):
    docs = read(spark, FOLDER, "documents")
    table = docs.select("doc_id", "text").toPandas()
    words, bounds = codes(*texts_to_arrays(list(table["text"])))
    own = [(words[a:b] >> np.uint64(32)).astype("<u4") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    root = {int(d): int(d) for d in table["doc_id"]}
    find = lambda x: x if root[x] == x else find(root[x])
    ids = [int(d) for d in table["doc_id"]]
    for i in range(len(own)):
        for j in range(i):
            if len(own[i]) >= 20 and order_minhash.similarity(own[i], own[j], 0.8) >= 0.8:
                a, b = sorted((find(ids[i]), find(ids[j])))
                root[b] = a
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(docs).collect()}
    long = [d for d, w in zip(ids, own, strict=True) if len(w) >= 20]
    assert {d: got[d] for d in long} == {d: find(d) for d in long}


def test_a_large_group_of_near_copies_is_one_class(spark):
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 400)}" for _ in range(150)]
    texts = [" ".join(w if rng.random() > 0.03 else f"n{rng.randint(0, 10**6)}" for w in base) for _ in range(300)]
    other = [(1000 + i, " ".join(f"z{rng.randint(0, 10**6)}" for _ in range(150))) for i in range(50)]
    rows = order_minhash.near_duplicates(spark.createDataFrame([*enumerate(texts), *other], "doc_id long, text string"), most_broadcast=10).collect()
    assert {r["class_id"] for r in rows if r["doc_id"] < 1000} == {0} and len({r["class_id"] for r in rows}) == 51


@pytest.mark.parametrize("copies", [300, 700])
def test_scattered_edits_get_the_classes_of_all_pairs(spark, copies):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    texts = [" ".join(w if rng.random() > 0.1 else f"n{rng.randint(0, 10**6)}" for w in base) for _ in range(copies)]
    words, bounds = codes(*texts_to_arrays(texts))
    own = [(words[a:b] >> np.uint64(32)).astype("<u4") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    labelled, of = order_minhash.kmers(words, bounds)
    values = order_minhash.sketches_of(labelled, of, order_minhash.factors(order_minhash.SKETCHES, 11), 2)
    root = list(range(copies))
    for i in range(copies):
        for j in range(i):
            if root[i] != root[j] and (values[i] == values[j]).any() and order_minhash.similarity(own[i], own[j], 0.8) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    rows = order_minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == dict(enumerate(root)) and len(set(root)) < 5


def test_bit_sets_rule_out_no_similar_pair():
    rng = random.Random(6)
    base = [rng.randint(0, 300) for _ in range(200)]
    own = [np.array([w if rng.random() > p else rng.randint(0, 300) for w in base[: rng.randint(120, 200)]], "<u4") for p in (0, 0.1, 0.2, 0.9) for _ in range(25)]
    bits = order_minhash.folded([order_minhash.word_bits(x) for x in own])
    may = order_minhash.possible(np.array([len(x) for x in own]), bits, 0.8)
    is_near = np.array([[order_minhash.similarity(x, y, 0.8) >= 0.8 for y in own] for x in own])
    assert (may | ~is_near).all() and is_near.sum() > 100 and (~may).sum() > 100


def test_near_copies_of_66_and_70_words_share_buckets(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randint(0, 10**6)}" for _ in range(70)] for _ in range(20)]
    rows = [(2 * i + k, " ".join(t)) for i, b in enumerate(base) for k, t in enumerate((b, b[:20] + b[24:]))]
    got = order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {d: d // 2 * 2 for d, _ in rows}


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 50), (50, 70)] + [(2000 - i, 3000) for i in range(400)], "a long, b long")
    with Scratch(spark) as scratch:
        got = {r["id"]: r["root"] for r in order_minhash.components(scratch, links).collect()}
        with pytest.raises(RuntimeError):
            order_minhash.components(scratch, links, most_rounds=1)
    assert got == {**{i: 0 for i in range(1, 21)}, 70: 50, 100: 50, 3000: 1601, **{i: 1601 for i in range(1602, 2001)}}


def test_sketches_match_a_plain_loop():
    rng = np.random.default_rng(3)
    labelled = np.unique(rng.integers(1, 2**63, 500).astype(np.uint64))
    rng.shuffle(labelled)
    bounds, by = np.array([0, 0, 1, 3, 200, 200, 500]), order_minhash.factors(8, 11)
    got = order_minhash.sketches_of(labelled, bounds, by, 2)
    spread = labelled ^ (labelled >> np.uint64(29))
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        for j in range(8):
            least = sorted(range(a, b), key=lambda x: int(spread[x] * (by[j] | np.uint64(1))))[:2]
            total = np.zeros(1, np.uint64)
            for x in sorted(least):
                total = order_minhash.mix(total + labelled[x : x + 1])
            assert got[i, j] == total[0]


def test_hot_keys_meet_in_parts(spark):
    many = spark.createDataFrame([(i % 3 if i % 2 else 9, i) for i in range(2000)], "key long, x long")
    few = many.groupBy("key").agg(F.count("*").alias("k")).withColumn("y", F.col("key") * 10).filter("key != 2")
    for how in ("inner", "left"):
        plain = sorted(map(str, many.join(few.drop("k"), ["key"], how).collect()))
        assert sorted(map(str, dealt(many, few, ["key"], 2000, how).select("key", "x", "y").collect())) == plain
        assert sorted(map(str, dealt(many.withColumn("k", F.lit(500)), few.withColumn("k", F.lit(500)), ["key"], 2000, how).select("key", "x", "y").collect())) == plain


def test_containment_in_blocks_is_the_same(spark):
    docs, bench = read(spark, FOLDER, "documents"), read(spark, FOLDER, "benchmark")
    whole, blocks = (sorted(map(tuple, containment.contaminated(docs, bench, block_runs=n).collect())) for n in (2_000_000, 100))
    assert whole == blocks and whole


def test_containment_finds_partial_copies(spark):
    item = [f"i{k}" for k in range(40)]
    rng = random.Random(1)
    noise = lambda n: [f"x{rng.randint(0, 10**6)}" for _ in range(n)]
    docs = [(1, " ".join(noise(5000) + item[:36] + noise(5000))), (2, " ".join(noise(100) + item[:30] + noise(100)))]
    got = containment.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["n_shared"]) for r in got] == [(1, 32)]


def test_held_out_language(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    got = language.detect_languages(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_held_out_quality(spark):
    docs, lab = (read(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    got = discriminant.quality_scores(docs, lab).filter("held_out").join(lab, "doc_id")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95


def test_held_out_toxicity(spark):
    docs, lab = (read(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    got = toxic_grammar.toxicity(docs, lab).filter("held_out").join(lab, "doc_id")
    assert got.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0] > 0.95


def test_grammar_reads_clauses():
    g = toxic_grammar.Grammar()
    one = lambda t: g.kinds[next(iter(g.clauses(t)))]
    assert one("you are an idiot") == (4, 0, 1)
    assert one("he said that idiot") == (2, 0, 1)
    assert one("not an idiot") == (1, 0, 0)
    assert one("they aren\u2019t idiots") == one("they aren't idiots") == (1, 0, 1)
    assert one("I will kill you") == (0, 3, 1)
    assert not g.clauses("a fine day. nothing more")


def test_no_text_with_a_clause_is_passed_over():
    g = toxic_grammar.Grammar(["дурак", "βλάκ", "straß"])
    texts = ["¡idiota!", "«idiot»", "\u201cidiot\u201d", "you\u00a0idiot", "so\u2014idiot", "two×idiot", "ДУРАК", "ΒΛΆΚΑΣ", "İdiot \u212aill", "É IDIOT", "STRAßE", None, "", "a fine day, déjà vu"]
    may = g.may_match(pa.array(texts))
    assert [bool(g.clauses(t or "")) <= bool(m) for t, m in zip(texts, may, strict=True)] == [True] * len(texts)
    assert all(g.clauses(t) for t in texts[:8]) and (g.features(pa.array(texts[:8])) > 0).any(axis=1).all() and not may[-3:].any()


def test_forest_learns():
    rows = secret_forest.labelled_findings(1200)
    forest = secret_forest.train(rows[:800])
    x = np.array([secret_forest.describe(*r[:4]) for r in rows[800:]])
    assert ((forest.predict(x) > 0.5) == [bool(r[4]) for r in rows[800:]]).mean() > 0.95


def test_secret_in_prose(spark):
    texts = [(1, 'foo token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" bar'), (2, "commit 04dbebab91ab85687d33eeaaf9ac699e1188f962 done"), (3, "plain words only")]
    rows = {r["doc_id"]: r for r in secret_forest.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert rows[1]["is_secret"] and not rows[2]["is_secret"] and rows[1]["start"] == 13 and 3 not in rows


def test_main_text():
    page = '<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><a>x</a></nav><div class="ad">Buy</div><article><h1>T&amp;t</h1><p>One&nbsp;two <b>three<br>four<p>Five<form>no</form><div id="comments"><p>bad</div></article><footer>f</footer></body></html>'
    assert main_text.main_text(page) == "T&t\nOne two three four\nFive"
    assert main_text.main_text(None) == main_text.main_text("") == main_text.main_text("<nav>only</nav>") == ""
    assert main_text.main_text("<p>a <p>b") == "a\nb"


PLAIN = "<body><div><ul>" + "<li><a href=x>Menu</a></li>" * 60 + "</ul></div><div><h1>Title</h1><div>" + "<p>Long text of a page that goes on and on for a while here.</p>" * 4 + "</div></div><div><a>x</a> <a>y</a></div></body>"


def test_clustered_lines_choose_the_region(monkeypatch):
    right = "\n".join(["Title", *["Long text of a page that goes on and on for a while here."] * 4])
    assert main_text.main_text(PLAIN) == right
    monkeypatch.setattr(main_text, "above", lambda smooth: np.ones(len(smooth), bool))
    assert "Menu" in main_text.main_text(PLAIN)


def test_articles_and_names():
    two = "<article><p>" + "a long first article " * 20 + "</p></article><nav>no</nav><article><p>short second</p></article>"
    assert main_text.main_text(f"<body>{two}</body>").endswith("\nshort second")
    assert main_text.main_text('<div class="share-price"><p>The price rose.</p></div>') == "The price rose."
    assert main_text.main_text('<body><div class="related-posts">no</div><div class="cookie-banner">no</div><div class="related-work">yes</div></body>') == "yes"


@pytest.mark.parametrize("page", ["<b>" * 20_000 + "</i>" * 20_000 + "x", "<b><article>" + "<i>" * 20_000 + "</b>" * 20_000 + "x", "<b>" * 20_000 + "<hr>" * 20_000 + "x", "<article>" * 3000 + "x"])
def test_unclosed_tags_take_linear_time(page):
    began = time.perf_counter()
    assert main_text.main_text(page) == "x" and time.perf_counter() - began < 5


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<p>a"), (3, "w", "<p>b"), (3, "w", "<p>b"), (4, "x", "<p>" + "word " * 100_000 + "</p>")]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(map(tuple, main_text.extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (2, None, "", 0), (None, "v", "a", 1), (3, "w", "b", 1), (3, "w", "b", 1), (4, "x", " ".join(["word"] * 100_000), 499_999)], key=str)
    assert main_text.extract(pages.limit(0)).count() == 0


def test_lines_keep_the_first(spark):
    rows = [(i, f"own line number {i}\nthe shared line here", f"s{i}") for i in range(8)] + [(20, "a b c d\nshort", "s1")]
    got = {r["doc_id"]: r["text"] for r in line_spread.without_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] == rows[0][1] and got[5] == "own line number 5" and got[20] == rows[-1][1]


def test_lines_meet_the_same_keys_by_broadcast_and_in_parts(spark):
    docs = read(spark, FOLDER, "documents")
    small, large = (sorted(map(tuple, line_spread.without_boilerplate(docs, most_broadcast=n).select("doc_id", "n_removed", "text").collect())) for n in (200_000, -1))
    assert small == large and any(r[1] for r in small)
