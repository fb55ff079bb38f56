"""Short items, lines and findings are not left out; rows of one id go one by one; context tables are those of a plain coder."""

import math
import random

import corpus_pipeline as p
import numpy as np
import pyarrow as pa
import pytest
from granary.llm import containment, discriminant, language, line_spread, secret_forest, toxic_grammar
from granary.llm.tables import read

FOLDER = "/root/testdata/sf0.001"


def test_items_of_few_words(spark):
    docs = spark.createDataFrame([(1, "only this: forty two, and more words here"), (2, "forty and two"), (3, "Forty-two!"), (4, None), (5, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "forty two"), (2, "a b c d"), (3, "words"), (4, "..."), (5, "b c d e f")], "item_id long, text string")
    got = sorted(tuple(r) for r in containment.contaminated(docs, items).collect())
    assert got == [(1, 1, 1.0, 1), (1, 3, 1.0, 1), (3, 1, 1.0, 1), (5, 2, 1.0, 1), (5, 5, 1.0, 1)]
    assert got == sorted(tuple(r) for r in containment.contaminated(docs, items, block_runs=1).collect())


def test_lines_of_one_word_and_without_spaces(spark):
    rows = [(i, f"Menu\n\n版权所有保留一切权利\nown text {i}", f"s{i}") for i in range(7)]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_spread.without_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] == (rows[0][1], 0) and all(got[i] == (f"\nown text {i}", 2) for i in range(1, 7))


def test_rows_of_one_id_go_one_by_one(spark):
    item = read(spark, FOLDER, "benchmark").first()["text"]
    rows = [(1, "a clean text of its own"), (1, f"before {item} after"), (2, f"x {item}"), (None, f"x {item}")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((str(r["doc_id"]), r["text"]) for r in p.decontaminate(spark, docs, FOLDER).collect()) == sorted([("1", rows[0][1]), ("None", rows[3][1])])
    scored = discriminant.quality_scores(read(spark, FOLDER, "documents"), read(spark, FOLDER, "labels"))
    good, bad = (read(spark, FOLDER, "documents").join(scored.filter(f"predicted = {k}").select("doc_id"), "doc_id").first() for k in (1, 0))
    mixed = spark.createDataFrame([(7, x["text"], "en", "s", 0) for x in (good, bad)], docs.schema)
    own = {r["text_hash"]: r["predicted"] for r in discriminant.quality_scores(mixed, read(spark, FOLDER, "labels")).collect()}
    assert len(own) == 2
    assert p.quality(spark, mixed, FOLDER).count() == sum(own.values())


def plain_bits(counts, context, byte, kinds):
    """PPM with escapes over dictionaries: the code length of a byte after its context (bytes, at most three)."""
    if context in counts:
        own = counts[context]
        total, d = sum(own.values()), len(own)
        if byte in own:
            return -math.log2(own[byte] / (total + d))
        return -math.log2(d / (total + d)) + (plain_bits(counts, context[1:], byte, kinds) if context else 8)
    return plain_bits(counts, context[1:], byte, kinds) if context else 8


def test_code_lengths_are_those_of_a_plain_coder(spark):
    rows = [(r["text"], r["lang"]) for r in read(spark, FOLDER, "documents").filter("text is not null and lang is not null").collect()]
    by: dict[str, list[str]] = {}
    for text, lang in rows:
        by.setdefault(lang, []).append(text)
    grams = {lang: np.unique(language.grams(pa.array(texts)), return_counts=True) for lang, texts in by.items()}
    model = language.ContextTables({lang: (v.astype(np.int64), n.astype(float)) for lang, (v, n) in grams.items()})
    trees: dict[str, dict] = {}
    for lang, (values, n) in grams.items():
        tree = trees.setdefault(lang, {})
        for g, k in zip(values.tolist(), n.tolist(), strict=True):
            raw = g.to_bytes(4, "big")
            for order in range(4):
                own = tree.setdefault(raw[3 - order : 3], {})
                own[raw[3]] = own.get(raw[3], 0) + k
    sample = [t[:300] for t, _ in rows[::20]]
    bits, _ = model.lengths(pa.array(sample))
    for i, text in enumerate(sample):
        data = b"\n\n\n" + bytes(language.lowered(np.frombuffer(text.encode(), np.uint8)))
        for j, lang in enumerate(model.langs):
            want = sum(plain_bits(trees[lang], data[k - 3 : k], data[k], None) for k in range(3, len(data)))
            assert bits[i, j] == pytest.approx(want, abs=0.1)


def held_out_findings():
    """(text, the finding or None): forms and names that the made training set does not have."""
    r = random.Random(99)
    some = lambda signs, k: "".join(r.choice(signs) for _ in range(k))
    small, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    out = []
    for _ in range(40):
        s = some(small + small.upper() + digits + "!$%^*", r.randint(9, 14)) + r.choice(digits)
        out += [(f'db.password := "{s}"\n', s), (f"export DB_PASSWORD='{s}'\n", s), (f"mongodb://root:{s}@10.0.0.7:27017/db", s)]
        s = "AIza" + some(small + small.upper() + digits + "_-", 35)
        out.append((f'"google_api_key" : "{s}",', s))
        s = ".".join(["eyJ" + some(small + digits, 17), "eyJ" + some(small.upper() + digits, 40), some(small + digits + "_", 43)])
        out.append((f"Cookie: session {s} ok", s))
        s = "-----BEGIN ENCRYPTED PRIVATE KEY-----\n" + "\n".join(some(small + small.upper() + digits + "+/", 64) for _ in range(6)) + "\n-----END ENCRYPTED PRIVATE KEY-----"
        out.append((f"pem follows\n{s}\nend", s))
        s = some(small, 32)
        out.append((f'api_key: "{s}"', s))
        for text in (f"release sha1: {some('0123456789abcdef', 40)}", f"password: {r.choice(['mandatory', 'optional', 'enter here', 'missing'])}", f"the token: {some(small, 3)} word", f"order id {some(digits, 18)}", f"http://localhost:{r.randint(1000, 9999)}/x", "token = response.json", f"key: {some('aeiou', 2)}ter{some('aeiou', 1)}ness"):
            out.append((text, None))
    return out


def test_held_out_forms_of_secrets():
    """Stated: precision and recall of 0.95 or more on forms that the training set does not have."""
    forest = secret_forest.train(secret_forest.labelled_findings())
    right = shown = wanted = 0
    for text, secret in held_out_findings():
        found = list(secret_forest.candidates(text)) if secret_forest.with_candidates(pa.array([text]))[0] else []
        if found:
            x = np.array([secret_forest.describe(w, text[max(0, a - 60) : a], text[a + len(w) : a + len(w) + 20], "src/app.py") for a, w in found])
            said = [w for (_, w), score in zip(found, forest.predict(x), strict=True) if score > 0.5]
            shown += len(said)
            right += secret in said
        wanted += secret is not None
    assert right >= 0.95 * wanted and right >= 0.95 * shown


@pytest.mark.parametrize(("text", "kinds"), [
    ("He said you are an idiot", {(2, 0, 1): 1}),
    ("He said: you are an idiot", {(2, 0, 1): 1}),
    ("He said: think of it. You are an idiot.\nYou are an idiot.", {(2, 0, 1): 1, (4, 0, 1): 1}),
    ('"Go away. You are an idiot. I mean it."', {(2, 0, 1): 1}),
    ('He wrote: "You are an idiot." You are an idiot.', {(2, 0, 1): 1, (4, 0, 1): 1}),
    ("He said it. You are an idiot", {(4, 0, 1): 1}),
    ("Note: you are an idiot", {(4, 0, 1): 1}),
    ('an open " mark\nyou are an idiot', {(4, 0, 1): 1}),
    ("You are not an idiot. You are an idiot", {(1, 0, 1): 1, (4, 0, 1): 1}),
])
def test_reports_go_over_the_ends_of_clauses(text, kinds):
    g = toxic_grammar.Grammar()
    assert {g.kinds[k]: n for k, n in g.clauses(text).items()} == kinds


def test_clauses_are_those_of_a_plain_walk(spark):
    """The composed table against a walk with plain variables, over whole texts."""
    g = toxic_grammar.Grammar(["ere", "tho"])
    t = toxic_grammar

    def walk(text):
        found, said, opened, quoted, left, insult, threat, target = {}, False, False, False, 0, 0, 0, 0
        for token in [*t.TOKEN.findall(text.lower().replace("’", "'")), "."]:
            symbol = t.MARKS.get(token, None) if token in t.MARKS else g.class_of(token)
            if symbol in t.LAST:
                if insult or threat:
                    found[insult, threat, target] = found.get((insult, threat, target), 0) + 1
                if symbol == t.COLON:
                    opened = opened or said
                elif symbol == t.BREAK:
                    opened = quoted = False
                said, left, insult, threat, target = False, 0, 0, 0, 0
                continue
            if symbol in t.KINDS:
                how = "negated" if left else "reported" if said or opened or quoted else "plain"
                if symbol == t.THREAT:
                    threat = max(threat, {"negated": 1, "reported": 2, "plain": 3}[how])
                else:
                    insult = max(insult, {"negated": 1, "reported": 2, "plain": 3 if symbol == t.LIKELY else 4}[how])
            left = 3 if symbol == t.NEGATION else max(0, left - 1)
            if symbol == t.REPORT:
                said = True
            elif symbol == t.QUOTE:
                if quoted:
                    said = opened = False
                quoted = not quoted
            elif symbol == t.TARGET:
                target = 1
        return found

    rng = random.Random(4)
    words = ["he", "said", "you", "idiot", "kill", "not", "thou", "erest", ".", ":", "\n", '"', "and", "»", "told", "wertlos"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [r["text"] for r in read(spark, FOLDER, "documents").filter("text is not null").collect()]
    for text in texts:
        assert {g.kinds[k]: n for k, n in g.clauses(text).items()} == walk(text)
