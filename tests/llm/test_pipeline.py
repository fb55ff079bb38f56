"""The pipeline's stages, each on its own input: the last four against plain loops in Python, quality against the classifier's own result.

The classifier itself is held to labels it has not seen, in test_operators.py.
"""

import hashlib
import re
from collections import defaultdict

import corpus_pipeline as p
import numpy as np
from granary.llm import discriminant, order_minhash
from granary.llm.queries import vocabulary
from granary.llm.tables import read

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def cut(text):
    return WORD.findall((text or "").lower())


def kept_lines(rows):
    """doc_id and text after lines with a word on six sites or more went from all but the first."""
    sites, first = defaultdict(set), {}
    lines = [(d, s, [(x, re.sub(r"^[ \t-\r]+|[ \t-\r]+$", "", x)) for x in (t or "").split("\n")]) for d, t, s in rows]
    long = lambda key: key != ""
    for d, s, own in lines:
        for _, key in own:
            if long(key):
                sites[key].add(s or "")
                first[key] = min(first.get(key, d), d)
    out = {}
    for d, _, own in lines:
        stay = [x for x, key in own if not (long(key) and len(sites[key]) >= 6 and first[key] != d)]
        if len(stay) == len(own) or re.search(r"[^ \t-\r]", "\n".join(stay)):
            out[d] = "\n".join(stay)
    return out


def first_of_class(rows):
    """The least ids of the classes that all pairs of texts give."""
    number: dict = {}
    own = {d: np.array([number.setdefault(w, len(number)) for w in cut(t)], "<u4") for d, t, _ in rows}
    root = {d: d for d in own}
    ids = sorted(own)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if root[a] != root[b] and order_minhash.similarity(own[a], own[b], 0.8) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return sorted(set(root.values()))


def clean(rows, items):
    runs = lambda t, k=5: {tuple(w[i : i + k]) for w in [cut(t)] for i in range(len(w) - k + 1)}
    wanted = [runs(t) for t in items]
    return sorted(d for d, t, _ in rows if not any(w and len(w & own) >= 0.8 * len(w) - 1e-9 for own in [runs(t)] for w in wanted))


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    docs, lab, bench = (read(spark, FOLDER, t) for t in ("documents", "labels", "benchmark"))
    items = [r["text"] for r in bench.collect()]
    library = Tokenizer.from_file(vocabulary())
    library.no_truncation()
    library.no_padding()
    for name, stage in p.STAGES:
        rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
        out = stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        got = {r["doc_id"]: r for r in out.collect()}
        if name != "encode":
            assert tuple(out.columns) == p.COLUMNS and all(r["n_chars"] == len(r["text"]) for r in got.values() if r["text"] is not None)
        if name == "quality":
            assert sorted(got) == sorted(r["doc_id"] for r in discriminant.quality_scores(docs, lab).filter("predicted = 1").collect())
        elif name == "lines":
            assert {d: r["text"] for d, r in got.items()} == kept_lines(rows)
        elif name == "near_duplicates":
            assert sorted(got) == first_of_class(rows)
        elif name == "decontaminate":
            assert sorted(got) == clean(rows, items)
        else:
            for d, t, _ in rows:
                ids = library.encode(t or "", add_special_tokens=False).ids
                assert got[d]["n_tokens"] == len(ids) and got[d]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        docs = out
    assert sorted(r["doc_id"] for r in p.run(spark, FOLDER).select("doc_id").collect()) == sorted(got)


def test_stages_on_odd_rows(spark):
    """Null ids and texts, empty texts, repeated rows: no stage fails, and near_duplicates keeps rows without an id."""
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, "en", "a", 0), (1, words, "en", "a", 0), (2, words + " more", "en", "b", 0), (None, words, "en", "c", 0), (None, None, None, None, None), (3, "", "en", "a", 0), (4, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    near = p.near_duplicates(spark, docs, FOLDER).collect()
    assert sorted(str(r["doc_id"]) for r in near) == ["1", "3", "4", "None", "None"]
    for name, stage in p.STAGES:
        assert stage(spark, docs, FOLDER).count() >= (0 if name == "quality" else 4)
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
