"""Operator 5: byte-level BPE, encoded by speculation and verification.

A text is cut by the tokenizer's pattern. For words not met before, greedy
longest match over the vocabulary proposes tokens; then every adjacent pair of
proposals is looked up, all words at once, in a table of pairs that are known to
stand (merging the two tokens' bytes alone gives back just those two). A word whose
tokens are whole and whose pairs all stand is its exact encoding; only the other
words go through exact merging. Words and pairs are kept in bounded tables.

Null texts count as empty. Empty texts give no tokens. Repeated rows give equal
rows, and an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from granary.llm.tables import emit, slices

#: The word pattern of the public byte-level tokenizer, with white
#: space spelt out as Unicode's White_Space property.
SPACE = r"\t-\r \u0085   -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def tangled(text: str) -> bool:
    """Whether it has white space other than single spaces and line ends between two characters."""
    return text.split() != text.replace("\n", " ").split(" ")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class BytePair:
    """An encoder and decoder for one vocabulary, with bounded memory."""

    def __init__(self, spec: str, most_words: int = 400_000, most_pairs: int = 2_000_000):
        data = json.loads(spec)
        model, letters = data["model"], byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.ids = {raw(t): i for t, i in model["vocab"].items()}
        pairs = [tuple(map(raw, p.split(" ") if isinstance(p, str) else p)) for p in model["merges"]]
        self.ranks = {(self.ids[a], self.ids[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = [self.ids[a + b] for a, b in pairs]
        self.one = [self.ids[bytes([b])] for b in range(256)]
        added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.bytes_of: dict[int, bytes] = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in added.items()}
        self.added = added
        self.split_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.words_of = regex.compile(PATTERN).findall
        self.longest = max(map(len, self.ids))
        self.whole: dict[int, bool] = {}
        self.stands: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.most_words, self.most_pairs = most_words, most_pairs
        self.speculated = self.merged = 0

    def merge(self, parts: list[int]) -> list[int]:
        """Exact BPE: the lowest-ranked adjacent pair, leftmost first, until none is left."""
        if len(parts) > 200:
            return self.merge_long(parts)
        rank, none = self.ranks.get, len(self.made)
        ranks = [rank(p, none) for p in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) != none:
            i = ranks.index(best)
            parts[i : i + 2] = [self.made[best]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap and linked neighbours: n log n steps for very long words."""
        import heapq

        ranks, n = self.ranks, len(parts)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(ranks[p], i, p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            best, i, pair = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or (parts[i], parts[j]) != pair:
                continue
            parts[i], alive[j], after[i] = self.made[best], False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (p := (parts[a], parts[b])) in ranks:
                    heapq.heappush(heap, (ranks[p], a, p))
        return [t for t, kept in zip(parts, alive, strict=True) if kept]

    def exact(self, word: bytes) -> list[int]:
        return self.merge([self.one[b] for b in word])

    def greedy(self, word: bytes) -> list[int]:
        out, i, n, ids, longest = [], 0, len(word), self.ids, self.longest
        while i < n:
            for j in range(min(n, i + longest), i, -1):
                if (t := ids.get(word[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
        return out

    def learn(self, fresh: list[str]) -> None:
        """Puts the encodings of new words into the table: propose, verify all pairs at once, repair."""
        if len(self.stands) > self.most_pairs:
            self.stands.clear()
        words = [w.encode() for w in fresh]
        proposed = [self.greedy(w) for w in words]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        bad = np.zeros(len(words), bool)
        tokens, place = np.unique(flat, return_inverse=True)
        fits = np.array([self.is_whole(int(t)) for t in tokens], bool)
        bad[owner[~fits[place]]] = True
        if flat.size > 1:
            same = owner[1:] == owner[:-1]
            pairs, place = np.unique(((flat[:-1] << 32) | flat[1:])[same], return_inverse=True)
            fits = np.array([self.does_stand(int(p)) for p in pairs], bool)
            if pairs.size:
                bad[owner[1:][same][~fits[place]]] = True
        for i in np.flatnonzero(bad):
            proposed[i] = self.exact(words[i])
        self.speculated += len(words)
        self.merged += int(bad.sum())
        for w, p in zip(fresh, proposed, strict=True):
            self.known[w] = np.array(p, "<u4").tobytes()

    def is_whole(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        if (ok := self.whole.get(token)) is None:
            ok = self.whole[token] = self.exact(self.bytes_of[token]) == [token]
        return ok

    def does_stand(self, pair: int) -> bool:
        if (ok := self.stands.get(pair)) is None:
            a, b = pair >> 32, pair & 0xFFFFFFFF
            ok = self.stands[pair] = self.exact(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return ok

    def ready(self, words: set[str]) -> None:
        """After this every one of these words is in the table."""
        if fresh := [w for w in words if w not in self.known]:
            if len(self.known) + len(fresh) > self.most_words:
                self.known.clear()
                fresh = list(words)
            self.learn(fresh)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers.

        The pattern never joins what stands before a space with what follows it
        when a letter or sign comes after the space, nor anything across a line
        end that has a letter or sign on both sides. So texts whose spaces and
        line ends all stand alone are cut there, and the pieces looked up; other
        texts go through the pattern whole.
        """
        plain, other, units = {}, {}, set()
        for k, text in enumerate(texts):
            if tangled(text) or (self.split_added and any(t in text for t in self.added)):
                parts = self.split_added.split(text) if self.split_added else [text]
                other[k] = [self.added[p] if j % 2 else self.words_of(p) for j, p in enumerate(parts)]
            elif text:
                plain[k] = [line.split(" ") for line in text.split("\n")]
                for line in plain[k]:
                    units.update(line[1:])
        if len(self.spaced) > self.most_words:
            self.spaced.clear()
        fresh = [(u, self.words_of(" " + u)) for u in units if u not in self.spaced]
        heads = {line[0]: self.words_of(line[0]) for lines in plain.values() for line in lines}
        words = {w for _, ws in fresh for w in ws}
        words.update(w for ws in heads.values() for w in ws)
        words.update(w for parts in other.values() for p in parts if not isinstance(p, int) for w in p)
        words.add("\n")
        self.ready(words)
        word, spaced = self.known.__getitem__, self.spaced
        for u, ws in fresh:
            spaced[u] = b"".join(map(word, ws))
        end, unit, out = word("\n"), spaced.__getitem__, []
        for k in range(len(texts)):
            if k in plain:
                out.append(end.join([b"".join([*map(word, heads[line[0]]), *map(unit, line[1:])]) for line in plain[k]]))
            else:
                out.append(b"".join(p.to_bytes(4, "little") if isinstance(p, int) else b"".join(map(word, p)) for p in other.get(k, [])))
        return out

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in memoryview(ids).cast("I").tolist()]).decode("utf-8", "replace")


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def bpe_round_trip(docs: DataFrame, vocabulary: str, digests: bool = False) -> DataFrame:
    """Encodes and decodes every text: doc_id, n_tokens, ids (packed) and decoded.

    ``vocabulary`` is the path of a tokenizer file on the driver; its text goes to
    the workers with the code. With ``digests`` the two long columns are replaced
    by SHA-256 digests in the same pass, so that they are never moved.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = BytePair(spec.value)
        sha = lambda x: hashlib.sha256(x).hexdigest()

        def rows():
            for batch in batches:
                for part in slices(batch, 1):
                    encoded = coder.encode([t or "" for t in part.column(1).to_pylist()])
                    decoded = [coder.decode(x) for x in encoded]
                    out = {"doc_id": part.column(0), "n_tokens": [len(x) // 4 for x in encoded]}
                    if digests:
                        yield out | {"ids_sha256": [sha(x) for x in encoded], "decoded_sha256": [sha(x.encode()) for x in decoded]}
                    else:
                        yield out | {"ids": encoded, "decoded": decoded}

        gc.disable()  # the tables are large and hold no cycles
        try:
            for columns in rows():
                yield from emit([columns], DIGESTS if digests else SCHEMA)
        finally:
            gc.enable()

    kinds = "ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string"
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, f"doc_id long, n_tokens long, {kinds}")
