"""Operator 1: secret scan with a random forest against false positives.

Candidates are private key blocks, signed web tokens of three parts, passwords in addresses
(``://user:password@``), values of six or more signs that are assigned to a name such as password, secret, token or key, and
all other runs of 16 or more letters, digits and the signs ``+ / = _ -`` that
hold a digit or both cases. A forest of decision trees, trained on labelled
findings, scores each one by its length, its character transitions, how much of it a
dictionary covers, the path of its document and the words around it.

``labelled_findings`` makes a training set by rule (keys and tokens in assignments;
checksums, ids, paths, long words as false findings), for tables that come without
labelled findings; pass your own rows where you have them.

Null and empty texts have no candidates. Ties in votes count as no secret.
Repeated rows are scanned each; rows with a null id are kept. An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.tables import emit, opened, share, slices, string_bytes

LEAST = 16
IN_TOKEN = np.isin(np.arange(256), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", np.uint8))
#: The name before an assigned value; what stands before one is looked for in so many characters.
NAME = r"(?:passw(?:or)?d|passphrase|pwd|secret|token|api[_\- ]?key|access[_\- ]?key|auth|credentials?|signature|key)"
ASSIGNED = rf"(?i:{NAME}[\"'`]?\s{{0,3}}(?::=|=>|[:=])\s{{0,3}})"
ADDRESS = r"://[^\s/:@\"']{1,64}:[^\s/@\"']{3,128}@"
CANDIDATE = re.compile(
    r"(?P<block>-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s:,\-]{0,20000}?-----END [A-Z ]{0,30}PRIVATE KEY-----)"
    r"|(?P<signed>\beyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,})"
    r"|://[^\s/:@\"']{1,64}:(?P<address>[^\s/@\"']{3,128})(?=@)"
    rf"|{ASSIGNED}(?:\"(?P<double>[^\"\s]{{6,200}})\"|'(?P<single>[^'\s]{{6,200}})'|`(?P<back>[^`\s]{{6,200}})`|(?P<bare>[^\s\"'`,;<>(){{}}\[\]]{{6,200}}))"
    r"|(?P<run>[A-Za-z0-9+/=_\-]{16,})"
)
#: Texts without a long run can hold a candidate only where this is found.
LIKELY = rf"{ASSIGNED}|{ADDRESS}|-----BEGIN "
#: Words of the dictionary, words that speak for and against a secret, parts of paths.
DICTIONARY = """the and for that with this from have are was not you all can her his one our out day get has him how man new now old see two way who
test example sample data file name value type list item user admin config default local remote server client index table field column count
version build release master branch commit image asset static public private module package library function class object string number
http https www com org net html json yaml text path home temp cache token secret password auth access api key error warning info debug
tion ing ent ion ate ness ment able er est""".split()
FOR = "password passwd pwd secret token api_key apikey api-key key auth authorization bearer credential credentials private access client_secret signature".split()
AGAINST = "sha sha1 sha256 md5 checksum hash digest commit revision uuid guid id etag version example integrity build fixture placeholder url path image".split()
PATHS = "test tests spec example examples doc docs fixture mock lock vendor node_modules dist sample".split()
FEATURES = 21


def kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def describe(candidate: str, before: str, after: str, path: str) -> list[float]:
    """The features of one finding; of a very long one, of its first 400 characters but for its length."""
    long, candidate = len(candidate), candidate[:400]
    n = len(candidate)
    kinds = [kind(c) for c in candidate]
    counts = Counter(candidate)
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    low = candidate.lower()
    covered = [False] * n
    for w in DICTIONARY:
        if len(w) >= 3:
            at = low.find(w)
            while at >= 0:
                covered[at : at + len(w)] = [True] * len(w)
                at = low.find(w, at + 1)
    moves = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(n - 1, 1)
    letters = sum(k < 2 for k in kinds)
    vowels = sum(c in "aeiou" for c in low) / max(letters, 1)
    words = re.findall(r"[a-z0-9_\-]+", before.lower())[-4:]
    near = re.search(r"[:=]\s*[\"'`]?$", before) is not None
    quoted = before[-1:] in "\"'`" and after[:1] in "\"'`" and before[-1:] != ""
    longest = max((len(w) for w in re.findall(r"[a-z]+", low)), default=0)
    parts = re.split(r"[^a-z_]+", path.lower())
    forms = [float(candidate.startswith("-----BEGIN")), float(candidate.startswith("eyJ") and candidate.count(".") == 2), float(re.search(r"://[^\s/:@]+:$", before) is not None)]
    return [
        *forms, min(long, 200), entropy, moves, sum(covered) / n, kinds.count(2) / n, kinds.count(1) / n, kinds.count(3) / n,
        float(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", candidate) is not None), float(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", candidate) is not None),
        vowels, longest / n, float(near), float(quoted), float(any(w in FOR or any(w.endswith(f) for f in FOR if len(f) > 4) for w in words)),
        float(any(w in AGAINST for w in words)), float(any(p in PATHS for p in parts)), float(len(counts) / n), float(candidate.count("/") / n),
    ]


def labelled_findings(n: int = 3000, seed: int = 7) -> list[tuple[str, str, str, str, int]]:
    """(candidate, before, after, path, label) by rule; the same for the same seed."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "es", "in", "le", "ou", "que", "sch", "tion", "ar", "el"]) for _ in range(r.randint(1, 4)))
    hexed = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))
    out = []
    sign = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789!@#$%^&*._+") for _ in range(k))
    web = lambda: ".".join("eyJ" * (i == 0) + mixed(r.randint(20, 60)) for i in range(3))
    block = lambda: (lambda k: f"-----BEGIN {k}PRIVATE KEY-----\n" + "\n".join(mixed(64) for _ in range(r.randint(2, 12))) + f"\n-----END {k}PRIVATE KEY-----")(r.choice(["", "RSA ", "EC ", "OPENSSH "]))
    for _ in range(n):
        path, prose = r.choice(["src/app.py", "config/prod.yaml", "src0", "deploy/env.sh", "notes.md"]), " ".join(word() for _ in range(r.randint(0, 4)))
        if r.random() < 0.5:
            secret = r.choice([lambda: hexed(r.choice([32, 40, 64])), lambda: mixed(r.randint(20, 48)), lambda: base64.b64encode(r.randbytes(r.choice([24, 32, 48]))).decode(), lambda: "AKIA" + mixed(16).upper(), lambda: r.choice(["ghp_", "sk_live_", "xoxb-"]) + mixed(36), lambda: sign(r.randint(8, 15)), lambda: word() + str(r.randint(0, 9999)) + r.choice("!?#$") + sign(2), lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(24, 40)))])()
            if r.random() < 0.1:
                secret = secret.upper()
            q, name = r.choice(['"', "'", ""]), r.choice(FOR)
            named = r.choice([f"{name} = {q}", f"{name}={q}", f"{name}: {q}", f"{name.upper()} = {q}", f"my_{name} = {q}"]) if r.random() < 0.9 or len(secret) < 16 else r.choice(["", "Bearer "])
            form = r.random()
            if form < 0.1:
                out.append((sign(r.randint(6, 20)).replace("@", "x"), f"{prose} {r.choice(['postgres', 'mysql', 'https', 'amqp', 'redis'])}://{word()}:", f"@{word()}.com", path, 1))
            elif form < 0.15:
                out.append((web(), f"{prose} {r.choice(['Bearer ', 'token = ', ''])}", f" {word()}", path, 1))
            elif form < 0.2:
                out.append((block(), f"{prose} ", f" {word()}", path, 1))
            else:
                out.append((secret, f"{prose} {named}", f"{q} {word()}", path, 1))
        else:
            q = r.choice(['"', "'", ""])
            make, name = r.choice([
                (lambda: hexed(r.choice([32, 40, 64])), r.choice(["sha256: ", "commit ", "md5 = ", "checksum: ", "etag: "])),
                (lambda: f"{hexed(8)}-{hexed(4)}-{hexed(4)}-{hexed(4)}-{hexed(12)}", r.choice(["id = ", "uuid: ", "", "request "])),
                (lambda: "/".join(word() for _ in range(5)) + str(r.randint(0, 99)), r.choice(["path: ", "", "see "])),
                (lambda: (word() + word() + word() + word()).title() + word() * 2, ""),
                (lambda: "_".join(word() for _ in range(5)) + str(r.randint(0, 9)), r.choice(["", "name = "])),
                (lambda: r.choice(["example_key_0123456789", "your-api-key-here-0000", "xxxxxxxxxxxxxxxxxxx1", "test_token_123456789"]), r.choice(["token = ", "api_key: "])),
                (lambda: str(r.randint(10**15, 10**20)), r.choice(["", "number ", "id "])),
                # what is assigned to such a name in code and prose without being a secret
                (lambda: r.choice(["required", "optional", "string", "changeme", "null", "undefined", "getenv", "os.environ", "config.password", "self.token", "********", "xxxxxxxx", "<password>", "your_password", "None", "process.env.TOKEN", "request.headers", "str", "generated", "hidden"]).ljust(6, "."), f"{r.choice(FOR)}{r.choice([' = ', ': ', '='])}{q}"),
                (lambda: word() * 2 + word(), f"{r.choice(['key', 'token', 'secret', 'password', 'the key', 'auth'])}{r.choice([': ', ' = '])}{q}"),
                (lambda: r.choice(["8080", "port", "user", "password", "pass", "xxxxx"]).ljust(3, "0"), f"{r.choice(['postgres', 'https'])}://{word()}:"),
            ])
            found = make()
            filled = found if re.search(r"[:=]\s?[\"']?$", name) else found + "0" * (LEAST - len(found))
            out.append((filled, f"{prose} {name}", f"{q if name.endswith(q) and q else ''} {word()}", r.choice([path, "tests/fixtures/a.json", "package-lock.json"]), 0))
    return out


class Forest:
    """Decision trees on bootstrap samples with a random third of the features at each split."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 10, least: int = 3, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees if len(y) else 0):
            rows = rng.integers(0, len(y), len(y))
            nodes: list[list[float]] = []
            self.grow(x[rows], y[rows], depth, least, rng, nodes)
            self.trees.append(np.array(nodes))

    def grow(self, x, y, depth, least, rng, nodes) -> int:
        """Appends the node (feature, threshold, left, right, share) and those below it."""
        me = len(nodes)
        nodes.append([-1, 0, 0, 0, y.mean()])
        if depth == 0 or len(y) < 2 * least or y.min() == y.max():
            return me
        best = None
        for f in rng.choice(x.shape[1], max(1, x.shape[1] // 3), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y))
            left, right = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(y) - n)
            impurity = n * left * (1 - left) + (len(y) - n) * right * (1 - right)
            impurity[(v[1:] == v[:-1]) | (n < least) | (len(y) - n < least)] = np.inf
            at = int(impurity.argmin())
            if np.isfinite(impurity[at]) and (best is None or impurity[at] < best[0]):
                best = (impurity[at], f, (v[at] + v[at + 1]) / 2)
        if best is None:
            return me
        _, f, t = best
        go = x[:, f] <= t
        nodes[me][:4] = [f, t, self.grow(x[go], y[go], depth - 1, least, rng, nodes), self.grow(x[~go], y[~go], depth - 1, least, rng, nodes)]
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.trees or not len(x):
            return np.zeros(len(x))
        total = np.zeros(len(x))
        for tree in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := tree[at, 0] >= 0).any():
                node = tree[at[inner]]
                go = x[np.flatnonzero(inner), node[:, 0].astype(np.int64)] <= node[:, 1]
                at[inner] = np.where(go, node[:, 2], node[:, 3]).astype(np.int64)
            total += tree[at, 4]
        return total / len(self.trees)


def train(findings: list[tuple[str, str, str, str, int]], most: int = 20_000) -> Forest:
    """A forest from labelled findings (candidate, before, after, path, label), of more than ``most`` a sample by hash."""
    rows = sorted(findings, key=lambda r: hashlib.sha256(repr(r).encode()).digest())[:most] if len(findings) > most else findings
    return Forest(np.array([describe(*r[:4]) for r in rows]).reshape(-1, FEATURES), np.array([r[4] for r in rows], float))


OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_chars", pa.int64()), ("sha256", pa.string()), ("score", pa.float64()), ("is_secret", pa.bool_())])


def with_candidates(array: pa.Array) -> np.ndarray:
    """Texts with a run of token bytes long enough that holds a digit or two cases, or with the beginning of another form."""
    data, bounds = string_bytes(array)
    inside = np.zeros(data.size + 2, bool)
    inside[1:-1] = IN_TOKEN[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edge[::2], edge[1::2]
    long = last - first >= LEAST
    first, last = first[long], last[long]
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data < 58))])
    large = np.concatenate([[0], np.cumsum((data >= 65) & (data < 91))])
    small = np.concatenate([[0], np.cumsum((data >= 97) & (data < 123))])
    of = lambda c, a, b: c[b] - c[a]
    good = (of(digits, first, last) > 0) | ((of(large, first + 1, last) > 0) & (of(small, first, last) > 0))
    out = pa.compute.match_substring_regex(array, LIKELY).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
    for a, b in zip(first[good], last[good], strict=True):  # a run may cross the end of a text
        i, j = np.searchsorted(bounds, [a, b - 1], side="right") - 1
        out[i : j + 1] = True
    return out


def candidates(text: str) -> Iterator[tuple[int, str]]:
    """(place, finding) of every candidate."""
    at = 0
    while m := CANDIDATE.search(text, at):
        form = m.lastgroup
        w, at = m.group(form), m.end(form)
        if form != "run" or any(c.isdigit() for c in w) or (any(c.isupper() for c in w[1:]) and any(c.islower() for c in w)):
            yield m.start(form), w


def scan(docs: DataFrame, forest: Forest | None = None, path: str = "source", threshold: float = 0.5) -> DataFrame:
    """doc_id, start, n_chars, sha256 (of the finding, which itself is not repeated), score and is_secret."""
    sent = share(docs.sparkSession, forest or train(labelled_findings()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = opened(sent)
        for batch in batches:
            for part in slices(batch, 1):
                rows: dict[str, list] = {f.name: [] for f in OUT}
                x = []
                for i in np.flatnonzero(with_candidates(part.column(1))):
                    text, doc, where = part.column(1)[int(i)].as_py() or "", part.column(0)[int(i)].as_py(), part.column(2)[int(i)].as_py() or ""
                    for start, found in candidates(text):
                        end = start + len(found)
                        x.append(describe(found, text[max(0, start - 60) : start], text[end : end + 20], where))
                        for k, v in (("doc_id", doc), ("start", start), ("n_chars", len(found)), ("sha256", hashlib.sha256(found.encode()).hexdigest())):
                            rows[k].append(v)
                found = own.predict(np.array(x).reshape(-1, FEATURES))
                rows["score"], rows["is_secret"] = found.tolist(), (found > threshold).tolist()
                yield from emit([rows], OUT)

    where = F.col(path).cast("string") if path in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), where.alias("path"))
    return rows.mapInArrow(run, "doc_id long, start long, n_chars long, sha256 string, score double, is_secret boolean")
