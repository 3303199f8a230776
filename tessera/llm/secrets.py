"""Secret scans: base patterns, and a linear-chain conditional random field over tokens.

Tokens are tagged secret-begin, inside or outside from their shape, the neighbouring tokens and features of the whole
file, and the best tags are found by Viterbi. The field is trained here, by gradient ascent on the log likelihood of
generated lines in which secrets of many kinds stand among prose, code, numbers, addresses and hashes that are none.

A token's features are those of its class, a coarse description of which there are few, so that scores are sums of
table rows. Where outside leads by more than any transition could make up for, it is part of every best path; Viterbi
then runs over the stretches in between, which gives the same tags as over the whole text. Texts are scanned whole, in
their partition, and nothing is shuffled.

Defined results: a null or empty text has no spans; rows that repeat an id are each scanned; a null id stays null; an
empty frame gives an empty frame; extra columns are ignored. A span of the field that overlaps base spans is cut
to the parts that they don't cover.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: The base kinds, in order, each with its pattern and what a match must have to count.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: m.end(2) - m.start(2) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: m.end() - m.start() >= 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), lambda m: True),  # a match of [0-9a-f]+ is a whole run, so a run of 24 and more is one that counts
)
KINDS = tuple(k for k, _, _ in BASE)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed; code points."""
    found = [(m.start(), m.end(), KINDS.index(kind)) for kind, pattern, good in BASE for m in pattern.finditer(text) if good(m)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


# tokens and their classes

TOKEN = re.compile(r"[\w+/.\-]+|[^\w\s+/.\-]+")
#: Words that often name a secret, or what a line is about.
NAMES = {
    **dict.fromkeys(("password", "passwd", "pwd", "pass", "passphrase", "secret", "token", "apikey", "api_key", "credential", "credentials", "private_key", "auth", "authorization", "bearer", "client_secret", "access_key", "access_token", "auth_token", "secret_key", "db_password", "signing_key"), "secret-name"),
    **dict.fromkeys(("commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "hash", "uuid", "guid", "etag", "revision", "id", "request_id", "version", "build", "file", "path", "url", "host", "color", "isbn", "phone", "tel", "card", "date"), "other-name"),
    **dict.fromkeys(("export", "set", "env", "const", "let", "var", "def", "return", "import", "header"), "code"),
}
PREFIXES = ("AKIA", "ghp_", "gho_", "sk_live_", "sk-", "xoxb-", "xoxp-", "eyJ", "AIza", "glpat-", "npm_")


def _entropy(t: str) -> float:
    n = len(t)
    return -sum(c / n * math.log2(c / n) for c in (t.count(x) for x in set(t)))


def token_class(t: str) -> tuple:
    """A coarse description: kind, length, and what it is made of."""
    u = t.rstrip(".-/")
    if u.isalpha() and len(u) < 24 and (u.islower() or u.isupper() or u[1:].islower() or u[2:].islower()):
        return ("word", NAMES.get(u.lower(), ""), min(len(u) // 6, 3))
    if not any(c.isalnum() for c in t):
        return ("mark", t if t in ("=", ":", '="', "='", '":', '"', "'", ":=", "://", "@", "(", ")", "{", "}", ",", "|", ";") else "other", 0)
    name = NAMES.get(t.strip("._-/+").lower(), "")
    if not name and (m := re.search(r"[._-](password|passwd|pwd|secret|token|key|credential)s?$", t, re.I | re.A)):
        name = "secret-name" if len(t) < 32 else ""
    digits, upper, lower = (sum(map(f, t)) for f in (str.isdigit, str.isupper, str.islower))
    kinds = (digits > 0) + (upper > 0) + (lower > 0)
    if digits + sum(t.count(c) for c in "+-./") == len(t):
        return ("number", name, min(len(t) // 5, 6))
    hexa = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", t) is not None
    uuid = re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", t) is not None
    start = next((p for p in PREFIXES if t.startswith(p)), "")
    joined = sum(t.count(c) for c in "./")
    return ("mixed", name, min(len(t) // 6, 7), kinds, min(int(4 * digits / len(t)), 3), int(hexa), int(uuid), start, min(joined, 3), min(int(_entropy(t)), 5), int(digits + upper + lower < len(t) - 3))


def class_features(c: tuple) -> list[str]:
    """The features of a token of this class, for the token itself."""
    out = [f"{c[0]}", *(f"{c[0]}.{k}={v}" for k, v in enumerate(c[1:]))]
    if c[0] == "mixed":
        out += [f"len+kinds={c[2]},{c[3]}", f"len+entropy={c[2]},{c[9]}", f"hex+len={c[5]},{c[2]}", f"joined+kinds={c[8]},{c[3]}"]
    return out


def near_features(c: tuple) -> list[str]:
    """What neighbours see of a token: its kind and name, or the mark itself."""
    return [f"{c[0]}:{c[1]}" if c[0] != "mixed" else f"mixed:{c[1]}:{c[2] > 2}"]


EDGE = ("edge", "", 0)
FILE_KINDS = 6


def file_kind(text: str, n: int) -> int:
    """A class of the whole file: how much it looks like settings or code, and its length."""
    signs = text.count("=") + text.count('":') + text.count("{")
    return (0 if signs == 0 else 1 if signs * 50 < n else 2) + 3 * (n > 200)


# training data

_SYLLABLES = "an the er on in st re ed ou ing tion ent or is at es th ha en it ar le de un que los para con der die und".split()


def _prose(r: random.Random) -> str:
    w = "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))
    if r.random() < 0.03:
        return f"{w.capitalize()}. " * r.randint(2, 5) + ("SS" + w)
    return (w.capitalize() if r.random() < 0.15 else w.upper() if r.random() < 0.05 else w) + r.choice(["", "", "", "", ",", ".", "!!", "***"])


def _some(r: random.Random, letters: str, low: int, high: int) -> str:
    return "".join(r.choice(letters) for _ in range(r.randint(low, high)))


_ALNUM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_HEX = "0123456789abcdef"


def _value(r: random.Random) -> str:
    kind = r.randrange(9)
    if kind == 0:
        return _some(r, _HEX, 24, 64)
    if kind == 1:
        return "AKIA" + _some(r, _ALNUM[26:], 16, 16).upper()
    if kind == 2:
        return r.choice(["ghp_", "gho_", "sk_live_", "glpat-", "npm_", "xoxb-", "AIza", "sk-"]) + _some(r, _ALNUM, 20, 40)
    if kind == 3:
        return "eyJ" + ".".join(_some(r, _ALNUM + "_-", 15, 50) for _ in range(3))
    if kind == 4:
        return _some(r, _ALNUM + "+/", 32, 64)
    if kind == 5:  # a passphrase with marks: several tokens
        return _some(r, _ALNUM, 4, 8) + r.choice("!@#$%&") + _some(r, _ALNUM, 3, 8)
    if kind == 6:
        return "".join(r.choice(_SYLLABLES) for _ in range(2)).capitalize() + str(r.randint(10, 9999))
    return _some(r, _ALNUM, 12, 40)


def _line(r: random.Random) -> list[tuple[str, bool]]:
    """Pieces of text, and whether each is a secret."""
    pieces: list[tuple[str, bool]] = []
    say = lambda n: pieces.append((" ".join(_prose(r) for _ in range(r.randint(0, n))) + " ", False))
    say(10)
    kind = r.random()
    if kind < 0.4:
        name = r.choice(["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "credential", "private_key", "client_secret", "access_key", "auth_token", "secret_key", "db_password", "DB_PASSWORD", "API_TOKEN", "signing_key"])
        v = _value(r)
        before, after = r.choice([(" = \"", '"'), ("=", ""), (": ", ""), (" = ", ""), ("='", "'"), ('": "', '",'), (" is ", "")])
        pieces += [(r.choice(["", "", "export ", '"']) + name + before, False), (v, True), (after + " ", False)]
    elif kind < 0.47:
        pieces += [("Authorization: Bearer ", False), (_value(r) if r.random() < 0.5 else "eyJ" + ".".join(_some(r, _ALNUM, 20, 40) for _ in range(3)), True), (" ", False)]
    elif kind < 0.52:
        pieces += [(f"{r.choice(['https', 'postgres', 'amqp'])}://{_some(r, _ALNUM[:26], 4, 8)}:", False), (_some(r, _ALNUM, 8, 16), True), ("@host.example.com/db ", False)]
    elif kind < 0.57:
        pieces += [(r.choice(["ghp_", "sk_live_", "AKIA", "xoxb-", "glpat-"]) + (_some(r, _ALNUM, 24, 36) if r.random() < 0.7 else _some(r, _ALNUM[26:], 16, 20).upper()), True), (" ", False)]
    else:
        pieces.append((r.choice([
            lambda: f"commit {_some(r, _HEX, 40, 40)} ", lambda: f"sha256: {_some(r, _HEX, 64, 64)} ", lambda: f"md5 {_some(r, _HEX, 32, 32)} ", lambda: f"id = {_some(r, _HEX, 8, 8)}-{_some(r, _HEX, 4, 4)}-4{_some(r, _HEX, 3, 3)}-{_some(r, _HEX, 4, 4)}-{_some(r, _HEX, 12, 12)} ",
            lambda: f"{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)} ", lambda: f"{_some(r, '0123456789', 13, 16)} ", lambda: f"+{r.randint(1, 99)} ({r.randint(100, 999)}) {r.randint(100, 999)}-{r.randint(1000, 9999)} ",
            lambda: f"{_prose(r)}.{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com ", lambda: f"https://www.example.com/{_prose(r)}/{r.randint(1, 9999)}?page={r.randint(1, 99)} ", lambda: f"src/{_prose(r)}/{_prose(r)}{r.randint(1, 9)}.py ", lambda: f"{_prose(r).title()}{_prose(r).title()} = {r.randint(1, 99999)} ",
            lambda: f"name = \"{_prose(r)}\" ", lambda: f"color: #{_some(r, _HEX, 6, 6)} ", lambda: f"version {r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 99)} ", lambda: f"the {r.choice(['password', 'token', 'secret'])} {_prose(r)} {_prose(r)} ", lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02} ",
            lambda: f"file_{_some(r, _ALNUM[:26], 5, 9)}_{r.randint(1, 99)}.parquet ", lambda: " | ".join(_prose(r) for _ in range(6)) + " ", lambda: " ".join(_prose(r) for _ in range(12)) + " ", lambda: "".join(r.choice(_SYLLABLES) for _ in range(r.randint(8, 14))) + " ",
        ])(), False))
    say(10)
    return pieces


def training_lines(n: int = 1600, seed: int = 5) -> list[tuple[str, list[tuple[int, int]]]]:
    r, out = random.Random(seed), []
    for _ in range(n):
        text, spans = "", []
        for piece, secret in _line(r):
            if secret:
                spans.append((len(text), len(text) + len(piece)))
            text += piece
        out.append((text, spans))
    return out


class Field:
    """A trained field: score tables by class, transitions, and what is needed to decode."""

    def __init__(self, weights: dict[str, np.ndarray], transitions: np.ndarray):
        self.weights, self.t = weights, transitions
        # the most that tagging y between a and b can gain over outside by transitions
        t = transitions
        self.gain = max(t[a, y] + t[y, b] - t[a, 0] - t[0, b] for a in range(3) for b in range(3) for y in (1, 2))
        self.file = np.array([self._sum([f"file={k}"]) for k in range(FILE_KINDS)])
        self.reset()

    def __getstate__(self):
        return self.weights, self.t

    def __setstate__(self, state):
        self.__init__(*state)

    def _sum(self, names: list[str]) -> np.ndarray:
        zero = np.zeros(3)
        return sum((self.weights.get(x, zero) for x in names), zero)

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.classes: dict[tuple, int] = {}
        self.rows: list[np.ndarray] = []
        self.table = np.zeros((0, 4, 3))
        self.add(EDGE)

    def add(self, c: tuple) -> int:
        k = self.classes.get(c)
        if k is None:
            k = self.classes[c] = len(self.rows)
            near = near_features(c)
            self.rows.append(np.stack([self._sum(class_features(c)), *(self._sum([f"{w}{x}" for x in near]) for w in ("-1:", "+1:", "-2:"))]))
        return k

    def ids(self, tokens: list[str]) -> list[int]:
        known = self.known
        if len(known) > 200_000:
            known.clear()
        out = []
        for t in tokens:
            k = known.get(t)
            if k is None:
                k = known[t] = self.add(token_class(t))
            out.append(k)
        return out

    def emissions(self, ids: list[int], kind: int) -> np.ndarray:
        if len(self.table) != len(self.rows):
            self.table = np.stack(self.rows)
        table = self.table
        k = np.array([0, 0, *ids, 0])
        return table[k[2:-1], 0] + table[k[1:-2], 1] + table[k[3:], 2] + table[k[:-3], 3] + self.file[kind]

    def decode(self, e: np.ndarray) -> np.ndarray:
        """The best tags of a text, by Viterbi over the stretches that outside doesn't win for certain."""
        tags = np.zeros(len(e), np.int8)
        open_ = np.flatnonzero(e[:, 0] - e[:, 1:].max(axis=1) <= self.gain)
        if not len(open_):
            return tags
        for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
            tags[run[0] : run[-1] + 1] = self.viterbi(e[run[0] : run[-1] + 1])
        return tags

    def viterbi(self, e: np.ndarray) -> list[int]:
        """The best tags between two outside ones."""
        score, back = self.t[0] + e[0], []
        for x in e[1:]:
            s = score[:, None] + self.t
            back.append(s.argmax(axis=0))
            score = s.max(axis=0) + x
        out = [int((score + self.t[:, 0]).argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]

    def spans(self, text: str) -> list[tuple[int, int]]:
        tokens = TOKEN.findall(text)
        if not tokens:
            return []
        tags = self.decode(self.emissions(self.ids(tokens), file_kind(text, len(tokens))))
        if not tags.any():
            return []
        out: list[list[int]] = []
        for m, tag, before in zip(TOKEN.finditer(text), tags, [0, *tags[:-1]]):
            if tag == 1 or tag == 2 and before == 0:
                out.append([m.start(), m.end()])
            elif tag == 2:
                out[-1][1] = m.end()
        return [(a, b - (len(text[a:b]) - len(text[a:b].rstrip(".,;")))) for a, b in out if len(text[a:b].rstrip(".,;")) >= 6]


@lru_cache(1)
def train(rounds: int = 100, l2: float = 0.02) -> Field:
    """Fit the field to training_lines() by Adam on the log likelihood; always the same result."""
    lines = training_lines()
    names: dict[str, int] = {}
    seqs = []
    for text, spans in lines:
        tokens = list(TOKEN.finditer(text))
        classes = [EDGE, EDGE, *(token_class(m[0]) for m in tokens), EDGE]
        kind = f"file={file_kind(text, len(tokens))}"
        feats, tags, last = [], [], None
        for i, m in enumerate(tokens, 2):
            own = class_features(classes[i]) + [f"-1:{x}" for x in near_features(classes[i - 1])] + [f"+1:{x}" for x in near_features(classes[i + 1])] + [f"-2:{x}" for x in near_features(classes[i - 2])] + [kind]
            feats.append([names.setdefault(x, len(names)) for x in own])
            hit = next((s for s in spans if m.start() < s[1] and m.end() > s[0]), None)
            tags.append(0 if hit is None else 2 if hit == last else 1)
            last = hit
        if tokens:
            seqs.append((feats, tags))
    n, length, most = len(seqs), max(len(f) for f, _ in seqs), max(len(x) for f, _ in seqs for x in f)
    x = np.full((n, length, most), len(names))  # the last row of the weights is 0
    y, real = np.zeros((n, length), int), np.zeros((n, length), bool)
    for i, (f, t) in enumerate(seqs):
        for j, own in enumerate(f):
            x[i, j, : len(own)] = own
        y[i, : len(t)], real[i, : len(t)] = t, True
    w, t = np.zeros((len(names) + 1, 3)), np.zeros((3, 3))
    mw, vw, mt, vt = np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)
    flat = x[real].ravel()
    gold = np.eye(3)[y] * real[..., None]
    # a text stands between outside tags, as decoding has it
    for step in range(1, rounds + 1):
        e = w[x].sum(axis=2)
        a, logs = np.zeros((length, n, 3)), lambda s, axis: (m := s.max(axis=axis)) + np.log(np.exp(s - np.expand_dims(m, axis)).sum(axis=axis))
        a[0] = t[0] + e[:, 0]
        for k in range(1, length):
            a[k] = np.where(real[:, k, None], logs(a[k - 1][:, :, None] + t, 1) + e[:, k], a[k - 1])
        z = logs(a[-1] + t[:, 0], 1)
        b = np.zeros((length, n, 3))
        b[-1] = t[:, 0]
        for k in range(length - 2, -1, -1):
            b[k] = np.where(real[:, k + 1, None], logs(t + (e[:, k + 1] + b[k + 1])[:, None, :], 2), b[k + 1])
        p = np.exp((a + b).transpose(1, 0, 2) - z[:, None, None]) * real[..., None]
        gt = np.zeros((3, 3))
        for k in range(1, length):
            both = np.exp(a[k - 1][:, :, None] + t + (e[:, k] + b[k])[:, None, :] - z[:, None, None]) * real[:, k, None, None]
            gt += np.einsum("ni,nj->ij", gold[:, k - 1], gold[:, k]) - both.sum(axis=0)
        ends = real.sum(axis=1) - 1
        gt[0] += (gold[:, 0] - p[:, 0]).sum(axis=0)
        gt[:, 0] += (gold[np.arange(n), ends] - p[np.arange(n), ends]).sum(axis=0)
        d = np.repeat((gold - p)[real], most, axis=0)
        gw = np.stack([np.bincount(flat, d[:, s], len(names) + 1) for s in range(3)], axis=1) / n - l2 * w / n * 10
        gw[-1] = 0
        gt = gt / n - l2 * t / n * 10
        for value, g, m, v in ((w, gw, mw, vw), (t, gt, mt, vt)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value += 0.12 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field({k: w[i].copy() for k, i in names.items()}, t.copy())


def scan_text(text: str, field: Field) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans) of a text: what the field finds is cut to the parts that no base span covers."""
    base = base_spans(text)
    covered: list[list[int]] = []  # base spans that touch or overlap, as one
    for x, y, _ in base:
        if covered and x <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], y)
        else:
            covered.append([x, y])
    more, at = [], 0
    for a, b in field.spans(text):  # both lists rise and neither overlaps itself
        while at < len(covered) and covered[at][1] <= a:
            at += 1
        k = at
        while k < len(covered) and covered[k][0] < b:
            if text[a : covered[k][0]].strip():
                more.append((a, covered[k][0], "crf"))
            a = min(covered[k][1], b)
            k += 1
        if text[a:b].strip():
            more.append((a, b, "crf"))
    order = (*KINDS, "crf")
    return base, sorted(base + more, key=lambda s: (s[0], order.index(s[2])))


def _join(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_crf) of every row."""
    field = df.sparkSession.sparkContext.broadcast(train())

    def f(batches):
        own = field.value
        for b in batches:
            for start in range(0, b.num_rows, 256):
                out = []
                for t in b.column(1).slice(start, 256).to_pylist():
                    base, spans = scan_text(t or "", own)
                    n = Counter(k for _, _, k in spans)
                    out.append((*(n[kind] for kind in KINDS), hashlib.sha256(_join(base).encode()).hexdigest(), _join(spans), n["crf"]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, 256), *(pa.array([x[c] for x in out], pa.string() if c in (3, 4) else pa.int64()) for c in range(6))], [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"])

    rows = df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(f, f"`{id_col}` long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")
