"""Secret scans: base patterns, and a character convolutional network over every candidate and its context.

Method. Base findings come from three patterns and always stay. Every other candidate is scored by a network in numpy. Candidates are
what base findings leave of the maximal runs of `SIGN` characters, without stops at their edges: those of 12 characters
or more that hold a letter and a digit; after a word that gives a secret away, any of 6 or more (each such word counts, also one that
follows another); and what stands between user and host of an address. A bare run is no candidate if it reads like a name (three quarters of its
letters in words that can be spoken), is a UUID, data after `base64,`, or a short argument of a web address. The network sees the
candidate and `AROUND` characters on either side, as characters that know whether they belong to the candidate: one
convolution with ReLU, maxima over four parts of the candidate's places and over those on either side, and a logistic unit. A candidate longer than
`INSIDE` is seen through windows that move by half their width to its end, and has the greatest of their scores.

Training. The network is trained by the driver on labelled findings: `labelled(n, seed)` writes `n` of them (n bounds the
sample), half true: keys, tokens, passwords and pass phrases of many shapes, after words that give them away or bare, and half false:
identifiers, part numbers, mail and web addresses, numbers of all kinds, versions, paths, dates, and plain words after the same giving words.
Like the scan, it takes candidates that base findings leave. Half of them train, a quarter calibrates the scores (Platt's logistic
fit) and sets the threshold: the greatest that still finds a share of `recall` of the true ones; the last quarter measures
(`Model.report`), and a recall under 0.9 there is an error. Shapes written apart from this generator are in the tests. Labelled findings of one's own
may be added. All randomness is seeded: every run has the same weights. The weights (some 100 KB, whatever the input) go with the task.

Cases. Null texts count as empty ones; no findings give counts 0, the digest of the empty string and empty spans. Spans
are in code points of the whole text, end exclusive; texts are never cut, and a text's time is in proportion to its length. Repeated
rows are scanned one by one; an empty table gives no rows. Only id and text are read."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ship

# The base patterns in their order, which group is measured, and how long it is at least.
KINDS = ["assign", "access", "hex", "cnn"]
BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
]
#: The same as the hex pattern with its length: a run of 16 or more is the whole run.
LONG_HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORD = re.compile(r"(?:passw|secret|token|api_?key)", re.A | re.I)

SIGN = r"[A-Za-z0-9+/_=~!@#$%^&*.:-]"
RUN = re.compile(SIGN + "{12,}")
LONG, SHORT, IN_ADDRESS = 12, 6, 20
#: Words that give a secret away, and what may stand between them and it.
GIVING = ["pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential"]
NAMES = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private)[_ -]?key|auth(?:orization)?|bearer|credentials?)"
#: Only the giving word is used up, so that each of several in a row gives what follows it.
TOLD = re.compile(NAMES + r"""(?=(["']?(?:\s{0,8}[:=]{1,3}\s{0,8}|\s{1,8}(?:is|was)\s{1,8}|\s{1,8})["'(]?)""" + SIGN + "{6})", re.I)
NAME_ONLY = re.compile(NAMES + "s?[:=]*", re.I)
TOKEN = re.compile(SIGN + "{6,}")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Words of 3 to 15 letters with a vowel, alone or in mixed case.
SPOKEN = re.compile(r"(?<![a-z])[A-Z]?(?=[a-z]{0,14}[aeiouy])[a-z]{2,14}(?![a-z])|(?<![A-Za-z0-9])(?=[A-Z]*[AEIOUY])[A-Z]{3,}(?![A-Za-z0-9])")
#: A password between a user and a host.
LOGIN = re.compile(r"://[A-Za-z0-9._~%+-]{0,64}:([^\s/@\"'<>]{6,256})@")
AROUND, INSIDE = 24, 48
LENGTH = 2 * AROUND + INSIDE

# Characters fall into classes: digits, letters a-f and the others in either case, and single signs.
SIGNS = "+/_=-.:@#$%^&*~!\"'<>()[]{},;| \n"
CLASSES = {c: 1 + i for i, c in enumerate("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + SIGNS)}
OTHER = len(CLASSES) + 1
ALPHABET = OTHER + 1
LOOKUP = np.full(128, OTHER, np.int16)
for _c, _i in CLASSES.items():
    LOOKUP[ord(_c)] = _i


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the base findings, sorted."""
    found = []
    if KEYWORD.search(text):
        found += [(m.start(), 0, m.end()) for m in BASE[0][1].finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in BASE[1][1].finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(found)


HAS_DIGIT, HAS_LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")


def _left(s: int, e: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a span that no finding (disjoint ones, in order) covers."""
    parts, j = [], bisect_right(taken, s, key=lambda f: f[1])
    while j < len(taken) and taken[j][0] < e:
        parts.append((s, taken[j][0]))
        s = taken[j][1]
        j += 1
    return [(a, b) for a, b in [*parts, (s, e)] if b - a >= SHORT]


def _reads(part: str) -> bool:
    """Whether a bare run reads like a name: three quarters of its letters lie in words that can be spoken."""
    letters = sum(c.isalpha() for c in part)
    return 4 * sum(len(w) for w in SPOKEN.findall(part)) >= 3 * letters


def _trimmed(text: str, s: int, e: int) -> tuple[int, int]:
    part = text[s:e].rstrip(".:!&")
    return s + len(part) - len(part.lstrip("=:.!&")), s + len(part)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans of the candidates, in order: none overlaps a base finding, and what those leave of a run is looked at."""
    taken: list[tuple[int, int]] = []
    for s, _, e in base:
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    found: dict[int, int] = {}  # by end: a secret that was told begins within its run
    for m in RUN.finditer(text):
        # what follows `base64,` is data that is shown as such
        if HAS_DIGIT.search(text, *m.span()) and HAS_LETTER.search(text, *m.span()) and not text.startswith("base64,", m.start() - 7):
            for s, e in _left(*m.span(), taken) if taken else [m.span()]:
                s, e = _trimmed(text, s, e)
                if e - s < IN_ADDRESS and "://" in text[max(0, s - 256) : s].rpartition(" ")[2]:
                    continue  # a short argument of a web address that no word gives away
                if _reads(text[s:e]) or UUID.fullmatch(text, s, e):
                    continue  # names and numbers of things, but for what a giving word says below
                if e - s >= LONG and HAS_DIGIT.search(text, s, e) and HAS_LETTER.search(text, s, e):
                    found[e] = s
    low = text.lower()
    if any(word in low for word in GIVING):
        # of several giving words before an end, the nearest counts: a run is scanned once
        nearest: dict[int, int] = {}
        runs = [m.span() for m in TOKEN.finditer(text)]
        for m in TOLD.finditer(text):
            at = m.end(1)
            k = bisect_right(runs, at, key=lambda r: r[0]) - 1
            if k >= 0 and at < runs[k][1]:
                nearest[k] = max(at, nearest.get(k, at))
        for k, at in nearest.items():
            for s, e in _left(at, runs[k][1], taken):
                s, e = _trimmed(text, s, e)
                if e - s >= SHORT and not NAME_ONLY.fullmatch(text, s, min(e, s + 32)):
                    found[e] = max(s, found.get(e, s))
    if "://" in text:
        for m in LOGIN.finditer(text):
            inside = [(s, e) for s, e in _left(*m.span(1), taken)]
            if inside:
                # the address around it is no candidate of its own
                found = {e: s for e, s in found.items() if e <= m.start() or s >= m.end()} | {e: s for s, e in inside}
    return sorted((s, e) for e, s in found.items())


def windows(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of LENGTH character codes (context, part of a candidate, context; 0 is nothing), and the place of each one's span."""
    views = [(k, s, e, a) for k, (s, e) in enumerate(spans) for a in ([*range(s, e - INSIDE, INSIDE // 2), e - INSIDE] if e - s > INSIDE else [s])]
    out = np.zeros((len(views), LENGTH), np.int16)
    for row, (_, s, e, a) in zip(out, views, strict=True):
        z = min(a + INSIDE, e)
        before, after = text[max(0, a - AROUND) : a], text[z : z + AROUND]
        for at, part, start in ((AROUND - len(before), before, a - len(before)), (AROUND, text[a:z], a), (AROUND + INSIDE, after, z)):
            codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
            places = np.arange(start, start + len(codes))
            row[at : at + len(codes)] = np.where(codes < 128, LOOKUP[np.minimum(codes, 127)], OTHER) + np.where((places >= s) & (places < e), ALPHABET, 0)
    return out, np.array([k for k, *_ in views], np.int64)


class Network:
    """One convolution of `width` characters with `filters` outputs, maxima over `PARTS` parts of the inner places and over the places before and
    after them, a logistic unit. The parts tell a string that is odd throughout from a name with one odd place."""

    PARTS = 4

    def __init__(self, filters=24, width=5, seed=7):
        rng = np.random.default_rng(seed)
        self.width = width
        self.table = rng.normal(0, 0.15, (width, 2 * ALPHABET, filters)).astype(np.float32)
        self.bias = np.zeros(filters, np.float32)
        self.out = rng.normal(0, 0.2, (self.PARTS + 2) * filters).astype(np.float32)
        self.offset = np.float32(0)
        inner = np.arange(AROUND - width // 2, AROUND + INSIDE - width // 2)
        self.groups = [np.arange(inner[0]), *np.array_split(inner, self.PARTS), np.arange(inner[-1] + 1, LENGTH - width + 1)]
        self.scale, self.shift = 1.0, 0.0

    def _maxima(self, x):
        """The greatest value of each filter in each group of places, and where it is."""
        n = LENGTH - self.width + 1
        z = self.bias + sum(self.table[k][x[:, k : k + n]] for k in range(self.width))
        at = [g[z[:, g].argmax(1)] for g in self.groups]
        return np.concatenate([np.take_along_axis(z, a[:, None], 1)[:, 0] for a in at], 1), np.concatenate(at, 1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        parts = [np.maximum(self._maxima(x[i : i + 256])[0], 0) @ self.out + self.offset for i in range(0, len(x), 256)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        return 1 / (1 + np.exp(-(self.scale * self.logits(x).astype(np.float64) + self.shift)))

    def fit(self, x, y, epochs=6, rate=0.01, batch=64, seed=11) -> None:
        rng = np.random.default_rng(seed)
        names = ["table", "bias", "out", "offset"]
        first = {n: np.zeros_like(getattr(self, n)) for n in names}
        second = {n: np.zeros_like(getattr(self, n)) for n in names}
        groups, step = len(self.groups), 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                raw, place = self._maxima(x[rows])
                active = np.maximum(raw, 0)
                error = (1 / (1 + np.exp(-(active @ self.out + self.offset))) - y[rows]) / len(rows)
                back = (error[:, None] * self.out) * (raw > 0)
                grads = {"out": active.T @ error, "offset": error.sum(), "bias": back.sum(0).reshape(groups, -1).sum(0), "table": np.zeros_like(self.table)}
                column = np.tile(np.arange(len(self.bias)), groups)[None].repeat(len(rows), 0)
                for k in range(self.width):
                    np.add.at(grads["table"][k], (np.take_along_axis(x[rows], place + k, 1), column), back)
                step += 1
                for n in names:
                    first[n] = 0.9 * first[n] + 0.1 * grads[n]
                    second[n] = 0.999 * second[n] + 0.001 * np.square(grads[n])
                    move = rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, n, (getattr(self, n) - move).astype(np.float32))

    def calibrate(self, x, y, steps=300, rate=0.05) -> None:
        """Platt's fit of scale and shift on rows that did not train."""
        z = self.logits(x).astype(np.float64)
        a, b = 1.0, 0.0
        for _ in range(steps):
            error = 1 / (1 + np.exp(-(a * z + b))) - y
            a, b = a - rate * float(np.mean(error * z)), b - rate * float(np.mean(error))
        self.scale, self.shift = a, b


def labelled(n: int = 14000, seed: int = 3) -> list[tuple[str, int, int, int]]:
    """Labelled findings, from `n` written ones those that base patterns leave: (text, start, end, 1 for a secret)."""
    rng = np.random.default_rng(seed)
    pick = lambda s: s[int(rng.integers(len(s)))]
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda chars, a, b: "".join(pick(chars) for _ in range(int(rng.integers(a, b + 1))))
    syllables = ["an", "the", "er", "on", "re", "ti", "ou", "en", "st", "ble", "ing", "sch", "ein", "eau", "ment", "ció", "que", "ado", "ß", "é", "and", "of"]
    word = lambda a=1, b=4: "".join(pick(syllables) for _ in range(int(rng.integers(a, b + 1))))
    prose = lambda a, b: " ".join(word() for _ in range(int(rng.integers(a, b + 1))))
    plain = lambda a=1, b=4: re.sub(r"[^a-z]", "", word(a, b)) or "an"
    prefixes = ["ghp_", "gho_", "sk_live_", "sk-", "xoxb-", "xoxp-", "glpat-", "pk_", "key-", "npm_", "hf_", "AIza"]
    # shapes that can be known bare, and shapes that only their context gives away
    bare = [
        lambda: some(low + up + dig + "+/", 24, 64) + pick(["", "=", "=="]),
        lambda: pick(prefixes) + some(low + up + dig, 20, 40),
        lambda: pick(["xoxb-", "xoxp-"]) + some(dig, 10, 12) + "-" + some(dig, 10, 12) + "-" + some(low + up + dig, 20, 24),
        lambda: "eyJ" + some(low + up + dig, 14, 24) + "." + some(low + up + dig + "_-", 16, 60),
        lambda: some(low + up + dig + "_-", 24, 43),
    ]
    uuid = lambda: "-".join(some("0123456789abcdef", n, n) for n in (8, 4, 4, 4, 12))
    told = [
        *bare,
        *[uuid] * 3,
        lambda: plain(1, 2).capitalize() + pick("!@#$%&*_-") + some(dig, 2, 4) + pick(["", "!", plain(1, 1)]),
        lambda: plain(2, 3) + some(dig, 1, 4),
        lambda: some("ABCDEF" + dig, 24, 48),
        lambda: some(low + up + dig, 3, 8) + pick("!@#$%^&*") + some(low + up + dig, 3, 8),
        lambda: some(low + up + dig, 7, 14),
        lambda: "-".join(plain(1, 3) for _ in range(int(rng.integers(3, 6)))),
        lambda: some(low + up, 8, 20),
    ]
    name = lambda: pick(["the secret token", "ssh password", "X-Api-Key", "client secret", "auth token", "pwd", "passphrase", "auth", "access key", "access_key", "private key", "credential", "bearer", "Authorization: Bearer", "passcode", "password", "secret", "token", "api key"])
    given = lambda: name() + pick([" = ", ": ", "=", ":", " is ", " "]) + pick(["", "", chr(34), "'"])
    other = [
        lambda: f"{plain()}.{some(dig, 1, 3)}@mail{some(dig, 1, 1)}.example.com",
        lambda: f"https://{pick(['www', 'm', 'blog'])}.{plain(2, 4)}.example.org/{plain()}/{some(dig, 1, 5)}" + pick(["", f"?{plain()}={some(dig, 1, 6)}", "/" + "-".join(plain() for _ in range(6))]),
        lambda: f"{plain(1, 3)}_{plain(1, 3)}_{some(dig, 1, 3)}",
        lambda: f"{some(dig, 4, 4)}-{some(dig, 2, 2)}-{some(dig, 2, 2)}T{some(dig, 2, 2)}:{some(dig, 2, 2)}:{some(dig, 2, 2)}Z",
        lambda: f"v{some(dig, 1, 2)}.{some(dig, 1, 2)}.{some(dig, 1, 2)}-{plain(1, 2)}.{some(dig, 1, 2)}",
        lambda: "/" + "/".join(plain(1, 4) for _ in range(int(rng.integers(2, 9)))) + f"{some(dig, 1, 2)}.{pick(['txt', 'html', 'csv', 'py'])}",
        lambda: f"{plain(2, 5)}{pick(['###', '***', '%%%', '$$$', '&&&'])}{some(dig, 1, 16)}",
        lambda: f"{some(dig, 12, 19)}{pick(['***', '###', 'th', '$$$', '%%%'])}" + plain(1, 1),
        lambda: f"{plain(2, 4)}-{plain(2, 4)}-{some(dig, 1, 4)}",
        lambda: f"{plain(2, 4).upper()}!!{plain(1, 3).upper()}{some(dig, 1, 2)}",
        lambda: f"{some(dig, 1, 3)}.{some(dig, 1, 3)}.{some(dig, 1, 3)}.{some(dig, 1, 3)}{pick(['/', ':', '***', '&&&'])}{plain(1, 1)}",
        lambda: f"#{plain(2, 4)}:{some(dig, 2, 6)}",
        *[lambda: pick(["get", "set", "find", "load", "is", "make"]) + "".join(plain(1, 3).capitalize() for _ in range(int(rng.integers(2, 5)))) + some(dig, 1, 2) + "".join(plain(1, 3).capitalize() for _ in range(int(rng.integers(1, 3))))] * 2,
        lambda: "".join(plain(1, 3).capitalize() for _ in range(int(rng.integers(2, 5)))) + some(dig, 1, 3),
        lambda: "-".join(some(up, 2, 5) if k % 2 == 0 else some(dig, 2, 6) for k in range(int(rng.integers(3, 6)))),
        lambda: some(up, 2, 5) + "-" + some(up + dig, 4, 6) + "-" + some(dig, 3, 6),
        lambda: pick(["ENSG", "ENST", "NM_", "XP_", "rs", "ISBN-", "DOI:10.", "IBAN:DE"]) + some(dig, 9, 14) + pick(["", ".1", ".12"]),
        lambda: "https://" + pick(["www.", "", "m."]) + plain(2, 3) + ".example.com/" + pick(["watch?v=", "v/", "embed/", "p/", "clip/"]) + some(low + up + dig + "_-", 8, 12),
        lambda: f"{plain(1, 3)}_{plain(1, 3)}_{plain(1, 3)}_v{some(dig, 1, 2)}" + pick(["", "_final", ".tar.gz"]),
        lambda: f"+{some(dig, 1, 2)}-{some(dig, 3, 3)}-{some(dig, 3, 4)}-{some(dig, 4, 4)}x{some(dig, 1, 3)}",
    ]
    rows = []
    for k in range(n):
        before, after = prose(0, 6), prose(0, 6)
        if k % 2:
            alone = rng.random() < 0.3
            core = pick(bare if alone else told)()
            lead = before + pick([" ", "\n", ' "']) if alone else f"{before} {given()}"
            if rng.random() < 0.08:
                core, lead = re.sub(r"[/@\"'<>]", "x", core), f"{before} {pick(['postgres', 'mysql', 'amqp', 'redis', 'https', 'ftp'])}://{plain(1, 2)}:"
                after = f"@{plain(2, 3)}.example.org:{some(dig, 4, 4)}/{plain()} {after}"
        elif rng.random() < 0.75:
            core = pick(other)()
            lead = before + pick([" ", " ", "\n", " | "]) if rng.random() < 0.9 else f"{before} {pick(['id', 'mail', 'see', 'version', 'file', 'url'])}{pick([' = ', ': ', ' '])}"
        else:
            core, lead = plain(2, 5) + pick(["", "", ".", "!"]), f"{before} {given()}"
        text = lead + core + ("" if after.startswith("@") else pick([" ", "\n", '" ', "; "])) + after
        for s, e in candidates(text, base_findings(text)):
            if s >= len(lead) - 1 and s < len(lead) + len(core):
                rows.append((text, s, e, k % 2))
                break
    return rows


class Model:
    def __init__(self, recall=0.98, rows=14000, extra=()):
        found = [*labelled(rows), *extra]
        order = np.random.default_rng(5).permutation(len(found))
        train, held, test = np.split(order, [len(found) // 2, 3 * len(found) // 4])
        y = np.array([v for *_, v in found], np.float32)
        self.network = Network()
        x, of = self._windows([found[i] for i in train])
        self.network.fit(x, y[train][of])
        x, of = self._windows([found[i] for i in held])
        self.network.calibrate(x, y[held][of])
        true = np.sort(self.score([found[i] for i in held])[y[held] == 1])
        # the greatest threshold with the recall asked for
        self.threshold = float(true[int(np.floor((1 - recall) * len(true)))])
        said = self.score([found[i] for i in test]) >= self.threshold
        self.report = {"threshold": self.threshold, "recall": float(said[y[test] == 1].mean()), "precision": float(y[test][said].mean()), "rows": len(y)}
        if self.report["recall"] < 0.9:
            raise ValueError(f"the network finds too few secrets: {self.report}")

    @staticmethod
    def _windows(found):
        made = [windows(t, [(s, e)])[0] for t, s, e, _ in found]
        return np.concatenate(made), np.repeat(np.arange(len(made)), [len(m) for m in made])

    def score(self, found) -> np.ndarray:
        x, of = self._windows(found)
        best = np.zeros(len(found))
        np.maximum.at(best, of, self.network.scores(x))
        return best

    def findings(self, text: str) -> tuple[list, list]:
        """Base findings, and all findings: (start, place of the kind, end), sorted."""
        base = base_findings(text)
        spans = candidates(text, base)
        if not spans:
            return base, base
        more = []
        for i in range(0, len(spans), 256):
            x, of = windows(text, spans[i : i + 256])
            found = np.unique(of[self.network.scores(x) >= self.threshold])
            more += [(spans[i + k][0], 3, spans[i + k][1]) for k in found.tolist()]
        return base, sorted(base + more)


@lru_cache(maxsize=4)
def model(recall=0.98, rows=14000) -> Model:
    return Model(recall, rows)


def scan(docs: DataFrame, recall=0.98, rows=14000, id_col="doc_id", text_col="text") -> DataFrame:
    """A row a document: doc_id, findings: array of (kind, start, end, text), sorted by start, then kind."""
    fitted = model(recall, rows)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            found = []
            for t in texts:
                text = t.as_py() or ""
                found.append([{"kind": KINDS[k], "start": s, "end": e, "text": text[s:e]} for s, k, e in fitted.findings(text)[1]])
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, kind)], names=["doc_id", "findings"])

    rows_in = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return ship(rows_in).mapInArrow(run, "doc_id long, findings array<struct<kind: string, start: long, end: long, text: string>>")


def digests(found: DataFrame) -> DataFrame:
    """From `scan`: n_assign, n_access, n_hex, base_sha256 and spans, in native functions."""
    said = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("findings", lambda x: x["kind"] != "cnn")
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.array_join(F.transform(base, said), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("findings", said), ",").alias("spans"), F.size(F.filter("findings", lambda x: x["kind"] == "cnn")).cast("long").alias("n_cnn"),
    )


def digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
