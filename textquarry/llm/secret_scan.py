"""Operator 12, secret scans: patterns, and a character convolutional network over every other candidate.

Base findings are the leftmost non-overlapping matches of three patterns; a finding's span is the whole match, in code
points. Candidates of the network are all maximal runs of the characters that keys are made of, stripped of dots and
dashes at their ends, of at least LEAST characters, with a digit or with small and capital letters mixed. One that touches no base finding is
scored together with LEFT characters before it and RIGHT after it; a long one in pieces of BODY characters that overlap by half, and has the mean
of their scores. Those that reach their kind's threshold become findings of the kind `model`.

The network (embedded characters, a convolution, maxima and means over body and context, two dense layers) is written and trained in
numpy on labelled findings: base findings and other candidates of the MOST_TRAIN documents of the least hashes (MOST_CHARACTERS of each), and findings of published formats and
harmless look-alikes made by a seeded generator, set into sentences of those documents. A fifth of them, by hash, isn't learned from: on one half of
it the scores are calibrated (a logistic of the network's output), on the other each kind's threshold is the one that finds RECALL of its secrets, or a lower one that still spares all but FALSE of its harmless candidates.

Defined results: a null text is empty; no finding gives zeros, the digest of an empty string and an empty list; rows that repeat are
scanned alike; nothing but doc_id and text is read, so further columns can't clash; texts and candidates of any length are scanned
whole; an empty table gives an empty result. A document is one row of one task, of some 40 bytes of memory for each byte of its text.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import LOWER, slices, utf8

KINDS = ("assign", "access", "hex", "model")
LEAST = 12
LEFT, BODY, RIGHT = 24, 48, 8
MOST_TRAIN = 2000
MOST_EACH = 3000  # candidates of the documents, of either label
MOST_CHARACTERS = 20_000  # of each of them
MADE = 3000  # generated findings, and as many look-alikes
RECALL = 0.97
FALSE = 0.002
SURE = 0.8  # no lower threshold is taken for the sake of more
SEED = 12
STRETCH = 1 << 13  # windows scored at a time

_ASSIGN = re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_KEY = np.zeros(256, bool)
_KEY[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.~-")] = True
_EDGE = b"./-~_"

# ---- candidates ---------------------------------------------------------------------------------------------


def _stretches(inside: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of maximal runs of at least so many bytes, each within one text."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(inside))]
    cut = np.unique(cut[inside[cut - 1] & inside[cut]]) if len(cut) else cut  # runs that go on in the next text
    starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    long = ends - starts >= least
    return starts[long], ends[long]


def _base(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes of all base findings."""
    found = [(a, b, 2) for a, b in zip(*(x.tolist() for x in _stretches(_HEX[data], offsets, 24)), strict=True)]
    raw, low = data.tobytes(), LOWER[data].tobytes()
    for names, where, pattern, kind in ((_NAMES, low, _ASSIGN, 0), ((b"AKIA",), raw, _ACCESS, 1)):
        rows: set[int] = set()
        for name in names:
            at = where.find(name)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                rows.add(row)
                at = where.find(name, int(offsets[row + 1]))  # on to the next text
        for row in rows:
            begin, end = int(offsets[row]), int(offsets[row + 1])
            for m in pattern.finditer(raw, begin, end):
                if len(m[1]) >= 6 if kind == 0 else m.end() - m.start() >= 20:
                    found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda f: (f[0], f[2]))


def _others(data: np.ndarray, offsets: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) in bytes of the candidates that touch no base finding."""
    raw, out = data.tobytes(), []
    starts, ends = np.array([b[0] for b in base], np.int64), np.maximum.accumulate(np.array([b[1] for b in base], np.int64))
    for a, b in zip(*(x.tolist() for x in _stretches(_KEY[data], offsets, LEAST)), strict=True):
        text = raw[a:b]
        body = text.strip(_EDGE)
        a += len(text) - len(text.lstrip(_EDGE))
        b = a + len(body)
        if len(body) < LEAST or not _mixed(body):
            continue
        last = int(np.searchsorted(starts, b)) - 1  # the last that starts before its end
        if last < 0 or ends[last] <= a:
            out.append((a, b))
    return out


_DIGIT, _CAMEL = re.compile(rb"[0-9]"), re.compile(rb"[a-z][A-Z]|[A-Z]{2}.*[a-z]", re.S)


def _mixed(body: bytes) -> bool:
    return bool(_DIGIT.search(body) or _CAMEL.search(body))


def shape(body: bytes) -> int:
    """The kind that a candidate's threshold goes by: digits and signs, one case of letters, both, with signs within."""
    if re.fullmatch(rb"[0-9+/_.~-]+", body):
        return 0
    if re.search(rb"[+/_.~-]", body):
        return 3
    return 2 if re.search(rb"[a-z]", body) and re.search(rb"[A-Z]", body) else 1


SHAPES = 4

# ---- the network --------------------------------------------------------------------------------------------

_CODE = np.full(256, 3, np.uint8)  # 0 nothing, 1 white space, 2 beyond ASCII, 3 another sign
_CODE[[0x20, *range(0x09, 0x0E)]] = 1
_CODE[128:] = 2
_SIGNS = b"\"'`:=+/_.-~@#,;()<>{}[]&?%$*!|\\"
_CODE[list(_SIGNS)] = 4 + np.arange(len(_SIGNS))
for _first, _n in ((0x30, 10), (0x41, 26), (0x61, 26)):
    _CODE[_first : _first + _n] = (_n == 26) * 10 + (_first == 0x61) * 26 + 4 + len(_SIGNS) + np.arange(_n)
_CODES = int(_CODE.max()) + 1
_SPAN = LEFT + BODY + RIGHT
_PART = np.repeat([0, 1, 2], [LEFT, BODY, RIGHT])
WIDE, DEEP, FILTERS, HIDDEN = 5, 8, 24, 16


def pieces(spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, of): candidates in pieces of BODY characters that overlap by half, and the candidate that each belongs to."""
    out = []
    for k, (a, b) in enumerate(spans):
        out.append((a, min(b, a + BODY), k))
        while a + BODY < b:
            a += BODY // 2
            out.append((a, min(b, a + BODY), k))
    start, end, of = np.array(out, np.int64).reshape(-1, 3).T
    return start, end, of


def windows(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Coded characters of some pieces and what stands around them, each within one text. A body ends in nothing if it is short."""
    row = np.searchsorted(offsets, start, "right") - 1
    at = start[:, None] + (np.arange(_SPAN) - LEFT)
    at[:, _PART == 2] = end[:, None] + np.arange(RIGHT)
    inside = (at >= offsets[row][:, None]) & (at < offsets[row + 1][:, None])
    inside[:, _PART == 1] &= at[:, _PART == 1] < end[:, None]
    return np.where(inside, _CODE[data[np.where(inside, at, 0)]], 0).astype(np.uint8) if len(at) else np.zeros((0, _SPAN), np.uint8)


@dataclass
class Network:
    weights: dict[str, np.ndarray]

    @staticmethod
    def new(rng: np.random.Generator) -> Network:
        draw = lambda *shape, by: (rng.standard_normal(shape) / np.sqrt(by)).astype(np.float32)
        pooled = 4 * FILTERS
        return Network({"embed": draw(_CODES, DEEP, by=DEEP), "conv": draw(WIDE * DEEP, FILTERS, by=WIDE * DEEP), "conv_b": np.zeros(FILTERS, np.float32), "one": draw(pooled, HIDDEN, by=pooled), "one_b": np.zeros(HIDDEN, np.float32), "two": draw(HIDDEN, 1, by=HIDDEN), "two_b": np.zeros(1, np.float32)})

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, dict]:
        """Outputs, and what their gradient needs."""
        w, n = self.weights, len(codes)
        half = WIDE // 2
        padded = np.pad(codes, ((0, 0), (half, half)))
        there = (codes > 0).astype(np.float32)
        embedded = w["embed"][padded] * (padded > 0)[..., None]
        views = np.lib.stride_tricks.sliding_window_view(embedded, WIDE, axis=1).transpose(0, 1, 3, 2).reshape(n, _SPAN, WIDE * DEEP)
        raw = np.maximum(views @ w["conv"] + w["conv_b"], 0) * there[..., None]
        body = raw[:, _PART == 1]
        length = np.maximum(there[:, _PART == 1].sum(1, keepdims=True), 1)
        tops = [raw[:, _PART == p].argmax(1) for p in range(3)]
        pools = [np.take_along_axis(raw[:, _PART == p], t[:, None], 1)[:, 0] for p, t in enumerate(tops)]
        pooled = np.concatenate([*pools, body.sum(1) / length], 1)
        hidden = np.maximum(pooled @ w["one"] + w["one_b"], 0)
        return (hidden @ w["two"] + w["two_b"])[:, 0], {"padded": padded, "views": views, "raw": raw, "length": length, "tops": tops, "pooled": pooled, "hidden": hidden, "there": there}

    def gradient(self, by_output: np.ndarray, seen: dict) -> dict[str, np.ndarray]:
        w, n = self.weights, len(by_output)
        out = {"two": seen["hidden"].T @ by_output[:, None], "two_b": by_output.sum(keepdims=True)}
        hidden = by_output[:, None] * w["two"][:, 0] * (seen["hidden"] > 0)
        out |= {"one": seen["pooled"].T @ hidden, "one_b": hidden.sum(0)}
        pooled = hidden @ w["one"].T
        raw = np.zeros_like(seen["raw"])
        for p, top in enumerate(seen["tops"]):
            first = int(np.flatnonzero(_PART == p)[0])
            raw[np.arange(n)[:, None], first + top, np.arange(FILTERS)[None]] += pooled[:, p * FILTERS : (p + 1) * FILTERS]
        raw[:, _PART == 1] += (pooled[:, 3 * FILTERS :] / seen["length"])[:, None]
        raw *= (seen["raw"] > 0) * seen["there"][..., None]
        out |= {"conv": np.tensordot(seen["views"], raw, ((0, 1), (0, 1))), "conv_b": raw.sum((0, 1))}
        views = (raw @ w["conv"].T).reshape(n, _SPAN, WIDE, DEEP)
        embed = np.zeros_like(w["embed"])
        for k in range(WIDE):
            np.add.at(embed, seen["padded"][:, k : k + _SPAN], views[:, :, k])
        embed[0] = 0
        return out | {"embed": embed}

    def outputs(self, codes: np.ndarray, at_a_time: int = 512) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.float32), *(self.forward(codes[k : k + at_a_time])[0] for k in range(0, len(codes), at_a_time))])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def train(codes: np.ndarray, labels: np.ndarray, rounds: int = 14, batch: int = 128, rate: float = 3e-3, seed: int = SEED) -> Network:
    """Adam on the cross entropy; both labels weigh the same."""
    rng = np.random.default_rng(seed)
    net = Network.new(rng)
    mean = {k: np.zeros_like(v) for k, v in net.weights.items()}
    square = {k: np.zeros_like(v) for k, v in net.weights.items()}
    share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    step = 0
    for turn in range(rounds):
        order = rng.permutation(len(codes))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            out, seen = net.forward(codes[some])
            y = labels[some].astype(np.float32)
            g = net.gradient(((_sigmoid(out) - y) * np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / len(some)).astype(np.float32), seen)
            step += 1
            now = rate * (1 - turn / rounds)
            for k, v in g.items():
                mean[k] += 0.1 * (v - mean[k])
                square[k] += 0.001 * (v * v - square[k])
                net.weights[k] -= now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return net


@dataclass
class Scanner:
    network: Network
    slope: float
    offset: float
    thresholds: list[float]  # by shape

    def scores(self, data: np.ndarray, offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
        """Probabilities of some candidates, by the means of their pieces."""
        start, end, of = pieces(spans)
        out = [self.network.outputs(windows(data, offsets, start[k : k + STRETCH], end[k : k + STRETCH])) for k in range(0, len(start), STRETCH)]
        mean = np.bincount(of, np.concatenate([np.zeros(0), *out]), len(spans)) / np.maximum(np.bincount(of, minlength=len(spans)), 1)
        return _sigmoid(self.slope * mean + self.offset)


def calibrated(net: Network, codes: np.ndarray, labels: np.ndarray, shapes: np.ndarray, hashes: np.ndarray, recall: float = RECALL) -> Scanner:
    """A scanner from held-out findings: the logistic from one half, thresholds from the other."""
    out = net.outputs(codes).astype(np.float64)
    half = hashes // 5 % 2 == 0
    slope, offset = 1.0, 0.0
    x, y = out[half], labels[half].astype(float)
    for _ in range(50 if 0 < y.sum() < len(y) else 0):  # Newton, with a small ridge
        p = _sigmoid(slope * x + offset)
        w = p * (1 - p) + 1e-6
        a, b, c = (w * x * x).sum() + 1e-2, (w * x).sum(), w.sum() + 1e-2
        u, v = ((y - p) * x).sum() - 1e-2 * (slope - 1), (y - p).sum() - 1e-2 * offset
        slope, offset = slope + (c * u - b * v) / (a * c - b * b), offset + (a * v - b * u) / (a * c - b * b)
    p = _sigmoid(slope * out + offset)
    thresholds = []
    for s in range(SHAPES):
        here = ~half & (shapes == s)
        own, rest = np.sort(p[here & labels.astype(bool)])[::-1], p[here & ~labels.astype(bool)]
        least = own[max(0, int(np.ceil(recall * len(own))) - 1)] if len(own) else 2.0
        if len(own):  # below that, as far down as spares all but FALSE of the harmless ones
            least = min(least, max(SURE, np.quantile(rest, 1 - FALSE) if len(rest) else SURE))
        thresholds.append(round(float(least), 6))
    return Scanner(net, float(slope), float(offset), thresholds)


# ---- labelled findings --------------------------------------------------------------------------------------

#: Ordinary words for look-alikes, beside those of the corpus.
_PLAIN = "river house market table garden window report final summer winter school donau dampf fahrt gesellschaft recht schutz auto strasse maison jardin voiture ecole tiempo mundo trabajo ciudad name value index update image header footer widget user account page main list item order number invoice".split()
_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def made_finding(rng: random.Random) -> tuple[str, str, str]:
    """(before, secret, after) in one of the published formats of keys, or without one."""
    some = lambda n, of=_ALNUM: "".join(rng.choice(of) for _ in range(n))
    url_safe, body = _ALNUM + "-_", rng.choice([_ALNUM, _ALNUM, "0123456789abcdefABCDEF", "0123456789abcdef"])
    kind = rng.randrange(9)
    secret = (
        "gh" + rng.choice("pousr") + "_" + some(36, body) if kind == 0
        else "xox" + rng.choice("bpa") + f"-{rng.randrange(10**10, 10**11)}-{some(24)}" if kind == 1
        else rng.choice(["sk", "rk", "pk"]) + "_" + rng.choice(["live", "test"]) + "_" + some(rng.choice([24, 32, 48]), body) if kind == 2
        else f"eyJ{some(rng.randrange(15, 34))}.eyJ{some(rng.randrange(20, 60), url_safe)}.{some(43, url_safe)}" if kind == 3
        else "AIza" + some(35, url_safe) if kind == 4
        else some(rng.choice([32, 40, 64]), "0123456789ABCDEF") if kind == 5
        else some(rng.choice([22, 28, 40, 43, 64, 86]), _ALNUM + "+/") if kind == 6
        else "glpat-" + some(20, url_safe) if kind == 7
        else some(rng.randrange(16, 44), body)
    )
    if not _DIGIT.search(secret.encode()):
        secret = secret[:-1] + rng.choice("0123456789")
    before = rng.choice(["key: ", "Authorization: Bearer ", "export KEY=", "\"credential\": \"", "auth='", "pwd: ", "client_id is ", "use ", "", "", "", "access with "])
    return before, secret.strip("./-~_") if kind in (6,) else secret, rng.choice(["", "\"", "'", ";", ",", "\n", ".", " "])


def made_lookalike(rng: random.Random, words: list[str]) -> tuple[str, str, str]:
    """(before, text, after) of something harmless that is a candidate too."""
    word = lambda: rng.choice(words) if words else "word"
    n = rng.randrange
    kind = n(19)
    text = (
        f"{n(1990, 2030)}-{n(1, 13):02d}-{n(1, 29):02d}T{n(24):02d}" if kind == 0
        else f"{n(10**7, 10**8):08x}-{n(16**4):04x}-4{n(16**3):03x}-{n(8, 12):x}{n(16**3):03x}-{n(16**12):012x}" if kind == 1
        else "/".join(word() for _ in range(n(2, 5))) + f"/{word()}{n(100)}.{rng.choice(['py', 'html', 'jpg', 'java'])}" if kind == 2
        else "-".join(word() for _ in range(n(2, 6))) + f"-{n(2000)}" if kind == 3
        else word().lower() + "".join(word().capitalize() for _ in range(n(1, 4))) + rng.choice(["", str(n(10))]) if kind == 4
        else f"{rng.choice(['mail', 'www', 'cdn', 'img'])}{n(100)}.{word()}.{rng.choice(['com', 'org', 'net', 'example.com'])}" if kind == 5
        else "".join(rng.choice("0123456789") for _ in range(n(12, 24))) if kind == 6
        else f"+{n(1, 99)}-{n(100, 999)}-{n(1000, 9999)}-{n(100, 9999)}" if kind == 7
        else f"{word()}_{word()}_{n(1000)}" if kind == 8
        else f"v{n(20)}.{n(20)}.{n(2000)}-{rng.choice(['beta', 'rc', 'alpha', 'snapshot'])}{n(10)}" if kind == 9
        else word().capitalize() * n(2, 4) + str(n(100)) if kind == 10
        else f"{word().lower()}{word().lower()}{word().lower()}{n(10, 3000)}" if kind == 12
        else word().lower() * n(3, 6) + str(n(10)) if kind == 13
        else f"{rng.choice(['isbn', 'art', 'nr', 'no'])}{n(10**9, 10**13)}" if kind == 14
        else rng.choice(["DE", "FR", "ES", "GB"]) + "".join(rng.choice("0123456789") for _ in range(rng.choice([18, 20, 22]))) if kind == 15
        else f"{word()}.{word()}.org/{word()}/" + "_".join(word().capitalize() for _ in range(n(1, 4))) + rng.choice(["", f"_{n(2000)}"]) if kind == 16
        else "".join(word().lower() for _ in range(n(3, 7))).capitalize() + rng.choice(["", str(n(100))]) if kind == 17
        else f"978-{n(10)}-{n(10**4)}-{n(10**4)}-{n(10)}" if kind == 11
        else f"{n(256)}.{n(256)}.{n(256)}.{n(256)}-{n(65536)}"
    )
    return rng.choice(["key: ", "", "", "", "see ", "at ", "id=", "\"name\": \"", "version ", "file: ", "from "]), text, rng.choice(["", "\"", ",", "\n", ".", " "])


def _findings(texts: list[str]) -> Iterator[tuple[np.ndarray, bool, bytes]]:
    """(window, label, body) of all base findings and other candidates."""
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    base = _base(data, offsets)
    raw = data.tobytes()
    for label, spans in ((True, [(a, b) if k else _value(raw, a, b) for a, b, k in base]), (False, _others(data, offsets, base))):
        start, end, of = pieces(spans)
        for code, k in zip(windows(data, offsets, start, end), of.tolist(), strict=True):
            yield code, label, raw[slice(*spans[k])]


def _value(raw: bytes, a: int, b: int) -> tuple[int, int]:
    return b - len(_ASSIGN.match(raw, a, b)[1]), b


def labelled(texts: list[str], made: int = MADE, most: int = MOST_EACH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """(codes, labels, shapes, hashes) to learn from."""
    rng = random.Random(seed)
    rows, count = [], {True: 0, False: 0}
    for code, label, body in _findings(texts):
        count[label] += 1
        if count[label] <= most:
            rows.append((code, label, body))
    words = _PLAIN + sorted({w for t in texts[:200] for w in re.findall(r"[A-Za-z]{3,12}", t)})[:5000]
    around = [t for t in texts if len(t) > 80] or ["The quick brown fox jumps over the lazy dog, and then over the lazy dog once again today."]

    def set_in(parts: tuple[str, str, str]) -> tuple[str, int, int]:
        text = rng.choice(around)
        at = rng.randrange(len(text) - 60)
        before, body, after = parts
        near = rng.choice(["", text[max(0, at - 40) : at].rsplit(" ", 1)[0] + " "])
        left, right = near + before, after + rng.choice(["", " " + text[at : at + 30], " " + text[at : at + 30]])
        return left + body + right, len(left.encode()), len((left + body).encode())

    for label in (True, False):
        parts = [set_in(made_finding(rng) if label else made_lookalike(rng, words)) for _ in range(made)]
        data, offsets = utf8(pa.array([p[0] for p in parts], pa.large_string()))
        spans = [(int(offsets[k]) + a, int(offsets[k]) + b) for k, (_, a, b) in enumerate(parts)]
        raw = data.tobytes()
        start, end, of = pieces(spans)
        rows += [(code, label, raw[slice(*spans[k])]) for code, k in zip(windows(data, offsets, start, end), of.tolist(), strict=True)]
    return np.stack([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([shape(r[2]) for r in rows]), np.array([zlib.crc32(r[2]) for r in rows])


def fit(documents: DataFrame, most: int = MOST_TRAIN, characters: int = MOST_CHARACTERS) -> Scanner:
    """A scanner trained on the findings of the `most` documents of the least hashes, of so many characters each, and on generated ones."""
    h = F.xxhash64("doc_id", "text")
    rows = documents.select("text", h.alias("h")).where("text is not null")
    last = rows.select("h").orderBy("h").limit(most).agg(F.max("h")).first()[0]
    some = rows.where(F.col("h") <= F.lit(last)).select("h", F.left("text", F.lit(characters)).alias("text")).limit(most).collect() if last is not None else []
    texts = [r.text for r in sorted(some)]
    codes, labels, shapes, hashes = labelled(texts)
    learn = hashes % 5 != 0
    return calibrated(train(codes[learn], labels[learn]), codes[~learn], labels[~learn], shapes[~learn], hashes[~learn])


# ---- scans --------------------------------------------------------------------------------------------------


def scan(documents: DataFrame, scanner: Scanner) -> DataFrame:
    """(doc_id, findings): array<struct<kind, start, end, score>>, in code points, ordered by start and kind; base findings score 1."""
    kinds = np.array(KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch.column(1), 1 << 22):
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:to], found(batch.column(1)[at:to])], names=["doc_id", "findings"])

    def found(texts: pa.Array) -> pa.Array:
        data, offsets = utf8(texts)
        base = _base(data, offsets)
        spans = _others(data, offsets, base)
        scores = scanner.scores(data, offsets, spans)
        raw = data.tobytes()
        more = [(a, b, 3, s) for (a, b), s in zip(spans, scores.tolist(), strict=True) if s >= scanner.thresholds[shape(raw[a:b])]]
        every = sorted([*((a, b, k, 1.0) for a, b, k in base), *more], key=lambda f: (f[0], f[2]))
        start, end, kind, score = (np.array([f[k] for f in every], t) for k, t in enumerate((np.int64, np.int64, np.int64, np.float64)))
        points = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
        row = np.searchsorted(offsets, start, "right") - 1
        first = points[offsets[row]]
        items = pa.StructArray.from_arrays([pa.array(kinds[kind].tolist(), pa.string()), pa.array((points[start] - first).astype(np.int32)), pa.array((points[end] - first).astype(np.int32)), pa.array(score)], names=["kind", "start", "end", "score"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(offsets))).astype(np.int32)), items)

    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, findings array<struct<kind:string,start:int,end:int,score:double>>"
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_model, base_sha256, spans)."""
    told = lambda c: F.array_join(F.transform(c, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    n = lambda k: F.size(F.filter("findings", lambda f: f["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *map(n, KINDS), F.sha2(told(F.filter("findings", lambda f: f["kind"] != "model")), 256).alias("base_sha256"), told(F.col("findings")).alias("spans"))

