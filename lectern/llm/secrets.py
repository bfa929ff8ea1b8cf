"""Finds secrets: three fixed rules, and a character network over every other candidate."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import wordvec as wv
from lectern.llm.common import small_batches, unpack

#: The base rules, their least lengths, and the order of kinds ("net" for the network's spans).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "net")

#: What the network judges: runs of at least 12 characters that secrets are made of, with a letter and a digit or with
#: a capital after a small letter.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
MIXED = re.compile(r"[a-z][A-Z]|[0-9].*[A-Za-z]|[A-Za-z].*[0-9]")
LEFT, INSIDE, RIGHT = 24, 40, 12
LENGTH, CHARS, DIM, WIDTH, FILTERS = LEFT + INSIDE + RIGHT, 130, 8, 5, 24


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of the base rules' matches, sorted."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text) if MIXED.search(m[0])]


def encode(text: str, lo: int, hi: int) -> np.ndarray:
    """Character codes of a candidate with its surroundings in fixed places; 0 pads, beyond ASCII is one code."""
    out = np.zeros(LENGTH, np.uint8)
    left, inside, right = text[max(0, lo - LEFT) : lo], text[lo : min(hi, lo + INSIDE)], text[hi : hi + RIGHT]
    for at, part in ((LEFT - len(left), left), (LEFT, inside), (LEFT + INSIDE, right)):
        out[at : at + len(part)] = [min(ord(c) + 1, CHARS - 1) for c in part]
    return out


def places(text: str, lo: int, hi: int) -> np.ndarray:
    """What the network sees of a candidate of over INSIDE characters, a row for each place of the INSIDE ones in it,
    with the characters around that place; a view of the codes, whatever the length."""
    start = max(0, lo - LEFT)
    codes = np.zeros(LEFT + hi - lo + RIGHT, np.uint8)
    part = [min(ord(c) + 1, CHARS - 1) for c in text[start : hi + RIGHT]]
    codes[LEFT - (lo - start) :][: len(part)] = part
    return np.lib.stride_tricks.sliding_window_view(codes, LENGTH)


class Network:
    """Embedding, one convolution, maximum over places in each of the three parts, logistic output."""

    PARTS = ((0, LEFT), (LEFT, LEFT + INSIDE), (LEFT + INSIDE, LENGTH - WIDTH + 1))

    def __init__(self, seed: int = 5):
        r = np.random.RandomState(seed)
        self.p = {
            "e": r.standard_normal((CHARS, DIM)) * 0.3,
            "k": r.standard_normal((WIDTH * DIM, FILTERS)) * 0.15,
            "b": np.zeros(FILTERS),
            "w": r.standard_normal(3 * FILTERS) * 0.1,
            "o": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def forward(self, x: np.ndarray):
        p = self.p
        e = p["e"][x]
        wide = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(x), LENGTH - WIDTH + 1, WIDTH * DIM)
        a = wide @ p["k"] + p["b"]
        tops = [a[:, lo:hi].argmax(1) + lo for lo, hi in self.PARTS]
        best = np.concatenate([np.take_along_axis(a, t[:, None], 1)[:, 0] for t in tops], axis=1)
        kept = np.maximum(best, 0)
        return kept @ p["w"] + p["o"][0], (wide, tops, best, kept)

    def logits(self, x: np.ndarray, batch: int = 512) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + batch])[0] for i in range(0, len(x), batch)]) if len(x) else np.zeros(0)

    def highest(self, heads: np.ndarray, rest: dict[int, np.ndarray]) -> np.ndarray:
        """The highest logit of each candidate, over its head and all its places."""
        z = self.logits(heads)
        for i, x in rest.items():
            z[i] = max(z[i], *(self.logits(x[j : j + 512]).max() for j in range(0, len(x), 512)))
        return z

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        z, (wide, tops, best, kept) = self.forward(x)
        d = ((1 / (1 + np.exp(-z)) - y) / len(y)).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["w"], g["o"] = kept.T @ d, np.asarray([d.sum()], np.float32)
        db = d[:, None] * self.p["w"] * (best > 0)
        rows = np.arange(len(x))[:, None]
        for i, top in enumerate(tops):
            part = db[:, i * FILTERS : (i + 1) * FILTERS]
            picked = wide[rows, top]
            g["k"] += np.einsum("nfd,nf->df", picked, part)
            g["b"] += part.sum(0)
            back = (part[:, :, None] * self.p["k"].T[None]).reshape(len(x), FILTERS, WIDTH, DIM)
            for j in range(WIDTH):
                np.add.at(g["e"], x[rows, top + j].reshape(-1), back[:, :, j].reshape(-1, DIM))
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, rate: float = 0.01, batch: int = 64, seed: int = 1) -> None:
        m, v, t = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2)), None, 0
        m, v = m
        rng = np.random.RandomState(seed)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                t += 1
                for k, g in self.gradients(x[order[i : i + batch]], y[order[i : i + batch]]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


class _Maker:
    """Makes up findings by rule: secrets and look-alikes of several kinds."""

    def __init__(self, seed: int):
        self.r = np.random.RandomState(seed)

    def pick(self, chars: str, lo: int, hi: int | None = None) -> str:
        return "".join(chars[i] for i in self.r.randint(0, len(chars), lo if hi is None else self.r.randint(lo, hi + 1)))

    def word(self) -> str:
        """Made of syllables, as words are."""
        return "".join(self.pick("bcdfghklmnprstvw", 1) + self.pick("aeiou", 1) + (self.pick("nrstl", 1) if self.r.rand() < 0.4 else "") for _ in range(self.r.randint(1, 4)))

    def name(self, n: int, joint: str) -> str:
        return joint.join(self.word() for _ in range(n))

    def secret(self, kind: str) -> str:
        every = LOWER + UPPER + DIGITS
        return {
            "hex": lambda: self.pick(DIGITS + "abcdef", int(self.r.choice([16, 20, 32, 40, 64]))).upper(),
            "plain": lambda: self.pick(every, 20, 48),
            "base64": lambda: self.pick(every + "+/", 24, 60) + "=" * self.r.randint(0, 3),
            "url64": lambda: self.pick(every + "_-", 22, 64),
            "prefixed": lambda: self.pick(LOWER, 2, 4) + ["_", "-"][self.r.randint(2)] + self.pick(every, 24, 40),
            "live": lambda: self.pick(LOWER, 2) + "_" + ["live", "test", "prod"][self.r.randint(3)] + "_" + self.pick(every, 20, 32),
            "dashed": lambda: "-".join(self.pick(UPPER + DIGITS, 5) for _ in range(5)),
            "grouped": lambda: "-".join(self.pick(DIGITS + "abcdef", n) for n in (8, 4, 4, 4, 12)),
            "dotted": lambda: "-".join([self.pick(LOWER, 4), self.pick(DIGITS, 10, 12), self.pick(every, 20, 28)]),
            "lower": lambda: self.pick(LOWER + DIGITS, 20, 40),
            "after": lambda: self.word() + "_" + self.word() + "=" + self.pick(every, 20, 40),
            "short": lambda: self.pick(every, 14, 18) + self.pick(DIGITS, 1),
        }[kind]()

    def other(self, kind: str) -> str:
        d = lambda n: self.pick(DIGITS, n)
        return {
            "words_digits": lambda: self.word() + self.word() + self.word() + d(self.r.randint(1, 4)),
            "slug": lambda: self.name(4, "-") + "-" + d(self.r.randint(1, 5)),
            "path": lambda: "/" + self.name(3, "/") + "/" + self.word() + d(1) + "/" + self.word(),
            "snake": lambda: self.name(3, "_") + "_" + d(self.r.randint(1, 4)),
            "constant": lambda: self.name(3, "_").upper() + "_" + d(1),
            "time": lambda: f"{self.r.randint(1950, 2035)}-{self.r.randint(10, 13)}-{self.r.randint(10, 29)}T{d(6)}Z",
            "camel": lambda: "".join(self.word().title() for _ in range(self.r.randint(3, 5))) + (d(self.r.randint(1, 3)) if self.r.rand() < 0.5 else ""),
            "method": lambda: self.word() + "".join(self.word().title() for _ in range(self.r.randint(2, 4))),
            "part": lambda: self.pick(UPPER, 2, 3) + "-" + d(4) + "-" + d(4) + "-" + self.pick(UPPER, 1),
            "versioned": lambda: self.name(2, "-") + "-v" + d(1) + "-" + d(2) + "-" + d(1),
            "sum": lambda: self.word() + "=" + d(3) + "+" + self.word() + "=" + d(3) + "/" + d(2),
            "query": lambda: self.word() + "=" + self.word() + d(2) + "-" + self.word(),
            "rule": lambda: ["-", "=", "_"][self.r.randint(3)] * self.r.randint(12, 40) + self.word() + d(1),
        }[kind]()

    def around(self, secret: bool) -> tuple[str, str]:
        """A lead and a tail, where no real context is to be had."""
        leads = ["", "see ", f"{self.word()} = ", f'{self.word()}_key = "', f'"{self.word()}": "', "Authorization: Bearer ", "export KEY=", f"{self.word()}: ", "(", f"{self.name(2, ' ')} "]
        lead = leads[self.r.randint(len(leads))]
        return self.name(4, " ") + " " + lead, ["", '"', ".", "\n", ",", ")"][self.r.randint(6)] + " " + self.name(3, " ")


SECRETS = ("hex", "plain", "base64", "url64", "prefixed", "live", "dashed", "dotted", "lower", "after", "short", "grouped")
OTHERS = ("words_digits", "slug", "path", "snake", "constant", "time", "camel", "method", "part", "versioned", "sum", "query", "rule")


def made_findings(n: int, seed: int = 11, contexts: list[tuple[str, str]] | None = None) -> list[tuple[str, int, int, str]]:
    """Labelled findings: (text, start, end, kind), the kinds of SECRETS and OTHERS in turn.

    Each stands between made-up words or, every second one, in a context of the corpus.
    """
    make, out = _Maker(seed), []
    for i in range(n):
        good = i % 2 == 0
        kinds = SECRETS if good else OTHERS
        kind = kinds[i // 2 % len(kinds)]
        body = make.secret(kind) if good else make.other(kind)
        before, after = make.around(good)
        if contexts and i // 2 % 2:
            left, right = contexts[make.r.randint(len(contexts))]
            before, after = left + (" " if make.r.rand() < 0.7 else before.split(" ")[-1]), after[:1] + " " + right
        out.append((before + body + after, len(before), len(before) + len(body), kind))
    return out


def samples(docs: DataFrame, most: int, text_col: str) -> tuple[list[bytes], list[tuple[str, str]]]:
    """At most ``most`` encoded base findings that are candidates too, and as many contexts of words, those of the least
    hashes, in one pass over all texts. Candidates outside the base rules have no label and are not taken."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, kinds = [], []
            for text in _suspects(b.column(0)):
                spans = base_spans(text)
                for lo, hi in candidates(text) if spans else ():
                    if any(a < hi and lo < e for a, _, e in spans):
                        xs.append(encode(text, lo, hi).tobytes())
                        kinds.append("finding")
                at = text.find(" ", len(text) // 2)
                if at >= LEFT and len(text) >= at + RIGHT:
                    xs.append((text[at - LEFT : at] + "\0" + text[at + 1 : at + RIGHT]).encode())
                    kinds.append("context")
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), pa.array(kinds, pa.string())], ["x", "kind"])

    rows = docs.select(F.col(f"`{text_col}`")).mapInArrow(found, "x binary, kind string").distinct()
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("x"), "x"))
    got = rows.withColumn("rank", rank).where(F.col("rank") <= most).collect()
    contexts = [tuple(bytes(r.x).decode("utf-8", "replace").split("\0", 1)) for r in got if r.kind == "context"]
    return sorted(bytes(r.x) for r in got if r.kind == "finding"), sorted(contexts)


def fit(found: list[bytes], contexts: list[tuple[str, str]], made: int = 3600, recall: float = 0.95, folds: int = 3, seed: int = 11) -> tuple[Network, float, float]:
    """A network, a scale and a threshold; sigmoid(scale * logit) is a probability.

    Scale and threshold are set on kinds that a network has not learnt: the kinds are dealt to
    ``folds``, and for each a network learns from the others. The threshold is the highest at which of every kind of secret at
    least ``recall`` are found. The network that is returned has learnt from all kinds and from the base rules' findings.
    """
    data = made_findings(made, seed, contexts)
    x = np.asarray([encode(t, lo, hi) for t, lo, hi, _ in data] + [np.frombuffer(f, np.uint8) for f in found])
    kind = np.asarray([k for *_, k in data] + ["finding"] * len(found))
    y = (np.isin(kind, SECRETS) | (kind == "finding")).astype(np.float32)
    fold = np.asarray([(SECRETS + OTHERS).index(k) % folds if k != "finding" else folds for k in kind])
    z = np.zeros(len(x))
    for f in range(folds):
        net = Network()
        net.fit(x[fold != f], y[fold != f], epochs=4)
        z[fold == f] = net.logits(x[fold == f])
    at = fold < folds
    scales = np.geomspace(0.05, 2, 19)
    loss = [np.mean(np.logaddexp(0, -s * z[at] * (2 * y[at] - 1))) for s in scales]
    scale = float(scales[int(np.argmin(loss))])
    p = 1 / (1 + np.exp(-scale * z))
    threshold = min(float(np.quantile(p[kind == k], 1 - recall, method="lower")) for k in SECRETS if (kind == k).any())
    net = Network()
    net.fit(x, y, epochs=6)
    return net, scale, threshold


_TOKEN = np.zeros(256, bool)
_TOKEN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdef"]] = True
_SMALL, _CAPITAL = (np.isin(np.arange(256), [ord(c) for c in x]) for x in (LOWER, UPPER))
_SIGN = np.zeros(256, bool)
_SIGN[[ord(":"), ord("=")]] = True


def _long_runs(flag: np.ndarray, least: int) -> np.ndarray:
    """First and last byte of each run of at least ``least`` set flags; runs may cross rows, which only errs to more."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flag, [False]]).astype(np.int8)))
    runs = edge.reshape(-1, 2)
    return runs[runs[:, 1] - runs[:, 0] >= least]


def _flagged(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which rows may hold a finding or a candidate; the others surely don't."""
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    runs = _long_runs(_TOKEN[data], 12)
    steps = np.concatenate([[0, 0], np.cumsum(_SMALL[data[:-1]] & _CAPITAL[data[1:]])]) if len(data) else np.zeros(1, np.int64)
    some = (digits[runs[:, 1]] > digits[runs[:, 0]]) | (steps[runs[:, 1]] > steps[runs[:, 0]])
    runs = np.concatenate([runs[some], _long_runs(_HEX[data], 24)])
    at = np.flatnonzero(_SIGN[data])
    a = np.flatnonzero(data[:-3] == 65) if len(data) > 3 else np.zeros(0, np.int64)
    a = a[(data[a + 1] == 75) & (data[a + 2] == 73) & (data[a + 3] == 65)]
    out = np.zeros(len(off) - 1, bool)
    rows = np.searchsorted(off, np.concatenate([at, a]), "right") - 1
    out[np.clip(rows, 0, len(off) - 2)] = True
    for lo, hi in runs:  # a run that crosses rows flags all of them
        first, last = np.searchsorted(off, [lo, hi - 1], "right") - 1
        out[first : last + 1] = True
    return out


def _suspects(column: pa.Array) -> Iterator[str]:
    for _, _, data, off in wv.slices(column):
        for i in np.flatnonzero(_flagged(data, off)):
            yield data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace")


def secret_scan(docs: DataFrame, most_samples: int = 2000, recall: float = 0.95, text_col: str = "text") -> DataFrame:
    """The columns of docs plus base and spans: arrays of (kind, start, end), by start, then kind.

    base are the matches of the three rules; spans also has kind net: candidates
    that overlap no base match and that the network finds to be secrets. Offsets
    count code points, ends are exclusive.

    A candidate is any run of at least 12 characters of a secret's alphabet with a letter and a digit, or with a
    capital after a small letter. The network sees 40 characters of it with 24 before and 12 after, of a longer one
    first its head, then every place, and the highest result counts. It is trained on labelled findings: made-up secrets and
    look-alikes of many kinds, half of them put into contexts of the corpus, and findings of the base rules (at most
    ``most_samples`` of either from the documents, by least hash). A candidate that no rule knows has no label: it is judged, never
    learnt from. Scale and threshold come from kinds held out of training (see ``fit``).

    Texts are scanned whole in Arrow batches, very long ones in one slice each; a byte-level test passes over rows
    that cannot hold any. Null and empty texts have none. Starts that tie are listed base kinds first. Repeated rows are
    scanned each. An empty table gives no rows. Input columns named base or spans are replaced, others kept, whatever
    their names. Nothing is shuffled but the distinct samples.
    """
    small_batches(docs)
    net, scale, threshold = fit(*samples(docs, most_samples, text_col), recall=recall)
    shared = docs.sparkSession.sparkContext.broadcast(net.p)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    span = "array<struct<kind:string,start:long,end:long>>"

    @F.arrow_udf(f"struct<base:{span},spans:{span}>")
    def scan(t: pa.Array) -> pa.Array:
        judge = Network()
        judge.p = shared.value
        base: list[list] = [[] for _ in range(len(t))]
        asked, xs, rest = [], [], {}
        for first, _, data, off in wv.slices(t):
            for i in np.flatnonzero(_flagged(data, off)):
                text = data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace")
                row = first + int(i)
                base[row] = base_spans(text)
                for lo, hi in candidates(text):
                    if not any(a < hi and lo < e for a, _, e in base[row]):
                        if hi - lo > INSIDE:
                            rest[len(asked)] = places(text, lo, hi)
                        asked.append((row, lo, hi))
                        xs.append(encode(text, lo, hi))
        spans = [list(x) for x in base]
        if asked:
            p = 1 / (1 + np.exp(-scale * judge.highest(np.asarray(xs), rest)))
            for (row, lo, hi), good in zip(asked, p >= threshold):
                if good:
                    spans[row].append((lo, 3, hi))
        say = lambda x: [{"kind": KINDS[k], "start": a, "end": e} for a, k, e in sorted(x)]
        return pa.array([{"base": say(b), "spans": say(s)} for b, s in zip(base, spans)], pa.struct([("base", pa.list_(kind)), ("spans", pa.list_(kind))]))

    rows = docs.select(F.struct("*").alias("d"), scan(F.col(f"`{text_col}`")).alias("s"))
    return unpack(rows, docs.columns, {"base": F.col("s.base"), "spans": F.col("s.spans")})


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
