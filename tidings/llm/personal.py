"""Personal data in texts: fixed patterns, and a boosted model for what they leave out.

Strict patterns with a check of their own (address, four parts up to 255, Luhn's sum, number
of digits) give the base spans, which always count. Looser generators propose further and
overlapping spans: addresses with spelt-out signs, other network addresses, numbers in any
grouping, each as a card and as a phone. Gradient-boosted trees, one ensemble a kind, judge them by format
(groups, separators, checks) and context (neighbouring characters and words). A proposal
becomes a span if its calibrated probability reaches the threshold of its kind and no better
span overlaps it.

The trees learn from a bounded sample of the texts. Invented data and look-alikes (dates,
order numbers, versions, cards with a wrong digit) are set into it, so their labels are
certain; base spans found there count as positive, other proposals as weakly negative. A
third of the texts only calibrates: scores become probabilities, and the threshold of a kind
is the least at which ``PRECISION`` of the judged spans are right. A kind that does not reach
it adds none.

Offsets are code points, ends exclusive. NULL is the empty text, which has no spans. Ids, repeated
rows and other columns have no influence.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import map_blocks, whole_text

KINDS = ("email", "ip", "card", "phone")
#: Texts that the trees learn from at most, and characters of a window of each.
SAMPLE, WINDOW = 1500, 3000
#: Share of the selected spans that must be right in the calibration texts.
PRECISION = 0.97
#: Trees of a kind, their depth, learning rate and ridge; weight of unlabelled proposals.
TREES, DEPTH, RATE, RIDGE = 60, 3, 0.2, 2.0
UNLABELLED = 0.3

Span = tuple[int, int]

# -- base spans ------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit)
        if place % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    """Each ``@`` with what may stand on either side; linear, whatever the text."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        # what a failing sign has behind it is looked at again only by the next sign
        if domain:
            free = domain.end()
            found.append((start, free))
        else:
            free = max(free, at + 1)
        at = text.find("@", at + 1 if not domain else free)
    return found


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def addresses(text: str) -> list[Span]:
    """Four dotted numbers at a time, from the left of each dotted run."""
    found = []
    for run in _DOTTED.finditer(text):
        parts = run.group().split(".")
        start = run.start()
        for first in range(0, len(parts) - 3, 4):
            four = parts[first : first + 4]
            end = start + sum(map(len, four)) + 3
            if all(map(_small, four)):
                found.append((start, end))
            start = end + 1
    return found


def cards(text: str) -> list[Span]:
    found = []
    for run in _CARD.finditer(text):
        digits = only_digits(run.group()) if run.end() - run.start() < 40 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(run.span())
    return found


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(only_digits(m.group())) <= 15]


def base_spans(text: str) -> dict[str, list[Span]]:
    digits = _ANY_DIGIT.search(text) is not None
    return {
        "email": emails(text) if "@" in text else [],
        "ip": addresses(text) if digits else [],
        "card": cards(text) if digits else [],
        "phone": phones(text) if digits and "+" in text else [],
    }


_ANY_DIGIT = re.compile("[0-9]")

# -- proposals -------------------------------------------------------------------------

#: Signs that may stand for ``@``, and an address behind one of them.
_SIGN = re.compile(r" ?(?:\(at\)|\[at\]|\{at\}) ?| @ ?|@ | at |@", re.I)
_SPELT = re.compile(
    r"[A-Za-z0-9-]{1,63}(?:(?: ?(?:\(dot\)|\[dot\]|\{dot\}) ?| dot | ?\.(?=[A-Za-z0-9])|\. (?=[a-z]))"
    r"[A-Za-z0-9-]{1,63}){1,5}",
    re.I,
)
_LOOSE_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?: ?\[\.\] ?| \. |\.)[0-9]{1,3}){3}(?![0-9])")
_COLONS = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}::?){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_NUMBER = re.compile(r"[+(]{0,2}[0-9](?:[ ().\-/]{0,2}[0-9]){6,24}(?![0-9])")
_GAP = re.compile(r"[ ().\-/]{2}")


def proposals(text: str) -> list[tuple[int, int, int]]:
    """``kind, start, end`` of everything that looks like personal data; spans overlap."""
    found = []
    lowered_at = "@" in text or "at" in text or "AT" in text
    if lowered_at:
        for sign in _SIGN.finditer(text):
            start = sign.start()
            while start > 0 and sign.start() - start < 64 and text[start - 1] in _LOCAL:
                start -= 1
            if start < sign.start() and (domain := _SPELT.match(text, sign.end())):
                found.append((0, start, domain.end()))
    if _ANY_DIGIT.search(text):
        for pattern in (_LOOSE_IP, _COLONS):
            found += [(1, *m.span()) for m in pattern.finditer(text)]
        for m in _NUMBER.finditer(text):
            spans = {m.span()}
            for gap in _GAP.finditer(text, *m.span()):
                spans |= {(m.start(), gap.start()), (gap.end(), m.end())}
            for start, end in sorted(spans):
                if len(only_digits(text[start:end])) >= 7:
                    found += [(2, start, end), (3, start, end)]
    return found


#: Words that announce a kind, and words that announce another number.
_HINTS = (
    frozenset("mail email e contact write reach correo courriel adresse kontakt an schreiben".split()),
    frozenset("ip host server address from login client adresse rechner serveur servidor".split()),
    frozenset("card visa mastercard credit debit amex karte kreditkarte carte tarjeta paid".split()),
    frozenset("phone tel telephone call mobile cell fax ring handy telefon anruf appel llame".split()),
)
_OTHER = frozenset(
    "order invoice version isbn date page id ticket build serial total number ref lot token key "
    "no bestellung rechnung seite datum commande pedido since".split()
)
_WORD = re.compile(r"[^\W\d_]+")
_GROUP = re.compile("[0-9]+")
FEATURES = 37


def features(text: str, start: int, end: int) -> list[float]:
    """Format and context of a span as numbers."""
    span = text[start:end]
    groups = _GROUP.findall(span)
    digits = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    before = text[max(0, start - 40) : start]
    near = [w.lower() for w in _WORD.findall(before)][-4:]
    lower = span.lower()
    label = re.split(r"[^a-z0-9]+", lower)[-1]
    left = text[start - 1] if start else " "
    right = text[end] if end < len(text) else " "

    def neighbour(c: str) -> int:
        return 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4

    first = int(groups[0][:6]) if groups else -1
    return [
        len(span), len(digits), len(groups), sizes[0], sizes[-1], max(sizes), min(sizes),
        *(span.count(c) for c in " -./(:["), "@" in span, span.startswith("+"),
        digits.startswith("0"), digits.startswith("00"), int(digits[0]) if digits else -1,
        bool(digits) and luhn(digits), len(set(digits)), len(set(sizes)),
        sum(c.isalpha() for c in span), bool(groups) and all(map(_small, groups)),
        1900 <= first <= 2100, len(label), lower.count("dot"), ". " in span,
        neighbour(left), neighbour(right), left in "\"'=#$/",
        *(any(w in hints for w in near) for hints in _HINTS),
        any(w in _OTHER for w in near), before.rstrip().endswith(":"),
    ]


# -- boosted trees ---------------------------------------------------------------------


@dataclass
class Trees:
    """Boosted regression trees: per node a feature, a cut and the places of its children."""

    start: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node - (2**DEPTH - 1)]
        return total


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Gradient boosting of the logistic loss, cuts at quantiles, second-order leaf values."""
    rate = np.clip((weight * y).sum() / weight.sum(), 0.01, 0.99)
    model = Trees(float(np.log(rate / (1 - rate))))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T)], 1)
    width = 34
    score = np.full(len(x), model.start)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        slope, curve = weight * (p - y), weight * p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(x), np.int64)
        for at in range(inner):
            inside = np.flatnonzero(node == at)
            best, chosen = 1e-6, None
            for column in range(x.shape[1]):
                bins = binned[inside, column]
                g = np.cumsum(np.bincount(bins, slope[inside], width))
                h = np.cumsum(np.bincount(bins, curve[inside], width))
                gain = (
                    g**2 / (h + RIDGE)
                    + (g[-1] - g) ** 2 / (h[-1] - h + RIDGE)
                    - g[-1] ** 2 / (h[-1] + RIDGE)
                )
                gain[(h < 1) | (h[-1] - h < 1)] = 0
                if gain[: len(cuts[column])].max(initial=0) > best:
                    place = int(gain[: len(cuts[column])].argmax())
                    best, chosen = float(gain[place]), (column, cuts[column][place])
            if chosen:
                feature[at], cut[at] = chosen
            node[inside] = 2 * at + 1 + (x[inside, feature[at]] > cut[at])
        leaf = node - inner
        g, h = (np.bincount(leaf, v, leaves) for v in (slope, curve))
        value = -RATE * g / (h + RIDGE)
        model.trees.append((feature, cut, value))
        score += value[leaf]
    return model


def calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn scores into probabilities (Newton's method with a ridge)."""
    x = np.stack([score, np.ones(len(score))], 1)
    beta, ridge = np.array([1.0, 0.0]), np.diag([0.1, 0.01])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(
            (x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ (beta - [1, 0])
        )
        beta -= np.clip(step, -1, 1)
    return float(beta[0]), float(beta[1])


def threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least probability from which on ``precision`` of the spans are right, at least 0.5."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    # equal probabilities are selected together
    last = np.append(p[order][1:] != p[order][:-1], True)
    good = np.flatnonzero(last & (right >= precision))
    return max(float(p[order][good[-1]]), 0.5) if len(good) else math.inf


@dataclass
class Model:
    """Trees, calibration and threshold of each kind."""

    kinds: list[tuple[Trees, tuple[float, float], float]]

    def probabilities(self, kind: int, x: np.ndarray) -> np.ndarray:
        trees, (slope, offset), _ = self.kinds[kind]
        return 1 / (1 + np.exp(-np.clip(slope * trees.scores(x) + offset, -30, 30)))


# -- what is learned -------------------------------------------------------------------


class Inventor:
    """Personal data and look-alikes, in the forms in which people write them."""

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)

    def number(self, size: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(size))

    def word(self) -> str:
        return "".join(self.rng.choice("abcdefghiklmnoprstuvw") for _ in range(self.rng.randint(3, 9)))

    def email(self) -> str:
        r = self.rng
        name = self.word() + r.choice(["", ".", "_", "-"]) + r.choice([self.word(), self.number(2)])
        labels = [self.word()] + [self.word()] * r.choice([0, 0, 1])
        end = r.choice(["com", "org", "net", "de", "fr", "es", "io", "info"])
        sign, dot = r.choice(
            [("@", "."), (" at ", " dot "), ("(at)", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "),
             (" @ ", "."), ("[at]", "[dot]"), (" at ", ".")]
        )
        return name + sign + dot.join([*labels, end])

    def ip(self) -> str:
        r = self.rng
        if r.random() < 0.4:
            return ":".join(f"{r.randrange(65536):x}" for _ in range(8))
        return r.choice([".", "[.]", " . "]).join(str(r.randint(1, 254)) for _ in range(4))

    def card(self, valid: bool = True) -> str:
        r = self.rng
        digits = r.choice("3456") + self.number(r.choice([13, 14, 14, 14]))
        for last in r.sample("0123456789", 10):
            if luhn(digits + last) == valid:
                digits += last
                break
        gap = r.choice(["", " ", "-", ".", "/", " - "])
        return gap.join(digits[k : k + 4] for k in range(0, len(digits), 4))

    def phone(self) -> str:
        r = self.rng
        area, a, b = str(r.randint(201, 989)), self.number(3), self.number(4)
        country = str(r.randint(1, 99))
        return r.choice(
            [f"+{country} ({area}) {a}-{b}", f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"({area}) {a} {b}",
             f"0{area} {a}{b}", f"00{country} {area} {a} {b}", f"{area}.{a}.{b}", f"0{area}/{a}{b}",
             f"1-{area}-{a}-{b}", f"+{country}/{area}/{a}{b}"]
        )

    def other(self) -> tuple[str, tuple[str, ...]]:
        """Something else that proposals take for data, and words it may stand behind."""
        r = self.rng
        day = f"{r.randint(1, 28):02}", f"{r.randint(1, 12):02}", str(r.randint(1950, 2030))
        time = ":".join(f"{r.randint(0, 59):02}" for _ in range(3))
        return r.choice(
            [
                (f"{day[2]}-{day[1]}-{day[0]} {time}", ("date", "since", "on")),
                (f"{day[0]}.{day[1]}.{day[2]}", ("datum", "date", "le")),
                (f"{day[0]}/{day[1]}/{day[2]} - {day[0]}/{day[1]}/{day[2]}", ("from", "dates")),
                (self.number(r.randint(7, 12)), ("order", "id", "ticket", "ref", "pedido")),
                (f"978-{self.number(1)}-{self.number(2)}-{self.number(6)}-{self.number(1)}", ("isbn",)),
                (self.card(valid=False), ("serial", "number", "lot", "of")),
                (self.number(16), ("token", "key", "id")),
                (".".join(self.number(1) for _ in range(3)) + f".{r.randint(256, 9999)}", ("version", "build")),
                (time + ":" + self.number(2), ("at", "time")),
                (":".join(f"{r.randrange(256):02x}" for _ in range(6)), ("mac", "device")),
                (f"{self.word()} at {self.word()}. {self.word()}", ("look", "met")),
                (f"{self.word()} at {self.word()}.{self.word().title()}", ("they", "look")),
                (f"{self.word()}@{self.word()}", ("user", "git")),
                (f"{self.number(3)} {self.number(3)} {self.number(3)}", ("total", "of", "population")),
                (f"{self.number(4)}-{self.number(4)}-{self.number(2)}", ("invoice", "rechnung")),
            ]
        )


def planted(text: str, made: Inventor) -> tuple[str, list[tuple[int, int, int]]]:
    """``text`` with data and look-alikes set between its words, and ``kind, start, end``.

    Look-alikes have the kind -1: every proposal within them is wrong.
    """
    r, known, parts, size = made.rng, [], [], 0
    words = text.split(" ")
    places = sorted(r.randrange(len(words) + 1) for _ in range(5))
    hints = (("mail", "contact", "write"), ("ip", "host", "from"), ("card", "visa", "paid"),
             ("phone", "tel", "call", "mobile"))
    for place, (first, last) in enumerate(zip([0, *places], [*places, len(words)])):
        if place:
            if r.random() < 0.5:
                kind = r.randrange(4)
                value, before = getattr(made, KINDS[kind])(), hints[kind]
            else:
                kind, (value, before) = -1, made.other()
            lead = r.choice(before) + r.choice([" ", ": "]) if r.random() < 0.5 else ""
            parts += [lead, value]
            known.append((kind, size + len(lead), size + len(lead) + len(value)))
            size += len(lead) + len(value)
            after = r.choice([" ", " ", ". ", ", ", "\n"])
            parts.append(after)
            size += len(after)
        piece = " ".join(words[first:last]) + (" " if last < len(words) or not place else " ")
        parts.append(piece)
        size += len(piece)
    return "".join(parts), known


def examples(text: str, made: Inventor) -> list[tuple[int, list[float], int, float]]:
    """``kind, features, label, weight`` of all proposals and base spans of a planted text."""
    whole, known = planted(text, made)
    sure = {(k, *span) for k in range(4) for span in base_spans(whole)[KINDS[k]]}
    right = {k for k in known if k[0] >= 0}
    found = []
    for kind, start, end in sorted(sure | right | set(proposals(whole))):
        inside = next((k for k in known if k[1] < end and start < k[2]), None)
        if inside is None:
            weight, label = (1.0, 1) if (kind, start, end) in sure else (UNLABELLED, 0)
        elif inside[0] < 0:
            weight, label = 1.0, 0
        else:
            weight, label = 1.0, int((kind, start, end) == inside)
        found.append((kind, features(whole, start, end), label, weight))
    return found


def train(texts: list[str]) -> Model | None:
    """A model of each kind; without texts there is none, and only base spans are found."""
    if not texts:
        return None
    rows: list[list] = [[], [], [], []]
    for at, text in enumerate(texts):
        seed = int.from_bytes(hashlib.sha256(text.encode("utf-8", "replace")).digest()[:8])
        for kind, x, y, w in examples(text, Inventor(seed)):
            rows[kind].append((x, y, w, at % 3 == 2))
    kinds = []
    for found in rows:
        x = np.array([f[0] for f in found], float).reshape(-1, FEATURES)
        y, w = (np.array([f[k] for f in found], float) for k in (1, 2))
        kept = np.array([f[3] for f in found], bool)
        if not 0 < y[~kept].sum() < (~kept).sum() or not 0 < y[kept].sum() < kept.sum():
            kinds.append((Trees(0.0), (1.0, 0.0), math.inf))
            continue
        trees = boost(x[~kept], y[~kept], w[~kept])
        sure = kept & (w == 1)
        scores = trees.scores(x[sure])
        slope, offset = calibrate(scores, y[sure])
        p = 1 / (1 + np.exp(-np.clip(slope * scores + offset, -30, 30)))
        kinds.append((trees, (slope, offset), threshold(p, y[sure], PRECISION)))
    return Model(kinds)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Train on windows of at most ``sample`` different texts, chosen by hash.

    A share of the hashes that holds about the sample is read, so no task orders the corpus; of
    a long text the window's place follows from the hash as well.
    """
    hashed = docs.select("text", F.xxhash64("text").alias("h")).where("text is not null")
    rows = hashed.count()
    if not rows:
        return None
    share = min(1.0, 2.0 * sample / rows)
    start = F.pmod(F.col("h"), F.greatest(F.length("text") - WINDOW, F.lit(1))).cast("int") + 1
    chosen = (
        hashed.where(F.pmod(F.col("h"), F.lit(1 << 32)) < int(share * (1 << 32)))
        .select("h", F.substr("text", start, F.lit(WINDOW)).alias("text"))
        .groupBy("h")
        .agg(F.min("text").alias("text"))
        .orderBy("h")
        .limit(sample)
        .collect()
    )
    return train([r["text"] for r in chosen])


# -- over tables -----------------------------------------------------------------------


def find(text: str, model: Model | None) -> tuple[dict[str, list[Span]], list[tuple]]:
    """Base spans by kind, and all spans ``start, kind, end, probability`` in order.

    Base spans have probability 1. Added ones overlap no other span.
    """
    base = base_spans(text)
    taken = sorted(span for spans in base.values() for span in spans)
    spans = [(s, k, e, 1.0) for k, kind in enumerate(KINDS) for s, e in base[kind]]
    open_spans = sorted(set(proposals(text)), key=lambda c: c[1:]) if model else []
    if open_spans:
        reach, at, free = -1, 0, []
        for kind, start, end in open_spans:
            while at < len(taken) and taken[at][0] < end:
                reach = max(reach, taken[at][1])
                at += 1
            if reach <= start and math.isfinite(model.kinds[kind][2]):
                free.append((kind, start, end))
        judged = []
        for kind in range(4):
            own = [c for c in free if c[0] == kind]
            if own:
                p = model.probabilities(kind, np.array([features(text, s, e) for _, s, e in own], float))
                good = p >= model.kinds[kind][2]
                judged += [(-q, s - e, s, k, e) for (k, s, e), q, ok in zip(own, p.tolist(), good) if ok]
        used: set[int] = set()
        for q, _, start, kind, end in sorted(judged):
            if used.isdisjoint(range(start, end)):
                used.update(range(start, end))
                spans.append((start, kind, end, -q))
    return base, sorted(spans)


def redact(text: str, spans: list[tuple]) -> str:
    """Every span replaced by its kind in brackets; of overlapping ones the first names it."""
    parts, free = [], 0
    for start, kind, end, _ in spans:
        if start >= free:
            parts += [text[free:start], f"[{KINDS[kind].upper()}]"]
        free = max(free, end)
    return "".join([*parts, text[free:]])


def find_personal(docs: DataFrame, model: Model | None, redacted: bool = True) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, numbers of base spans, ``base`` and ``spans``.

    Spans are ``kind, start, end, probability``, by start and kind; ``redacted`` is the text
    without them. One narrow pass; the model, some kilobytes, travels with it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    inner = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                   ("probability", pa.float64())])
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: list[list[int]] = [[], [], [], []]
        bases, spans, texts = [], [], []
        for at in range(batch.num_rows):
            text = batch.column(1)[at].as_py()
            base, found = find(text, sent.value)
            for k, kind in enumerate(KINDS):
                counts[k].append(len(base[kind]))
            named = [{"kind": KINDS[k], "start": s, "end": e, "probability": p} for s, k, e, p in found]
            spans.append(named)
            strict = {(s, k, e) for k, kind in enumerate(KINDS) for s, e in base[kind]}
            bases.append([n for n, f in zip(named, found) if f[:3] in strict])
            texts.append(redact(text, found) if redacted else None)
        columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts)]
        columns += [pa.array(bases, inner), pa.array(spans, inner), pa.array(texts, pa.string())]
        names = ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans", "redacted"]
        return pa.RecordBatch.from_arrays(columns, names)

    key = docs.schema["doc_id"].dataType.simpleString()
    span = "array<struct<kind:string,start:int,end:int,probability:double>>"
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    found = map_blocks(
        docs.select("doc_id", whole_text("text").alias("text")),
        f"doc_id {key}, {counts}, base {span}, spans {span}, redacted string",
        run,
    )
    return found if redacted else found.drop("redacted")
