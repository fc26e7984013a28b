"""Personal data: patterns, and a linear-chain conditional random field that adds to them.

Base spans are the matches of four patterns, found in the whole text. The field sees a text as
tokens between white space. A token's features are its shape (digits, letters, marks), what
kind of number it could be, and a few telling words; a label's score at a token sums weights of
the features of the token and of its two neighbours, and a weight for each pair of adjacent
labels. Weights are trained on a small labelled table by gradient ascent on the likelihood
(forward-backward), and texts are decoded by Viterbi in numpy batches.

A span needs a digit, an '@' or a trigger word, and all other unknown words are one plain token.
The model checks that in a row of six plain tokens the inner ones have the label O on every best
path, whatever stands around them; then the parts between such rows can be decoded for
themselves, and those that can hold a span are, with the same result as decoding whole texts.
Where the check fails, whole texts are decoded.
"""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import col, tidy

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)

# -- base patterns -------------------------------------------------------------------------

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")  # a match never begins inside a run of digits
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local@domain, leftmost first; found from each '@', so in linear time."""
    begin, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > begin and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            begin = m.end()
        at = text.find("@", max(begin, at + 1))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end), by start and then by kind in the order of KINDS."""
    out = [(a, "email", b) for a, b in emails(text)] if "@" in text else []
    if DIGITS.search(text):
        for m in IP.finditer(text):
            if all(int(p) <= 255 for p in m[0].split(".") if len(p) < 10) and all(len(p.lstrip("0")) < 4 for p in m[0].split(".")):
                out.append((m.start(), "ip", m.end()))
        for m in CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 37 and 12 <= len(d := "".join(DIGITS.findall(m[0]))) <= 19 and luhn(d):
                out.append((m.start(), "card", m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), "phone", m.end()))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def joined(spans: Iterable[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


# -- features ------------------------------------------------------------------------------

WORDS = (  # fixed values: the words that the field knows by themselves
    "at", "dot", "tel", "phone", "call", "fax", "mobile", "email", "mail", "contact", "reach", "card", "visa",
    "ip", "host", "server", "order", "page", "version", "year", "invoice", "item", "token", "serial", "com", "org", "net",
)
TRIGGERS = ("dot", "(at)", "[at]", "{at}", "(dot)", "[dot]", "{dot}")  # fixed values: tokens that open a window
SIZES = (0, 1, 2, 3, 4, 6, 8, 11, 15, 19)
PLAIN, EDGE = 0, 1


def shape(token: str) -> str:
    """Digits as 0 (runs of up to four are told apart), letters as a or A (runs as one)."""
    out = re.sub(r"[0-9]+", lambda m: "0" * min(len(m[0]), 5), token)
    out = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() else "a", out)
    return out[:40]


def features(token: str) -> tuple[str, ...]:
    """The names of a token's features; () for a plain one."""
    word = token.strip("()[]{}<>.,;:!?\"'|").lower()
    known = word if word in WORDS else ""
    if not any(c in "0123456789@" for c in token):
        return (f"word {known}", *(["bracket"] if token[0] in "([{" and token.lower() in TRIGGERS else [])) if known else ()
    digits = "".join(DIGITS.findall(token))
    body = token.strip(".,;:!?\"'|")
    out = [f"shape {shape(body)}", f"digits {sum(len(digits) > s for s in SIZES)}"]
    out += [f"word {known}"] if known else []
    out += [n for n, ok in (("mail", "@" in body), ("plus", body.startswith("+")), ("open", body.startswith("(")), ("letters", any(c.isalpha() for c in body)), ("dash", "-" in body), ("points", body.count(".") >= 2)) if ok]
    if 12 <= len(digits) <= 19:
        out.append("luhn" if luhn(digits) else "no luhn")
    return tuple(out)


# -- the labelled table --------------------------------------------------------------------

TEMPLATES = (  # fixed values: what the small labelled table is drawn from; {kind.form} is labelled, {form} is not
    "w w call {phone.local} w w", "tel {phone.local} w", "phone: {phone.local}", "w w {phone.local} w", "fax {phone.grouped} w w",
    "w mobile {phone.grouped} w w", "reach w at {phone.plus} w", "w w {phone.plus} w w w", "contact {phone.grouped} w",
    "w w {email.plain} w w", "email {email.plain}", "mail w w {email.plain} w", "w w {email.spoken} w w", "contact {email.spoken} w", "email {email.spoken}",
    "w w {email.bracket} w", "w {email.bracket} w w", "w host {ip.plain} w", "w w {ip.plain} w w", "server {ip.plain}",
    "w card {card.plain} w", "w w {card.plain} w w", "visa {card.grouped} w", "w w {card.grouped} w",
    "w w {year} w w", "w {count} w w w", "order {serial} w w", "page {count} w", "version {release} w w", "w w {price} w",
    "w {date} w w", "w w {serial} w w", "token = {hex} w", "invoice {badcard} w", "w w {badcard} w w", "w at w w", "w w at {count} w", "w {count} {count} w",
    "w dot w w", "item {count} {serial} w", "w {year} - {year} w", "w com w", "w w w w w", "w {range} w w", "w {measure} w w", "call w w", "w mail w w", "w {count} , {count} w", "w w {date} {clock} w",
)


def draw(form: str, r: random.Random) -> str:
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghinorst") for _ in range(r.randint(3, 8)))

    def card() -> str:
        d = r.choice("3456") + n(14)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def bad() -> str:
        while luhn(d := n(16)):
            pass
        return d

    return {
        "local": lambda: r.choice((f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"({n(3)}) {n(3)} {n(4)}", f"{n(3)}.{n(3)}.{n(4)}")),
        "grouped": lambda: r.choice((f"{n(3)} {n(3)} {n(4)}", f"0{n(2)} {n(3)} {n(4)}", f"0{n(1)} {n(2)} {n(2)} {n(2)} {n(2)}", f"0{n(3)} {n(6)}")),
        "plus": lambda: r.choice((f"+{n(1)} ({n(3)}) {n(3)}-{n(4)}", f"+{n(2)} {n(3)} {n(7)}", f"+{n(11)}", f"+{n(2)}-{n(3)}-{n(3)}-{n(4)}")),
        "plain": lambda: "",
        "spoken": lambda: f"{word()} at {word()} dot {r.choice(('com', 'org', 'net'))}",
        "bracket": lambda: r.choice((f"{word()} (at) {word()} (dot) com", f"{word()} [at] {word()} [dot] org", f"{word()} [at] {word()}.com", f"{word()} (at) {word()}.net")),
        "year": lambda: str(r.randint(1800, 2030)), "count": lambda: n(r.randint(1, 4)).lstrip("0") or "7", "serial": lambda: n(r.randint(5, 11)),
        "release": lambda: f"{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", "price": lambda: r.choice((f"${n(2)}.{n(2)}", f"{n(3)},{n(3)}", f"{n(2)}%")),
        "date": lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", "clock": lambda: f"{r.randint(10, 23)}:{r.randint(10, 59)}", "hex": lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)),
        "badcard": bad, "range": lambda: f"{n(2)}-{n(3)}", "measure": lambda: f"{n(2)}{r.choice(('kg', 'mm', 'px'))}",
        "email": lambda: f"{word()}{r.choice(('', n(2), '.' + word()))}@{word()}.{r.choice(('com', 'org', 'example.com'))}", "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), "card": card,
        "cards": lambda: (lambda d: r.choice(" -").join(d[k : k + 4] for k in range(0, 16, 4)))(card()),
    }[form]()


def labelled_table(each: int = 16, seed: int = 29) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: (tokens, labels) of each sentence, drawn from TEMPLATES."""
    r = random.Random(seed)
    out = []
    for line in TEMPLATES:
        for _ in range(each):
            tokens: list[str] = []
            labels: list[str] = []
            for part in line.split():
                m = re.fullmatch(r"\{(\w+)(?:\.(\w+))?\}", part)
                kind = m[1] if m and m[2] else "O"
                form = m and (m[1] if not m[2] or m[2] == "plain" else "cards" if kind == "card" else m[2])
                words = draw(form, r).split() if m else [part]
                tokens += words
                labels += [kind] * len(words)
            if r.random() < 0.3:
                tokens[-1] += r.choice(".,;")
            out.append((tokens, labels))
    return out


# -- the field -----------------------------------------------------------------------------


class Field:
    """names: feature -> column; own, before, after: feature x label weights for a token, its
    left and its right neighbour; pair: label x label."""

    def __init__(self, names: dict[str, int], own: np.ndarray, before: np.ndarray, after: np.ndarray, pair: np.ndarray):
        self.names, self.own, self.before, self.after, self.pair = names, own, before, after, pair
        self.known: dict[str, int] = {}
        self.scores = [self._scores(["plain"]), self._scores(["edge"])]  # of PLAIN and EDGE: 3 x labels
        self.table = np.stack(self.scores)
        self.local = self._local()

    def _scores(self, found: Iterable[str]) -> np.ndarray:
        at = [self.names[f] for f in found if f in self.names]
        return np.stack([w[at].sum(axis=0) for w in (self.own, self.before, self.after)])

    def class_of(self, token: str) -> int:
        c = self.known.get(token)
        if c is None:
            if len(self.known) > 200_000:
                self.known.clear()
                self.scores = self.scores[:2]
            found = features(token)
            c = PLAIN
            if found:
                c = len(self.scores)
                self.scores.append(self._scores(found))
            self.known[token] = c
        return c

    def _local(self) -> bool:
        """Whether of QUIET plain tokens in a row the third and fourth have the label O on every
        best path, whatever stands around them: all labellings of the second to the fifth are
        compared with O O O O, for all labels of the first and the sixth."""
        plain = self._scores(["plain"]).sum(axis=0)
        margin = plain[0] - plain
        p, k = self.pair, len(LABELS)
        for ls in itertools.product(range(k), repeat=4):
            if ls[1] or ls[2]:
                inner = sum(p[x, y] for x, y in zip(ls, ls[1:])) - sum(margin[x] for x in ls)
                first, last = (p[:, ls[0]] - p[:, 0]).max(), (p[ls[3]] - p[0]).max()
                if first + inner + last > 3 * p[0, 0]:
                    return False
        return True

    def viterbi(self, emit: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Best labels (sequences x longest) for emissions (sequences x longest x labels); each
        sequence stands between two O."""
        n, longest, k = emit.shape
        back = np.zeros((n, longest, k), np.int8)
        best = emit[:, 0] + self.pair[0]
        end = np.zeros(n, np.int64)
        for t in range(longest):
            if t:
                path = best[:, :, None] + self.pair[None]
                back[:, t] = path.argmax(axis=1)
                best = path.max(axis=1) + emit[:, t]
            last = sizes == t + 1
            if last.any():
                end[last] = (best[last] + self.pair[:, 0]).argmax(axis=1)
        out = np.zeros((n, longest), np.int64)
        now = end
        for t in range(longest - 1, -1, -1):
            live = sizes > t
            now = np.where(sizes == t + 1, end, now)
            out[live, t] = now[live]
            if t:
                now = np.where(live, back[np.arange(n), t, now], now)
        return out

    def decode(self, windows: list[list[int]]) -> list[np.ndarray]:
        """windows: classes, with one class of context on each side; labels of what is between."""
        self.table = np.stack(self.scores)
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(windows)
        order = sorted(range(len(windows)), key=lambda i: len(windows[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * len(windows[order[end]]) <= 50_000:
                end += 1
            some = order[at:end]
            sizes = np.array([len(windows[i]) - 2 for i in some])
            cls = np.full((len(some), sizes.max() + 2), EDGE)
            for row, i in enumerate(some):
                cls[row, : len(windows[i])] = windows[i]
            emit = self.table[cls[:, 1:-1], 0] + self.table[cls[:, :-2], 1] + self.table[cls[:, 2:], 2]
            for row, (i, labels) in enumerate(zip(some, self.viterbi(emit, sizes))):
                out[i] = labels[: sizes[row]]
            at = end
        return out


def train(rows: list[tuple[list[str], list[str]]], rounds: int = 120, penalty: float = 2e-3) -> Field:
    """Weights that maximise the mean log-likelihood of the rows less a square penalty (Adam on
    the whole table). Rows without tokens are skipped; labels that are not in LABELS count as O."""
    rows = [r for r in rows if r[0]]
    found = [[features(t) or ("plain",) for t in tokens] for tokens, _ in rows]
    names = {f: k for k, f in enumerate(["plain", "edge", *sorted({f for row in found for fs in row for f in fs} - {"plain"})])}
    n, longest, k = len(rows), max((len(r[0]) for r in rows), default=1), len(LABELS)
    phi = np.zeros((n, longest + 2, len(names)), np.float32)
    phi[:, :, 1] = 1
    gold = np.zeros((n, longest), np.int64)
    mask = np.zeros((n, longest), bool)
    for i, (row, (_, labels)) in enumerate(zip(found, rows)):
        for t, fs in enumerate(row):
            phi[i, t + 1] = 0
            phi[i, t + 1, [names[f] for f in fs]] = 1
            gold[i, t] = LABELS.index(labels[t]) if labels[t] in LABELS else 0
        mask[i, : len(row)] = True
    w = np.zeros((3, len(names), k))
    pair = np.zeros((k, k))
    m, v, step = [np.zeros_like(w), np.zeros_like(pair)], [np.zeros_like(w), np.zeros_like(pair)], 0
    flat = [phi[:, 1:-1].reshape(-1, len(names)), phi[:, :-2].reshape(-1, len(names)), phi[:, 2:].reshape(-1, len(names))]
    sizes = mask.sum(axis=1)
    for _ in range(rounds if n else 0):
        emit = sum(f @ w[j].astype(np.float32) for j, f in enumerate(flat)).reshape(n, longest, k).astype(np.float64)
        a, b = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        lse = lambda x, axis: (top := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - top).sum(axis=axis))
        a[:, 0] = emit[:, 0] + pair[0]
        for t in range(1, longest):
            a[:, t] = np.where(mask[:, t, None], lse(a[:, t - 1, :, None] + pair[None], 1) + emit[:, t], a[:, t - 1])
        for t in range(longest - 1, -1, -1):
            ends = (sizes == t + 1)[:, None]
            nxt = lse((b[:, t + 1] + emit[:, t + 1])[:, None, :] + pair[None], 2) if t + 1 < longest else np.zeros((n, k))
            b[:, t] = np.where(ends, pair[:, 0], np.where(mask[:, t, None], nxt, 0))
        total = lse(a[np.arange(n), sizes - 1] + pair[:, 0], 1)
        p = np.exp(a + b - total[:, None, None]) * mask[:, :, None]
        err = (np.eye(k)[gold] * mask[:, :, None] - p).reshape(-1, k) / n
        g_pair = np.zeros((k, k))
        np.add.at(g_pair, (0, gold[:, 0]), 1.0)
        g_pair[0] -= p[:, 0].sum(axis=0)
        np.add.at(g_pair, (gold[np.arange(n), sizes - 1], 0), 1.0)
        g_pair[:, 0] -= p[np.arange(n), sizes - 1].sum(axis=0)
        for t in range(1, longest):
            on = mask[:, t]
            np.add.at(g_pair, (gold[on, t - 1], gold[on, t]), 1.0)
            both = a[on, t - 1, :, None] + pair[None] + (emit[on, t] + b[on, t])[:, None, :] - total[on, None, None]
            g_pair -= np.exp(both).sum(axis=0)
        grads = [np.stack([f.T @ err for f in flat]) - penalty * w, g_pair / n - penalty * pair]
        step += 1
        for x, g, mm, vv in zip((w, pair), grads, m, v):
            mm += 0.1 * (g - mm)
            vv += 0.01 * (g * g - vv)
            x += 0.15 * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)
    return Field(names, *w, pair)


# -- texts ---------------------------------------------------------------------------------

OPEN = re.compile("[0-9@]|" + "|".join(rf"(?<!\S){re.escape(t)}" for t in TRIGGERS), re.IGNORECASE)
SPACES = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x2028, 0x2029, 0x3000], np.uint32)  # fixed values
QUIET = 6  # plain tokens in a row that part two windows


def tokens_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    solid = ~np.isin(codes, SPACES)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def cores(at: list[int], n: int, look) -> Iterator[tuple[int, int]]:
    """First and last tokens of the parts around the trigger tokens `at` (of n) that QUIET plain
    tokens in a row part from the rest."""

    def quiet(tokens: range) -> int | None:
        """The first token of the first such row in the direction of the range."""
        run = 0
        for t in tokens:
            run = run + 1 if look(t) == PLAIN else 0
            if run == QUIET:
                return t - tokens.step * (QUIET - 1)
        return None

    first = quiet(range(at[0] - 1, -1, -1))
    lo = 0 if first is None else first + 1
    for here, there in zip(at, at[1:]):
        if there - here > QUIET and (end := quiet(range(here + 1, there))) is not None:
            yield lo, end - 1
            lo = quiet(range(there - 1, here, -1)) + 1
    end = quiet(range(at[-1] + 1, n))
    yield lo, n - 1 if end is None else end - 1


def trim(text: str, kind: str, a: int, b: int) -> tuple[int, int] | None:
    """The span without marks around it, or None if it can't be what it is called."""
    while b > a and not text[b - 1].isalnum() and text[b - 1] not in ")]":
        b -= 1
    while a < b and not text[a].isalnum() and text[a] not in "+([":
        a += 1
    body = text[a:b]
    if body.count("(") != body.count(")"):
        a, b = a + (body[:1] == "("), b - (body[-1:] == ")")
    digits = "".join(DIGITS.findall(body))
    ok = {
        "phone": 7 <= len(digits) <= 15 and not any(c.isalpha() for c in body),
        "card": 12 <= len(digits) <= 19 and luhn(digits) and not any(c.isalpha() for c in body),
        "ip": len(p := DIGITS.findall(body)) == 4 and all(len(x) < 4 and int(x) < 256 for x in p),
        "email": bool(re.search(r"@|\bat\b", body, re.I)) and bool(re.search(r"\.|\bdot\b", body, re.I)),
    }[kind]
    return (a, b) if ok and b > a else None


def find_spans(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """For each text its base spans and all spans, each sorted (start, kind, end)."""
    base = [base_spans(t) for t in texts]
    windows: list[list[int]] = []
    where: list[tuple[int, np.ndarray, np.ndarray]] = []
    for i, text in enumerate(texts):
        hits = [m.start() for m in OPEN.finditer(text)] if OPEN.search(text) else []
        if not hits:
            continue
        starts, ends = tokens_of(text)
        at = np.unique(np.searchsorted(starts, hits, side="right") - 1)
        names = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist())] if len(at) * 20 > len(starts) else None
        look = lambda t: field.class_of(names[t] if names else text[starts[t] : ends[t]])
        for lo, hi in cores(at.tolist(), len(starts), look) if field.local else [(0, len(starts) - 1)]:
            lo, hi = max(0, lo - 2), min(len(starts) - 1, hi + 2)
            windows.append([look(t) if 0 <= t < len(starts) else EDGE for t in range(lo - 1, hi + 2)])
            where.append((i, starts[lo : hi + 1], ends[lo : hi + 1]))
    added: list[list] = [[] for _ in texts]
    for (i, starts, ends), labels in zip(where, field.decode(windows)):
        t = 0
        while t < len(labels):
            e = t + 1
            while e < len(labels) and labels[e] == labels[t]:
                e += 1
            if labels[t]:
                kind = LABELS[labels[t]]
                span = trim(texts[i], kind, int(starts[t]), int(ends[e - 1]))
                if span and not any(a < span[1] and span[0] < b for a, _, b in base[i]):
                    added[i].append((span[0], kind, span[1]))
            t = e
    return [(b, sorted(b + a, key=lambda s: (s[0], KINDS.index(s[1])))) for b, a in zip(base, added)]


def redact(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans as one."""
    out, at = [], 0
    for a, kind, b in spans:
        if b > at:
            if a >= at:
                out += [text[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, text_col: str = "text", labelled: list[tuple[list[str], list[str]]] | None = None) -> DataFrame:
    """docs with base_spans and spans (arrays of start, kind, end; code points, end exclusive)
    and redacted (the text with all spans replaced; null where the text is null).

    labelled: (tokens, labels) rows to train on; by default the small table drawn from
    TEMPLATES. Null and empty texts have no spans. Input columns named like the outputs are
    replaced; repeated rows are treated alike; an empty table gives an empty result.
    """
    field = train(labelled_table() if labelled is None else labelled)
    weights = (field.names, field.own, field.before, field.after, field.pair)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    made = ("base_spans", "spans", "redacted")
    keep = [c for c in docs.columns if c not in made]
    rows = docs.select(*[col(c) for c in keep])
    at = keep.index(text_col)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("end", T.LongType())]))
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*shared.value)
        for whole in batches:
            for s in range(0, whole.num_rows, 400):
                b = whole.slice(s, 400)
                texts = b.column(at).to_pylist()
                got = find_spans([t or "" for t in texts], own)
                packed = [pa.array([[{"start": x, "kind": k, "end": y} for x, k, y in g[j]] for g in got], arrow) for j in (0, 1)]
                clean = pa.array([None if t is None else redact(t, g[1]) for t, g in zip(texts, got)], pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns, *packed, clean], names=[*b.schema.names, *made])

    return rows.mapInArrow(tidy(run), T.StructType([*rows.schema.fields, T.StructField("base_spans", span), T.StructField("spans", span), T.StructField("redacted", T.StringType())]))


def span_text(spans: list) -> str:
    return joined((s["start"], s["kind"], s["end"]) for s in spans)


def sha256_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
