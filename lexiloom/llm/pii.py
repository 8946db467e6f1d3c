r"""Personal data by patterns and a linear-chain conditional random field over word shapes.

Base spans come from fixed patterns. A conditional random field adds what they miss: telephone numbers without a plus
sign, spelt-out e-mail addresses, card numbers of 13 to 15 digits, numbers that a greedy pattern ran together. Its
features are a token's shape (kinds of its first and last character, counts of digits, dots and dashes, signs, letters,
words like `at`, `dot` and names of domains) and its neighbours' shapes; it is trained on the small labelled table of
labelled_table() by likelihood, and decoded by Viterbi over many sentences at a time in numpy. Tokens are runs of non-space characters; a sentence ends at a line end or after a word with
. ! or ?, and a longer one than LONGEST is decoded in pieces of LONGEST with CONTEXT tokens around. An added span is
kept only if its number passes its kind's check (count of digits, Luhn, parts of at most 255) and it touches no base
span; whether words are an address or digits a telephone number is for the field alone to say.

Null and empty texts have no spans; rows with equal ids or texts are scanned each for itself; empty tables give empty
results; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm import common
from lexiloom.llm.common import NOT_SPACE, Words

KINDS = ("email", "ip", "card", "phone")
#: O, then B and I of each kind.
STATES = 1 + 2 * len(KINDS)
#: Tokens of a piece of a sentence and around it; steps and sentences of training.
LONGEST, CONTEXT, STEPS, SENTENCES = 192, 24, 120, 700

# --- base patterns ---

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: No match begins inside a run of digits: each of its ends is tried from the run's first one.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str):
    past = 0
    for m in _AT.finditer(text):
        a = m.start()
        while a > past and text[a - 1] in _LOCAL:
            a -= 1
        if a < m.start():
            past = m.end()
            yield a, past


def _ip_ok(found: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in found.split("."))


def base_spans(text: str, at: bool = True, digits: bool = True, plus: bool = True) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)] if at else []
    if digits:
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if _ip_ok(m.group())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                number = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(number) <= 19 and luhn(number):
                    out.append((2, m.start(), m.end()))
        if plus:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m.group())) <= 15]
    return out


# --- shapes ---

_KIND = np.full(256, 3, np.int64)  # other signs
_KIND[[*range(48, 58)]] = 0
_KIND[[*range(97, 123), *range(128, 256)]] = 1
_KIND[[*range(65, 91)]] = 2
for _i, _c in enumerate("+([."):
    _KIND[ord(_c)] = 4 + _i
_DIGITS = np.searchsorted([1, 2, 3, 4, 5, 7, 10, 13, 20], np.arange(64), "right")
#: Sizes of the parts of a shape: digits, first and last character, @, dots, dashes, letters, word.
PARTS = (10, 8, 8, 2, 5, 4, 3, 6)
#: Top-level domains, a class of words to the field.
DOMAINS = ("biz", "com", "co", "de", "edu", "es", "eu", "fr", "gov", "info", "io", "it", "jp", "net", "nl", "org", "pl", "ru", "uk", "us")
#: Words by class: at and dot, each bare or in brackets, and domains with what may follow them.
_SPECIAL = (("at",), ("(at)", "[at]", "{at}"), ("dot",), ("(dot)", "[dot]", "{dot}"), tuple(w + end for d in DOMAINS for w in (d, d.upper()) for end in ("", ".", ",", ";", "!", "?", ")")))


def _special() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of special words in order, and their classes."""
    data, off = common.flat(pa.array([w for group in _SPECIAL for w in group]))
    found = Words(data, off, NOT_SPACE).hash
    order = np.argsort(found)
    return found[order], np.repeat(np.arange(1, len(_SPECIAL) + 1), [len(g) for g in _SPECIAL])[order]


_WORDS, _CLASSES = _special()


def shapes(words: Words, data: np.ndarray) -> np.ndarray:
    """A row of PARTS for each token."""

    def many(flags):
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(flags, out=total[1:])
        return (total[words.end] - total[words.start]).astype(np.int64)

    kind = _KIND[data]
    at = np.minimum(np.searchsorted(_WORDS, words.hash), len(_WORDS) - 1)
    special = np.where(_WORDS[at] == words.hash, _CLASSES[at], 0)
    letters = many((kind == 1) | (kind == 2))
    return np.stack(
        [_DIGITS[np.minimum(many(kind == 0), 63)], kind[words.start], kind[words.end - 1], np.minimum(many(data == 64), 1), np.minimum(many(data == 46), 4), np.minimum(many(data == 45), 3), np.searchsorted([1, 4], letters, "right"), special], axis=1
    )


_RADIX = np.cumprod([1, *PARTS])


def codes(rows: np.ndarray) -> np.ndarray:
    return rows @ _RADIX[:-1]


def _parts(code: np.ndarray) -> np.ndarray:
    return np.stack([code // r % n for r, n in zip(_RADIX, PARTS, strict=False)], axis=1)


# --- the labelled table ---


def labelled_table(sentences: int = SENTENCES) -> list[tuple[list[str], list[int]]]:
    """Tokens and states of made-up sentences, the same in every run."""
    rnd = random.Random(20240401)
    number = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzéüñ") for _ in range(rnd.randint(1, 11)))
    ending = lambda: rnd.choice(["", "", "", ",", ".", ";"])

    def plain() -> list[str]:
        pick = rnd.random()
        if pick < 0.12:
            return [rnd.choice([*DOMAINS, "at", "at", "dot", "(at)", "[dot]"]) + ending()]
        if pick < 0.16:
            # What only looks like an address or a number of a telephone.
            last = rnd.choice([word(), word(), number(rnd.randint(1, 4))])
            return rnd.choice([[*plain(), "at", *plain()], [*plain(), "at", *plain()], [word(), "at", word(), "dot", word() + "x"], [word(), "at", word(), rnd.choice(DOMAINS)], [word(), "dot", rnd.choice(DOMAINS)], [number(rnd.randint(1, 4)) for _ in range(rnd.randint(2, 6))], [number(3), number(3), last], [f"{number(4)}-{number(4)}", number(4)], [f"({number(3)})", last], [rnd.choice(["at", "dot", *DOMAINS])] * rnd.randint(2, 20)])
        if pick < 0.82:
            w = word()
            return [rnd.choice([w, w, w, w.capitalize(), w.upper()]) + ending()]
        return [
            rnd.choice(
                [
                    number(rnd.randint(1, 5)), f"{number(4)}-{number(2)}-{number(2)}", f"{number(1)}.{number(1)}.{number(2)}", f"{number(rnd.randint(1, 3))}.{number(rnd.randint(1, 3))}", f"v{number(1)}.{number(1)}", f"{number(2)}:{number(2)}", f"${number(3)}.{number(2)}", f"{number(2)},{number(3)}", f"{word()}={number(6)}{word()}", word() + number(3),
                    number(rnd.randint(6, 12)), "".join(rnd.choice("0123456789abcdef") for _ in range(40)), "AKIA" + number(4) + "ABCDEFGH" + number(4), f"({number(4)})", f"{number(3)}%", "###", "***", "|", "!!", "--", f"[{number(1)}]", f"{word()}-{word()}", f"{number(1)}/{number(1)}", "at", "dot", "@" + word(), '"' + number(5) + word(),
                ]
            )
            + ending()
        ]

    def entity() -> tuple[int, list[str]]:
        kind = rnd.randrange(4)
        if kind == 0:
            hosts, end = [word() for _ in range(rnd.choice([1, 1, 1, 2]))], rnd.choice(DOMAINS)
            style = rnd.choice([("(at)", "(dot)"), ("[at]", "[dot]"), ("{at}", "{dot}"), ("at", "dot"), ("at", "dot"), None])
            name = word() + rnd.choice(["", number(2), "." + word()])
            if style is None:
                return 0, [f"{name}@{'.'.join(hosts)}.{end}"]
            return 0, [name, style[0], *(x for h in hosts for x in (h, style[1])), end]
        if kind == 1:
            return 1, [".".join(str(rnd.randint(0, 255)) for _ in range(4))]
        if kind == 2:
            groups = rnd.choice([[4, 4, 4, 4], [16], [4, 6, 5], [15]])
            parts = [number(n) for n in groups]
            return 2, ["-".join(parts)] if rnd.random() < 0.3 else parts
        a, b, c = number(3), number(3), number(4)
        return 3, rnd.choice([[f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"{a}.{b}.{c}"], [f"+{number(1)}", f"({a})", f"{b}-{c}"], [f"+{number(2)}", a, b, c], [f"({a})", b, c]])

    out = []
    for _ in range(sentences):
        tokens: list[str] = []
        states: list[int] = []
        for _ in range(rnd.randint(3, 12)):
            if rnd.random() < 0.15:
                kind, own = entity()
                own[-1] += ending()
                tokens += own
                states += [1 + 2 * kind, *[2 + 2 * kind] * (len(own) - 1)]
            else:
                own = plain()
                tokens += own
                states += [0] * len(own)
        out.append((tokens, states))
    return out


# --- the field ---


def _features(code: np.ndarray, seen: np.ndarray | None = None) -> np.ndarray:
    """Columns of a token's own features, for its shape's parts and, for shapes of the table, the whole."""
    rows = _parts(code)
    columns = rows + np.concatenate(([0], np.cumsum(PARTS)[:-1]))
    whole = np.zeros(len(code), np.int64)
    if seen is not None and len(seen):
        at = np.minimum(np.searchsorted(seen, code), len(seen) - 1)
        whole = np.where(seen[at] == code, at + 1, 0)
    return np.column_stack([columns, sum(PARTS) + whole])


class Field:
    """Weights: of features of a token itself, of the one before and of the one after, by state; of state pairs; of first states."""

    def __init__(self, seen: np.ndarray):
        self.seen = seen
        n = sum(PARTS) + len(seen) + 1
        self.own, self.before, self.after = (np.zeros((n, STATES)) for _ in range(3))
        self.pair, self.first = np.zeros((STATES, STATES)), np.zeros(STATES)
        # I of a kind follows only B or I of it.
        self.allowed, self.begin = np.zeros((STATES, STATES)), np.zeros(STATES)
        for s in range(2, STATES, 2):
            self.allowed[:, s] = -1e4
            self.allowed[[s - 1, s], s] = 0
            self.begin[s] = -1e4

    def arrays(self) -> list[np.ndarray]:
        return [self.own, self.before, self.after, self.pair, self.first]

    def emissions(self, code: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Score of each state at each token; starts flags the first tokens of sentences."""
        distinct, which = np.unique(code, return_inverse=True)
        f = _features(distinct, self.seen)
        own, before, after = (w[f].sum(1).astype(np.float32) for w in (self.own, self.before, self.after))
        out = own[which]
        inner = np.flatnonzero(~starts[1:])
        out[inner + 1] += before[which[inner]]
        out[inner] += after[which[inner + 1]]
        return out

    def viterbi(self, scores: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Best states of all tokens; sentences begin at begin and are decoded side by side."""
        out = np.zeros(len(scores), np.int8)
        if not len(size):
            return out
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        trans = (self.pair + self.allowed).astype(np.float32)
        best = scores[begin] + (self.first + self.begin).astype(np.float32)
        final = best.copy()
        back = np.zeros((len(scores), STATES), np.int8)
        active = len(size)
        for t in range(1, int(size[0])):
            active = int(np.searchsorted(-size, -t))
            step = best[:active, :, None] + trans
            at = step.argmax(1)
            best = np.take_along_axis(step, at[:, None, :], 1)[:, 0, :] + scores[begin[:active] + t]
            back[begin[:active] + t] = at
            final[:active] = best
        state = final.argmax(1)
        for t in range(int(size[0]) - 1, -1, -1):
            active = int(np.searchsorted(-size, -t))
            now = state[:active]
            out[begin[:active] + t] = now
            state[:active] = back[begin[:active] + t, now]
        return out


def _lse(x: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """log of the sum of exp(x) over its last axis, or of its product with weight."""
    top = x.max(-1, keepdims=True)
    e = np.exp(x - top)
    with np.errstate(divide="ignore"):
        # States that cannot follow have no weight: -inf.
        return np.log(e.sum(-1)) + top[..., 0] if weight is None else np.log(e @ weight) + top


def fit(table: list[tuple[list[str], list[int]]], steps: int = STEPS) -> Field:
    """Likelihood with a weak quadratic penalty, by Adam; every step takes the whole table."""
    data, off = common.flat(pa.array([" ".join(t) for t, _ in table], pa.string()))
    words = Words(data, off, NOT_SPACE)
    code, state = codes(shapes(words, data)), np.concatenate([s for _, s in table])
    if len(code) != len(state):
        raise ValueError("tokens must have no space inside")
    size, begin = np.diff(words.first), words.first[:-1]
    starts = np.zeros(len(code), bool)
    starts[begin] = True
    field = Field(np.unique(code))
    f = _features(code, field.seen)
    inner = np.flatnonzero(~starts[1:])
    # Features as a matrix, a row for each token of the table.
    has = np.zeros((len(code), len(field.own)))
    has[np.arange(len(code))[:, None], f] = 1
    has_inner, has_next = has[inner], has[inner + 1]
    n, top = len(size), int(size.max())
    place = np.full((n, top), -1)
    for k in range(n):
        place[k, : size[k]] = begin[k] + np.arange(size[k])
    real = place >= 0
    gold_pair, gold_first = np.zeros((STATES, STATES)), np.bincount(state[begin], minlength=STATES)
    np.add.at(gold_pair, (state[inner], state[inner + 1]), 1)
    gold = np.eye(STATES)[state]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in field.arrays()]
    for step in range(1, steps + 1):
        scores = field.own[f].sum(1)
        scores[inner + 1] += field.before[f[inner]].sum(1)
        scores[inner] += field.after[f[inner + 1]].sum(1)
        e = np.where(real[:, :, None], scores[place], 0)
        trans = np.exp(field.pair + field.allowed)
        a, b = np.zeros((n, top, STATES)), np.zeros((n, top, STATES))
        a[:, 0] = e[:, 0] + field.first + field.begin
        for t in range(1, top):
            a[:, t] = np.where(real[:, t, None], _lse(a[:, t - 1], trans) + e[:, t], a[:, t - 1])
        z = _lse(a[:, -1])
        for t in range(top - 2, -1, -1):
            b[:, t] = np.where(real[:, t + 1, None], _lse(e[:, t + 1] + b[:, t + 1], trans.T), 0)
        p = np.exp(a + b - z[:, None, None])
        pair = np.zeros((STATES, STATES))
        for t in range(1, top):
            on = real[:, t]
            from_, to = a[on, t - 1], e[on, t] + b[on, t] - z[on, None]
            most = from_.max(1, keepdims=True)
            pair += trans * (np.exp(from_ - most).T @ np.exp(to + most))
        error = np.zeros_like(gold)
        error[place[real]] = p[real]
        error = gold - error
        grads = [has.T @ error, has_inner.T @ error[inner + 1], has_next.T @ error[inner], gold_pair - pair, gold_first - p[:, 0].sum(0)]
        for w, g, (m, v) in zip(field.arrays(), grads, moments, strict=True):
            g = g - 0.1 * w
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return field


# --- scanning ---


def _checked(kind: int, text: str) -> bool:
    digits = "".join(_DIGIT.findall(text))
    if kind == 0:
        return True
    if kind == 1:
        return len(digits) >= 4 and len(re.findall(r"[0-9]+", text)) == 4 and all(int(x[:9]) <= 255 for x in re.findall(r"[0-9]+", text))
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15


def _sentences(words: Words, data: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """Flags of tokens with which sentences, or pieces of them, begin."""
    n = len(words.hash)
    lines = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data == 10) | (data == 13), out=lines[1:])
    starts = np.zeros(n, bool)
    if n:
        starts[words.first[:-1][np.diff(words.first) > 0]] = True
        last = data[words.end[:-1] - 1]
        stop = ((last == 46) | (last == 33) | (last == 63)) & plain[:-1]
        starts[1:] |= (lines[words.start[1:]] > lines[words.start[:-1]]) | stop
    return starts


def _decoded(field: Field, code: np.ndarray, starts: np.ndarray) -> np.ndarray:
    scores = field.emissions(code, starts)
    begin = np.flatnonzero(starts)
    size = np.diff(np.append(begin, len(code)))
    short = size <= LONGEST
    out = field.viterbi(scores, begin[short], size[short])
    a, b, keep = [], [], []
    for x, n in zip(begin[~short].tolist(), size[~short].tolist(), strict=True):
        for k in range(0, n, LONGEST):
            a.append(max(x, x + k - CONTEXT))
            b.append(min(x + n, x + k + LONGEST + CONTEXT))
            keep.append((x + k, min(x + n, x + k + LONGEST)))
    # Pieces overlap, so each batch of them takes every other one.
    for odd in (0, 1):
        part = slice(odd, None, 2)
        if a[part]:
            made = field.viterbi(scores, np.array(a[part]), np.array(b[part]) - np.array(a[part]))
            for x, y in keep[part]:
                out[x:y] = made[x:y]
    return out


_TRIM = " \t\n\r,;:!?\"'.|"


def scan_slice(field: Field, data: np.ndarray, off: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(base spans, all spans) of each text of a slice; places are code points."""
    words = Words(data, off, NOT_SPACE)
    rows = shapes(words, data)
    code = codes(rows)
    starts = _sentences(words, data, (rows[:, 0] == 0) & (rows[:, 3] == 0) & (rows[:, 7] == 0))
    states = _decoded(field, code, starts)
    marked = np.flatnonzero(states)
    docs_marked: dict[int, list[tuple[int, int, int]]] = {}
    held = None
    for t in marked.tolist():
        s = int(states[t])
        kind = (s - 1) // 2
        if s % 2 == 0 and held and held[0] == kind and held[2] == t - 1:
            held[2] = t
            continue
        held = [kind, t, t]
        doc = int(np.searchsorted(words.first, t, "right")) - 1
        docs_marked.setdefault(doc, []).append(held)
    flags = {}
    for name, byte in (("at", data == 64), ("digits", (data >= 48) & (data <= 57)), ("plus", data == 43)):
        total = np.concatenate(([0], np.cumsum(byte)))
        flags[name] = total[off[1:]] > total[off[:-1]]
    out = []
    for k in range(len(off) - 1):
        at, digits, plus = bool(flags["at"][k]), bool(flags["digits"][k]), bool(flags["plus"][k])
        if not (at or digits or k in docs_marked):
            out.append(([], []))
            continue
        raw = data[off[k] : off[k + 1]].tobytes()
        text = raw.decode()
        base = base_spans(text, at, digits, plus)
        every = list(base)
        for kind, first, last in docs_marked.get(k, ()):
            x, y = int(words.start[first] - off[k]), int(words.end[last] - off[k])
            own = raw[x:y].decode()
            left = len(own) - len(own.lstrip(_TRIM))
            own = own.strip(_TRIM)
            if own.endswith(")") and "(" not in own:
                own = own[:-1]
            start = len(raw[:x].decode()) + left
            if own and _checked(kind, own) and not any(a < start + len(own) and start < b for _, a, b in base):
                every.append((kind, start, start + len(own)))
        out.append((base, sorted(set(every))))
    return out


def told(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, base (spans of the fixed patterns) and spans (all), each as kind:start:end by kind, then start, of each row."""
    common.prepare(docs.sparkSession)
    field = field or fit(labelled_table())

    def run(batches):
        for batch in batches:
            data, off = common.flat(batch.column("text"))
            found = []
            for i, j in common.slices(off):
                found += scan_slice(field, data[off[i] : off[j]], off[i : j + 1] - off[i])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([told(x[0]) for x in found], pa.string()), pa.array([told(x[1]) for x in found], pa.string())], names=["doc_id", "base", "spans"])

    return common.own(docs, "doc_id", "text").mapInArrow(common.task(run), "doc_id long, base string, spans string")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents."""

    def run(batches):
        for batch in batches:
            base = batch.column("base").to_pylist()
            counts = [pa.array([sum(s.startswith(k) for s in x.split(",")) if x else 0 for x in base], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digest, batch.column("spans")], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return scan(common.read(spark, sf_dir, "documents")).mapInArrow(common.task(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
