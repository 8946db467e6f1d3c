"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

A word's bytes are read left to right. The tokens of a word are those of which every two neighbours, merged by
themselves, stay as they are; so the last token of what was read so far is the one that ends there and agrees with the
last token of what lies before it, and each position has one token that leads back to an earlier position. What is
still to come can go on from any of the last positions, as many as the longest token has bytes: that is the look-back
that a state holds. Tokens that the ways back from all of these have in common are stable and are emitted. They are
at the latest once as many bytes lie after a token as the merge list's sufficient lookahead has: what follows changes
a token only through a chain of overlapping merges, each of a later rank than the one to its right, so the longest such
chain, times the longest token, bounds it (Berglund and van der Merwe, 2023). So memory doesn't grow with the word.
Every word is read that way, and the last byte, which has symbols of its own, ends it; a worker remembers short words,
bounded in bytes.

Texts are read in pieces that end before white space, with which no token and no normalisation crosses. Decoding turns
ids into bytes and bytes into text by a state machine that holds one unfinished UTF-8 sequence.

Nulls and empty texts have no tokens; rows with equal ids or texts are encoded each for itself; an empty table
gives an empty result; columns other than the named ones aren't read.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import struct
import unicodedata
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm import common

#: Characters of a text that are read at once; bytes of remembered words and of rows that are put out at once.
PIECE, REMEMBERED, OUT = 1 << 20, 64 << 20, 4 << 20
#: Remembered pairs of tokens; bytes of a word between looks for stable tokens.
PAIRS, STEP = 1 << 18, 256
END, NONE = "</w>", 1 << 60

#: White space of the Unicode property, and the characters that str.split also splits at.
_SPACE = "\t-\r \x85\xa0  -     　"
_ODD = regex.compile("[\x1c-\x1f]")
#: Letters that Unicode 16 has beyond Python's tables. The pattern's library takes other unassigned characters for letters, too.
_NEW_LETTERS = ((0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0))
_LETTER = regex.compile(r"\p{L}")


def _no_letter(c: str) -> bool:
    return unicodedata.category(c) == "Cn" and bool(_LETTER.match(c)) and not any(a <= ord(c) <= b for a, b in _NEW_LETTERS)


_CUT = regex.compile(f"[{_SPACE}]")
_BLANKS = regex.compile(f"[{_SPACE}]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def lookahead(merges: list[tuple[str, str]], longest: int) -> int:
    """Bytes after a token that can still change it: the longest chain of merges, each with a later rank than the
    one to its right, whose left part is its right part; times the longest token."""
    best: dict[str, int] = {}
    most = 0
    for left, right in reversed(merges):
        chain = 1 + best.get(left, 0)
        best[right] = max(best.get(right, 0), chain)
        most = max(most, chain)
    return (most + 1) * longest


_ONE = (1,)


def _sizes(tokens: dict[bytes, int]) -> dict[bytes, tuple[int, ...]]:
    out: dict[bytes, set[int]] = {}
    for t in tokens:
        if len(t) > 1:
            out.setdefault(t[-2:], {1}).add(len(t))
    return {k: tuple(sorted(v, reverse=True)) for k, v in out.items()}


class Transducer:
    """Encoder and decoder of one tokenizers file: lower-casing, NFC, words by pattern, byte-level BPE with word ends."""

    def __init__(self, spec: str):
        made = json.loads(spec)
        model = made["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {}
        for r, (a, b) in enumerate(merges):
            if a in self.vocab and b in self.vocab:
                self.rank.setdefault(self.vocab[a] << 20 | self.vocab[b], r << 20 | self.vocab[a + b])
        letters = byte_letters()
        self.inner = [self.vocab.get(c, -1) for c in letters]
        self.final = [self.vocab.get(c + END, -1) for c in letters]
        self.missing = min(self.inner) < 0
        self.lookahead = lookahead(merges, max(len(t.removesuffix(END)) for t in self.vocab))
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.token = [""] * size
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.token[i] = t
        self.text = [t.encode() for t in self.token]
        back = {c: b for b, c in enumerate(letters)}
        names = {*self.special.values()}
        self.raw = [t.encode() if i in names else bytes(back[c] for c in t.removesuffix(END)) + (b" " if t.endswith(END) else b"") for i, t in enumerate(self.token)]
        self.plain_join = made.get("decoder") is None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = 0
        self.agreed: dict[int, bool] = {}
        # Tokens by their bytes, inside a word and at its end; a token that its own merges don't give never comes up.
        self.inside: dict[bytes, int] = {}
        self.ending: dict[bytes, int] = {}
        self.spelling: dict[int, list[int]] = {}
        for t, i in self.vocab.items():
            own = t.removesuffix(END)
            if i in names or not own or any(c not in back for c in own):
                continue
            data = bytes(back[c] for c in own)
            symbols = [self.inner[b] for b in data]
            if own != t:
                symbols[-1] = self.final[data[-1]]
            if min(symbols) >= 0 and self.merged(symbols[:]) == [i]:
                self.spelling[i] = symbols
                (self.inside if own == t else self.ending)[data] = i
        self.longest = max(map(len, self.spelling.values()), default=1)
        #: Lengths of the tokens that end with two bytes, long ones first; of one byte there is always one.
        self.sizes_inside, self.sizes_ending = _sizes(self.inside), _sizes(self.ending)

    # --- encoding ---

    def merged(self, ids: list[int]) -> list[int]:
        """ids with the merge list applied, lowest rank first, leftmost first."""
        rank, low = self.rank.get, (1 << 20) - 1
        found = [rank(a << 20 | b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
        if len(ids) < 200:
            while found and (best := min(found)) != NONE:
                i = found.index(best)
                ids[i] = new = best & low
                del ids[i + 1], found[i]
                if i:
                    found[i - 1] = rank(ids[i - 1] << 20 | new, NONE)
                if i < len(found):
                    found[i] = rank(new << 20 | ids[i + 1], NONE)
            return ids
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i) for i, r in enumerate(found) if r != NONE]
        heapq.heapify(heap)
        found.append(NONE)
        while heap:
            best, i = heapq.heappop(heap)
            if found[i] != best:
                continue
            j = after[i]
            ids[i], ids[j], found[j], after[i] = best & low, -1, NONE, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0:
                    found[x] = rank(ids[x] << 20 | ids[y], NONE) if y >= 0 else NONE
                    if found[x] != NONE:
                        heapq.heappush(heap, (found[x], x))
        return [x for x in ids if x >= 0]

    def agree(self, left: int, right: int) -> bool:
        """Whether two tokens, one after the other, stay as they are."""
        found = self.merged(self.spelling[left] + self.spelling[right]) == [left, right]
        if len(self.agreed) >= PAIRS:
            self.agreed.clear()
        self.agreed[left << 20 | right] = found
        return found

    def word(self, data: bytes) -> list[int]:
        """Tokens of one word, emitted as soon as they are stable. Bytes without a symbol are left out."""
        closing = self.final[data[-1]] >= 0
        data = data[: len(data) - (not closing)]
        if self.missing:
            data = bytes(b for b in data[:-1] if self.inner[b] >= 0) + data[-1:] if closing else bytes(b for b in data if self.inner[b] >= 0)
        whole = len(data)
        out: list[int] = []
        agreed = self.agreed.get
        tokens, sizes = self.inside, self.sizes_inside
        # By position from base on: the last token of what ends there, and where it begins.
        base, last, begins = 0, [-1], [0]
        for end in range(1, whole + 1):
            if end == whole and closing:
                tokens, sizes = self.ending, self.sizes_ending
            for n in sizes.get(data[end - 2 : end] if end > 1 else b"", _ONE):
                begin = end - n
                if begin < base or (token := tokens.get(data[begin:end])) is None:
                    continue
                if not begin:
                    break
                before = last[begin - base]
                found = agreed(before << 20 | token)
                if found or found is None and self.agree(before, token):
                    break
            else:
                raise ValueError("the file's merges don't give one way back")
            last.append(token)
            begins.append(begin)
            if end - base >= STEP + self.longest and not end % STEP:
                stable = self.common_start(begins, base, end)
                out += self.way_back(last, begins, base, stable)
                last, begins, base = last[stable - base :], begins[stable - base :], stable
        return out + self.way_back(last, begins, base, whole)

    def common_start(self, begins: list[int], base: int, end: int) -> int:
        """The last position that the ways back from all of the last positions have in common."""
        ways = set(range(max(base, end - self.longest + 1), end + 1))
        while len(ways) > 1:
            far = max(ways)
            ways.remove(far)
            ways.add(max(base, begins[far - base]))
        return ways.pop()

    @staticmethod
    def way_back(last: list, begins: list[int], base: int, end: int) -> list[int]:
        """Tokens from base to end."""
        out = []
        while end > base:
            out.append(last[end - base])
            end = begins[end - base]
        return out[::-1]

    def chunk(self, text: str) -> bytes:
        """Ids, as little-endian 32-bit integers, of a normalised text without white space."""
        if (out := self.older.get(text)) is not None:
            self.remember(text, out)
            return out
        if not text.isascii() and any(map(_no_letter, text)):
            words = self.odd_words(text)
        else:
            words = self.words.findall(text)
        parts, new = [], False
        for w in words:
            ids = self.known.get(w) if len(w) < len(text) else None
            if ids is None and (ids := self.older.get(w)) is None:
                ids = struct.pack(f"<{len(x := self.word(w.encode()))}I", *x)
                self.remember(w, ids)
                new = True
            parts.append(ids)
        if len(parts) == 1 and len(words[0]) == len(text):
            return parts[0]
        out = b"".join(parts)
        # Of several words together, only those are kept that are all known; most others don't come again.
        if not new:
            self.remember(text, out)
        return out

    def remember(self, word: str, ids: bytes) -> None:
        """Keeps a short word; when too many bytes are kept, those that were not used since the last time go."""
        if len(word) <= 64:
            if self.size >= REMEMBERED // 2:
                self.older, self.known, self.size = self.known, {}, 0
            self.known[word] = ids
            # About what a string, its bytes and their entry take.
            self.size += 200 + len(word) + len(ids)

    def odd_words(self, text: str) -> list[str]:
        """Words of a text with unassigned characters, which are no letters; the pattern's library takes some for letters."""
        letters = "".join("\0" if _no_letter(c) else c for c in text)
        return [text[m.start() : m.end()] for m in self.words.finditer(letters)]

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        chunk = self.chunk
        if _ODD.search(text):
            parts = [x for x in _BLANKS.split(text) if x]
        else:
            parts = text.split()
        out = []
        # chunk() may put a new table in the place of known.
        for w in parts:
            x = self.known.get(w)
            out.append(chunk(w) if x is None else x)
        return b"".join(out)

    def encode(self, text: str):
        """Ids of text, as bytes, piece by piece."""
        at, n = 0, len(text)
        while at < n:
            end = n
            if n - at > PIECE:
                found = _CUT.search(text, at + PIECE)
                end = found.start() if found else n
            piece = text[at:end] if at or end < n else text
            if self.split and "<" in piece:
                for i, part in enumerate(self.split.split(piece)):
                    if i % 2:
                        yield self.special[part].to_bytes(4, "little")
                    elif part:
                        yield self.plain(part)
            else:
                yield self.plain(piece)
            at = end

    # --- decoding ---

    def decoder(self) -> Decoder:
        return Decoder(self)


class Decoder:
    """Incremental decoder: feed() takes ids in any portions, as bytes, and returns text.

    Each token gives bytes: of a file without a decoder its vocabulary string, after a blank if it isn't the first one;
    of others its own bytes, with a blank for a word's end. The bytes go through a state machine of UTF-8, which holds
    an unfinished sequence back until it is complete; wrong ones give U+FFFD.
    """

    def __init__(self, made: Transducer, plain: bool | None = None):
        self.made, self.plain, self.begun = made, made.plain_join if plain is None else plain, False
        self.state = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids: bytes, last: bool = False) -> str:
        numbers = array("I", ids)
        if self.plain:
            out = b" ".join(map(self.made.text.__getitem__, numbers))
            if self.begun and numbers:
                out = b" " + out
            self.begun |= bool(numbers)
        else:
            out = b"".join(map(self.made.raw.__getitem__, numbers))
        return self.state.decode(out, last)


_LOADED: dict[int, Transducer] = {}


def load(spec: str) -> Transducer:
    """The transducer of a file's content, made once in a process."""
    key = hash(spec)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Transducer(spec)
    return _LOADED[key]


def path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def spec(file: str | None = None) -> str:
    """Content of a tokenizers file; it is read on the driver and travels to the workers with the task (some MB)."""
    with open(file or path(), encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, file: str | None = None, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian 32-bit) and decoded (string) of each row's whole text.

    digests=True gives ids_sha256 and decoded_sha256 in place of ids and decoded, without keeping either.
    """
    common.prepare(docs.sparkSession)
    content = spec(file)

    def run(batches):
        made = load(content)
        for batch in batches:
            begin, size, counts, first, second = 0, 0, [], [], []
            for at, text in enumerate(batch.column(1)):
                decoder, n = made.decoder(), 0
                a, b = (hashlib.sha256(), hashlib.sha256()) if digests else ([], [])
                add_a, add_b = (a.update, lambda t, b=b: b.update(t.encode())) if digests else (a.append, b.append)
                for ids in made.encode(text.as_py() or ""):
                    n += len(ids) // 4
                    add_a(ids)
                    add_b(decoder.feed(ids))
                add_b(decoder.feed(b"", last=True))
                counts.append(n)
                first.append(a.hexdigest() if digests else b"".join(a))
                second.append(b.hexdigest() if digests else "".join(b))
                size += len(first[-1]) + len(second[-1])
                # Rows of long texts leave before the others of their batch are done.
                if size >= OUT or at + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0)[begin : at + 1], pa.array(counts, pa.int64()), pa.array(first, pa.string() if digests else pa.binary()), pa.array(second, pa.string())], names=names)
                    begin, size, counts, first, second = at + 1, 0, [], [], []

    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    kinds = ["long", "long", "string" if digests else "binary", "string"]
    return common.own(docs, "doc_id", "text").mapInArrow(common.task(run), ", ".join(f"{a} {b}" for a, b in zip(names, kinds, strict=True)))


def op9_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and digests of every whole text of documents."""
    return encode(common.read(spark, sf_dir, "documents"), digests=True)
