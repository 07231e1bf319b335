"""Secret scans: patterns, and a linear-chain conditional random field.

The field tags every token of a text as begin, inside or outside of a secret, in
one chain from its first token to its last. Its features are the token's shape,
the tokens before and after it, its chunk (a run without white space) and what
the whole text looks like; weights are learned in numpy from a seeded set of
synthetic lines, so the model is the same in every run. Scores of tokens are sums
of rows of a table by distinct token. Stretches of tokens that no bound on a
path's gain lets be part of a secret are outside in the best path; the stretches
between them are decoded by Viterbi, which is exact.
"""

from __future__ import annotations

import itertools
import random
import re
import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.kernels import arrow_map

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
# Words that name a credential.
NAMES = ("password", "passwd", "pwd", "pass", "secret", "token", "key", "apikey", "api_key", "auth", "bearer", "credential", "credentials", "private", "signature", "passphrase")
BEGIN, INSIDE, OUTSIDE = 0, 1, 2
FEATURE_BITS = 14
#: The feature of a chunk's first token, which is not inside: no secret goes on behind white space.
FIRST = 1 << FEATURE_BITS
#: Tokens before one that may name it, and that may hold a sign of assignment.
NAME_REACH, SIGN_REACH = 5, 3
#: Distinct tokens, and their characters, that a table of scores keeps before it starts anew.
TABLE_TOKENS, TABLE_CHARS = 500_000, 16_000_000

_TOKEN = re.compile(r"[\w+/~.\-]+|\S")
_HEAD = re.compile(r"[A-Za-z]{2,5}(?=[_\-]|[A-Z0-9])")
_NUMBERS = re.compile(r"\d+([.\-/:]\d+)+")
_NAME = re.compile(rf"(?<![a-z])(?:{'|'.join(NAMES)})(?![a-z])|secret|passw|token|apikey|api_key")
_PIECE = re.compile(r"[\w+/~.\-]+|\s+|\S")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, kind and end of the spans of the base patterns."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _shape(token: str) -> list[str]:
    n = len(token)
    if token.isascii() and token.isalpha():
        digits, lower = 0, n if token.islower() else n - 1 if token[1:].islower() else sum(c.islower() for c in token)
        upper = n - lower
    else:
        digits = sum(c.isdigit() for c in token)
        upper = sum(c.isupper() for c in token)
        lower = sum(c.islower() for c in token)
    other = n - digits - upper - lower
    kind = "".join(k for k, v in (("d", digits), ("U", upper), ("l", lower), ("o", other)) if v)
    size = min(6, n.bit_length())
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:], strict=False)) if 0 < digits < n else 0
    out = [f"k={kind}", f"n={size}", f"kn={kind}{size}", f"turns={min(4, turns * 8 // n)}", f"many={min(8, n // 6)}{kind}"]
    if n >= 8:
        out.append(f"distinct={len(set(token)) * 4 // min(n, 32)}{size}")
        out.append(f"digits={digits * 4 // n}{kind}{size}")
    if all(c in "0123456789abcdef" for c in token.lower()):
        out.append(f"hex{size}")
    head = _HEAD.match(token)
    if head:
        out.append(f"head={head[0].lower()}")
    if _NUMBERS.fullmatch(token):
        out.append("numbers")
    if "." in token:
        out.append(f"dots{min(3, token.count('.'))}")
    return out


def document_features(text: str) -> list[str]:
    """What the file looks like: how much of it is assignments and braces."""
    n = max(1, len(text))
    code = sum(text.count(c) for c in "={};")
    return [f"file={min(3, code * 200 // n)}", f"size={min(4, len(text).bit_length() // 4)}"]


def _index(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) & ((1 << FEATURE_BITS) - 1)


def _names(token: str) -> bool:
    """Whether a token names a credential."""
    return _NAME.search(token.lower()) is not None


def _own(own: list[str], named: bool, sign: bool) -> list[str]:
    """Features of a token of shape ``own``."""
    name = f"named={named}{sign}"
    return ["bias", name, *own, *(f"{name}{x}" for x in own[:3])]


def _chunk_features(at: bool, url: bool, pct: bool) -> list[str]:
    return [f"at={at}", f"url={url}", f"pct={pct}"]


def features(tokens: list[str], chunks: list[int], after: str, file: list[str]) -> list[list[int]]:
    """Indices of the features of each token of a text; chunks: the number of each token's chunk."""
    joined: dict[int, str] = {}
    for t, c in zip(tokens, chunks, strict=True):
        joined[c] = joined.get(c, "") + t
    whole = {c: _chunk_features("@" in x, "://" in x, "%" in x) for c, x in joined.items()}
    signs, names = [t.endswith(("=", ":")) for t in tokens], [_names(t) for t in tokens]
    out = []
    for i, token in enumerate(tokens):
        own = _own(_shape(token), any(names[max(0, i - NAME_REACH) : i]), any(signs[max(0, i - SIGN_REACH) : i]))
        next_, same = (tokens[i + 1], chunks[i + 1] == chunks[i]) if i + 1 < len(tokens) else (after, False)
        near = [f"prev={tokens[i - 1].lower()[-12:] if i else ''}", f"p2={tokens[i - 2].lower()[-12:] if i > 1 else ''}", f"next={same}{next_[:3]}"]
        out.append([*([FIRST] if not i or chunks[i - 1] != chunks[i] else []), *(_index(f) for f in (*own, *near, *whole[chunks[i]], *file))])
    return out


class Field:
    """weight: (features, 3); move: (3, 3) from state to state; what is before and after a text is outside."""

    def __init__(self) -> None:
        self.weight = np.zeros((FIRST + 1, 3))
        self.weight[FIRST, INSIDE] = -1e4
        self.move = np.zeros((3, 3))
        self.move[OUTSIDE, INSIDE] = -1e4

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        return np.array([self.weight[r].sum(0) for r in rows])

    def viterbi(self, rows: list[list[int]]) -> list[int]:
        """The best path from outside to outside; of equal paths the one with the lower states."""
        return self.best_path(self.scores(rows))

    def best_path(self, emit: np.ndarray) -> list[int]:
        best = self.move[OUTSIDE] + emit[0]
        back = []
        for e in emit[1:]:
            reach = best[:, None] + self.move
            back.append(reach.argmax(0))
            best = reach.max(0) + e
        state = int((best + self.move[:, OUTSIDE]).argmax())
        path = [state]
        for b in reversed(back):
            state = int(b[state])
            path.append(state)
        return path[::-1]

    def step(self, rows: list[list[int]], tags: list[int], rate: float, squares: tuple[np.ndarray, np.ndarray]) -> None:
        """One AdaGrad step along the gradient of the log likelihood, by forward and backward sums."""
        emit, n = self.scores(rows), len(rows)
        fore, back = np.zeros((n, 3)), np.zeros((n, 3))
        fore[0] = self.move[OUTSIDE] + emit[0]
        for i in range(1, n):
            fore[i] = np.logaddexp.reduce(fore[i - 1][:, None] + self.move, axis=0) + emit[i]
        back[-1] = self.move[:, OUTSIDE]
        for i in range(n - 2, -1, -1):
            back[i] = np.logaddexp.reduce(self.move + emit[i + 1] + back[i + 1], axis=1)
        total = np.logaddexp.reduce(fore[-1] + back[-1])
        state = np.exp(fore + back - total)
        moved = np.zeros((3, 3))
        for i in range(1, n):
            moved -= np.exp(fore[i - 1][:, None] + self.move + emit[i] + back[i] - total)
        moved[OUTSIDE] -= state[0]
        moved[:, OUTSIDE] -= state[-1]
        path = [OUTSIDE, *tags, OUTSIDE]
        for a, b in zip(path, path[1:], strict=False):
            moved[a, b] += 1
        for i, row in enumerate(rows):
            grad = -state[i]
            grad[tags[i]] += 1
            squares[0][row] += grad**2
            self.weight[row] += rate * grad / np.sqrt(squares[0][row] + 1e-6)
        self.weight[FIRST, INSIDE] = -1e4
        squares[1][:] += moved**2
        self.move += rate * moved / np.sqrt(squares[1] + 1e-6)
        self.move[OUTSIDE, INSIDE] = -1e4


def _drawn(rng: random.Random, letters: str, low: int, high: int) -> str:
    return "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))


def synthetic_line(rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """A line of invented words with at most one secret, and where that is."""
    syllables = ["ra", "ti", "on", "en", "the", "er", "le", "in", "ou", "que", "sch", "ción", "es", "and", "ung"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    alnum, b64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    hexa = "0123456789abcdef"
    cased = lambda: (w.title() if (r := rng.random()) < 0.15 else w.upper() if r < 0.18 else w) + (rng.choice([".", ",", ";", ":", "!", "?"]) if rng.random() < 0.12 else "") if (w := word()) else ""
    before, after = [cased() for _ in range(rng.randint(2, 8))], [cased() for _ in range(rng.randint(1, 6))]
    named = ["password", "pwd", "pass", "passphrase", "secret", "client_secret", "token", "access_token", "auth_token", "api-key", "apikey", "API_KEY", "private_key", "credential", "DB_PASS", "aws_secret_access_key", "signing_key", "Authorization: Bearer", "bearer", "key"]
    kind = rng.random()
    start = ""
    if kind < 0.45:
        name = rng.choice(named)
        marked = alnum + "!$%^*#@"
        value = rng.choice([lambda: _drawn(rng, hexa, 10, 40), lambda: _drawn(rng, alnum, 10, 40), lambda: _drawn(rng, b64, 20, 64) + rng.choice(["", "=", "=="]), lambda: _drawn(rng, marked, 9, 20), lambda: _drawn(rng, alnum, 8, 12) + "-" + _drawn(rng, alnum, 8, 12), lambda: _drawn(rng, string.ascii_letters, 10, 28), lambda: _drawn(rng, marked, 5, 8), lambda: "-".join(word() for _ in range(rng.randint(3, 4)))])()
        start = name + rng.choice(["=", ": ", " = ", ":", " is ", " => ", '="', ' = "', ': "', " "])
        tail = '"' if start.endswith('"') else ""
    elif kind < 0.65:
        value = rng.choice(["AKIA", "ASIA"]) + _drawn(rng, string.ascii_uppercase + string.digits, 16, 16) if rng.random() < 0.3 else rng.choice(["ghp_", "gho_", "sk-", "sk_live_", "xoxb-", "glpat-", "npm_", "AIza", "hf_", "SG.", "eyJ"]) + _drawn(rng, alnum, 20, 48)
        tail = ""
    else:
        digits = string.digits
        plain = rng.choice(
            [
                lambda: _drawn(rng, digits, 8, 19),
                lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}",
                lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
                lambda: f"{word()}.{rng.randint(1, 99)}@mail{rng.randint(0, 9)}.example.com",
                lambda: f"https://{word()}.example.com/{word()}/{rng.randint(1, 99999)}?page={rng.randint(1, 99)}",
                lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}:{rng.randint(10, 59)}:00",
                lambda: f"{word()}_{word()}{rng.randint(1, 999)}.py",
                lambda: f"v{rng.randint(1, 20)}.{rng.randint(0, 99)}.{rng.randint(0, 9)}-beta{rng.randint(1, 9)}",
                lambda: f"{word()}{word()}-{rng.randint(1, 2030)}",
                lambda: f"$$${word()}{rng.randint(1, 99)}%%%",
                lambda: "-".join(_drawn(rng, hexa, n, n) for n in (8, 4, 4, 4, 12)),
                lambda: "4" + " ".join(_drawn(rng, digits, 4, 4) for _ in range(4)),
                lambda: f"&#{rng.randint(100, 9999)};&#{rng.randint(100, 9999)};",
                lambda: "".join(rng.choice(digits + "-()") for _ in range(rng.randint(8, 16))),
                lambda: f"{word()},{word()}.{rng.randint(1, 400)}{word()}|{word()}",
                lambda: f"{rng.choice(named)} {rng.choice(['is', 'of', 'and', 'for', 'was', 'to'])} {word()} {word()}",
                lambda: f"{rng.choice(named)}: {word()} {word()}",
                lambda: f"{rng.choice(named)} {word()}, {rng.choice(named)} {word()}",
                lambda: f"{word().title()}{word().title()}",
                lambda: f"{word()}_{word()} = {word()}({word()}.{word()}, {word()}[{rng.randint(0, 99)}])",
                lambda: f'{word()}-{word()}-{word()} "{word()} {word()}" ({word()})',
                lambda: f"{word()}={word()};{word()}: {word().title()}",
                lambda: "".join(rng.choice("日本語の文章を書くабвгдежзиклмнопαβγδε") for _ in range(rng.randint(2, 40))),
                lambda: rng.choice("-=_*.#") * rng.randint(3, 60),
                lambda: " ".join([word().title()] * rng.randint(3, 30)),
                lambda: "! ".join(word().upper() + "!" for _ in range(rng.randint(2, 6))),
            ]
        )()
        lead = [rng.choice(["order", "page", "commit", "id:", "tel", "see", "ref=", "version", "the", word()])] if rng.random() < 0.5 else []
        return " ".join(before + lead + [plain] + after), []
    left = " ".join(before) + " " + start
    return left + value + tail + " " + " ".join(after), [(len(left), len(left) + len(value))]


def _lattices(text: str) -> list[tuple[list[re.Match], list[int], str]]:
    """The text's one lattice: its tokens, the number of each one's chunk and what comes next, which is nothing."""
    tokens = list(_TOKEN.finditer(text))
    if not tokens:
        return []
    gaps = [0, *(int(a.end() != b.start()) for a, b in zip(tokens, tokens[1:], strict=False))]
    return [(tokens, list(itertools.accumulate(gaps)), "")]


def train(lines: int = 2500, epochs: int = 3, seed: int = 11) -> Field:
    """A field of ``lines`` synthetic lines; the same for the same arguments."""
    rng, field = random.Random(seed), Field()
    rows = []
    for _ in range(lines):
        text, secrets = synthetic_line(rng)
        file = document_features(text) if rng.random() < 0.5 else [f"file={rng.randint(0, 1)}", f"size={rng.randint(1, 4)}"]
        for tokens, chunks, after in _lattices(text):
            tags, last = [], OUTSIDE
            for t in tokens:
                own = any(a <= t.start() and t.end() <= b for a, b in secrets)
                last = (INSIDE if last != OUTSIDE else BEGIN) if own else OUTSIDE
                tags.append(last)
            rows.append((features([t[0] for t in tokens], chunks, after, file), tags))
    squares = np.full(field.weight.shape, 0.1), np.full((3, 3), 0.1)
    for epoch in range(epochs):
        for i in rng.sample(range(len(rows)), len(rows)):
            field.step(*rows[i], 0.3 / (1 + epoch), squares)
    return field


class _Ids(dict):
    def __init__(self, add) -> None:
        super().__init__()
        self.add = add

    def __missing__(self, piece: str) -> int:
        return self.add(piece)


class Scores:
    """Scores of the tokens of texts under a field, by a table with a row for each distinct piece of text.

    Scores are those of begin and inside against outside, as the real and the
    imaginary part of a number, so that one look-up finds both. A piece has its
    length, what it says, and where its shape and its first characters stand;
    it adds ``gives`` to the scores of the two tokens after it.
    """

    def __init__(self, field: Field) -> None:
        self.field = field
        self.weight = field.weight[:, BEGIN] - field.weight[:, OUTSIDE] + 1j * (field.weight[:, INSIDE] - field.weight[:, OUTSIDE])
        self.chunk = np.array([self._sum(_chunk_features(bool(k & 4), bool(k & 2), bool(k & 1))) for k in range(8)])
        self.edge = self._sum(["prev="]), self._sum(["p2="]), self._sum(["next=False"])
        move = field.move
        self.within = max(move[BEGIN, BEGIN], move[BEGIN, INSIDE], move[INSIDE, BEGIN], move[INSIDE, INSIDE]) - move[OUTSIDE, OUTSIDE]
        self.around = move[OUTSIDE, BEGIN] + max(move[BEGIN, OUTSIDE], move[INSIDE, OUTSIDE]) - 2 * move[OUTSIDE, OUTSIDE]
        self._clear()

    def _clear(self) -> None:
        self.ids, self.chars = _Ids(self._add), 0
        self.shapes: dict[tuple[str, ...], int] = {}
        self.starts: dict[str, int] = {}
        self.length, self.says, self.shape, self.start = np.zeros(1024, np.int64), np.zeros(1024, np.uint8), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.gives = [np.zeros(1024, complex), np.zeros(1024, complex)]
        self.own, self.next = np.zeros(1024, complex), np.zeros(1024, complex)

    def _sum(self, found: list[str]) -> complex:
        return self.weight[[_index(f) for f in found]].sum()

    def _add(self, piece: str) -> int:
        k = self.ids[piece] = len(self.ids)
        self.chars += len(piece)
        if k == len(self.length):
            self.length, self.says, self.shape, self.start, *self.gives = (np.concatenate([x, np.zeros_like(x)]) for x in (self.length, self.says, self.shape, self.start, *self.gives))
        self.length[k] = len(piece)
        if piece.isspace():
            self.says[k] = 1
            return k
        shape, start, low = tuple(_shape(piece)), piece[:3], piece.lower()[-12:]
        at = self.shapes.get(shape)
        if at is None:
            at = self.shapes[shape] = 4 * len(self.shapes)
            self.own = np.concatenate([self.own, np.zeros_like(self.own)]) if at == len(self.own) else self.own
            self.own[at : at + 4] = [self._sum(_own(list(shape), named, sign)) for named in (False, True) for sign in (False, True)]
        then = self.starts.get(start)
        if then is None:
            then = self.starts[start] = 2 * len(self.starts)
            self.next = np.concatenate([self.next, np.zeros_like(self.next)]) if then == len(self.next) else self.next
            self.next[then : then + 2] = [self._sum([f"next={same}{start}"]) for same in (False, True)]
        self.shape[k], self.start[k] = at, then
        self.gives[0][k], self.gives[1][k] = self.weight[_index(f"prev={low}")], self.weight[_index(f"p2={low}")]
        self.says[k] = 2 * _names(piece) + 4 * piece.endswith(("=", ":")) + 8 * (piece == "@") + 16 * (piece == "%") + 32 * (piece == ":") + 64 * piece.startswith("//")
        return k

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begins, ends and scores of a text's tokens, those of outside being 0."""
        pieces = _PIECE.findall(text)
        if len(self.ids) > TABLE_TOKENS or self.chars > TABLE_CHARS:
            self._clear()
        every = np.array(list(map(self.ids.__getitem__, pieces)), np.int64)
        said = self.says[every]
        at = np.flatnonzero(said != 1)
        n, own, says, length = len(at), every[at], said[at], self.length[every]
        end = np.cumsum(length)[at]
        if not n:
            return end, end, np.zeros((0, 3))
        first = np.ones(n, bool)
        first[1:] = at[1:] - at[:-1] > 1
        which = np.zeros(n, np.int64)
        for flag, reach, value in ((2, NAME_REACH, 2), (4, SIGN_REACH, 1)):
            for k in np.flatnonzero(says & flag).tolist():
                which[k + 1 : k + 1 + reach] |= value
        emit = self.own[self.shape[own] + which] + (self.chunk[0] + sum((self._sum([f]) for f in document_features(text)), 0j))
        if (says & 56).any():
            url = np.zeros(n, bool)
            url[:-1] = (says[:-1] & 32 > 0) & (says[1:] & 64 > 0) & ~first[1:]
            begin, chunk = np.flatnonzero(first), np.cumsum(first) - 1
            kind = sum(np.logical_or.reduceat(x, begin) * v for x, v in ((says & 8 > 0, 4), (url, 2), (says & 16 > 0, 1)))
            emit += (self.chunk - self.chunk[0])[kind[chunk]]
        emit[first] += self.weight[FIRST]
        emit[1:] += self.gives[0][own[:-1]]
        emit[2:] += self.gives[1][own[:-2]]
        emit[:-1] += self.next[self.start[own[1:]] + ~first[1:]]
        emit[0] += self.edge[0]
        emit[:2] += self.edge[1]
        emit[-1] += self.edge[2]
        return end - length[at], end, np.stack([emit.real, emit.imag, np.zeros(n)], 1)

    def stretches(self, emit: np.ndarray) -> list[tuple[int, int]]:
        """Where the best path may leave outside: the tokens of all runs whose bound on the gain is not below none.

        A run of tokens in a secret gains no more than the sum of its bounds and
        ``around``, against the same tokens outside.
        """
        gain = np.maximum(emit[:, BEGIN], emit[:, INSIDE]) - emit[:, OUTSIDE] + self.within
        total = np.concatenate([[0.0], np.cumsum(gain)])
        # The best run that holds a token begins at the least sum before it and ends at the greatest after it.
        best = np.maximum.accumulate(total[:0:-1])[::-1] - np.minimum.accumulate(total[:-1])
        may = np.concatenate([[False], best + self.around - self.within >= -1e-6 - 1e-12 * np.abs(total).max(), [False]])
        edges = np.flatnonzero(may[1:] != may[:-1])
        return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def field_spans(text: str, field: Field | Scores) -> list[tuple[int, int]]:
    """Where the field's best tags put secrets, in code points."""
    scores = field if isinstance(field, Scores) else Scores(field)
    starts, ends, emit = scores.of(text)
    out: list[tuple[int, int]] = []
    for a, b in scores.stretches(emit):
        at = None
        for i, tag in enumerate([*scores.field.best_path(emit[a:b]), OUTSIDE], a):
            if at is not None and tag != INSIDE:
                out.append((at, int(ends[i - 1])))
                at = None
            if tag == BEGIN:
                at = int(starts[i])
    return [(a, a + len(text[a:b].rstrip(".,;\"'") or text[a:b])) for a, b in out]


def scan(text: str | None, field: Field | Scores) -> list[tuple[int, int, int]]:
    """All spans: the base ones, and the field's where they touch no base one; start, kind, end."""
    text = text or ""
    base = base_spans(text)
    added = [(a, 3, b) for a, b in field_spans(text, field) if not any(a < e and s < b for s, _, e in base)]
    return sorted(base + added)


_TRAINED: list[Field] = []


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, spans as array<struct<kind, start, end>>, for each row of ``docs``.

    Null and empty texts have none; repeated rows give repeated rows; other
    columns take no part, whatever their names.
    """
    if not _TRAINED:
        _TRAINED.append(train())
    shipped = docs.sparkSession.sparkContext.broadcast((_TRAINED[0].weight, _TRAINED[0].move))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span))])

    held: list[Scores] = []

    def work(batch: pa.RecordBatch) -> dict:
        if not held:
            field = Field()
            field.weight, field.move = shipped.value
            held.append(Scores(field))
        found = [scan(t, held[0]) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "spans": [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for x in found]}

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(arrow_map(work, schema), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")
