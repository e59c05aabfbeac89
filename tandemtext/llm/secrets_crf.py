"""Secrets in text: tokens tagged begin, inside or outside by a linear-chain conditional random field."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tandemtext.llm.common import chunks, packed, table, unpacked

OUTSIDE, BEGIN, INSIDE = 0, 1, 2
TOKENS = re.compile(r"[\w+/\-]+(?:\.[\w+/\-]+)*|[^\w\s+/\-]")
REDACTED = "[SECRET]"
#: Training sentences, passes over them and seed; the model is trained on made-up lines and needs no corpus. Its weights are
#: in WEIGHTS; `python -m tandemtext.llm.secrets_crf` trains and writes them again.
SENTENCES, STEPS, SEED = 1600, 160, 11
WEIGHTS = Path(__file__).with_name("secrets_weights.json")
#: Neighbouring words that a token's tag looks at: so many before and after it.
BEFORE, AFTER = 3, 1

_NAMES = frozenset("token secret password passwd pwd key apikey api_key api-key access_key secret_key access_token auth_token client_secret auth authorization bearer credential credentials private_key signing_key session_token pass passphrase".split())
_PARTS = re.compile(r"[_.\-]+")
_PREFIXES = ("//hooks.", "//discord.com/api/webhooks", "akia", "asia", "ghp_", "gho_", "github_pat_", "glpat-", "sk-", "sk_live", "sk_test", "pk_live", "xoxb-", "xoxp-", "eyj", "aiza", "npm_", "hf_", "ya29")
_HEX = re.compile(r"[0-9a-fA-F]+\Z")


def _entropy(word: str) -> float:
    n = len(word)
    return -sum(c / n * math.log2(c / n) for c in (word.count(x) for x in set(word)))


@lru_cache(maxsize=100_000)
def name_in(word: str) -> str | None:
    """The name of a secret that a word is, or ends or begins with before or after _ . or -, as db_password or TOKEN-2; or null."""
    low = word.lower()
    if low in _NAMES:
        return low
    if len(low) > 40 or word.isalpha():
        return None
    parts = [p for p in _PARTS.split(low) if p]
    return next((p for p in (parts[-1:] + parts[:1]) if p in _NAMES), None) if len(parts) > 1 else None


def word_features(word: str) -> tuple[str, ...]:
    """What a tag sees of its own token: shape, length, alphabet, randomness and known beginnings."""
    n = len(word)
    if n < 16 and word.isalpha():
        low = word.lower()
        return ("name=" + low,) if low in _NAMES else ("letters",)
    if n == 1:
        return ("mark=" + word if word in "=:\"'`{}[](),;<>#$%&*!@|" else "mark",)
    low = word.lower()
    out = ["name part"] if name_in(word) else []
    digits = sum(c.isdigit() for c in word)
    upper, lower = any(c.isupper() for c in word), any(c.islower() for c in word)
    size = min(n // 4, 12)
    kind = ("d" if digits else "") + ("u" if upper else "") + ("l" if lower else "") + ("m" if not word.isalnum() else "")
    out += [f"kind={kind}", f"size={size}", f"kind={kind} size={size}"]
    if digits and _HEX.match(word) and digits < n:
        out.append(f"hex size={size}")
    if n >= 12:
        out.append(f"random={int(2 * _entropy(word))} {kind}")
        out.append(f"digits={4 * digits // n} {kind}")
    out += ["prefix=" + p for p in _PREFIXES if low.startswith(p)]
    if word.startswith("-----"):
        out.append("dashes")
    return tuple(out)


def neighbour_features(word: str) -> tuple[str, ...]:
    """What a tag sees of a token near it."""
    name = name_in(word)
    if name:
        return ("a name", "name=" + name)
    if len(word) == 1 and not word.isalnum():
        return ("mark=" + word,)
    if word.startswith("//"):
        return ("slashes",)
    if word.isalpha() and len(word) < 16:
        return ("letters",)
    return ("long",) if len(word) >= 16 else ("other",)


def file_feature(n_tokens: int, n_names: int, n_code: int) -> str:
    """What all tags see of their text: whether a secret's name occurs and how many tokens are marks of code."""
    share = n_code / max(1, n_tokens)
    return f"names={min(n_names, 1)} code={0 if share == 0 else 1 if share < 0.02 else 2 if share < 0.1 else 3}"


def _is_name(word: str) -> bool:
    return name_in(word) is not None


def _is_code(word: str) -> bool:
    return len(word) == 1 and word in "={}:;\"'"


def training_lines(n: int = SENTENCES, seed: int = SEED) -> list[tuple[list[str], list[int]]]:
    """Made-up token lists with their tags: assignments, headers and key blocks, and what only resembles them."""
    rnd = random.Random(seed)
    hexa, alnum, b64 = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    some = lambda chars, k: "".join(rnd.choice(chars) for _ in range(k))
    syllables = "an the er on in re th or es ti en ed ou ea le la de ment que ung ich ción ado ä é".split()

    def words(k: int) -> list[str]:
        out = []
        for _ in range(k):
            w = "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 5)))
            w = w.capitalize() if rnd.random() < 0.15 else w.upper() if rnd.random() < 0.05 else w
            out.append(w)
            if rnd.random() < 0.15:
                out.append(rnd.choice(",,....;:!?()#$%&*|\"'"))
        return out

    def person() -> list[str]:
        """A password that a person makes up, as tokens."""
        word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(2, 3)))
        leet = lambda w: "".join({"a": "4", "e": "3", "o": "0", "i": "1", "t": "7"}.get(c, c) if rnd.random() < 0.5 else c for c in w)
        k = rnd.randrange(8)
        if k <= 1:
            return [word() + some("0123456789", rnd.randint(1, 4)) + (word() if rnd.random() < 0.3 else "")]
        if k == 2:
            return [word().capitalize() + some("0123456789", rnd.randint(2, 4)), rnd.choice("!?$*#")]
        if k == 3:
            return [leet(word()).capitalize() + some("0123456789", 1), rnd.choice("&@!$#%"), some("0123456789", rnd.randint(1, 3))]
        if k == 4:
            return [leet(word()) + some("0123456789", 1), "@", leet(word())]
        if k == 5:
            return ["-".join(word() for _ in range(rnd.randint(3, 4)))]
        if k == 6:
            return [some("abcdefghijklmnopqrstuvwxyz", rnd.randint(3, 6)) + some("0123456789", rnd.randint(2, 6))]
        return ["A" + some(alnum, rnd.randint(6, 12)) + some("0123456789", 1)]

    def value() -> list[str]:
        k = rnd.randrange(9)
        if k == 0 or k == 7:
            s = some(hexa, rnd.choice((32, 40, 40, 48, 64)))
        elif k == 1:
            s = "AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)
        elif k == 2:
            s = rnd.choice(("ghp_", "gho_", "npm_", "hf_")) + some(alnum, 36)
        elif k == 3:
            s = rnd.choice(("sk-", "sk_live_", "xoxb-", "glpat-")) + some(alnum, rnd.choice((20, 24, 48)))
        elif k == 4:
            return [f"eyJ{some(alnum, 18)}.eyJ{some(alnum, 30)}.{some(alnum, 43)}"]
        elif k == 5:
            return [some(b64, rnd.choice((22, 24, 32, 40, 43, 44, 86))), *rnd.choice(("", "=", "=="))]
        else:
            s = some(alnum, rnd.choice((16, 20, 24, 32, 40)))
        return [s.upper() if k in (0, 7) and rnd.random() < 0.3 else s]

    def tagged(v: list[str]) -> list[tuple[str, int]]:
        return [(w, BEGIN if i == 0 else INSIDE) for i, w in enumerate(v)]

    def plain(v: list[str]) -> list[tuple[str, int]]:
        return [(w, OUTSIDE) for w in v]

    def secret() -> list[tuple[str, int]]:
        k, name = rnd.randrange(13), rnd.choice(sorted(_NAMES))
        name = rnd.choice(("", "", "", "db_", "my_", "app-", "smtp.", "aws_")) + name + rnd.choice(("", "", "", "", "_2"))
        name = name.upper() if rnd.random() < 0.3 else name
        v = value()
        if k == 8:
            return plain([name, rnd.choice("=:"), q := rnd.choice("\"'")]) + tagged(person()) + plain([q])
        if k <= 10 and k > 8:
            return plain([rnd.choice(("password", "passwd", "pwd", "pass", "db_password", "DB_PASS", "PASSWORD", "passphrase", "secret", "user_pwd")), rnd.choice("=:")]) + tagged([w for w in person() if len(w) > 1])[:1]
        if k == 11:
            return plain([rnd.choice(("postgres", "mysql", "https", "amqp", "redis", "ftp", "mongodb")), ":", "//" + rnd.choice(("admin", "root", "user", "app", "joe", words(1)[0])), ":"]) + tagged(rnd.choice((v[:1], [w for w in person() if len(w) > 1][:1]))) + plain(["@", rnd.choice(("db", "localhost", "db.example.com/app", "10.0.0.1", "host.internal")), *rnd.choice(([], [":", "5432"]))])
        if k == 12:
            return plain(["https", ":"]) + tagged([f"//hooks.{rnd.choice(('slack.com', 'example.com', 'chat.example.org'))}/services/T{some(alnum, 8).upper()}/B{some(alnum, 8).upper()}/{some(alnum, 24)}"])
        if k <= 2:
            q = rnd.choice(('"', '"', "'", "`"))
            return plain([name, rnd.choice("=:="), q]) + tagged(v) + plain([q])
        if k <= 4:
            return plain([name, rnd.choice("=:")]) + tagged(v)
        if k == 5:
            return plain(["Authorization", ":", "Bearer"]) + tagged(v)
        if k == 6:
            body = [w for _ in range(rnd.randint(2, 4)) for w in [some(b64, 64)]]
            return tagged(["-----BEGIN", "RSA", "PRIVATE", "KEY-----", *body, "-----END", "RSA", "PRIVATE", "KEY-----"])
        v = [rnd.choice(("AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), "ghp_" + some(alnum, 36), "sk_live_" + some(alnum, 24)))]
        return tagged(v)

    def decoy() -> list[tuple[str, int]]:
        k = rnd.randrange(18)
        num = lambda c: some("0123456789", c)
        if k == 0:
            v = [num(16)]
        elif k == 1:
            v = ["+1", "(", num(3), ")", f"{num(3)}-{num(4)}"]
        elif k == 2:
            v = [".".join(str(rnd.randint(1, 255)) for _ in range(4))]
        elif k == 3:
            v = [f"{words(1)[0]}.{num(2)}", "@", f"mail{rnd.randint(1, 9)}.example.com"]
        elif k == 4:
            v = ["http", ":", f"//www.{some('abcdefghij', 8)}.example.org/{some('abcdefghij', 6)}/{num(5)}"]
        elif k == 5:
            v = ["commit", some(hexa, rnd.choice((7, 8, 12, 40)))]
        elif k == 6:
            v = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(8, 14)))]
        elif k == 7:
            v = [rnd.choice(sorted(_NAMES)), rnd.choice("=:"), rnd.choice(("none", "true", "null", "yes", "x"))]
        elif k == 8:
            v = ["the", rnd.choice(("secret", "key", "password", "token")), "of", *words(2)]
        elif k == 9:
            v = ["isbn", f"{num(3)}-{num(1)}-{num(4)}-{num(4)}-{num(1)}"]
        elif k == 10:
            v = ["version", f"{num(1)}.{num(2)}.{num(1)}", "CC", "BY-NC", "4.0", "."]
        elif k == 11:
            v = ["id", "=", '"', num(rnd.choice((6, 9, 12))), '"']
        elif k == 13:
            v = [rnd.choice(sorted(_NAMES)), ":", *words(rnd.randint(1, 3))]
        elif k == 14:
            v = [rnd.choice(("user", "name", "port", "host", "login", "chapter", "file", "ref", "room")), rnd.choice("=:"), *rnd.choice(([], ['"'])), *person()[:1]]
        elif k == 15:
            v = [rnd.choice(("http", "https", "ftp")), ":", f"//{words(1)[0].lower()}.example.org", ":", num(4)]
        elif k == 16:
            v = [num(2), ":", num(2), rnd.choice(("h", "Uhr", "pm")), ",", person()[0], *words(1)]
        elif k == 17:
            v = ["contact", "@" + words(1)[0].lower() + num(2), "or", f"//{words(1)[0].lower()}.example.org/{words(1)[0].lower()}-{num(3)}"]
        else:
            v = ["sha256", ":", some(hexa, 64)]
        return plain(v)

    out = []
    for _ in range(n):
        line = plain(words(rnd.randint(2, 12)))
        for _ in range(rnd.randint(0, 3)):
            line += (secret() if rnd.random() < 0.5 else decoy()) + plain(words(rnd.randint(1, 8)))
        out.append(([w for w, _ in line], [t for _, t in line]))
    return out


class Model:
    """Weights of a trained field: for each place (own, neighbours, file) a dict from feature to three scores, and transitions."""

    def __init__(self, scores: dict[str, dict[str, np.ndarray]], moves: np.ndarray, start: np.ndarray) -> None:
        self.scores, self.moves, self.start = scores, moves, start
        self.id = uuid.uuid4().hex

    def sum(self, place: str, features: tuple[str, ...]) -> np.ndarray:
        known = self.scores[place]
        return sum((known[f] for f in features if f in known), np.zeros(3))


def _places(words: list[str]) -> list[tuple[str, tuple[str, ...], int]]:
    """(place, features, token) for all that the tags of a token list see."""
    n = len(words)
    out = [("own", word_features(w), i) for i, w in enumerate(words)]
    near = [neighbour_features(w) for w in words]
    for d in [*range(-BEFORE, 0), *range(1, AFTER + 1)]:
        out += [(f"at{d:+d}", near[i + d] if 0 <= i + d < n else ("edge",), i) for i in range(n)]
    f = (file_feature(n, sum(map(_is_name, words)), sum(map(_is_code, words))),)
    return out + [("file", f, i) for i in range(n)]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


class Likelihood:
    """The penalised log likelihood of tagged lines, with its exact gradient by the forward-backward recursion over all lines at once."""

    PENALTY = 0.05

    def __init__(self, lines: list[tuple[list[str], list[int]]]) -> None:
        self.n, self.longest = len(lines), max(len(w) for w, _ in lines)
        n, longest = self.n, self.longest
        self.index: dict[tuple[str, str], int] = {}
        rows, feats = [], []
        tags = np.zeros((n, longest), np.int64)
        self.mask = mask = np.zeros((n, longest), bool)
        for k, (words, t) in enumerate(lines):
            tags[k, : len(t)], mask[k, : len(t)] = t, True
            for place, features, i in _places(words):
                for f in features:
                    rows.append(k * longest + i)
                    feats.append(self.index.setdefault((place, f), len(self.index)))
        self.rows, self.feats, self.size = np.array(rows), np.array(feats), len(self.index)
        self.gold = np.zeros((n * longest, 3))
        self.gold[np.flatnonzero(mask.ravel()), tags.ravel()[mask.ravel()]] = 1
        self.both = mask[:, 1:] & mask[:, :-1]
        self.gold_moves = np.zeros((3, 3))
        np.add.at(self.gold_moves, (tags[:, :-1][self.both], tags[:, 1:][self.both]), 1)
        self.gold_start = np.bincount(tags[:, 0], minlength=3).astype(float)

    def __call__(self, w: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[float, list[np.ndarray]]:
        n, longest, mask, both, rows, feats = self.n, self.longest, self.mask, self.both, self.rows, self.feats
        flat = np.stack([np.bincount(rows, w[feats, y], n * longest) for y in range(3)], 1)
        e = flat.reshape(n, longest, 3)
        fw, bw = np.empty_like(e), np.zeros_like(e)
        fw[:, 0] = e[:, 0] + start
        for i in range(1, longest):
            go = e[:, i] + _logsum(fw[:, i - 1, :, None] + moves, 1)
            fw[:, i] = np.where(mask[:, i, None], go, fw[:, i - 1])
        total = _logsum(fw[:, -1], 1)
        for i in range(longest - 2, -1, -1):
            back = _logsum(moves + (e[:, i + 1] + bw[:, i + 1])[:, None, :], 2)
            bw[:, i] = np.where(mask[:, i + 1, None], back, 0)
        p = np.exp(fw + bw - total[:, None, None]) * mask[:, :, None]
        pair = np.exp(fw[:, :-1, :, None] + moves + (e[:, 1:] + bw[:, 1:])[:, :, None, :] - total[:, None, None, None]) * both[:, :, None, None]
        d = self.gold - p.reshape(-1, 3)
        value = (flat * self.gold).sum() + (self.gold_moves * moves).sum() + (self.gold_start * start).sum() - total.sum() - self.PENALTY / 2 * ((w * w).sum() + (moves * moves).sum())
        return float(value), [np.stack([np.bincount(feats, d[rows, y], self.size) for y in range(3)], 1) - self.PENALTY * w, self.gold_moves - pair.sum((0, 1)) - self.PENALTY * moves, self.gold_start - p[:, 0].sum(0)]


def train(n: int = SENTENCES, steps: int = STEPS, seed: int = SEED) -> Model:
    """The field that makes the tags of the training lines most likely, with a small quadratic penalty: exact gradients, followed by Adam."""
    objective = Likelihood(training_lines(n, seed))
    w, moves, start = np.zeros((objective.size, 3)), np.zeros((3, 3)), np.zeros(3)
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, moves, start)]
    for step in range(1, steps + 1):
        _, grads = objective(w, moves, start)
        for x, g, (m, v) in zip((w, moves, start), grads, state, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    scores: dict[str, dict[str, np.ndarray]] = {}
    for (place, f), i in objective.index.items():
        scores.setdefault(place, {})[f] = w[i].copy()
    return Model(scores, moves, start)


@lru_cache(maxsize=1)
def trained() -> Model:
    """The field as `train` makes it, read from WEIGHTS."""
    got = json.loads(WEIGHTS.read_text())
    return Model({place: {f: np.array(x) for f, x in own.items()} for place, own in got["scores"].items()}, np.array(got["moves"]), np.array(got["start"]))


def write_weights(path: Path = WEIGHTS) -> None:
    m = train()
    short = lambda x: [round(float(v), 4) for v in x]
    rows = {"scores": {place: {f: short(x) for f, x in sorted(own.items())} for place, own in sorted(m.scores.items())}, "moves": [short(x) for x in m.moves], "start": short(m.start)}
    path.write_text(json.dumps(rows, ensure_ascii=False, indent=0).replace(",\n", ",").replace("[\n", "[").replace("\n]", "]"))


def viterbi(e: np.ndarray, moves: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[int]:
    """The tags of the best path through scores `e`; `first` and `last` are added at the ends. Ties go to the lower tag."""
    best, back = e[0] + first, []
    for x in e[1:]:
        through = best[:, None] + moves
        back.append(through.argmax(0))
        best = through.max(0) + x
    y = int((best + last).argmax())
    path = [y]
    for b in reversed(back):
        y = int(b[y])
        path.append(y)
    return path[::-1]


class Tagger:
    """Tags whole token lists; tokens alike in all that is seen of them share one row of score tables."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.classes: dict[tuple, int] = {}
        self.words: dict[str, int] = {}
        self.shifts = [d for d in range(-BEFORE, AFTER + 1) if d]
        self.tables = np.zeros((0, 1 + len(self.shifts), 3))
        self.flags = np.zeros((0, 2), bool)
        self._rows, self._flag_rows = [], []
        self.edge = self._class(("edge",), (), ("edge",), False, False)
        self.plain = self.class_of("word")
        m, start = model.moves, model.start
        #: What a stretch of secret tokens gains by transitions over outside tokens: at most `inner` a token, and `ends` once.
        self.inner = m[1:, 1:].max() - m[0, 0]
        self.ends = max(m[0, 1:].max() - m[0, 0], start[1:].max() - start[0]) + max(m[1:, 0].max() - m[0, 0], 0.0) - self.inner

    def _class(self, key: tuple, own: tuple, near: tuple, name: bool, code: bool) -> int:
        c = self.classes.get(key)
        if c is None:
            c = self.classes[key] = len(self._rows)
            self._rows.append([self.model.sum("own", own), *[self.model.sum(f"at{d:+d}", near) for d in self.shifts]])
            self._flag_rows.append((name, code))
        return c

    def class_of(self, word: str) -> int:
        c = self.words.get(word)
        if c is None:
            if len(self.words) > 400_000:
                self.words.clear()
            own, near, name, code = word_features(word), neighbour_features(word), _is_name(word), _is_code(word)
            c = self.words[word] = self._class((own, near, name, code), own, near, name, code)
        return c

    def scores(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all tokens of several texts, and where each text begins; texts are set apart by edges."""
        gap = [self.edge] * max(BEFORE, AFTER)
        codes, begin = list(gap), []
        plain, of = self.plain, self.class_of
        for ws in words:
            begin.append(len(codes))
            codes += [plain if w.isalpha() and len(w) < 16 and w.lower() not in _NAMES else of(w) for w in ws]
            codes += gap
        if len(self._rows) > len(self.tables):
            self.tables, self.flags = np.array(self._rows), np.array(self._flag_rows)
        x = np.array(codes)
        sizes = np.array([len(ws) for ws in words])
        starts = np.array(begin)
        e = self.tables[x, 0]
        for k, d in enumerate(self.shifts, 1):
            e += self.tables[np.roll(x, -d), k]
        counts = np.cumsum(np.r_[np.zeros((1, 2), np.int64), self.flags[x]], axis=0)
        for s, n in zip(starts, sizes, strict=True):
            names, code = counts[s + n] - counts[s]
            e[s : s + n] += self.model.sum("file", (file_feature(int(n), int(names), int(code)),))
        return e, starts

    def tag(self, words: list[list[str]]) -> list[list[tuple[int, int]]]:
        """For each text the (first, last) tokens of its secrets, as the best path has them.

        A stretch of tokens that the best path has inside secrets must beat the same stretch outside. The most that
        any stretch around a token can gain follows from running sums; where that is negative, the token is outside on the
        best path. So the path is found exactly by decoding only what lies between such tokens.
        """
        if not words:
            return []
        e, starts = self.scores(words)
        gain = self.inner + np.maximum(e[:, BEGIN], e[:, INSIDE]) - e[:, OUTSIDE]
        outside = np.ones(len(e), bool)
        for s, ws in zip(starts, words, strict=True):
            outside[s : s + len(ws)] = False
        gain[outside] = -1e6  # no stretch goes from one text to the next
        p = np.cumsum(gain)
        before = np.minimum.accumulate(np.r_[0.0, p[:-1]])
        after = np.maximum.accumulate(p[::-1])[::-1]
        unsure = after - before + self.ends >= -1e-3
        moves, start, out = self.model.moves, self.model.start, []
        none = np.zeros(3)
        for s, ws in zip(starts, words, strict=True):
            n, spans = len(ws), []
            at = np.flatnonzero(unsure[s : s + n])
            for part in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []:
                a, b = int(part[0]), int(part[-1]) + 1
                path = viterbi(e[s + a : s + b], moves, start if a == 0 else moves[OUTSIDE], moves[:, OUTSIDE] if b < n else none)
                for i, y in enumerate(path, a):
                    if y == BEGIN or y == INSIDE and not (spans and spans[-1][1] == i - 1):
                        spans.append((i, i))
                    elif y == INSIDE:
                        spans[-1] = (spans[-1][0], i)
            out.append(spans)
        return out

    def find(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """For each text the (start, end) characters of its secrets."""
        words = [TOKENS.findall(t) for t in texts]
        out = []
        for t, spans in zip(texts, self.tag(words), strict=True):
            if spans:
                places = [m.span() for m in TOKENS.finditer(t)]
                spans = [(places[a][0], places[b][1]) for a, b in spans]
            out.append(spans)
        return out


_taggers: dict[str, Tagger] = {}


def _tagger(model: Model) -> Tagger:
    if model.id not in _taggers:
        _taggers.clear()
        _taggers[model.id] = Tagger(model)
    return _taggers[model.id]


def find_secrets(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, start, n_chars, digest) of each secret in each text: its place and a SHA-256, never the secret itself.

    Whole texts are read, very long ones too. Null and empty texts have no secrets; a null doc_id is a value as others. Rows
    that repeat are each reported. Of equally likely taggings that with the lower tags counts, outside being the lowest. Other
    columns, whatever their names, are ignored. Empty input: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())
    schema = T.StructType([docs.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("digest", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(shared.value)
        for whole in batches:
            for b in chunks(whole, 1):
                texts = [t or "" for t in b.column(1).to_pylist()]
                got = [(i, s, e) for i, spans in enumerate(tagger.find(texts)) for s, e in spans]
                if got:
                    at = pa.array([i for i, _, _ in got])
                    digests = [hashlib.sha256(texts[i][s:e].encode("utf-8", "surrogatepass")).hexdigest() for i, s, e in got]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([s for _, s, _ in got], pa.int64()), pa.array([e - s for _, s, e in got], pa.int64()), pa.array(digests)], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """All rows of `docs`, each secret in their texts replaced by REDACTED; n_chars, if there, is that of the new text.

    Null and empty texts, all other columns, also those named as ours, and the number of rows stay as they are. Empty input: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())
    used = ("text", "n_chars") if "n_chars" in docs.columns else ("text",)
    rows = packed(docs, used)
    names, at = rows.columns, 0
    sized = 1 if "n_chars" in used else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(shared.value)
        for whole in batches:
            for b in chunks(whole, at):
                texts = b.column(at).to_pylist()
                clean = []
                for t, spans in zip(texts, tagger.find([t or "" for t in texts]), strict=True):
                    for s, e in reversed(spans):
                        t = t[:s] + REDACTED + t[e:]
                    clean.append(t)
                columns = list(b.columns)
                columns[at] = pa.array(clean, pa.string())
                if sized is not None:
                    was = columns[sized]
                    columns[sized] = pc.coalesce(pa.array([None if t is None else len(t) for t in clean], pa.int64()).cast(was.type), was)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return unpacked(rows.mapInArrow(run, rows.schema), docs.columns, used)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place and digest of every secret in every document."""
    return find_secrets(table(spark, sf_dir, "documents"))


if __name__ == "__main__":
    write_weights()
