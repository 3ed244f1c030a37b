"""Personal data by fixed patterns and a linear-chain conditional random field.

The patterns find addresses, numbers and cards in their plain forms. The random field reads words by
their shape (letters and digits folded, signs kept) and those of their neighbours, is trained here
from a small labelled table, and adds spans that the patterns miss. Words far from any digit, `@`,
bracketed `at` or word that announces a secret are outside by definition, so it reads only the stretches
around such words, each whole, many stretches side by side.
"""

from __future__ import annotations

import functools
import hashlib
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wattloom.llm.common import adam, per_batch
from wattloom.llm.words import give_back

KINDS = ("email", "ip", "card", "phone")
#: A kind that only the random field finds.
EXTRA = ("secret",)
ORDER = {k: i for i, k in enumerate(KINDS + EXTRA)}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The patterns' parts. The address pattern is read from each `@` outwards, which finds the same matches.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else int(d) * 2 - 9 * (d > "4") for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, leftmost and apart."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        # the next match can't begin before the end of this one, nor reach over this `@`
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed; code points, end exclusive."""
    found = [(s, e, "email") for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], ORDER[s[2]], s[1]))


#: The labelled table: words in brackets are of the kind named first in the bracket.
LABELLED = """
write to [email ana.lopez@mail.example.org] for details
mail: [email j_doe99@host1.example.net] or come by
contact [email sales@shop.example.com], please
send it to [email that.92@mail2.example.com] today
reach me at [email maria (at) example.org] soon
address [email bob [at] mail [dot] example [dot] com] is new
my e-mail is [email kim (at) host (dot) net] and yours
host [ip 10.0.0.1] answered
from [ip 192.168.17.250] to [ip 8.8.4.4] today
server at [ip 97.51.17.173] was down
the address [ip 2001:db8:85a3:0:0:8a2e:370:7334] replied
ip [ip fe80:0:0:0:202:b3ff:fe1e:8329] is local
card [card 4111 1111 1111 1111] was charged
paid with [card 5500-0000-0000-0004] on monday
number [card 4012888888881881] expired
the visa [card 9807915762804490] ends here
call [phone +1 (499) 555-6503] now
phone: [phone +44 20 7946 0958] after nine
tel [phone (555) 010-4477] or mail
ring [phone (212) 555-0188] any day
fax [phone 030-555-0199] is old
our number [phone 555-010-7788] works
mobile [phone +49 151 5550 1234] please
call [phone 212.555.0147] for help
token = [secret "1eb9c654e721b4f812088970e66a6345cee33dd6"]
the token = [secret "908038b7daaf91e730d2f64001c52934d43d9336"] leaked
api_key = [secret 9f8e7d6c5b4a39281706f5e4d3c2b1a0] here
key: [secret "0b96a8c8d79c4a5085c919698889f59b72ab7bb6"]
password = [secret hunter2x99] must change
secret = [secret s3cr3tV4lue88] stays
password = [secret correcthorse] stays
the password = [secret opensesame] works
secret = [secret swordfish] again
token = [secret "letmeinplease"] leaked
api_key = [secret abracadabra] here
forgot your password again
a password must be long and the token is new
the secret of the garden
keep it secret and safe
as a token of thanks
the api_key is sent with each request
in 2019 we sold 300 units
version 2.0 of the license
license, version 3.
under cc by-nc 4.0. and more
the year 1998 and the year 2004
chapter 12, page 345 of the book
room 101 on floor 3
at 10:45 on 12.05.2021 we met
on 2021-05-12 at 10 o'clock
it cost 12.50 or 1,299.00 euros
score 3:2 after 90 minutes
about 15 percent of 4000 people
order 12345 has 7 parts
section 4.2.1 says so
h2o and co2 are gases
route 66 and a4 paper
isbn 978-3-16-148410-0 in print
the 1st, 2nd and 3rd place
follow @news on the site
see you @ noon
temperature 21.5 degrees
ratio 16:9 or 4:3 screens
block 7 row 12 seat 34
born in 1985, moved in 2003
model x200 with 512 mb
"""

LABELS = ["O"] + [f"{b}-{k}" for k in KINDS + EXTRA for b in ("B", "I")]
N_LABELS = len(LABELS)
#: Hashed features; words to each side of a signal word that are read.
FEATURES, REACH = 1 << 12, 3

WORD = re.compile(r"\S+")
SIGNAL = re.compile(r"[0-9@]|[(\[](?:at|dot)[)\]]", re.I)
#: Words that announce a secret, which may be of letters alone.
ANNOUNCING = ("password", "secret", "token", "api_key")
ANNOUNCED = re.compile(rf"(?<![A-Za-z])(?:{'|'.join(ANNOUNCING)})(?![A-Za-z])", re.I)
FOLDS = ((re.compile(r"[a-z]+"), "a"), (re.compile(r"[A-Z]+"), "A"), (re.compile(r"[^\x00-\x7F]+"), "u"))


def _digits(m: re.Match) -> str:
    return "9" * min(len(m[0]), 5)


@functools.lru_cache(maxsize=1 << 14)
def _shape(word: str) -> str:
    for pattern, to in FOLDS:
        word = pattern.sub(to, word)
    return re.sub(r"[0-9]+", _digits, word)[:40]


def _slot(feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=4).digest(), "little") % FEATURES


@functools.lru_cache(maxsize=1 << 14)
def _own(word: str) -> tuple[int, ...]:
    """Features of a word by its shape and make."""
    core = word.strip(".,;:!?*&%$#|\"'")
    n_digit, n_alpha = sum(c.isdigit() for c in core), sum(c.isalpha() for c in core)
    made = [
        f"s={_shape(core)}", f"d={min(n_digit, 12)}", f"l={min(len(core), 24) // 3}", f"at={'@' in core}", f"dots={min(core.count('.'), 4)}",
        f"col={min(core.count(':'), 5)}", f"dash={min(core.count('-'), 4)}", f"hex={len(core) >= 16 and bool(re.fullmatch('[0-9a-fA-F]+', core)) and n_alpha > 0}",
        f"mixed={n_digit > 1 and n_alpha > 1}", f"only={n_alpha == 0}", f"par={core[:1]}", f"plus={core.startswith('+')}",
    ]
    return tuple(_slot(m) for m in made)


@functools.lru_cache(maxsize=1 << 14)
def _near(word: str, side: str) -> tuple[int, ...]:
    core = word.strip(".,;:!?*&%$#|\"'").lower()
    said = core if re.fullmatch(r"[a-z_=-]{1,10}", core) and core in CUES else ""
    return (_slot(f"{side}s={_shape(core)}"), _slot(f"{side}w={said}"), _slot(f"{side}p={word[-1:] if not word[-1:].isalnum() else ''}"))


#: Words that announce what follows.
CUES = frozenset("mail e-mail email contact write call phone tel ring fax mobile number card visa paid host ip server token key api_key password secret year version page chapter room = at dot (at) (dot) [at] [dot]".split())


def features(words: list[str], before: str = "<s>", after: str = "</s>") -> list[tuple[int, ...]]:
    padded = [before, *words, after]
    return [_own(w) + _near(padded[i], "-") + _near(padded[i + 2], "+") + (0,) for i, w in enumerate(words)]


class Field(NamedTuple):
    emit: np.ndarray  # feature, label
    move: np.ndarray  # label, label
    start: np.ndarray


def _allowed() -> np.ndarray:
    """Inside a kind only after its begin or inside."""
    ok = np.ones((N_LABELS, N_LABELS), bool)
    for j, name in enumerate(LABELS):
        if name[0] == "I":
            ok[:, j] = [p != "O" and p[2:] == name[2:] for p in LABELS]
    return ok


FORBIDDEN = -1e4


def _labelled() -> list[tuple[list[str], list[int]]]:
    out = []
    for line in LABELLED.strip().split("\n"):
        words, labels, kind, fresh = [], [], None, False
        for piece in line.split():
            if kind is None and piece.startswith("[") and piece[1:] in ORDER:
                kind, fresh = piece[1:], True
                continue
            ends = kind is not None and re.search(r"(?<!dot|.at)\](?=[,.]?$)", piece)
            if ends:
                piece = piece[: ends.start()] + piece[ends.end() :]
            words.append(piece)
            labels.append(0 if kind is None else LABELS.index(("B-" if fresh else "I-") + kind))
            fresh = False
            if ends:
                kind = None
        out.append((words, labels))
    return out


@functools.lru_cache(maxsize=1)
def train(steps: int = 150) -> Field:
    """Maximum likelihood with a small ridge, by forward-backward over the padded table. A worker trains once, always alike."""
    rows = _labelled()
    n, size = len(rows), max(len(w) for w, _ in rows)
    width = len(features(["x"])[0])
    x = np.zeros((n, size, width), np.int64)
    y, mask = np.zeros((n, size), np.int64), np.zeros((n, size), bool)
    for i, (words, labels) in enumerate(rows):
        x[i, : len(words)], y[i, : len(words)], mask[i, : len(words)] = features(words), labels, True
    ban = np.where(_allowed(), 0, FORBIDDEN)
    first = np.where([name[0] == "I" for name in LABELS], FORBIDDEN, 0.0)
    onehot = np.eye(N_LABELS)[y] * mask[..., None]

    def grads(q: dict, _: int) -> dict:
        e = q["emit"][x].sum(2)
        move = q["move"] + ban
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + q["start"] + first
        for t in range(1, size):
            step = np.logaddexp.reduce(alpha[:, t - 1, :, None] + move, 1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
        for t in range(size - 2, -1, -1):
            step = np.logaddexp.reduce(move + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], step, 0)
        z = np.logaddexp.reduce(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        gap = p - onehot
        emit = np.zeros_like(q["emit"])
        np.add.at(emit, x.reshape(-1), np.repeat(gap.reshape(-1, N_LABELS), width, 0))
        pair = np.zeros((N_LABELS, N_LABELS))
        for t in range(1, size):
            joint = np.exp(alpha[:, t - 1, :, None] + move + (e[:, t] + beta[:, t])[:, None, :] - z[:, None, None]) * mask[:, t, None, None]
            pair += joint.sum(0) - np.einsum("ni,nj->ij", onehot[:, t - 1] * mask[:, t, None], onehot[:, t])
        return {"emit": emit, "move": pair, "start": gap[:, 0].sum(0)}

    zero = {"emit": np.zeros((FEATURES, N_LABELS)), "move": np.zeros((N_LABELS, N_LABELS)), "start": np.zeros(N_LABELS)}
    got = adam(grads, zero, steps, 0.1, 0.05)
    return Field(got["emit"], got["move"] + ban, got["start"] + first)


def viterbi(emissions: np.ndarray, lengths: np.ndarray, field: Field) -> np.ndarray:
    """Best label paths of padded sequences (sequence, place, label); places past a length are 0."""
    n, size, _ = emissions.shape
    back = np.zeros((n, size, N_LABELS), np.int8)
    score = emissions[:, 0] + field.start
    for t in range(1, size):
        step = score[:, :, None] + field.move
        back[:, t] = step.argmax(1)
        go = step.max(1) + emissions[:, t]
        live = t < lengths
        score = np.where(live[:, None], go, score)
        back[~live, t] = np.arange(N_LABELS)
    path = np.zeros((n, size), np.int64)
    path[:, -1] = score.argmax(1)
    for t in range(size - 1, 0, -1):
        path[:, t - 1] = np.take_along_axis(back[:, t], path[:, t : t + 1], 1)[:, 0]
    path[np.arange(size) >= lengths[:, None]] = 0
    return path


def signals(text: str) -> list[int]:
    """Places of the signs and of the words that announce a secret."""
    out = [m.start() for m in SIGNAL.finditer(text)]
    low = text.lower()
    if any(w in low for w in ANNOUNCING):
        out += [m.start() for m in ANNOUNCED.finditer(text)]
    return out


def stretches(text: str) -> list[list[tuple[int, int]]]:
    """Runs of words (start, end) around those with a signal."""
    at = signals(text)
    if not at:
        return []
    words = [m.span() for m in WORD.finditer(text)]
    starts = np.array([s for s, _ in words])
    marked = np.zeros(len(words) + 1, np.int64)
    near = np.searchsorted(starts, at, "right") - 1
    np.add.at(marked, np.maximum(near - REACH, 0), 1)
    np.add.at(marked, np.minimum(near + REACH + 1, len(words)), -1)
    inside = np.append(np.cumsum(marked[:-1]) > 0, False)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside])))
    return [words[a:b] for a, b in zip(edge[::2], edge[1::2])]


#: Stretches decoded side by side, their places with padding unless one alone has more, and words whose features are held at once.
BATCH, PLACES, CHUNK = 256, 51_200, 4096


def emissions_of(words: list[str], field: Field) -> np.ndarray:
    """(word, label) scores of one stretch, in chunks that see their neighbours."""
    out = np.zeros((len(words), N_LABELS))
    for at in range(0, len(words), CHUNK):
        to = min(at + CHUNK, len(words))
        rows = features(words[at:to], words[at - 1] if at else "<s>", words[to] if to < len(words) else "</s>")
        out[at:to] = field.emit[np.array(rows)].sum(1)
    return out


def _batches(sizes: list[int]):
    """(from, to) of the batches of stretches whose sizes ascend."""
    at = 0
    while at < len(sizes):
        to = at + 1
        while to < len(sizes) and to - at < BATCH and (to + 1 - at) * sizes[to] <= PLACES:
            to += 1
        yield at, to
        at = to


def field_spans(texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Spans that the random field finds in each text."""
    field = train()
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    todo = [(i, run) for i, text in enumerate(texts) for run in stretches(text)]
    todo.sort(key=lambda r: len(r[1]))
    for at, to in _batches([len(run) for _, run in todo]):
        part = todo[at:to]
        lengths = np.array([len(run) for _, run in part])
        emissions = np.zeros((len(part), lengths.max(), N_LABELS))
        for k, (i, run) in enumerate(part):
            emissions[k, : len(run)] = emissions_of([texts[i][s:e] for s, e in run], field)
        for (i, run), path in zip(part, viterbi(emissions, lengths, field)):
            k = 0
            while k < len(run):
                name = LABELS[path[k]]
                if name[0] != "B":
                    k += 1
                    continue
                to = k + 1
                while to < len(run) and LABELS[path[to]] == "I" + name[1:]:
                    to += 1
                s, e = run[k][0], run[to - 1][1]
                while e > s and texts[i][e - 1] in ".,;:!?*&%$#|\"'":
                    e -= 1
                while s < e and texts[i][s] in "\"'|*&%$#":
                    s += 1
                told = name[2:] == "secret" and ANNOUNCED.search(texts[i], run[max(k - REACH, 0)][0], run[k][0])
                if s < e and (told or SIGNAL.search(texts[i], s, e)):
                    out[i].append((s, e, name[2:]))
                k = to
    return out


def find(texts: list[str | None]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; added spans never touch a base span."""
    texts = [t or "" for t in texts]
    live = [i for i, t in enumerate(texts) if SIGNAL.search(t) or signals(t)]
    out: list[tuple[list, list]] = [([], []) for _ in texts]
    for i, added in zip(live, field_spans([texts[i] for i in live])):
        base = base_spans(texts[i])
        more, k, reach = [], 0, 0
        for s, e, kind in sorted(added):
            while k < len(base) and base[k][0] < e:
                reach = max(reach, base[k][1])
                k += 1
            if reach <= s:
                more.append((s, e, kind))
        out[i] = (base, sorted(base + more, key=lambda x: (x[0], ORDER[x[2]], x[1])))
    return out


def joined(spans: list) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string"


def detect(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts of base spans, base spans and all spans as `kind:start:end` lists.

    Null and empty texts have none.
    """

    def work(batch: pa.RecordBatch) -> dict:
        found = find(batch.column("text").to_pylist())
        counts = {f"n_{k}": [sum(s[2] == k for s in base) for base, _ in found] for k in KINDS}
        return {"doc_id": batch.column("doc_id")} | counts | {"base": [joined(b) for b, _ in found], "spans": [joined(a) for _, a in found]}

    return per_batch(docs.select("doc_id", "text"), SCHEMA, work)


def mask(text: str, spans: list) -> str:
    """``text`` with each span replaced by its kind in capitals and brackets; of overlapping spans the first is named."""
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


#: Documents masked at once.
REDACT_ROWS = 1024


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` with personal data masked in ``text``; ``n_chars``, where it is a column, follows the new text."""
    names = docs.columns
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def run(batches):
        give_back()  # what tasks before left
        # a part of a batch at a time: its texts, spans and new texts are Python's own strings
        for batch in (whole.slice(i, REDACT_ROWS) for whole in batches for i in range(0, whole.num_rows, REDACT_ROWS)):
            columns = list(batch.columns)
            texts = columns[at].to_pylist()
            new = [t if t is None or not spans else mask(t, spans) for t, (_, spans) in zip(texts, find(texts))]
            if size >= 0:
                chars = columns[size].to_pylist()
                columns[size] = pa.array([c if a is b else len(b) for a, b, c in zip(texts, new, chars)], columns[size].type)
            columns[at] = pa.array(new, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
