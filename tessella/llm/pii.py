"""Personal data: fixed patterns, and a linear-chain CRF over word shapes.

The patterns find the base spans of emails, IPv4 addresses, payment cards and
phone numbers. A conditional random field over whitespace-parted tokens adds
spans of the same kinds and of secrets where no base span lies. Its features are
a token's shape (which kinds of characters, how many digits, how long) and
those of its neighbours; it is trained in numpy by gradient ascent on the small
labelled table ``LABELLED`` and decoded by Viterbi in numpy batches. A token
whose evidence for "outside" outweighs whatever transitions could gain is
outside on every best path, so only the runs between such tokens are decoded;
the result is that of decoding whole texts.

Found cards must pass the checksum and addresses have parts up to 255, whoever
found them. Defined cases: null and empty texts have no spans; offsets are code
points; where a found span meets a base one, the base one alone stays; texts of
any length are read whole, some megabyte at a time or one text; repeated rows
count; an empty table gives no rows; only doc_id and text are read, so other
columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm.common import doc_text, map_arrow

KINDS = ("email", "ip", "card", "phone")
LABELS = ("outside", *KINDS, "secret")
STEP_CHARS = 1 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+").match
# a match never begins within a run of digits: the run's own start would have matched as well
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}").finditer
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++").finditer
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_DIGIT = re.compile(r"[0-9]").search


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _card_ok(s: str) -> bool:
    return 16 <= len(d := _digits(s)) <= 19 and luhn(d)


def _ip_ok(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: what can precede an @ is taken as far back as the match before."""
    out, at, last = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            last = at + 1
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    if _DIGIT(text):
        if "." in text:
            out += [("ip", *m.span()) for m in _IP(text) if _ip_ok(m[0])]
        out += [("card", *m.span()) for m in _CARD(text) if _card_ok(m[0])]
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


#: The labelled table: spans are marked [kind|text]. Every line and value is made up for it (networks and numbers
#: reserved for examples, the card schemes' own test numbers, digits and letters typed at random).
LABELLED = (
    "please write to [email|anna.berg@mail3.example.com] before noon, thanks.",
    "Kontakt: [email|m_klein@firma.example.de] oder telefonisch [phone|+49 (30) 555-0199] erreichbar.",
    "escribe a [email|lola99@correo.example.es], por favor, y espera.",
    "questions go to the list.[email|77@lists.example.org] and are answered within a week",
    "votre adresse [email|j.petit@poste.example.fr] est connue de nous.",
    "mailto:[email|office-2@example.net] | Betreff | Anfrage",
    "the host [ip|192.0.2.17] answered and then it closed.",
    "Server [ip|10.0.0.254], der andere ist [ip|192.168.1.20] und der ist langsam.",
    "de [ip|198.51.100.4] que la red no responde. Fin.",
    "depuis [ip|203.0.113.162] | le serveur | est là | encore",
    "ban [ip|203.0.113.9] now, wait, and so on",
    "connect to [ip|198.51.100.77]:8080 and log in",
    "my card is [card|4539578763621486] and it expires soon.",
    "Karte [card|4111 1111 1111 1111] wurde belastet, sagt man.",
    "tarjeta [card|5500005555555559] | queda | lista",
    "numéro [card|4012888888881881], merci de payer.",
    "pay with [card|4111-1111-1111-1111] today. Next one is free",
    "call [phone|+1 (202) 555-0143] now or never.",
    "call me at [phone|(202) 555-0171] after the meeting, please.",
    "ring [phone|(303) 555-0118], ask for the manager.",
    "her number: [phone|(415) 555-0190]",
    "Tel. [phone|+44 20 7946 0958] und dann weiter im Text",
    "llama al [phone|+34 912 345 678] por la tarde.",
    "appelez le [phone|+33 1 70 18 99 00] demain matin.",
    "fax [phone|555-010-2233] is still in use.",
    "or dial [phone|487-555-0109] for the front desk",
    "mobile [phone|612-555-0162] or mail, either will do",
    "phone [phone|(773) 555-0134] | fax | none",
    "my cell is [phone|(206) 555-0155]. Call any time!",
    "text [phone|503-555-0187], she reads everything",
    'token = [secret|"5d1f0c77be29a4e36608f1d2b93c4a7e0182d6f5"] and then text',
    'set token = [secret|"e07a4b91c2d8356f1b0c9e7d4a2f6835719cd0ab"]',
    'mit token = [secret|"13fb8e20d7c64a5990e1f3b2c8d7a6405e9b1c72"]! und so weiter',
    "api key [secret|c40d9e1b7f2a63585d0e4c9b8a7f1632d5e0b948] must not be shared.",
    "password hash [secret|0b9d7e4f1a2c5638e7d0b4f9c1a6283574de90fb16c8a3d2] leaked.",
    "secret: [secret|7be1d04c9f2a68535e0d1c7b94fa2e60]",
    "the key is [secret|d81f30c69a7b4e25f0c1d93e8b7a6452], keep it safe",
    "export SECRET=[secret|4f9a0d3c7e1b8256] and restart",
    "apikey [secret|a9c81e7d0f3b42569d0e1f7c] | rotated | daily",
    "auth [secret|f00d7a1e93cb4d82a6e05c17b94d2f38e1c07a65d3b9f841027ce6ad59b0c3f7] expired yesterday",
    "Schlüssel [secret|92b7c0e4d1fa83650c9e2d7b4f1a8635], nicht weitergeben",
    "la clave [secret|6c0f2e9d8b7a14533e1d0c9f8a7b6254] caduca hoy",
    "jeton [secret|b4e7d19c0a2f8365c7e0d4b9f1a26358] à renouveler",
    "the quick brown fox jumps over the lazy dog. And again, it did so!",
    "Rain fell on the old harbour all night. By morning the boats had gone.",
    "STOP!! READ!! THIS!! BEFORE!! YOU!! SIGN!! ANYTHING!!",
    "win$$$ big&&& prizes*** now%%% friend### act,&&& fast. today###",
    "apples | pears and plums | cherries | grapes. | nuts, | figs",
    "Les élèves étaient là; où est-il? C'est tout, n'est-ce pas...",
    "Öffnen Sie die Tür, bitte. Größe und Maß für die Straße (neu).",
    "El niño comió ñoquis; ¿verdad? ¡Sí! (así es) y más.",
    "Lundi, mardi et jeudi. Puis rien. Et voilà: la fin, enfin!",
    "Der Zug, der um acht fuhr, kam nie an. Schade. Wirklich?",
    "in 1999 there were 25 people, 3 dogs and 12,500 birds.",
    "chapter 4.2 covers section 10.1 in 300 pages (see figure 7)",
    "version 3.0 was released on 2021-05-04 at 10:30, build 4711.",
    "order 880125513 shipped, 2 of 3 boxes, total 19.99 euros",
    "item 60417733 and item 915 are out of stock",
    "Released under a public licence, version 2, with no warranty.",
    "Copyright 2019 The Authors. All rights reserved. Version 2.0 applies.",
    "a - b + c = d; x == y; f(x) = 2x + 1, see eq. (3)",
    "https://www.example.com/path/page-2.html?id=3 is a link, not a person",
    "serial 1234567890123456 fails, 99999 too, number 7.",
    "room 12-34 of the 5th floor, line 9 (of 20)",
    "e-mail is a well-known word and @home is a handle",
    "antidisestablishmentarianism and Donaudampfschifffahrtsgesellschaft are long words",
    "model X200-B45 and part 77-1204-A are not made any more",
    "call on us, or write (any day but Sunday), room (12)",
    "the token of our thanks is a key to the city, no secret",
    "pages 101-118, figures (1) to (12), tables 3-5",
)

_MARK = re.compile(r"\[(\w+)\|([^\]]*)\]")
#: A character's flags.
_FLAGS = {"lower": 1, "upper": 2, "digit": 4, "at": 8, "dot": 16, "dash": 32, "paren": 64, "plus": 128, "quote": 256, "sign": 512, "beyond": 1024}
_BITS = len(_FLAGS)


def _char_flags() -> np.ndarray:
    out = np.full(129, 0, np.int32)
    for c in range(33, 129):
        ch = chr(c)
        if c == 128 or ch.isalpha():
            out[c] = _FLAGS["lower"] if c == 128 or ch.islower() else _FLAGS["upper"]
            if c == 128 or ch.lower() > "f":
                out[c] |= _FLAGS["beyond"]  # not hexadecimal
        else:
            out[c] = _FLAGS["digit"] if ch.isdigit() else _FLAGS[{"@": "at", ".": "dot", "-": "dash", "(": "paren", ")": "paren", "+": "plus", '"': "quote"}.get(ch, "sign")]
    return out


_CHAR = _char_flags()
_DIGITS_AT = np.array([0, 1, 2, 3, 4, 5, 5, 6, 6, 7, 7, 7, 7, 8, 8, 8, 9, 9, 9, 9] + [10] * 20 + [11], np.int32)
_LENGTH_AT = np.array([0, 1, 2, 2, 3, 3, 3, 4, 4, 4, 4, 4, 4] + [5] * 12 + [6] * 13 + [7], np.int32)
_CODES = 1 << (_BITS + 4 + 3)


def tokens(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and shape code of every whitespace-parted token of code points."""
    small = np.minimum(chars, 128)
    blank = (small <= 32) | (small == 127)
    begin = np.nonzero(~blank & np.concatenate([[True], blank[:-1]]))[0]
    end = np.nonzero(~blank & np.concatenate([blank[1:], [True]]))[0] + 1
    if not len(begin):
        return begin, end, np.zeros(0, np.int32)
    flags = np.bitwise_or.reduceat(_CHAR[small], begin)
    count = np.concatenate([[0], np.cumsum((small >= 48) & (small <= 57))])
    n = _DIGITS_AT[np.minimum(count[end] - count[begin], len(_DIGITS_AT) - 1)]
    size = _LENGTH_AT[np.minimum(end - begin, len(_LENGTH_AT) - 1)]
    return begin, end, flags | n << _BITS | size << (_BITS + 4)


def features(code: int) -> list[str]:
    """The features that a shape code stands for."""
    flags, n, size = code & ((1 << _BITS) - 1), code >> _BITS & 15, code >> (_BITS + 4)
    on = [k for k, v in _FLAGS.items() if flags & v]
    return ["bias", *on, f"digits{n}", f"length{size}", "=".join(on), f"{'digit' in on}{'beyond' in on}{'lower' in on}{n}-{size}"]


@dataclass
class Crf:
    weights: tuple[dict[str, np.ndarray], ...]  # for the token before, the token, the token after
    trans: np.ndarray

    def __post_init__(self):
        self.rows: dict[int, int] = {}
        self.tables = [np.zeros((0, len(LABELS))) for _ in range(3)]
        self.safe = [np.zeros(0) for _ in range(3)]
        self.bound = 2 * (self.trans.max() - self.trans.min()) + 1e-9

    def _row(self, codes: np.ndarray) -> np.ndarray:
        """Row of each code in the tables of scores; codes not met before get one."""
        present = np.nonzero(np.bincount(codes, minlength=_CODES))[0]
        for c in present.tolist():
            if c not in self.rows:
                self.rows[c] = len(self.rows)
                for k in range(3):
                    w = sum((self.weights[k][f] for f in features(c) if f in self.weights[k]), np.zeros(len(LABELS)))
                    self.tables[k] = np.vstack([self.tables[k], w])
                    self.safe[k] = np.append(self.safe[k], (w[0] - w[1:]).min())
        where = np.zeros(_CODES, np.int32)
        where[present] = [self.rows[c] for c in present.tolist()]
        return where[codes]

    def decode(self, codes: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Labels of the best path; ``text`` numbers each token's text."""
        out = np.zeros(len(codes), np.int8)
        if not len(codes):
            return out
        row = self._row(codes)
        inner = text[1:] == text[:-1]
        before, after = np.concatenate([[False], inner]), np.concatenate([inner, [False]])
        near = np.concatenate([[0], row[:-1]]), np.concatenate([row[1:], [0]])
        margin = self.safe[1][row] + np.where(before, self.safe[0][near[0]], 0) + np.where(after, self.safe[2][near[1]], 0)
        open_ = np.nonzero(margin <= self.bound)[0]
        if not len(open_):
            return out
        score = self.tables[1][row[open_]] + np.where(before[open_, None], self.tables[0][near[0][open_]], 0) + np.where(after[open_, None], self.tables[2][near[1][open_]], 0)
        split = np.concatenate([[True], (np.diff(open_) > 1) | ~before[open_[1:]]])
        first = np.nonzero(split)[0]
        size = np.diff(np.append(first, len(open_)))
        # beside a run of open tokens is an outside token, or the text's edge
        score[first] += np.where(before[open_[first], None], self.trans[0], 0)
        final = first + size - 1
        score[final] += np.where(after[open_[final], None], self.trans[:, 0], 0)
        label = np.zeros(len(open_), np.int8)
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        for a in range(0, len(first), 4096):
            label_run(score, first[a : a + 4096], size[a : a + 4096], self.trans, label)
        out[open_] = label
        return out


def label_run(score: np.ndarray, first: np.ndarray, size: np.ndarray, trans: np.ndarray, label: np.ndarray) -> None:
    """Viterbi for runs sorted by falling size; writes ``label``."""
    longest = int(size[0])
    best = score[first].copy()
    back = []
    for t in range(1, longest):
        n = int(np.searchsorted(-size, -t, side="left"))  # runs with more than t tokens
        via = best[:n, :, None] + trans
        back.append(via.argmax(1).astype(np.int8))
        best[:n] = via.max(1) + score[first[:n] + t]
    now = best.argmax(1)
    label[first + size - 1] = now
    for t in range(longest - 1, 0, -1):
        n = len(back[t - 1])
        now[:n] = back[t - 1][np.arange(n), now[:n]]
        label[first[:n] + t - 1] = now[:n]


def parse_labelled(line: str) -> tuple[str, list[tuple[str, int, int]]]:
    """Plain text and spans of a marked line."""
    text, spans, last = "", [], 0
    for m in _MARK.finditer(line):
        text += line[last : m.start()]
        spans.append((m[1], len(text), len(text) + len(m[2])))
        text += m[2]
        last = m.end()
    return text + line[last:], spans


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def fit(rows: tuple[str, ...] = LABELLED, epochs: int = 120, rate: float = 0.3, penalty: float = 0.003) -> Crf:
    """Gradient ascent on the conditional likelihood, with adaptive steps."""
    n_labels, names, data = len(LABELS), {}, []
    for line in rows:
        text, spans = parse_labelled(line)
        begin, end, codes = tokens(_code_points(text))
        truth = np.zeros(len(codes), int)
        for kind, a, b in spans:
            truth[(begin < b) & (end > a)] = LABELS.index(kind)
        ids = []
        for k in range(len(codes)):
            ids.append([names.setdefault((o, f), len(names)) for o in (0, 1, 2) if 0 <= k + o - 1 < len(codes) for f in features(int(codes[k + o - 1]))])
        data.append((ids, truth))
    hot = [np.zeros((len(t), len(names))) for _, t in data]
    for x, (ids, _) in zip(hot, data):
        for k, row in enumerate(ids):
            x[k, row] = 1
    w, trans = np.zeros((len(names), n_labels)), np.zeros((n_labels, n_labels))
    sw, st = np.full_like(w, 1e-6), np.full_like(trans, 1e-6)

    def lse(z, axis):
        top = z.max(axis, keepdims=True)
        return (np.log(np.exp(z - top).sum(axis, keepdims=True)) + top).squeeze(axis)

    for _ in range(epochs):
        gw, gt = -penalty * len(data) * w, -penalty * len(data) * trans
        for x, (_, truth) in zip(hot, data):
            e, n = x @ w, len(truth)
            f, b = np.zeros_like(e), np.zeros_like(e)
            f[0] = e[0]
            for t in range(1, n):
                f[t] = e[t] + lse(f[t - 1][:, None] + trans, 0)
            for t in range(n - 2, -1, -1):
                b[t] = lse(trans + e[t + 1] + b[t + 1], 1)
            z = lse(f[-1], 0)
            d = -np.exp(f + b - z)
            d[np.arange(n), truth] += 1
            gw += x.T @ d
            for t in range(1, n):
                gt -= np.exp(f[t - 1][:, None] + trans + e[t] + b[t] - z)
                gt[truth[t - 1], truth[t]] += 1
        sw += gw * gw
        st += gt * gt
        w += rate * gw / np.sqrt(sw)
        trans += rate * gt / np.sqrt(st)
    weights: tuple[dict, dict, dict] = ({}, {}, {})
    for (o, f), k in names.items():
        weights[o][f] = w[k]
    return Crf(weights, trans)


_EDGE = ".,;:!?'\"()[]{}<>|#$%&*="


def crf_spans(crf: Crf, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Spans of the CRF alone: runs of tokens with one label, without signs at their ends."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    joined = "\n".join(texts)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    begin, end, codes = tokens(_code_points(joined))
    text = np.searchsorted(starts, begin, side="right") - 1
    label = crf.decode(codes, text)
    at = np.nonzero(label)[0]
    if not len(at):
        return out
    runs = np.split(at, np.nonzero((np.diff(at) > 1) | (label[at[1:]] != label[at[:-1]]) | (text[at[1:]] != text[at[:-1]]))[0] + 1)
    for r in runs:
        a, b, kind = int(begin[r[0]]), int(end[r[-1]]), LABELS[label[r[0]]]
        while a < b and joined[a] in _EDGE and not (kind == "phone" and joined[a] == "("):
            a += 1
        while a < b and joined[b - 1] in _EDGE:
            b -= 1
        s = joined[a:b]
        digits = len(_digits(s))
        if kind == "card" and not _card_ok(s) or kind == "phone" and not 7 <= digits <= 15 or kind == "email" and "@" not in s:
            continue
        if kind == "ip" and not (re.fullmatch(r"[0-9]+(\.[0-9]+){3}", s) and _ip_ok(s)) or kind == "secret" and (len(s) < 16 or not digits):
            continue
        if a < b:
            k = int(text[r[0]])
            out[k].append((kind, a - int(starts[k]), b - int(starts[k])))
    return out


def find(crf: Crf, texts: list[str | None]) -> list[tuple[list, list]]:
    """Base spans, and all spans, of every text; both by kind, then start."""
    out, held, size = [], [], 0
    texts = [t or "" for t in texts]
    for k, t in enumerate(texts, 1):
        held.append(t)
        size += len(t)
        if size > STEP_CHARS or k == len(texts):
            for t2, more in zip(held, crf_spans(crf, held)):
                base = base_spans(t2)
                added = [s for s in more if not any(s[1] < b and a < s[2] for _, a, b in base)]
                out.append((base, sorted(base + added, key=lambda s: (LABELS.index(s[0]), s[1], s[2]))))
            held, size = [], 0
    return out


@cache
def default_model() -> Crf:
    return fit()


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, crf: Crf | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    shared = docs.sparkSession.sparkContext.broadcast(crf or default_model())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = find(shared.value, batch.column("text").to_pylist())
        cols = {"doc_id": batch.column("doc_id")}
        for kind in KINDS:
            cols[f"n_{kind}"] = pa.array([sum(s[0] == kind for s in base) for base, _ in got], pa.int64())
        cols["base_sha256"] = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in got])
        cols["spans"] = pa.array([_joined(every) for _, every in got])
        return pa.RecordBatch.from_pydict(cols)

    return map_arrow(doc_text(docs), run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")
