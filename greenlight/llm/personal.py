"""Personal data: exact patterns, and a linear-chain conditional random field for the forms they miss.

The patterns find e-mail addresses, IPv4 addresses, card and phone numbers in their plain forms (``patterns``). The
field tags words: its features are the shape of a word (letters collapsed, digits counted, signs kept) and a few
cue words, both of the word itself and of two neighbours to either side. It is trained on the driver from a small
labelled table of at most ``MAX_LABELLED`` rows, by gradient steps on the exact log-likelihood, and is sent to the
workers as one table of weights. In a batch the lines of many texts that have a digit, a sign of an address or a
written-out @, without which the checks below refuse any span, are sorted by length and decoded together by Viterbi. A tagged stretch becomes a span if it also holds against the check of its kind (the checksum of a card, the
number of digits of a phone number) and overlaps no span of the patterns; those stay as they are.

Every row is judged on its own: nothing is shuffled.

Defined results
- null text is empty: no spans. Spans are in code points, the end exclusive.
- Sequences are lines; a very long line is decoded whole, in as many steps as it has words.
- Spans are ordered by start, then by kind as in ``KINDS``. Spans of the field don't overlap one another.
- Equal scores go to the tag that comes first. Repeated rows are judged row by row. An empty table gives no rows;
  columns other than doc_id and text are not read.
- Labelled rows without text or with no spans are examples of plain text; an empty labelled table is refused.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from greenlight.llm.words import LOWER, hash_spans, row_of, slices, word_bounds

KINDS = ("email", "ip", "card", "phone")
MAX_LABELLED = 5000
SLICE = 1 << 20
SPANS = "doc_id long, spans array<struct<kind: string, start: long, end: long, base: boolean>>"

# ---------------------------------------------------------------- patterns

LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
QUAD = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def is_quad(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def is_card(text: str) -> bool:
    digits = digits_of(text)
    return 12 <= len(digits) <= 19 and luhn(digits)


def patterns(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the exact patterns, each kind from left to right without overlaps.

    All scans are linear: an address is read outward from its ``@``, numbers from the first digit of a run.
    """
    out = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_PART:
            start -= 1
        host = HOST.match(text, at + 1) if start < at else None
        if host:
            end = host.end()
            out.append(("email", start, end))
        at = text.find("@", host.end() if host else at + 1)
    out += [("ip", *m.span()) for m in QUAD.finditer(text) if is_quad(m.group())]
    out += [("card", *m.span()) for m in CARD.finditer(text) if m.end() - m.start() >= 12 and is_card(m.group())]
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# ---------------------------------------------------------------- features

TAGS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))
N_TAGS = len(TAGS)
REACH = 2
EDGE = "<edge>"

#: Words that stand before or inside personal data, by what they hint at (fixed values).
CUES = {
    "at": "at (at) [at] {at} arobase <at>",
    "dot": "dot (dot) [dot] {dot} punkt punto point <dot>",
    "phone": "phone tel telephone mobile cell fax call text telefon anrufen téléphone appelez portable teléfono llame móvil ruf",
    "card": "card visa mastercard amex debit credit carte karte kreditkarte tarjeta",
    "mail": "mail e-mail email courriel correo write contact reach kontakt escriba",
    "ip": "ip address host server client adresse dirección ipv4 ipv6",
}

#: Capitals, letters, digits and bytes beyond ASCII as one sign each; of equal neighbours only digits are kept.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] = ord("A")
_CLASS[97:123] = ord("a")
_CLASS[48:58] = ord("0")
_CLASS[128:] = ord("u")


#: Digits, and signs without which no address is one.
SIGNS = np.zeros(256, bool)
SIGNS[list(b"0123456789@:[({<")] = True


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the shapes of all words, and where each begins and ends."""
    kind = _CLASS[data]
    inner = np.zeros(len(data) + 1, np.int8)
    inner[starts] += 1
    np.subtract.at(inner, ends, 1)
    kept = np.cumsum(inner[:-1]).astype(bool)
    again = np.zeros(len(data), bool)
    again[1:] = (kind[1:] == kind[:-1]) & (kind[1:] != ord("0"))
    again[starts] = False
    kept &= ~again
    place = np.concatenate([[0], np.cumsum(kept)])
    return kind[kept], place[starts], place[ends]


def shape_features(shape: str) -> list[str]:
    """What a shape tells: itself, its digit groups, its signs, its ends."""
    if shape == EDGE:
        return [EDGE]
    core = shape.strip(".,;:!?\"'()<>[]{}*#&%$")
    digits = core.count("0")
    groups = re.sub("0+", lambda m: str(min(len(m.group()), 20)), core)
    out = [f"shape={groups}" if len(groups) <= 40 else "shape=long", f"digits={min(digits, 20)}", f"first={core[:1]}", f"last={core[-1:]}"]
    out += [f"has {sign}" for sign in "@:.-()/_[]+" if sign in core]
    out += [f"{sign} {min(core.count(sign), 8)} times" for sign in ".:-" if sign in core]
    out.append("plain" if not digits and core.isalnum() else "signs" if not digits else "number" if digits == len(core) else "mixed")
    if re.fullmatch(r"[0A-Fau:]+", core) and core.count(":") >= 2:
        out.append("colons")
    return out


def cue_hashes() -> tuple[np.ndarray, list[str]]:
    words = {f"{w}{end}": cue for cue, text in CUES.items() for w in text.split() for end in ("", ":", ".", ",")}
    raw = [w.encode() for w in words]
    stops = np.cumsum([len(w) for w in raw])
    keys = hash_spans(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], stops[:-1]]), stops)
    order = np.argsort(keys)
    names = list(words.values())
    return keys[order], [names[k] for k in order]


def may_hold(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which words are such that ``holds`` needs one of them: a digit, a sign of an address, or a written-out @."""
    signs = np.concatenate([[0], np.cumsum(SIGNS[data])])
    size = ends - starts
    written = ((size == 2) | (size == 7)) & (LOWER[data[starts]] == ord("a"))  # at, arobase
    return (signs[ends] > signs[starts]) | written


def in_lines_of(words: np.ndarray, line: np.ndarray) -> np.ndarray:
    """For each word whether its line has one of these words."""
    if not len(line):
        return words
    wanted = np.zeros(int(line[-1]) + 1, bool)
    wanted[line[words]] = True
    return wanted[line]


class Reader:
    """Words of texts as numbers of shapes and cues."""

    def __init__(self):
        self.names = [EDGE]
        self.number = {EDGE: 0}
        self.keys, cues = cue_hashes()
        self.cue_names = sorted(set(cues))
        self.cues = np.array([1 + self.cue_names.index(c) for c in cues])

    def read(self, data: np.ndarray, offsets: np.ndarray, all_lines: bool = True):
        """Starts and ends of words, row and line of each (a line ends with its row), its shape and its cue (0 for
        none); without ``all_lines`` only of lines that can hold a span."""
        starts, ends, rows = word_bounds(data, offsets)
        row = row_of(rows)
        breaks = np.zeros(len(data) + 1, np.int64)
        breaks[np.flatnonzero(data == 10)] = 1
        breaks[offsets[:-1]] = 1
        line = np.cumsum(breaks)[starts]
        if not all_lines:
            kept = in_lines_of(may_hold(data, starts, ends), line)
            starts, ends, row, line = starts[kept], ends[kept], row[kept], line[kept]
        text, a, b = shapes(data, starts, ends)
        distinct, first, inverse = np.unique(hash_spans(text, a, b), return_index=True, return_inverse=True)
        raw = text.tobytes()
        numbers = np.empty(len(distinct), np.int64)
        for k, (x, y) in enumerate(zip(a[first].tolist(), b[first].tolist())):
            shape = raw[x:y].decode("latin-1")
            if shape not in self.number:
                self.number[shape] = len(self.names)
                self.names.append(shape)
            numbers[k] = self.number[shape]
        hashes = hash_spans(LOWER[data], starts, ends)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        cue = np.where(self.keys[at] == hashes, self.cues[at], 0)
        return starts, ends, row, line, numbers[inverse], cue


# ---------------------------------------------------------------- the field


def allowed() -> np.ndarray:
    """0 where a tag may follow another (row before column), a large negative number where it may not."""
    out = np.zeros((N_TAGS, N_TAGS), np.float32)
    for j, tag in enumerate(TAGS):
        if tag[0] == "I":
            out[[i for i, before in enumerate(TAGS) if before[2:] != tag[2:]], j] = -1e4
    return out


def starts_allowed() -> np.ndarray:
    return np.array([-1e4 if t[0] == "I" else 0 for t in TAGS], np.float32)


def _padded(values: np.ndarray, length: np.ndarray, first: np.ndarray, steps: int) -> np.ndarray:
    """Rows of ``values`` laid out as (step, line); what lies beyond a line is zero."""
    out = np.zeros((steps, len(length), *values.shape[1:]), values.dtype)
    for k in range(steps):
        live = length > k
        out[k, live] = values[first[live] + k]
    return out


def viterbi(emission: np.ndarray, first: np.ndarray, length: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best tag of every word. Lines begin at ``first``; those of like length are decoded together."""
    best = np.zeros(len(emission), np.int8)
    order = np.argsort(length, kind="stable")
    at = 0
    while at < len(order):
        steps = int(length[order[at]])
        stop = int(np.searchsorted(length[order], max(steps + 4, steps * 5 // 4), side="right"))
        stop = min(stop, at + max(1, (1 << 17) // max(steps, 1)))
        mine = order[at:stop]
        a, n = first[mine], length[mine]
        steps = int(n[-1])
        score = starts_allowed() + emission[a]
        back = np.zeros((steps, len(mine), N_TAGS), np.int8)
        for k in range(1, steps):
            live = int(np.searchsorted(n, k, side="right"))  # lines are in order of length
            step = score[live:, :, None] + trans
            back[k, live:] = step.argmax(axis=1)
            score[live:] = step.max(axis=1) + emission[a[live:] + k]
        tag = score.argmax(axis=1)
        for k in range(steps - 1, -1, -1):
            live = int(np.searchsorted(n, k, side="right"))
            best[a[live:] + k] = tag[live:]
            if k:
                tag[live:] = back[k, np.arange(live, len(mine)), tag[live:]]
        at = stop
    return best


class Field:
    """Weights of a trained field: shape features by reach, cues by reach, transitions."""

    def __init__(self, feature_names: list[str], shape_weights: np.ndarray, cue_weights: np.ndarray, trans: np.ndarray):
        self.features = {f: k for k, f in enumerate(feature_names)}
        self.shape_weights, self.cue_weights, self.trans = shape_weights, cue_weights, trans
        self.table = np.zeros((2 * REACH + 1, 0, N_TAGS), np.float32)
        self.reader = Reader()

    def __getstate__(self):
        return list(self.features), self.shape_weights, self.cue_weights, self.trans

    def __setstate__(self, state):
        self.__init__(*state)

    def _emission(self, shape: np.ndarray, cue: np.ndarray, line: np.ndarray) -> np.ndarray:
        known = self.table.shape[1]
        if known < len(self.reader.names):
            new = np.zeros((2 * REACH + 1, len(self.reader.names) - known, N_TAGS), np.float32)
            for k, name in enumerate(self.reader.names[known:]):
                ids = [self.features[f] for f in shape_features(name) if f in self.features]
                new[:, k] = self.shape_weights[:, ids].sum(axis=1)
            self.table = np.concatenate([self.table, new], axis=1)
        out = np.zeros((len(shape), N_TAGS), np.float32)
        for reach in range(-REACH, REACH + 1):
            near_shape, near_cue = neighbours(shape, cue, line, reach)
            out += self.table[reach + REACH][near_shape] + self.cue_weights[reach + REACH][near_cue]
        if len(self.reader.names) > 1 << 17:  # shapes are kept for the next batch, up to a bound
            self.reader, self.table = Reader(), self.table[:, :0]
        return out

    def tagged(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, str, int, int]]:
        """Stretches (row, kind, first byte, last byte + 1) of the best tags, bytes counted in their row."""
        starts, ends, row, line, shape, cue = self.reader.read(data, offsets, all_lines=False)
        if not len(starts):
            return []
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        length = np.diff(np.append(first, len(line)))
        tags = viterbi(self._emission(shape, cue, line), first, length, self.trans)
        begins = np.flatnonzero(tags % 2 == 1)  # B of any kind
        goes_on = np.append((tags > 0) & (tags % 2 == 0), False)
        out = []
        for k in begins.tolist():
            stop = k + 1
            while goes_on[stop] and line[stop] == line[k]:
                stop += 1
            base = offsets[row[k]]
            out.append((int(row[k]), KINDS[(int(tags[k]) - 1) // 2], int(starts[k] - base), int(ends[stop - 1] - base)))
        return out


def neighbours(shape: np.ndarray, cue: np.ndarray, line: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Shape and cue of the word ``reach`` words on in the same line; the edge's beyond it."""
    if not reach:
        return shape, cue
    at = np.clip(np.arange(len(shape)) + reach, 0, len(shape) - 1)
    inside = (at == np.arange(len(shape)) + reach) & (line[at] == line)
    return np.where(inside, shape[at], 0), np.where(inside, cue[at], 0)


def gradient(emission: np.ndarray, gold: np.ndarray, first: np.ndarray, length: np.ndarray, trans: np.ndarray):
    """Log-likelihood of all lines, and its derivative by emission and by transition, by forward and backward sums
    that are scaled to one at every step."""
    steps = int(length.max())
    top = emission.max(axis=1)
    em = _padded(np.exp(emission - top[:, None]), length, first, steps)
    went = np.exp(trans)
    live = [np.flatnonzero(length > k) for k in range(steps)]
    fore, rear = np.zeros_like(em), np.zeros_like(em)
    scale = np.ones((steps, len(length)))
    for k in range(steps):
        at = live[k]
        here = (fore[k - 1, at] @ went if k else np.exp(starts_allowed())) * em[k, at]
        scale[k, at] = here.sum(axis=1)
        fore[k, at] = here / scale[k, at][:, None]
    d_trans = np.zeros((N_TAGS, N_TAGS))
    rear[length - 1, np.arange(len(length))] = 1
    for k in range(steps - 1, 0, -1):
        at = live[k]
        ahead = em[k, at] * rear[k, at] / scale[k, at][:, None]
        d_trans -= went * (fore[k - 1, at].T @ ahead)
        rear[k - 1, at] = ahead @ went.T
    d_em = np.zeros((len(emission), N_TAGS))
    value = -np.log(scale).sum() - top.sum() + emission[np.arange(len(gold)), gold].sum()
    for k in range(steps):
        at = first[live[k]] + k
        d_em[at] -= fore[k, live[k]] * rear[k, live[k]]
        d_em[at, gold[at]] += 1
        if k:
            value += trans[gold[at - 1], gold[at]].sum()
            np.add.at(d_trans, (gold[at - 1], gold[at]), 1)
    return value, d_em, d_trans


def train(rows: list[tuple[str | None, list[tuple[str, int, int]]]], steps: int = 150, rate: float = 0.15, penalty: float = 0.02) -> Field:
    """Fit a field to texts with labelled spans (kind, start, end in code points) by Adam on all rows at once."""
    if not rows:
        raise ValueError("the labelled table has no rows")
    reader = Reader()
    texts = [(t or "").encode() for t, _ in rows]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts, ends, _, line, shape, cue = reader.read(data, offsets)
    gold = np.zeros(len(starts), np.int64)
    for k, (text, spans) in enumerate(rows):
        for kind, a, b in spans:
            a, b = (offsets[k] + len(text[:x].encode()) for x in (a, b))
            inside = np.flatnonzero((starts < b) & (ends > a))
            gold[inside] = 2 + 2 * KINDS.index(kind)
            gold[inside[:1]] = 1 + 2 * KINDS.index(kind)
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    length = np.diff(np.append(first, len(line)))
    told = [shape_features(s) for s in reader.names]
    names = sorted({f for fs in told for f in fs})
    number = {f: k for k, f in enumerate(names)}
    holds = np.zeros((len(told), len(names)), np.float32)
    for k, fs in enumerate(told):
        holds[k, [number[f] for f in fs]] = 1
    near = [neighbours(shape, cue, line, r) for r in range(-REACH, REACH + 1)]
    params = [np.zeros((2 * REACH + 1, len(names), N_TAGS)), np.zeros((2 * REACH + 1, len(reader.cue_names) + 1, N_TAGS)), np.zeros((N_TAGS, N_TAGS))]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        table = holds @ params[0]
        emission = sum(table[r][s] + params[1][r][c] for r, (s, c) in enumerate(near))
        _, d_em, d_trans = gradient(emission, gold, first, length, params[2] + allowed())
        d_table, d_cue = np.zeros_like(table), np.zeros_like(params[1])
        for r, (s, c) in enumerate(near):
            np.add.at(d_table[r], s, d_em)
            np.add.at(d_cue[r], c, d_em)
        for k, d in enumerate((holds.T @ d_table, d_cue, d_trans)):
            d = d - penalty * params[k]
            mean[k] = 0.9 * mean[k] + 0.1 * d
            square[k] = 0.999 * square[k] + 0.001 * d * d
            params[k] += rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return Field(names, params[0].astype(np.float32), params[1].astype(np.float32), (params[2] + allowed()).astype(np.float32))


# ---------------------------------------------------------------- spans

#: An address written out: its sign for @ and for the dot, bare words among them (fixed values).
AT_SIGN = r"(?:\s*@\s*|\s*[\[({<]\s*at\s*[\])}>]\s*|\s(?:at|arobase)\s)"
DOT_SIGN = r"(?:\s?\.\s?|\s*[\[({<]\s*dot\s*[\])}>]\s*|\s(?:dot|punkt|punto|point)\s)"
BARE = re.compile(r"\s(?:at|arobase|dot|punkt|punto|point)\s", re.I)
#: Endings that an address in bare words must have, since "look at the dot on" is one by its form (fixed values).
ENDINGS = frozenset("com net org edu gov io info co uk de fr es it nl ch at eu us ca au in jp br ru pl se no dk fi be pt".split())

#: What a span of a kind is within a tagged stretch (fixed values).
CORES = {
    "email": re.compile(rf"[A-Za-z0-9][A-Za-z0-9._%+-]*{AT_SIGN}[A-Za-z0-9-]+(?:{DOT_SIGN}[A-Za-z0-9-]+)*{DOT_SIGN}[A-Za-z]{{2,}}", re.I),
    "ip": re.compile(r"[0-9A-Fa-f:].*[0-9A-Fa-f:]", re.S),
    "card": re.compile(r"[0-9].*[0-9]", re.S),
    "phone": re.compile(r"[(+0-9].*[0-9]", re.S),
}


def is_sixth(text: str) -> bool:
    """Whether a text is an IPv6 address."""
    if text.count("::") > 1 or not re.fullmatch(r"[0-9A-Fa-f:]+", text):
        return False
    parts = text.split(":")
    filled = [p for p in parts if p]
    return all(len(p) <= 4 for p in filled) and (len(filled) == len(parts) == 8 or ("::" in text and 2 <= len(filled) <= 7))


def holds(kind: str, text: str) -> bool:
    """The check of a kind on the text of a span."""
    if kind == "card":
        return is_card(text)
    if kind == "phone":
        return 7 <= len(digits_of(text)) <= 15 and re.fullmatch(r"[+(0-9][-0-9 ()./]*[0-9]", text) is not None
    if kind == "ip":
        plain = re.sub(r"\s*[\[({]?\s*(?:\.|\bdot\b)\s*[\])}]?\s*", ".", text, flags=re.I)
        return is_sixth(text) or (re.fullmatch(r"[0-9]+(\.[0-9]+){3}", plain) is not None and is_quad(plain))
    return len(text) <= 320 and (BARE.search(text) is None or re.split(r"[^A-Za-z]", text)[-1].lower() in ENDINGS)


def spans_of(text: str, tagged: list[tuple[str, int, int]]) -> list[tuple[str, int, int, bool]]:
    """Spans of the patterns, and of the tagged stretches (kind, start, end) that hold and overlap none of them."""
    base = patterns(text)
    begins, reach = [x for _, x, _ in base], list(accumulate((y for _, _, y in base), max))
    out = [(*s, True) for s in base]
    for kind, a, b in tagged:
        core = CORES[kind].search(text, a, b)
        while core and kind == "phone" and core.group()[0] == "(" and core.group().count("(") > core.group().count(")"):
            core = CORES[kind].search(text, core.start() + 1, core.end())
        if core and holds(kind, core.group()):
            before = bisect_left(begins, core.end())
            if not before or reach[before - 1] <= core.start():
                out.append((kind, *core.span(), False))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _finder(field: Field):
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(item))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in slices(batch.column("text"), SLICE):
                n = len(offsets) - 1
                tagged: dict[int, list] = {}
                for k, kind, a, b in field.tagged(data, offsets):
                    tagged.setdefault(k, []).append((kind, a, b))
                signs = np.concatenate([[0], np.cumsum((data == 64) | ((data >= 48) & (data < 58)))])
                asked = np.flatnonzero(np.diff(signs[offsets]) > 0).tolist()
                found = [[] for _ in range(n)]
                for k in sorted({*asked, *tagged}):
                    raw = data[offsets[k] : offsets[k + 1]].tobytes()
                    in_points = []
                    if k in tagged:
                        begins = np.concatenate([[0], np.cumsum((data[offsets[k] : offsets[k + 1]] & 0xC0) != 0x80)])
                        in_points = [(kind, int(begins[a]), int(begins[b])) for kind, a, b in tagged[k]]
                    found[k] = spans_of(raw.decode(), in_points)
                flat = [s for spans in found for s in spans]
                bounds = np.concatenate([[0], np.cumsum([len(s) for s in found])])
                values = pa.StructArray.from_arrays([pa.array([s[c] for s in flat], item.field(c).type) for c in range(4)], fields=list(item))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, n), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)], schema=schema)

    return find


def learn(labelled: DataFrame) -> Field:
    """A field trained on a labelled table of (text, spans array<struct<kind, start, end>>)."""
    rows = labelled.select("text", "spans").limit(MAX_LABELLED + 1).collect()
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"the labelled table has more than {MAX_LABELLED} rows")
    return train([(r["text"], [tuple(s) for s in r["spans"] or []] if r["text"] else []) for r in rows])


def find(docs: DataFrame, field: Field) -> DataFrame:
    """A row for each document with its spans in order; ``base`` tells those of the patterns."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_finder(field), SPANS)
