"""A small labelled table for ``personal``: sentences with personal data of known places, made by a rule from a seed.

Every sentence is a few filler words, one piece, and a few filler words. Pieces are personal data in plain and in
written-out forms, or plain text that looks like it: dates, prices, versions, measures, identifiers, long numbers.
"""

from __future__ import annotations

import random

from greenlight.llm.personal import luhn

SCHEMA = "text string, spans array<struct<kind: string, start: int, end: int>>"

#: Parts of the sentences (fixed values).
FILLER = (
    "the of and to in was for on with that this from by are not he she it you we they have had but all one when there can more at point "
    "le la les des une pour dans est que qui avec sur pas plus der die das und ist nicht mit von den ein auf el los las por con una para como "
    "time people way day man thing woman life child world school state family student group country problem hand part place case week"
).split()
NAMES = "anna bo carla dev erik fatima goran hana ivan julia kofi lena marc nora otto pia ravi sara tom uma".split()
HOSTS = "example mailbox inbox acme orbit lumen delta posteo webpost fastnet".split()
ENDS = "com net org de fr es io co.uk info edu".split()
PHONE_CUES = ["call", "phone:", "tel.", "Tel:", "call me at", "mobile", "text", "fax:", "appelez le", "Telefon", "llame al", "phone number is"]
CARD_CUES = ["card", "visa", "card number", "carte", "Karte", "tarjeta", "paid with card", "mastercard"]
MAIL_CUES = ["mail", "write to", "contact", "e-mail:", "reach me at", "courriel", "correo", "email"]
IP_CUES = ["host", "server", "ip", "address", "client", "from"]


def _number(rng: random.Random, n: int) -> str:
    return str(rng.randint(1, 9)) + "".join(str(rng.randint(0, 9)) for _ in range(n - 1))


def _card(rng: random.Random, n: int = 16, right: bool = True) -> str:
    digits = rng.choice("45") + "".join(str(rng.randint(0, 9)) for _ in range(n - 2))
    last = next(d for d in "0123456789" if luhn(digits + d))
    return digits + (last if right else str((int(last) + rng.randint(1, 9)) % 10))


def _grouped(text: str, sizes: list[int], sign: str) -> str:
    out = []
    for n in sizes:
        out.append(text[:n])
        text = text[n:]
    return sign.join(out)


def _quad(rng: random.Random, most: int = 255) -> list[str]:
    return [str(rng.randint(1, most)) for _ in range(4)]


def _sixth(rng: random.Random) -> str:
    parts = [f"{rng.randint(1, 65535):x}" for _ in range(8)]
    if rng.random() < 0.5:
        return ":".join(parts)
    a, b = rng.randint(1, 3), rng.randint(1, 4)
    return ":".join(parts[:a]) + "::" + ":".join(parts[-b:])


def personal(rng: random.Random) -> tuple[str, str, str]:
    """Kind, cue and text of one piece of personal data."""
    kind = rng.choice(("email", "email", "ip", "card", "phone", "phone"))
    if kind == "email":
        name = rng.choice(NAMES) + rng.choice(["", f".{rng.choice(NAMES)}", f"_{rng.randint(1, 99)}", str(rng.randint(1, 99))])
        host, end = rng.choice(HOSTS), rng.choice(ENDS)
        text = rng.choice(["{}@{}.{}", "{}@{}.{}", "{} [at] {} [dot] {}", "{} (at) {} (dot) {}", "{} at {} dot {}", "{}[at]{}[dot]{}", "{}(at){}.{}", "{} @ {}.{}", "{} [at] {}.{}", "{} @ {} . {}"])
        return kind, rng.choice(["", "", rng.choice(MAIL_CUES)]), text.format(name, host, end)
    if kind == "ip":
        sign = rng.choice([".", ".", "[.]", "[dot]", ":"])
        text = _sixth(rng) if sign == ":" else sign.join(_quad(rng))
        return kind, rng.choice(["", rng.choice(IP_CUES)]), text
    if kind == "card":
        sizes = rng.choice([[16], [4, 4, 4, 4], [4, 4, 4, 4], [4, 4, 4, 4], [4, 6, 5]])
        return kind, rng.choice(["", "", rng.choice(CARD_CUES)]), _grouped(_card(rng, sum(sizes)), sizes, rng.choice([" ", "-", ".", "/", "_", " - "]))
    form = rng.randint(0, 8)
    a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
    cue = rng.choice(PHONE_CUES)
    if form <= 2:
        return kind, rng.choice(["", cue]), rng.choice([f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"+{rng.randint(1, 99)}-{a}-{b}-{c}", f"+{a}{b}{c}"])
    if form <= 5:
        return kind, rng.choice(["", cue]), rng.choice([f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"({a}){b}-{c}", f"1-{a}-{b}-{c}"])
    return kind, cue, rng.choice([f"{a}.{b}.{c}", f"{a} {b} {c}", f"0{a}/{b}{c}", f"0{a[:2]} {b}{c}", f"00{rng.randint(1, 99)} {a} {b}{c}", f"{a}{b}{c}", f"0{a[:1]} {b[:2]} {b[1:]} {c[:2]} {c[2:]}", f"{b}-{c}", f"1 {a} {b} {c}"])


def plain(rng: random.Random) -> str:
    """A piece that isn't personal data."""
    d, m, y = rng.randint(1, 28), rng.randint(1, 12), rng.randint(1900, 2030)
    quad = _quad(rng)
    quad[rng.randint(0, 3)] = str(rng.randint(256, 999))
    n = lambda: str(rng.randint(0, 10 ** rng.randint(1, 5)))
    return rng.choice([
        f"{y}-{m:02}-{d:02}", f"{d:02}/{m:02}/{y}", f"{d}.{m}.{y}", f"{m}/{d}/{y % 100:02}", f"{rng.randint(0, 23)}:{rng.randint(10, 59)}", f"{m:02}:{d:02}:{rng.randint(10, 59)}",
        f"{rng.randint(1, 9)}.{rng.randint(0, 20)}", f"v{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", f"{rng.randint(1, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 99)}",
        f"${rng.randint(1, 999)},{_number(rng, 3)}.{rng.randint(10, 99)}", f"{_number(rng, 3)},{_number(rng, 3)}", f"{rng.randint(1, 99)}%", f"{n()} {n()} {n()}", f"{n()} {n()} {n()} {n()} {n()}",
        f"978-{rng.randint(0, 9)}-{_number(rng, 2)}-{_number(rng, 6)}-{rng.randint(0, 9)}", f"#{_number(rng, rng.randint(3, 8))}", f"order {_number(rng, 10)}", f"number {_number(rng, 10)}",
        f"{y}-{y + rng.randint(1, 9)}", f"{rng.randint(1, 99)}-{rng.randint(100, 199)}", f"{rng.randint(1, 9)} * {rng.randint(1, 9)} + {rng.randint(1, 99)}", f"{rng.randint(0, 9)}:{rng.randint(0, 9)}",
        _card(rng, 16, right=False), _grouped(_card(rng, 16, right=False), [4] * 4, rng.choice(" -")), _number(rng, rng.randint(4, 19)), ".".join(quad), f"token = \"{rng.getrandbits(160):040x}\"", f"{rng.getrandbits(64):016x}",
        ":".join(f"{rng.randint(0, 255):02x}" for _ in range(6)), f"a {rng.choice(['dot', 'point'])} on the {rng.choice(FILLER)}", f"look at {rng.choice(FILLER)}", f"at {d}:{m:02}", f"@{rng.choice(NAMES)}", f"{n()} @ ${m}.{d:02}",
        f"page {n()}", f"www.{rng.choice(HOSTS)}.{rng.choice(ENDS)}", f"https://{rng.choice(HOSTS)}.{rng.choice(ENDS)}/a{n()}", f"({rng.randint(1, 99)})", f"[{rng.randint(1, 99)}]", f"({y})", f"room {_number(rng, 3)}-{_number(rng, 4)}",
        f"{_number(rng, 3)}-{_number(rng, 4)}", f"part {_number(rng, 3)}.{_number(rng, 3)}.{_number(rng, 4)}", f"{_number(rng, 3)} {_number(rng, 3)} {_number(rng, 4)}", rng.choice(PHONE_CUES + CARD_CUES + MAIL_CUES + IP_CUES),
    ])


def labelled(rows: int = 1200, seed: int = 13) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Sentences and their spans (kind, start, end)."""
    rng = random.Random(seed)
    out = []
    for _ in range(rows):
        text, spans = "", []
        most = rng.choice((0, 5, 5, 5, 5))  # some sentences are the piece alone
        for _ in range(rng.choice((1, 1, 2)) if most else 1):
            before = [rng.choice([w, w, w.upper(), w.capitalize() + ","]) for w in rng.choices(FILLER, k=rng.randint(0, most))]
            if rng.random() < 0.5:
                text += " ".join([*before, plain(rng)]) + " "
                continue
            kind, cue, piece = personal(rng)
            text += "".join(w + " " for w in [*before, *([cue] if cue else [])]) + rng.choice(["", "", "", "(", '"'])
            spans.append((kind, len(text), len(text) + len(piece)))
            text += piece + rng.choice(["", "", "", ".", ",", ")", "!", "***", "&&&", ";"]) + " "
        text += " ".join(rng.choices(FILLER, k=rng.randint(0, most)))
        out.append((text, spans))
    return out
