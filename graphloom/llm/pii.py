"""Personal data: detected entities are replaced by keyed surrogates of the same type, gender, script and format.

Numbers, addresses and secrets go through a keyed permutation of all strings of their own format (a Feistel network
walked until it lands in the format), so distinct entities can't meet and equal ones stay equal in every document. Names
are drawn by a keyed hash from names of the same gender and script; those draws can meet, so all distinct names of the
corpus are checked against each other (and against names that occur), and the later ones are drawn again. Within a
document the full and short forms of a person's name, with a title or without, share one draw.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import hmac
import ipaddress
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import checkpointed, claim, mapped, pieces, raw_texts

#: Redrawn names that a broadcast may carry (some 100 bytes each); four syllables and a given name give 2**33 draws,
#: so a hundred million distinct names leave about 600 000 to redraw. More than this bound is an error, not a loss.
MOST_REDRAWN = 1_000_000

_TITLES = {
    "m": "Mr|Mister|Sir|Herr|Herrn|Monsieur|Señor|Sr|Don|господин|г-н|κύριος",
    "f": "Mrs|Ms|Miss|Madam|Frau|Mme|Mlle|Madame|Mademoiselle|Señora|Señorita|Sra|Srta|Doña|госпожа|г-жа|κυρία",
    "n": "Dr|Prof|Professor|Doktor|Docteur|Doctor|Mx",
}
_GENDER = {t: g for g, ts in _TITLES.items() for t in ts.split("|")}
_GIVEN = {
    ("Latin", "m"): "Adrian Bastian Conrad Dorian Edgar Florian Gustav Hector Julian Leander Magnus Nestor Oswald Quentin Roland Tristan",
    ("Latin", "f"): "Adela Beatrix Celia Dorothea Elvira Flora Greta Helena Irina Livia Marina Noemi Ottilie Paloma Rosalind Sabina",
    ("Latin", "n"): "Alexis Andrea Ariel Camille Charlie Dominique Eden Jules Kim Maxime Morgan Noa Robin Sascha Sidney Yael",
    ("Cyrillic", "m"): "Антон Борис Вадим Глеб Денис Егор Захар Илья Кирилл Леонид Макар Никита Олег Павел Роман Тимур",
    ("Cyrillic", "f"): "Алла Белла Вера Галина Дарья Ева Зоя Инна Кира Лада Майя Нина Ольга Полина Римма Тамара",
    ("Greek", "m"): "Αλέξανδρος Βασίλης Γιώργος Δημήτρης Ευάγγελος Ζήσης Ηλίας Θωμάς",
    ("Greek", "f"): "Αθηνά Βάσω Γεωργία Δήμητρα Ελένη Ζωή Ηρώ Θάλεια",
}
_SYLLABLES = {
    "Latin": [c + v for c in "b c d f g h j k l m n p r s t v".split() for v in "a e i o u an el or".split()],
    "Cyrillic": [c + v for c in "б в г д ж з к л м н п р с т ф х".split() for v in "а е и о у ан ел ор".split()],
    "Greek": [c + v for c in "β γ δ ζ θ κ λ μ ν π ρ σ τ φ χ ψ".split() for v in "α ε ι ο υ αν ελ ορ".split()],
}
_CAP = r"\p{Lu}[\p{L}'’-]*\p{L}"
_START, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: In order of precedence where they overlap.
PATTERNS = [
    ("EMAIL", regex.compile(_START + r"[\p{L}\p{N}](?:[\p{L}\p{N}._%+-]*[\p{L}\p{N}_%+-])?@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?\.)+\p{L}{2,}")),
    ("SECRET", regex.compile(r"(?<![\p{L}\p{N}_-])(?:sk[-_](?:live[-_]|test[-_])?|gh[pousr]_|github_pat_|AKIA|ASIA|xox[abprs]-|AIza|glpat-)[A-Za-z0-9_-]{12,}")),
    ("SECRET", regex.compile(r"(?<![\p{L}\p{N}_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]*)?")),
    ("SECRET", regex.compile(r"""(?i)(?<![\p{L}\p{N}])(?:password|passwd|pwd|passphrase|secret)["']?[ \t]{0,4}(?:=>|:=|==|[:=])[ \t]{0,4}(?:"(?P<v>[^"\s]+)"|'(?P<v>[^'\s]+)'|(?P<v>\S+?)(?=[.,;:)\]}>"']*(?:\s|$)))""")),
    ("SECRET", regex.compile(r"(?i)(?<![\p{L}\p{N}])(?:api[ _-]?key|key|secret|token|password|passwd|pwd)\W{0,8}\s?[:=]\W{0,8}?[\"']?(?P<v>[A-Za-z0-9_+/~-]{8,}=*)")),
    ("SECRET", regex.compile(_START + r"(?:[0-9a-f]{32,}|[0-9A-F]{32,})" + _END)),
    ("IBAN", regex.compile(_START + r"[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?" + _END)),
    ("MAC", regex.compile(_START + r"[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}" + _END)),
    ("IPV6", regex.compile(r"(?<![\p{L}\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:(?:[0-9A-Fa-f]{1,4}:){1,7}|:):(?:[0-9A-Fa-f]{1,4}:)*(?:(?:\d{1,3}\.){3}\d{1,3}|[0-9A-Fa-f]{1,4})?|(?:[0-9A-Fa-f]{1,4}:){6}(?:\d{1,3}\.){3}\d{1,3})(?![\p{L}\p{N}:]|\.\d)")),
    ("IPV4", regex.compile(r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\d)")),
    ("CARD", regex.compile(_START + r"(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|3[47]\d{2}[ -]\d{6}[ -]\d{5})" + _END)),
    ("SSN", regex.compile(_START + r"\d{3}-\d{2}-\d{4}" + _END)),
    ("PHONE", regex.compile(r"(?<![\p{L}\p{N}])(?:\+|00)\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}" + _END)),
    ("PHONE", regex.compile(r"(?<![\p{L}\p{N}+])(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4}" + _END)),
    ("NUMBER", regex.compile(_START + r"\d{9,}" + _END)),
    ("NAME", regex.compile(_START + r"(?P<t>" + "|".join(sorted(_GENDER, key=len, reverse=True)) + r")\.?[ ](?P<v>" + _CAP + r"(?:[ ]" + _CAP + r"){0,2})")),
    ("NAME", regex.compile(r"(?i:my name is|name:|ich heiße|je m'appelle|me llamo|меня зовут)[ ](?P<v>" + _CAP + r"(?:[ ]" + _CAP + r"){0,2})")),
]
#: Says outright that a secret follows: with or without digits.
_LABELLED = next(p for _, p in PATTERNS if "passphrase" in p.pattern)
_labels = regex.compile(rb"(?i)passw|pwd|passphrase|secret")
_possessive = regex.compile(r"['’]s(?=[ ]|$)")
_named = regex.compile(_START + _CAP + _END)
_quick = regex.compile(rb"[0-9@]|::")
_titles = [t.encode() for t in _GENDER]
_spoken = [x.encode() for x in ("y name is", "ame:", "ch heiße", "e m'appelle", "e llamo", "еня зовут")]


def entities(text: str, raw: bytes | None = None) -> list[tuple[int, int, str, str]]:
    """start, end, type, gender of what is found, in order, without overlap."""
    return [e[:4] for e in detected(text, raw)]


def detected(text: str, raw: bytes | None = None) -> list[tuple[int, int, str, str, str, tuple[int, ...]]]:
    """As entities(), and of names the person's whole name, case-folded, and which of its parts stand there."""
    raw = text.encode() if raw is None else raw
    numeric = _quick.search(raw) is not None
    named = any(t in raw for t in _titles) or any(t in raw for t in _spoken)
    labelled = _labels.search(raw) is not None
    if not numeric and not named and not labelled:
        return []
    found: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []
    for kind, pattern in PATTERNS:
        if not (named if kind == "NAME" else labelled if pattern is _LABELLED else numeric):
            continue
        for m in pattern.finditer(text):
            i, j = m.span("v") if "v" in pattern.groupindex else m.span()
            if kind == "SECRET" and pattern is not _LABELLED and not any(c.isdigit() for c in text[i:j]):
                continue
            if kind == "IPV6" and not _is_ipv6(text[i:j]):
                continue
            if kind == "NAME" and (own := _possessive.search(text[i:j])):
                j = i + own.start()
            if all(j <= a or i >= b for a, b in taken):
                taken.append((i, j))
                found.append((i, j, kind, _GENDER.get(m["t"], "n") if "t" in pattern.groupindex else "n"))
    return sorted(linked(text, found))


def _is_ipv6(text: str) -> bool:
    """Whether it is an address, with a digit or groups of four, so that a::b of a program isn't."""
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return text.count(":") == 7 or any(c.isdigit() for c in text) or all(len(x) == 4 for x in text.split(":") if x) and any(text.split(":"))


def _parts_of(whole: tuple[str, ...], form: tuple[str, ...]) -> tuple[int, ...]:
    """Which parts of a whole name a form has: all, the first and the last, the surname, or the given name; else none."""
    if form == whole:
        return tuple(range(len(whole)))
    if len(form) == 2 and len(whole) > 2 and form == (whole[0], whole[-1]):
        return 0, len(whole) - 1
    if len(form) == 1:
        return (len(whole) - 1,) if form[0] == whole[-1] else (0,) if form[0] == whole[0] else ()
    return ()


def linked(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str, str, tuple[int, ...]]]:
    """The entities with names joined to persons, and what else of the text repeats a person's name or a part of it.

    A form belongs to the person of fitting gender mentioned last before it (else next after it) whose name has it; a
    person has the gender of any of its mentions. Words count as a repeat only if capitalised.
    """
    names = [(i, j, g, tuple(text[i:j].casefold().split(" "))) for i, j, kind, g in found if kind == "NAME"]
    if not names:
        return [(*e, "", ()) for e in found]
    people: list[tuple[tuple[str, ...], list[str], list[int]]] = []  # whole name, gender, places
    having: dict[tuple[str, ...], list[int]] = {}
    whose: dict[int, int] = {}

    def nearest(form: tuple[str, ...], gender: str, at: int) -> int | None:
        best = None
        for p in having.get(form, ()):
            if gender == "n" or people[p][1][0] in ("n", gender):
                places = people[p][2]
                k = bisect.bisect_right(places, at)
                far = (0, at - places[k - 1], p) if k else (1, places[0] - at, p)
                best = far if best is None or far < best else best
        return None if best is None else best[2]

    # whole names before their short forms, and those of known gender before the others
    for i, _, g, form in sorted(names, key=lambda n: (-len(n[3]), n[2] == "n", n[0])):
        p = nearest(form, g, i)
        if p is None:
            p = len(people)
            people.append((form, [g], []))
            for own in {form, (form[0], form[-1]) if len(form) > 2 else form, form[:1], form[-1:]}:
                having.setdefault(own, []).append(p)
        elif g != "n":
            people[p][1][0] = g
        bisect.insort(people[p][2], i)
        whose[i] = p
    out = []
    for i, j, kind, g in found:
        if kind == "NAME":
            whole, gender, _ = people[whose[i]]
            out.append((i, j, kind, gender[0], " ".join(whole), _parts_of(whole, tuple(text[i:j].casefold().split(" ")))))
        else:
            out.append((i, j, kind, g, "", ()))
    taken = sorted((i, j) for i, j, _, _ in found)
    words = []
    for m in _named.finditer(text):
        i, j = m.span()
        words.append((i, j - 2 if text[j - 2 : j] in ("'s", "’s") else j))
    k = 0
    while k < len(words):
        for n in (3, 2, 1):
            part = words[k : k + n]
            i, j = part[0][0], part[-1][1]
            form = tuple(text[a:b].casefold() for a, b in part)
            if len(part) < n or form not in having or any(text[a[1] : b[0]].strip() or a[1] == b[0] for a, b in zip(part, part[1:])):
                continue
            t = bisect.bisect_left(taken, (j, 0))
            if t and taken[t - 1][1] > i:
                continue
            whole, gender, _ = people[p := nearest(form, "n", i)]
            out.append((i, j, "NAME", gender[0], " ".join(whole), _parts_of(whole, form)))
            bisect.insort(people[p][2], i)
            k += n - 1
            break
        k += 1
    return out


class Surrogates:
    """Keyed replacements; `redrawn` has the number of draws of those names whose first draw met another name's."""

    def __init__(self, key: bytes, redrawn: dict[str, int] | None = None):
        self.key, self.redrawn, self.known = key, redrawn or {}, {}

    def digest(self, *parts: object) -> bytes:
        return hmac.new(self.key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest()

    def permute(self, x: int, size: int, tweak: str, back: bool = False) -> int:
        """A keyed permutation of range(size), or its inverse: eight Feistel rounds over the next even number of bits, walked
        until inside."""
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            a, b = x >> half, x & mask
            for r in reversed(range(8)) if back else range(8):
                if back:
                    a, b = b ^ (int.from_bytes(self._round(tweak, size, r, a, half), "big") & mask), a
                else:
                    a, b = b, a ^ (int.from_bytes(self._round(tweak, size, r, b, half), "big") & mask)
            x = a << half | b
            if x < size:
                return x

    def moved(self, x: int, size: int, tweak: str) -> int:
        """A keyed permutation of range(size) that is one cycle: it moves every number, and so does a walk along it to the
        next number of any kind that has two."""
        return self.permute((self.permute(x, size, tweak) + 1) % size, size, tweak, back=True)

    def _round(self, tweak: str, size: int, r: int, b: int, half: int) -> bytes:
        d = self.digest(tweak, size, r, b)
        return d if half <= 256 else b"".join(self.digest(tweak, size, r, b, i) for i in range(-(-half // 256)))

    def shaped(self, text: str, tweak: str, fits=lambda s: True) -> str:
        """The text under a permutation of all texts of its shape that moves each of them: each letter or digit varies in its
        class, the rest stays."""
        letters = [c for c in text if c.isalnum()]
        hexes = len(letters) >= 32 or tweak in ("MAC", "IPV6")
        hexed = hexes and all(c in "0123456789abcdef" for c in letters)
        hexed_up = hexes and not hexed and all(c in "0123456789ABCDEF" for c in letters)
        classes = []
        for c in text:
            if hexed and c.isalnum():
                classes.append("0123456789abcdef")
            elif hexed_up and c.isalnum():
                classes.append("0123456789ABCDEF")
            else:
                classes.append(_class_of(c))
        if not any(classes):  # a secret of marks only
            classes = [_MARKS if c in _MARKS else "" for c in text]
        mask = "".join("." if k else c for c, k in zip(text, classes)) + "".join(k[:1] for k in classes)
        size, x = 1, 0
        for c, k in zip(text, classes):
            if k:
                size *= len(k)
                x = x * len(k) + (k.index(c) if len(k) < 64 else bisect.bisect_left(k, c))
        if size == 1:
            return text
        while True:
            x = self.moved(x, size, f"{tweak} {mask}")
            y, out = x, []
            for c, k in zip(reversed(text), reversed(classes)):
                if k:
                    y, d = divmod(y, len(k))
                    c = k[d]
                out.append(c)
            made = "".join(reversed(out))
            if fits(made):
                return made

    def name(self, text: str, gender: str, draw: int) -> str:
        """A name of as many parts in the same script and gender; a single part is a surname."""
        parts = text.split(" ")
        script = next((s for s in ("Cyrillic", "Greek") if regex.search(rf"\p{{{s}}}", text)), "Latin")
        d = int.from_bytes(self.digest("name", gender, draw, text.casefold()), "big")
        given = (_GIVEN.get((script, gender)) or _GIVEN.get((script, "m"))).split()
        out = []
        for i, p in enumerate(parts):
            if i < len(parts) - 1:
                d, r = divmod(d, len(given))
                made = given[r]
            else:
                made = ""
                for _ in range(4):
                    d, r = divmod(d, 128)
                    made += _SYLLABLES[script][r]
                made = made.capitalize()
            out.append(made.upper() if len(p) > 1 and p.isupper() else made)
        return " ".join(out)

    def mention(self, text: str, whole: str, gender: str, parts: tuple[int, ...]) -> str:
        """What stands for a form of a person's name: those parts of the whole name's surrogate, spaced and capitalised alike."""
        made, out = self.of(whole, "NAME", gender).split(" "), regex.split(r"(\s+)", text)
        for n, k in enumerate(parts):
            out[2 * n] = made[k].upper() if len(out[2 * n]) > 1 and out[2 * n].isupper() else made[k]
        return "".join(out)

    def of(self, text: str, kind: str, gender: str = "n") -> str:
        """The surrogate of an entity."""
        key = (text, kind, gender)
        if key not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[key] = self._make(text, kind, gender)
        return self.known[key]

    def _make(self, text: str, kind: str, gender: str) -> str:
        if kind == "NAME":
            return self.name(text, gender, self.redrawn.get(f"{gender} {text.casefold()}", 0))
        if kind == "EMAIL":
            local, _, domain = text.partition("@")
            *labels, top = domain.split(".")
            return self.shaped(local, "local") + "@" + ".".join([*[self.shaped(x, "label") for x in labels], top])
        if kind == "IPV4":
            x = sum(int(p) << s for p, s in zip(text.split("."), (24, 16, 8, 0)))
            block = next(((b, m) for b, m in _PRIVATE if x & ~((1 << m) - 1) == b), None)
            if block:
                x = block[0] | self.moved(x & ((1 << block[1]) - 1), 1 << block[1], f"ip {block[0]}")
            else:
                while True:
                    x = self.moved(x, 1 << 32, "ip")
                    if all(x & ~((1 << m) - 1) != b for b, m in _PRIVATE):
                        break
            return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
        if kind == "CARD":
            digits = lambda s: [int(c) for c in s if c.isdigit()]
            good = _luhn(digits(text))
            first = text[0] == "0"
            return self.shaped(text, "card", lambda s: _luhn(digits(s)) == good and (s[0] == "0") == first)
        if kind == "IBAN":
            bare = text.replace(" ", "")
            body = self.shaped(bare[4:], "iban " + bare[:2])
            if _iban_check(bare[:2] + "00" + bare[4:]) == bare[2:4]:
                made = bare[:2] + _iban_check(bare[:2] + "00" + body) + body
            else:
                made = bare[:2] + bare[2:4] + body
            chars = iter(made)
            return "".join(c if c == " " else next(chars) for c in text)
        if kind == "PHONE":
            m = regex.match(r"(?:\+|00)\d{1,3}(?=[ .-])", text)
            head = m.group() if m else ""
            return head + self.shaped(text[len(head) :], "phone " + head)
        if kind == "SECRET":
            m = regex.match(r"sk[-_](?:live[-_]|test[-_])?|gh[pousr]_|github_pat_|AKIA|ASIA|xox[abprs]-|AIza|glpat-|eyJ", text)
            head = m.group() if m else ""
            return head + self.shaped(text[len(head) :], "secret " + head)
        if kind == "NUMBER":
            first = text[0] == "0"
            return self.shaped(text, "number", lambda s: (s[0] == "0") == first)
        if kind == "IPV6" and "." in text:  # the IPv4 address at the end is what varies
            head, _, tail = text.rpartition(":")
            return f"{head}:{self.of(tail, 'IPV4')}"
        if kind in ("MAC", "IPV6"):  # their letters are digits: one case for the permutation
            return self.shaped(text.lower(), kind).upper() if text.isupper() else self.shaped(text.lower(), kind)
        return self.shaped(text, kind)


_CLASSES = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "äöüßéèêëçñóíáúâîôûàùïœæåø", "ÄÖÜÉÈÊËÇÑÓÍÁÚÂÎÔÛÀÙÏŒÆÅØ"]
_MARKS = "!#$%&()*+,-./:;<=>?@[]^_`{|}~"


@functools.cache
def _other_classes() -> dict[tuple, str]:
    """Letters and digits outside _CLASSES by script (as named by Unicode), category and block; in order."""
    made: dict[tuple, list[str]] = {}
    for n in range(0x30000):
        if (c := chr(n)).isalnum() and (k := _class_key(c)):
            made.setdefault(k, []).append(c)
    return {k: "".join(v) for k, v in made.items()}


def _class_key(c: str) -> tuple | None:
    """The script, category and block of a letter or digit outside _CLASSES: the block tells usual from rare letters."""
    if any(c in k for k in _CLASSES) or not (name := unicodedata.name(c, "")):
        return None
    return name.split()[0], unicodedata.category(c), sum(ord(c) >= n for n in (0x250, 0x1E00, 0x4E00, 0xA000, 0xAC00, 0xD7A4, 0x10000))


@functools.lru_cache(1 << 16)
def _class_of(c: str) -> str:
    """The characters that may stand for one: of its alphabet, script or, where it is alone in that, its category."""
    known = next((k for k in _CLASSES if c in k), "")
    if known or not c.isalnum() or not (key := _class_key(c)):
        return known
    own = _other_classes().get(key, "")
    return own if len(own) > 1 else "".join(sorted(x for k, x in _other_classes().items() if k[1] == key[1] and len(x) == 1))


_PRIVATE = [(10 << 24, 24), (172 << 24 | 16 << 16, 20), (192 << 24 | 168 << 16, 16), (127 << 24, 24), (0, 24), (169 << 24 | 254 << 16, 16), (224 << 24, 29)]


def _luhn(digits: list[int]) -> bool:
    return not sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10


def _iban_check(iban: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97:02d}"


def _drawn(names: DataFrame, key: bytes) -> DataFrame:
    """The surrogate of each name (gender, name, draw)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Surrogates(key)
        for b in batches:
            made = [s.name(n, g, d).casefold() for g, n, d in zip(*[b.column(i).to_pylist() for i in range(3)])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=["gender", "name", "draw", "made"])

    return mapped(names, run, "gender string, name string, draw int, made string")


def redraws(docs: DataFrame, key: bytes, text_col: str = "text") -> dict[str, int]:
    """The draw of each name whose earlier draws met another name or another name's surrogate: of names that meet, the
    first in order keeps its draw. Nothing is gathered where the corpus has no names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = set()
            for raw in raw_texts(b, "text"):
                if any(t in raw for t in _titles) or any(t in raw for t in _spoken):
                    x = raw.decode()
                    found |= {(g, whole) for _, _, k, g, whole, _ in detected(x, raw) if k == "NAME"}
            g, n = zip(*sorted(found)) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(n, pa.string())], names=["gender", "name"])

    names = checkpointed(mapped(docs.select(F.col(text_col).alias("text")), run, "gender string, name string").distinct().withColumn("draw", F.lit(0)))
    if names.isEmpty():
        return {}
    real = names.select(F.col("name").alias("made")).distinct().withColumn("real", F.lit(True))
    while True:
        made = checkpointed(_drawn(names, key).join(real, "made", "left"))
        first = made.groupBy("made").agg(F.min(F.struct("draw", "name", "gender")).alias("first"))
        again = made.join(first, "made").withColumn("again", F.col("real").isNotNull() | (F.struct("draw", "name", "gender") != F.col("first")))
        names = checkpointed(again.select("gender", "name", (F.col("draw") + F.col("again").cast("int")).alias("draw"), "again"))
        if names.where("again").isEmpty():
            break
        names = names.drop("again")
    changed = names.where("draw > 0")
    if changed.count() > MOST_REDRAWN:
        raise ValueError("more names meet than a broadcast may carry: names need more syllables")
    return {f"{r.gender} {r.name}": r.draw for r in changed.toLocalIterator()}


def replaced(docs: DataFrame, key: bytes, text_col: str = "text", with_entities: bool = False) -> DataFrame:
    """The rows with every detected entity of the text replaced; columns unchanged but for the text (and n_chars, where
    there is such a column and the text changed), plus pii_entities (type, start and end in the new text) on request.

    Whole texts of any length. A null text stays null, a text without entities as it is; rows are independent apart from
    the names' collision check, which covers all rows; nothing is shuffled but distinct names.
    """
    drawn = docs.sparkSession.sparkContext.broadcast(redraws(docs, key, text_col))
    columns = [c for c in docs.columns if c != "pii_entities"] if with_entities else docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pii")
        s = Surrogates(key, drawn.value)
        for b in batches:
            at = columns.index(text_col)
            raw = b.column(at).cast(pa.binary()).to_pylist()
            texts, marks, sizes = [], [], []
            for x in raw:
                own, text = [], None if x is None else x
                if x is not None and (found := detected(x.decode(), x)):
                    old, out, last, total = x.decode(), [], 0, 0
                    for i, j, kind, gender, whole, parts in found:
                        new = s.mention(old[i:j], whole, gender, parts) if whole else s.of(old[i:j], kind, gender)
                        out += [old[last:i], new]
                        total += i - last
                        own.append({"type": kind, "start": total, "end": total + len(new)})
                        total += len(new)
                        last = j
                    text = ("".join(out) + old[last:]).encode()
                texts.append(text)
                marks.append(own)
                sizes.append(len(text or b""))
            made = list(b.columns)
            made[at] = pa.array(texts, pa.binary()).cast(pa.string())
            if "n_chars" in columns:
                k = columns.index("n_chars")
                made[k] = pa.array([len(t.decode()) if own else n for t, own, n in zip(texts, marks, made[k].to_pylist())], made[k].type)
            names = list(columns)
            if with_entities:
                made.append(pa.array(marks, pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))))
                names.append("pii_entities")
            whole = pa.RecordBatch.from_arrays(made, names=names)
            for i, j in pieces(sizes):
                yield whole.slice(i, j - i)

    fields = [docs.schema[c] for c in columns]
    if with_entities:
        fields.append(T.StructField("pii_entities", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))))
    return mapped(docs.select(*[F.col(f"`{c}`") for c in columns]), run, T.StructType(fields))
