"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text: at-signs, plus signs, schemes, digits and the cues of identifiers. At
each anchor a small deterministic parser expands to the left and right and validates what it has: local part and domain of an
address, the four parts of an IP address, the digits of a card (Luhn), the digits of a phone number, the check digits of an
IBAN, the areas of a social security number, the login in an URL. Nothing is searched between anchors.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import ahocorasick
from pyspark.sql import DataFrame

from .spans import Span, scan_texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "login")

_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_LOCAL = _ALNUM | set("._%+-")
# What stands right of an anchor. Fixed patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])*")
_DIALLED = re.compile(r"[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ \u00a0\u202f-]?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9])")
_SECURITY = re.compile(r"[ _-]*security(?:[ _-]*(?:number|num|nr|no))?", re.IGNORECASE)
_SIGNS = re.compile(r"[ :.#-]{0,3}")
_WORD = re.compile(r"[^\W_]+")
_LOGIN = re.compile(r"[^\s/@:?#]+:[^\s/@?#]+(?=@[A-Za-z0-9])")

#: A number belongs to a cue that stands so many characters and words before it at most.
NEAR_CHARS, NEAR_WORDS = 80, 6
#: Letters and digits of an IBAN by country; of other countries the check digits alone tell where it ends.
_IBAN_SIZES = {country: size for size, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for country in countries.split()}


def _spellings(word: str) -> list[str]:
    """A word in capitals, small letters and every mixture."""
    return ["".join(letters) for letters in product(*({c.lower(), c.upper()} for c in word))]


_ANCHORS = {"@": "at", "+": "plus", "://": "scheme"} | {w: kind for cue, kind in (("iban", "iban"), ("ssn", "ssn"), ("social", "social")) for w in _spellings(cue)} | {d: "digit" for d in "0123456789"}


def _automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for word, kind in _ANCHORS.items():
        automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton


_AUTOMATON = _automaton()


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _iban_holds(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _iban_at(text: str, at: int) -> int | None:
    """The end of the IBAN that begins here: as long as its country has it, else up to the last group boundary where the check digits hold."""
    if not (found := _IBAN.match(text, at)):
        return None
    ends = [i + 1 for i in range(at, found.end()) if text[i] in _ALNUM]
    size = _IBAN_SIZES.get(text[at:at + 2])
    for n in [size] if size else range(len(ends), 14, -1):
        if n <= len(ends) and text[ends[n - 1]:ends[n - 1] + 1] not in _ALNUM and _iban_holds("".join(text[e - 1] for e in ends[:n])):
            return ends[n - 1]
    return None


def _ssn_at(text: str, at: int) -> int | None:
    found = None if text[at - 1] == "-" and text[at - 2] in "0123456789" else _SSN.match(text, at)
    return found and found.end()


def _numbers_after(text: str, begin: int, cue_end: int, end_at) -> Iterator[tuple[int, int]]:
    """Start and end of the numbers that a cue announces: right after it, or after a few words if the cue is a word of its own; then of those that follow."""
    direct = _SIGNS.match(text, cue_end).end()
    plural = cue_end + (text[cue_end:cue_end + 1] in ("s", "S"))
    alone = not (begin and text[begin - 1].isalpha()) and not text[plural:plural + 1].isalpha()
    at, until, words = cue_end, cue_end + NEAR_CHARS if alone else direct, 0
    while at <= min(until, len(text) - 1) and words <= NEAR_WORDS:
        if (at == cue_end or text[at - 1] not in _ALNUM) and (end := end_at(text, at)):
            yield at, end
            at, until, words = end, end + NEAR_CHARS, 0
        elif at in (cue_end, plural) or not (word := _WORD.match(text, at)):
            at += 1
        else:
            at, words = word.end(), words + 1


def find_personal(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans of a text (email, ip, card, phone) and the further ones (iban, ssn, login)."""
    own: list[Span] = []
    more: list[Span] = []
    taken = {"iban": 0, "ssn": 0}
    email_from = phone_from = ip_from = card_from = 0  # where the next match of a kind may begin
    for last, (kind, width) in _AUTOMATON.iter(text):
        at = last - width + 1
        if kind == "digit":
            if at >= ip_from:
                chain = _DOTTED.match(text, at)
                ip_from = chain.end()
                if ip_from - at >= 7:
                    parts, place = chain[0].split("."), at
                    for i in range(0, len(parts) - 3, 4):
                        four = parts[i:i + 4]
                        size = sum(map(len, four)) + 3
                        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                            own.append(("ip", place, place + size))
                        place += size + 1
            if at >= card_from:
                chain = _CHAIN.match(text, at)
                card_from = chain.end()
                if card_from - at >= 12:
                    digits = chain[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and _luhn(digits):
                        own.append(("card", at, card_from))
        elif kind == "at":
            begin = at
            while begin > email_from and text[begin - 1] in _LOCAL:
                begin -= 1
            if begin < at and (domain := _DOMAIN.match(text, at + 1)):
                own.append(("email", begin, domain.end()))
                email_from = domain.end()
        elif kind == "plus":
            if at >= phone_from and (dialled := _DIALLED.match(text, at + 1)):
                phone_from = dialled.end()
                if 9 <= sum(c in "0123456789" for c in dialled[0]) <= 15:
                    own.append(("phone", at, phone_from))
        elif kind in ("iban", "ssn", "social"):
            cue = _SECURITY.match(text, last + 1) if kind == "social" else None
            if kind == "social" and not cue:
                continue
            name, end_at = ("iban", _iban_at) if kind == "iban" else ("ssn", _ssn_at)
            for begin, end in _numbers_after(text, at, cue.end() if cue else last + 1, end_at):
                if begin < taken[name]:  # another cue had it
                    continue
                more.append((name, begin, end))
                taken[name] = end
        elif found := _LOGIN.match(text, last + 1):
            more.append(("login", found.start(), found.end()))
    return own, more


def scan_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Offsets are code points, end exclusive. A null or empty text has no spans. Repeated rows are scanned each on their own,
    null ids stay null, other columns are ignored. A text is held whole by one task, however long.
    """
    return scan_texts(docs, find_personal, BASE, KINDS, id_col, text_col)
