"""Checksums of published identifier standards; each takes the identifier as written."""

from __future__ import annotations

import re

DIGITS = re.compile(r"[0-9]")


def digits(text: str) -> list[int]:
    return [int(c) for c in DIGITS.findall(text)]


def luhn(text: str) -> bool:
    """ISO/IEC 7812: every second digit from the right but one doubled."""
    total = 0
    for k, d in enumerate(reversed(digits(text))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _weighted(ds: list[int], weights: tuple[int, ...], modulus: int) -> int:
    return sum(d * w for d, w in zip(ds, weights)) % modulus


def pesel(text: str) -> bool:
    """Weights 1, 3, 7, 9 in turn; month digits carry the century."""
    ds = digits(text)
    if len(ds) != 11 or (10 - _weighted(ds, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3), 10)) % 10 != ds[10]:
        return False
    return 1 <= (ds[2] * 10 + ds[3]) % 20 <= 12 and 1 <= ds[4] * 10 + ds[5] <= 31


def nip(text: str) -> bool:
    ds = digits(text)
    return len(ds) == 10 and _weighted(ds, (6, 5, 7, 2, 3, 4, 5, 6, 7), 11) == ds[9]


def regon(text: str) -> bool:
    ds = digits(text)
    short = len(ds) in (9, 14) and _weighted(ds, (8, 9, 2, 3, 4, 5, 6, 7), 11) % 10 == ds[8]
    return short and (len(ds) == 9 or _weighted(ds, (2, 4, 8, 5, 0, 9, 7, 3, 6, 1, 2, 4, 8), 11) % 10 == ds[13])


def _letters(text: str) -> list[int]:
    return [int(c, 36) for c in re.sub(r"[^0-9A-Za-z]", "", text)]


def id_card(text: str) -> bool:
    """Three letters and six digits, the first digit checks."""
    v = _letters(text)
    return len(v) == 9 and _weighted(v, (7, 3, 1, 9, 7, 3, 1, 7, 3), 10) == 0


def passport(text: str) -> bool:
    """Two letters and seven digits, the first digit checks."""
    v = _letters(text)
    return len(v) == 9 and _weighted(v, (7, 3, 9, 1, 7, 3, 1, 7, 3), 10) == 0


def iban(text: str) -> bool:
    """ISO 13616, remainder 1 modulo 97; a bare national number reads as Polish."""
    plain = re.sub(r"[^0-9A-Za-z]", "", text).upper()
    plain = plain if plain[:2].isalpha() else f"PL{plain}"
    if len(plain) < 15:
        return False
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def land_register(text: str) -> bool:
    """Court code, eight digits, check digit; X is 10 and letters follow from 11, weights 1, 3, 7."""
    plain = re.sub(r"[^0-9A-Za-z]", "", text).upper()
    if len(plain) != 13 or not plain[4:].isdigit():
        return False
    order = "0123456789XABCDEFGHIJKLMNOPRSTUWYZ"
    if any(c not in order for c in plain[:12]):
        return False
    return sum(order.index(c) * w for c, w in zip(plain[:12], (1, 3, 7) * 4)) % 10 == int(plain[12])


def ipv4(text: str) -> bool:
    return all(int(x) <= 255 for x in text.split("."))
