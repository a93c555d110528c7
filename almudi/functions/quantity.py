"""Contents stated in text: numbers with metric, imperial and counting units."""

from __future__ import annotations

import re
from fractions import Fraction
from functools import lru_cache
from typing import NamedTuple

# Units, what each is of the base unit (exact), and the base unit.
UNITS = {
    "g": ("1", "g"), "gr": ("1", "g"), "grs": ("1", "g"), "gramo": ("1", "g"), "gramos": ("1", "g"),
    "mg": ("0.001", "g"),
    "kg": ("1000", "g"), "kgs": ("1000", "g"), "kilo": ("1000", "g"), "kilos": ("1000", "g"), "kilogramo": ("1000", "g"), "kilogramos": ("1000", "g"),
    "lb": ("453.59237", "g"), "lbs": ("453.59237", "g"), "libra": ("453.59237", "g"), "libras": ("453.59237", "g"),
    "oz": ("28.349523125", "oz"), "onz": ("28.349523125", "oz"), "onza": ("28.349523125", "oz"), "onzas": ("28.349523125", "oz"),
    "floz": ("29.5735295625", "ml"),
    "ml": ("1", "ml"), "mililitro": ("1", "ml"), "mililitros": ("1", "ml"), "cc": ("1", "ml"), "cl": ("10", "ml"),
    "l": ("1000", "ml"), "lt": ("1000", "ml"), "lts": ("1000", "ml"), "ltr": ("1000", "ml"), "litro": ("1000", "ml"), "litros": ("1000", "ml"),
    "gal": ("3785.411784", "ml"), "gals": ("3785.411784", "ml"), "galon": ("3785.411784", "ml"), "galones": ("3785.411784", "ml"),
    "u": ("1", "unit"), "un": ("1", "unit"), "ud": ("1", "unit"), "uds": ("1", "unit"), "und": ("1", "unit"), "unds": ("1", "unit"), "unid": ("1", "unit"), "unids": ("1", "unit"),
    "unit": ("1", "unit"), "units": ("1", "unit"), "unidad": ("1", "unit"), "unidades": ("1", "unit"), "pza": ("1", "unit"), "pzas": ("1", "unit"), "pieza": ("1", "unit"), "piezas": ("1", "unit"),
    "doc": ("12", "unit"), "docena": ("12", "unit"), "docenas": ("12", "unit"),
}
IMPERIAL = frozenset(("lb", "lbs", "libra", "libras", "oz", "onz", "onza", "onzas", "floz", "gal", "gals", "galon", "galones"))
FLUID_OUNCE = Fraction("29.5735295625")

_NUMBER = r"\d+\s+\d+/\d+|\d+/\d+|\d+(?:[.,]\d+)*"
_UNIT = r"fl\.?\s*(?:oz|onzas?)|(?:oz|onzas?)\.?\s*fl|" + "|".join(sorted(UNITS, key=len, reverse=True))
_QUANTITY = re.compile(rf"(?P<n>{_NUMBER})\s*(?P<u>{_UNIT})(?![a-z])\.?")
_TIMES_BEFORE = re.compile(r"(?<![\d.,/])(\d+)\s*[x×]\s*$")
_PACK_BEFORE = re.compile(r"(?:pack|paquete|caja|bolsa|paq\.?)\s+(?:de\s+)?(\d+)\s+(?:de|x)\s*$")
_TIMES_AFTER = re.compile(r"^\s*[x×]\s*(\d+)(?![\d/]|[.,]\d)(?!\s*(?:%s)(?![a-z]))" % _UNIT)
_NAMED_UNIT = re.compile(rf"(?:\ben|etiqueta:?|unidad:?)\s+(?P<u>{_UNIT})(?![a-z])")
_PLAIN = str.maketrans("áéíóúüñ", "aeiouun")


class Content(NamedTuple):
    """``dim`` is g, ml, unit or oz (an ounce that may be either); thousandths of the base
    unit, for oz by weight, and then ``milli_ml`` by volume."""

    dim: str
    milli: int
    milli_ml: int


def number(text: str) -> Fraction:
    """A stated number: ``1 1/2``, ``0,5``, ``1,500``; a comma before exactly three digits groups."""
    text = text.strip()
    if "/" in text:
        whole, _, part = text.rpartition(" ")
        top, _, bottom = part.partition("/")
        return Fraction(int(whole or 0)) + (Fraction(int(top), int(bottom)) if int(bottom) else 0)
    text = re.sub(r",(?=\d{3}(?!\d))", "", text).replace(",", ".")
    head, *rest = text.split(".")
    return Fraction(head + ("." + "".join(rest) if rest else ""))


def _unit(text: str) -> str:
    text = re.sub(r"[.\s]", "", text)
    return "floz" if "fl" in text else text


def half_up(x: Fraction) -> int:
    return (2 * x.numerator + x.denominator) // (2 * x.denominator)


def _content(total: Fraction, unit: str) -> Content:
    factor, dim = UNITS[unit]
    return Content(dim, half_up(total * Fraction(factor) * 1000), half_up(total * FLUID_OUNCE * 1000) if dim == "oz" else 0)


def plain(text: str) -> str:
    return text.lower().translate(_PLAIN).strip()


@lru_cache(maxsize=200_000)
def parse(text: str | None) -> Content | None:
    """The whole content stated in ``text`` (packs times size), or None.

    A metric size beats an imperial one beside it; a count beside a size is a pack count.
    """
    if not text:
        return None
    t = plain(text)
    sizes, counts, packs = [], [], []
    for m in _QUANTITY.finditer(t):
        unit, n = _unit(m["u"]), number(m["n"])
        if n <= 0:
            continue
        (counts if UNITS[unit][1] == "unit" else sizes).append((n, unit))
        before, after = t[: m.start()], t[m.end() :]
        if b := _TIMES_BEFORE.search(before) or _PACK_BEFORE.search(before):
            packs.append(int(b[1]))
        elif a := _TIMES_AFTER.search(after):
            packs.append(int(a[1]))
    if not sizes and not counts:
        return None
    times = Fraction(max(packs[0], 1)) if packs else Fraction(1)
    if not sizes:
        n, unit = counts[0]
        return _content(n * times, unit)
    n, unit = next((s for s in sizes if s[1] not in IMPERIAL), sizes[0])
    if not packs and counts:
        times = counts[0][0] * Fraction(UNITS[counts[0][1]][0])
    return _content(n * times, unit)


def parse_fields(value: str | None, unit: str | None = None, note: str | None = None) -> Content | None:
    """A size stated over several columns: in the value, in value and unit, or with a note."""
    value, unit, note = value or "", unit or "", note or ""
    has_number = re.search(r"\d", value) is not None
    if has_number:
        if c := parse(value) or parse(f"{value} {unit}"):
            return c
        if m := _NAMED_UNIT.search(plain(note)):
            return parse(f"{value} {m['u']}")
        return None
    return parse(unit) or parse(note)


def first_number(*texts: str | None) -> float | None:
    """The first number written in the texts, whatever its unit."""
    for t in texts:
        if m := re.search(_NUMBER, t or ""):
            return float(number(m[0]))
    return None


def bare_number(value: str | None) -> float | None:
    """The number of a value that states no unit at all."""
    m = re.fullmatch(_NUMBER, plain(value or ""))
    return float(number(m[0])) if m else None
