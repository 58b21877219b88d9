"""Phonetic keys: Soundex is Spark's own; Metaphone and NYSIIS by Arrow UDFs over distinct names."""

from __future__ import annotations

import re
from itertools import groupby

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

VOWELS = "AEIOU"


def _letters(name: str) -> str:
    return re.sub(r"[^A-Z]", "", (name or "").upper())


def metaphone_one(name: str) -> str:
    """Consonant sounds of a name; vowels count at its start only."""
    s = _letters(name)
    if s[:2] in ("KN", "GN", "PN", "AE", "WR"):
        s = s[1:]
    elif s[:1] == "X":
        s = "S" + s[1:]
    elif s[:2] == "WH":
        s = "W" + s[2:]
    out, k = [], 0
    while k < len(s):
        c, before, after, rest = s[k], s[k - 1] if k else "", s[k + 1 : k + 2], s[k + 1 :]
        k += 1
        if c == before and c != "C":
            continue
        front = after != "" and after in "EIY"
        if c in VOWELS:
            out.append(c if k == 1 else "")
        elif c == "B":
            out.append("" if before == "M" and not after else "B")
        elif c == "C":
            if rest[:2] == "IA" or after == "H":
                out.append("K" if before == "S" and after == "H" else "X")
                k += after == "H"
            elif front:
                out.append("" if before == "S" else "S")
            else:
                out.append("K")
        elif c == "D":
            edge = after == "G" and rest[1:2] != "" and rest[1:2] in "EIY"
            out.append("J" if edge else "T")
            k += edge
        elif c == "G":
            silent = after == "H" and rest[1:2] not in tuple(VOWELS) or rest in ("N", "NED")
            out.append("" if silent else "J" if front and before != "G" else "K")
            k += after == "H"
        elif c == "H":
            out.append("H" if after in tuple(VOWELS) and before not in tuple("CSPTG") else "")
        elif c == "K":
            out.append("" if before == "C" else "K")
        elif c == "P":
            out.append("F" if after == "H" else "P")
            k += after == "H"
        elif c == "Q":
            out.append("K")
        elif c == "S":
            soft = after == "H" or rest[:2] in ("IO", "IA")
            out.append("X" if soft else "S")
            k += after == "H"
        elif c == "T":
            out.append("X" if rest[:2] in ("IO", "IA") else "0" if after == "H" else "" if rest[:2] == "CH" else "T")
            k += after == "H"
        elif c == "V":
            out.append("F")
        elif c in "WY":
            out.append(c if after in tuple(VOWELS) else "")
        elif c == "X":
            out.append("KS")
        elif c == "Z":
            out.append("S")
        else:
            out.append(c)
    return "".join(out)


def nysiis_one(name: str) -> str:
    """A name as the New York State system spells it."""
    s = _letters(name)
    if not s:
        return ""
    for old, new in (("MAC", "MCC"), ("KN", "NN"), ("K", "C"), ("PH", "FF"), ("PF", "FF"), ("SCH", "SSS")):
        if s.startswith(old):
            s = new + s[len(old) :]
            break
    for old, new in (("EE", "Y"), ("IE", "Y"), ("DT", "D"), ("RT", "D"), ("RD", "D"), ("NT", "D"), ("ND", "D")):
        if s.endswith(old):
            s = s[: -len(old)] + new
            break
    out, k = [s[0]], 1
    while k < len(s):
        c, step = s[k], 1
        if s.startswith("EV", k):
            new, step = "AF", 2
        elif c in VOWELS:
            new = "A"
        elif s.startswith("KN", k):
            new, step = "N", 2
        elif s.startswith("SCH", k):
            new, step = "SSS", 3
        elif s.startswith("PH", k):
            new, step = "FF", 2
        elif c == "H" and (s[k - 1] not in VOWELS or s[k + 1 : k + 2] not in tuple(VOWELS)) or c == "W" and s[k - 1] in VOWELS:
            new = out[-1][-1]
        else:
            new = {"Q": "G", "Z": "S", "M": "N", "K": "C"}.get(c, c)
        out.append(new)
        k += step
    key = "".join(c for c, _ in groupby("".join(out)))
    if len(key) > 1 and key.endswith("S"):
        key = key[:-1]
    if key.endswith("AY"):
        key = key[:-2] + "Y"
    return key[:-1] if len(key) > 1 and key.endswith("A") else key


def _once(names: pd.Series, key) -> pd.Series:
    once = {x: key(x) for x in names.fillna("").unique()}
    return names.fillna("").map(once)


@pandas_udf(StringType())
def metaphone(names: pd.Series) -> pd.Series:
    return _once(names, metaphone_one)


@pandas_udf(StringType())
def nysiis(names: pd.Series) -> pd.Series:
    return _once(names, nysiis_one)
