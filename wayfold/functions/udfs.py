"""Functions that no built-in expresses, as Arrow-batched UDFs: folding, phonetic codes, edit distance with transpositions, lexical vectors, WKB."""

from __future__ import annotations

import struct
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
POLYGON = T.ArrayType(T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))))

# Transliteration of Greek and Cyrillic letters, and of Latin ones that do not decompose.
LATIN = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ħ": "h", "ı": "i", "ŋ": "ng", "ŧ": "t", "ĸ": "k", "ſ": "s"}
CYRILLIC_TO = ["a", "b", "v", "g", "d", "e", "zh", "z", "i", "i", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "kh", "ts", "ch", "sh", "shch", "", "y", "", "e", "iu", "ia", "io", "ie", "i", "yi", "g"]
CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяёєіїґ", CYRILLIC_TO, strict=True))
GREEK_TO = ["a", "b", "g", "d", "e", "z", "e", "th", "i", "k", "l", "m", "n", "x", "o", "p", "r", "s", "s", "t", "u", "ph", "kh", "ps", "o"]
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", GREEK_TO, strict=True))
TABLE = LATIN | CYRILLIC | GREEK


def fold(text: str) -> str:
    """ASCII where a letter has a Latin form; other scripts pass."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFC", text)
    return text.translate({ord(c): folded_letter(c) for c in set(text)})


def folded_letter(c: str) -> str:
    low = c.lower()
    hit = TABLE.get(low)
    if hit is None:
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        return "".join(TABLE.get(x.lower(), x) if not x.isascii() else x for x in base)
    return hit if c == low else hit[:1].upper() + hit[1:]


@F.pandas_udf(T.StringType())
def ascii_fold(s: pd.Series) -> pd.Series:
    """Transliterated text; null if nothing changes."""
    return s.map(lambda t: None if t is None or (f := fold(t)) == t else f)


@F.pandas_udf(T.StringType())
def fold_for_compare(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else fold(t).strip().lower())


def osa(a: str, b: str) -> int:
    """Edit distance in which a swap of neighbours is one edit."""
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    return row[-1]


@F.pandas_udf(T.IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


DIM = 32


def embed(text: str) -> np.ndarray:
    """Counts of hashed character trigrams (FNV-1a over code points), with unit length; zero if there is nothing to count."""
    out = np.zeros(DIM)
    if text.strip():
        chars = ["#", *("#" if c.isspace() else c for c in text.lower() if c.isalnum() or c.isspace()), "#"]
        for i in range(len(chars) - 2):
            h = 0x811C9DC5
            for c in chars[i : i + 3]:
                for b in ord(c).to_bytes(4, "little"):
                    h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
            out[h % DIM] += 1
    n = np.sqrt((out * out).sum())
    return out / n if n else out


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embed32(s: pd.Series) -> pd.Series:
    return s.map(lambda t: embed(t or "").astype(np.float32).tolist())


def double_metaphone(word: str, size: int = 4) -> tuple[str, str]:
    """Primary and alternate code of a word, after the published algorithm (L. Philips, 2000)."""
    w = "".join(c for c in word.upper() if c.isalpha() or c == " ")
    if not w.strip():
        return "", ""
    w = w.strip()
    n, p, a, i = len(w), [], [], 0
    slavic = any(x in w for x in ("W", "K", "CZ", "WITZ"))
    vowel = "AEIOUY"

    def at(k: int, *forms: str) -> bool:
        return k >= 0 and any(w.startswith(f, k) for f in forms)

    def ch(k: int) -> str:
        return w[k] if 0 <= k < n else ""

    def add(x: str, y: str | None = None) -> None:
        p.append(x)
        a.append(x if y is None else y)

    if at(0, "GN", "KN", "PN", "WR", "PS"):
        i = 1
    if ch(0) == "X":
        add("S")
        i = 1
    while i < n and (len("".join(p)) < size or len("".join(a)) < size):
        c = ch(i)
        step = 1
        if c in vowel:
            if i == 0:
                add("A")
        elif c == "B":
            add("P")
            step = 2 if ch(i + 1) == "B" else 1
        elif c == "Ç":
            add("S")
        elif c == "C":
            if i > 1 and ch(i - 2) not in vowel and at(i - 1, "ACH") and ch(i + 2) != "I" and (ch(i + 2) != "E" or at(i - 2, "BACHER", "MACHER")):
                add("K")
                step = 2
            elif i == 0 and at(i, "CAESAR"):
                add("S")
                step = 2
            elif at(i, "CHIA"):
                add("K")
                step = 2
            elif at(i, "CH"):
                step = 2
                if i > 0 and at(i, "CHAE"):
                    add("K", "X")
                elif i == 0 and (at(1, "HARAC", "HARIS") or at(1, "HOR", "HYM", "HIA", "HEM")) and not at(0, "CHORE"):
                    add("K")
                elif at(0, "VAN ", "VON ", "SCH") or at(i - 2, "ORCHES", "ARCHIT", "ORCHID") or ch(i + 2) in ("T", "S") or ((ch(i - 1) in ("A", "O", "U", "E") or i == 0) and (ch(i + 2) in tuple("LRNMBHFVW ") or i + 2 >= n)):
                    add("K")
                elif i > 0:
                    add("K") if at(0, "MC") else add("X", "K")
                else:
                    add("X")
            elif at(i, "CZ") and not at(i - 2, "WICZ"):
                add("S", "X")
                step = 2
            elif at(i + 1, "CIA"):
                add("X")
                step = 3
            elif at(i, "CC") and not (i == 1 and ch(0) == "M"):
                if ch(i + 2) in ("I", "E", "H") and not at(i + 2, "HU"):
                    if (i == 1 and ch(0) == "A") or at(i - 1, "UCCEE", "UCCES"):
                        add("KS")
                    else:
                        add("X")
                    step = 3
                else:
                    add("K")
                    step = 2
            elif at(i, "CK", "CG", "CQ"):
                add("K")
                step = 2
            elif at(i, "CI", "CE", "CY"):
                add("S", "X") if at(i, "CIO", "CIE", "CIA") else add("S")
                step = 2
            else:
                add("K")
                step = 3 if at(i + 1, " C", " Q", " G") else 2 if ch(i + 1) in ("C", "K", "Q") and not at(i + 1, "CE", "CI") else 1
        elif c == "D":
            if at(i, "DG"):
                if ch(i + 2) in ("I", "E", "Y"):
                    add("J")
                    step = 3
                else:
                    add("TK")
                    step = 2
            else:
                add("T")
                step = 2 if at(i, "DT", "DD") else 1
        elif c == "F":
            add("F")
            step = 2 if ch(i + 1) == "F" else 1
        elif c == "G":
            if ch(i + 1) == "H":
                step = 2
                if i > 0 and ch(i - 1) not in vowel:
                    add("K")
                elif i == 0:
                    add("J") if ch(2) == "I" else add("K")
                elif ch(i - 2) in ("B", "H", "D") and i > 1 or ch(i - 3) in ("B", "H", "D") and i > 2 or ch(i - 4) in ("B", "H") and i > 3:
                    pass
                elif i > 2 and ch(i - 1) == "U" and ch(i - 3) in ("C", "G", "L", "R", "T"):
                    add("F")
                elif i > 0 and ch(i - 1) != "I":
                    add("K")
            elif ch(i + 1) == "N":
                step = 2
                if i == 1 and ch(0) in vowel and not slavic:
                    add("KN", "N")
                elif not at(i + 2, "EY") and ch(i + 1) != "Y" and not slavic:
                    add("N", "KN")
                else:
                    add("KN")
            elif at(i + 1, "LI") and not slavic:
                add("KL", "L")
                step = 2
            elif i == 0 and (ch(1) == "Y" or at(1, "ES", "EP", "EB", "EL", "EY", "IB", "IL", "IN", "IE", "EI", "ER")):
                add("K", "J")
                step = 2
            elif (at(i + 1, "ER") or ch(i + 1) == "Y") and not at(0, "DANGER", "RANGER", "MANGER") and ch(i - 1) not in ("E", "I") and not at(i - 1, "RGY", "OGY"):
                add("K", "J")
                step = 2
            elif ch(i + 1) in ("E", "I", "Y") or at(i - 1, "AGGI", "OGGI"):
                if at(0, "VAN ", "VON ", "SCH") or at(i + 1, "ET"):
                    add("K")
                else:
                    add("J") if at(i + 1, "IER") else add("J", "K")
                step = 2
            else:
                add("K")
                step = 2 if ch(i + 1) == "G" else 1
        elif c == "H":
            if (i == 0 or ch(i - 1) in vowel) and ch(i + 1) in vowel and ch(i + 1):
                add("H")
                step = 2
        elif c == "J":
            if at(i, "JOSE") or at(0, "SAN "):
                add("H") if (i == 0 and ch(i + 4) in ("", " ")) or at(0, "SAN ") else add("J", "H")
            elif i == 0:
                add("J", "A")
            elif ch(i - 1) in vowel and not slavic and ch(i + 1) in ("A", "O"):
                add("J", "H")
            elif i == n - 1:
                add("J", "")
            elif ch(i + 1) not in tuple("LTKSNMBZ") and ch(i - 1) not in ("S", "K", "L"):
                add("J")
            step = 2 if ch(i + 1) == "J" else 1
        elif c == "K":
            add("K")
            step = 2 if ch(i + 1) == "K" else 1
        elif c == "L":
            if ch(i + 1) == "L":
                step = 2
                if (i == n - 3 and at(i - 1, "ILLO", "ILLA", "ALLE")) or ((w.endswith(("AS", "OS")) or w[-1] in "AO") and at(i - 1, "ALLE")):
                    add("L", "")
                else:
                    add("L")
            else:
                add("L")
        elif c == "M":
            add("M")
            step = 2 if ch(i + 1) == "M" or (at(i - 1, "UMB") and (i + 1 == n - 1 or at(i + 2, "ER"))) else 1
        elif c == "N":
            add("N")
            step = 2 if ch(i + 1) == "N" else 1
        elif c == "Ñ":
            add("N")
        elif c == "P":
            if ch(i + 1) == "H":
                add("F")
                step = 2
            else:
                add("P")
                step = 2 if ch(i + 1) in ("P", "B") else 1
        elif c == "Q":
            add("K")
            step = 2 if ch(i + 1) == "Q" else 1
        elif c == "R":
            add("", "R") if i == n - 1 and not slavic and at(i - 2, "IE") and not at(i - 4, "ME", "MA") else add("R")
            step = 2 if ch(i + 1) == "R" else 1
        elif c == "S":
            if at(i - 1, "ISL", "YSL"):
                pass
            elif i == 0 and at(0, "SUGAR"):
                add("X", "S")
            elif at(i, "SH"):
                add("S") if at(i + 1, "HEIM", "HOEK", "HOLM", "HOLZ") else add("X")
                step = 2
            elif at(i, "SIO", "SIA"):
                add("S") if slavic else add("S", "X")
                step = 3
            elif (i == 0 and ch(1) in ("M", "N", "L", "W")) or ch(i + 1) == "Z":
                add("S", "X")
                step = 2 if ch(i + 1) == "Z" else 1
            elif at(i, "SC"):
                step = 3
                if ch(i + 2) == "H":
                    if at(i + 3, "OO", "ER", "EN", "UY", "ED", "EM"):
                        add("X", "SK") if at(i + 3, "ER", "EN") else add("SK")
                    else:
                        add("X", "S") if i == 0 and ch(3) not in vowel and ch(3) != "W" else add("X")
                elif ch(i + 2) in ("I", "E", "Y"):
                    add("S")
                else:
                    add("SK")
            else:
                add("", "S") if i == n - 1 and at(i - 2, "AI", "OI") else add("S")
                step = 2 if ch(i + 1) in ("S", "Z") else 1
        elif c == "T":
            if at(i, "TION", "TIA", "TCH"):
                add("X")
                step = 3
            elif at(i, "TH", "TTH"):
                add("T") if at(i + 2, "OM", "AM") or at(0, "VAN ", "VON ", "SCH") else add("0", "T")
                step = 2
            else:
                add("T")
                step = 2 if ch(i + 1) in ("T", "D") else 1
        elif c == "V":
            add("F")
            step = 2 if ch(i + 1) == "V" else 1
        elif c == "W":
            if at(i, "WR"):
                add("R")
                step = 2
            else:
                if i == 0 and (ch(1) in vowel and ch(1) or at(0, "WH")):
                    add("A", "F") if ch(1) in vowel else add("A")
                if (i == n - 1 and i > 0 and ch(i - 1) in vowel) or at(i - 1, "EWSKI", "EWSKY", "OWSKI", "OWSKY") or at(0, "SCH"):
                    add("", "F")
                elif at(i, "WICZ", "WITZ"):
                    add("TS", "FX")
                    step = 4
        elif c == "X":
            if not (i == n - 1 and (at(i - 3, "IAU", "EAU") or at(i - 2, "AU", "OU"))):
                add("KS")
            step = 2 if ch(i + 1) in ("C", "X") else 1
        elif c == "Z":
            if ch(i + 1) == "H":
                add("J")
                step = 2
            else:
                add("S", "TS") if at(i + 1, "ZO", "ZI", "ZA") or (slavic and i > 0 and ch(i - 1) != "T") else add("S")
                step = 2 if ch(i + 1) == "Z" else 1
        i += step
    return "".join(p)[:size], "".join(a)[:size]


def phonetic(text: str) -> list[str]:
    """Distinct codes of each folded word of three letters or more, sorted."""
    found = set()
    for word in "".join(c if c.isalnum() else " " for c in fold(text)).split():
        if len(word) >= 3:
            found.update(x for x in double_metaphone(word) if x)
    return sorted(found)


@F.pandas_udf(T.ArrayType(T.StringType()))
def phonetic_codes(s: pd.Series) -> pd.Series:
    return s.map(lambda t: phonetic(t or ""))


def _wkb(raw: bytes, at: int) -> tuple[int, str, int]:
    """(base type, byte order, place after the head); the SRID of an extended head is passed over."""
    order = "<" if raw[at] == 1 else ">"
    (kind,) = struct.unpack_from(order + "I", raw, at + 1)
    at += 5 + (4 if kind & 0x20000000 else 0)
    return kind & ~0x20000000, order, at


def wkb_point_of(raw: bytes | None) -> tuple[float, float] | None:
    """Of a point, of any dimension; else null."""
    try:
        kind, order, at = _wkb(raw, 0)
        if (kind & 0xFFFF) % 1000 != 1:
            return None
        return struct.unpack_from(order + "dd", raw, at)
    except (TypeError, IndexError, struct.error):
        return None


def wkb_polygons_of(raw: bytes | None) -> list[list[list[tuple[float, float]]]] | None:
    """Rings by part of a two-dimensional polygon or multipolygon; else null."""

    def rings(order: str, at: int) -> tuple[list, int]:
        (n,) = struct.unpack_from(order + "I", raw, at)
        at += 4
        out = []
        for _ in range(n):
            (m,) = struct.unpack_from(order + "I", raw, at)
            at += 4
            flat = struct.unpack_from(order + f"{2 * m}d", raw, at)
            at += 16 * m
            out.append(list(zip(flat[::2], flat[1::2], strict=True)))
        return out, at

    try:
        kind, order, at = _wkb(raw, 0)
        if kind == 3:
            return [rings(order, at)[0]]
        if kind != 6:
            return None
        (n,) = struct.unpack_from(order + "I", raw, at)
        at += 4
        parts = []
        for _ in range(n):
            kind, inner, at = _wkb(raw, at)
            if kind != 3:
                return None
            part, at = rings(inner, at)
            parts.append(part)
        return parts
    except (TypeError, IndexError, struct.error):
        return None


@F.pandas_udf(POINT)
def wkb_point(s: pd.Series) -> pd.DataFrame:
    found = [wkb_point_of(None if x is None else bytes(x)) for x in s]
    return pd.DataFrame({"lon": [None if f is None else f[0] for f in found], "lat": [None if f is None else f[1] for f in found]}, dtype="float64")


@F.pandas_udf(POLYGON)
def wkb_polygons(s: pd.Series) -> pd.Series:
    def rows(raw):
        parts = wkb_polygons_of(None if raw is None else bytes(raw))
        return None if parts is None else [[[{"x": x, "y": y} for x, y in ring] for ring in part] for part in parts]

    return s.map(rows)


def simplified(ring: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Douglas-Peucker on a closed ring; the ring as it is if the tolerance is 0 or too few vertices would be left."""
    if tolerance <= 0 or len(ring) < 5:
        return ring
    keep, stack = {0, len(ring) - 1}, [(0, len(ring) - 1)]
    while stack:
        a, b = stack.pop()
        (ax, ay), (bx, by) = ring[a], ring[b]
        dx, dy = bx - ax, by - ay
        size = (dx * dx + dy * dy) ** 0.5
        far, at = -1.0, -1
        for i in range(a + 1, b):
            px, py = ring[i][0] - ax, ring[i][1] - ay
            d = abs(px * dy - py * dx) / size if size else (px * px + py * py) ** 0.5
            if d > far:
                far, at = d, i
        if far > tolerance:
            keep.add(at)
            stack += [(a, at), (at, b)]
    out = [ring[i] for i in sorted(keep)]
    return out if len(out) >= 4 else ring


def simplify(tolerance: float):
    """A UDF that simplifies all rings of a polygon column."""

    @F.pandas_udf(POLYGON)
    def run(s: pd.Series) -> pd.Series:
        def rows(parts):
            if parts is None:
                return None
            return [[[{"x": x, "y": y} for x, y in simplified([(v["x"], v["y"]) for v in ring], tolerance)] for ring in part] for part in parts]

        return s.map(rows)

    return run


@F.pandas_udf(T.BinaryType())
def pack_vectors(s: pd.Series) -> pd.Series:
    """Vectors as little-endian 32-bit floats."""
    return s.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpack_vectors(s: pd.Series) -> pd.Series:
    """What ``pack_vectors`` packed; null if the length is no multiple of four bytes."""
    return s.map(lambda v: None if v is None or len(v) % 4 else np.frombuffer(v, "<f4"))
