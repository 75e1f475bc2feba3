"""Code points that count as special: ASCII punctuation and white space, typographic and mathematical symbols, and every emoji of one code point (Unicode 15)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_RANGES = (
    "9-D 20-2F 3A-40 5B-60 7B-7E 81-85 91-93 95-99 9C-9D A1-AB AD-B4 B7-BF D7 F7-F8 131 26A 2BA-2BC 2C8 2CC 2D0 2D8 2DA 2DC 3C0 413 60C 647 66A 66C 6E9 93E 940 947 94D "
    "97D 9BE E51 2002-2003 2005 2008-200B 2010-2011 2013-2016 2018-201A 201C-2020 2022 2024 2026 202F-2030 2032-2033 2039-203A 203C 203F 2043-2044 2049 20A8 20AA 20AC "
    "2103 2122 2139 2194-2199 21A9-21AA 21D3 2206 2208 2212 221A 221E-221F 2248 2256 2264-2265 2295 22C5 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2 2550 25A0 25AA-25AC "
    "25B2 25B4 25B6-25B7 25BA-25BC 25C0 25C6 25CF 25E6 25FB-25FE 2600-2606 260E 2611 2614-2615 2618 261B 261D 2620 2622-2623 2626 262A 262E-262F 2638-263B 2640 2642 "
    "2648-2653 265F-2661 2663 2665-2666 2668 266B 267B 267E-267F 2692-2697 2699 269B-269C 26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE 26C4-26C5 26C8 26CE-26CF 26D1 "
    "26D3-26D4 26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712-2714 2716 271D 2721 2726 2728 2731 2733-2734 2744 2747 274C 274E 2753-2757 2763-2764 "
    "2795-2797 27A1 27A4 27A9 27B0 27BF 2800 2934-2935 2B05-2B07 2B1B-2B1C 2B50 2B55 3000-3002 300A-300D 3010-3011 3030 303D 309C 3297 3299 58EB FD3E-FD3F FEFF FF01 "
    "FF08-FF09 FF0C FF0E FF11 FF1A-FF1B FF1F FF3E FF5E FFFC-FFFD 1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F201-1F202 1F21A 1F22F 1F232-1F23A 1F250-1F251 "
    "1F300-1F321 1F324-1F393 1F396-1F397 1F399-1F39B 1F39E-1F3F0 1F3F3-1F3F5 1F3F7-1F4FD 1F4FF-1F53D 1F549-1F54E 1F550-1F567 1F56F-1F570 1F573-1F57A 1F587 1F58A-1F58D "
    "1F590 1F595-1F596 1F5A4-1F5A5 1F5A8 1F5B1-1F5B2 1F5BC 1F5C2-1F5C4 1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3 1F5FA-1F64F 1F680-1F6C5 1F6CB-1F6D2 "
    "1F6D5-1F6D9 1F6DC-1F6E5 1F6E9 1F6EB-1F6EC 1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0 1F90C-1F93A 1F93C-1F945 1F947-1F9FF 1FA70-1FA7C 1FA80-1FAC6 1FAC8 1FACC-1FADD "
    "1FADF-1FAEB 1FAEF-1FAFA"
)


def special_class() -> str:
    """The body of a regular-expression class, in the syntax that Java and RE2 share."""
    out = []
    for part in _RANGES.split():
        lo, _, hi = part.partition("-")
        out.append(f"\\x{{{lo}}}-\\x{{{hi}}}" if hi else f"\\x{{{lo}}}")
    return "".join(out)


@lru_cache
def special_table() -> np.ndarray:
    """Whether a code point is special, for all of them."""
    out = np.zeros(0x110000, dtype=bool)
    for part in _RANGES.split():
        lo, _, hi = part.partition("-")
        out[int(lo, 16) : int(hi or lo, 16) + 1] = True
    return out
