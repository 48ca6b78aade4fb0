"""Bengali character inventory, built from code points: typed nukta letters may be silently decomposed."""

from __future__ import annotations


def _chars(*ranges: tuple[int, int]) -> frozenset[str]:
    return frozenset(chr(c) for a, z in ranges for c in range(a, z + 1))


# fixed values: the script's classes
CONSONANTS = _chars((0x0995, 0x09B9), (0x09CE, 0x09CE), (0x09DC, 0x09DD), (0x09DF, 0x09DF), (0x09F0, 0x09F1))
VOWELS = _chars((0x0985, 0x098C), (0x098F, 0x0990), (0x0993, 0x0994), (0x09E0, 0x09E1))
MATRAS = _chars((0x09BE, 0x09CC), (0x09D7, 0x09D7), (0x09E2, 0x09E3))
MODIFIERS = _chars((0x0981, 0x0983), (0x09FE, 0x09FE))
VIRAMA, NUKTA, RA, YA = (chr(c) for c in (0x09CD, 0x09BC, 0x09B0, 0x09AF))
ZWJ, ZWNJ = chr(0x200D), chr(0x200C)
TA, KHANDA_TA = chr(0x09A4), chr(0x09CE)
VEDIC_ANUSVARA, ABBREVIATION_SIGN = chr(0x09FC), chr(0x09FD)
DANDA, DOUBLE_DANDA, CURRENCY_FOUR = chr(0x0964), chr(0x0965), chr(0x09F7)
BENGALI_BLOCK = _chars((0x0980, 0x09FF))
ASCII_PRINTABLE = _chars((0x20, 0x7E))
GUARANTEED = BENGALI_BLOCK | ASCII_PRINTABLE | {DANDA, DOUBLE_DANDA}
#: Letters that NFC leaves as a base and a nukta, and their single code points.
RECOMPOSED = {chr(a) + NUKTA: chr(b) for a, b in ((0x09A1, 0x09DC), (0x09A2, 0x09DD), (0x09AF, 0x09DF))}
#: Where a vowel sign stands; all others of the class are unassigned code points.
MATRA_POSITION = {
    **{m: "unassigned" for m in MATRAS},
    **{chr(c): "after" for c in (0x09BE, 0x09C0, 0x09D7)},
    **{chr(c): "before" for c in (0x09BF, 0x09C7, 0x09C8)},
    **{chr(c): "below" for c in (0x09C1, 0x09C2, 0x09C3, 0x09C4, 0x09E2, 0x09E3)},
    **{chr(c): "split" for c in (0x09CB, 0x09CC)},
}
#: White space as Python's str.split sees it.
WHITESPACE = "".join(chr(c) for a, z in ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)) for c in range(a, z + 1))
SPECIALS = ("<pad>", "<unk>", "<s>", "</s>", "<mask>")
MARKER = chr(0x2581)
#: Letters a-z onto the script, for tests on tables that hold none of it.
LATIN = "abcdefghijklmnopqrstuvwxyz"
LATIN_AS_BENGALI = "".join(map(chr, (0x09BE, 0x09AC, 0x0995, 0x09A6, 0x09BF, 0x09AB, 0x0997, 0x09B9, 0x09CD, 0x099C, 0x0985, 0x09B2, 0x09AE, 0x09A8, 0x09C7, 0x09AA, 0x09DF, 0x09B0, 0x09B8, 0x09A4, 0x09C1, 0x09AD, 0x0982, 0x200C, 0x09BC, 0x0981)))


def body(chars: str | frozenset[str]) -> str:
    """A set as the body of a character class: the characters themselves, in order, runs as ranges."""
    codes = sorted(map(ord, chars))
    out, k = "", 0
    while k < len(codes):
        j = k
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out += chr(codes[k]) if j == k else f"{chr(codes[k])}-{chr(codes[j])}"
        k = j + 1
    return out


# patterns
C, V, M, K = body(CONSONANTS), body(VOWELS), body(MATRAS), body(MODIFIERS)
_LINK = body(MATRAS | {NUKTA, ZWJ})
_RUN = body(MATRAS | {NUKTA, ZWJ, VIRAMA})
_TAIL = body(MATRAS | MODIFIERS | {NUKTA, ZWJ, ZWNJ, VIRAMA})


def akshara(possessive: bool = True) -> str:
    """One syllable. Possessive quantifiers keep long chains from deep recursion; RE2 has only greedy ones."""
    q = "*+" if possessive else "*"
    return f"[{C}](?:[{_LINK}]{q}{VIRAMA}[{_RUN}]{q}[{C}]){q}[{_TAIL}]{q}|[{V}][{_TAIL}]{q}"


_EXTEND = r"\x{0981}-\x{0983}\x{09BC}\x{09BE}-\x{09C4}\x{09C7}\x{09C8}\x{09CB}-\x{09CD}\x{09D7}\x{09E2}\x{09E3}\x{09FE}\x{200C}\x{200D}\p{M}"
_JOINING = r"\x{0995}-\x{09A8}\x{09AA}-\x{09B0}\x{09B2}\x{09B6}-\x{09B9}\x{09DC}\x{09DD}\x{09DF}\x{09F0}\x{09F1}"
_INSIDE = r"\x{0981}\x{09BC}\x{09BE}\x{09C1}-\x{09C4}\x{09D7}\x{09E2}\x{09E3}\x{09FE}\x{200D}"
_OTHER = rf"\r\n|\p{{Cc}}|\X[{_EXTEND}]*+"
#: A syllable, or one grapheme cluster of anything else.
CHUNK = f"{akshara()}|{_OTHER}"
#: A grapheme cluster with the conjunct rule, which Java's own ``\X`` lacks.
GRAPHEME = rf"[{_JOINING}](?:[{_INSIDE}]*+{VIRAMA}[{_INSIDE}{VIRAMA}]*+[{_JOINING}])*+[{_EXTEND}]*+|{_OTHER}"
ONSET = f"^[{C}][{NUKTA}{ZWJ}{ZWNJ}]*(?:{VIRAMA}[{C}][{NUKTA}{ZWJ}{ZWNJ}]*)*"
ONSET_UNIT = f"[{C}][{NUKTA}{ZWJ}{ZWNJ}]*"
SPACE_CLASS = "".join(rf"\x{{{ord(c):04X}}}" for c in WHITESPACE)
#: Marks that Unicode joins to the letter after them.
PREPENDED = r"[\x{0600}-\x{0605}\x{06DD}\x{070F}\x{0890}\x{0891}\x{08E2}\x{0D4E}\x{110BD}\x{110CD}\x{111C2}\x{111C3}\x{1193F}\x{11941}\x{11A3A}\x{11A84}-\x{11A89}\x{11D46}\x{11F02}]"
_DIGITS, _LATIN_LETTERS = r"0-9\x{09E6}-\x{09EF}", r"A-Za-z\x{00C0}-\x{024F}"
_BENGALI = r"\x{0980}-\x{09E5}\x{09F0}-\x{09FF}\x{200C}\x{200D}"
#: A run of one script: Bengali, Latin, digits, or anything else that is not white space.
SCRIPT_RUN = f"[{_BENGALI}]+|[{_LATIN_LETTERS}]+|[{_DIGITS}]+|[^{_BENGALI}{_LATIN_LETTERS}{_DIGITS}{SPACE_CLASS}]+"
