import random
import unicodedata

import pytest
import regex
from pyspark.sql import functions as F

from lipika import charset as ch
from lipika.functions import text as T

SPELL = lambda s: "".join(chr(int(x, 16)) for x in s.split())
GOLDEN = [
    ("09B8 09CD 09A4 09CD 09B0 09C0", [6]),
    ("09A1 09BC 09BE", [3]),
    ("0985 09CD 09A4", [2, 1]),
    ("0995 09BE 09CD 09A4", [4]),
    ("0995 0982 09CD 09A4", [3, 1]),
    ("0995 0982 09BE", [3]),
    ("09A6 09C1 09C1 09C1 09C1", [5]),
    ("0985 09BC", [2]),
    ("0995 09CD", [2]),
    ("0995 09CD 200D 09A4", [4]),
    ("0995 09CD 200C 09A4", [3, 1]),
    ("0995 200D 09CD 09A4", [4]),
    ("09A8 200C 09CD 09A4", [3, 1]),
    ("0995 09BC 09BC", [3]),
    ("09CE 09CD 0995", [3]),
]


def column(spark, rows, f):
    df = spark.createDataFrame(list(enumerate(rows)), "k long, t string")
    return [r.x for r in df.select("k", f(F.col("t")).alias("x")).orderBy("k").collect()]


def machine(text):
    """Syllables by a scan over character classes."""
    out, at = [], 0
    marks = ch.MATRAS | ch.MODIFIERS | {ch.NUKTA, ch.ZWJ, ch.ZWNJ, ch.VIRAMA}
    while at < len(text):
        if text[at] not in ch.CONSONANTS | ch.VOWELS:
            end = regex.compile(r"\X").match(text, at).end()
        else:
            end, chains = at + 1, text[at] in ch.CONSONANTS
            while True:
                stop = end
                while stop < len(text) and text[stop] in marks:
                    stop += 1
                run = set(text[end:stop])
                end = stop
                if chains and ch.VIRAMA in run and not run & (ch.MODIFIERS | {ch.ZWNJ}) and end < len(text) and text[end] in ch.CONSONANTS:
                    end += 1
                else:
                    break
        out.append(text[at:end])
        at = end
    return out


def test_class_sizes():
    assert [len(x) for x in (ch.CONSONANTS, ch.VOWELS, ch.MATRAS, ch.MODIFIERS, ch.GUARANTEED)] == [43, 14, 18, 4, 225]
    classes = [ch.CONSONANTS, ch.VOWELS, ch.MATRAS, ch.MODIFIERS]
    assert sum(map(len, classes)) == len(frozenset().union(*classes))
    assert len(ch.MATRA_POSITION) == 18 and list(ch.MATRA_POSITION.values()).count("unassigned") == 4


def test_golden_syllables(spark):
    got = column(spark, [SPELL(s) for s, _ in GOLDEN], T.aksharas)
    for (_, sizes), chunks in zip(GOLDEN, got):
        assert [c.end - c.start for c in chunks] == sizes and {c.kind for c in chunks} == {"akshara"}
    other = column(spark, [SPELL("09BF"), SPELL("1F468 200D 1F469 200D 1F467"), "", "ab", None], T.aksharas)
    assert [[(c.start, c.end, c.kind) for c in x] if x is not None else None for x in other] == [[(0, 1, "other")], [(0, 5, "other")], [], [(0, 1, "other"), (1, 2, "other")], None]


def test_random_strings_equal_a_scan_and_the_cluster_library(spark):
    rng = random.Random(20260725)
    alphabet = [*map(chr, range(0x0980, 0x0A00)), ch.VIRAMA, ch.VIRAMA, ch.VIRAMA, ch.ZWJ, ch.ZWNJ, "a", " ", "\n", ch.DANDA, chr(0x995), chr(0x9A4), ch.RA]
    rows = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(14))) for _ in range(3000)]
    assert column(spark, rows, T.chunks) == [machine(r) for r in rows]
    assert column(spark, rows, T.graphemes) == [regex.findall(r"\X", r) for r in rows]


def test_long_chain_is_one_syllable(spark):
    text = chr(0x995) + (ch.VIRAMA + chr(0x995)) * 50_000
    assert [len(x) for x in column(spark, [text], T.chunks)] == [1]


def test_chunk_rows_offsets(spark):
    text = SPELL("0995 09CD 09A4") + " ab" + SPELL("09A8 09BF")
    df = spark.createDataFrame([(1, text, "x")], "k long, t string, tag string")
    rows = T.chunk_rows(df, "k", "t", ("tag",)).orderBy("pos").collect()
    assert [text[r.start : r.end] for r in rows] == [r.chunk for r in rows] == machine(text)


@pytest.mark.parametrize(
    ("text", "policy", "expected"),
    [("09A1 09BC", "preserve", "09DC"), ("09A2 09BC", "preserve", "09DD"), ("09AF 09BC", "preserve", "09DF"), ("09DC", "preserve", "09DC"), ("09A4 09CD 200D", "preserve", "09CE"), ("0995 09CD 200C 09A4", "strip", "0995 09CD 09A4"), ("", "strip", "")],
)
def test_normalize(spark, text, policy, expected):
    assert column(spark, [SPELL(text)], lambda c: T.normalize(c, policy)) == [SPELL(expected)]


def test_nfc_and_words(spark):
    rows = ["e\u0301", "\u00e9", "a  b\tc ", None, SPELL("09DC"), "x\x1cy"]
    assert column(spark, rows, T.nfc) == [unicodedata.normalize("NFC", r) if r is not None else None for r in rows]
    assert column(spark, rows, T.words) == [r.split() if r is not None else None for r in rows]
    assert column(spark, rows, T.is_nfc) == [False, True, True, None, False, True]


def test_features(spark):
    cases = [
        ("0995 09BF", ["0995"], [False], "09BF", [], True),
        ("09B8 09CD 09A4 09CD 09B0 09C0", ["09B8", "09A4", "09B0"], [False] * 3, "09C0", [], True),
        ("09A1 09BC 09CD 0995", ["09A1", "0995"], [True, False], None, [], True),
        ("0986 0983", [], [], "0986", ["0983"], True),
        ("0986", [], [], "0986", [], True),
        ("0995 09BE 09CD 09A4", ["0995"], [False], "09BE", [], False),
        ("0995 09CD 200D 09A4", ["0995"], [False], None, [], False),
    ]
    got = column(spark, [SPELL(c[0]) for c in cases], T.features)
    for (text, onset, nuktas, vowel, marks, lossless), f in zip(cases, got):
        assert (f.text, f.onset, f.nuktas, f.vowel, f.modifiers, f.is_lossless) == (SPELL(text), [SPELL(x) for x in onset], nuktas, SPELL(vowel) if vowel else None, [SPELL(x) for x in marks], lossless)
    assert column(spark, ["a"], T.features) == [None]
    assert [tuple(x) for x in column(spark, [SPELL("0995 09CD 09B7 09C1"), SPELL("0995"), SPELL("0986 0983")], T.onset_tail)] == [(SPELL("0995 09CD 09B7"), SPELL("09C1")), (SPELL("0995"), ""), (SPELL("0986 0983"), "")]


def test_lines(spark):
    d = ch.DANDA
    rows = ["a\n b \n\nc", f"x{d} y{d}z", "one", " ", "", None]
    assert column(spark, rows, T.split_lines) == [["a", "b", "c"], [f"x{d}", f"y{d}z"], ["one"], [], [], None]
    assert column(spark, ["abc", "abcd", "abéé", "ééab" + SPELL("0995 0995 0995 0995")], T.is_clean_line) == [False, True, False, True]
