"""Porter stemming as Spark expressions.

The published algorithm (M. F. Porter, 1980) with the usual corrections of current
toolkits: a few irregular words, ``-ied``, ``-alli``, ``-fulli``, ``-logi``, ``-bli`` and a
milder rule for a final y. Every step is one projection of string built-ins; a word's
consonant/vowel pattern is a string of the same length, so the pattern of a stem is a prefix.
A run of y alternates between both kinds, however long it is.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: irregular words and suffix rules of the algorithm ------------
IRREGULAR = {
    "sky": ["sky", "skies"], "die": ["dying"], "lie": ["lying"], "tie": ["tying"],
    "news": ["news"], "inning": ["innings", "inning"], "outing": ["outings", "outing"],
    "canning": ["cannings", "canning"], "howe": ["howe"], "proceed": ["proceed"],
    "exceed": ["exceed"], "succeed": ["succeed"],
}
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"),
    ("biliti", "ble"), ("fulli", "ful"),
]
STEP_3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
]
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion",
    "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]
# --- end of fixed values ----------------------------------------------------------


def _pattern(w: Column) -> Column:
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    classes = "".join("y" if ch == "y" else "v" if ch in "aeiou" else "c" for ch in letters)
    raw = F.translate(w, letters, classes)
    # A y is a consonant at the start and after a vowel, and a vowel after a consonant.
    out = F.regexp_replace(raw, "^y", "c")
    # A run goes on in pairs from where the last pair ended; at most one y is left at its end.
    for before, after in ("cv", "vc"):
        out = F.regexp_replace(out, f"(?:(?<={before})|(?!^)\\G)yy", after + before)
        out = F.replace(out, F.lit(before + "y"), F.lit(before + after))
    return F.when(w.contains("y"), out).otherwise(raw)


class _Word:
    """A word and its pattern, both as columns of the current projection."""

    def __init__(self, word: str, pattern: str):
        self.text, self.cv = F.col(word), F.col(pattern)
        # Rules with suffixes of one length share the expressions of that stem.
        self.stem = cache(lambda cut: F.left(self.text, F.length(self.text) - cut))
        self.stem_cv = cache(lambda cut: F.left(self.cv, F.length(self.cv) - cut))
        self.measure = cache(lambda cut: F.regexp_count(self.stem_cv(cut), F.lit("vc")))

    def ends(self, suffix: str) -> Column:
        return self.text.endswith(suffix)

    def short(self, cut: int) -> Column:
        """Stem ends consonant-vowel-consonant, not in w, x, y; or is vowel-consonant."""
        cv, last = self.stem_cv(cut), F.right(self.stem(cut), F.lit(1))
        return (cv.endswith("cvc") & ~last.isin("w", "x", "y")) | (cv == "vc")


def _first_rule(w: _Word, rules: list[tuple[str, str, Callable[[int], Column] | None]]) -> Column:
    """The first suffix that fits decides, even when its condition then fails."""
    case = F
    for suffix, put, condition in rules:
        changed = F.concat(w.stem(len(suffix)), F.lit(put))
        if condition is not None:
            changed = F.when(condition(len(suffix)), changed).otherwise(w.text)
        case = case.when(w.ends(suffix), changed)
    return case.otherwise(w.text)


def _step_1a(w: _Word) -> Column:
    short_ies = w.ends("ies") & (F.length(w.text) == 4)
    plain = _first_rule(w, [("sses", "ss", None), ("ies", "i", None), ("ss", "ss", None), ("s", "", None)])
    return F.when(short_ies, F.concat(w.stem(3), F.lit("ie"))).otherwise(plain)


def _step_1b(w: _Word) -> Column:
    def repaired(cut: int) -> Column:
        base, cv = w.stem(cut), w.stem_cv(cut)
        last = F.right(base, F.lit(1))
        double = (F.length(base) >= 2) & (last == F.substr(base, F.length(base) - 1, F.lit(1))) & cv.endswith("c")
        add_e = F.concat(base, F.lit("e"))
        return (
            F.when(base.endswith("at") | base.endswith("bl") | base.endswith("iz"), add_e)
            .when(double & ~last.isin("l", "s", "z"), F.left(base, F.length(base) - 1))
            .when(double, base)
            .when((w.measure(cut) == 1) & w.short(cut), add_e)
            .otherwise(base)
        )

    def voiced(cut: int) -> Column:
        return w.stem_cv(cut).contains("v")

    return (
        F.when(w.ends("ied"), F.concat(w.stem(3), F.when(F.length(w.text) == 4, F.lit("ie")).otherwise(F.lit("i"))))
        .when(w.ends("eed"), F.when(w.measure(3) > 0, w.stem(1)).otherwise(w.text))
        .when(w.ends("ed") & voiced(2), repaired(2))
        .when(w.ends("ing") & voiced(3), repaired(3))
        .otherwise(w.text)
    )


def _step_1c(w: _Word) -> Column:
    soft = w.ends("y") & (F.length(w.text) > 2) & w.stem_cv(1).endswith("c")
    return F.when(soft, F.concat(w.stem(1), F.lit("i"))).otherwise(w.text)


def _step_2_alli(w: _Word) -> Column:
    return F.when(w.ends("alli") & (w.measure(4) > 0), w.stem(2)).otherwise(w.text)


def _step_2(w: _Word) -> Column:
    def some(cut: int) -> Column:
        return w.measure(cut) > 0

    rules = [(s, r, some) for s, r in STEP_2]
    return _first_rule(w, [*rules, ("logi", "log", lambda cut: w.measure(cut - 1) > 0)])


def _step_3(w: _Word) -> Column:
    return _first_rule(w, [(s, r, lambda cut: w.measure(cut) > 0) for s, r in STEP_3])


def _step_4(w: _Word) -> Column:
    def long_stem(suffix: str) -> Callable[[int], Column]:
        def condition(cut: int) -> Column:
            ok = w.measure(cut) > 1
            if suffix == "ion":
                ok = ok & F.right(w.stem(cut), F.lit(1)).isin("s", "t")
            return ok

        return condition

    return _first_rule(w, [(s, "", long_stem(s)) for s in STEP_4])


def _step_5a(w: _Word) -> Column:
    drop = (w.measure(1) > 1) | ((w.measure(1) == 1) & ~w.short(1))
    return F.when(w.ends("e") & drop, w.stem(1)).otherwise(w.text)


def _step_5b(w: _Word) -> Column:
    return F.when(w.ends("ll") & (w.measure(1) > 1), w.stem(1)).otherwise(w.text)


STEPS = [_step_1a, _step_1b, _step_1c, _step_2_alli, _step_2, _step_3, _step_4, _step_5a, _step_5b]


def stem_column(df: DataFrame, col: str, out: str | None = None, min_length: int = 4) -> DataFrame:
    """Stem a column of lower-case words; shorter words than ``min_length`` stay as they are."""
    word, cv = "_stem_word", "_stem_pattern"
    df = df.withColumn(word, F.col(col))
    for step in STEPS:
        df = df.withColumn(cv, _pattern(F.col(word)))
        df = df.withColumn(word, step(_Word(word, cv)))
    fixed = F
    for root, forms in IRREGULAR.items():
        fixed = fixed.when(F.col(col).isin(forms), F.lit(root))
    result = F.when(F.length(F.col(col)) < min_length, F.col(col)).otherwise(fixed.otherwise(F.col(word)))
    return df.withColumn(out or col, result).drop(word, cv)
