"""Scalar functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that stand for no speaker.
PLACEHOLDERS = ("person", "all", "moderator", "member-girl", "others", "unknown")


def prefix(text: Column, mark: str = "_") -> Column:
    """What comes before the first mark."""
    return F.substring_index(text, mark, 1)


def clean_speaker(name: Column) -> Column:
    """A speaker's name with repaired quotes and without white space at its ends; null where nothing is left, and for
    placeholders, whatever number follows them."""
    fixed = F.regexp_replace(F.translate(name, "\x92\x93\x94", "’\"\""), r"^\s+|\s+$", "")
    stem = F.lower(F.trim(F.regexp_replace(fixed, "[0-9]+$", "")))
    return F.when((fixed != "") & ~stem.isin(*PLACEHOLDERS), fixed)


def clamp(value: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def pointer_value(x: Column, width: Column) -> Column:
    """Place on a slider as -1..1; 0 where the width isn't positive."""
    return F.when(width > 0, clamp(x / width * 2 - 1)).otherwise(0.0)


def half_width(arousal: Column) -> Column:
    return 0.015 + clamp((arousal + 1) / 2, 0.0, 1.0) * 0.205


def floor_percent(done: Column, total: Column) -> Column:
    return F.when(total == 0, 0).otherwise(F.floor(done * 100 / total))


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero, of the number as it is stored: 0.31525, a little less than that in binary, becomes 0.3152. ``round`` takes
    the shortest decimal that names the number for the number itself."""
    return F.round(x * float(10**digits), 0) / float(10**digits)


def exact_sum(x: Column) -> Column:
    """The sum of doubles as they are written, to six digits; no order of adding changes it."""
    return F.sum(x.cast("decimal(24,6)"))


def nearest_rank(values: Column, p: float) -> Column:
    """sorted[min(n - 1, round(p * (n - 1)))], halves to even; null without values."""
    at = F.least(F.size(values) - 1, F.bround(p * (F.size(values) - 1), 0).cast("int"))
    return F.when(F.size(values) > 0, F.get(F.array_sort(values), at))


def spaced(n: Column) -> Column:
    """Up to nine different positions, evenly in the middle 88 % of n."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.floor(n * (0.06 + 0.88 * (i + 0.5) / 9))))


def cosine(a: Column, b: Column) -> Column:
    """Inner product, the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    """A vector of length one; zero stays zero."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


#: Characters beside which no blank is put, modalities and sets whose tasks need the language, asset kinds.
CJK = "⺀-〿㐀-䶿一-鿿豈-﫿︰-﹏＀-￯"
LANGUAGE_MODALITIES, LANGUAGE_SETS = ("text", "audiovisual"), ("chsims",)
#: Strong words of a translation, and the parts of the original that call for each.
LICENSED = {
    "so": ["这么", "那么", "太", "好", "如此", "死了", "极了", "透了"],
    "such": ["这么", "那么", "如此"],
    "really": ["真", "确实", "实在", "可", "着实"],
    "totally": ["完全", "整个", "彻底"],
    "absolutely": ["绝对", "绝", "千万", "一定", "务必"],
    "completely": ["完全", "彻底", "殆尽", "全"],
    "even": ["都", "就算", "即使", "连", "甚至", "还", "也"],
    "ever": ["从来", "自从", "曾", "过"],
    "never": ["从来", "从没", "永远", "绝不", "横竖", "没", "不曾"],
    "damn": ["该死", "他妈"],
    "terrible": ["糟", "可怕", "惨", "差"],
    "wonderful": ["好极", "棒", "美妙"],
    "awful": ["糟", "可怕", "惨"],
    "extremely": ["极", "非常", "不得了", "得很", "十分"],
    "incredibly": ["极", "非常", "不得了"],
    "utterly": ["完全", "彻底"],
}


def needs_blank(before: Column, after: Column) -> Column:
    """Whether a blank goes between two tokens: both are there, and neither meets the other with a CJK character."""
    a, b = F.right(before, F.lit(1)), F.left(after, F.lit(1))
    return F.coalesce((a != "") & (b != "") & ~a.rlike(f"[{CJK}]") & ~b.rlike(f"[{CJK}]"), F.lit(False))


def unlicensed(original: Column, translation: Column) -> Column:
    """Strong words of the translation that nothing in the original calls for. ``so`` as a conjunction doesn't count."""
    words = F.regexp_extract_all(F.lower(translation), F.lit("[a-z']+"), F.lit(0))
    joins = ~translation.rlike(r"\bso +[a-z]+(ly)?\b(?! +[A-Z])") & (translation.startswith("So ") | translation.contains(", so ") | translation.contains(". So "))
    found = []
    for word, cues in LICENSED.items():
        hit = F.array_contains(words, word) & ~original.rlike("|".join(cues))
        found.append(F.when(hit & ~joins if word == "so" else hit, word))
    return F.array_compact(F.array(*found))


def word_ratio(original: Column, translation: Column) -> Column:
    """Words of the translation for each character of the original."""
    n = F.size(F.filter(F.split(F.trim(translation), r"\s+"), lambda x: x != ""))
    return n / F.greatest(F.lit(1), F.char_length(original))


def utc_iso(at: Column) -> Column:
    """A time without a zone as UTC in ISO 8601, with microseconds only where there are some."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(at, "SSSSSS")
    return F.concat(whole, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("+00:00"))


def crop_rule(sample_id: Column, width: Column, height: Column, keep: float = 0.82) -> Column:
    """The crop of a source's clips: one keeps the upper part at an even height, one has a fixed crop for its only size."""
    top = F.floor(F.floor(height * keep) / 2) * 2
    return F.when(sample_id.startswith("chsims_"), F.concat(F.lit("crop="), width.cast("string"), F.lit(":"), top.cast("string"), F.lit(":0:0"))).when(
        sample_id.startswith("iemocap_") & (width == 360) & (height == 480), F.lit("fixed")
    )


def language_exclusive(modality: Column, sample_id: Column) -> Column:
    """Tasks that need someone who reads the language."""
    return modality.isin(*LANGUAGE_MODALITIES) & prefix(sample_id).isin(*LANGUAGE_SETS)


def best_fraction(value: Column, limit: int = 100_000) -> Column:
    """The fraction nearest to ``value`` (0, or from 1/500 up) among those with a denominator up to ``limit``, in lowest terms: a struct of
    n and d. A double is a whole number of halves, quarters, ...; its continued fraction is followed as long as denominators
    fit, and then the last of them competes with the one that takes as much of the next term as still fits."""
    scale = F.lit(53) - F.floor(F.log2(value)).cast("int")
    one = F.pow(F.lit(2.0), scale)
    start = lambda **v: F.struct(*(x.cast("long").alias(k) for k, x in v.items()))
    most = F.lit(limit).cast("long")
    whole = lambda a, b: F.call_function("div", a, b)

    named = lambda x, use: F.get(F.transform(F.array(x), use), 0)  # noqa: E731  (worked out once, however often it is used)

    def step(s: Column, _: Column) -> Column:
        def turn(a: Column) -> Column:
            moved = F.struct(s["p"].alias("p0"), s["q"].alias("q0"), (s["p0"] + a * s["p"]).alias("p"), (s["q0"] + a * s["q"]).alias("q"), s["d"].alias("n"), (s["n"] - a * s["d"]).alias("d"))
            return F.when((s["q"] == 0) | (a <= whole(most - s["q0"], F.greatest(s["q"], F.lit(1)))), moved).otherwise(s)

        return F.when(s["d"] == 0, s).otherwise(named(whole(s["n"], s["d"]), turn))

    def chosen(m: Column) -> Column:
        more = whole(most - m["q0"], F.greatest(m["q"], F.lit(1)))
        wide = m["q0"] + more * m["q"]
        # 2 * d * wide <= whole: the last convergent is nearer
        last = (m["d"] == 0) | (m["d"].cast("decimal(20,0)") * wide.cast("decimal(10,0)") * 2 <= one.cast("decimal(20,0)"))
        return F.when(last, F.struct(m["p"].alias("n"), m["q"].alias("d"))).otherwise(F.struct((m["p0"] + more * m["p"]).alias("n"), wide.alias("d")))

    zero, unit_ = F.lit(0), F.lit(1)
    made = F.aggregate(F.sequence(F.lit(1), F.lit(40)), start(p0=zero, q0=unit_, p=unit_, q=zero, n=value * one, d=one), step)
    return F.when(value == 0, start(n=zero, d=unit_)).otherwise(named(made, chosen))


def rational_rate(fps: Column, limit: int = 100_000) -> Column:
    """A frame rate as its best fraction with a denominator up to ``limit``."""
    return F.get(F.transform(F.array(best_fraction(fps, limit)), lambda x: F.concat(x["n"].cast("string"), F.lit("/"), x["d"].cast("string"))), 0)


def token_hash(token: Column) -> Column:
    return F.sha2(F.encode(token, "UTF-8"), 256)
