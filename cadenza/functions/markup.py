"""Column functions over markup strings and acoustic values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Defaults of the acoustic model.
BASE_FREQUENCY, BASE_AMPLITUDE = 180.0, 0.5


def escape(text: Column) -> Column:
    """Text with &, <, > and double quotes as entities."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def attribute(name: str, value: Column) -> Column:
    """`` name="value"``, or nothing for null."""
    return F.coalesce(F.concat(F.lit(f' {name}="'), escape(value), F.lit('"')), F.lit(""))


def whole(value: Column) -> Column:
    """A number without decimals, half to even; what rounds to zero from below is ``-0``."""
    rounded = F.rint(value)
    return F.when((rounded == 0) & (value < 0), "-0").otherwise(rounded.cast("long").cast("string"))


def relative(value: Column, unit: str, plus_at_zero: bool = True) -> Column:
    """``value`` with its sign and unit: +12%, -3dB."""
    plus = value >= 0 if plus_at_zero else value > 0
    return F.concat(F.when(plus, "+").otherwise(""), whole(value), F.lit(unit))


def plain_number(value: Column, places: int) -> Column:
    """A number rounded half to even, written with at least one decimal and no exponent."""
    return number_text(F.bround(value, places))


def number_text(value: Column) -> Column:
    """A number in full: at least one decimal, ten at most, no exponent; nan, inf and -inf."""
    odd = F.isnan(value) | (F.abs(value) == float("inf"))
    named = F.replace(F.lower(value.cast("string")), F.lit("infinity"), F.lit("inf"))
    full = F.regexp_replace(F.format_string("%.10f", value), r"(?<=\.\d{1,9})0+$|(?<=\.0)0+$", "")
    return F.when(odd, named).when(value.isNotNull(), full)


def finite(value: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def float_or_null(text: Column) -> Column:
    """A number as Python's float() reads it (ASCII forms), else null."""
    fine = text.rlike(r"^\s*[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$")
    word = text.rlike(r"(?i)^\s*[+-]?(nan|inf|infinity)\s*$")
    plain = F.regexp_replace(F.lower(text), r"[\s_+]|(?<=inf)inity", "")
    signed = F.when(fine, F.replace(F.btrim(text), F.lit("_"), F.lit(""))).when(word, F.replace(plain, F.lit("-nan"), F.lit("nan")))
    return signed.try_cast("double")


def int_or_null(text: Column) -> Column:
    """A whole number as Python's int() reads it (ASCII forms), else null."""
    return F.when(text.rlike(r"^\s*[+-]?\d+(_\d+)*\s*$"), F.replace(F.btrim(text), F.lit("_"), F.lit("")).try_cast("long"))


def pitch_to_hz(pitch: Column, base: Column | float = BASE_FREQUENCY) -> Column:
    """Absolute frequency of ``+N%``, ``+Nst`` or ``NHz`` over ``base``; anything else is ``base``."""
    base = base if isinstance(base, Column) else F.lit(base)
    number = lambda unit, sign: F.regexp_extract(pitch, rf"^({sign}\d+(?:\.\d+)?){unit}$", 1)
    percent, semitones, hertz = number("%", "[+\\-]"), number("st", "[+\\-]"), number("Hz", "")
    return (
        F.when(percent != "", base * (1.0 + percent.try_cast("double") / 100.0))
        .when(semitones != "", base * F.pow(F.lit(2.0), semitones.try_cast("double") / 12.0))
        .when(hertz != "", hertz.try_cast("double"))
        .otherwise(base)
    )


def volume_to_amplitude(volume: Column, base: Column | float = BASE_AMPLITUDE) -> Column:
    """Amplitude of ``+NdB`` over ``base``; anything else is ``base``."""
    base = base if isinstance(base, Column) else F.lit(base)
    decibels = F.regexp_extract(volume, r"^([+\-]\d+(?:\.\d+)?)dB$", 1)
    return F.when(decibels != "", base * F.pow(F.lit(10.0), decibels.try_cast("double") / 20.0)).otherwise(base)


def volume_to_ssml(volume: Column) -> Column:
    """SSML volume: x-soft up to -20 dB, x-loud from 20 dB, else a signed dB value; text that is no
    dB value passes."""
    decibels = F.regexp_extract(volume, r"(?i)^([+-]?\d+(\.\d+)?)dB$", 1)
    value = decibels.try_cast("double")
    short = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", value), "0+$", ""), r"\.$", "")
    return (
        F.when(volume.isNull() | (decibels == ""), volume)
        .when(value <= -20, "x-soft")
        .when(value >= 20, "x-loud")
        .otherwise(F.concat(F.when(value >= 0, "+").otherwise(""), F.when(value == 0, "0").otherwise(short), F.lit("dB")))
    )


def voice_quality(jitter: Column, shimmer: Column, hnr: Column) -> Column:
    """breathy, creaky, tense or modal; null if nothing was measured."""
    return (
        F.when(hnr < 7.0, "breathy")
        .when(jitter > 0.02, "creaky")
        .when(shimmer > 0.12, "tense")
        .when(F.coalesce(jitter, shimmer, hnr).isNotNull(), "modal")
    )


def resampled(values: Column, points: int = 20) -> Column:
    """A contour on ``points`` equal steps by linear interpolation; empty: zeros."""
    n = F.size(values)

    def at(k: Column) -> Column:
        place = k.cast("double") * (n - 1) / F.lit(points - 1)
        low = F.least(F.floor(place).cast("int"), n - 2)
        a, b = F.get(values, low).cast("double"), F.get(values, low + 1).cast("double")
        return a + (b - a) * (place - low)

    return (
        F.when(n == 0, F.array_repeat(F.lit(0.0), points))
        .when(n == 1, F.array_repeat(F.get(values, F.lit(0)).cast("double"), points))
        .otherwise(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at))
    )
