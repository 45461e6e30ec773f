"""Column builders: labels, identities, uncertainty, losses. All are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Confidence levels of a judgment and their values; blank is missing.
CONFIDENCE = {"Not Confident": 0.0, "Somewhat Confident": 0.5, "Confident": 1.0}
_EDGE = " \t\n\x0b\f\r"


def strip(x: Column) -> Column:
    """Without white space of any kind at either end (``trim`` takes spaces only)."""
    return F.btrim(x, F.lit(_EDGE))


def label_set(annotation: Column) -> Column:
    """A comma list as a sorted array of distinct labels without blanks."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(annotation, ","), strip), lambda x: x != "")))


def label_signature(annotation: Column) -> Column:
    return F.array_join(label_set(annotation), ",")


def indicator(labels: Column, code: str) -> Column:
    return F.array_contains(labels, code).cast("double")


def item_id(*parts: Column) -> Column:
    """SHA-256 of the identity tuple as a compact JSON array, so that no two tuples share it."""
    return F.sha2(F.to_json(F.array(*parts)), 256)


def content_id(text: Column) -> Column:
    return F.sha2(text, 256)


def hash_rank(namespace: str, seed: int, value: Column) -> Column:
    """A deterministic shuffle key: fixed-width hex, so its order as text is its order as a number."""
    return F.sha2(F.concat(F.lit(f"{namespace}:{seed}:"), value), 256)


def hash_int(value: Column) -> Column:
    """The first eight hex digits of SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(value, 256), 1, 8), 16, 10).cast("bigint")


def confidence_value(level: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, value in CONFIDENCE.items():
        out = F.when(level == name, F.lit(value)).otherwise(out)
    return out


def entropy(p: Column) -> Column:
    """Binary entropy in nats; 0 at 0 and 1, null outside [0, 1].

    Rounded to 12 places so that H(p) and H(1-p) tie before ranks are taken.
    """
    q = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p))
    h = -(q * F.ln(q) + (1 - q) * F.ln(1 - q))
    return F.when((p == 0) | (p == 1), F.lit(0.0)).when((p > 0) & (p < 1), F.round(h, 12))


def disagreement(h: Column, n: Column) -> Column:
    """Chance that two of ``n`` annotators differ; null below two annotators."""
    return F.when(n > 1, 2 * n * h * (1 - h) / (n - 1))


def squared(p: Column, h: Column) -> Column:
    return (p - h) * (p - h)


def absolute(p: Column, h: Column) -> Column:
    return F.abs(p - h)


def hard(p: Column) -> Column:
    """1 from one half on, else 0."""
    return (p >= 0.5).cast("double")


def majority(h: Column) -> Column:
    """``pos`` above one half, ``neg`` below, ``tie`` at it."""
    return F.when(h > 0.5, "pos").when(h < 0.5, "neg").when(h == 0.5, "tie")


def unit_clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def in_unit(x: Column) -> Column:
    """Whether a text or number is a finite number in [0, 1]."""
    value = x.try_cast("double")
    return F.coalesce(~F.isnan(value) & value.between(0, 1), F.lit(False))


def is_whole(x: Column) -> Column:
    return F.floor(x) == x


def as_bool(x: Column) -> Column:
    return F.lower(strip(x)) == "true"


def name_parts(x: Column) -> Column:
    """Lower-case words of a column name."""
    return F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: w != "")


def one_line(x: Column) -> Column:
    return F.regexp_replace(x, r"\R", " ")


def number_text(x: Column, places: int) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), "NA").otherwise(F.format_string(f"%.{places}f", x))


def cell_name(*parts: Column) -> Column:
    return F.concat_ws(" :: ", *parts)


def below_share(key: Column, share: float) -> Column:
    """Whether the first 16 hex digits of a hash key lie below ``share`` of their range."""
    bound = int(share * 16**16)
    return F.substring(key, 1, 16) < f"{bound:016x}"


def coder_loss(s: Column, h: Column) -> Column:
    """Expected squared loss against single votes of share ``h``."""
    return (s - h) * (s - h) + h * (1 - h)
