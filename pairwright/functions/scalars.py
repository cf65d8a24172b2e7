"""Fixed-point geometry, colour contrast, style parsing and path rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright.functions.binding import let

# Fixed-point scale and coordinate range.
Q64_SCALE = 64
Q64_LIMIT = 16_777_216


def round_ties_even(value: Column) -> Column:
    """Nearest integer, ties to even; the cast to long also turns -0.0 into 0."""
    return F.rint(value).cast("long")


def quantize_q64(value: Column) -> Column:
    """1/64 units; null when outside the coordinate range."""
    scaled = F.rint(value * Q64_SCALE)
    return F.when(F.abs(scaled) <= Q64_LIMIT, scaled.cast("long"))


def shift_box(box: Column, scroll_x: Column, scroll_y: Column) -> Column:
    """Page coordinates to viewport coordinates."""
    return F.struct(
        (box["x"] - scroll_x).alias("x"),
        (box["y"] - scroll_y).alias("y"),
        box["width"].alias("width"),
        box["height"].alias("height"),
    )


def overflow_clip(
    box: Column, client: Column, overflow_x: Column, overflow_y: Column, scroll_x: Column, scroll_y: Column
) -> Column:
    """Clip box of an element whose overflow is not visible on both axes; null otherwise."""
    clip = F.struct(
        (box["x"] + client["x"] - scroll_x).alias("x"),
        (box["y"] + client["y"] - scroll_y).alias("y"),
        client["width"].alias("width"),
        client["height"].alias("height"),
    )
    return F.when(~((overflow_x == "visible") & (overflow_y == "visible")), clip)


RGB_PATTERN = r"^rgb\(\s*(\d{1,3})\s*,\s*(\d{1,3})\s*,\s*(\d{1,3})\s*\)$"


def parse_rgb(text: Column) -> Column:
    """Three channels of an opaque ``rgb(r, g, b)``; null when malformed or out of range."""
    channels = F.array(*[F.try_to_number(F.regexp_extract(text, RGB_PATTERN, i), F.lit("999")).cast("int") for i in (1, 2, 3)])
    return F.when(text.rlike(RGB_PATTERN) & F.forall(channels, lambda c: c.between(0, 255)), channels)


def _luminance(rgb: Column) -> Column:
    # sRGB transfer function and luminance weights.
    def linear(channel: Column) -> Column:
        scaled = channel / F.lit(255.0)
        return F.when(scaled <= 0.04045, scaled / 12.92).otherwise(F.pow((scaled + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * linear(rgb[0]) + 0.7152 * linear(rgb[1]) + 0.0722 * linear(rgb[2])


def contrast_milli(foreground: Column, background: Column) -> Column:
    """WCAG contrast ratio in thousandths, halves rounded up."""
    first, second = _luminance(foreground), _luminance(background)
    ratio = (F.greatest(first, second) + 0.05) / (F.least(first, second) + 0.05)
    # greatest and least skip nulls, so an unparsed colour must be kept null here
    return F.when(first.isNotNull() & second.isNotNull(), F.floor(ratio * 1000 + 0.5).cast("long"))


OPACITY_PATTERN = r"^(?:0(?:\.\d+)?|1(?:\.0+)?)$"
Z_INDEX_PATTERN = r"^-?(?:0|[1-9]\d*)$"


def parse_opacity(text: Column) -> Column:
    """Canonical decimal between zero and one, in thousandths; null when malformed."""
    return F.when(text.rlike(OPACITY_PATTERN), F.rint(text.try_cast("double") * 1000).cast("long"))


def parse_z_index(text: Column) -> Column:
    """Canonical 32-bit integer; null for ``auto`` and for malformed text."""
    return F.when(text.rlike(Z_INDEX_PATTERN) & (text != "-0"), text.try_cast("int").cast("long"))


def z_index_malformed(text: Column) -> Column:
    return (text != "auto") & parse_z_index(text).isNull()


def unsafe_path(path: Column, strict: bool = False) -> Column:
    """Relative path that is empty-ended, doubled or climbs; ``strict`` also bars backslash and percent."""
    unsafe = (
        path.startswith("/")
        | path.endswith("/")
        | path.contains("//")
        | F.exists(F.split(path, "/"), lambda part: part.isin(".", ".."))
    )
    return unsafe | path.contains("\\") | path.contains("%") if strict else unsafe


def path_ancestors(path: Column) -> Column:
    """Every proper ancestor directory of a relative path."""

    def prefixes(parts: Column) -> Column:
        depths = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: n > 0)
        return F.transform(depths, lambda n: F.array_join(F.slice(parts, 1, n), "/"))

    return let(F.split(path, "/"), prefixes)


def parameters_out_of_order(text: Column, separator: str) -> Column:
    """``name=value`` parameters must have unique names sorted by name."""
    names = F.transform(F.split(text, separator), lambda part: F.substring_index(part, "=", 1))
    return (F.array_distinct(F.array_sort(names)) != names) & (text != "")


def epoch_micros(column: str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp column, whatever the session time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})")
