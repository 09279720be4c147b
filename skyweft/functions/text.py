"""Identifiers, file names, URLs and fixed-point text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sky import bind

# Patterns and file-name formats of the input catalogs.
HEADER_LINE = r"^#\s*(\d+)\s+([A-Za-z0-9_]+)\b"
UNSAFE_CHARS = r"[^A-Za-z0-9._-]+"
TILE_FILE_LINE = r"(?i)CFIS_LSB\.(\d{3})\.(\d{3})\.r\."
TILE_BARE_LINE = r"\b(\d{3})\.(\d{3})\b"
TILE_FILE_FORMAT = "CFIS_LSB.%03d.%03d.r.fits"
CUTOUT_FILE = r"^tile_(.+?)_source_(.+)\.fits$"
FILTER_TOKEN = r"(?i)^F\d{3,4}[A-Z0-9]*$"
FIELD_VERSION = r"(?i)v\d+$"
FRAME_BAND = r"frame-([ugriz])-"
QUERY_BAND = r"[?&](?:band|bands|filter)=([ugriz])(?:[&$])?"
URL_IN_TEXT = r"https?://[^\s\"'<>]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def source_id(raw: Column | str) -> Column:
    """Integral numbers become plain integer text, anything else is made safe
    for file names; nothing left becomes 'unknown'."""
    text = F.trim(col(raw))
    number = text.try_cast("double")
    nearest = F.rint(number)
    integral = (F.abs(number) < 1e18) & (F.abs(number - nearest) < 1e-6)
    safe = F.regexp_replace(text, UNSAFE_CHARS, "_")
    return (
        F.when(integral, nearest.cast("bigint").cast("string"))
        .when(safe == "", "unknown")
        .otherwise(safe)
    )


def first_nonempty(*cols: Column | str) -> Column:
    """First value that is neither NULL nor empty; '' when there is none."""
    return F.coalesce(*[F.nullif(col(c).cast("string"), F.lit("")) for c in cols], F.lit(""))


def tile_id(tile_x: Column | str, tile_y: Column | str) -> Column:
    return F.format_string("%03d.%03d", col(tile_x), col(tile_y))


def tile_file_name(tile_x: Column | str, tile_y: Column | str) -> Column:
    return F.format_string(TILE_FILE_FORMAT, col(tile_x), col(tile_y))


def parse_tile(text: Column | str) -> Column:
    """struct(tile_x, tile_y) from a tile file name or a bare xxx.yyy; NULL
    fields when neither occurs."""
    t = col(text)

    def part(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(t, pattern, group), F.lit(""))

    def either(group: int) -> Column:
        return F.coalesce(part(TILE_FILE_LINE, group), part(TILE_BARE_LINE, group)).cast("int")

    return F.struct(either(1).alias("tile_x"), either(2).alias("tile_y"))


def fixed_point(value: Column | str, digits: int) -> Column:
    """C-style ``%.<digits>f``: the exact binary value rounded half to even.

    ``format_string`` rounds the shortest decimal form half up, which differs
    on ties (0.125, 1.005). Here value * 10**digits is held as a product plus
    its rounding error (two-product), so the tie test is exact. Beyond
    2**52 / 10**digits the integer part and the fraction, both exact, are written
    apart; up to 1e37. Non-finite prints nan.
    """
    scale, split = float(10**digits), float(2**27 + 1)
    ph = scale * split - (scale * split - scale)
    pl = scale - ph
    ten = F.lit(10**digits).cast("bigint")

    def units(a: Column) -> Column:
        y = a * scale
        ah = a * split - (a * split - a)
        err = ((ah * ph - y) + ah * pl + (a - ah) * ph) + (a - ah) * pl
        near = F.rint(y)
        up, down = ((y - near) - 0.5) + err > 0.0, ((y - near) + 0.5) + err < 0.0
        return (near + up.cast("double") - down.cast("double")).cast("bigint")

    def digits_of(u: Column) -> Column:
        if digits == 0:
            return u.cast("string")
        rest = u % ten
        whole = ((u - rest) / ten).cast("bigint").cast("string")
        return F.concat(whole, F.lit("."), F.substring((ten + rest).cast("string"), 2, digits))

    # Only values next to a tie need the exact test; the rest go through decimals.
    v = col(value).cast("double")
    a = F.abs(v)
    y = a * scale
    near_tie = F.abs(y - F.floor(y) - 0.5) <= y * 4e-16
    exact = bind(units(a), digits_of)
    quick = a.cast(f"decimal(18,{digits})").cast("string")
    sign = F.when(v < 0.0, "-").otherwise("")
    floor = F.when(a < float(2**53), F.floor(F.least(a, F.lit(float(2**53)))).cast("double")).otherwise(a)

    def decimal_of(x: Column) -> Column:
        """An integral double below 2**64, exactly; a plain cast would go through
        the shortest decimal form."""
        top = F.floor(x / float(2**32))
        rest = (x - top.cast("double") * float(2**32)).cast("bigint")
        return top.cast("decimal(10,0)") * F.lit(2**32).cast("decimal(10,0)") + rest.cast("decimal(10,0)")

    def joined(u: Column) -> Column:  # u: the fraction in units of the last digit
        carry = u >= ten
        rest = F.when(carry, u - ten).otherwise(u)
        high = F.floor(F.least(floor, F.lit(1e37)) / float(2**64))
        low = F.least(floor, F.lit(1e37)) - high.cast("double") * float(2**64)
        base = F.lit("18446744073709551616").cast("decimal(20,0)")
        whole = (high.cast("decimal(18,0)") * base).cast("decimal(38,0)") + decimal_of(low).cast("decimal(21,0)") + carry.cast("int")
        tail = F.lit("") if digits == 0 else F.concat(F.lit("."), F.substring((ten + rest).cast("string"), 2, digits))
        return F.concat(whole.cast("decimal(38,0)").cast("string"), tail)

    fraction = a - floor
    # At digits = 0 a tie goes to the even integer, which needs the integer's parity.
    odd = (floor % 2 == 1) & (fraction == 0.5)
    large = bind(units(fraction) + odd.cast("bigint") if digits == 0 else units(fraction), joined)
    return (
        F.when(v.isNull() | F.isnan(v), "nan")
        .when(a == float("inf"), F.concat(sign, F.lit("inf")))
        .when(a >= 1e37, F.format_string(f"%.{digits}f", v))
        .when(a >= float(2**52) / scale, F.concat(sign, large))
        .otherwise(F.concat(sign, F.when(near_tie, exact).otherwise(quick)))
    )


def file_stem(name: Column | str) -> Column:
    """Drop .fits.gz or the last suffix."""
    n = col(name)
    return F.when(n.endswith(".fits.gz"), F.regexp_replace(n, r"\.fits\.gz$", "")).otherwise(
        F.regexp_replace(n, r"(?<=.)\.[^.]*$", "")
    )


def masked_name(name: Column | str, tag: str = "masked") -> Column:
    """a.fits -> a.<tag>.fits, a.fits.gz -> a.<tag>.fits.gz, other -> other.<tag>.fits"""
    n = col(name)
    return (
        F.when(n.endswith(".fits.gz"), F.regexp_replace(n, r"\.fits\.gz$", f".{tag}.fits.gz"))
        .when(n.endswith(".fits"), F.regexp_replace(n, r"\.fits$", f".{tag}.fits"))
        .otherwise(F.concat(n, F.lit(f".{tag}.fits")))
    )


def filter_and_field(name: Column | str) -> Column:
    """struct(filter, field): the first dash token before '_' that looks like a
    filter, and the token after it with its version suffix removed."""
    stem = F.regexp_replace(col(name), r"\.fits(\.gz)?$", "")
    tokens = F.filter(F.split(F.split_part(stem, F.lit("_"), F.lit(1)), "-"), lambda t: t != "")
    at = F.array_position(F.transform(tokens, lambda t: t.rlike(FILTER_TOKEN)), True).cast("int")
    found = F.when(at > 0, at)
    field = F.upper(F.regexp_replace(F.trim(F.get(tokens, found)), FIELD_VERSION, ""))
    return F.struct(
        F.upper(F.get(tokens, found - 1)).alias("filter"),
        F.nullif(field, F.lit("")).alias("field"),
    )


def url_band(url: Column | str) -> Column:
    low = F.lower(col(url))
    return F.coalesce(
        F.nullif(F.regexp_extract(low, FRAME_BAND, 1), F.lit("")),
        F.regexp_extract(low, QUERY_BAND, 1),
    )


def urls_in(text: Column | str) -> Column:
    """URLs in a text in order of first appearance, without repeats."""
    plain = col(text)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.array_distinct(F.regexp_extract_all(plain, F.lit(URL_IN_TEXT), F.lit(0)))


def query_url(base: str, params: list[tuple[str, Column | str]]) -> Column:
    """base?k=v&... with percent-encoded values; NULL values are left out."""
    pairs = []
    for key, value in params:
        v = value if isinstance(value, Column) else F.lit(value)
        pairs.append(F.when(v.isNotNull(), F.concat(F.lit(f"{key}="), F.url_encode(v))))
    return F.concat(F.lit(f"{base}?"), F.concat_ws("&", *pairs))


def cutout_url(base: str, ra, dec, width, height, pixscale, layer: str, band: str, subimage=None) -> Column:
    return query_url(
        base,
        [
            ("ra", fixed_point(ra, 8)),
            ("dec", fixed_point(dec, 8)),
            ("width", col(width).cast("string")),
            ("height", col(height).cast("string")),
            ("pixscale", fixed_point(pixscale, 6)),
            ("layer", layer),
            ("bands", band),
            ("subimage", F.lit(subimage)),
        ],
    )


def image_search_url(endpoint: str, ra, dec, size_deg, band: str) -> Column:
    position = F.concat_ws(",", fixed_point(ra, 8), fixed_point(dec, 8))
    return query_url(
        endpoint,
        [("POS", position), ("SIZE", fixed_point(size_deg, 6)), ("FORMAT", "image/fits"), ("bandpass", band)],
    )


def parse_xy(text: Column | str) -> Column:
    """'x,y' -> struct(x, y); NULL when there are not exactly two numbers."""
    parts = F.filter(F.transform(F.split(col(text), ","), F.trim), lambda p: p != "")
    ok = F.size(parts) == 2
    x, y = F.get(parts, 0).try_cast("double"), F.get(parts, 1).try_cast("double")
    return F.when(ok & x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def qualify_columns(columns: str, owners: dict[str, set[str]]) -> str:
    """Prefix bare names with the alias of the table that owns them; names that
    are already qualified, expressions and unknown names stay as they are."""

    def one(name: str) -> str:
        if any(ch in name for ch in ".( "):
            return name
        alias = next((a for a, names in owners.items() if name in names), None)
        return f"{alias}.{name}" if alias else name

    return ", ".join(one(c.strip()) for c in columns.split(",") if c.strip())


def metric_name(name: str) -> str:
    return name[2:] if name.startswith(("P_", "S_")) else name
