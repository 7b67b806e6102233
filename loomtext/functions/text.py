"""Column expressions on text: counts, splits, normalisation, hashes, and edits that leave protected zones alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Zones that text edits leave alone: fenced and inline code, display and inline mathematics.
ZONES = r"```[\s\S]*?```|`[^`\n]+`|\$\$[\s\S]*?\$\$|\$[^$\n]+\$"
#: The same with links, link definitions and footnotes, for citations.
CITATION_ZONES = ZONES + r"|\\\[[\s\S]*?\\\]|\\\([^\n]*?\\\)|!?\[[^\]]*\]\([^)]*\)|\[[^\]]*[a-zA-Z][^\]]*\]\[[^\]]*\]|\[\^[^\]]+\]"
UNICODE_SPACE = r"(?U)\s+"
#: The characters that (?U)\s matches.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
INVISIBLE = "\u00ad\u200b\u200c\u200d\ufeff"


def tokens(text: Column) -> Column:
    """Estimated tokens: a quarter of the characters, 1 at least, 0 for the empty text."""
    return F.when(text == "", F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))).cast("long")


def words(text: Column) -> Column:
    """Words between Unicode white space."""
    return F.size(F.filter(F.split(text, UNICODE_SPACE), lambda x: x != "")).cast("long")


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(text, F.lit(SPACES))


def ascii_classes(pattern: str) -> str:
    """A pattern whose word boundaries and white space (outside of brackets) are those of ASCII, as in DuckDB.

    Java's boundaries follow the letters of all scripts up to version 18.
    """
    edge = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
    return pattern.replace(r"\b", edge).replace(r"\s", r"[\t\n\f\r ]")


def format_count(value: Column) -> Column:
    """Digits in groups of three."""
    return F.format_number(value, 0)


def lines(text: Column) -> Column:
    """Lines between line feeds; trailing empty ones stay."""
    return F.split(text, "\n", -1)


def lines_any(text: Column) -> Column:
    """Lines between any of the line boundaries of Unicode text; no empty line after the last boundary."""
    parts = F.split(text, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def paragraphs(text: Column, many: bool = False) -> Column:
    """Parts between blank lines: exactly one, or as many as there are."""
    return F.split(text, "\n\n+" if many else "\n\n", -1)


def collapse_blank(text: Column) -> Column:
    """Three and more line feeds become two."""
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def hash64(text: Column) -> Column:
    """The first 8 bytes of MD5, little-endian, as a signed integer."""
    digest = F.md5(text.cast("binary"))
    return F.conv(F.concat(*[F.substring(digest, 2 * k - 1, 2) for k in range(8, 0, -1)]), 16, -10).cast("long")


def normal(text: Column) -> Column:
    """Paragraph form for comparison: lower case, single spaces, letters, digits and underscores only."""
    spaced = F.regexp_replace(F.lower(nfkc(text)), r"(?U)\s+", " ")
    return strip(F.regexp_replace(spaced, r"(?U)[^\w\s]", ""))


def nfkc(text: Column) -> Column:
    """Compatibility normalisation by the Unicode library that Spark's collations use; ASCII text goes as it is."""
    call = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True))
    return F.when(text.rlike(r"[^\x00-\x7F]"), call).otherwise(text)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits."""
    return F.bit_count(a.bitwiseXOR(b))


def clean_title(text: Column) -> Column:
    """A heading's text without emphasis marks and a final colon."""
    return strip(F.regexp_replace(F.regexp_replace(nfkc(text), r"^[\s*_]+|[\s*_]+$", ""), r":\s*$", ""))


def led(zones: str, first: str) -> str:
    """zones, which all begin with a character of the class ``first``: one look at it spares trying each kind of zone at each place."""
    return f"(?=[{first}])(?:{zones})"


def outside(text: Column, zones: str, edit: Callable[[Column], Column], first: str = "`$") -> Column:
    """text with edit applied to each part outside the zones, which stay as they are; first: the characters they begin with."""
    zones = led(zones, first)
    parts = F.split(text, zones, -1)
    kept = F.concat(F.regexp_extract_all(text, F.lit(zones), F.lit(0)), F.array(F.lit("")))
    return F.array_join(F.zip_with(parts, kept, lambda p, z: F.concat(edit(p), F.coalesce(z, F.lit("")))), "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, also where use names it inside of a lambda."""
    return F.get(F.transform(F.array(value), use), 0)


def bytes_text(size: Column) -> Column:
    """A size as B, KB, MB or GB."""
    out = F.format_string("%d B", size.cast("long"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        out = F.when(size >= 1024**power, F.format_string(f"%.1f {unit}", size / float(1024**power))).otherwise(out)
    return out


def seconds_text(seconds: Column) -> Column:
    """A duration in ms below a second, else in s."""
    return F.when(seconds < 1, F.format_string("%.0f ms", seconds * 1000)).otherwise(F.format_string("%.1f s", seconds * 1.0))


def suffix(name: Column) -> Column:
    """The extension of a file name, lower case, without its dot."""
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


def stem(name: Column) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(name, r"\.[^.]+$", "")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, for scratch columns beside columns of any name."""
    taken = {c.lower() for c in df.columns}
    name, n = f"__{stem}", 0
    while name.lower() in taken:
        n += 1
        name = f"__{stem}{n}"
    return name
