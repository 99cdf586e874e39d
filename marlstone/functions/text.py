"""Text scalars as column expressions: folding, tokens, cleaning, URLs, slugs, fields.

All of them stay in the JVM. Folding is full: tables derived by rule from Unicode decompositions and case foldings of all scripts.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
#: Two signs or more: a lone one has no sign of the class after it, so it is skipped as a whole.
TOKEN = r"[a-z0-9][a-z0-9+#.-]+"
BODY_WORD = "[a-záéíóúñü]+"

#: Query parameters that never tell pages apart (besides those that begin with utm_).
TRACKING = ("trk", "trackingid", "ref", "refid")
#: Spellings of work models, as normalised keys.
WORK_MODELS = {
    "Remote": ("remote", "remoto", "remota", "100 remoto", "100 remote"),
    "Hybrid": ("hybrid", "hibrido", "hibrida"),
    "On-site": ("onsite", "on site", "presencial"),
}
#: What counts as true in a field.
TRUE_WORDS = ("true", "yes", "approved")


@functools.cache
def fold_table() -> dict[str, str]:
    """What each code point beyond ASCII folds to, where that differs from itself: compatibility decomposition, marks of a combining class dropped, then case folding.

    Hangul syllables are left out, being arithmetic. As marks are dropped, their order doesn't count, so a text folds sign by sign.
    """
    out = {}
    for cp in (*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x110000)):
        c = chr(cp)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).casefold()
        if plain != c:
            out[c] = plain
    return out


#: Signs of long foldings that are frequent in texts; they are replaced beforehand, so that such texts keep to the table of single signs.
FREQUENT = ("ß", "…", "™")


@functools.cache
def _single_signs() -> tuple[str, str]:
    """Signs that fold to one sign, with those, followed by signs that are dropped (translate drops what has no partner)."""
    table = fold_table()
    one = [c for c in table if len(table[c]) == 1]
    return "".join([*map(chr, range(65, 91)), *one, *(c for c in table if not table[c])]), "".join([*map(chr, range(97, 123)), *(table[c] for c in one)])


@functools.cache
def _long_signs() -> tuple[str, tuple[tuple[str, str], ...]]:
    """A class of the signs that fold to several, and for each place of the result the signs with their letter there; signs whose folding is over come last and are dropped."""
    table = {c: t for c, t in fold_table().items() if len(t) > 1 and c not in FREQUENT}
    spans: list[list[int]] = []
    for cp in sorted(map(ord, table)):
        if spans and spans[-1][1] == cp - 1:
            spans[-1][1] = cp
        else:
            spans.append([cp, cp])
    signs = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]"
    deep = sorted(table, key=lambda c: -len(table[c]))
    return signs, tuple(("".join(deep), "".join(table[c][i] for c in deep if len(table[c]) > i)) for i in range(len(table[deep[0]])))


LATIN = 0x180


@functools.cache
def _latin() -> tuple[str, str, str]:
    """For the first Latin blocks: a short class, quick to test, of all that is not for the small table, and the table of lower-case signs
    with their letters. Dashes and quotation marks that fold to themselves are let through; the last sign of the table is the dot that lowering leaves of a dotted capital i."""
    table = {c: t for c, t in fold_table().items() if ord(c) < LATIN and c != "ß"}
    odd = [c for c, t in table.items() if len(t) > 1]
    one = [c for c, t in table.items() if len(t) == 1]
    signs = "[" + "".join(odd) + rf"\x{{{LATIN:x}}}-\x{{200f}}\x{{2011}}\x{{2017}}\x{{2024}}-\x{{10ffff}}]"
    return signs, "".join(one) + "\u0307", "".join(table[c] for c in one)


# Of the Unicode standard: syllables are their first one plus (initial * 21 + vowel) * 28 + final.
SYLLABLES = r"[\x{ac00}-\x{d7a3}]"
INITIALS, VOWELS, FINALS = ("".join(map(chr, range(a, a + n))) for a, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))


def _fold_sign(x: Column) -> Column:
    """A sign folded."""
    signs, places = _long_signs()
    n = F.ascii(x) - 0xAC00
    at = lambda letters, i: F.substr(F.lit(letters), i.cast("int"), F.lit(1))
    final = n % 28
    syllable = F.concat(at(INITIALS, F.floor(n / 588) + 1), at(VOWELS, F.floor(n % 588 / 28) + 1), F.when(final > 0, at(FINALS, final)).otherwise(F.lit("")))
    long = F.concat(*[F.translate(x, src, dst) for src, dst in places])
    return F.when(x.rlike(SYLLABLES), syllable).when(x.rlike(signs), long).otherwise(F.translate(x, *_single_signs()))


def fold(c: Column) -> Column:
    """Case and accents folded: equal to NFKD without combining marks, case-folded, on all code points; null stays null.

    ASCII is only lowered; texts whose signs each fold to one sign or none go through one table; only others are cut into signs.
    """
    table, plain = fold_table(), c
    for sign in FREQUENT:
        plain = F.replace(plain, F.lit(sign), F.lit(table[sign]))
    cut = F.array_join(F.transform(F.split(plain, ""), _fold_sign), "")
    signs = "[" + _long_signs()[0][1:-1] + SYLLABLES[1:-1] + "]"
    other, src, dst = _latin()
    latin = F.replace(F.translate(F.lower(c), src, dst), F.lit("ß"), F.lit("ss"))
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).when(~c.rlike(other), latin).when(plain.rlike(signs), cut).otherwise(F.translate(plain, *_single_signs()))


def squeeze(c: Column) -> Column:
    """Runs of white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def search_text(c: Column) -> Column:
    """Folded and squeezed, for containment tests; null counts as empty."""
    return squeeze(fold(F.coalesce(c, F.lit(""))))


def tokens(c: Column) -> Column:
    """Search tokens of two signs or more; null gives none."""
    return F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def body_words(c: Column) -> Column:
    """Lower-case words over the letters of English and Spanish, accents kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(BODY_WORD), F.lit(0))


def strip(c: Column) -> Column:
    """White space of any kind cut at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def clean_string(c: Column) -> Column:
    """As text, trimmed; blank counts as null."""
    return F.nullif(strip(c.cast("string")), F.lit(""))


def distinct_by_case(items: Column) -> Column:
    """Items in order, each once whatever its case; the first spelling stays. Sorted by key and place, so a long list takes n log n."""
    keyed = F.array_sort(F.transform(items, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x"))))
    # The sorted list is bound once, as the element of an array of one.
    first = F.transform(F.array(keyed), lambda s: F.filter(s, lambda x, i: (i == 0) | ~F.get(s, i - 1)["k"].eqNullSafe(x["k"])))
    return F.transform(F.array_sort(F.transform(F.get(first, 0), lambda x: F.struct(x["i"], x["x"]))), lambda x: x["x"])


def clean_list(items: Column) -> Column:
    """Items trimmed, blanks and nulls dropped, case-insensitively distinct; null gives an empty list."""
    cleaned = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), clean_string), lambda x: x.isNotNull())
    return distinct_by_case(cleaned)


def norm_key(c: Column) -> Column:
    """Folded, runs of other signs than a-z and 0-9 as one space, trimmed; null counts as empty."""
    return F.trim(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def canonical_url(c: Column) -> Column:
    """First http(s) URL in the text, scheme and host in lower case, without tracking parameters, fragment and
    closing slashes of the path (an empty path is a slash); null if there is none."""
    raw = F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"https?://[^\s)\]]+", 0), F.lit(""))
    part = lambda i: F.regexp_extract(raw, r"^(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$", i)
    path = F.regexp_replace(part(3), "/+$", "")
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(F.split(part(4), "&"), lambda p: (F.length(p) > 0) & ~name(p).startswith("utm_") & ~name(p).isin(*TRACKING))
    again = lambda s: F.url_encode(F.try_url_decode(s))
    pair = lambda p: F.concat(again(F.substring_index(p, "=", 1)), F.lit("="), again(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise(F.lit(""))))
    query = F.array_join(F.transform(kept, pair), "&")
    return F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def work_model(c: Column) -> Column:
    """Remote, Hybrid or On-site where the key says so, else the cleaned text."""
    text = clean_string(c)
    out = text
    for name, keys in WORK_MODELS.items():
        out = F.when(norm_key(text).isin(*keys), name).otherwise(out)
    return out


def posted_date(c: Column) -> Column:
    """``struct(iso, raw)``: iso only where the text has that shape."""
    raw = clean_string(c)
    return F.struct(F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), raw).alias("iso"), raw.alias("raw"))


def slug(c: Column) -> Column:
    """Lower case, runs of other signs than a-z and 0-9 as a hyphen; ``section`` if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("section"))


def fields(content: Column) -> Column:
    """Map of ``- **Key:** value`` lines, keys in lower case, back-quotes cut off values, the last of a key wins."""
    pattern = r"^- \*\*([^*]+):\*\*\s*(.*)$"
    lines = F.filter(F.transform(F.split(F.coalesce(content, F.lit("")), r"\r\n|[\r\n]"), strip), lambda s: s.rlike(pattern))
    key = lambda s: F.lower(strip(F.regexp_extract(s, pattern, 1)))
    keys = F.transform(lines, key)
    last = F.filter(lines, lambda s, i: ~F.array_contains(F.transform(F.slice(lines, i + 2, F.size(lines)), key), key(s)))
    return F.map_from_arrays(F.filter(keys, lambda k, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), k)), F.transform(last, lambda s: F.regexp_replace(strip(F.regexp_extract(s, pattern, 2)), "^`+|`+$", "")))


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)).isin(*TRUE_WORDS), F.lit(False))


def plain_number(c: Column) -> Column:
    """A number at six significant digits without closing zeros, as %g has it between 1e-4 and 1e6."""
    digits = F.greatest(F.lit(0), F.lit(5) - F.floor(F.log10(F.greatest(F.abs(c), F.lit(1e-4)))).cast("int"))
    text = F.format_string("%.6f", F.round(c * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits))
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def posix_join(folder: Column, relative: Column) -> Column:
    """Path of ``relative`` seen from ``folder``, with . and .. resolved as far as the path goes."""
    parts = F.split(F.when(relative.startswith("/"), relative).otherwise(F.concat_ws("/", F.nullif(folder, F.lit("")), relative)), "/")
    empty = F.array().cast("array<string>")

    def step(path: Column, part: Column) -> Column:
        up = (F.size(path) > 0) & (F.element_at(path, -1) != "..")
        return (
            F.when(part.isin("", "."), path).when((part == "..") & up, F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))).otherwise(F.concat(path, F.array(part)))
        )

    return F.array_join(F.aggregate(parts, empty, step), "/")


def numbers(c: Column) -> Column:
    """Numbers in the text, a decimal comma as a point."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(".")))
