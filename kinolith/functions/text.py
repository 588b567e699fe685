"""Text functions as Columns; all stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed value: what counts as whitespace, in and beyond ASCII.
WS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"

#: Number words of captions.
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")


def clean(c: Column) -> Column:
    """Runs of whitespace become one space, the ends are stripped; null becomes the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), WS + "+", " "))


def tokens(c: Column) -> Column:
    """Words between whitespace, none of them empty; null has no words."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), WS + "+"), lambda t: t != "")


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def first_nonblank(*columns: Column) -> Column:
    """The first value with a character other than whitespace, null where there is none."""
    kept = [F.when(F.regexp_replace(c, WS, "") != "", c) for c in columns]
    return F.coalesce(*kept)


def grep(pattern: str, *columns: Column) -> Column:
    """Case-insensitive search in the columns joined by blanks; nulls are left out of the join."""
    return F.concat_ws(" ", *columns).rlike("(?i)" + pattern)


def classify(c: Column, words: dict[str, str], default: str) -> Column:
    """Class of the first word, in the given order, that the lower-cased text contains."""
    lowered, found = F.lower(c), F.lit(default)
    for word, name in reversed(list(words.items())):
        found = F.when(F.contains(lowered, F.lit(word)), F.lit(name)).otherwise(found)
    return found


def hash_bucket(c: Column, buckets: int = 10_000) -> Column:
    """Bucket of a text by 60 bits of its MD5 digest; the same everywhere and for ever."""
    return F.pmod(F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("bigint"), F.lit(buckets))


def split_of(name: Column, share: float) -> Column:
    """'val' for about ``share`` of all names, 'train' for the others; decided by the name alone."""
    return F.when(hash_bucket(name) < int(share * 10_000), "val").otherwise("train")


def body_key(c: Column, header: str = "H ") -> Column:
    """Digest of a text without its header lines."""
    return F.md5(F.array_join(F.filter(lines(c), lambda x: ~F.startswith(x, F.lit(header))), "\n"))


def take_while(c: Column, prefixes: str, header: str) -> Column:
    """From the first line that starts with ``header``: the lines that start with one of the letters
    ``prefixes``, blanks skipped, up to the first other line. Without a header the stripped text.
    """
    rows = lines(c)
    at = F.array_position(F.transform(rows, lambda x: F.startswith(x, F.lit(header))), F.lit(True))
    rest = F.filter(F.slice(rows, F.greatest(at, F.lit(1)).cast("int"), F.size(rows)), lambda x: F.regexp_replace(x, WS, "") != "")
    good = F.transform(rest, lambda x: F.substring(x, 1, 1).isin(*prefixes))
    bad = F.array_position(good, F.lit(False))
    kept = F.when(bad > 0, F.slice(rest, 1, (bad - 1).cast("int"))).otherwise(rest)
    return F.when(at > 0, F.array_join(kept, "\n")).otherwise(F.regexp_replace(c, f"^{WS}+|{WS}+$", ""))


def expected_count(c: Column, noun: str = "(?:figures|dancers|shapes|tailors|bakers|hikers|weavers)") -> Column:
    """Count that a caption announces: a number word or digits, then at most 40 characters, then a plural noun."""
    words = "|".join(NUMBER_WORDS)
    found = F.lower(F.regexp_extract(c, rf"(?i)\b({words}|\d+)\b[^.]{{0,40}}?\b{noun}\b", 1))
    value = F.array_position(F.array(*map(F.lit, NUMBER_WORDS)), found)
    return F.when(found == "", None).when(value > 0, value).otherwise(F.try_to_number(found, F.lit("999999999999")).cast("bigint"))


def number_atoms(c: Column) -> Column:
    """Atoms of a text: whole numbers as <NUM> with value / 100, everything else as it stands."""

    def atom(t: Column) -> Column:
        number = t.rlike(r"^-?\d{1,15}$")
        return F.struct(
            F.when(number, "<NUM>").otherwise(t).alias("tok"), F.when(number, F.try_divide(t.try_cast("double"), F.lit(100.0))).alias("val")
        )

    return F.transform(tokens(c), atom)


def atoms_text(atoms: Column) -> Column:
    """The text of number atoms, words joined by single blanks; the inverse of ``number_atoms``."""
    word = lambda a: F.when(a["tok"] == "<NUM>", F.rint(a["val"] * 100).cast("bigint").cast("string")).otherwise(a["tok"])
    return F.array_join(F.transform(atoms, word), " ")


def hex_of(r: Column, g: Column, b: Column) -> Column:
    """#RRGGBB of three whole numbers from 0 to 255."""
    return F.concat(F.lit("#"), *[F.lpad(F.hex(x), 2, "0") for x in (r, g, b)])


def rgb_of(c: Column) -> Column:
    """[r, g, b] of #RRGGBB or #RGB; null for other texts."""
    long = F.when(c.rlike("^#[0-9A-Fa-f]{3}$"), F.regexp_replace(c, "([0-9A-Fa-f])", "$1$1")).otherwise(c)
    parts = [F.conv(F.substring(long, i, 2), 16, 10).cast("int") for i in (2, 4, 6)]
    return F.when(long.rlike("^#[0-9A-Fa-f]{6}$"), F.array(*parts))


def prefix_before(c: Column, mark: str) -> Column:
    """The text before the first ``mark``; all of it where the mark is missing."""
    return F.when(F.contains(c, F.lit(mark)), F.substring_index(c, mark, 1)).otherwise(c)


def key_values(c: Column, keys: tuple[str, ...]) -> Column:
    """Map of the words key=value of a text; other keys are dropped, the last of a key wins."""
    pairs = F.filter(tokens(F.regexp_replace(c, ",", " ")), lambda t: F.contains(t, F.lit("=")))
    pairs = F.transform(pairs, lambda t: F.struct(F.substring_index(t, "=", 1).alias("k"), F.regexp_replace(t, "^[^=]*=", "").alias("v")))
    last = lambda key: F.try_element_at(F.filter(pairs, lambda p: p["k"] == key), F.lit(-1))["v"]
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*[last(k) for k in keys])), lambda k, v: v.isNotNull())
