"""Text columns: tokens, trimming, excerpts and labels, all as built-in expressions."""

from __future__ import annotations

import unicodedata

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# The combining marks that the full-text tokenizer removes, as code points.
MARKS = "".join(map(chr, [0x300, 0x301, 0x302, 0x303, 0x304, 0x306, 0x307, 0x308, 0x309, 0x30A, 0x30B, 0x30C, 0x30F, 0x311, 0x31B, 0x323, 0x324, 0x325, 0x326, 0x327, 0x328, 0x32D, 0x32E, 0x330, 0x331]))
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def folded(c: str) -> str:
    """A character without case, and an ASCII letter with one of MARKS without it; letters of several marks keep them."""
    low = c.casefold() if len(c.casefold()) == 1 else c.lower()[0]
    parts = unicodedata.normalize("NFD", low)
    return parts[0] if len(parts) == 2 and parts[0].isascii() and parts[1] in MARKS else low


#: What lower case leaves to be folded, over the basic plane, by the rule above.
_FROM = "".join(c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)]) if c.lower() == c and c not in MARKS and folded(c) != c)
_TO = "".join(map(folded, _FROM))
_TABLE = str.maketrans(_FROM, _TO, MARKS)
_WORD = regex.compile(TOKEN)
_SPAN = regex.compile(r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}{MARKS}]*".replace("{MARKS}", MARKS))
#: White space as Unicode has it, which trim() and \s leave out in part.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u0085]"


def fold(text: Column) -> Column:
    """Text without case and diacritics; what is ASCII needs no table."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(F.lower(text), _FROM + MARKS, _TO))


def fold_text(text: str) -> str:
    """fold() of one string."""
    return text.lower() if text.isascii() else text.lower().translate(_TABLE)


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits, in order."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def words(text: str) -> list[str]:
    """tokens() of one string."""
    return _WORD.findall(fold_text(text))


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, token) of each token, by places of the text as it is: marks after a letter belong to its token."""
    return [(m.start(), m.end(), t) for m in _SPAN.finditer(text) if (t := "".join(words(m.group())))]


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def trim_end(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"[^\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u0085]")


def collapse(text: Column) -> Column:
    """Each run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def crop(text: Column, whole: int = 2000, head: int = 1000, tail: int = 500) -> Column:
    """Up to `whole` characters as they are; else the head, the number of characters cut, and the tail."""
    t = collapse(text)
    cut = (F.length(t) - head - tail).cast("string")
    return F.when(F.length(t) <= whole, t).otherwise(F.concat(F.left(t, F.lit(head)), F.lit(" …["), cut, F.lit(" chars cut]… "), F.right(t, F.lit(tail))))


def excerpt(text: Column, size: int = 140) -> Column:
    t = collapse(text)
    return F.when(F.length(t) <= size, t).otherwise(F.concat(F.lit("…"), F.left(t, F.lit(size)), F.lit("…")))


def truncated(text: Column, size: int) -> Column:
    t = trim(text)
    return F.when(F.length(t) <= size, t).otherwise(F.concat(F.left(t, F.lit(size)), F.lit("…")))


def short_id(session_id: Column) -> Column:
    return F.left(session_id, F.lit(8))


def title_or(title: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) == "", "(untitled)").otherwise(title)


def shell_quoted(text: Column) -> Column:
    quoted = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    return F.when((text == "") | text.rlike(r"""[\s'"\\$`]"""), quoted).otherwise(text)


def basename(path: Column) -> Column:
    """The last part of a path; null where it is the root, empty or '..'."""
    last = F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]+)$", 1)
    return F.when(last.isin("", "..", "."), F.lit(None)).otherwise(last)


def has_id_prefix(session_id: Column, prefix: str) -> Column:
    """ASCII case doesn't count, and no character of the prefix is a wildcard."""
    low = prefix.translate({c: c + 32 for c in range(65, 91)})
    folded = F.translate(session_id, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return folded.startswith(low)
