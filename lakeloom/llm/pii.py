"""Surrogates for personal data, with DataFrame functions only.

Entities are found by one pattern: e-mail and network addresses, phone, card, account and social-security
numbers, secrets, and names of persons (after a title, or a listed given name with a surname). Each gets the
surrogate that a keyed permutation of its format gives: letters become letters of the same script and case, vowels
vowels, digits digits, everything else stays. A phone's country code, a card's first digit, an account's country,
a key's prefix and an address's top-level domain stay; check sums hold or fail as before. A listed given name
becomes another of its gender and script.

The permutation is a Feistel network over an entity's symbols, each in the radix of its class, conjugated with a
step that no value survives: so two entities of a kind never share a surrogate and none is its own, however full a
format is, and no table of entities is needed. Each surrogate is checked against collision where it is made: the
inverse permutation must give the entity back. Mentions that differ only in case or separators are one entity and
share a surrogate wherever they stand. All of it is one pass over the rows without a shuffle.

Null text stays null, empty text empty; rows of equal ids or texts are kept each. Characters of scripts that aren't
listed stay. Numbers in the form of a card that fail the check sum, ISBNs and digests named as such stay. Bare names
are found only in a text that has them in full; given names only from the list.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

# Given names by gender and script, and titles.
GIVEN = {
    ("f", "latin"): "Maria Anna Julia Laura Sophie Emma Claire Camille Elena Lucia Carmen Isabel Ingrid Ursula Heike Petra Monika Susan Linda Patricia Jennifer Elizabeth Margaret Deborah Rebecca Catherine Chloe Juliette Manon Greta Fatima Aisha Layla Zeynep Priya".split(),
    ("m", "latin"): "John James Robert Michael William David Richard Thomas Charles Daniel Matthew Anthony Andrew Joshua Kevin Pierre Jean Antoine Luc Hans Klaus Jürgen Wolfgang Stefan Carlos Miguel Javier Pablo Diego Lars Ahmed Mohammed Omar Hassan Ibrahim Mehmet Rajesh".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Юлия Екатерина Галина Людмила".split(),
    ("m", "cyrillic"): "Иван Алексей Дмитрий Сергей Андрей Михаил Николай Владимир Павел Олег Юрий Борис".split(),
    ("f", "arabic"): "فاطمة عائشة مريم زينب ليلى نور".split(),
    ("m", "arabic"): "محمد أحمد علي حسن حسين عمر خالد يوسف".split(),
}
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mademoiselle Señor Señora Señorita".split()
#: Characters that become one another: within each line, upper case is as distinct as lower case.
ALPHABETS = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "áàâäãåéèêëíìîïóòôöõúùûü", "ñçšžčćłđ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "αεηιουω", "βγδζθκλμνξπρστφχψ")
HEX = ("0123456789", "abcdef")
#: Letters of scripts without case, as ranges: Hebrew, Arabic, Devanagari, Thai, Georgian, Hiragana, Katakana, Han, Hangul.
RANGES = ((0x5D0, 0x5EA), (0x621, 0x63A), (0x641, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
#: International calling codes of one and two digits; all others have three.
CALLING = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3}"

_GIVEN = "|".join(n for names in GIVEN.values() for n in names)
_TITLE = "|".join(TITLES)
_NAME = r"(?:\p{Lu}\p{Ll}+|\p{IsArabic}{2,})(?:-\p{Lu}\p{Ll}+)?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: In order: of patterns that match at the same place, the first holds.
PATTERNS = {
    "email": r"(?<![\p{L}\d])[\p{L}\d][\p{L}\d._%+\-]*@[\p{L}\d](?:[\p{L}\d\-]*[\p{L}\d])?(?:\.[\p{L}\d](?:[\p{L}\d\-]*[\p{L}\d])?)*\.\p{L}{2,}",
    "secret": r"(?<![\p{L}\d_])(?:sk|pk|rk|ghp|gho|xox[abp])[-_][A-Za-z0-9_\-]{16,}|(?<![\p{L}\d_])AKIA[A-Z0-9]{16}(?![\p{L}\d])|(?<![\p{L}\d_\-])(?<!(?i:commit|revision|changeset|sha1|sha256|md5|checksum|digest|etag)[ :=#(\"']{1,3})(?=[A-Za-z_\-]*\d)(?=[\d_\-]*[A-Za-z])[A-Za-z0-9_\-]{28,}(?![\p{L}\d_\-])",
    "iban": r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[A-Z\d]{4}){2,7}(?: ?[A-Z\d]{1,3})?(?![\p{L}\d])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\d]|\.\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<!\d)(?<!(?i:isbn|order|invoice|ticket)(?: (?:no|nr|number))?[ :#.]{1,3})(?!97[89](?:[ \-]?\d){10}(?![ \-]?\d))\d(?:[ \-]?\d){12,18}(?!\d)",
    "phone": r"(?<![\d(])\+\d{1,3}[ .\-]?(?:\(\d{1,5}\)[ .\-]?)?\d{1,4}(?:[ .\-]?\d{2,4}){1,4}(?!\d)|(?<!\d)\(\d{2,5}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)|(?<![\d.\-])\d{3}[.\-]\d{3,4}[.\-]\d{4}(?![\d.\-])|(?<![\d.\-])0\d{1,4}[ /\-]\d{3,4}[ \-]?\d{3,5}(?![\d.\-])",
    "titled": rf"(?=[\p{{Lu}}\p{{IsArabic}}])(?<=(?<![\p{{L}}\d])(?:{_TITLE})\.? ){_NAME}(?: {_NAME})?",
    "named": rf"(?<![\p{{L}}\d])(?:{_GIVEN})(?:-(?:{_GIVEN}))? {_NAME}",
}
#: Every entity begins a word, or is a number.
PATTERN = r"(?:(?<![\p{L}\d])|(?=[\d+(]))(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
#: A cheap test that every text with an entity passes: all but names and keys of a known prefix hold a digit, an at sign or a plus.
_FIRST = "".join(sorted({n[0] for names in GIVEN.values() for n in names} | {t[0] for t in TITLES}))
GATE = r"[0-9@+]|(?=[sprgxA])(?:(?:sk|pk|rk|ghp|gho|xox[abp])[-_]|AKIA)"
NAME_GATE = rf"(?<![\p{{L}}\d])(?=[{_FIRST}])(?:(?:{_TITLE})\.? [\p{{Lu}}\p{{IsArabic}}]|(?:{_GIVEN})(?![\p{{L}}\d]))"


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _chars(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0))


def _low(x: Column) -> Column:
    """Lower case, character by character."""
    return F.translate(F.lower(F.translate(x, "İ", "I")), "ς", "σ")


# ---- the permutation


def _symbol(c: Column, alphabets: tuple[str, ...]) -> Column:
    """A character's value v in its class of n, and its class a; n is 1 where it stays."""
    made = lambda v, n, a: F.struct(v.cast("long").alias("v"), F.lit(n).cast("long").alias("n"), a.alias("a"))
    out = made(F.lit(0), 1, c)
    code = F.ascii(c)
    if alphabets is ALPHABETS:
        for a, b in RANGES:
            out = F.when(code.between(a, b), made(code - a, b - a + 1, F.lit(f"#{a}"))).otherwise(out)
    for letters in reversed(alphabets):
        out = F.when(F.instr(F.lit(letters), c) > 0, made(F.instr(F.lit(letters), c) - 1, len(letters), F.lit(letters))).otherwise(out)
    return out


def _character(v: Column, a: Column) -> Column:
    code = F.substring(a, 2, 8).cast("long") + v
    return F.when((F.length(a) > 1) & a.startswith("#"), F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")).otherwise(F.substring(a, v.cast("int") + 1, F.lit(1)))


def _steps(shift: int) -> Column:
    """Three rounds, a shift of every symbol, and the rounds undone: (round, sign), the shift as round -1."""
    order = [(0, 1), (1, 1), (2, 1), (-1, shift), (2, -1), (1, -1), (0, -1)]
    return F.array(*(F.struct(F.lit(r).alias("r"), F.lit(s).alias("s")) for r, s in order))


def _permuted(state: Column, key: str, tweak: Column, shift: int = 1) -> Column:
    """Symbols (v, n) under the keyed permutation of their radices; shift -1 is its inverse.

    A round adds to the symbols at places of one parity numbers drawn from a keyed digest of those of the other.
    """
    whole = lambda v, n: F.struct(v.cast("long").alias("v"), n.cast("long").alias("n"))

    def step(s: Column, x: Column) -> Column:
        seen = F.array_join(F.transform(s, lambda e, i: F.concat(e.n.cast("string"), F.when(F.pmod(i + x.r, F.lit(2)) == 1, F.concat(F.lit(":"), e.v.cast("string"))).otherwise(""))), ",")
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, x.r.cast("string"), seen), 256)
        moved = lambda d: F.transform(s, lambda e, i: whole(F.when(F.pmod(i + x.r, F.lit(2)) == 0, F.pmod(e.v + x.s * F.pmod(F.xxhash64(d, i), F.lit(1 << 40)), e.n)).otherwise(e.v), e.n))
        return F.when(x.r < 0, F.transform(s, lambda e: whole(F.pmod(e.v + x.s, e.n), e.n))).otherwise(_let(digest, moved))

    return F.aggregate(_steps(shift), state, step)


def _checked(state: Column, key: str, tweak: Column) -> Column:
    """The permuted symbols; an error where the inverse doesn't lead back, as then another entity could come here."""
    collides = F.raise_error(F.lit("two entities share a surrogate")).cast("array<struct<v:bigint,n:bigint>>")
    return _let(state, lambda s: _let(_permuted(s, key, tweak), lambda out: F.when(_permuted(out, key, tweak, -1) == s, out).otherwise(collides)))


def _mapped(low: Column, key: str, tweak: Column, fixed: Column | int = 0, tail: int = 0, alphabets: tuple[str, ...] = ALPHABETS) -> Column:
    """A lower-case string with its characters permuted, all but the first `fixed` and last `tail` ones."""
    size = F.length(low)
    symbols = F.transform(_chars(low), lambda c, i: F.when((i < fixed) | (i >= size - tail), F.struct(F.lit(0).cast("long").alias("v"), F.lit(1).cast("long").alias("n"), c.alias("a"))).otherwise(_symbol(c, alphabets)))

    def put(all_: Column) -> Column:
        free = F.transform(F.filter(all_, lambda e: e.n > 1), lambda e: F.struct(e.v.alias("v"), e.n.alias("n")))

        def walk(new: Column) -> Column:
            state = F.struct(F.lit(0).alias("i"), F.lit("").alias("s"))
            step = lambda w, e: F.struct((w.i + (e.n > 1).cast("int")).alias("i"), F.concat(w.s, F.when(e.n > 1, _character(F.get(new, w.i).v, e.a)).otherwise(e.a)).alias("s"))
            return F.aggregate(all_, state, step, lambda w: w.s)

        return _let(_checked(free, key, tweak), walk)

    return _let(symbols, put)


# ---- kinds


def _kind(x: Column) -> Column:
    out = F.lit("named")
    for kind, p in reversed([(k, p) for k, p in PATTERNS.items() if k not in ("titled", "named")]):
        # look-around at the edges holds within the text; here the whole entity is at hand
        out = F.when(x.rlike(f"^(?:{p})$"), kind).otherwise(out)
    return out


def _luhn(x: Column) -> Column:
    """The check sum of a number's digits: doubling every second one from the right, 0 where it holds."""
    digits = F.reverse(_chars(F.regexp_replace(x, r"\D", "")))
    worth = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.pmod(F.aggregate(worth, F.lit(0), lambda s, d: s + d), F.lit(10))


def _card(low: Column, key: str) -> Column:
    """The last digit gives the same check sum as before."""
    new = _mapped(low, key, F.lit("card"), 1, 1)
    return _let(new, lambda x: _let(F.concat(F.left(x, F.length(x) - 1), F.lit("0")), lambda head: F.concat(F.left(x, F.length(x) - 1), F.pmod(_luhn(low) - _luhn(head), F.lit(10)).cast("string"))))


def _account(low: Column, key: str) -> Column:
    """Country and validity stay: the one valid pair of check digits becomes the other's, the rest keep their rank among invalid ones."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 87)
    rest = lambda x: F.aggregate(_chars(F.concat(F.regexp_replace(F.substring(x, 5, 99), "[^a-z0-9]", ""), F.left(x, F.lit(2)), F.lit("00"))), F.lit(0), lambda m, c: F.pmod(m * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97)))
    new = _mapped(low, key, F.left(low, F.lit(2)), 4)

    def digits(right: Column, x: Column) -> Column:
        mine, given = 98 - rest(x), F.substring(low, 3, 2).cast("int")
        rank = given - (given > right).cast("int")
        return F.lpad(F.when(given == right, mine).otherwise(rank + (rank >= mine).cast("int")).cast("string"), 2, "0")

    return _let(new, lambda x: F.concat(F.left(x, F.lit(2)), _let(98 - rest(low), lambda right: digits(right, x)), F.substring(x, 5, 99)))


def _network(low: Column, key: str) -> Column:
    """Octets keep their number of digits and their range."""
    sizes = lambda o: F.when(F.length(o) == 1, F.lit(10)).when(F.length(o) == 2, F.lit(90)).otherwise(F.lit(156)).cast("long")
    bases = lambda n: F.when(n == 10, F.lit(0)).when(n == 90, F.lit(10)).otherwise(F.lit(100)).cast("long")
    state = F.transform(F.split(low, r"\."), lambda o: F.struct((o.cast("long") - bases(sizes(o))).alias("v"), sizes(o).alias("n")))
    return F.array_join(F.transform(_checked(state, key, F.lit("ip")), lambda e: (e.v + bases(e.n)).cast("string")), ".")


def _mail(low: Column, key: str) -> Column:
    """The domain by itself, so that it stays one; the local part within it; the top-level domain as it is."""
    local, domain = F.substring_index(low, "@", 1), F.substring_index(low, "@", -1)
    top = F.length(F.substring_index(domain, ".", -1)) + 1
    host = F.left(domain, F.length(domain) - top)
    return F.concat(_mapped(local, key, domain), F.lit("@"), _mapped(host, key, F.lit("domain")), F.right(domain, top))


def _given(key: str) -> Column:
    """Each listed name and the next of its gender and script, in a keyed order."""
    pairs = []
    for (gender, script), names in GIVEN.items():
        order = sorted(names, key=lambda n: hmac.new(key.encode(), f"{gender}|{script}|{n}".encode(), hashlib.sha256).digest())
        pairs += zip(order, [*order[1:], order[0]], strict=True)
    return F.create_map(*(F.lit(x) for pair in pairs for x in pair))


def _dressed(new: Column, mention: Column) -> Column:
    """A lower-case surrogate in a mention's case."""
    return F.array_join(F.zip_with(_chars(new), _chars(mention), lambda n, c: F.when(c.rlike(r"\p{Lu}"), F.upper(n)).otherwise(n)), "")


def surrogate(mention: Column, key: str) -> Column:
    """The surrogate of one mention; a number of a card's form that isn't one stays."""

    def of(kind: Column) -> Column:
        low = _low(mention)
        lead = lambda pattern: F.length(F.regexp_extract(low, pattern, 0))
        part = lambda w: F.coalesce(F.try_element_at(_given(key), w), _dressed(_mapped(_low(w), key, F.lit("name")), w))
        name = F.array_join(F.transform(F.regexp_extract_all(mention, F.lit(r"[ \-]|[^ \-]+"), F.lit(0)), part), "")
        known = r"^(?:(?:sk|pk|rk|ghp|gho|xox[abp])[-_]|akia)"
        tail = F.regexp_replace(low, known, "")
        secret = F.when(tail.rlike("^[0-9a-f]+$"), _mapped(low, key, F.lit("secret"), lead(known), alphabets=HEX)).otherwise(_mapped(low, key, F.lit("secret"), lead(known)))
        new = (
            F.when(kind == "email", _mail(low, key))
            .when(kind == "ip", _network(low, key))
            .when(kind == "card", F.when(_luhn(low) == 0, _card(low, key)).otherwise(low))
            .when(kind == "iban", _account(low, key))
            .when(kind == "phone", _mapped(low, key, F.lit("phone"), lead(rf"^(?:\+(?:{CALLING})|\(?0)")))
            .when(kind == "secret", secret)
            .otherwise(_mapped(low, key, kind))
        )
        return F.when(kind == "named", name).otherwise(_dressed(new, mention))

    return _let(_kind(mention), of)


# ---- texts


def mentions(text: Column) -> Column:
    """(found, gaps): the entities of a text in order, and what stands between them.

    A text's names are looked for again by their words, so that later short mentions are found too.
    """

    def parts(pattern: Column) -> Column:
        return F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"), F.split(text, pattern, F.lit(-1)).alias("gaps"))

    def again(found: Column) -> Column:
        names = F.filter(found, lambda x: x.rlike(rf"^{_NAME}(?:[ \-]{_NAME})*$"))
        words = F.array_distinct(F.filter(F.flatten(F.transform(names, lambda x: F.split(x, r"[ \-]"))), lambda w: F.length(w) > 1))
        pattern = F.when(F.size(words) > 0, F.concat(F.lit(PATTERN + r"|(?<![\p{L}\d])(?:"), F.array_join(words, "|"), F.lit(r")(?![\p{L}\d])"))).otherwise(F.lit(PATTERN))
        return F.when(F.size(names) > 0, _let(pattern, parts)).otherwise(F.struct(found.alias("found"), F.split(text, PATTERN, -1).alias("gaps")))

    return _let(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), again)


def entities(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(kind, mention, surrogate) of each distinct mention, to audit a corpus and key."""
    t = F.col(text)
    found = docs.filter(t.rlike(GATE) | t.rlike(NAME_GATE)).select(F.explode(mentions(t).found).alias("mention")).distinct()
    return found.select(_kind(F.col("mention")).alias("kind"), "mention", surrogate(F.col("mention"), key).alias("surrogate"))


def replace_pii(docs: DataFrame, key: str, text: str = "text", keep_count: str | None = None) -> DataFrame:
    """The rows of docs with surrogates in their texts; keep_count: also a column, new in docs, with the number of replacements.

    key: secret, from the caller's configuration; the same key gives the same surrogates. All other columns stay as
    they are, whatever their names.
    """
    if not key:
        raise ValueError("surrogates need a key")
    kept = docs.columns
    (made,) = unused(kept, "_made")
    t = F.col(text)
    same = F.struct(t.alias("text"), F.lit(0).alias("n"))

    def put(m: Column) -> Column:
        new = F.transform(m.found, lambda x: surrogate(x, key))
        whole = lambda ys: F.struct(F.concat(F.get(m.gaps, F.lit(0)), F.array_join(F.zip_with(ys, F.slice(m.gaps, F.lit(2), F.size(m.gaps)), lambda y, g: F.concat(y, g)), "")).alias("text"), F.size(F.filter(F.arrays_zip(m.found.alias("x"), ys.alias("y")), lambda p: p.x != p.y)).alias("n"))
        return F.when(F.size(m.found) == 0, same).otherwise(_let(new, whole))

    gated = F.coalesce(t.rlike(GATE) | t.rlike(NAME_GATE), F.lit(False))
    out = docs.withColumn(made, F.when(gated, _let(mentions(t), put)).otherwise(same))
    extra = [F.col(made).n.alias(keep_count)] if keep_count else []
    return out.select(*(F.col(made).text.alias(text) if c == text else F.col(c) for c in kept), *extra)
