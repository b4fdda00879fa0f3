"""Surrogates for private data, in DataFrame operations.

Entities are found by one pattern: e-mail and IP addresses, phone, card, account and social security numbers, keys,
tokens and passwords, and names after a title. Each gets a surrogate that depends on a secret key, its type and its
canonical form only, so the same entity has the same surrogate everywhere, and that keeps the format: digits stay
digits, letters stay letters of the same script and case, cards and account numbers keep valid check digits, addresses
stay addresses. Names are replaced word by word, given names by gender and family names by themselves, so Mr. John
Smith and Mr. Smith still share a family name, and so does a bare Smith in a text that names one after a title.
Where two entities would share a surrogate, or a surrogate is itself an entity of the corpus, a further attempt is made
until none does; attempts make short or rare formats longer, so there are always enough surrogates.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import Workspace, fenced, input_partitions, skew_join, unique_name

#: Attempts at most; each of those beyond WIDEN adds a digit or more, so they never run out in practice.
MAX_ATTEMPTS = 48
#: Attempts within the format of numbers, addresses and keys.
WIDEN = 8
#: Letters of a bare family name at least, which are sought in texts that have it after a title.
BARE_LETTERS = 3

_TITLES_F = ["Mrs.", "Mrs", "Ms.", "Ms", "Frau", "Mme", "Madame", "Señora", "Sra.", "госпожа"]
_TITLES_M = ["Mr.", "Mr", "Herr", "Monsieur", "Señor", "Sr.", "господин"]
_TITLES_N = ["Dr.", "Prof."]
_LATIN_F = ["Anna", "Clara", "Elena", "Julia", "Laura", "Maria", "Nora", "Sofia", "Vera", "Alice", "Emma", "Ida", "Lena", "Olga", "Rosa", "Sara"]
_LATIN_M = ["Adam", "David", "Erik", "Jonas", "Lukas", "Martin", "Oscar", "Peter", "Simon", "Thomas", "Anton", "Felix", "Hugo", "Karl", "Leo", "Paul"]
_CYRILLIC_F = ["Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "София"]
_CYRILLIC_M = ["Антон", "Борис", "Виктор", "Иван", "Максим", "Олег", "Павел", "Сергей"]
_LATIN_END = ["bach", "berg", "dale", "field", "ford", "horst", "land", "mann", "mont", "stein", "strom", "vale", "well", "wick", "wood", "worth"]
_CYRILLIC_END_M = ["анов", "арин", "енко", "еров", "илин", "оров", "унин", "юков"]
_LATIN_N = ["Alex", "Robin", "Kim", "Sasha", "Toni", "Charlie", "Jean", "Luca"]
_CYRILLIC_N = ["Саша", "Женя", "Валя", "Шура"]
_LATIN_MORE = ["an", "bel", "cor", "din", "el", "fin", "gar", "hal", "in", "kel", "lor", "min", "nel", "or", "ran", "tal"]
_CYRILLIC_MORE = ["ан", "бел", "вар", "гор", "дин", "ел", "зар", "ин", "кор", "лен", "мир", "ник", "ор", "рин", "сан", "тар"]
#: Scripts whose letters are exchanged among themselves: class, first letter and how many follow each other.
_SCRIPTS = [
    ("[а-џ]", "а", 32), ("[Ѐ-Я]", "А", 32), ("[ά-ώ]", "α", 17), ("[Ά-Ϋ]", "Α", 17), ("[ա-ֆ]", "ա", 38), ("[Ա-Ֆ]", "Ա", 38), ("[ა-ჰ]", "ა", 33), ("[א-ת]", "א", 27), ("[ء-غف-ي]", "ف", 10),
    ("[अ-ह]", "क", 37), ("[ก-ฮ]", "ก", 46), ("[ぁ-ん]", "ぁ", 83), ("[ァ-ン]", "ァ", 83), ("[가-힣]", "가", 11172), ("[一-龥]", "一", 20902)]
_CYRILLIC_END_F = ["анова", "арина", "енко", "ерова", "илина", "орова", "унина", "юкова"]

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_NAME = r"\p{Lu}[\p{L}'’-]+"
_TITLED = "(?:" + "|".join(t.replace(".", r"\.") for t in _TITLES_F + _TITLES_M + _TITLES_N) + ")"
#: Each kind and its pattern, in order of precedence. No pattern has a group.
KINDS = [
    ("email", r"(?<![\w.+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,}"),
    ("secret", r"(?<=[Pp]assword=|[Pp]asswd=|[Ss]ecret=|[Aa]pi_key=)[^\s\"']{6,}|(?<=token = \"|token=\"|secret = \"|api_key = \")[^\s\"]{8,}(?=\")"),
    ("key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ip", rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.\d)"),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("card", r"(?<![\w-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-])"),
    ("name", rf"(?<=(?<!\p{{L}}){_TITLED} ){_NAME}(?: {_NAME}){{0,2}}"),
]
#: Every occurrence of any kind.
PATTERN = "|".join(f"(?:{p})" for _, p in KINDS)
#: Stands around entities while a text is split; texts that hold it themselves are split in another way.
MARK = "\uFDD0"
#: No text without one of these has an entity; it spares most texts the pattern.
HINT = r"\d{3}|\d\.\d|\+\d|[A-Z]{2}\d{2}|@|AKIA|ASIA|[Pp]assw|[Ss]ecret|token|[Aa]pi_key|" + _TITLED + r" \p{Lu}"


def kind(entity: Column) -> Column:
    """The first kind whose shape the entity has. What has no shape of its own is a secret."""
    whole = [
        ("email", r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"), ("key", r"^(?:AKIA|ASIA)[A-Z0-9]{16}$"), ("iban", r"^[A-Z]{2}\d{2}[A-Z0-9 ]{12,}$"),
        ("ip", rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), ("ssn", r"^\d{3}-\d{2}-\d{4}$"), ("phone", r"^(?:\+\d|\(\d{3}\) ?\d{3}[ .-]|\d{3}[.-]\d{3}[.-]\d{4}$)"),
        ("card", r"^\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}$"),
    ]
    named = F.when(entity.rlike(rf"^{_NAME}(?: {_NAME}){{0,2}}$"), "name").otherwise("secret")
    return reduce(lambda rest, x: F.when(entity.rlike(x[1]), x[0]).otherwise(rest), reversed(whole), named)


def canonical(entity: Column, of: Column) -> Column:
    """What tells an entity from others of its kind: spelling of e-mail case and of separators does not."""
    return (F.when(of == "email", F.lower(entity)).when(of.isin("phone", "card", "iban", "ssn"), F.regexp_replace(entity, r"[^0-9A-Za-z+]", "")).otherwise(entity))


def units(x: Column) -> Column:
    """What an entity (e, g: gender of the title before it) is replaced by: each word of a name, given names by gender;
    any other entity whole. (k: kind, e: spelling, c: canonical form) each."""
    one = lambda k, e, c: F.struct(k.alias("k"), e.alias("e"), c.alias("c"))
    words = F.split(x["e"], " ")
    named = F.transform(words, lambda w, i: one(F.when(i == F.size(words) - 1, F.lit("family")).otherwise(F.concat(F.lit("given "), x["g"])), w, w))
    return F.when(x["k"] == "name", named).otherwise(F.array(one(x["k"], x["e"], canonical(x["e"], x["k"]))))


def _stream(of: Column, canon: Column, attempt: Column, key: str) -> Column:
    """128 hexadecimal digits that only the holder of the key can tell: HMAC with SHA-512."""
    if not key:
        raise ValueError("surrogates need a secret key")
    block = hashlib.sha512(key.encode()).digest() if len(key.encode()) > 128 else key.encode()
    inner, outer = (bytes(b ^ pad for b in block.ljust(128, b"\0")) for pad in (0x36, 0x5C))
    message = F.encode(F.concat_ws("|", of, attempt.cast("string"), canon), "UTF-8")
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message), 512))), 512)


def _byte(stream: Column, i: Column | int) -> Column:
    """The i-th of the stream's 64 bytes, round about."""
    at = F.pmod(F.lit(i) if isinstance(i, int) else i, F.lit(64)) * 2 + 1
    return F.conv(F.substring(stream, at, F.lit(2)), 16, 10).cast("int")


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def _masked(text: Column, stream: Column) -> Column:
    """Each digit becomes a digit and each letter a letter of its case and script; all else stays. Letters of scripts
    that are not listed become Latin ones of their case."""
    def one(c: Column, i: Column) -> Column:
        b = _byte(stream, i)
        shift = lambda first, n: F.char(F.lit(ord(first)) + F.pmod(b, F.lit(n)))
        among = lambda letters: F.substring(F.lit(letters), F.pmod(b, F.lit(len(letters))) + 1, F.lit(1))
        # F.char knows the first 256 characters only; others come from their place in UTF-16.
        beyond = lambda first, n: F.decode(F.unhex(F.lpad(F.hex(F.lit(ord(first)) + F.pmod(b * 256 + _byte(stream, i + 29), F.lit(n))), 4, "0")), "UTF-16BE")
        out = F.when(c.rlike("^[0-9]$"), shift("0", 10)).when(c.rlike("^[a-f]$"), shift("a", 6)).when(c.rlike("^[g-z]$"), shift("g", 20)).when(c.rlike("^[A-Z]$"), shift("A", 26)).when(c.rlike("^[ -~]$"), c)
        for letters, first, n in _SCRIPTS:
            out = out.when(c.rlike(f"^{letters}$"), beyond(first, n))
        return out.when(c.rlike(r"^\p{Ll}$"), among("àáâäåèéêëìíîïòóôöùúûü")).when(c.rlike(r"^\p{Lu}$"), among("ÀÁÂÄÅÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜ")).when(c.rlike(r"^\p{L}$"), shift("a", 26)).otherwise(c)
    return F.array_join(F.transform(F.split(text, ""), one), "")


def _digits(stream: Column, n: Column) -> Column:
    """n digits of the stream's end, none for n below 1."""
    return F.translate(F.substring(stream, F.lit(65), F.greatest(n, F.lit(0))), "abcdef", "012345")


def _more(values: list[str], stream: Column, n: Column) -> Column:
    """n of 16 syllables, none for n below 1."""
    at = lambda i: F.conv(F.substring(stream, F.lit(64) + i, F.lit(1)), 16, 10).cast("int")
    return F.when(n < 1, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: _pick(values, at(i))), ""))


def _refill(shape: Column, digits: Column) -> Column:
    """The shape with its letters and digits replaced in turn by the characters of `digits`."""
    chars = F.split(shape, "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("i"))
    step = lambda a, c: F.struct(
        F.concat(a["out"], F.when(c.rlike("^[0-9A-Za-z]$"), F.substring(digits, a["i"] + 1, F.lit(1))).otherwise(c)).alias("out"),
        (a["i"] + F.when(c.rlike("^[0-9A-Za-z]$"), 1).otherwise(0)).alias("i"))
    return F.aggregate(chars, start, step, lambda a: a["out"])


def luhn_sum(digits: Column) -> Column:
    """Sum of a digit string whose last digit counts twice (the check digit follows it)."""
    reverse = F.split(F.reverse(digits), "")
    return F.aggregate(
        F.transform(reverse, lambda c, i: F.when(i % 2 == 1, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))),
        F.lit(0), lambda a, x: a + x)


def _card(canon: Column, stream: Column) -> Column:
    n = F.length(canon)
    head = _masked(F.substring(canon, F.lit(2), n - 2), stream)
    body = F.concat(F.substring(canon, 1, 1), head)
    return F.concat(body, F.pmod(10 - F.pmod(luhn_sum(body), F.lit(10)), F.lit(10)).cast("string"))


def _iban(canon: Column, stream: Column) -> Column:
    """Country and shape stay; the check digits are those of the new number: 98 less its remainder by 97."""
    country = F.substring(canon, F.lit(1), F.lit(2))
    own = _masked(F.substring(canon, F.lit(5), F.length(canon)), stream)
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(F.upper(c)) - 55)
    turned = F.transform(F.split(F.concat(own, country, F.lit("00")), ""), lambda c: F.struct(value(c).alias("v"), F.when(c.rlike("^[0-9]$"), 10).otherwise(100).alias("m")))
    rest = F.aggregate(turned, F.lit(0), lambda a, x: F.pmod(a * x["m"] + x["v"], F.lit(97)))
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), own)


def _word(word: Column, of: Column, stream: Column, attempt: Column) -> Column:
    """A given or family name in the word's script; every attempt makes it a syllable longer."""
    b = _byte(stream, 0) * 256 + _byte(stream, 1)
    russian = word.rlike(r"^\p{IsCyrillic}")
    third = _byte(stream, 2)
    given = (F.when(russian, F.concat(F.when(of == "given f", _pick(_CYRILLIC_F, b)).when(of == "given m", _pick(_CYRILLIC_M, b)).otherwise(_pick(_CYRILLIC_N, b)), _more(_CYRILLIC_MORE, stream, attempt)))
             .otherwise(F.concat(F.when(of == "given f", _pick(_LATIN_F, b)).when(of == "given m", _pick(_LATIN_M, b)).otherwise(_pick(_LATIN_N, b)), _more(_LATIN_MORE, stream, attempt))))
    slavic = F.concat(_pick(list("БВГДЗКЛМНПРСТФ"), b), _pick(["а", "е", "и", "о", "у", "ар", "ел", "ир", "ол", "ур"], F.floor(b / 14)), _more(_CYRILLIC_MORE, stream, attempt), _pick(list("бвгдзклмнпрст"), third))
    latin = F.concat(_pick(list("ABCDFGHKLMNPRSTVW"), b), _pick(["a", "e", "i", "o", "u", "al", "er", "in", "or", "un"], F.floor(b / 17)), _more(_LATIN_MORE, stream, attempt), _pick(list("bdfgklmnprstvz"), third))
    family = (F.when(russian, F.concat(slavic, F.when(word.rlike("(?:а|ая)$"), _pick(_CYRILLIC_END_F, b)).otherwise(_pick(_CYRILLIC_END_M, b))))
              .otherwise(F.concat(latin, _pick(_LATIN_END, _byte(stream, 41)))))
    other = _masked(F.concat(word, F.repeat(F.substring(word, F.length(word), F.lit(1)), attempt * 2)), stream)
    return F.when(~russian & ~word.rlike(r"^\p{IsLatin}"), other).when(of == "family", family).otherwise(given)


def surrogate(entity: Column, of: Column, canon: Column, s: Column, attempt: Column) -> Column:
    """The surrogate of one unit of kind `of`, by its canonical form, stream and attempt."""
    longer = _digits(s, attempt - WIDEN)
    address = F.concat_ws(".", *[(_byte(s, i) % (223 if i == 0 else 254) + 1).cast("string") for i in range(4)])
    # IPv4 has no more places: addresses of the block for documentation.
    address = F.when(attempt > WIDEN, F.concat(F.lit("2001:db8::"), F.substring(s, 65, 4), F.lit(":"), F.substring(s, 69, 4))).otherwise(address)
    place = F.substring_index(canon, "@", -1)
    mail = F.concat(_masked(F.substring_index(canon, "@", 1), s), F.translate(F.substring(s, F.lit(65), attempt * 2), "0123456789", "ghijklmnop"), F.lit("@"), F.when(place.rlike(r"(^|\.)example\.(com|net|org)$"), place).otherwise(F.lit("example.org")))
    digits = F.regexp_replace(canon, r"^\+", "")
    ahead = F.when(canon.startswith("+"), F.greatest(F.length(F.regexp_extract(entity, r"^\+(\d{1,3})(?=[ .(-])", 1)), F.lit(1))).otherwise(0)
    number = F.concat(F.substring(digits, F.lit(1), ahead), F.char(F.lit(50) + _byte(s, 50) % 8), _masked(F.substring(digits, ahead + 2, F.length(digits)), s))
    return (F.when(of == "email", mail).when(of == "ip", address).when(of == "card", F.concat(_refill(entity, _card(canon, s)), longer))
            .when(of == "phone", F.concat(_refill(entity, number), longer)).when(of == "ssn", F.concat(_refill(entity, _masked(canon, s)), longer))
            .when(of == "iban", F.concat(_refill(entity, _iban(canon, s)), longer))
            .when(of == "key", F.concat(F.substring(entity, 1, 4), _masked(F.substring(entity, 5, 64), s), longer))
            .when(of == "secret", F.concat(_masked(entity, s), F.substring(s, F.lit(65), attempt))).otherwise(_word(entity, of, s, attempt)))


def unit_key(of: Column, canon: Column) -> Column:
    return F.concat(of, F.lit("|"), canon)


def replacements(made_of: Column, attempts: Column, key: str) -> Column:
    """The surrogates of an array of units. What several branches need is worked out step by step, once for each.
    `attempts` maps unit_key to attempts, 0 where there are none."""
    tries = lambda x: F.coalesce(F.try_element_at(attempts, unit_key(x["k"], x["c"])), F.lit(0))
    counted = F.transform(made_of, lambda x: F.struct(x["k"].alias("k"), x["e"].alias("e"), x["c"].alias("c"), tries(x).alias("a")))
    streams = F.transform(counted, lambda x: F.struct(x["k"].alias("k"), x["e"].alias("e"), x["c"].alias("c"), x["a"].alias("a"), _stream(x["k"], x["c"], x["a"], key).alias("s")))
    return F.transform(streams, lambda x: F.struct(x["k"].alias("k"), x["e"].alias("e"), surrogate(x["e"], x["k"], x["c"], x["s"], x["a"]).alias("s")))


def with_entities(df: DataFrame, text: str = "text") -> DataFrame:
    """(row: a struct of all columns but the text, null: whether the text is null, p: the parts of the text between
    entities, one more than there are entities, e: the entities in order, with repeats, g: for each the gender of the
    title before it, f, m or n). The pattern runs over a text once."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = F.split(F.regexp_replace(t, PATTERN, f"{MARK}$0{MARK}"), MARK, -1)
    apart = F.zip_with(F.split(t, PATTERN, -1), F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0)), lambda p, e: F.when(e.isNull(), F.array(p)).otherwise(F.array(p, e)))
    # Parts and entities in turn.
    turns = F.when(~t.rlike(HINT), F.array(t)).when(t.contains(MARK), F.flatten(apart)).otherwise(found)
    d = df.select(F.struct(F.lit(0).alias(unique_name(df, "__none")), *[F.col(c) for c in df.columns if c != text]).alias("row"), F.col(text).isNull().alias("null"), turns.alias("t"))
    d = fenced(d.select("row", "null", "t"), {"t": F.col("t")})
    odd = lambda n: F.filter("t", lambda _, i: i % 2 == n)
    d = d.select("row", "null", odd(0).alias("p"), odd(1).alias("e"))
    any_of = lambda titles: "(?:" + "|".join(x.replace(".", r"\.") for x in titles) + ") $"
    gender = lambda p: F.when(p.rlike(any_of(_TITLES_F)), "f").when(p.rlike(any_of(_TITLES_N)), "n").otherwise("m")
    return d.withColumn("g", F.transform(F.slice("p", F.lit(1), F.size("e")), gender))


def entity_units() -> Column:
    """For each entity of a row of `with_entities` the array of its units."""
    kinds = F.transform(F.arrays_zip(F.col("e").alias("e"), F.col("g").alias("g")), lambda x: F.struct(x["e"].alias("e"), x["g"].alias("g"), kind(x["e"]).alias("k")))
    return F.transform(kinds, units)


def entity_table(found: DataFrame) -> DataFrame:
    """(kind, canon, entity): one row for each unit, spelt as its smallest spelling."""
    rows = found.filter(F.size("e") > 0).select(F.explode(F.arrays_zip(F.col("e").alias("e"), F.col("g").alias("g"))).alias("x"))
    rows = rows.select("x.e", "x.g").distinct()  # a spelling occurs often; its kind is told once
    each = rows.select(F.explode(units(F.struct("e", "g", kind(F.col("e")).alias("k")))).alias("u"))
    return each.groupBy(F.col("u.k").alias("kind"), F.col("u.c").alias("canon")).agg(F.min("u.e").alias("entity"))


def retries(ws: Workspace, entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt) of the units whose first surrogate collides, and the attempt that does not.

    Two collide when they share a surrogate's canonical form, or when a surrogate is an original of the same kind.
    Of those that share, the one with the fewest attempts, then the smallest canonical form, keeps its surrogate.
    """
    def made(d: DataFrame) -> DataFrame:
        d = fenced(d, {"__stream": _stream(F.col("kind"), F.col("canon"), F.col("attempt"), key)})
        d = fenced(d, {"__new": surrogate(F.col("entity"), F.col("kind"), F.col("canon"), F.col("__stream"), F.col("attempt"))})
        return d.withColumn("s", canonical(F.col("__new"), F.col("kind"))).drop("__new", "__stream")

    # Spread by number: the table is small, but each row takes long.
    spread = entities.repartition(input_partitions(entities), "kind", "canon")
    current = ws.table(made(spread.withColumn("attempt", F.lit(0))), "surrogates0")
    originals = entities.select("kind", F.col("canon").alias("s")).withColumn("taken", F.lit(True))
    for i in range(1, MAX_ATTEMPTS):
        holders = current.groupBy("kind", "s").agg(F.min(F.struct("attempt", "canon")).alias("first"), F.count(F.lit(1)).alias("n"))
        owned = holders.join(originals, ["kind", "s"], "left").filter((F.col("n") > 1) | F.col("taken"))
        bad = current.join(owned, ["kind", "s"], "inner").filter(F.col("taken") | (F.col("first.canon") != F.col("canon"))).select("kind", "canon")
        bad = ws.table(bad, f"bad{i}")
        if bad.isEmpty():
            break
        # Only what collides is worked out again.
        moved = current.join(bad, ["kind", "canon"], "left_semi").drop("s").withColumn("attempt", F.col("attempt") + 1)
        current = ws.table(current.join(bad, ["kind", "canon"], "left_anti").unionByName(made(moved)), f"surrogates{i}")
    else:
        raise RuntimeError(f"no surrogate after {MAX_ATTEMPTS} attempts")
    return current.filter("attempt > 0").select("kind", "canon", "attempt")


def replace(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """`df` with every entity in `text` replaced, and n_entities, the number of entities in the row. `key` is secret:
    who has it can tell whether a guess was replaced by a given surrogate.

    Null texts stay null, with 0 entities, and empty ones empty; very long texts are replaced whole, in the memory that
    a few copies of the text take; repeated rows are replaced alike; an empty table gives an empty one; a column named
    n_entities is replaced, all others pass through. Bare family names of BARE_LETTERS or more, in a text that has
    them after a title, are replaced too but not counted.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "pii")
    base = df.select(*[c for c in df.columns if c.lower() != "n_entities" or c == text])
    found = with_entities(base, text)
    # Written once, so the pattern runs once; the digest names a text with entities, and copies share theirs.
    found = found.withColumn("d", F.when(F.size("e") > 0, F.sha2(F.concat(F.array_join("p", MARK), F.lit(MARK), F.array_join("e", MARK), F.array_join("g", "")), 256)))
    found = ws.table(found, "found")
    entities = ws.table(entity_table(found), "entities")
    again = ws.table(retries(ws, entities, key), "retries")
    none = F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<int>))")
    if again.isEmpty():
        found = found.withColumn("a", none)
    else:
        spelt = found.filter(F.size("e") > 0).select("d", "e", "g").withColumn("u", F.explode(F.array_distinct(F.flatten(entity_units()))))
        spelt = spelt.select("d", F.col("u.k").alias("kind"), F.col("u.c").alias("canon"))
        hit = skew_join(spelt, again, ["kind", "canon"], "inner").groupBy("d").agg(F.map_from_entries(F.collect_set(F.struct(unit_key(F.col("kind"), F.col("canon")), "attempt"))).alias("a"))
        found = skew_join(found, hit, ["d"], "left").withColumn("a", F.coalesce("a", none))
    made = F.transform(entity_units(), lambda us: replacements(us, F.col("a"), key))
    found = fenced(found.select("row", "null", "p", F.size("e").alias("n"), F.when(F.size("e") > 0, made).alias("m")), {"m": F.col("m")})
    families = F.array_distinct(F.filter(F.flatten("m"), lambda x: (x["k"] == "family") & (F.length(x["e"]) >= BARE_LETTERS)))
    bare = lambda p, x: F.regexp_replace(p, F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), F.lit(r"\Q"), x["e"], F.lit(r"\E"), F.lit(r"(?![\p{L}\p{N}_])")), x["s"])
    parts = F.when(F.size("f") > 0, F.transform("p", lambda p: F.aggregate("f", p, bare))).otherwise(F.col("p"))
    spoken = F.transform("m", lambda us: F.array_join(F.transform(us, lambda x: x["s"]), " "))
    joined = F.array_join(F.zip_with(parts, spoken, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    done = found.withColumn("f", families).select("row", "n", F.when(F.col("null"), F.lit(None)).when(F.col("n") > 0, joined).otherwise(F.element_at("p", 1)).alias("t"))
    return done.select(*[F.col("t").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in base.columns], F.col("n").cast("long").alias("n_entities"))
