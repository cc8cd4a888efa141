"""Personal data: detection, and surrogates of the same type and format.

Detected: e-mail addresses, IBANs, payment card numbers, US social security
numbers, phone numbers, IPv4 and IPv6 addresses, and persons named after a title.
One expression with an alternative for each kind finds them, so what two kinds
could claim goes to the first.

* Phones: international ones after + or 00, national ones with a leading 0 (9 to
  12 digits), North American and Spanish ones, with separators or without.
* A name goes on over capital words, with particles (von, de la), initials and
  inner capitals, hyphens and apostrophes, and always ends at a word's end. A name
  of several words is found without its title too in a text that has it with one.

README says what is left undetected.

A surrogate is drawn from HMAC-SHA-512 of the kind, the normalised value and an
attempt number under a key:

* digits become digits, letters become letters of the same case and script, and
  all other characters stay; a phone's country code, an e-mail's label structure
  (under the reserved top domain ``example``), an IBAN's country and a card's
  leading digit stay, and card and IBAN check digits are made to fit again;
* octets of addresses stay octets, and hexadecimal digits hexadecimal;
* a person keeps the titles; given names come from a list of the gender that they
  tell (of either, where they tell none), family names are put together from
  parts of the same script, with the ending of that gender.

Equal values get equal surrogates everywhere (coreference). Distinctness is
checked over all values: where two would share a surrogate, or a surrogate is
itself a value that occurs, the smallest keeps it and the others draw again, up
to ATTEMPTS times. What still collides then (a kind has nearly as many values as
its format has room for) becomes ``[kind-digest]``: distinct, but not of the format.

Texts are searched once. Mentions are stored; a bitmap of bounded size tells the
rows that have some, and only those are shuffled, to be rewritten.

Defined results: null text stays null, empty stays empty; each row is rewritten,
repeated ones alike; a text may be of any length; an empty table stays one; other
columns are carried along, but for ``n_entities``, which is replaced. The key is a
literal of the plans: who may read the event log may read it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Carried, let, marks_of, perhaps_in, small_batches, stored

#: Country codes, and a further digit with what may separate it from the one before.
COUNTRY = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
_DIGIT = r"(?:(?:[ \u00a0\u202f.\-/]| ?\(|\)[ .\-/]?)?[0-9])"
_TRUNK = r"(?: ?\(0\)|[ .\-/]?0)?"
_DATE = r"[0-9]{1,2}[./\-][0-9]{1,2}[./\-](?:[0-9]{4}|[0-9]{2})(?![./\-]?[0-9])"
PHONES = [
    r"(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![\w])",
    # International; lengths are fixed where they are known, so that a number after it stays apart.
    rf"(?:\+|00)(?:1{_DIGIT}{{10}}|3[34]{_TRUNK}{_DIGIT}{{9}}|44{_TRUNK}{_DIGIT}{{9,10}}|49{_TRUNK}{_DIGIT}{{6,11}}|(?!1|3[34]|4[49]){COUNTRY}{_DIGIT}{{6,12}})(?![0-9_])",
    # National: with a leading 0 in pairs or otherwise, North American, Spanish; no dates, no parts of longer numbers.
    rf"(?<![0-9][.,\-/])(?!{_DATE})(?:"
    + "|".join(
        [
            r"0[1-9](?:[ \u00a0\u202f.\-/]?[0-9]{2}){4}(?![\w]|[.,\-/][0-9])",
            rf"0[1-9]{_DIGIT}{{7,10}}",
            r"\(0[1-9][0-9]{0,4}\)(?:[ \-/]?[0-9]){4,9}",
            r"(?:1[ .\-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .\-]?)[2-9][0-9]{2}[ .\-]?[0-9]{4}",
            r"[6-9][0-9]{2}(?:[ \-]?[0-9]{3}){2}",
            r"[6-9][0-9]{2}(?:[ \-][0-9]{2}){3}",
            r"[89][0-9][ \-][0-9]{3}(?:[ \-][0-9]{2}){2}",
        ]
    )
    + r")(?![\w]|[.,\-/][0-9])",
]
#: Titles by the gender that they tell.
TITLES = {
    "male": "Mr Herr Monsieur Señor Господин Sr Sir",
    "female": "Mrs Ms Miss Frau Madame Mademoiselle Mme Mlle Señora Señorita Sra Srta Госпожа",
    "either": "Dr Prof Professor Mx Доктор Профессор",
}
TITLE = "(?:" + "|".join(sorted(" ".join(TITLES.values()).split(), key=lambda t: (-len(t), t))) + ")"
_AFTER_TITLE = r"(?:\.[ \u00a0\u202f]{0,2}|[ \u00a0\u202f]{1,2})"
TITLED = rf"(?:{TITLE}{_AFTER_TITLE}){{1,3}}"
_LETTERS = r"[\p{L}\p{M}\p{N}_]*+"
#: A capital word; hyphens and apostrophes go on, but for endings such as that of "Smith's".
_WORD = rf"\p{{Lu}}{_LETTERS}(?:(?:-|['’](?!(?:s|ll|re|ve|d|m|t)(?!\p{{L}})))\p{{L}}{_LETTERS})*+"
_PARTICLES = r"(?:(?:van|von|vom|zu|zur|zum|de|del|della|di|da|dos|du|le|la|el|al|ter|ten|bin|ibn)[ ](?:(?:der|den|dem|la|las|los)[ ])?)?(?:[dl]['’]|(?:al|el)-)?"
_NAME = rf"{_PARTICLES}(?:(?:\p{{Lu}}\.[ \-]?)++)?{_WORD}"

#: Kinds in order, each with the pattern that finds it at a word's start.
PATTERNS = {
    "email": r"(?<![.%+\-])[A-Za-z0-9_.%+\-]{1,64}+@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"[3-6][0-9]{3}(?:[ \-]?[0-9]{4}){2}[ \-]?[0-9]{3,4}(?![\w])",
    "ssn": r"[0-9]{3}(?<!-[0-9]{3})-[0-9]{2}-[0-9]{4}(?![\w\-])",
    "phone": "(?:" + "|".join(PHONES) + ")",
    "ip": r"(?<!\.)(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\w]|\.[0-9])",
    "ip6": r"(?=[A-Fa-f:]{0,39}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "person": rf"{TITLED}{_NAME}(?:[ \u00a0\u202f](?:y )?(?!{TITLE}(?!\p{{L}})){_NAME})*+",
}
START = r"(?<![\p{L}0-9_])"
ANY = START + "(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
#: Every entity has one of these; most texts have none, and are not searched further.
HINT = rf"[0-9@]|{TITLE}[.\u00a0\u202f ]"
#: Given names, and parts of family names with the endings of each gender.
GIVEN = {
    ("Latin", True): "Adam Albert Anton Boris Bruno Carl Conrad David Edgar Emil Erik Felix Frank Georg Gustav Hugo Ivan Jakob Jonas Karl Konstantin Leon Louis Lukas Martin Max Noel Oscar Otto Paul Peter Ralph Robert Simon Theo Tom Viktor Walter",
    ("Latin", False): "Ada Agnes Anna Berta Clara Diana Dora Edith Emma Eva Flora Gerda Greta Hanna Helena Ida Irene Johanna Julia Karla Lena Lisa Luise Maria Martha Nora Olga Paula Rita Rosa Sara Sofia Tina Ursula Vera Wanda",
    ("Cyrillic", True): "Иван Пётр Павел Антон Борис Глеб Денис Егор Илья Олег Роман Семён Фёдор Юрий Яков Артём",
    ("Cyrillic", False): "Анна Вера Дарья Елена Ирина Мария Нина Ольга Софья Юлия Алла Галина Лидия Раиса Тамара Зоя",
}
ROOTS = {
    "Latin": "Alt Berg Birk Brand Brun Burg Dorn Eich Eller Fels Forst Gold Hag Hart Hoch Holz Kall Kirch Klein Lang Lind Moor Nord Ober Rein Rot Sand Stein Tann Thor Ulm Wald Weid West Wind Winter",
    "Cyrillic": "Бел Волк Воробьёв Громад Дёмин Жук Зимин Кот Лебед Мороз Нос Орл Петух Рыбак Сокол Соловь Тихомир Ушак Хомяк Шишк",
}
ENDINGS = {
    ("Latin", True): "acker au bach beck dorf ermann feld hof horst hus kamp mann mark meier ner sen see stad",
    ("Cyrillic", True): "ов ин енко овский аев ьянов",
    ("Cyrillic", False): "ова ина енко овская аева ьянова",
}
ATTEMPTS = 32


def kind_of(value: Column) -> Column:
    """The first kind whose pattern fits; none for a number like a card's that fails Luhn's check."""
    out = F.lit("person")
    for kind, pattern in reversed(list(PATTERNS.items())[:-1]):
        out = F.when(value.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return F.when(out.eqNullSafe("card") & (F.pmod(_luhn(F.regexp_replace(value, "[^0-9]", "")), F.lit(10)) != 0), F.lit(None)).otherwise(out)


def normalised(kind: Column, value: Column) -> Column:
    """What tells entities apart: case does not in addresses, separators do not in numbers, a title's full stop does not."""
    numbers = F.regexp_replace(value, r"[^0-9+]", "")
    return F.when(kind.isin("email", "ip6"), F.lower(value)).when(kind.isin("card", "ssn", "phone"), numbers).when(kind == "iban", F.replace(value, F.lit(" "))).when(kind == "person", _spaced(value)).otherwise(value)


def _spaced(person: Column) -> Column:
    """Title and names with one space between them, and no full stop after the title."""
    return F.regexp_replace(F.regexp_replace(person, rf"{START}({TITLE}){_AFTER_TITLE}", "$1 "), r"[\u00a0\u202f]", " ")


def _byte(stream: Column, i: Column) -> Column:
    """The i-th (from 0) byte of a hexadecimal stream, read in a circle."""
    at = (F.pmod(i, F.lit(64)) * 2 + 1).cast("int")
    return F.conv(F.substring(stream, at, F.lit(2)), 16, 10).cast("int")


def _alike(value: Column, stream: Column) -> Column:
    """Digits to digits, letters to letters of their case and script, one for one."""

    def one(c: Column, i: Column) -> Column:
        b = _byte(stream, i)
        pick = lambda letters: F.substring(F.lit(letters), (F.pmod(b, F.lit(len(letters))) + 1).cast("int"), F.lit(1))
        return (
            F.when(c.between("0", "9"), F.pmod(b, F.lit(10)).cast("string"))
            .when(c.between("a", "z"), pick("abcdefghijklmnopqrstuvwxyz"))
            .when(c.between("A", "Z"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            .when(c.rlike(r"^\p{IsCyrillic}$") & (c == F.lower(c)), pick("абвгдежзиклмнопрстуфхцчшэюя"))
            .when(c.rlike(r"^\p{IsCyrillic}$"), pick("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), one), "")


def _luhn(digits: Column) -> Column:
    """Sum of Luhn's algorithm, the last digit taken singly."""
    each = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2, F.lit(10)) + F.when(c.cast("int") > 4, 1).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _card(value: Column, stream: Column) -> Column:
    """Keeps the first digit; a number that passes Luhn's check gives one that does."""
    drawn = F.concat(F.substring(value, 1, 1), _alike(F.substring(value, F.lit(2), F.length(value)), stream))
    only = lambda c: F.regexp_replace(c, "[^0-9]", "")
    cut = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
    check = F.pmod(10 - F.pmod(_luhn(F.concat(only(cut), F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    return F.when(F.pmod(_luhn(only(value)), F.lit(10)) == 0, F.concat(cut, check)).otherwise(drawn)


def _mod97(text: Column) -> Column:
    """An IBAN's number modulo 97, letters as two digits."""
    each = F.filter(F.split(text, ""), lambda c: c != "")
    worth = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(each, F.lit(0), lambda a, c: F.pmod(a * F.when(c.between("0", "9"), 10).otherwise(100) + worth(c), F.lit(97)))


def _iban(value: Column, stream: Column) -> Column:
    """Keeps the country; the check digits fit the new account."""
    country, account = F.substring(value, 1, 2), _alike(F.substring(value, F.lit(5), F.length(value)), stream)
    check = F.lpad((98 - _mod97(F.concat(F.replace(account, F.lit(" ")), country, F.lit("00")))).cast("string"), 2, "0")
    return F.concat(country, check, account)


def _email(value: Column, stream: Column, domain_stream: Column) -> Column:
    """Local part and labels letter by letter; one domain stays one domain; the top label is reserved."""
    low = F.lower(value)
    local, domain = F.substring_index(low, "@", 1), F.substring_index(low, "@", -1)
    labels = F.slice(F.split(domain, r"\."), F.lit(1), F.size(F.split(domain, r"\.")) - 1)
    return F.concat(_alike(local, stream), F.lit("@"), _alike(F.array_join(labels, "."), domain_stream), F.lit(".example"))


def _hexadecimal(value: Column, stream: Column) -> Column:
    """Hexadecimal digits for such digits, numerals for numerals."""

    def one(c: Column, i: Column) -> Column:
        b = _byte(stream, i)
        letter = F.substring(F.lit("abcdef"), (F.pmod(b, F.lit(6)) + 1).cast("int"), F.lit(1))
        return F.when(c.between("0", "9"), F.pmod(b, F.lit(10)).cast("string")).when(c == ":", c).otherwise(letter)

    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), one), "")


NAMED = rf"^(?:{TITLE} )+"


def _person(value: Column, stream: Column, attempt: Column) -> Column:
    titles = F.regexp_extract(value, NAMED, 0)
    told = lambda which: titles.rlike(rf"(?:^| )(?:{TITLES[which].replace(' ', '|')}) ")
    cyrillic, either = value.rlike(r"\p{IsCyrillic}"), ~told("male") & ~told("female")
    male = F.when(either, F.pmod(_byte(stream, F.lit(9)), F.lit(2)) == 0).otherwise(~told("female"))
    words = F.size(F.split(F.regexp_replace(value, NAMED, ""), " "))

    def pick(names: str, at: int) -> Column:
        listed = names.split(" ")
        return F.element_at(F.array(*map(F.lit, listed)), (F.pmod(_byte(stream, F.lit(at)), F.lit(len(listed))) + 1).cast("int"))

    def both(script: str, gender: bool) -> Column:
        endings = ENDINGS.get((script, gender), ENDINGS[script, True])
        first, last = pick(GIVEN[script, gender], 0), F.concat(pick(ROOTS[script], 1), pick(endings, 2))
        # A name that was taken gets a second family name, then more letters.
        last = F.when(attempt == 0, last).otherwise(F.concat(last, F.lit("-"), pick(ROOTS[script], 3), pick(endings, 4)))
        last = F.when(attempt < 4, last).otherwise(F.concat(last, F.translate(F.substring(stream, 9, 6), "0123456789abcdef", "абвгдежзиклмнопр" if script == "Cyrillic" else "abcdefghiklmnopr")))
        return F.when(words > 1, F.concat(first, F.lit(" "), last)).otherwise(last)

    name = F.when(cyrillic & male, both("Cyrillic", True)).when(cyrillic, both("Cyrillic", False)).when(male, both("Latin", True)).otherwise(both("Latin", False))
    return F.concat(titles, name)


def hmac(key: str) -> Callable[[Column], Column]:
    """HMAC-SHA-512 (RFC 2104) of a text, in hexadecimal."""
    raw = key.encode()
    raw = (hashlib.sha512(raw).digest() if len(raw) > 128 else raw).ljust(128, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    return lambda text: F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 512))), 512)


def surrogate(kind: Column, value: Column, key: str, attempt: Column) -> Column:
    """A surrogate of the normalised value, in that form."""
    digest = hmac(key)
    drawn = digest(F.concat_ws("\x1f", kind, value, attempt.cast("string")))
    domain = digest(F.concat_ws("\x1f", F.lit("domain"), F.substring_index(F.lower(value), "@", -1)))
    code = F.regexp_extract(value, rf"^(?:(?:\+|00){COUNTRY}0?|0|1(?=[0-9]{{10}}$))", 0)
    octets = F.array_join(F.transform(F.array(*map(F.lit, range(4))), lambda i: _byte(drawn, i).cast("string")), ".")
    return let(
        drawn,
        lambda stream: F.when(kind == "email", _email(value, stream, domain))
        .when(kind == "card", _card(value, stream))
        .when(kind == "iban", _iban(value, stream))
        .when(kind == "ip", octets)
        .when(kind == "ip6", _hexadecimal(value, stream))
        .when(kind == "phone", F.concat(code, _area(F.substring(value, F.length(code) + 1, F.length(value)), stream)))
        .when(kind == "person", _person(value, stream, attempt))
        .otherwise(_alike(value, stream)),
    )


def _area(number: Column, stream: Column) -> Column:
    """An area code starts with 2 to 9."""
    first = (F.pmod(_byte(stream, F.lit(63)), F.lit(8)) + 2).cast("string")
    return F.concat(first, _alike(F.substring(number, F.lit(2), F.length(number)), stream))


def formatted(kind: Column, value: Column, drawn: Column) -> Column:
    """A surrogate of a number with the separators of the value it stands for, or of a person with its title as written."""
    signs = F.filter(F.split(drawn, ""), lambda c: c != "")
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    is_sign = lambda c: c.rlike("^[0-9A-Za-z+]$")
    step = F.aggregate(
        chars,
        F.struct(F.lit(1).alias("at"), F.lit("").alias("out")),
        lambda a, c: F.when(is_sign(c), F.struct((a.at + 1).alias("at"), F.concat(a.out, F.coalesce(F.get(signs, a.at - 1), F.lit(""))).alias("out"))).otherwise(F.struct(a.at.alias("at"), F.concat(a.out, c).alias("out"))),
    )
    titled = F.concat(F.regexp_extract(value, rf"^{TITLED}", 0), F.regexp_replace(drawn, NAMED, ""))
    shown = F.when(value == F.upper(value), F.upper(drawn)).otherwise(drawn)
    as_written = F.when(kind.isin("card", "ssn", "phone", "iban"), step.out).when(kind == "person", titled).when(kind == "ip6", shown).otherwise(drawn)
    return F.when(drawn.startswith("["), drawn).otherwise(as_written)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """entities: distinct (kind, value). Adds ``surrogate``, distinct within a kind and no value itself."""
    waiting, done, values = entities, None, entities.select(F.col("kind").alias("vk"), F.col("value").alias("vv"))
    for attempt in range(ATTEMPTS):
        drawn = waiting.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), key, F.lit(attempt)))
        free = drawn.join(values, (F.col("kind") == F.col("vk")) & (F.col("surrogate") == F.col("vv")), "left_anti")
        if done is not None:
            taken = done.select(F.col("kind").alias("tk"), F.col("surrogate").alias("ts"))
            free = free.join(taken, (F.col("kind") == F.col("tk")) & (F.col("surrogate") == F.col("ts")), "left_anti")
        kept = free.groupBy("kind", "surrogate").agg(F.min("value").alias("value")).select("kind", "value", "surrogate")
        kept = stored(kept, "surrogates")
        done = kept if done is None else done.union(kept)
        waiting = stored(waiting.join(kept.select("kind", "value"), ["kind", "value"], "left_anti"), "colliding")
        if waiting.isEmpty():
            return done
    # So many values that their format has no free surrogates left: tell them apart outside it.
    tail = waiting.withColumn("surrogate", F.concat(F.lit("["), F.col("kind"), F.lit("-"), F.substring(hmac(key)(F.concat_ws("\x1f", "kind", "value")), 1, 32), F.lit("]")))
    return done.union(tail)


def pseudonymise(docs: DataFrame, key: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with entities replaced in ``text_col``, and ``n_entities`` counting them."""
    table = Carried(small_batches(docs), id_col, text_col, ("n_entities",))
    text = F.col("text")
    has = F.coalesce(text.rlike(HINT) & text.rlike(ANY), F.lit(False))
    row_key = F.xxhash64("id", "text").alias("row_key")
    found = table.rows.where(has).select(row_key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1)))).alias("mention"))
    found = found.withColumn("kind", kind_of(F.col("mention"))).withColumn("value", normalised(F.col("kind"), F.col("mention")))
    found = stored(found.where(F.col("kind").isNotNull()).distinct(), "mentions")
    mapped = found.join(assign(found.select("kind", "value").distinct(), key), ["kind", "value"])
    by = formatted(F.col("kind"), F.col("mention"), F.col("surrogate"))
    # Names of several words, which stand for the same person without the title.
    bare, by_bare = (F.regexp_replace(F.col(c), NAMED, "") for c in ("value", "surrogate"))
    named = F.when((F.col("kind") == "person") & bare.contains(" "), F.struct(bare.alias("mention"), by_bare.alias("by")))
    mapped = mapped.select("row_key", F.struct("mention", by.alias("by")).alias("m"), named.alias("bare"))
    pairs = lambda c: F.sort_array(F.collect_set(c))
    mapped = mapped.groupBy("row_key").agg(pairs("m").alias("mentions"), pairs("bare").alias("bares"))
    mapped = stored(mapped.withColumnRenamed("row_key", "found_key"), "replacements")
    some, clean = perhaps_in(table.rows.withColumn("row_key", row_key), "row_key", marks_of(mapped, "found_key"))
    dirty = some.join(mapped, F.col("row_key") == F.col("found_key"), "left")
    # Longer names first; one of two titles' surrogates, if they differ, for both.
    names = F.array_sort(F.array_distinct(F.transform("bares", lambda b: b["mention"])), lambda a, b: F.length(b) - F.length(a))
    listed = F.array_join(F.transform(names, lambda n: F.concat(F.lit("\\Q"), n, F.lit("\\E"))), "|")
    pattern = F.when(F.size("bares") > 0, F.concat(F.lit(f"{ANY}|{START}(?:"), listed, F.lit(r")(?![\p{L}\p{N}_])"))).otherwise(ANY)
    dirty = dirty.withColumn("pattern", pattern).withColumn("every", F.concat("mentions", F.filter("bares", lambda b: ~F.exists("bares", lambda o: (o["mention"] == b["mention"]) & (o["by"] < b["by"])))))
    dirty = dirty.withColumn("pii_map", F.map_from_entries("every")).withColumn("pii_found", F.regexp_extract_all(text, F.concat(F.lit("("), F.col("pattern"), F.lit(")")), F.lit(1)))
    of = lambda m: F.element_at(F.col("pii_map"), m)
    joined = F.array_join(F.zip_with(F.split(text, F.col("pattern"), -1), "pii_found", lambda p, m: F.concat(p, F.coalesce(of(m), m, F.lit("")))), "")
    there = F.col("found_key").isNotNull()
    n = F.when(there, F.size(F.filter("pii_found", lambda m: of(m).isNotNull()))).otherwise(0).cast("long").alias("n_entities")
    dirty = dirty.select("id", F.when(there, joined).otherwise(text).alias("text"), "rest", n)
    return table.out(dirty.unionByName(clean.select("id", "text", "rest", F.lit(0).cast("long").alias("n_entities"))), F.col("n_entities"))
