"""Surrogates for personal data, in DataFrame functions only.

Detected entities get keyed replacements of their own type and format: digits stay digits in their layout (card numbers
keep their first digit and whether their check digit holds, phone numbers their country code), addresses stay addresses,
e-mail keeps its top domain, keys keep their alphabet, case and length, and a name after a form of address keeps gender,
script and number of parts.

What is replaced are an entity's units, in one spelling each: the lower-case address, the digits of a number without its
layout, the lower-case hexadecimal key, and a name's given and family name apart. So all spellings of one thing are
replaced alike wherever they stand (coreference), "Mr. John Smith" and "Mr. Smith" keep a family name in common, and in a
document that has "Mr. John Smith" a bare "John" or "Smith" is replaced too. Numbers are permuted by a keyed Feistel network
over their own digits, so different ones never meet; the other surrogates are keyed hashes in the unit's shape. All
distinct units are then checked: a surrogate that another unit has too, or that is itself a unit of the corpus, is made
anew with the next attempt's key. Names and e-mail addresses grow longer with attempts. Units that are left after ATTEMPTS
rounds, which needs a number format whose values are nearly all in use, take each other's values in turn, so surrogates
stay distinct; one left alone in its format is an error. Only these new ones, the overrides, are looked up when texts are
rewritten, and only the rows with entities take part in that join.

Bare runs of 13 to 19 digits are card numbers if their check digit holds, else they stay as they are. E-mail addresses have
up to 64 characters before the @ and up to 126 labels before the top domain; longer ones are none. Null texts stay null and empty ones empty; texts without
entities stay as they are; repeated rows are rewritten alike. Entities are matched without regard to overlap, from left
to right, in whole texts. Extra columns are kept, but for those that have the names asked for in ``report``, which give
way to the report.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import let, written

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# Hexadecimal in either case; runs longer than any one digest are keys only if they hold a digit ("aaaa..." is none).
_HEX = "|".join(rf"[0-9{a}]{{32,128}}+(?![0-9{a}])|(?=[{a}]*+[0-9])[0-9{a}]{{129,}}+" for a in ("a-f", "A-F"))
# Forms of address by gender, and names by gender and script.
MALE_FORMS = ["Mr", "Sir", "Herr", "Señor", "Monsieur", "Господин"]
FEMALE_FORMS = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Madame", "Mme", "Госпожа"]
GIVEN = {
    ("m", "latin"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Mark", "Noah", "Oscar", "Paul"],
    ("f", "latin"): ["Alice", "Bella", "Clara", "Diana", "Elena", "Flora", "Greta", "Helen", "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Olivia", "Paula"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Игорь", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Сергей", "Тимур"],
    ("f", "cyrillic"): ["Анна", "Белла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Ксения", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Софья"],
}
SYLLABLES = {
    "latin": ["bar", "ben", "dal", "den", "fal", "gar", "hol", "jen", "kel", "lor", "mar", "nor", "pel", "ras", "sol", "ver"],
    "cyrillic": ["бар", "вер", "гал", "дол", "зар", "кол", "лор", "мар", "нов", "пол", "рас", "сол", "тор", "фед", "хар", "шел"],
}
_FORMS = "|".join([*MALE_FORMS, *FEMALE_FORMS])
# What is detected, in the order in which it is tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,24}+(?![A-Za-z0-9-])",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "card": r"(?<!\d)(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})(?!\d)",
    "secret": rf"(?<![0-9A-Za-z])(?:{_HEX}|AKIA[0-9A-Z]{{16}}|sk-(?:(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{{20,}}+|[A-Za-z0-9]{{20,}}+))(?![0-9A-Za-z])",
    "name": rf"(?<!\p{{L}})(?:{_FORMS})\.? \p{{Lu}}\p{{L}}++(?: \p{{Lu}}\p{{L}}++)?",
}
# No pattern begins inside a word but those that begin with a digit, a plus or a bracket: other places are passed by at once.
ANY = "(?:(?<![A-Za-z])|(?=[\\d+(]))(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
ATTEMPTS = 40
#: Attempts after which e-mail addresses and family names grow longer by an attempt, as their own length may be used up.
SHORT_ATTEMPTS = 5
#: Overrides up to which they are broadcast (some 2 MB); beyond, they are joined by shuffle.
OVERRIDES_BROADCAST = 10_000
ROUNDS = 8


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string, modulo 10: 0 where the check digit holds."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10


def kind_of(entity: Column) -> Column:
    """The type of what ANY has matched; "none" for a run of digits that is no card number."""
    like = lambda p: F.regexp_like(entity, F.lit(p))
    return (
        F.when(F.contains(entity, F.lit("@")), "email")
        .when(like(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(like(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(like(r"^\d{13,19}$"), F.when(_luhn(entity) == 0, "card").otherwise("none"))
        .when(like(r"^\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}$"), "card")
        .when(like(r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$"), "phone")
        .when(like("^(?:[0-9a-fA-F]+|AKIA.*|sk-.*)$"), "secret")
        .otherwise("name")
    )


def _country(phone: Column) -> Column:
    """The country code with its plus: 1 and 7 stand alone."""
    return F.regexp_extract(phone, r"^(\+(?:[17]|\d{1,3}))", 1)


def _after(text: Column, head: Column) -> Column:
    return F.substring(text, F.length(head) + 1, F.length(text))


def _form(name: Column) -> Column:
    """The form of address, without its full stop and with it."""
    return F.regexp_extract(name, rf"^({_FORMS})\.? ", 1)


def _parts(name: Column) -> Column:
    """The given name, if any, and the family name."""
    return F.split(F.regexp_replace(name, rf"^(?:{_FORMS})\.? ", ""), " ")


def _name_units(name: Column) -> Column:
    """Units of a name after a form of address."""
    parts, gender = _parts(name), F.when(_form(name).isin(FEMALE_FORMS), "f").otherwise("m")

    def unit(part: Column, i: Column) -> Column:
        script = F.when(F.regexp_like(part, F.lit(r"\p{IsCyrillic}")), "cyrillic").otherwise("latin")
        return F.when(i + 1 < F.size(parts), F.concat(F.lit("given-"), gender, F.lit("-"), script, F.lit("|"), part)).otherwise(F.concat(F.lit("family-"), script, F.lit("|"), part))

    return F.transform(parts, unit)


def units_of(entity: Column, kind: Column) -> Column:
    """The units of an entity: type and one spelling, parted by a bar."""
    hexa = F.regexp_like(entity, F.lit("^[0-9a-fA-F]+$"))
    one = (
        F.when(kind == "email", F.concat(F.lit("email|"), F.lower(entity)))
        .when(kind == "phone", F.concat(F.lit("phone|"), _digits(_after(entity, _country(entity)))))
        .when(kind.isin("card", "ssn"), F.concat(kind, F.lit("|"), _digits(entity)))
        .when((kind == "secret") & hexa, F.concat(F.lit("hex|"), F.lower(entity)))
        .when(kind == "secret", F.concat(F.lit("key|"), entity))
        .otherwise(F.concat(kind, F.lit("|"), entity))
    )
    return F.when(kind == "none", F.array().cast("array<string>")).when(kind == "name", _name_units(entity)).otherwise(F.array(one))


def entities(text: Column) -> Column:
    """All entities of a text in order: entity, kind and units. With names, their bare parts are entities as well."""
    first = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda e: F.struct(e.alias("entity"), kind_of(e).alias("kind")))

    def whole(found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(x["entity"].alias("entity"), x["kind"].alias("kind"), units_of(x["entity"], x["kind"]).alias("units")))

    def with_parts(found: Column) -> Column:
        known = F.flatten(F.transform(F.filter(found, lambda x: x["kind"] == "name"), lambda x: _name_units(x["entity"])))
        again = F.regexp_extract_all(text, pattern_for(found), F.lit(0))

        def one(e: Column) -> Column:
            of_part = F.filter(known, lambda u: F.substring_index(u, "|", -1) == e)
            kind = F.when(F.size(of_part) > 0, "name").otherwise(kind_of(e))
            units = F.when(F.size(of_part) > 0, F.slice(of_part, 1, 1)).otherwise(units_of(e, kind))
            return F.struct(e.alias("entity"), kind.alias("kind"), units.alias("units"))

        return F.transform(again, one)

    # transform over a list of one: the found entities are worked out once and named.
    return F.flatten(F.transform(F.array(first), lambda found: F.when(F.exists(found, lambda x: x["kind"] == "name"), with_parts(found)).otherwise(whole(found))))


def pattern_for(found: Column) -> Column:
    """The pattern whose matches the entities of a text are: with names, their parts are looked for as well."""
    parts = F.array_distinct(F.flatten(F.transform(F.filter(found, lambda x: (x["kind"] == "name") & (_form(x["entity"]) != "")), lambda x: _parts(x["entity"]))))
    bare = F.concat(F.lit(ANY + r"|(?<!\p{L})(?:"), F.array_join(F.array_sort(parts), "|"), F.lit(r")(?!\p{L})"))
    return F.when(F.size(parts) > 0, bare).otherwise(F.lit(ANY))


def _number(*parts: Column) -> Column:
    """48 keyed bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12), 16, 10).cast("long")


def _ten_to(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")


def _permuted(digits: Column, key: Column) -> Column:
    """A keyed permutation of the digit strings of this length (2 to 18 digits): halves added to in turn."""
    half = F.floor(F.length(digits) / 2).cast("int")
    n = F.length(digits)

    def turn(held: Column, i: Column) -> Column:
        a, b = held["a"], held["b"]
        of_a = F.lpad(((a.cast("long") + F.pmod(_number(key, n.cast("string"), i.cast("string"), b), _ten_to(half))) % _ten_to(half)).cast("string"), half, F.lit("0"))
        of_b = F.lpad(((b.cast("long") + F.pmod(_number(key, n.cast("string"), i.cast("string"), a), _ten_to(n - half))) % _ten_to(n - half)).cast("string"), n - half, F.lit("0"))
        even = i % 2 == 0
        return F.struct(F.when(even, of_a).otherwise(a).alias("a"), F.when(even, b).otherwise(of_b).alias("b"))

    start = F.struct(F.substring(digits, F.lit(1), half).alias("a"), F.substring(digits, half + 1, n).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda held: F.concat(held["a"], held["b"]))


def _filled(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in order, by those given."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(held: Column, c: Column) -> Column:
        is_digit = F.regexp_like(c, F.lit(r"^\d$"))
        return F.struct(
            F.concat(held["out"], F.when(is_digit, F.substring(digits, held["at"], F.lit(1))).otherwise(c)).alias("out"),
            F.when(is_digit, held["at"] + 1).otherwise(held["at"]).alias("at"),
        )

    return F.aggregate(F.split(shape, ""), start, put, lambda held: held["out"])


def _address(entity: Column, key: Column) -> Column:
    """Another IPv4 address: the two halves of 16 bits added to in turn."""
    octet = F.transform(F.split(entity, r"\."), lambda x: x.cast("long"))
    start = F.struct((octet[0] * 256 + octet[1]).alias("a"), (octet[2] * 256 + octet[3]).alias("b"))

    def turn(held: Column, i: Column) -> Column:
        even = i % 2 == 0
        of_a = F.pmod(held["a"] + _number(key, i.cast("string"), held["b"].cast("string")), F.lit(65536))
        of_b = F.pmod(held["b"] + _number(key, i.cast("string"), held["a"].cast("string")), F.lit(65536))
        return F.struct(F.when(even, of_a).otherwise(held["a"]).alias("a"), F.when(even, held["b"]).otherwise(of_b).alias("b"))

    def spelt(held: Column) -> Column:
        four = [F.floor(held["a"] / 256), held["a"] % 256, F.floor(held["b"] / 256), held["b"] % 256]
        return F.concat_ws(".", *[x.cast("string") for x in four])

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, spelt)


def _masked(text: Column, stream: Column, letters: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """Letters become keyed letters of their case, digits keyed digits, anything else stays. stream: 128 hex digits."""
    n, up = len(letters), letters.upper()

    def one(c: Column, i: Column) -> Column:
        roll = F.conv(F.substring(stream, F.pmod(i * 2, F.lit(126)) + 1, F.lit(3)), 16, 10).cast("int") + i
        pick = (roll % n + 1).cast("int")
        return (
            F.when(F.regexp_like(c, F.lit(r"^\d$")), (roll % 10).cast("string"))
            .when(F.regexp_like(c, F.lit("^[a-z]$")), F.substring(F.lit(letters), pick, F.lit(1)))
            .when(F.regexp_like(c, F.lit("^[A-Z]$")), F.substring(F.lit(up), pick, F.lit(1)))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _secret(value: Column, key: Column) -> Column:
    """As many hexadecimal digits."""
    blocks = F.sequence(F.lit(0), F.floor((F.length(value) - 1) / 128).cast("int"))
    whole = F.array(F.sha2(F.concat_ws("|", key, value), 512))  # a long key is hashed once, then its digest for each block
    hexa = F.transform(whole, lambda h: F.array_join(F.transform(blocks, lambda k: F.sha2(F.concat_ws("|", h, k.cast("string")), 512)), ""))
    return F.substring(hexa[0], F.lit(1), F.length(value))


def _card(value: Column, key: Column) -> Column:
    """The first digit, the middle ones permuted, and the check digit with which the Luhn sum is what it was."""
    first, middle = F.substring(value, 1, 1), F.substring(value, F.lit(2), F.length(value) - 2)
    head = F.concat(first, _permuted(middle, F.concat_ws("|", key, first)))
    return F.concat(head, F.pmod(_luhn(value) - _luhn(F.concat(head, F.lit("0"))), F.lit(10)).cast("string"))


def _one_of(names: list[str], *parts: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(_number(*parts), F.lit(len(names))) + 1).cast("int"))


def _syllables(script: str, n: Column, *parts: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: _one_of(SYLLABLES[script], *parts, i.cast("string"))), "")


def surrogate(unit: Column, secret: str, attempt: Column | None = None) -> Column:
    """The surrogate of a unit at an attempt (0 first), with the unit's type before it."""
    attempt = F.lit(0) if attempt is None else attempt
    parts = let(F.substring_index(unit, "|", 1), lambda kind: F.struct(kind.alias("kind"), _after(unit, F.concat(kind, F.lit("|"))).alias("value"), F.concat_ws("|", F.lit(secret), attempt.cast("string"), kind).alias("key")))
    return let(parts, lambda x: F.concat(x["kind"], F.lit("|"), _made(x["kind"], x["value"], x["key"], attempt)))


def _made(kind: Column, value: Column, key: Column, attempt: Column) -> Column:
    """The surrogate of a unit's value."""
    stream = F.sha2(F.concat_ws("|", key, value), 512)
    more = F.greatest(F.lit(0), attempt - SHORT_ATTEMPTS)
    top = F.regexp_extract(value, r"(\.[a-z]+)$", 1)
    host = F.concat(F.repeat(F.lit("a"), more), F.substring(value, F.lit(1), F.length(value) - F.length(top)))
    prefix = F.regexp_extract(value, "^(AKIA|sk-)", 1)
    out = (
        F.when(kind == "email", F.concat(let(stream, lambda s: _masked(host, s)), top))
        .when(kind == "ip", _address(value, key))
        .when(kind.isin("ssn", "phone"), _permuted(value, key))
        .when(kind == "card", _card(value, key))
        .when(kind == "hex", _secret(value, key))
        .when(kind == "key", F.concat(prefix, let(stream, lambda s: _masked(_after(value, prefix), s))))
    )
    for script in SYLLABLES:
        for gender in ("m", "f"):
            given = F.concat(_one_of(GIVEN[gender, script], key, value), F.when(attempt > 0, _syllables(script, F.greatest(attempt, F.lit(1)), key, value)).otherwise(""))
            out = out.when(kind == f"given-{gender}-{script}", given)
        out = out.when(kind == f"family-{script}", F.initcap(_syllables(script, 4 + more, key, value)))
    return out


def rendered(entity: Column, kind: Column, new: Column) -> Column:
    """new (the surrogates of the entity's units) in the entity's own spelling."""
    return let(F.transform(new, lambda u: _after(u, F.concat(F.substring_index(u, "|", 1), F.lit("|")))), lambda value: _spelt(entity, kind, value))


def _spelt(entity: Column, kind: Column, value: Column) -> Column:
    def cased(shift: Column) -> Column:
        """shift: a surrogate that has grown longer has its new letters in front."""
        return F.array_join(F.transform(F.split(value[0], ""), lambda c, i: F.when((i >= shift) & F.regexp_like(F.substring(entity, i - shift + 1, F.lit(1)), F.lit("[A-Z]")), F.upper(c)).otherwise(c)), "")

    country, form = _country(entity), F.regexp_extract(entity, rf"^((?:{_FORMS})\.? )", 1)
    return (
        F.when(kind == "email", F.when(F.lower(entity) == entity, value[0]).otherwise(let(F.length(value[0]) - F.length(entity), cased)))
        .when(kind == "phone", F.concat(country, _filled(_after(entity, country), value[0])))
        .when(kind.isin("ssn", "card"), _filled(entity, value[0]))
        .when((kind == "secret") & F.regexp_like(entity, F.lit("^[0-9a-fA-F]*[A-F][0-9a-fA-F]*$")), F.upper(value[0]))
        .when(kind == "name", F.concat(form, F.array_join(value, " ")))
        .when(kind == "none", entity)
        .otherwise(value[0])
    )


def overrides(units: DataFrame, secret: str, attempts: int = ATTEMPTS) -> DataFrame:
    """unit, surrogate for the distinct units whose first surrogate another has too or is itself a unit of the corpus."""
    first = written(units.select("unit", surrogate(F.col("unit"), secret).alias("surrogate")), "surrogates")
    real, given = first.select(F.col("unit").alias("surrogate")), first
    fixed = None

    def colliding(given: DataFrame) -> DataFrame:
        same = given.groupBy("surrogate").agg(F.count(F.lit(1)).alias("n"), F.min("unit").alias("keeps")).where("n > 1")
        doubled = given.join(same, "surrogate").where(F.col("unit") != F.col("keeps")).select("unit")
        return written(doubled.union(given.join(real, "surrogate", "left_semi").select("unit")).distinct(), "collisions")

    def settled(given: DataFrame, bad: DataFrame, again: DataFrame) -> DataFrame:
        return written(given.join(bad, "unit", "left_anti").unionByName(again), "surrogates")

    for attempt in range(1, attempts + 1):
        bad = colliding(given)
        if bad.isEmpty():
            break
        again = written(bad.select("unit", surrogate(F.col("unit"), secret, F.lit(attempt)).alias("surrogate")), "overrides")
        given = settled(given, bad, again)
        fixed = again if fixed is None else fixed.join(bad, "unit", "left_anti").unionByName(again)
    else:
        bad = colliding(given)
        if not bad.isEmpty():
            again = written(_exchanged(bad), "overrides")
            alone = again.where("unit = surrogate").count()
            if alone:
                raise ValueError(f"{alone} values have no free surrogate in their format")
            fixed = again if fixed is None else fixed.join(bad, "unit", "left_anti").unionByName(again)
    return first.where(F.lit(False)) if fixed is None else written(fixed, "overrides")


def _exchanged(bad: DataFrame) -> DataFrame:
    """Units of a type and length take the next one's value, the last the first one's. No unit outside has such a value as its
    surrogate, as it would be taken."""
    from pyspark.sql import Window

    rows = bad.withColumns({"kind": F.substring_index("unit", "|", 1), "n": F.length("unit")})
    line = Window.partitionBy("kind", "n").orderBy("unit")
    ends = rows.groupBy("kind", "n").agg(F.min("unit").alias("least"))
    return rows.withColumn("after", F.lead("unit").over(line)).join(ends, ["kind", "n"]).select("unit", F.coalesce("after", "least").alias("surrogate"))


def replace_entities(docs: DataFrame, secret: str, broadcast_rows: int = OVERRIDES_BROADCAST, report: tuple[str, str] = ("n_replaced", "kinds"), attempts: int = ATTEMPTS) -> DataFrame:
    """docs with every entity of text replaced, and n_replaced (long) and kinds (sorted distinct types, array<string>)."""
    own, row = f"own_{uuid.uuid4().hex}", f"row_{uuid.uuid4().hex}"  # no column of docs has such a name
    found = F.coalesce(entities(F.col("text")), F.array().cast("array<struct<entity:string,kind:string,units:array<string>>>"))
    rows = written(docs.drop(*report).withColumns({own: found, row: F.monotonically_increasing_id()}), "surrogate-rows")
    units = F.array_distinct(F.flatten(F.transform(own, lambda x: x["units"])))
    odd = overrides(rows.where(F.size(own) > 0).select(F.explode(units).alias("unit")).distinct(), secret, attempts)
    few = odd.limit(broadcast_rows + 1).count()
    columns = [c for c in docs.columns if c not in report]

    def rewritten(some: DataFrame, known: Column | None) -> DataFrame:
        def new(unit: Column) -> Column:
            return surrogate(unit, secret) if known is None else F.coalesce(F.try_element_at(known, unit), surrogate(unit, secret))

        made = F.transform(own, lambda x: rendered(x["entity"], x["kind"], F.transform(x["units"], new)))
        between = F.split("text", pattern_for(F.col(own)), -1)
        text = F.array_join(F.zip_with(between, made, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        real = F.filter(own, lambda x: x["kind"] != "none")
        kinds = F.array_sort(F.array_distinct(F.transform(real, lambda x: x["kind"])))
        return some.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in columns], F.size(real).cast("long").alias(report[0]), kinds.alias(report[1]))

    plain = rows.where(F.size(own) == 0).select(*[F.col(f"`{c}`") for c in columns], F.lit(0).cast("long").alias(report[0]), F.array().cast("array<string>").alias(report[1]))
    some = rows.where(F.size(own) > 0)
    if few == 0:
        return plain.unionByName(rewritten(some, None))
    of_row = some.select(row, F.explode(units).alias("unit")).join(F.broadcast(odd) if few <= broadcast_rows else odd, "unit")
    of_row = of_row.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("unit", "surrogate"))).alias(f"{row}_known"))  # one text's units
    return plain.unionByName(rewritten(some.join(of_row, row, "left"), F.coalesce(F.col(f"{row}_known"), F.create_map().cast("map<string,string>"))))
