"""PII surrogates: keyed, type-consistent replacements, with DataFrame and SQL functions only.

Method. One regular expression finds the entities; a text is cut at them and joined again with their surrogates. An
entity in normal form is a format (what stays: separators, prefix, ending, the class of each character) and a value in
it. Its surrogate is the value's image under a keyed permutation of the format's whole space, a Feistel network over
the characters: equal entities get equal surrogates (coreference), different ones of one format different ones
(distinctness), and none its own original. Card numbers keep issuer digit and Luhn check, IBANs country and check
digits. A name's surname is permuted within its script, vowels to vowels; a given name becomes one of the person's
gender.

Collision check: a surrogate that is itself an entity of the table is given up, and the entity asks the next permutation
for one that is neither an entity nor taken. Where a format's space is too full for that (more than half of it are
entities, or some are still without one after the last attempt) all entities of that format take the first permutation:
still all different, none its own original, but it may be another's.
"""

from __future__ import annotations

import secrets
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

# Repeated groups are possessive: Java matches these in a loop, others by recursion, which long texts overflow. What
# repeats without a bound stands after a boundary, so that a search over a long run tries it once.
_TITLES = "Mrs|Mr|Ms|Miss|Dr|Prof|MRS|MR|MS|DR|Herr|Frau|Monsieur|Madame|Mme|Señora|Señor|Sra|Sr|Господин|Госпожа|Κύριος|Κυρία"
_WORD = r"\p{Lu}[\p{L}\p{M}]*+(?:['’](?=\p{Lu}|\p{L}{3})[\p{L}\p{M}]++)*+"
_ITEM = rf"(?:(?:\p{{Lu}}\.[ -]?(?=\p{{Lu}}))*+{_WORD})"
_PARTICLES = "(?:(?:de|da|di|del|della|der|den|van|von|la|le|du|dos|das|bin|ibn|al|el|ter|zu) ){0,4}"
_LOCAL, _LABEL = r"[\p{L}\p{N}\p{M}._%+-]", r"[\p{L}\p{N}\p{M}]++(?:[-_]++[\p{L}\p{N}\p{M}]++)*+"
_OCTET, _GROUP = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])", "[0-9A-Fa-f]{1,4}"
#: Kinds with their patterns, in order of precedence at one place.
PATTERNS = {
    "email": rf"(?<!{_LOCAL}|[\p{{L}}\p{{N}}]['’]){_LOCAL}++(?:['’]{_LOCAL}++)*+@(?=[\p{{L}}\p{{N}}\p{{M}}_.-]*\.\p{{L}}{{2}}){_LABEL}(?:\.{_LABEL})++",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9A-Za-z])",
    "ipv6": rf"(?<![0-9A-Za-z:.])(?:(?:{_GROUP}:){{7}}{_GROUP}|(?=[A-Fa-f:]{{0,39}}[0-9])(?:{_GROUP}:){{1,6}}(?::{_GROUP}){{1,6}})(?![0-9A-Za-z:])",
    "ip": rf"(?<![0-9.A-Za-z])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9A-Za-z]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+|00)[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z.-])0[0-9](?:[ .-][0-9]{2}){4}(?![0-9A-Za-z])|(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{4}(?![0-9A-Za-z-])",
    "name": rf"(?<![\p{{L}}])(?:{_TITLES})\.?\s{{1,3}}{_ITEM}(?:[ -]{_PARTICLES}(?=\p{{Lu}}){_ITEM})*+",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these has no entity.
HINT = rf"[0-9@]|::|{_TITLES}"
FEMALE = r"(?i)^(Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа|Κυρία)\b"
EITHER = r"(?i)^(Dr|Prof)\b"
#: The country codes of one and two digits; all others have three.
COUNTRY = r"^(?:\+|00)(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Given names by script and gender; those of the two genders differ.
NAMES = {
    ("latin", "f"): "Anna Maria Clara Laura Helen Nina Julia Emma Sofia Ines Eva Irene Marta Alma Paula Vera",
    ("latin", "m"): "Peter Paul Martin Lukas David Simon Victor Anton Bruno Oscar Felix Hugo Leon Mario Tomas Emil",
    ("cyrillic", "f"): "Анна Мария Елена Ольга Ирина Вера Нина Лариса Дарья София Юлия Алла Зоя Майя Полина Раиса",
    ("cyrillic", "m"): "Иван Пётр Павел Андрей Борис Виктор Антон Максим Олег Игорь Роман Семён Фёдор Юрий Денис Глеб",
    ("greek", "f"): "Άννα Μαρία Ελένη Σοφία Ειρήνη Δάφνη Ζωή Νίκη Χλόη Ρέα Ιόλη Θάλεια Κλειώ Μυρτώ Φαίδρα Αθηνά",
    ("greek", "m"): "Γιάννης Πέτρος Παύλος Νίκος Κώστας Ανδρέας Σπύρος Μάρκος Λουκάς Ηλίας Θωμάς Φώτης Σταύρος Άρης Πάνος Ορέστης",
}
#: Letters of names with the vowels first, so that vowels and consonants are ranges: in this order and in that of code points.
_SORTED = "aeioubcdfghjklmnpqrstvwxyz" + "αεηιουωβγδζθκλμνξπρςστφχψ" + "аеиоуыэюябвгджзйклмнпрстфхцчшщъь"
_RANGES = "".join(map(chr, [*range(97, 123), *range(945, 970), *range(1072, 1104)]))
#: Ranges of code points (first, how many) within which a character is replaced; of names, and of all else.
NAME_RANGES = [(97, 5), (102, 21), (945, 7), (952, 18), (1072, 9), (1081, 23), (940, 4), (972, 3), (224, 23), (248, 8)]
TEXT_RANGES = [(48, 10), (97, 26), (65, 26), (224, 23), (248, 8), (945, 25), (1072, 32), (0x5D0, 27), (0x621, 26), (0x641, 10), (0x905, 53), (0x3041, 86), (0x30A1, 90), (0x4E00, 20992), (0xAC00, 11172)]
ROUNDS = 4


@dataclass(frozen=True)
class Key:
    """The secret that surrogates depend on, and how often a collision is tried again before its format gives in."""

    secret: str = field(repr=False)
    attempts: int = 40


_SESSION = Key(secrets.token_hex(32))


def session_key(spark=None) -> Key:
    """The key whose secret the session's ``spark.stillpoint.pii.secret`` holds; else one drawn anew for this process."""
    found = spark.conf.get("spark.stillpoint.pii.secret", None) if spark is not None else None
    return Key(found) if found else _SESSION


def kind_of(entity: Column) -> Column:
    """The first kind whose pattern matches the whole entity."""
    out = F.lit(None).cast("string")
    for kind in reversed(PATTERNS):
        out = F.when(entity.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def _person(entity: Column) -> Column:
    """The words of a name without honorific, dots, apostrophes and case, parted by one space."""
    bare = F.regexp_replace(entity, r"^\p{L}+\.?\s+", "")
    return F.trim(F.regexp_replace(F.translate(F.lower(F.regexp_replace(bare, "['’]", "")), "ё", "е"), r"[ .-]+", " "))


def normal(kind: Column, entity: Column) -> Column:
    """What mentions of one entity share: addresses without case, numbers without separators, of names the last word, the surname."""
    surname = F.regexp_extract(_person(entity), r"([^ ]+)$", 1)
    return F.when(kind == "name", surname).when(kind.isin("email", "ipv6"), F.lower(entity)).when(kind.isin("card", "phone", "iban", "ssn"), F.regexp_replace(entity, r"[ ().-]", "")).otherwise(entity)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _number(text: Column) -> Column:
    """48 bits of a text's SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("bigint")


def _char(code: Column) -> Column:
    """The character of a code point."""
    return F.when(code < 128, F.char(code)).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def _class(code: Column, ranges: list[tuple[int, int]]) -> Column:
    """The range (base, many) of a code point; of letters outside ``ranges`` the 16 code points around."""
    out = F.struct((code - code % 16).alias("base"), F.lit(16).alias("many"))
    for base, many in reversed(ranges):
        out = F.when((code >= base) & (code < base + many), F.struct(F.lit(base).alias("base"), F.lit(many).alias("many"))).otherwise(out)
    return out


def _permuted(values: Column, many: Column, tag: Column) -> Column:
    """The image of ``values`` (each from 0 to its ``many`` - 1) under a keyed permutation without fixed points.

    With f a Feistel network of the places at even and odd positions and s a step that adds a keyed number (not 0) to
    each place, the permutation is f, then s, then f backwards.
    """
    half = lambda x, odd: F.filter(x, lambda _, i: i % 2 == odd)
    start = F.struct(half(values, 0).alias("a"), half(values, 1).alias("b"), half(many, 0).alias("p"), half(many, 1).alias("q"))

    def shifted(x: Column, of: Column, by: Column, sign: int, what: Column) -> Column:
        """``x`` plus or minus numbers that depend on ``by``."""
        return _let(F.sha2(F.concat_ws("\u001f", tag, what, F.array_join(F.transform(by, lambda v: v.cast("string")), ",")), 256), lambda d: F.transform(x, lambda v, i: F.pmod(v + sign * (_number(F.concat_ws("\u001f", d, i.cast("string"))) % of[i]), of[i].cast("bigint"))))

    def stepped(x: Column, of: Column, side: str) -> Column:
        add = lambda i: 1 + _number(F.concat_ws("\u001f", tag, F.lit(f"step{side}"), i.cast("string"))) % F.greatest(of[i] - 1, F.lit(1))
        return F.transform(x, lambda v, i: F.pmod(v + add(i), of[i].cast("bigint")))

    as_state = lambda a, b, p, q: F.struct(a.alias("a"), b.alias("b"), p.alias("p"), q.alias("q"))

    def step(s: Column, k: Column) -> Column:
        there = as_state(s["b"], shifted(s["a"], s["p"], s["b"], 1, k.cast("string")), s["q"], s["p"])
        turn = as_state(stepped(s["a"], s["p"], "a"), stepped(s["b"], s["q"], "b"), s["p"], s["q"])
        back = as_state(shifted(s["b"], s["q"], s["a"], -1, (2 * ROUNDS - k).cast("string")), s["a"], s["q"], s["p"])
        return F.when(k < ROUNDS, there).when(k == ROUNDS, turn).otherwise(back)

    end = F.aggregate(F.sequence(F.lit(0), F.lit(2 * ROUNDS)), start, step)
    return _let(end, lambda s: F.flatten(F.zip_with(s["a"], s["b"], lambda x, y: F.filter(F.array(x, y), lambda v: v.isNotNull()))))


def _fill(shape: Column, found: str, chars: Column) -> Column:
    """``shape`` with ``chars``, in order, in the places of the characters that match ``found``."""
    return F.array_join(F.flatten(F.zip_with(F.split(shape, found, -1), chars, lambda p, c: F.array(F.coalesce(p, F.lit("")), F.coalesce(c, F.lit(""))))), "")


def _luhn(digits: Column) -> Column:
    """What the last digit lacks to pass the Luhn check, 0 to 9: sum of the digits, every second from the right doubled."""
    n = F.char_length(digits)

    def value(c: Column, i: Column) -> Column:
        d = c.try_cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when((n - 1 - i) % 2 == 1, twice).otherwise(d)

    return F.pmod(-F.aggregate(F.transform(_chars(digits), value), F.lit(0), lambda a, x: a + x), F.lit(10))


def _iban_check(country: Column, body: Column) -> Column:
    """The check digits, 2 to 98, of an IBAN's country and account."""
    place = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    rest = F.aggregate(_chars(F.concat(body, country, F.lit("00"))), F.lit(0), lambda a, c: F.when(place(c) > 9, a * 100 + place(c)).otherwise(a * 10 + place(c)) % 97)
    return 98 - rest


_ALNUM = r"[\p{L}\p{Nd}]"
#: Of each kind: which characters of the middle part are replaced.
_REPLACED = {"email": _ALNUM, "name": r"\p{L}", "iban": "[0-9A-Z]", "card": "[0-9]", "phone": "[0-9]", "ssn": "[0-9]", "ipv6": "[0-9a-f]"}


def parts(kind: Column, norm: Column) -> tuple[Column, Column, Column]:
    """(prefix, middle, ending) of an entity: the middle is what the permutation works on.

    The country's digits of a phone, the issuer's of a card, the country of an IBAN and the top domain stay; check
    digits follow from the rest.
    """
    n = F.char_length(norm)
    keep = F.when(kind == "phone", F.char_length(F.regexp_extract(norm, COUNTRY, 0))).when(kind == "card", 1).when(kind == "iban", 4).otherwise(0).cast("int")
    top = F.when(kind == "email", F.char_length(F.regexp_extract(norm, r"\.\p{L}++$", 0))).when(kind == "card", 1).otherwise(0).cast("int")
    return F.substr(norm, F.lit(1), keep), F.substr(norm, keep + 1, n - keep - top), F.substr(norm, n - top + 1, top)


def places(kind: Column, middle: Column) -> Column:
    """Array of (base, many, value): the replaceable places of a middle part, in order."""
    own = F.when(kind == "name", F.translate(middle, _SORTED, _RANGES)).otherwise(middle)
    found = F.lit(None).cast("array<string>")
    for k, what in _REPLACED.items():
        found = F.when(kind == k, F.regexp_extract_all(own, F.lit(f"({what})"), 1)).otherwise(found)

    def place(c: Column, i: Column) -> Column:
        code = F.ascii(c)
        first = F.when(code >= 50, F.struct(F.lit(50).alias("base"), F.lit(8).alias("many"))).otherwise(F.struct(F.lit(48).alias("base"), F.lit(2).alias("many")))
        hexa = F.when(code >= 97, F.struct(F.lit(97).alias("base"), F.lit(6).alias("many"))).otherwise(F.struct(F.lit(48).alias("base"), F.lit(10).alias("many")))
        # what follows a phone's code may not turn to 0 or 1
        own = F.when((kind == "phone") & (i == 0), first).when(kind == "ipv6", hexa).when(kind == "name", _class(code, NAME_RANGES)).otherwise(_class(code, TEXT_RANGES))
        return _let(own, lambda r: F.struct(r["base"].cast("bigint").alias("base"), r["many"].cast("bigint").alias("many"), (code - r["base"]).cast("bigint").alias("value")))

    def octet(c: Column) -> Column:
        v = c.try_cast("bigint")
        inner = (v > 0) & (v < 255)
        return F.struct(F.when(inner, 1).otherwise(v).cast("bigint").alias("base"), F.when(inner, 254).otherwise(1).cast("bigint").alias("many"), F.when(inner, v - 1).otherwise(0).cast("bigint").alias("value"))

    return F.when(kind == "ip", F.transform(F.split(middle, r"\."), octet)).otherwise(F.transform(found, place))


def with_format(entities: DataFrame) -> DataFrame:
    """Adds to (kind, norm): ``_p`` (places), ``_format`` (a hash of all that the permutation keeps) and ``_space`` (log2 of the format's size)."""
    kind, norm = F.col("kind"), F.col("norm")
    prefix, middle, ending = parts(kind, norm)
    literal = F.lit(None).cast("string")
    for k, what in _REPLACED.items():
        literal = F.when(kind == k, F.regexp_replace(middle, what, "\u001f")).otherwise(literal)
    out = entities.withColumn("_p", places(kind, middle))
    # a card's last digit and an IBAN's check digits count as their distance to the right ones, which stays
    kept = F.when(kind == "card", _luhn(norm).cast("string")).when(kind == "iban", F.pmod(F.substring(norm, 3, 2).cast("int") - _iban_check(F.substring(norm, 1, 2), F.substr(norm, F.lit(5), F.char_length(norm) - 4)), F.lit(100)).cast("string")).otherwise(ending)
    # distinct surrogates of IBANs and cards follow from distinct middles, as what is kept is the same
    front = F.when(kind == "iban", F.substring(norm, 1, 2)).otherwise(prefix)
    shape = F.concat_ws("\u001e", kind, front, kept, literal, F.transform("_p", lambda p: F.concat_ws(":", p["base"].cast("string"), p["many"].cast("string"))))
    space = F.aggregate("_p", F.lit(0.0), lambda a, p: a + F.log2(p["many"].cast("double")))
    return out.withColumn("_format", F.sha2(shape, 256)).withColumn("_space", space)


def surrogate(kind: Column, norm: Column, attempt: Column, key: Key) -> Column:
    """The surrogate of an entity in normal form, from its ``_p`` and ``_format``."""
    prefix, middle, ending = parts(kind, norm)
    tag = F.concat_ws("\u001f", F.lit(key.secret), F.col("_format"), attempt.cast("string"))
    values = _permuted(F.transform("_p", lambda p: p["value"]), F.transform("_p", lambda p: p["many"]), tag)
    codes = F.zip_with(values, F.col("_p"), lambda v, p: v + p["base"])
    octets = F.array_join(F.transform(codes, lambda c: c.cast("string")), ".")
    chars = F.transform(codes, _char)
    new = F.lit(None).cast("string")
    for k, what in _REPLACED.items():
        new = F.when(kind == k, _fill(middle, what, chars)).otherwise(new)
    new = F.when(kind == "ip", octets).when(kind == "name", F.translate(new, _RANGES, _SORTED)).otherwise(new)

    def whole(new: Column) -> Column:
        card = F.concat(prefix, new)
        lack = _luhn(F.concat(card, F.lit("0")))
        check = F.concat(card, F.pmod(lack + F.try_to_number(ending, F.lit("9")).cast("int") - _luhn(F.concat(prefix, middle, F.lit("0"))), F.lit(10)).cast("string"))
        country = F.substring(norm, 1, 2)
        off = F.substring(norm, 3, 2).try_cast("int") - _iban_check(country, middle)
        iban = F.concat(country, F.lpad(F.pmod(_iban_check(country, new) + off, F.lit(100)).cast("string"), 2, "0"), new)
        return F.when(kind == "card", check).when(kind == "iban", iban).when(kind == "ip", new).otherwise(F.concat(prefix, new, ending))

    return _let(new, whole)


def entity_table(found: DataFrame, key: Key, scratch: Scratch) -> DataFrame:
    """(kind, norm, surrogate) of the distinct entities of ``found`` (kind, norm), all surrogates different.

    See the module's docstring for the collision check. Later attempts read only entities of formats that are still open.
    """
    every = scratch.save(with_format(found.groupBy("kind", "norm").count().drop("count")), "entities")
    ask = lambda df, attempt: df.withColumn("surrogate", surrogate(F.col("kind"), F.col("norm"), F.lit(attempt), key))
    lean, put = ["kind", "norm", "_format"], ["kind", "norm", "_format", "surrogate"]
    first = scratch.save(ask(every, 0).select(*put), "first")
    as_rival = lambda df: df.select("kind", F.col("norm").alias("surrogate"))
    done = scratch.save(first.join(as_rival(every), ["kind", "surrogate"], "left_anti").select(*put), "given")
    open_ = scratch.save(first.join(as_rival(every), ["kind", "surrogate"], "left_semi").select(*lean), "open")
    if open_.isEmpty():
        return done.select("kind", "norm", "surrogate")
    formats = open_.select("_format").distinct()
    rivals = scratch.save(every.join(formats, "_format", "left_semi"), "rivals")
    taken = scratch.save(done.join(formats, "_format", "left_semi"), "taken")
    full = rivals.groupBy("_format").agg(F.count("*").alias("n"), F.first("_space").alias("space")).where(F.log2(F.col("n") * 2) > F.col("space")).select("_format")
    full = scratch.save(full, "full")
    left = scratch.save(rivals.join(open_.join(full, "_format", "left_anti").select("kind", "norm"), ["kind", "norm"], "left_semi"), "open")
    settled = done
    for attempt in range(1, key.attempts + 1):
        if left.isEmpty():
            break
        asked = ask(left, attempt).select(*put).join(as_rival(rivals), ["kind", "surrogate"], "left_anti").join(taken.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        new = scratch.save(asked, "new")
        settled, taken = settled.unionByName(new), taken.unionByName(new)
        left = scratch.save(left.join(new, ["kind", "norm"], "left_anti"), "open")
    give_in = scratch.save(full.union(left.select("_format")).distinct(), "give_in")
    back = first.join(give_in, "_format", "left_semi")
    return scratch.save(settled.join(give_in, "_format", "left_anti").unionByName(back).select("kind", "norm", "surrogate"), "table")


def given_names(people: DataFrame, key: Key, scratch: Scratch) -> DataFrame:
    """(script, norm, given, g, chosen): the given name of each person, from ``people`` (script, norm, given, g).

    g is f, m or u (the honorific doesn't say): u takes the gender that other mentions of the person have, if these are
    of one, else one drawn by the key. People of one surname get different given names: who finds theirs taken draws
    again, each time from 16 times as many (names joined by a hyphen), until none is left.
    """
    known = people.groupBy("script", "norm", "given").agg(F.max(F.col("g") == "f").alias("f"), F.max(F.col("g") == "m").alias("m"), F.max(F.col("g") == "u").alias("u"))
    drawn = F.when(_number(F.concat_ws("\u001f", F.lit(key.secret), F.lit("gender"), "script", "norm", "given")) % 2 == 0, "f").otherwise("m")
    of = F.when(F.col("f") == F.col("m"), drawn).when(F.col("f"), "f").otherwise("m")
    known = scratch.save(known.select("script", "norm", "given", "f", "m", "u", of.alias("of")), "people")
    has = lambda g: F.when(F.col(g) | (F.col("u") & (F.col("of") == g)), F.lit(g))
    each = known.select("script", "norm", "given", F.explode(F.filter(F.array(has("f"), has("m")), lambda x: x.isNotNull())).alias("gender"))
    left = scratch.save(each, "unnamed")
    done, attempt, same = None, 0, ["script", "norm", "given", "gender"]
    while not left.isEmpty():
        picks = []
        for k in range(attempt + 1):
            # the first draw depends on the given name alone, so that it is the same with most surnames
            seed = F.concat_ws("\u001f", F.lit(key.secret), F.lit(f"given{attempt}.{k}"), "given", *(["norm"] if attempt else []))
            pick = F.lit(None).cast("string")
            for (script, g), names in NAMES.items():
                each_name = F.array(*map(F.lit, names.split()))
                pick = F.when((F.col("script") == script) & (F.col("gender") == g), F.element_at(each_name, (_number(seed) % len(names.split()) + 1).cast("int"))).otherwise(pick)
            picks.append(pick)
        asked = left.withColumn("chosen", F.concat_ws("-", *picks))
        if done is not None:
            asked = asked.join(done.select("script", "norm", "chosen"), ["script", "norm", "chosen"], "left_anti")
        won = asked.groupBy("script", "norm", "gender", "chosen").agg(F.min("given").alias("given")).select(*same, "chosen")
        done = scratch.save(won if done is None else done.unionByName(won), "named")
        left = scratch.save(left.join(done, same, "left_anti"), "unnamed")
        attempt += 1
    if done is None:
        return known.select("script", "norm", "given", F.lit("u").alias("g"), F.lit("").alias("chosen"))
    by_title = done.select("script", "norm", "given", F.col("gender").alias("g"), "chosen")
    unknown = known.where("u").withColumn("gender", F.col("of")).join(done, same).select("script", "norm", "given", F.lit("u").alias("g"), "chosen")
    return by_title.unionByName(unknown)


def with_entities(df: DataFrame, text_col: str) -> DataFrame:
    """``_entities``: the entities of the text in order, an empty array where there is none."""
    text = df[text_col]
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(f"({ENTITY})"), 1))
    return df.withColumn("_entities", F.coalesce(found, F.array().cast("array<string>")))


#: Entities with over a 2000th of all mentions, of these the short ones, are joined by broadcast: 2000 rows of 256 characters at most.
HOT_SHARE, HOT_LENGTH = 2000, 256


def _told(mention: DataFrame, table: DataFrame, counts: DataFrame) -> DataFrame:
    """``mention`` with its surrogate; entities that very many mentions name don't meet in one task."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where((F.col("n") > max(1000, total // HOT_SHARE)) & (F.char_length("norm") <= HOT_LENGTH)).select("kind", "norm")
    hot = F.broadcast(hot.join(table, ["kind", "norm"]))
    return mention.join(hot, ["kind", "norm"]).unionByName(mention.join(hot.select("kind", "norm"), ["kind", "norm"], "left_anti").join(table, ["kind", "norm"]))


def surrogates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Key | None = None) -> DataFrame:
    """(id, text, n_entities) of every row: its whole text with all entities replaced.

    Null text stays null, with no entities; a null id stays null; repeated rows give repeated rows; other columns are not
    read; an empty table gives no rows. Mentions in another format (separators, an honorific and its dot, initials with
    and without dots, an address all in capitals) get the same surrogate in their own format; an address in mixed case
    gets it in small letters. Without a key one is drawn for this process: give one to get the same surrogates again.
    What has nothing to replace, as 0.0.0.0, stays.
    """
    spark = df.sparkSession
    key = key or session_key()
    scratch = Scratch(spark, "pii")
    rows = with_entities(df.select(df[id_col].alias("_id"), df[text_col].alias("_text")), "_text")
    rows = scratch.save(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    with_some = rows.where(F.size("_entities") > 0)
    mention = with_some.select("_row", F.posexplode("_entities").alias("_pos", "entity")).withColumn("kind", kind_of(F.col("entity")))
    person = _person(F.col("entity"))
    name = F.col("kind") == "name"
    script = F.when(person.rlike(r"\p{IsGreek}"), "greek").when(person.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    gender = F.when(F.col("entity").rlike(FEMALE), "f").when(F.col("entity").rlike(EITHER), "u").otherwise("m")
    mention = mention.select(
        "_row", "_pos", "entity", "kind", normal(F.col("kind"), F.col("entity")).alias("norm"),
        F.when(name, script).alias("script"), F.when(name & F.contains(person, F.lit(" ")), F.regexp_replace(person, " [^ ]+$", "")).alias("given"), F.when(name, gender).alias("g"),
    )
    mention = scratch.save(mention, "mentions")
    counts = scratch.save(mention.groupBy("kind", "norm").agg(F.count("*").alias("n")), "counts")
    table = entity_table(counts, key, scratch)
    told = _told(mention, table, counts)
    people = mention.where("given is not null").select("script", "norm", "given", "g").distinct()
    if not people.isEmpty():
        named = given_names(people, key, scratch)
        told = told.where("given is not null").join(named, ["script", "norm", "given", "g"]).unionByName(told.where("given is null").withColumn("chosen", F.lit(None).cast("string")))
    else:
        told = told.withColumn("chosen", F.lit(None).cast("string"))
    given, entity = F.col("surrogate"), F.col("entity")
    bare = F.regexp_replace(entity, r"^\p{L}+\.?\s+", "")
    apart = F.when(F.regexp_extract(bare, "[ -]", 0) == "-", "-").otherwise(" ")
    surname = F.concat(F.coalesce(F.concat(F.col("chosen"), apart), F.lit("")), F.initcap(given))
    surname = F.when((bare == F.upper(bare)) & (F.char_length(bare) > 2), F.upper(surname)).otherwise(surname)
    shaped = (
        F.when(F.col("kind").isin("card", "phone", "ssn"), _fill(entity, "[0-9]", F.regexp_extract_all(given, F.lit("([0-9])"), 1)))
        .when(F.col("kind") == "iban", _fill(entity, "[0-9A-Z]", _chars(given)))
        .when(F.col("kind").isin("email", "ipv6") & (entity == F.upper("entity")), F.upper(given))
        .when(name, F.concat(F.regexp_extract(entity, r"^(\p{L}+\.?\s+)", 1), surname))
        .otherwise(given)
    )
    told = told.select("_row", F.struct("_pos", shaped.alias("new")).alias("_one"))
    told = told.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list("_one")), lambda x: x["new"]).alias("_new"))
    joined = _fill(F.col("_text"), ENTITY, F.col("_new"))
    changed = with_some.join(told, "_row").select(F.col("_id").alias(id_col), joined.alias(text_col), F.size("_entities").cast("bigint").alias("n_entities"))
    same = rows.where(F.size("_entities") == 0).select(F.col("_id").alias(id_col), F.col("_text").alias(text_col), F.lit(0).cast("bigint").alias("n_entities"))
    return changed.unionByName(same)


def op8_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    """The key is that of the session (see session_key)."""
    return surrogates(spark.read.parquet(f"{sf_dir}/documents.parquet"), key=session_key(spark))
