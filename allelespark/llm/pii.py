"""PII surrogates by keyed, shape-preserving bijections; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, store

# Given names by gender, titles, and the alphabets within which a character is replaced.
MALE = "James John Robert Michael William David Thomas Charles Daniel Paul Mark George Peter Hans Karl Stefan Jürgen Wolfgang Klaus Andreas Jean Pierre Michel Luc Antoine Louis José Juan Carlos Luis Miguel Antonio".split()
FEMALE = "Mary Patricia Linda Barbara Elizabeth Jennifer Susan Sarah Karen Nancy Anna Emma Laura Julia Petra Ursula Monika Sabine Heike Ingrid Marie Jeanne Sophie Camille Claire Hélène María Carmen Ana Isabel Lucía Elena".split()
TITLES = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señor|Señora|Señorita|Sr|Sra)\.?"
ALPHABETS = (
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ",
    "àáâäãåæèéêëìíîïòóôöõøùúûüý", "çñßšžđ", "ÀÁÂÄÃÅÆÈÉÊËÌÍÎÏÒÓÔÖÕØÙÚÛÜÝ", "ÇÑŠŽĐ",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ",
    "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
)
#: Blocks of letters; those that no alphabet above has are alphabets of their own, by block and case.
BLOCKS = ((0xAA, 0x24F), (0x370, 0x3FF), (0x400, 0x52F), (0x531, 0x587), (0x5D0, 0x5EA), (0x620, 0x64A), (0x904, 0x939), (0xE01, 0xE2E), (0x10A0, 0x10FF), (0x1E00, 0x1EFF), (0x1F00, 0x1FFF), (0x3041, 0x3096), (0x30A1, 0x30FA))
#: Digits of an IPv6 address, in lower case.
HEX = "0123456789abcdef"


def _alphabets() -> tuple[str, ...]:
    """ALPHABETS and, by rule, the other letters of BLOCKS, so that every letter of these has others to become."""
    import unicodedata

    have, more = set("".join(ALPHABETS)), []
    for first, last in BLOCKS:
        for case in ("Ll", "Lu", "Lo"):
            rest = "".join(chr(i) for i in range(first, last + 1) if unicodedata.category(chr(i)) == case and chr(i) not in have)
            if len(rest) > 1:
                more.append(rest)
    return ALPHABETS + tuple(more)

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Kinds and their patterns, tried in this order at each place.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9](?:[A-Za-z0-9-]*\.)+[A-Za-z]{2,}",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\d.]*\d)",
    "ipv6": r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w:])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:)(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![\w:])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<![\w-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?![\w-])|(?<![\w-])3[47]\d{2}(?: \d{6} |-\d{6}-|\d{6})\d{5}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<!\w)\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\w)|(?<![\w-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    "name": rf"(?<!\p{{L}})(?:{TITLES} \p{{Lu}}\p{{L}}+(?:[ -]\p{{Lu}}\p{{L}}+)?|(?:{'|'.join([*MALE, *FEMALE])}) \p{{Lu}}\p{{L}}+)(?!\p{{L}})",
}
_NUMBERS = "|".join(f"(?:{KINDS[k]})" for k in ("ip", "card", "ssn", "phone")).replace(r"([ -]?)\d{4}\1\d{4}\1", r"(?: \d{4} \d{4} |-\d{4}-\d{4}-|\d{8})")
#: Names alone, for texts without a digit and an @, and all kinds; a look at the next character spares most places the rest.
NAMES = f"(?=[A-Z])(?:{KINDS['name']})"
PATTERN = rf"(?:{KINDS['email']})|(?=[0-9A-Fa-f])(?:{KINDS['ipv6']})|(?=[A-Z])(?:{KINDS['iban']})|(?=[\d+(])(?:{_NUMBERS})|{NAMES}"


def kind_of(entity: Column) -> Column:
    out = F.lit("card")
    for kind, rule in (("ssn", r"^\d{3}-\d{2}-\d{4}$"), ("phone", r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$"), ("ip", r"^\d+(\.\d+){3}$"), ("name", r"^\p{Lu}"), ("iban", r"^[A-Z]{2}\d{2}[ A-Z0-9]+$"), ("ipv6", r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$"), ("email", "@")):
        out = F.when(entity.rlike(rule), kind).otherwise(out)
    return out


def _number(hex_: Column, digits: int = 12) -> Column:
    return F.conv(F.substring(hex_, 1, digits), 16, 10).cast("long")


def _hash(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *(p.cast("string") for p in parts)), 512)


def _places(alphabets: tuple[str, ...]) -> tuple[str, list[int], list[int]]:
    """All letters end to end, and for each where its alphabet begins and how long that is."""
    begin = [b for k, a in enumerate(alphabets) for b in [1 + sum(map(len, alphabets[:k]))] * len(a)]
    return "".join(alphabets), begin, [len(a) for a in alphabets for _ in a]


_ANY, _HEX = _places(_alphabets()), _places((HEX,))


def _constant(values: list) -> Column:
    """A constant array from one literal, which the optimizer folds; an array of literals costs a call each."""
    return F.split(F.lit(",".join(map(str, values))), ",")


def _move(c: Column, by: Column, letters) -> Column:
    """A character moved within its alphabet; null if it has none."""
    all_, begins, sizes = letters
    at = F.instr(F.lit(all_), c)
    begin, size = F.get(_constant(begins).cast("array<int>"), at - 1), F.get(_constant(sizes).cast("array<int>"), at - 1)
    return F.when(at > 0, F.substr(F.lit(all_), begin + F.pmod(at - begin + by, size), F.lit(1)))


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _shift(s: Column, stream: Column, sign: Column, letters) -> Column:
    """Each character of s moved within its alphabet by the stream's bytes, forth or back; others stay."""

    def one(c: Column, i: Column) -> Column:
        by = F.conv(F.substr(stream, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        return F.coalesce(_move(c, sign * by, letters), c)

    return F.array_join(F.transform(_chars(s), one), "")


def _next(s: Column, letters) -> Column:
    """s with its first character that has an alphabet moved on by one: no string but one without such stays as it is."""
    state = F.struct(F.lit("").alias("out"), F.lit(False).alias("done"))

    def step(acc: Column, c: Column) -> Column:
        moved = _move(c, F.lit(1), letters)
        return F.struct(F.concat(acc["out"], F.when(acc["done"], c).otherwise(F.coalesce(moved, c))).alias("out"), (acc["done"] | moved.isNotNull()).alias("done"))

    return F.aggregate(_chars(s), state, step, lambda acc: acc["out"])


def _shape(s: Column, key: str, salt: Column, letters=_ANY) -> Column:
    """A keyed bijection of the strings of one shape that leaves none as it was: a Feistel network of shifts, each half moved by a
    hash of the other twice over, then _next(), then the network backwards. A conjugate of a map without fixed points has none."""
    half = F.floor(F.length(s) / 2).cast("int")
    split = lambda x: F.struct(F.substr(x, F.lit(1), half).alias("l"), F.substr(x, half + 1, F.length(x)).alias("r"))

    def turn(sign: int):
        def go(acc: Column, i: Column) -> Column:
            side = F.pmod(i, F.lit(2)) == 0
            fixed, moved = F.when(side, acc["l"]).otherwise(acc["r"]), F.when(side, acc["r"]).otherwise(acc["l"])
            turned = _shift(moved, _hash(key, salt, i, fixed), F.lit(sign), letters)
            return F.struct(F.when(side, fixed).otherwise(turned).alias("l"), F.when(side, turned).otherwise(fixed).alias("r"))

        return go

    rounds = lambda order: F.array(*map(F.lit, order))
    there = F.aggregate(rounds(range(1, 5)), split(s), turn(1), lambda acc: F.concat(acc["l"], acc["r"]))
    # through one-element arrays, so that each step is computed once
    on = F.transform(F.array(there), lambda x: _next(x, letters))
    back = F.transform(on, lambda x: F.aggregate(rounds(range(4, 0, -1)), split(x), turn(-1), lambda acc: F.concat(acc["l"], acc["r"])))
    return F.get(back, F.lit(0))


def _iban_check(country: Column, body: Column) -> Column:
    """The check number of an account's country and body."""
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    rest = F.aggregate(_chars(F.concat(body, country, F.lit("00"))), F.lit(0), lambda r, c: F.pmod(r * F.when(value(c) > 9, 100).otherwise(10) + value(c), F.lit(97)).cast("int"))
    return 98 - rest


def _iban(found: Column, given: Column) -> Column:
    """given, permuted behind its fourth character, with check digits as far from the right ones as found's were."""
    was, now = F.regexp_replace(found, " ", ""), F.regexp_replace(given, " ", "")
    right = lambda x: _iban_check(F.substring(x, 1, 2), F.substr(x, F.lit(5), F.length(x)))
    digits = 2 + F.pmod(right(now) - 2 + F.substring(was, 3, 2).cast("int") - right(was), F.lit(97))
    return F.concat(F.substring(given, 1, 2), F.lpad(digits.cast("int").cast("string"), 2, "0"), F.substr(given, F.lit(5), F.length(given)))


def _luhn(body: Column) -> Column:
    """The check digit of a string of digits."""
    digits = F.transform(F.filter(F.split(F.reverse(body), ""), lambda c: c != ""), lambda c, i: c.cast("int") * F.when(F.pmod(i, F.lit(2)) == 0, 2).otherwise(1))
    total = F.aggregate(digits, F.lit(0), lambda acc, d: acc + F.when(d > 9, d - 9).otherwise(d))
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10))


def _plain(e: Column) -> Column:
    return F.regexp_replace(e, "[ -]", "")


def _ip(e: Column, key: str) -> Column:
    """The first octet stays; the other 24 bits pass a Feistel network of halves of 12 bits, a step of one, and the network back."""
    o = F.transform(F.split(e, r"\."), lambda x: x.cast("long"))
    x = F.get(o, 1) * 65536 + F.get(o, 2) * 256 + F.get(o, 3)
    low = F.lit(4095)
    f = lambda side, i, v: _number(_hash(key, F.lit(side), i, v)).bitwiseAND(low)
    split = lambda v: F.struct(F.shiftright(v, 12).alias("l"), v.bitwiseAND(low).alias("r"))

    def there(acc: Column, i: Column) -> Column:
        left = acc["l"].bitwiseXOR(f("ip", i, acc["r"]))
        return F.struct(left.alias("l"), acc["r"].bitwiseXOR(f("ip'", i, left)).alias("r"))

    def back(acc: Column, i: Column) -> Column:
        right = acc["r"].bitwiseXOR(f("ip'", i, acc["l"]))
        return F.struct(acc["l"].bitwiseXOR(f("ip", i, right)).alias("l"), right.alias("r"))

    join = lambda acc: acc["l"] * 4096 + acc["r"]
    y = F.transform(F.array(x), lambda v: F.pmod(F.aggregate(F.array(F.lit(1), F.lit(2)), split(v), there, join) + 1, F.lit(1 << 24)))
    y = F.get(F.transform(y, lambda v: F.aggregate(F.array(F.lit(2), F.lit(1)), split(v), back, join)), F.lit(0))
    return F.concat_ws(".", F.get(o, 0).cast("string"), F.shiftright(y, 16).cast("string"), F.shiftright(y, 8).bitwiseAND(F.lit(255)).cast("string"), y.bitwiseAND(F.lit(255)).cast("string"))


def _listed(w: Column, key: str) -> Column:
    """Another given name of the same gender, by a keyed rotation of its list; null for any other word."""
    out = F.lit(None).cast("string")
    for names in (MALE, FEMALE):
        turn = 1 + F.pmod(_number(_hash(key, F.lit(names[0]))), F.lit(len(names) - 1))
        at = F.array_position(_constant(names), w)
        out = F.when(at > 0, F.get(_constant(names), F.pmod(at - 1 + turn, F.lit(len(names))).cast("int"))).otherwise(out)
    return out


def _parts(e: Column, kind: Column) -> Column:
    """An entity cut in pieces, each with whether it is to be replaced."""
    fixed = lambda c: F.struct(c.alias("piece"), F.lit(False).alias("new"))
    fresh = lambda c: F.struct(c.alias("piece"), F.lit(True).alias("new"))
    email = r"^([^@]*)@(.*)(\.[^.]*)$"
    keep = r"^((?:\+\d{1,3}[ .-]?)?\(?\d)(.*)$"
    words = F.regexp_extract_all(F.regexp_replace(e, rf"^{TITLES} ", ""), F.lit("[ -]|[^ -]+"), 0)
    out = F.when(kind == "email", F.array(fresh(F.regexp_extract(e, email, 1)), fixed(F.lit("@")), fresh(F.regexp_extract(e, email, 2)), fixed(F.regexp_extract(e, email, 3))))
    out = out.when(kind == "phone", F.array(fixed(F.regexp_extract(e, keep, 1)), fresh(F.regexp_extract(e, keep, 2))))
    out = out.when(kind == "name", F.concat(F.array(fixed(F.regexp_extract(e, rf"^(?:{TITLES} )?", 0))), F.transform(words, fresh)))
    out = out.when(kind == "iban", F.array(fixed(F.substring(e, 1, 4)), fresh(F.substr(e, F.lit(5), F.length(e)))))
    out = out.when(kind == "card", F.array(fixed(F.substring(e, 1, 1)), fresh(F.substr(e, F.lit(2), F.length(e) - 2)), fixed(F.substring(e, -1, 1))))
    return out.otherwise(F.array(fresh(e)))


def surrogates(found: Column, key: str) -> Column:
    """An array of (kind, found, given) for an array of entities. For each kind and format the mapping is a bijection: equal
    entities get equal replacements, different ones different ones, wherever they stand. Of a card number all digits but the
    first and the last are permuted; the last is as far from the check digit as it was."""
    named = F.transform(found, lambda e: F.struct(kind_of(e).alias("kind"), e.alias("found")))
    cut_up = F.transform(named, lambda x: F.struct(x["kind"].alias("kind"), x["found"].alias("found"), _parts(x["found"], x["kind"]).alias("parts")))

    def piece(kind: Column):
        def new(p: Column) -> Column:
            shaped = F.when(kind == "ipv6", _shape(F.lower(p["piece"]), key, kind, _HEX)).otherwise(_shape(p["piece"], key, kind))
            return F.when(~p["new"] | (F.length(p["piece"]) == 0), p["piece"]).otherwise(F.coalesce(F.when(kind == "name", _listed(p["piece"], key)), shaped))

        return new

    given = F.transform(cut_up, lambda x: F.struct(x["kind"].alias("kind"), x["found"].alias("found"), F.when(x["kind"] == "ip", _ip(x["found"], key)).otherwise(F.array_join(F.transform(x["parts"], piece(x["kind"])), "")).alias("given")))

    def checked(x: Column) -> Column:
        was, now = _plain(x["found"]), _plain(x["given"])
        body = lambda x: F.substr(x, F.lit(1), F.length(x) - 1)
        digit = F.pmod(_luhn(body(now)) + F.substring(was, -1, 1).cast("int") - _luhn(body(was)), F.lit(10))
        card = F.concat(F.substr(x["given"], F.lit(1), F.length(x["given"]) - 1), digit.cast("string"))
        return F.struct(x["kind"].alias("kind"), x["found"].alias("found"), F.when(x["kind"] == "card", card).when(x["kind"] == "iban", _iban(x["found"], x["given"])).otherwise(x["given"]).alias("given"))

    return F.transform(given, checked)


_CAPITALS = "A-Z"  # what a title or a listed given name begins with


def _surnames(text: Column) -> Column:
    """Last words of the names found in a text, of three letters and more, without repeats."""
    last = F.transform(F.regexp_extract_all(text, F.lit(NAMES), F.lit(0)), lambda n: F.element_at(F.split(n, "[ -]"), -1))
    return F.array_distinct(F.filter(last, lambda w: F.length(w) > 2))


def replace(docs: DataFrame, key: str, entities: str = "entities") -> DataFrame:
    """docs with the entities of text replaced, and a column of them, an array of (kind, found, given) in order; other columns
    stay, and the new one takes the name entities, with as many underscores behind it as no input column has.

    Entities are emails, IPv4 and IPv6 addresses, IBANs, card numbers of 15 and 16 digits, US social security and phone
    numbers, names after a title or that begin with a listed given name, and the surnames of these where they stand alone in
    the same text. No replacement equals what it stands for. Replacements keep letter case, script, digits, separators, the
    top-level domain, the country code, the validity of card and account numbers, titles and the gender of listed names; a
    host's mapping is the same in all addresses and a surname's in all names. Null texts stay null and have no entities;
    empty ones and those without entities stay as they are; repeated rows have the same result. Nothing is shuffled.
    """
    while entities in docs.columns:
        entities += "_"
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # so that no input column clashes with a helper's
    at = inner["text"]
    text = F.col(at)
    # each helper is a column of its own, so that its pattern runs once over a text
    d = docs.toDF(*inner.values()).withColumn("alone", F.when(text.rlike(f"[{_CAPITALS}]"), _surnames(text)))
    base = F.when(text.rlike("[0-9@:]"), F.lit(PATTERN)).otherwise(F.lit(NAMES))
    own = F.concat(base, F.lit("|(?<!\\p{L})(?:"), F.array_join("alone", "|"), F.lit(")(?!\\p{L})"))
    d = d.withColumn("pattern", F.when(F.size("alone") > 0, own).when(text.rlike("[0-9@:]") | F.col("alone").isNotNull(), base))
    d = d.withColumn("found", F.coalesce(F.when(F.col("pattern").isNotNull(), F.regexp_extract_all(text, F.col("pattern"), F.lit(0))), F.array().cast("array<string>")))
    d = d.withColumn("entities", surrogates(F.col("found"), key))
    joined = F.zip_with(F.split(text, F.col("pattern"), F.lit(-1)), F.col("entities.given"), lambda p, g: F.concat(F.coalesce(p, F.lit("")), F.coalesce(g, F.lit(""))))
    d = d.withColumn(at, F.when(F.size("entities") > 0, F.array_join(joined, "")).otherwise(text))
    return d.select(*(F.col(v).alias(c) for c, v in inner.items()), F.col("entities").alias(entities))


def audit(replaced: DataFrame, entities: str = "entities") -> dict[str, int]:
    """Over the entities of all documents: how many there are, how many replacements two of them share, how many equal what they
    stand for (none of either, or the mapping is at fault), and how many replacements are also entities of the documents."""
    e = replaced.select(F.explode(entities).alias("e")).select("e.kind", "e.found", "e.given").distinct()
    e = cut(e)
    shared = e.groupBy("kind", "given").agg(F.count("*").alias("n")).filter("n > 1")
    again = e.select("kind", F.col("given").alias("found")).join(e.select("kind", "found"), ["kind", "found"], "left_semi")
    return {"entities": e.count(), "shared": shared.count(), "unchanged": e.filter("found = given").count(), "reused": again.count()}


def _of(kind: str):
    return lambda e: e["kind"] == kind


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_email, ..., n_entities, corpus_shared, corpus_reused) for each row of docs(doc_id, text).

    The replaced texts are written once in the shared folder and audited by their entities alone. The counts of audit() stand in every row; shared or
    unchanged replacements raise ValueError before any row is returned.
    """
    r = store(replace(docs.select("doc_id", "text"), key))
    checked = audit(r)
    if checked["shared"] or checked["unchanged"]:
        raise ValueError(f"{checked['shared']} replacements stand for more than one entity, {checked['unchanged']} for themselves")
    n = [F.size(F.filter("entities", _of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return r.select("doc_id", "text", *n, F.size("entities").cast("long").alias("n_entities"), F.lit(checked["shared"]).cast("long").alias("corpus_shared"), F.lit(checked["reused"]).cast("long").alias("corpus_reused"))
