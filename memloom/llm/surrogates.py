"""Replaces personal data and secrets by keyed surrogates that stand for the same kind of thing.

Mentions are found by patterns and cut into parts: an address into user and domain, a person
into given name and surname, a number into its digits.  Each distinct part of the corpus gets
one surrogate, so the same part reads the same everywhere (coreference), in whatever format
it stands.  A surrogate is drawn from a keyed hash of the part: digits and letters in the same
places, card and account numbers with right check digits if the original's are right, reserved
addresses, names of the same gender and script.  Surrogates that several parts draw, or that
occur in the corpus themselves, are drawn again for all but the smallest part, until all differ
(distinctness).  What is left when a format has too few values gets a keyed tag instead.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.shared import Scratch, fresh, looked_up

#: Attempts at a surrogate, round by round; of a round's attempts a part takes the first that is free.
ROUNDS = ((0,), (1, 2, 3), (4, 5, 6, 7), (8, 9, 10, 11))
#: Secrets with fewer letters and digits, and those left after so many attempts, get surrogates that don't keep their shape.
LEAST_SHAPED, SHAPED_ATTEMPTS = 4, 4
#: How a tag begins, which stands where all attempts failed.
TAG = "<"
# Patterns of the entities, and words that introduce a person, by gender.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
CLOUD_KEY = r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"
SECRET_NAME = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)"
SECRET = rf"(?<![\p{{L}}\d]){SECRET_NAME}\s{{0,3}}[=:]\s{{0,3}}[\"']?[^\s\"']{{6,}}"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
PHONE = r"(?<![\w+])(?:(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w])"
CARD = r"(?<![\w.-])(?:\d[ -]?){12,18}\d(?![\w])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
MEN = ["Mr", "Herr", "Herrn", "Señor", "Monsieur", "Sir", "господин", "г-н", "κύριος"]
WOMEN = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme", "Lady", "госпожа", "г-жа", "κυρία"]
_NAME = r"\p{Lu}[\p{L}'’-]{1,40}"
PERSON = rf"(?<!\p{{L}})(?:{'|'.join(sorted({t for w in MEN + WOMEN for t in (w, w.upper())}, key=lambda t: (-len(t), t)))})\.? {_NAME}(?: {_NAME})?(?!\p{{L}})"
ANY = "|".join([EMAIL, CLOUD_KEY, SECRET, IPV4, PHONE, SSN, CARD, IBAN, PERSON])
# What names are made of.
GIVEN = {
    "latin_m": ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Leon", "Martin", "Oscar", "Paul", "Simon"],
    "latin_f": ["Alma", "Clara", "Diana", "Elena", "Flora", "Ida", "Julia", "Laura", "Marta", "Nora", "Sara", "Vera"],
    "cyrillic_m": ["Антон", "Борис", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Максим", "Павел", "Роман"],
    "cyrillic_f": ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Лидия", "Мария", "Нина", "Ольга", "Софья"],
    "greek_m": ["Άρης", "Γιώργος", "Δημήτρης", "Ηλίας", "Θάνος", "Κώστας", "Νίκος", "Πέτρος"],
    "greek_f": ["Άννα", "Βασιλική", "Ελένη", "Ζωή", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία"],
}
SYLLABLES = {
    "latin": ["ba", "del", "fen", "gor", "han", "kel", "lam", "mor", "nas", "par", "ral", "ser", "tor", "ven", "wil", "zan"],
    "cyrillic": ["ба", "вел", "гор", "дем", "жар", "зим", "кор", "лав", "мор", "нес", "пол", "рад", "сав", "тим", "фед", "яр"],
    "greek": ["βα", "γαλ", "δημ", "θε", "καλ", "λα", "μαν", "νικ", "παπ", "ρα", "σταμ", "τρι", "φω", "χρι"],
}
SURNAME_END = {"latin": "", "cyrillic_m": "ов", "cyrillic_f": "ова", "greek_m": "ίδης", "greek_f": "ίδου"}
#: Codes of countries have one, two or three digits, by the international numbering plan; the number follows.
COUNTRY_CODE = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})(\d{4,})$"
_PART = "array<struct<kind:string,value:string,text:string>>"


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _part(kind, value: Column, text: Column) -> Column:
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    return F.struct(kind.alias("kind"), value.alias("value"), text.alias("text"))


def _literal(text: Column) -> Column:
    return _part("", F.lit(""), text)


def parts(mention: Column) -> Column:
    """The parts of a mention, in order; parts of kind '' are no entities and stay."""
    m = mention
    local, domain = F.regexp_extract(m, "^(.*)@", 1), F.regexp_extract(m, "@(.*)$", 1)
    email = F.array(_part("user", F.lower(local), local), _literal(F.lit("@")), _part("domain", F.lower(domain), domain))
    opening = rf"^({SECRET_NAME}\s*[=:]\s*[\"']?)(.*)$"
    bare = F.regexp_extract(m, opening, 2)
    kind = F.when(bare.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lit("hex")).otherwise(F.lit("secret"))
    secret = F.array(_literal(F.regexp_extract(m, opening, 1)), _part(kind, bare, bare))
    number = _digits(m)
    number_kind = F.when(m.rlike(f"^(?:{SSN})$"), F.lit("ssn")).when(m.rlike(f"^(?:{PHONE})$"), F.lit("phone")).otherwise(F.lit("card"))
    abroad = F.regexp_extract(number, COUNTRY_CODE, 1)
    national = F.when((number_kind == "phone") & m.startswith("+") & (abroad != ""), abroad).when((number_kind == "phone") & (F.length(number) == 11) & number.startswith("1"), F.substring(number, 2, 10)).otherwise(number)
    digits = F.array(_part(number_kind, national, m))
    iban = F.array(_part("iban", F.regexp_replace(m, " ", ""), m))
    title = rf"^([\p{{L}}-]+\.? )({_NAME})(?: ({_NAME}))?$"
    first, second = F.regexp_extract(m, title, 2), F.regexp_extract(m, title, 3)
    spoken = F.regexp_extract(m, r"^([\p{L}-]+)", 1)
    gender = F.when(F.lower(spoken).isin([w.lower() for w in WOMEN]), F.lit("f")).otherwise(F.lit("m"))
    script = F.when(m.rlike(r"[\p{IsCyrillic}]"), F.lit("cyrillic")).when(m.rlike(r"[\p{IsGreek}]"), F.lit("greek")).otherwise(F.lit("latin"))
    given = _part(F.concat(F.lit("given_"), script, F.lit("_"), gender), F.lower(first), first)

    def surname(name: Column) -> Column:
        # surnames without gendered endings are one name for all
        return _part(F.concat(F.lit("surname_"), script, F.when(script == "latin", F.lit("")).otherwise(F.concat(F.lit("_"), gender))), F.lower(name), name)

    head = _literal(F.regexp_extract(m, title, 1))
    person = F.when(second != "", F.array(head, given, _literal(F.lit(" ")), surname(second))).otherwise(F.array(head, surname(first)))
    return (
        F.when(m.rlike(f"^{SECRET_NAME}\\s*[=:]"), secret)
        .when(m.contains("@"), email)
        .when(m.rlike(f"^(?:{CLOUD_KEY})$"), F.array(_part("cloud_key", m, m)))
        .when(m.rlike(f"^(?:{IPV4})$"), F.array(_part("ip", m, m)))
        .when(m.rlike(r"^[A-Z]{2}\d{2}"), iban)
        .when(m.rlike(r"^[\p{L}]"), person)
        .otherwise(digits)
        .cast(_PART)
    )


def _stream(key: str, attempt: Column) -> Column:
    """192 hex digits keyed by kind, value and attempt."""
    seed = F.concat_ws("|", F.lit(key), F.col("kind"), F.col("value"), attempt.cast("string"))
    return F.concat(*[F.sha2(F.concat(seed, F.lit(f"|{i}")), 256) for i in range(3)])


def _nth(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, (i * 3 % 186 + 1).cast("int"), F.lit(6)), 16, 10).cast("int")


def _pick(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), (n % len(alphabet) + 1).cast("int"), F.lit(1))


def _shape(value: Column, stream: Column) -> Column:
    """Letters and digits in the places of letters and digits."""

    def one(c: Column, i: Column) -> Column:
        n = _nth(stream, i)
        return (
            F.when(c.between("0", "9"), _pick("0123456789", n))
            .when(c.between("a", "z"), _pick("abcdefghijklmnopqrstuvwxyz", n))
            .when(c.between("A", "Z"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n))
            .when(c.between("а", "я"), _pick("абвгдежзийклмнопрстуфхцчшщыэюя", n))
            .when(c.between("α", "ω"), _pick("αβγδεζηθικλμνξοπρστυφχψω", n))
            .otherwise(c)
        )

    return F.array_join(F.transform(_chars(value), one), "")


def _wide(value: Column, stream: Column, more: int) -> Column:
    """Letters and digits, as many as the value has characters and some more."""
    places = F.sequence(F.lit(0), F.length(value) + F.lit(more - 1))
    return F.array_join(F.transform(places, lambda i: _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", _nth(stream, i))), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, the last one counted once."""

    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.transform(F.reverse(_chars(digits)), weigh), F.lit(0), lambda a, b: a + b) % 10


def _mod_97(text: Column) -> Column:
    """Digits and letters (A = 10 to Z = 35) as one number, modulo 97."""

    def add(sum_: Column, c: Column) -> Column:
        figure = c.between("0", "9")
        return (sum_ * F.when(figure, 10).otherwise(100) + F.when(figure, c.cast("int")).otherwise(F.ascii(c) - 55)) % 97

    return F.aggregate(_chars(text), F.lit(0), add)


def _of(names: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))


def draw(key: str, attempt: int) -> Column:
    """The surrogate of (kind, value) at an attempt."""
    stream, value, kind = _stream(key, F.lit(attempt)), F.col("value"), F.col("kind")
    n = [_nth(stream, F.lit(i)) for i in range(12)]
    shaped = _shape(value, stream)
    longer = attempt // 2
    user = shaped if not attempt else F.concat(shaped, *[_pick("abcdefghijklmnopqrstuvwxyz", x) for x in n[: min(12, longer)]])
    domain = F.concat(F.regexp_replace(_shape(F.regexp_replace(value, r"\.[^.]*$", ""), stream), r"(^|\.)-", "$1x"), *[_pick("abcdefghijklmnopqrstuvwxyz", x) for x in n[: min(12, longer)]], F.lit(".example"))
    hex_ = F.array_join(F.transform(_chars(value), lambda c, i: F.when(value.rlike("[A-F]"), _pick("0123456789ABCDEF", _nth(stream, i))).otherwise(_pick("0123456789abcdef", _nth(stream, i)))), "")
    # addresses nobody has: the reserved block from 240 on
    ip = F.concat_ws(".", (n[0] % 16 + 240).cast("string"), *[(x % 256).cast("string") for x in n[1:4]])
    cloud = F.concat(F.substring(value, 1, 4), F.array_join(F.transform(_chars(F.substring(value, 5, 99)), lambda c, i: _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", _nth(stream, i))), ""))
    phone = F.concat(_pick("23456789", n[11]), F.substring(shaped, 2, 99))
    body = F.concat(F.substring(value, 1, 1), F.expr("substring(_shaped, 2, length(value) - 2)"))
    check = (10 - _luhn(F.concat(body, F.lit("0")))) % 10
    last = F.when(_luhn(value) == 0, check).otherwise((check + 1 + n[10] % 9) % 10)
    card = F.concat(body, last.cast("string"))
    country, account = F.substring(value, 1, 2), F.expr("substring(_shaped, 5, 99)")
    right = 98 - _mod_97(F.concat(account, country, F.lit("00")))
    valid = _mod_97(F.concat(F.substring(value, 5, 99), F.substring(value, 1, 4))) == 1
    iban = F.concat(country, F.lpad(F.when(valid, right).otherwise((right - 1 + n[10] % 95) % 97 + 2).cast("string"), 2, "0"), account)
    # where the shape leaves too few values
    poor = F.length(F.regexp_replace(value, "[^0-9a-zA-Zа-яα-ω]", "")) < LEAST_SHAPED
    wide = kind.isin("secret", "hex") if attempt >= SHAPED_ATTEMPTS else (kind == "secret") & poor
    out = F.when(wide, _wide(value, stream, attempt)).when(kind == "user", user).when(kind == "domain", domain).when(kind == "hex", hex_).when(kind == "ip", ip).when(kind == "cloud_key", cloud)
    out = out.when(kind == "phone", phone).when(kind == "card", card).when(kind == "iban", iban)
    for group, names in GIVEN.items():
        given = F.concat_ws("-", *[_of(names, x) for x in n[: 1 + min(6, attempt)]])
        out = out.when(kind == f"given_{group}", given)
    for group, end in SURNAME_END.items():
        syllables = SYLLABLES[group.split("_")[0]]
        out = out.when(kind == f"surname_{group}", F.concat(F.initcap(F.concat(*[_of(syllables, x) for x in n[: 3 + min(8, longer)]])), F.lit(end)))
    return out.otherwise(shaped)


def assign(scratch: Scratch, originals: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) for each distinct (kind, value): surrogates of a kind all differ, and none is a value of its kind."""
    taken = scratch.table(originals.select("kind", F.lower("value").alias("_low")).distinct(), "taken")
    pending, accepted = originals, None
    for attempts in ROUNDS:
        drawn = []
        for n in attempts:
            shaped = _shape(F.col("value"), _stream(key, F.lit(n)))
            drawn.append(pending.withColumn("_shaped", F.when(F.col("kind").isin("card", "iban"), shaped)).select("kind", "value", F.lit(n).alias("n"), draw(key, n).alias("surrogate")))
        tried = reduce(DataFrame.unionByName, drawn)
        free = tried.withColumn("_low", F.lower("surrogate")).join(taken, ["kind", "_low"], "left_anti").drop("_low")
        if accepted is not None:
            free = free.join(accepted.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        # a surrogate goes to one part, and a part takes the first of those that go to it
        owned = free.groupBy("kind", "surrogate").agg(F.min(F.struct("n", "value")).alias("first")).select("kind", "surrogate", "first.n", "first.value")
        won = owned.groupBy("kind", "value").agg(F.min_by("surrogate", "n").alias("surrogate")).select("kind", "value", "surrogate")
        won = scratch.table(won, "won")
        accepted = won if accepted is None else accepted.unionByName(won)
        pending = scratch.table(pending.join(won.select("kind", "value"), ["kind", "value"], "left_anti"), "pending")
        if pending.isEmpty():
            return accepted
    seed = F.sha2(F.concat_ws("|", F.lit(key), F.lit("tag"), F.col("kind"), F.col("value")), 256)
    tags = pending.select("kind", "value", F.concat(F.lit(TAG), F.regexp_extract("kind", "^[a-z]+", 0), F.lit("-"), F.substring(seed, 1, 32), F.lit(">")).alias("surrogate"))
    return accepted.unionByName(tags)


def _render(part: Column, new: Column) -> Column:
    """A part's text with its surrogate, new: digits, or letters and digits, go into the places they have in the text."""
    text, kind = part["text"], part["kind"]
    skipped = F.length(_digits(text)) - F.length(new)  # a country code stands before the surrogate
    place = lambda i, other: F.length(F.regexp_replace(F.substring(text, F.lit(1), (i + 1).cast("int")), other, ""))

    def digit(c: Column, i: Column) -> Column:
        at = place(i, r"\D") - skipped
        return F.when(c.between("0", "9") & (at > 0), F.substring(new, at, F.lit(1))).otherwise(c)

    filled = F.array_join(F.transform(_chars(text), digit), "")
    spaced = F.array_join(F.transform(_chars(text), lambda c, i: F.when(c == " ", c).otherwise(F.substring(new, place(i, " "), F.lit(1)))), "")
    loud = (F.length(text) > 1) & (text == F.upper(text)) & (text != F.lower(text)) & ~kind.isin("hex", "secret", "cloud_key", "iban")
    return F.when(kind == "", text).when(new.startswith(TAG), new).when(kind.isin("phone", "card", "ssn"), filled).when(kind == "iban", spaced).when(loud, F.upper(new)).otherwise(new)


def pseudonymise(df: DataFrame, text_col: str = "text", key: str = "memloom") -> DataFrame:
    """The rows of df with all mentions in the text replaced, and ``_mentions``, their number
    (with more underscores if there is such a column).

    All other columns stay.  Null texts stay null; texts without a mention stay as they are to
    the byte.  Equal mentions get equal surrogates in all rows; the key decides them.  A format
    with too few values for all its mentions gets tags (such as ``<ssn-...>``) for the rest.
    Repeated rows are each treated alike, an empty table gives an empty result; texts of any
    length are taken whole.
    """
    scratch = Scratch(df.sparkSession, "surrogates")
    number = fresh(df.columns, "_mentions")
    text = F.col(f"`{text_col}`").cast("string")
    own = [F.col(f"`{c}`") for c in df.columns]
    hit = F.coalesce(text.rlike(ANY), F.lit(False))
    plain = df.where(~hit).select(*own, F.lit(0).alias(number))
    mentions = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), parts)
    # the row itself is one column, so that its columns' names don't matter
    found = df.where(hit).select(F.struct(*own).alias("row"), F.monotonically_increasing_id().alias("id"), F.split(text, ANY).alias("pieces"), mentions.alias("parts"))
    found = scratch.table(found, "found")
    mentioned = found.select("id", F.posexplode("parts").alias("mention", "ps"))
    seen = mentioned.select("id", "mention", F.posexplode("ps").alias("nth", "p")).where("p.kind <> ''").select("id", "mention", "nth", "p.kind", "p.value")
    chosen = assign(scratch, scratch.table(seen.select("kind", "value").distinct(), "entities"), key)
    # a part may stand in very many texts: its rows meet its surrogate in lanes.  Back at their texts, surrogates are found by
    # the place of their mention, each of which has at least one and two at most
    named = looked_up(seen, scratch.table(chosen, "chosen"), ["kind", "value"], "id").repartition("id")
    by_mention = named.groupBy("id", "mention").agg(F.collect_list(F.struct("nth", "surrogate")).alias("new"))
    names = by_mention.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("mention", "new"))).alias("names"))  # as many as a text has mentions

    def written(ps: Column, own: Column) -> Column:
        return F.array_join(F.transform(ps, lambda p, i: _render(p, F.element_at(F.map_from_entries(own["new"]), i))), "")

    new = F.zip_with("parts", "names", written)
    replaced = F.array_join(F.zip_with("pieces", new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    done = found.join(names, "id")
    columns = [replaced.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns]
    return plain.unionByName(done.select(*columns, F.size("parts").alias(number)))


def surrogate_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = "memloom") -> DataFrame:
    """One row per row of df: (doc_id, text with surrogates, n_mentions)."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return pseudonymise(rows, key=key).withColumnRenamed("_mentions", "n_mentions")
